"""Files made of ordered rows: one file per name, streamed by the task that holds its rows, complete or absent."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def write_in_order(rows: DataFrame, order: list[str], path_col: str = "path", data_col: str = "data") -> DataFrame:
    """Write each path's ``data`` (binary), in ``order``, to that path; returns (path, bytes).

    Rows are dealt by path and sorted, so a task holds one batch at a time. A
    file is written under a temporary name and renamed when complete: a
    repeated task leaves one file. Nothing is written before the result is
    computed. Paths must be in a store that tasks can reach.
    """
    dealt = rows.select(path_col, *order, data_col).repartition(path_col).sortWithinPartitions(path_col, *order).select(path_col, data_col)

    def run(batches):
        out = path = name = system = None
        size, done = 0, []

        def close():
            out.close()
            system.move(name[1], name[0])
            done.append((path, size))

        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != path:
                    if out is not None:
                        close()
                    path, size = at, 0
                    system, own = fs.FileSystem.from_uri(at)
                    name = (own, f"{own}.{uuid.uuid4().hex}.tmp")
                    system.create_dir(own.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name[1])
                if data.is_valid:
                    view = data.as_buffer()
                    out.write(view)
                    size += view.size
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["path", "bytes"])

    return dealt.mapInArrow(run, "path string, bytes long")
