"""Road corridor of an observation from border lines: bounds to both sides and how far a vehicle is outside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reach along x (m), margin and floor of an excursion (m), lane labels of vehicles on the road.
REACH_M, MARGIN_M, FLOOR_M = 40.0, 0.3, 0.05
#: Rows by points of a snapshot that are compared at once.
BLOCK = 1 << 18
ON_ROAD = ["EGO lane", "1st Left", "2nd Left", "1st Right", "2nd Right"]


def _snapshots(rows: pa.RecordBatch) -> list[tuple]:
    """(line, time, (x, y) of the points or None) of each row."""
    lists = rows.column("__points")
    xy = lists.values
    x, y = (pc.struct_field(xy, c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    ends = lists.offsets.to_numpy()
    points = [(x[a:b], y[a:b]) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
    return list(zip(rows.column("__line").to_pylist(), rows.column("__ts").to_pylist(), points, strict=True))


def _innermost(snaps: list[tuple], t, x_rel, ex, ey, cos, sin) -> tuple[np.ndarray, np.ndarray]:
    """Least y > 0 and largest y <= 0 of the lines' nearest points; not finite without one. snaps: by line, times and points."""
    left, right = np.full(len(t), np.inf), np.full(len(t), -np.inf)
    for at, points in snaps:
        # a snapshot holds from the first time that is nearer to it than to the one before
        near = np.searchsorted((at[:-1] + at[1:]) // 2 + 1, t, side="right")
        for k in np.unique(near):
            px, py = points[k]
            of = np.flatnonzero(near == k)
            for r in np.array_split(of, 1 + len(of) * len(px) // BLOCK) if len(px) else ():
                dx, dy, c, s = px - ex[r, None], py - ey[r, None], cos[r, None], sin[r, None]
                gap = np.abs(dx * c + dy * s - x_rel[r, None])
                gap[np.isnan(gap)] = np.inf
                j = (np.arange(len(r)), gap.argmin(axis=1))
                y = np.where(gap[j] <= REACH_M, (dy * c - dx * s)[j], np.nan)
                left[r] = np.fmin(left[r], np.where(y > 0, y, np.nan))
                right[r] = np.fmax(right[r], np.where(y <= 0, y, np.nan))
    return left, right


def bounds(obs: DataFrame, lines: DataFrame) -> DataFrame:
    """``obs`` (with ex, ey, eyaw) and the innermost border to the left (y > 0) and right, in the ego's frame at its time; null without one.

    Each line counts with its snapshot that is nearest in time (ties: the
    earlier), and of that with the point nearest along x, the first of equals,
    if it is in reach. lines: trace_id, line_id, t_us, points (array of x, y in
    the global frame); of snapshots with one time one counts.

    A trace's rows and lines meet by one exchange on the trace and are sorted by
    it, lines first, so that a task streams through its traces in Arrow batches of
    many of them. Held at a time are a batch and one trace's lines; points of a
    snapshot are turned for blocks of rows at once.
    """
    turned = obs.withColumns({"__cos": F.cos("eyaw"), "__sin": F.sin("eyaw"), "__k": F.lit(1)})
    named = lines.where("trace_id is not null").select("trace_id", F.lit(0).alias("__k"), F.col("line_id").alias("__line"), F.col("t_us").alias("__ts"), F.col("points").alias("__points"))
    helpers = ["__cos", "__sin", "__k", "__line", "__ts", "__points"]
    met = turned.unionByName(named, allowMissingColumns=True).repartition("trace_id").sortWithinPartitions("trace_id", "__k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, own, snaps = (), {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, kinds = batch.column("trace_id").to_pylist(), batch.column("__k").to_numpy()
            is_line = np.flatnonzero(kinds == 0)
            read = dict(zip(is_line.tolist(), _snapshots(batch.take(pa.array(is_line))), strict=True)) if len(is_line) else {}
            floats = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in ("x_rel", "ex", "ey", "__cos", "__sin")}
            t = batch.column("t_us").cast(pa.int64()).fill_null(np.iinfo(np.int64).min // 4).to_numpy()
            left, right = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
            starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                if trace != (ids[a],):
                    trace, own, snaps = (ids[a],), {}, None
                first = a + int((kinds[a:b] == 0).sum())
                for line, at, points in (read[i] for i in range(a, first)):
                    if at is not None and points is not None:
                        own.setdefault(line, {}).setdefault(at, points)
                if first < b:
                    if snaps is None:
                        snaps = [(np.array(sorted(found), dtype=np.int64), [found[k] for k in sorted(found)]) for found in own.values()]
                    of = slice(first, b)
                    left[of], right[of] = _innermost(snaps, t[of], *(v[of] for v in floats.values()))
            out = batch.filter(pa.array(kinds == 1)) if len(is_line) else batch
            out = out.drop_columns(helpers)
            for name, v in (("left_m", left[kinds == 1]), ("right_m", right[kinds == 1])):
                out = out.append_column(name, pa.array(v, mask=~np.isfinite(v)))
            yield out

    schema = T.StructType([*obs.schema, T.StructField("left_m", T.DoubleType()), T.StructField("right_m", T.DoubleType())])
    return met.mapInArrow(run, schema)


def excursion(rows: DataFrame) -> DataFrame:
    """``rows`` with excursion and side: how far the box is outside as a whole but for the margin, 0 below 5 cm.

    The box's edge towards the road decides. A lane label of the road says that
    the vehicle is on it. A box out to the left isn't tested to the right.
    """
    half = F.col("width") / 2
    left = F.col("y_rel") - half - (F.col("left_m") - MARGIN_M)
    right = F.col("right_m") + MARGIN_M - (F.col("y_rel") + half)
    on = F.coalesce(F.col("lane").isin(ON_ROAD), F.lit(False))
    side = F.when(on, None).when(left > 0, "left").when(right > 0, "right")
    out = F.when(side == "left", left).when(side == "right", right)
    return rows.withColumns({"excursion": F.when(out >= FLOOR_M, out).otherwise(0.0), "side": F.when(out >= FLOOR_M, side)})
