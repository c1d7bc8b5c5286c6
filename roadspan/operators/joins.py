"""Joins along time: interpolating as-of and nearest within a tolerance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspan.functions.exprs import wrap_radians, yaw_of_heading


def interp_asof(obs: DataFrame, ego: DataFrame, offset_us: int = 0) -> DataFrame:
    """``obs`` with the ego's position, speed and yaw at its time: ex, ey, es, eyaw.

    One sort per trace and no join: poses carry their successor, and a running
    window brings the last pose to each observation. Outside of the recording
    the first or last pose holds; of poses with one time the last counts.
    Traces without a pose have nulls.
    """
    by_time = Window.partitionBy("trace_id").orderBy("t_us", "seq")
    pose = F.struct("t_us", "x_m", "y_m", "speed", yaw_of_heading(F.col("heading_deg")).alias("yaw"))
    poses = ego.select("trace_id", F.col("t_us").alias("__t"), F.lit(0).alias("__k"), F.struct(pose.alias("a"), F.lead(pose).over(by_time).alias("b")).alias("__p"), "seq")
    first = Window.partitionBy("trace_id").orderBy("__t", "__k", "seq")
    poses = poses.withColumn("seq", F.col("seq").cast("long"))
    rows = obs.select("trace_id", (F.col("t_us") + offset_us).alias("__t"), F.lit(1).alias("__k"), F.struct(*obs.columns).alias("__o"))
    both = poses.unionByName(rows, allowMissingColumns=True)
    last = F.last("__p", ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("trace_id").orderBy("__t", "__k", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = both.withColumns({"__l": last, "__f": F.first("__p", ignorenulls=True).over(whole)}).where("__k = 1")
    a = lambda c: F.coalesce(F.col(f"__l.a.{c}"), F.col(f"__f.a.{c}"))
    b = lambda c: F.coalesce(F.col(f"__l.b.{c}"), a(c))
    span = F.col("__l.b.t_us") - F.col("__l.a.t_us")
    f = F.when(span > 0, (F.col("__t") - F.col("__l.a.t_us")) / span).otherwise(0.0)
    mid = lambda c: a(c) + (b(c) - a(c)) * f
    # the key that rows were dealt by, so that what follows by trace needs no exchange
    key = F.col("trace_id") if rows.schema["trace_id"].dataType == both.schema["trace_id"].dataType else F.col("__o.trace_id")
    own = [key.alias(c) if c == "trace_id" else F.col(f"__o.{c}") for c in obs.columns]
    return found.select(*own, mid("x_m").alias("ex"), mid("y_m").alias("ey"), mid("speed").alias("es"), (a("yaw") + wrap_radians(b("yaw") - a("yaw")) * f).alias("eyaw"))


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], tolerance_us: int = 300_000) -> DataFrame:
    """Each left row with the right row of equal keys that is nearest in time, at most ``tolerance_us`` away.

    Both sides are put together and sorted once per key, forth and back: running
    windows bring the last right row up to each time and the first from it on,
    so nothing is paired off and repeated left rows stay. Ties go to the
    earlier time, then to the largest ordinal; rows without a time, left rows
    without a partner and null keys are left out. left: keys, id columns, t_us;
    right: keys, t_us, ord and payload columns, which the result holds as the
    struct ``near``.
    """
    known = " and ".join(f"{k} is not null" for k in [*keys, "t_us"])
    part = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    r = right.where(known).select(*part, F.col("t_us").alias("__t"), F.lit(0).alias("__k"), F.col("ord").cast("long").alias("__ord"), F.struct(*right.columns).alias("__r"))
    l = left.where(known).select(*part, F.col("t_us").alias("__t"), F.lit(1).alias("__k"), F.struct(*left.columns).alias("__l"))  # noqa: E741
    w = Window.partitionBy(*(f"__key{i}" for i in range(len(keys))))
    so_far = lambda t: F.last("__r", ignorenulls=True).over(w.orderBy(t, "__k", "__ord").rowsBetween(Window.unboundedPreceding, 0))
    met = r.unionByName(l, allowMissingColumns=True).withColumns({"__a": so_far(F.col("__t")), "__b": so_far(F.desc("__t"))}).where("__k = 1")
    before, after = F.col("__t") - F.col("__a.t_us"), F.col("__b.t_us") - F.col("__t")
    near = F.when(F.col("__b").isNull() | (before <= after), F.col("__a")).otherwise(F.col("__b"))
    return met.withColumn("near", near).where(F.abs(F.col("near.t_us") - F.col("__t")) <= tolerance_us).select("__l.*", "near")


#: Rows of whole traces that are looked through at once at least, and pairs that are given back at once, about.
BATCH, OUT = 1 << 14, 1 << 15


def _pairs_in_time(obj: np.ndarray, t: np.ndarray, tolerance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a trace and the nearest in time of each track with a larger number, at most ``tolerance`` away, as two arrays of places; by pairs of tracks. Rows are in order of obj, t."""
    bounds = np.flatnonzero(np.append(True, obj[1:] != obj[:-1])).tolist() + [len(obj)]
    tracks = list(zip(bounds[:-1], bounds[1:], strict=True))
    for k, (c, d) in enumerate(tracks):
        last = c + np.flatnonzero(np.append(t[c + 1 : d] != t[c : d - 1], True))  # of a track's rows with one time the last answers
        at = t[last]
        for a, b in tracks[:k]:
            if t[a] - tolerance > at[-1] or t[b - 1] + tolerance < at[0]:
                continue
            ask = t[a:b]
            after = np.searchsorted(at, ask, side="right")
            before, after = np.maximum(after - 1, 0), np.minimum(after, len(at) - 1)
            near = np.where(np.abs(ask - at[before]) <= np.abs(at[after] - ask), before, after)
            ok = np.flatnonzero(np.abs(at[near] - ask) <= tolerance)
            if len(ok):
                yield a + ok, last[near[ok]]


def nearest_of_tracks(rows: DataFrame, tolerance_us: int = 300_000, within: tuple[str, str, str] | None = None) -> DataFrame:
    """``rows`` (trace_id, obj_id, obs_ord, t_us, ...) with each ``other`` track of their trace that has a larger number, and ``near``, its row that is nearest in time.

    Choice and ties are those of ``nearest_within``. Rows move and are sorted
    once; a task streams through its traces in Arrow batches, and pairs, of
    which there are several times as many as rows, are neither sorted nor
    shuffled. Held at a time are some batches of whole traces.
    ``within``: columns x, y and reach; pairs further apart than the mean of
    their reaches, and a hair more, are left out.
    """
    known = rows.where("trace_id is not null and obj_id is not null and t_us is not null").repartition("trace_id").sortWithinPartitions("trace_id", "obj_id", "t_us", "obs_ord")
    schema = T.StructType([*rows.schema, T.StructField("other", rows.schema["obj_id"].dataType), T.StructField("near", rows.schema)])

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
        """Rows of whole traces, at least BATCH of them, and the bounds of each."""
        held, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, n = [*(held or []), batch], n + batch.num_rows
            if n < BATCH:
                continue
            one = pa.concat_batches(held)
            bounds = _starts(one.column("trace_id"))
            if len(bounds) > 1:
                yield one.slice(0, bounds[-1]), bounds
                one = one.slice(bounds[-1])
            held, n = [one], one.num_rows if len(bounds) > 1 else 0  # a long trace is looked at again after as many rows
        if held:
            one = pa.concat_batches(held)
            yield one, [*_starts(one.column("trace_id")), one.num_rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in traces(batches):
            obj, t = batch.column("obj_id").to_numpy(), batch.column("t_us").cast(pa.int64()).to_numpy()
            x, y, reach = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in within) if within else (None, None, None)
            left, right, n = [], [], 0
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for i, j in _pairs_in_time(obj[a:b], t[a:b], tolerance_us):
                    i, j = a + i, a + j  # noqa: PLW2901
                    if within:
                        close = ~(np.hypot(x[i] - x[j], y[i] - y[j]) > (reach[i] + reach[j]) / 2 + 1e-5)
                        i, j = i[close], j[close]  # noqa: PLW2901
                    left.append(i)
                    right.append(j)
                    n += len(i)
                    if n >= OUT:
                        yield _paired(batch, np.concatenate(left), np.concatenate(right))
                        left, right, n = [], [], 0
            if n:
                yield _paired(batch, np.concatenate(left), np.concatenate(right))

    return known.mapInArrow(run, schema)


def _starts(keys: pa.Array) -> list[int]:
    """Where in a sorted column a value begins."""
    return [0, *(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()]


def _paired(batch: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows i of the batch with those at j as ``other`` and ``near``."""
    out, near = batch.take(pa.array(i)), batch.take(pa.array(j))
    return out.append_column("other", near.column("obj_id")).append_column("near", near.to_struct_array())
