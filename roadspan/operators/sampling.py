"""Scenes on a time grid: every track of a trace at the same instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspan.functions import exprs as X

EXPIRY_US = 500_000  # fixed value: a track is shown so long before its first and after its last observation


def at_grid(rows: DataFrame, keys: list[str], order: list[str], step_us: int, linear: list[str], angles: list[str] = [], held: list[str] = [], expiry_us: int = 0) -> DataFrame:  # noqa: B006
    """(keys, t_us and the columns named): ``rows`` of each key at all multiples of ``step_us``.

    Between two rows ``linear`` columns are interpolated, ``angles`` (degrees)
    over the shorter arc, and ``held`` ones are those of the earlier row. Up to
    ``expiry_us`` before the first row and after the last those rows hold; beyond
    there is nothing. Of rows with one time the last counts, but the first at
    the first time of all. Each row makes the instants up to its successor, so
    the grid takes one sort by key and no join, and a row makes only instants
    within its own gap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    cols = [*linear, *angles, *held]
    own = rows.select(*keys, *order, *(c for c in cols if c not in order), F.lead(F.struct("t_us", *linear, *angles)).over(w).alias("__b"), F.lag("t_us").over(w).isNull().alias("__first"), F.min("t_us").over(whole).alias("__t0"))
    t, step = F.col("t_us"), F.lit(step_us)
    end = F.coalesce("__b.t_us", t + expiry_us + 1)  # exclusive
    end = F.when(F.col("__first"), F.greatest(end, t + 1)).otherwise(end)
    begin = F.when(F.col("__first"), t - expiry_us).when(t == F.col("__t0"), t + 1).otherwise(t)
    lowest, highest = F.ceil(begin / step), F.ceil(end / step) - 1
    ticks = F.when(highest >= lowest, F.sequence(lowest, highest)).otherwise(F.array().cast("array<bigint>"))
    grid = own.withColumn("__n", F.explode(ticks)).withColumn("__at", F.col("__n") * step)
    span = F.col("__b.t_us") - t
    f = F.when((F.col("__at") > t) & (span > 0), (F.col("__at") - t) / span).otherwise(0.0)
    mid: list[Column] = [(F.col(c) + F.coalesce((F.col(f"__b.{c}") - F.col(c)) * f, F.lit(0.0))).alias(c) for c in linear]
    mid += [(F.col(c) + F.coalesce(X.wrap_degrees(F.col(f"__b.{c}") - F.col(c)) * f, F.lit(0.0))).alias(c) for c in angles]
    return grid.select(*keys, F.col("__at").alias("t_us"), *mid, *held)


def scenes(glob: DataFrame, step_us: int = 100_000) -> DataFrame:
    """Vehicles of every trace at each instant: place, heading, size, lane; ``glob`` has gx, gy, heading."""
    return at_grid(glob, ["trace_id", "obj_id"], ["t_us", "obs_ord"], step_us, ["gx", "gy", "length", "width"], ["heading"], ["lane"], EXPIRY_US)


def ego_scenes(ego: DataFrame, step_us: int = 100_000) -> DataFrame:
    """The ego's pose at each instant of its recording."""
    return at_grid(ego, ["trace_id"], ["t_us", "seq"], step_us, ["x_m", "y_m", "speed"], ["heading_deg"])
