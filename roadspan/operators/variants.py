"""What-if variants of a track, and repairs that are plain expressions or folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from roadspan.operators.events import by_track


def whole_track() -> WindowSpec:
    return Window.partitionBy("trace_id", "obj_id")


def scale_gap(obs: DataFrame, factor: float) -> DataFrame:
    """Gaps ahead scaled, to 1 m at least."""
    return obs.withColumn("x_rel", F.when(F.col("x_rel") > 0, F.greatest(F.lit(1.0), F.col("x_rel") * factor)).otherwise(F.col("x_rel")))


def scale_lateral(obs: DataFrame, factor: float) -> DataFrame:
    return obs.withColumn("y_rel", F.col("y_rel") * factor)


def windowed_gap(obs: DataFrame, factor: float, start: float, end: float) -> DataFrame:
    """Gaps ahead fall to ``factor`` between two fractions of the track's time, and stay there."""
    t0, t1 = F.min("t_us").over(whole_track()), F.max("t_us").over(whole_track())
    frac = F.when(t1 > t0, (F.col("t_us") - t0) / (t1 - t0)).otherwise(0.0)
    ramp = F.when(frac <= start, 1.0).when(frac >= end, factor).otherwise(1.0 + (factor - 1.0) * (frac - start) / (end - start))
    return obs.withColumn("x_rel", F.when(F.col("x_rel") > 0, F.greatest(F.lit(1.0), F.col("x_rel") * ramp)).otherwise(F.col("x_rel")))


def time_warp_lateral(obs: DataFrame, compress: float, tighten: float) -> DataFrame:
    """Lateral motion played faster by ``1 / compress`` and scaled: y at the time to which the warp sends each observation.

    The warped times and the track's own meet in one sorted window, as in an as-of join.
    """
    t0, t1 = F.min("t_us").over(whole_track()), F.max("t_us").over(whole_track())
    own = obs.withColumns({"__t0": t0, "__span": t1 - t0})
    frac = F.when(F.col("__span") > 0, (F.col("t_us") - F.col("__t0")) / F.col("__span")).otherwise(0.0)
    asked = own.withColumn("__at", F.col("__t0") + F.least(F.lit(1.0), frac / compress) * F.col("__span"))
    point = F.struct(F.col("t_us").cast("double").alias("t"), F.col("y_rel").alias("y"))
    known = obs.select("trace_id", "obj_id", F.col("t_us").cast("double").alias("__at"), F.lit(0).alias("__k"), "obs_ord", F.struct(point.alias("a"), F.lead(point).over(by_track()).alias("b")).alias("__p"))
    rows = asked.select("trace_id", "obj_id", "__at", F.lit(1).alias("__k"), F.struct(*obs.columns).alias("__o"), "obs_ord")
    w = Window.partitionBy("trace_id", "obj_id").orderBy("__at", "__k", "obs_ord").rowsBetween(Window.unboundedPreceding, 0)
    met = known.unionByName(rows, allowMissingColumns=True).withColumn("__l", F.last("__p", ignorenulls=True).over(w)).where("__k = 1")
    a, b = F.col("__l.a"), F.col("__l.b")
    f = F.when(b["t"] > a["t"], (F.col("__at") - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    y = (a["y"] + (F.coalesce(b["y"], a["y"]) - a["y"]) * f) * tighten
    return met.select(*(y.alias(c) if c == "y_rel" else F.col(f"__o.{c}") for c in obs.columns))


def trim_trailing(rows: DataFrame, hit: Column) -> DataFrame:
    """Drop observations at a track's end for which ``hit`` holds; the first observation always stays."""
    back = Window.partitionBy("trace_id", "obj_id").orderBy(F.desc("t_us"), F.desc("obs_ord")).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(by_track()) == 1
    return rows.withColumns({"__all": F.min(hit.cast("int")).over(back), "__first": first}).where("__all = 0 or __first").drop("__all", "__first")


def blend_weight(t_us: Column, start: Column, end: Column, taper_us: int = 500_000) -> Column:
    """1 inside of a window, a cosine taper over half a second outside, 0 beyond."""
    gap = F.greatest(start - t_us, t_us - end, F.lit(0))
    return F.when(gap <= 0, 1.0).when(gap >= taper_us, 0.0).otherwise(0.5 * (1 + F.cos(gap * 3.141592653589793 / taper_us)))


def rate_limited(corrections: DataFrame, keys: list[str], time: str, value: str, order: list[str] | None = None, per_second: float = 0.5) -> DataFrame:
    """``corrections`` with ``value`` changing by at most ``per_second``, forward and then backward; signs stay.

    A size is the least, over all rows before (then after) it, of that row's
    size and what may be gained since: a running minimum each way.
    """
    w = Window.partitionBy(*keys).orderBy(time, *(order or []))
    gain = F.col(time) / 1e6 * per_second
    forward = F.min(F.abs(F.col(value)) - gain).over(w.rowsBetween(Window.unboundedPreceding, 0)) + gain
    # from the end on: a frame that ends at the last row would be worked out anew for every row
    back = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in (time, *(order or []))))
    backward = F.min(F.col("__size") + gain).over(back.rowsBetween(Window.unboundedPreceding, 0)) - gain
    return corrections.withColumn("__size", forward).withColumn(value, F.signum(value) * backward).drop("__size")
