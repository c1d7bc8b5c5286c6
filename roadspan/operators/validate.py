"""Validation rules: kinematic limits, overlaps, off-road runs, and the issue list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspan.functions import exprs as X
from roadspan.operators.events import by_trace, by_track
from roadspan.operators.frames import sampled
from roadspan.operators.joins import nearest_of_tracks

#: Least time and length (m) of a course.
COURSE_US, COURSE_M = 1_000_000, 1.5
#: What a run's judgement reads of a row.
RUN_COLUMNS = ("trace_id", "obj_id", "obs_ord", "t_us", "excursion", "side", "gx", "gy", "zrot")


def _worst(*levels):
    """high if any is, else medium if any is."""
    either = lambda name: F.array_contains(F.array(*(F.coalesce(x, F.lit("")) for x in levels)), name)
    return F.when(either("high"), "high").when(either("medium"), "medium")


def ego_kinematic(ego: DataFrame) -> DataFrame:
    """Sampled pose pairs whose speed or acceleration exceeds the limits."""
    dt = (F.lead("t_us").over(by_trace()) - F.col("t_us")) / 1e6
    speed = F.hypot(F.lead("x_m").over(by_trace()) - F.col("x_m"), F.lead("y_m").over(by_trace()) - F.col("y_m")) / dt
    accel = (F.lead("speed").over(by_trace()) - F.col("speed")) / dt
    rows = sampled(ego).select("trace_id", F.col("t_us").alias("t_start"), F.lead("t_us").over(by_trace()).alias("t_end"), speed.alias("speed"), accel.alias("accel")).where("t_end > t_start")
    return rows.withColumn("severity", _worst(X.severity(F.col("speed"), *X.SPEED_LIMITS), X.severity(F.abs("accel"), *X.ACCEL_LIMITS))).where("severity is not null")


def track_steps(glob: DataFrame) -> DataFrame:
    """Consecutive observations of a track with a positive time step: dt, speed, yaw_rate."""
    dt = (F.lead("t_us").over(by_track()) - F.col("t_us")) / 1e6
    dx, dy = F.lead("gx").over(by_track()) - F.col("gx"), F.lead("gy").over(by_track()) - F.col("gy")
    dist = F.sqrt(dx * dx + dy * dy)  # not hypot, whose last bit differs: limits are compared exactly
    turn = F.abs(X.wrap_degrees(F.lead("heading").over(by_track()) - F.col("heading")))
    rows = glob.select("trace_id", "obj_id", "obs_ord", F.col("t_us").alias("t_start"), F.lead("t_us").over(by_track()).alias("t_end"), dt.alias("dt"), dist.alias("dist"), turn.alias("turn"))
    return rows.where("dt > 0").select("trace_id", "obj_id", "obs_ord", "t_start", "t_end", "dt", (F.col("dist") / F.col("dt")).alias("speed"), (F.col("turn") / F.col("dt")).alias("yaw_rate"))


def speed_flags(steps: DataFrame) -> DataFrame:
    return steps.withColumn("severity", X.severity(F.col("speed"), *X.SPEED_LIMITS)).where("severity is not null").select("trace_id", "obj_id", "t_start", "t_end", "speed", "severity")


def yaw_rate_flags(steps: DataFrame) -> DataFrame:
    return steps.withColumn("severity", X.severity(F.col("yaw_rate"), *X.YAW_RATE_LIMITS)).where("severity is not null").select("trace_id", "obj_id", "t_start", "t_end", "yaw_rate", "severity")


def centred_acceleration(steps: DataFrame) -> DataFrame:
    """Speed change between the two steps around an inner observation, over their mean duration. Both must belong to it."""
    w = Window.partitionBy("trace_id", "obj_id").orderBy("t_start", "obs_ord")
    rows = steps.withColumns({"s1": F.lead("speed").over(w), "dt1": F.lead("dt").over(w), "t1": F.lead("t_start").over(w), "t_next": F.lead("t_end").over(w)}).where("t1 = t_end")
    rows = rows.select("trace_id", "obj_id", F.col("t_end").alias("t_us"), "t_next", ((F.col("s1") - F.col("speed")) / ((F.col("dt") + F.col("dt1")) / 2)).alias("accel"))
    return rows.withColumn("severity", X.severity(F.abs("accel"), *X.ACCEL_LIMITS)).where("severity is not null")


def kinematic(steps: DataFrame) -> DataFrame:
    """(trace_id, obj_id, severity, t_start, t_end): ``speed_flags``, ``yaw_rate_flags`` and ``centred_acceleration`` of one pass over ``steps``."""
    w = Window.partitionBy("trace_id", "obj_id").orderBy("t_start", "obs_ord")
    rows = steps.withColumns({"__s1": F.lead("speed").over(w), "__dt1": F.lead("dt").over(w), "__t1": F.lead("t_start").over(w), "__next": F.lead("t_end").over(w)})
    accel = F.when(F.col("__t1") == F.col("t_end"), (F.col("__s1") - F.col("speed")) / ((F.col("dt") + F.col("__dt1")) / 2))
    flag = lambda severity, a, b: F.struct(severity.alias("severity"), F.col(a).alias("t_start"), F.col(b).alias("t_end"))
    flags = F.array(
        flag(X.severity(F.col("speed"), *X.SPEED_LIMITS), "t_start", "t_end"), flag(X.severity(F.col("yaw_rate"), *X.YAW_RATE_LIMITS), "t_start", "t_end"),
        flag(X.severity(F.abs(accel), *X.ACCEL_LIMITS), "t_end", "__next"),
    )
    return rows.select("trace_id", "obj_id", F.inline(F.filter(flags, lambda f: f["severity"].isNotNull())))


def ego_overlaps(at: DataFrame) -> DataFrame:
    """Observations whose box touches the ego's, both in the ego's frame; one row per distinct time of a track."""
    z = F.lit(0.0)
    hit = X.boxes_overlap(z, z, z, F.lit(X.EGO_LENGTH), F.lit(X.EGO_WIDTH), F.col("x_rel"), F.col("y_rel"), F.col("zrot"), F.col("length"), F.col("width"))
    return at.where(hit).select("trace_id", "obj_id", "t_us").distinct()


def pair_overlaps(glob: DataFrame) -> DataFrame:
    """Pairs of tracks whose boxes touch: each observation against the other track's nearest within 300 ms.

    See ``nearest_of_tracks``; boxes further apart than their diagonals aren't
    tested.
    """
    rows = glob.select("trace_id", "obj_id", "obs_ord", "t_us", "gx", "gy", "heading", "length", "width", F.hypot("length", "width").alias("__reach"))
    near = nearest_of_tracks(rows, within=("gx", "gy", "__reach"))
    n = lambda c: F.col(f"near.{c}")
    close = F.hypot(F.col("gx") - n("gx"), F.col("gy") - n("gy")) <= (F.hypot("length", "width") + F.hypot(n("length"), n("width"))) / 2 + 1e-6  # corners that touch are left to the test
    hit = X.boxes_overlap(F.col("gx"), F.col("gy"), F.radians("heading"), F.col("length"), F.col("width"), n("gx"), n("gy"), F.radians(n("heading")), n("length"), n("width"))
    return near.where(close & hit).select("trace_id", "obj_id", "other", "t_us").distinct()


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of the run (``__run``) that they are in or behind, and what a run's judgement needs of each."""
    whole = Window.partitionBy("trace_id", "obj_id")
    off = F.col("excursion") > 0
    new = F.when(off & ~F.coalesce(F.lag(off).over(by_track()), F.lit(False)), 1).otherwise(0)
    placed = {"gx", "gy"} <= set(rows.columns)
    at = F.struct("t_us", "obs_ord", *(F.col(c) if placed else F.lit(None).cast("double").alias(c) for c in ("gx", "gy")))
    earlier = Window.partitionBy("trace_id", "obj_id").orderBy("t_us").rangeBetween(Window.unboundedPreceding, -COURSE_US)
    marked = rows.withColumns({"__off": F.coalesce(off, F.lit(False)), "__new": new, "__last": F.max("t_us").over(whole), "__at": at, "__base": F.coalesce(F.max(at).over(earlier), F.min(at).over(whole))})
    return marked.withColumn("__run", F.sum("__new").over(by_track().rowsBetween(Window.unboundedPreceding, 0)))


def _of_run() -> dict[str, Column]:
    """Aggregates over the rows of one run."""
    return {
        "t_start": F.min("t_us"), "t_end": F.max("t_us"), "peak_m": F.max("excursion"), "side": F.max_by("side", F.struct("excursion", -F.col("obs_ord"))), "to_end": F.max("t_us") == F.max("__last"),
        "__a": F.min(F.struct("__at", "__base")), "__b": F.max("__at"), "__axis": F.max(X.axis_angle(F.col("zrot"))),
    }


def _judged(runs: DataFrame) -> DataFrame:
    def course(a, b):
        dx, dy = F.col(f"{b}.gx") - F.col(f"{a}.gx"), F.col(f"{b}.gy") - F.col(f"{a}.gy")
        return F.when(F.sqrt(dx * dx + dy * dy) >= COURSE_M, F.degrees(F.atan2(dy, dx)))

    turn = F.coalesce(F.abs(X.wrap_degrees(course("__a.__at", "__b") - course("__a.__base", "__a.__at"))), F.col("__axis"))
    runs = runs.withColumn("turn_deg", turn).drop("__run", "__a", "__b", "__axis")
    return runs.withColumn("label", F.when((F.col("peak_m") >= 4) | (F.col("peak_m") >= 2) & (F.col("to_end") | (F.col("turn_deg") >= 10)), "departure").otherwise("noise"))


def offroad_runs(rows: DataFrame) -> DataFrame:
    """Runs of consecutive observations with ``excursion`` > 0: bounds, peak, its side, the turn, and whether the track ends in it.

    A departure peaks at 4 m or more, or at 2 m and lasts to the track's end or
    turns by 10 degrees. The turn is between the course of at least 1 s before
    the run and the run's own; where either has under 1.5 m (or ``rows`` has no
    gx, gy) it is the largest angle to the ego's axis.
    """
    return _judged(_marked(rows).where("__off").groupBy("trace_id", "obj_id", "__run").agg(*(v.alias(k) for k, v in _of_run().items())))


def run_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with the label of the off-road run (``offroad_runs``) that they are part of, else null. Windows only: no join, no exchange of its own."""
    one = Window.partitionBy("trace_id", "obj_id", "__run", "__off")
    known = {"peak_m", "to_end", "__a", "__b", "__axis"}
    marked = _marked(rows.select(F.struct(*rows.columns).alias("__row"), *(c for c in rows.columns if c in RUN_COLUMNS)))
    parts = {k: v for k, v in _of_run().items() if k in known and k != "to_end"} | {"__end": F.max("t_us"), "__till": F.max("__last")}
    runs = marked.withColumns({k: v.over(one) for k, v in parts.items()}).withColumn("to_end", F.col("__end") == F.col("__till"))
    return _judged(runs).select("__row.*", F.when(F.col("__off"), F.col("label")).alias("label"))


def issues(obs_global: DataFrame, ego: DataFrame, excursions: DataFrame) -> DataFrame:
    """(trace_id, category, severity, obj_id, t_start, t_end) of all rules; excursions: see ``offroad_runs``.

    A collision of two vehicles is the issue of the one with the smaller number.
    Four passes read the observations: steps, both kinds of overlaps, and runs.
    Whoever has them from a longer plan should write them before.
    """
    runs = offroad_runs(excursions).withColumns({"severity": F.when(F.col("label") == "departure", "low").otherwise("medium"), "category": F.when(F.col("label") == "departure", "road_departure").otherwise("off_road")})
    none = F.lit(None).cast("int")
    one = lambda df, cat, sev, obj, a, b: df.select("trace_id", cat.alias("category"), sev.alias("severity"), obj.alias("obj_id"), F.col(a).alias("t_start"), F.col(b).alias("t_end"))
    s, o = F.col("severity"), F.col("obj_id")
    return (
        one(ego_kinematic(ego), F.lit("kinematic"), s, none, "t_start", "t_end")
        .unionByName(one(kinematic(track_steps(obs_global)), F.lit("kinematic"), s, o, "t_start", "t_end"))
        .unionByName(one(ego_overlaps(obs_global), F.lit("collision"), F.lit("high"), o, "t_us", "t_us"))
        .unionByName(one(pair_overlaps(obs_global), F.lit("collision"), F.lit("high"), o, "t_us", "t_us"))
        .unionByName(one(runs, F.col("category"), s, o, "t_start", "t_end"))
    )


def numbered(found: DataFrame) -> DataFrame:
    """Issues with their ordinal in a trace, by (t_start, vehicle or 0, category, severity, t_end)."""
    w = Window.partitionBy("trace_id").orderBy("t_start", F.coalesce("obj_id", F.lit(0)), "category", "severity", "t_end")
    return found.withColumn("issue_ord", F.row_number().over(w).cast("long") - 1)
