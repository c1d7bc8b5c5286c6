"""Fixes of a trace: smoothing, the corridor clamp, trimming, and what they did to each vehicle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspan.functions import exprs as X
from roadspan.operators import corridor, frames, repair, validate, variants

#: Fixed value: largest clamp (m).
CLAMP_M = 1.5


def clamp_offroad(bounded: DataFrame) -> DataFrame:
    """Boxes slightly outside of the corridor moved back to its edge, along the ego's y axis and at a limited rate.

    bounded: posed observations with left_m, right_m (``corridor.bounds``).
    Adds excursion, side, label, departed, too_large and clamped. Departures
    and lane-labelled boxes stay, and so do those that would move by over
    1.5 m; shifts below 5 cm are left out.
    """
    rows = validate.run_labels(corridor.excursion(bounded))
    signed = F.when(F.col("side") == "left", -F.col("excursion")).when(F.col("side") == "right", F.col("excursion")).otherwise(0.0)
    departed = F.coalesce(F.col("label") == "departure", F.lit(False))
    rows = rows.withColumns({"departed": departed, "too_large": ~departed & (F.abs(signed) > CLAMP_M)})
    rows = rows.withColumn("__delta", F.when(F.col("departed") | F.col("too_large"), 0.0).otherwise(signed))
    rows = variants.rate_limited(rows, ["trace_id", "obj_id"], "t_us", "__delta", ["obs_ord"])
    rows = rows.withColumn("clamped", F.abs("__delta") >= corridor.FLOOR_M).withColumn("y_rel", F.col("y_rel") + F.when(F.col("clamped"), F.col("__delta")).otherwise(0.0))
    x, y = X.body_to_global(F.col("x_rel"), F.col("y_rel"), F.col("ex"), F.col("ey"), F.col("eyaw"))
    return rows.withColumns({"gx": F.when(F.col("clamped"), x).otherwise(F.col("gx")), "gy": F.when(F.col("clamped"), y).otherwise(F.col("gy"))}).drop("__delta")


def apply_fixes(posed: DataFrame, issues: DataFrame, lines: DataFrame, strength: str = "standard") -> DataFrame:
    """Smoothing of kinematic issues, clamp, and trimming of trailing overlaps with the ego; relative fields follow.

    Returns the observations that stay, with orig_x_m, orig_y_m, fixed,
    departed and too_large. Unknown strengths raise.
    """
    pad = 500_000
    windows = issues.where("category = 'kinematic' and obj_id is not null").select("trace_id", "obj_id", (F.col("t_start") - pad).alias("t_start"), (F.col("t_end") + pad).alias("t_end"))
    smooth = frames.reproject_relative(repair.smooth_tracks(posed, windows, strength))
    clamped = clamp_offroad(corridor.bounds(smooth, lines))
    clamped = clamped.withColumn("fixed", F.col("fixed") | F.col("clamped"))
    z = F.lit(0.0)
    hit = X.boxes_overlap(z, z, z, F.lit(X.EGO_LENGTH), F.lit(X.EGO_WIDTH), F.col("x_rel"), F.col("y_rel"), F.col("zrot"), F.col("length"), F.col("width"))
    return variants.trim_trailing(clamped, hit)


def fix_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(trace_id, obj_id, n_fixed, dropped, departures, too_large) per vehicle that anything was done to or declined for.

    before: all observations; only their trace_id and obj_id are read.
    """
    had = before.groupBy("trace_id", "obj_id").agg(F.count("*").alias("had"))
    did = after.groupBy("trace_id", "obj_id").agg(F.count("*").alias("have"), F.count_if("fixed").alias("n_fixed"), F.count_if("departed").alias("departures"), F.count_if("too_large").alias("too_large"))
    rows = had.join(did, ["trace_id", "obj_id"]).withColumn("dropped", F.col("had") - F.col("have"))
    return rows.where("n_fixed + dropped + departures + too_large > 0").select("trace_id", "obj_id", "n_fixed", "dropped", "departures", "too_large")
