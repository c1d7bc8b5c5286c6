"""Prediction beyond both ends of a track: who is eligible, how far, and which track goes on where another ends.

This is the relational part: constant speed and heading. Both directions come
from one aggregation of the tracks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspan.operators.predict import ALONE_SPEED, EDGE_FRAMES, HORIZON_BEHIND, STEP_S, _speed, continuation_candidates, one_to_one, track_ends
from roadspan.shared import written

STILL_MPS = 0.1  # fixed value: below it the box's own heading counts


def framed_ends(glob: DataFrame) -> DataFrame:
    """``track_ends`` with the frames of a track's first and last observation: first_frame, last_frame."""
    at = F.struct("t_us", "obs_ord", "frame")
    return track_ends(glob, F.min(at)["frame"].alias("first_frame"), F.max(at)["frame"].alias("last_frame"))


def bounded_ends(glob: DataFrame, links: DataFrame, clips: DataFrame, backward: bool = True, forward: bool = True, ends: DataFrame | None = None) -> DataFrame:
    """(trace_id, obj_id, direction, t_us, gx, gy, speed, yaw, reach, bound_us): the ends from which a track is to be predicted.

    glob: observations with frame; links: continuations (a, b); clips: per trace
    t0_us, t1_us and total_frames (may be null). A track that begins in the
    first three frames has nothing before it, one that reaches the last three
    nothing after; one that continues another isn't predicted backward, and
    where a track is continued its prediction ends before the successor's first
    observation. Other bounds are the recording's. ends: ``framed_ends`` of glob, where they are there already.
    """
    ends = (framed_ends(glob) if ends is None else ends).join(clips, "trace_id", "left")
    starts = ends.select("trace_id", F.col("obj_id").alias("b"), F.col("first.t_us").alias("next_us"))
    after = links.join(starts, ["trace_id", "b"]).select("trace_id", F.col("a").alias("obj_id"), "next_us")
    ends = ends.join(after, ["trace_id", "obj_id"], "left").join(links.select("trace_id", F.col("b").alias("obj_id"), F.lit(True).alias("follows")), ["trace_id", "obj_id"], "left")

    def plan(direction: int, a: str, b: str, anchor: str, wanted, bound):
        p, q, at = F.col(a), F.col(b), F.col(anchor)
        speed = F.when(F.col("n") < 2, F.lit(ALONE_SPEED)).otherwise(_speed(p, q))
        yaw = F.when((F.col("n") >= 2) & (speed > STILL_MPS), F.atan2(q["gy"] - p["gy"], q["gx"] - p["gx"])).otherwise(F.radians(at["heading"]))
        return F.struct(F.lit(direction).alias("direction"), at["t_us"].alias("t_us"), at["gx"].alias("gx"), at["gy"].alias("gy"), speed.alias("speed"), yaw.alias("yaw"), F.when(at["x_rel"] < 0, HORIZON_BEHIND).otherwise(1.0).alias("reach"), bound.alias("bound_us"), wanted.alias("wanted"))

    back = plan(-1, "first", "second", "first", F.lit(backward) & (F.col("first_frame") > EDGE_FRAMES) & F.col("follows").isNull(), F.col("t0_us"))
    on = F.col("total_frames").isNull() | (F.col("last_frame") < F.col("total_frames") - EDGE_FRAMES)
    fore = plan(1, "penultimate", "last", "last", F.lit(forward) & on, F.least("t1_us", "next_us"))
    return ends.select("trace_id", "obj_id", F.explode(F.array(back, fore)).alias("e")).where("e.wanted").select("trace_id", "obj_id", "e.*").drop("wanted")


def predict_ends(ends: DataFrame, horizon_s: float = 4.0, horizon_m: float | None = None) -> DataFrame:
    """(trace_id, obj_id, direction, step, t_us, gx, gy) every 0.2 s from each end, within its bound (exclusive), horizon and distance.

    Tracks behind the ego reach three times as far.
    """
    steps = F.round(F.lit(horizon_s) * F.col("reach") / STEP_S)
    if horizon_m is not None:
        far = F.floor(F.lit(horizon_m) * F.col("reach") / (F.col("speed") * STEP_S))
        steps = F.when(F.col("speed") > 1e-6, F.least(steps, far)).otherwise(steps)
    whole = int(STEP_S * 1e6)
    room = F.floor((F.abs(F.col("bound_us") - F.col("t_us")) - 1) / whole)
    right = (F.col("bound_us") - F.col("t_us")) * F.col("direction") > 0
    count = F.when(F.col("bound_us").isNull(), steps).when(right, F.least(steps, room)).otherwise(0).cast("int")
    rows = ends.withColumn("n", count).where("n > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n"))))
    k = F.col("step") * F.col("direction")
    return rows.select("trace_id", "obj_id", "direction", "step", (F.col("t_us") + k * whole).alias("t_us"), (F.col("gx") + F.cos("yaw") * F.col("speed") * STEP_S * k).alias("gx"), (F.col("gy") + F.sin("yaw") * F.col("speed") * STEP_S * k).alias("gy"))


def linked_ends(glob: DataFrame, clips: DataFrame, **choices) -> DataFrame:
    """``bounded_ends`` with the links that the tracks themselves give. Ends, one row a track, are worked out once and written."""
    ends = written(framed_ends(glob), "ends")
    links = one_to_one(continuation_candidates(ends))
    return bounded_ends(glob, links, clips, ends=ends, **choices)
