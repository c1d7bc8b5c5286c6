"""Behaviour episodes of ego and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from roadspan.functions.exprs import wrap_degrees
from roadspan.operators.frames import sampled
from roadspan.operators.islands import merge_episodes
from roadspan.operators.joins import interp_asof


def by_trace() -> WindowSpec:
    """A trace's poses in order."""
    return Window.partitionBy("trace_id").orderBy("t_us", "seq")


def by_track() -> WindowSpec:
    """A track's observations in order."""
    return Window.partitionBy("trace_id", "obj_id").orderBy("t_us", "obs_ord")


def braking(ego: DataFrame) -> DataFrame:
    """Deceleration beyond 3 m/s2 for 0.3 s or more; hard from 6 m/s2."""
    dt = (F.lead("t_us").over(by_trace()) - F.col("t_us")) / 1e6
    pairs = sampled(ego).select("trace_id", F.col("t_us").alias("t_start"), F.lead("t_us").over(by_trace()).alias("t_end"), ((F.lead("speed").over(by_trace()) - F.col("speed")) / dt).alias("accel"))
    found = merge_episodes(pairs.where("t_end > t_start and accel < -3"), ["trace_id"], "t_start", "t_end", 0, [F.min("accel").alias("peak")])
    return found.where("t_end - t_start >= 300000").withColumn("severity", F.when(F.col("peak") <= -6, "hard").otherwise("moderate"))


def overtakes(obs: DataFrame) -> DataFrame:
    """Changes of side along x, between observations at least 2 m away and at most 8 m aside on average."""
    x1, y1, t1 = (F.lead(c).over(by_track()).alias(c + "1") for c in ("x_rel", "y_rel", "t_us"))
    pairs = obs.where(F.abs("x_rel") >= 2).select("trace_id", "obj_id", "t_us", "x_rel", "y_rel", x1, y1, t1)
    found = pairs.where((F.col("x_rel") > 0) != (F.col("x_rel1") > 0)).where(F.abs((F.col("y_rel") + F.col("y_rel1")) / 2) <= 8)
    t = F.col("t_us") + F.floor((F.col("t_us1") - F.col("t_us")) / 2)
    return found.select("trace_id", "obj_id", t.alias("t_us"), F.when(F.col("x_rel") < 0, "vehicle_overtakes_ego").otherwise("ego_overtakes_vehicle").alias("direction"), ((F.col("y_rel") + F.col("y_rel1")) / 2).alias("lateral_m"))


def short_headways(obs: DataFrame, ego: DataFrame, offset_us: int = 0) -> DataFrame:
    """Under a second behind a vehicle in the own lane, for 0.3 s or more; near misses are under half a second."""
    at = interp_asof(obs, ego, offset_us).where("x_rel > 0 and abs(y_rel) <= 1.9 and es >= 1 and x_rel / es < 1")
    rows = at.select("trace_id", "obj_id", F.col("t_us").alias("t_start"), F.col("t_us").alias("t_end"), (F.col("x_rel") / F.col("es")).alias("h"), "x_rel")
    found = merge_episodes(rows, ["trace_id", "obj_id"], "t_start", "t_end", 2_000_000, [F.min("h").alias("min_headway_s"), F.min("x_rel").alias("min_gap_m")])
    return found.where("t_end - t_start >= 300000").withColumn("near_miss", F.col("min_headway_s") < 0.5)


def cut_ins(obs: DataFrame) -> DataFrame:
    """From beside into the own lane, up to 25 m ahead."""
    return obs.withColumn("before", F.lag("y_rel").over(by_track())).where("abs(before) > 1.9 and abs(y_rel) <= 1.9 and x_rel > 0 and x_rel <= 25").select("trace_id", "obj_id", "t_us", "x_rel")


def standstills(ego: DataFrame) -> DataFrame:
    """Under 0.5 m/s for 3 s or more; gaps up to a second don't end it."""
    rows = ego.where("speed < 0.5").select("trace_id", F.col("t_us").alias("t_start"), F.col("t_us").alias("t_end"))
    return merge_episodes(rows, ["trace_id"], "t_start", "t_end", 1_000_000, []).where("t_end - t_start >= 3000000")


def sharp_turns(ego: DataFrame) -> DataFrame:
    """Heading changes of 45 degrees or more within 3 s; overlapping ones count once, by the largest."""
    ahead = Window.partitionBy("trace_id").orderBy("t_us").rangeBetween(0, 3_000_000)
    pairs = ego.select("trace_id", F.col("t_us").alias("t_start"), F.last("t_us").over(ahead).alias("t_end"), wrap_degrees(F.last("heading_deg").over(ahead) - F.col("heading_deg")).alias("turn"))
    found = pairs.where(F.abs("turn") >= 45).withColumn("t0", F.col("t_start"))
    return merge_episodes(found, ["trace_id"], "t_start", "t_end", 0, [F.max_by("turn", F.struct(F.abs("turn"), -F.col("t0"))).alias("turn_deg")])


def all_events(obs: DataFrame, ego: DataFrame) -> DataFrame:
    """(trace_id, phenomenon, t_us, obj_id) of every episode; near misses count as short headways too."""
    none = F.lit(None).cast("int").alias("obj_id")
    head = short_headways(obs, ego)
    one = lambda df, name, t, obj: df.select("trace_id", name.alias("phenomenon"), F.col(t).alias("t_us"), obj)
    parts = [
        one(braking(ego), F.concat("severity", F.lit("_braking")), "t_start", none),
        one(overtakes(obs), F.col("direction"), "t_us", F.col("obj_id")),
        one(head, F.lit("short_headway"), "t_start", F.col("obj_id")),
        one(head.where("near_miss"), F.lit("near_miss"), "t_start", F.col("obj_id")),
        one(cut_ins(obs), F.lit("cut_in"), "t_us", F.col("obj_id")),
        one(standstills(ego), F.lit("standstill"), "t_start", none),
        one(sharp_turns(ego), F.lit("sharp_turn"), "t_start", none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
