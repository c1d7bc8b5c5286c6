"""Trace tables made from the driver's tables, in DataFrames and in DuckDB SQL.

A trace is a supplier: its ego drives 400 poses at 10 Hz. A track is a (supplier,
line number): its observations are line items in the order of their dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("seq"), F.col("trace_id")
    poses = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("trace_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))).alias("seq"))
    return poses.select(
        "trace_id",
        "seq",
        (i * 100000).alias("t_us"),
        (F.greatest(F.lit(0.0), F.abs((s * 7 + i) % 200 - 100).cast("double") * 0.4 - 10.0) * (1 + s % 2)).alias("speed"),
        (i * 2).cast("double").alias("x_m"),
        (((s + i) % 9).cast("double") * 0.25).alias("y_m"),
        ((270 + (s * 13 + F.floor(i / 40) * 31) % 90) % 360).cast("double").alias("heading_deg"),
    )


EGO = """ego AS (SELECT s_suppkey AS trace_id, i AS seq, i * 100000 AS t_us, greatest(0::DOUBLE, CAST(abs((s_suppkey * 7 + i) % 200 - 100) AS DOUBLE) * 0.4::DOUBLE - 10::DOUBLE) * (1 + s_suppkey % 2) AS speed,
 CAST(i * 2 AS DOUBLE) AS x_m, CAST((s_suppkey + i) % 9 AS DOUBLE) * 0.25::DOUBLE AS y_m,
 CAST((270 + (s_suppkey * 13 + (i // 40) * 31) % 90) % 360 AS DOUBLE) AS heading_deg FROM supplier CROSS JOIN (SELECT range AS i FROM range(0, 400)) r)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_shipdate", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("n", F.row_number().over(order).cast("long") - 1)
    return rows.select(
        F.col("l_suppkey").alias("trace_id"),
        F.col("l_linenumber").alias("obj_id"),
        F.col("n").alias("obs_ord"),
        (F.col("n") * 400000 + (F.col("l_orderkey") % 5) * 20000).alias("t_us"),
        ((F.col("l_quantity") - 25) * 1.5).alias("x_rel"),
        ((F.col("l_discount") * 100 - 5) * 0.8).alias("y_rel"),
        (4 + F.col("l_tax") * 20).alias("length"),
        (1.7 + F.col("l_tax") * 5).alias("width"),
        ((F.col("l_quantity") % 7 - 3) * 0.1).alias("zrot"),
        F.col("l_returnflag").alias("lane"),
    )


OBS = """obs AS (SELECT l_suppkey AS trace_id, l_linenumber AS obj_id, n AS obs_ord, n * 400000 + (l_orderkey % 5) * 20000 AS t_us,
 (l_quantity - 25) * 1.5::DOUBLE AS x_rel, (l_discount * 100 - 5) * 0.8::DOUBLE AS y_rel, 4 + l_tax * 20 AS length, 1.7::DOUBLE + l_tax * 5 AS width, (l_quantity % 7 - 3) * 0.1::DOUBLE AS zrot, l_returnflag AS lane
 FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS n FROM lineitem) z)"""

#: Ego pose at every observation: clamped outside of the recording, else linear, with the shortest arc of yaw.
AT = """nxt AS (SELECT *, radians((heading_deg + 90) % 360) AS yaw, lead(t_us) OVER w AS t1, lead(x_m) OVER w AS x1, lead(y_m) OVER w AS y1, lead(speed) OVER w AS s1, lead(radians((heading_deg + 90) % 360)) OVER w AS yaw1 FROM ego WINDOW w AS (PARTITION BY trace_id ORDER BY t_us)),
pos AS (SELECT obs.*, e.t_us AS t0, t1, CASE WHEN t1 IS NULL OR obs.t_us <= e.t_us THEN 0 ELSE (obs.t_us - e.t_us) / CAST(t1 - e.t_us AS DOUBLE) END AS f, x_m, y_m, speed, yaw, coalesce(x1, x_m) AS x1, coalesce(y1, y_m) AS y1, coalesce(s1, speed) AS s1, coalesce(yaw1, yaw) AS yaw1 FROM obs ASOF JOIN nxt e ON obs.trace_id = e.trace_id AND obs.t_us >= e.t_us),
ego_at AS (SELECT trace_id, obj_id, obs_ord, t_us, x_rel, y_rel, length, width, zrot, lane, x_m + (x1 - x_m) * f AS ex, y_m + (y1 - y_m) * f AS ey, speed + (s1 - speed) * f AS es, yaw + atan2(sin(yaw1 - yaw), cos(yaw1 - yaw)) * f AS eyaw FROM pos)"""

#: Observations in the global frame.
GLOBAL = """posed AS (SELECT *, ex + x_rel * cos(eyaw) - y_rel * sin(eyaw) AS gx, ey + x_rel * sin(eyaw) + y_rel * cos(eyaw) AS gy, (degrees(eyaw + zrot) % 360 + 360) % 360 AS heading FROM ego_at)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two road edges of each trace along the ego's x axis, with a snapshot every 10 s; the road widens and narrows by trace and time."""
    s, n, k = F.col("trace_id"), F.col("line_id"), F.col("snap")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("trace_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("line_id"))
    rows = rows.withColumn("snap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    y = F.when(n == 0, 1.0).otherwise(-1.0) * (2.0 + ((s + k * 3) % 5).cast("double") * 0.5)
    points = F.transform(F.sequence(F.lit(-3), F.lit(42)), lambda i: F.struct((i * 20).cast("double").alias("x"), y.alias("y")))
    return rows.select("trace_id", "line_id", (k * 10000000).alias("t_us"), points.alias("points"))


EDGES = """edges AS (SELECT s_suppkey AS trace_id, n AS line_id, k * 10000000 AS t_us, CASE WHEN n = 0 THEN 1::DOUBLE ELSE -1::DOUBLE END * (2::DOUBLE + CAST((s_suppkey + k * 3) % 5 AS DOUBLE) * 0.5::DOUBLE) AS y
 FROM supplier CROSS JOIN (SELECT range AS n FROM range(0, 2)) a CROSS JOIN (SELECT range AS k FROM range(0, 5)) b)"""


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global tracks along a straight road that break off and go on under another number: every 25th observation on, five are missing, in each fifth trace ten."""
    order = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_shipdate", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("n", F.row_number().over(order).cast("long") - 1)
    s, o, n = F.col("l_suppkey"), F.col("l_linenumber"), F.col("n")
    rows = rows.where(n % 25 < F.when(s % 5 == 0, 15).otherwise(20))
    t = n * 400000
    x = (o % 4 + 18).cast("double") * t / 1e6 + F.col("l_discount") * 2 + o * 6
    return rows.select(
        s.alias("trace_id"), (o + 10 * F.floor(n / 25)).cast("int").alias("obj_id"), n.alias("obs_ord"), t.alias("t_us"), (n + 1).cast("int").alias("frame"), x.alias("gx"), ((o % 3 - 1) * 3.5 + F.col("l_discount")).alias("gy"), F.lit(0.0).alias("heading"),
        (x - t / 1e6 * 20.0).alias("x_rel"), ((o % 3 - 1) * 3.5 + F.col("l_discount")).alias("y_rel"), (1.7 + F.col("l_tax") * 5).alias("width"), (o % 3).cast("string").alias("lane"),
    )


DRIVES = """drives AS MATERIALIZED (SELECT s AS trace_id, CAST(o + 10 * (n // 25) AS INTEGER) AS obj_id, n AS obs_ord, n * 400000 AS t_us, n + 1 AS frame, CAST(o % 4 + 18 AS DOUBLE) * (n * 400000) / 1e6 + l_discount * 2 + o * 6 AS gx, (o % 3 - 1) * 3.5::DOUBLE + l_discount AS gy, 0::DOUBLE AS heading,
 CAST(o % 4 + 18 AS DOUBLE) * (n * 400000) / 1e6 + l_discount * 2 + o * 6 - (n * 400000) / 1e6 * 20 AS x_rel, (o % 3 - 1) * 3.5::DOUBLE + l_discount AS y_rel, 1.7::DOUBLE + l_tax * 5 AS width, CAST(o % 3 AS VARCHAR) AS lane
 FROM (SELECT *, l_suppkey AS s, l_linenumber AS o, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS n FROM lineitem) z WHERE n % 25 < CASE WHEN s % 5 = 0 THEN 15 ELSE 20 END)"""
