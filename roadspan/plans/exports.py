"""Registered queries of documents that are written and read back, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadspan.operators import road, summaries
from roadspan.plans import projection as P
from roadspan.plans import queries as Q
from roadspan.plans.queries import query, rounded
from roadspan.shared import shared_dir, written
from roadspan.ship import ship
from roadspan.sources import maps, opendrive
from roadspan.sources.files import write_in_order

LABELS = ["Traffic Sign", "Highly Reflective Marker", "Highway Accessories", 'Tree & "bush" <old>']
_label = f"[{', '.join(repr(x) for x in LABELS)}][CAST(obj_id % 4 AS INTEGER) + 1]"

PLACED = f"""so AS (SELECT *, {_label} AS label, row_number() OVER o - 1 AS mid, count(*) OVER (PARTITION BY trace_id, obj_id) AS cnt FROM posed WINDOW o AS (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord)),
sr AS (SELECT o.trace_id, obj_id, label, gx, gy, length, width, arg_min({{'s': s, 'x': l.x_m, 'y': l.y_m, 'h': radians((heading_deg + 90) % 360)}}, {{'d': (l.x_m - gx) ** 2 + (l.y_m - gy) ** 2, 'q': seq}}) AS r
FROM (SELECT trace_id, obj_id, label, gx, gy, length, width FROM so WHERE mid = cnt // 2) o JOIN line l USING (trace_id) GROUP BY ALL),
placed AS (SELECT trace_id, obj_id, label, CASE WHEN obj_id % 4 < 2 THEN 'pole' ELSE 'none' END AS odr_type, length, width, CAST(1.5 AS DOUBLE) AS height,
r.s + cos(r.h) * (gx - r.x) + sin(r.h) * (gy - r.y) AS s, cos(r.h) * (gy - r.y) - sin(r.h) * (gx - r.x) AS t FROM sr)"""
WITH_LINE = f"{Q.BASE}, {Q.LINE.removeprefix(f'WITH RECURSIVE {P.EGO}, ')}".replace("WITH ego", "WITH RECURSIVE ego", 1)


def _statics(spark, sf_dir):
    """The tracks as static objects, with labels by their number."""
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("obj_id") % 4).cast("int"))
    return Q._glob(spark, sf_dir).select("trace_id", "obj_id", "obs_ord", "t_us", label.alias("obj_type"), F.col("gx").alias("x"), F.col("gy").alias("y"), "length", "width", F.lit(1.5).alias("height"))


@query(f"{WITH_LINE}, {PLACED} SELECT trace_id, obj_id, label, odr_type, round(s, 5) + 0 AS s, round(t, 5) + 0 AS t, length, width, height FROM placed")
def static_placements(spark, sf_dir):
    """Static objects by their middle observation, projected to the road."""
    out = road.static_placements(_statics(ship(spark), sf_dir), road.reference_line(P.ego(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 5) + 0.0 for c in ("s", "t")})


@query(f"""{WITH_LINE}, {PLACED}, pv AS (SELECT *, radians((heading_deg + 90) % 360) AS hdg, lead(s) OVER w - s AS length, radians({Q.WRAP.format('(lead(heading_deg) OVER w - heading_deg)')}) AS turn FROM line WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
pg AS (SELECT *, turn / length AS cv, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS ord FROM pv WHERE length > 0.000001),
sec AS (SELECT trace_id, k AS ord, k * 30.0 AS s, (trace_id + k) % 3 + 1 AS n_right, (trace_id * k) % 3 AS n_left FROM (SELECT DISTINCT trace_id, unnest(range(0, greatest(1, CAST(ceil(length / 30) AS BIGINT)))) AS k FROM (SELECT trace_id, max(s) AS length FROM line GROUP BY 1) z) y),
side AS (SELECT trace_id, ord, s, n_left, n_right, unnest(range(0, n_left + n_right)) AS k FROM sec),
ob AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY obj_id) - 1 AS ord FROM placed)
SELECT trace_id, part, ord, s, coalesce(number, 0) AS number, coalesce(kind, '') AS kind, coalesce(name, '') AS name, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(e, 0) AS e FROM (
SELECT trace_id, 'stretch' AS part, CAST(ord AS BIGINT) AS ord, round(s, 3) + 0 AS s, CAST(NULL AS BIGINT) AS number, CASE WHEN abs(cv) < 0.0001 THEN 'line' ELSE 'arc' END AS kind, CAST(NULL AS VARCHAR) AS name, round(x_m, 3) + 0 AS a, round(y_m, 3) + 0 AS b, round(hdg, 6) + 0 AS c, round(length, 3) + 0 AS d, CASE WHEN abs(cv) < 0.0001 THEN 0 ELSE round(cv, 6) END + 0 AS e FROM pg
UNION ALL SELECT trace_id, 'offset', ord, CAST(s AS DOUBLE), NULL, NULL, NULL, CAST(1.75 + ord % 2 AS DOUBLE), NULL, NULL, NULL, NULL FROM sec
UNION ALL SELECT trace_id, 'lane', ord * 100 + k, s, CASE WHEN k < n_left THEN n_left - k ELSE n_left - k - 1 END, CASE WHEN (k = 0 AND n_left > 0) OR k = n_left + n_right - 1 THEN 'solid' ELSE 'broken' END, NULL, CASE WHEN k < n_left THEN 3.25 + (n_left - k) * 0.25 ELSE 3.5 END::DOUBLE, NULL, NULL, NULL, NULL FROM side
UNION ALL SELECT trace_id, 'object', ord, round(s, 3) + 0, obj_id, odr_type, label, round(t, 3) + 0, round(length, 2) + 0, round(width, 2) + 0, height, NULL FROM ob) z""")
def opendrive_elements(spark, sf_dir):
    """Roads of all traces written as OpenDRIVE, a file each, and read back: every stretch, offset, lane and object in the file's order."""
    path = f"{shared_dir(spark)}/opendrive-{uuid.uuid4().hex}"
    line = written(road.reference_line(P.ego(ship(spark), sf_dir)), "line")
    s, k = F.col("trace_id"), F.col("window")
    sections = line.groupBy("trace_id").agg(F.max("s").alias("length")).select("trace_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("length") / road.WINDOW_M)) - 1)).alias("window"))
    left = F.transform(F.sequence(F.lit(0), ((s * k) % 3).cast("int")), lambda i: 3.25 + i * 0.25)  # one too many, for there may be none
    sections = sections.select(
        "trace_id", (k * road.WINDOW_M).alias("s_start"), F.array_repeat(F.lit(3.5), ((s + k) % 3 + 1).cast("int")).alias("lane_widths"), (1.75 + k % 2).alias("center_offset"),
        F.slice(left, 2, F.size(left) - 1).alias("left_widths"),
    )
    roads = line.select("trace_id").distinct().select("trace_id", F.concat(F.lit(f"{path}/trace-"), F.col("trace_id").cast("string"), F.lit(".xodr")).alias("path"), F.lit(None).cast("string").alias("name"))
    opendrive.write_opendrive(roads, road.plan_view(line), sections, road.static_placements(_statics(spark, sf_dir), line)).write.format("noop").mode("overwrite").save()
    found = opendrive.read_elements(spark, path)
    found = found.na.fill({"number": 0, "kind": "", "name": "", **dict.fromkeys("abcde", 0.0)})
    return found.withColumn("trace_id", F.regexp_extract("path", r"trace-(\d+)\.xodr$", 1).cast("long")).drop("path").select("trace_id", "part", F.col("ord").cast("long").alias("ord"), *[c for c in found.columns if c not in ("path", "part", "ord")])


# --- maps ---

MAP_TAGS = ['{"name":"Ring","ref":"B 1","lanes":"3","maxspeed":"50"}', '{"ref":"R1","lanes":"2;3","maxspeed":"30 mph"}', "{}", '{"name":"","ref":"","lanes":"","maxspeed":"none"}']


def _boxes(spark, sf_dir):
    """Extents of the traces, which are spread over fifty places."""
    poses = Q._latlon(spark, sf_dir)
    return summaries.extents(poses.withColumn("lat", F.col("lat") + F.col("trace_id") % 50 * 0.002))


@query(f"""{Q.LATLON}, lm AS (SELECT trace_id, seq, lat + trace_id % 50 * 0.002::DOUBLE AS lat, lon FROM ll),
g AS (SELECT trace_id, arg_min(lat, seq) AS lat0, arg_min(lon, seq) AS lon0, round(min(lat) - 100 / 111320.0::DOUBLE, 4) AS a, min(lon) AS b FROM lm GROUP BY 1),
w AS (SELECT trace_id, lat0, lon0, w, k, a + w * 0.0005::DOUBLE AS lat, round(b - 100 / (111320 * greatest(0.1, cos(radians(lat0)))), 4) + k * 0.001::DOUBLE AS lon FROM g CROSS JOIN (SELECT range AS w FROM range(0, 4)) x CROSS JOIN (SELECT range AS k FROM range(0, 5)) y WHERE trace_id % 50 % 5 <> 0)
SELECT trace_id, w + 1 AS way_id, CAST(k AS INTEGER) AS k, coalesce(['Ring', 'R1', NULL, NULL][w + 1], '') AS name, CASE WHEN w = 0 THEN 3 ELSE 0 END AS lanes, round(CASE w WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN 30 * 1.60934::DOUBLE ELSE 0.0::DOUBLE END, 6) AS maxspeed_kph,
round(radians(lon - lon0) * cos(radians(lat0)) * 6378137, 4) + 0 AS x, round(radians(lat - lat0) * 6378137, 4) + 0 AS y FROM w""")
def map_overlay(spark, sf_dir):
    """A map per box, written as files of which each fifth is broken, read again and laid over the traces."""
    folder = f"{shared_dir(spark)}/maps-{uuid.uuid4().hex}"
    boxes = _boxes(ship(spark), sf_dir)
    made = boxes.withColumn("key", maps.box_key(*map(F.col, maps.BOX))).groupBy("key").agg(F.min(F.round("min_lat", 4)).alias("a"), F.min(F.round("min_lon", 4)).alias("b"), F.min(F.col("trace_id") % 50 % 5).alias("m"))
    w, k = F.sequence(F.lit(0), F.lit(3)), F.sequence(F.lit(0), F.lit(4))
    ways = F.transform(w, lambda w: F.struct((w + 1).alias("id"), F.transform(k, lambda k: F.array(F.col("a") + w * 0.0005, F.col("b") + k * 0.001)).alias("points"), F.from_json(F.get(F.array(*map(F.lit, MAP_TAGS)), w), "map<string,string>").alias("tags")))
    text = F.to_json(F.struct(F.lit("osm").alias("provider"), ways.alias("ways")))
    files = made.select(maps.map_path(folder, "osm", F.col("key")).alias("path"), F.lit(0).alias("o"), F.encode(F.when(F.col("m") == 0, F.substring(text, 1, 40)).otherwise(text), "UTF-8").alias("data"))
    write_in_order(files, ["o"]).write.format("noop").mode("overwrite").save()
    out = maps.overlay(boxes, maps.read_maps(spark, folder)).na.fill({"name": "", "lanes": 0, "maxspeed_kph": 0.0})
    return out.select("trace_id", "way_id", "k", "name", "lanes", F.round("maxspeed_kph", 6).alias("maxspeed_kph"), *((F.round(c, 4) + 0.0).alias(c) for c in ("x", "y")))


# --- road edges ---


@query(f"""WITH {P.EGO}, e AS (SELECT trace_id, l AS line_id, seq AS ord, x_m AS x, y_m + CASE WHEN l = 0 THEN 4.1 ELSE -7.3 END::DOUBLE AS y, CASE WHEN l = 0 THEN 'left' ELSE 'right' END AS side FROM ego CROSS JOIN (SELECT range AS l FROM range(0, 2)) r WHERE seq % 7 = 0),
g AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS seg FROM e WINDOW w AS (PARTITION BY trace_id, line_id ORDER BY ord)),
c AS (SELECT *, sum(seg) OVER (PARTITION BY trace_id, line_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s1 FROM g WHERE seg >= 0.000001),
t AS (SELECT *, unnest(range(CAST(floor(s0 / 4) AS BIGINT) + 1, CAST(ceil(s1 / 4) AS BIGINT))) AS k FROM (SELECT *, coalesce(lag(s1) OVER (PARTITION BY trace_id, line_id ORDER BY ord), 0) AS s0 FROM c) z),
p AS (SELECT trace_id, line_id, k, x + dx * (k * 4 - s0) / seg AS px, y + dy * (k * 4 - s0) / seg AS py, CASE WHEN side = 'left' THEN 1.1 ELSE -1.1 END::DOUBLE / seg AS f, dx, dy FROM t)
SELECT trace_id, line_id, k, round(px, 5) + 0 AS x, round(py, 5) + 0 AS y, round(px - dy * f, 5) + 0 AS x_end, round(py + dx * f, 5) + 0 AS y_end FROM p""")
def edge_ticks(spark, sf_dir):
    """Ticks along a left and a right edge beside each seventh pose."""
    line = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    left = F.col("line_id") == 0
    edges = P.ego(spark, sf_dir).where("seq % 7 = 0").select("trace_id", line.alias("line_id"), F.col("seq").alias("ord"), F.col("x_m").alias("x"), "y_m")
    edges = edges.withColumns({"y": F.col("y_m") + F.when(left, 4.1).otherwise(-7.3), "side": F.when(left, "left").otherwise("right")})
    return road.edge_ticks(edges).withColumns({c: F.round(c, 5) + 0.0 for c in ("x", "y", "x_end", "y_end")})
