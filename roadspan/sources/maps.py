"""Stored maps of the surroundings of traces: one JSON file per box, found by a key of the box; their ways as rows, tags as columns.

Nothing is fetched here. ``missing`` names the boxes that no file is stored
for, so that whoever may use the network can fetch and store them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspan.functions import exprs as X

#: Decimals of a box in its key, length of the key, kilometres in a mile.
DECIMALS, KEY_LENGTH, MILE_KM = 4, 16, 1.60934
BOX = ["min_lat", "min_lon", "max_lat", "max_lon"]
_TAGS, _POINT = "map<string,string>", "struct<lat: double, lon: double>"
_MAP = f"provider string, ways array<struct<id: bigint, points: array<array<double>>, tags: {_TAGS}>>, elements array<struct<type: string, id: bigint, geometry: array<{_POINT}>, tags: {_TAGS}>>, broken string"


def box_key(*box: Column) -> Column:
    """Key of a box (min_lat, min_lon, max_lat, max_lon): hash of its corners as written with four decimals, without zeros at the end. Null if a corner is."""
    plain = [F.regexp_replace(F.format_string(f"%.{DECIMALS}f", F.round(c, DECIMALS)), r"(\.\d+?)0+$", "$1") for c in box]
    known = box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
    return F.when(known, F.substring(F.sha1(F.concat(F.lit("("), F.array_join(F.array(*plain), ", "), F.lit(")"))), 1, KEY_LENGTH))


def map_path(folder: str, provider: str, key: Column) -> Column:
    return F.concat(F.lit(f"{folder.rstrip('/')}/{provider}_"), key, F.lit(".json"))


def read_maps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, way_id, ord, tags, points, broken): the ways of stored maps in the files' order; a file that can't be read is one row with its ``broken`` text.

    A file is one box, so it is bounded by the margin around a trace. Both the
    stored form (``ways``) and the provider's answer (``elements``) are read;
    of the latter what isn't a way, or has no geometry, is left out. A file
    without ways has no rows. ``ord`` is the way's place; ``points`` are
    struct(lat, lon), those with less than two numbers left out.
    """
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"_([^_]*)\.json$", 1).alias("key"), "value")
    rows = files.select("key", "value", F.from_json("value", _MAP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("m"))
    stored = F.transform("m.ways", lambda w: F.struct(w["id"].alias("id"), w["tags"].alias("tags"), F.transform(F.filter(w["points"], lambda p: F.size(p) >= 2), lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon"))).alias("points")))
    answered = F.transform(F.filter("m.elements", lambda e: (e["type"] == "way") & e["geometry"].isNotNull()), lambda e: F.struct(e["id"].alias("id"), e["tags"].alias("tags"), e["geometry"].alias("points")))
    bad = F.when(F.col("m").isNull() | F.col("m.broken").isNotNull() | (F.col("m.ways").isNull() & F.col("m.elements").isNull()), F.col("value"))
    rows = rows.select("key", bad.alias("broken"), F.coalesce(stored, answered).alias("ways"))
    ways = rows.where("broken is null").select("key", F.posexplode("ways").alias("ord", "w")).select("key", F.col("w.id").alias("way_id"), "ord", F.coalesce("w.tags", F.create_map().cast(_TAGS)).alias("tags"), "w.points", F.lit(None).cast("string").alias("broken"))
    return ways.unionByName(rows.where("broken is not null").select("key", "broken"), allowMissingColumns=True)


def missing(extents: DataFrame, maps: DataFrame) -> DataFrame:
    """(key, min_lat, min_lon, max_lat, max_lon): the boxes of ``extents`` without a readable map, each once."""
    boxes = extents.withColumn("key", box_key(*map(F.col, BOX))).where("key is not null").groupBy("key").agg(*(F.min(c).alias(c) for c in BOX))
    return boxes.join(maps.where("broken is null").select("key").distinct(), "key", "left_anti")


def _tag(tags: Column, name: str) -> Column:
    return F.nullif(F.try_element_at(tags, F.lit(name)), F.lit(""))


def way_name(tags: Column) -> Column:
    """The name, else the reference; empty ones count as none."""
    return F.coalesce(_tag(tags, "name"), _tag(tags, "ref"))


def way_lanes(tags: Column) -> Column:
    """The number of lanes, where it is a whole number."""
    raw = _tag(tags, "lanes")
    return F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("int"))


def way_maxspeed_kph(tags: Column) -> Column:
    """The speed limit in km/h from its first word, where that is a number; miles are turned into kilometres."""
    raw = _tag(tags, "maxspeed")
    first = F.regexp_extract(raw, r"^\s*(\S+)", 1)
    number = F.when(first.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), first.try_cast("double"))
    return F.when(F.contains(raw, F.lit("mph")), number * MILE_KM).otherwise(number)


def overlay(extents: DataFrame, maps: DataFrame) -> DataFrame:
    """(trace_id, way_id, ord, name, lanes, maxspeed_kph, k, x, y): points of the ways around each trace, in its frame.

    extents: ``summaries.extents``. ``k`` is the point's place in its way;
    with it as ``ord`` the rows are what ``road.match_way`` takes. Traces
    without a readable map, and ways without points, have no rows.
    """
    traces = extents.select("trace_id", "lat0", "lon0", box_key(*map(F.col, BOX)).alias("key"))
    ways = maps.where("broken is null").select("key", "way_id", "ord", way_name(F.col("tags")).alias("name"), way_lanes(F.col("tags")).alias("lanes"), way_maxspeed_kph(F.col("tags")).alias("maxspeed_kph"), "points")
    at = traces.join(ways, "key").select("trace_id", "lat0", "lon0", "way_id", "ord", "name", "lanes", "maxspeed_kph", F.posexplode("points").alias("k", "p"))
    x, y = X.local_east_north(F.col("p.lat"), F.col("p.lon"), F.col("lat0"), F.col("lon0"))
    return at.select("trace_id", "way_id", "ord", "name", "lanes", "maxspeed_kph", "k", x.alias("x"), y.alias("y"))
