"""Readers of recordings: ego CSV, annotation XML, and the pairing of both over a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of an ego file, and what one unit of them is worth.
CSV_COLUMNS = ["ADTF_CHUNK_TIME", "INS_ANGLE_TRUE_HEADING", "INS_Pos_Abs_Latitude", "INS_Pos_Abs_Longitude", "INS_Vel_Frame_X", "INS_Vel_Frame_Y", "INS_Vel_Frame_Z"]
DEGREES, HEADING, VELOCITY = 1e-7, 0.01, 0.005
#: Folder names that tell a kind of file, not a recording.
GENERIC = ["adma", "data", "raw", "input", "inputs", "logs", "log", "csv", "gps", "ins", "export", "exports", "output", "outputs", "recording", "recordings", "measurement"]
SUFFIX = r"(?i)__ref-?qc_ind$"  # fixed value: ending of an annotation's name
BEFORE = 4  # fixed value: most trace names between an annotation's name and the one it begins with
EXAMPLES = 10


def folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def trace_name(path: Column, root: str = "") -> Column:
    """Nearest folder above the file and below ``root`` with a name of its own, else the folder it is in."""
    parts = F.split(F.substring(path, len(root.rstrip("/")) + 1, 1 << 20) if root else path, "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    own = F.filter(above, lambda p: ~F.lower(p).isin(GENERIC) & (p != ""))
    return F.coalesce(F.try_element_at(own, F.lit(-1)), folder(path))


def read_ego(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Poses of ego CSV files: (trace_id, seq, t_us, lat, lon, heading_deg, v_north, v_east, v_vert), in stable time order.

    Columns are found by name in each file's own header, in any order; more are
    left out. A file without one of the seven raises an error that lists what
    is missing. Files with one header are read together, so a corpus takes as
    many reads as it has headers.
    """
    path = F.col("_metadata.file_path")
    lines = spark.read.text(paths).select(path.alias("path"), F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("head"))
    heads = lines.where(F.col("head").contains(CSV_COLUMNS[0])).groupBy("path").agg(F.min("head").alias("head"))
    kinds = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]
    if lines.select("path").distinct().join(heads, "path", "left_anti").head(1) or not kinds:
        raise ValueError(f"missing columns: {', '.join(CSV_COLUMNS)}")
    found = []
    for head in kinds:
        names = [c.strip().strip('"') for c in head.split(",")]
        missing = [c for c in CSV_COLUMNS if c not in names]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        schema = T.StructType([T.StructField(c if names.index(c) == i else f"__{i}", T.StringType()) for i, c in enumerate(names)])
        rows = spark.read.option("header", True).schema(schema).csv(paths).select(path.alias("path"), F.monotonically_increasing_id().alias("__pos"), *CSV_COLUMNS)
        found.append(rows if len(kinds) == 1 else rows.join(heads.where(F.col("head") == head), "path", "left_semi"))
    raw = reduce(DataFrame.union, found)
    n = lambda c: F.trim(c).cast("long")
    rows = raw.select(
        folder(F.col("path")).alias("trace_id"),
        "__pos",
        n("ADTF_CHUNK_TIME").alias("t_us"),
        (n("INS_Pos_Abs_Latitude") * DEGREES).alias("lat"),
        (n("INS_Pos_Abs_Longitude") * DEGREES).alias("lon"),
        (n("INS_ANGLE_TRUE_HEADING") * HEADING).alias("heading_deg"),
        (n("INS_Vel_Frame_X") * VELOCITY).alias("v_north"),
        (n("INS_Vel_Frame_Y") * VELOCITY).alias("v_east"),
        (n("INS_Vel_Frame_Z") * VELOCITY).alias("v_vert"),
    )
    w = Window.partitionBy("trace_id").orderBy("t_us", "__pos")
    return rows.withColumn("seq", F.row_number().over(w).cast("long") - 1).drop("__pos")


def ego_columns(ego: DataFrame) -> DataFrame:
    """The seven integer columns of an ego file, by the inverse scales and banker's rounding."""
    whole = lambda c, unit: F.bround(F.col(c) / unit).cast("long")
    return ego.select(
        "trace_id", "seq", F.col("t_us").alias(CSV_COLUMNS[0]), whole("heading_deg", HEADING).alias(CSV_COLUMNS[1]), whole("lat", DEGREES).alias(CSV_COLUMNS[2]), whole("lon", DEGREES).alias(CSV_COLUMNS[3]),
        whole("v_north", VELOCITY).alias(CSV_COLUMNS[4]), whole("v_east", VELOCITY).alias(CSV_COLUMNS[5]), whole("v_vert", VELOCITY).alias(CSV_COLUMNS[6]),
    )


def write_ego(ego: DataFrame, target: str) -> None:
    """One folder of CSV per trace; each trace's rows are in one file, in order."""
    ego_columns(ego).repartition("trace_id").sortWithinPartitions("trace_id", "seq").drop("seq").write.partitionBy("trace_id").option("header", True).csv(target)


_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xp", "yp", "zp", "xs", "ys", "zs", "zrot")])
_STAMP = "frame int, chunktime long"


def _nested(names: list[str], inner: T.DataType) -> T.DataType:
    for n in reversed(names):
        inner = T.StructType([T.StructField(n, inner)])
    return inner


def _plain(path: Column) -> Column:
    """A local file's path in one spelling; readers differ in the number of slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _xml(spark: SparkSession, paths, tag: str, schema: T.StructType, pairs: DataFrame | None = None) -> DataFrame:
    """Elements of annotation files with their trace: the one that ``pairs`` (name, annotation_path) gives the file.

    Without pairs it is the folder of a file named ``annotation.xml``, else the
    file's own name without its ending.
    """
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(paths).withColumn("__path", _plain(F.col("_metadata.file_path")))
    if pairs is not None:
        return rows.join(pairs.select(F.col("name").alias("trace_id"), _plain(F.col("annotation_path")).alias("__path")), "__path").drop("__path")
    own = stem(F.col("__path"))
    return rows.withColumn("trace_id", F.when(F.lower(own) == "annotation", folder(F.col("__path"))).otherwise(F.regexp_replace(own, SUFFIX, ""))).drop("__path")


def read_static(spark: SparkSession, paths: str | list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Static objects: one row per timestamp with a box; missing texts are empty, missing numbers 0, zrot in radians."""
    stamp = T.StructType([T.StructField("_frame", T.IntegerType()), T.StructField("_chunktime", T.LongType()), T.StructField("bounding_box", _nested(["rect_static_geom", "coordinates"], _BOX))])
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("obj_type", T.StringType()), T.StructField("timestamps", T.StructType([T.StructField("rect_static_timestamp", T.ArrayType(stamp))]))])
    rows = _xml(spark, paths, "rect_static", schema, pairs).select("trace_id", F.coalesce("id", F.lit(0)).alias("obj_id"), F.coalesce("obj_type", F.lit("")).alias("obj_type"), F.posexplode("timestamps.rect_static_timestamp").alias("pos", "s"))
    box = F.col("s.bounding_box.rect_static_geom.coordinates")
    num = lambda n: F.coalesce(box[n], F.lit(0.0))
    out = rows.where(box.isNotNull()).select(
        "trace_id", "obj_id", "obj_type", "pos", F.coalesce("s._chunktime", F.lit(0)).alias("t_us"), F.coalesce("s._frame", F.lit(0)).alias("frame"),
        num("xp").alias("x_rel"), num("yp").alias("y_rel"), num("zp").alias("z_rel"), num("xs").alias("length"), num("ys").alias("width"), num("zs").alias("height"), F.radians(num("zrot")).alias("zrot"),
    )
    w = Window.partitionBy("trace_id", "obj_id").orderBy("t_us", "pos")
    return out.withColumn("obs_ord", F.row_number().over(w).cast("long") - 1).drop("pos")


def read_vehicles(spark: SparkSession, paths: str | list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Vehicle observations: one row per timestamp with a box; missing texts are Unknown or empty, missing numbers 0, zrot in radians."""
    stamp = T.StructType(
        [T.StructField("_frame", T.IntegerType()), T.StructField("_chunktime", T.LongType()), T.StructField("_interpolationState", T.StringType())]
        + [T.StructField(n, T.StringType()) for n in ("obj_movement", "obj_lane", "obj_confidence")]
        + [T.StructField("bounding_box", _nested(["vehicle_bb", "coordinates"], _BOX))]
    )
    schema = T.StructType(
        [T.StructField("id", T.IntegerType()), T.StructField("obj_type", T.StringType()), T.StructField("reflecting_parts", T.StringType()), T.StructField("timestamps", T.StructType([T.StructField("rect_vehicle_timestamp", T.ArrayType(stamp))]))]
    )
    rows = _xml(spark, paths, "rect_vehicle", schema, pairs).select("trace_id", F.col("id").alias("obj_id"), F.coalesce("obj_type", F.lit("Unknown")).alias("obj_type"), F.posexplode("timestamps.rect_vehicle_timestamp").alias("pos", "s"))
    box = F.col("s.bounding_box.vehicle_bb.coordinates")
    rows = rows.where(box.isNotNull())
    num = lambda n: F.coalesce(box[n], F.lit(0.0))
    out = rows.select(
        "trace_id", "obj_id", "obj_type", "pos", F.coalesce("s._chunktime", F.lit(0)).alias("t_us"), F.coalesce("s._frame", F.lit(0)).alias("frame"), F.coalesce("s.obj_movement", F.lit("Unknown")).alias("obj_movement"), F.coalesce("s.obj_lane", F.lit("Unknown")).alias("lane"),
        F.coalesce("s.obj_confidence", F.lit("")).alias("obj_confidence"), num("xp").alias("x_rel"), num("yp").alias("y_rel"), num("zp").alias("z_rel"), num("xs").alias("length"), num("ys").alias("width"), num("zs").alias("height"), F.radians(num("zrot")).alias("zrot"),
    )
    w = Window.partitionBy("trace_id", "obj_id").orderBy("t_us", "pos")
    return out.withColumn("obs_ord", F.row_number().over(w).cast("long") - 1).drop("pos")


def polyline(coordinates: Column) -> Column:
    """Points of a map xp_N, yp_N in the order of N as a number; N without both is left out."""
    ns = F.transform(F.filter(F.map_keys(coordinates), lambda k: k.rlike(r"^xp_\d+$")), lambda k: F.regexp_extract(k, r"(\d+)", 1).cast("int"))
    both = F.filter(F.array_sort(ns), lambda n: F.array_contains(F.map_keys(coordinates), F.concat(F.lit("yp_"), n.cast("string"))))
    at = lambda axis, n: F.element_at(coordinates, F.concat(F.lit(f"{axis}p_"), n.cast("string")))
    return F.transform(both, lambda n: F.struct(at("x", n).alias("x"), at("y", n).alias("y")))


def _lines(spark, paths, tag: str, stamps: str, geometry: list[str], kind: str, texts: list[str], pairs: DataFrame | None) -> DataFrame:
    stamp = T.StructType([T.StructField("_frame", T.IntegerType()), T.StructField("_chunktime", T.LongType()), T.StructField(geometry[0], _nested(geometry[1:] + ["coordinates"], T.MapType(T.StringType(), T.DoubleType())))])
    schema = T.StructType([T.StructField("id", T.IntegerType()), *(T.StructField(t, T.StringType()) for t in texts), T.StructField("line_attributes", T.StructType([T.StructField(stamps, T.ArrayType(stamp))]))])
    rows = _xml(spark, paths, tag, schema, pairs).select("trace_id", F.lit(kind).alias("kind"), F.col("id").alias("obj_id"), *(F.coalesce(t, F.lit("")).alias(t) for t in texts), F.explode(f"line_attributes.{stamps}").alias("s"))
    return rows.select("trace_id", "kind", "obj_id", *texts, F.col("s._chunktime").alias("t_us"), F.col("s._frame").alias("frame"), polyline(F.col(".".join(["s", *geometry, "coordinates"]))).alias("points"))


def read_lane_markings(spark: SparkSession, paths: str | list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Lane markings, one row per snapshot, with their points in the ego's frame."""
    return _lines(spark, paths, "line_static_lm", "line_static_check_II_timestamp", ["line_static", "line_static_check_II_geom"], "lane", ["lane_type", "width", "group"], pairs)


def read_borders(spark: SparkSession, paths: str | list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Border lines, one row per snapshot."""
    return _lines(spark, paths, "line_bp", "line_static_timestamp", ["line_static", "line_static_geom"], "border", ["obj_type"], pairs)


def read_frames(spark: SparkSession, paths: str | list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Per-frame road data; the ego lane counts only if it is all digits, a lane number that is no number raises."""
    names = ["Road_type", "NUM_lanes", "EGO_lane", "Weather_1", "Light_conditions"]
    schema = T.StructType([T.StructField("_frame", T.IntegerType()), T.StructField("_chunktime", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])
    rows = _xml(spark, paths, "frame_specific_timestamp", schema, pairs)
    lane = F.when(F.col("EGO_lane").rlike("^[0-9]+$"), F.col("EGO_lane").cast("int"))
    return rows.select("trace_id", F.col("_chunktime").alias("t_us"), F.col("_frame").alias("frame"), F.col("Road_type").alias("road_type"), F.col("NUM_lanes").cast("int").alias("num_lanes"), lane.alias("ego_lane"), F.col("Weather_1").alias("weather"), F.col("Light_conditions").alias("light"))


def _prefixes(name: str) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n)))


def claims(ego: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every annotation with the trace it belongs to: (annotation_path, name, ego_path, how, won); name is null without one.

    ego: (name, path), of several files of a name the smallest path stands for
    it; annotations: (stem, path). A stem that equals a name but for its ending
    is ``exact``; else it is ``prefix`` if it begins with a name, case aside,
    with at most four names between that and the stem in sorted order, and the
    longest counts. All of those begin with the name, too, so stems and names
    meet by equi-joins on prefixes. Exact claims go before others, each kind by path;
    the first wins the trace.
    """
    own = ego.groupBy("name").agg(F.min("path").alias("ego_path")).withColumn("low", F.lower("name"))
    notes = annotations.select("stem", F.col("path").alias("annotation_path"), F.lower("stem").alias("low"))
    exact = notes.withColumn("name", F.regexp_replace("stem", SUFFIX, "")).join(own.drop("low"), "name").select("annotation_path", "name", "ego_path", F.lit("exact").alias("how"))
    rest = notes.join(exact.select("annotation_path"), "annotation_path", "left_anti")
    met = rest.select("annotation_path", F.col("low").alias("all"), _prefixes("low").alias("low")).join(own, "low")
    longest = met.groupBy("annotation_path", "all").agg(F.max(F.struct(F.length("low"), "name", "ego_path", "low")).alias("m")).select("annotation_path", "all", "m.name", "m.ego_path", F.col("m.low").alias("begin"))
    longer = own.select(F.col("low").alias("other"), _prefixes("low").alias("begin")).where("other <> begin")
    between = longest.join(longer, "begin").where("other <= all").groupBy("annotation_path").agg(F.count("*").alias("n"))
    loose = longest.join(between, "annotation_path", "left").where(F.coalesce("n", F.lit(0)) <= BEFORE).select("annotation_path", "name", "ego_path", F.lit("prefix").alias("how"))
    found = exact.unionByName(loose)
    first = Window.partitionBy("name").orderBy("how", "annotation_path")
    ranked = found.withColumn("won", F.row_number().over(first) == 1)
    return notes.select("annotation_path").join(ranked, "annotation_path", "left")


def pair_files(ego: DataFrame, annotations: DataFrame) -> DataFrame:
    """(name, ego_path, annotation_path, how) of every trace that has both files; see ``claims``."""
    return claims(ego, annotations).where("won").select("name", "ego_path", "annotation_path", "how")


def unmatched(ego: DataFrame, annotations: DataFrame) -> DataFrame:
    """(kind, name): trace names without an annotation, and annotation paths without a trace."""
    found = claims(ego, annotations)
    alone = ego.select("name").distinct().join(found.where("won").select("name"), "name", "left_anti")
    return alone.select(F.lit("ego").alias("kind"), "name").unionByName(found.where("name is null").select(F.lit("annotation").alias("kind"), F.col("annotation_path").alias("name")))


def scan_counts(ego: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row of counters of a scan, with up to ten examples of what found no partner."""
    found = claims(ego, annotations)
    files = ego.agg(F.count("*").alias("ego_files"), F.count_distinct("name").alias("traces"))
    notes = found.agg(F.count("*").alias("annotation_files"), F.count_if("won").alias("matched"), F.count_if(~F.col("won")).alias("duplicates"), F.count_if(F.col("name").isNull()).alias("unmatched_annotations"))
    some = unmatched(ego, annotations).withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy("name"))).where(F.col("at") <= EXAMPLES)
    shown = some.agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))), ",").alias(f"{k}_examples") for k in ("ego", "annotation")))
    row = files.join(notes, F.lit(True)).join(shown, F.lit(True))  # one row each
    return row.withColumns({"name_collisions": F.col("ego_files") - F.col("traces"), "unmatched_traces": F.col("traces") - F.col("matched")})


def files_by_subtree(files: DataFrame, root: str) -> DataFrame:
    """(subtree, n): files below each top-level folder of ``root``; ``.`` for those in the root itself."""
    rest = F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20), "/")
    return files.groupBy(F.when(F.size(rest) > 1, rest[0]).otherwise(".").alias("subtree")).agg(F.count("*").alias("n"))
