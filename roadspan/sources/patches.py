"""Keyed patches of annotation XML files that keep every byte they don't know.

A file is never parsed as a whole. Spark's text reader cuts it behind each
observation's closing tag; a record is a head (all that stands before the
observation, such as the end of the vehicle before), the white space and the
observation. Records meet the changed rows by (trace, vehicle, frame), and what
comes out is put in order and streamed to a new file. Bytes pass through as
Latin-1 characters, one each, whatever the file's own encoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspan.sources.files import write_in_order
from roadspan.sources.traces import _plain

#: Fixed values of the format: the observation's and the vehicle's element, and what marks a prediction.
OBSERVATION, VEHICLE = "rect_vehicle_timestamp", "rect_vehicle"
PREDICTED_STATE, PREDICTED_CONFIDENCE = "predicted", "Predicted"
END = f"</{OBSERVATION}>"
_LAST_OPEN = rf"(?s)^(.*?)(\s*)(<{OBSERVATION}(?=[\s>])(?:(?!<{OBSERVATION}[\s>]).)*+)$"


def records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Records of the files (path, trace_id, target): place in the file, vehicle, frame, time, and the parts head, gap and body.

    ``vehicle_no`` counts the vehicles that have observations; the last record
    of a file has no body. A file is split over tasks as any text file is.
    """
    paths = [r["path"] for r in files.select("path").distinct().collect()]  # names of files, as every read needs them
    raw = spark.read.option("lineSep", END).text(paths).select(_plain(F.col("_metadata.file_path")).alias("__path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("text"))
    named = raw.join(F.broadcast(files.withColumn("__path", _plain(F.regexp_replace("path", "^/", "file:/"))).select("__path", "trace_id", "target")), "__path")
    has = F.col("text").rlike(rf"<{OBSERVATION}[\s>]")
    part = lambda i: F.when(has, F.regexp_extract("text", _LAST_OPEN, i))
    rows = named.select("__path", "trace_id", "target", "block", "no", F.coalesce(part(1), F.col("text")).alias("head"), F.coalesce(part(2), F.lit("")).alias("gap"), part(3).alias("body"))
    opens = F.col("head").rlike(rf"<{VEHICLE}[\s>]")
    tag = F.regexp_extract("body", r"(?s)^<[^>]*>", 0)
    number = lambda name: F.try_to_number(F.nullif(F.regexp_extract(tag, rf'(?<![\w-]){name}\s*=\s*["\']\s*(-?\d+)', 1), F.lit("")), F.lit("S999999999999999999")).cast("long")
    own = F.regexp_extract(F.element_at(F.split("head", rf"<{VEHICLE}(?=[\s>])"), -1), r"<id>\s*(-?\d+)\s*</id>", 1)
    order = Window.partitionBy("__path").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, 0)
    # an empty text stands for a vehicle without a number, so that it doesn't take on the one before
    return rows.withColumns({
        "vehicle_no": F.sum(F.when(opens, 1).otherwise(0)).over(order),
        "obj_id": F.nullif(F.last(F.when(opens, own), ignorenulls=True).over(order), F.lit("")).cast("int"),
        "frame": F.when(F.col("body").isNotNull(), number("frame").cast("int")),
        "t_us": F.coalesce(number("chunktime"), F.lit(0).cast("long")),
    })


def _text(value: Column) -> Column:
    """A text as XML writes it in any encoding: everything but plain ASCII as character references."""
    codes = F.transform(F.split(F.coalesce(value, F.lit("")), ""), lambda c: F.when(c.isin("&", "<", ">") | (F.ascii(c) > 126), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c))
    return F.array_join(codes, "")


def _plain_replacement(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _set_field(body: Column, name: str, value: Column) -> Column:
    """``body`` with the content of its first element ``name`` replaced; without such an element it stays."""
    pattern = rf"(?s)^(.*?<{name}(?:\s[^>]*)?>)[^<]*(</{name}>.*)$"
    return F.regexp_replace(body, F.lit(pattern), F.concat(F.lit("$1"), _plain_replacement(value), F.lit("$2")))


def _set_attribute(body: Column, name: str, value: Column) -> Column:
    """``body`` with an attribute of its opening tag, which stands first from then on."""
    bare = F.regexp_replace(body, rf"(?s)^(<[^>]*?)\s+{name}\s*=\s*(?:\"[^\"]*\"|'[^']*')", "$1")
    return F.regexp_replace(bare, F.lit(r"^(<[\w.-]+)"), F.concat(F.lit("$1"), F.lit(f' {name}="'), _plain_replacement(value), F.lit('"')))


def _number(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)).cast("double").cast("string")


def patched(spark: SparkSession, files: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, order columns, data) of the patched files; ``path`` is the target.

    files: (path, trace_id, target). rows: the observations that a trace is to
    have, as the readers give them (trace_id, obj_id, frame, t_us, x_rel, y_rel,
    z_rel, length, width, height, zrot in radians, obj_movement, lane), with
    ``fixed`` and ``synthetic``. Of a vehicle that has rows, observations whose
    frame no row names are left out, those of fixed rows get x, y and the
    angle in degrees, and synthetic rows come in as copies of its first
    observation with values of their own, frames -n to -1 in order of time, and
    the marks of predictions. Such a vehicle's observations are in order of
    time. Vehicles without rows, and all else, stay byte for byte; so does a
    vehicle whose rows change nothing. Of rows that repeat a frame a fixed one
    counts. Vehicles or observations without a number are left alone. Records
    that no file has are ignored.
    """
    keys = ["trace_id", "obj_id"]
    found = records(spark, files)
    real = rows.where("not synthetic").groupBy(*keys, "frame").agg(F.max(F.struct("fixed", "x_rel", "y_rel", "zrot")).alias("r"))
    made = rows.where("synthetic")
    tracks = rows.groupBy(*keys).agg(F.count_if("synthetic").alias("n_made"))
    met = found.join(tracks, keys, "left").join(real, [*keys, "frame"], "left")
    gone = F.col("body").isNotNull() & F.col("n_made").isNotNull() & F.col("frame").isNotNull() & F.col("r").isNull()
    fixed = F.coalesce(F.col("r.fixed"), F.lit(False))
    vehicle = Window.partitionBy("__path", "vehicle_no")
    met = met.withColumns({"gone": gone, "changed": F.coalesce(F.max(gone | fixed | (F.col("n_made") > 0)).over(vehicle), F.lit(False))})
    body = F.col("body")
    for name, value in (("xp", F.col("r.x_rel")), ("yp", F.col("r.y_rel")), ("zrot", F.degrees("r.zrot"))):
        body = _set_field(body, name, _number(value))
    met = met.withColumn("kept", F.when(~F.col("gone") & F.col("body").isNotNull(), F.concat("gap", F.when(fixed, body).otherwise(F.col("body")), F.lit(END))))
    last = F.col("body").isNull()
    at = F.when(F.col("changed") & ~last, F.col("t_us"))
    pieces = F.array(
        F.struct(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t"), F.concat("head", F.when(last, F.col("gap")).otherwise("")).alias("text")),
        F.struct(F.lit(1).alias("kind"), at.alias("t"), F.col("kept").alias("text")),
    )
    # heads after a vehicle's first observation are comments and the like: they stay before their observation
    opens = F.col("head").rlike(rf"<{VEHICLE}[\s>]") | last
    own = met.withColumn("after", last.cast("int")).withColumn("e", F.explode(pieces)).where("e.text is not null and e.text <> ''")
    base = own.select("target", "vehicle_no", "after", F.when(opens, F.col("e.kind")).otherwise(1).alias("kind"), F.when(F.col("e.kind") == 1, F.col("e.t")).otherwise(F.when(~opens, at)).alias("t"), "block", "no", F.col("e.kind").alias("piece"), F.col("e.text").alias("text"))
    first = met.where("body is not null").groupBy("target", "trace_id", "obj_id", "vehicle_no").agg(F.min(F.struct("gone", "block", "no", "gap", "body")).alias("f"))
    count = Window.partitionBy(*keys)
    # a vehicle's predictions, of which there are a few dozen
    new = made.withColumn("frame", (F.row_number().over(count.orderBy("t_us")) - F.count("*").over(count) - 1).cast("int")).join(first, keys)
    body = F.col("f.body")
    for name, value in (("time", "t_us"), ("chunktime", "t_us"), ("frame", "frame")):
        body = _set_attribute(body, name, F.col(value).cast("string"))
    body = _set_attribute(body, "interpolationState", F.lit(PREDICTED_STATE))
    for name, value in (("obj_movement", _text(F.col("obj_movement"))), ("obj_lane", _text(F.col("lane"))), ("obj_confidence", F.lit(PREDICTED_CONFIDENCE))):
        body = _set_field(body, name, value)
    for name, value in (("xp", F.col("x_rel")), ("yp", F.col("y_rel")), ("zp", F.col("z_rel")), ("xs", F.col("length")), ("ys", F.col("width")), ("zs", F.col("height")), ("zrot", F.degrees("zrot"))):
        body = _set_field(body, name, _number(value))
    new = new.select("target", "vehicle_no", F.lit(0).alias("after"), F.lit(1).alias("kind"), F.col("t_us").alias("t"), F.lit(1 << 62).alias("block"), (F.col("frame") + (1 << 31)).cast("long").alias("no"), F.lit(1).alias("piece"), F.concat("f.gap", body, F.lit(END)).alias("text"))
    return base.unionByName(new).select(F.col("target").alias("path"), "after", "vehicle_no", "kind", "t", "block", "no", "piece", F.encode("text", "ISO-8859-1").alias("data"))


def write_patched(spark: SparkSession, files: DataFrame, rows: DataFrame) -> DataFrame:
    """Write the patched files; returns (path, bytes) of each, when computed. See ``patched`` and ``write_in_order``."""
    return write_in_order(patched(spark, files, rows), ["after", "vehicle_no", "kind", "t", "block", "no", "piece"])
