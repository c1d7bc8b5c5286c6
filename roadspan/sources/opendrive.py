"""OpenDRIVE documents: one road per trace, put together from several relations and streamed to one file each.

Every element is a row of text with its place in the document (part, s,
ordinal), made by column expressions. Rows are sorted by file and place and
written as they come, so no document is held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspan.sources.files import write_in_order

#: Fixed values of the format: version, the type of a lane that is driven on, the marks of lanes and their width (m).
MAJOR, MINOR, DRIVING, OUTER_MARK, INNER_MARK, MARK_M = 1, 6, "driving", "solid", "broken", 0.12
#: Parts of a document in their order.
HEAD, GEOMETRY, LANES, OFFSET, SECTION, AFTER_LANES, OBJECT, TAIL = range(8)
ORDER = ["part", "s", "ord"]


def _escaped(text: Column) -> Column:
    """A text as an attribute's value; characters that XML can't hold are left out."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _lane(number: Column, width: Column, outermost: Column) -> Column:
    mark = F.when(outermost, OUTER_MARK).otherwise(INNER_MARK)
    return F.format_string(
        f'          <lane id="%d" type="{DRIVING}" level="false">\n            <width sOffset="0" a="%.2f" b="0" c="0" d="0"/>\n'
        f'            <roadMark sOffset="0" type="%s" weight="standard" color="standard" width="{MARK_M}"/>\n          </lane>\n',
        number, width, mark,
    )


def _section(left: Column, right: Column, s: Column) -> Column:
    """One section: the left lanes from the outermost in, the middle, the right lanes from the middle out. A section holds a dozen lanes at most."""
    n, m = F.size(left), F.size(right)
    inward = F.transform(F.reverse(left), lambda w, i: _lane(n - i, w, i == 0))
    outward = F.transform(right, lambda w, i: _lane(-(i + 1), w, i == m - 1))
    block = lambda tag, lanes: F.concat(F.lit(f"        <{tag}>\n"), F.array_join(lanes, ""), F.lit(f"        </{tag}>\n"))
    middle = (
        '        <center>\n          <lane id="0" type="none" level="false">\n            <roadMark sOffset="0" type="'
        f'{OUTER_MARK}" weight="standard" color="standard" width="{MARK_M}"/>\n          </lane>\n        </center>\n'
    )
    return F.concat(F.format_string('      <laneSection s="%.3f">\n', s), F.when(n > 0, block("left", inward)).otherwise(""), F.lit(middle), block("right", outward), F.lit("      </laneSection>\n"))


def elements(roads: DataFrame, geometry: DataFrame, sections: DataFrame, objects: DataFrame, name: str = "road") -> DataFrame:
    """(path, part, s, ord, data) of the documents of ``roads`` (trace_id, path, name).

    geometry: ``road.plan_view``; sections: ``lanes.lane_sections``; objects:
    ``road.static_placements``. A trace may have several paths; of rows that
    repeat a path one counts. A road without geometry gives no file, as there
    is none to describe. Null names are ``name``, null labels empty; objects
    without a place on the road are left out. Where a file has no object, it
    has no list of them. The road begins at its first pose, s = 0.
    """
    roads = roads.where("path is not null").groupBy("path").agg(F.min(F.struct("trace_id", "name")).alias("r")).select("path", "r.trace_id", F.coalesce("r.name", F.lit(name)).alias("name"))
    row = lambda part, s, ord_, text: [F.lit(part).alias("part"), s.cast("double").alias("s"), ord_.cast("long").alias("ord"), text.alias("text")]
    zero = F.lit(0)
    length = geometry.groupBy("trace_id").agg(F.max(F.col("s") + F.col("length")).alias("length"))
    placed = objects.where("s is not null and t is not null")
    counts = placed.groupBy("trace_id").agg(F.count("*").alias("n"))
    frame = roads.join(length.hint("merge"), "trace_id").join(counts.hint("merge"), "trace_id", "left").withColumn("name", _escaped(F.col("name")))
    head = F.format_string(
        f'<?xml version="1.0" encoding="UTF-8"?>\n<OpenDRIVE>\n  <header revMajor="{MAJOR}" revMinor="{MINOR}" name="%s" version="1.00" north="0" south="0" east="0" west="0"/>\n'
        '  <road name="%s" length="%.3f" id="1" junction="-1">\n    <planView>\n', "name", "name", "length",
    )
    parts = F.array(*(F.struct(*row(p, zero, zero, t)) for p, t in (
        (HEAD, head), (LANES, F.lit("    </planView>\n    <lanes>\n")),
        (AFTER_LANES, F.concat(F.lit("    </lanes>\n"), F.when(F.col("n") > 0, "    <objects>\n").otherwise(""))),
        (TAIL, F.concat(F.when(F.col("n") > 0, "    </objects>\n").otherwise(""), F.lit("  </road>\n</OpenDRIVE>\n"))),
    )))
    frame_rows = frame.select("path", F.inline(parts))
    shape = F.when(F.col("shape") == "line", F.lit("<line/>")).otherwise(F.format_string('<arc curvature="%.6f"/>', "curvature"))
    stretch = F.format_string('      <geometry s="%.3f" x="%.3f" y="%.3f" hdg="%.6f" length="%.3f">%s</geometry>\n', "s", "x_m", "y_m", "hdg", "length", shape)
    offset = F.format_string('      <laneOffset s="%.3f" a="%.3f" b="0" c="0" d="0"/>\n', "s_start", "center_offset")
    thing = F.format_string(
        '      <object id="%d" name="%s" type="%s" s="%.3f" t="%.3f" zOffset="0" hdg="0" pitch="0" roll="0" length="%.2f" width="%.2f" height="%.2f" orientation="none"/>\n',
        "obj_id", _escaped(F.coalesce("label", F.lit(""))), "odr_type", "s", "t", *(F.coalesce(c, F.lit(0.0)) for c in ("length", "width", "height")),
    )
    s, at = F.col("s"), F.col("s_start")
    made = [
        geometry.select("trace_id", *row(GEOMETRY, s, zero, stretch)),
        sections.select("trace_id", *row(OFFSET, at, zero, offset)),
        sections.select("trace_id", *row(SECTION, at, zero, _section(F.col("left_widths"), F.col("lane_widths"), at))),
        placed.select("trace_id", *row(OBJECT, zero, F.col("obj_id"), thing)),
    ]
    all_rows = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    body = frame.select("trace_id", "path").join(all_rows.hint("merge"), "trace_id").select("path", *ORDER, "text")
    return frame_rows.unionByName(body).select("path", *ORDER, F.encode("text", "UTF-8").alias("data"))


def write_opendrive(roads: DataFrame, geometry: DataFrame, sections: DataFrame, objects: DataFrame) -> DataFrame:
    """Write the documents; returns (path, bytes) of each, when computed. See ``elements`` and ``write_in_order``."""
    return write_in_order(elements(roads, geometry, sections, objects), ORDER)


def _attributes(**fields: str) -> str:
    return ", ".join(f"_{k}: {v}" for k, v in fields.items())


_LANE = f"struct<{_attributes(id='int')}, width: struct<{_attributes(a='double')}>, roadMark: struct<{_attributes(type='string')}>>"
_ROAD = (
    f"_name string, _length double, planView struct<geometry: array<struct<{_attributes(s='double', x='double', y='double', hdg='double', length='double')}, arc: struct<_curvature: double>>>>, "
    f"lanes struct<laneOffset: array<struct<{_attributes(s='double', a='double')}>>, laneSection: array<struct<_s: double, left: struct<lane: array<{_LANE}>>, right: struct<lane: array<{_LANE}>>>>>, "
    f"objects struct<object: array<struct<{_attributes(id='long', name='string', type='string', s='double', t='double', length='double', width='double', height='double')}>>>"
)


def read_roads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, length, geometry, offsets, sections, objects): roads as stored, a row each, with their elements as arrays in the file's order."""
    rows = spark.read.format("xml").option("rowTag", "road").schema(T.StructType.fromDDL(_ROAD)).load(paths)
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_name").alias("name"), F.col("_length").alias("length"), F.col("planView.geometry").alias("geometry"),
        F.col("lanes.laneOffset").alias("offsets"), F.col("lanes.laneSection").alias("sections"), F.col("objects.object").alias("objects"),
    )


def read_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per stretch, offset, lane and object of the files: path, part, ord (place in the file), s, number, kind, name, and values a, b, c, d.

    Stretches: x, y, heading and length, kind ``line`` or ``arc``; arcs have
    their curvature in e. Offsets: the offset. Lanes: the width, kind that of
    their mark. Objects: t, length, width and height.
    """
    roads = read_roads(spark, paths)
    none, zero = F.lit(None), F.lit(0.0)

    def rows(frame: DataFrame, part: str, s: Column, number: Column = none, kind: Column = none, name: Column = none, a: Column = none, b: Column = none, c: Column = none, d: Column = none, e: Column = none) -> DataFrame:
        values = [v.cast("double").alias(k) for k, v in (("s", s), ("a", a), ("b", b), ("c", c), ("d", d), ("e", e))]
        return frame.select("path", F.lit(part).alias("part"), "ord", number.cast("long").alias("number"), kind.cast("string").alias("kind"), name.cast("string").alias("name"), *values)

    def each(column: str) -> DataFrame:
        return roads.select("path", F.posexplode(column).alias("ord", "r"))

    at = lambda n: F.col(f"r.{n}")
    curved = at("arc._curvature")
    lane = each("sections").select("path", "ord", at("_s").alias("at"), F.posexplode(F.concat(*(F.coalesce(at(f"{side}.lane"), F.array().cast(f"array<{_LANE}>")) for side in ("left", "right")))).alias("k", "r"))
    lane = lane.withColumn("ord", F.col("ord") * 100 + F.col("k"))
    out = rows(each("geometry"), "stretch", at("_s"), kind=F.when(curved.isNull(), "line").otherwise("arc"), a=at("_x"), b=at("_y"), c=at("_hdg"), d=at("_length"), e=F.coalesce(curved, zero))
    out = out.unionByName(rows(each("offsets"), "offset", at("_s"), a=at("_a")))
    out = out.unionByName(rows(lane, "lane", F.col("at"), number=at("_id"), kind=at("roadMark._type"), a=at("width._a")))
    return out.unionByName(rows(each("objects"), "object", at("_s"), number=at("_id"), kind=at("_type"), name=at("_name"), a=at("_t"), b=at("_length"), c=at("_width"), d=at("_height")))
