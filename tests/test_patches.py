"""Annotation patches: bytes that nothing changes, fixed, removed and synthetic observations, repeated tasks."""

import math
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from roadspan.sources import files, patches, traces

KIND = "trace_id string, obj_id int, frame int, t_us long, x_rel double, y_rel double, z_rel double, length double, width double, height double, zrot double, obj_movement string, lane string, fixed boolean, synthetic boolean"


def _stamp(frame, t, x, lane="EGO lane", extra=""):
    return f"""
      <rect_vehicle_timestamp frame="{frame}" chunktime='{t}' interpolationState="manual" own="1">{extra}
        <obj_movement>Moving</obj_movement><obj_lane>{lane}</obj_lane><obj_confidence>High</obj_confidence>
        <bounding_box><vehicle_bb><coordinates><xp>{x}</xp><yp>1.50</yp><zp>0</zp><xs>4.2</xs><ys>1.8</ys><zs>1.5</zs><zrot>90</zrot></coordinates></vehicle_bb></bounding_box>
      </rect_vehicle_timestamp>"""


def _vehicle(i, stamps):
    return f"\n  <rect_vehicle>\n    <id>{i}</id><obj_type>Car</obj_type>\n    <timestamps>{''.join(stamps)}\n    </timestamps>\n  </rect_vehicle>"


def _file(vehicles):
    text = f"""<?xml version='1.0' encoding='iso-8859-1'?>
<root><scene_attributes><Country_code>Österreich &amp; Co</Country_code></scene_attributes>
<vehicles>{''.join(vehicles)}
</vehicles><!-- geprüft --><static_objects><rect_static><id>9</id></rect_static></static_objects>
</root>\n"""
    return text.encode("latin-1")


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    a = _file([_vehicle(1, [_stamp(1, 0, 10), _stamp(2, 400_000, 11, extra="<!-- zwölf -->"), _stamp(3, 800_000, 12)]), "\n  <rect_vehicle><id>5</id><timestamps/></rect_vehicle>", _vehicle(2, [_stamp(2, 400_000, 30), _stamp(1, 0, 29)])])
    (folder / "a__ref-QC_IND.xml").write_bytes(a)
    (folder / "b.xml").write_bytes(_file([]))
    return folder


def _files(spark, folder, out):
    return spark.createDataFrame([(f"{folder}/a__ref-QC_IND.xml", "a", f"{out}/a.xml"), (f"{folder}/b.xml", "b", f"{out}/b.xml")], "path string, trace_id string, target string")


def _rows(spark, folder, *more):
    seen = traces.read_vehicles(spark, str(folder)).select("trace_id", "obj_id", "frame", "t_us", "x_rel", "y_rel", "z_rel", "length", "width", "height", "zrot", "obj_movement", "lane", F.lit(False).alias("fixed"), F.lit(False).alias("synthetic"))
    return seen.unionByName(spark.createDataFrame(list(more), KIND)) if more else seen


def test_without_changes_bytes_stay(spark, source, tmp_path):
    for rows in (_rows(spark, source), _rows(spark, source).limit(0)):
        got = {r.path.rpartition("/")[2]: r.bytes for r in patches.write_patched(spark, _files(spark, source, tmp_path / "out"), rows).collect()}
        for name, old in (("a.xml", "a__ref-QC_IND.xml"), ("b.xml", "b.xml")):
            want = (source / old).read_bytes()
            assert (tmp_path / "out" / name).read_bytes() == want and got[name] == len(want)


def test_fixed_removed_and_synthetic(spark, source, tmp_path):
    out = tmp_path / "out"
    rows = _rows(spark, source).where("not (trace_id = 'a' and obj_id = 1 and frame = 3)")
    hit = (F.col("obj_id") == 1) & (F.col("frame") == 2)
    rows = rows.withColumns({"x_rel": F.when(hit, 11.25).otherwise(F.col("x_rel")), "zrot": F.when(hit, math.pi / 4).otherwise(F.col("zrot")), "fixed": hit})
    rows = rows.unionByName(spark.createDataFrame([("a", 1, None, t, x, -3.5, 0.25, 5.0, 2.0, 1.6, 0.0, "Moving", "1st Räd <x>", False, True) for t, x in ((900_000, 14.0), (200_000, 10.5))], KIND))
    for _ in range(2):  # a repeated run leaves one file
        patches.write_patched(spark, _files(spark, source, out), rows).collect()
    assert sorted(p.name for p in out.iterdir()) == ["a.xml", "b.xml"]
    text = (out / "a.xml").read_bytes().decode("latin-1")
    old = (source / "a__ref-QC_IND.xml").read_bytes().decode("latin-1")
    begin, end = "<id>2</id>", "</root>"
    assert text[text.index(begin) : text.index(end)] == old[old.index(begin) : old.index(end)]  # untouched, out of order as it was
    stamps = ET.fromstring(text.encode("latin-1")).find("vehicles/rect_vehicle").findall("timestamps/rect_vehicle_timestamp")
    value = lambda s, n: s.findtext(f"bounding_box/vehicle_bb/coordinates/{n}")
    assert [(s.get("frame"), s.get("chunktime"), s.get("interpolationState"), s.get("own"), float(value(s, "xp"))) for s in stamps] == [
        ("1", "0", "manual", "1", 10.0), ("-2", "200000", "predicted", "1", 10.5), ("2", "400000", "manual", "1", 11.25), ("-1", "900000", "predicted", "1", 14.0),
    ]
    assert [value(s, "zrot") for s in stamps] == ["90", "0.0", "45.0", "0.0"] and value(stamps[0], "yp") == "1.50"
    assert stamps[1].get("time") == "200000" and stamps[1].findtext("obj_lane") == "1st Räd <x>" and stamps[1].findtext("obj_confidence") == "Predicted" and value(stamps[1], "zs") == "1.6"
    again = {(r.obj_id, r.frame): (r.x_rel, round(r.zrot, 9)) for r in traces.read_vehicles(spark, str(out)).where("trace_id = 'a'").collect()}
    assert again == {(1, 1): (10.0, round(math.pi / 2, 9)), (1, -2): (10.5, 0.0), (1, 2): (11.25, round(math.pi / 4, 9)), (1, -1): (14.0, 0.0), (2, 2): (30.0, round(math.pi / 2, 9)), (2, 1): (29.0, round(math.pi / 2, 9))}


def test_splits_of_a_file_keep_its_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = _file([_vehicle(i, [_stamp(f, f * 100_000, f) for f in range(40)]) for i in range(20)])
    (tmp_path / "in" / "c.xml").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        one = spark.createDataFrame([(f"{tmp_path}/in/c.xml", "c", f"{tmp_path}/out/c.xml")], "path string, trace_id string, target string")
        rows = _rows(spark, tmp_path / "in").limit(0)
        assert spark.read.option("lineSep", patches.END).text(f"{tmp_path}/in/c.xml").rdd.getNumPartitions() > 5
        patches.write_patched(spark, one, rows).collect()
        assert (tmp_path / "out/c.xml").read_bytes() == data
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_appear_complete_only(spark, tmp_path):
    target = f"{tmp_path}/out/x.bin"
    bad = spark.createDataFrame([(target, 1, b"ab"), (target, 0, b"cd")], "path string, i int, data binary")
    assert [tuple(r) for r in files.write_in_order(bad, ["i"]).collect()] == [(target, 4)]
    assert (tmp_path / "out/x.bin").read_bytes() == b"cdab" and len(list((tmp_path / "out").iterdir())) == 1
    with pytest.raises(Exception, match="broken"):
        files.write_in_order(bad.withColumn("data", F.when(F.col("i") == 1, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("data"))).withColumn("path", F.lit(f"{tmp_path}/out/y.bin")), ["i"]).collect()
    assert not (tmp_path / "out/y.bin").exists()
