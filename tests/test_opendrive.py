"""OpenDRIVE documents: order of elements, odd names, roads without objects, several paths, reading back."""

import xml.etree.ElementTree as ET

import pytest

from roadspan.sources import opendrive

ROAD, GEO = "trace_id long, path string, name string", "trace_id long, s double, x_m double, y_m double, hdg double, length double, curvature double, shape string"
SEC = "trace_id long, window long, s_start double, num_lanes int, lane_widths array<double>, source string, center_offset double, left_widths array<double>"
OBJ = "trace_id long, obj_id long, label string, odr_type string, s double, t double, length double, width double, height double"


@pytest.fixture
def tables(spark):
    geometry = [(t, i * 5.0, i * 5.0, 0.0, 0.1, 5.0, c, "line" if abs(c) < 1e-4 else "arc") for t in (1, 2) for i, c in enumerate([0.0, 0.02, -0.02] + [0.0] * 17)]
    sections = [(t, w, w * 30.0, 2, [3.5, 3.25], "annotation", 1.75, left) for t in (1, 2) for w, left in enumerate([[3.0, 3.1, 3.2], [], [3.0], [3.0]])]
    objects = [(1, 9, 'a "b" <c> & d\x01\n', "pole", 12.5, -3.0, 0.2, 0.3, 2.0), (1, 4, None, "none", 90.0, 4.0, None, 1.0, 1.0), (1, 5, "off", "none", None, None, 1.0, 1.0, 1.0), (3, 1, "x", "none", 0.0, 0.0, 1.0, 1.0, 1.0)]
    return [spark.createDataFrame(r, k) for r, k in ((geometry, GEO), (sections, SEC), (objects, OBJ))]


def test_order_and_values(spark, tables, tmp_path):
    roads = [(1, f"file://{tmp_path}/a.xodr", "Straße 'A' & <B>"), (1, f"file://{tmp_path}/b.xodr", None), (2, f"file://{tmp_path}/c.xodr", "c"), (2, f"file://{tmp_path}/c.xodr", "c"), (3, f"file://{tmp_path}/none.xodr", "no line"), (1, None, "no path")]
    made = opendrive.write_opendrive(spark.createDataFrame(roads, ROAD), *tables)
    sizes = {r.path.rpartition("/")[2]: r.bytes for r in made.collect()}
    assert set(sizes) == {"a.xodr", "b.xodr", "c.xodr"} == {p.name for p in tmp_path.iterdir()} and all((tmp_path / k).stat().st_size == n for k, n in sizes.items())
    before = {k: (tmp_path / k).read_bytes() for k in sizes}
    assert len(made.collect()) == 3 and before == {p.name: p.read_bytes() for p in tmp_path.iterdir()}  # a repeated task leaves one file

    root = ET.parse(tmp_path / "a.xodr").getroot()
    (road,) = root.findall("road")
    assert root.find("header").attrib["revMinor"] == "6" and road.attrib == {"name": "Straße 'A' & <B>", "length": "100.000", "id": "1", "junction": "-1"} and [e.tag for e in road] == ["planView", "lanes", "objects"]
    stretches = road.findall("planView/geometry")
    assert [float(g.get("s")) for g in stretches] == [i * 5.0 for i in range(20)] and [g[0].tag for g in stretches] == ["line", "arc", "arc"] + ["line"] * 17 and stretches[2][0].get("curvature") == "-0.020000"
    assert [e.tag for e in road.find("lanes")] == ["laneOffset"] * 4 + ["laneSection"] * 4 and [float(e.get("s")) for e in road.find("lanes")] == [0, 30, 60, 90] * 2
    first, second = road.findall("lanes/laneSection")[:2]
    assert [e.tag for e in first] == ["left", "center", "right"] and [e.tag for e in second] == ["center", "right"]
    lane = lambda e: [(x.get("id"), x.find("width").get("a"), x.find("roadMark").get("type")) for x in e]
    assert lane(first.find("left")) == [("3", "3.20", "solid"), ("2", "3.10", "broken"), ("1", "3.00", "broken")] and lane(first.find("right")) == [("-1", "3.50", "broken"), ("-2", "3.25", "solid")]
    things = road.findall("objects/object")
    assert [(o.get("id"), o.get("name"), o.get("s"), o.get("length")) for o in things] == [("4", "", "90.000", "0.00"), ("9", 'a "b" <c> & d\n', "12.500", "0.20")]
    assert ET.parse(tmp_path / "b.xodr").getroot().find("road").get("name") == "road" and ET.parse(tmp_path / "c.xodr").getroot().find("road/objects") is None

    read = opendrive.read_elements(spark, f"file://{tmp_path}/a.xodr").orderBy("part", "ord").collect()
    assert [(r.number, r.kind, r.a) for r in read if r.part == "lane"][:5] == [(3, "solid", 3.2), (2, "broken", 3.1), (1, "broken", 3.0), (-1, "broken", 3.5), (-2, "solid", 3.25)]
    assert [(r.kind, r.e) for r in read if r.part == "stretch"][:3] == [("line", 0.0), ("arc", 0.02), ("arc", -0.02)] and sum(r.part == "offset" for r in read) == 4 and [r.number for r in read if r.part == "object"] == [4, 9]


def test_no_roads(spark, tables):
    assert opendrive.write_opendrive(spark.createDataFrame([], ROAD), *tables).collect() == []
