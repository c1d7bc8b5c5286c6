"""Stored maps: keys of boxes, both forms of a file, broken ones, tags, boxes that are missing, ways in a trace's frame."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from roadspan.operators import road
from roadspan.sources import maps


def _key(box):
    return hashlib.sha1(str(tuple(round(v, 4) for v in box)).encode()).hexdigest()[:16]


def test_keys_are_those_of_written_tuples(spark):
    rnd = random.Random(4)
    boxes = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180), rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(200)] + [(0.0, 0.0001, 48.5, -7.0), (100.0, 1e-9, -0.00012, 12.25)]
    rows = spark.createDataFrame([*boxes, (None, 1.0, 2.0, 3.0)], "min_lat double, min_lon double, max_lat double, max_lon double")
    got = rows.select("*", maps.box_key(*map(F.col, maps.BOX)).alias("key")).collect()
    assert len(got) == 203 and all(r.key == (None if r.min_lat is None else _key(tuple(r)[:4])) for r in got)


@pytest.mark.parametrize(("tags", "want"), [
    ({"name": "A", "ref": "B", "lanes": " 4 ", "maxspeed": "30 mph"}, ("A", 4, 30 * 1.60934)), ({"name": "", "ref": "B", "lanes": "2;3", "maxspeed": "80"}, ("B", None, 80.0)),
    ({"lanes": "3.5", "maxspeed": "walk"}, (None, None, None)), ({"maxspeed": "30mph", "lanes": ""}, (None, None, None)), ({}, (None, None, None)), ({"maxspeed": "  12.5 km/h"}, (None, None, 12.5)),
])
def test_tags(spark, tags, want):
    row = spark.createDataFrame([(tags,)], "tags map<string,string>").select(maps.way_name(F.col("tags")), maps.way_lanes(F.col("tags")), maps.way_maxspeed_kph(F.col("tags"))).first()
    assert tuple(row) == want


def test_files_and_overlay(spark, tmp_path):
    boxes = {1: (48.0, 9.0, 48.01, 9.01), 2: (48.0, 9.0, 48.01, 9.01), 3: (50.0, 8.0, 50.01, 8.01), 4: (51.0, 8.0, 51.01, 8.01), 5: (52.0, 8.0, 52.01, 8.01), 6: (None, 8.0, 52.01, 8.01)}
    put = lambda i, text: (tmp_path / f"osm_{_key(boxes[i])}.json").write_text(text)
    put(1, json.dumps({"provider": "osm", "bbox": {}, "ways": [{"id": 7, "points": [[48.0, 9.0], [48.0, 9.001]], "tags": {"name": "Ring"}}, {"id": 8, "points": [], "tags": {}}]}))
    put(3, json.dumps({"elements": [{"type": "node", "id": 1}, {"type": "way", "id": 9, "geometry": [{"lat": 50.0, "lon": 8.0}]}, {"type": "way", "id": 10}]}))
    put(4, '{"provider": "osm", "ways": [{"id": 7, "poi')
    found = maps.read_maps(spark, f"file://{tmp_path}")
    assert sorted((r.way_id, r.ord) for r in found.where("broken is null").collect()) == [(7, 0), (8, 1), (9, 0)] and [r.key for r in found.where("broken is not null").collect()] == [_key(boxes[4])]
    extents = spark.createDataFrame([(t, b[0], b[1], *b) for t, b in boxes.items()], "trace_id long, lat0 double, lon0 double, min_lat double, min_lon double, max_lat double, max_lon double")
    assert sorted(r.key for r in maps.missing(extents, found).collect()) == sorted({_key(boxes[4]), _key(boxes[5])})
    rows = maps.overlay(extents, found)
    got = sorted((r.trace_id, r.way_id, r.k, r.name, round(r.x, 2), round(r.y, 2)) for r in rows.collect())
    assert got == [(1, 7, 0, "Ring", 0.0, 0.0), (1, 7, 1, "Ring", 74.49, 0.0), (2, 7, 0, "Ring", 0.0, 0.0), (2, 7, 1, "Ring", 74.49, 0.0), (3, 9, 0, None, 0.0, 0.0)]
    line = spark.createDataFrame([(1, i, i * 5.0, i * 5.0, 1.0, 270.0) for i in range(16)], "trace_id long, seq long, s double, x_m double, y_m double, heading_deg double")
    (best,) = road.match_way(line, rows.withColumn("ord", F.col("k"))).collect()
    mean = sum(min(math.hypot(i * 5.0, 1), math.hypot(i * 5.0 - 74.487, 1)) for i in range(16)) / 16
    assert (best.trace_id, best.way_id) == (1, 7) and best.mean_m == pytest.approx(mean, abs=0.01)
    assert maps.overlay(extents.limit(0), found).collect() == []
