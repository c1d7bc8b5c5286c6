"""Trace operators on rows made here; expectations follow from their definitions."""

import math

import pytest
from pyspark.sql import functions as F

from roadspan.functions import exprs as X
from roadspan.operators import events, joins, summaries, validate, variants
from roadspan.sources import traces
from roadspan.streaming import sessions


def _ego(spark, speeds, step_us=100_000, heading=None):
    rows = [(1, i, i * step_us, float(v), i * 2.0, 0.0, float(heading[i]) if heading else 270.0) for i, v in enumerate(speeds)]
    return spark.createDataFrame(rows, "trace_id long, seq long, t_us long, speed double, x_m double, y_m double, heading_deg double")


def _obs(spark, rows):
    return spark.createDataFrame([(1, o, i, int(t * 1e6), float(x), float(y), 4.0, 1.8, 0.0) for i, (o, t, x, y) in enumerate(rows)], "trace_id long, obj_id int, obs_ord long, t_us long, x_rel double, y_rel double, length double, width double, zrot double")


def test_two_tailgates(spark):
    ego = _ego(spark, [20] * 600)
    obs = _obs(spark, [(1, t, x, 0) for t, x in zip((5, 5.5, 6, 20, 30, 45, 45.5, 46), (10, 10, 10, 200, 200, 12, 12, 12), strict=True)])
    got = sorted((r.t_start, r.t_end, r.near_miss) for r in events.short_headways(obs, ego).collect())
    assert got == [(5_000_000, 6_000_000, False), (45_000_000, 46_000_000, False)]
    sparse = _obs(spark, [(1, t, 10, 0) for t in (5.0, 6.2, 7.4)])
    assert events.short_headways(sparse, ego).count() == 1
    assert events.short_headways(sparse.limit(1), ego).count() == 0


def test_interpolation_ties_and_ends(spark):
    ego = spark.createDataFrame([(1, 0, 0, 1.0, 0.0, 0.0, 350.0), (1, 1, 100, 2.0, 10.0, 0.0, 10.0), (1, 2, 100, 4.0, 20.0, 0.0, 10.0), (1, 3, 200, 8.0, 40.0, 0.0, 10.0)], "trace_id long, seq long, t_us long, speed double, x_m double, y_m double, heading_deg double")
    obs = spark.createDataFrame([(1, t) for t in (-5, 0, 50, 100, 150, 200, 900)] + [(2, 1)], "trace_id long, t_us long")
    got = {(r.trace_id, r.t_us): (r.ex, r.es) for r in joins.interp_asof(obs, ego).collect()}
    assert got == {(1, -5): (0.0, 1.0), (1, 0): (0.0, 1.0), (1, 50): (5.0, 1.5), (1, 100): (20.0, 4.0), (1, 150): (30.0, 6.0), (1, 200): (40.0, 8.0), (1, 900): (40.0, 8.0), (2, 1): (None, None)}
    yaw = {r.t_us: r.eyaw for r in joins.interp_asof(obs.where("t_us = 50"), ego).collect()}[50]
    assert abs(math.sin(yaw) - 1) < 1e-9  # over north, not the long way round


def test_nearest_prefers_earlier_then_last(spark):
    left = spark.createDataFrame([(1, 0, 1_000_000), (1, 1, 9_000_000)], "k long, i long, t_us long")
    right = spark.createDataFrame([(1, 0, 800_000, "a"), (1, 1, 1_200_000, "b"), (1, 2, 800_000, "c"), (1, 3, 8_600_000, "d")], "k long, ord long, t_us long, v string")
    assert [(r.i, r.near.v) for r in joins.nearest_within(left, right, ["k"]).collect()] == [(0, "c")]


def test_braking_standstill_turn(spark):
    assert events.braking(_ego(spark, [33] * 10 + [33 - 0.8 * i for i in range(1, 11)] + [25] * 5)).collect()[0].severity == "hard"
    assert events.standstills(_ego(spark, [5] * 5 + [0] * 31 + [5] * 5)).count() == 1
    assert events.standstills(_ego(spark, [5] * 5 + [0] * 30 + [5] * 5)).count() == 0
    turn = events.sharp_turns(_ego(spark, [5] * 80, heading=[0] * 20 + [i * 4.5 for i in range(20)] + [90] * 40)).collect()
    assert len(turn) == 1 and abs(turn[0].turn_deg) >= 85


def test_uneven_acceleration(spark):
    glob = spark.createDataFrame([(1, 1, 0, 0, 0.0), (1, 1, 1, 400_000, 8.0), (1, 1, 2, 600_000, 12.4)], "trace_id long, obj_id int, obs_ord long, t_us long, gx double").withColumns({"gy": F.lit(0.0), "heading": F.lit(0.0)})
    assert abs(validate.centred_acceleration(validate.track_steps(glob)).collect()[0].accel - 6.6667) < 1e-3


def test_axis_fold_and_wrap(spark):
    r = spark.range(1).select(*(F.round(X.axis_angle(F.lit(a)), 6) for a in (0.0, math.pi, math.radians(-175), math.pi / 2)), X.wrap_degrees(F.lit(-190.0)), X.compass_label(F.lit(44.0))).first()
    assert list(r) == [0.0, 0.0, 5.0, 90.0, 170.0, "NE"]


@pytest.mark.parametrize(("x", "y", "yaw", "hit"), [(4.45, 0, 0, True), (4.46, 0, 0, False), (0, 1.85, 0, True), (0, 1.86, 0, False), (3.5, 2.2, math.pi / 4, True), (4.4, 2.6, math.pi / 4, False)])
def test_box_overlap(spark, x, y, yaw, hit):
    v = F.lit
    assert spark.range(1).select(X.boxes_overlap(v(0.0), v(0.0), v(0.0), v(4.9), v(1.9), v(float(x)), v(float(y)), v(float(yaw)), v(4.0), v(1.8))).first()[0] is hit


def test_offroad_runs(spark):
    rows = _obs(spark, [(1, i / 10, 5, 0) for i in range(8)]).withColumn("excursion", F.element_at(F.array(*map(F.lit, (0.0, 1.0, 1.2, 0.0, 0.0, 1.0, 2.5, 3.0))), F.col("obs_ord").cast("int") + 1)).withColumn("side", F.lit("left"))
    got = sorted((r.t_start, r.t_end, r.peak_m, r.to_end, r.label) for r in validate.offroad_runs(rows).collect())
    assert got == [(100_000, 200_000, 1.2, False, "noise"), (500_000, 700_000, 3.0, True, "departure")]


@pytest.mark.parametrize(("turn", "label"), [(9.0, "noise"), (11.0, "departure")])
def test_offroad_turn(spark, turn, label):
    a = math.radians(turn)
    xs = [(i * 1.0, 0.0) for i in range(15)] + [(14 + i * math.cos(a), i * math.sin(a)) for i in range(1, 6)] + [(30.0, 0.0)]
    rows = _obs(spark, [(1, i / 10, x, y) for i, (x, y) in enumerate(xs)]).withColumns({"gx": F.col("x_rel"), "gy": F.col("y_rel"), "side": F.lit("left"), "excursion": F.when(F.col("obs_ord").between(14, 19), 2.5).otherwise(0.0)})
    r = validate.offroad_runs(rows).first()
    assert (r.t_start, r.to_end, r.label) == (1_400_000, False, label) and math.isclose(r.turn_deg, turn)
    still = validate.offroad_runs(rows.withColumns({"gx": F.lit(0.0), "zrot": F.lit(math.radians(-170))}).withColumn("gy", F.lit(0.0))).first()
    assert math.isclose(still.turn_deg, 10)


def test_issues_of_pairs_and_off_road(spark):
    ego = _ego(spark, [20] * 20)
    obs = _obs(spark, [(1, 0.1, 30, 0), (2, 0.1, 32, 0), (3, 0.1, 90, 4), (4, 0.1, 90, -9)])
    glob = obs.withColumns({"gx": F.col("x_rel"), "gy": F.col("y_rel"), "heading": F.lit(0.0)})
    out = glob.withColumns({"excursion": F.abs("y_rel") - 3, "side": F.lit("left")})
    got = sorted((r.category, r.severity, r.obj_id, r.t_start, r.t_end) for r in validate.issues(glob, ego, out).where("category != 'kinematic'").collect())
    assert got == [("collision", "high", 1, 100_000, 100_000), ("off_road", "medium", 3, 100_000, 100_000), ("road_departure", "low", 4, 100_000, 100_000)]


def test_rate_limit_against_fold(spark):
    values = [3.0, 0.0, -2.0, 5.0, 5.0, 0.1]
    df = spark.createDataFrame([(1, i * 1_000_000, v) for i, v in enumerate(values)], "k long, t long, v double")
    got = [r.v for r in variants.rate_limited(df, ["k"], "t", "v").orderBy("t").collect()]

    def limit(vs):
        out = [vs[0]]
        for v in vs[1:]:
            out.append(math.copysign(min(abs(v), abs(out[-1]) + 0.5), v) if v else 0.0)
        return out

    assert got == pytest.approx(limit(limit(values)[::-1])[::-1])


def test_trim_keeps_the_first(spark):
    obs = _obs(spark, [(1, i, x, 0) for i, x in enumerate((1, 50, 1, 1))] + [(2, i, 1, 0) for i in range(3)])
    got = sorted((r.obj_id, r.obs_ord) for r in variants.trim_trailing(obs, F.abs("x_rel") < 5).collect())
    assert got == [(1, 0), (1, 1), (2, 4)]


def test_mode_prefers_the_first(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, ""), (1, 5, None)], "k long, t long, v string")
    assert [(r.v, r.n) for r in summaries.mode_first_wins(df, ["k"], "v", ["t"]).collect()] == [("b", 2)]


def test_ego_file_round_trip(spark, tmp_path):
    rows = [("x", 0, 10, 48.1234567, 9.7654321, 271.35, 1.005, -2.5, 0.0), ("x", 1, 5, 48.1234568, 9.7654322, 0.01, 0.0, 0.005, 0.01)]
    ego = spark.createDataFrame(rows, "trace_id string, seq long, t_us long, lat double, lon double, heading_deg double, v_north double, v_east double, v_vert double")
    (tmp_path / "x").mkdir()
    cols = traces.ego_columns(ego).drop("trace_id", "seq").collect()
    text = ",".join([*traces.CSV_COLUMNS[::-1], "more"]) + "\n" + "".join(",".join([*map(str, list(r)[::-1]), "z"]) + "\n" for r in cols)
    (tmp_path / "x" / "adma.csv").write_text(text)
    got = traces.read_ego(spark, f"{tmp_path}/x/adma.csv").orderBy("seq").collect()
    assert [(r.trace_id, r.t_us, round(r.lat, 7), round(r.heading_deg, 2), round(r.v_east, 3)) for r in got] == [("x", 5, 48.1234568, 0.01, 0.005), ("x", 10, 48.1234567, 271.35, -2.5)]
    (tmp_path / "x" / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="ADTF_CHUNK_TIME"):
        traces.read_ego(spark, f"{tmp_path}/x/bad.csv")
    traces.write_ego(ego, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2


def test_annotation_file(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "annotation.xml").write_text(
        """<root><vehicles><rect_vehicle><id>7</id><obj_type>Car</obj_type><timestamps>
<rect_vehicle_timestamp frame="2" chunktime="200"><obj_lane>EGO lane</obj_lane><bounding_box><vehicle_bb><coordinates><xp>5</xp><yp>-1</yp><zrot>180</zrot></coordinates></vehicle_bb></bounding_box></rect_vehicle_timestamp>
<rect_vehicle_timestamp frame="1" chunktime="100"><bounding_box><vehicle_bb><coordinates><xp>4</xp></coordinates></vehicle_bb></bounding_box></rect_vehicle_timestamp>
<rect_vehicle_timestamp frame="3" chunktime="300"/></timestamps></rect_vehicle></vehicles>
<border_polygons><line_bp><id>1</id><obj_type>Road Edge</obj_type><line_attributes><line_static_timestamp frame="1" chunktime="100"><line_static><line_static_geom><coordinates><xp_1>1</xp_1><yp_1>2</yp_1><xp_10>9</xp_10><yp_10>8</yp_10><xp_2>3</xp_2><yp_2>4</yp_2><xp_3>0</xp_3></coordinates></line_static_geom></line_static></line_static_timestamp></line_attributes></line_bp></border_polygons></root>"""
    )
    path = f"{tmp_path}/t1/annotation.xml"
    got = traces.read_vehicles(spark, path).orderBy("obs_ord").collect()
    assert [(r.trace_id, r.obj_id, r.t_us, r.lane, r.x_rel, round(r.zrot, 6), r.length) for r in got] == [("t1", 7, 100, "Unknown", 4.0, 0.0, 0.0), ("t1", 7, 200, "EGO lane", 5.0, 3.141593, 0.0)]
    line = traces.read_borders(spark, path).collect()[0]
    assert [(p.x, p.y) for p in line.points] == [(1.0, 2.0), (3.0, 4.0), (9.0, 8.0)] and line.obj_type == "Road Edge"


def test_pairing(spark):
    ego = spark.createDataFrame([("Trace_A", "1"), ("Trace_A", "0"), ("trace_b", "2"), ("other", "3"), *((f"q{i}", f"9{i}") for i in ("", 0, 1, 2, 3))], "name string, path string")
    notes = [("Trace_A__ref-QC_IND", "x"), ("Trace_A", "w"), ("trace_a__refQC_IND", "k"), ("TRACE_B_cut", "y"), ("trace_b", "z"), ("trac", "u"), ("q_long", "p"), ("q2_long", "r")]
    found = traces.claims(ego, spark.createDataFrame(notes, "stem string, path string")).collect()
    assert {r.annotation_path: (r.name, r.ego_path, r.how, r.won) for r in found} == {
        "w": ("Trace_A", "0", "exact", True), "x": ("Trace_A", "0", "exact", False), "k": ("Trace_A", "0", "prefix", False), "z": ("trace_b", "2", "exact", True), "y": ("trace_b", "2", "prefix", False),
        "u": (None, None, None, None), "p": ("q", "9", "prefix", True), "r": ("q2", "92", "prefix", True),
    }
    more = ego.union(spark.createDataFrame([("q4", "94")], "name string, path string"))
    assert {r.annotation_path: r.name for r in traces.claims(more, spark.createDataFrame(notes, "stem string, path string")).collect()}["p"] is None


def test_names_of_traces(spark):
    rows = [("/c/run1/ADMA/adma.csv", "run1"), ("/c/data/raw/adma.csv", "raw"), ("/c/x/y/gps/adma.csv", "y")]
    df = spark.createDataFrame(rows, "path string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", traces.trace_name(F.col("path"), "/c")).collect())


def test_corpus_with_mixed_headers_and_annotations_in_one_folder(spark, tmp_path):
    values = dict(zip(traces.CSV_COLUMNS, range(1, 8), strict=True))
    for name, order in (("t1", traces.CSV_COLUMNS), ("t2", ["extra", *traces.CSV_COLUMNS[::-1]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "adma.csv").write_text(",".join(order) + "\n" + ",".join(str(values.get(c, "z")) for c in order) + "\n")
    got = traces.read_ego(spark, f"{tmp_path}/*/adma.csv").collect()
    assert sorted((r.trace_id, r.t_us, round(r.v_vert, 3)) for r in got) == [("t1", 1, 0.035), ("t2", 1, 0.035)]
    (tmp_path / "t3").mkdir()
    (tmp_path / "t3" / "adma.csv").write_text(",".join(traces.CSV_COLUMNS[:-1]) + "\n1,2,3,4,5,6\n")
    with pytest.raises(ValueError, match="INS_Vel_Frame_Z"):
        traces.read_ego(spark, f"{tmp_path}/*/adma.csv")
    box = "<bounding_box><{0}><coordinates><xp>5</xp><zrot>90</zrot></coordinates></{0}></bounding_box>"
    (tmp_path / "Annotations").mkdir()
    for name in ("t1", "t2"):
        (tmp_path / "Annotations" / f"{name}__ref-QC_IND.xml").write_text(
            f"<root><vehicles><rect_vehicle><id>7</id><timestamps><rect_vehicle_timestamp chunktime='1'>{box.format('vehicle_bb')}</rect_vehicle_timestamp></timestamps></rect_vehicle></vehicles>"
            f"<static_objects><rect_static><id>3</id><obj_type>Sign</obj_type><timestamps><rect_static_timestamp frame='1' chunktime='9'>{box.format('rect_static_geom')}</rect_static_timestamp><rect_static_timestamp chunktime='4'/></timestamps></rect_static></static_objects></root>"
        )
    path = f"{tmp_path}/Annotations/*.xml"
    assert sorted((r.trace_id, r.obj_id) for r in traces.read_vehicles(spark, path).collect()) == [("t1", 7), ("t2", 7)]
    assert sorted((r.trace_id, r.obj_id, r.obj_type, r.t_us, round(r.zrot, 4)) for r in traces.read_static(spark, path).collect()) == [("t1", 3, "Sign", 9, 1.5708), ("t2", 3, "Sign", 9, 1.5708)]
    files = spark.read.format("binaryFile").load(path).select("path")
    pairs = files.select(F.concat(F.lit("run-"), traces.stem(F.col("path"))).alias("name"), F.col("path").alias("annotation_path"))
    assert sorted({r.trace_id for r in traces.read_vehicles(spark, path, pairs).collect()}) == ["run-t1__ref-QC_IND", "run-t2__ref-QC_IND"]


def test_streaming_sessions_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(u, t) for u in (1, 2) for t in (0, 600, 5000, 6000, 90_000)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = sessions.sessions(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", ["user_id"])
    out = sessions.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    want = {(r.user_id, r.start, r.n) for r in sessions.sessions(rows, "ts", ["user_id"]).collect()}
    got = {(r.user_id, r.start, r.n) for r in out.collect()}
    assert got <= want and len(want - got) <= 2  # the last session of each user is still open


def test_entry_imports_and_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
