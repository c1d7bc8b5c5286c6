"""Prediction: plans at track ends, step counts, and continuation links."""

import math

from pyspark.sql import functions as F

from roadspan.operators import predict, reports
from roadspan.ship import ship

SCHEMA = "trace_id long, obj_id int, obs_ord long, t_us long, gx double, gy double, heading double, x_rel double, y_rel double, width double, lane string"


def _glob(spark, rows):
    return spark.createDataFrame([(1, o, i, int(t * 1e6), float(x), 0.0, 0.0, float(rel), -3.8, w, lane) for i, (o, t, x, rel, w, lane) in enumerate(rows)], SCHEMA)


TRUCKS = [(3, 7, 210, 10, 2.8, "1st Right"), (3, 8, 240, 10, 2.8, "1st Right"), (4, 9.3, 279, 10, 2.8, "1st Right"), (4, 10.3, 309, 10, 2.8, "1st Right")]


def _links(spark, rows):
    return {(r.a, r.b) for r in predict.continuations(predict.track_ends(_glob(ship(spark), rows))).collect()}


def test_continuation_and_vetoes(spark):
    assert _links(spark, TRUCKS) == {(3, 4)}
    change = lambda **k: [r if r[0] == 3 else tuple(k.get(n, v) for n, v in zip(("o", "t", "x", "rel", "w", "lane"), r, strict=True)) for r in TRUCKS]
    assert _links(spark, change(w=3.5)) == set()
    assert _links(spark, change(lane="EGO lane")) == set()
    assert _links(spark, [r if r[0] == 3 else (r[0], r[1], r[2] + 200, *r[3:]) for r in TRUCKS]) == set()
    assert _links(spark, [r if r[0] == 3 else (r[0], r[1] + 3, r[2] + 90, *r[3:]) for r in TRUCKS]) == set()


def test_continuation_is_one_to_one(spark):
    rival = [(5, 7, 210, 10, 2.8, "1st Right"), (5, 8, 241, 10, 2.8, "1st Right")]
    assert _links(spark, TRUCKS + rival) == {(3, 4)}


def test_step_counts_and_positions(spark):
    rows = [(1, 0, 0, 5, 1.8, "a"), (1, 1, 20, 5, 1.8, "a"), (2, 0, 0, -5, 1.8, "a"), (2, 1, 10, -5, 1.8, "a"), (3, 0, 7, 5, 1.8, "a")]
    got = predict.extrapolate(_glob(spark, rows), 4.0)
    assert {r.obj_id: r.n for r in got.groupBy("obj_id").agg(F.count("*").alias("n")).collect()} == {1: 20, 2: 60, 3: 20}
    end = {r.obj_id: (r.gx, r.t_us) for r in got.where("step = 20").collect()}
    assert math.isclose(end[1][0], 100) and end[1][1] == 5_000_000 and math.isclose(end[3][0], 107)


def test_steering_turns_toward_the_path(spark):
    ego = spark.createDataFrame([(1, i, i * 100_000, 10.0, float(i), 0.0, 270.0) for i in range(200)], "trace_id long, seq long, t_us long, speed double, x_m double, y_m double, heading_deg double")
    glob = _glob(ship(spark), [(1, 0, 0, 5, 1.8, "a"), (1, 1, 10, 5, 1.8, "a")]).withColumn("gy", F.col("obs_ord") * 10.0)
    ys = [r.gy for r in predict.steered(glob, ego).orderBy("step").collect()]
    assert len(ys) == 20 and ys[-1] - ys[-2] < 0.05 < ys[1] - ys[0]


def test_report_and_scene(spark):
    issues = spark.createDataFrame([(1, "kinematic", "medium", 2, 1_500_000, 2_000_000), (1, "collision", "high", None, 500_000, 500_000)], "trace_id long, category string, severity string, obj_id int, t_start long, t_end long")
    tags = spark.createDataFrame([(1, "cut_in", 2), (2, "cut_in", 1)], "trace_id long, phenomenon string, n long")
    got = {r.trace_id: r.report for r in reports.text_report(issues, tags).collect()}
    assert got[1].splitlines()[:3] == ["Trace 1", "Issues: 2 (high 1)", "Events: cut_in=2"] and "0.500  high" in got[1].splitlines()[3] and got[2].endswith("cut_in=1\n")


def _boxed(spark, rows):
    cols = SCHEMA + ", length double"
    return spark.createDataFrame([(1, o, i, int(t * 1e6), float(x), 0.0, 0.0, 5.0, 0.0, 2.0, "a", float(ln)) for i, (o, t, x, ln) in enumerate(rows)], cols)


def _far_ego(spark):
    return spark.createDataFrame([(1, i, i * 100_000, 10.0, float(i), 500.0, 270.0) for i in range(300)], "trace_id long, seq long, t_us long, speed double, x_m double, y_m double, heading_deg double")


def test_governor_stops_before_an_obstacle(spark):
    parked = [(2, 0.2 * i, 200, 5) for i in range(120)]
    moving = [(1, 0, 100, 5), (1, 1, 130, 5)]
    got = [r for r in predict.governed(_boxed(ship(spark), moving + parked), _far_ego(spark), 6.0).where("obj_id = 1").orderBy("step").collect()]
    assert got and 180 < max(r.gx for r in got) < 200
    free = predict.governed(_boxed(spark, moving), _far_ego(spark), 6.0).where("obj_id = 1")
    assert free.agg(F.max("gx")).first()[0] > 220


def test_governor_leaves_a_tailgater_alone(spark):
    rows = [(1, 0, 22, 20), (1, 1, 42, 20), (2, 0, 0, 20), (2, 1, 20, 20)]  # the leader steps first
    got = predict.governed(_boxed(ship(spark), rows), _far_ego(spark), 4.0)
    assert {r.obj_id: (r.n, r.v) for r in got.groupBy("obj_id").agg(F.count("*").alias("n"), F.min("speed").alias("v")).collect()} == {1: (20, 20.0), 2: (20, 20.0)}


def test_governed_traces_are_streamed_and_cut_anywhere(spark):
    """Several traces, batches that end inside of them, boxes long before the ends: equal steps, no group of its own for each trace."""
    moving, parked = [(1, 0, 100, 5), (1, 1, 130, 5)], [(2, 0.2 * i, 200, 5) for i in range(40)]
    one, ego = _boxed(ship(spark), moving + parked), _far_ego(spark)
    glob = one.unionByName(one.withColumn("trace_id", F.lit(2).cast("long"))).unionByName(one.where("obj_id = 1").withColumn("trace_id", F.lit(3).cast("long")))
    poses = ego.crossJoin(spark.range(1, 5).withColumnRenamed("id", "k")).withColumn("trace_id", F.col("k")).drop("k")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(name), []
    try:
        for n in ("7", "10000"):
            spark.conf.set(name, n)
            out = predict.governed(glob, poses, 6.0)
            found.append(sorted(map(tuple, out.collect())))
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 2, 3}
    assert [r[1:] for r in found[0] if r[0] == 1] == [r[1:] for r in found[0] if r[0] == 2] == sorted(tuple(r)[1:] for r in predict.governed(one, ego, 6.0).collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan


def test_steered_paths_are_streamed_and_cut_anywhere(spark):
    """Several traces, one without poses, batches that end inside of them: equal steps; a trace's path isn't repeated for each of its tracks."""
    ego = spark.createDataFrame([(t, i, i * 100_000, 10.0, float(i), math.sin(i / 9) * 5, 270.0) for t in (1, 3) for i in range(200)], "trace_id long, seq long, t_us long, speed double, x_m double, y_m double, heading_deg double")
    rows = [(o, k, 7.0 * o + 10 * k, 5 - o, 1.8, "a") for o in range(1, 10) for k in (0, 1)]
    one = _glob(ship(spark), rows)
    glob = one.unionByName(one.withColumn("trace_id", F.lit(2).cast("long"))).unionByName(one.withColumn("trace_id", F.lit(3).cast("long")))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(name), []
    try:
        for n in ("4", "10000"):
            spark.conf.set(name, n)
            out = predict.steered(glob, ego)
            found.append(sorted(map(tuple, out.collect())))
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 3}
    assert [r[1:] for r in found[0] if r[0] == 1] == [r[1:] for r in found[0] if r[0] == 3]
    path, x, y, yaw = [(float(i), math.sin(i / 9) * 5) for i in range(200)], 17.0, 0.0, 0.0
    for _, obj, step, t_us, gx, gy in (r for r in found[0] if r[:2] == (1, 1)):
        i = min(range(200), key=lambda k: (path[k][0] - x) ** 2 + (path[k][1] - y) ** 2)  # noqa: B023
        (ax, ay), (bx, by) = path[max(0, i - 1)], path[min(199, i + 1)]
        tangent = math.atan2(by - ay, bx - ax)
        yaw += 0.35 * math.atan2(math.sin(tangent - yaw), math.cos(tangent - yaw))
        x, y = x + 10 * 0.2 * math.cos(yaw), y + 10 * 0.2 * math.sin(yaw)
        assert t_us == 1_000_000 + step * 200_000 and math.isclose(gx, x, abs_tol=1e-9) and math.isclose(gy, y, abs_tol=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
