"""Links of tracks against the sequential choice, and bounds of predictions at both ends."""

import random

from pyspark.sql import functions as F

from roadspan.operators import ends, predict


def _greedy(rows):
    taken, out = set(), set()
    for t, a in sorted({(t, a) for t, a, *_ in rows}):
        free = sorted((e, b) for u, c, b, e in rows if (u, c) == (t, a) and (t, b) not in taken)
        if free:
            taken.add((t, free[0][1]))
            out.add((t, a, free[0][1]))
    return out


def test_rounds_equal_the_sequential_choice(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = sorted({(t, a, b): (t, a, b, float(rng.randrange(6))) for t in range(4) for a in range(9) for b in range(9) if rng.random() < 0.4}.values())
        got = {tuple(r) for r in ends.one_to_one(spark.createDataFrame(rows, "trace_id long, a int, b int, error double")).collect()}
        assert got == _greedy(rows)
    chain = [(0, a, b, float(b)) for a in range(7) for b in range(7) if b <= a]  # everyone wants what the one before has
    assert {tuple(r) for r in ends.one_to_one(spark.createDataFrame(chain, "trace_id long, a int, b int, error double")).collect()} == _greedy(chain)
    assert ends.one_to_one(spark.createDataFrame([], "trace_id long, a int, b int, error double")).count() == 0


def _tracks(spark, rows):
    kind = "trace_id long, obj_id int, obs_ord long, t_us long, frame int, gx double, gy double, heading double, x_rel double, y_rel double, width double, lane string"
    return spark.createDataFrame([(1, o, i, int(t * 1e6), f, float(x), 0.0, 0.0, float(r), -3.8, 2.8, "1st Right") for i, (o, t, f, x, r) in enumerate(rows)], kind)


def test_a_continued_track_stops_where_the_next_begins(spark):
    glob = _tracks(spark, [(3, 7, 70, 210, 5), (3, 8, 80, 240, 5), (4, 9.3, 93, 279, 5), (4, 10.3, 103, 309, 5)])
    links = ends.one_to_one(predict.continuation_candidates(predict.track_ends(glob)))
    assert [tuple(r) for r in links.collect()] == [(1, 3, 4)]
    clips = spark.createDataFrame([(1, 0, 60_000_000, 600)], "trace_id long, t0_us long, t1_us long, total_frames int")
    found = {(r.obj_id, r.direction): (r.speed, r.bound_us) for r in ends.bounded_ends(glob, links, clips).collect()}
    assert found == {(3, -1): (30.0, 0), (3, 1): (30.0, 9_300_000), (4, 1): (30.0, 60_000_000)}
    steps = ends.predict_ends(ends.bounded_ends(glob, links, clips)).groupBy("obj_id", "direction").agg(F.count("*").alias("n"), F.min("t_us").alias("a"), F.max("t_us").alias("b"), F.min("gx").alias("x")).collect()
    got = {(r.obj_id, r.direction): (r.n, r.a, r.b, round(r.x, 6)) for r in steps}
    assert got == {(3, -1): (20, 3_000_000, 6_800_000, 90.0), (3, 1): (6, 8_200_000, 9_200_000, 246.0), (4, 1): (20, 10_500_000, 14_300_000, 315.0)}


def test_eligibility_distance_and_single_observations(spark):
    glob = _tracks(spark, [(1, 1, 3, 0, 5), (1, 2, 50, 10, 5), (2, 1, 4, 0, -5), (2, 2, 98, 10, 5), (5, 1, 50, 0, 5)])
    clips = spark.createDataFrame([(1, 0, 60_000_000, 100)], "trace_id long, t0_us long, t1_us long, total_frames int")
    none = spark.createDataFrame([], "trace_id long, a int, b int")
    found = ends.bounded_ends(glob, none, clips)
    assert {(r.obj_id, r.direction) for r in found.collect()} == {(1, 1), (2, -1), (5, -1), (5, 1)}
    n = {(r.obj_id, r.direction): r["count"] for r in ends.predict_ends(found, 4.0, 7.0).groupBy("obj_id", "direction").count().collect()}
    # 2 m a step: 3 steps; 5 m a step alone: 1; backward until the recording's begin, which isn't reached
    assert n == {(1, 1): 3, (2, -1): 4, (5, -1): 1, (5, 1): 1}
    assert ends.bounded_ends(glob, none, clips.withColumn("total_frames", F.lit(None).cast("int")), backward=False).count() == 3


def test_linked_ends_are_worked_out_once(spark):
    glob = _tracks(spark, [(3, 7, 70, 210, 5), (3, 8, 80, 240, 5), (4, 9.3, 93, 279, 5), (4, 10.3, 103, 309, 5)])
    clips = spark.createDataFrame([(1, 0, 60_000_000, 600)], "trace_id long, t0_us long, t1_us long, total_frames int")
    out = ends.linked_ends(glob, clips)
    assert {(r.obj_id, r.direction): (r.speed, r.bound_us) for r in out.collect()} == {(3, -1): (30.0, 0), (3, 1): (30.0, 9_300_000), (4, 1): (30.0, 60_000_000)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()  # observations aren't read again
