"""Corridor bounds in the ego's frame and excursions over them."""

import math

from pyspark.sql import functions as F

from roadspan.operators import corridor


def _obs(spark, y, lane="Other", yaw=0.0, t=0):
    return spark.createDataFrame([(1, 1, 0, t, 10.0, float(y), 1.8, lane, 0.0, 0.0, float(yaw))], "trace_id long, obj_id int, obs_ord long, t_us long, x_rel double, y_rel double, width double, lane string, ex double, ey double, eyaw double")


def _lines(spark, *ys, t=0):
    return spark.createDataFrame([(1, i, t, [(float(x), float(y)) for x in range(-50, 51, 5)]) for i, y in enumerate(ys)], "trace_id long, line_id int, t_us long, points array<struct<x:double,y:double>>")


def test_innermost_bounds_and_sides(spark):
    r = corridor.excursion(corridor.bounds(_obs(spark, 5), _lines(spark, 4, 9, -3, -8))).first()
    assert (r.left_m, r.right_m, r.side) == (4.0, -3.0, "left") and math.isclose(r.excursion, 0.4)
    r = corridor.excursion(corridor.bounds(_obs(spark, -2), _lines(spark, 4, -3))).first()
    assert r.side is None and r.excursion == 0
    r = corridor.excursion(corridor.bounds(_obs(spark, 8, lane="EGO lane"), _lines(spark, 4))).first()
    assert r.side is None and r.excursion == 0 and r.right_m is None
    for y, out, side in ((3.6, 0, None), (4.0, 0, None), (4.64, 0, None), (4.66, 0.06, "left"), (-3.5, 0, None), (-4.0, 0.4, "right")):
        r = corridor.excursion(corridor.bounds(_obs(spark, y), _lines(spark, 4, -3))).first()
        assert r.side == side and math.isclose(r.excursion, out, abs_tol=1e-9)


def test_nearest_snapshot_and_rotation(spark):
    lines = _lines(spark, 4, t=0).union(_lines(spark, 6, t=1_000_000)).withColumn("line_id", F.lit(0))
    assert corridor.bounds(_obs(spark, 0, t=500_000), lines).first().left_m == 4.0
    assert corridor.bounds(_obs(spark, 0, t=500_001), lines).first().left_m == 6.0
    turned = corridor.bounds(_obs(spark, 0, yaw=math.pi), _lines(spark, 4)).first()
    assert turned.left_m is None and math.isclose(turned.right_m, -4.0)


def test_without_lines(spark):
    r = corridor.excursion(corridor.bounds(_obs(spark, 50), _lines(spark, 4).limit(0))).first()
    assert r.left_m is None and r.excursion == 0


def test_equals_loops_and_has_no_join(spark):
    """All snapshots of several lines and all their points, against loops; rows without a pose or trace, broken points; one meeting of rows and lines."""
    import random

    rnd = random.Random(5)
    own = [(t, o, i, rnd.choice([None, *range(0, 9000, 700)]), rnd.uniform(-30, 30), 0.0, 1.8, "x", rnd.choice([None, 1.0, 2.0, 3.0]), rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i, (t, o) in enumerate([(1, 1), (1, 2), (2, 1), (None, 1)] * 40)]
    obs = spark.createDataFrame(own, "trace_id long, obj_id int, obs_ord long, t_us long, x_rel double, y_rel double, width double, lane string, ex double, ey double, eyaw double")
    snaps = [(1, n, t, [(rnd.uniform(-80, 80), rnd.uniform(-9, 9)) for _ in range(rnd.choice([0, 1, 30]))]) for n in range(4) for t in rnd.sample(range(0, 9000, 350), 5)] + [(1, 9, 0, None), (3, 0, 0, [(0.0, 1.0)]), (None, 0, 0, [(0.0, 1.0)])]
    lines = spark.createDataFrame(snaps, "trace_id long, line_id int, t_us long, points array<struct<x:double,y:double>>")
    want = {}
    for t, _, i, at, x, _, _, _, ex, ey, yaw in own:
        ys = []
        for n in range(4):
            of = sorted((s for s in snaps if s[0] == t and s[1] == n and t is not None), key=lambda s: (abs(s[2] - (at or 0)), s[2]) if at is not None else s[2])
            turned = [(abs((px - ex) * math.cos(yaw) + (py - ey) * math.sin(yaw) - x), (py - ey) * math.cos(yaw) - (px - ex) * math.sin(yaw)) for px, py in (of[0][3] if of and ex is not None else [])]
            near = min(turned, key=lambda g: g[0], default=(99, 0))
            ys += [near[1]] if near[0] <= 40 else []
        want[i] = (min((y for y in ys if y > 0), default=None), max((y for y in ys if y <= 0), default=None))
    out = corridor.bounds(obs, lines)
    got = {r.obs_ord: (r.left_m, r.right_m) for r in out.collect()}
    short = lambda d: {k: tuple(v if v is None else round(v, 9) for v in p) for k, p in d.items()}
    assert short(got) == short(want) and any(a for a, _ in want.values())
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_traces_are_streamed_in_batches(spark):
    """Batches that hold several traces and traces that go over several batches give the same; no group of its own is set up for a trace."""
    at = "trace_id long, obj_id int, obs_ord long, t_us long, x_rel double, y_rel double, width double, lane string, ex double, ey double, eyaw double"
    obs = spark.createDataFrame([(t, 1, i, i * 1000, 0.0, 0.0, 1.8, "x", 0.0, 0.0, 0.0) for t in [None, *range(20)] for i in range(t % 9 if t else 3)], at)
    lines = spark.createDataFrame([(t, n, k * 5000, [(0.0, (t + 1.0 + k) * s)]) for t in range(20) if t != 7 for n, s in ((0, 1), (1, -1)) for k in (0, 1)], "trace_id long, line_id int, t_us long, points array<struct<x:double,y:double>>")
    y = lambda r: None if r.trace_id is None or r.trace_id == 7 else r.trace_id + 1.0 + (r.t_us > 2500)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (size, "5"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            out = corridor.bounds(obs, lines)
            rows = out.collect()
            assert len(rows) == obs.count() and all((r.left_m, r.right_m) == (y(r), None if y(r) is None else -y(r)) for r in rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_labels_of_runs_without_a_join(spark):
    """Rows that share a time with another run's end keep the label of their own run, once each."""
    from roadspan.operators import validate

    rows = [(1, 1, i, t, e, "left", 0.0) for i, (t, e) in enumerate([(0, 1.0), (5, 5.0), (5, 0.0), (5, 1.0), (9, 0.0)])]
    out = validate.run_labels(spark.createDataFrame(rows, "trace_id long, obj_id int, obs_ord long, t_us long, excursion double, side string, zrot double"))
    assert [r.label for r in sorted(out.collect(), key=lambda r: r.obs_ord)] == ["departure", "departure", None, "noise", None]
    assert out.columns == ["trace_id", "obj_id", "obs_ord", "t_us", "excursion", "side", "zrot", "label"] and "Join" not in out._jdf.queryExecution().executedPlan().toString()
