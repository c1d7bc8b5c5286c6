"""Nearest in time, against loops: repeated rows, ties, nulls, odd types, empty sides."""

import random

import pytest
from pyspark.sql import functions as F

from roadspan.operators.joins import nearest_within

LEFT, RIGHT = "k string, g int, t_us long, id int", "k string, g int, t_us long, ord int, v string"


def _plain(left, right, tolerance):
    out = []
    for k, g, t, i in left:
        own = [r for r in right if r[0] == k and r[1] == g and r[2] is not None and t is not None and abs(r[2] - t) <= tolerance and k is not None]
        if own:
            out.append((k, g, t, i, min(own, key=lambda r: (abs(r[2] - t), r[2], -r[3]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_loops(spark, seed):
    rnd = random.Random(seed)
    left = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 1), rnd.choice([None, *range(0, 400, 7)]), rnd.randint(0, 3)) for _ in range(300)]
    right = [(rnd.choice(["a", "a", "b", "c", None]), rnd.randint(0, 1), rnd.choice([None, *range(-40, 440, 9)]), n, rnd.choice(["x", None])) for n in range(60)]
    rnd.shuffle(right)
    got = nearest_within(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k", "g"], 11)
    assert got.columns == ["k", "g", "t_us", "id", "near"]
    assert sorted(((r.k, r.g, r.t_us, r.id, tuple(r.near)) for r in got.collect()), key=repr) == _plain(left, right, 11)


def test_repeated_rows_stay_and_one_exchange_does(spark):
    left = spark.createDataFrame([("a", 0, 5, 1)] * 3, LEFT)
    right = spark.createDataFrame([("a", 0, 4, 1, "early"), ("a", 0, 6, 2, "late"), ("a", 0, 4, 0, "less")], RIGHT)
    got = nearest_within(left, right, ["k", "g"])
    assert [r.near.v for r in got.collect()] == ["early"] * 3
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 1 and "Join" not in plan
    assert nearest_within(left.limit(0), right, ["k", "g"]).collect() == [] == nearest_within(left, right.where(F.lit(False)), ["k", "g"]).collect()


@pytest.mark.parametrize("seed", range(3))
def test_nearest_of_tracks_equals_the_general_join(spark, seed):
    """Equal times, nulls, single rows, several traces; rows move once, by their trace."""
    from roadspan.operators.joins import nearest_of_tracks

    rnd = random.Random(seed)
    rows = spark.createDataFrame([(rnd.choice([1, 1, 2, None]), rnd.choice([1, 2, 3, 7, None]), n, rnd.choice([None, *range(0, 400, 13)])) for n in range(150)] + [(5, 1, 0, 3), (6, 1, 0, 3), (6, 2, 0, 9)], "trace_id long, obj_id int, obs_ord long, t_us long")
    others = rows.select("trace_id", F.col("obj_id").alias("other"), F.col("obs_ord").alias("ord"), "t_us")
    want = nearest_within(rows.join(others.select("trace_id", "other").distinct(), "trace_id").where("obj_id < other"), others, ["trace_id", "other"], 20)
    out = nearest_of_tracks(rows, 20)
    plain = lambda df, c: sorted((r.trace_id, r.obj_id, r.obs_ord, r.t_us, r.other, r.near.t_us, r.near[c]) for r in df.collect())
    assert plain(out, "obs_ord") == plain(want, "ord") != []
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_limit_of_speed_is_compared_as_in_sql(spark):
    """Steps of which hypot and the root of squares lie on different sides of 45 m/s: flags follow the root, as the SQL does."""
    from roadspan.operators import validate

    odd = spark.range(200_000).select((18 * F.cos("id")).alias("x"), (18 * F.sin("id")).alias("y")).where("(hypot(x, y) / 0.4D > 45) != (sqrt(x * x + y * y) / 0.4D > 45)").limit(40).collect()
    assert odd
    rows = [r for i, p in enumerate(odd) for r in ((1, i, 0, 0, 0.0, 0.0, 0.0), (1, i, 1, 400_000, p.x, p.y, 0.0))]
    glob = spark.createDataFrame(rows, "trace_id long, obj_id int, obs_ord long, t_us long, gx double, gy double, heading double")
    got = {r.obj_id for r in validate.speed_flags(validate.track_steps(glob)).collect()}
    assert got == {i for i, p in enumerate(odd) if (p.x * p.x + p.y * p.y) ** 0.5 / 0.4 > 45}


def test_issues_at_a_limit_of_speed_are_those_of_sql(spark):
    """The whole issue list and its counts at 60 m/s, where hypot would take medium for high or the reverse."""
    from roadspan.operators import summaries, validate
    from roadspan.plans.queries import _excursions

    odd = spark.range(200_000).select((24 * F.cos("id")).alias("x"), (24 * F.sin("id")).alias("y")).where("(hypot(x, y) / 0.4D > 60) != (sqrt(x * x + y * y) / 0.4D > 60)").limit(40).collect()
    assert odd
    rows = [r for i, p in enumerate(odd, 1) for r in ((i, 1, 0, 0, 50.0, 0.0, 0.0, 4.0, 2.0, 0.0, 0.0, 0.0), (i, 1, 1, 400_000, 50.0, 0.0, 0.0, 4.0, 2.0, p.x, p.y, 0.0))]
    glob = spark.createDataFrame(rows, "trace_id long, obj_id int, obs_ord long, t_us long, x_rel double, y_rel double, zrot double, length double, width double, gx double, gy double, heading double")
    ego = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.0, 0.0)], "trace_id long, seq long, t_us long, x_m double, y_m double, speed double, heading_deg double")
    counts = summaries.count_by(validate.issues(glob, ego, _excursions(glob)), "trace_id", "category", "severity").collect()
    assert {(r.trace_id, r.severity, r.n) for r in counts} == {(i, "high" if (p.x * p.x + p.y * p.y) ** 0.5 / 0.4 > 60 else "medium", 1) for i, p in enumerate(odd, 1)}


def test_turns_at_a_limit_of_yaw_rate_are_those_of_sql(spark):
    """Turns of which pmod and SQL's remainders lie on different sides of 15 degrees a second."""
    from roadspan.operators import validate

    wrapped = "abs(((h + 6 - h + 180) % 360 + 360) % 360 - 180) / 0.4D > 15"
    odd = spark.range(200_000).select((F.col("id") * 0.0018).alias("h")).where(f"(abs(pmod(h + 6 - h + 180, 360) - 180) / 0.4D > 15) != ({wrapped})").limit(40).collect()
    assert odd
    rows = [r for i, p in enumerate(odd) for r in ((1, i, 0, 0, 0.0, 0.0, p.h), (1, i, 1, 400_000, 0.0, 0.0, p.h + 6))]
    glob = spark.createDataFrame(rows, "trace_id long, obj_id int, obs_ord long, t_us long, gx double, gy double, heading double")
    got = {r.obj_id for r in validate.yaw_rate_flags(validate.track_steps(glob)).collect()}
    assert got == {i for i, p in enumerate(odd) if abs((((p.h + 6) - p.h + 180) % 360 + 360) % 360 - 180) / 0.4 > 15}


def test_pairs_of_tracks_are_streamed_and_cut_anywhere(spark, monkeypatch):
    """Batches that end inside of traces, nested columns, a limit of distance: equal pairs, which no window sorts; places that are missing stay."""
    from roadspan.operators import joins
    from roadspan.ship import ship

    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 2]), rnd.choice([1, 2, 3, 7]), n, rnd.choice(range(0, 400, 13)), rnd.uniform(0, 9), rnd.choice([None, 1.0]), 2.0, [(n, "a")] if n % 3 else None) for n in range(150)]
    frame = ship(spark).createDataFrame(rows, "trace_id long, obj_id int, obs_ord long, t_us long, x double, y double, reach double, moved array<struct<n:int,s:string>>")
    name, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    try:
        for n in ("7", "10000"):
            spark.conf.set(name, n)
            out = joins.nearest_of_tracks(frame, 20)
            found.append(sorted(map(tuple, out.collect()), key=repr))
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1] != [] and out.columns == [*frame.columns, "other", "near"]
    close = sorted(map(tuple, joins.nearest_of_tracks(frame, 20, ("x", "y", "reach")).collect()), key=repr)
    assert close == [r for r in found[0] if r[5] is None or r[-1]["y"] is None or abs(r[4] - r[-1]["x"]) <= 2] != found[0]
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["reports", "worst_active_issue"])
def test_observations_are_made_once(spark, monkeypatch, name):
    """All passes read the written ones, instead of sorting line items anew."""
    from roadspan.plans import projection, queries

    made, obs = [], projection.obs
    monkeypatch.setattr(projection, "obs", lambda *a: made.append(a) or obs(*a))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1
