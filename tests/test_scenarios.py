"""Scenes on a grid against a plain version; variants as whole traces and their issue deltas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadspan.operators import alternatives, sampling, validate


def _at(rows, t, expiry):
    """One track's values at an instant by a search from the definition; rows are (t, x, angle) in order."""
    if t < rows[0][0] - expiry or t > rows[-1][0] + expiry:
        return None
    if t <= rows[0][0]:
        return rows[0][1:]
    if t >= rows[-1][0]:
        return rows[-1][1:]
    i = max(k for k, r in enumerate(rows) if r[0] <= t)
    (t0, x0, a0), (t1, x1, a1) = rows[i], rows[i + 1]
    f = (t - t0) / (t1 - t0)
    return x0 + (x1 - x0) * f, a0 + ((a1 - a0 + 180) % 360 - 180) * f


def test_grid_against_a_search(spark):
    rng = random.Random(7)
    tracks = {k: sorted((rng.choice([0, 50, 100, 130, 700, 701, 999, 2000, 2400]) + rng.randrange(3) * 100, float(rng.randrange(50)), float(rng.randrange(360))) for _ in range(rng.choice([1, 2, 9]))) for k in range(12)}
    rows = spark.createDataFrame([(k, i, *r) for k, v in tracks.items() for i, r in enumerate(v)], "k int, ord int, t_us long, x double, a double")
    for step, expiry in ((100, 250), (37, 0)):
        got = {(r.k, r.t_us): (r.x, r.a) for r in sampling.at_grid(rows, ["k"], ["t_us", "ord"], step, ["x"], ["a"], expiry_us=expiry).collect()}
        want = {(k, t): v for k, rs in tracks.items() for t in range(-step * (expiry // step + 1), 3000, step) if (v := _at(rs, t, expiry)) is not None}
        assert got.keys() == want.keys()
        assert all(math.isclose(a, b, abs_tol=1e-9) for k in want for a, b in zip(got[k], want[k], strict=True))


def test_grid_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, ord int, t_us long, x double, a double")
    assert sampling.at_grid(empty, ["k"], ["t_us", "ord"], 100, ["x"], ["a"]).count() == 0


def test_one_sort_and_no_join(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 0.0)], "k int, ord int, t_us long, x double, a double")
    plan = sampling.at_grid(rows, ["k"], ["t_us", "ord"], 100, ["x"], ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


KIND = "trace_id long, obj_id int, obs_ord long, t_us long, x_rel double, y_rel double, length double, width double, zrot double, lane string, ex double, ey double, es double, eyaw double"


def _posed(spark):
    rows = [(1, 1, i, i * 400_000, 30.0, 0.0, 4.0, 1.8, 0.0, "a", i * 8.0, 0.0, 20.0, 0.0) for i in range(8)]
    rows += [(1, 2, i, i * 400_000, 16.0, 0.2, 4.0, 1.8, 0.0, "a", i * 8.0, 0.0, 20.0, 0.0) for i in range(8)]
    rows += [(1, 3, i, i * 400_000, 40.0 - i, 4.0 - 0.5 * i, 4.0, 1.8, 0.0, "b", i * 8.0, 0.0, 20.0, 0.0) for i in range(8)]
    return spark.createDataFrame(rows, KIND).withColumns({"gx": F.col("ex") + F.col("x_rel"), "gy": F.col("ey") + F.col("y_rel"), "heading": F.lit(0.0)})


def _excursion(rows):
    return rows.withColumns({"excursion": F.abs("y_rel") - 2.5, "side": F.lit("left")})


def test_variant_is_a_whole_trace_and_its_delta_is_that_of_all_issues(spark):
    posed = _posed(spark)
    ego = spark.createDataFrame([(1, i, i * 100_000, 20.0, i * 2.0, 0.0, 270.0) for i in range(40)], "trace_id long, seq long, t_us long, speed double, x_m double, y_m double, heading_deg double")
    table = [(1, "closer", 1, 0.5, None, None, None, None), (1, "late", 3, None, None, None, 1.2, 1.4), (1, "brake", 1, 0.5, 0.3, 0.55, None, None)]
    variants = spark.createDataFrame(table, "trace_id long, kind string, obj_id int, gap double, `from` double, `to` double, lateral double, compress double")
    made = alternatives.perturbed(posed, variants)
    whole = alternatives.variant_traces(posed, made)
    assert {(r.variant_id, r["count"]) for r in whole.groupBy("variant_id").count().collect()} == {(f"1__{k}", 24) for k in ("closer", "late", "brake")}
    closer = made.where("kind = 'closer'").collect()
    assert all((r.x_rel, r.orig_x_m, r.gx) == (15.0, r.ex + 30.0, r.ex + 15.0) for r in closer)
    brake = {r.obs_ord: r.x_rel for r in made.where("kind = 'brake'").collect()}
    assert brake[0] == brake[2] == 30 and brake[4] == brake[7] == 15 and brake[3] == pytest.approx(30 * (1 - 0.5 * (3 / 7 - 0.3) / 0.25))
    deltas = {r.kind: (r.n_rows, r.gained, r.lost) for r in alternatives.issue_deltas(posed, made, _excursion).collect()}
    key = lambda r: (r.category, r.severity, r.obj_id, r.t_start, r.t_end)

    def all_issues(rows):
        found = validate.issues(rows, ego, _excursion(rows)).collect()
        return sorted(map(key, found), key=str)

    base = all_issues(posed)
    for kind in ("closer", "late", "brake"):
        mine = all_issues(whole.where(F.col("kind") == kind).drop("kind"))
        more = list(mine)
        less = [x for x in base if not (x in more and not more.remove(x))]
        assert deltas[kind] == (8, len(more), len(less)), kind
    assert deltas["closer"][1] > 0


def test_a_second_change_keeps_the_first_place(spark):
    posed = _posed(spark).withColumns({"orig_x_m": F.lit(-1.0), "orig_y_m": F.lit(-2.0), "orig_heading": F.lit(5.0)})
    variants = spark.createDataFrame([(1, "k", 1, 0.5, None, None, None, None)], "trace_id long, kind string, obj_id int, gap double, `from` double, `to` double, lateral double, compress double")
    assert {(r.orig_x_m, r.orig_y_m, r.orig_heading) for r in alternatives.perturbed(posed, variants).collect()} == {(-1.0, -2.0, 5.0)}


def test_neighbours_of_variants_are_found_once(spark, monkeypatch):
    """However many variants a trace has, its rows are asked once about the nearest in time."""
    posed, asked = _posed(spark), []
    variants = spark.createDataFrame([(1, f"v{i}", 2, 0.5 + i / 10, None, None, None, None) for i in range(6)], "trace_id long, kind string, obj_id int, gap double, `from` double, `to` double, lateral double, compress double")
    near = alternatives.nearest_of_tracks
    monkeypatch.setattr(alternatives, "nearest_of_tracks", lambda rows: asked.append(rows.count()) or near(rows))
    alternatives.issue_deltas(posed, alternatives.perturbed(posed, variants), _excursion, variants)
    assert asked == [posed.count()]
