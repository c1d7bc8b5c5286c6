"""Neighbours over a whole order and report counts, against loops: ties, case, nulls, one row, no rows."""

import random

from roadspan.operators import summaries


def _plain(rows, like=None):
    kept = sorted((n.lower(), n, k) for k, n in rows if not like or like.lower() in n.lower())
    keys = [k for _, _, k in kept]
    return sorted((k, keys[i - 1], keys[(i + 1) % len(keys)]) for i, k in enumerate(keys))


def test_neighbours_in_all(spark):
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choice("abAB") for _ in range(3))) for k in range(200)]
    for some, like in ((rows, None), (rows, "aB"), (rows, "none"), (rows[:1], None), ([], None), ([(k, "same") for k in range(50)], None)):
        table = spark.createDataFrame(some, "k long, name string").repartition(7)
        got = summaries.neighbours_in_all(table, "k", "name", like)
        assert got.columns == ["k", "previous", "next"]
        assert sorted(map(tuple, got.collect())) == _plain(some, like)


def test_issue_report(spark):
    rows = [(1, "overlap", "high", True), (1, "overlap", "low", None), (1, None, "medium", False), (1, "kinematic", None, True), (2, "kinematic", "high", False)]
    issues = spark.createDataFrame(rows, "trace_id int, category string, severity string, fixed boolean")
    got = {r.trace_id: (r.total, r.high, r.medium, r.low, r.fixed, r.unfixed, r.by_category) for r in summaries.issue_report(issues).collect()}
    assert got == {1: (4, 1, 1, 1, 2, 2, {"": 1, "kinematic": 1, "overlap": 2}), 2: (1, 1, 0, 0, 0, 1, {"kinematic": 1})}
    assert {(r.total, r.fixed) for r in summaries.issue_report(issues.drop("fixed")).collect()} == {(4, 0), (1, 0)}
    assert summaries.issue_report(issues.limit(0)).count() == 0
