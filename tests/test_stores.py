"""Replaced keys of a stored table, and a log with broken lines."""

from pyspark.sql import functions as F

from roadspan.sources import stores


def test_keys_are_replaced_and_a_repeat_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    kind = "k string, tag string, n int"
    first = spark.createDataFrame([(f"t{i}", tag, i) for i in range(20) for tag in "ab"] + [(None, "x", 1)], kind)
    stores.replace_keys(path, first, first, "k", 4)
    rows = lambda: sorted(map(tuple, stores.read_keys(spark, path, first.schema, "k").collect()))
    assert rows() == sorted((f"t{i}", tag, i) for i in range(20) for tag in "ab")
    new = spark.createDataFrame([("t3", "c", 1), ("t99", "c", 2), ("t5", "not asked for", 0)], kind)
    keys = spark.createDataFrame([("t3",), ("t4",), ("t99",)], "k string")
    want = sorted([(f"t{i}", tag, i) for i in range(20) for tag in "ab" if i not in (3, 4)] + [("t3", "c", 1), ("t99", "c", 2)])
    for _ in range(2):
        stores.replace_keys(path, new, keys, "k", 4)
        assert rows() == want


def test_a_bucket_that_loses_its_last_row(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    stores.replace_keys(path, rows, rows, "k", 4)
    stores.replace_keys(path, rows.limit(0), rows, "k", 4)
    assert stores.read_keys(spark, path, rows.schema, "k").count() == 0
    stores.replace_keys(path, rows, rows, "k", 4)
    assert stores.read_keys(spark, path, rows.schema, "k").count() == 1


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(f"t{i}", i) for i in range(50)], "k string, n int")
    stores.replace_keys(path, rows, rows, "k", 8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    stores.replace_keys(path, rows.where("k = 't7'"), rows.where("k = 't7'"), "k", 8)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(before.keys() - after.keys()) == 1 and len(before.keys() & after.keys()) == len(before) - 1


def test_log_counts_broken_lines(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(i, f"s{i}", None if i == 2 else i * 0.5) for i in range(5)], "at long, status string, value double")
    stores.append_log(rows.where("at < 3"), path)
    stores.append_log(rows.where("at >= 3"), path)
    (tmp_path / "log" / "part-z.txt").write_text('{"at": 9, "status": "cut\n\n   \nnull\n[1]\n{"at": "no number", "status": "x"}\n{"status": "no time", "more": {"a": 1}}\n')
    log = stores.read_log(spark, path, rows.schema)
    good = sorted((r.at if r.at is not None else -1, r.status, r.value) for r in log.where("broken is null").collect())
    assert good == [(-1, "no time", None), (0, "s0", 0.0), (1, "s1", 0.5), (2, "s2", None), (3, "s3", 1.5), (4, "s4", 2.0)]
    assert log.where(F.col("broken").isNotNull()).count() == 4
    assert [tuple(r) for r in stores.tail(log, ["at"], 2).collect()] == [(4, "s4", 2.0, 4), (3, "s3", 1.5, 4)]
