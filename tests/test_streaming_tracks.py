"""Streams of poses and observations in shuffled micro-batches against the batch operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from roadspan.operators import events, joins
from roadspan.ship import ship
from roadspan.streaming import tracks

EGO = "trace_id long, seq long, t_us long, x_m double, y_m double, speed double, heading_deg double"
OBS = "trace_id long, obj_id long, obs_ord long, t_us long, x_rel double, y_rel double"
DELAY = 2_000_000


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k) for k in tracks.SETTINGS}
    for k, v in tracks.SETTINGS.items():
        spark.conf.set(k, v)
    yield ship(spark)
    for k, v in before.items():
        spark.conf.set(k, v)


def _recordings(seed):
    rnd = random.Random(seed)
    ego = [(k, i, i * 100_000 + rnd.choice([0, 0, 30_000]), 2.0 * i, rnd.random(), rnd.choice([0.5, 8.0, 20.0]), rnd.choice([1.0, 359.0])) for k in (1, 2) for i in range(60)]
    obs = [(k, o, i, i * 150_000 - 300_000, rnd.choice([3.0, 6.0, 9.0, -4.0]), rnd.choice([0.5, 0.5, 3.0])) for k in (1, 2, 3) for o in (1, 2) for i in range(50)]
    return ego, obs + obs[:3]


def _replay(spark, make, batches, at):
    """The results after each batch has arrived and the query has gone on from its checkpoint."""
    for rows in batches:
        rows.write.mode("append").parquet(f"{at}/in")
        stream = make(spark.readStream.schema(tracks.ROWS).parquet(f"{at}/in"))
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _batches(spark, rows, n, rnd):
    """Rows in ``n`` micro-batches: none is overtaken by one that is over half the delay newer."""
    come = sorted(rows.collect(), key=lambda r: r.t_us + rnd.random() * DELAY / 2)
    size = -(-len(come) // n)
    ends = spark.createDataFrame([("end", k) for k in (1, 2, 3)], "kind string, trace_id long")
    none = spark.createDataFrame([], tracks.ROWS)
    parts = [spark.createDataFrame(come[i : i + size], tracks.ROWS) for i in range(0, len(come), size)]
    return [*parts, none.unionByName(ends, allowMissingColumns=True)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_batch(spark, store, tmp_path, seed):
    ego, obs = (spark.createDataFrame(r, s) for r, s in zip(_recordings(seed), (EGO, OBS), strict=True))
    batches = _batches(spark, tracks.arrivals(ego, obs), 3, random.Random(seed))
    cols = ["trace_id", "obj_id", "obs_ord", "t_us", *(F.round(c, 9).alias(c) for c in ("ex", "ey", "es", "eyaw"))]
    got = _replay(spark, lambda s: tracks.aligned(s, DELAY), batches, str(tmp_path / "a"))
    assert got.where("kind = 'late'").count() == 0
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(map(tuple, joins.interp_asof(obs, ego).select(cols).collect()), key=repr)
    cols = ["trace_id", "obj_id", "t_start", "t_end", F.round("min_headway_s", 9), "min_gap_m", "near_miss"]
    got = _replay(spark, lambda s: tracks.short_headways(s, DELAY), batches, str(tmp_path / "b"))
    want = sorted(map(tuple, events.short_headways(obs, ego).select(cols).collect()))
    assert want and sorted(map(tuple, got.select(cols).collect())) == want


def test_late_and_silent(spark, store, tmp_path):
    """Late rows are named, whatever they are; a silent trace is given out; rows without a time are late."""
    row = lambda kind, k, t, o=None, x=None: (kind, k, t, 0, o, x, 0.0, 0.0, 0.0, 10.0, 0.0)
    first = [row("pose", 1, t * 1_000_000) for t in range(0, 10)] + [row("obs", 1, t * 500_000, 7, 4.0) for t in range(20)] + [row("pose", 2, 0), row("obs", 2, 50, 8, 4.0), row("obs", 3, 60, 9, 4.0)]
    second = [row("obs", 1, 7_500_000, 7, 1.0), row("obs", 1, 7_500_001, 7, 4.0), row("pose", 1, 100), row("obs", 1, None, 7, 4.0), row("obs", 1, 9_800_000, 7, 4.0)]
    make = lambda s: tracks.aligned(s, DELAY, idle_ms=1)
    at = str(tmp_path / "late")
    got = _replay(spark, lambda s: tracks.aligned(s, DELAY, idle_ms=10**9), [spark.createDataFrame(first, tracks.ROWS), spark.createDataFrame(second, tracks.ROWS)], at)
    # the mark is 7.5 s: what comes at or before it is late
    assert {(r.trace_id, r.obj_id, r.t_us) for r in got.where("kind = 'late' and t_us is not null").collect()} == {(1, None, 100), (1, 7, 7_500_000)}
    assert got.where("kind = 'late' and t_us is null").count() == 1
    assert {r.t_us for r in got.where("kind = 'at' and trace_id = 1").collect()} == {t * 500_000 for t in range(15)}
    at = str(tmp_path / "silent")
    _replay(spark, make, [spark.createDataFrame(first, tracks.ROWS)], at)
    time.sleep(0.5)
    got = _replay(spark, make, [spark.createDataFrame([row("pose", 4, 0)], tracks.ROWS)], at)
    assert {(r.trace_id, r.t_us, r.es) for r in got.where("kind = 'at' and trace_id > 1").collect()} == {(2, 50, 10.0), (3, 60, None)}
    assert got.where("kind = 'at' and trace_id = 1").count() == 20


def test_state_is_read_and_written_once():
    """A recording's micro-batch costs one read and one write of state whatever it holds, and its timer is set once; rows come packed by recording."""
    import pyarrow as pa

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, v):
            calls.append("update")
            self.held = v

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, _):
            calls.append("register")

        def deleteTimer(self, _):
            calls.append("delete")

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 5

    one = tracks.Headways(DELAY, 1000)
    one.init(Handle())
    row = lambda kind, t=None, o=None, x=None: (kind, 1, t, 0, o, x, 0.0, 0.0, 0.0, 10.0, 0.0)
    names = [f.split() for f in tracks.ROWS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    out = []
    for rows in ([row("pose", t * 1_000_000) for t in range(9)] + [row("obs", t * 500_000, 7, 4.0) for t in range(17)], [row("obs", 1, 7, 4.0)], [row("end")]):
        batch = pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])
        packed = list(tracks._packed([batch]))  # noqa: SLF001
        assert [b.num_rows for b in packed] == [1]
        out += one.handleInputRows((1,), iter([type("R", (), {"rows": packed[0].column(1)[0].as_py()})]), Now())
    assert calls == ["get", "register", "update", "get", "update", "get", "delete", "update"]
    assert [tuple(r) for r in out] == [("late", 1, 7, 1, 1, None, None, None), ("episode", 1, 7, 0, 8_000_000, 0.4, 4.0, True)]
