"""As-of join and headway episodes on a stream of poses and observations in any order, with state by trace.

Each recording has a clock of its own: its latest time less the allowed delay is
its mark, and what arrives at or before the mark that held when its micro-batch
began is late. Late rows are a result of their own, so none is lost silently. State
holds what is newer than the mark, the last pose before it and open episodes, so it is
bounded by the delay, not by the length of a recording.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Rows of the stream. kind: ``pose`` (ord, x_m, y_m, speed, heading_deg), ``obs`` (ord, obj_id, x_rel, y_rel) or ``end`` of a recording.
ROWS = "kind string, trace_id long, t_us long, ord long, obj_id long, x_rel double, y_rel double, x_m double, y_m double, speed double, heading_deg double"
ALIGNED = "kind string, trace_id long, obj_id long, obs_ord long, t_us long, ex double, ey double, es double, eyaw double"
EPISODES = "kind string, trace_id long, obj_id long, t_start long, t_end long, min_headway_s double, min_gap_m double, near_miss boolean"
#: What a session needs for these: a store for state of several variables, and, where a query ends when it has read
#: what is there, no batches without rows, as timers by the clock ask for those for ever.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
OVER = 1 << 62  # mark of a recording that has ended
FIELDS = [f.split()[0] for f in ROWS.split(", ")]
LONGS = [f.split()[0] for f in ROWS.split(", ") if f.endswith(" long")]


#: A row of the stream in packed form; c and d are x_rel, y_rel of an observation, c to f x_m, y_m, speed, heading_deg of a pose.
PACKED = np.dtype([("kind", "i1"), ("t", "<i8"), ("ord", "<i8"), ("obj", "<i8"), ("c", "<f8"), ("d", "<f8"), ("e", "<f8"), ("f", "<f8")])
EPISODE = np.dtype([("obj", "<i8"), ("a", "<i8"), ("b", "<i8"), ("h", "<f8"), ("gap", "<f8")])
POSE, OBSERVATION, END = 0, 1, 2
NULL = -(1 << 63)  # of longs, in packed form
NEW = (-OVER, -OVER, 0, 0, b"", b"")  # state of a recording not seen before


def _packed(batches):
    """(trace_id, rows): the rows of a trace in an Arrow batch as one value, so that few rows are moved and met in Python."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = {f: batch.column(i) for i, f in enumerate(FIELDS)}
        kind = pc.index_in(col["kind"], pa.array(["pose", "obs", "end"])).fill_null(OBSERVATION).to_numpy(zero_copy_only=False)
        whole = {c: col[c].fill_null(NULL).to_numpy(zero_copy_only=False) for c in LONGS}
        real = lambda c: col[c].to_numpy(zero_copy_only=False)
        rows = np.zeros(n, PACKED)
        rows["kind"], rows["t"], rows["ord"], rows["obj"] = kind, whole["t_us"], whole["ord"], whole["obj_id"]
        pose = kind == POSE
        rows["c"], rows["d"] = np.where(pose, real("x_m"), real("x_rel")), np.where(pose, real("y_m"), real("y_rel"))
        rows["e"], rows["f"] = real("speed"), real("heading_deg")
        order = np.argsort(whole["trace_id"], kind="stable")
        rows, trace = rows[order], whole["trace_id"][order]
        first = np.flatnonzero(np.r_[True, trace[1:] != trace[:-1]])
        data = rows.tobytes()
        ends = [*first[1:].tolist(), n]
        parts = [data[i * PACKED.itemsize : j * PACKED.itemsize] for i, j in zip(first.tolist(), ends, strict=True)]
        keys = trace[first]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=keys == NULL), pa.array(parts, pa.binary())], names=["trace_id", "rows"])


def _yaw(heading_deg: np.ndarray) -> np.ndarray:
    return np.radians((heading_deg + 90.0) % 360.0)


def _long(v: int) -> int | None:
    return None if v == NULL else v


class Aligned(StatefulProcessor):
    """Observations with the ego's pose at their time, as soon as both poses around them can't change any more.

    All that a recording holds is one value of state, read and written once in a micro-batch.
    """

    columns = [f.split()[0] for f in ALIGNED.split(", ")]

    def __init__(self, delay_us: int, idle_ms: int):
        self.delay_us, self.idle_ms = delay_us, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.row = lambda values, made=Row(*self.columns): made(*values)
        self.state = handle.getValueState("state", "mark long, latest long, timer long, active long, waiting binary, open binary")

    def late(self, trace: int, row) -> tuple:
        return "late", trace, _long(int(row["obj"])), _long(int(row["ord"])), _long(int(row["t"])), None, None, None, None

    def results(self, trace: int, obs: np.ndarray, a: np.ndarray | None, b: np.ndarray | None, f: np.ndarray | None, opened: bytes, settled: int, ended: bool) -> tuple[list[tuple], bytes]:
        """Rows to give out for ``obs`` (in order of time), all up to ``settled`` being known, and what stays open. Poses ``a`` and ``b`` are around them, ``f`` the way between; none if there is no pose."""
        who = zip(map(_long, obs["obj"].tolist()), map(_long, obs["ord"].tolist()), obs["t"].tolist(), strict=True)
        if a is None:
            return [("at", trace, *o, None, None, None, None) for o in who], opened
        turn = _yaw(b["f"]) - _yaw(a["f"])
        yaw = _yaw(a["f"]) + np.arctan2(np.sin(turn), np.cos(turn)) * f
        pose = zip(*((a[c] + (b[c] - a[c]) * f).tolist() for c in "cde"), yaw.tolist(), strict=True)
        return [("at", trace, *o, *p) for o, p in zip(who, pose, strict=True)], opened

    def handleInputRows(self, key, rows, timerValues):
        mark, latest, timer, _, waiting, opened = self.state.get() or NEW
        come = np.frombuffer(b"".join(r.rows for r in rows), PACKED)
        ended = bool((come["kind"] == END).any())
        come = come[come["kind"] != END]
        behind = come["t"] <= mark  # also those without a time
        late = [self.late(key[0], r) for r in come[behind]]
        come = come[~behind]
        latest = max(latest, int(come["t"].max())) if len(come) else latest
        held = np.concatenate([np.frombuffer(waiting, PACKED), come])
        out, state = self._advance(key[0], held, opened, OVER if ended else max(mark, latest - self.delay_us), latest, ended)
        now = timerValues.getCurrentProcessingTimeInMs()
        if ended and timer:
            self.handle.deleteTimer(timer)
        elif not ended and not timer:  # one that is there goes on, and looks for rows since when it expires
            self.handle.registerTimer(now + self.idle_ms)
        self.state.update((*state[:2], 0 if ended else timer or now + self.idle_ms, now, *state[2:]))
        yield from map(self.row, late + out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """A recording that has been silent for long: all it holds is given out; it may still go on later."""
        mark, latest, _, active, waiting, opened = self.state.get() or NEW
        if active + self.idle_ms > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(active + self.idle_ms)
            self.state.update((mark, latest, active + self.idle_ms, active, waiting, opened))
            return
        out, state = self._advance(key[0], np.frombuffer(waiting, PACKED), opened, max(mark, latest), latest, True)
        self.state.update((*state[:2], 0, active, *state[2:]))
        yield from map(self.row, out)

    def _advance(self, trace: int, held: np.ndarray, opened: bytes, mark: int, latest: int, ended: bool) -> tuple[list[tuple], tuple]:
        held = held[np.lexsort((held["ord"], held["t"]))]
        poses, obs = held[held["kind"] == POSE], held[held["kind"] == OBSERVATION]
        n = int(np.searchsorted(poses["t"], mark, "right"))
        settled = mark if ended else int(poses["t"][n - 1]) if n else -OVER
        done = int(np.searchsorted(obs["t"], settled, "right"))
        now, a, b, f = obs[:done], None, None, None
        if len(poses):
            i = np.searchsorted(poses["t"], now["t"], "right") - 1
            a = poses[np.maximum(i, 0)]
            b = poses[np.where(i < 0, 0, np.minimum(i + 1, len(poses) - 1))]  # before a recording the first pose holds
            span = b["t"] - a["t"]
            f = np.where(span > 0, (now["t"] - a["t"]) / np.maximum(span, 1), 0.0)
        kept = b"" if mark == OVER else np.concatenate([poses[max(0, n - 1) :], obs[done:]]).tobytes()
        out, opened = self.results(trace, now, a, b, f, opened, settled, ended)
        return out, (mark, latest, kept, opened)


class Headways(Aligned):
    """Episodes under a second behind a vehicle in the own lane, closed when nothing can prolong them."""

    columns = [f.split()[0] for f in EPISODES.split(", ")]
    gap_us, least_us = 2_000_000, 300_000

    def late(self, trace: int, row) -> tuple:
        t = _long(int(row["t"]))
        return "late", trace, _long(int(row["obj"])), t, t, None, None, None

    def results(self, trace, obs, a, b, f, opened, settled, ended):
        going, done = {r[0]: r for r in np.frombuffer(opened, EPISODE).tolist()}, []
        if a is not None and len(obs):
            speed, x = a["e"] + (b["e"] - a["e"]) * f, obs["c"]
            near = np.flatnonzero((x > 0) & (np.abs(obs["d"]) <= 1.9) & (speed >= 1) & (x < 2 * speed))
            near = near[x[near] / speed[near] < 1]
            for k, t, gap, h in zip(obs["obj"][near].tolist(), obs["t"][near].tolist(), x[near].tolist(), (x[near] / speed[near]).tolist(), strict=True):
                was = going.get(k)
                if was and t > was[2] + self.gap_us:
                    done.append(was)
                    was = None
                going[k] = (k, was[1], t, min(was[3], h), min(was[4], gap)) if was else (k, t, t, h, gap)
        closed = [e for e in going.values() if ended or settled >= e[2] + self.gap_us]
        left = [e for e in going.values() if not (ended or settled >= e[2] + self.gap_us)]
        out = [("episode", trace, _long(k), a, b, h, g, h < 0.5) for k, a, b, h, g in done + closed if b - a >= self.least_us]
        return out, np.array(left, EPISODE).tobytes()


def arrivals(ego: DataFrame, obs: DataFrame) -> DataFrame:
    """Poses and observations as rows of one stream."""
    none = lambda *cols: [F.lit(None).cast("double").alias(c) for c in cols]
    poses = ego.select(F.lit("pose").alias("kind"), "trace_id", "t_us", F.col("seq").alias("ord"), F.lit(None).cast("long").alias("obj_id"), *none("x_rel", "y_rel"), "x_m", "y_m", "speed", "heading_deg")
    seen = obs.select(F.lit("obs").alias("kind"), "trace_id", "t_us", F.col("obs_ord").alias("ord"), F.col("obj_id").cast("long").alias("obj_id"), "x_rel", "y_rel", *none("x_m", "y_m", "speed", "heading_deg"))
    return poses.unionByName(seen)


def _by_trace(rows: DataFrame, processor: Aligned, schema: str) -> DataFrame:
    packed = rows.select(*FIELDS).mapInArrow(_packed, "trace_id long, rows binary")
    return packed.groupBy("trace_id").transformWithState(processor, schema, "Append", "ProcessingTime")


def aligned(rows: DataFrame, delay_us: int = 5_000_000, idle_ms: int = 3_600_000) -> DataFrame:
    """``at`` rows, each observation with ex, ey, es, eyaw as ``joins.interp_asof`` has them, and ``late`` rows, whatever they were.

    rows: a stream of ``ROWS``. Repeated rows stay, rows without a time are late, traces
    without a pose have nulls once they have ended. The session needs ``SETTINGS``; rows
    with a null trace are one trace.
    """
    return _by_trace(rows, Aligned(delay_us, idle_ms), ALIGNED)


def short_headways(rows: DataFrame, delay_us: int = 5_000_000, idle_ms: int = 3_600_000) -> DataFrame:
    """``episode`` rows as ``events.short_headways`` has them, and ``late`` rows; see ``aligned``."""
    return _by_trace(rows, Headways(delay_us, idle_ms), EPISODES)
