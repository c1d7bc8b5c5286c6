"""Extrapolation of tracks beyond their ends, and the linking of a track to its continuation.

The constant-velocity plan of a track's ends is relational. In the step models
each step depends on the one before; without the governor tracks are
independent, with it a trace's ends and what is near them in time are taken together.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspan.functions import exprs as X
from roadspan.operators import road
from roadspan.operators.events import by_track
from roadspan.shared import written

#: Step (s), least clip distance in frames, default speed, limits of a continuation.
STEP_S, EDGE_FRAMES, ALONE_SPEED = 0.2, 3, 25.0
GAP_S, SIDE_M, WIDTH_M, SPEED_ERROR = 3.0, 2.0, 0.6, 8.0
HORIZON_BEHIND = 3.0
#: Most rows of a batch that is given back.
OUT = 1 << 15
#: Fixed values of the governor: braking and recovery (m/s2), margin (m), steering share, heading cap (deg/s), nearest box in time (us).
BRAKE, RECOVER, MARGIN_M, STEER, TURN_CAP, NEAR_US = 5.0, 2.0, 1.0, 0.35, 10.0, 300_000


def track_ends(glob: DataFrame, *also: Column) -> DataFrame:
    """Per track its first two and last two observations as structs, and what a plan needs of them; ``also``: further aggregates."""
    point = F.struct("t_us", "gx", "gy", "heading", "x_rel", "y_rel", "width", "lane")
    w = by_track()
    rows = glob.withColumns({"__p": point, "__n": F.row_number().over(w), "__m": F.row_number().over(Window.partitionBy("trace_id", "obj_id").orderBy(F.desc("t_us"), F.desc("obs_ord")))})
    pick = lambda cond, name: F.max_by("__p", F.when(F.expr(cond), 1)).alias(name)
    return rows.groupBy("trace_id", "obj_id").agg(pick("__n = 1", "first"), pick("__n = 2", "second"), pick("__m = 2", "penultimate"), pick("__m = 1", "last"), F.count("*").alias("n"), *also)


def _speed(a, b):
    dt = F.abs(b["t_us"] - a["t_us"]) / 1e6
    return F.when(dt > 0, F.hypot(b["gx"] - a["gx"], b["gy"] - a["gy"]) / dt).otherwise(0.0)


def _end() -> dict[str, Column]:
    """What ``end_plan`` says, from ``penultimate``, ``last`` and ``n``."""
    a, b = F.col("penultimate"), F.col("last")
    speed = F.when(F.col("n") < 2, F.lit(ALONE_SPEED)).otherwise(_speed(a, b))
    moved = F.atan2(b["gy"] - a["gy"], b["gx"] - a["gx"])
    heading = F.when((F.col("n") >= 2) & (speed > 0.1), moved).otherwise(F.radians(b["heading"]))
    horizon = F.when(b["x_rel"] < 0, HORIZON_BEHIND).otherwise(1.0)
    return {"t_us": b["t_us"], "gx": b["gx"], "gy": b["gy"], "speed": speed, "yaw": heading, "reach": horizon}


def end_plan(ends: DataFrame) -> DataFrame:
    """Speed and heading (radians) at a track's last observation; from motion above 0.1 m/s, else from its box."""
    return ends.select("trace_id", "obj_id", *(v.alias(k) for k, v in _end().items()))


def extrapolate(glob: DataFrame, horizon_s: float = 4.0) -> DataFrame:
    """Forward positions every 0.2 s at constant speed and heading, over the horizon (three times it for tracks behind the ego)."""
    plan = end_plan(track_ends(glob))
    steps = plan.withColumn("step", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(F.lit(horizon_s) * F.col("reach") / STEP_S).cast("int")))))
    far = F.col("speed") * F.col("step") * STEP_S
    return steps.select(
        "trace_id", "obj_id", "step", (F.col("t_us") + F.col("step") * int(STEP_S * 1e6)).alias("t_us"), (F.col("gx") + far * F.cos("yaw")).alias("gx"), (F.col("gy") + far * F.sin("yaw")).alias("gy"), "speed"
    )


def continuation_candidates(ends: DataFrame) -> DataFrame:
    """(trace_id, a, b, error): tracks b that may go on where a ends.

    b begins up to 3 s after a's end, in the same lane, at most 2 m aside and
    0.6 m wider or narrower, and the speed that bridges the gap is at most
    8 m/s off the mean of both ends' speeds. Ends and beginnings meet on
    (trace, lane, bucket of 3 s).
    """
    a = ends.where("n >= 2").select("trace_id", F.col("obj_id").alias("a"), F.col("last").alias("e"), _speed(F.col("penultimate"), F.col("last")).alias("va"))
    b = ends.where("n >= 2").select("trace_id", F.col("obj_id").alias("b"), F.col("first").alias("s"), _speed(F.col("first"), F.col("second")).alias("vb"))
    bucket = lambda c: F.floor(c / int(GAP_S * 1e6))
    a = a.withColumns({"lane": F.col("e.lane"), "k": F.explode(F.array(bucket(F.col("e.t_us")), bucket(F.col("e.t_us")) + 1))})
    b = b.withColumns({"lane": F.col("s.lane"), "k": bucket(F.col("s.t_us"))})
    gap = (F.col("s.t_us") - F.col("e.t_us")) / 1e6
    bridge = F.hypot(F.col("s.gx") - F.col("e.gx"), F.col("s.gy") - F.col("e.gy")) / gap
    pairs = a.join(b, ["trace_id", "lane", "k"]).where((F.col("a") != F.col("b")) & (gap > 0) & (gap <= GAP_S))
    pairs = pairs.where((F.abs(F.col("s.y_rel") - F.col("e.y_rel")) <= SIDE_M) & (F.abs(F.col("s.width") - F.col("e.width")) <= WIDTH_M))
    return pairs.withColumn("error", F.abs(bridge - (F.col("va") + F.col("vb")) / 2)).where(F.col("error") <= SPEED_ERROR).select("trace_id", "a", "b", "error")


def one_to_one(candidates: DataFrame) -> DataFrame:
    """(trace_id, a, b): in the order of a, each takes the candidate of least error (then the smaller b) that no earlier one has.

    Rounds of proposals: every a asks for its best candidate, every b keeps the
    first a that asks, and pairs of that b with later ones go, as those can
    never have it. All b prefer the earlier a, so there is one stable outcome,
    which is the sequential choice. A round is two grouped minima and a join;
    it is written, and the last one removes nothing. No trace is one group.
    """
    left = written(candidates.select("trace_id", "a", "b", "error"), "candidates")
    n = left.count()
    while True:
        asked = left.groupBy("trace_id", "a").agg(F.min(F.struct("error", "b")).alias("m")).select("trace_id", "a", F.col("m.b").alias("b"))
        held = asked.groupBy("trace_id", "b").agg(F.min("a").alias("first"))
        left = written(left.join(held, ["trace_id", "b"], "left").where("first is null or a <= first").drop("first"), "candidates")
        now = left.count()
        if now == n:
            return asked
        n = now


def continuations(ends: DataFrame) -> DataFrame:
    """(trace_id, a, b): the one-to-one links of the candidates."""
    return one_to_one(continuation_candidates(ends))



def steered(glob: DataFrame, ego: DataFrame, horizon_s: float = 4.0, steer: float = 0.35) -> DataFrame:
    """Forward positions of a model that turns toward the ego path's nearest tangent by ``steer`` of the difference in each step.

    Needs a trace's whole ego path at every step; without the governor, tracks
    don't see each other. A task streams through the ends of its traces' tracks
    in Arrow batches; a trace's path comes with its first track
    (``road.carried``). Held at a time are a batch and one trace's path.
    """
    plan = end_plan(track_ends(glob))
    path = ego.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("t_us", "x_m", "y_m"))).alias("__path"))
    path = path.select("trace_id", F.transform("__path", lambda p: F.struct(p["x_m"].alias("x_m"), p["y_m"].alias("y_m"))).alias("__path"))
    schema = T.StructType([*(plan.schema[c] for c in ("trace_id", "obj_id")), *T.StructType.fromDDL("step int, t_us long, gx double, gy double")])
    step_us = int(STEP_S * 1e6)

    def steps(x: float, y: float, speed: float, yaw: float, n: int, px: np.ndarray, py: np.ndarray, xs: list[float], ys: list[float]) -> Iterator[tuple[float, float]]:
        for _ in range(n):
            i = int(np.argmin((px - x) ** 2 + (py - y) ** 2))
            a, b = max(0, i - 1), min(len(xs) - 1, i + 1)
            if math.hypot(xs[b] - xs[a], ys[b] - ys[a]) > 1e-9:
                tangent = math.atan2(ys[b] - ys[a], xs[b] - xs[a])
                yaw += steer * math.atan2(math.sin(tangent - yaw), math.cos(tangent - yaw))
            x += speed * STEP_S * math.cos(yaw)
            y += speed * STEP_S * math.sin(yaw)
            yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poses, last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n, at = batch.column("__n").to_numpy(), batch.column("t_us").to_pylist()
            ends = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist() for c in ("gx", "gy", "speed", "yaw", "reach")]
            row, step, t_us, x, y = [], [], [], [], []
            for a, b in road.traces_of(n, last):
                if n[a] == 1 and (poses := road.packed_of(batch.column("__path"), a, ("x_m", "y_m"))):
                    poses = poses["x_m"], poses["y_m"], poses["x_m"].tolist(), poses["y_m"].tolist()
                if poses is None:
                    continue
                for k in range(a, b):
                    gx, gy, speed, yaw, reach = (v[k] for v in ends)
                    most = max(1, round(horizon_s * reach / STEP_S))
                    places = list(steps(gx, gy, speed, yaw, most, *poses))
                    row += [k] * most
                    step += range(1, most + 1)
                    t_us += (None if at[k] is None else at[k] + i * step_us for i in range(1, most + 1))
                    x += (p[0] for p in places)
                    y += (p[1] for p in places)
            last = int(n[-1])
            made = batch.select(["trace_id", "obj_id"]).take(pa.array(row, pa.int64()))
            for name, v, kind in (("step", step, pa.int32()), ("t_us", t_us, pa.int64()), ("gx", x, pa.float64()), ("gy", y, pa.float64())):
                made = made.append_column(name, pa.array(v, kind))
            yield from (made.slice(i, OUT) for i in range(0, made.num_rows, OUT))

    return road.carried(plan, path, "__path").mapInArrow(run, schema)


def _corners(x: float, y: float, yaw: float, length: float, width: float) -> list[tuple[float, float]]:
    c, s = math.cos(yaw), math.sin(yaw)
    return [(x + a * c - b * s, y + a * s + b * c) for a, b in ((length / 2, width / 2), (length / 2, -width / 2), (-length / 2, -width / 2), (-length / 2, width / 2))]


def _touch(a: tuple, b: tuple) -> bool:
    """Separating-axis test of two boxes (x, y, yaw, length, width)."""
    if math.hypot(a[0] - b[0], a[1] - b[1]) > (math.hypot(a[3], a[4]) + math.hypot(b[3], b[4])) / 2:
        return False
    p, q = _corners(*a), _corners(*b)
    for yaw in (a[2], a[2] + math.pi / 2, b[2], b[2] + math.pi / 2):
        c, s = math.cos(yaw), math.sin(yaw)
        u, v = [x * c + y * s for x, y in p], [x * c + y * s for x, y in q]
        if max(u) < min(v) or max(v) < min(u):
            return False
    return True


class _Scene:
    """Boxes of a trace's tracks by time; predictions are added as they are made."""

    def __init__(self) -> None:
        self.tracks: dict[int, tuple[list[int], list[tuple]]] = {}

    def add(self, obj: int, t: int, box: tuple) -> None:
        times, boxes = self.tracks[obj]
        i = bisect.bisect_right(times, t)
        times.insert(i, t)
        boxes.insert(i, box)

    def others(self, obj: int, t: int):
        for o, (times, boxes) in self.tracks.items():
            if o == obj:
                continue
            i = bisect.bisect_left(times, t)
            if i and (i == len(times) or t - times[i - 1] <= times[i] - t):
                i -= 1  # of two as near the earlier
            if i < len(times) and abs(times[i] - t) <= NEAR_US:
                yield boxes[i]


#: Columns of a trace's rows in ``governed``: poses (without obj_id) first, then each track in order of time.
_INTEGERS, _FLOATS = ("t_us", "end_us"), ("x", "y", "heading", "length", "width", "speed", "yaw", "reach")


def _governed(trace: int, rows: dict[str, np.ndarray], horizon_s: float) -> list[tuple]:
    """The steps of one trace, see ``governed``."""
    n = int(rows["is_pose"].sum())
    if not 0 < n < len(rows["is_pose"]):
        return []
    px, py = rows["x"][:n], rows["y"][:n]
    pt, xs, ys, pyaw = (rows[c][:n].tolist() for c in ("t_us", "x", "y", "heading"))
    obj, times = rows["obj_id"][n:], rows["t_us"][n:].tolist()
    boxes = list(zip(*(rows[c][n:].tolist() for c in ("x", "y")), np.radians(rows["heading"][n:]).tolist(), *(rows[c][n:].tolist() for c in ("length", "width")), strict=True))
    scene, out, heap = _Scene(), [], []
    bounds = [0, *(np.flatnonzero(obj[1:] != obj[:-1]) + 1).tolist(), len(obj)]
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        o, last = int(obj[a]), boxes[b - 1]
        scene.tracks[o] = (times[a:b], boxes[a:b])
        end, speed, yaw, reach = (rows[c][n + b - 1].item() for c in ("end_us", "speed", "yaw", "reach"))
        state = {"obj": o, "x": last[0], "y": last[1], "yaw": yaw, "box": last[2], "v": speed, "cruise": speed, "step": 0, "most": max(1, round(horizon_s * reach / STEP_S)), "size": last[3:]}
        heapq.heappush(heap, (end + int(STEP_S * 1e6), k, state))
    count = len(heap)
    while heap:
        t, _, s = heapq.heappop(heap)
        if t >= pt[-1]:
            continue
        i = int(np.argmin((px - s["x"]) ** 2 + (py - s["y"]) ** 2))
        a, b = max(0, i - 1), min(n - 1, i + 1)
        yaw = s["yaw"]
        if math.hypot(xs[b] - xs[a], ys[b] - ys[a]) > 1e-9:
            tangent = math.atan2(ys[b] - ys[a], xs[b] - xs[a])
            yaw += STEER * math.atan2(math.sin(tangent - yaw), math.cos(tangent - yaw))
        turn = STEER * math.atan2(math.sin(yaw - s["box"]), math.cos(yaw - s["box"]))
        cap = math.radians(TURN_CAP) * STEP_S
        box_yaw = s["box"] + max(-cap, min(cap, turn))
        j = max(0, bisect.bisect_right(pt, t) - 1)
        k = min(j + 1, n - 1)
        f = (t - pt[j]) / (pt[k] - pt[j]) if t > pt[j] and k > j else 0.0
        ego_yaw = pyaw[j] + ((pyaw[k] - pyaw[j] + 180) % 360 - 180) * f
        around = [*scene.others(s["obj"], t), (xs[j] + (xs[k] - xs[j]) * f, ys[j] + (ys[k] - ys[j]) * f, math.radians(ego_yaw), X.EGO_LENGTH, X.EGO_WIDTH)]
        c, d = math.cos(yaw), math.sin(yaw)

        def at(v, s=s, c=c, d=d):
            return s["x"] + v * STEP_S * c, s["y"] + v * STEP_S * d

        def blocked(v, margin, at=at, yaw=yaw, s=s, c=c, d=d, around=around):
            x, y = at(v)
            own = (x, y, yaw, s["size"][0] + 2 * margin, s["size"][1] + 2 * margin)
            across = math.hypot(own[3], own[4])
            for q in around:
                dx, dy = q[0] - x, q[1] - y
                if dx * c + dy * d > 0 and math.hypot(dx, dy) <= (across + math.hypot(q[3], q[4])) / 2 and _touch(own, q):
                    return True
            return False

        v = s["v"]
        if blocked(v, MARGIN_M):
            v = max(0.0, v - BRAKE * STEP_S)
            after = v
            if blocked(v, 0.0):
                continue
        else:
            after = min(s["cruise"], v + RECOVER * STEP_S)
        x, y = at(v)
        s |= {"x": x, "y": y, "yaw": yaw, "box": box_yaw, "v": after, "step": s["step"] + 1}
        scene.add(s["obj"], t, (x, y, box_yaw, *s["size"]))
        out.append((trace, s["obj"], s["step"], t, x, y, v))
        if s["step"] < s["most"]:
            count += 1
            heapq.heappush(heap, (t + int(STEP_S * 1e6), count, s))
    return out


def governed(glob: DataFrame, ego: DataFrame, horizon_s: float = 4.0) -> DataFrame:
    """Forward positions of all tracks of a trace, stepped in the order of time so that each sees the others.

    Before a step, a box along the direction of travel is tested with a margin
    of 1 m against boxes ahead, the ego's at that very time; a blocked track
    brakes and takes the step at the lower speed, and ends where its box would
    still touch another. Free tracks regain their speed. Steps are bound to
    each other across a trace's tracks; traces are independent. Nothing is
    predicted from the ego's last pose on.

    No step looks at boxes more than 0.3 s before the first one, so of the
    observations only those from there on and each track's last one are moved.
    Ends are found by windows over the rows themselves: ``glob`` is read once.
    A task streams through its traces in sorted Arrow batches of many of them;
    held at a time are a batch and one trace's poses and such observations.
    """
    track = Window.partitionBy("trace_id", "obj_id").orderBy(F.desc("t_us"), F.desc("obs_ord")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct("t_us", "gx", "gy", "heading", "x_rel")
    tracks = glob.where("trace_id is not null and obj_id is not null").select("trace_id", "obj_id", "obs_ord", "t_us", "gx", "gy", "heading", "x_rel", "length", "width")
    tracks = tracks.withColumns({"last": F.first(point).over(track), "penultimate": F.nth_value(point, 2).over(track), "n": F.count("*").over(track)})
    end = _end()
    boxes = tracks.select("trace_id", "obj_id", "obs_ord", "t_us", F.col("gx").alias("x"), F.col("gy").alias("y"), "heading", "length", "width", end["t_us"].alias("end_us"), *(end[c].alias(c) for c in ("speed", "yaw", "reach")))
    boxes = boxes.withColumn("__from", F.min("end_us").over(Window.partitionBy("trace_id")) + int(STEP_S * 1e6) - NEAR_US)
    seen = boxes.where("t_us >= __from or t_us = end_us").drop("__from")
    poses = ego.where("trace_id is not null and t_us is not null").select("trace_id", "t_us", F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.pmod(F.col("heading_deg") + 90, F.lit(360.0)).alias("heading"))
    rows = seen.unionByName(poses, allowMissingColumns=True).repartition("trace_id").sortWithinPartitions("trace_id", F.asc_nulls_first("obj_id"), "t_us", "obs_ord")

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = {"trace_id": pa.int64(), "obj_id": pa.int32(), "step": pa.int32(), "t_us": pa.int64(), "gx": pa.float64(), "gy": pa.float64(), "speed": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def whole(trace: int, parts: list[dict]) -> list[tuple]:
        return _governed(trace, {c: np.concatenate([p[c] for p in parts]) if len(parts) > 1 else v for c, v in parts[0].items()}, horizon_s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, obj = batch.column("trace_id").to_numpy(), batch.column("obj_id")
            cols = {"is_pose": obj.is_null().to_numpy(zero_copy_only=False), "obj_id": obj.fill_null(0).to_numpy()}
            cols |= {c: batch.column(c).fill_null(0).to_numpy() for c in _INTEGERS} | {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _FLOATS}
            starts, out = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()], []
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                if parts and trace != ids[a]:
                    out += whole(trace, parts)
                    parts = []
                trace = ids[a].item()
                parts.append({c: v[a:b] for c, v in cols.items()})
            if out:
                yield made(out)
        if parts and (out := whole(trace, parts)):
            yield made(out)

    return rows.mapInArrow(run, "trace_id long, obj_id int, step int, t_us long, gx double, gy double, speed double")
