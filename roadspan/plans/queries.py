"""Registered queries of the trace operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspan.functions import exprs as X
from roadspan.operators import corridor, events, fixes, frames, joins, lanes, predict, repair, road, summaries, validate, variants
from roadspan.operators import reports as R
from roadspan.plans import projection as P
from roadspan.shared import written
from roadspan.ship import ship
from roadspan.sources import traces
from roadspan.streaming import sessions as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Six decimals, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in cols})


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0 AS {c.rsplit('.', 1)[-1]}" for c in cols)


WRAP = "(({0} + 180) % 360 + 360) % 360 - 180"
BASE = f"WITH {P.EGO}, {P.OBS}, {P.AT}, {P.GLOBAL}"


def _glob(spark, sf_dir):
    return frames.populate_global(P.obs(spark, sf_dir), P.ego(spark, sf_dir))


def _at(spark, sf_dir):
    return joins.interp_asof(P.obs(spark, sf_dir), P.ego(spark, sf_dir))


# --- headway: the flagship ---

HEAD = """hw AS (SELECT trace_id, obj_id, t_us, x_rel / es AS h, x_rel FROM ego_at WHERE x_rel > 0 AND abs(y_rel) <= 1.9 AND es >= 1 AND x_rel / es < 1),
hn AS (SELECT *, CASE WHEN t_us <= lag(t_us) OVER w + 2000000 THEN 0 ELSE 1 END AS new FROM hw WINDOW w AS (PARTITION BY trace_id, obj_id ORDER BY t_us)),
hr AS (SELECT *, sum(new) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM hn),
head AS (SELECT trace_id, obj_id, min(t_us) AS t_start, max(t_us) AS t_end, min(h) AS min_headway_s, min(x_rel) AS min_gap_m FROM hr GROUP BY trace_id, obj_id, run HAVING max(t_us) - min(t_us) >= 300000)"""


@query(f"{BASE}, {HEAD} SELECT trace_id, obj_id, t_start, t_end, {r6('min_headway_s', 'min_gap_m')}, min_headway_s < 0.5 AS near_miss FROM head")
def short_headway(spark, sf_dir):
    return rounded(events.short_headways(P.obs(spark, sf_dir), P.ego(spark, sf_dir)), "min_headway_s", "min_gap_m")


# --- frames ---


@query(f"""WITH {P.EGO}, ll AS (SELECT *, 48 + y_m / 111320 AS lat, 9 + x_m / 111320 AS lon FROM ego),
a AS (SELECT trace_id, arg_min(lat, t_us) AS lat0, arg_min(lon, t_us) AS lon0 FROM ll GROUP BY 1)
SELECT trace_id, seq, round(radians(lon - lon0) * cos(radians(lat0)) * 6378137, 6) + 0 AS x_m, round(radians(lat - lat0) * 6378137, 6) + 0 AS y_m FROM ll JOIN a USING (trace_id)""")
def ego_project_local(spark, sf_dir):
    ego = P.ego(spark, sf_dir).withColumns({"lat": 48 + F.col("y_m") / 111320, "lon": 9 + F.col("x_m") / 111320})
    return rounded(frames.project_ego(ego).select("trace_id", "seq", "x_m", "y_m"), "x_m", "y_m")


@query(f"""WITH {P.EGO} SELECT trace_id, seq, round(radians((heading_deg + 90) % 360), 6) AS yaw, {WRAP.format('heading_deg')} AS wrapped,
CASE WHEN heading_deg > 180 THEN least(360 - heading_deg, 180 - (360 - heading_deg)) ELSE least(heading_deg, 180 - heading_deg) END AS folded,
((450 - heading_deg) % 360 + 360) % 360 AS bearing FROM ego""")
def angle_wrap_yaw(spark, sf_dir):
    h = F.col("heading_deg")
    return P.ego(spark, sf_dir).select(
        "trace_id", "seq", F.round(X.yaw_of_heading(h), 6).alias("yaw"), X.wrap_degrees(h).alias("wrapped"), F.round(X.axis_angle(F.radians(h)), 6).alias("folded"), X.compass_bearing(h).alias("bearing")
    )


@query(f"{BASE} SELECT trace_id, obj_id, obs_ord, {r6('ex', 'ey', 'es')}, round(sin(eyaw), 6) + 0 AS sin_yaw, round(cos(eyaw), 6) + 0 AS cos_yaw FROM ego_at")
def interp_asof(spark, sf_dir):
    at = _at(spark, sf_dir).withColumns({"sin_yaw": F.sin("eyaw"), "cos_yaw": F.cos("eyaw")})
    return rounded(at.select("trace_id", "obj_id", "obs_ord", "ex", "ey", "es", "sin_yaw", "cos_yaw"), "ex", "ey", "es", "sin_yaw", "cos_yaw")


@query(f"{BASE} SELECT trace_id, obj_id, obs_ord, {r6('gx', 'gy')}, round(sin(radians(heading)), 6) + 0 AS sin_heading FROM posed")
def populate_global(spark, sf_dir):
    g = _glob(spark, sf_dir).withColumn("sin_heading", F.sin(F.radians("heading")))
    return rounded(g.select("trace_id", "obj_id", "obs_ord", "gx", "gy", "sin_heading"), "gx", "gy", "sin_heading")


@query(f"{BASE} SELECT trace_id, obj_id, obs_ord, {r6('x_rel', 'y_rel', 'zrot')} FROM posed")
def frame_roundtrip(spark, sf_dir):
    return rounded(frames.reproject_relative(_glob(spark, sf_dir)).select("trace_id", "obj_id", "obs_ord", "x_rel", "y_rel", "zrot"), "x_rel", "y_rel", "zrot")


@query(f"""WITH {P.EGO}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY t_us) - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS c,
(max(t_us) OVER (PARTITION BY trace_id) - min(t_us) OVER (PARTITION BY trace_id)) / 1000000.0 AS s FROM ego)
SELECT trace_id, seq, t_us FROM n WHERE i % greatest(1, c // greatest(1, CAST(floor(s * 2) AS BIGINT))) = 0""")
def stride_sampling(spark, sf_dir):
    return frames.sampled(P.ego(spark, sf_dir), 2).select("trace_id", "seq", "t_us")


# --- validation ---

STEPS = f"""st AS (SELECT trace_id, obj_id, obs_ord, t_us AS t_start, lead(t_us) OVER w AS t_end, (lead(t_us) OVER w - t_us) / 1e6 AS dt,
sqrt((lead(gx) OVER w - gx) ** 2 + (lead(gy) OVER w - gy) ** 2) AS dist, abs({WRAP.format('(lead(heading) OVER w - heading)')}) AS turn FROM posed WINDOW w AS (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord)),
steps AS (SELECT *, dist / dt AS speed, turn / dt AS yaw_rate FROM st WHERE dt > 0)"""


def _sev(x: str, limits: tuple[float, float]) -> str:
    return f"CASE WHEN {x} > {limits[1]} THEN 'high' WHEN {x} > {limits[0]} THEN 'medium' END"


EGO_KIN = f"""ek AS (SELECT trace_id, t_us AS t_start, lead(t_us) OVER w AS t_end, (lead(t_us) OVER w - t_us) / 1e6 AS dt, sqrt((lead(x_m) OVER w - x_m) ** 2 + (lead(y_m) OVER w - y_m) ** 2) AS d, lead(speed) OVER w - speed AS dv FROM ego WINDOW w AS (PARTITION BY trace_id ORDER BY t_us)),
ego_kin AS (SELECT trace_id, t_start, t_end, d / dt AS speed, dv / dt AS accel, CASE WHEN d / dt > 60 OR abs(dv / dt) > 12 THEN 'high' WHEN d / dt > 45 OR abs(dv / dt) > 6 THEN 'medium' END AS severity FROM ek WHERE dt > 0)"""


@query(f"WITH {P.EGO}, {EGO_KIN} SELECT trace_id, t_start, t_end, {r6('speed', 'accel')}, severity FROM ego_kin WHERE severity IS NOT NULL")
def ego_kinematic(spark, sf_dir):
    return rounded(validate.ego_kinematic(P.ego(spark, sf_dir)), "speed", "accel")


@query(f"{BASE}, {STEPS} SELECT trace_id, obj_id, t_start, t_end, {r6('speed')}, {_sev('speed', X.SPEED_LIMITS)} AS severity FROM steps WHERE speed > 45")
def vehicle_speed_flags(spark, sf_dir):
    return rounded(validate.speed_flags(validate.track_steps(_glob(spark, sf_dir))), "speed")


@query(f"{BASE}, {STEPS} SELECT trace_id, obj_id, t_start, t_end, {r6('yaw_rate')}, {_sev('yaw_rate', X.YAW_RATE_LIMITS)} AS severity FROM steps WHERE yaw_rate > 15")
def yaw_rate_flags(spark, sf_dir):
    return rounded(validate.yaw_rate_flags(validate.track_steps(_glob(spark, sf_dir))), "yaw_rate")


ACCEL = f"""ca AS (SELECT trace_id, obj_id, t_end AS t_us, (lead(speed) OVER w - speed) / ((dt + lead(dt) OVER w) / 2) AS accel, lead(t_start) OVER w AS t1, lead(t_end) OVER w AS t_next, t_end FROM steps WINDOW w AS (PARTITION BY trace_id, obj_id ORDER BY t_start, obs_ord)),
accel AS (SELECT trace_id, obj_id, t_us, t_next, accel, {_sev('abs(accel)', X.ACCEL_LIMITS)} AS severity FROM ca WHERE t1 = t_end AND abs(accel) > 6)"""


@query(f"{BASE}, {STEPS}, {ACCEL} SELECT trace_id, obj_id, t_us, {r6('accel')}, severity FROM accel")
def centred_accel(spark, sf_dir):
    return rounded(validate.centred_acceleration(validate.track_steps(_glob(spark, sf_dir))), "accel").drop("t_next")


def _sat(x1, y1, a1, l1, w1, x2, y2, a2, l2, w2) -> str:
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    tests = []
    for a, sx, sy in ((a1, "cos({0})", "sin({0})"), (a1, "-sin({0})", "cos({0})"), (a2, "cos({0})", "sin({0})"), (a2, "-sin({0})", "cos({0})")):
        ux, uy = f"({sx.format(a)})", f"({sy.format(a)})"
        reach = " + ".join(f"abs({ux} * cos({b}) + {uy} * sin({b})) * {ln} / 2 + abs({uy} * cos({b}) - {ux} * sin({b})) * {wd} / 2" for b, ln, wd in ((a1, l1, w1), (a2, l2, w2)))
        tests.append(f"abs({ux} * {dx} + {uy} * {dy}) <= {reach}")
    return " AND ".join(tests)


HITS = f"hits AS (SELECT DISTINCT trace_id, obj_id, t_us FROM obs WHERE {_sat('0', '0', '0', '4.9::DOUBLE', '1.9::DOUBLE', 'x_rel', 'y_rel', 'zrot', 'length', 'width')})"


@query(f"WITH {P.OBS}, {HITS} SELECT * FROM hits")
def collision_ego(spark, sf_dir):
    return validate.ego_overlaps(P.obs(spark, sf_dir))


NEAR = """pr AS (SELECT a.trace_id, a.obj_id, a.obs_ord, a.t_us, a.gx, a.gy, a.heading, a.length, a.width, b.obj_id AS other, b.obs_ord AS ord2, b.t_us AS t2, b.gx AS gx2, b.gy AS gy2, b.heading AS heading2, b.length AS length2, b.width AS width2,
row_number() OVER (PARTITION BY a.trace_id, a.obj_id, a.obs_ord, b.obj_id ORDER BY abs(a.t_us - b.t_us), b.t_us, b.obs_ord DESC) AS rn
FROM posed a JOIN posed b ON a.trace_id = b.trace_id AND a.obj_id < b.obj_id AND b.t_us BETWEEN a.t_us - 300000 AND a.t_us + 300000)"""


@query(f"""WITH {P.OBS}, pr AS (SELECT a.trace_id, a.obj_id, a.obs_ord, b.obj_id AS other, b.obs_ord AS near_ord, row_number() OVER (PARTITION BY a.trace_id, a.obj_id, a.obs_ord, b.obj_id ORDER BY abs(a.t_us - b.t_us), b.t_us, b.obs_ord DESC) AS rn
FROM obs a JOIN obs b ON a.trace_id = b.trace_id AND a.obj_id < b.obj_id AND b.t_us BETWEEN a.t_us - 300000 AND a.t_us + 300000) SELECT trace_id, obj_id, obs_ord, other, near_ord FROM pr WHERE rn = 1""")
def nearest_within_300ms(spark, sf_dir):
    obs = P.obs(ship(spark), sf_dir).select("trace_id", "obj_id", "obs_ord", "t_us")
    return joins.nearest_of_tracks(obs).select("trace_id", "obj_id", "obs_ord", "other", F.col("near.obs_ord").alias("near_ord"))


PAIRS = f"pairs AS (SELECT DISTINCT trace_id, obj_id, other, t_us FROM pr WHERE rn = 1 AND {_sat('gx', 'gy', 'radians(heading)', 'length', 'width', 'gx2', 'gy2', 'radians(heading2)', 'length2', 'width2')})"


@query(f"{BASE}, {NEAR}, {PAIRS} SELECT * FROM pairs")
def collision_pairs(spark, sf_dir):
    return validate.pair_overlaps(_glob(ship(spark), sf_dir))


def _course(a: str, b: str) -> str:
    return f"CASE WHEN sqrt(({b}.x - {a}.x) ** 2 + ({b}.y - {a}.y) ** 2) >= 1.5 THEN degrees(atan2({b}.y - {a}.y, {b}.x - {a}.x)) END"


def _runs(rows: str) -> str:
    """CTEs up to runs: spells of excursion > 0 in ``rows`` with their turn and label."""
    return f"""ex AS (SELECT *, {{'t': t_us, 'o': obs_ord, 'x': gx, 'y': gy}} AS p, abs({WRAP.format('degrees(zrot)')}) AS axis FROM ({rows}) z),
om AS (SELECT *, coalesce(max(p) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1000000 PRECEDING), min(p) OVER (PARTITION BY trace_id, obj_id)) AS base, max(t_us) OVER (PARTITION BY trace_id, obj_id) AS t_last,
CASE WHEN excursion > 0 AND NOT coalesce(lag(excursion > 0) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord), false) THEN 1 ELSE 0 END AS new FROM ex),
orr AS (SELECT *, sum(new) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord ROWS UNBOUNDED PRECEDING) AS run FROM om),
og AS (SELECT trace_id, obj_id, min(t_us) AS t_start, max(t_us) AS t_end, max(excursion) AS peak_m, first(side ORDER BY excursion DESC, obs_ord) AS side, max(t_us) = max(t_last) AS to_end, min(p) AS a, arg_min(base, p) AS b, max(p) AS z, max(least(axis, 180 - axis)) AS axis
FROM orr WHERE excursion > 0 GROUP BY trace_id, obj_id, run),
oc AS (SELECT *, {_course('b', 'a')} AS c0, {_course('a', 'z')} AS c1 FROM og),
ot AS (SELECT *, coalesce(abs({WRAP.format('(c1 - c0)')}), axis) AS turn_deg FROM oc),
runs AS (SELECT *, CASE WHEN peak_m >= 4 OR (peak_m >= 2 AND (to_end OR turn_deg >= 10)) THEN 'departure' ELSE 'noise' END AS label FROM ot)"""


RUNS = _runs("SELECT *, abs(y_rel) - 2.5::DOUBLE AS excursion, CASE WHEN y_rel > 0 THEN 'left' ELSE 'right' END AS side FROM posed")
ISSUES = """iss AS (SELECT trace_id, 'kinematic' AS category, severity, NULL AS obj_id, t_start, t_end FROM ego_kin WHERE severity IS NOT NULL
UNION ALL SELECT trace_id, 'kinematic', CASE WHEN speed > 60 THEN 'high' ELSE 'medium' END, obj_id, t_start, t_end FROM steps WHERE speed > 45
UNION ALL SELECT trace_id, 'kinematic', CASE WHEN yaw_rate > 40 THEN 'high' ELSE 'medium' END, obj_id, t_start, t_end FROM steps WHERE yaw_rate > 15
UNION ALL SELECT trace_id, 'kinematic', severity, obj_id, t_us, t_next FROM accel UNION ALL SELECT trace_id, 'collision', 'high', obj_id, t_us, t_us FROM hits
UNION ALL SELECT trace_id, 'collision', 'high', obj_id, t_us, t_us FROM pairs
UNION ALL SELECT trace_id, CASE label WHEN 'departure' THEN 'road_departure' ELSE 'off_road' END, CASE label WHEN 'departure' THEN 'low' ELSE 'medium' END, obj_id, t_start, t_end FROM runs)"""
ALL_ISSUES = f"{BASE}, {EGO_KIN}, {STEPS}, {ACCEL}, {HITS}, {NEAR}, {PAIRS}, {RUNS}, {ISSUES}"


def _excursions(obs):
    return obs.withColumns({"excursion": F.abs("y_rel") - 2.5, "side": F.when(F.col("y_rel") > 0, "left").otherwise("right")})


def _written_glob(spark, sf_dir):
    """Observations as the rules need them, written once for the passes that read them."""
    return written(_glob(ship(spark), sf_dir).select("trace_id", "obj_id", "obs_ord", "t_us", "x_rel", "y_rel", "zrot", "length", "width", "gx", "gy", "heading"), "posed")


def _issues(spark, sf_dir, glob=None):
    glob = glob or _written_glob(spark, sf_dir)
    return validate.issues(glob, P.ego(spark, sf_dir), _excursions(glob))


def _kinematic(posed):
    """The kinematic issues of vehicles alone."""
    return validate.kinematic(validate.track_steps(posed)).withColumn("category", F.lit("kinematic"))


@query(f"{ALL_ISSUES} SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY t_start, coalesce(obj_id, 0), category, severity, t_end) - 1 AS issue_ord FROM iss")
def validate_all(spark, sf_dir):
    return validate.numbered(_issues(spark, sf_dir))


@query(f"{ALL_ISSUES} SELECT trace_id, category, severity, count(*) AS n FROM iss GROUP BY ALL")
def issue_counts(spark, sf_dir):
    return summaries.count_by(_issues(spark, sf_dir), "trace_id", "category", "severity")


@query(f"""{ALL_ISSUES}, mk AS (SELECT *, t_end - t_start < 100000 AS fixed FROM iss),
bc AS (SELECT trace_id, string_agg(category || '=' || n, ',' ORDER BY category) AS by_category FROM (SELECT trace_id, category, count(*) AS n FROM iss GROUP BY ALL) z GROUP BY 1)
SELECT trace_id, count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
count(*) FILTER (fixed) AS fixed, count(*) FILTER (NOT fixed) AS unfixed, any_value(by_category) AS by_category FROM mk JOIN bc USING (trace_id) GROUP BY 1""")
def issue_report_counts(spark, sf_dir):
    """Issues of under 0.1 s count as fixed here."""
    report = summaries.issue_report(_issues(spark, sf_dir).withColumn("fixed", F.expr("t_end - t_start < 100000")))
    shown = F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.withColumn("by_category", F.array_join(shown, ","))


@query(f"{ALL_ISSUES} SELECT category, severity, count(*) AS n FROM iss GROUP BY ROLLUP (category, severity)")
def issue_rollup(spark, sf_dir):
    return summaries.severity_rollup(_issues(spark, sf_dir))


@query(f"{BASE}, {RUNS} SELECT trace_id, obj_id, t_start, t_end, {r6('peak_m')}, side, to_end, {r6('turn_deg')}, label FROM runs")
def offroad_runs(spark, sf_dir):
    return rounded(validate.offroad_runs(_excursions(_glob(spark, sf_dir))), "peak_m", "turn_deg")


BOUNDS = f"""{P.EDGES}, sn AS (SELECT a.*, line_id, arg_min(y, {{'g': abs(e.t_us - a.t_us), 't': e.t_us}}) AS ly FROM (SELECT trace_id, obj_id, obs_ord, t_us, x_rel, y_rel, width, lane, zrot, ex, ey, eyaw, gx, gy FROM posed) a JOIN edges e USING (trace_id) GROUP BY ALL),
pt AS (SELECT *, cos(eyaw) * (i * 20 - ex) + sin(eyaw) * (ly - ey) AS px, -sin(eyaw) * (i * 20 - ex) + cos(eyaw) * (ly - ey) AS py, i FROM sn CROSS JOIN (SELECT range AS i FROM range(-3, 43)) r),
nr AS (SELECT trace_id, obj_id, obs_ord, line_id, arg_min(py, {{'g': abs(px - x_rel), 'i': i}}) AS py FROM pt WHERE abs(px - x_rel) <= 40 GROUP BY ALL),
sd AS (SELECT trace_id, obj_id, obs_ord, min(py) FILTER (py > 0) AS left_m, max(py) FILTER (py <= 0) AS right_m FROM nr GROUP BY ALL),
bd AS (SELECT posed.*, left_m, right_m FROM posed LEFT JOIN sd USING (trace_id, obj_id, obs_ord))"""


def _bounds(spark, sf_dir):
    return corridor.bounds(_glob(ship(spark), sf_dir).drop("es"), P.edges(spark, sf_dir))


@query(f"{BASE}, {BOUNDS} SELECT trace_id, obj_id, obs_ord, {r6('left_m', 'right_m')} FROM bd")
def corridor_bounds(spark, sf_dir):
    return rounded(_bounds(spark, sf_dir).select("trace_id", "obj_id", "obs_ord", "left_m", "right_m"), "left_m", "right_m")


ON_ROAD = f"lane IN ({', '.join(repr(x) for x in corridor.ON_ROAD)})"
OUT = f"""sx AS (SELECT *, y_rel - width / 2 - (left_m - 0.3::DOUBLE) AS l, right_m + 0.3::DOUBLE - (y_rel + width / 2) AS r FROM bd),
sy AS (SELECT *, CASE WHEN {ON_ROAD} THEN NULL WHEN l > 0 THEN l WHEN r > 0 THEN r END AS o FROM sx),
cx AS (SELECT * EXCLUDE (l, r, o), CASE WHEN o >= 0.05 THEN o ELSE 0 END AS excursion, CASE WHEN o >= 0.05 THEN CASE WHEN l > 0 THEN 'left' ELSE 'right' END END AS side FROM sy)"""


@query(f"{BASE}, {BOUNDS}, {OUT} SELECT trace_id, obj_id, obs_ord, {r6('excursion')}, side FROM cx")
def corridor_excursion(spark, sf_dir):
    return rounded(corridor.excursion(_bounds(spark, sf_dir)).select("trace_id", "obj_id", "obs_ord", "excursion", "side"), "excursion")


@query(f"{BASE}, {BOUNDS}, {OUT}, {_runs('SELECT * FROM cx')} SELECT trace_id, obj_id, t_start, t_end, {r6('peak_m')}, side, to_end, {r6('turn_deg')}, label FROM runs")
def corridor_runs(spark, sf_dir):
    return rounded(validate.offroad_runs(corridor.excursion(_bounds(spark, sf_dir))), "peak_m", "turn_deg")


# --- events ---

BRAKE = """bp AS (SELECT trace_id, t_us AS t_start, lead(t_us) OVER w AS t_end, (lead(speed) OVER w - speed) / ((lead(t_us) OVER w - t_us) / 1e6) AS accel FROM ego WINDOW w AS (PARTITION BY trace_id ORDER BY t_us)),
bn AS (SELECT *, CASE WHEN t_start <= lag(t_end) OVER (PARTITION BY trace_id ORDER BY t_start) THEN 0 ELSE 1 END AS new FROM bp WHERE accel < -3),
br AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY t_start ROWS UNBOUNDED PRECEDING) AS run FROM bn),
brake AS (SELECT trace_id, min(t_start) AS t_start, max(t_end) AS t_end, min(accel) AS peak FROM br GROUP BY trace_id, run HAVING max(t_end) - min(t_start) >= 300000)"""


@query(f"WITH {P.EGO}, {BRAKE} SELECT trace_id, t_start, t_end, {r6('peak')}, CASE WHEN peak <= -6 THEN 'hard' ELSE 'moderate' END AS severity FROM brake")
def braking(spark, sf_dir):
    return rounded(events.braking(P.ego(spark, sf_dir)), "peak")


OVER = """ov AS (SELECT trace_id, obj_id, t_us, x_rel, y_rel, lead(x_rel) OVER w AS x1, lead(y_rel) OVER w AS y1, lead(t_us) OVER w AS t1 FROM obs WHERE abs(x_rel) >= 2 WINDOW w AS (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord)),
over AS (SELECT trace_id, obj_id, t_us + (t1 - t_us) // 2 AS t_us, CASE WHEN x_rel < 0 THEN 'vehicle_overtakes_ego' ELSE 'ego_overtakes_vehicle' END AS direction FROM ov WHERE x_rel * x1 < 0 AND abs((y_rel + y1) / 2) <= 8)"""


@query(f"WITH {P.OBS}, {OVER} SELECT * FROM over")
def overtake(spark, sf_dir):
    return events.overtakes(P.obs(spark, sf_dir)).drop("lateral_m")


CUT = "cut AS (SELECT trace_id, obj_id, t_us, x_rel FROM (SELECT *, lag(y_rel) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord) AS b FROM obs) z WHERE abs(b) > 1.9 AND abs(y_rel) <= 1.9 AND x_rel > 0 AND x_rel <= 25)"


@query(f"WITH {P.OBS}, {CUT} SELECT * FROM cut")
def cut_in(spark, sf_dir):
    return events.cut_ins(P.obs(spark, sf_dir))


STAND = """sn AS (SELECT trace_id, t_us, CASE WHEN t_us <= lag(t_us) OVER (PARTITION BY trace_id ORDER BY t_us) + 1000000 THEN 0 ELSE 1 END AS new FROM ego WHERE speed < 0.5),
sr AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM sn),
stand AS (SELECT trace_id, min(t_us) AS t_start, max(t_us) AS t_end FROM sr GROUP BY trace_id, run HAVING max(t_us) - min(t_us) >= 3000000)"""


@query(f"WITH {P.EGO}, {STAND} SELECT * FROM stand")
def standstill(spark, sf_dir):
    return events.standstills(P.ego(spark, sf_dir))


TURN = f"""tp AS (SELECT trace_id, t_us AS t_start, last(t_us) OVER w AS t_end, {WRAP.format('(last(heading_deg) OVER w - heading_deg)')} AS turn FROM ego WINDOW w AS (PARTITION BY trace_id ORDER BY t_us RANGE BETWEEN CURRENT ROW AND 3000000 FOLLOWING)),
tn AS (SELECT *, CASE WHEN t_start <= max(t_end) OVER (PARTITION BY trace_id ORDER BY t_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM tp WHERE abs(turn) >= 45),
tr AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY t_start ROWS UNBOUNDED PRECEDING) AS run FROM tn),
turns AS (SELECT trace_id, min(t_start) AS t_start, max(t_end) AS t_end, first(turn ORDER BY abs(turn) DESC, t_start) AS turn_deg FROM tr GROUP BY trace_id, run)"""


@query(f"WITH {P.EGO}, {TURN} SELECT * FROM turns")
def sharp_turn(spark, sf_dir):
    return events.sharp_turns(P.ego(spark, sf_dir))


PHEN = """ph AS (SELECT trace_id, CASE WHEN peak <= -6 THEN 'hard_braking' ELSE 'moderate_braking' END AS phenomenon FROM brake UNION ALL SELECT trace_id, direction FROM over
UNION ALL SELECT trace_id, 'short_headway' FROM head UNION ALL SELECT trace_id, 'near_miss' FROM head WHERE min_headway_s < 0.5 UNION ALL SELECT trace_id, 'cut_in' FROM cut
UNION ALL SELECT trace_id, 'standstill' FROM stand UNION ALL SELECT trace_id, 'sharp_turn' FROM turns)"""


@query(f"{BASE}, {BRAKE}, {OVER}, {HEAD}, {CUT}, {STAND}, {TURN}, {PHEN} SELECT trace_id, phenomenon, count(*) AS n FROM ph GROUP BY ALL")
def phenomena_counts(spark, sf_dir):
    return summaries.count_by(events.all_events(P.obs(spark, sf_dir), P.ego(spark, sf_dir)), "trace_id", "phenomenon")


# --- summaries ---


@query(f"WITH {P.OBS} SELECT trace_id, lane, count(*) AS n FROM obs GROUP BY ALL")
def objects_by_type(spark, sf_dir):
    return summaries.count_by(P.obs(spark, sf_dir), "trace_id", "lane")


@query(f"""WITH {P.OBS}, c AS (SELECT trace_id, lane, count(*) AS n, min({{'t': t_us, 'o': obj_id, 'r': obs_ord}}) AS f FROM obs GROUP BY ALL)
SELECT trace_id, lane, n FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, f) AS rn FROM c) z WHERE rn = 1""")
def mode_first_wins(spark, sf_dir):
    return summaries.mode_first_wins(P.obs(spark, sf_dir), ["trace_id"], "lane", ["t_us", "obj_id", "obs_ord"])


@query(f"""WITH {P.OBS}, m AS (SELECT trace_id, obj_id, count(*) AS n, median(x_rel) AS med_x, median(y_rel) AS med_y FROM obs GROUP BY ALL)
SELECT trace_id, obj_id, round(med_x, 6) + 0 AS med_x FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY med_x, obj_id) AS rn FROM m WHERE n >= 5 AND med_x > 0 AND abs(med_y) <= 1.9) z WHERE rn = 1""")
def lead_vehicle_pick(spark, sf_dir):
    return rounded(summaries.lead_vehicle(P.obs(spark, sf_dir)), "med_x")


@query(f"""WITH {P.OBS}, n AS (SELECT trace_id, y_rel, CASE WHEN y_rel - lag(y_rel) OVER (PARTITION BY trace_id ORDER BY y_rel) <= 0.5 THEN 0 ELSE 1 END AS new FROM obs),
r AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY y_rel) AS cluster FROM n), i AS (SELECT *, row_number() OVER (PARTITION BY trace_id, cluster ORDER BY y_rel) - 1 AS i, count(*) OVER (PARTITION BY trace_id, cluster) AS n FROM r)
SELECT trace_id, CAST(cluster AS BIGINT) AS cluster, n, round(y_rel, 6) + 0 AS middle FROM i WHERE i = n // 2""")
def gap_cluster_1d(spark, sf_dir):
    return rounded(summaries.gap_clusters(P.obs(spark, sf_dir).select("trace_id", "y_rel"), ["trace_id"], "y_rel", 0.5), "middle")


@query(f"WITH {P.OBS}, i AS (SELECT *, row_number() OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord) - 1 AS i, count(*) OVER (PARTITION BY trace_id, obj_id) AS n FROM obs) SELECT trace_id, obj_id, obs_ord, t_us FROM i WHERE i = n // 2")
def static_middle_obs(spark, sf_dir):
    return summaries.middle_row(P.obs(spark, sf_dir), ["trace_id", "obj_id"], ["t_us", "obs_ord"]).select("trace_id", "obj_id", "obs_ord", "t_us")


@query(f"""WITH {P.EGO}, s AS (SELECT *, coalesce(sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2), 0) AS step FROM ego WINDOW w AS (PARTITION BY trace_id ORDER BY t_us))
SELECT trace_id, seq, t_us, round(sum(step) OVER (PARTITION BY trace_id ORDER BY t_us ROWS UNBOUNDED PRECEDING), 6) + 0 AS travelled_m,
round(sum(step) OVER b - first(step) OVER b, 6) + 0 AS trail_m FROM s WINDOW b AS (PARTITION BY trace_id ORDER BY t_us RANGE BETWEEN 3000000 PRECEDING AND CURRENT ROW)""")
def trail_window(spark, sf_dir):
    return rounded(summaries.trail(P.ego(spark, sf_dir)), "travelled_m", "trail_m")


# --- catalog ---


def _catalog(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("trace_id"), F.col("s_name").alias("name"), F.lit("2024-01-01").alias("scanned_at"), F.col("s_acctbal").alias("duration_s"))


@query("""WITH c AS (SELECT s_suppkey AS trace_id, s_name AS name, '2024-01-01' AS scanned_at, s_acctbal AS duration_s FROM supplier WHERE s_nationkey < 15),
n AS (SELECT s_suppkey AS trace_id, s_name || '/new' AS name, '2024-02-02' AS scanned_at FROM supplier WHERE s_nationkey >= 10)
SELECT trace_id, coalesce(n.name, c.name) AS name, coalesce(n.scanned_at, c.scanned_at) AS scanned_at, duration_s FROM c FULL JOIN n USING (trace_id)""")
def catalog_upsert(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("trace_id"), "s_nationkey")
    rows = _catalog(spark, sf_dir).join(nation, "trace_id")
    scanned = rows.where("s_nationkey >= 10").select("trace_id", F.concat("name", F.lit("/new")).alias("name"), F.lit("2024-02-02").alias("scanned_at"))
    return summaries.upsert_identity(rows.where("s_nationkey < 15").drop("s_nationkey"), scanned, "trace_id", ["name", "scanned_at"])


def _tags(spark, sf_dir):
    return summaries.count_by(events.all_events(P.obs(spark, sf_dir), P.ego(spark, sf_dir)), "trace_id", "phenomenon").select("trace_id", F.col("phenomenon").alias("tag"), "n")


@query(f"""{BASE}, {BRAKE}, {OVER}, {HEAD}, {CUT}, {STAND}, {TURN}, {PHEN}, tags AS (SELECT trace_id, phenomenon AS tag, count(*) AS n FROM ph GROUP BY ALL),
page AS (SELECT s_suppkey AS trace_id, s_name AS name FROM supplier WHERE s_name ILIKE '%1%' AND s_suppkey IN (SELECT trace_id FROM tags WHERE tag = 'standstill') AND s_suppkey IN (SELECT trace_id FROM tags WHERE tag = 'short_headway') ORDER BY lower(s_name), s_suppkey LIMIT 20)
SELECT trace_id, name, (SELECT string_agg(tag || '=' || n, ',' ORDER BY tag || '=' || n) FROM tags t WHERE t.trace_id = page.trace_id) AS tags FROM page""")
def catalog_query(spark, sf_dir):
    return summaries.catalog_query(_catalog(spark, sf_dir).select("trace_id", "name"), _tags(spark, sf_dir), "trace_id", "%1%", ["standstill", "short_headway"], 20)


@query("SELECT count(*) AS total, count(*) FILTER (s_acctbal > 0) AS processed FROM supplier")
def catalog_stats(spark, sf_dir):
    return _catalog(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("duration_s") > 0).alias("processed"))


@query("""SELECT s_nationkey, s_suppkey, coalesce(lag(s_suppkey) OVER w, last(s_suppkey) OVER a) AS previous, coalesce(lead(s_suppkey) OVER w, first(s_suppkey) OVER a) AS next FROM supplier
WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey), a AS (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def trace_neighbor(spark, sf_dir):
    return summaries.neighbours(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_nationkey", "s_suppkey", "s_name")


@query("""SELECT c_custkey, coalesce(lag(c_custkey) OVER w, last(c_custkey) OVER a) AS previous, coalesce(lead(c_custkey) OVER w, first(c_custkey) OVER a) AS next FROM customer WHERE contains(lower(c_name), '7')
WINDOW w AS (ORDER BY lower(c_name), c_name, c_custkey), a AS (ORDER BY lower(c_name), c_name, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def name_neighbors(spark, sf_dir):
    """Previous and next over the whole order of those names that hold a 7."""
    return summaries.neighbours_in_all(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", "c_name", "7")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def manifest_tail(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


# --- variants and repairs ---


@query(f"WITH {P.OBS} SELECT trace_id, obj_id, obs_ord, round(CASE WHEN x_rel > 0 THEN greatest(1, x_rel * 0.65::DOUBLE) ELSE x_rel END, 6) + 0 AS x_rel FROM obs")
def variant_gap_scale(spark, sf_dir):
    return rounded(variants.scale_gap(P.obs(spark, sf_dir), 0.65).select("trace_id", "obj_id", "obs_ord", "x_rel"), "x_rel")


@query(f"WITH {P.OBS} SELECT trace_id, obj_id, obs_ord, round(y_rel * 0.6::DOUBLE, 6) + 0 AS y_rel FROM obs")
def variant_lateral(spark, sf_dir):
    return rounded(variants.scale_lateral(P.obs(spark, sf_dir), 0.6).select("trace_id", "obj_id", "obs_ord", "y_rel"), "y_rel")


@query(f"""WITH {P.OBS}, f AS (SELECT *, coalesce((t_us - min(t_us) OVER w) / nullif(max(t_us) OVER w - min(t_us) OVER w, 0), 0) AS f FROM obs WINDOW w AS (PARTITION BY trace_id, obj_id)),
g AS (SELECT *, CASE WHEN f <= 0.3::DOUBLE THEN 1 WHEN f >= 0.55::DOUBLE THEN 0.5 ELSE 1::DOUBLE + (0.5::DOUBLE - 1::DOUBLE) * (f - 0.3::DOUBLE) / (0.55::DOUBLE - 0.3::DOUBLE) END AS k FROM f)
SELECT trace_id, obj_id, obs_ord, round(CASE WHEN x_rel > 0 THEN greatest(1, x_rel * k) ELSE x_rel END, 6) + 0 AS x_rel FROM g""")
def variant_brake(spark, sf_dir):
    return rounded(variants.windowed_gap(P.obs(spark, sf_dir), 0.5, 0.3, 0.55).select("trace_id", "obj_id", "obs_ord", "x_rel"), "x_rel")


@query(f"""WITH {P.OBS}, s AS (SELECT *, min(t_us) OVER w AS t0, max(t_us) OVER w - min(t_us) OVER w AS span FROM obs WINDOW w AS (PARTITION BY trace_id, obj_id)),
q AS (SELECT trace_id, obj_id, obs_ord, t0 + least(1, coalesce((t_us - t0) / nullif(span, 0), 0) / 0.7::DOUBLE) * span AS tq FROM s),
k AS (SELECT trace_id, obj_id, CAST(t_us AS DOUBLE) AS t, y_rel AS y, lead(CAST(t_us AS DOUBLE)) OVER w AS t1, lead(y_rel) OVER w AS y1 FROM obs WINDOW w AS (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord))
SELECT q.trace_id, q.obj_id, q.obs_ord, round((y + CASE WHEN t1 > t THEN (y1 - y) * (tq - t) / (t1 - t) ELSE 0 END) * 0.8::DOUBLE, 6) + 0 AS y_rel FROM q ASOF JOIN k ON q.trace_id = k.trace_id AND q.obj_id = k.obj_id AND q.tq >= k.t""")
def variant_time_warp(spark, sf_dir):
    return rounded(variants.time_warp_lateral(P.obs(spark, sf_dir), 0.7, 0.8).select("trace_id", "obj_id", "obs_ord", "y_rel"), "y_rel")


@query(f"""WITH {P.OBS}, h AS (SELECT *, abs(x_rel) < 20 AS hit FROM obs), b AS (SELECT *, bool_and(hit) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us DESC, obs_ord DESC ROWS UNBOUNDED PRECEDING) AS tail,
row_number() OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord) AS n FROM h) SELECT trace_id, obj_id, obs_ord FROM b WHERE NOT tail OR n = 1""")
def trim_trailing_overlap(spark, sf_dir):
    return variants.trim_trailing(P.obs(spark, sf_dir), F.abs("x_rel") < 20).select("trace_id", "obj_id", "obs_ord")


@query(f"""WITH {P.OBS}, g AS (SELECT trace_id, obj_id, obs_ord, greatest(10000000 - t_us, t_us - 15000000, 0) AS g FROM obs)
SELECT trace_id, obj_id, obs_ord, round(CASE WHEN g <= 0 THEN 1 WHEN g >= 500000 THEN 0 ELSE 0.5 * (1 + cos(g * pi() / 500000)) END, 6) AS weight FROM g""")
def blend_weight(spark, sf_dir):
    return P.obs(spark, sf_dir).select("trace_id", "obj_id", "obs_ord", F.round(variants.blend_weight(F.col("t_us"), F.lit(10_000_000), F.lit(15_000_000)), 6).alias("weight"))


# --- files and sessions ---


FILES = """e AS (SELECT 't' || s_suppkey AS name, min('e/t' || s_suppkey) AS ego_path FROM supplier GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY lower(name)) AS rn FROM e),
n AS (SELECT 't' || s_suppkey || '__ref-QC_IND' AS stem, 'a/' || s_suppkey AS path FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT 'T' || s_suppkey || '_cut', 'b/' || s_suppkey FROM supplier WHERE s_nationkey BETWEEN 8 AND 14 UNION ALL SELECT 'x' || s_suppkey, 'c/' || s_suppkey FROM supplier WHERE s_nationkey >= 23),
x AS (SELECT path, name, ego_path, 'exact' AS how FROM n JOIN e ON name = regexp_replace(stem, '(?i)__ref-?qc_ind$', '')),
i AS (SELECT path, stem, (SELECT count(*) FROM r WHERE lower(name) <= lower(stem)) AS idx FROM n WHERE path NOT IN (SELECT path FROM x)),
p AS (SELECT path, arg_max(name, rn) AS name, arg_max(ego_path, rn) AS ego_path, 'prefix' AS how FROM i JOIN r ON rn <= idx AND rn > idx - 5 AND starts_with(lower(stem), lower(name)) GROUP BY path),
c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY how, path) = 1 AS won FROM (SELECT * FROM x UNION ALL SELECT * FROM p) z)"""


def _files(spark, sf_dir):
    """(ego files, annotations) named after suppliers: with the usual ending, with a longer name, and of no trace."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey").cast("string")
    ego = s.select(F.concat(F.lit("t"), k).alias("name"), F.concat(F.lit("e/t"), k).alias("path"))
    kinds = (("s_nationkey < 10", "t", "__ref-QC_IND", "a/"), ("s_nationkey between 8 and 14", "T", "_cut", "b/"), ("s_nationkey >= 23", "x", "", "c/"))
    notes = [s.where(c).select(F.concat(F.lit(a), k, F.lit(b)).alias("stem"), F.concat(F.lit(p), k).alias("path")) for c, a, b, p in kinds]
    return ego, notes[0].union(notes[1]).union(notes[2])


@query(f"WITH {FILES} SELECT name, ego_path, path AS annotation_path, how FROM c WHERE won")
def pair_by_name(spark, sf_dir):
    return traces.pair_files(*_files(spark, sf_dir))


UNMATCHED = "u AS (SELECT 'ego' AS kind, name FROM e WHERE name NOT IN (SELECT name FROM c) UNION ALL SELECT 'annotation', path FROM n WHERE path NOT IN (SELECT path FROM c))"


@query(f"WITH {FILES}, {UNMATCHED} SELECT * FROM u")
def unmatched_names(spark, sf_dir):
    return traces.unmatched(*_files(spark, sf_dir))


@query(f"""WITH {FILES}, {UNMATCHED}, s AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name) AS rn FROM u)
SELECT (SELECT count(*) FROM supplier) AS ego_files, (SELECT count(*) FROM e) AS traces, (SELECT count(*) FROM n) AS annotation_files, (SELECT count(*) FROM c WHERE won) AS matched, (SELECT count(*) FROM c WHERE NOT won) AS duplicates,
(SELECT count(*) FROM u WHERE kind = 'annotation') AS unmatched_annotations, (SELECT count(*) FROM supplier) - (SELECT count(*) FROM e) AS name_collisions, (SELECT count(*) FROM u WHERE kind = 'ego') AS unmatched_traces,
(SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM s WHERE kind = 'ego' AND rn <= 10) AS ego_examples, (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM s WHERE kind = 'annotation' AND rn <= 10) AS annotation_examples""")
def scan_counts(spark, sf_dir):
    return traces.scan_counts(*_files(spark, sf_dir))


@query("SELECT CASE WHEN contains(substr(p, 3), '/') THEN split_part(p, '/', 2) ELSE '.' END AS subtree, count(*) AS n FROM (SELECT 'c/' || CASE WHEN s_nationkey = 0 THEN '' ELSE 'n' || s_nationkey || '/d/' END || s_suppkey AS p FROM supplier) z GROUP BY 1")
def files_by_subtree(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    below = F.when(F.col("s_nationkey") == 0, "").otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/d/")))
    return traces.files_by_subtree(s.select(F.concat(F.lit("c/"), below, F.col("s_suppkey").cast("string")).alias("path")), "c")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) + 1800000000 AS BIGINT) AS end_us, count(*) AS n FROM r GROUP BY user_id, run""")
def events_sessions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = S.sessions(rows, "ts", ["user_id"])
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""WITH p AS (SELECT s_suppkey AS trace_id, CAST((s_suppkey * 37 % 120) - 60 AS DOUBLE) AS lat, CAST((s_suppkey * 91 % 358) - 179 AS DOUBLE) AS lon FROM supplier),
k AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone, 1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE) AS n FROM p),
t AS (SELECT *, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam, 2 * sqrt(n) / (1 + n) AS e FROM k),
u AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS tt FROM t),
v AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta, 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a,
n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM u)
SELECT trace_id, zone, round(500000 + 0.9996::DOUBLE * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996::DOUBLE * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS northing FROM v""")
def utm_origin(spark, sf_dir):
    s = F.col("s_suppkey")
    p = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(s.alias("trace_id"), (s * 37 % 120 - 60).cast("double").alias("lat"), (s * 91 % 358 - 179).cast("double").alias("lon"))
    east, north = X.utm(F.col("lat"), F.col("lon"))
    return p.select("trace_id", X.utm_zone(F.col("lon")).alias("zone"), F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query(f"""WITH RECURSIVE {P.OBS}, o AS MATERIALIZED (SELECT trace_id, obj_id, obs_ord, t_us, y_rel AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY trace_id, obj_id) AS n FROM obs WINDOW w AS (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord)),
f AS (SELECT trace_id, obj_id, i, t_us, v FROM o WHERE i = 1 UNION ALL SELECT o.trace_id, o.obj_id, o.i, o.t_us, sign(o.v) * least(abs(o.v), abs(f.v) + 0.5::DOUBLE * (o.t_us - f.t_us) / 1000000) FROM f JOIN o ON o.trace_id = f.trace_id AND o.obj_id = f.obj_id AND o.i = f.i + 1),
g AS MATERIALIZED (SELECT f.*, o.obs_ord, o.n FROM f JOIN o USING (trace_id, obj_id, i)),
b AS (SELECT trace_id, obj_id, obs_ord, i, t_us, v FROM g WHERE i = n UNION ALL SELECT g.trace_id, g.obj_id, g.obs_ord, g.i, g.t_us, sign(g.v) * least(abs(g.v), abs(b.v) + 0.5::DOUBLE * (b.t_us - g.t_us) / 1000000) FROM b JOIN g ON g.trace_id = b.trace_id AND g.obj_id = b.obj_id AND g.i = b.i - 1)
SELECT trace_id, obj_id, obs_ord, {r6('v')} FROM b""")
def rate_limit(spark, sf_dir):
    """Lateral corrections of every track, rate-limited both ways."""
    rows = P.obs(spark, sf_dir).select("trace_id", "obj_id", "obs_ord", "t_us", F.col("y_rel").alias("v"))
    return rounded(variants.rate_limited(rows, ["trace_id", "obj_id"], "t_us", "v", ["obs_ord"]).drop("t_us"), "v")


# --- fixes ---

CLAMP = f"""{BASE}, {BOUNDS}, {OUT}, {_runs('SELECT * FROM cx')},
lb AS (SELECT c.*, r.label FROM cx c LEFT JOIN runs r ON c.trace_id = r.trace_id AND c.obj_id = r.obj_id AND c.excursion > 0 AND c.t_us BETWEEN r.t_start AND r.t_end),
dl AS (SELECT *, coalesce(label = 'departure', false) AS departed, CASE WHEN side = 'left' THEN -excursion WHEN side = 'right' THEN excursion ELSE 0 END AS signed FROM lb),
de AS (SELECT *, NOT departed AND abs(signed) > 1.5 AS too_large, CASE WHEN departed OR abs(signed) > 1.5 THEN 0 ELSE signed END AS delta FROM dl),
l1 AS (SELECT *, min(abs(delta) - t_us / 2000000.0::DOUBLE) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord ROWS UNBOUNDED PRECEDING) + t_us / 2000000.0::DOUBLE AS s1 FROM de),
l2 AS (SELECT *, sign(delta) * (min(s1 + t_us / 2000000.0::DOUBLE) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t_us / 2000000.0::DOUBLE) AS d FROM l1),
cl AS (SELECT * EXCLUDE (y_rel), abs(d) >= 0.05 AS clamped, y_rel + CASE WHEN abs(d) >= 0.05 THEN d ELSE 0 END AS y_rel FROM l2)"""


@query(f"""{CLAMP} SELECT trace_id, obj_id, obs_ord, {r6('y_rel')}, round(CASE WHEN clamped THEN ey + x_rel * sin(eyaw) + y_rel * cos(eyaw) ELSE gy END, 6) + 0 AS gy, clamped, departed, too_large FROM cl""")
def clamp_offroad(spark, sf_dir):
    return rounded(fixes.clamp_offroad(_bounds(spark, sf_dir)).select("trace_id", "obj_id", "obs_ord", "y_rel", "gy", "clamped", "departed", "too_large"), "y_rel", "gy")


@query(f"""{CLAMP}, tr AS (SELECT *, abs(x_rel) < 20 AS hit FROM cl), tb AS (SELECT *, bool_and(hit) OVER (PARTITION BY trace_id, obj_id ORDER BY t_us DESC, obs_ord DESC ROWS UNBOUNDED PRECEDING) AS tail, row_number() OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord) AS n FROM tr),
sm AS (SELECT trace_id, obj_id, count(*) FILTER (clamped AND (NOT tail OR n = 1)) AS n_fixed, count(*) FILTER (tail AND n > 1) AS dropped, count(*) FILTER (departed AND (NOT tail OR n = 1)) AS departures, count(*) FILTER (too_large AND (NOT tail OR n = 1)) AS too_large FROM tb GROUP BY 1, 2)
SELECT * FROM sm WHERE n_fixed + dropped + departures + too_large > 0""")
def fix_summary(spark, sf_dir):
    after = variants.trim_trailing(fixes.clamp_offroad(_bounds(spark, sf_dir)).withColumn("fixed", F.col("clamped")), F.abs("x_rel") < 20)
    return fixes.fix_summary(P.obs(spark, sf_dir), after)


@query()
def apply_fixes(spark, sf_dir):
    """All fixes of every trace: smoothing, clamp and trimming."""
    posed = written(_glob(ship(spark), sf_dir), "posed")
    fixed = fixes.apply_fixes(posed, _kinematic(posed), P.edges(spark, sf_dir))
    return fixed.select("trace_id", "obj_id", "obs_ord", "x_rel", "y_rel", "gx", "gy", "heading", "fixed", "departed", "too_large")


# --- scene, catalog and classes ---

LATLON = f"WITH {P.EGO}, ll AS (SELECT *, 48 + y_m / 111320 AS lat, 9 + x_m / 111320 AS lon, speed * cos(radians(heading_deg)) AS v_north, -speed * sin(radians(heading_deg)) AS v_east FROM ego)"


def _latlon(spark, sf_dir):
    h = F.radians("heading_deg")
    return P.ego(spark, sf_dir).withColumns({"lat": 48 + F.col("y_m") / 111320, "lon": 9 + F.col("x_m") / 111320, "v_north": F.col("speed") * F.cos(h), "v_east": -F.col("speed") * F.sin(h)})


@query(f"""{LATLON} SELECT trace_id, seq, (t_us - min(t_us) OVER (PARTITION BY trace_id)) / 1000000.0::DOUBLE AS t_s, (heading_deg + 90) % 360 AS yaw_deg, heading_deg % 360 AS bearing_deg, round(sqrt(v_north ** 2 + v_east ** 2), 6) AS speed_mps,
round(v_east * cos(radians(heading_deg + 90)) + v_north * sin(radians(heading_deg + 90)), 6) + 0 AS v_fwd_mps, round(v_north * cos(radians(heading_deg + 90)) - v_east * sin(radians(heading_deg + 90)), 6) + 0 AS v_lat_mps FROM ll""")
def scene_poses(spark, sf_dir):
    return rounded(summaries.scene_poses(_latlon(spark, sf_dir)), "speed_mps", "v_fwd_mps", "v_lat_mps")


@query(f"""{LATLON}, g AS (SELECT trace_id, count(*) AS n, min(t_us) AS t0, max(t_us) AS t1, arg_min(lat, seq) AS lat0, arg_min(lon, seq) AS lon0, min(lat) AS a, min(lon) AS b, max(lat) AS c, max(lon) AS d FROM ll GROUP BY 1)
SELECT trace_id, n, t0, t1, (t1 - t0) / 1000000.0::DOUBLE AS duration_s, round(lat0, 6) AS lat0, round(lon0, 6) AS lon0, round(a - 100 / 111320.0::DOUBLE, 6) AS min_lat, round(c + 100 / 111320.0::DOUBLE, 6) AS max_lat,
round(b - 100 / (111320 * greatest(0.1, cos(radians(lat0)))), 6) AS min_lon, round(d + 100 / (111320 * greatest(0.1, cos(radians(lat0)))), 6) AS max_lon FROM g""")
def trace_extents(spark, sf_dir):
    return rounded(summaries.extents(_latlon(spark, sf_dir)), "lat0", "lon0", "min_lat", "max_lat", "min_lon", "max_lon")


@query(f"WITH {P.OBS}, f AS (SELECT trace_id, bool_or(x_rel > 35 AND trace_id % 2 = 0) AS a, bool_or(y_rel > 3.5 AND trace_id % 3 = 0) AS b FROM obs GROUP BY 1) SELECT trace_id, concat_ws('__', CASE WHEN a THEN 'fixed' END, CASE WHEN b THEN 'predicted' END) AS suffix FROM f")
def provenance(spark, sf_dir):
    t = F.col("trace_id")
    return summaries.provenance(P.obs(spark, sf_dir).withColumns({"fixed": (F.col("x_rel") > 35) & (t % 2 == 0), "synthetic": (F.col("y_rel") > 3.5) & (t % 3 == 0)}))


@query("SELECT s_name, count(*) OVER () AS total FROM supplier WHERE contains(lower(s_name), 'r#00000000') ORDER BY lower(s_name), s_name LIMIT 5 OFFSET 2")
def trace_page(spark, sf_dir):
    return summaries.page(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_name", "R#00000000", 5, 2)


#: Words of part types stand for object types.
TYPES = "t AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN ' Car ' WHEN 1 THEN 'Semi-Trailer' WHEN 2 THEN 'Pedestrian' WHEN 3 THEN 'unknown' WHEN 4 THEN 'Motorbike' WHEN 5 THEN 'Traffic Sign' WHEN 6 THEN 'Van' WHEN 7 THEN 'Highly Reflective Marker' ELSE 'Truck' END AS k, 3 + p_size % 8 + 0.25::DOUBLE AS ln, 1.5::DOUBLE + p_size % 3 * 0.25::DOUBLE AS wd FROM part)"


@query(f"""WITH {TYPES}, m AS (SELECT *, lower(k) AS w FROM t) SELECT p_partkey, CASE WHEN w LIKE '%pedestrian%' OR w LIKE '%person%' THEN 'PEDESTRIAN' WHEN w LIKE '%trailer%' THEN 'TRAILER' WHEN w LIKE '%unknown%' THEN 'UNKNOWN' ELSE 'VEHICLE' END AS actor,
CASE WHEN trim(w) IN ('car', 'truck', 'van', 'bus', 'motorbike') THEN trim(w) ELSE 'car' END AS category, CASE WHEN k IN ('Traffic Sign', 'Highly Reflective Marker') THEN 'pole' ELSE 'none' END AS static,
CASE WHEN w LIKE '%pedestrian%' THEN 'box' WHEN w LIKE '%truck%' OR w LIKE '%trailer%' OR ln > 9 THEN 'CONFIGURABLE_SEMI_TRUCK' WHEN w LIKE '%motorbike%' THEN 'GENERIC_DAELIM_MOTORBIKE' ELSE 'GENERIC_YARIS' END AS model,
CASE WHEN w LIKE '%pedestrian%' OR w LIKE '%truck%' OR w LIKE '%trailer%' OR ln > 9 THEN NULL WHEN w LIKE '%motorbike%' THEN round(ln / 1.95::DOUBLE, 4) ELSE round(ln / 4.1::DOUBLE, 4) END AS scale_x, CASE WHEN w NOT LIKE '%pedestrian%' THEN round(wd / 1.8::DOUBLE, 4) END AS scale_y,
trim(regexp_replace(k, '[^a-zA-Z0-9_-]+', '-', 'g'), '-') AS slug FROM m""")
def object_classes(spark, sf_dir):
    kinds = F.array(*map(F.lit, (" Car ", "Semi-Trailer", "Pedestrian", "unknown", "Motorbike", "Traffic Sign", "Van", "Highly Reflective Marker", "Truck")))
    k, size = F.element_at(kinds, (F.col("p_partkey") % 9 + 1).cast("int")), F.col("p_size")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", k.alias("k"), (3 + size % 8 + 0.25).alias("ln"), (1.5 + size % 3 * 0.25).alias("wd"))
    rows = rows.withColumn("g", X.model_guess(F.col("k"), F.col("ln"), F.col("wd")))
    return rows.select("p_partkey", X.actor_type(F.col("k")).alias("actor"), X.scenario_category(F.col("k")).alias("category"), X.static_type(F.col("k")).alias("static"), "g.*", X.slug(F.col("k")).alias("slug"))


@query(f"WITH {P.EDGES} SELECT trace_id, line_id, t_us, CASE WHEN y > 0 THEN 'left' ELSE 'right' END AS side FROM edges")
def line_sides(spark, sf_dir):
    return P.edges(spark, sf_dir).select("trace_id", "line_id", "t_us", X.line_side(F.col("points")).alias("side"))


# --- prediction and reports ---

ENDS = """en AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord) AS i, row_number() OVER (PARTITION BY trace_id, obj_id ORDER BY t_us DESC, obs_ord DESC) AS j, count(*) OVER (PARTITION BY trace_id, obj_id) AS n FROM posed)"""


@query(f"""{BASE}, {ENDS}, pl AS (SELECT b.trace_id, b.obj_id, b.n, b.t_us, b.gx, b.gy, b.heading, b.x_rel, a.gx AS px, a.gy AS py, (b.t_us - a.t_us) / 1e6 AS dt FROM en b LEFT JOIN en a ON a.trace_id = b.trace_id AND a.obj_id = b.obj_id AND a.j = 2 WHERE b.j = 1),
sp AS (SELECT *, CASE WHEN n < 2 THEN 25 WHEN dt > 0 THEN sqrt((gx - px) ** 2 + (gy - py) ** 2) / dt ELSE 0 END AS speed FROM pl),
yw AS (SELECT *, CASE WHEN n >= 2 AND speed > 0.1 THEN atan2(gy - py, gx - px) ELSE radians(heading) END AS yaw, CASE WHEN x_rel < 0 THEN 60 ELSE 20 END AS steps FROM sp)
SELECT trace_id, obj_id, CAST(s AS INTEGER) AS step, t_us + s * 200000 AS t_us, round(gx + speed * s * 0.2::DOUBLE * cos(yaw), 5) + 0 AS gx, round(gy + speed * s * 0.2::DOUBLE * sin(yaw), 5) + 0 AS gy FROM (SELECT *, unnest(range(1, steps + 1)) AS s FROM yw) z""")
def predict_ungoverned(spark, sf_dir):
    out = predict.extrapolate(_glob(spark, sf_dir)).drop("speed")
    return out.withColumns({c: F.round(F.col(c), 5) + 0.0 for c in ("gx", "gy")})


@query()
def predict_steered(spark, sf_dir):
    return predict.steered(_glob(ship(spark), sf_dir), P.ego(spark, sf_dir))


@query()
def predict_governed(spark, sf_dir):
    return predict.governed(_glob(ship(spark), sf_dir), P.ego(spark, sf_dir))


@query(f"""{BASE}, {ENDS}, f AS MATERIALIZED (SELECT a.trace_id, a.obj_id, a.t_us, a.gx, a.gy, a.y_rel, a.width, a.lane, CASE WHEN b.t_us > a.t_us THEN sqrt((b.gx - a.gx) ** 2 + (b.gy - a.gy) ** 2) / ((b.t_us - a.t_us) / 1e6) ELSE 0 END AS v FROM en a JOIN en b ON a.trace_id = b.trace_id AND a.obj_id = b.obj_id AND a.i = 1 AND b.i = 2),
l AS MATERIALIZED (SELECT a.trace_id, a.obj_id, a.t_us, a.gx, a.gy, a.y_rel, a.width, a.lane, CASE WHEN a.t_us > b.t_us THEN sqrt((b.gx - a.gx) ** 2 + (b.gy - a.gy) ** 2) / ((a.t_us - b.t_us) / 1e6) ELSE 0 END AS v FROM en a JOIN en b ON a.trace_id = b.trace_id AND a.obj_id = b.obj_id AND a.j = 1 AND b.j = 2),
c AS (SELECT l.trace_id, l.obj_id AS a, f.obj_id AS b, abs(sqrt((f.gx - l.gx) ** 2 + (f.gy - l.gy) ** 2) / ((f.t_us - l.t_us) / 1e6) - (l.v + f.v) / 2) AS error FROM l JOIN f ON l.trace_id = f.trace_id AND l.lane = f.lane AND l.obj_id <> f.obj_id AND f.t_us > l.t_us AND f.t_us <= l.t_us + 3000000 AND abs(f.y_rel - l.y_rel) <= 2 AND abs(f.width - l.width) <= 0.6)
SELECT trace_id, a, b, round(error, 6) AS error FROM c WHERE error <= 8""")
def continuation_candidates(spark, sf_dir):
    return rounded(predict.continuation_candidates(predict.track_ends(_glob(spark, sf_dir))), "error")


@query()
def continuations(spark, sf_dir):
    return predict.continuations(predict.track_ends(_glob(spark, sf_dir)))


@query()
def reports(spark, sf_dir):
    glob = _written_glob(spark, sf_dir)
    phenomena = summaries.count_by(events.all_events(glob, P.ego(spark, sf_dir)), "trace_id", "phenomenon")
    return R.text_report(_issues(spark, sf_dir, glob), phenomena)


@query()
def scene_json(spark, sf_dir):
    return R.scene_json(P.obs(spark, sf_dir), P.ego(spark, sf_dir))


# --- repair and road ---


@query()
def smooth_tracks(spark, sf_dir):
    """Every track, smoothed where a kinematic issue flags it."""
    posed = written(_glob(ship(spark), sf_dir), "posed")
    windows = _kinematic(posed).where("obj_id is not null").select("trace_id", "obj_id", (F.col("t_start") - 500_000).alias("t_start"), (F.col("t_end") + 500_000).alias("t_end"))
    return repair.smooth_tracks(posed, windows).select("trace_id", "obj_id", "obs_ord", "gx", "gy", "heading", "fixed")


ARC = f"""sd AS (SELECT *, coalesce(sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2), 0) AS d FROM ego WINDOW w AS (PARTITION BY trace_id ORDER BY t_us)),
sc AS (SELECT *, sum(d) OVER (PARTITION BY trace_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS s FROM sd),
arc AS (SELECT *, lead(s) OVER w AS s1, lead(x_m) OVER w AS x1, lead(y_m) OVER w AS y1 FROM sc WINDOW w AS (PARTITION BY trace_id ORDER BY t_us))"""


@query(f"WITH {P.EGO}, {ARC} SELECT trace_id, seq, round(s, 6) AS s FROM arc")
def road_ref_arclength(spark, sf_dir):
    return rounded(road.arc_length(P.ego(spark, sf_dir)).select("trace_id", "seq", "s"), "s")


@query(f"""WITH {P.EGO}, {ARC}, g AS (SELECT *, unnest(range(CAST(floor(s / 15) AS BIGINT) + 1, CAST(floor(s1 / 15) AS BIGINT) + 1)) AS k FROM arc WHERE s1 > s)
SELECT trace_id, k, k * 15.0::DOUBLE AS s, round(x_m + (x1 - x_m) * (k * 15 - s) / (s1 - s), 5) + 0 AS x_m, round(y_m + (y1 - y_m) * (k * 15 - s) / (s1 - s), 5) + 0 AS y_m FROM g""")
def arc_resample(spark, sf_dir):
    return road.resample(P.ego(spark, sf_dir)).withColumns({c: F.round(F.col(c), 5) + 0.0 for c in ("x_m", "y_m")})


@query(f"""{ALL_ISSUES} SELECT o.trace_id, o.obj_id, o.obs_ord, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
FROM obs o JOIN iss i ON o.trace_id = i.trace_id AND o.obj_id = i.obj_id AND o.t_us BETWEEN i.t_start - 300000 AND i.t_end + 300000 GROUP BY ALL""")
def worst_active_issue(spark, sf_dir):
    glob = _written_glob(spark, sf_dir)
    return road.worst_active(glob, _issues(spark, sf_dir, glob))


LINE = f"""WITH RECURSIVE {P.EGO}, sd AS (SELECT *, coalesce(sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2), 0) AS d FROM ego WINDOW w AS (PARTITION BY trace_id ORDER BY t_us)),
sc AS MATERIALIZED (SELECT trace_id, seq, t_us, x_m, y_m, heading_deg, sum(d) OVER (PARTITION BY trace_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS s FROM sd),
nx AS MATERIALIZED (SELECT a.trace_id, a.seq, min(b.seq) AS after FROM sc a JOIN sc b ON a.trace_id = b.trace_id AND b.seq > a.seq AND b.s >= a.s + 5 GROUP BY 1, 2),
jump AS (SELECT trace_id, CAST(0 AS BIGINT) AS seq FROM supplier JOIN (SELECT DISTINCT trace_id FROM sc) z ON trace_id = s_suppkey UNION ALL SELECT nx.trace_id, nx.after FROM jump JOIN nx USING (trace_id, seq)),
line AS MATERIALIZED (SELECT sc.* FROM sc JOIN (SELECT trace_id, seq FROM jump UNION SELECT trace_id, max(seq) FROM sc GROUP BY 1) k USING (trace_id, seq))"""


@query(f"{LINE} SELECT trace_id, seq, {r6('s')} FROM line")
def reference_line(spark, sf_dir):
    return rounded(road.reference_line(P.ego(ship(spark), sf_dir)).select("trace_id", "seq", "s"), "s")


@query(f"""{LINE}, pv AS (SELECT *, radians((heading_deg + 90) % 360) AS hdg, lead(s) OVER w - s AS length, radians({WRAP.format('(lead(heading_deg) OVER w - heading_deg)')}) AS turn FROM line WINDOW w AS (PARTITION BY trace_id ORDER BY seq))
SELECT trace_id, {r6('s', 'hdg', 'length')}, round(turn / length, 6) + 0 AS curvature, CASE WHEN abs(turn / length) < 0.0001 THEN 'line' ELSE 'arc' END AS shape FROM pv WHERE length > 0.000001""")
def plan_view(spark, sf_dir):
    return rounded(road.plan_view(road.reference_line(P.ego(ship(spark), sf_dir))).drop("x_m", "y_m"), "s", "hdg", "length", "curvature")


@query(f"""{BASE}, {LINE.removeprefix(f'WITH RECURSIVE {P.EGO}, ')}, pq AS (SELECT p.trace_id, obj_id, obs_ord, gx, gy, arg_min({{'s': s, 'x': l.x_m, 'y': l.y_m, 'h': radians((heading_deg + 90) % 360)}}, {{'d': (l.x_m - gx) ** 2 + (l.y_m - gy) ** 2, 'q': seq}}) AS r
FROM (SELECT trace_id, obj_id, obs_ord, gx, gy FROM posed) p JOIN line l USING (trace_id) GROUP BY ALL)
SELECT trace_id, obj_id, obs_ord, round(r.s + cos(r.h) * (gx - r.x) + sin(r.h) * (gy - r.y), 5) + 0 AS s, round(cos(r.h) * (gy - r.y) - sin(r.h) * (gx - r.x), 5) + 0 AS t FROM pq""".replace("WITH ego", "WITH RECURSIVE ego", 1))
def project_to_road(spark, sf_dir):
    points = _glob(ship(spark), sf_dir).select("trace_id", "obj_id", "obs_ord", F.col("gx").alias("x"), F.col("gy").alias("y"))
    out = road.project_to_road(points, road.reference_line(P.ego(spark, sf_dir)))
    return out.select("trace_id", "obj_id", "obs_ord", *((F.round(c, 5) + 0.0).alias(c) for c in ("s", "t")))


@query(f"""{BASE}, cs AS (SELECT *, (coalesce(lead(t_us) OVER w, t_us) - coalesce(lag(t_us) OVER w, t_us)) / 1e6 AS dt, sqrt((coalesce(lead(gx) OVER w, gx) - coalesce(lag(gx) OVER w, gx)) ** 2 + (coalesce(lead(gy) OVER w, gy) - coalesce(lag(gy) OVER w, gy)) ** 2) AS d FROM posed WINDOW w AS (PARTITION BY trace_id, obj_id ORDER BY t_us, obs_ord))
SELECT trace_id, obj_id, obs_ord, round(CASE WHEN dt > 0 THEN d / dt ELSE 0 END, 5) AS speed_mps FROM cs""")
def central_speeds(spark, sf_dir):
    out = road.central_speeds(_glob(spark, sf_dir), ["trace_id", "obj_id"], "gx", "gy")
    return out.select("trace_id", "obj_id", "obs_ord", F.round("speed_mps", 5).alias("speed_mps"))


@query(f"""{LINE}, fm AS (SELECT s_suppkey AS trace_id, k AS ord, k * 3700000 AS t_us, CAST((s_suppkey + k * k) % 4 AS INTEGER) AS num_lanes FROM supplier CROSS JOIN (SELECT range AS k FROM range(0, 12)) r),
fp AS (SELECT f.*, coalesce((SELECT min(seq) FROM ego e WHERE e.trace_id = f.trace_id AND e.t_us >= f.t_us), 399) AS seq FROM fm f WHERE num_lanes > 0),
fq AS (SELECT f.trace_id, f.ord, f.num_lanes, e.x_m AS gx, e.y_m AS gy, arg_min({{'s': s, 'x': l.x_m, 'y': l.y_m, 'h': radians((l.heading_deg + 90) % 360)}}, {{'d': (l.x_m - e.x_m) ** 2 + (l.y_m - e.y_m) ** 2, 'q': l.seq}}) AS r FROM fp f JOIN ego e USING (trace_id, seq) JOIN line l USING (trace_id) GROUP BY ALL),
fw AS (SELECT trace_id, CAST(floor((r.s + cos(r.h) * (gx - r.x) + sin(r.h) * (gy - r.y)) / 30) AS BIGINT) AS "window", num_lanes, count(*) AS n, min(ord) AS f FROM fq GROUP BY ALL)
SELECT trace_id, "window", arg_min(num_lanes, {{'n': -n, 'f': f}}) AS num_lanes FROM fw GROUP BY 1, 2""")
def lanes_by_window(spark, sf_dir):
    s = F.col("s_suppkey")
    meta = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(s.alias("trace_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("ord"))
    meta = meta.withColumns({"t_us": F.col("ord") * 3_700_000, "num_lanes": ((F.col("trace_id") + F.col("ord") * F.col("ord")) % 4).cast("int")})
    ego = P.ego(ship(spark), sf_dir)
    return road.lanes_by_window(meta, ego, road.reference_line(ego))


@query(f"""{LINE}, wy AS (SELECT s_suppkey AS trace_id, w AS way_id, k AS ord, CAST(k * 40 AS DOUBLE) AS x, CAST((w - 2) * 12 + (s_suppkey + w * k) % 7 * 3 AS DOUBLE) AS y FROM supplier CROSS JOIN (SELECT range AS w FROM range(0, 5)) a CROSS JOIN (SELECT range AS k FROM range(0, 21)) b WHERE s_suppkey % 6 <> 0),
sa AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n FROM line),
sm AS (SELECT trace_id, seq, way_id, min(sqrt((x_m - x) ** 2 + (y_m - y) ** 2)) AS d FROM sa JOIN wy USING (trace_id) WHERE i % greatest(1, n // 30) = 0 GROUP BY ALL),
wm AS (SELECT trace_id, way_id, avg(d) AS m FROM sm GROUP BY ALL), wb AS (SELECT trace_id, arg_min(way_id, {{'m': round(m, 9), 'w': way_id}}) AS way_id, min(m) AS mean_m FROM wm GROUP BY 1)
SELECT trace_id, way_id, {r6('mean_m')} FROM wb WHERE mean_m <= 20""")
def match_way(spark, sf_dir):
    s = F.col("s_suppkey")
    ways = spark.read.parquet(f"{sf_dir}/supplier.parquet").where(s % 6 != 0).select(s.alias("trace_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("way_id"))
    ways = ways.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))))
    w, k = F.col("way_id"), F.col("ord")
    ways = ways.withColumns({"x": (k * 40).cast("double"), "y": ((w - 2) * 12 + (F.col("trace_id") + w * k) % 7 * 3).cast("double")})
    return rounded(road.match_way(road.reference_line(P.ego(ship(spark), sf_dir)), ways), "mean_m")


@query()
def lane_sections(spark, sf_dir):
    """Lane sections of every trace, from markings every metre whose number and distance vary along the road."""
    ego = P.ego(ship(spark), sf_dir)
    line = written(road.reference_line(ego), "line")  # read by four projections
    s = F.col("trace_id")
    marks = ego.select("trace_id", F.col("x_m").alias("x"), F.explode(F.array(*map(F.lit, (-2, -1, 0, 1)))).alias("n"))
    marks = marks.withColumn("k", F.floor(F.col("x") / 120)).where((F.col("n") > -2) | ((s + F.col("k")) % 3 > 0))
    marks = marks.select("trace_id", "x", (F.col("n") * (3.2 + (s + F.col("k")) % 2 * 0.4) + 1.7).alias("y"))
    posed = _glob(spark, sf_dir).select("trace_id", F.col("gx").alias("x"), F.col("gy").alias("y"), "lane")
    meta = ego.where("seq % 40 = 0").select("trace_id", "t_us", F.col("seq").alias("ord"), (F.lit(3) + 0 * s).cast("int").alias("num_lanes"))
    majority = ego.select("trace_id").distinct().select("trace_id", F.lit(3).alias("num_lanes"), (s % 3).cast("int").alias("ego_lane"), F.when(s % 5 == 0, 4).alias("hint"))
    return lanes.lane_sections(line, marks, posed, road.lanes_by_window(meta, ego, line), majority)
