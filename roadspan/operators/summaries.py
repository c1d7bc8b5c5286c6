"""Grouped summaries with the reference's tie rules, catalog tables, pages and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspan.shared import written


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def mode_first_wins(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Most frequent non-empty value per key; of equally frequent ones the one met first."""
    counts = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("first"), F.col(value).alias("v"))).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("b.v").alias(value), (-F.col("b.less")).alias("n"))


def lead_vehicle(obs: DataFrame) -> DataFrame:
    """Per trace the closest track ahead in the own lane, by exact medians; ties go to the smaller id."""
    med = obs.groupBy("trace_id", "obj_id").agg(F.count("*").alias("n"), F.percentile("x_rel", F.lit(0.5)).alias("med_x"), F.percentile("y_rel", F.lit(0.5)).alias("med_y"))
    fit = med.where("n >= 5 and med_x > 0 and abs(med_y) <= 1.9")
    return fit.groupBy("trace_id").agg(F.min(F.struct("med_x", "obj_id")).alias("b")).select("trace_id", "b.obj_id", "b.med_x")


def issue_report(issues: DataFrame) -> DataFrame:
    """Counts per trace for the report: total, by severity, fixed and unfixed, and a map by category.

    Issues may carry a boolean ``fixed``; without it, or where it is null, they are unfixed. A null category is the empty one.
    """
    n = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(s)
    done = F.coalesce("fixed", F.lit(False)) if "fixed" in issues.columns else F.lit(False)
    counts = issues.groupBy("trace_id", F.coalesce("category", F.lit("")).alias("category"), "severity", done.alias("done")).agg(F.count("*").alias("n"))
    per = counts.groupBy("trace_id", "category").agg(F.sum("n").alias("total"), n("high"), n("medium"), n("low"), F.sum(F.when(F.col("done"), F.col("n")).otherwise(0)).alias("fixed"))
    sums = [F.sum(c).alias(c) for c in ("total", "high", "medium", "low", "fixed")]
    named = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "total")))).alias("by_category")  # a handful of categories
    return per.groupBy("trace_id").agg(*sums, named).withColumn("unfixed", F.col("total") - F.col("fixed"))


def severity_rollup(issues: DataFrame) -> DataFrame:
    """Issue counts by category and severity with subtotals."""
    return issues.rollup("category", "severity").agg(F.count("*").alias("n"))


def upsert_identity(catalog: DataFrame, scanned: DataFrame, key: str, refreshed: list[str]) -> DataFrame:
    """``catalog`` with the refreshed columns of scanned rows, and rows that it hasn't got; computed metadata stays."""
    new = scanned.select(F.col(key), F.struct(*refreshed).alias("__s"))
    both = catalog.join(new, key, "full")
    cols = [F.coalesce(F.col(f"__s.{c}"), F.col(c)).alias(c) if c in refreshed else F.col(c) for c in catalog.columns]
    return both.select(*cols)


def replace_keys(tags: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Tag rows of ``keys`` replaced by ``new``; tags of other keys stay."""
    return tags.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)


def catalog_query(catalog: DataFrame, tags: DataFrame, key: str, like: str, wanted: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of catalog rows that match ``like`` and have all wanted tags, in the order of their lower-cased name, with their tags."""
    found = catalog.where(F.col("name").ilike(like))
    for tag in wanted:
        found = found.join(tags.where(F.col("tag") == tag).select(key), key, "left_semi")
    page = found.orderBy(F.lower("name"), key).offset(offset).limit(limit)
    own = tags.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat("tag", F.lit("="), F.col("n").cast("string")))), ",").alias("tags"))
    return page.join(own, key, "left")


def neighbours(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Previous and next key in the order, wrapping around at the ends of each group."""
    w = Window.partitionBy(group).orderBy(order, key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(group, key, F.coalesce(F.lag(key).over(w), F.last(key).over(whole)).alias("previous"), F.coalesce(F.lead(key).over(w), F.first(key).over(whole)).alias("next"))


def neighbours_in_all(rows: DataFrame, key: str, order: str, like: str | None = None) -> DataFrame:
    """(key, previous, next) in the order of the whole table, or of the rows whose key holds ``like``, wrapping around at its ends.

    The order is without regard to case, then by name and key. Rows are sorted by ranges, so no task holds them
    all; only the first and last key of each range, one row a range, are put side by side.
    """
    kept = rows.select(F.col(key).alias("__key"), F.lower(order).alias("__low"), F.col(order).alias("__name"))
    kept = kept.where(F.contains("__low", F.lit(like.lower()))) if like else kept
    by = ["__low", "__name", "__key"]
    ranged = written(kept.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, *by).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__part").orderBy(*by)
    ends = ranged.groupBy("__part").agg(F.min_by("__key", F.struct(*by)).alias("__first"), F.max_by("__key", F.struct(*by)).alias("__last"))
    across = Window.partitionBy(F.lit(0)).orderBy("__part")  # one row a range
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = ends.select("__part", F.coalesce(F.lag("__last").over(across), F.last("__last").over(whole)).alias("__before"), F.coalesce(F.lead("__first").over(across), F.first("__first").over(whole)).alias("__after"))
    near = ranged.withColumns({"__lag": F.lag("__key").over(w), "__lead": F.lead("__key").over(w)}).join(F.broadcast(sides), "__part")
    return near.select(F.col("__key").alias(key), F.coalesce("__lag", "__before").alias("previous"), F.coalesce("__lead", "__after").alias("next"))


def gap_clusters(values: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """One-dimensional clusters of values at most ``gap`` apart: size and upper-middle element."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)
    marked = values.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w))  # equal values share a cluster
    inner = Window.partitionBy(*keys, "cluster").orderBy(value)
    ranked = marked.withColumns({"__n": F.row_number().over(inner) - 1, "n": F.count("*").over(Window.partitionBy(*keys, "cluster"))})
    return ranked.where(F.col("__n") == F.floor(F.col("n") / 2)).select(*keys, F.col("cluster").cast("long").alias("cluster"), "n", F.col(value).alias("middle"))


def middle_row(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of ordinal n // 2 of each key."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)}).where("__i = floor(__n / 2)").drop("__i", "__n")


def trail(ego: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Ego distance since the start, and over the last few seconds."""
    order = Window.partitionBy("trace_id").orderBy("t_us")
    step = F.coalesce(F.hypot(F.col("x_m") - F.lag("x_m").over(order), F.col("y_m") - F.lag("y_m").over(order)), F.lit(0.0))
    rows = ego.withColumn("step", step)
    back = order.rangeBetween(-int(seconds * 1_000_000), 0)
    return rows.select("trace_id", "seq", "t_us", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("travelled_m"), (F.sum("step").over(back) - F.first("step").over(back)).alias("trail_m"))


#: Fixed value: margin (m) of a trace's surroundings.
MARGIN_M = 100.0


def extents(ego: DataFrame) -> DataFrame:
    """(trace_id, n, t0, t1, duration_s, lat0, lon0, and the box min_lat .. max_lon with 100 m around it) per trace."""
    g = ego.groupBy("trace_id").agg(F.count("*").alias("n"), F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.min_by("lat", "seq").alias("lat0"), F.min_by("lon", "seq").alias("lon0"), *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")))
    dlat, dlon = F.lit(MARGIN_M / 111320.0), MARGIN_M / (111320.0 * F.greatest(F.lit(0.1), F.cos(F.radians("lat0"))))
    wider = {"min_lat": F.col("min_lat") - dlat, "max_lat": F.col("max_lat") + dlat, "min_lon": F.col("min_lon") - dlon, "max_lon": F.col("max_lon") + dlon}
    return g.withColumns({"duration_s": (F.col("t1") - F.col("t0")) / 1e6, **wider})


def provenance(obs: DataFrame) -> DataFrame:
    """(trace_id, suffix): ``fixed`` and ``predicted`` joined by ``__`` if any observation is, else empty."""
    flag = lambda c, name: F.when(F.bool_or(c), name)
    return obs.groupBy("trace_id").agg(F.concat_ws("__", flag("fixed", "fixed"), flag("synthetic", "predicted")).alias("suffix"))


def page(names: DataFrame, key: str, text: str, limit: int, offset: int = 0) -> DataFrame:
    """(key, total): a page of the keys that hold ``text`` without regard to case, in lower-cased order, each with the count of all such keys."""
    found = names.select(key).distinct().where(F.lower(key).contains(text.lower()))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.lower(key), key).offset(offset).limit(limit).join(total, F.lit(True))  # a one-row side


def scene_poses(ego: DataFrame) -> DataFrame:
    """Poses as a scene shows them: seconds since the start, yaw and bearing in degrees, speed forward and to the left."""
    t0 = F.min("t_us").over(Window.partitionBy("trace_id"))
    yaw = F.radians(F.pmod(F.col("heading_deg") + 90.0, F.lit(360.0)))
    east, north = F.col("v_east"), F.col("v_north")
    return ego.select(
        "trace_id", "seq", ((F.col("t_us") - t0) / 1e6).alias("t_s"), F.pmod(F.col("heading_deg") + 90.0, F.lit(360.0)).alias("yaw_deg"), F.pmod("heading_deg", F.lit(360.0)).alias("bearing_deg"),
        F.hypot(north, east).alias("speed_mps"), (east * F.cos(yaw) + north * F.sin(yaw)).alias("v_fwd_mps"), (north * F.cos(yaw) - east * F.sin(yaw)).alias("v_lat_mps"),
    )
