"""Ego and observation frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspan.functions import exprs as X
from roadspan.operators.joins import interp_asof


def project_ego(ego: DataFrame) -> DataFrame:
    """lat, lon to metres east and north of the trace's first pose."""
    w = Window.partitionBy("trace_id").orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x, y = X.local_east_north(F.col("lat"), F.col("lon"), F.first("lat").over(w), F.first("lon").over(w))
    return ego.withColumns({"x_m": x, "y_m": y})


def populate_global(obs: DataFrame, ego: DataFrame, offset_us: int = 0) -> DataFrame:
    """Observations with the ego's pose (ex, ey, es, eyaw) and their own in the global frame: gx, gy, heading."""
    at = interp_asof(obs, ego, offset_us)
    gx, gy = X.body_to_global(F.col("x_rel"), F.col("y_rel"), F.col("ex"), F.col("ey"), F.col("eyaw"))
    return at.withColumns({"gx": gx, "gy": gy, "heading": X.global_heading(F.col("eyaw"), F.col("zrot"))})


def reproject_relative(rows: DataFrame) -> DataFrame:
    """x_rel, y_rel and zrot anew from gx, gy and heading."""
    x, y = X.global_to_body(F.col("gx"), F.col("gy"), F.col("ex"), F.col("ey"), F.col("eyaw"))
    return rows.withColumns({"x_rel": x, "y_rel": y, "zrot": X.zrot_of_heading(F.col("heading"), F.col("eyaw"))})


def sampled(ego: DataFrame, hertz: int = 10) -> DataFrame:
    """Every n-th pose, so that about ``hertz`` a second remain; the first always does."""
    w = Window.partitionBy("trace_id")
    order = w.orderBy("t_us", "seq")
    seconds = (F.max("t_us").over(w) - F.min("t_us").over(w)) / 1e6
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / F.greatest(F.lit(1), F.floor(seconds * hertz))))
    return ego.withColumns({"__n": F.row_number().over(order) - 1, "__s": stride}).where("__n % __s = 0").drop("__n", "__s")
