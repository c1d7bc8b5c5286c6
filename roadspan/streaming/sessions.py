"""Streaming episodes: sessions of a key that end after a gap, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(rows: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a batch or a stream: keys, start, end, n. On a stream, rows later than ``late`` are left out."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    found = marked.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Write what the stream holds now as Parquet and read it back."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
