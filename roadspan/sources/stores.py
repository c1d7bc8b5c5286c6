"""Tables that are kept between runs: a catalog whose keys are replaced, and an append-only log of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BUCKETS = 64
BUCKET = "_bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _marked(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, _bucket(F.col(key), buckets))


def replace_keys(path: str, new: DataFrame, keys: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """In the table at ``path``, all rows of ``keys`` give way to those of ``new``; other keys' rows stay. Makes the table if there is none.

    Keys lie in hash buckets, which are partitions: only the buckets of
    ``keys`` are read and written, and each of them changes as a whole when the
    job commits, so a failed or repeated run leaves the old or the new rows.
    Rows of ``new`` under other keys, and null keys, are left out. One job
    writes a table at a time; ``buckets`` stays what it was at first.
    """
    spark = new.sparkSession
    asked = keys.where(F.col(key).isNotNull()).select(key).distinct()
    rows = _marked(new.join(asked, key, "left_semi").select(*new.columns), key, buckets)
    touched = _marked(asked, key, buckets).select(BUCKET).distinct()
    # a bucket that loses its last row is still to be written: a row without a key stands for it
    marks = touched.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema), BUCKET)
    if _exists(spark, path):
        old = spark.read.schema(rows.schema).parquet(path).where(F.col(key).isNotNull())
        # at most ``buckets`` rows: prunes the table's partitions
        rows = old.join(F.broadcast(touched), BUCKET, "left_semi").join(asked, key, "left_anti").select(*rows.columns).union(rows)
    rows.union(marks).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_keys(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """The rows of a table that ``replace_keys`` keeps."""
    return spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(path).where(F.col(key).isNotNull()).drop(BUCKET)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)  # noqa: SLF001


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to the log as one line of JSON each, with null fields as null; they appear together when the job commits."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The log's fields and ``broken``: the line, where it is no JSON object of these fields, else null. Empty lines are left out.

    Fields that a line hasn't got are null, further ones are ignored.
    """
    with_line = StructType([*schema.fields, StructField("broken", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", with_line, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"), "value")
    return parsed.select(*(F.col(f"r.`{f.name}`") for f in schema.fields), F.when(F.col("r").isNull(), F.col("value")).otherwise(F.col("r.broken")).alias("broken"))


def tail(log: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` whole lines by ``order``, the latest first, each with the number of broken lines in the log."""
    broken = log.agg(F.count("broken").alias("n_broken"))  # one row
    return log.where("broken is null").drop("broken").orderBy(*(F.desc(c) for c in order)).limit(n).join(F.broadcast(broken), F.lit(True))
