"""Written tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set (tests on one machine), a temporary one becomes it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)  # noqa: SLF001
    if not found:
        found = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():  # noqa: SLF001
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder path of this run below the shared folder."""
    root = shared_dir(spark)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def unused(columns: list[str], name: str) -> str:
    """``name`` with as many leading underscores as tell it from ``columns`` without regard to case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{fresh_dir(spark, name)}/{name}.table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
