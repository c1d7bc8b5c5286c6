"""Listing of a corpus: folders are listed by tasks, level by level, with links followed once."""

from __future__ import annotations

import errno
import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspan.shared import written

#: The two files of a stored trace.
EGO_FILE, ANNOTATION_FILE = "adma.csv", "annotation.xml"
EXAMPLES = 10
ENTRY = "kind string, path string, real string, link boolean, reason string"
BATCH = 10_000
NO_FOLDER = [os.strerror(e) for e in (errno.ENOENT, errno.ENOTDIR)]


def _contents(batches):
    """What the folders of ``path`` hold; a folder itself is a row, too, if it opens."""
    names, rows = ["kind", "path", "real", "link", "reason"], []
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        rows.clear()
        return out

    for given in batches:
        for at, real in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
            try:
                found = os.scandir(at)
            except OSError as e:
                rows.append(("unreadable", at, real, False, e.strerror or str(e)))
                continue
            rows.append(("folder", at, real or os.path.realpath(at), False, None))
            with found:
                for entry in found:
                    try:
                        deeper = entry.is_dir()
                    except OSError as e:
                        rows.append(("unreadable", entry.path, None, entry.is_symlink(), e.strerror or str(e)))
                    else:
                        rows.append(("below", entry.path, os.path.realpath(entry.path), entry.is_symlink(), None) if deeper else ("file", entry.path, None, entry.is_symlink(), None))
                    if len(rows) >= BATCH:
                        yield batch()
        if rows:
            yield batch()


def walk(spark: SparkSession, root: str, levels: int | None = None) -> DataFrame:
    """All below ``root``: (kind, path, real, link, reason).

    kind: ``folder``, opened; ``file``, dead links among them; ``again``, a
    folder whose real path has been met on a shorter way, or on one of equal
    length and smaller path, and which isn't entered, so cycles end;
    ``unreadable``, with the system's reason; ``below``, a folder deeper than
    ``levels``. Each level is one job over its folders, dealt by path, and is
    written once; a folder's entries are streamed by one task. ``root`` is in
    a file system that all executors have mounted; where it isn't a folder, this raises.
    """
    tasks = spark.sparkContext.defaultParallelism * 4
    front, parts, level = spark.createDataFrame([(root.rstrip("/") or "/", None)], "path string, real string"), [], 0
    seen = None
    while True:
        listed = written(front.repartition(tasks, "path").mapInArrow(_contents, ENTRY), "listing")
        level += 1
        below = listed.where("kind = 'below'")
        if seen is None:
            if listed.where(F.col("kind").eqNullSafe("unreadable") & F.col("reason").isin(NO_FOLDER) & (F.col("path") == (root.rstrip("/") or "/"))).head(1):
                raise NotADirectoryError(root)
            seen = listed.where("kind = 'folder'").select("real")
        parts.append(listed.where("kind <> 'below'"))
        if level == levels or not below.head(1):
            parts.append(below)
            return reduce(DataFrame.unionByName, parts)
        front = written(below.groupBy("real").agg(F.min("path").alias("path")).join(seen, "real", "left_anti").select("path", "real"), "front")
        parts.append(below.join(front.select("path"), "path", "left_anti").select(F.lit("again").alias("kind"), "path", "real", "link", "reason"))
        parts.append(below.join(front.select("path"), "path", "left_semi").where("link").select(F.lit("link").alias("kind"), "path", "real", "link", "reason"))
        seen = seen.unionByName(front.select("real"))


def walk_counts(entries: DataFrame) -> DataFrame:
    """One row: folders opened, unreadable ones with up to ten examples by path, links to folders, ways that led to a folder again."""
    bad = F.col("kind") == "unreadable"
    counts = entries.agg(
        F.count_if(F.col("kind") == "folder").alias("dirs_visited"), F.count_if(bad).alias("dirs_unreadable"),
        F.count_if(F.col("kind").isin("again", "link", "below") & F.col("link")).alias("links_followed"), F.count_if(F.col("kind") == "again").alias("again_skipped"),
    )
    some = entries.where(bad).select(F.format_string("%s (%s)", "path", "reason").alias("e")).orderBy("e").limit(EXAMPLES).agg(F.sort_array(F.collect_list("e")).alias("unreadable_examples"))
    return counts.join(some, F.lit(True))  # one row each


def subfolders(spark: SparkSession, path: str) -> DataFrame:
    """(name, path) of the folders directly in ``path`` that aren't hidden, by name without regard to case; none if it can't be opened."""
    name = F.element_at(F.split("path", "/"), -1)
    return walk(spark, path, 1).where("kind = 'below'").select(name.alias("name"), "path").where("name not like '.%'").orderBy(F.lower("name"), "name")


def registered(entries: DataFrame, root: str, external: DataFrame) -> DataFrame:
    """(trace_id, ego_path, annotation_path) of all known traces.

    A folder directly in ``root`` with both files is a trace of its name.
    external: (trace_id, ego_path, annotation_path, ord), traces known by
    reference; the first by ``ord`` holds, and goes before a folder of its name.
    """
    at = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    files = entries.where("kind = 'file'").where(name.isin(EGO_FILE, ANNOTATION_FILE)).groupBy(at.alias("at")).agg(F.min(F.when(name == EGO_FILE, F.col("path"))).alias("ego_path"), F.min(F.when(name == ANNOTATION_FILE, F.col("path"))).alias("annotation_path"))
    inside = files.where(F.col("ego_path").isNotNull() & F.col("annotation_path").isNotNull() & (F.regexp_extract("at", r"^(.*)/[^/]*$", 1) == root.rstrip("/")))
    stored = inside.select(F.element_at(F.split("at", "/"), -1).alias("trace_id"), "ego_path", "annotation_path", F.lit(1).alias("k"), F.lit(0).cast("long").alias("ord"))
    known = external.select("trace_id", "ego_path", "annotation_path", F.lit(0).alias("k"), F.col("ord").cast("long").alias("ord"))
    first = Window.partitionBy("trace_id").orderBy("k", "ord", "ego_path", "annotation_path")
    return known.unionByName(stored).withColumn("n", F.row_number().over(first)).where("n = 1").select("trace_id", "ego_path", "annotation_path")
