"""Connected components of a link table: contraction within tasks, then large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspan.llm._scratch import written


CHUNK = 1 << 20  # links that a task contracts at once


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of some links, without the components' smallest nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    below = label < np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    def made(held):
        columns = [np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in contract(*columns)], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node of its component.

    Tasks first contract chunks of at most ``CHUNK`` links to stars; one chunk
    is the whole of a small graph. For more, each step is a grouped minimum
    with map-side combining and a join; no node's neighbours are ever
    collected. Every round is written to the shared folder. Empty links give
    an empty table; self-links and repeated links don't matter.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "cc")
    tasks = -(-edges.count() // CHUNK)
    edges = written(_contracted(edges, max(1, tasks)), "cc")
    state = None
    while tasks > 1:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to u's minimum
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "cc")
        # small star: u and its lower neighbours go to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = written(small, "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return nodes.union(roots.select("node", F.col("node").alias("component")))
