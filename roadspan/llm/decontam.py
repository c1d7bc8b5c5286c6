"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (five tokens in a row) are
compared: the longest matches that don't overlap are marked again and again,
found by running Karp-Rabin hashes of falling lengths, and the share of the
item's tokens that end up marked is its coverage. Where a passage's parts stand
in another order, they are tiles all the same. Tokens are words without regard to
case and punctuation; Chinese, Japanese and Thai letters are tokens of their own.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspan.llm import _bloom
from roadspan.llm._scratch import unused, written
from roadspan.llm._text import NOT_ALPHANUMERIC, U64, bytes_of, gram_hashes, slices, word_hashes

SEED = 5  # tokens in a seed, and in the shortest tile
COVERAGE = 0.6
SMALL = 200_000  # seed rows up to this number are broadcast to the exact join
SMALL_BYTES = 1 << 25  # and items' texts up to this size
_BASE = 0x9E3779B97F4A7C15


class _Running:
    """Hashes of all runs of any length of a token sequence, from one running polynomial sum."""

    def __init__(self, tokens: np.ndarray) -> None:
        n = len(tokens)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)
        inverse = np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * self.power[:n], dtype=np.uint64)])

    def runs(self, length: int) -> np.ndarray:
        n = len(self.total) - length
        return (self.total[length:] - self.total[:n]) * self.inverse[:n]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs without a marked token."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[length:] == total[: len(total) - length])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (start in item, start in doc, length), longest first.

    The longest match of unmarked tokens is marked next; of equally long ones
    the first in the item, then in the document. No two tiles overlap in either sequence, and none is shorter than
    ``least``.
    """
    out: list[tuple[int, int, int]] = []
    if min(len(item), len(doc)) < least:
        return out
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    left, right = _Running(item), _Running(doc)
    length = min(len(item), len(doc))
    while True:
        p, t = _free(in_item, length), _free(in_doc, length)
        hp, ht = left.runs(length)[p], right.runs(length)[t]
        on = np.isin(ht, hp)
        t, ht = t[on], ht[on]
        matches = []
        if len(t):
            at: dict[int, list[int]] = {}
            for h, j in zip(ht.tolist(), t.tolist(), strict=True):
                at.setdefault(h, []).append(j)
            for h, i in zip(hp.tolist(), p.tolist(), strict=True):
                for j in at.get(h, ()):
                    if i and j and not in_item[i - 1] and not in_doc[j - 1] and item[i - 1] == doc[j - 1]:
                        continue  # part of a match that begins earlier
                    n = 0
                    while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not in_item[i + n] and not in_doc[j + n]:
                        n += 1
                    if n >= length:
                        matches.append((-n, i, j))
        # the longest first; what a tile leaves of a match waits for its turn
        heapify(matches)
        while matches:
            n, i, j = heappop(matches)
            n = -n
            taken = in_item[i : i + n] | in_doc[j : j + n]
            if not taken.any():
                in_item[i : i + n] = in_doc[j : j + n] = True
                out.append((i, j, n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= length:
                    heappush(matches, (a - b, i + a, j + a))
        if length == least:
            return out
        length = max(least, length // 2)


def _tokens(column: pa.Array) -> list[np.ndarray]:
    words, at = word_hashes(*bytes_of(column), NOT_ALPHANUMERIC, unspaced=True)
    return [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _seeds(items: DataFrame) -> DataFrame:
    """(item, which, seed, places, n) of every distinct seed of each item row (item, text, which); items shorter than a seed have none."""

    def run(batches):
        for part in slices(batches, "text"):
            for i, words in enumerate(_tokens(part.column(1))):
                seed, places = np.unique(gram_hashes(words, SEED), return_counts=True)
                k = len(seed)
                own = [part.column(c).take(pa.array([i] * k, pa.int64())) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(seed.view(np.int64)), pa.array(places.astype(np.int64)), pa.array([len(words)] * k, pa.int64())], names=["item", "which", "seed", "places", "n"])

    return items.mapInArrow(run, "item long, which long, seed long, places long, n long")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, digest, item, coverage, tiles) for each document row and item that share enough seeds to matter.

    digest is the SHA-256 of the document's text. Pairs whose shared seeds
    can't add up to ``COVERAGE`` are left out. Null texts share nothing.
    """
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("text")).distinct()
    items = written(rows.withColumn("which", F.xxhash64("text")), "items")
    seeds = written(_seeds(items), "seeds")
    shared = _bloom.share(docs, _bloom.build(seeds, F.col("seed"), 20))

    def scan(batches):
        for part in slices(batches, "text"):
            words, at = word_hashes(*bytes_of(part.column(1)), NOT_ALPHANUMERIC, unspaced=True)
            grams = gram_hashes(words, SEED)
            hit = np.flatnonzero(shared.value.probe(grams)) if len(grams) else np.zeros(0, np.int64)
            row = np.searchsorted(at, hit, side="right") - 1
            on = hit + SEED <= at[row + 1]
            hit, row = hit[on], row[on]
            some, first = np.unique(row, return_index=True)
            lists = [np.unique(g).view(np.int64) for g in np.split(grams[hit], first[1:])] if len(some) else []
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in part.columns), pa.array(lists, pa.list_(pa.int64()))], names=["id", "text", "seeds"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = plain.mapInArrow(scan, "id long, text binary, seeds array<long>").withColumn("row", F.monotonically_increasing_id())
    suspects = written(found, "suspects")

    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    small = seeds.count() <= SMALL and size <= SMALL_BYTES
    met = suspects.select("row", F.explode("seeds").alias("seed")).join(F.broadcast(seeds) if small else seeds, "seed")
    pairs = met.groupBy("row", "item", "which", "n").agg(F.sum("places").alias("m")).where(SEED * F.col("m") >= COVERAGE * F.col("n"))
    texts = items.select("item", "which", F.col("text").alias("item_text"))
    pairs = pairs.join(F.broadcast(texts) if small else texts, (pairs["item"].eqNullSafe(texts["item"])) & (pairs["which"] == texts["which"])).select("row", pairs["item"], "item_text")
    per_doc = pairs.groupBy("row").agg(F.collect_list(F.struct("item", "item_text")).alias("items"))

    def tile(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                doc = _tokens(row.column(1))[0]
                items = row.column(3)[0].as_py()
                own = _tokens(pa.array([x["item_text"] for x in items], pa.binary()))
                got = [tiles(t, doc) for t in own]
                share = [sum(n for *_, n in g) / len(t) for g, t in zip(got, own, strict=True)]
                spans = [[{"item_start": i, "doc_start": j, "length": n} for i, j, n in g] for g in got]
                many = [0] * len(items)
                yield pa.RecordBatch.from_arrays(
                    [row.column(0).take(pa.array(many)), row.column(2).take(pa.array(many)), pa.array([x["item"] for x in items], pa.int64()), pa.array(share, pa.float64()), pa.array(spans, pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])))],
                    names=["id", "digest", "item", "coverage", "tiles"],
                )

    full = suspects.select("row", "id", "text").join(per_doc, "row").select("id", "text", F.sha2("text", 256).alias("digest"), "items")
    return full.mapInArrow(tile, "id long, digest string, item long, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>")


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document row: id, contaminated, n_items covered, the best item and its coverage (0 and null without any).

    An item counts if at least ``COVERAGE`` of its tokens are tiled. Ties go to
    the smallest item id. Rows with equal id and text have equal results; null
    texts are clean; items with under ``SEED`` tokens are too short to tell.
    Other columns are left out. Empty tables give empty results, an empty
    benchmark clean documents.
    """
    hits = overlaps(docs, benchmark, id_col, text_col, item_col)
    best = hits.groupBy("id", "digest").agg(
        F.count_distinct(F.when(F.col("coverage") >= COVERAGE, F.col("item"))).alias("n_items"), F.max(F.struct("coverage", (-F.col("item")).alias("less"))).alias("b")
    )
    rows = docs.select(F.col(id_col).alias("key"), F.sha2(F.col(text_col).cast("binary"), 256).alias("d"))
    both = rows.join(best, rows["key"].eqNullSafe(best["id"]) & (rows["d"] == best["digest"]), "left")
    return both.select(
        F.col("key").alias(id_col),
        (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        (-F.col("b.less")).alias(item_col),
        F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows of which an item is covered."""
    hits = written(overlaps(docs, benchmark, id_col, text_col, item_col).where(F.col("coverage") >= COVERAGE).select("id", "digest").distinct(), "covered")
    at = unused(docs.columns, "digest")
    keyed = docs.withColumn(at, F.sha2(F.col(text_col).cast("binary"), 256))
    return keyed.join(hits, keyed[id_col].eqNullSafe(hits["id"]) & (keyed[at] == hits["digest"]), "left_anti").drop(at)
