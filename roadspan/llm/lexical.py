"""Ranked lexical search: best-first branch and bound over a tree of per-term maxima.

Documents are indexed in segments of consecutive rows, each written as one row
of postings. Over a segment's documents stands a tree of ranges; for every term
each range holds the highest weight factor of the term in any of its documents.
An item's bound of a range is the sum over its terms, so the range with the
highest bound is opened first, and nothing below the k-th best score so far
needs opening; ranges whose bound equals it are opened, as a tie may go to a
smaller id. Tasks open their segments on their own; what a first few segments
give is already a lower limit for all. Postings are never gathered by term, so
a term that every document holds is no hot key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from roadspan.llm._scratch import written
from roadspan.llm._text import NOT_ALPHANUMERIC, bytes_of, slices, word_hashes

SEGMENT = 4096  # most documents of a segment
POSTINGS = 1 << 19  # after which a segment is closed
WIDTH, FAN = 64, 8  # documents of a lowest range, ranges of the next higher one
CELLS = 1 << 21  # most (term, lowest range) pairs of a segment's tree
FIRST = 32  # segments about that are searched for a first limit
PAIRS, ITEMS = 1 << 20, 20_000  # (item, term) pairs and items that are searched for at once, about
PIECE = 1 << 20  # bytes of text worked on at once


def _cuts(values: np.ndarray) -> list[int]:
    """Ends of pieces of about ``PIECE`` bytes, each before a byte that is in no term."""
    ends = []
    while (ends[-1] if ends else 0) + PIECE < len(values):
        at = ends[-1] + PIECE if ends else PIECE
        while at < len(values):
            between = np.flatnonzero(NOT_ALPHANUMERIC[values[at : at + PIECE]])
            if len(between):
                at += int(between[0])
                break
            at += PIECE
        ends.append(min(at, len(values)))
    return [*ends, len(values)] if not ends or ends[-1] < len(values) else ends


def _term_counts(values: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row with repeats; row, number in ``wanted`` and occurrences of each wanted term), by row and term."""
    if len(offsets) == 2 and len(values) > 2 * PIECE:  # a very long text
        n, tf, start = 0, np.zeros(len(wanted), np.int64), 0
        for end in _cuts(values):
            h, _ = word_hashes(values[start:end], np.array([0, end - start]), NOT_ALPHANUMERIC)
            n, start = n + len(h), end
            at = _find(wanted, h)
            tf += np.bincount(at[at >= 0], minlength=len(wanted))
        some = np.flatnonzero(tf)
        return np.array([n]), np.zeros(len(some), np.int64), some, tf[some]
    h, at = word_hashes(values, offsets, NOT_ALPHANUMERIC)
    number = _find(wanted, h)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))[number >= 0]
    keys, tf = np.unique(row * np.int64(len(wanted) or 1) + number[number >= 0], return_counts=True)
    return np.diff(at), *np.divmod(keys, np.int64(len(wanted) or 1)), tf


def _find(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ``among``, or -1."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term) once each; texts with one id are one item, null ids are one of their own, null texts have no term."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for part in slices(batches, "text", PIECE):
            h, at = word_hashes(*bytes_of(part.column(1)), NOT_ALPHANUMERIC)
            row = np.repeat(np.arange(part.num_rows), np.diff(at))
            if len(h):
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], names=["item", "term"])

    return rows.mapInArrow(run, StructType([rows.schema["item"], StructField("term", LongType())])).distinct()


def index(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Segments (segment, id[], n[], doc[], term[], tf[]): documents that hold a term, their lengths, and the postings of the ``wanted`` term hashes.

    Every row is a document of its own, whatever its id; very long texts are
    worked off in pieces. One row is at most ``SEGMENT`` documents and about
    ``POSTINGS`` postings.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    ints = ArrayType(LongType())
    schema = StructType([StructField("segment", LongType()), StructField("id", ArrayType(rows.schema["id"].dataType)), *(StructField(n, ints) for n in ("n", "doc", "term", "tf"))])

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = postings = 0

        def segment():
            ids = pa.concat_arrays([h[0] for h in held])
            first = np.cumsum([0, *(len(h[0]) for h in held)])
            columns = [np.concatenate([h[1] for h in held]), np.concatenate([h[2] + f for h, f in zip(held, first, strict=False)]), *(np.concatenate([h[i] for h in held]) for i in (3, 4))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64))) for c in (ids, *columns)]
            return pa.RecordBatch.from_arrays([pa.array([at]), *lists], names=schema.fieldNames())

        for part in slices(batches, "text", PIECE):
            n, row, term, tf = _term_counts(*bytes_of(part.column(1)), shared.value)
            full = n > 0
            renumbered = np.cumsum(full) - 1
            held.append((part.column(0).cast(kind).filter(pa.array(full)), n[full], renumbered[row], term, tf))
            size, postings = size + int(full.sum()), postings + len(tf)
            while size >= SEGMENT or postings >= POSTINGS:
                spare = None
                if size > SEGMENT:  # the last part is cut where the segment is full
                    ids, n, row, term, tf = held.pop()
                    keep = len(ids) - (size - SEGMENT)
                    own = row < keep
                    held.append((ids[:keep], n[:keep], row[own], term[own], tf[own]))
                    spare = (ids[keep:], n[keep:], row[~own] - keep, term[~own], tf[~own])
                yield segment()
                at += 1
                held = [spare] if spare else []
                size, postings = sum(len(h[0]) for h in held), sum(len(h[4]) for h in held)
        if size:
            yield segment()

    return rows.mapInArrow(run, schema)


def _document_frequency(segments: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each wanted term: counted in tasks, then summed."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    found = segments.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


@dataclass
class Query:
    """A block of items: each one's terms (numbers) and their weights lie one after another from ``start``."""

    items: pa.Array
    start: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    documents: int
    length: int
    k: int
    limit: np.ndarray  # scores that k documents are known to reach


class Tree:
    """Postings of a segment by (term, lowest range) and the maxima of all levels, the lowest first."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, query: Query) -> None:
        m = 50 + 50 * n * query.documents // query.length
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order = np.argsort(term, kind="stable")
        self.terms, slot = np.unique(term[order], return_inverse=True)
        self.doc, self.impact = doc[order], impact[order]
        self.width = max(WIDTH, -(-len(n) // max(1, CELLS // max(1, len(self.terms)))))
        self.ranges = -(-len(n) // self.width)
        key = slot * self.ranges + self.doc // self.width
        cells = len(self.terms) * self.ranges
        self.at = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=cells))])
        low = np.zeros(cells, np.int64)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first):
            low[key[first]] = np.maximum.reduceat(self.impact, first)
        self.levels = [low.reshape(len(self.terms), self.ranges)]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def scores(self, slots: np.ndarray, weights: np.ndarray, leaf: int) -> tuple[int, np.ndarray]:
        """(first document, scores) of a lowest range."""
        cell = slots * self.ranges + leaf
        start, count = self.at[cell], self.at[cell + 1] - self.at[cell]
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        first = leaf * self.width
        total = np.zeros(self.width, np.int64)
        np.add.at(total, self.doc[at] - first, np.repeat(weights, count) * self.impact[at])
        return first, total

    def search(self, slots: np.ndarray, weights: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Best first, (documents, scores) that reach the limit; the limit, which may have risen, is sent in after each."""
        top = len(self.levels) - 1
        queue = [(-int(weights @ self.levels[top][slots, 0]), top, 0)] if self.ranges else []
        while queue:
            bound, level, node = heapq.heappop(queue)
            if -bound < max(limit, 1):
                return
            if level == 0:
                first, total = self.scores(slots, weights, node)
                good = np.flatnonzero(total >= max(limit, 1))
                if len(good):
                    limit = yield first + good, total[good]
                continue
            children = self.levels[level - 1][slots, node * FAN : (node + 1) * FAN]
            for i, b in enumerate((weights @ children).tolist()):
                if b >= max(limit, 1):
                    heapq.heappush(queue, (-b, level - 1, node * FAN + i))


def _best(segments: DataFrame, query: Query) -> DataFrame:
    """(item number, id, score): what each task's segments hold of each item's ``k`` best, by falling score, then id (null first)."""
    shared = segments.sparkSession.sparkContext.broadcast(query)
    kind = segments.schema["id"].dataType.elementType

    def run(batches):
        q = shared.value
        n_items = len(q.start) - 1
        best: dict[int, list[tuple]] = {}
        limit = q.limit.copy()
        for batch in batches:
            for r in range(batch.num_rows):
                own = {name: batch.column(batch.schema.get_field_index(name))[r].values for name in ("id", "n", "doc", "term", "tf")}
                tree = Tree(*(own[name].to_numpy() for name in ("n", "doc", "term", "tf")), q)
                slot = _find(tree.terms, q.terms)
                root = np.where(slot >= 0, tree.levels[-1][np.maximum(slot, 0), 0] if len(tree.terms) else 0, 0)
                bounds = np.add.reduceat(q.weights * root, q.start[:-1]) if n_items else np.zeros(0)
                for i in np.flatnonzero(bounds >= np.maximum(limit, 1)).tolist():
                    here = slice(q.start[i], q.start[i + 1])
                    some = slot[here] >= 0
                    found = tree.search(slot[here][some], q.weights[here][some], int(limit[i]))
                    send = None
                    held = best.setdefault(i, [])
                    while True:
                        try:
                            docs, scores = found.send(send)
                        except StopIteration:
                            break
                        ids = own["id"].take(pa.array(docs)).to_pylist()
                        held += [(-s, d is not None, d) for s, d in zip(scores.tolist(), ids, strict=True)]
                        if len(held) >= q.k:
                            held.sort(key=lambda x: x if x[1] else x[:2])
                            del held[q.k :]
                            limit[i] = max(limit[i], -held[-1][0])
                        send = int(limit[i])
        for i, held in best.items():
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(held), pa.int64()), pa.array([x[2] for x in held], to_arrow_type(kind)), pa.array([-x[0] for x in held], pa.int64())], names=["item", "id", "score"])

    return segments.mapInArrow(run, StructType([StructField("item", LongType()), StructField("id", kind), StructField("score", LongType())]))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents that score highest, from 1, ties by id.

    Whole texts and all documents count. Every row of ``docs`` is a document of
    its own, so repeated rows rank one after another; a null id goes before all
    others in a tie. Texts of one item id are one item. Null and empty texts
    have no terms: such documents are found by no item and count in no
    statistic, such items have no row. Empty tables give no row; further
    columns are left alone. Items are searched for in blocks of bounded size,
    and only a block's terms and weights are sent to all tasks.
    """
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_col, item_text_col), "item_terms")
    size = pairs.agg(F.count("*"), F.count_distinct(F.xxhash64("item"))).first()
    blocks = max(1, -(-size[0] // PAIRS), -(-size[1] // ITEMS))
    found = None
    for block in range(blocks if size[0] else 0):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow()
        if not own.num_rows:
            continue
        lists = own["terms"].combine_chunks()
        hashes = lists.flatten().to_numpy().view(np.uint64)
        wanted = np.unique(hashes)
        segments = written(index(docs, wanted, id_col, text_col), "segments")
        count, documents, length = segments.select(F.size("n").alias("docs"), F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("terms")).agg(F.count("*"), F.sum("docs"), F.sum("terms")).first()
        if not count:
            break
        df = _document_frequency(segments, len(wanted))
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        terms = np.searchsorted(wanted, hashes)
        query = Query(own["item"].combine_chunks(), np.asarray(lists.offsets, dtype=np.int64), terms, weight[terms], documents, length, k, np.zeros(own.num_rows, np.int64))
        if count > 2 * FIRST:
            some = _best(segments.where(F.pmod(F.xxhash64("segment"), F.lit(count)) < FIRST), query)
            reached = _ranked(some, k).where(F.col("rank") == k).select("item", "score").toArrow()
            query.limit[reached["item"].to_numpy()] = reached["score"].to_numpy()
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(own.num_rows)), item_col: query.items}))
        # at most ITEMS rows
        rows = _ranked(_best(segments, query), k).join(F.broadcast(names), "item").select(F.col(item_col).alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
        found = rows if found is None else found.union(rows)
    if found is None:
        kinds = [StructField("item_id", items.schema[item_col].dataType), StructField("rank", IntegerType()), StructField("doc_id", docs.schema[id_col].dataType), StructField("score", LongType())]
        found = spark.createDataFrame([], StructType(kinds))
    return found
