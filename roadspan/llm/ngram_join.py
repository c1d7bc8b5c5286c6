"""N-gram Jaccard self-join of documents by a size-aware heavy-light join.

A document's set holds the hashes of its distinct five-word shingles. Two
documents link when ``|A & B| >= threshold * |A | B|``. Sets below a size
boundary are *light*: they emit a key for each fixed-size subset that a partner
must share. Sets from the boundary on are *heavy*: they enter the inverted lists
of their prefix, the first ``n - ceil(0.8 n) + 1`` shingles of one order over all
shingles, and linked sets meet in one of these lists. The boundary is the size
with the least estimated cost over the histogram of sizes. Light sets that may
have heavy partners do both.

The order puts shingles with a hash below ``LOW`` first, by the number of sets
that hold them, then all others by hash. Only the low ones are counted, so a
text is hashed once and about a third of its shingles move. Rare shingles first
keep lists short, and a prefix filled with shingles of one set only needs no list.

A list is not expanded into its pairs. Neighbours in it are compared first, and
what they link is one component; pairs are formed across components only. Lists
that are long even so hold near copies of one text by the thousand. Their members
are described by their difference ``D`` from a common base, what most of them hold:

    ``9 |A ^ B| <= |A| + |B|``  is the link, and  ``|A ^ B| = |DA| + |DB| - 2 |DA & DB|``,

so that with ``f(A) = 9 |DA| - |A|`` two members link if ``18 |DA & DB| >= f(A) + f(B)``.
A sum of 0 or less is a link in any case. All members with such links have one with
the member of least ``f``, the centre, and so are in its component; all others share
an item of their differences' prefixes, rare items first: short lists again. Lists of
differences that are still long form a group of their own, ``LEVELS`` times; what is
left then is expanded. No link between different components is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspan.llm import _bloom
from roadspan.llm._graph import components
from roadspan.llm._scratch import written
from roadspan.llm._text import _LANES, U64, bytes_of, mix, shingle_sets, slices

PERCENT = 80  # Jaccard threshold in hundredths; the differences' bounds below are those of 80
WORDS = 5
LOW = U64(3 * (1 << 64) // 10)  # shingles with a smaller hash come first, rare ones before frequent ones
FREQUENT = 24  # counts of tasks summed; from here on a shingle is dealt over parts and not counted
FREQUENT_KEPT = 1 << 19  # most of them; bounds the broadcast to 8 MB, links don't depend on it
PARTS = 64
TRIED = 2  # neighbours of each document that are compared first
LONG = 48  # lists above this length form groups
LONG_DIFFERENCE = 512  # and lists of differences above this one
LEVELS = 3
LIGHT_MOST = 16  # largest boundary looked at


def _least_partner(n: int) -> int:
    """Smallest overlap of a set of ``n`` with any linked set at least as large."""
    return -(-PERCENT * n // 100)


def _subset_sizes(n: int) -> list[int]:
    """Overlaps that linked sets of size ``n`` and ``m >= n`` share at least, for every possible ``m``."""
    return sorted({_least_partner(m) for m in range(n, n * 100 // PERCENT + 1)})


def _prefix(n: int) -> int:
    return n - _least_partner(n) + 1


_PREFIX = f"n - ({PERCENT} * n + 99) div 100 + 1"
_NEAR_SIZES = f"100 * least(n, n2) >= {PERCENT} * greatest(n, n2)"


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """Smallest heavy size: the one with the least estimated number of keys and partners looked at."""

    def cost(x: int) -> float:
        total = 0.0
        for n, docs in sizes.items():
            if n < x:
                total += docs * sum(comb(n, c) for c in _subset_sizes(n))
            if n >= x or n * 100 >= PERCENT * x:
                total += docs * _prefix(n) * (1 + list_length)
        return total

    return min(range(1, LIGHT_MOST + 1), key=cost)


def _key(s: np.ndarray) -> bytes:
    """128-bit identity of a set."""
    return b"".join(mix((mix(s ^ U64(c)) if c else s).sum(dtype=np.uint64, keepdims=True) + U64(len(s))).tobytes() for c in (0, 0x5851F42D4C957F2D))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n, m, key, low) of every document; among them rows (n, shingle) of what a task saw often.

    ``low`` has the set's low shingles or, if those are fewer, its prefix by
    hash: its first ``m`` entries. Small sets are there as a whole.
    """
    names = ["id", "n", "m", "key", "low", "shingle"]

    def frequent(held):
        u, c = np.unique(np.concatenate(held), return_counts=True)
        u, c = u[c >= 3], c[c >= 3]
        none = [pa.nulls(len(u), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([none[0], pa.array(c, pa.int64()), *none[1:], pa.array(u.view(np.int64))], names=names)

    def scan(batches):
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0
        for part in slices(batches, "t"):
            sets = shingle_sets(*bytes_of(part.column(1)), WORDS)
            keys = [_key(s) if len(s) else None for s in sets]
            below = [int(np.searchsorted(s, LOW)) for s in sets]
            m = [max(b, _prefix(len(s))) if len(s) else 0 for s, b in zip(sets, below, strict=True)]
            low = [s if len(s) <= 2 * LIGHT_MOST else s[:k] for s, k in zip(sets, m, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(m, pa.int64()), pa.array(keys, pa.binary()), _lists(low), pa.nulls(len(sets), pa.int64())], names=names)
            for s, b, k in zip(sets, below, keys, strict=True):
                if k is not None and k not in seen:
                    if len(seen) < 1 << 17:
                        seen.add(k)
                    held.append(s[:b])
                    size += b
            if size > 1 << 19:
                yield frequent(held)
                held, size = [], 0
        if size:
            yield frequent(held)

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return plain.mapInArrow(scan, "id long, n long, m long, key binary, low array<long>, shingle long")


def _prefix_keys(heavy: DataFrame, meta: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, n, key): the shingles of each heavy set's prefix that another set holds too."""
    flat = heavy.select("id", F.explode(F.slice("low", 1, F.col("m").cast("int"))).alias("key")).join(F.broadcast(frequent), "key", "left")
    part = F.when(F.col("rank").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    flat = flat.withColumn("part", part).withColumn("cnt", F.coalesce(F.col("rank") + (1 << 40), F.count("*").over(Window.partitionBy("key", "part"))))
    flat = flat.where("rank is not null or cnt > 1").withColumn("high", F.expr(f"key < 0 or key >= {int(LOW)}"))
    w = Window.partitionBy("id")
    flat = flat.withColumns({"at": F.row_number().over(w.orderBy("high", F.expr("if(high, 0, cnt)"), F.expr("key < 0"), "key")), "shared": F.count("*").over(w)})
    # shingles of this set alone come first and need no list
    return flat.join(meta, "id").where(f"at <= {_PREFIX} - (m - shared)").select("id", "n", "key")


def _subset_keys(light: DataFrame) -> DataFrame:
    """(id, n, key): a key for each subset of a light set that a partner must share."""

    def scan(batches):
        for batch in batches:
            ids, ns, keys = [], [], []
            for i, n, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = low.values.to_numpy().view(np.uint64)
                for c in _subset_sizes(n):
                    for sub in combinations(s, c):
                        ids.append(i)
                        ns.append(n)
                        keys.append(mix(_LANES[c : c + 1] + mix(np.array(sub, np.uint64)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.int64())], names=["id", "n", "key"])

    return light.select("id", "n", "low").mapInArrow(scan, "id long, n long, key long")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the documents in ``ids``; a filter of fixed size thins the scan, the join makes it exact."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(_bloom.build(ids, F.xxhash64("id"), 19))

    def scan(batches):
        bloom = wanted.value
        for batch in batches:
            for part in slices([batch.filter(pa.array(bloom.probe(batch.column(2).to_numpy())))], "t"):
                sets = shingle_sets(*bytes_of(part.column(1)), WORDS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    plain = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return plain.withColumn("h", F.xxhash64("id")).mapInArrow(scan, "id long, set binary").join(ids, "id", "left_semi")


def _array(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold, by exact intersection."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _array(x), _array(y)
                both = np.sort(np.concatenate([x, y]))
                n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * n >= PERCENT * (len(x) + len(y) - n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return written(full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct(), "links")


def _neighbours(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours by size in lists, ``TRIED`` for each document: those that are neighbours most often. Long lists go in blocks."""
    few = lists.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("cnt") / 4096)))
    w = Window.partitionBy("key", "block").orderBy("n", "id")
    near = few.withColumns({"id2": F.lead("id").over(w), "n2": F.lead("n").over(w)}).where(f"id <> id2 and {_NEAR_SIZES}")
    near = near.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).agg(F.count("*").alias("met"))
    ends = near.select("a", "b", "met", F.explode(F.array("a", "b")).alias("end"))
    w = Window.partitionBy("end").orderBy(F.desc("met"), "a", "b")
    return ends.withColumn("at", F.row_number().over(w)).where(f"at <= {TRIED}").select("a", "b").distinct()


def _pairs(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Pairs (a, b) of different components that meet in a list and satisfy ``on``."""
    right = right.select("key", *(F.col(c).alias(f"{c}2") for c in right.columns if c != "key"))
    met = left.join(right, "key").where(f"c <> c2 and {_NEAR_SIZES} and {on}")
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _groups(long: DataFrame) -> DataFrame:
    """(pivot, id) for the members of lists that hold more than one component.

    long: key, id, c, own (component of the centre of the group that a list of differences comes from, else null).
    A list's pivot is that of its largest component but ``own``: the member in most lists.
    """
    sizes = long.groupBy("key", "c", "own").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max_by("c", F.struct((~F.col("c").eqNullSafe(F.col("own"))).alias("other"), "k", "c")).alias("main"), F.count("*").alias("parts"))
    pivots = long.groupBy("c", "id").agg(F.count("*").alias("k")).groupBy("c").agg(F.max_by("id", F.struct("k", -F.col("id"))).alias("pivot"))
    main = main.where("parts > 1").join(pivots, F.col("main") == F.col("c")).select("key", "pivot")
    return long.select("key", "id").join(main, "key").select("pivot", "id").distinct()


def _from_pivot(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, id, x, n, items) per member: its difference from the pivot; x tells apart different sets of one id."""

    def scan(batches):
        for batch in batches:
            rows, items = ([], []), []
            for a, p in zip(batch.column(2), batch.column(3), strict=True):
                a, p = _array(a), _array(p)
                rows[0].append(int(a.sum(dtype=np.uint64).view(np.int64)))
                rows[1].append(len(a))
                items.append(np.setxor1d(a, p, assume_unique=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(r, pa.int64()) for r in rows), _lists(items)], names=["pivot", "id", "x", "n", "items"])

    counts = groups.groupBy("pivot").agg(F.ceil(F.count("*") / 256).alias("parts"))
    members = groups.join(counts, "pivot").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).join(sets, "id").select("pivot", "part", "id", "set")
    pivots = counts.join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("base")), "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("pivot", "part", "base")
    both = members.join(pivots, ["pivot", "part"]).select("pivot", "id", "set", "base")
    return written(both.mapInArrow(scan, "pivot long, id long, x long, n long, items array<long>"), "from-pivot")


def _differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, centre, id, x, n, linked, short, long, items) per member: its difference from the group's base and the prefixes of it that matter.

    The base is what most members hold; so few items that most members differ
    by are collected per group. ``centre`` is the member with the least f,
    linked says that f(member) + f(centre) <= 0. ``short`` is the prefix that
    meets members that aren't linked; those have a longer one, ``long``, that
    meets linked members.
    """
    rows = _from_pivot(groups, sets).repartition("pivot", "id")  # a large group's members go to all tasks
    size = rows.groupBy("pivot").agg(F.count("*").alias("members"))
    held = rows.select("pivot", F.explode("items").alias("item")).groupBy("pivot", "item").agg(F.count("*").alias("held"))
    most = held.join(size, "pivot").where("2 * held > members").groupBy("pivot").agg(F.collect_list("item").alias("most"))
    rows = rows.join(most, "pivot", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    rows = rows.withColumn("items", F.concat(F.array_except("items", "most"), F.array_except("most", "items"))).withColumn("f", F.expr("9 * size(items) - n"))
    rows = written(rows.drop("most"), "from-base")
    centre = rows.groupBy("pivot").agg(F.min(F.struct("f", "id")).alias("c")).select("pivot", F.col("c.id").alias("centre"), (-F.col("c.f")).alias("r"))
    rows = rows.join(centre, "pivot").withColumn("linked", F.expr("f <= r"))
    short = F.expr("size(items) - (f + r + 18) div 18 + 1")
    return written(rows.select("pivot", "centre", "id", "x", "n", "linked", short.alias("short"), F.when(F.col("linked"), short).otherwise(F.expr("size(items) - (f - r + 17) div 18 + 1")).alias("long"), "items"), "differences")


def _difference_lists(differences: DataFrame) -> DataFrame:
    """(key, centre, id, n, linked, near, cnt): lists of the prefixes of differences; near: within the short prefix."""
    who = ["pivot", "id", "x"]
    flat = differences.repartition(*who).select(*who, F.explode("items").alias("item"))
    shared = flat.join(flat.groupBy("pivot", "item").agg(F.count("*").alias("held")).where("held > 1"), ["pivot", "item"])
    w = Window.partitionBy(*who)
    shared = shared.withColumns({"at": F.row_number().over(w.orderBy("held", "item")), "own": F.count("*").over(w)})
    meta = differences.select(*who, "centre", "n", "linked", "short", "long", F.size("items").alias("size"))
    keys = shared.join(meta, who).withColumn("at", F.expr("at + size - own")).where("at <= long")
    keys = written(keys.select(F.xxhash64("pivot", "item").alias("key"), "centre", "id", "n", "linked", F.expr("at <= short").alias("near")), "keys")
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1"), "key")


def _across(lists: DataFrame, sets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components that share a list, and the links known then. lists: key, id, n, cnt."""

    def labelled(lists: DataFrame) -> DataFrame:
        near = lists.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        if "centre" in lists.columns:
            near = near.join(comp.select(F.col("id").alias("centre"), F.col("component").alias("own")), "centre", "left").withColumn("own", F.coalesce("own", "centre"))
        else:
            near = near.withColumn("own", F.lit(None).cast("long"))
        return written(near, "near")

    comp = components(links).withColumnRenamed("node", "id")
    first, pairs = lists, []
    long = labelled(lists).where(f"cnt > {LONG}")
    for level in range(LEVELS + 1):
        groups = written(_groups(long), "groups")
        if groups.isEmpty():
            long = None
            break
        differences = _differences(groups, sets)
        links = links.union(differences.where("linked and id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")))
        comp = components(links).withColumnRenamed("node", "id")
        if not level:  # the links to centres alone: with them, most lists of one text's copies get one base
            long = labelled(first).where(f"cnt > {LONG}")
            continue
        near = labelled(_difference_lists(differences))
        met = near.where(f"cnt <= {LONG_DIFFERENCE}")
        pairs.append(written(_pairs(met, met.where("not linked"), "(linked or near and near2 and id < id2)"), "pairs"))
        long = near.where(f"cnt > {LONG_DIFFERENCE}")
    if long is not None:
        pairs.append(_pairs(long, long.where("not linked"), "(linked or near and near2 and id < id2)"))
    short = labelled(first).where(f"cnt <= {LONG}")
    pairs.append(_pairs(short, short, "id < id2"))
    return reduce(DataFrame.union, pairs).distinct(), links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``; component_id is the smallest id reachable by links.

    Null or empty texts have no shingle, link with nothing and are their own
    component. Rows with a null id keep their row with a null component. Rows
    that repeat an id are one document: whatever links to any of its texts is
    in its component. An empty table gives an empty result. Other columns of
    ``docs`` are not looked at, whatever their names.
    """
    table = written(nodes(docs, id_col, text_col), "nodes")
    rows = table.where("shingle is null").select("id", "n", "m", "key", "low")
    named = rows.where("id is not null and key is not null")
    reps = written(named.groupBy("key").agg(F.min(F.struct("id", "n", "m")).alias("r")).select("key", F.col("r.id").alias("rep"), "r.n", "r.m"), "reps")
    sizes = {r["n"]: r["k"] for r in reps.where(f"n <= {2 * LIGHT_MOST}").groupBy("n").agg(F.count("*").alias("k")).collect()}
    x = boundary(sizes, 0.3)

    seen = table.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("rank")).where(F.col("rank") >= FREQUENT)
    frequent = written(seen.orderBy(F.desc("rank"), "shingle").limit(FREQUENT_KEPT).select(F.col("shingle").alias("key"), "rank"), "frequent")
    heads = named.groupBy("key").agg(F.min(F.struct("id", "n", "m", "low")).alias("r")).select("r.*")
    heavy = _prefix_keys(heads.where(f"n >= {x} or n * 100 >= {PERCENT * x}"), reps.select(F.col("rep").alias("id"), "n", "m"), frequent)
    keys = written(heavy.union(_subset_keys(heads.where(f"n < {x}"))), "keys")
    lists = written(keys.join(keys.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1"), "key"), "lists")

    sets = written(_sets(docs, lists.select("id").distinct(), id_col, text_col), "sets")
    tried = written(_neighbours(lists), "tried")
    links = verify(sets, tried)
    pairs, links = _across(lists, sets, links)
    links = links.union(verify(sets, pairs.join(tried, ["a", "b"], "left_anti")))

    twice = named.join(reps.select("key", "rep"), "key").join(rows.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(links.union(twice)).select(F.col("node").alias("rep"), "component")
    whole = reps.join(comp, "rep", "left").select("key", F.coalesce("component", "rep").alias("c"))
    return rows.select("id", "n", "key").join(whole, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))
