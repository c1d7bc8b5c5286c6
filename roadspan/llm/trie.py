"""Prefix trie of conversations from mergeable partial tries.

A node is named by its depth and a 128-bit hash of its turns, which is a sum
over positions (two lanes of 64 bits), so that parts of a conversation can be
hashed apart and put together: a conversation may be spread over any number of
tasks. Tasks emit node tables that are combined as far as their rows go;
rounds of grouped merges, keyed by node, sum members and join end lists until
one row is left per node. The rollup goes bottom-up by doubling distances: a
round adds to each node what lies 1, 2, 4, ... levels below, so that a depth of
hundreds takes nine rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspan.llm._scratch import written

PERIOD = 100  # conversations that share the opening of the first of them
FAN = 16  # partial tables that a round of merges joins
HELD = 1 << 16  # rows that a task combines at once
PIECE = 1000  # ends in a piece of an end list
SEALED = 64  # pieces beyond which an end list isn't copied in further merges
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: has an inverse
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MOST = 5  # turns of an opening


def opening(conv_id: Column) -> Column:
    """How many turns conversation ``conv_id`` takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST + 1)).cast("int")


def _powers(exponents: np.ndarray) -> np.ndarray:
    """``BASE`` to each power, of either sign, modulo 2**64."""
    out = np.ones(len(exponents), np.uint64)
    left = np.abs(exponents).astype(np.uint64)
    factor = np.where(exponents < 0, INVERSE, BASE)
    while left.any():
        out = np.where(left & np.uint64(1), out * factor, out)
        factor, left = factor * factor, left >> np.uint64(1)
    return out


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _hashes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _longs(batch, name).view(np.uint64)


def ordered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(part, conv, no, a, b, chars, sum_a, sum_b), written: a conversation's turns with their number within the part of the table, from 1.

    Turns are ordered by number (null first); those that tie by the MD5 of role
    and text, and repeated rows follow one another. Rows are dealt in ranges of
    (conversation, turn), so a conversation of any length is cut over parts;
    ``sum_*`` hash its turns from the part's first on.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    rows = (
        conversations.where(F.col(conv_col).isNotNull())
        .select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
        .select("conv", "turn", "digest", half(1).alias("a"), half(17).alias("b"), "chars", "row")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "conv", "a", "b", "chars")

    def run(batches):
        last, no, sums = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            conv = _longs(batch, "conv")
            if not len(conv):
                continue
            first = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1 if conv[0] != last else conv[0]))
            starts = np.concatenate([[0], first[first > 0]])
            own = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv)))) + 1
            goes_on = conv[0] == last
            head = starts[1] if len(starts) > 1 else len(conv)
            if goes_on:
                own[:head] += no
            power = _powers(own)
            totals = []
            for lane, name in enumerate(("a", "b")):
                run_sum = np.cumsum(_hashes(batch, name) * power, dtype=np.uint64)
                before = np.concatenate([np.zeros(1, np.uint64), run_sum])[starts]
                total = run_sum - np.repeat(before, np.diff(np.append(starts, len(conv))))
                if goes_on:
                    total[:head] += sums[lane]
                totals.append(total)
            last, no, sums = conv[-1], int(own[-1]), [t[-1] for t in totals]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int64)), *(pa.array(t.view(np.int64)) for t in totals)], names=[*batch.schema.names, "no", "sum_a", "sum_b"])

    kind = "part long, conv long, a long, b long, chars long, no long, sum_a long, sum_b long"
    return written(dealt.mapInArrow(run, kind), "turns")


def _joined(turns: DataFrame) -> DataFrame:
    """``turns`` with ``no`` and ``sum_*`` over the whole conversation: what earlier parts hold of a part's first conversation is added.

    Only the last row of each part's first and last conversation is needed for
    that, two rows per part, which the driver adds up.
    """
    ends = turns.groupBy("part").agg(F.min_by(F.struct("conv"), "conv").alias("first"), F.max("conv").alias("last"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("first.conv", "last"))).alias("conv"))
    edges = turns.join(F.broadcast(ends), ["part", "conv"]).groupBy("part", "conv").agg(F.max_by(F.struct("no", "sum_a", "sum_b"), "no").alias("s")).select("part", "conv", "s.*").orderBy("conv", "part").toArrow().to_pylist()
    carried: dict[tuple[int, int], tuple[int, np.uint64, np.uint64]] = {}
    last, so_far = None, (0, np.uint64(0), np.uint64(0))
    for e in edges:
        if e["conv"] != last:
            last, so_far = e["conv"], (0, np.uint64(0), np.uint64(0))
        elif so_far[0]:
            carried[e["part"], last] = so_far
        n, *sums = so_far
        power = _powers(np.array([n]))
        so_far = (n + e["no"], *(s + (np.array([e[k]], np.int64).view(np.uint64) * power)[0] for s, k in zip(sums, ("sum_a", "sum_b"), strict=True)))
    shared = turns.sparkSession.sparkContext.broadcast(carried)

    def run(batches):
        parts = {p for p, _ in shared.value}
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            here = set(np.unique(_longs(batch, "part")).tolist()) & parts
            if here:
                part, conv, no = (_longs(batch, n) for n in ("part", "conv", "no"))
                no, sums = no.copy(), [_hashes(batch, n).copy() for n in ("sum_a", "sum_b")]
                for (p, c), (n, *before) in shared.value.items():
                    if p in here and len(at := np.flatnonzero((part == p) & (conv == c))):
                        no[at] += n
                        power = _powers(np.array([n]))
                        for s, b in zip(sums, before, strict=True):
                            s[at] = s[at] * power + b
                columns |= {"no": pa.array(no), "sum_a": pa.array(sums[0].view(np.int64)), "sum_b": pa.array(sums[1].view(np.int64))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return turns.mapInArrow(run, turns.schema) if carried else turns


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of each rebuilt conversation, its end): rows (conv, depth, a, b, pa, pb, chars) without the root, and (conv, depth, a, b).

    ``a``, ``b`` name the node, ``pa``, ``pb`` its parent; the root is 0, 0.
    """
    heads = turns.where(F.col("no") <= MOST).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("no", "a", "b", "chars", "sum_a", "sum_b"))).alias("head"))
    sizes = turns.groupBy("conv").agg(F.max(F.struct("no", "sum_a", "sum_b")).alias("all"))
    heads = written(heads.join(sizes, "conv").withColumn("h", opening(F.col("conv"))), "heads")
    taken = heads.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    convs = heads.withColumn("base", F.col("conv") - F.col("conv") % PERIOD).join(taken, "base", "left")
    opened = F.slice(F.coalesce("base_head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    before = F.when(F.col("h") > 0, F.get("head", F.least("h", F.size("head")) - 1))  # what the own turns left out add up to
    convs = convs.withColumn("opened", opened).withColumn("cut", before).withColumn("tail", F.greatest(F.col("all.no") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv", "h", "all", "tail", "opened", F.size("opened").alias("k"), F.try_element_at("opened", F.lit(-1)).alias("top"), "cut"), "convs")
    start = [F.coalesce(F.col(f"top.sum_{x}"), F.lit(0).cast("long")).alias(f"start_{x}") for x in "ab"] + [F.coalesce(F.col(f"cut.sum_{x}"), F.lit(0).cast("long")).alias(f"cut_{x}") for x in "ab"]
    openings = convs.select("conv", F.explode("opened").alias("t")).select("conv", F.col("t.no").alias("depth"), F.col("t.sum_a").alias("a"), F.col("t.sum_b").alias("b"), F.col("t.a").alias("turn_a"), F.col("t.b").alias("turn_b"), F.col("t.chars").alias("chars"))
    own = turns.join(convs.select("conv", "h", "k", *start), "conv").where(F.col("no") > F.col("h"))

    def shifted(batches):
        for batch in batches:
            h, k, no = (_longs(batch, n).astype(np.int64) for n in ("h", "k", "no"))
            power = _powers(k - h)
            sums = [_hashes(batch, f"start_{x}") + power * (_hashes(batch, f"sum_{x}") - _hashes(batch, f"cut_{x}")) for x in "ab"]
            arrays = [batch.column(batch.schema.get_field_index("conv")), pa.array(no - h + k), *(pa.array(s.view(np.int64)) for s in sums), *(batch.column(batch.schema.get_field_index(n)) for n in ("turn_a", "turn_b", "chars"))]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv", "depth", "a", "b", "turn_a", "turn_b", "chars"])

    def parents(batches):
        for batch in batches:
            power = _powers(_longs(batch, "depth"))
            up = [_hashes(batch, x) - _hashes(batch, f"turn_{x}") * power for x in "ab"]
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("conv", "depth", "a", "b")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(u.view(np.int64)) for u in up), batch.column(batch.schema.get_field_index("chars"))], names=["conv", "depth", "a", "b", "pa", "pb", "chars"])

    plain = "conv long, depth long, a long, b long, turn_a long, turn_b long, chars long"
    lasts = convs.select("conv", F.col("h"), "k", F.col("all.no").alias("no"), F.col("all.sum_a").alias("sum_a"), F.col("all.sum_b").alias("sum_b"), *start, F.lit(0).cast("long").alias("turn_a"), F.lit(0).cast("long").alias("turn_b"), F.lit(0).cast("long").alias("chars"), "tail")
    ends = lasts.where("tail > 0").drop("tail").mapInArrow(shifted, plain).select("conv", "depth", "a", "b")
    short = convs.where("tail = 0").select("conv", F.col("k").cast("long").alias("depth"), *(F.coalesce(F.col(f"top.sum_{x}"), F.lit(0).cast("long")).alias(x) for x in "ab"))
    nodes = openings.union(own.select("conv", "h", "k", "no", "sum_a", "sum_b", "start_a", "start_b", "cut_a", "cut_b", F.col("a").alias("turn_a"), F.col("b").alias("turn_b"), "chars").mapInArrow(shifted, plain))
    return nodes.mapInArrow(parents, "conv long, depth long, a long, b long, pa long, pb long, chars long"), ends.union(short)


def partial_tries(nodes: DataFrame) -> DataFrame:
    """Node tables combined within tasks: rows (part, node, parent, smallest member, members), at most ``HELD`` rows in memory; a task's tables follow one another."""

    def run(batches):
        part = TaskContext.get().partitionId()

        def made(held):
            table = pa.Table.from_batches(held)
            out = table.group_by(["depth", "a", "b"]).aggregate([("pa", "min"), ("pb", "min"), ("chars", "min"), ("conv", "min"), ("conv", "count")]).combine_chunks()
            columns = {n: out[n].combine_chunks() for n in ("depth", "a", "b", "pa_min", "pb_min", "chars_min", "conv_min", "conv_count")}
            return pa.RecordBatch.from_arrays([pa.array([part] * out.num_rows, pa.int64()), *(c.cast(pa.int64()) for c in columns.values())], names=["part", "depth", "a", "b", "pa", "pb", "chars", "conv", "n"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield made(held)
                held, size = [], 0
        if size:
            yield made(held)

    return nodes.mapInArrow(run, "part long, depth long, a long, b long, pa long, pb long, chars long, conv long, n long")


def end_pieces(ends: DataFrame) -> DataFrame:
    """(part, node, first, ids): the conversations that end at a node as pieces of at most ``PIECE`` ascending ids in decimals, from ranges of ids that don't overlap."""
    dealt = ends.repartitionByRange("conv").sortWithinPartitions("conv")

    def run(batches):
        part = TaskContext.get().partitionId()

        def made(table):
            conv = table["conv"].to_numpy()
            keys = np.stack([table[n].to_numpy() for n in ("depth", "a", "b")])
            order = np.lexsort((conv, *keys))
            conv, keys = conv[order], keys[:, order]
            new = np.concatenate([[True], (np.diff(keys, axis=1) != 0).any(axis=0)])
            starts = np.flatnonzero(new)
            cuts = np.concatenate([np.arange(s, e, PIECE) for s, e in zip(starts, np.append(starts[1:], len(conv)), strict=True)])
            texts = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(cuts, np.append(cuts[1:], len(conv)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(cuts), pa.int64()), *(pa.array(k[cuts]) for k in keys), pa.array(conv[cuts]), pa.array(texts)], names=["part", "depth", "a", "b", "first", "ids"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield made(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield made(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "part long, depth long, a long, b long, first long, ids string")


def merged(partials: DataFrame) -> DataFrame:
    """Rounds of hash-keyed merges: in each, ``FAN`` neighbouring partial tables become one.

    Members are summed and end lists joined. A list of more than ``SEALED``
    pieces stands on its own from then on and isn't copied again, so that no
    row grows with the number of ends.
    """
    rows = written(partials, "partial_trie")
    parts = rows.agg(F.max("part")).first()[0]
    while parts is not None and parts > 0:
        parts //= FAN
        own = F.when(F.size("ends") > SEALED, F.col("ends")[0]["first"])
        rows = (
            rows.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
            .groupBy("depth", "a", "b", "part", own.alias("sealed"))
            .agg(*(F.min(c).alias(c) for c in ("pa", "pb", "chars", "conv")), F.sum("n").alias("n"), F.flatten(F.collect_list("ends")).alias("ends"))
            .select("part", "depth", "a", "b", "pa", "pb", "chars", "conv", "n", "ends")
        )
    return written(rows, "trie_rows")


def _digests(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): pieces pass in order of their first id, one at a time."""
    pieces = rows.select("depth", "a", "b", F.explode("ends").alias("e")).select("depth", "a", "b", "e.first", "e.ids")
    dealt = pieces.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first")

    def run(batches):
        last, state = None, None
        for batch in batches:
            out = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, ids in zip(keys, batch.column(4).to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield made(out)
        if last is not None:
            yield made([(*last, state.hexdigest())])

    def made(out):
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=["depth", "a", "b", "ends_sha256"])

    return dealt.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _rollup(nodes: DataFrame) -> DataFrame:
    """(depth, a, b, more_leaves, more_saved): what the nodes below each node add up to.

    Round k adds what lies between 2**k and 2**(k+1) - 1 levels below, from the
    nodes' own sums up to 2**k - 1 levels below them. Only nodes at least that
    deep take part.
    """
    active = nodes.where("depth > 0").select("depth", "a", "b", F.col("pa").alias("ja"), F.col("pb").alias("jb"), "leaves", "saved")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    far, found = 1, None
    while far <= deepest:
        up = active.groupBy((F.col("depth") - far).alias("depth"), F.col("ja").alias("a"), F.col("jb").alias("b")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = written(up, "rollup")
        found = up if found is None else found.union(up)
        if 2 * far <= deepest:
            over = active.select((F.col("depth") + far).alias("depth"), F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("next_a"), F.col("jb").alias("next_b"))
            deep = active.where(F.col("depth") >= 2 * far).join(over, ["depth", "ja", "jb"]).join(up, ["depth", "a", "b"], "left")
            active = written(deep.select("depth", "a", "b", F.col("next_a").alias("ja"), F.col("next_b").alias("jb"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))), "active")
        far *= 2
    if found is None:
        return nodes.select("depth", "a", "b", F.lit(0).cast("long").alias("more_leaves"), F.lit(0).cast("long").alias("more_saved")).limit(0)
    return found.groupBy("depth", "a", "b").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Each conversation is rebuilt from the opening of the first one of its
    hundred and its own later turns; the trie is that of the rebuilt ones. Null
    roles and texts are empty; null turns come first; turns that tie are ordered
    by the MD5 of role and text, and repeated rows are turns of their own. Rows
    with a null conversation belong to none and are left out. Texts of any
    length go by their hash and length from the first step on. An empty table
    gives no row, further columns are left alone.
    """
    turns = _joined(ordered_turns(conversations, conv_col, turn_col, role_col, text_col))
    turns = written(turns, "turns_joined")
    rows, ends = rebuilt(turns)
    no = F.lit(0).cast("long")
    none = F.array().cast("array<struct<first:bigint,ids:string>>")
    root = ends.groupBy(F.spark_partition_id().cast("long").alias("part")).agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    partials = (
        partial_tries(rows).select("*", none.alias("ends"))
        .union(root.select("part", no.alias("depth"), no.alias("a"), no.alias("b"), no.alias("pa"), no.alias("pb"), no.alias("chars"), "conv", "n", none.alias("ends")))
        .union(end_pieces(ends).select("part", "depth", "a", "b", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), F.lit(None).cast("long").alias("chars"), F.lit(None).cast("long").alias("conv"), no.alias("n"), F.array(F.struct("first", "ids")).alias("ends")))
    )
    rows = merged(partials)
    node = ["depth", "a", "b"]
    nodes = rows.groupBy(*node).agg(*(F.min(c).alias(c) for c in ("pa", "pb", "chars", "conv")), F.sum("n").alias("n"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, node, "left").select(*node, "pa", "pb", "conv", "n", F.coalesce("n_children", no).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    nodes = written(nodes, "nodes")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    full = nodes.join(parents, ["depth", "pa", "pb"], "left").join(_rollup(nodes), node, "left").join(_digests(rows), node, "left")
    return full.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", no)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", no)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
