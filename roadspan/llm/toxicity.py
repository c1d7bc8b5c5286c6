"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A position's input is a word embedding next to the scaled sum of its character
n-gram embeddings, so that words never seen still score by their letters. The
first dimension of both begins as the lower confidence bound of the log-odds
that toxic training texts hold the word or n-gram. Every
text is scored in overlapping windows that cover all of it; its score is that
of its highest window. In training, too, a text's label is given to the window
that scores highest at the time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspan.llm._sample import bounded
from roadspan.llm._text import _LOWER, _SPACE, U64, bytes_of, slices, word_hashes

WINDOW, STRIDE = 32, 16  # words
WORD_BUCKETS, CHAR_BUCKETS = 1 << 17, 1 << 18
ORDERS = (3, 4, 5)  # characters
DIM, HIDDEN, ATTENTION = 8, 8, 8
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000  # most labelled texts of each kind that are learned from
EPOCHS, STEPS, BATCH, RATE = 5, 150, 128, 0.01
SAMPLE_BYTES = 1 << 25  # and of their texts together, of each kind
SEED = 11
PART = 10_000  # words or windows worked out at once


class Words:
    """The distinct words of some texts: word bucket, character n-gram buckets, and where each word's begin."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        self.n = len(starts)
        parts = [_grams(values, starts[i : i + PART], ends[i : i + PART]) for i in range(0, self.n, PART)]  # bounds the temporaries
        self.grams = np.concatenate([np.zeros(0, np.int32), *(g for g, _ in parts)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), self.counts)
        self.bucket = (hashes % U64(WORD_BUCKETS)).astype(np.int32)

    def inputs(self, net: dict) -> np.ndarray:
        """Input vector of each word."""
        chars = np.zeros((self.n, DIM), np.float32)
        some = np.flatnonzero(self.counts)
        begin = (np.cumsum(self.counts) - self.counts)[some]
        for i in range(0, len(some), 10_000):  # bounds the gathered rows
            part = begin[i : i + 10_000]
            end = begin[i + 10_000] if i + 10_000 < len(begin) else len(self.grams)
            chars[some[i : i + 10_000]] = np.add.reduceat(net["chars"][self.grams[part[0] : end]], part - part[0], axis=0)
        chars /= np.sqrt(np.maximum(self.counts, 1))[:, None]
        return np.concatenate([net["words"][self.bucket], chars], axis=1)


def _grams(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character n-gram buckets of some words, word by word, and how many each word has."""
    size = ends - starts
    total = size + 2
    at = np.cumsum(total) - total
    n = int(total.sum())
    flat = np.full(n, 2, np.uint32)
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    flat[at[owner] + 1 + inner] = _LOWER[values[starts[owner] + inner]]
    row = np.repeat(np.arange(len(size), dtype=np.int32), total)
    grams, rows, h = [], [], np.zeros(n, np.uint32)
    for k in range(1, max(ORDERS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + (flat[k - 1 :] + np.uint32(k * 257)) * np.uint32(0x9E3779B1)
        if k in ORDERS:
            inside = row[:m] == row[k - 1 :]
            mixed = (h ^ (h >> np.uint32(16))) * np.uint32(0x45D9F3B)
            grams.append(((mixed ^ (mixed >> np.uint32(15))) % np.uint32(CHAR_BUCKETS))[inside])
            rows.append(row[:m][inside])
    grams, rows = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (grams, rows))
    return grams[np.argsort(rows, kind="stable")].astype(np.int32), np.bincount(rows, minlength=len(size))


def windows(values: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(distinct words, windows as word numbers from 1 with 0 for padding, row of each window).

    Windows of 32 words begin every 16 words until the text's last word is
    covered; a text without words has one empty window.
    """
    hashes, starts, ends, at = _spans(values, offsets)
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    words = Words(values, starts[first], ends[first], unique)
    n = np.diff(at)
    per = np.maximum(1, -(-(n - STRIDE) // STRIDE))
    row = np.repeat(np.arange(len(n)), per)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    numbers = np.zeros((len(row), WINDOW), np.int32)
    for i in range(0, len(row), PART):
        own = row[i : i + PART]
        where = begin[i : i + PART, None] + np.arange(WINDOW)
        inside = where < n[own][:, None]
        numbers[i : i + PART][inside] = inverse[(at[own][:, None] + where)[inside]] + 1
    return words, numbers, row


def _spans(values: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first bytes, end bytes of all words, each row's offsets into them), worked out in parts of bounded size."""
    parts, at, i = [], [np.zeros(1, np.int64)], 0
    while i < len(offsets) - 1:
        to = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        own, own_at = values[offsets[i] : offsets[to]], offsets[i : to + 1] - offsets[i]
        n = len(own)
        solid = np.zeros(n + 2, dtype=bool)
        solid[1:-1] = ~_SPACE[own]
        edge = np.zeros(n + 1, dtype=bool)
        edge[own_at] = True
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        hashes, words_at = word_hashes(own, own_at)
        parts.append((hashes, starts + offsets[i], ends + offsets[i]))
        at.append(words_at[1:] + at[-1][-1])
        i = to
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return hashes, starts, ends, np.concatenate(at)


def fresh() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = {"words": make(WORD_BUCKETS, DIM, scale=0.1), "chars": make(CHAR_BUCKETS, DIM, scale=0.3)}
    for d in "fb":
        net |= {f"W{d}": make(2 * DIM, 3 * HIDDEN, scale=0.35), f"U{d}": make(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    return net | {"A": make(2 * HIDDEN, ATTENTION, scale=0.3), "v": make(ATTENTION, scale=0.5), "o": make(2 * HIDDEN, scale=0.3), "c": np.full(1, -1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(net: dict, d: str, x: np.ndarray, numbers: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (time, window, unit) of one direction; ``x``: projected inputs, row 0 for padding."""
    b, t = numbers.shape
    h = np.zeros((b, HIDDEN), np.float32)
    out = np.empty((t, b, HIDDEN), np.float32)
    U = net[f"U{d}"]
    for i in range(t) if d == "f" else range(t - 1, -1, -1):
        live = (numbers[:, i] > 0).astype(np.float32)[:, None]
        a, u = x[numbers[:, i]], h @ U
        zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        new = h + live * (1 - z) * (n - h)
        if keep is not None:
            keep.append((i, live, h, z, r, n, u[:, 2 * HIDDEN :]))
        h = out[i] = new
    return out


def forward(net: dict, words: Words, numbers: np.ndarray, keep: dict | None = None, inputs: np.ndarray | None = None) -> np.ndarray:
    """Probability of each window."""
    x = words.inputs(net) if inputs is None else inputs
    hidden = []
    for d in "fb":
        a = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
        a[1:] = x @ net[f"W{d}"] + net[f"b{d}"]
        hidden.append(_run(net, d, a, numbers, None if keep is None else keep.setdefault(d, [])))
    h = np.concatenate(hidden, axis=2)
    t = np.tanh(h @ net["A"])
    s = t @ net["v"]
    live = numbers.T > 0
    e = np.where(live, np.exp(s - s.max(axis=0)), 0)
    w = e / np.maximum(e.sum(axis=0), 1e-20)
    pooled = np.einsum("tb,tbh->bh", w, h)
    p = _sigmoid(pooled @ net["o"] + net["c"][0])
    if keep is not None:
        keep |= {"x": x, "h": h, "t": t, "w": w, "pooled": pooled}
    return p


def gradients(net: dict, words: Words, numbers: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted mean cross-entropy by back-propagation through time."""
    k: dict = {}
    p = forward(net, words, numbers, k)
    g = {n: np.zeros_like(v) for n, v in net.items() if n not in ("words", "chars")}
    ds = ((p - labels) * weights / weights.sum()).astype(np.float32)
    g["o"], g["c"] = k["pooled"].T @ ds, np.array([ds.sum()], np.float32)
    dp = ds[:, None] * net["o"]
    dw = np.einsum("bh,tbh->tb", dp, k["h"])
    de = k["w"] * (dw - (k["w"] * dw).sum(axis=0))
    g["v"] = np.einsum("tb,tba->a", de, k["t"])
    dt = de[:, :, None] * net["v"] * (1 - k["t"] ** 2)
    g["A"] = np.einsum("tbh,tba->ha", k["h"], dt)
    dh_all = k["w"][:, :, None] * dp + dt @ net["A"].T
    dx = np.zeros_like(k["x"])
    for j, d in enumerate("fb"):
        dh = np.zeros((len(numbers), HIDDEN), np.float32)
        da = np.zeros((len(k["x"]) + 1, 3 * HIDDEN), np.float32)
        for i, live, before, z, r, n, un in reversed(k[d]):
            dh = dh + dh_all[i][:, j * HIDDEN : (j + 1) * HIDDEN]
            new = dh * live
            dn = new * (1 - z) * (1 - n * n)
            dz = new * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(da, numbers[:, i], np.concatenate([dz, dr, dn], axis=1))
            g[f"U{d}"] += before.T @ du
            dh = dh * (1 - live) + new * z + du @ net[f"U{d}"].T
        da = da[1:]
        g[f"W{d}"], g[f"b{d}"] = k["x"].T @ da, da.sum(axis=0)
        dx += da @ net[f"W{d}"].T
    g["words"] = _summed(words.bucket, dx[:, :DIM])
    g["chars"] = _summed(words.grams, (dx[:, DIM:] / np.sqrt(np.maximum(words.counts, 1))[:, None])[words.rows])
    return g


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, summed values): the gradient of a table of which few rows were used."""
    if not len(at):
        return at, values
    order = np.argsort(at, kind="stable")
    begin = np.flatnonzero(np.diff(at[order], prepend=-1))
    return at[order][begin], np.add.reduceat(values[order], begin, axis=0)


def _log_odds(ones: np.ndarray, zeros: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Lower confidence bound, not below 0, of the log-odds that a toxic text holds a bucket rather than a clean one."""
    ones, zeros = ones + 0.5, zeros + 0.5
    odds = np.log(ones / (labels.sum() + 1)) - np.log(zeros / ((1 - labels).sum() + 1))
    return np.maximum(0, odds - 1.5 * np.sqrt(1 / ones + 1 / zeros)).astype(np.float32)


def _subset(words: Words, used: np.ndarray) -> Words:
    """The words of the given numbers only."""
    out = object.__new__(Words)
    keep = np.zeros(words.n, bool)
    keep[used] = True
    new = np.cumsum(keep) - 1
    on = keep[words.rows]
    out.n, out.grams, out.rows = int(keep.sum()), words.grams[on], new[words.rows[on]].astype(np.int32)
    out.counts, out.bucket = words.counts[keep], words.bucket[keep]
    return out


def fit(texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Train on texts and 0/1 labels; without both labels the untrained network, which scores low, is returned."""
    net = fresh()
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return net
    values = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    words, numbers, row = windows(values, offsets)
    rng = np.random.default_rng(SEED)

    first = np.flatnonzero(np.diff(row, prepend=-1))
    begin = np.cumsum(words.counts) - words.counts
    held = {n: np.zeros((2, len(net[n]))) for n in ("words", "chars")}
    for y, rows in zip(labels.astype(int), np.split(numbers, first[1:]), strict=True):
        own = np.unique(rows)
        own = own[own > 0] - 1
        n = words.counts[own]
        grams = words.grams[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        held["words"][y, np.unique(words.bucket[own])] += 1
        held["chars"][y, np.unique(grams)] += 1
    for n, (zeros, ones) in held.items():
        net[n][:, 0] = _log_odds(ones, zeros, labels)

    count = np.diff(np.append(first, len(row)))
    moment = {n: np.zeros_like(v) for n, v in net.items()}
    square = {n: np.zeros_like(v) for n, v in net.items()}
    positive = np.float32(max(1.0, (labels == 0).sum() / (labels == 1).sum() / 2))
    rounds = max(EPOCHS, -(-STEPS * BATCH // len(texts)))
    step, total = 0, 0
    for epoch in range(rounds):
        if epoch == 0 or epoch * 5 // rounds != (epoch - 1) * 5 // rounds:
            p = predict_windows(net, words, numbers)
            top = np.lexsort((-p, row))[first]
        some = first + (rng.random(len(first)) * count).astype(np.int64)
        chosen = np.concatenate([top, some[labels == 0]])
        rng.shuffle(chosen)
        total = total or rounds * -(-len(chosen) // BATCH)
        for i in range(0, len(chosen), BATCH):
            part = chosen[i : i + BATCH]
            used = np.unique(numbers[part])
            used = used[used > 0]
            own = np.searchsorted(used, numbers[part]) + 1
            own[numbers[part] == 0] = 0
            y = labels[row[part]]
            g = gradients(net, _subset(words, used - 1), own, y, np.where(y > 0, positive, 1).astype(np.float32))
            step += 1
            rate = RATE * (1.1 - step / total)
            for n, v in net.items():
                at, d = g[n] if isinstance(g[n], tuple) else (slice(None), g[n])
                moment[n][at] = m = 0.9 * moment[n][at] + 0.1 * d
                square[n][at] = q = 0.99 * square[n][at] + 0.01 * d * d
                v[at] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
    # where both kinds are apart, even odds lie between them, nearer to the toxic side
    p = np.clip(np.maximum.reduceat(predict_windows(net, words, numbers), first), 1e-7, 1 - 1e-7)
    z = np.log(p / (1 - p))
    clean, toxic = np.quantile(z[labels == 0], 0.995), np.quantile(z[labels == 1], 0.02)
    if toxic > clean:
        net["c"] -= np.float32(0.4 * clean + 0.6 * toxic)
    return net


def predict_windows(net: dict, words: Words, numbers: np.ndarray, batch: int = 4096) -> np.ndarray:
    x = words.inputs(net)
    return np.concatenate([forward(net, words, numbers[i : i + batch], inputs=x) for i in range(0, len(numbers), batch)])


def score_texts(net: dict, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Highest window's probability of each row."""
    if len(offsets) < 2:
        return np.zeros(0)
    words, numbers, row = windows(values, offsets)
    return np.maximum.reduceat(predict_windows(net, words, numbers), np.flatnonzero(np.diff(row, prepend=-1))).astype(np.float64).round(6)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that nothing is learned from; null ids are not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> dict[str, np.ndarray]:
    """Fit on at most ``toxic`` and ``clean`` labelled texts of each kind that aren't held out, of ``SAMPLE_BYTES`` together; those few reach the driver.

    A document that is labelled more than once counts as toxic if any label
    says so; of texts with one id the smallest is learned from. Null labels,
    ids and texts are left out. All windows of a text are learned from.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    kept = bounded(known.where("y = 1"), F.col("k"), toxic).union(bounded(known.where("y = 0"), F.col("k"), clean))
    # a few thousand ids: the join's small side, of a proven bound
    found = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("binary").alias("t")).where("t is not null").join(F.broadcast(kept), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    before = Window.partitionBy("y").orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("bytes", F.sum(F.octet_length("t")).over(before)).where(F.col("bytes") <= SAMPLE_BYTES).select("k", "y", "t").toArrow().sort_by("k")
    return fit(found["t"].to_pylist(), found["y"].to_numpy())


def score(docs: DataFrame, net: dict[str, np.ndarray], text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each whole text, from the text alone; a column of that name is replaced.

    Null and empty texts have the score of an empty window, equal texts equal
    scores, whatever rows they stand beside.
    """
    base = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for part in slices(batches, text_col, 1 << 19):
            scores = score_texts(shared.value, *bytes_of(part.column(part.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, score_col])

    return base.mapInArrow(run, base.select("*", F.lit(0.0).alias(score_col)).schema)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``toxicity``, learned from ``labels`` of documents that aren't held out.

    Every row is scored: see ``score`` for null, empty and equal texts and
    ``train`` for nulls and repeats in what is learned from. Without labels of
    both kinds all scores are low. An empty table gives an empty result.
    """
    return score(docs, train(docs, labels, id_col, text_col), text_col)
