"""The quality rules, the conversation trie and the ranked search against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspan.llm import lexical, quality, trie
from roadspan.ship import ship

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sp(spark):
    return ship(spark)


# --- quality ---


def _plain_statistics(text):
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    is_mark = lambda c: not (c.isalpha() or c.isnumeric() or c.isspace())
    marks = [c for c in text if is_mark(c)]
    return {
        "words": len(words), "word_length": share(sum(map(len, words)), len(words)), "distinct_words": share(len(set(words)), len(words)), "repeated_next": share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
        "distinct_lines": share(len(set(lines)), len(lines)), "line_words": share(len(words), len(lines)), "upper": share(sum(c.isupper() for c in text), len(text)), "digits": share(sum(c.isnumeric() for c in text), len(text)),
        "marks": share(len(marks), len(text)), "symbols": share(sum(c not in ".,;:'\"()?-" for c in marks), len(text)), "stops": share(sum(c in ".?" for c in marks), len(words)), "white": share(sum(c.isspace() for c in text), len(text)),
    }


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "One two.\nOne two.", "Te Te Te tE 12 ½ ##!! | a", "Ünder Ärger; ÇA", "x" * 300_000, "ab " * 50_000]
    rows = quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "pieces")
    got = {r.i: r.pieces.asDict() for r in rows.select("i", "pieces").collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(_plain_statistics(t), abs=1e-12), t and t[:20]


def test_column_equals_the_rules_on_the_table(spark):
    rng = np.random.default_rng(1)
    names = list(quality.STATISTICS)
    table = rng.random((400, len(names)))
    labels = ((table[:, 2] > 0.4) & (table[:, 9] < 0.7) | (table[:, 0] > 0.9)).astype(float)
    model = quality.fit(table, names, labels)
    assert model.rules and len(model.rules) < len(quality.paths(table, names, labels)) and len(model.describe()) == len(model.rules)
    z = model.intercept + sum(w * r.holds(table, names) for r, w in model.rules)
    want = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in table], ", ".join(f"{n} double" for n in names))
    got = np.array([r.s for r in df.select(model.column({n: F.col(n) for n in names}).alias("s")).collect()])
    assert np.abs(got - want).max() < 1e-6 and ((got >= 0.5) == (labels > 0)).mean() > 0.95


def test_lasso_is_optimal():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 6)) < 0.5).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    penalty = 0.02
    w = quality.lasso(x, y, penalty)
    g = x.T @ (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y) / len(y)
    assert all(abs(d + penalty * np.sign(v)) < 1e-3 if v else abs(d) <= penalty + 1e-3 for d, v in zip(g, w[:-1], strict=True))
    assert (quality.lasso(x, y, 10.0)[:-1] == 0).all()


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.assess(docs, labels).join(labels, "doc_id").where(quality.held_out()).select("quality", "quality_score").collect()
    right = [(r.quality_score >= 0.3) == (r.quality == 1) for r in rows]
    assert len(rows) > 50 and np.mean(right) > 0.95 and all(r.quality_score >= 0.3 for r in rows if r.quality == 1)


def test_quality_of_odd_rows(spark):
    good, bad = "The quick fox, it seems, ran over some hills. ", "$$$ $$$ ### "
    rows = [(i, good * 3 if i % 2 else bad * 9) for i in range(60)] + [(None, good), (90, None), (91, ""), (92, good * 3), (92, bad * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pieces": F.lit(1), "statistics": F.lit(2), "quality_score": F.lit(-1.0), "k": F.lit(3)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (None, 1), (92, None)], "doc_id long, quality int")
    out = quality.assess(docs, labels)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(rows)
    by = defaultdict(set)
    for r in out.collect():
        by[r.text].add(r.quality_score)
        assert r.pieces == 1 and r.statistics == 2 and r.k == 3
    assert all(len(v) == 1 and 0 <= min(v) <= 1 for v in by.values()) and min(by[good * 3]) > 0.9 and max(by[bad * 9]) < 0.1
    assert by[None] == by[""]
    assert quality.assess(docs.limit(0), labels).count() == 0
    for only in (labels.limit(0), labels.where("quality = 1")):
        assert quality.assess(docs, only).select("quality_score").distinct().count() == 1


# --- trie ---


def _plain_trie(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h]) + tuple(turns[h:])
    nodes = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    out = set()
    for s, cs in nodes.items():
        below = [t for t in nodes if t[: len(s)] == s]
        leaves = sum(not any(u[:-1] == t and u for u in nodes) for t in below)
        saved = sum((len(nodes[t]) - 1) * len(t[-1][1]) for t in below if t)
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(s))))
        out.add((min(cs), len(s), min(nodes[s[:-1]]) if s else None, len(cs), sum(len(t) == len(s) + 1 for t in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _trie(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    df = df.withColumns({"part": F.lit(7), "a": F.lit("x"), "DEPTH": F.lit(1), "no": F.lit(None).cast("int")})
    return [tuple(r) for r in trie.prefix_trie(df).collect()]


def test_trie_against_a_plain_one(sp):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 14), *range(95, 112), *range(300, 306), 707]:
        for t in range(rng.choice([0, 1, 3, 7, 9])):
            rows.append((c, rng.choice([t, t, None, 2]), rng.choice(["user", "user", None]), rng.choice(["a", "bb", "é😀", "", None])))
    rows += rows[:5] + [(None, 1, "user", "left out"), (0, 1, "", "a"), (0, 1, None, "a")]
    got = _trie(sp, rows)
    assert len(got) == len(set(got)) and set(got) == _plain_trie(rows)


def test_trie_of_one_long_conversation_and_many_copies(sp):
    rows = [(5, t, "user", f"turn {t}") for t in range(300)]  # cut over all parts
    rows += [(c, t, "user", f"same {t}") for c in range(200, 1800) for t in range(3)]
    got = _trie(sp, rows)
    assert len(got) == len(set(got)) and max(r[1] for r in got) > 290
    assert set(got) == _plain_trie(rows)


def test_long_end_lists_stay_in_order(sp, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie, "SEALED", 2)
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "HELD", 50)
    rows = [(c, 0, "user", "same") for c in random.Random(1).sample(range(100_000), 900)]
    assert set(_trie(sp, rows, 4)) == _plain_trie(rows)


def test_empty_trie_and_turnless_conversations(sp):
    assert _trie(sp, []) == []
    rows = [(c, 0, "user", "x") for c in range(101, 130)]  # none has a first one to take turns from
    assert set(_trie(sp, rows)) == _plain_trie(rows)


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _plain_search(docs, items, k):
    held = [(d, Counter(_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(_terms(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c, n in held:
            m = 50 + 50 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _search(spark, docs, items, k, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns({"id": F.lit(1), "segment": F.lit("x"), "term": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(1), "doc_id": F.lit(3)})
    return sorted((tuple(r) for r in lexical.search(d, i, k).collect()), key=str)


def _corpus(rng, n):
    words = ["Alpha", "beta", "gamma", "d2", "élan", "日本", "the", "of", "x", "rare"] + [f"w{i}" for i in range(60)]
    return [(rng.randrange(10_000), rng.choice([None, "", " -- ", " ".join(rng.choices(words, k=rng.randrange(1, 30))) + rng.choice([".", "!\x00the", ""])])) for _ in range(n)]


def test_search_against_all_scores(sp, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 40)
    monkeypatch.setattr(lexical, "FIRST", 3)
    rng = random.Random(6)
    docs = _corpus(rng, 900)
    docs += docs[:40] + [(None, docs[50][1]), (7, "the the the"), (8, "the the the"), (6, "THE THE THE")]
    items = [(i, t) for i, (_, t) in enumerate(_corpus(rng, 25))] + [(3, "rare Alpha"), (None, "beta beta"), (99, "nowhere else"), (100, "the")]
    for pairs in (lexical.PAIRS, 40):  # one block, several
        monkeypatch.setattr(lexical, "PAIRS", pairs)
        assert _search(sp, docs, items, 10) == _plain_search(docs, items, 10)


def test_search_of_very_long_texts(sp, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 1000)
    rng = random.Random(8)
    long = " ".join(rng.choices(["the", "of", "a1", "bb", "ccc", "longword" * 40], k=3000))
    docs = [(1, long), (2, "x" * 5000 + " the"), (3, "y" * 2500), (4, "the bb"), (5, None)]
    items = [(1, "the bb ccc"), (2, "x" * 5000), (3, long)]
    assert _search(sp, docs, items, 3, 1) == _plain_search(docs, items, 3)


def test_search_of_nothing(sp):
    assert _search(sp, [], [(1, "the")], 5) == [] == _search(sp, [(1, "the")], [], 5) == _search(sp, [(1, "the")], [(1, None)], 5)
    assert dict(lexical.search(sp.createDataFrame([], "doc_id long, text string"), sp.createDataFrame([], "item_id long, text string")).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_branch_and_bound_opens_little_and_misses_nothing():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 50, 2000)
    doc = np.repeat(np.arange(2000), 6)
    term = rng.integers(0, 300, len(doc))
    keys = np.unique(doc * 300 + term)
    doc, term = np.divmod(keys, 300)
    tf = rng.integers(1, 5, len(doc))
    query = lexical.Query(None, np.array([0, 1]), np.array([0]), np.array([1]), 2000, int(n.sum()), 5, np.zeros(1, np.int64))
    tree = lexical.Tree(n, doc, term, tf, query)
    assert [x.shape[1] for x in tree.levels] == [32, 4, 1]
    terms, weights = np.array([3, 77, 150]), np.array([900, 4000, 2500])
    m = 50 + 50 * n * 2000 // int(n.sum())
    full = np.zeros(2000, np.int64)
    for t, w in zip(terms, weights, strict=True):
        at = np.flatnonzero(term == t)
        full[doc[at]] += w * (10**9 * tf[at] // (1000 * tf[at] + 20 * m[doc[at]]))
    slots = np.searchsorted(tree.terms, terms)
    limit = int(np.sort(full)[-5])
    found, opened = {}, 0
    steps = tree.search(slots, weights, limit)
    part = next(steps, None)
    while part:
        opened += 1
        found |= dict(zip(part[0].tolist(), part[1].tolist(), strict=True))
        try:
            part = steps.send(limit)
        except StopIteration:
            part = None
    assert found == {int(d): int(full[d]) for d in np.flatnonzero(full >= limit)} and opened <= 10
