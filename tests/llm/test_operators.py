"""Small tables of odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadspan.llm import bpe, decontam, langid, licenses, media, ngram_join, sst, toxicity, url_filter, warc

LONG = "word " * 30_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs", "en", "b"),
    (2, "the quick brown fox jumps over the lazy dog and runs", "en", "b"),
    (3, "", "en", "a"),
    (4, None, None, None),
    (None, "null id here", "en", "a"),
    (5, LONG, "en", "a"),
    (6, "der schnelle braune fuchs springt über den faulen hund", "de", "a"),
    (7, " \n\t ", "de", "a"),
    (8, "123 ... 456", "de", "a"),
    (9, "one two", "en", "c"),
    (10, "ONE TWO", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    clash = ("id", "key", "n", "t", "k", "h", "c", "a", "b", "ids", "digest", "seeds", "rep", "component", "payload")
    return base.withColumns({c: F.lit("clash") for c in clash})


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_jaccard_components(spark, docs):
    got = _rows(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(1, 7, 1), (2, 7, 1), (2, 7, 1), (3, 0, 3), (4, 0, 4), (None, 1, None), (5, 1, 5), (6, 5, 6), (7, 0, 7), (8, 1, 8), (9, 1, 9), (10, 1, 9)], key=str)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 40))]
        texts.append(base)
        for _ in range(rng.integers(0, 6)):
            copy = list(base)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(0, len(copy))] = f"x{rng.integers(0, 5)}"
            texts.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_of_large_groups(spark):
    """Thousands of near copies of one text, some of them with an edit in common, and thousands of short texts."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(70)]
    texts = []
    for i in range(1600):
        copy = list(base)
        if i % 3 == 0:
            copy[20] = "common"
        for at in rng.integers(0, 70, rng.integers(0, 4)):
            copy[at] = f"x{i}"
        texts.append(copy)
    texts += [[f"s{x}" for x in rng.integers(0, 4, rng.integers(1, 15))] for _ in range(1600)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in texts]
    number = {x: i for i, x in enumerate({x for s in sets for x in s})}
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    linked = 100 * both >= 80 * (size[:, None] + size - both)
    want = np.arange(len(sets))
    while True:
        low = np.where(linked, want, len(sets)).min(axis=1)
        if (low == want).all():
            break
        want = low
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(sets))] == want.tolist() and len(set(want[:1600].tolist())) > 5


def test_components_in_chunks(spark, monkeypatch):
    from roadspan.llm import _graph

    monkeypatch.setattr(_graph, "CHUNK", 40)
    rng = np.random.default_rng(1)
    pairs = [*((i, i + 1) for i in range(60)), *((int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))), (7, 7)]
    label = {x: x for p in pairs for x in p}
    while True:
        new = dict(label)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    assert {k: got.get(k, k) for k in label} == label


def test_bpe_round_trip_equals_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.default_path(spark)
    library = Tokenizer.from_file(path)
    for r in bpe.round_trip(docs, path).select("text", "ids", "decoded", "key").collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) and r["key"] == "clash"
    assert _rows(bpe.decode(bpe.encode(docs, path), path), "decoded") == _rows(docs.select(F.coalesce("text", F.lit("")).alias("decoded")), "decoded")
    model = bpe.BpeModel.from_file(path)
    for t in ("a<|endoftext|> b", "\x1c\x85\u3000 x", "don't  we'll\r\n", "½² 日本語 😀\u0301", "a" * 3000, " " * 50 + "x"):
        assert np.frombuffer(model.encode(t), np.int32).tolist() == library.encode(t, add_special_tokens=False).ids
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_sst_shards(spark, docs):
    from tokenizers import Tokenizer

    path = sst.default_path(spark)
    library = Tokenizer.from_file(path)
    rows = sst.store(docs, path).orderBy("start").collect()
    want = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (doc_id, text) in zip(rows, want, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, start, len(ids), ids)
        start += len(ids)
    encoder = sst.WordEncoder.from_file(path)
    manifest = sst.write(docs, encoder, sst.fresh_dir(spark, "t"), 2)
    assert sst.lookup(manifest, 9).tolist() == [*library.encode("one two").ids, 2]
    assert sst.lookup(manifest, 4).tolist() == [2] and sst.lookup(manifest, 77) is None
    assert sst.store(docs.limit(0), path).count() == 0
    for t in ("ΑΣ Σ ß İ", "Word, it's. 'S! <|endoftext|>x a\u0301 \u2003b", "x.. y,z !?"):
        assert encoder.encode(pa.array([t]))[1] == np.array(library.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes()


def test_sst_ids_where_normalising_matters(spark):
    from tokenizers import Tokenizer

    path = sst.default_path(spark)
    library, encoder = Tokenizer.from_file(path), sst.WordEncoder.from_file(path)
    for t in ("<|ENDOFTEXT|>", "A <|EndOfText|>x B. <|endoftext|> C", "BELED\u0130YES\u0130.", "\u0130,", "<|endoftext|>. ABC! \u00c9T\u00c9? \u0130\u0130! \u01c5. \u1e9e,"):
        assert encoder.encode(pa.array([t]))[1] == np.array(library.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes(), t


def _decoded(png: bytes) -> bytes:
    """Samples of a grey 8-bit image, by the format's rules alone."""
    assert png[:8] == bytes([137]) + b"PNG\r\n" + bytes([26, 10])
    at, kinds, data = 8, [], b""
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
        kinds.append(kind)
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and set(kinds[1:-1]) == {b"IDAT"}
    raw = zlib.decompress(data)
    assert len(raw) == height * (width + 1)
    rows = [raw[i : i + width + 1] for i in range(0, len(raw), width + 1)]
    assert all(r[0] == 0 for r in rows)
    return b"".join(r[1:] for r in rows)


def _padded(text):
    raw = (text or "").encode()
    return raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))


def test_media(spark, docs):
    got = _rows(media.media_columns(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = [(i, len((t or "").encode()), len(_padded(t)), hashlib.sha256(_padded(t)).hexdigest(), zlib.crc32(_padded(t)[-64:])) for i, t, *_ in ROWS]
    assert got == sorted(want, key=str)
    stored = {r.payload_sha256: (r.media_bytes, r.media_sha256, r.feature) for r in media.media_columns(docs).collect()}
    for _, t, *_ in ROWS:
        png = media.to_png(_padded(t))
        size, digest, feature = stored[hashlib.sha256(_padded(t)).hexdigest()]
        assert _decoded(png) == _padded(t) == media.from_png(png) and (size, digest) == (len(png), hashlib.sha256(png).hexdigest())
        assert feature == f"png 64x{len(_padded(t)) // 64} 8-bit;mean={np.mean(list(_padded(t))):.4f};levels={len(set(_padded(t)))}"
    assert media.media_columns(docs.limit(0)).count() == 0


def test_media_shards_are_tar_files_of_images(spark, docs):
    target = media.fresh_dir(spark, "tar")
    payloads = docs.select(media.payload(F.col("text")).alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    index = media.metadata(media.by_shard(media.store(payloads, target))).collect()
    assert len(index) == len({_padded(t) for _, t, *_ in ROWS}) and all((r.width, r.bits) == (64, 8) for r in index)
    members = {}
    for path in {r.path for r in index}:
        with tarfile.open(path.removeprefix("file://")) as tar:
            for m in tar:
                members[path, m.offset_data] = (m.name, tar.extractfile(m).read())
    for r in index:
        name, png = members[r.path, r.offset]
        assert name == r.digest.hex() + ".png" and len(png) == r.length and hashlib.sha256(_decoded(png)).hexdigest() == r.digest.hex() and r.height * 64 == len(_decoded(png))


def test_warc(spark):
    big = "x" * 200_000
    rows = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/\r\n", None), (5, "u", ""), (6, "u", big), (6, "u", big), (None, "v", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).withColumns({"id": F.lit(1), "record": F.lit(2), "data": F.lit("x")})
    got = _rows(warc.archive(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == sorted([(1, 4, "response", None), (3, 4, "revisit", 1), (None, 4, "revisit", 1), (2, 0, "response", None), (5, 0, "revisit", 2), (6, 200_000, "response", None), (6, 200_000, "revisit", 6)], key=str)
    digests = {r.page_id: r.payload_digest for r in warc.archive(pages).collect()}
    assert digests[6] == warc.base32(hashlib.sha1(big.encode()).digest())
    small = _rows(warc.archive(pages, least_bytes=5), "page_id", "record_type")
    assert small.count((3, "response")) == 1 and (6, "revisit") in small
    assert warc.archive(pages.limit(0)).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", None, "/"), ("block", "a.net", "")], "verdict string, host string, path string")
    urls = ["http://x.Example.COM/en/1?q", "https://www.example.com/en/", "http://example.com", "http://notexample.com/en/", "net/es/", None, "", "http://b.net/es/x", "ftp://a.net#f", "http://a.net/es/", "x://y://net/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "h", "p", "b", "won", "_Won", "key", "n")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {
        0: ("x.example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 2: ("example.com", "", None, "allow"),
        3: ("notexample.com", "/en/", "com/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("b.net", "/es/x", "net/es/", "block"),
        8: ("a.net", "", "a.net", "block"), 9: ("a.net", "/es/", "net/es/", "block"), 10: ("y:", "//net/es/", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    # one length twice: the longer host wins; of a rule that is given twice the smaller verdict; pages may repeat
    tied = spark.createDataFrame([("allow", "b.org", "/x"), ("block", "a.b.org", ""), ("block", "c.org", "/"), ("allow", "c.org", "/")], "verdict string, host string, path string")
    again = spark.createDataFrame([(1, "http://a.b.org/x"), (1, "http://a.b.org/x"), (2, "http://c.org/")], "page_id long, url string")
    assert _rows(url_filter.judge(again, tied), "page_id", "rule", "verdict") == [(1, "a.b.org", "block"), (1, "a.b.org", "block"), (2, "c.org/", "allow")]
    # most rows without a host, a third of one url, in many partitions, a long url, and columns named as working ones
    many = spark.range(0, 3000, 1, 40).selectExpr("id as page_id", "case id % 3 when 0 then 'http://a.b.org/x' when 1 then null else 'no host' end as url", "'clash' as part", "'clash' as _part")
    long = spark.createDataFrame([(-1, "http://c.org/" + "y" * 300_000)], "page_id long, url string").withColumns({"part": F.lit("clash"), "_part": F.lit("clash")})
    judged = url_filter.judge(many.union(long), tied)
    assert judged.columns == ["page_id", "url", "part", "_part", "host", "path", "rule", "verdict"]
    counts = {(r.rule, r.verdict, r.part): r["count"] for r in judged.groupBy("rule", "verdict", "part").count().collect()}
    assert counts == {("a.b.org", "block", "clash"): 1000, ("c.org/", "allow", "clash"): 1, (None, "allow", "clash"): 2000}


def test_language(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(docs).collect()}
    assert got[4][0] == got[3][0] == got[7][0] == got[8][0] == "und" and got[4][1] == 0
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_held_out(spark):
    rng = np.random.default_rng(0)
    words = {"en": ["the", "and", "of", "is"], "de": ["der", "und", "ist", "für"], "fr": ["le", "et", "est", "été"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(list(words) * 60)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where(langid.held_out()).collect()
    assert got and all(r.lang_pred == r.lang for r in got)


def test_language_against_plain_version(spark):
    """Posterior of a naive Bayes with a dictionary of counts, one n-gram at a time; ties go to the first language."""
    rng = np.random.default_rng(4)
    words = {"en": ["the", "And", "of"], "de": ["der", "und", "für"]}
    train = [(lang, " ".join(rng.choice(words[lang], 6))) for lang in ("en", "de", "en") for _ in range(5)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(train)], "doc_id long, text string, lang string")
    model = langid.train(docs, "text", "lang", "doc_id")
    size = 1 << langid.LOG2_BUCKETS

    def grams(text):
        chars = [ord(c) for c in f"\x02{text.lower()}\x03"]
        for n in langid.ORDERS:
            for i in range(len(chars) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x9E3779B1 + (chars[i + k] + k + 1) * 0x85EBCA6B) % 2**32
                yield (h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 32 - langid.LOG2_BUCKETS

    counts = {lang: {} for lang in words}
    for lang, t in train:
        for g in grams(t):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    share = {"en": 10 / 15, "de": 5 / 15}
    for t in ("the und", "Für", "x", "of the and der", "the " * 50):
        z = {}
        for lang, c in counts.items():
            own, total = list(grams(t)), sum(c.values()) + langid.SMOOTHING * size
            z[lang] = sum(np.log((c.get(g, 0) + langid.SMOOTHING) / total) for g in own) / len(own) * min(len(own), langid.SURE_AFTER) + np.log(share[lang])
        p = {lang: np.exp(v - max(z.values())) for lang, v in z.items()}
        best = max(sorted(p), key=p.get)
        got, score = langid.score([t], model)
        assert model.languages[got[0]] == best and abs(score[0] - p[best] / sum(p.values())) < 1e-3
    even = langid.LanguageModel(["a", "b"], np.zeros((size, 2), np.float32), np.zeros(2, np.float32))
    assert langid.score(["tie"], even)[0][0] == 0


def test_toxicity_against_plain_version():
    """Forward pass with loops over windows, words, characters and time."""
    rng = np.random.default_rng(6)
    net = {k: rng.standard_normal(v.shape).astype(np.float32) * 0.3 for k, v in toxicity.fresh().items()}
    texts = ["Some Words of a text", "", "one", " ".join(f"w{i}" for i in range(70)), "a\u00e9 b"]
    values, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = toxicity.score_texts(net, values, offsets)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def embedded(word):
        low = [2, *(b + 32 if 65 <= b <= 90 else b for b in word.encode()), 2]
        chars, many = np.zeros(toxicity.DIM), 0
        for n in toxicity.ORDERS:
            for i in range(len(low) - n + 1):
                h = 0
                for k in range(1, n + 1):
                    h = (h * 0x01000193 + (low[i + k - 1] + k * 257) * 0x9E3779B1) % 2**32
                h = (h ^ h >> 16) * 0x45D9F3B % 2**32
                chars += net["chars"][(h ^ h >> 15) % toxicity.CHAR_BUCKETS]
                many += 1
        one = np.frombuffer(word.encode(), np.uint8)
        hashed = int(toxicity.word_hashes(one, np.array([0, len(one)]))[0][0])
        return np.concatenate([net["words"][hashed % toxicity.WORD_BUCKETS], chars / np.sqrt(max(many, 1))])

    def states(d, xs):
        h, out, H = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs:
            a, u = x @ net[f"W{d}"] + net[f"b{d}"], h @ net[f"U{d}"]
            z, r = sigmoid(a[:H] + u[:H]), sigmoid(a[H : 2 * H] + u[H : 2 * H])
            h = z * h + (1 - z) * np.tanh(a[2 * H :] + r * u[2 * H :])
            out.append(h)
        return out

    for text, score in zip(texts, got, strict=True):
        words, best, at = text.split(), 0.0, 0
        while True:
            xs = [embedded(w) for w in words[at : at + toxicity.WINDOW]]
            pooled = np.zeros(2 * toxicity.HIDDEN)
            if xs:
                hs = [np.concatenate(x) for x in zip(states("f", xs), states("b", xs[::-1])[::-1], strict=True)]
                e = np.exp([np.tanh(h @ net["A"]) @ net["v"] for h in hs])
                pooled = sum(w * h for w, h in zip(e / e.sum(), hs, strict=True))
            best = max(best, sigmoid(pooled @ net["o"] + net["c"][0]))
            if at + toxicity.WINDOW >= len(words):
                break
            at += toxicity.STRIDE
        assert abs(score - best) < 1e-4


def test_toxicity_gradients():
    texts = [b"hello idiot world foo bar" * 3, b"good day my friend", b"", b"x " * 50]
    words, numbers, row = toxicity.windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert row.tolist() == [0, 1, 2, 3, 3, 3] and (numbers[2] == 0).all()
    net = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    y, one = np.array([1, 0, 0, 1, 0, 1.0]), np.ones(6)
    g = toxicity.gradients(net, words, numbers, y, one)

    def loss():
        p = toxicity.forward(net, words, numbers)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("Wf", "Ub", "bf", "A", "v", "o", "c"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net[name][at]
        net[name][at] = old + 1e-2
        up = loss()
        net[name][at] = old - 1e-2
        down = loss()
        net[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 1e-4


def test_toxicity(spark, docs):
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("the", "an", "er", "on", "in") for b in ("ing", "ed", "ly", "or")]
    rows = []
    for i in range(300):
        words = list(rng.choice(plain, 60))
        if i % 4 == 0:
            words[rng.integers(0, 60)] = "zorkish" + str(rng.choice(["a", "o", "u"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.assess(df.drop("toxic"), df.select("doc_id", "toxic")).join(df.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).collect()
    assert np.mean([(r.toxicity >= 0.5) == r.toxic for r in got]) >= 0.95
    empty = df.select("doc_id", "toxic").limit(0)
    odd = toxicity.assess(docs, empty)
    assert odd.count() == len(ROWS) and all(0 <= r.toxicity < 0.5 for r in odd.collect())
    assert toxicity.assess(docs.limit(0), empty).count() == 0


def test_tiles_reordered():
    item = np.arange(40, dtype=np.uint64)
    doc = np.concatenate([np.arange(100, 120), np.arange(20, 40), [7], np.arange(0, 20)]).astype(np.uint64)
    assert decontam.tiles(item, doc) == [(0, 41, 20), (20, 20, 20)]
    assert decontam.tiles(item, item) == [(0, 0, 40)] and decontam.tiles(item[:4], item) == [] and decontam.tiles(item, item[:0]) == []


def test_tiles_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(250):
        p, t = rng.integers(0, 4, 25).astype(np.uint64), rng.integers(0, 4, 60).astype(np.uint64)
        got = decontam.tiles(p, t, 3)
        mp, mt, want = np.zeros(25, bool), np.zeros(60, bool), []
        while True:  # one longest match at a time
            best = (0, 0, 0)
            for i in range(25):
                for j in range(60):
                    n = 0
                    while i + n < 25 and j + n < 60 and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < 3:
                break
            n, i, j = best[0], -best[1], -best[2]
            mp[i : i + n] = mt[j : j + n] = True
            want.append((i, j, n))
        assert got == want


def test_decontamination(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, passage), (2, "too short"), (3, None), (4, passage)], "item_id long, text string")
    turned = "Zeta, eta theta iota KAPPA! and then alpha beta gamma delta epsilon."
    rows = [(1, f"so {passage} end"), (2, turned), (3, "alpha beta gamma delta epsilon only"), (4, None), (5, ""), (None, passage), (6, "clean text of no interest at all"), (1, f"so {passage} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "digest", "item", "row")})
    got = _rows(decontam.judge(docs, bench), "doc_id", "contaminated", "n_items", "item_id", "coverage")
    assert got == sorted([(1, True, 2, 1, 1.0)] * 2 + [(2, True, 2, 1, 1.0), (3, False, 0, None, 0.0), (4, False, 0, None, 0.0), (5, False, 0, None, 0.0), (None, True, 2, 1, 1.0), (6, False, 0, None, 0.0)], key=str)
    left = decontam.remove(docs, bench)
    assert _rows(left, "doc_id") == [(3,), (4,), (5,), (6,)] and left.columns == docs.columns
    assert decontam.judge(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontam.judge(docs, bench.limit(0)).collect())


def test_decontamination_of_unspaced_scripts(spark):
    item = "春の海ひねもすのたりのたりかな"
    bench = spark.createDataFrame([(1, item), (2, "ภาษาไทยเป็นภาษาทางการ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"昔{item}と言う"), (2, "夏草や兵どもが夢の跡"), (3, "คือภาษาไทยเป็นภาษาทางการของ")], "doc_id long, text string")
    assert {r.doc_id: r.item_id for r in decontam.judge(docs, bench).where("contaminated").collect()} == {1: 1, 3: 2}


def test_licences(spark):
    code = "def run of several other words that no template holds at all"
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("r/LICENSE", mit), ("r/a/x.py", "code\nmore"), ("r/a/b/y.py", f"{apache}\n{code}"), ("r/c/COPYING", apache), ("r/c/d/z.py", ""), ("s/q.py", "license of the apache people"), (None, "code"), (None, mit), ("r/n.py", None), ("top", "x")]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("old") for c in ("d", "no", "dir", "licence", "g", "line", "whole", "__digest", "__Folder")})
    got = {(r.path, r.text): (r.licence, r.origin, r.licence_path) for r in licenses.scan(files, spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")).collect()}
    assert got == {
        rows[0]: ("MIT", "file", "r/LICENSE"), rows[1]: ("MIT", "inherited", "r/LICENSE"), rows[2]: ("Apache-2.0", "header", "r/a/b/y.py"), rows[3]: ("Apache-2.0", "file", "r/c/COPYING"),
        rows[4]: ("Apache-2.0", "inherited", "r/c/COPYING"), rows[5]: (None, None, None), rows[6]: (None, None, None), rows[7]: ("MIT", "file", None), rows[8]: ("MIT", "inherited", "r/LICENSE"), rows[9]: (None, None, None),
    }


def test_licences_of_odd_rows(spark):
    templates = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    mit, isc = "Released under the MIT License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    code = "def run of several other words that no template holds at all\n" * 8
    rows = [("b/LICENSE", mit), ("b/COPYING", mit), ("b/x", "y"), ("b/x", "y"), ("c/long", "word " * 60_000 + "\n" + mit), ("c/both", f"{isc}\n{mit}\n{code}"), ("c/both", f"{code}{mit}\n{isc}"), ("c/none", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = _rows(licenses.scan(files, templates), "path", "licence", "origin", "licence_path")
    assert got == sorted([("b/LICENSE", "MIT", "file", "b/LICENSE"), ("b/COPYING", "MIT", "file", "b/COPYING"), ("b/x", "MIT", "inherited", "b/COPYING"), ("b/x", "MIT", "inherited", "b/COPYING"), ("c/long", "MIT", "header", "c/long"), ("c/both", "ISC", "header", "c/both"), ("c/both", "ISC", "header", "c/both"), ("c/none", None, None, None)], key=str)
    assert licenses.scan(files.limit(0), templates).count() == 0


def _pipeline(spark, folder, rows, items, labels):
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, key string, b string, u string, component string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(folder))
        docs.write.parquet(f"{folder}/stage{i}.parquet")
        docs = spark.read.parquet(f"{folder}/stage{i}.parquet")
        kept.append(sorted((r.doc_id for r in docs.collect()), key=str))
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()), key=str) == kept[-1]
    return kept, docs


def test_pipeline(spark, tmp_path):
    """Each stage takes out what is planted for it and leaves all else; the last one's digests are the library's."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    words = ["the", "and", "of", "ing", "eat", "on", "in", "ed", "ly", "for"]
    text = lambda n=40: " ".join("".join(rng.choice(words, 2)) for _ in range(n))
    passage = text()
    clash = ("c",) * 5
    clean = [(i, text(), "en", "s", 1, *clash) for i in range(300)]
    toxic = [(i, f"{text(20)} zorkish{i % 3} {text(20)}", "en", "s", 1, *clash) for i in range(1000, 1150)]
    near = clean[0][1].rsplit(" ", 1)[0]
    odd = [(100_0, None, None, None, None, *clash), (2000, near, "en", "s", 1, *clash), (2001, clean[1][1], "en", "s", 1, *clash), (2002, f"so {passage} end", "en", "s", 1, *clash), (2003, "...", "en", "s", 1, *clash), (5, clean[5][1], "en", "s", 1, *clash), (None, text(), "en", "s", 1, *clash), (2004, "", "en", "s", 1, *clash), (2005, text(20_000), None, "s", 1, *clash)]
    odd[0] = (2006, *odd[0][1:])
    labels = [*((r[0], 1, 0) for r in clean), *((r[0], 0, 1) for r in toxic), (None, 1, None)]
    kept, out = _pipeline(spark, tmp_path, clean + toxic + odd, [(1, passage), (2, None)], labels)
    good = [r[0] for r in clean]
    after = lambda *more: sorted([*good, *more], key=str)
    assert kept[0] == after(*(r[0] for r in toxic), 2000, 2001, 2002, 5, None, 2005)
    assert kept[1] == after(2000, 2001, 2002, 5, None, 2005)
    assert kept[2] == after(2002, None, 2005)
    assert kept[3] == kept[4] == after(None, 2005)
    path = bpe.default_path(spark)
    library, texts = Tokenizer.from_file(path), {r[0]: r[1] for r in clean + odd}
    for r in out.where("doc_id < 20").collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    kept, _ = _pipeline(spark, tmp_path, [], [], [])
    assert kept == [[]] * 5


def test_licence_files_and_blocks(spark):
    gpl = licenses.GNU.format("", "3")
    wrapped = "\n".join(" * " + gpl[i : i + 70] for i in range(0, len(gpl), 70)).replace("\n * ", "\n# ")
    mit = f"MIT License\n\nCopyright (c) 2020 Jo Doe\n\n{licenses.GRANT}\n\n{licenses.AS_IS}\n"
    prose = "the software of the house is old and the licence to run it under the rules is kept in the office " * 20
    rows = [("m/LICENSE", mit), ("m/src/a.py", "x = 1"), ("g/a.c", prose + "\n" + wrapped + "\nint main;\n" + prose), ("s/a.c", "// SPDX-License-Identifier: MIT\nint x;"), ("s/b.c", "/* SPDX-License-Identifier: (GPL-2.0-only OR MIT) */"), ("n/a.txt", "Released under the MIT License. See the page on the web for more words of all kinds."), ("p/a.txt", prose), ("v/COPYING", licenses.GNU_FILE.format("", "3, 29 June 2007", "2007") + "\n" + prose), ("v/x.c", "int y;")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in licenses.scan(files, spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")).collect()}
    assert got == {"m/LICENSE": ("MIT", "file"), "m/src/a.py": ("MIT", "inherited"), "g/a.c": ("GPL-3.0", "header"), "s/a.c": ("MIT", "header"), "s/b.c": ("GPL-2.0-only OR MIT", "header"), "n/a.txt": ("MIT", "header"), "p/a.txt": (None, None), "v/COPYING": ("GPL-3.0", "file"), "v/x.c": ("GPL-3.0", "inherited")}


def test_long_items_and_clashing_names(spark):
    long = " ".join(f"w{i % 9000}" for i in range(20_000))
    docs = spark.createDataFrame([(1, "before " + long + " after"), (2, "something else that is clean of it"), (3, None)], "doc_id long, text string").withColumns({"__roadspan_digest": F.lit(1), "digest": F.lit(2), "which": F.lit(3), "__n": F.lit(4), "place": F.lit(5)})
    bench = spark.createDataFrame([(7, long), (8, "five words are not many enough maybe")], "item_id long, text string")
    left = decontam.remove(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    import corpus_pipeline

    twice = docs.union(docs)
    kept = corpus_pipeline.one_of_each_group(spark, twice, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and {r["__n"] for r in kept.collect()} == {4}


def test_language_is_that_of_the_full_sum():
    model = langid.LanguageModel(["a", "b"], np.zeros((1 << langid.LOG2_BUCKETS, 2), np.float32), np.log(np.array([0.999, 0.001], np.float32)))
    model.log_p[:, 0], model.log_p[:, 1] = -3.02, -3.0
    best, p = langid.score(["word " * 2000, "w"], model)
    assert list(best) == [1, 0] and 0 < p[0] < 0.5 < p[1]  # the evidence of all n-grams outweighs the prior


def test_bpe_model_is_flat_in_a_worker():
    """A worker's copy of the public vocabulary is held in arrays of machine numbers, not in an object per entry; ids are the same."""
    import gc
    import pickle
    import tracemalloc

    import public_tokenizers

    sent = pickle.dumps(bpe.BpeModel.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    gc.collect()
    tracemalloc.start()
    model = pickle.loads(sent)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 28e6
    text = "Flat tables, the same ids: naïve  déjà-vu 12345 你好\n"
    assert model.decode_batch(np.frombuffer(model.encode(text), np.int32).astype(np.int64), np.array([0, len(model.encode(text)) // 4])) == [text]
