"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard is one range of identifiers in ascending order:

    blocks | index | Bloom filter | footer (72 bytes)

A block holds up to ``BLOCK`` bytes of rows, compressed as one zstd frame. A
row is (shared key bytes, own key bytes, value bytes, own key, value): keys are
prefix-compressed against the row before. The sparse index has each block's
first key, place, rows, and the shard's tokens before it. A lookup asks the
Bloom filter, finds the block by binary search in the index and reads that one.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspan.llm import _files
from roadspan.llm._bloom import WORDS, BlockedBloom, _probes
from roadspan.llm._scratch import fresh_dir, written
from roadspan.llm._text import mix, slices

MAGIC = b"RSPNSST1"
FOOTER = struct.Struct("<8Q8s")  # index at, index bytes, filter at, filter bytes, rows, tokens, id width, crc of index and filter, magic
ROW = struct.Struct("<HHI")
ENTRY = struct.Struct("<HQIIQ")
BLOCK = 1 << 18
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: Fixed value: the pre-tokenizer's pattern, whose matches hold no white space.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KEPT_WORDS, KEPT_LENGTH = 200_000, 48  # encoded words that a worker keeps in each of two generations, and the longest of them


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as identifiers do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _hash(keys: list[bytes]) -> np.ndarray:
    return mix(np.array([int.from_bytes(k, "big") & (2**64 - 1) for k in keys], np.uint64))


class SstWriter:
    """Writes rows that come in ascending key order; equal keys may repeat."""

    def __init__(self, uri: str, width: int) -> None:
        self.out, self.width = _files.Output(uri), width
        self.packer = zstandard.ZstdCompressor(level=3)
        self.block, self.size, self.index, self.keys = [], 0, [], []
        self.rows = self.tokens = self.block_rows = self.block_tokens = 0
        self.first = self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.rows and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            for a, b in zip(key, self.last, strict=False):
                if a != b:
                    break
                shared += 1
        else:
            self.first = key
        self.block += [ROW.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self.size += ROW.size + len(key) - shared + len(value)
        self.last = key
        self.keys.append(key)
        self.rows += 1
        self.block_rows += 1
        self.tokens += len(value) // self.width
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.packer.compress(b"".join(self.block))
            place = self.out.write(data)
            self.index.append(ENTRY.pack(len(self.first), place, len(data), self.block_rows, self.block_tokens) + self.first)
            self.block, self.size, self.block_rows, self.block_tokens = [], 0, 0, self.tokens

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        table = np.zeros(max(1, -(-len(self.keys) * 12 // 512)) * WORDS, np.uint64)
        if self.keys:
            base, bits = _probes(_hash(self.keys), len(table) // WORDS)
            np.bitwise_or.at(table, (base + (bits >> np.uint64(6))).astype(np.int64).ravel(), (np.uint64(1) << (bits & np.uint64(63))).ravel())
        bloom = table.astype("<u8").tobytes()
        a, b = self.out.write(index), self.out.write(bloom)
        self.out.write(FOOTER.pack(a, len(index), b, len(bloom), self.rows, self.tokens, self.width, zlib.crc32(index + bloom), MAGIC))
        self.out.close()


class SstReader:
    """Reads one shard: ``rows`` in order, ``get`` by key."""

    def __init__(self, uri: str) -> None:
        self.file = _files.open_input(uri)
        size = self.file.size()
        a, la, b, lb, self.n_rows, self.n_tokens, self.width, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        index, bloom = self.file.read_at(la, a), self.file.read_at(lb, b)
        if zlib.crc32(index + bloom) != crc:
            raise ValueError(f"{uri}: index or filter is damaged")
        self.bloom = BlockedBloom(np.frombuffer(bloom, "<u8"))
        self.blocks, self.firsts = [], []
        at = 0
        while at < la:
            n, place, length, rows, before = ENTRY.unpack_from(index, at)
            at += ENTRY.size
            self.firsts.append(index[at : at + n])
            self.blocks.append((place, length, rows, before))
            at += n
        self.unpacker = zstandard.ZstdDecompressor()

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        place, length, rows, _ = self.blocks[i]
        data = self.unpacker.decompress(self.file.read_at(length, place))
        at, key = 0, b""
        for _ in range(rows):
            shared, own, size = ROW.unpack_from(data, at)
            at += ROW.size
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def rows(self) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, tokens of the shard before it, value) in order."""
        for i, (_, _, _, before) in enumerate(self.blocks):
            for key, value in self._block(i):
                yield key, before, value
                before += len(value) // self.width

    def get(self, key: bytes) -> bytes | None:
        """Value of a key (the first one if it repeats), None if the shard hasn't got it."""
        if not self.bloom.probe(_hash([key]))[0]:
            return None
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key:
            i -= 1
        for j in range(i, len(self.blocks)):
            if self.firsts[j] > key:
                break
            for k, value in self._block(j):
                if k == key:
                    return value
                if k > key:
                    return None
        return None


class WordEncoder:
    """A tokenizers file, applied to each distinct space-delimited piece of a batch once.

    Its pre-tokenizer's matches hold no white space and its normalizer doesn't
    join anything across a space or line feed, so a text's ids are the ids of
    its pieces in a row. ``from_file`` reads both from the file's declarations.
    """

    def __init__(self, spec: str) -> None:
        self.spec = spec
        self._fresh()

    def _fresh(self) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(self.spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.kind = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.lowers = self.model.encode("Ab", add_special_tokens=False).ids == self.model.encode("ab", add_special_tokens=False).ids
        # added tokens match on the raw text and by case; lower-casing must not make one
        self.added = sorted({t.content.lower() for t in self.model.get_added_tokens_decoder().values()})
        self.new, self.old = {"": b""}, {}
        suffix = json.loads(self.spec)["model"].get("end_of_word_suffix")
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        for token, i in vocabulary.items() if suffix else ():
            self.last[i] = token.endswith(suffix)

    def __getstate__(self) -> dict:
        return {"spec": self.spec}

    def __setstate__(self, state: dict) -> None:
        self.spec = state["spec"]
        self._fresh()

    @classmethod
    def from_file(cls, path: str) -> WordEncoder:
        """Raises for a file whose ids may depend on more than space-delimited pieces."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        parts = lambda x, many: x[many] if x and x["type"] == "Sequence" else [x] if x else []
        normal, cut = parts(spec["normalizer"], "normalizers"), parts(spec["pre_tokenizer"], "pretokenizers")
        spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        fits = all(x["type"] in ("NFC", "Lowercase") or x == spaces for x in normal) and cut and cut[0]["type"] == "Split" and cut[0].get("pattern") == {"Regex": WORDS_ONLY} and cut[0].get("invert") and cut[0].get("behavior") == "Removed"
        fits = fits and all(x["type"] == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in cut[1:])
        if not fits or any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: its ids may depend on more than space-delimited pieces")
        return cls(text)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """(offsets of each text's pieces, pieces)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.lowers:
            # these characters have no context in lower-casing and are composed already
            plain = pc.match_substring_regex(texts, f"^{PLAIN.pattern}$")
            low = pc.utf8_lower(pc.if_else(plain, texts, ""))
            for a in self.added:
                plain = pc.and_not(plain, pc.match_substring(low, a))
            texts = pc.if_else(plain, low, texts)
        found = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return found.offsets.to_numpy(), found.flatten().dictionary_encode()

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, which are one match of the pre-tokenizer each: encoded in one text and cut after each word's last token."""
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.model.encode_batch_fast([" ".join(words[i : i + 100]) for i in range(0, len(words), 100)], add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._apart(words)
        data, at, size = ids.tobytes(), [0, *ends.tolist()], ids.itemsize
        return [data[a * size : b * size] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _apart(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes; those of short words are kept for later batches."""
        if len(self.new) > KEPT_WORDS:
            self.old, self.new = self.new, {"": b""}
        new, old = self.new, self.old
        missing = [w for w in words if w not in new]
        # plain letters with one mark at the end are two matches of the pre-tokenizer; others may
        # be normalised to letters and marks, which join it
        ended = {w for w in missing if w[-1] in ".,!?" and w[:-1].isalpha() and PLAIN.fullmatch(w)}
        todo = dict.fromkeys(x for w in missing for x in ((w[:-1], w[-1]) if w in ended else (w,)) if x not in new)
        new.update((w, old[w]) for w in todo if w in old)
        todo = [w for w in todo if w not in new]
        letters = [w for w in todo if self.last is not None and w.isalpha() and PLAIN.fullmatch(w)]
        others = list(set(todo).difference(letters))
        for some, encode in ((letters, self._together), (others, self._apart)):
            for i in range(0, len(some), 5000):
                new.update(zip(some[i : i + 5000], encode(some[i : i + 5000]), strict=True))
        out = [new[w] if w in new else new[w[:-1]] + new[w[-1]] for w in words]
        for w in todo:
            if len(w) > KEPT_LENGTH:
                del new[w]
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, bytes]:
        """(offsets in bytes, ids as little-endian integers of ``kind``) of texts, each followed by ``end_id``; null and empty texts have no other."""
        at, pieces = self._pieces(texts)
        ids, of, at = self._learn(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pieces.indices, at - at[0]
        if end_id is not None:  # one more piece after each text
            of = pa.array(np.insert(of.to_numpy(), at[1:], len(ids)))
            ids, at = [*ids, np.array([end_id], self.kind).tobytes()], at + np.arange(len(at))
        taken = pa.array(ids, pa.large_binary()).take(of)
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
        return offsets[at], taken.buffers()[2].to_pybytes() if len(taken) else b""


def write(docs: DataFrame, encoder: WordEncoder, target: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards below ``target`` in ascending id order (equal ids by text) and return their manifest.

    Ranges come from Spark's range partitioning; each task streams its sorted
    rows into one file, which appears when complete, so a repeated task leaves
    the same file. Null texts are empty documents; null ids come first. An
    empty table has no shard with rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(encoder)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange(n, "k").sortWithinPartitions("k", "t")

    def run(batches):
        writer, path = None, f"{target}/part-{TaskContext.get().partitionId():06d}.sst"
        e = model.value
        first = None
        for part in slices(batches, "t", 2 << 20):
            if writer is None:
                writer, first = SstWriter(path, e.kind.itemsize), part.column(0)[0].as_py()
            at, ids = e.encode(part.column(1), end_id)
            for k, a, b in zip(part.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                writer.add(key_of(k), ids[a:b])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first": pa.array([first], pa.int64()), "last": pa.array([id_of(writer.last)], pa.int64()), "n_rows": [writer.rows], "n_tokens": [writer.tokens]})

    return written(rows.mapInArrow(run, "path string, first long, last long, n_rows long, n_tokens long"), "manifest")


def read(spark: SparkSession, shards: Iterable[tuple[str, int]], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in shards, given as (path, tokens in all shards before)."""
    shards = list(shards)
    listed = spark.createDataFrame(shards, "path string, base long").repartition(max(1, len(shards)), "path")

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SstReader(path)
                kind = np.dtype(f"<u{reader.width}")
                held, size = [], 0
                for key, before, value in reader.rows():
                    held.append((id_of(key), base + before, np.frombuffer(value, kind)))
                    size += len(value)
                    if size > 1 << 21:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(held):
        at = np.cumsum([0, *(len(v) for _, _, v in held)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([v for _, _, v in held]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in held], pa.int64()), pa.array([s for _, s, _ in held], pa.int64()), pa.array(np.diff(at).astype(np.int64)), ids], names=[id_col, "start", "n_tokens", "ids"])

    return listed.mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids array<int>")


def in_order(manifest: DataFrame) -> list[tuple[str, int]]:
    """(path, tokens before) of the shards in ascending order; one small row per shard reaches the driver."""
    out, total = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["path"]):
        out.append((r["path"], total))
        total += r["n_tokens"]
    return out


def lookup(manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """Ids of one document, by the manifest's ranges and a binary search in the one shard."""
    hit = manifest.where((F.col("first").isNull() | (F.col("first") <= doc_id)) & (F.col("last") >= doc_id)).first()
    if hit is None:
        return None
    reader = SstReader(hit["path"])
    value = reader.get(key_of(doc_id))
    return None if value is None else np.frombuffer(value, f"<u{reader.width}")


def store(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write shards in the shared folder, and read every document back from them."""
    spark = docs.sparkSession
    manifest = write(docs, WordEncoder.from_file(path), fresh_dir(spark, "sst"), end_id, id_col, text_col)
    return read(spark, in_order(manifest), id_col)


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32): CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return stored.select(id_col, "start", "n_tokens", "ids").mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def default_path(spark: SparkSession) -> str:
    """``spark.roadspan.tokenizer.words`` of the session, else the public word vocabulary of this machine."""
    import public_tokenizers

    return spark.conf.get("spark.roadspan.tokenizer.words", None) or public_tokenizers.path("word_bpe_49k.json")
