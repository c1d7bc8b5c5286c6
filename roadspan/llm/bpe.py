"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token the one token that ends its encoding is stored.
An automaton over the vocabulary yields, longest first, the tokens that are
suffixes of the prefix; a token is the last one if the encoding of what comes
before it ends in a token that it is compatible with, i.e. no merge would cross
the border between the two. Exactly one token passes. Following the stored
tokens back from the end gives the ids, in time linear in the pre-token.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspan.llm._text import slices

#: Fixed value: the split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern for texts of these characters only, where the standard library's faster engine gives equal results.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
KEPT_WORDS = 120_000  # encoded pre-tokens that a worker keeps, in each of two generations
KEPT_PAIRS = 200_000
LONGEST_KEPT = 48


@cache
def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if visible, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeModel:
    """Vocabulary, merges and the automaton over both; picklable, with caches that stay in each worker.

    Tokens are numbered by rank inside: the single bytes, then the merges in order.
    Tables are flat arrays and a pair is one number, as every worker of an executor
    holds a model; the tokens' spellings are one string of bytes.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> None:
        of = byte_characters()
        raw = lambda t: bytes(of[c] for c in t)
        tokens: list[bytes] = [bytes([b]) for b in range(256)]
        char = {b: c for c, b in of.items()}
        self.ids = array("i", [vocab[char[b]] for b in range(256)])
        rank = {t: i for i, t in enumerate(tokens)}
        self.pairs: dict[int, int] = {}
        self.first, self.second = array("i", range(256)), array("i", range(256))  # the two that a merge makes a token of
        for a, b in merges:
            x, y = raw(a), raw(b)
            if x + y in rank:
                raise ValueError(f"two merges make {a + b!r}; the order of such a vocabulary is not a rank")
            self.pairs[rank[x] << 20 | rank[y]] = rank[x + y] = len(tokens)
            self.first.append(rank[x])
            self.second.append(rank[y])
            tokens.append(x + y)
            self.ids.append(vocab[a + b])
        self.special = dict(special)
        size = max([*vocab.values(), *special.values()]) + 1
        spelled = [b""] * size
        for t, i in vocab.items():
            spelled[i] = raw(t)
        for t, i in special.items():
            spelled[i] = t.encode()
        self.spelled = b"".join(spelled)
        self.sizes = np.array([len(t) for t in spelled], np.int64)
        self._automaton(tokens)
        self._fresh()

    @classmethod
    def from_file(cls, path: str) -> BpeModel:
        """Read a tokenizer file (JSON) of a byte-level BPE model without normalizer, prefix space or added affixes."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in neighbouring text aren't handled")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        return cls({t: i for t, i in model["vocab"].items() if t not in special}, merges, special)

    def _automaton(self, tokens: list[bytes]) -> None:
        """States are prefixes of tokens; ``step`` has the trie's edges, ``back`` the longest proper suffix that is a state."""
        self.step: dict[int, int] = {}
        end: dict[int, int] = {}
        depth_first: list[list[tuple[int, int, int]]] = []
        states = 1
        for t, spelled in enumerate(tokens):
            s = 0
            for d, b in enumerate(spelled):
                n = self.step.get(s << 8 | b)
                if n is None:
                    n = self.step[s << 8 | b] = states
                    states += 1
                    while len(depth_first) <= d:
                        depth_first.append([])
                    depth_first[d].append((n, s, b))
                s = n
            end[s] = t
        self.back = array("i", [0]) * states
        self.longest = array("i", [-1]) * states  # longest token that is a suffix of the state
        self.shorter = array("i", [-1]) * len(tokens)  # next shorter token that is a suffix of the token
        for level in depth_first:
            for n, s, b in level:
                f = self.back[s]
                if s:
                    while (to := self.step.get(f << 8 | b)) is None:
                        f = self.back[f]
                    self.back[n] = to
                below = self.longest[self.back[n]]
                t = end.get(n, -1)
                if t >= 0:
                    self.shorter[t] = below
                    self.longest[n] = t
                else:
                    self.longest[n] = below
        self.length = array("i", map(len, tokens))
        # a token that its own bytes aren't encoded to never ends an encoding
        self.own = bytearray([True]) * len(tokens)
        self.known: dict[int, bool] = {}
        for t in range(256, len(tokens)):
            self.own[t] = self.compatible(self.first[t], self.second[t], before=t)
        self.known = {}

    def compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """True if no merge crosses the border between the two tokens.

        Both sides are unmade, the later merge first, down to the bytes at the
        border; a pair there that merges earlier than what was unmade would
        have been merged. ``before``: only merges earlier than this one count.
        """
        most = len(self.length) if before is None else before
        pairs, first, second = self.pairs, self.first, self.second
        while True:
            merged = pairs.get(left << 20 | right)
            if merged is not None and merged < most:
                return False
            if left > right and left >= 256:
                most, left = left, second[left]
            elif right >= 256:
                most, right = right + 1, first[right]
            elif left >= 256:
                most, left = left, second[left]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        step, back, longest, shorter, length, own, known = self.step, self.back, self.longest, self.shorter, self.length, self.own, self.known
        last = [-1] * len(word)
        state = 0
        for i, b in enumerate(word):
            to = step.get(state << 8 | b)
            while to is None:
                state = back[state]
                to = step.get(state << 8 | b)
            state = to
            t = longest[state]
            while True:
                j = i - length[t]
                if own[t]:
                    if j < 0:
                        break
                    pair = last[j] << 20 | t
                    ok = known.get(pair)
                    if ok is None:
                        if len(known) >= KEPT_PAIRS:
                            known.clear()
                        ok = known[pair] = self.compatible(last[j], t)
                    if ok:
                        break
                t = shorter[t]
            last[i] = t
        out = []
        i = len(word) - 1
        while i >= 0:
            t = last[i]
            out.append(self.ids[t])
            i -= length[t]
        out.reverse()
        return out

    def _fresh(self) -> None:
        self.known, self.new, self.old = {}, {}, {}
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.flat = np.frombuffer(self.spelled, np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "new", "old", "words", "cut", "flat", "starts")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _miss(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = np.array(self.encode_word(word.encode()), np.int32).tobytes()
            if len(word) > LONGEST_KEPT:
                return found
        if len(self.new) >= KEPT_WORDS:
            self.old, self.new = self.new, {}
        self.new[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text; special tokens' strings become their ids."""
        if self.cut is not None and any(t in text for t in self.special):
            return b"".join(np.int32(self.special[p]).tobytes() if p in self.special else self.encode(p) for p in self.cut.split(text) if p)
        miss = self._miss
        words = PLAIN_PATTERN.findall(text) if PLAIN.fullmatch(text) else self.words(text)
        return b"".join([self.new.get(w) or miss(w) for w in words])

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of rows ``ids[at[i]:at[i+1]]``; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        spelled = self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        cut = np.concatenate([[0], ends])[at]
        return [spelled[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _ids(model: BpeModel, column: pa.Array) -> pa.ListArray:
    rows = [model.encode(t) if t else b"" for t in column.to_pylist()]
    at = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _texts(model: BpeModel, column: pa.ListArray) -> pa.Array:
    column = pc.fill_null(column, []) if column.null_count else column
    at = column.offsets.to_numpy().astype(np.int64)
    ids = column.values.to_numpy()[at[0] : at[-1]] if len(at) else np.zeros(0, np.int32)
    return pa.array(model.decode_batch(ids.astype(np.int64), at - at[0]), pa.string())


def _with(df: DataFrame, new: str, kind: str, f, of: str, cut: bool) -> DataFrame:
    """``df`` with column ``new`` (an existing one of that name is replaced), from column ``of``, batch by batch."""
    base = df.drop(new) if new != of else df
    schema = base.select("*", F.lit(None).cast(kind).alias(new)).schema

    def run(batches):
        for batch in slices(batches, of) if cut else batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, f(batch.column(batch.schema.get_field_index(of)))], names=[*batch.schema.names, new])

    return base.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids``, the whole text's token ids. Null and empty texts have no id; other columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(BpeModel.from_file(path))

    return _with(docs, ids_col, "array<int>", lambda column: _ids(model.value, column), text_col, True)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``decoded``, the text that the ids spell. Null and empty lists spell the empty text."""
    model = rows.sparkSession.sparkContext.broadcast(BpeModel.from_file(path))

    return _with(rows, text_col, "string", lambda column: _texts(model.value, column), ids_col, False)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with ``encode``'s ids and what ``decode`` makes of them, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(BpeModel.from_file(path))
    base = docs.drop(ids_col, decoded_col)
    schema = base.select("*", F.lit(None).cast("array<int>").alias(ids_col), F.lit("").alias(decoded_col)).schema

    def run(batches):
        pa.default_memory_pool().release_unused()  # workers are used again: what an earlier stage freed goes back
        for batch in slices(batches, text_col, 1 << 19):
            ids = _ids(model.value, batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, _texts(model.value, ids)], names=[*batch.schema.names, ids_col, decoded_col])

    return base.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
    return round_trip(docs.select(id_col, text_col), path, text_col).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_path(spark: SparkSession) -> str:
    """``spark.roadspan.tokenizer.bpe`` of the session, else the public byte-level vocabulary of this machine."""
    import public_tokenizers

    return spark.conf.get("spark.roadspan.tokenizer.bpe", None) or public_tokenizers.path("byte_bpe_50k.json")
