"""Byte-level helpers shared by the text operators: Arrow batches in, numpy arrays out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words where punctuation doesn't count: all ASCII but letters and digits.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_LANES = (_rng.integers(0, 2**63, 64, dtype=np.uint64) * U64(2)) + U64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all their bits depend on all input bits."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        a[0] = 1
        have = _powers[base] = np.cumprod(a, dtype=np.uint64)
    return have[:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a binary or string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return values[first : offsets[-1]] if len(offsets) else values, offsets - first


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` bytes of ``column`` (one row at least): bounds numpy's temporaries."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def word_hashes(values: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE, unspaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) and each row's offsets into them.

    ``between`` marks the bytes between words; without it words are ``[^\\x20\\x09-\\x0D]+``.
    With ``unspaced`` every letter of scripts that leave no space between words (CJK, kana, Thai) is a word.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[values]
    solid = ~between[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    if unspaced:
        thai = (values == 0xE0) & np.isin(np.append(values[1:], 0), (0xB8, 0xB9))
        for first, length in ((thai | (values >= 0xE3) & (values <= 0xE9), 3), ((values == 0xF0) & (np.append(values[1:], 0) >= 0xA0), 4)):
            at = np.flatnonzero(first)
            edge[at] = edge[np.minimum(at + length, n)] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low] * _power(_P, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_P_INV, n)[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; entry i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _LANES[0]
    for j in range(1, k):
        h = h + words[j : n + j] * _LANES[j]
    return mix(h)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """Hash of a whole short sequence of words, unlike that of any full-length gram."""
    salt = np.full(1, 0xA0761D6478BD642F, np.uint64) * U64(len(words))
    return mix((words * _LANES[: len(words)]).sum(dtype=np.uint64, keepdims=True) + salt)


def shingle_sets(values: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``k``-word shingles; fewer words: the whole sequence as one; none: empty."""
    words, at = word_hashes(values, offsets)
    grams = gram_hashes(words, k)
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= k:
            out.append(np.unique(grams[s : e - k + 1]))
        elif e > s:
            out.append(sequence_hash(words[s:e]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
