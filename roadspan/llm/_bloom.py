"""Blocked Bloom filter built by Spark aggregation and probed with numpy.

A key's hash picks one 512-bit block; all its bits lie in that block, so a
probe touches one cache line. The size in bytes is a parameter and does not
depend on the number of keys, so its broadcast has a proven bound; more keys
only raise the share of false hits, which an exact join removes afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # 64-bit words in a block
PROBES = 6  # bits set per key


def _bit(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th of a key's bits in its block."""
    return (h * np.uint64(2 * i + 1) ^ (h >> np.uint64(5 * i + 3))) & np.uint64(511)


def _probes(hashed: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashed.astype(np.uint64)
    word = (h >> np.uint64(34)) % np.uint64(blocks) * np.uint64(WORDS)
    return word[:, None], np.stack([_bit(h, i) for i in range(PROBES)], axis=1)


class BlockedBloom:
    """Probe side; ``table`` has ``blocks * 8`` unsigned 64-bit words."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    def __contains__(self, hashed: int) -> bool:
        return bool(self.probe(np.array([hashed], dtype=np.int64))[0])

    def probe(self, hashed: np.ndarray) -> np.ndarray:
        """True where the key of a 64-bit hash may be in the filter; never False for a key that is."""
        h = hashed.view(np.uint64)
        word = (h >> np.uint64(34)) % np.uint64(len(self.table) // WORDS) * np.uint64(WORDS)
        at = np.arange(len(h))
        for i in range(PROBES):  # few are left after the first bit
            bit = _bit(h, i)
            on = (self.table[(word + (bit >> np.uint64(6))).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            at, h, word = at[on], h[on], word[on]
        found = np.zeros(len(hashed), dtype=bool)
        found[at] = True
        return found


def build(keys: DataFrame, hashed: Column, log2_bytes: int = 20) -> BlockedBloom:
    """Filter over the 64-bit hashes of all rows of ``keys``; takes ``2**log2_bytes`` bytes at any number of rows.

    Tasks set bits in their own table; the words are OR-ed by a grouped
    aggregation, and at most ``2**log2_bytes / 8`` words reach the driver.
    Null hashes are left out; no rows give a filter without hits.
    """
    words = 2**log2_bytes // 8
    blocks = words // WORDS

    def partial(batches):
        import pyarrow as pa

        table = np.zeros(words, dtype=np.uint64)
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            base, bits = _probes(h, blocks)
            np.bitwise_or.at(table, (base + (bits >> np.uint64(6))).astype(np.int64).ravel(), (np.uint64(1) << (bits & np.uint64(63))).ravel())
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(table[at].view(np.int64))], names=["word", "bits"])

    rows = keys.select(hashed.alias("h")).mapInArrow(partial, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(words, dtype=np.uint64)
    found = rows.toArrow()
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return BlockedBloom(table)


def share(df: DataFrame, bloom: BlockedBloom) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(bloom)
