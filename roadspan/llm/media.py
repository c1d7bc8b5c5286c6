"""Media columns: content-addressed payloads in tar shards.

A payload is stored once, as a grey PNG image of 64 samples a row, under its
SHA-256, one tar member each. Rows carry digest, shard, offset and length.
Metadata columns come from range reads of the header alone; only features read
the whole payload.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspan.llm import _files
from roadspan.llm._scratch import fresh_dir, written
from roadspan.llm._text import slices

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
HEADER_BYTES = 33  # signature and IHDR
PIECE = 1 << 20  # most bytes in an IDAT chunk
SEEN = 1 << 17  # digests a task remembers so as not to store a payload twice


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """8-bit grey image of a payload whose length is a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packed = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 9)
    header = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))
    return SIGNATURE + header + b"".join(_chunk(b"IDAT", packed[i : i + PIECE]) for i in range(0, len(packed), PIECE)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The payload of an image made by ``to_png``; damaged chunks raise."""
    _, height, _ = png_header(media)
    at, packed = 8, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes()


def payload(text: Column) -> Column:
    """UTF-8 of a text (null: empty) with zero bytes up to a positive multiple of 64."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    pad = F.greatest(F.lit(1), F.ceil(n / WIDTH).cast("int")) * WIDTH - n
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad)))


def store(payloads: DataFrame, target: str) -> DataFrame:
    """Write tar shards below ``target``; payloads: (digest, payload), repeats allowed. Returns the index.

    Each task writes the payloads that it meets into a shard of its own, one
    member per payload named by its digest, so that no payload is shuffled. A
    payload is in a shard once as far as the task remembers; of copies in
    several shards the index (digest, path, offset, length) names the first.
    """

    def shard(batches):
        out, path, seen = None, f"{target}/shard-{TaskContext.get().partitionId():06d}.tar", set()
        for part in slices(batches, "payload"):
            digests, offsets, lengths = [], [], []
            for i, digest in enumerate(part.column(0).to_pylist()):
                if digest in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                media = to_png(part.column(1)[i].as_py())
                out = out or _files.Output(path)
                info = tarfile.TarInfo(f"{digest.hex()}.png")
                info.size = len(media)
                out.write(info.tobuf(tarfile.USTAR_FORMAT))
                digests.append(digest)
                offsets.append(out.write(media))
                lengths.append(len(media))
                out.write(b"\0" * (-len(media) % tarfile.BLOCKSIZE))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([path] * len(digests), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["digest", "path", "offset", "length"])
        if out:
            out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            out.close()

    stored = written(payloads.select("digest", "payload").mapInArrow(shard, "digest binary, path string, offset long, length long"), "media-members")
    return stored.groupBy("digest").agg(F.min(F.struct("path", "offset", "length")).alias("m")).select("digest", "m.*")


def by_shard(index: DataFrame) -> DataFrame:
    """The index with each shard's rows in one task and in file order, as ``metadata`` and ``features`` read best."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "path").sortWithinPartitions("path", "offset")


def _read(index: DataFrame, schema: str, row) -> DataFrame:
    """``index`` with the columns that ``row(file, offset, length)`` gives."""
    types = T.StructType.fromDDL(schema)
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in types]

    def run(batches):
        path, file = None, None
        for batch in batches:
            out = []
            for p, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if p != path:
                    path, file = p, _files.open_input(p)
                out.append(row(file, offset, length))
            new = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *types.names])

    return index.mapInArrow(run, T.StructType([*index.schema, *types]))


def metadata(index: DataFrame) -> DataFrame:
    """The index with width, height and bits, from a 33-byte range read of each payload's header."""
    return _read(index, "width long, height long, bits long", lambda file, offset, length: png_header(file.read_at(HEADER_BYTES, offset)))


def features(index: DataFrame) -> DataFrame:
    """The index with what reading the whole payload gives: sizes, digests, and a text of mean and distinct samples."""

    def row(file, offset, length):
        media = file.read_at(length, offset)
        back = from_png(media)
        samples = np.frombuffer(back, np.uint8)
        text = f"mean={samples.mean():.4f};levels={np.count_nonzero(np.bincount(samples, minlength=256))}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), text

    return _read(index, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, samples string", row)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media and return per row its size, digests and features as read back.

    Null texts are stored as the empty text. Equal texts share one stored
    payload. Rows with null or repeated ids keep one row each; other columns
    of ``docs`` are left out. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("n_bytes"), payload(F.col(text_col)).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    index = store(rows.select("digest", "payload"), fresh_dir(docs.sparkSession, "media"))
    found = features(metadata(by_shard(index))).drop("path", "offset", "length").withColumn("feature", F.format_string("png %dx%d %d-bit;%s", "width", "height", "bits", "samples"))
    return rows.drop("payload").join(found, "digest").drop("digest", "samples")
