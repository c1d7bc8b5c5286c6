"""WARC archives from a chunked record table.

A record's payload is rows (record, chunk number, bytes): no step holds a whole
record besides the input row itself. Each chunk row carries the SHA-1 and the
length of the payload up to and including it, so the last chunk's are the
record's. The writer streams chunks into gzip members, and the reader takes
archives apart piece by piece and digests payloads as they pass.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspan.llm import _files
from roadspan.llm._scratch import fresh_dir, written

CHUNK = 64 << 10
DATE = "1970-01-01T00:00:00Z"  # records are the same whenever they are written
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunk_records(records: DataFrame, id_col: str, payload_col: str, url_col: str, chunk: int = CHUNK) -> DataFrame:
    """Rows (record, id, chunk_no, last, bytes_so_far, sha1_so_far, data, url).

    ``data`` is a zstd frame of at most ``chunk`` payload bytes; the url stands
    in a record's first chunk. Null and empty payloads are one empty chunk.
    ``record`` numbers the rows, so that ids may repeat or be null.
    """
    rows = records.select(
        F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("binary").alias("payload"), F.col(url_col).cast("string").alias("url")
    )
    kinds = {"record": pa.int64(), "id": pa.int64(), "chunk_no": pa.int32(), "last": pa.bool_(), "bytes_so_far": pa.int64(), "sha1_so_far": pa.binary(), "data": pa.binary(), "url": pa.string()}

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            held, size = [], 0
            record, own, value, url = batch.columns
            for record, own, value, url in zip(record.to_pylist(), own.to_pylist(), value, url.to_pylist(), strict=True):
                view = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
                sha1, n = hashlib.sha1(), 0
                for no, at in enumerate(range(0, len(view) or 1, chunk)):
                    piece = view[at : at + chunk]
                    sha1.update(piece)
                    n += len(piece)
                    held.append((record, own, no, n == len(view), n, sha1.digest(), pack(piece), url if no == 0 else None))
                    size += len(piece)
                    if size > 1 << 20:
                        yield table(held)
                        held, size = [], 0
            if held:
                yield table(held)

    return rows.mapInArrow(run, "record long, id long, chunk_no int, last boolean, bytes_so_far long, sha1_so_far binary, data binary, url string")


def classify(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Per record: payload size and digest, and the record that a revisit refers to.

    Of records with equal payloads of at least ``least_bytes`` the one with the
    smallest id (then the smallest record number; null ids last) is the
    response. Copies are combined before the shuffle.
    """
    heads = chunks.where("last").select("record", "id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("sha1"))
    first = heads.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("record"))).alias("f"))
    return heads.join(first, ["sha1", "payload_bytes"], "left").select("record", "id", "payload_bytes", "sha1", (F.coalesce("f.record", "record") != F.col("record")).alias("revisit"), F.col("f.record").alias("first_record"), F.col("f.id").alias("first_id"))


def _urn(record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(record))}>"


def _head(record, own, size, sha1, revisit, first_record, first_id, url) -> bytes:
    http = "" if revisit else HTTP.format(size)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(record)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{base32(sha1)}", f"X-Payload-Length: {size}"]
    if own is not None:
        lines.append(f"X-Page-Id: {own}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first_record)}"]
        if first_id is not None:
            lines.append(f"X-Refers-To-Page-Id: {first_id}")
    else:
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {0 if revisit else len(http) + size}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write(chunks: DataFrame, classes: DataFrame, target: str) -> DataFrame:
    """Write gzip archives below ``target``, one per task, and return (path, records). Revisits have no block."""
    spark = chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select("record", "chunk_no", "last", "data", "url").join(classes, "record").where("not revisit or chunk_no = 0")
    rows = rows.withColumn("data", F.when(~F.col("revisit"), F.col("data")))
    rows = rows.repartition(n, "record").sortWithinPartitions("record", "chunk_no")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        out, member, records = None, None, 0
        path = f"{target}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            for r in batch.to_pylist():
                out = out or _files.Output(path)
                if r["chunk_no"] == 0:
                    member = zlib.compressobj(5, wbits=31)
                    out.write(member.compress(_head(r["record"], r["id"], r["payload_bytes"], r["sha1"], r["revisit"], r["first_record"], r["first_id"], r["url"])))
                    records += 1
                if not r["revisit"]:
                    out.write(member.compress(unpack(r["data"])))
                if r["revisit"] or r["last"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records]})

    return written(rows.mapInArrow(run, "path string, records long"), "archives")


class _Pieces:
    """Decompressed bytes of one file of gzip members, in pieces of bounded size."""

    def __init__(self, file) -> None:
        self.file, self.inflate, self.raw, self.held = file, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    return False
            piece = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int):
        while n:
            if not self.held and not self.more():
                raise ValueError("archive ends in the middle of a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def records(file) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, payload size, payload SHA-1) of each record; size and digest are None for records without a payload."""
    pieces = _Pieces(file)
    while (head := pieces.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        size = digest = None
        if fields["WARC-Type"] == "response":
            http = pieces.until(b"\r\n\r\n")
            size, sha1 = length - len(http) - 4, hashlib.sha1()
            for piece in pieces.take(size):
                sha1.update(piece)
            digest = sha1.digest()
        else:
            for _ in pieces.take(length):
                pass
        for _ in pieces.take(4):
            pass
        yield fields, size, digest


def read(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per record of the archives: id, payload_bytes, payload_digest, record_type, refers_to, url.

    Response payloads are digested again and held against their header; a
    mismatch raises. A revisit's size and digest are those of its headers.
    """
    n = max(1, archives.count())

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for fields, size, digest in records(_files.open_input(path)):
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if digest is not None and (base32(digest) != said or size != int(fields["X-Payload-Length"])):
                        raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} doesn't fit its digest")
                    own, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    held.append((own and int(own), int(fields["X-Payload-Length"]), said, fields["WARC-Type"], to and int(to), fields.get("WARC-Target-URI")))
                    if len(held) == 5000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=[id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return archives.select("path").repartition(n, "path").mapInArrow(run, f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """Write a WARC record per row of ``pages`` and read the archives back; see ``read``.

    Null payloads are empty ones. Null urls leave the target header out. Rows
    that repeat an id are records of their own. Empty tables write nothing.
    """
    chunks = written(chunk_records(pages, id_col, payload_col, url_col), "chunks")
    archives = write(chunks, classify(chunks, least_bytes), fresh_dir(pages.sparkSession, "warc"))
    return read(archives, id_col)
