"""WARC archives, written and read as a stream of chunks.

A record's payload is never handled whole: the writer compresses it chunk by chunk, and the reader
gives a table of chunks (record id, chunk number, bytes), each with the digest of all bytes so far, so the last
chunk of a record carries the digest of its payload. Both hold one chunk at a time.

Archives are gzip files with a member for each record, as the format asks for. Each task writes its own
files under names that no other attempt uses; only files that a finished task reports are in the manifest, so
what a lost executor left behind is never read.

Equal payloads: the record with the largest page_id is a response, the others are revisits that refer to it and have no
payload block. Payloads below ``least_bytes`` are all responses.

Edge cases: a null payload is empty. A null url has no target. Records that repeat both page_id and payload share
one fate. Of payloads whose page_ids are all null, all are responses. An empty table gives no records.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import attach, cut, shared_folder

CHUNK = 1 << 16
#: A task begins a new archive after so many bytes.
FILE_BYTES = 1 << 30
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no long, data binary, bytes_so_far long, digest_so_far string, is_last boolean, payload_bytes long, payload_digest string"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks_of(payload: memoryview, size: int = CHUNK) -> Iterator[memoryview]:
    for i in range(0, len(payload), size):
        yield payload[i : i + size]


class Writer:
    """Records to one archive."""

    def __init__(self, out: BinaryIO, chunk: int = CHUNK):
        self.out, self.chunk, self.written = out, chunk, 0

    def _head(self, fields: list[tuple[str, str]], block: int) -> bytes:
        lines = [b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "replace") for k, v in fields), b"Content-Length: %d" % block]
        return b"\r\n".join(lines) + b"\r\n\r\n"

    def record(self, page_id: int | None, url: str | None, payload: memoryview, revisits: int | None, is_revisit: bool) -> None:
        """One gzip member. The digest is known before the block is written, so the payload is read twice, by chunks."""
        sha1 = hashlib.sha1(usedforsecurity=False)
        for part in chunks_of(payload, self.chunk):
            sha1.update(part)
        http = HTTP % len(payload)
        fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")]
        if url is not None:
            fields.append(("WARC-Target-URI", "".join(url.split("\r")).replace("\n", "")))
        fields += [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{b32(sha1.digest())}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
        if is_revisit:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{revisits}>")]
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        block = len(http) + (0 if is_revisit else len(payload))
        self._put(pack.compress(self._head(fields, block) + http))
        if not is_revisit:
            for part in chunks_of(payload, self.chunk):
                self._put(pack.compress(part))
        self._put(pack.compress(b"\r\n\r\n") + pack.flush())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)


class _Members:
    """The bytes of a file of gzip members, as a stream."""

    def __init__(self, source: BinaryIO, chunk: int):
        self.source, self.chunk, self.unpack, self.packed, self.plain = source, chunk, None, b"", bytearray()

    def _more(self) -> bool:
        while not self.plain:
            if not self.packed:
                self.packed = self.source.read(self.chunk)
                if not self.packed:
                    if self.unpack is not None and not self.unpack.eof:
                        raise ValueError("the archive ends within a record")
                    return False
            if self.unpack is None or self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            self.plain += self.unpack.decompress(self.packed, self.chunk)
            self.packed = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        """Up to a line's end, that left out; None at the end of the file."""
        held = bytearray()
        while self._more():
            at = self.plain.find(b"\n")
            held += self.plain[: at + 1] if at >= 0 else self.plain
            del self.plain[: at + 1 if at >= 0 else len(self.plain)]
            if at >= 0:
                return bytes(held).rstrip(b"\r\n")
        return bytes(held) or None

    def some(self, most: int) -> bytes:
        """At most so many bytes."""
        if not self._more():
            raise ValueError("the archive ends within a record")
        out = bytes(self.plain[:most])
        del self.plain[:most]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """n bytes in chunks of the same size, but for the last."""
        held = bytearray()
        while n:
            while len(held) < min(n, self.chunk):
                held += self.some(min(n, self.chunk) - len(held))
            yield bytes(held)
            n -= len(held)
            held.clear()


def _page(value: str | None) -> int | None:
    inside = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if inside else None


def read_records(source: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNKS: each record has at least one, an empty one if it has no payload."""
    stream = _Members(source, chunk)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while line := stream.line():
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        left = int(fields["content-length"])
        while left:  # the HTTP head
            line = stream.line()
            left -= len(line) + 2
            if not line:
                break
        page, kind, refers = _page(fields["warc-record-id"]), fields["warc-type"], _page(fields.get("warc-refers-to"))
        told = (int(fields["x-payload-length"]), fields["warc-payload-digest"].partition(":")[2])
        sha1, so_far, number = hashlib.sha1(usedforsecurity=False), 0, 0
        for data in stream.exactly(left):
            sha1.update(data)
            so_far += len(data)
            yield page, kind, refers, number, data, so_far, b32(sha1.digest()), so_far == left, *told
            number += 1
        if not left:
            yield page, kind, refers, 0, b"", 0, b32(sha1.digest()), True, *told


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """Any file system that Arrow reaches: a local or mounted path, hdfs:, s3:, gs: or file:."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives below folder; returns their manifest (path, records, bytes), kept in the shared folder."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("n"), F.unhex(F.sha1(body.cast("binary"))).alias("digest"))
    groups = rows.where(F.col("n") >= least_bytes).groupBy("n", "digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("size")).where("size > 1")
    told = attach(rows, cut(groups), ["n", "digest"], "size", pages.count(), ["page_id"])
    ready = told.select("page_id", "url", "body", "keep", (F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))).alias("again"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = name = None
        done, records = [], 0
        try:
            for batch in batches:
                for page, link, text, keep, again in zip(*(batch.column(i) for i in range(5)), strict=True):
                    if writer is None:
                        system, path = _open(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        name, out, records = path, system.open_output_stream(path, compression=None), 0
                        writer = Writer(out, chunk)
                    view = memoryview(text.as_buffer()) if text.is_valid and len(text.as_buffer()) else memoryview(b"")
                    writer.record(page.as_py(), link.as_py(), view, keep.as_py(), again.as_py())
                    records += 1
                    if writer.written >= file_bytes:
                        out.close()
                        done.append((f"{folder}/{name.rpartition('/')[2]}", records, writer.written))
                        out = writer = None
            if writer is not None:
                out.close()
                done.append((f"{folder}/{name.rpartition('/')[2]}", records, writer.written))
                out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return cut(ready.mapInArrow(write, "path string, records long, bytes long"))


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, data: bool = True, last_only: bool = False) -> DataFrame:
    """The chunk table of all archives, by CHUNKS; each archive is a task's. Without data, the bytes are checked but not returned."""
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string())
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inside = _open(path)
                held, size = [], 0
                with system.open_input_stream(inside, compression=None) as source:
                    for row in read_records(source, chunk):
                        if last_only and not row[7]:
                            continue
                        held.append(row if data else (*row[:4], None, *row[5:]))
                        size += len(row[4]) if data else 200
                        if size >= 4 << 20:
                            yield pack(held)
                            held, size = [], 0
                if held:
                    yield pack(held)

    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(read, CHUNKS)


def payload_facts(chunks: DataFrame) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's are those of the bytes read back, which must be as its head says; a revisit's are its head's."""
    last = chunks.where("is_last")
    response = F.col("record_type") == "response"
    wrong = response & ((F.col("bytes_so_far") != F.col("payload_bytes")) | (F.col("digest_so_far") != F.col("payload_digest")))
    size = F.when(wrong, F.raise_error(F.lit("a record differs from its digest"))).when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes"))
    digest = F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest"))
    return last.select("page_id", size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages and read the archives back: payload_facts of all records."""
    folder = shared_folder(pages.sparkSession, "warc")
    return payload_facts(read_chunks(write_archives(pages, folder, **options), data=False, last_only=True))
