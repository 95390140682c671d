"""WARC archives: a writer of one gzip member per record and a sequential reader.

The reader decompresses each member piece by piece, cuts records by Content-Length and never holds more than a
piece of a file (and, only if payloads are asked for, one payload). Block and payload digests are recomputed from what was read.

Equal payloads are stored once: the page with the smallest page_id is the response, the others are revisits that refer to it and
carry only the HTTP header.

Archives are written to the shared folder, each under a name of its own attempt; the table of finished
archives is written after them, so a task that is run again leaves at most an unread file.

Nulls: null html is an empty payload; a null url is written as ``urn:page:<page_id>``; rows with a null page_id revisit an equal payload that has a page_id,
else they are responses. Repeated rows with the smallest page_id are all responses. An empty table gives an empty result. Columns besides
page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.shared import fresh_path, parallelism, written

#: Bytes after which a task begins another archive.
ROLL = 256 << 20
PIECE = 1 << 16
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else path if not parts.scheme else None


def _open(path: str, mode: str):
    if local := _local(path):
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow.fs import FileSystem

    store, inner = FileSystem.from_uri(path)
    if mode == "wb":
        store.create_dir(os.path.dirname(inner), recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_stream(inner)


class _Member:
    """The decompressed bytes of one gzip member, taken in order."""

    def __init__(self, file, left: bytes):
        self.file, self.left, self.unzip, self.ready = file, left, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.unzip.eof:
            return False
        data = self.unzip.unconsumed_tail or self.left or self.file.read(PIECE)
        if data is not self.unzip.unconsumed_tail:
            self.left = b""
        if not data:
            raise ValueError("the archive ends inside a record")
        self.ready += self.unzip.decompress(data, PIECE)
        if self.unzip.eof:
            self.left = self.unzip.unused_data
        return True

    def line_block(self) -> bytes:
        """What comes before the next empty line, and that line."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a header has no end")
        out, self.ready = self.ready[: at + 4], self.ready[at + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            while not self.ready:
                if not self.more():
                    raise ValueError("a block is shorter than its Content-Length")
            out, self.ready = self.ready[:n], self.ready[n:]
            n -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}


def records(file, payloads: bool = False) -> Iterator[dict]:
    """The records of an open archive in order. ``valid``: both digests agree with what was read (a revisit has a block digest only)."""
    left = b""
    while True:
        left = left or file.read(PIECE)
        if not left:
            return
        member = _Member(file, left)
        head = _fields(member.line_block())
        size, seen, whole, body, kept, http = int(head["content-length"]), hashlib.sha1(), hashlib.sha1(), 0, [], b""
        inside = False
        for piece in member.take(size):
            seen.update(piece)
            if not inside:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                inside, piece, http = True, http[at + 4 :], http[: at + 4]
            whole.update(piece)
            body += len(piece)
            if payloads:
                kept.append(piece)
        for _ in member.take(4):
            pass
        while member.more():
            pass
        if member.ready:
            raise ValueError("a record is longer than its Content-Length")
        left = member.left
        kind, stated = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        digest = base64.b32encode(whole.digest()).decode()
        valid = head["warc-block-digest"] == f"sha1:{base64.b32encode(seen.digest()).decode()}" and (kind == "revisit" or digest == stated)
        yield {
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "uri": head["warc-target-uri"],
            "payload_bytes": body if kind == "response" else int(_fields(http)["content-length"]),
            "payload_digest": digest if kind == "response" else stated,
            "record_type": kind,
            "refers_to": int(head["x-refers-to-page-id"]) if kind == "revisit" else None,
            "valid": valid,
            "payload": b"".join(kept) if payloads and kind == "response" else None,
        }


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, record_type, refers_to. The first page of each payload comes from a pre-aggregated minimum; the join on the payload's digest hashes
    that narrow side, so that pages aren't sorted, and is one that AQE can split where many pages share a payload."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("_digest", F.sha1(F.col("html").cast("binary")))
    first = own.groupBy(F.col("_digest").alias("_d")).agg(F.min("page_id").alias("_first"))
    again = (F.octet_length("html") >= least) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return own.join(first.hint("shuffle_hash"), F.col("_digest") == F.col("_d")).select(
        "page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to")
    )


def write_archives(plan: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes the archives; path, records, bytes of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            file.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        parts = (batch.slice(at, 128) for batch in batches for at in range(0, batch.num_rows, 128))
        for part in parts:
            for page_id, url, html, kind, first in zip(*(c.to_pylist() for c in part.columns)):
                if file is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = _open(path, "wb")
                data = record(page_id, url, html.encode(), kind, first)
                file.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    yield done()
                    file = None
        if file is not None:
            yield done()

    return written(plan.mapInArrow(write, "path string, records long, bytes long"), "archives")


READ = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the archives named in ``path``: one task reads an archive from its start to its end."""
    schema = READ + (", payload binary" if payloads else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()][: 7 + payloads]
        names = [x.split()[0] for x in schema.split(", ")]

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with _open(path, "rb") as file:
                    for r in records(file, payloads):
                        rows.append(r)
                        held += 200 + len(r["payload"] or b"")
                        if held > 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return archives.select("path").repartition(parallelism(archives.sparkSession)).mapInArrow(read, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages to archives and reads them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(planned(pages, least), folder))
