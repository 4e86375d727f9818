"""WARC 1.1 archives: a writer with one gzip member per record, and a sequential reader.

The reader holds one record's block at a time at most: it feeds the file to zlib in pieces, takes
header lines up to the blank line, frames the block by Content-Length, checks the payload digest
while bytes pass by, and steps to the next member where zlib reports a member's end.

Archives go to the folder in ``spark.checkpoint.dir`` (or a folder that the caller names), never to
a machine's own disk. A writing task writes its file under a temporary name and renames it; a task
that runs again after a lost executor replaces its file by an equal one.

Defined results: null html is the empty payload; records of equal payloads refer to the smallest
page_id, which null loses to any number; rows that repeat this page_id are all responses; a null
url is the empty target; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_path, materialise

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ORIGIN = uuid.UUID("5f0d9f3c-7f0b-4a5e-9a6e-0c3f7f1f2b11")


#: A URL is written as it is; one with spaces or control characters has these and % escaped, and a header says so.
_BREAKS = re.compile(r"[\x00-\x20\x7f]")
_UNSAFE = re.compile(r"[\x00-\x20\x7f%]")


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(path: str, mode: str):
    """A file of the shared folder: a plain path or file: URI, else what pyarrow can open."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return where.open_output_stream(inner) if "w" in mode else where.open_input_stream(inner)


def record_bytes(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url: str | None, html: str | None, digest: str, first) -> bytes:
    """A response record, or a revisit (no payload) that refers to page ``first``.

    ``first`` is None for a response.
    """
    payload = (html or "").encode("utf-8", "surrogatepass")
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url and _BREAKS.search(url) else url or ""
    ident = lambda i: f"<urn:uuid:{uuid.uuid5(_ORIGIN, str(i))}>"
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", ident(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if uri != (url or ""):
        headers.append(("X-Target-Escaped", "1"))
    if first is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", ident(first)),
            ("X-Refers-To-Page", str(first)),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return record_bytes(headers, http.encode() + (b"" if first is not None else payload))


class _Members:
    """Bytes of a gzip file of many members; ``at_end`` tells the end of the current member."""

    def __init__(self, source):
        self.source, self.raw, self.zip, self.out = source, b"", None, bytearray()

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
        self.zip = zlib.decompressobj(31) if self.raw else None
        return self.zip is not None

    def more(self) -> bool:
        """Decompress a little more of this member; False at its end."""
        while not self.zip.eof:
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    raise WarcError("the file ends within a record")
            try:
                got = self.zip.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.out.find(mark, start)) < 0:
            start = max(0, len(self.out) - len(mark) + 1)
            if not self.more():
                raise WarcError("a record's header has no end")
        got = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return got

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise WarcError("a record is shorter than its Content-Length")
            got = bytes(self.out[:n])
            del self.out[: len(got)]
            n -= len(got)
            yield got


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    pairs = (x.split(":", 1) for x in lines[1:] if ":" in x)
    return {k.strip(" \t").lower(): v.strip(" \t") for k, v in pairs}


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an open archive, in order, digests verified."""
    data = _Members(source)
    while data.next_member():
        head = data.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise WarcError("no WARC version line")
        headers = _headers(head)
        if not headers.get("content-length", "").isdigit():
            raise WarcError("no Content-Length")
        sha, parts, opening = hashlib.sha1(), [], bytearray()
        in_payload = "http" not in headers.get("content-type", "")
        for part in data.exactly(int(headers["content-length"])):
            if not in_payload:
                opening += part
                at = opening.find(b"\r\n\r\n")
                if at < 0:
                    continue
                in_payload, part = True, bytes(opening[at + 4 :])
            sha.update(part)
            parts.append(part)
        if b"".join(data.exactly(4)) != b"\r\n\r\n" or data.out or data.more():
            raise WarcError("a record has no proper end")
        want = headers.get("warc-payload-digest", "")
        if headers.get("warc-type") != "revisit" and want:
            if want != "sha1:" + base64.b32encode(sha.digest()).decode():
                raise WarcError(f"digest of {headers.get('warc-record-id')} differs")
        yield headers, b"".join(parts)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        local = folder.startswith("file:") or "://" not in folder
        # a store without rename gets a file per attempt; only the attempt that ends well is listed
        attempt = "" if local else f"-{uuid.uuid4().hex}"
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}{attempt}.warc.gz"
        out, count = None, 0
        plain = "/" + name[5:].lstrip("/") if name.startswith("file:") else name
        temp = f"{plain}.{uuid.uuid4().hex}.tmp" if local else name
        for b in batches:
            for page_id, url, html, first, seen in zip(
                *(b.column(k).to_pylist() for k in ("page_id", "url", "html", "first", "revisit")), strict=True
            ):
                if out is None:
                    if local:
                        os.makedirs(os.path.dirname(plain), exist_ok=True)
                    out = _open(temp, "wb")
                digest = base32_sha1((html or "").encode("utf-8", "surrogatepass"))
                out.write(page_record(page_id, url, html, digest, first if seen else None))
                count += 1
        if out is not None:
            out.close()
            if local:
                os.replace(temp, plain)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [count]})

    return write


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; (path, records) per archive."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
    )
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    seen = rows.join(firsts.filter("n > 1"), "digest", "left").select(
        "page_id",
        "url",
        "html",
        "first",
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )
    return materialise(seen.mapInArrow(_writer(folder), "path string, records long"), "warc-list")


def _reader(with_payload: bool):
    return lambda batches: _read(batches, with_payload)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    number = lambda x: int(x) if x else None

    def pack(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for b in batches:
        for path in b.column("path").to_pylist():
            rows, held = [], 0
            with _open(path, "rb") as source:
                for h, payload in read_records(source):
                    kind = h.get("warc-type")
                    size = int(h["x-payload-length"]) if kind == "revisit" else len(payload)
                    url = h.get("warc-target-uri", "")
                    payload = payload if with_payload else None
                    rows.append((
                        number(h.get("x-page-id")), unquote(url) if "x-target-escaped" in h else url, kind,
                        h.get("warc-payload-digest", "").removeprefix("sha1:"), size,
                        number(h.get("x-refers-to-page")), payload,
                    ))
                    held += len(payload or b"")
                    if held > 1 << 22 or len(rows) >= 2000:
                        yield pack(rows)
                        rows, held = [], 0
            yield pack(rows)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``archives.path``, one task per few archives.

    Digests are verified in any case; without ``with_payload`` that column is null.
    """
    spark: SparkSession = archives.sparkSession
    paths = archives.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return paths.mapInArrow(
        _reader(with_payload),
        "page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
        "refers_to long, payload binary",
    )
