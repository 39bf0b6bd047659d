"""WARC archives: writing captures, reading archives back, and assembling transactions.

A capture is written as three records: a request, a response (or a revisit where
an equal payload is archived elsewhere) and metadata.  Request and metadata name
the response by ``WARC-Concurrent-To``; a revisit names the record it repeats by
``WARC-Refers-To``.

Archives are gzip files written by Spark's text writer, so executors write
straight to any file system that Spark reaches.  Each row of text is one whole
archive: a task joins records with the format's record separator until they
have ``archive_mb`` MB, and a file holds one row.  Reading back parses each
archive by the records' content lengths, one archive at a time.  Records meet
under their concurrent-to identifiers and one nested row per capture comes out;
a revisit finds what it repeats by the identifier that it
refers to.

Nulls and edge cases: a null html is an empty payload; a null url is an empty
target; empty payloads are equal payloads like any others; payloads may hold
blank lines, record separators and text that looks like a header; repeated rows
(the same page_id) give one capture each, of which the first in order of the
hash of url and html is the representative; rows alike in all three are numbered
and the first of them is; a null page_id comes after all others; extra columns
are ignored; a page larger than an archive is an archive of its own; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import work_dir, written

_SPACE = uuid.UUID("6f0f2b52-3f0c-5c07-9a3e-1c7b1b7f7c11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """Parameters: least payload size that is deduplicated, MB of payload in an archive, and the capture date."""

    dedup_from: int = 0
    archive_mb: int = 8
    date: str = "2026-01-01T00:00:00Z"


def digest32(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}/{key}')}>"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(x or "").encode() for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("copy"), pa.array([digest32(x) for x in got]), pa.array([len(x) for x in got], pa.int64()),
                batch.column("url"), batch.column("html"),
            ],
            ["page_id", "copy", "digest", "bytes", "url", "html"],
        )


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _clean(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def _fields(page: int | None, size: int) -> bytes:
    """Metadata: the page and its payload's full length."""
    rows = [("page-id", "" if page is None else str(page)), ("payload-length", str(size))]
    return "".join(f"{k}: {v}\r\n" for k, v in rows).encode()


def _writer(a: Archive):
    """Captures to archives, a row of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page, copy, digest, n, url, html, first_key in zip(
                *(batch.column(c) for c in ("page_id", "copy", "digest", "bytes", "url", "html", "first_key"))
            ):
                records = _capture(a, page.as_py(), copy.as_py(), digest.as_py(), n.as_py(), url.as_py(), html.as_py(), first_key.as_py())
                more = sum(map(len, records)) + 4 * len(records)
                if held and size + more > a.archive_mb << 20:
                    yield _archive(held)
                    held, size = [], 0
                held += records
                size += more
        if held:
            yield _archive(held)

    return run


def _archive(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(records).decode()], pa.string())], ["value"])


def _capture(
    a: Archive, page: int | None, copy: str, digest: str, size: int, url: str | None, html: str | None, first_key: str | None,
) -> list[bytes]:
    """Request, response or revisit, and metadata of one page."""
    key = f"{'' if page is None else page}/{copy}"
    own, uri = record_id("capture", key), _clean(url)
    common = [("WARC-Date", a.date), ("WARC-Target-URI", uri)]
    proof = ("WARC-Payload-Digest", f"sha1:{digest}")
    if first_key is None or first_key == key:
        kind, block, extra = "response", HTTP_HEAD + (html or "").encode(), []
    else:
        kind, block = "revisit", HTTP_HEAD
        extra = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("capture", first_key)), ("WARC-Truncated", "length")]
    return [
        _record(
            [
                ("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", key)), ("WARC-Concurrent-To", own), *common,
                ("Content-Type", "application/http; msgtype=request"),
            ],
            f"GET {uri} HTTP/1.1\r\n\r\n".encode(),
        ),
        _record(
            [
                ("WARC-Type", kind), ("WARC-Record-ID", own), *common, proof, ("WARC-Block-Digest", f"sha1:{digest32(block)}"), *extra,
                ("Content-Type", "application/http; msgtype=response"),
            ],
            block,
        ),
        _record(
            [
                ("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", key)), ("WARC-Concurrent-To", own), *common,
                ("Content-Type", "application/warc-fields"),
            ],
            _fields(page, size),
        ),
    ]


def numbered(pages: DataFrame) -> DataFrame:
    """(page_id, copy, url, html); ``copy`` tells rows of one page_id apart: the hash of url and html, and a number where all three are alike."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
    )
    base = base.withColumn("hash", F.xxhash64("url", "html"))
    number = F.lit(0)
    if not base.groupBy("page_id", "hash").count().filter("count > 1").isEmpty():  # rows alike are rare; only then are pages moved to be numbered
        number = F.row_number().over(Window.partitionBy("page_id", "hash").orderBy("url", F.length("html"))) - 1
    copy = F.concat_ws("-", F.lpad(F.hex("hash"), 16, "0"), F.lpad(number.cast("string"), 10, "0"))  # text that sorts as the numbers do
    return base.select("page_id", copy.alias("copy"), "url", "html")


def captures(pages: DataFrame, archive: Archive) -> DataFrame:
    """Pages with payload digest and, of equal payloads, the one that is archived in full."""
    found = numbered(pages).mapInArrow(_digests, "page_id long, copy string, digest string, bytes long, url string, html string")
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("o"), F.col("copy").alias("c"))
    first = found.filter(F.col("bytes") >= archive.dedup_from).groupBy("digest", "bytes").agg(F.min(order).alias("m"))
    joined = found.join(first, ["digest", "bytes"], "left")
    page = F.when(F.col("m.o") == 2**63 - 1, "").otherwise(F.col("m.o").cast("string"))
    return joined.select("page_id", "copy", "digest", "bytes", "url", "html", F.concat(page, F.lit("/"), F.col("m.c")).alias("first_key"))


def write(pages: DataFrame, path: str, archive: Archive | None = None) -> None:
    """Write archives of ``pages`` (page_id, url, html) under ``path``, each of ``archive_mb`` MB at most or of one page."""
    a = archive or Archive()
    text = captures(pages, a).mapInArrow(_writer(a), "value string")
    text.write.option("lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


RECORDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, bytes long, digest string, block binary"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of one archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head[1:])}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, block
        at = end + 4 + size + 4


def _reader(with_blocks: bool):
    """Records of whole archives; responses' payloads are measured and checked against their digests where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size, raw = [], 0, content.as_py()
                for h, block in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    kind, digest = h["warc-type"], (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    length = None
                    if kind == "response":
                        payload = block.partition(SEPARATOR)[2]
                        length = len(payload)
                        if digest is not None and digest != digest32(payload):
                            raise ValueError("a payload differs from its digest")
                        digest = digest or digest32(payload)
                    kept = block if with_blocks or kind not in ("response", "revisit") else None
                    rows.append(
                        (
                            kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), length, digest,
                            kept,
                        )
                    )
                    size += len(kept or b"")
                    if size > 8 << 20:
                        yield _record_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _record_batch(rows)

    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "type": pa.string(), "record_id": pa.string(), "concurrent_to": pa.string(), "refers_to": pa.string(), "uri": pa.string(),
        "bytes": pa.int64(), "digest": pa.string(), "block": pa.binary(),
    }
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def read(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """Records of all archives under ``path``; an archive is parsed by its records' lengths, once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_reader(with_blocks), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata.

    Requests and metadata meet their capture under the identifier that they are
    concurrent to; all three come from one reading and one shuffle.
    """
    captured = F.col("type").isin("response", "revisit")
    meets = F.when(captured, F.col("record_id")).when(F.col("type").isin("request", "metadata"), F.col("concurrent_to"))
    side = lambda kind: F.min(F.when(F.col("type") == kind, F.struct(F.col("record_id").alias("id"), F.decode("block", "UTF-8").alias("fields")))).alias(kind)
    response = F.max(F.when(captured, F.struct("type", "refers_to", "uri", "bytes", "digest", "block"))).alias("response")
    met = records.withColumn("_capture", meets).filter("_capture is not null").groupBy("_capture").agg(response, side("request"), side("metadata"))
    return met.filter("response is not null").select(F.col("_capture").alias("record_id"), "response", "request", "metadata")


def _field(name: str):
    return F.nullif(F.regexp_extract("metadata.fields", rf"(?m)^{name}: (-?\d+)\r?$", 1), F.lit("")).cast("long")


def describe(transactions: DataFrame) -> DataFrame:
    """Page, payload size, digest and kind of each capture, and for a revisit the page of the record it refers to.

    A response's size is that of the payload read back; a revisit has the size of
    the response it refers to, found by its record identifier, or what its
    metadata say where that response is in none of the archives read.
    """
    own = transactions.select(
        "record_id", _field("page-id").alias("page_id"), _field("payload-length").alias("said"), "response.type", "response.refers_to",
        "response.bytes", "response.digest",
    )
    own = written(own, "captures")  # small rows, read twice; and a table lets the join be split at a response that very many refer to
    full = own.filter("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("bytes").alias("of_bytes"),
    )
    joined = own.join(full, "refers_to", "left")
    return joined.select(
        "page_id", F.coalesce("bytes", "of_bytes", "said").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of_page").alias("refers_to")
    )


def round_trip(pages: DataFrame, archive: Archive | None = None) -> DataFrame:
    """Write archives to the shared folder, read them back, assemble the transactions."""
    path = work_dir(pages.sparkSession, "warc")
    write(pages, path, archive)
    return describe(assemble(read(pages.sparkSession, path, with_blocks=False)))
