"""WARC archives: writing, reading, and revisit records for repeated payloads.

``resolve`` finds, per payload digest, the record whose payload is kept: headers alone
(id, digest, length) are shuffled, and a hot digest shrinks before the shuffle to its
largest id. ``write_archives`` writes one record per row with fresh headers: a response
with its payload, or a revisit without it that names the kept record. ``read_archives``
parses archives, and ``rewrite_archives`` joins revisits that it reads to their originals
and writes deduplicated archives of what it has read.

Files are written by Spark's text sink, a record per row; the line separator is the
empty line that ends a record. They are read as binary rows and cut by Content-Length.
Records are written where their row is read, so payloads are not shuffled for it; a file takes as
many of them as make about ``FILE_BYTES`` at the mean size of all.

Null payloads are empty. Null urls have no target header; control characters in urls are
percent-encoded. A record with a null id has the id "null" in its header and is read back
as null; it is kept only if no record of its payload has an id. Rows that repeat the kept
id and payload are responses as well. An empty table gives no records. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.llm.common import work_path
from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

LEAST_BYTES = 0  # shorter payloads are never revisits
FILE_BYTES = 16 << 20
CAPTURED = "2024-01-01T00:00:00Z"
RECORD_ID = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in base 32: 160 bits as four times 40."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), payload_bytes, payload_digest."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("bigint"), "url", html.alias("html")).withColumns({
        "payload_bytes": F.octet_length("html").cast("bigint"),
        "payload_digest": base32_sha1(F.col("html").cast("binary"))})


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """payload_digest, payload_bytes, kept: the id whose record keeps the payload.

    Only payloads that several rows share are listed.
    """
    same = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    return same.agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def with_types(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds record_type and refers_to."""
    out = join_dim(rows, kept, ["payload_digest", "payload_bytes"], ["page_id"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("kept"))).drop("kept")


def record_text(rows: DataFrame) -> Column:
    """The record without the empty line at its end."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda i: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    # a url is one line: control characters and spaces are encoded
    url = F.col("url")
    for code in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit(_HTTP), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(CAPTURED)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(rows: DataFrame, path: str, total_bytes: int, n_rows: int) -> None:
    """``rows`` as from ``with_types``; the bytes and number of all payloads set the records of a file."""
    per_file = max(1, FILE_BYTES * n_rows // max(1, total_bytes))
    writer = rows.select(record_text(rows)).write.option("lineSep", "\r\n\r\n")
    writer.option("maxRecordsPerFile", min(per_file, 1 << 30)).text(path)


_FIELD = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def parse_records(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, v in _FIELD.findall(data[at:end + 2])}
        start = end + 4
        at = start + int(headers[b"content-length"])
        yield headers, data[start:at]
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at += 4


def _page(name: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", name or b"")
    return int(found[1]) if found else None


def _parsed(with_payload: bool):
    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = []
                for headers, block in parse_records(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    fields = {k.lower(): v for k, v in _FIELD.findall(http + b"\r\n")}
                    kind = headers[b"warc-type"].decode()
                    digest = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    size = int(fields[b"content-length"])
                    if kind == "response":
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest or len(payload) != size:
                            raise ValueError(f"payload of {headers[b'warc-record-id']!r} does not match its header")
                    url = headers.get(b"warc-target-uri")
                    rows.append((
                        _page(headers[b"warc-record-id"]), url.decode() if url is not None else None, kind, digest, size,
                        _page(headers.get(b"warc-refers-to")),
                        payload.decode() if with_payload and kind == "response" else None))
                names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                keep = len(names) if with_payload else len(names) - 1
                yield pa.RecordBatch.from_arrays(columns[:keep], names[:keep])

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record; html is null for revisits and absent without ``with_payload``."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    schema = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
              "refers_to long") + (", html string" if with_payload else "")
    return files.mapInArrow(_parsed(with_payload), schema)


def _load(headers: DataFrame) -> tuple[int, int]:
    """Bytes of all payloads and their number."""
    row = headers.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    return row[0] or 0, row[1]


def archive_pages(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write the rows of ``pages`` (page_id, url, html) as deduplicated archives below ``path``."""
    rows = with_digest(pages)
    headers = durable(rows.select("page_id", "payload_bytes", "payload_digest"))
    write_archives(with_types(rows, resolve(headers, least_bytes)), path, *_load(headers))


def rewrite_archives(spark: SparkSession, source: str, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Deduplicate archives that may hold revisits: these get the payload digest of their original.

    A revisit whose original is missing stays a revisit of the same record.
    """
    records = read_archives(spark, source, with_payload=True)
    headers = durable(records.drop("html"))
    kept = resolve(headers.filter("record_type = 'response'"), least_bytes)
    fresh = with_types(records.filter("record_type = 'response'").drop("record_type", "refers_to"), kept)
    originals = headers.filter("record_type = 'response'").select("payload_digest", "payload_bytes", "page_id")
    originals = originals.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("found"))
    old = join_dim(records.filter("record_type = 'revisit'"), originals, ["payload_digest", "payload_bytes"],
                   ["page_id"], "left")
    old = old.withColumn("refers_to", F.coalesce("found", "refers_to")).drop("found")
    write_archives(fresh.unionByName(old.select(fresh.columns)), path, *_load(headers))


def page_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archive the pages in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    archive_pages(pages, path, least_bytes)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
