"""WARC archives with revisit resolution.

Records are written by Spark's own text sink: a WARC record ends with CR LF CR LF, which is given as the
line separator, so the sink's commit protocol (and any file system Spark knows) serves the archives too.
Reading is by Content-Length, never by looking for separators, so payloads may hold any characters.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import apart, lean, remove, scratch

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
#: Records in one archive file at most; readers hold one compressed file at a time.
RECORDS_PER_FILE = 4000

RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to_id string, digest string, payload_bytes long, header_digest string, payload binary"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def resolve_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to pages (page_id, url, html).

    Only digests are aggregated, with a map-side combine, so a payload that a third of all pages
    share arrives as one row per task; the join back splits hot digests (AQE skew join), as its other side holds each digest once.
    Null html counts as empty. Rows with a null page_id are always responses. Repeated rows of the smallest page_id are all responses.
    Payloads of any length are digested whole. Extra columns are kept, but for those with the four new names, which are replaced. An empty table gives an empty result.
    """
    new = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    order = [c for c in pages.columns if c not in new]
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages, names = apart(pages.drop(*new), "page_id", "url", "html")
    rows = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("page_id").alias("_n"))
    first = first.where("_n > 1").drop("_n")
    seen = rows.join(first, "payload_digest", "left")
    again = F.coalesce(F.col("page_id") > F.col("_first"), F.lit(False))
    out = seen.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))})
    back = {c: n for n, c in names.items()}
    return out.select(*(F.col(f"`{back.get(c, c)}`").alias(c) for c in order), *new)


def record_text(date: str) -> Column:
    """One record, without its closing CR LF CR LF, of a row that resolve_revisits() made."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP_HEAD), F.when(again, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit(""))))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), r"[\x00-\x20]", "%20")
    return F.concat(
        F.lit(VERSION + CRLF),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", name(F.col("page_id"))),
        _field("WARC-Target-URI", url),
        _field("WARC-Date", F.lit(date)),
        F.when(again, F.concat(_field("WARC-Profile", F.lit(REVISIT_PROFILE)), _field("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(""),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes pages as gzipped WARC files below ``path``; repeats of a payload become revisit records."""
    records = resolve_revisits(pages, min_bytes).select(record_text(date).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_archive(content: bytes, keep_payload: bool = False) -> Iterator[tuple]:
    """Records of one (possibly gzipped) archive, decompressed piece by piece."""
    feed = zlib.decompressobj(wbits=47) if content[:2] == b"\x1f\x8b" else None
    view, at, buffer = memoryview(content), 0, bytearray()

    def more() -> bool:
        nonlocal at, feed
        if at >= len(view):
            return False
        piece = view[at : at + (1 << 18)]
        at += len(piece)
        if feed is None:
            buffer.extend(piece)
        else:
            buffer.extend(feed.decompress(piece))
            while feed.eof and feed.unused_data:  # further gzip members
                rest, feed = feed.unused_data, zlib.decompressobj(wbits=47)
                buffer.extend(feed.decompress(rest))
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        lines = bytes(buffer[:end]).decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, length = end + 4, int(head["content-length"])
        while len(buffer) < start + length + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        block = bytes(buffer[start : start + length])
        if buffer[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        del buffer[: start + length + 4]
        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        full = head["warc-type"] == "response"
        yield (
            head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"),
            hashlib.sha256(payload).hexdigest() if full else None, len(payload) if full else None,
            head.get("warc-payload-digest", "").rpartition(":")[2] or None, payload if keep_payload else None,
        )


def read_archives(spark: SparkSession, path: str, *, keep_payload: bool = False) -> DataFrame:
    """Records of all archives below ``path``. digest and payload_bytes are computed from the stored payload; revisits have none of their own."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in parse_archive(content.as_py(), keep_payload):
                    rows.append(record)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows))], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows))], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lean(parse), RECORD_SCHEMA)


def resolved_payloads(records: DataFrame) -> DataFrame:
    """One row per record with the full payload's size and digest: revisit records are joined to the response they name.

    Responses are unique by record id among those referred to, so the join can split a hot response's revisits.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long") if hasattr(c, "try_cast") else F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    rows = records.withColumns({"page_id": page(F.col("record_id")), "refers_to": page(F.col("refers_to_id"))})
    originals = rows.where("record_type = 'response'").groupBy("record_id", "digest").agg(F.first("payload_bytes").alias("_bytes"))
    originals = originals.select(F.col("record_id").alias("refers_to_id"), F.col("digest").alias("header_digest"), F.col("digest").alias("_digest"), "_bytes")
    joined = rows.join(originals, ["refers_to_id", "header_digest"], "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("digest", "_digest").alias("payload_digest"), "record_type", "refers_to", "target_uri")


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 100) -> DataFrame:
    """Writes the archives to the shared folder, reads them back and returns what they say of each page."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    return resolved_payloads(read_archives(spark, path)).drop("target_uri")


def discard(spark: SparkSession, path: str) -> None:
    """Removes archives that are no longer needed."""
    remove(spark, path)
