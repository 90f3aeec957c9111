"""WARC writing, reading and transaction assembly.

A capture is three records: a request, a response (or a revisit of an equal payload), and metadata. The request and
the metadata name the response or revisit in WARC-Concurrent-To; assembly joins them on it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash, stash_path

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
#: Fixed by the format: the profile of revisits of identical payloads.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1, without padding (160 bits are 32 digits)."""
    digits = F.sha1(data)
    out = []
    for k in range(4):
        five = F.conv(F.substring(digits, 10 * k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(_ALPHABET), (F.shiftright(five, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


def _record(kind: str, ident: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """The text of one record up to, not with, its closing two line ends."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), ident, F.lit(">\r\n")]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, least: int = 0, broadcast_rows: int = 200_000, page: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the captures of pages as WARC files below path.

    Files are text whose lines end in the two line ends that close a record, so Spark's own committer writes them and
    a lost executor's files are written again. Of the pages with equal payloads of at least `least` bytes, that with
    the smallest page_id (then the first in the table) is a response and the others revisit it; smaller payloads are
    all responses. Equal payloads are found by digest: the smallest page of each is aggregated on the map side first.
    Only digests that repeat go back to the pages: broadcast where they are at most broadcast_rows, else by a join that
    Spark may split where a digest is hot.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page).cast("string").alias("name"), F.col(page).alias("page"), F.regexp_replace(F.col(url), r"[\x00-\x20\x7f]", "_").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    first = F.min(F.struct(F.col("page").isNull(), F.col("page"), F.col("row")))
    chosen = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    chosen = stash(chosen.select("digest", F.col("f.page").cast("string").alias("to"), F.col("f.row").alias("to_row")), "repeated")
    rows = rows.join(F.broadcast(chosen) if chosen.limit(broadcast_rows + 1).count() <= broadcast_rows else chosen, "digest", "left")
    ident = lambda kind, name, row: F.concat(F.lit(f"urn:capture:{kind}:"), F.coalesce(name, F.lit("")), F.lit(":"), row.cast("string"))
    name, row = F.col("name"), F.col("row")
    again = F.coalesce(F.col("to_row") != row, F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    target, when = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    content = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", ident("response", name, row), [target, when, digest, content], F.concat(http, F.col("payload")))
    refers = ("WARC-Refers-To", F.concat(F.lit("<"), ident("response", F.col("to"), F.col("to_row")), F.lit(">")))
    revisit = _record("revisit", ident("revisit", name, row), [target, when, digest, ("WARC-Profile", F.lit(PROFILE)), refers, content], http)
    kept = F.when(again, ident("revisit", name, row)).otherwise(ident("response", name, row))
    beside = ("WARC-Concurrent-To", F.concat(F.lit("<"), kept, F.lit(">")))
    asked = F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record("request", ident("request", name, row), [target, when, beside, ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    facts = F.concat(F.coalesce(F.concat(F.lit("page-id: "), name, F.lit("\r\n")), F.lit("")), F.lit("payload-length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", ident("metadata", name, row), [target, when, beside, ("Content-Type", F.lit("application/warc-fields"))], facts)
    lines = rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))
    # files of about 32 MB, as each is read whole
    mean = pages.agg(F.avg(F.octet_length(html))).first()[0] or 0.0
    lines.write.option("lineSep", _END).option("maxRecordsPerFile", max(30, 3 * int((32 << 20) / (mean + 2000)))).text(path)


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record; blocks are cut by their Content-Length alone, where a record
    has one."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", start)
        if stop < 0:
            return
        head = data[start:stop]
        if found := _LENGTH.search(head):
            size = int(found[1])
        else:
            # without a length, a block goes up to the next record
            after = data.find(_END.encode() + b"WARC/", stop + 4)
            size = (after if after >= 0 else len(data.removesuffix(_END.encode()))) - stop - 4
        fields = {}
        for line in head.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.decode().lower()] = v.strip().decode()
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


_SCHEMA = "kind string, id string, url string, concurrent_to string, refers_to string, bytes long, digest string, block binary"


def read_records(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """One row per record of the archives below path. bytes and digest are of the payload (after the HTTP head) of
    responses, computed from what was read; block is null unless asked for (metadata keeps it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for f, block in parse(content.as_py()):
                    kind = f.get("warc-type", "")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    bare = [v.strip("<>") if (v := f.get(k)) else None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to")]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None
                    rows.append((kind, bare[0], f.get("warc-target-uri"), bare[1], bare[2], None if payload is None else len(payload), digest, block if blocks or kind == "metadata" else None))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _SCHEMA)


_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], ["kind", "id", "url", "concurrent_to", "refers_to", "bytes", "digest", "block"])


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: id, url, response struct (kind, refers_to, bytes, digest, block), request struct,
    metadata struct. bytes and digest of a revisit are those of the response it refers to. A capture without request
    or metadata has nulls there; requests and metadata that name no capture are left out."""
    mains = records.where("kind IN ('response', 'revisit')")
    extra = lambda kind: records.where(F.col("kind") == kind).select(F.col("concurrent_to").alias("id"), F.struct(F.col("id"), F.col("url"), F.col("block")).alias(kind))
    full = records.where("kind = 'response'").select(F.col("id").alias("refers_to"), F.col("bytes").alias("_b"), F.col("digest").alias("_d"))
    joined = mains.join(extra("request"), "id", "left").join(extra("metadata"), "id", "left").join(full, "refers_to", "left")
    said = F.struct("kind", "refers_to", F.coalesce("bytes", "_b").alias("bytes"), F.coalesce("digest", "_d").alias("digest"), "block")
    return joined.select("id", "url", said.alias("response"), "request", "metadata")


def round_trip(pages: DataFrame, least: int = 0, name: str = "warc") -> DataFrame:
    """Writes the archives of pages into the shared folder, reads them once and assembles their captures.

    pages must give the same rows in the same order when it is read again, as a written table does: the rows' places
    name the captures. Null html is an empty payload; null url has no WARC-Target-URI; white space in urls becomes _ in
    the archive. Null page_id: written and read without one (last in the order that picks responses). Repeated rows are
    captures of their own, the first being the response. Very long html is one record, read whole. Other columns play no
    part. An empty table gives no captures.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = stash_path(spark, name)
    write_archives(pages, path, least)
    # without blocks but those of metadata: a small table, which four branches of the assembly read
    return assemble(stash(read_records(spark, path), "records"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    named = lambda c: F.nullif(F.regexp_extract(c, r"^urn:capture:response:([^:]*):", 1), F.lit("")).cast(kind)
    said = F.nullif(F.regexp_extract(F.col("metadata.block").cast("string"), r"(?m)^page-id: ([^\r\n]*)", 1), F.lit("")).cast(kind)
    return round_trip(pages).select(said.alias("page_id"), F.col("response.bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), named(F.col("response.refers_to")).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
