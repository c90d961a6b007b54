r"""WARC archives with revisit resolution.

Pages become WARC/1.1 records. Their headers (never the payloads) are aggregated by payload digest; the page with the
smallest id of each digest is the response and the others become revisit records, which carry fresh headers and no
payload. Each record is a gzip member of its own (records of 16 MB or more are several members), so that it can be read by
its offset alone. Archives are written by Spark's text sink, one row a file, so tasks that are lost are run again and only
committed files count. Reading goes by Content-Length, so payloads may hold anything. Revisit records are joined to the
responses that they name by payload digest.

Payloads are shuffled once at most, by the join that marks revisits, and each partition of it becomes archive files of
about `file_bytes` compressed bytes, more only by the last record. A task holds one such file and one record. Digests with
very many pages are joined by broadcast (see common.join_by_key).

Defined results: null html is an empty payload. Payloads under `min_bytes` are all responses. A null page_id can be
response only if all ids of its digest are null. Rows that repeat the smallest page_id are all responses, and revisits name
the smallest of their URLs. Rows of one page_id and digest have the same WARC-Record-ID. A null URL gives a record without
WARC-Target-URI, and revisits of it have no WARC-Refers-To-Target-URI. Control characters and blanks in URLs are percent-encoded, each by
its own value; the record of such a URL also has its own text (X-Url, base64), which the reader gives back. All records of one writing have one WARC-Date. An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

END = "\r\n\r\n"
#: Compressed bytes of an archive file, and rows of an Arrow batch that the reader gives.
FILE_BYTES, READ_ROWS = 16 << 20, 1000
#: Shorter gzip members end in a zero byte, the highest of their length.
MEMBER_BYTES = (1 << 24) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, digest string, payload_bytes long, refers_digest string"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, by JVM functions: four base32 digits for each five hex digits."""
    digits, table = F.sha1(data), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(table, F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest) of each page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("digest"),
    )


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers() with `original` and `original_url`: null for responses, else page_id and URL of the response that the row revisits."""
    head = headers(pages)
    large = head.where(F.col("payload_bytes") >= min_bytes).select("page_id", "digest", "url")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    groups = large.groupBy("digest").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    repeated = common.materialise(groups.select("digest", "n", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")), "warc-digests")
    # only ids and digests meet the shuffle of repeated digests
    copies = common.join_by_key(large.select("page_id", "digest"), repeated, ["digest"], "n").where(~F.col("page_id").eqNullSafe(F.col("original")))
    m = copies.select(F.col("page_id").alias("m_id"), F.col("digest").alias("m_digest"), "original", "original_url").distinct()
    same = F.col("page_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest"))
    return head.join(m, same, "left").select(*head.columns, "original", "original_url")


def header_url(url: Column) -> Column:
    """A URL for a header line: control characters and blanks are percent-encoded, each by its own value; all else stays."""
    out = url
    for c in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(unfit(url), out).otherwise(url)


def unfit(url: Column) -> Column:
    """Whether a URL holds what no header line can."""
    return F.rlike(url, F.lit(r"[\x00-\x20\x7F]"))


def record(date: str) -> Column:
    """The text of one WARC record, with its end, of a row of resolve()."""
    original, revisit = F.col("original"), F.col("original").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    uuid = lambda *cols: F.regexp_replace(F.md5(F.concat_ws("|", *cols)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    names = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", uuid(original.cast("string"), F.col("digest"))),
        line("WARC-Refers-To-Target-URI", header_url(F.col("original_url"))),
        line("WARC-Refers-To-Date", F.lit(date)),
    )
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uuid(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", header_url(F.col("url"))),
        line("X-Url", F.when(unfit(F.col("url")), F.translate(F.base64(F.encode("url", "UTF-8")), "\r\n", ""))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, names).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        F.lit(END),
    )


def members(data: bytes) -> Iterator[bytes]:
    """Gzip members of data, each of MEMBER_BYTES at most."""
    for a in range(0, len(data), MEMBER_BYTES):
        packer = zlib.compressobj(wbits=31)
        yield packer.compress(data[a : a + MEMBER_BYTES]) + packer.flush()


def write_archives(resolved: DataFrame, path: str, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """Writes WARC files of about file_bytes each, every record compressed by itself; date is now if none is given."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bytearray()

        def full() -> pa.RecordBatch:
            # the sink ends the row, and so the file, by the zero byte that is taken off here
            return pa.RecordBatch.from_pydict({"value": pa.array([bytes(memoryview(own)[:-1])], pa.binary())})

        for batch in batches:
            for value in batch.column("value"):
                for member in members(value.as_py().encode()):
                    own += member
                if len(own) >= file_bytes:
                    yield full()
                    own = bytearray()
        if own:
            yield full()

    rows = resolved.select(record(date).alias("value")).mapInArrow(files, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and content block of each record of a WARC stream."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        fields = {}
        while (line := stream.readline().strip()) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip(" \t\r\n")
        block = stream.read(int(fields["content-length"]))
        stream.read(len(END))
        yield fields, block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in RECORD.split(","))])
    for batch in batches:
        for content in batch.column("content"):
            stream: BinaryIO = io.BytesIO(content.as_py())
            if stream.getbuffer()[:2] == b"\x1f\x8b":
                stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
            rows = []
            for f, block in parse(stream):
                revisit = f["warc-type"] == "revisit"
                named = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                digest = named if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                if named != digest:
                    raise ValueError("payload digest does not fit")
                page, url = f.get("x-page-id"), f.get("warc-target-uri")
                url = base64.b64decode(f["x-url"]).decode() if "x-url" in f else url
                rows.append({
                    "page_id": int(page) if page else None, "url": url, "record_type": f["warc-type"], "digest": digest,
                    "payload_bytes": None if revisit else len(block), "refers_digest": named if revisit else None,
                })
                if len(rows) == READ_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; payload digests are computed anew from the payloads."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records, RECORD)


def follow_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, digest, record_type, refers_to): revisit records joined to their originals by digest."""
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    counts = revisits.groupBy("digest").agg(F.count("*").alias("n"))
    named = responses.join(counts, "digest", "left_semi").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("full"))
    table = common.materialise(named.join(counts, "digest"), "warc-originals")
    joined = common.join_by_key(revisits.select("page_id", "digest", "record_type"), table, ["digest"], "n")
    cols = ["page_id", "payload_bytes", "digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(cols).unionByName(joined.withColumnRenamed("full", "payload_bytes").select(cols))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = common.new_path(spark, "warc")
    write_archives(resolve(pages), path)
    back = follow_revisits(common.materialise(read_archives(spark, path), "warc-records"))
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as hex from pages),
d as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), 'string_agg', '') as digest from p)
select page_id, octet_length(b)::bigint as payload_bytes, digest as payload_digest,
  case when page_id = min(page_id) over (partition by digest) then 'response' else 'revisit' end as record_type,
  case when page_id <> min(page_id) over (partition by digest) then min(page_id) over (partition by digest) end as refers_to
from d
"""
