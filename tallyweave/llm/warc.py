"""Content-addressed WARC archive.

An archive is a folder with two tables: ``payloads`` (digest, payload) holds the bytes of every distinct payload once,
under their SHA-256; ``headers`` (ordinal key, digest, header) holds for every record the exact bytes that stand before
its payload: the WARC header and the HTTP head. A record is ``header + payload + CRLF CRLF``; that of a revisit has no
payload of its own. ``restore`` rebuilds all records by a join on the digest and refuses bytes whose digest differs
from the key; ``parse`` reads records; ``write_files`` and ``read_files`` move records to and from plain ``.warc`` files.

Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest key is the response, the others
revisit it; rows with smaller payloads are all responses.

Defined results
---------------
* A null page has the empty payload. Rows that repeat key and payload are the same capture: where the key is the
  group's smallest they are all responses. A null key sorts behind all others; its record carries no page id.
* Line breaks are removed from URLs, a null URL is written as ``urn:page:<key>``.
* Pages of any length are stored whole, up to the size of one value.
* An empty table gives an empty archive. Columns besides key, url and page are not read.

The digests are narrow and are grouped without the payloads; a hot payload is pre-aggregated. Payloads are moved once,
to meet their headers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import common

#: Rows that are not to be stored (copies) are told to all tasks up to this number, 32 bytes each; beyond, by a shuffle.
MAX_BROADCAST_COPIES = 500_000
CRLF = "\r\n"
END = CRLF * 2
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times 40 bits, as eight digits each."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("page/"), F.coalesce(key.cast("string"), F.lit("null"))))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _facts(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")), "UTF-8")
    return pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def _header(date: str) -> Column:
    """The bytes before the payload, from key, url, size, sha1, first and revisit."""
    uri = F.coalesce(F.regexp_replace("url", "[\r\n]", ""), F.concat(F.lit("urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))))
    http = F.concat_ws(CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("size")), F.lit(CRLF))
    block = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("key"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first")))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("X-Page-ID: "), F.col("key").cast("string")),
        F.concat(F.lit("Content-Length: "), block),
        F.lit(CRLF),
    ]
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), http), "UTF-8")


def write_archive(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", page: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """Write one record for each row of ``pages`` into the archive at ``path``, a folder that does not exist yet."""
    spark = pages.sparkSession
    facts = _facts(pages, key, url, page)
    narrow = facts.select("key", "url", "digest", F.octet_length("payload").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    narrow, narrow_path = common.written(narrow, "captures")
    firsts = narrow.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    firsts, firsts_path = common.written(firsts.where("n > 1").drop("n"), "firsts")
    linked = narrow.join(firsts, "digest", "left")
    behind = F.col("key").isNull() | (F.col("key") > F.col("first"))
    revisit = F.coalesce(F.col("first").isNotNull() & behind & (F.col("size") >= min_bytes), F.lit(False))
    linked = linked.withColumn("revisit", revisit)
    linked.select("key", "digest", "revisit", _header(date).alias("header")).write.parquet(f"{path}/headers")
    # a digest's payload is kept from the row with the smallest key; several rows may share that key, or have none
    copies, copies_path = common.written(linked.where("first is not null").select("key", "digest", behind.alias("behind")), "copies")
    few = copies.count() <= MAX_BROADCAST_COPIES
    near = F.broadcast if few else lambda d: d
    several = copies.where(F.coalesce("behind", F.lit(True))).select(F.col("key").alias("k"), F.col("digest").alias("d")).distinct()
    kept = facts.select("key", "digest", "payload").join(near(several), F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left_anti")
    repeats = narrow.groupBy("digest", "key").agg(F.count("*").alias("n")).where("n > 1").select("digest").distinct()
    unkeyed = narrow.where("key is null").select("digest").distinct().join(firsts.where("first is null"), "digest", "left_semi")
    odd, odd_path = common.written(repeats.unionByName(unkeyed).distinct(), "odd")
    apart = F.broadcast(odd) if odd.count() <= MAX_BROADCAST_COPIES else odd
    once = kept.join(apart, "digest", "left_anti").select("digest", "payload")
    again = facts.select("digest", "payload").join(apart, "digest", "left_semi").groupBy("digest").agg(F.first("payload").alias("payload"))
    once.unionByName(again).write.option("compression", "zstd").parquet(f"{path}/payloads")
    common.drop(spark, narrow_path, firsts_path, copies_path, odd_path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, record): the exact bytes of every record; a payload whose digest is not its key raises an error."""
    headers, payloads = (spark.read.parquet(f"{path}/{t}") for t in ("headers", "payloads"))
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("binary"))
    own = headers.where("not revisit").join(payloads.select("digest", good.alias("payload")), "digest", "left")
    own = own.select("key", "digest", "header", F.coalesce("payload", F.raise_error(F.lit("a payload is missing")).cast("binary")).alias("payload"))
    end = F.lit(END.encode())
    return own.select("key", F.concat("header", "payload", end).alias("record")).unionByName(headers.where("revisit").select("key", F.concat("header", end).alias("record")))


def parse(records: DataFrame) -> DataFrame:
    """Fields of records: type, ids, target, digest, page id, and the payload that the record itself holds.

    Lengths are taken from Content-Length; a payload whose SHA-1 differs from the header's raises an error.
    """
    head = F.substring_index(F.col("record").cast("string"), END, 1)
    field = lambda name: F.nullif(F.regexp_extract(F.col("head"), rf"(?i)\r\n{name}: *([^\r]*)", 1), F.lit(""))
    out = records.withColumn("head", head)
    out = out.withColumn("length", field("Content-Length").cast("long"))
    out = out.withColumn("block", F.expr("substring(record, cast(octet_length(head) + 5 as int), cast(length as int))"))
    out = out.withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    out = out.select(
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Refers-To").alias("refers_to_record"),
        field("X-Page-ID").alias("page_id"),
        F.expr("substring(block, cast(octet_length(http) + 5 as int))").alias("payload"),
    )
    same = (F.col("record_type") != "response") | (base32_sha1(F.col("payload")) == F.col("payload_digest"))
    return out.withColumn("payload", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its record's digest")).cast("binary")))


def captures(parsed: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type and the page that a revisit refers to."""
    narrow = parsed.select("record_type", "record_id", "page_id", "payload_digest", "refers_to_record", F.octet_length("payload").cast("long").alias("size"))
    narrow, _ = common.written(narrow, "parsed")
    named = narrow.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("first"), F.first("size").alias("first_size"))
    # written, so that the revisits of a hot payload are dealt to several tasks when they meet their response
    named, _ = common.written(named.withColumnRenamed("record_id", "refers_to_record"), "responses")
    found = narrow.where("record_type = 'revisit'").join(named, "refers_to_record", "left")
    sizes = F.coalesce("first_size", F.raise_error(F.lit("a revisit refers to no response")).cast("long"))
    both = found.select("page_id", sizes.alias("payload_bytes"), "payload_digest", "record_type", F.col("first").alias("refers_to"))
    return both.unionByName(narrow.where("record_type = 'response'").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to")))


def write_files(records: DataFrame, path: str, *, records_per_file: int = 10_000) -> None:
    """Write records to plain WARC files in a folder, by Spark's own writer, so to any file system that it knows."""
    body = F.expr(f"substring(record, 1, octet_length(record) - {len(END)})").cast("string")
    records.select(body.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (record) of the plain WARC files under a path. Files are read whole, so they should be of bounded size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = list(split_records(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, "record binary")


def split_records(content: bytes) -> Iterator[bytes]:
    """Cut a file into records by their Content-Length."""
    at = 0
    while at < len(content):
        end = content.find(END.encode(), at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(b":", 1) for line in content[at:end].split(b"\r\n")[1:])
        length = int(next(v for k, v in fields.items() if k.lower() == b"content-length"))
        stop = end + 4 + length + 4
        if content[stop - 4 : stop] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield content[at:stop]
        at = stop


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
