"""WARC archives with revisit records, written and read by Spark's own text source.

Headers (id, digest, size) are grouped by payload digest, pre-aggregated, to find each
original response; a record whose payload another one holds becomes a revisit record.
Archives are Spark text files whose lines end in two CRLF, as WARC records do, so the
writer's commit protocol makes them whole even if executors are lost, and any store
that Spark reaches will do. Reading splits at the next record's version line, so no
task holds a whole archive. A payload that holds such a version line itself is stored
in base64, so that every payload is read back byte for byte.

Defined results: a null payload counts as empty, a null url has no target header; rows
that repeat the original's id and payload are responses too; a null id is never the
original if its copies have ids; other columns are ignored; no pages give no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

CRLF = "\r\n"
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """``id, url, payload, digest, original``: the smallest id with an equal payload of at
    least ``min_bytes``, for all but that one; else null."""
    src = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    src = src.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = src.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("original"))
    found = src.join(first, "digest", "left")
    return found.select("id", "url", "payload", "digest", F.when(F.col("id").isNull() | (F.col("id") != F.col("original")), F.col("original")).alias("original"))


def write(resolved: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write a record for each row of ``resolve`` to the folder ``path``."""
    c = F.col
    revisit = c("original").isNotNull()
    embedded = c("payload").contains(CRLF * 2 + _VERSION) | c("payload").startswith(_VERSION)
    body = F.when(revisit, F.lit("")).when(embedded, F.base64(c("payload").cast("binary"))).otherwise(c("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), F.when(embedded & ~revisit, F.lit(f"Content-Transfer-Encoding: base64{CRLF}")).otherwise(F.lit("")), F.lit(f"Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    lines = [
        F.lit(_VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(c("id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), c("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), c("original").cast("string"), F.lit(">")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http, body)
    resolved.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The records below ``path``: ``id, url, type, digest, refers_to, payload``; a revisit
    has the digest that its header names and a null payload, a response the digest of
    the payload that was read."""
    text = spark.read.option("lineSep", f"{CRLF * 2}{_VERSION}{CRLF}").text(path)
    # WARC header, HTTP header, body; the last record of an archive ends with its own two CRLF
    rows = text.select(F.split("value", CRLF * 2, 3).alias("part")).where(F.size("part") == 3)
    rows = rows.select(F.col("part")[0].alias("head"), F.col("part")[1].alias("http"), F.col("part")[2].cast("binary").alias("rest"))
    rows = rows.withColumn("body", F.substring("rest", F.lit(1), F.regexp_extract("http", r"\r\nContent-Length: ([0-9]+)$", 1).cast("int")))
    number = lambda name: F.nullif(F.regexp_extract(F.coalesce(_header(name), F.lit("")), "<urn:page:([^>]*)>", 1), F.lit("")).cast(id_type)
    out = rows.select(number("WARC-Record-ID").alias("id"), _header("WARC-Target-URI").alias("url"), _header("WARC-Type").alias("type"), F.regexp_extract(F.coalesce(_header("WARC-Payload-Digest"), F.lit("")), "sha256:(.*)", 1).alias("named"), number("WARC-Refers-To").alias("refers_to"), F.contains("http", F.lit("Content-Transfer-Encoding: base64")).alias("encoded"), "body")
    payload = F.when(F.col("type") == "response", F.when(F.col("encoded"), F.unbase64(F.col("body").cast("string"))).otherwise(F.col("body")))
    out = out.select("id", "url", "type", "named", "refers_to", payload.alias("payload"))
    return out.select("id", "url", "type", F.coalesce(F.sha2("payload", 256), "named").alias("digest"), "refers_to", "payload")


def summary(records: DataFrame) -> DataFrame:
    """Per record ``id, type, digest, refers_to, payload_bytes``: a revisit's size is that of
    the original response, joined by id."""
    slim = core.stage(records.select("id", "type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    sizes = slim.where("type = 'response'").groupBy(F.col("id").alias("refers_to"), "digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    revisit = slim.where("type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "digest"], "left")
    return slim.where("type = 'response'").unionByName(revisit)
