"""WARC records in a content-addressed archive.

An archive is two tables. `headers` has a row for each record: its exact header bytes and the SHA-256 of its payload. `payloads` has the bytes of every
different payload once, under that digest, which is verified when they are read: bytes that no longer have their digest raise an error.
Joining the two gives back every record byte for byte. Of records with equal payloads of at least `least` bytes, that with the largest id is the
response and the others revisit it; smaller payloads are stored once as well, but all their records are responses.

Which record is which is decided on digests alone (partial aggregation, then a salted join of narrow rows), so a payload that a third of all records
share is no hot group; payload bytes are shuffled once, by record id, to reach the one record that brings them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import salted_join, stored

LEAST_REVISIT = 1000
CRLF = "\r\n"
END = b"\r\n\r\n"


def records(pages: DataFrame, record_id: str, uri: str, payload: str, least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(id, digest, size, response, header) of every row: what a WARC file says about it, without the payload.

    Null payloads are empty. Rows with a null id are responses of their own and never referred to; of rows with equal id and payload each stays.
    Line breaks in a uri are taken out, as they would end the header line.
    """
    bytes_ = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(record_id).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(uri).cast("string"), F.lit("")), r"[\r\n]+", "").alias("uri"), F.sha2(bytes_, 256).alias("digest"), F.sha1(bytes_).alias("sha1"), F.octet_length(bytes_).cast("long").alias("size"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1 AND response IS NOT NULL").drop("n")
    marked = salted_join(rows, groups, ["digest"], "id", "left")
    is_revisit = F.col("response").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("response"))
    return marked.select("id", "digest", "size", F.when(is_revisit, F.col("response")).alias("response"), _header(is_revisit, date).alias("header"))


def _header(is_revisit: Column, date: str) -> Column:
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("id")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn("response"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(is_revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)).cast("binary")


def write(pages: DataFrame, record_id: str, uri: str, payload: str, out: str, least: int = LEAST_REVISIT) -> None:
    """Write the archive of all rows below `out`."""
    found = stored(records(pages, record_id, uri, payload, least), "warc-records")
    found.select("id", "digest", "header").write.mode("overwrite").parquet(f"{out}/headers")
    bytes_ = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    # who brings the bytes: of each digest the record with the largest id; ids are spread evenly, digests may not be
    bringers = found.groupBy("digest").agg(F.max("id").alias("id")).filter("id IS NOT NULL")
    bodies = pages.select(F.col(record_id).cast("long").alias("id"), bytes_.alias("payload"))
    brought = bodies.join(bringers, "id").filter(F.sha2("payload", 256) == F.col("digest")).select("digest", "payload")
    # ids that repeat can bring the same bytes twice, and missing ids bring none
    if not found.filter("id IS NULL").isEmpty():
        brought = brought.union(bodies.filter("id IS NULL").withColumn("digest", F.sha2("payload", 256)).join(bringers, "digest", "left_anti").select("digest", "payload")).dropDuplicates(["digest"])
    elif not found.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        brought = brought.dropDuplicates(["digest"])
    brought.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/payloads")


def payloads(spark: SparkSession, out: str) -> DataFrame:
    """(digest, payload) of an archive; a payload that does not have its digest raises an error."""
    broken = F.raise_error(F.concat(F.lit("payload does not have its digest "), F.col("digest")))
    return spark.read.parquet(f"{out}/payloads").select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(broken.cast("binary")).alias("payload"))


def read(spark: SparkSession, out: str, **of_payload: Column) -> DataFrame:
    """Records of an archive: id, type, refers_to, digest, header, and `of_payload`, columns over `payload` that are worked out on the payload's side of
    the join, so that the bytes themselves are only shuffled if asked for (payload=F.col("payload"))."""
    headers = spark.read.parquet(f"{out}/headers")
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)", 1)
    parsed = headers.select("id", "digest", "header", field("WARC-Type").alias("type"), F.expr("try_cast(regexp_extract(CAST(header AS STRING), '\\r\\nWARC-Refers-To: <urn:record:(-?[0-9]+)>', 1) AS BIGINT)").alias("refers_to"))
    bodies = payloads(spark, out).select("digest", *[c.alias(name) for name, c in of_payload.items()])
    return salted_join(parsed, bodies, ["digest"], "id")


def reconstruct(spark: SparkSession, out: str) -> DataFrame:
    """(id, record): every record as in a WARC file; a revisit has no payload of its own."""
    both = read(spark, out, payload=F.col("payload"))
    body = F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select("id", F.concat("header", body, F.lit(END)).alias("record"))
