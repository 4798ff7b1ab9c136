"""Content-addressed WARC archive: payload bytes once, exact record headers apart.

`payloads`: digest (SHA-256), payload, first (the largest record id that has it), verified by
full comparison when written and by recomputed digests when read. `headers`: record id, digest,
the exact header block of each record, the block's head of a response (status line and HTTP
headers) included. A record is header, blank line, block, two line ends; joins bring both back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import scratch

#: RFC 4648 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
#: For tables without a time of capture.
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of 40 hex digits: five of them are four characters."""
    out = []
    for i in range(8):
        part = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(part, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def write_archive(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 0, date: Column | None = None) -> tuple[str, str]:
    """Write one record per row; paths of the payload and header tables.

    Of records with equal payloads of at least `least` bytes the one with the largest id is the
    response and the others revisit it. date: the time of capture as text, EPOCH if there is none.
    Cases: a null payload is empty; a null url is written as urn:unknown; a null id never beats a
    known one, and its record is a response of its own when it has no other; repeated rows of the
    largest id are all responses, and share a record id only if url and payload are equal too;
    line ends within a url are dropped from its header; an empty table gives an empty archive; further columns are not
    read.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("urn:unknown")).alias("url"), (F.lit(None) if date is None else date).cast("string").alias("date"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    store = rows.groupBy("digest", "payload").agg(F.max("id").alias("first"), F.max(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("named")).select("digest", "payload", "first", F.col("named.url").alias("first_url"))
    payloads = scratch.new_path(spark, "warc-payloads")
    store.write.option("compression", "zstd").parquet(payloads)

    scratch.release(spark)

    kept = spark.read.parquet(payloads)
    head = rows.select("id", "url", "date", "digest", F.octet_length("payload").cast("long").alias("bytes"), base32_of_hex(F.sha1("payload")).alias("sha1"))
    first = kept.select("digest", "first", "first_url")
    joined = head.join(first, "digest", "left")
    revisit = (F.col("bytes") >= least) & (F.col("first") != F.col("id"))
    revisit = F.coalesce(revisit, F.col("id").isNull() & F.col("first").isNotNull() & (F.col("bytes") >= least))
    name = lambda c, url: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.lower(F.hex(F.xxhash64(url, "digest"))), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes"), F.lit(EOL + EOL))
    http = F.when(revisit, F.lit(f"HTTP/1.1 200 OK{EOL}{EOL}")).otherwise(http)
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"), "url")),
        F.concat(F.lit("WARC-Date: "), F.coalesce(F.regexp_replace("date", r"[\r\n]", ""), F.lit(EPOCH))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first"), "first_url"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), length),
    ]
    headers = scratch.new_path(spark, "warc-headers")
    joined.select("id", "digest", F.concat_ws(EOL, *lines, F.lit(""), F.lit("")).alias("header"), http.alias("block_head")).write.option("compression", "zstd").parquet(headers)
    return payloads, headers


def read_archive(spark: SparkSession, payloads: str, headers: str) -> DataFrame:
    """Records brought back from both tables: id, header, block_head, payload, and what the header says.

    A stored payload whose SHA-256 isn't its name, or one whose SHA-1 isn't what a header says,
    fails the read. payload_bytes and payload_digest are those of the record's payload.
    """
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't have its digest")).cast("binary"))
    stored = spark.read.parquet(payloads).select("digest", good.alias("payload"))
    told = lambda field: F.regexp_extract("header", rf"(?:^|\r\n){field}: ([^\r\n]*)", 1)
    heads = spark.read.parquet(headers).select("id", "digest", "header", "block_head", told("WARC-Type").alias("record_type"), F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)", 1).alias("told_sha1"), F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d+):", 1).alias("refers"), told("WARC-Target-URI").alias("url"))
    found = heads.join(stored, "digest").withColumn("sha1", base32_of_hex(F.sha1("payload")))
    same = F.when(F.col("told_sha1") == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("a header names another payload")))
    return found.select("id", "url", "header", "block_head", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), same.alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", F.col("refers").cast("long")).alias("refers_to"))


def records(archive: DataFrame) -> DataFrame:
    """archive and the original record bytes, record. A revisit's block has no payload."""
    block = F.when(F.col("record_type") == "response", F.concat(F.encode("block_head", "UTF-8"), "payload")).otherwise(F.encode("block_head", "UTF-8"))
    return archive.withColumn("record", F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(EOL * 2), "UTF-8")))


def contents(written: DataFrame) -> DataFrame:
    """What the bytes of each record say: id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is cut out of its record, by the lengths that its header and the head of
    its block have; a revisit's is that of the record it refers to, which the archive has joined to
    it. A record whose block isn't as long as its header says fails.
    """
    length = F.regexp_extract("header", r"\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("int")
    whole = F.octet_length("record") == F.octet_length("header") + length + len(EOL * 2)
    own = F.expr("substring(record, octet_length(header) + octet_length(block_head) + 1, octet_length(record) - octet_length(header) - octet_length(block_head) - 4)")
    payload = F.when(~whole, F.raise_error(F.lit("a record isn't as long as its header says")).cast("binary")).when(F.col("record_type") == "response", own).otherwise(F.col("payload"))
    found = written.select("id", payload.alias("payload"), "payload_digest", "record_type", "refers_to")
    return found.select("id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to")
