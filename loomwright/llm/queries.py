"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, decontaminate, exact_dedup, jaccard, licenses, quality, secret_scan, shards, toxicity, warc


#: The public vocabulary file; every worker has it there.
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", keep=["doc_id"])
    found = F.array_join(F.transform("licenses", lambda x: x.license), ",")
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), found.alias("licenses"), F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x.dice)), F.lit(0.0)), 6).alias("best_dice"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.secret_scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")
    of = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long")
    return found.select("doc_id", *[of(r.name).alias(f"n_{r.name}") for r in secret_scan.RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(*toxicity.sample(docs, "doc_id", "text", labels, "doc_id", "toxic", held_out=HELD_OUT))
    out = toxicity.score(docs, "text", model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    metadata = [F.col("n_chars"), shards.text_place(F.col("source")), shards.text_place(F.col("lang")), F.col("doc_id")]
    out = shards.shard_documents(docs, "doc_id", "text", metadata)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, "text", VOCABULARY, keep=["doc_id"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.read_archive(spark, *warc.write_archive(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return warc.contents(warc.records(archive)).withColumnRenamed("id", "page_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(*toxicity.sample(docs, "doc_id", "text", labels, "doc_id", "quality", held_out=HELD_OUT))
    out = quality.score(docs, "text", model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.link_sets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_license_scan, op3_secret_scan, op4_toxicity, op5_sharding, op6_bpe, op7_warc, op8_exact_dedup, op9_quality, op10_ngram_jaccard)
}
