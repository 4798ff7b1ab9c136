"""From raw documents to tokens: toxicity, exact and near copies, benchmark passages, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. A stage works on all rows that came in; all but the last return
the columns of documents, whatever further ones these have.

Cases: null and empty texts are clean, each other's copies, and no near copies; rows of null
doc_id are documents like any other, but no near copies; decisions go by row, told apart by
doc_id and text, and of rows that are equal in both one stays; an empty table passes as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import arrow, bpe, decontaminate, exact_dedup, jaccard, scratch, toxicity
from loomwright.llm.queries import HELD_OUT, VOCABULARY, table

#: Texts that score this much are rejected.
TOXIC = 0.3


def without(docs: DataFrame, marked: DataFrame, key: Column) -> DataFrame:
    """docs but for the rows that `marked` (doc_id, key, stays) says go; key: the same of docs. Of rows equal in doc_id and key, one stays."""
    fate = marked.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    fate = scratch.keep(fate.filter("not stays or times > 1").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "stays"), "pipeline-fate")
    same = docs["doc_id"].eqNullSafe(fate["_doc"]) & (key == fate["_key"])
    left = docs.join(fate, same, "left_anti").select(*docs.columns)
    repeated = fate.filter("stays")
    if repeated.isEmpty():
        return left
    name = arrow.fresh(docs, "_key")
    again = docs.withColumn(name, key).join(repeated.select(F.col("_doc").alias("_d"), F.col("_key").alias("_k")), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col(name) == F.col("_k")), "left_semi")
    return left.unionByName(again.dropDuplicates(["doc_id", name]).select(*docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from the labelled ones among docs outside the held-out quarter."""
    model = toxicity.train(*toxicity.sample(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "toxic", held_out=HELD_OUT))
    name = arrow.fresh(docs, "score")
    return toxicity.score(docs, "text", model).filter(F.col(name) < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null and empty texts are equal."""
    groups = exact_dedup.exact_dedup(docs.select("doc_id", "text"), "doc_id", "text")
    return without(docs, groups.select("doc_id", F.col("text_sha256").alias("key"), F.col("kept").alias("stays")), F.sha2(F.coalesce("text", F.lit("")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links join, the row with the least doc_id (of several texts of that id, one)."""
    linked = jaccard.link_sets(docs.select("doc_id", "text"), "doc_id", "text")
    rows = scratch.keep(linked.select("doc_id", F.col("text_hash").alias("key"), "text_group"), "pipeline-linked")
    first = rows.filter("text_group is not null").groupBy("text_group").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    return without(docs, rows.join(first, "text_group", "left").select("doc_id", "key", F.coalesce(F.struct("doc_id", "key") == F.col("first"), F.lit(True)).alias("stays")), F.xxhash64("text"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and digests of its ids and of the text decoded from them."""
    return bpe.round_trip(docs, "text", VOCABULARY, keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Training and encoding aren't SQL; tests/llm holds the pipeline against plain versions of its stages.
ORACLE_SQL = None
