"""Exact deduplication in three combining stages, all in DataFrame operations.

1. Within a task, rows of one digest and one content become one row (the map side of the first
   aggregation; content is part of the key, so it is compared in full).
2. The tasks' rows meet by (digest, salt, content). The salt is the number of the reading task
   modulo `salts`, so a content that every task holds is spread over `salts` reducers.
3. The salts' winners, at most `salts` for a content, meet by (digest, content).

Cases: a null text counts as empty and all empty texts form a group; a null id never beats a
known one, and a group of null ids only keeps one of its rows; repeated rows: one of those that
hold the largest id is kept; an empty table gives no rows; further columns are ignored here and
never clash, as only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import scratch

SALTS = 32


def exact_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows (id, content) -> one row per content: digest, keep_id, group_size.

    Two contents of one digest would make the digest unfit as a name of the group; the query then
    fails with a message instead of joining wrong rows.
    """
    local = rows.select(F.sha2("content", 256).alias("digest"), "content", "id", (F.spark_partition_id() % salts).alias("salt"))
    salted = local.groupBy("digest", "salt", "content").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    named = whole.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents"))
    return named.select("digest", "keep_id", F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents share a digest")).cast("long")).otherwise(F.col("group_size")).alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str, text_col: str, normalise: Column | None = None, salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    normalise: an expression over text_col to compare instead of the text itself.
    Only groups of two or more travel through the join back; both its sides are plain exchanges,
    so adaptive execution splits the partition of a hot digest.
    """
    content = F.coalesce(normalise if normalise is not None else F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), content.alias("content"))
    groups = scratch.keep(exact_groups(rows, salts).filter("group_size > 1"), "exact-groups")
    named = rows.groupBy("id", F.sha2("content", 256).alias("digest")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    named = named.join(groups, "digest", "left").select("id", "digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), "times")).alias("nth"))
    return named.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        ((F.col("nth") == 1) & (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
