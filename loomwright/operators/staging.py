"""Staged sources: what changed, what is staged twice, validation, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKING = ("pending", "processing", "failed")
MAX_BYTES, MAX_LINES = 1_000_000, 10_000


def changes(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """files, indexed (path, size, mtime): path and change: new, unchanged or modified. What isn't known counts as equal."""
    old = indexed.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_known"))
    same = F.coalesce(F.col("size") == F.col("_size"), F.lit(True)) & F.coalesce(F.col("mtime") == F.col("_mtime"), F.lit(True))
    return files.join(old, "path", "left").select("path", F.when(F.col("_known").isNull(), "new").when(same, "unchanged").otherwise("modified").alias("change"))


def not_staged(fresh: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows whose (branch, base, uri) isn't staged or failed already."""
    return fresh.join(pending.filter(F.col("status").isin(*BLOCKING)).select("branch", "base", "uri").distinct(), ["branch", "base", "uri"], "left_anti")


def summary(pending: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers by status; what is being processed still counts as pending."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return pending.groupBy(*keys).agg(n("pending", "processing").alias("pending"), n("indexed").alias("indexed"), n("failed").alias("failed"))


def by_base(pending: DataFrame) -> DataFrame:
    return pending.filter(F.col("status").isin("pending", "processing")).groupBy("base").agg(F.count(F.lit(1)).alias("pending"))


def update_status(pending: DataFrame, updates: DataFrame) -> DataFrame:
    """pending with the status and last_error of updates (id, status, last_error), where there are any."""
    new = updates.select("id", F.col("status").alias("_status"), F.col("last_error").alias("_error"))
    joined = pending.join(new, "id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).withColumn("last_error", F.when(F.col("_status").isNotNull(), F.col("_error")).otherwise(F.col("last_error"))).drop("_status", "_error").select(*pending.columns)


def unstage(pending: DataFrame, gone: DataFrame) -> DataFrame:
    return pending.join(gone.select("branch", "base", "uri").distinct(), ["branch", "base", "uri"], "left_anti").select(*pending.columns)


def clear_indexed(pending: DataFrame) -> DataFrame:
    """Without what is indexed; failed sources stay."""
    return pending.filter("status != 'indexed'")


def invalid(text: Column, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> Column:
    """Why a source can't be indexed, or null."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(text.isNull(), "unreadable").when(F.octet_length(text) > max_bytes, "too large").when(lines > max_lines, "too many lines").when(F.trim(text) == "", "empty")


def health(bases: DataFrame) -> DataFrame:
    """bases (base, chunks, vectors, model, wanted_model, dim, wanted_dim): state, the first rule that fits."""
    state = (
        F.when(F.col("chunks").isNull(), "ERROR")
        .when(F.col("vectors").isNull() | ((F.col("vectors") == 0) & (F.col("chunks") > 0)), "INDEX_MISSING")
        .when(F.col("model").isNull(), "MISSING_MODEL")
        .when((F.col("model") != F.col("wanted_model")) | (F.col("dim") != F.col("wanted_dim")), "NEEDS_REINDEX")
        .otherwise("OK")
    )
    return bases.select("base", state.alias("state"))
