"""Memory entries: metrics and pruning by policy."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import estimated_tokens


class Policy(NamedTuple):
    obsolete_tags: list[str] | None = None
    #: Entries older than this many days before `now` go.
    max_age_days: int | None = None
    max_entries: int | None = None
    max_tokens: int | None = None


def embeddable(title, text):
    """Title, blank line, text; the text alone without a title."""
    return F.when(title.isNotNull() & (F.trim(title) != ""), F.concat(title, F.lit("\n\n"), text)).otherwise(text)


def metrics(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.sum(estimated_tokens(F.col("text"))).alias("tokens"))


def visible(entries: DataFrame, branch: str) -> DataFrame:
    """Entries of project and global scope, and those of the branch."""
    return entries.filter(F.col("scope").isin("project", "global") | (F.col("branch") == branch))


def mark_pruned(entries: DataFrame, policy: Policy, key: str, order: str, now=None) -> DataFrame:
    """entries (text, tags, created_at) and `reason`: why a row goes, or null.

    The rules go in order, each over the rows that those before left: obsolete tag, age, number
    of entries, tokens; the last two take the oldest of each key first, by `order`.
    """
    reason = F.lit(None).cast("string")
    if policy.obsolete_tags:
        reason = F.when(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, policy.obsolete_tags))), F.lit(False)), "tag").otherwise(reason)
    if policy.max_age_days is not None:
        old = F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {policy.max_age_days} days")
        reason = F.coalesce(reason, F.when(old, "age"))
    out = entries.withColumn("reason", reason)
    # rows that still stand come in a window of their own
    standing = lambda: Window.partitionBy(key, F.col("reason").isNull()).orderBy(F.col(order).desc())
    if policy.max_entries is not None:
        n = F.row_number().over(standing())
        out = out.withColumn("_n", n).withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > policy.max_entries, "entries"))).drop("_n")
    if policy.max_tokens is not None:
        # the oldest go until what is left fits: a row goes if it and all newer ones are too many
        total = F.sum(estimated_tokens(F.col("text"))).over(standing().rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_t", total).withColumn("reason", F.coalesce("reason", F.when(F.col("_t") > policy.max_tokens, "tokens"))).drop("_t")
    return out


def prune(entries: DataFrame, policy: Policy, key: str, order: str, now=None) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned)."""
    marked = mark_pruned(entries, policy, key, order, now)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
