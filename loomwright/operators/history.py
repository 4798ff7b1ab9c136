"""Timeline and logs: filters, views, revision references, releases."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.rules import COMMIT_KINDS


def log_filter(entries: DataFrame, kinds: list[str] | None = None, bases: list[str] | None = None, since: datetime | str | None = None, until: datetime | str | None = None, baseless: bool = True) -> DataFrame:
    """entries (timestamp, kind, bases): kind, any base, since and until inclusive. baseless: entries without bases pass the filter by base."""
    keep = F.lit(True)
    if kinds:
        keep = keep & F.col("kind").isin(kinds)
    if bases:
        hit = F.arrays_overlap("bases", F.array(*map(F.lit, bases)))
        keep = keep & F.coalesce(hit | (F.size("bases") <= 0) if baseless else hit, F.lit(baseless))
    if since is not None:
        keep = keep & (F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        keep = keep & (F.col("timestamp") <= F.lit(until).cast("timestamp"))
    return entries.filter(keep)


def newest(entries: DataFrame, limit: int, tie: str) -> DataFrame:
    return entries.orderBy(F.col("timestamp").desc(), F.col(tie)).limit(limit)


def log_view(timeline: DataFrame) -> DataFrame:
    """A revision's first operation as a log line: kind, its bases and all of it as JSON."""
    op = F.get("operations", F.lit(0))
    bases = F.coalesce(op.bases, F.when(op.base.isNotNull(), F.array(op.base)), F.array().cast("array<string>"))
    return timeline.select("id", "branch", "timestamp", "message", F.coalesce(op.type, F.lit("other")).alias("kind"), bases.alias("bases"), F.to_json(op).alias("meta"))


def enrich(entries: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """entries with the current statistics of their bases, in the bases' order."""
    each = entries.select(key, F.posexplode_outer("bases").alias("pos", "base")).join(stats, "base", "left")
    found = each.filter("base is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "base", *[c for c in stats.columns if c != "base"]))).alias("base_stats"))  # the bases of one entry
    return entries.join(found, key, "left")


def ancestors(timeline: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """start (id) -> root, id, step: parents up to `steps` away. One equi-join a step."""
    up = timeline.select("id", "parent_id")
    front = found = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("step"))
    for s in range(1, steps + 1):
        front = front.join(up, "id").filter("parent_id is not null").select("root", F.col("parent_id").alias("id"), F.lit(s).alias("step"))
        found = found.unionByName(front)
    return found


def resolve_revision(timeline: DataFrame, reference: str) -> str:
    """The id that HEAD, @, HEAD~n, @~n, an id or a prefix of six characters or more stands for. The head is the newest revision; ValueError for no or several."""
    name, _, n = reference.partition("~")
    if name in ("HEAD", "@"):
        head = timeline.agg(F.max(F.struct("timestamp", "id")).alias("t")).first().t
        if head is None:
            raise ValueError("the timeline is empty")
        back = int(n or 1) if "~" in reference else 0
        found = ancestors(timeline, timeline.sparkSession.createDataFrame([(head.id,)], "id string"), back).filter(F.col("step") == back).first()
        if found is None:
            raise ValueError(f"{reference} goes beyond the first revision")
        return found.id
    exact = timeline.filter(F.col("id") == reference).select("id").first()
    if exact:
        return exact.id
    if len(reference) < 6:
        raise ValueError("a prefix needs six characters")
    hits = timeline.filter(F.col("id").startswith(reference)).select("id").distinct().limit(2).collect()
    if len(hits) != 1:
        raise ValueError(f"{len(hits) or 'no'} revisions begin with {reference}")
    return hits[0].id


def parse_commit(message: Column) -> Column:
    """struct(kind, scope, breaking, description) of a conventional commit; whatever isn't one is other, with all of the message."""
    head, tail = F.substring_index(message, ":", 1), F.trim(F.regexp_extract(message, r"(?s)^[^:]*:(.*)$", 1))
    name = F.lower(F.trim(F.regexp_extract(head, r"^\s*([A-Za-z]+)", 1)))
    whole = F.contains(message, F.lit(":")) & (tail != "") & head.rlike(r"^\s*[A-Za-z]+\s*(\([^)]*\))?\s*!?\s*$") & name.isin([k for k in COMMIT_KINDS if k != "other"])
    scope = F.regexp_extract(head, r"\(([^)]*)\)", 1)
    return F.struct(
        F.when(whole, name).otherwise("other").alias("kind"),
        F.when(whole & (scope != ""), scope).alias("scope"),
        (whole & F.trim(head).endswith("!")).alias("breaking"),
        F.when(whole, tail).otherwise(F.trim(message)).alias("description"),
    )


def between(timeline: DataFrame, after: int | None, upto: int | None, order: str) -> DataFrame:
    """Rows whose place in the order of appending is above `after` and at most `upto`."""
    keep = F.lit(True)
    keep = keep & (F.col(order) > after) if after is not None else keep
    return timeline.filter(keep & (F.col(order) <= upto) if upto is not None else keep)


def release_groups(commits: DataFrame, order: str) -> DataFrame:
    """commits (message, order) by kind: kind, place, n, lines in order. A release is a bounded range of revisions."""
    c = parse_commit(F.col("message"))
    line = F.concat(F.when(F.col("c.scope").isNotNull(), F.concat(F.lit("**"), F.col("c.scope"), F.lit("**: "))).otherwise(""), F.col("c.description"))
    place = F.array_position(F.array(*map(F.lit, COMMIT_KINDS)), F.col("c.kind"))
    rows = commits.withColumn("c", c).select(F.col("c.kind").alias("kind"), place.alias("place"), order, line.alias("line"), F.col("c.breaking").alias("breaking"))
    return rows.groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n"), F.count_if("breaking").alias("n_breaking"), F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda s: s.line).alias("lines"))


def render_changelog(groups: DataFrame, title: str) -> str:
    """Markdown of a release: a heading, then its groups in order."""
    out = [f"## {title}", ""]
    for g in groups.orderBy("place").collect():  # at most one row for each kind
        out += [f"### {COMMIT_KINDS[g.kind]}", "", *(f"- {x}" for x in g.lines), ""]
    return "\n".join(out)


def add_release(changelog: str, section: str) -> str:
    """The section before the first one of the changelog; ValueError if its heading is there."""
    heading = section.split("\n", 1)[0]
    lines = changelog.split("\n")
    if heading in lines:
        raise ValueError(f"{heading} is in the changelog")
    at = next((i for i, x in enumerate(lines) if x.startswith("## ")), len(lines))
    return "\n".join([*lines[:at], section, *lines[at:]])


def changelog(existing: str | None, section: str, append: bool) -> str:
    """A changelog of the section alone, or the existing one (else an empty one) with the section in its place."""
    return add_release("# Changelog\n\n" if existing is None else existing, section) if append else section


def last_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
