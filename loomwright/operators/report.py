"""What a workspace tells of itself: status, bases, one revision, sizes, lists of its inventory."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import graph, history, staging
from loomwright.operators.workspace import BASES, base_stats, totals
from loomwright.sources.snapshots import Store

MAX_SOURCES, MAX_MEMORIES, SUMMARY = 20, 10, 60


class Status(NamedTuple):
    initialized: bool
    #: The newest revision of the branch.
    head: str | None = None
    #: pending, indexed, failed
    staging: DataFrame | None = None
    #: base, chunks, files, vectors
    bases: DataFrame | None = None
    #: path, change: staged
    staged: DataFrame | None = None
    #: path: changed since it was indexed, and not staged
    modified: DataFrame | None = None
    clean: bool | None = None


def working_tree(files: DataFrame, indexed: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(staged: path and change, modified: path). Files (path, size, mtime) that aren't there any more are no modification."""
    staged = pending.filter("status = 'pending'").select(F.col("uri").alias("path"), F.coalesce("change_type", F.lit("new")).alias("change"))
    modified = staging.changes(files, indexed).filter("change = 'modified'").select("path").join(staged.select("path").distinct(), "path", "left_anti")
    return staged, modified


def head_of(timeline: DataFrame | None, branch: str) -> str | None:
    if timeline is None:
        return None
    return timeline.filter(F.col("branch") == branch).agg(F.max(F.struct("timestamp", "id")).alias("t")).select("t.id").first().id


def status(store: Store, branch: str, files: DataFrame, pending: DataFrame) -> Status:
    head = head_of(store.read("timeline"), branch)
    if head is None:
        return Status(False)
    own = pending.filter(F.col("branch") == branch)
    chunks, vectors = store.read("chunks"), store.read("vectors")
    known = files.sparkSession.createDataFrame([], "path string, size long, mtime long")
    if chunks is not None:
        chunks = chunks.filter(F.col("branch") == branch)
        known = chunks.select(F.col("file_path").alias("path"), F.col("indexed_size").alias("size"), F.col("indexed_mtime").alias("mtime"))
    staged, modified = working_tree(files, known, own)
    bases = base_stats(chunks, vectors.filter(F.col("branch") == branch)) if chunks is not None else None
    return Status(True, head, staging.summary(own, []), bases, staged, modified, staged.isEmpty() and modified.isEmpty())


def bases(store: Store, branch: str) -> list[str]:
    """Bases with chunks, in their fixed order."""
    chunks = store.read("chunks")
    if chunks is None:
        return []
    there = {r.base for r in chunks.filter((F.col("branch") == branch) & F.col("base").isin(*BASES)).select("base").distinct().collect()}  # at most three
    return [b for b in BASES if b in there]


def stats(store: Store, branch: str, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(by base, totals); ValueError for a base that isn't there."""
    by_base = base_stats(*(store.read(t).filter(F.col("branch") == branch) for t in ("chunks", "vectors")), base)
    return by_base, totals(by_base)


def bytes_on_disk(spark: SparkSession, folder: str, names: tuple[str, ...] = ("sources.jsonl", "stats.json", "model-info.json"), index: str = "index") -> int:
    """Bytes of some files in a folder and of all files, not folders, directly below its `index`; what isn't there counts nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    total = sum(system.getFileStatus(path(folder, n)).getLen() for n in names if system.exists(path(folder, n)))
    below = path(folder, index)
    return total + (sum(f.getLen() for f in system.listStatus(below) if f.isFile()) if system.exists(below) else 0)


class Shown(NamedTuple):
    id: str
    #: pos, type, bases, source_count
    operations: DataFrame
    #: base, sources_added
    impact: DataFrame
    #: base, path: the first of the revision's sources
    sources: DataFrame
    #: id, summary: the first of its memories
    memories: DataFrame
    #: kind, n: the graph as it is now
    graph: DataFrame | None


def samples(chunks: DataFrame, revision: str, max_sources: int = MAX_SOURCES, max_memories: int = MAX_MEMORIES) -> tuple[DataFrame, DataFrame]:
    """(base, path), (id, summary) of the first chunks of a revision: bases in their order, then paths. A memory is told by its title, else by the start of its text."""
    own = chunks.filter(F.col("revision_id") == revision)
    place = F.array_position(F.array(*map(F.lit, BASES)), F.col("base"))
    path = F.when(F.col("base") == "memory", F.regexp_replace("file_path", "^memory://", "")).otherwise(F.col("file_path"))
    sources = own.select("base", path.alias("path"), place.alias("_b")).orderBy("_b", "path").limit(max_sources).drop("_b")
    title = F.get_json_object("extra", "$.title") if "extra" in chunks.columns else F.lit(None).cast("string")
    short = F.when(F.length("text") <= SUMMARY, F.col("text")).otherwise(F.concat(F.substring("text", 1, SUMMARY - 3), F.lit("...")))
    memories = own.filter("base = 'memory'").select("id", F.coalesce(title, short, "file_path").alias("summary"), "file_path").orderBy("file_path", "id").limit(max_memories).drop("file_path")
    return sources, memories


def impact(timeline: DataFrame) -> DataFrame:
    """timeline (id, operations) -> id, base, sources_added: of every revision and base that it commits to; the last commit counts."""
    each = timeline.select("id", F.posexplode("operations").alias("pos", "o")).filter("o.type = 'commit'")
    per = each.select("id", "pos", F.explode("o.bases").alias("base"), F.col("o.source_count").alias("n"))
    return per.groupBy("id", "base").agg(F.max_by("n", "pos").alias("sources_added"))


def show(store: Store, reference: str = "HEAD", max_sources: int = MAX_SOURCES, max_memories: int = MAX_MEMORIES) -> Shown:
    """One revision; ValueError where the reference names none."""
    timeline = store.read("timeline")
    if timeline is None:
        raise ValueError("the workspace has no revision")
    revision = history.resolve_revision(timeline, reference)
    own = timeline.filter(F.col("id") == revision)
    chunks = store.read("chunks")
    none = store.spark.createDataFrame
    sources, memories = samples(chunks, revision, max_sources, max_memories) if chunks is not None else (none([], "base string, path string"), none([], "id string, summary string"))
    nodes, edges = store.read("nodes"), store.read("edges")
    counted = graph.counts(nodes, edges) if nodes is not None and edges is not None else None
    return Shown(revision, own.select(F.posexplode("operations").alias("pos", "o")).select("pos", "o.*"), impact(own).drop("id"), sources, memories, counted)


def write_inventory(root: str, files: DataFrame, deps: DataFrame, tech: DataFrame) -> None:
    """The inventory as JSON lines below a folder: files, dependencies, technologies, in the order of an inventory, and its numbers."""
    keys = {"files": ["path"], "dependencies": ["manager", "name"], "tech": ["kind", "name"]}
    for name, rows in (("files", files), ("dependencies", deps), ("tech", tech)):
        rows.orderBy(*keys[name]).write.mode("overwrite").json(f"{root}/{name}")
    counted = files.select(F.lit(1).alias("n"), F.lit(None).cast("string").alias("manager")).unionByName(deps.select(F.lit(0).alias("n"), "manager"))
    counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.array_sort(F.collect_set("manager")).alias("managers")).write.mode("overwrite").json(f"{root}/stats")  # managers are a handful


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("total_files long, managers array<string>").json(f"{root}/stats")
