"""Add, commit, reindex, status: the steps of a workspace, as plans over its tables."""

from __future__ import annotations

import re
import uuid
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.embedding import hash_embedding
from loomwright.functions.paths import BRANCH, base_of, kind_of
from loomwright.operators import links, search, staging
from loomwright.sources.snapshots import Store

#: The version of the term index; tables of another version count as missing.
INDEX_VERSION = 1
BASES = ("code", "docs", "memory")
TIMELINE = "id string, parent_id string, branch string, timestamp timestamp, message string, operations array<struct<type:string,bases:array<string>,source_count:int>>"


class Model(NamedTuple):
    name: str = "hash"
    dimensions: int = 384


def add(files: DataFrame, indexed: DataFrame, pending: DataFrame, branch: str, at: datetime) -> DataFrame:
    """files (path, size, mtime, text) -> new pending rows: what is new or modified, not empty and not staged."""
    changed = staging.changes(files, indexed).filter("change != 'unchanged'")
    rows = files.filter("size > 0").join(changed, "path").select(
        F.sha1(F.concat_ws("\n", F.lit(branch), "path", F.lit(str(at)))).alias("id"),
        F.lit(branch).alias("branch"),
        base_of(F.col("path")).alias("base"),
        kind_of(F.col("path")).alias("kind"),
        F.col("path").alias("uri"),
        F.lit(at).alias("added_at"),
        F.lit("pending").alias("status"),
        F.col("change").alias("change_type"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("string").alias("metadata"),
    )
    return staging.not_staged(rows, pending).select(*pending.columns)


#: What a chunk replaces, and where the rows made of a chunk have its id.
PLACE = ["base", "branch", "file_path"]
KEYS = {"vectors": "id", "postings": "doc_id", "doc_stats": "doc_id"}
META = "model string, dimensions int, index_version int"


def init(store: Store, branch: str, at: datetime) -> str:
    """The first revision of a branch; ValueError where there is one."""
    timeline = store.read("timeline")
    if timeline is not None and not timeline.filter(F.col("branch") == branch).isEmpty():
        raise ValueError(f"branch {branch} is there already")
    revision = str(uuid.uuid4())
    entry = store.spark.createDataFrame([(revision, None, branch, at, "init", [("init", list(BASES), 0)])], TIMELINE)
    store.write({"timeline": entry if timeline is None else timeline.unionByName(entry)})
    return revision


def branch_of(override: str | None, git_head: str | None) -> str:
    """The branch that an own setting names, else the one of version control's HEAD file, else main; a bare commit is HEAD. ValueError for a name that can't be a branch."""
    name = (override or "").strip()
    head = (git_head or "").strip()
    if not name and head.startswith("ref: refs/heads/"):
        name = head.removeprefix("ref: refs/heads/")
    if not name:
        return "HEAD" if re.fullmatch("[0-9a-fA-F]{40}", head) else "main"
    if not re.fullmatch(BRANCH, name):
        raise ValueError(f"{name} can't be the name of a branch")
    return name


def derived(chunks: DataFrame, embed) -> dict[str, DataFrame]:
    """What is made of chunks one by one: vectors and terms."""
    index = search.build_index(chunks, "id", "text")
    vectors = chunks.select("id", embed("text").alias("vector"), "base", "branch", F.col("file_path").alias("path"))
    return {"vectors": vectors, "postings": index.postings.select("term", "doc_id", "tf"), "doc_stats": index.tokens.select("doc_id", "length")}


def graph_tables(chunks: DataFrame) -> dict[str, DataFrame]:
    built = links.sync(chunks.select(F.col("file_path").alias("path"), "base", "text"))
    return {"nodes": built.nodes, "edges": built.edges}


def index_ready(store: Store) -> bool:
    """Whether the term index is there, in this version."""
    meta = store.read("meta")
    row = meta.first() if meta is not None else None
    return row is not None and getattr(row, "index_version", None) == INDEX_VERSION and store.revision("postings") is not None


def chunk_id(*parts: str):
    return F.concat(F.lit("chunk-"), F.lpad(F.lower(F.hex(F.xxhash64(*parts))), 16, "0"))


def commit(store: Store, files: DataFrame, pending: DataFrame, message: str, at: datetime, model: Model | None = None, embed=hash_embedding) -> tuple[str, DataFrame]:
    """Index what is pending: (revision id, pending after the commit). All tables appear together.

    One file is one chunk, and the latest chunk of a path replaces those before it: vectors and
    terms of the others are taken over as they are, only new text is embedded and split. The graph
    is built anew. Files that can't be indexed stay staged as failed, with the reason.
    """
    spark = files.sparkSession
    revision = str(uuid.uuid4())
    staged = pending.filter(F.col("status").isin("pending", "processing")).join(files.select(F.col("path").alias("uri"), "text", "size", "mtime"), "uri", "left")
    checked = staged.withColumn("reason", staging.invalid(F.col("text")))
    lines = F.size(F.split("text", "\n"))
    good = checked.filter("reason is null").select(
        chunk_id("base", "branch", "uri", "text").alias("id"), "base", "branch", F.col("uri").alias("file_path"), F.lit(1).alias("start_line"), lines.alias("end_line"), "text",
        F.lit(at).alias("indexed_at"), F.lit(revision).alias("revision_id"), F.col("id").alias("source_id"), F.col("mtime").alias("indexed_mtime"), F.col("size").alias("indexed_size"),
    )
    good = good.dropDuplicates(PLACE)
    old = store.read("chunks")
    stay = None if old is None else old.join(good.select(*PLACE), PLACE, "left_anti").select(*old.columns)
    whole = good if stay is None else stay.unionByName(good)
    bases = [r.base for r in good.select("base").distinct().orderBy("base").collect()]  # a handful of bases
    n = good.count()
    timeline = store.read("timeline")
    head = timeline.agg(F.max_by("id", "timestamp").alias("id")).first().id if timeline is not None else None
    branch = pending.agg(F.min("branch").alias("b")).first().b
    entry = spark.createDataFrame([(revision, head, branch, at, message, [("commit", bases, n)])], TIMELINE)
    m = model or Model()
    meta = spark.createDataFrame([(m.name, m.dimensions, INDEX_VERSION)], META)
    tables = {"chunks": whole, "meta": meta, "timeline": entry if timeline is None else timeline.unionByName(entry)}
    reuse = stay is not None and index_ready(store)
    for name, new in derived(good if reuse else whole, embed).items():
        if reuse:
            new = store.read(name).join(stay.select(F.col("id").alias(KEYS[name])), KEYS[name], "left_semi").select(*new.columns).unionByName(new)
        tables[name] = new
    store.write(tables | graph_tables(whole))
    after = staging.update_status(pending, checked.select("id", F.when(F.col("reason").isNull(), "indexed").otherwise("failed").alias("status"), F.col("reason").alias("last_error")))
    return revision, staging.clear_indexed(after)


def compatible(store: Store, model: Model) -> str:
    """missing, mismatch or ok."""
    meta = store.read("meta")
    row = meta.first() if meta is not None else None
    return "missing" if row is None else "ok" if (row.model, row.dimensions) == tuple(model) else "mismatch"


def reindex(store: Store, model: Model, embed=hash_embedding, force: bool = False, dry_run: bool = False) -> int:
    """Make vectors, terms and graph of all chunks anew where the model has changed, or by force: the number of chunks."""
    chunks = store.read("chunks")
    if chunks is None or (compatible(store, model) == "ok" and not force):
        return 0
    n = chunks.count()
    if not dry_run:
        meta = chunks.sparkSession.createDataFrame([(*model, INDEX_VERSION)], META)
        store.write({"meta": meta} | derived(chunks, embed) | graph_tables(chunks))
    return n


def base_stats(chunks: DataFrame, vectors: DataFrame, base: str | None = None) -> DataFrame:
    """base, chunks, files, vectors; ValueError for a base that isn't there."""
    if base is not None and chunks.filter(F.col("base") == base).isEmpty():
        raise ValueError(f"there is no base {base}")
    keep = F.lit(True) if base is None else F.col("base") == base
    v = vectors.filter(keep).groupBy("base").agg(F.count(F.lit(1)).alias("vectors"))
    return chunks.filter(keep).groupBy("base").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files")).join(v, "base", "left").fillna(0, ["vectors"])


def totals(stats: DataFrame) -> DataFrame:
    """One row: chunks, files and vectors of all bases together."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "files", "vectors")])


def stored_text(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks (id, file_path, start_line, end_line, text), files (path, text): id, text and error.

    The text that is stored, else that of the file's lines from start to end (the whole file where
    they are no lines of it); a memory without text and a file that is gone are errors.
    """
    now = chunks.join(files.select(F.col("path").alias("file_path"), F.col("text").alias("_file")), "file_path", "left")
    lines = F.split(F.regexp_replace("_file", r"\r?\n$", ""), r"\r?\n")
    inside = (F.col("start_line") > 0) & (F.col("end_line") > 0) & (F.col("start_line") <= F.size(lines))
    part = F.when(inside, F.array_join(F.slice(lines, F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")).otherwise(F.col("_file"))
    memory = F.col("file_path").startswith("memory:")
    text = F.coalesce("text", F.when(~memory, part))
    error = F.when(text.isNull(), F.when(memory, "no stored text").otherwise("file not found"))
    return now.select("id", text.alias("text"), error.alias("error"))


def index_state(stored: dict | None, wanted: dict) -> str:
    """stored, wanted (model, dimensions, backend): missing, model, dimensions, legacy, backend or ok, the first that differs. A store in plain files can be moved to any backend; only to `lancedb` is it worth saying."""
    if stored is None:
        return "missing"
    for key in ("model", "dimensions"):
        if stored[key] != wanted[key]:
            return key
    if stored["backend"] == "simple_file":
        return "legacy" if wanted["backend"] == "lancedb" else "ok"
    return "ok" if stored["backend"] == wanted["backend"] else "backend"
