"""A batch of questions against all bases: search, prefilter, rerank, overlap, summary, graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators import chunks as C
from loomwright.operators import graph as G
from loomwright.operators import search as S
from loomwright.operators.exhaustive import Found

RAG_BASES = ("code", "docs", "memory")


class Settings(NamedTuple):
    #: The bases that are searched.
    bases: tuple[str, ...] = RAG_BASES
    #: On: nearest vectors only.
    dense_only: bool = False
    #: Bases whose term index is missing: nearest vectors only.
    without_terms: tuple[str, ...] = ()
    top_k: int = 8
    candidates: int = 50
    #: Off: hits keep their fused order, all of them.
    rerank: bool = True
    rerank_from: int = C.RERANK_FROM
    final_k: int = C.RERANK_TO
    min_score: float | None = None
    max_subgraphs: int = 3
    max_hops: int = G.MAX_HOPS
    max_nodes: int = G.MAX_NODES


class Answer(NamedTuple):
    #: qid, id, base, path, start, end, snippet, score, rank
    chunks: DataFrame
    #: qid, base, n
    counts: DataFrame
    #: qid, languages, files, chunks
    stack: DataFrame
    #: qid, root, node, hop
    graph: DataFrame


def ask(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, settings: Settings | None = None) -> Answer:
    """questions (qid, question, vector), chunks (id, base, path, start, end, text), vectors (id, vector), nodes (id, kind, path), edges.

    Each base is searched on its own, dense and sparse together; hits of all bases go through
    one order. Steps: rank, prefilter by named files, rerank, least score, overlaps, summary,
    graph around the hits' files. All questions go through one plan.
    """
    s = settings or Settings()
    asked = questions.select("qid", F.col("question").alias("text"), "vector")
    found = None
    for base in s.bases:
        own = chunks.filter(F.col("base") == base)
        mine = vectors.join(own.select("id"), "id", "left_semi")
        if s.dense_only or base in s.without_terms:
            hit = S.knn(mine, asked, s.top_k).select("qid", "id", (F.col("score") / 30.5).alias("score"))
        else:
            hit = S.hybrid(S.build_index(own, "id", "text"), mine, asked, s.top_k, s.candidates).select("qid", F.col("doc_id").alias("id"), "score")
        found = hit if found is None else found.unionByName(hit)
    full = chunks.select("id", "base", "path", "start", "end", F.col("text").alias("snippet"))
    # fused scores are at most 1 / (k + 1): brought to 0 .. 0.5, the range of dense ones
    hits = found.join(full, "id").join(questions.select("qid", "question"), "qid").withColumn("score", F.col("score") * 30.5)
    columns = ["qid", "id", "question", "path", "base", "snippet", "start", "end", "score"]
    hits = C.add_named_files(hits.select(*columns), full, questions.select("qid", "question"))
    if s.rerank:
        hits = C.rerank(hits, first=s.rerank_from, final=s.final_k).withColumn("score", F.col("final_score")).select(*columns)
    if s.min_score is not None:
        hits = hits.filter(F.col("score") >= s.min_score)
    hits = C.drop_overlaps(hits, ["qid", "path"])
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")))
    from loomwright.functions.paths import language_of

    stack = ranked.groupBy("qid").agg(F.array_sort(F.collect_set(language_of(F.col("path")))).alias("languages"), F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"))
    roots = ranked.join(nodes.filter(F.col("kind").isin("file", "doc")).select(F.col("id").alias("node"), "path"), "path").groupBy("qid", "node").agg(F.min("rank").alias("rank"))
    first = roots.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "node"))).filter(F.col("_n") <= s.max_subgraphs)
    near = G.bounded(edges, first.select(F.col("node").alias("id")).distinct(), s.max_hops, s.max_nodes)
    around = first.select("qid", F.col("node").alias("root")).join(near, "root").select("qid", "root", "node", "hop")
    return Answer(ranked, ranked.groupBy("qid", "base").agg(F.count(F.lit(1)).alias("n")), stack, around)


def askable(vectors: DataFrame, requested: list[str] | None = None) -> tuple[str, ...]:
    """The bases asked for that have vectors, in the order asked for; without a wish, the known bases in their order."""
    there = {r.base for r in vectors.select("base").distinct().collect()}  # a handful
    return tuple(b for b in (RAG_BASES if requested is None else requested) if b in there)


def memories(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, top_k: int = 8) -> DataFrame:
    """questions (qid, text, vector), chunks (id, base, text, extra as JSON), vectors (id, vector) -> the nearest memories of each question.

    Nearest vectors alone, without rerank or least score. An entry whose JSON has no memory_id is
    left out after the search; scope is `project` and source `agent` where they aren't said.
    """
    own = chunks.filter("base = 'memory'")
    hits = S.knn(vectors.join(own.select("id"), "id", "left_semi"), questions, top_k)
    said = lambda k, other=None: F.coalesce(F.get_json_object("extra", f"$.{k}"), F.lit(other)).alias(k.removeprefix("memory_"))
    rows = hits.select("qid", "id", "score").join(own.select("id", "text", "extra"), "id")
    tags = F.coalesce(F.from_json(F.get_json_object("extra", "$.tags"), "array<string>"), F.array().cast("array<string>")).alias("tags")
    out = rows.select("qid", F.get_json_object("extra", "$.memory_id").alias("memory"), said("memory_scope", "project"), said("memory_source", "agent"), said("title", ""), F.coalesce("text", F.lit("")).alias("text"), F.try_to_timestamp(F.get_json_object("extra", "$.created_at")).alias("created_at"), tags, "score")
    return out.filter("memory is not null")


def graph_context(answer: Answer, found: Found) -> DataFrame:
    """qid, node: what the walks around the hits and the answer from the graph hold together."""
    return answer.graph.select("qid", "node").unionByName(found.nodes.select("qid", F.col("id").alias("node"))).distinct()


def log_rows(answer: Answer, questions: DataFrame, branch: str, at) -> DataFrame:
    """Rows of the ask log."""
    hits = answer.counts.groupBy("qid").agg(F.sum("n").cast("int").alias("total_hits"), F.array_sort(F.collect_set("base")).alias("bases"))
    return questions.select("qid", "question").join(hits, "qid", "left").select(F.lit(at).cast("timestamp").alias("timestamp"), F.lit(branch).alias("branch"), "question", F.coalesce("bases", F.array().cast("array<string>")).alias("bases"), F.coalesce("total_hits", F.lit(0)).alias("total_hits"), F.lit(None).cast("string").alias("bundle_path"))
