"""Inverted index, BM25 search, exact vector search and rank fusion, for whole batches of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomwright.functions import scoring
from loomwright.functions.text import stemmed, terms
from loomwright.sources.shared import keep

#: Decimal places to which scores are rounded before ranking, so that ranks don't depend on the order of sums.
PLACES = 6


class Index(NamedTuple):
    #: doc_id, length, terms: each text once, in the shared folder
    tokens: DataFrame
    #: term, doc_id, tf, length
    postings: DataFrame
    #: n, total, mean: one row
    stats: DataFrame


def term_rows(docs: DataFrame, id_col: str, text_col: str, stem: bool = False, stopwords: list[str] | None = None) -> DataFrame:
    """(doc_id, term), one row per occurrence."""
    found = terms(F.col(text_col), stopwords)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(stemmed(found) if stem else found).alias("term"))


def build_index(docs: DataFrame, id_col: str, text_col: str, stem: bool = False) -> Index:
    """Tokens, term frequencies and corpus statistics. Texts are read and split once; all else comes from the tokens. A text without terms has length 0 and counts for the mean."""
    found = terms(F.col(text_col))
    tokens = docs.select(F.col(id_col).alias("doc_id"), (stemmed(found) if stem else found).alias("terms"))
    tokens = keep(tokens.select("doc_id", F.size("terms").cast("long").alias("length"), "terms"), "tokens")
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.avg("length").alias("mean"))
    return Index(tokens, frequencies(tokens.select("doc_id", "length", F.explode("terms").alias("term"))), stats)


def frequencies(occurrences: DataFrame) -> DataFrame:
    """term, doc_id, tf, length of (doc_id, length, term)."""
    return occurrences.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def term_counts(index: Index) -> DataFrame:
    """term, df: each text counts once for each of its terms, without a row for each occurrence."""
    return index.tokens.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(index: Index) -> DataFrame:
    """term, df, idf."""
    return term_counts(index).join(F.broadcast(index.stats), how="cross").select("term", "df", scoring.idf(F.col("n"), F.col("df")).alias("idf"))  # stats is one row


def top_per(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key and their rank from 1; ties go by `tie`."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_scores(index: Index, questions: DataFrame, id_col: str, text_col: str, stem: bool = False) -> DataFrame:
    """qid, doc_id, score of all documents that have a term of the question.

    A term that a question repeats counts as often; unknown terms count for nothing. Only the
    questions' terms get postings: others are dropped before anything is shuffled, and what is
    left is written once for both its readers.
    """
    asked = keep(term_rows(questions, id_col, text_col, stem).groupBy(F.col("doc_id").alias("qid"), "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    occurrences = index.tokens.select("doc_id", "length", F.explode("terms").alias("term"))
    wanted = keep(frequencies(occurrences.join(asked.select("term").distinct(), "term", "left_semi")), "wanted")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(index.stats)  # one row
    weighted = asked.join(df, "term").join(stats, how="cross").select("qid", "term", "times", "mean", scoring.idf(F.col("n"), F.col("df")).alias("idf"))
    hits = wanted.join(weighted, "term")
    part = F.col("times") * scoring.bm25(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean"))
    return hits.groupBy("qid", "doc_id").agg(F.round(F.sum(part), PLACES).alias("score"))


def bm25_search(index: Index, questions: DataFrame, id_col: str, text_col: str, k: int, stem: bool = False) -> DataFrame:
    """qid, doc_id, score, rank: the k best documents of each question."""
    return top_per(bm25_scores(index, questions, id_col, text_col, stem), "qid", "score", "doc_id", k)


#: Numbers of the questions' vectors that one pass over the vectors answers, questions multiplied at once, and differences held at once.
PASS, BLOCK, HELD = 4 << 20, 1024, 1 << 21


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """A row for each question, a column for each vector."""
    if metric == "l2":
        out, step = np.empty((len(q), len(v))), max(1, HELD // max(1, q.size))
        for at in range(0, len(v), step):
            out[:, at : at + step] = -np.sqrt(((q[:, None, :] - v[None, at : at + step, :]) ** 2).sum(axis=2))
    else:
        out = q @ v.T
        if metric == "cosine":
            size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
            out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    return np.round(out, PLACES) + 0.0


def knn(vectors: DataFrame, questions: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """vectors (id, vector), questions (qid, vector) -> qid, id, score, rank: exact search.

    Questions go out by a hash of their id, about PASS numbers at a time, a bounded broadcast that
    the driver forgets after its pass; every task multiplies its vectors with BLOCK questions at a
    time and hands on its k best for each, so that the shuffle carries k rows per batch and
    question. metric: cosine, dot or l2 (minus the distance). Null vectors are left out; vectors
    that differ in length fail.
    """
    spark = vectors.sparkSession
    asked = questions.select("qid", "vector").filter("vector is not null")
    passes = max(1, -(-(asked.agg(F.sum(F.size("vector"))).first()[0] or 0) // PASS))
    schema = T.StructType([T.StructField("qid", questions.schema["qid"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    parts = []
    for p in range(passes):
        block = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p).collect()
        shared = spark.sparkContext.broadcast(([r.qid for r in block], np.array([r.vector for r in block], np.float64)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, every = shared.value
            for batch in batches:
                rows = batch.filter(batch.column(1).is_valid())
                if not rows.num_rows or not len(names):
                    continue
                v = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
                own = np.array(rows.column(0).to_pylist())
                for at in range(0, len(names), BLOCK):
                    ids = names[at : at + BLOCK]
                    qids, found, values = [], [], []
                    for i, score in enumerate(scores(every[at : at + BLOCK], v, metric)):
                        if len(score) > k:  # keep ties at the edge
                            near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                        else:
                            near = np.arange(len(score))
                        near = near[np.lexsort((own[near], -score[near]))][:k]
                        qids += [ids[i]] * len(near)
                        found += own[near].tolist()
                        values.append(score[near])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((qids, found, np.concatenate(values)), kinds, strict=True)], names=["qid", "id", "score"])

        best = vectors.select("id", "vector").mapInArrow(search, schema)
        if passes > 1:
            best = keep(best, "knn")
            shared.unpersist()
        parts.append(best)
    return top_per(reduce(DataFrame.unionByName, parts), "qid", "score", "id", k)


def vector_filter(base: str | None = None, branch: str | None = None, source_type: str | None = None, path_prefix: str | None = None, tags: list[str] | None = None, revision_id: str | None = None) -> Column:
    """All conditions that are given; without any, everything."""
    out = F.lit(True)
    for name, value in (("base", base), ("branch", branch), ("source_type", source_type), ("revision_id", revision_id)):
        out = out & (F.col(name) == value) if value is not None else out
    if path_prefix is not None:
        out = out & F.startswith(F.col("path"), F.lit(path_prefix))
    if tags:
        out = out & (F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    return out


def centroid(vectors: DataFrame, key: str | None = None) -> DataFrame:
    """Mean of the vectors of each key, brought to length 1: (key,) vector."""
    from loomwright.functions.vectors import normalised

    keys = [key] if key else []
    spread = vectors.select(*keys, F.posexplode("vector").alias("pos", "x"))
    means = spread.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("vector"))  # one entry per dimension
    return whole.select(*keys, normalised(F.col("vector")).alias("vector"))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: float = scoring.RRF_K, w_dense: float = scoring.RRF_DENSE, w_sparse: float = scoring.RRF_SPARSE) -> DataFrame:
    """Rank fusion of (qid, doc_id, rank) lists: qid, doc_id, dense_rank, sparse_rank, score, rank."""
    scoring.check_fusion(rrf_k, w_dense, w_sparse)
    both = dense.select("qid", "doc_id", F.col("rank").alias("dense_rank")).join(sparse.select("qid", "doc_id", F.col("rank").alias("sparse_rank")), ["qid", "doc_id"], "full_outer")
    w = Window.partitionBy("qid")  # two short lists
    missing = F.greatest(F.count("dense_rank").over(w), F.count("sparse_rank").over(w)) + 1
    scored = both.withColumn("score", F.round(scoring.rrf(F.col("dense_rank"), F.col("sparse_rank"), missing, rrf_k, w_dense, w_sparse), 9))
    return top_per(scored, "qid", "score", "doc_id", k)


def hybrid(index: Index, vectors: DataFrame, questions: DataFrame, k: int, candidates: int = 50, stem: bool = False) -> DataFrame:
    """questions (qid, text, vector): the k best of dense and sparse search together."""
    dense = knn(vectors, questions, candidates).withColumnRenamed("id", "doc_id")
    return fuse(dense, bm25_search(index, questions, "qid", "text", candidates, stem), k)
