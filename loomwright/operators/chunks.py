"""Operators on retrieved chunks: overlap, prefilter, rerank, expansion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import scoring
from loomwright.functions.paths import type_of
from loomwright.rules import EXPANSIONS

RERANK_FROM, RERANK_TO = 30, 5
MAX_VARIANTS = 4


def overlap_pairs(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Pairs of rows of one key whose closed [start, end] meet, the lesser `order` first. The key is an equi-join; within it ranges are compared."""
    a, b = (rows.select(F.col(key), F.col(order).alias(x), F.col("start").alias(f"s{x}"), F.col("end").alias(f"e{x}")) for x in ("a", "b"))
    return a.join(b, key).filter("a < b and sa <= eb and sb <= ea").select(key, "a", "b")


def drop_overlaps(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy: by score, then id, a row stays unless one that stays has its keys and meets its [start, end].

    Rows of a key stream by in order; only the ranges that stay in the current key are held.
    """

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, []
        for pdf in frames:
            stays = []
            for key, start, end in zip(zip(*(pdf[k].tolist() for k in keys), strict=True), pdf["start"].tolist(), pdf["end"].tolist(), strict=True):
                if key != current:
                    current, kept = key, []
                free = not any(start <= e and s <= end for s, e in kept)
                stays.append(free)
                if free:
                    kept.append((start, end))
            yield pdf[stays]

    return hits.repartition(*keys).sortWithinPartitions(*keys, F.col("score").desc(), "id").mapInPandas(greedy, hits.schema)


def best_per_path(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The same where every chunk is a whole file: the best row of each path."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rerank_input(path: Column, base: Column, snippet: Column) -> Column:
    return F.format_string("[File: %s] [Type: %s] [Base: %s]\n%s", path, type_of(path), base, snippet)


@F.pandas_udf(T.DoubleType())
def lexical_overlap(questions: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Stand-in for a cross-encoder, which isn't available offline: shared words over the question's words, brought to -0.1 .. 0.1."""
    for q, t in questions:
        out = []
        for a, b in zip(q.fillna(""), t.fillna(""), strict=True):
            words = set(a.lower().split())
            out.append(0.2 * len(words & set(b.lower().split())) / len(words) - 0.1 if words else -0.1)
        yield pd.Series(out)


def rerank(hits: DataFrame, scorer=lexical_overlap, first: int = RERANK_FROM, final: int = RERANK_TO) -> DataFrame:
    """hits (qid, id, question, path, base, snippet, score): the `first` best go to the scorer, the `final` best by its score stay, and are ordered by blend and boost."""
    few = hits.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))).filter(F.col("_r") <= first).drop("_r")
    scored = few.withColumn("rerank_score", scorer("question", rerank_input(F.col("path"), F.col("base"), F.col("snippet"))))
    kept = scored.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "id"))).filter(F.col("_r") <= final).drop("_r")
    file = scoring.detect_file(F.col("question"))
    boosted = kept.withColumn("_f", file).withColumn("final_score", F.round(scoring.blend(F.col("score"), F.col("rerank_score")) + scoring.file_boost(F.col("question"), F.col("path"), F.col("_f.pattern"), F.col("_f.explicit")), 6)).drop("_f")
    return boosted.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("final_score").desc(), "id")))


def add_named_files(hits: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """hits and, with score 0.5, the chunks of files that a question names and that aren't among its hits."""
    named = questions.withColumn("_f", scoring.detect_file(F.col("question"))).filter("_f is not null")
    stem = F.substring_index(F.substring_index(F.lower("_f.pattern"), "/", -1), ".", 1)
    found = named.withColumn("_stem", stem).join(chunks.withColumn("_stem", F.substring_index(F.substring_index(F.lower("path"), "/", -1), ".", 1)), "_stem")
    found = found.filter(scoring.names_path(F.col("_f.pattern"), F.col("path"))).withColumn("score", F.lit(0.5))
    fresh = found.join(hits.select("qid", "path").distinct(), ["qid", "path"], "left_anti")
    return hits.unionByName(fresh.select(*hits.columns))


def variants(questions: DataFrame, table: dict[str, list[str]] | None = None, most: int = MAX_VARIANTS) -> DataFrame:
    """qid, variant, place: the question and up to most - 1 others, each with the first place of one term put otherwise."""
    rows = [(i, t, j, a) for i, (t, alts) in enumerate((EXPANSIONS if table is None else table).items()) for j, a in enumerate(alts[: most - 1])]
    spark = questions.sparkSession
    known = F.broadcast(spark.createDataFrame(rows, "i int, term string, j int, alt string"))  # the fixed table
    hit = questions.join(known, F.contains(F.lower("question"), F.col("term")))
    at = F.instr(F.lower("question"), F.col("term"))
    changed = F.concat(F.expr("substring(question, 1, instr(lower(question), term) - 1)"), "alt", F.expr("substring(question, instr(lower(question), term) + length(term))"))
    all_ = hit.filter(at > 0).select("qid", changed.alias("variant"), (F.col("i") * 100 + F.col("j")).alias("o"), "question").filter("variant != question").groupBy("qid", "variant").agg(F.min("o").alias("o"))
    all_ = questions.select("qid", F.col("question").alias("variant"), F.lit(-1).alias("o")).unionByName(all_)
    return all_.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("o"))).filter(F.col("place") <= most).drop("o")
