"""Questions that ask for everything of a kind, answered from the graph, a batch at a time."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.graph import touching
from loomwright.rules import ALL_MARKS, ASKED_METHODS, ENDPOINT_WORDS, EXPANSIONS, KIND_SYNONYMS, KIND_WORDS, STACK_EXPANSIONS

MAX_NODES = 128


def _says(question: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(question, F.lit(w))
    return out


def asks_for_endpoints(question: Column) -> Column:
    return _says(F.lower(question), ENDPOINT_WORDS)


def intent(question: Column) -> Column:
    """struct(exhaustive, kinds, method, reason). Words are looked for as parts of others, so "target" says get; a method without a kind means endpoints."""
    q = F.lower(question)
    wants = _says(q, ALL_MARKS)
    method = F.lit(None).cast("string")
    for m in reversed(ASKED_METHODS):
        method = F.when(F.contains(q, F.lit(m)), m.upper()).otherwise(method)
    said = F.filter(F.array(*[F.when(_says(q, words), k) for k, words in KIND_WORDS.items()]), lambda k: k.isNotNull())
    kinds = F.when((F.size(said) == 0) & method.isNotNull(), F.array(F.lit("endpoint"))).otherwise(said)
    reason = F.when(F.size(kinds) == 0, "everything").otherwise(F.concat_ws(" ", F.lit("every"), method, F.array_join(kinds, ", ")))
    none = F.array().cast("array<string>")
    return F.struct(wants.alias("exhaustive"), F.when(wants, kinds).otherwise(none).alias("kinds"), F.when(wants, method).alias("method"), F.when(wants, reason).alias("reason"))


class Found(NamedTuple):
    #: qid, id, matched: the nodes asked for and, not counted against the cap, their neighbours
    nodes: DataFrame
    #: qid and the columns of edges
    edges: DataFrame


def exhaustive(questions: DataFrame, nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES) -> Found:
    """questions (qid, question), nodes (id, kind, method), edges (id, from_node, to_node, ...).

    The first max_nodes matches of a question by id, twice as many of the edges that touch them,
    and the nodes at the other ends. A node without a method passes a filter by method only if
    it is an endpoint. Questions that aren't exhaustive, or name no kind, find nothing.
    """
    spark = questions.sparkSession
    same = [(k, n) for k in KIND_WORDS for n in [k, *KIND_SYNONYMS.get(k, [])]]
    synonyms = F.broadcast(spark.createDataFrame(same, "target string, kind string"))  # the fixed table
    asked = questions.withColumn("i", intent(F.col("question"))).filter("i.exhaustive").select("qid", F.col("i.method").alias("wanted"), F.explode("i.kinds").alias("target"))
    fits = F.col("wanted").isNull() | (F.upper("method") == F.col("wanted")) | (F.col("method").isNull() & (F.col("kind") == "endpoint"))
    hits = asked.join(synonyms, "target").join(nodes, "kind").filter(fits).select("qid", "id").distinct()
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).filter(F.col("_n") <= max_nodes).drop("_n")
    near = touching(edges, first.select("id").distinct())
    out = near.join(first.select("qid", F.col("id").alias("from_node")), "from_node").select("qid", *edges.columns)
    into = near.join(first.select("qid", F.col("id").alias("to_node")), "to_node").select("qid", *edges.columns)
    mine = out.unionByName(into).distinct()
    mine = mine.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).filter(F.col("_n") <= 2 * max_nodes).drop("_n")
    ends = mine.select("qid", F.explode(F.array("from_node", "to_node")).alias("id")).distinct().join(first, ["qid", "id"], "left_anti")
    return Found(first.withColumn("matched", F.lit(True)).unionByName(ends.withColumn("matched", F.lit(False))), mine)


def stack_table(technologies: list[str]) -> dict[str, list[str]]:
    """The table of terms with what a project's technologies add, after the general alternatives."""
    table = {k: list(v) for k, v in EXPANSIONS.items()}
    names = [t.lower() for t in technologies]
    for marks, more in STACK_EXPANSIONS:
        if any(m in n for m in marks for n in names):
            for term, alternatives in more.items():
                table.setdefault(term, []).extend(alternatives)
    return table
