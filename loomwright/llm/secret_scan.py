"""Secret scan with an incremental blob ledger, all in DataFrame operations.

Every historical version of a text is a blob, named by its SHA-256. The ledger has one row for
each (blob, rule, rule version) that was ever scanned, with the spans found, empty or not. A scan
reads only blobs that lack a row for some current rule version, runs just those rules on them,
appends the new rows, and joins the findings of every blob back to all paths that hold it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import scratch


class Rule(NamedTuple):
    name: str
    version: int
    pattern: str
    #: The group whose length counts, and the length asked for.
    group: int
    least: int


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
#: In the order in which kinds are listed. The length of a run of one class can stand in its pattern: a shorter run has no longer one inside.
RULES = [
    Rule("assign", 1, rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
]
SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as code point offsets, end exclusive.

    split() at the same pattern gives the gaps between the matches, so that offsets are running
    sums of the lengths of gaps and matches.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    parts = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), sized, lambda p, s: F.struct(p.gap.alias("gap"), p.len.alias("len"), F.length(s).alias("size")))
    empty = F.array().cast("array<struct<start:int,end:int,size:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc.at + p.gap
        end = begin + F.coalesce(p.len, F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), p["size"].alias("size")))
        return F.struct(end.alias("at"), F.when(p["size"] >= rule.least, F.concat(acc.found, one)).otherwise(acc.found).alias("found"))

    found = F.aggregate(parts, start, step, lambda acc: acc.found)
    kept = F.transform(found, lambda s: F.struct(s.start.alias("start"), s.end.alias("end")))
    return F.when(F.regexp_like(text, pattern), kept).otherwise(F.array().cast(SPANS))


def scan_ledger(blobs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """New ledger rows for blobs (blob, text): those (blob, rule, version) that the ledger lacks."""
    rules = rules or RULES
    if ledger is None:
        todo = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        current = F.array(*[F.lit(f"{r.name}/{r.version}") for r in rules])
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "rule", "version")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        todo = todo.filter(F.size(F.array_except(current, "seen")) > 0)
    rows = [F.when(~F.array_contains("seen", f"{r.name}/{r.version}"), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    return todo.select("blob", F.explode(F.array(*rows)).alias("row")).filter("row is not null").select("blob", "row.*")


def blobs_of(df: DataFrame, text_col: str, ledger: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Each distinct content once: blob, text. Content is part of the key, so a copy is dropped only after a full comparison, within its task before any shuffle.

    With a ledger, blobs that it has for every rule version are dropped by their digests, before
    any text is shuffled on: only the digests of the ledger's complete blobs travel to the texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = df.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    if ledger is not None:
        current = F.lit(False)
        for r in rules or RULES:
            current = current | ((F.col("rule") == r.name) & (F.col("version") == r.version))
        done = ledger.filter(current).groupBy("blob").agg(F.countDistinct("rule", "version").alias("n")).filter(F.col("n") == len(rules or RULES)).select("blob")
        digests = df.select(F.sha2(text, 256).alias("blob")).distinct()
        unseen = scratch.keep(digests.join(done, "blob", "left_anti"), "secret-unseen")
        blobs = blobs.join(unseen, "blob", "left_semi")
    return blobs.distinct()


def secret_scan(df: DataFrame, id_col: str, text_col: str, ledger: DataFrame | None = None, rules: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths with findings, rows to append to the ledger).

    Paths: one row per input row: id, blob, findings: array of (start, end, order, kind), sorted.
    Cases: a null text is an empty blob; a null id is a path like any other; repeated rows get
    equal findings; ties in start are ordered by rule; an empty table gives no rows; further
    columns are not read.
    """
    rules = rules or RULES
    fresh = scratch.keep(scan_ledger(blobs_of(df, text_col, ledger, rules), ledger, rules), "secret-ledger")
    known = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "rule", "version", "spans"))
    current = F.lit(False)
    order = F.lit(0)
    for i, r in enumerate(rules):
        current = current | ((F.col("rule") == r.name) & (F.col("version") == r.version))
        order = F.when(F.col("rule") == r.name, i).otherwise(order)
    hits = known.filter(current & (F.size("spans") > 0)).withColumn("order", order)
    tagged = F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.col("order"), F.col("rule").alias("kind")))
    # at most one row for each rule: a blob's findings are those of one text
    by_blob = hits.groupBy("blob").agg(F.flatten(F.collect_list(tagged)).alias("findings"))
    none = F.array().cast("array<struct<start:int,end:int,order:int,kind:string>>")
    sorted_ = F.array_sort(F.coalesce("findings", none), lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(a.order - b.order))
    paths = df.select(F.col(id_col).alias(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    return paths.join(by_blob, "blob", "left").select(id_col, "blob", sorted_.alias("findings")), fresh
