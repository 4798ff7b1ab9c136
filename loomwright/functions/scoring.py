"""Scores: BM25, rank fusion, blending and boosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.rules import FILE_EXTENSIONS, QUESTION_WORDS

K1, B = 1.2, 0.75
RRF_K, RRF_DENSE, RRF_SPARSE = 60.0, 0.5, 0.5


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(idf_: Column, tf: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def rrf(dense_rank: Column, sparse_rank: Column, missing: Column, k: float = RRF_K, dense: float = RRF_DENSE, sparse: float = RRF_SPARSE) -> Column:
    """Reciprocal rank fusion; a missing rank counts as `missing`, one more than the longer list."""
    return F.lit(dense) / (k + F.coalesce(dense_rank, missing)) + F.lit(sparse) / (k + F.coalesce(sparse_rank, missing))


def check_fusion(k: float, dense: float, sparse: float, dense_top: int = 50, sparse_top: int = 50) -> list[str]:
    """Warnings about settings that work; ValueError for those that don't."""
    if k <= 0:
        raise ValueError("the RRF constant must be positive")
    if dense < 0 or sparse < 0:
        raise ValueError("weights must not be negative")
    if (dense > 0 and dense_top == 0) or (sparse > 0 and sparse_top == 0):
        raise ValueError("a weighted side needs candidates")
    out = []
    if dense == 0 and sparse == 0:
        out.append("both weights are zero")
    elif abs(dense + sparse - 1) > 0.01:
        out.append("weights don't sum to one")
    if k > 100:
        out.append("a large RRF constant flattens ranks")
    return out


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def blend(dense: Column, rerank: Column) -> Column:
    """Four tenths of the rerank score, six of the dense one, each brought to 0 .. 1."""
    return 0.4 * _clamped((rerank + 0.1) * 5.0) + 0.6 * _clamped(dense * 2.0)


def detect_file(question: Column) -> Column:
    """struct(pattern, explicit): the file that a question names, or null."""
    known = F.array(*map(F.lit, FILE_EXTENSIONS))
    good = lambda c: (c != "") & F.array_contains(known, F.lower(F.substring_index(c, ".", -1)))
    said = F.regexp_extract(question, r"(?i)\b(?:in|from|of|at)\s+([a-zA-Z0-9_\-./]+\.[a-zA-Z0-9]+)", 1)
    file = F.regexp_extract(question, r"(?i)\b(?:the\s+)?([a-zA-Z0-9_\-]+\.[a-zA-Z0-9]+)\s+file", 1)
    big = F.regexp_extract(question, r"\b([A-Z][a-zA-Z0-9_]*\.[a-zA-Z0-9]+)\b", 1)
    small = F.get(F.filter(F.regexp_extract_all(question, F.lit(r"\b([a-z][a-z0-9_\-]*\.[a-zA-Z0-9]+)\b"), F.lit(1)), good), F.lit(0))
    found = lambda c, explicit: F.struct(c.alias("pattern"), F.lit(explicit).alias("explicit"))
    return F.when(good(said), found(said, True)).when(good(file), found(file, True)).when(good(big), found(big, False)).when(small.isNotNull(), found(small, False))


def names_path(pattern: Column, path: Column) -> Column:
    """Whether a path is what a pattern names: the same last part, the same stem, or the pattern within."""
    p, low = F.lower(pattern), F.lower(path)
    file = F.substring_index(low, "/", -1)
    return (file == p) | (F.substring_index(file, ".", 1) == F.substring_index(p, ".", 1)) | F.contains(low, p)


def file_boost(question: Column, path: Column, pattern: Column, explicit: Column) -> Column:
    """What a path's name adds to its score."""
    q, file = F.lower(question), F.substring_index(F.lower(path), "/", -1)
    asks = lambda *words: q.rlike("|".join(words))
    has = lambda *words: file.rlike("|".join(words))
    term = F.exists(F.split(q, r"\s+"), lambda t: ~t.isin(QUESTION_WORDS) & (F.octet_length(t) >= 3) & F.contains(file, t))
    return (
        F.when(pattern.isNotNull() & names_path(pattern, path), F.when(explicit, 0.5).otherwise(0.25))
        .when(asks("css", "style") & has(r"\.css$", r"\.scss$", "style"), 0.1)
        .when(asks("config", "bundler", "vite", "webpack") & has("config", "vite", "webpack"), 0.1)
        .when(asks("helper", "util") & has("helper", "util"), 0.1)
        .when(asks("hook") & file.startswith("use"), 0.1)
        .when(asks("api") & has("api"), 0.1)
        .when(term, 0.05)
        .otherwise(0.0)
    )
