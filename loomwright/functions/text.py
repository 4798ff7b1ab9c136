"""Terms of texts as column expressions, and stemming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.porter2 import stem
from loomwright.rules import STOPWORDS

WORD = r"[\p{L}\p{N}_]+"
LEAST_BYTES = 2


def words(text: Column) -> Column:
    """All words of a text in lower case; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def keep_term(word: Column, stopwords: list[str] | None = None) -> Column:
    """A word with a letter, LEAST_BYTES bytes and no place among the stopwords."""
    stop = STOPWORDS if stopwords is None else stopwords
    return word.rlike(r"\p{L}") & (F.octet_length(word) >= LEAST_BYTES) & ~word.isin(stop)


def terms(text: Column, stopwords: list[str] | None = None) -> Column:
    """Words that count for search, in order, without stemming."""
    return F.filter(words(text), lambda w: keep_term(w, stopwords))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Porter2 stems of lists of terms; stems of fewer than LEAST_BYTES bytes are dropped. Each distinct term is stemmed once a worker."""
    known: dict[str, str] = {}

    def one(t: str) -> str:
        if t not in known:
            if len(known) > 500_000:
                known.clear()
            known[t] = stem(t)
        return known[t]

    for s in lists:
        yield s.map(lambda ts: [x for x in map(one, ts) if len(x.encode()) >= LEAST_BYTES] if ts is not None else [])


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def shorten(text: Column, most: int) -> Column:
    """At most `most` bytes of ASCII text; what is longer ends in three points."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    """Lower case, runs of all but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
