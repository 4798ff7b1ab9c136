import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(SMALL))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        p = words(t)
        m = min(10, len(p))
        for k in range(len(p) - m + 1 if m else 0):
            for a in range(len(w) - m + 1):
                if w[a : a + m] == p[k : k + m]:
                    hit.update(range(a, a + m))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def cases():
    rnd = random.Random(3)
    vocab = ["ab", "cd", "Éa", "x9", "ef", "gh"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 3, 5, 10, 14])))) for i in range(12)] + [(50, ""), (51, None), (52, "one two three four five six seven eight nine ten eleven"), (None, "ab")]
    texts = [" ,".join(rnd.choices(vocab, k=rnd.randint(0, 60))) for _ in range(60)] + [None, "", "  ", "x ONE two three four five six seven eight nine ten eleven y" * 2, "one two three four five six seven eight nine", "ab" * 9000, "ab cd " * 4000]
    return items, texts + texts[:3]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_against_brute_force(spark, docs, block):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(*texts)
    out = D.contamination(df, "text", bench, "item_id", "text", block_bytes=block)
    assert out.columns == [*df.columns, "n_words", "_items", "n_hit"] and out.count() == len(texts)
    got = {r.doc_id: (r.n_words, r.n_hit, r._items) for r in out.collect()}
    known = [(i, t) for i, t in items if i is not None]
    for i, t in enumerate(texts):
        assert got[i] == brute(t, known), i


def test_filter_and_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    df = docs("x a b c y", "clean", None)
    kept = D.drop_contaminated(df, "text", bench, "item_id", "text")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert D.drop_contaminated(df, "text", bench.limit(0), "item_id", "text").count() == 3
    assert D.drop_contaminated(df.filter(F.lit(False)), "text", bench, "item_id", "text").count() == 0


def test_shift_tables_skip():
    groups = D.compile_patterns([("1", "a b c d e f g h i j")]).groups
    assert len(groups) == 1 and groups[0].m == 10 and groups[0].shift.max() == 8 and (groups[0].shift == 0).sum() == 1
