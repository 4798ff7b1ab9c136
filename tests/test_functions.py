import math

import pytest
from pyspark.sql import functions as F

from loomwright.functions import paths, scoring
from loomwright.functions.embedding import hash_vector
from loomwright.functions.porter2 import stem
from loomwright.functions.text import terms
from loomwright.functions.vectors import cosine, distance, dot, normalised


def one(spark, *cols, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(*cols).first()


@pytest.mark.parametrize(
    "word, root",
    [
        ("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cries", "cri"),
        ("hopping", "hop"), ("hoping", "hope"), ("running", "run"), ("generalizations", "general"), ("skies", "sky"), ("news", "news"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("relational", "relat"),
        ("conditional", "condit"), ("inning", "inning"), ("proceed", "proceed"), ("agreed", "agre"), ("plastered", "plaster"), ("sky", "sky"), ("electricity", "electr"), ("adoption", "adopt"), ("controlling", "control"),
    ],
)
def test_porter2(word, root):
    assert stem(word) == root


def test_idf_bounds(spark):
    f = lambda n, df: scoring.idf(F.lit(n), F.lit(df))
    a, b, c = one(spark, f(1000, 900), f(1000, 10), f(1000, 1))
    assert 0 < a < 0.5 and b > 3 and c > 5


def test_terms(spark):
    assert one(spark, terms(F.lit("The Main_fn of 42 a x é do RETURN ok")))[0] == ["main_fn", "é", "do", "return", "ok"]
    assert one(spark, terms(F.lit(None).cast("string")))[0] == []


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    got = one(spark, dot(a, b), cosine(a, b), cosine(a, zero), distance(a, b), normalised(a), normalised(zero))
    assert got[0] == 24 and math.isclose(got[1], 0.96) and got[2] == 0 and math.isclose(got[3], math.sqrt(2)) and got[4] == [0.6, 0.8] and got[5] == [0, 0]


def test_blend(spark):
    assert one(spark, scoring.blend(F.lit(0.5), F.lit(0.1)))[0] == 1.0
    assert one(spark, scoring.blend(F.lit(-1.0), F.lit(-5.0)))[0] == 0.0


def test_fusion_settings():
    assert scoring.check_fusion(60, 0.5, 0.5) == []
    assert len(scoring.check_fusion(200, 0.9, 0.5)) == 2
    for bad in ((0, 0.5, 0.5), (60, -1, 0.5)):
        with pytest.raises(ValueError):
            scoring.check_fusion(*bad)


def test_hash_vector():
    v = hash_vector("abc")
    assert len(v) == 384 and math.isclose(float((v * v).sum()), 1) and (v == hash_vector("abc")).all() and not (v == hash_vector("abd")).all()


def test_branch_names(spark):
    names = ["main", "feat/x-1.2", "/a", "a/", "a//b", "a b", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(paths.good_branch(F.col("n"))).collect()]
    assert got == [True, True, False, False, False, False, False]


def test_methods(spark):
    text = "export async function GET() {}\nexport const POST = 1\nexport function GET() {}\nfunction PUT() {}"
    assert one(spark, paths.methods_of(F.lit(text)))[0] == ["GET", "POST"]
    assert one(spark, paths.methods_of(F.lit("x")))[0] == []
    assert one(spark, paths.methods_of(F.lit(None).cast("string")))[0] == ["GET"]
