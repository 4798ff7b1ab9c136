"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import paths, scoring
from loomwright.operators import chunks as C
from loomwright.operators import inventory as I
from loomwright.operators import search as S
from loomwright.rules import EXPANSIONS, STOPWORDS
from loomwright.sources.tables import markdown, table

QUERIES, SQL = {}, {}
TOP = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_TERMS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda t: regexp_matches(t, '\p{L}') and strlen(t) >= 2 and not list_contains(STOP, t))".replace("STOP", _STOP)
_INDEX = f"""
tok as (select doc_id, unnest({_TERMS}) as term from documents),
tf as (select doc_id, term, count(*) as tf from tok group by all),
dl as (select doc_id, len({_TERMS})::bigint as length from documents),
st as (select count(*) as n, sum(length) as total, avg(length) as mean from dl),
df as (select term, count(*) as df from tf group by term),
idf as (select term, df, ln((n - df + 0.5) / (df + 0.5) + 1.0) as idf from df, st)"""
_BM25 = f"""{_INDEX},
q as (select item_id as qid, unnest({_TERMS}) as term from benchmark),
sc as (select qid, tf.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score
       from q join idf using (term) join tf using (term) join dl on dl.doc_id = tf.doc_id, st group by all)"""
_Q = "(select vec_id as qid, embedding::double[] as q from embeddings where vec_id % 50 = 0)"


def _index(spark: SparkSession, sf_dir: str) -> S.Index:
    return S.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).filter("id % 50 = 0").select(F.col("id").alias("qid"), "vector")


@query(f"with {_INDEX} select doc_id, term, tf from tf")
def token_tf(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("doc_id", "term", "tf")


@query(f"with {_INDEX} select term, df from df")
def token_df(spark, sf_dir):
    return S.term_counts(_index(spark, sf_dir))


@query(f"with {_INDEX} select n, total::bigint as total, round(mean, 6) as mean, (select count(*) from df) as vocabulary from st")
def corpus_stats(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.stats.join(S.term_counts(i).agg(F.count(F.lit(1)).alias("vocabulary")), how="cross").select("n", "total", F.round("mean", 6).alias("mean"), "vocabulary")


@query(f"with {_INDEX} select term, df, round(idf, 6) as idf from idf")
def bm25_idf(spark, sf_dir):
    return S.term_stats(_index(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_BM25} select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) as rank from sc qualify rank <= {TOP}")
def bm25_search_benchmark(spark, sf_dir):
    return S.bm25_search(_index(spark, sf_dir), _questions(spark, sf_dir), "qid", "text", TOP)


@query(f"with {_INDEX}, q as (select distinct item_id as qid, unnest({_TERMS}) as term from benchmark) select qid, term, df, round(idf, 6) as idf from q join idf using (term)")
def bm25_term_stats(spark, sf_dir):
    asked = S.term_rows(_questions(spark, sf_dir), "qid", "text").distinct()
    return asked.join(S.term_stats(_index(spark, sf_dir)), "term").select(F.col("doc_id").alias("qid"), "term", "df", F.round("idf", 6).alias("idf"))


def _knn_sql(score: str, more: str = "", extra: str = "") -> str:
    return f"""select qid, vec_id as id, round({score}, 6) + 0.0 as score{extra}, row_number() over (partition by qid{", label" if extra else ""} order by round({score}, 6) desc, vec_id) as rank
from embeddings, {_Q} {more} qualify rank <= {TOP}"""


_COS, _DOT, _L2 = "list_cosine_similarity(embedding::double[], q)", "list_dot_product(embedding::double[], q)", "-list_distance(embedding::double[], q)"


@query(_knn_sql(_COS))
def vector_cosine_topk(spark, sf_dir):
    return S.knn(_vectors(spark, sf_dir), _asked(spark, sf_dir), TOP)


@query(_knn_sql(_DOT))
def vector_dot_topk(spark, sf_dir):
    return S.knn(_vectors(spark, sf_dir), _asked(spark, sf_dir), TOP, "dot")


@query(_knn_sql(_L2))
def vector_l2_topk(spark, sf_dir):
    return S.knn(_vectors(spark, sf_dir), _asked(spark, sf_dir), TOP, "l2")


@query(_knn_sql(_COS, "where label in (1, 2)"))
def vector_filtered_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("base", F.when(F.col("label").isin(1, 2), "code").otherwise("docs"))
    return S.knn(v.filter(S.vector_filter(base="code")), _asked(spark, sf_dir), TOP)


@query(f"with v as (select row_number() over (order by vec_id) as n, vec_id, embedding::double[] as e, label from embeddings), c as (select label, list(x / n2 order by pos) as q from (select label, pos, x, sqrt(sum(x * x) over (partition by label)) as n2 from (select label, pos, avg(e[pos]) as x from v, range(1, 65) r(pos) group by all)) group by label) select v.label, vec_id, round(list_cosine_similarity(e, q), 6) as score, row_number() over (partition by v.label order by round(list_cosine_similarity(e, q), 6) desc, vec_id) as rank from v join c using (label) qualify rank <= {TOP}")
def vector_per_label_topk(spark, sf_dir):
    from loomwright.functions.vectors import cosine

    v = _vectors(spark, sf_dir)
    scored = v.join(S.centroid(v, "label").withColumnRenamed("vector", "q"), "label").select("label", F.col("id").alias("vec_id"), F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score"))
    return S.top_per(scored, "label", "score", "vec_id", TOP)


@query("select label, pos - 1 as pos, round(x / n, 6) + 0.0 as x from (select label, pos, x, sqrt(sum(x * x) over (partition by label)) as n from (select label, pos, avg(embedding[pos]::double) as x from embeddings, range(1, 65) r(pos) group by all))")
def embedding_centroid_norm(spark, sf_dir):
    return S.centroid(_vectors(spark, sf_dir), "label").select("label", F.posexplode("vector").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


_FUSE = f"""{_BM25},
sp as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as sr from sc qualify sr <= 50),
de as (select item_id as qid, v.vec_id as doc_id, row_number() over (partition by item_id order by round(list_cosine_similarity(v.embedding::double[], w.embedding::double[]), 6) desc, v.vec_id) as dr
       from benchmark join embeddings w on w.vec_id = item_id, embeddings v qualify dr <= 50),
mi as (select qid, greatest(count(dr), count(sr)) + 1 as miss from (select qid, dr, sr from de full join sp using (qid, doc_id)) group by qid),
fu as (select qid, doc_id, dr as dense_rank, sr as sparse_rank, round(0.5 / (60 + coalesce(dr, miss)) + 0.5 / (60 + coalesce(sr, miss)), 9) as score from de full join sp using (qid, doc_id) join mi using (qid))
select qid, doc_id, dense_rank, sparse_rank, score, row_number() over (partition by qid order by score desc, doc_id) as rank from fu qualify rank <= """


def _hybrid(spark, sf_dir, k):
    v = _vectors(spark, sf_dir)
    asked = _questions(spark, sf_dir).join(v.select(F.col("id").alias("qid"), "vector"), "qid", "left")
    return S.hybrid(_index(spark, sf_dir), v, asked, k)


@query(f"with {_FUSE}{TOP}")
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, TOP)


@query(f"with {_FUSE}100")
def rrf_fusion(spark, sf_dir):
    return _hybrid(spark, sf_dir, 100)


_URL = "regexp_replace(url, '\\?.*$', '')"


@query("select part_a.p_partkey as id, round(0.4 * greatest(0.0, least(1.0, (p_size / 250.0 - 0.1 + 0.1) * 5.0)) + 0.6 * greatest(0.0, least(1.0, p_retailprice / 2000.0 * 2.0)), 6) as score from part part_a")
def score_blend(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(scoring.blend(F.col("p_retailprice") / 2000.0, F.col("p_size") / 250.0 - 0.1), 6).alias("score"))


#: Kinds of questions that name files in every way.
_ASK = ["where is the css style", "how does config work", "show helper util", "which hook", "call the api", "what is in src/main.rs", "the utils.py file", "see Button.tsx", "open index.ts", "large brass"]
_FILES = ["src/main.rs", "lib/utils.py", "ui/Button.tsx", "web/index.ts", "web/style.css", "vite.config.js", "src/helper.ts", "hooks/useState.ts", "api/users.ts", "docs/large.md"]
_ASKSQL = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_ASK))
_FILESQL = ", ".join(f"({i}, '{p}')" for i, p in enumerate(_FILES))
_NAMED = {5: ("src/main.rs", True), 6: ("utils.py", True), 7: ("Button.tsx", False), 8: ("index.ts", False)}
_NAMEDSQL = ", ".join(f"({i}, '{p}', {str(x).lower()})" for i, (p, x) in _NAMED.items())


def _asks(spark, sf_dir):
    """A question for each item of the benchmark, its kind by the item's id."""
    kinds = F.array(*map(F.lit, _ASK))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % len(_ASK)).alias("kind"), F.concat(F.get(kinds, (F.col("item_id") % len(_ASK)).cast("int")), F.lit(" "), "item_id").alias("question"))


@query(f"""with a as (select * from (values {_ASKSQL}) v(kind, question)), q as (select item_id as qid, kind, question || ' ' || item_id as question from benchmark join a on kind = item_id % {len(_ASK)}), f as (select * from (values {_FILESQL}) v(fid, path)), n as (select * from (values {_NAMEDSQL}) v(kind, pattern, explicit)),
x as (select q.qid, path, lower(question) as q, lower(regexp_extract(path, '[^/]*$')) as file, lower(pattern) as p, explicit, lower(path) as low from q, f left join n on n.kind = q.kind)
select qid, path, case
 when p is not null and (file = p or split_part(file, '.', 1) = split_part(p, '.', 1) or contains(low, p)) then case when explicit then 0.5 else 0.25 end
 when regexp_matches(q, 'css|style') and regexp_matches(file, '\\.css$|\\.scss$|style') then 0.1
 when regexp_matches(q, 'config|bundler|vite|webpack') and regexp_matches(file, 'config|vite|webpack') then 0.1
 when regexp_matches(q, 'helper|util') and regexp_matches(file, 'helper|util') then 0.1
 when contains(q, 'hook') and starts_with(file, 'use') then 0.1
 when contains(q, 'api') and contains(file, 'api') then 0.1
 when len(list_filter(string_split(q, ' '), lambda t: not list_contains(['the','is','a','an','where','what','how','which','are','in','for','to'], t) and strlen(t) >= 3 and contains(file, t))) > 0 then 0.05
 else 0.0 end::double as boost from x""")
def filename_boost(spark, sf_dir):
    files = spark.createDataFrame([(p,) for p in _FILES], "path string")
    named = _asks(spark, sf_dir).withColumn("f", scoring.detect_file(F.col("question")))
    both = named.join(F.broadcast(files), how="cross")  # a fixed table of ten rows each
    return both.select("qid", "path", scoring.file_boost(F.col("question"), F.col("path"), F.col("f.pattern"), F.col("f.explicit")).alias("boost"))


@query(f"select item_id as qid, pattern, explicit from benchmark left join (values {_NAMEDSQL}) n(kind, pattern, explicit) on kind = item_id % {len(_ASK)}")
def filename_detect(spark, sf_dir):
    return _asks(spark, sf_dir).withColumn("f", scoring.detect_file(F.col("question"))).select("qid", "f.pattern", "f.explicit")


@query(f"with {_BM25} select qid, doc_id, score from sc where score >= 12.0")
def min_score_filter(spark, sf_dir):
    return S.bm25_scores(_index(spark, sf_dir), _questions(spark, sf_dir), "qid", "text").filter("score >= 12.0")


@query("select doc_id as id, source as path, n_chars::double as score from documents qualify row_number() over (partition by source order by n_chars desc, doc_id) = 1")
def dedup_by_path(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("n_chars").cast("double").alias("score"))
    return C.best_per_path(d, ["path"])


@query("with r as (select l_orderkey, l_linenumber as n, (l_partkey % 97)::bigint as s, (l_partkey % 97 + l_quantity)::bigint as e from lineitem) select x.l_orderkey, x.n as a, y.n as b from r x join r y on x.l_orderkey = y.l_orderkey and x.n < y.n and x.s <= y.e and y.s <= x.e")
def range_overlap_pairs(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 97).alias("start"), (F.col("l_partkey") % 97 + F.col("l_quantity")).cast("long").alias("end"))
    return C.overlap_pairs(r, "l_orderkey", "l_linenumber")


@query()
def greedy_overlap_dedup(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 97).alias("start"), (F.col("l_partkey") % 97 + F.col("l_quantity")).cast("long").alias("end"), F.col("l_extendedprice").alias("score"))
    return C.drop_overlaps(r, ["path"])


_BASE = "case when regexp_matches(url, '^(?i)https?://') then 'docs' else 'code' end"


@query(f"select {_BASE} as base, case when regexp_matches(url, '^(?i)https?://') then 'url' else 'unknown' end as kind, count(*) as n from pages group by all")
def base_inference(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(paths.base_of(F.col("url")).alias("base"), paths.kind_of(F.col("url")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_EXT = ["css", "md", "tsx", "ts", "html", "json", "py", "scss"]
_STEM = ["config", "useThing", "helper", "users-api", "plain"]


@query(f"select case e when 'tsx' then 'typescript' when 'ts' then 'typescript' when 'py' then 'python' when 'md' then 'markdown' else e end as language, count(*) as files from (select ({_EXT!r})[1 + p_size % 8] as e from part) group by all")
def language_counts(spark, sf_dir):
    end = F.get(F.array(*map(F.lit, _EXT)), F.col("p_size") % 8)
    return I.language_counts(table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), "p_partkey", F.lit("."), end).alias("path")))


@query(f"""with f as (select p_partkey, lower(({_STEM!r})[1 + p_partkey % 5] || '.' || ({_EXT!r})[1 + p_size % 8]) as f from part)
select case when contains(f, 'config') or f = 'package.json' then 'config' when regexp_matches(f, '\\.(css|scss|sass|less)$') then 'stylesheet' when f like '%.md' or contains(f, 'readme') then 'documentation'
 when regexp_matches(f, '\\.(jsx|tsx)$') then 'component' when regexp_matches(f, '^use.*\\.(js|ts)$') then 'hook' when regexp_matches(f, 'helper|util|lib') then 'utility' when regexp_matches(f, 'api|service|client') then 'api'
 when regexp_matches(f, '\\.(js|ts)$') then 'script' when f like '%.html' then 'markup' when f like '%.json' then 'data' else 'code' end as type, count(*) as n from f group by all""")
def file_type_counts(spark, sf_dir):
    stem, ext = F.array(*map(F.lit, _STEM)), F.array(*map(F.lit, _EXT))
    p = table(spark, sf_dir, "part").select(F.concat_ws(".", F.get(stem, (F.col("p_partkey") % 5).cast("int")), F.get(ext, F.col("p_size") % 8)).alias("path"))
    return p.groupBy(paths.type_of(F.col("path")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


_EXPROWS = ", ".join(f"({i * 100 + j}, '{t}', '{a}')" for i, (t, alts) in enumerate(EXPANSIONS.items()) for j, a in enumerate(alts[:3]))
_EXPQ = ["How does the architecture of the API flow", "styles and Theme settings", "nothing here", "Database model types"]
_EXPQSQL = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_EXPQ))


@query(f"""with e as (select * from (values {_EXPQSQL}) v(kind, question)), q as (select item_id as qid, question || ' ' || item_id as question from benchmark join e on kind = item_id % {len(_EXPQ)}), t as (select * from (values {_EXPROWS}) v(o, term, alt)),
v as (select qid, question as variant, -1 as o from q union all
      select qid, variant, min(o) as o from (select qid, o, question, substr(question, 1, instr(lower(question), term) - 1) || alt || substr(question, instr(lower(question), term) + length(term)) as variant from q, t where contains(lower(question), term)) where variant <> question group by all)
select qid, variant, row_number() over (partition by qid order by o) as place from v qualify place <= 4""")
def query_expansion(spark, sf_dir):
    kinds = F.array(*map(F.lit, _EXPQ))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.get(kinds, (F.col("item_id") % len(_EXPQ)).cast("int")), F.lit(" "), "item_id").alias("question"))
    return C.variants(asked)


@query()
def porter2_stem(spark, sf_dir):
    i = S.build_index(table(spark, sf_dir, "documents"), "doc_id", "text", stem=True)
    return S.term_counts(i)


@query()
def bm25_search_stemmed(spark, sf_dir):
    return S.bm25_search(S.build_index(table(spark, sf_dir, "documents"), "doc_id", "text", stem=True), _questions(spark, sf_dir), "qid", "text", TOP, stem=True)


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markdown("html").alias("text"))


@query()
def hash_embedding(spark, sf_dir):
    from loomwright.functions.embedding import hash_embedding as embed

    return table(spark, sf_dir, "benchmark").select("item_id", embed("text").alias("vector"))
