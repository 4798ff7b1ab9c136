"""Queries of logs, releases, staging, memory, snapshots and inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import history as H
from loomwright.operators import inventory as I
from loomwright.operators import memory as M
from loomwright.operators import report as R
from loomwright.operators import staging as V
from loomwright.operators import workspace as K
from loomwright.rules import COMMIT_KINDS, LOCK_FILES
from loomwright.sources.snapshots import delete, upsert
from loomwright.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark, sf_dir):
    """Events as log entries: the type is the kind, the user's parity gives the bases (none for every fifth)."""
    e = table(spark, sf_dir, "events")
    base = F.when(F.col("user_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("user_id") % 2 == 0, F.array(F.lit("code"))).otherwise(F.array(F.lit("docs"), F.lit("memory")))
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("kind"), base.alias("bases"), "value")


_LOG = "e as (select event_id as id, ts as timestamp, event_type as kind, value, case when user_id % 5 = 0 then [] when user_id % 2 = 0 then ['code'] else ['docs', 'memory'] end as bases from events)"
_SPAN = "timestamp between timestamp '2024-01-05' and timestamp '2024-01-20'"


@query(f"with {_LOG} select id, kind from e where kind in ('signup', 'purchase') and (len(bases) = 0 or list_has_any(bases, ['code'])) and {_SPAN} order by timestamp desc, id limit 100")
def log_filter_newest(spark, sf_dir):
    found = H.log_filter(_log(spark, sf_dir), ["signup", "purchase"], ["code"], "2024-01-05", "2024-01-20")
    return H.newest(found, 100, "id").select("id", "kind")


@query(f"with {_LOG} select id, kind from e where list_has_any(bases, ['code']) and {_SPAN}")
def ask_log_filter(spark, sf_dir):
    return H.log_filter(_log(spark, sf_dir), None, ["code"], "2024-01-05", "2024-01-20", baseless=False).select("id", "kind")


@query(f"""with {_LOG}, s as (select base, count(*) as n, round(sum(value), 4) as total from (select unnest(bases) as base, value from e) group by base)
select id, base, n, total from (select id, unnest(bases) as base from e) join s using (base)""")
def log_enriched(spark, sf_dir):
    e = _log(spark, sf_dir)
    stats = e.select(F.explode("bases").alias("base"), "value").groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return H.enrich(e, stats, "id").select("id", F.explode("base_stats").alias("s")).select("id", "s.base", "s.n", "s.total")


@query("select event_id as id, event_type as kind, json_extract_string(props, '$.k')::int as count from events")
def log_view(spark, sf_dir):
    op = F.array(F.from_json(F.concat(F.lit('{"type":"'), "event_type", F.lit('","count":'), F.get_json_object("props", "$.k"), F.lit("}")), "type string, bases array<string>, base string, count int"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("main").alias("branch"), F.col("ts").alias("timestamp"), F.lit("").alias("message"), op.alias("operations"))
    return H.log_view(e).select("id", "kind", F.get_json_object("meta", "$.count").cast("int").alias("count"))


def _timeline(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("rev"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("id"), F.when(F.col("event_id") > 7, F.concat(F.lit("rev"), F.lpad((F.col("event_id") - 7).cast("string"), 8, "0"))).alias("parent_id"), F.col("ts").alias("timestamp"), "event_id", "event_type", "user_id")


@query("""with recursive t as (select 'rev' || lpad(event_id::varchar, 8, '0') as id, case when event_id > 7 then 'rev' || lpad((event_id - 7)::varchar, 8, '0') end as parent_id, event_id, event_type from events),
w as (select id as root, id, 0 as step from t where event_type = 'signup' union all select root, t.parent_id, step + 1 from w join t using (id) where step < 5 and t.parent_id is not null)
select root, id, step from w""")
def revision_ancestor(spark, sf_dir):
    t = _timeline(spark, sf_dir)
    return H.ancestors(t, t.filter("event_type = 'signup'"), 5)


@query("with t as (select 'rev' || lpad(event_id::varchar, 8, '0') as id from events) select left(id, 9) as prefix, count(*) as n, case when count(*) = 1 then min(id) end as id from t group by all")
def revision_prefix(spark, sf_dir):
    t = _timeline(spark, sf_dir)
    return t.groupBy(F.substring("id", 1, 9).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 1, F.min("id")).alias("id"))


_KIND = "case event_type when 'signup' then 'feat' when 'purchase' then 'fix' when 'error' then 'perf' when 'view' then 'oddity' else 'docs' end"


def _commits(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "feat").when(F.col("event_type") == "purchase", "fix").when(F.col("event_type") == "error", "perf").when(F.col("event_type") == "view", "oddity").otherwise("docs")
    scope = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("(s"), F.col("user_id") % 10, F.lit(")"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", F.concat(kind, scope, F.when(F.col("user_id") % 7 == 0, "!").otherwise(""), F.lit(": change "), "event_id").alias("message"))


_PLACES = "case kind " + " ".join(f"when '{k}' then {i + 1}" for i, k in enumerate(COMMIT_KINDS)) + " end"


@query(f"""with c as (select event_id, {_KIND} as k, user_id from events),
p as (select event_id, case when k = 'oddity' then 'other' else k end as kind, k <> 'oddity' and user_id % 7 = 0 as breaking,
  case when k = 'oddity' then k || case when user_id % 3 = 0 then '(s' || user_id % 10 || ')' else '' end || case when user_id % 7 = 0 then '!' else '' end || ': change ' || event_id
       else case when user_id % 3 = 0 then '**s' || user_id % 10 || '**: ' else '' end || 'change ' || event_id end as line from c)
select kind, {_PLACES}::bigint as place, count(*) as n, count(*) filter (breaking) as n_breaking, string_agg(line, chr(10) order by event_id) as lines from p group by kind""")
def release_groups(spark, sf_dir):
    return H.release_groups(_commits(spark, sf_dir), "event_id").withColumn("lines", F.array_join("lines", "\n")).withColumn("place", F.col("place").cast("long"))


@query("select event_id from (select event_id, row_number() over (order by ts, event_id) as n from events) where n > 100 and n <= 900")
def release_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return H.between(e.orderBy("ts", "event_id").limit(900).withColumn("o", F.row_number().over(_all_by("ts", "event_id"))), 100, 900, "o").select("event_id")


def _all_by(*cols):
    from pyspark.sql import Window

    return Window.orderBy(*cols)  # over the 900 rows that the range is about


@query("select o_orderkey, case when o_orderkey % 11 = 0 then 'new' when o_orderkey % 7 = 0 then 'modified' when o_orderkey % 5 = 0 then 'unchanged' else 'unchanged' end as change from orders")
def change_detection(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = o.select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").cast("long").alias("size"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    old = now.filter("path % 11 != 0").select("path", F.when(F.col("path") % 5 == 0, F.lit(None)).otherwise(F.col("size")).alias("size"), F.when(F.col("path") % 7 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return V.changes(now, old).select(F.col("path").alias("o_orderkey"), "change")


_STATUS = "case o_orderstatus when 'F' then 'indexed' when 'O' then 'pending' else 'failed' end"


def _pending(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), F.lit("main").alias("branch"), F.col("o_orderpriority").alias("base"), F.concat(F.lit("u"), F.col("o_custkey")).alias("uri"), status.alias("status"))


@query(f"with p as (select o_orderkey as id, o_orderpriority as base, 'u' || o_custkey as uri, {_STATUS} as status from orders), f as (select o_orderkey as id, o_orderpriority as base, 'u' || (o_custkey + 1) as uri from orders) select id from f where not exists (select 1 from p where p.base = f.base and p.uri = f.uri and status in ('pending', 'processing', 'failed'))")
def pending_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fresh = o.select(F.col("o_orderkey").alias("id"), F.lit("main").alias("branch"), F.col("o_orderpriority").alias("base"), F.concat(F.lit("u"), F.col("o_custkey") + 1).alias("uri"))
    return V.not_staged(fresh, _pending(spark, sf_dir)).select("id")


@query(f"with p as (select o_orderpriority as base, {_STATUS} as status from orders) select base, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'indexed') as indexed, count(*) filter (status = 'failed') as failed from p group by base")
def staging_summary(spark, sf_dir):
    return V.summary(_pending(spark, sf_dir), ["base"])


@query("select doc_id, case when strlen(text) > 5000 then 'too large' when len(text) - len(replace(text, chr(10), '')) + 1 > 12 then 'too many lines' when trim(text) = '' then 'empty' end as reason from documents")
def source_validation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.invalid(F.col("text"), 5000, 12).alias("reason"))


@query("select role, count(*) as entries, sum(strlen(coalesce(text, '')))::bigint as bytes, sum(ceil(strlen(coalesce(text, '')) / 4.0))::bigint as tokens from conversations group by role")
def memory_metrics(spark, sf_dir):
    return M.metrics(table(spark, sf_dir, "conversations"), ["role"])


def _memory(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    order = F.col("conv_id") * 1000 + F.col("turn")
    return c.select("conv_id", "turn", F.col("role").alias("key"), "text", order.alias("o"), F.array(F.when(F.col("conv_id") % 9 == 0, "old").otherwise("new")).alias("tags"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("conv_id") % 60).cast("int"))).alias("created_at"))


def _memory_rows(marked):
    return marked.select("conv_id", "turn", "reason")


_MEM = "m as (select conv_id, turn, role, coalesce(text, '') as text, conv_id * 1000 + turn as o from conversations)"


@query(f"with {_MEM} select conv_id, turn, case when conv_id % 9 = 0 then 'tag' end as reason from m")
def prune_obsolete_tag(spark, sf_dir):
    return _memory_rows(M.mark_pruned(_memory(spark, sf_dir), M.Policy(obsolete_tags=["old"]), "key", "o"))


@query(f"with {_MEM} select conv_id, turn, case when timestamp '2024-01-01' + to_days((conv_id % 60)::int) < timestamp '2024-03-01' - interval 30 day then 'age' end as reason from m")
def prune_by_age(spark, sf_dir):
    return _memory_rows(M.mark_pruned(_memory(spark, sf_dir), M.Policy(max_age_days=30), "key", "o", "2024-03-01"))


@query(f"with {_MEM} select conv_id, turn, case when row_number() over (partition by role order by o desc) > 100 then 'entries' end as reason from m")
def prune_max_entries(spark, sf_dir):
    return _memory_rows(M.mark_pruned(_memory(spark, sf_dir), M.Policy(max_entries=100), "key", "o"))


@query(f"""with {_MEM}, a as (select *, case when conv_id % 9 = 0 then 'tag' end as r from m),
b as (select *, coalesce(r, case when row_number() over (partition by role, r is null order by o desc) > 150 then 'entries' end) as r2 from a)
select conv_id, turn, coalesce(r2, case when sum(ceil(strlen(text) / 4.0)) over (partition by role, r2 is null order by o desc rows unbounded preceding) > 4000 then 'tokens' end) as reason from b""")
def prune_token_budget(spark, sf_dir):
    return _memory_rows(M.mark_pruned(_memory(spark, sf_dir), M.Policy(["old"], None, 150, 4000), "key", "o"))


@query("select c_custkey, c_name, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer union all select c_custkey + 1000000, c_name, c_acctbal + 1 from customer where c_custkey % 3 = 0 and c_custkey % 2 = 0")
def index_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    third = c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return upsert(c, third.unionByName(third.filter("c_custkey % 2 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)), "c_custkey")


@query("select c_custkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def index_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return delete(c, table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey").select("c_custkey")


@query("select p_partkey as base, case when p_size % 5 = 4 then 'INDEX_MISSING' when p_size % 5 = 3 then 'MISSING_MODEL' when p_size % 5 = 2 then 'NEEDS_REINDEX' else 'OK' end as state from part")
def health_state(spark, sf_dir):
    k = F.col("p_size") % 5
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("base"), F.lit(3).alias("chunks"), F.when(k == 4, 0).otherwise(3).alias("vectors"), F.when(k != 3, "m").alias("model"), F.when(k == 2, "n").otherwise("m").alias("wanted_model"), F.lit(64).alias("dim"), F.lit(64).alias("wanted_dim"))
    return V.health(b)


@query("select p_brand, p_partkey, p_size from part qualify row_number() over (partition by p_brand order by p_size, p_partkey) = 1")
def tech_first_wins(spark, sf_dir):
    return I.first_by(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", ["p_size", "p_partkey"])


_LOCKS = ", ".join(f"({i}, '{f}', '{m}', '{e}', {p})" for i, (f, m, e, p) in enumerate(LOCK_FILES))


@query(f"with l as (select * from (values {_LOCKS}) v(i, file, manager, ecosystem, place)), f as (select l.* from part join l on i = p_partkey % {len(LOCK_FILES)} where p_size % 4 <> 0) select ecosystem, min_by(manager, place) as manager from f group by ecosystem")
def manager_priority(spark, sf_dir):
    names = F.array(*[F.lit(f) for f, *_ in LOCK_FILES])
    files = table(spark, sf_dir, "part").filter("p_size % 4 != 0").select(F.concat(F.lit("a/"), F.get(names, (F.col("p_partkey") % len(LOCK_FILES)).cast("int"))).alias("path"))
    return I.managers(files)


_TURNS = "c as (select conv_id || '-' || turn as id, role as base, 'conv' || conv_id as file_path, conv_id % 3 as k, turn from conversations)"


def _turns(spark, sf_dir):
    """Turns as chunks: the role is the base, the conversation the file; two of three have a vector."""
    t = table(spark, sf_dir, "conversations")
    chunks = t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("base"), F.concat(F.lit("conv"), "conv_id").alias("file_path"), (F.col("conv_id") % 3).alias("k"))
    return chunks.drop("k"), chunks.filter("k < 2").select("id", "base")


@query(f"with {_TURNS} select base, count(*) as chunks, count(distinct file_path) as files, count(*) filter (k < 2) as vectors from c group by base")
def base_stats(spark, sf_dir):
    return K.base_stats(*_turns(spark, sf_dir))


@query(f"with {_TURNS}, b as (select base, count(*) as chunks, count(distinct file_path) as files, count(*) filter (k < 2) as vectors from c group by base) select sum(chunks)::bigint as chunks, sum(files)::bigint as files, sum(vectors)::bigint as vectors from b")
def base_totals(spark, sf_dir):
    return K.totals(K.base_stats(*_turns(spark, sf_dir)))


_COMMITS = "t as (select 'rev' || event_id as id, list_transform(range(event_id % 3 + 1), lambda i: {'type': case when (event_id + i) % 4 = 0 then 'reindex' else 'commit' end, 'bases': case when i = 0 then ['code', 'docs'] else ['docs'] end, 'n': (event_id + i) % 100}) as o from events)"


@query(f"with {_COMMITS}, e as (select id, unnest(o) as o, generate_subscripts(o, 1) as pos from t), b as (select id, pos, o.n as n, unnest(o.bases) as base from e where o.type = 'commit') select id, base, max_by(n, pos)::int as sources_added from b group by all")
def show_impact(spark, sf_dir):
    """Events as revisions of one to three operations."""
    e = F.col("event_id")
    op = lambda i: F.struct(F.when((e + i) % 4 == 0, "reindex").otherwise("commit").alias("type"), F.when(i == 0, F.array(F.lit("code"), F.lit("docs"))).otherwise(F.array(F.lit("docs"))).alias("bases"), ((e + i) % 100).cast("int").alias("source_count"))
    t = table(spark, sf_dir, "events").select(F.concat(F.lit("rev"), e).alias("id"), F.transform(F.sequence(F.lit(0).cast("long"), e % 3), op).alias("operations"))
    return R.impact(t)


_DOC = "d as (select doc_id::varchar as id, case doc_id % 3 when 0 then 'memory' when 1 then 'code' else 'docs' end as base, case when doc_id % 3 = 0 then 'memory://' else 'f/' end || lpad(doc_id::varchar, 8, '0') as file_path, 'r' || doc_id % 5 as revision_id, text, case when doc_id % 2 = 0 then '{\"title\": \"t' || doc_id || '\"}' end as extra from documents)"


def _doc_chunks(spark, sf_dir):
    """Documents as chunks of five revisions; every third is a memory, half of them with a title."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    base = F.when(k % 3 == 0, "memory").when(k % 3 == 1, "code").otherwise("docs")
    path = F.concat(F.when(k % 3 == 0, "memory://").otherwise("f/"), F.lpad(k.cast("string"), 8, "0"))
    return d.select(k.cast("string").alias("id"), base.alias("base"), path.alias("file_path"), F.concat(F.lit("r"), k % 5).alias("revision_id"), "text", F.when(k % 2 == 0, F.concat(F.lit('{"title": "t'), k, F.lit('"}'))).alias("extra"))


@query(f"with {_DOC} select base, regexp_replace(file_path, '^memory://', '') as path from d where revision_id = 'r3' order by list_position(['code', 'docs', 'memory'], base), file_path limit {R.MAX_SOURCES}")
def show_sources(spark, sf_dir):
    """The first sources of a revision: the limit is the feature."""
    return R.samples(_doc_chunks(spark, sf_dir), "r3")[0]


@query(f"with {_DOC} select id, coalesce(json_extract_string(extra, '$.title'), case when length(text) <= {R.SUMMARY} then text else left(text, {R.SUMMARY - 3}) || '...' end, file_path) as summary from d where revision_id = 'r3' and base = 'memory' order by file_path, id limit {R.MAX_MEMORIES}")
def show_memories(spark, sf_dir):
    """The first memories of a revision: the limit is the feature."""
    return R.samples(_doc_chunks(spark, sf_dir), "r3")[1]


@query("""with o as (select o_orderkey as k, 'src/o' || o_orderkey as path, o_orderkey % 50 as size, o_orderkey % 7 as mtime from orders),
n as (select path, case when k % 10 = 0 then size + 1 else size end as size, mtime, k from o where k % 6 <> 0), p as (select path, k from o where k % 20 = 0)
select path, 'modified' as state from n where k % 10 = 0 and path not in (select path from p) union all select path, 'staged' from p""")
def working_tree(spark, sf_dir):
    """Orders as indexed files, some of them gone, some changed, some staged."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("src/o"), "o_orderkey").alias("path"), (F.col("o_orderkey") % 50).alias("size"), (F.col("o_orderkey") % 7).alias("mtime"))
    now = o.filter("k % 6 != 0").select("path", F.when(F.col("k") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")
    pending = o.filter("k % 20 = 0").select(F.col("path").alias("uri"), F.lit("pending").alias("status"), F.lit("modified").alias("change_type"))
    staged, modified = R.working_tree(now, o.select("path", "size", "mtime"), pending)
    return modified.select("path", F.lit("modified").alias("state")).unionByName(staged.select("path", F.lit("staged").alias("state")))


@query("""select l_orderkey || '-' || l_linenumber as id, case when l_linenumber % 3 = 0 then 'kept ' || l_partkey when l_orderkey % 5 = 0 then null when l_linenumber > 3 then 'a' || l_orderkey || chr(10) || 'b' || chr(10) || 'c' || chr(10) else array_to_string((string_split('a' || l_orderkey || chr(10) || 'b' || chr(10) || 'c', chr(10)))[l_linenumber : l_linenumber + 1], chr(10)) end as text,
 case when l_linenumber % 3 <> 0 and l_orderkey % 5 = 0 then 'file not found' end as error from lineitem""")
def stored_text(spark, sf_dir):
    """Order lines as chunks of their order's file, which has three lines and is gone for every fifth; a third have their text stored."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    path = lambda c: F.concat(F.lit("f"), c)
    chunks = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), path(F.col("l_orderkey")).alias("file_path"), k.cast("int").alias("start_line"), (k + 1).cast("int").alias("end_line"), F.when(k % 3 == 0, F.concat(F.lit("kept "), "l_partkey")).alias("text"))
    files = table(spark, sf_dir, "orders").filter("o_orderkey % 5 != 0").select(path(F.col("o_orderkey")).alias("path"), F.concat(F.lit("a"), "o_orderkey", F.lit("\nb\nc\n")).alias("text"))
    return K.stored_text(chunks, files)


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1")
def latest_per_path(spark, sf_dir):
    return H.last_per(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("select user_id, count(*) as n, round(sum(value), 4) as total, max(ts) as last from events where event_type <> 'error' group by user_id")
def ask_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type != 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last"))


_MANIFESTS = ['{"dependencies": {"react": "^18"}, "devDependencies": {"vite": "5"}}', '[dependencies]\nserde = "1"\n[dev-dependencies]\ntempfile = { version = "3" }\n', "flask>=2 # web\npytest==8\n", "module m\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n)\n"]
_NAMES = ["package.json", "Cargo.toml", "requirements.txt", "go.mod"]


@query()
def manifest_dependencies(spark, sf_dir):
    k = (F.col("p_partkey") % 4).cast("int")
    m = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit("/"), F.get(F.array(*map(F.lit, _NAMES)), k)).alias("path"), F.get(F.array(*map(F.lit, _MANIFESTS)), k).alias("text"))
    return I.dependencies(m)
