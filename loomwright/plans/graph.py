"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright import rules
from loomwright.functions import paths
from loomwright.operators import graph as G
from loomwright.operators import links
from loomwright.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _path(c="url"):
    return F.concat(F.regexp_replace(F.regexp_replace(c, r"^https?://", ""), r"\?.*$", ""), F.lit(".html"))


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', '') || '.html'"


def _nodes(spark, sf_dir):
    """Regions, nations, suppliers and customers as nodes."""
    t = lambda n: table(spark, sf_dir, n)
    one = lambda df, kind, key, label: df.select(F.concat_ws(":", F.lit(kind), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
    return one(t("region"), "region", "r_regionkey", "r_name").unionByName(one(t("nation"), "nation", "n_nationkey", "n_name")).unionByName(one(t("supplier"), "supplier", "s_suppkey", "s_name")).unionByName(one(t("customer"), "customer", "c_custkey", "c_name"))


def _edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    one = lambda df, a, ka, b, kb, kind: df.select(F.concat_ws(":", F.lit(a), F.col(ka)).alias("from_node"), F.concat_ws(":", F.lit(b), F.col(kb)).alias("to_node"), F.lit(kind).alias("kind"))
    return one(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "belongsTo").unionByName(one(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "locatedIn")).unionByName(one(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "locatedIn"))


_NODES = """nodes as (select 'region:' || r_regionkey as id, 'region' as kind, r_name as label from region union all select 'nation:' || n_nationkey, 'nation', n_name from nation
 union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier union all select 'customer:' || c_custkey, 'customer', c_name from customer)"""
_EDGES = """edges as (select 'nation:' || n_nationkey as from_node, 'region:' || n_regionkey as to_node, 'belongsTo' as kind from nation
 union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'locatedIn' from supplier union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'locatedIn' from customer)"""


@query(f"select 'doc:' || path as id, 'doc' as kind, regexp_extract(path, '[^/]*$') as label, path from (select distinct {_PATH} as path from pages)")
def kg_nodes(spark, sf_dir):
    return G.file_nodes(table(spark, sf_dir, "pages").select(_path().alias("path"), F.lit("docs").alias("base"))).drop("base")


_RULE = {r.kind: r.pattern.replace("'", "''") for r in G.RULES if r.language == "html"}


@query(f"""with s as (select page_id, html, list_distinct(regexp_extract_all(html, '{_RULE["htmlSection"]}', 2)) as s, list_distinct(regexp_extract_all(html, '{_RULE["htmlAnchor"]}', 1)) as a from pages)
select page_id, 'htmlSection' as kind, unnest(s) as name from s union all select page_id, 'htmlAnchor', unnest(list_filter(a, lambda x: not list_contains(s, x))) from s
union all select page_id, case when contains(html, '<html') or contains(html, '<!DOCTYPE') or contains(html, '<body') then 'htmlTemplate' else 'htmlPartial' end, 'p' || page_id from s""")
def kg_html_symbols(spark, sf_dir):
    path = F.concat(F.lit("site/p"), "page_id", F.lit(".html"))
    found = G.symbols(table(spark, sf_dir, "pages").select(path.alias("path"), F.lit("html").alias("language"), F.col("html").alias("text")))
    return found.select(F.regexp_extract("path", r"p(-?\d+)\.html$", 1).cast("long").alias("page_id"), "kind", "name")


_CLASS = rules.HTML_CLASSES


@query(f"""select distinct page_id, 'sym:css:*:styleClass:' || name as to_node, 'usesClass' as kind from (
 select page_id, unnest(string_split_regex(trim(c), '\\s+')) as name from (select page_id, unnest(regexp_extract_all(html, '{_CLASS.replace("'", "''")}', 1)) as c from pages)) where name <> ''""")
def kg_uses_class(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    return links.relations(pages).select(F.col("path").cast("long").alias("page_id"), "to_node", "kind")


@query("select page_id, unnest(list_distinct(regexp_extract_all(html, 'href\\s*=\\s*\"([^\"#]+)\"', 1))) as target from pages")
def kg_link_edges(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href\s*=\s*"([^"#]+)"'), F.lit(1)))).alias("target"))


@query("select p_partkey, case when n > 1 then id || '#' || n else id end as id from (select p_partkey, 'sym:part:' || p_brand || ':' || p_type as id, row_number() over (partition by p_brand, p_type order by p_partkey) as n from part)")
def kg_symbol_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(":", F.lit("sym:part"), "p_brand", "p_type").alias("id"))
    return G.disambiguate(p, "p_partkey").select("p_partkey", "id")


#: Layouts of files and the routes that they mean; {} is a part's brand and key.
_ROUTES = ["web/src/app/api/{}/route.ts", "app/api/{}/[id]/route.tsx", "web/app/(group)/api/{}/route.js", "site/pages/api/{}/index.ts", "pages/api/{}.ts", "src/pages/api/{}/index.js", "src/app/api/{}/route.jsx", "src/lib/{}.ts", "web\\app\\api\\{}\\route.ts"]
_WANT = ["/api/{}", "/api/{}/[id]", "/api/{}", "/api/{}", "/api/{}", "/api/{}", "/api/{}", None, "/api/{}"]
_NAME = "lower(replace(p_brand, '#', '-')) || '-' || p_partkey"


def _listed(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _named(spark, sf_dir, layouts):
    """A path for each part, its layout by the part's key."""
    name = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("-"), F.col("p_partkey"))
    layout = F.get(F.array(*map(F.lit, layouts)), (F.col("p_partkey") % len(layouts)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(layout, F.lit("{}"), name).alias("path"))


@query(f"select p_partkey, replace(({_listed(_WANT)})[1 + p_partkey % {len(_WANT)}], '{{}}', {_NAME}) as route from part")
def kg_endpoint_routes(spark, sf_dir):
    return _named(spark, sf_dir, _ROUTES).select("p_partkey", paths.route_of(F.col("path")).alias("route"))


_CANDIDATES = "['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.rs', '.py', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/mod.rs']"


@query(f"""with f as (select 'src/m' || (p_partkey % 20) || '/f' || p_partkey || (['.ts', '.tsx', '/index.ts', '.js'])[1 + p_partkey % 4] as path, p_partkey as k from part),
i as (select f.path, 'm' || ((k + 1) % 20) || '/f' || (k + 1) as stem, '../m' || ((k + 1) % 20) || '/f' || (k + 1) as target from f where k % 4 <> 2),
c as (select path, target, 'src/' || stem || e as to_path, r from (select path, target, stem, unnest({_CANDIDATES}) as e, unnest(range(14)) as r from i))
select c.path, target, min_by('file:' || f.path, r) as to_node from c join f on f.path = to_path group by all""")
def kg_import_resolve(spark, sf_dir):
    k = F.col("p_partkey")
    end = F.get(F.array(*map(F.lit, [".ts", ".tsx", "/index.ts", ".js"])), (k % 4).cast("int"))
    f = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("src/m"), k % 20, F.lit("/f"), k, end).alias("path"))
    imports = f.filter("k % 4 != 2").select("path", F.concat(F.lit("../m"), (F.col("k") + 1) % 20, F.lit("/f"), F.col("k") + 1).alias("target"))
    return G.resolve_imports(imports, f.select(F.concat_ws(":", F.lit("file"), "path").alias("id"), "path"))


@query(f"""with recursive {_NODES}, {_EDGES}, b as (select from_node as node, to_node as next from edges union select to_node, from_node from edges),
w as (select id as root, id as node, 0 as hop from nodes where kind = 'region' union select w.root, b.next, hop + 1 from w join b on b.node = w.node where hop < 2)
select root, node, min(hop) as hop from w group by all""")
def kg_bfs_2hop(spark, sf_dir):
    return G.reach(_edges(spark, sf_dir), _nodes(spark, sf_dir).filter("kind = 'region'"))


@query(f"with {_NODES}, {_EDGES} select e.* from edges e where from_node in (select id from nodes where kind = 'nation' and label like '%A%') or to_node in (select id from nodes where kind = 'nation' and label like '%A%')")
def kg_exhaustive(spark, sf_dir):
    return G.touching(_edges(spark, sf_dir), _nodes(spark, sf_dir).filter("kind = 'nation' and label like '%A%'"))


@query(f"with {_EDGES} select id, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select from_node as id, 1 as o, 0 as i from edges union all select to_node, 0, 1 from edges) group by id")
def kg_degree(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@query(f"with {_NODES}, {_EDGES}, n as (select * from nodes) select 0 as part, '  \"' || id || '\" [label=\"' || label || '\"];' as line from n union all select 1, '  \"' || from_node || '\" -> \"' || to_node || '\" [label=\"' || kind || '\"];' from edges where from_node in (select id from n) and to_node in (select id from n)")
def kg_export_edges(spark, sf_dir):
    return G.dot_lines(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("part", "line")


@query(f"with {_NODES}, {_EDGES} select 1 as part, '  ' || regexp_replace(from_node, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || kind || '| ' || regexp_replace(to_node, '[^A-Za-z0-9_]', '_', 'g') as line from edges")
def kg_export_mermaid(spark, sf_dir):
    return G.mermaid_lines(_nodes(spark, sf_dir), _edges(spark, sf_dir)).filter("part = 1").select("part", "line")


#: Layouts of files and their labels.
_LABELS = [("src/app/page.tsx", "page.tsx"), ("src/{}/page.tsx", "{}/page.tsx"), ("web/{}/components/index.ts", "{}/index.ts"), ("a/{}.py", "{}.py"), ("crates/{}/src/lib.rs", "{}/lib.rs"), ("main.rs", "main.rs"), ("{}/lib/app/mod.rs", "mod.rs")]


@query(f"select p_partkey, replace(({_listed(w for _, w in _LABELS)})[1 + p_partkey % {len(_LABELS)}], '{{}}', {_NAME}) as label from part")
def kg_labels(spark, sf_dir):
    return _named(spark, sf_dir, [p for p, _ in _LABELS]).select("p_partkey", paths.label_of(F.col("path")).alias("label"))


@query(f"with {_NODES}, {_EDGES} select kind, count(*) as n from (select kind from nodes union all select kind from edges) group by kind")
def kg_counts(spark, sf_dir):
    return G.counts(_nodes(spark, sf_dir), _edges(spark, sf_dir))


#: A source file for each part, in one of four languages, that imports the next part's, calls and defines.
_KEY = "p_partkey"
_ENDS = [".ts", ".jsx", ".py", ".rs"]
_SOURCES = [
    "import {{ a }} from './f{n}'\nconst b = require(\"lib{k}\")\nfunction run{k}() {{ go{m}(1); user.save(); console.log(2) }}\n",
    "import './f{n}'\nexport const Card{k} = (p) => <i className=\"x{m} y\"/>\nlet z = clean(3)\n",
    "import os{k}\nfrom mod{n}.sub import x\nclass A{k}(B):\n    def m(self): return work{m}(self)\n",
    "use crate::part{n}::x;\nmod inner{k};\npub struct S{k};\nfn f{k}(a: u8) {{ Shape::area(a); }}\n",
]


def _fill(line: str, as_sql: bool):
    """A line with a part's key, the next key and the key modulo 7 filled in, as a column or as SQL."""
    import re

    bits = re.split(r"(\{\w\})", line.replace("{{", "\0").replace("}}", "\1"))
    bits = [b.replace("\0", "{").replace("\1", "}") for b in bits if b]
    value = {"{k}": _KEY, "{n}": f"({_KEY} + 1)", "{m}": f"({_KEY} % 7)"}
    if as_sql:
        return " || ".join(value[b] + "::varchar" if b in value else "'" + b.replace("'", "''") + "'" for b in bits)
    return F.concat(*[F.expr(value[b]).cast("string") if b in value else F.lit(b) for b in bits])


def _source_files(spark, sf_dir):
    kind = F.col(_KEY) % 4
    end, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (e, line) in enumerate(zip(_ENDS, _SOURCES)):
        end, text = F.when(kind == i, e).otherwise(end), F.when(kind == i, _fill(line, False)).otherwise(text)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), _KEY, end).alias("path"), F.lit("code").alias("base"), text.alias("text"))


_FILES = "f as (select p_partkey as k, 'src/f' || p_partkey || (" + _listed(_ENDS) + ")[1 + p_partkey % 4] as path, case p_partkey % 4 " + " ".join(f"when {i} then {_fill(line, True)}" for i, line in enumerate(_SOURCES)) + " end as text from part)"
_EITHER = "list_transform(list_zip(regexp_extract_all(text, '{0}', 1), regexp_extract_all(text, '{0}', 2)), lambda x: case when x[1] <> '' then x[1] else x[2] end)"
_IMPORTED = "case k % 4 " + " ".join(f"when {i} then " + _EITHER.format(list(rules.IMPORT_PATTERNS.values())[j].replace("'", "''")) for i, j in enumerate([0, 0, 2, 1])) + " end"


@query(f"""with {_FILES}, i as (select path, unnest({_IMPORTED}) as target from f), c as (select path, target, 'src/' || substr(target, 3) || e as to_path, r from (select path, target, unnest({_CANDIDATES}) as e, unnest(range(14)) as r from i where target like './%')),
t as (select c.path, target, min_by('file:' || f.path, r) as to_node from c join f on f.path = to_path group by all)
select i.path, i.target, t.to_node from i left join t using (path, target)""")
def kg_imports_from_text(spark, sf_dir):
    files = _source_files(spark, sf_dir)
    found = links.imports(files).select("path", "target")
    known = files.select(F.concat_ws(":", F.lit("file"), "path").alias("id"), "path")
    return found.join(G.resolve_imports(found, known).hint("merge"), ["path", "target"], "left")


@query(f"""with {_FILES}, calls as (
 select path, 0 as t, unnest(['sym:js:*:function:run' || k, 'sym:js:*:function:go' || k % 7, 'sym:js:*:function:save', 'sym:js:*:method:user#save']) as to_node from f where k % 4 = 0
 union all select path, 0, 'sym:js:*:function:clean' from f where k % 4 = 1
 union all select path, 0, unnest(['sym:py:*:function:A' || k, 'sym:py:*:function:m', 'sym:py:*:function:work' || k % 7]) from f where k % 4 = 2
 union all select path, 0, unnest(['sym:rs:*:function:f' || k, 'sym:rs:*:function:area', 'sym:rs:*:function:Shape::area']) from f where k % 4 = 3),
defs as (select path, unnest(case k % 4 when 0 then ['ts:' || path || ':function:run' || k] when 1 then ['js:' || path || ':reactComponent:Card' || k]
 when 2 then ['py:' || path || ':class:A' || k, 'py:' || path || ':method:m'] else ['rs:' || path || ':struct:S' || k, 'rs:' || path || ':function:f' || k, 'rs:' || path || ':module:inner' || k] end) as s from f),
uses as (select path, unnest(['sym:css:*:styleClass:x' || k % 7, 'sym:css:*:styleClass:y']) as to_node from f where k % 4 = 1)
select 'file:' || path as from_node, to_node, 'calls' as kind from calls union all select 'file:' || path, 'sym:' || s, 'defines' from defs union all select 'file:' || path, to_node, 'usesClass' from uses
union all select 'file:' || f.path, 'file:' || g.path, 'imports' from f join f g on g.k = f.k + 1 where f.k % 4 < 2""")
def kg_sync_edges(spark, sf_dir):
    return links.sync(_source_files(spark, sf_dir)).edges.select("from_node", "to_node", "kind")


@query(f"""with {_FILES} select 'file:' || path as id, 'file' as kind from f union all select 'sym:' || s, split_part(s, ':', 3) from (select unnest(case k % 4 when 0 then ['ts:' || path || ':function:run' || k] when 1 then ['js:' || path || ':reactComponent:Card' || k]
 when 2 then ['py:' || path || ':class:A' || k, 'py:' || path || ':method:m'] else ['rs:' || path || ':struct:S' || k, 'rs:' || path || ':function:f' || k, 'rs:' || path || ':module:inner' || k] end) as s from f)""")
def kg_sync_nodes(spark, sf_dir):
    return links.sync(_source_files(spark, sf_dir)).nodes.select("id", "kind")


@query(f"with {_NODES} select id, kind, label from nodes where kind in ('nation', 'supplier') and contains(lower(label), 'n_1')")
def kg_list_nodes(spark, sf_dir):
    return G.list_nodes(_nodes(spark, sf_dir), kinds=["nation", "supplier"], label="N_1")


@query(f"with {_EDGES} select * from edges where kind = 'locatedIn' and (from_node = 'nation:7' or to_node = 'nation:7')")
def kg_list_edges(spark, sf_dir):
    return G.list_edges(_edges(spark, sf_dir), kinds=["locatedIn"], node="nation:7")


def _numbered(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("id", F.concat_ws("|", "from_node", "to_node", "kind"))


@query(f"""with recursive {_NODES}, {_EDGES}, o as (select from_node || '|' || to_node || '|' || kind as id, from_node, to_node, row_number() over (order by from_node || '|' || to_node || '|' || kind) as n from edges where from_node in (select id from nodes) and to_node in (select id from nodes)),
w as (select 0::bigint as n, []::varchar[] as held, 0 as taken, '' as id union all
 select o.n, case when fits then list_distinct(held || [from_node, to_node]) else held end, taken + fits::int, case when fits then o.id else '' end
 from (select o.n, o.id, o.from_node, o.to_node, w.held, w.taken, w.taken < {G.MAX_EDGES} and len(list_distinct(w.held || [o.from_node, o.to_node])) <= {G.MAX_NODES} as fits from w join o on o.n = w.n + 1) o)
select id from w where id <> ''""")
def kg_budgeted_edges(spark, sf_dir):
    edges = _numbered(spark, sf_dir)
    return spark.createDataFrame([(i,) for i in G.budgeted(_nodes(spark, sf_dir), edges, G.MAX_NODES, G.MAX_EDGES)], "id string")


@query(f"""with {_NODES}, {_EDGES}, b as (select from_node as node, to_node as next from edges union select to_node, from_node from edges), r as (select id as root, id as node, 0 as hop from nodes where kind = 'region'),
h1 as (select distinct root, next as node, 1 as hop from r join b using (node) where next <> root), k1 as (select * from h1 qualify row_number() over (partition by root order by node) < {G.MAX_NODES}), s1 as (select * from r union all select * from k1),
h2 as (select distinct root, next as node, 2 as hop from k1 join b using (node) where (root, next) not in (select (root, node) from s1))
select * from (select * from s1 union all select * from h2) qualify row_number() over (partition by root order by hop, node) <= {G.MAX_NODES}""")
def kg_bounded_walk(spark, sf_dir):
    return G.bounded(_edges(spark, sf_dir), _nodes(spark, sf_dir).filter("kind = 'region'"))


@query(f"""with {_NODES}, {_EDGES}, n as (select * from nodes order by id limit 100), e as (select * from edges where from_node in (select id from n) and to_node in (select id from n) order by from_node, to_node, kind limit 50)
select 0 as part, '{{"id":"' || id || '","kind":"' || kind || '","label":"' || label || '"}}' as line from n union all select 1, '{{"from":"' || from_node || '","to":"' || to_node || '","kind":"' || kind || '"}}' from e""")
def kg_export_json(spark, sf_dir):
    """An export with caps: the feature is the limit."""
    return G.json_lines(*G.capped(_nodes(spark, sf_dir), _edges(spark, sf_dir), 100, 50)).select("part", "line")


@query()
def budgeted_export(spark, sf_dir):
    """Walks within node and edge budgets from each region: the neighbourhood comes from `reach`, the order of the walk from one group for each root."""
    import pandas as pd

    edges = _edges(spark, sf_dir)
    near = G.reach(edges, _nodes(spark, sf_dir).filter("kind = 'region'"))
    own = near.join(edges, near.node == edges.from_node).select("root", G.edge_id(F.col("from_node"), F.col("to_node"), F.col("kind")).alias("id"), "from_node", "to_node")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, used = G.capped_walk(pdf, pdf.root.iloc[0])
        return pd.DataFrame({"root": pdf.root.iloc[0], "part": ["node"] * len(nodes) + ["edge"] * len(used), "id": nodes + used})

    return own.groupBy("root").applyInPandas(walk, "root string, part string, id string")
