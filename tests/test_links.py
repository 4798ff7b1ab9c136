import json
import random

from loomwright.operators import graph, links
from loomwright.plans.graph import kg_imports_from_text
from loomwright.rules import IMPORT_ENDINGS

FILES = [
    ("src/index.ts", "import { a } from './utils';\nimport './config'\nconst r = require(\"react\");\nrun(); user.save(1); console.log(2); JSON.parse(x)\nfunction go() { go2() }\nfunction go() {}\n"),
    ("src/utils.ts", "export const helper = (a) => a\nexport interface I {}\ntype Alias = string\nexport class C {}\n"),
    ("src/config.ts", None),
    ("src/card.tsx", "import React from 'react'\nexport function Card() { return (<div className=\"p-4 m-2\"><i className={`a ${b} c`}/><b className={cn('q', x)}/></div>) }\nimport { Button, Menu as M } from \"@/components/ui/button\""),
    ("web/src/app/api/users/route.ts", "export async function GET() {}\nexport const POST = () => 1"),
    ("app.module.ts", "@NgModule({declarations: [Foo,\n Bar]}) export class AppModule {}\nconst routes: Routes = [{ path: 'home', component: Foo }, { path: '', component: Foo }]"),
    ("m.py", "import os\nfrom a.b import c\nclass A(B):\n    def __str__(self): pass\n    def f(self): return work(self)\nLIMIT = 3\nT = 1\nos.path(1); db.query(2); print(3)\n"),
    ("x.rs", "use crate::a::b;\nmod tests;\npub(crate) async fn go<T>(a: T) { Shape::area(a); Vec::new(); x.send2::<T>(1) }\npub struct s;\nstatic mut N: u8 = 1;"),
    ("g.go", "func (s *S) Run(a int) {}\ntype S struct {}\ntype s2 struct {}\ntype Names []string\ntype Id string\nconst Max = 3\n"),
    ("d.c", "static int  add(int a) {\n return 1; }\nint main(void) { if (x) { } }\n#define MAX_N 3\n#define lower 3\ntypedef unsigned int u32;\nstruct P { int a; };\n"),
    ("s.css", ".a:hover { --main-color: red } #top { } .b.c { } @tailwind base;"),
    ("p.html", "<html><section id=\"s1\" class='a b'><p id='x1'></p></section>"),
    ("_part.html", "<p>1</p>"),
]


def frame(spark, rows):
    return spark.createDataFrame([(p, "code", t) for p, t in rows], "path string, base string, text string")


def plan(df):
    """The physical plan; of a frame that was collected, the one that ran."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_symbols_of_languages(spark):
    g = links.sync(frame(spark, FILES))
    got = {r.id for r in g.nodes.filter("id like 'sym:%'").collect()}
    assert got == {
        "sym:ts:src/index.ts:function:go", "sym:ts:src/index.ts:function:go#2", "sym:ts:src/utils.ts:function:helper", "sym:ts:src/utils.ts:interface:I", "sym:ts:src/utils.ts:type:Alias", "sym:ts:src/utils.ts:class:C",
        "sym:ts:src/card.tsx:reactComponent:Card", "sym:ts:src/card.tsx:uiComponent:Button", "sym:ts:web/src/app/api/users/route.ts:function:GET", "sym:ts:web/src/app/api/users/route.ts:function:POST",
        "sym:ts:app.module.ts:class:AppModule", "sym:ts:app.module.ts:ngModule:AppModule", "sym:ts:app.module.ts:ngRoute:/home", "sym:py:m.py:class:A", "sym:py:m.py:method:f", "sym:py:m.py:constant:LIMIT",
        "sym:rs:x.rs:function:go", "sym:rs:x.rs:struct:s", "sym:rs:x.rs:constant:N", "sym:go:g.go:function:Run", "sym:go:g.go:struct:S", "sym:go:g.go:type:Id", "sym:go:g.go:constant:Max",
        "sym:c:d.c:function:add", "sym:c:d.c:function:main", "sym:c:d.c:macro:MAX_N", "sym:c:d.c:typedef:u32", "sym:c:d.c:struct:P",
        "sym:css:s.css:styleClass:a", "sym:css:s.css:styleClass:b", "sym:css:s.css:styleClass:c", "sym:css:s.css:styleId:top", "sym:css:s.css:cssVariable:main-color", "sym:css:s.css:tailwindDirective:base",
        "sym:html:p.html:htmlTemplate:p", "sym:html:p.html:htmlSection:s1", "sym:html:p.html:htmlAnchor:x1", "sym:html:_part.html:htmlPartial:_part",
    }


def test_edges(spark):
    g = links.sync(frame(spark, FILES))
    e = {(r.from_node, r.to_node, r.kind) for r in g.edges.collect()}
    to = lambda kind, start: {b for a, b, k in e if k == kind and a == start}
    assert to("imports", "file:src/index.ts") == {"file:src/utils.ts", "file:src/config.ts"}
    assert to("definesEndpoint", "file:web/src/app/api/users/route.ts") == {"endpoint:GET:/api/users", "endpoint:POST:/api/users"}
    assert to("calls", "file:src/index.ts") == {f"sym:js:*:{x}" for x in ("function:run", "function:save", "function:go", "function:go2", "method:user#save")}
    assert to("calls", "file:m.py") == {f"sym:py:*:{x}" for x in ("function:A", "function:f", "function:work", "function:path", "function:query", "method:db#query")}
    assert to("calls", "file:x.rs") >= {"sym:rs:*:function:Shape::area", "sym:rs:*:method:x#send2"} and "sym:rs:*:function:Vec::new" not in to("calls", "file:x.rs")
    assert to("usesClass", "file:src/card.tsx") == {f"sym:css:*:styleClass:{x}" for x in ("p-4", "m-2", "a", "c", "q")}
    assert to("usesClass", "file:p.html") == {"sym:css:*:styleClass:a", "sym:css:*:styleClass:b"}
    assert to("usesUiComponent", "file:src/card.tsx") == {"sym:js:@/components/ui/button:uiComponent:Button"}
    assert {a for a, b, k in e if k == "belongsToModule"} == {"sym:js:app.module.ts:ngComponent:Foo", "sym:js:app.module.ts:ngComponent:Bar"}
    assert to("defines", "file:s.css") and len({r.id for r in g.edges.collect()}) == g.edges.count()


def test_limits_and_imports(spark):
    files = frame(spark, FILES)
    assert [(r.target, r.pos) for r in links.imports(files.filter("path = 'src/index.ts'")).orderBy("pos").collect()] == [("./utils", 0), ("./config", 1), ("react", 2)]
    assert links.imports(files, 1).groupBy("path").count().filter("count > 1").count() == 0
    few = links.sync(files, links.Limits(max_symbols=1)).edges.filter("kind = 'defines'").groupBy("from_node").count()
    assert few.filter("count > 1").count() == 0
    bare = links.sync(files, links.Limits(symbols=False, endpoints=False))
    assert {r.kind for r in bare.nodes.select("kind").distinct().collect()} == {"file"} and {r.kind for r in bare.edges.select("kind").distinct().collect()} == {"imports"}
    assert links.sync(frame(spark, []).limit(0)).nodes.count() == 0


def test_imports_gather_nothing_on_the_driver(spark, tmp_path):
    spark.range(40).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    found = kg_imports_from_text(spark, str(tmp_path))
    got = found.collect()
    assert len(got) == 70 and sum(r.to_node is not None for r in got) == 20
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)


def test_sync_gathers_nothing_on_the_driver(spark, tmp_path):
    frame(spark, FILES).write.parquet(f"{tmp_path}/chunks")
    edges = links.sync(spark.read.parquet(f"{tmp_path}/chunks")).edges
    assert {r.to_node for r in edges.collect() if r.kind == "imports" and r.from_node == "file:src/index.ts"} == {"file:src/utils.ts", "file:src/config.ts"}
    assert "SortMergeJoin" in plan(edges) and "Broadcast" not in plan(edges)


def exploded(node):
    """Rows that the explosions of a plan that ran have made."""
    own = node.metrics().get("numOutputRows").get().value() if node.nodeName() == "Generate" else 0
    return own + sum(exploded(node.children().apply(i)) for i in range(node.children().size()))


def test_imports_are_not_exploded(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        imports = spark.range(100).selectExpr("concat('a/m', id, '.ts') as path", "'./x' as target")
        found = graph.resolve_imports(imports, spark.createDataFrame([("file:a/x.ts", "a/x.ts"), ("file:b.py", "b.py")], "id string, path string"))
        assert len(found.collect()) == 100 and exploded(found._jdf.queryExecution().executedPlan()) <= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_import_stems(spark):
    known = ["a/x.ts", "a/x/index.ts", "a/x", "a/y.js.ts", "a/y.js", "a/.ts", "a/z/mod.rs", "a/index.ts", "b.py", "a/x.tsx", None]
    asked = [("a/m.ts", t) for t in ("./x", "./x.ts", "./x/index", "./y", "./y.js", "./z", ".", "./", "../b", "/b", "x", "./none", "./x/", "../a/./x")] + [("a/m.ts", "./x"), ("m.ts", "./a/x"), ("m.ts", "./a")]
    files = spark.createDataFrame([(f"file:{p}", p) for p in known], "id string, path string")
    got = {(r.path, r.target): r.to_node for r in graph.resolve_imports(spark.createDataFrame(asked, "path string, target string"), files).collect()}
    want = {}
    for path, target in asked:
        if target[0] in "./":
            parts = []
            for p in ("" if target[0] == "/" else path.rpartition("/")[0] + "/").split("/") + target.split("/"):
                parts = parts[:-1] if p == ".." else parts if p in ("", ".") else [*parts, p]
            found = [x for x in ("/".join(parts) + e for e in IMPORT_ENDINGS) if x in known]
            want |= {(path, target): f"file:{found[0]}"} if found else {}
    assert got == want and len(want) == 14


def test_budgeted(spark):
    rng = random.Random(3)
    for nodes, budget in ((8, (3, 4)), (20, (5, 2)), (12, (12, 100)), (30, (7, 9))):
        edges = sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes + 2)}") for _ in range(60)})
        rows = [(f"{i:03d}", a, b, "k") for i, (a, b) in enumerate(edges)]
        known = {f"n{i}" for i in range(nodes)}
        held, want = set(), []
        for i, a, b, _ in rows:
            if len(want) < budget[1] and a in known and b in known and len(held | {a, b}) <= budget[0]:
                held |= {a, b}
                want.append(i)
        e = spark.createDataFrame(rows, "id string, from_node string, to_node string, kind string")
        n = spark.createDataFrame([(x,) for x in known], "id string")
        assert graph.budgeted(n, e, *budget) == want


def test_bounded(spark):
    e = spark.createDataFrame([(f"e{i}", "hub", f"n{i:02d}", "k") for i in range(50)] + [("x1", "n00", "far", "k"), ("x2", "n49", "farther", "k")], "id string, from_node string, to_node string, kind string")
    roots = spark.createDataFrame([("hub",), ("far",), ("alone",)], "id string")
    near = graph.bounded(e, roots, 2, 10)
    got = {}
    for r in near.collect():
        got.setdefault(r.root, {})[r.node] = r.hop
    assert got["hub"] == {"hub": 0, **{f"n{i:02d}": 1 for i in range(9)}}
    assert got["far"] == {"far": 0, "n00": 1, "hub": 2} and got["alone"] == {"alone": 0}
    assert graph.edges_of(near, e, 4).groupBy("root").count().filter("count > 4").count() == 0


def test_lists_and_exports(spark):
    g = links.sync(frame(spark, FILES))
    assert {r.label for r in graph.list_nodes(g.nodes, ["file"], label="PY").collect()} == {"m.py"}
    assert graph.list_nodes(g.nodes, path="src/").count() == graph.list_nodes(g.nodes).filter("path like 'src/%'").count()
    assert graph.list_edges(g.edges, ["imports"], node="file:src/utils.ts").count() == 1 and graph.list_edges(g.edges, target="file:src/utils.ts").count() == 1 and graph.list_edges(g.edges, source="none").count() == 0
    n, e = graph.capped(g.nodes, g.edges, 5, 2)
    assert n.count() == 5 and e.count() <= 2
    lines = [json.loads(r.line) for r in graph.json_lines(g.nodes, g.edges).collect()]
    assert {x["kind"] for x in lines if "from" in x} >= {"imports", "defines", "definesEndpoint"}
    assert {r.kind: r.n for r in graph.counts(g.nodes, g.edges).collect()}["file"] == len(FILES)
