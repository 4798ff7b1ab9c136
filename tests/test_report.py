from datetime import datetime

import pytest
from test_workspace import FILES, files, nothing

from loomwright.functions.embedding import hash_embedding
from loomwright.operators import ask, config, exhaustive, report, workspace
from loomwright.sources.snapshots import Store

CODE = [("src/a.ts", "import './b'\nrun()"), ("src/b.ts", "export function run() {}")]


def test_branches():
    assert workspace.branch_of("dev\n", "ref: refs/heads/main") == "dev"
    assert workspace.branch_of(None, "ref: refs/heads/feature/x\n") == "feature/x"
    assert workspace.branch_of("", "a" * 40) == "HEAD" and workspace.branch_of(None, None) == "main" and workspace.branch_of(None, "odd") == "main"
    with pytest.raises(ValueError):
        workspace.branch_of("a//b", None)


def test_index_state():
    want = {"model": "m", "dimensions": 3, "backend": "lancedb"}
    assert workspace.index_state(None, want) == "missing"
    assert workspace.index_state(want | {"model": "n", "dimensions": 4}, want) == "model"
    assert workspace.index_state(want | {"dimensions": 4, "backend": "simple_file"}, want) == "dimensions"
    assert workspace.index_state(want | {"backend": "simple_file"}, want) == "legacy"
    assert workspace.index_state(want | {"backend": "other"}, want) == "backend" and workspace.index_state(want, want) == "ok"


def test_config():
    g = {"embeddings": {"default": {"modelId": "g"}, "bases": {"code": {"modelId": "c", "dimension": 8}}}, "indexes": {"bases": {"docs": {"backend": "odd", "metric": "dot"}}}, "retrieval": {"hybrid": {"rrfK": 30.0}}}
    p = {"embeddings": {"bases": {"docs": {"modelId": "p"}}}, "retrieval": {"hybrid": {"denseWeight": 0.9}, "reranker": {"topK": 4}}}
    assert [config.embedding_of(b, g, p)["modelId"] for b in ("code", "docs", "memory")] == ["c", "p", "g"]
    assert config.embedding_of("code", {}) == config.EMBEDDING
    assert config.index_of("docs", g) == {"backend": "simple_file", "metric": "dot", "dimension": 384} and config.index_of("code", g)["dimension"] == 8
    r = config.retrieval_of(g, p)
    assert (r["hybrid"]["rrfK"], r["hybrid"]["denseWeight"], r["hybrid"]["sparseWeight"], r["reranker"]["topK"]) == (30.0, 0.9, 0.5, 4)
    errors, warnings = config.validate(g, p)
    assert not errors and any("sum to 1.4" in w for w in warnings) and any("finalK" in w for w in warnings)
    assert config.validate({}) == ([], [])
    bad = {"performance": {"embeddingBatchSize": 0, "maxFileLines": 1}, "retrieval": {"hybrid": {"rrfK": 0, "sparseTopK": 0}, "reranker": {"topK": 0, "finalK": 0}}}
    assert len(config.validate(bad)[0]) == 5 and len(config.validate(bad)[1]) == 1
    assert set(config.resolved(g, p)["embeddings"]) == {"code", "docs", "memory"}


def test_status_show(spark, tmp_path):
    store, (pending, indexed) = Store(spark, str(tmp_path / "s")), nothing(spark)
    assert not report.status(store, "main", files(spark, []), pending).initialized
    root = workspace.init(store, "main", datetime(2023, 1, 1))
    with pytest.raises(ValueError):
        workspace.init(store, "main", datetime(2023, 1, 2))
    assert report.bases(store, "main") == [] and report.show(store).id == root
    f = files(spark, FILES + CODE)
    first, _ = workspace.commit(store, f, workspace.add(f, indexed, pending, "main", datetime(2024, 1, 1)), "one", datetime(2024, 1, 1))
    edges = {(r.from_node, r.to_node) for r in store.read("edges").filter("kind = 'imports'").collect()}
    assert edges == {("file:src/a.ts", "file:src/b.ts")} and store.read("edges").filter("kind = 'defines'").count() > 0
    now = files(spark, [("src/a.ts", "run(1)")], 2).unionByName(files(spark, FILES + CODE[1:]))
    s = report.status(store, "main", now, pending)
    assert s.initialized and s.head == first and not s.clean and [r.path for r in s.modified.collect()] == ["src/a.ts"] and s.staged.count() == 0
    assert report.status(store, "main", f, pending).clean
    assert report.bases(store, "main") == ["code", "docs"]
    by_base, total = report.stats(store, "main")
    assert {r.base: r.chunks for r in by_base.collect()} == {"code": 4, "docs": 1} and total.first().vectors == 5
    shown = report.show(store, "HEAD")
    assert shown.id == first and {r.base: r.sources_added for r in shown.impact.collect()} == {"code": 5, "docs": 5}
    assert [r.path for r in shown.sources.collect()] == ["src/a.ts", "src/b.ts", "src/main.rs", "src/utils.py", "docs/guide.md"] and shown.graph.count() > 2
    assert report.show(store, "HEAD~1").id == root
    # only what has changed is embedded and split again
    known = store.read("chunks").selectExpr("file_path as path", "indexed_size as size", "indexed_mtime as mtime")
    seen = []
    embed = lambda c: seen.append(c) or hash_embedding(c)
    workspace.commit(store, now, workspace.add(now, known, pending, "main", datetime(2024, 1, 2)), "two", datetime(2024, 1, 2), embed=embed)
    ids = {r.id for r in store.read("chunks").collect()}
    assert len(ids) == 5 and {r.id for r in store.read("vectors").collect()} == ids == {r.doc_id for r in store.read("doc_stats").collect()} and len(seen) == 1
    assert store.read("postings").join(store.read("chunks").selectExpr("id as doc_id"), "doc_id", "left_anti").count() == 0
    assert store.read("edges").filter("kind = 'imports'").count() == 0 and workspace.index_ready(store)
    assert workspace.reindex(store, workspace.Model(), force=True) == 5


def test_memories(spark):
    chunks = spark.createDataFrame(
        [("m1", "memory", "keep it", '{"memory_id": "a", "memory_scope": "global", "title": "T", "tags": ["x", "y"], "created_at": "2024-01-01T00:00:00Z"}'), ("m2", "memory", "other", None), ("m3", "memory", None, '{"memory_id": "b"}'), ("c1", "code", "keep it", '{"memory_id": "c"}')],
        "id string, base string, text string, extra string",
    )
    vectors = chunks.selectExpr("id", "base").withColumn("vector", hash_embedding("id"))
    q = spark.createDataFrame([(1, "keep it")], "qid int, text string").withColumn("vector", hash_embedding("text"))
    got = {r.memory: r for r in ask.memories(q, chunks, vectors.select("id", "vector")).collect()}
    assert set(got) == {"a", "b"} and (got["a"].scope, got["a"].title, got["a"].tags) == ("global", "T", ["x", "y"]) and (got["b"].scope, got["b"].source, got["b"].text, got["b"].tags) == ("project", "agent", "", [])
    assert ask.askable(vectors) == ("code", "memory") and ask.askable(vectors, ["memory", "docs"]) == ("memory",)


def test_graph_context(spark):
    nodes = spark.createDataFrame([("e1", "endpoint", "GET"), ("f1", "file", None)], "id string, kind string, method string")
    edges = spark.createDataFrame([("x", "f1", "e1", "definesEndpoint")], "id string, from_node string, to_node string, kind string")
    found = exhaustive.exhaustive(spark.createDataFrame([(1, "show all routes")], "qid int, question string"), nodes, edges)
    walk = spark.createDataFrame([(1, "f1", "f1", 0), (2, "z", "z", 0)], "qid int, root string, node string, hop int")
    got = ask.graph_context(ask.Answer(walk, walk, walk, walk), found)
    assert sorted(map(tuple, got.collect())) == [(1, "e1"), (1, "f1"), (2, "z")]


def test_stored_text(spark):
    chunks = spark.createDataFrame([("1", "a", 2, 3, None), ("2", "a", 1, 1, "kept"), ("3", "gone", 1, 1, None), ("4", "memory:x", 1, 1, None), ("5", "a", 9, 9, None), ("6", "a", 0, 0, None), ("7", "a", 3, 9, None)], "id string, file_path string, start_line int, end_line int, text string")
    got = {r.id: (r.text, r.error) for r in workspace.stored_text(chunks, spark.createDataFrame([("a", "l1\nl2\nl3\n")], "path string, text string")).collect()}
    assert got == {"1": ("l2\nl3", None), "2": ("kept", None), "3": (None, "file not found"), "4": (None, "no stored text"), "5": ("l1\nl2\nl3\n", None), "6": ("l1\nl2\nl3\n", None), "7": ("l3", None)}


def test_files(spark, tmp_path):
    (tmp_path / "index" / "sub").mkdir(parents=True)
    (tmp_path / "sources.jsonl").write_text("12345")
    (tmp_path / "other").write_text("1")
    (tmp_path / "index" / "v").write_text("123")
    (tmp_path / "index" / "sub" / "w").write_text("1")
    assert report.bytes_on_disk(spark, str(tmp_path)) == 8 and report.bytes_on_disk(spark, str(tmp_path / "none")) == 0
    f = spark.createDataFrame([("b", "file"), ("a", "file")], "path string, kind string")
    d = spark.createDataFrame([("npm", "x"), ("cargo", "y"), ("npm", "z")], "manager string, name string")
    t = spark.createDataFrame([("tool", "T")], "kind string, name string")
    report.write_inventory(str(tmp_path / "inv"), f, d, t)
    assert tuple(report.read_stats(spark, str(tmp_path / "inv")).first()) == (2, ["cargo", "npm"])
    assert [r.path for r in spark.read.json(str(tmp_path / "inv" / "files")).orderBy("path").collect()] == ["a", "b"]
