import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwright.operators import chunks, graph, history, inventory, memory, search, staging
from loomwright.sources.snapshots import Store, delete, upsert
from loomwright.sources.tables import SCHEMAS, directory, ignored, json_lines, to_markdown
from loomwright.streaming.ingest import commit_stream, pending_stream, windowed_counts


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_bm25_ranks_the_best_first(spark):
    docs = spark.createDataFrame([("a", "quick brown fox"), ("b", "lazy dog sleeps"), ("c", "fox fox fox rust"), ("d", "")], "id string, text string")
    index = search.build_index(docs, "id", "text")
    hit = search.bm25_search(index, spark.createDataFrame([(1, "fox"), (2, "unknownword"), (3, ""), (4, "rust rust")], "qid int, text string"), "qid", "text", 2)
    got = rows(hit.select("qid", "rank", "doc_id"))
    assert got == [(1, 1, "c"), (1, 2, "a"), (4, 1, "c")]
    assert index.stats.first().n == 4


def test_rrf(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid int, doc_id string, rank int")
    sparse = spark.createDataFrame([(1, "b", 1), (1, "d", 2), (1, "a", 3)], "qid int, doc_id string, rank int")
    got = search.fuse(dense, sparse, 10).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["b", "a", "d", "c"]
    assert got[0].score == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-9)
    assert got[3].score == pytest.approx(0.5 / 63 + 0.5 / 64, abs=1e-9)


def test_knn_handles_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 2)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None)], "id int, vector array<double>")
    got = search.knn(v, v.select(F.col("id").alias("qid"), "vector"), 1, "l2")
    assert rows(got.select("qid", "id")) == [(i, i) for i in range(5)]


def test_overlaps(spark):
    h = spark.createDataFrame([("p", 1, 1, 10, 0.9), ("p", 2, 5, 12, 0.8), ("p", 3, 11, 20, 0.7), ("q", 4, 1, 1, 0.1)], "path string, id int, start int, end int, score double")
    assert rows(chunks.drop_overlaps(h, ["path"]).select("id")) == [(1,), (3,), (4,)]


def test_rerank_and_prefilter(spark):
    q = spark.createDataFrame([(1, "what is in src/main.rs")], "qid int, question string")
    c = spark.createDataFrame([(7, "src/main.rs", "code", "fn main"), (8, "x.py", "code", "what is in here")], "id int, path string, base string, snippet string")
    hits = q.join(c.filter("id = 8"), how="cross").withColumn("score", F.lit(0.4)).select("qid", "id", "question", "path", "base", "snippet", "score")
    both = chunks.add_named_files(hits, c, q)
    assert rows(both.select("id", "score")) == [(7, 0.5), (8, 0.4)]
    got = chunks.rerank(both, final=2).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 8]


def test_symbols(spark):
    files = spark.createDataFrame(
        [
            ("a.py", "python", "import x\nclass A:\n    def m(self): pass\n    def __str__(self): pass\ndef f(): pass\nMAX = 1\n"),
            ("b.sql", "sql", "CREATE TABLE t1 (a int); create or replace view v1 as select 1"),
            ("c.md", "markdown", "# One\ntext\n## Two words ##\n"),
            ("d.rs", "rust", "pub struct S;\npub async fn go() {}\nmod tests {}\nconst K: u8 = 1;"),
        ],
        "path string, language string, text string",
    )
    got = {(r.path, r.kind, r.name) for r in graph.symbols(files).collect()}
    assert got >= {("a.py", "class", "A"), ("a.py", "method", "m"), ("a.py", "function", "f"), ("a.py", "constant", "MAX"), ("b.sql", "table", "t1"), ("b.sql", "view", "v1"), ("c.md", "h1", "one"), ("c.md", "h2", "two-words"), ("d.rs", "struct", "S"), ("d.rs", "function", "go"), ("d.rs", "constant", "K")}
    assert not any(n in ("__str__", "tests") for _, _, n in got)


def test_imports(spark):
    files = spark.createDataFrame([("file:src/utils.ts", "src/utils.ts"), ("file:src/config.ts", "src/config.ts"), ("file:src/api/handler.ts", "src/api/handler.ts")], "id string, path string")
    imports = spark.createDataFrame([("src/index.ts", "./utils"), ("src/index.ts", "./config"), ("src/api/handler.ts", "../utils"), ("src/index.ts", "react")], "path string, target string")
    assert rows(graph.resolve_imports(imports, files)) == [("src/api/handler.ts", "../utils", "file:src/utils.ts"), ("src/index.ts", "./config", "file:src/config.ts"), ("src/index.ts", "./utils", "file:src/utils.ts")]


def test_revisions(spark):
    t = spark.createDataFrame([("aaaaaa1", None, datetime(2024, 1, 1)), ("aaaaaa2", "aaaaaa1", datetime(2024, 1, 2)), ("bbbbbb3", "aaaaaa2", datetime(2024, 1, 3))], "id string, parent_id string, timestamp timestamp")
    assert history.resolve_revision(t, "HEAD") == "bbbbbb3"
    assert history.resolve_revision(t, "@~1") == "aaaaaa2"
    assert history.resolve_revision(t, "HEAD~2") == "aaaaaa1"
    assert history.resolve_revision(t, "bbbbbb") == "bbbbbb3"
    for bad in ("HEAD~3", "aaaaaa", "bbb", "zzzzzzz"):
        with pytest.raises(ValueError):
            history.resolve_revision(t, bad)


def test_release(spark):
    c = spark.createDataFrame([(1, "feat(api)!: add it"), (2, "fix: mend"), (3, "no colon"), (4, "fix: "), (5, "feat: two")], "o int, message string")
    groups = history.release_groups(c, "o")
    text = history.render_changelog(groups, "1.0")
    assert text.index("### Features") < text.index("### Bug Fixes") < text.index("### Other")
    assert "- **api**: add it\n- two" in text
    log = history.add_release("# Log\n\n## 0.9\n", text)
    assert log.index("## 1.0") < log.index("## 0.9")
    with pytest.raises(ValueError):
        history.add_release(log, text)


def test_prune_splits_all_rows(spark):
    m = spark.createDataFrame([(i, "k", "x" * 40, ["old"] if i == 9 else ["new"], datetime(2024, 1, 1 + i)) for i in range(10)], "o int, key string, text string, tags array<string>, created_at timestamp")
    kept, pruned = memory.prune(m, memory.Policy(["old"], 6, 4, 25), "key", "o", "2024-01-10")
    assert rows(kept.select("o")) == [(7,), (8,)]
    assert dict(rows(pruned.select("o", "reason"))) == {0: "age", 1: "age", 2: "age", 3: "entries", 4: "entries", 5: "tokens", 6: "tokens", 9: "tag"}


def test_staging(spark):
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, None)], "path string, size long, mtime long")
    old = spark.createDataFrame([("b", 2, 3), ("c", 3, 5)], "path string, size long, mtime long")
    assert rows(staging.changes(files, old)) == [("a", "new"), ("b", "modified"), ("c", "unchanged")]


def test_manifests():
    parse = inventory.parse_manifest
    assert parse("x/package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}') == [("npm", "a", "1", "runtime"), ("npm", "b", "2", "dev")]
    assert parse("pyproject.toml", '[project]\ndependencies = ["x>=1"]\n[tool.poetry.group.dev.dependencies]\ny = "2"\n') == [("pip", "x", ">=1", "runtime"), ("poetry", "y", "2", "dev")]
    assert parse("Gemfile", "gem 'rails', '7'\ngroup :test do\n gem 'rspec'\nend\n") == [("bundler", "rails", "7", "runtime"), ("bundler", "rspec", "", "dev")]
    assert parse("package.json", "{broken") == []


def test_technologies(spark):
    files = spark.createDataFrame([("a/x.py",), ("deploy/docker-compose.yml",), ("b/x.ts",), ("K8S/x.yaml",), ("x.TF",)], "path string")
    deps = spark.createDataFrame([("npm", "react", "1", "runtime", "p"), ("npm", "typescript", "5", "dev", "p")], inventory.DEPENDENCY)
    got = {(r.kind, r.name) for r in inventory.technologies(files, deps).collect()}
    assert {("language", "Python"), ("framework", "React"), ("infra", "Docker Compose"), ("infra", "Kubernetes")} <= got and ("infra", "Terraform") not in got


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id int, v string")
    assert rows(upsert(old, new, "id", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(delete(old, new, "id")) == [(1, "a")]
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("t") is None
    store.write({"t": old})
    store.write({"t": new})
    assert store.read("t").count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"id": "1", "branch": "main", "base": "code", "kind": "file", "uri": "a", "status": "pending"}) + "\n\n")
    assert json_lines(spark, str(tmp_path / "p.jsonl"), "pending").count() == 1
    for f in ("src/a.py", "node_modules/x.js", "img.png", ".hidden/y.py"):
        (tmp_path / "w" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / f).write_text("x")
    assert [r.path.rsplit("w/")[-1] for r in directory(spark, str(tmp_path / "w")).collect()] == ["src/a.py"]
    assert to_markdown("<nav>n</nav><h1>T</h1><p>a <a href='u'>b</a></p><script>x</script>") == "# T\n\na [b](u)"
    long = "<p>" + "word " * 120 + "</p>"
    page = f"<html><body><header>h</header><div class='menu'>m<div>n</div></div><p>before</p><article><p>short</p></article><main><h2>M</h2><div class='toc'>t</div>{long}<br>end</main><p>after</p></body></html>"
    text = to_markdown(page)  # the article is too short
    assert text.startswith("## M\n\nword word") and text.endswith("end") and "before" not in text and not any(x in text.split() for x in "mnth")
    assert to_markdown(page.replace("<main>", "<main><article>").replace("</main>", "</article></main>").replace("<article><p>short</p></article>", "")).endswith("end")
    assert to_markdown(f"<body><p>a<p>b{long}</body>").startswith("a\n\nb") and to_markdown("") == "" and to_markdown("</p>x<br></div>") == "x"


def test_ignore_file(spark):
    paths = ["a.log", "x/a.log", "keep.log", "build/o", "src/build/o", "doc/a.txt", "doc/sub/a.txt", "t/x/y/z.bin", "f1.md", "f2.md", "q.py"]
    lines = ["# comment", "", "*.log", "!keep.log", "/build/", "doc/*.txt", "t/**/z.bin", "f[!2].md"]
    got = {r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").filter(ignored(F.col("p"), lines)).collect()}
    assert got == {"a.log", "x/a.log", "build/o", "doc/a.txt", "t/x/y/z.bin", "f1.md"}


def test_changelog_modes():
    assert history.changelog("old", "## 1\n", False) == "## 1\n"
    assert history.changelog(None, "## 1\n", True).startswith("# Changelog") and "## 1" in history.changelog("# C\n\n## 0\n", "## 1\n", True)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i, s: json.dumps({"id": i, "branch": "main", "base": "code", "kind": "file", "uri": i, "status": s}) + "\n"
    (tmp_path / "in/1.json").write_text(line("1", "pending") + line("2", "pending"))
    store = Store(spark, str(tmp_path / "store"))
    go = lambda: commit_stream(pending_stream(spark, str(tmp_path / "in")), store, "pending", "id", str(tmp_path / "check")).awaitTermination()
    go()
    (tmp_path / "in/2.json").write_text(line("2", "indexed"))
    go()
    assert rows(store.read("pending").select("id", "status")) == [("1", "pending"), ("2", "indexed")]
    batch = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "a", 1.0), (datetime(2024, 1, 1, 0, 50), "a", 2.0), (datetime(2024, 1, 1, 1, 5), "a", 4.0)], "ts timestamp, event_type string, value double")
    assert [tuple(r)[2:] for r in windowed_counts(batch).orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]
    assert set(SCHEMAS) >= {"chunks", "vectors", "timeline"}
