from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwright.functions.embedding import hash_embedding
from loomwright.operators import ask, workspace
from loomwright.sources.snapshots import Store
from loomwright.sources.tables import SCHEMAS

FILES = [("src/main.rs", "fn main() { run the server }"), ("src/utils.py", "def helper(): parse config"), ("docs/guide.md", "# Guide\nhow to configure the server"), ("empty.py", "")]


def files(spark, rows, mtime=1):
    return spark.createDataFrame([(p, len(t), mtime, t) for p, t in rows], "path string, size long, mtime long, text string")


def nothing(spark):
    return spark.createDataFrame([], SCHEMAS["pending"]), spark.createDataFrame([], "path string, size long, mtime long")


def test_add_commit_reindex(spark, tmp_path):
    store, (pending, indexed) = Store(spark, str(tmp_path / "s")), nothing(spark)
    f = files(spark, FILES)
    staged = workspace.add(f, indexed, pending, "main", datetime(2024, 1, 1))
    assert sorted((r.uri, r.base, r.change_type) for r in staged.collect()) == [("docs/guide.md", "docs", "new"), ("src/main.rs", "code", "new"), ("src/utils.py", "code", "new")]
    assert workspace.add(f, indexed, staged, "main", datetime(2024, 1, 2)).count() == 0
    first, left = workspace.commit(store, f, staged, "one", datetime(2024, 1, 1))
    assert left.count() == 0 and store.read("chunks").count() == 3
    known = store.read("chunks").select(F.col("file_path").alias("path"), F.col("indexed_size").alias("size"), F.col("indexed_mtime").alias("mtime"))
    changed = files(spark, [("src/main.rs", "fn main() {}"), ("bad.py", " ")], 2)
    again = workspace.add(changed, known, pending, "main", datetime(2024, 1, 3))
    second, left = workspace.commit(store, changed, again, "two", datetime(2024, 1, 3))
    assert [(r.uri, r.status, r.last_error) for r in left.collect()] == [("bad.py", "failed", "empty")]
    assert store.read("chunks").count() == 3
    t = {r.id: r for r in store.read("timeline").collect()}
    assert t[second].parent_id == first and t[second].operations[0].source_count == 1
    assert workspace.compatible(store, workspace.Model()) == "ok" and workspace.reindex(store, workspace.Model()) == 0
    other = workspace.Model("other", 384)
    assert workspace.compatible(store, other) == "mismatch" and workspace.reindex(store, other, dry_run=True) == 3
    assert workspace.reindex(store, other) == 3 and workspace.compatible(store, other) == "ok"
    stats = {r.base: r.chunks for r in workspace.base_stats(store.read("chunks"), store.read("vectors")).collect()}
    assert stats == {"code": 2, "docs": 1}
    with pytest.raises(ValueError):
        workspace.base_stats(store.read("chunks"), store.read("vectors"), "none")


def test_ask(spark, tmp_path):
    store, (pending, indexed) = Store(spark, str(tmp_path / "s")), nothing(spark)
    f = files(spark, FILES)
    workspace.commit(store, f, workspace.add(f, indexed, pending, "main", datetime(2024, 1, 1)), "one", datetime(2024, 1, 1))
    q = spark.createDataFrame([(1, "what is in src/main.rs"), (2, "configure server")], "qid int, question string").withColumn("vector", hash_embedding("question"))
    chunks = store.read("chunks").select("id", "base", F.col("file_path").alias("path"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), "text")
    edges = spark.createDataFrame([("e", "file:src/main.rs", "file:src/utils.py", "imports")], "id string, from_node string, to_node string, kind string")
    a = ask.ask(q, chunks, store.read("vectors").select("id", "vector"), store.read("nodes"), edges)
    top = {r.qid: r.path for r in a.chunks.filter("rank = 1").collect()}
    assert top[1] == "src/main.rs"
    assert {r.node for r in a.graph.filter("qid = 1 and root = 'file:src/main.rs'").collect()} == {"file:src/main.rs", "file:src/utils.py"}
    assert {r.qid for r in a.stack.collect()} == {1, 2}
    log = ask.log_rows(a, q, "main", datetime(2024, 1, 2))
    assert log.count() == 2 and log.filter("total_hits > 0").count() == 2
