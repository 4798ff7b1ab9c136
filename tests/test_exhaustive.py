from pyspark.sql import functions as F

from loomwright.operators import chunks, exhaustive

NODES = [("e1", "endpoint", "GET"), ("e2", "endpoint", "POST"), ("e3", "endpoint", None), ("f1", "function", None), ("m1", "method", None), ("file:a", "file", None)]
EDGES = [("x1", "file:a", "e1", "definesEndpoint"), ("x2", "file:a", "f1", "defines"), ("x3", "f1", "m1", "calls")]


def test_intent(spark):
    asked = ["show all GET routes", "List every function", "what is main", "all target things", "todas as classes", "all of it"]
    got = [tuple(r.i) for r in spark.createDataFrame([(q,) for q in asked], "q string").select(exhaustive.intent(F.col("q")).alias("i")).collect()]
    assert got[0][:3] == (True, ["endpoint"], "GET")
    assert got[1][:3] == (True, ["function"], None)
    assert got[2] == (False, [], None, None)
    assert got[3][:3] == (True, ["endpoint"], "GET")  # "target" says get
    assert got[4][:3] == (True, ["class"], None)
    assert got[5] == (True, [], None, "everything")


def test_exhaustive(spark):
    nodes, edges = spark.createDataFrame(NODES, "id string, kind string, method string"), spark.createDataFrame(EDGES, "id string, from_node string, to_node string, kind string")
    q = spark.createDataFrame([(1, "show all GET routes"), (2, "list all functions"), (3, "main?")], "qid int, question string")
    found = exhaustive.exhaustive(q, nodes, edges)
    got = {(r.qid, r.id, r.matched) for r in found.nodes.collect()}
    assert got == {(1, "e1", True), (1, "e3", True), (1, "file:a", False), (2, "f1", True), (2, "m1", True), (2, "file:a", False)}
    assert {(r.qid, r.id) for r in found.edges.collect()} == {(1, "x1"), (2, "x2"), (2, "x3")}
    few = exhaustive.exhaustive(q, nodes, edges, max_nodes=1)
    assert {(r.qid, r.id) for r in few.nodes.filter("matched").collect()} == {(1, "e1"), (2, "f1")}


def test_stack_terms(spark):
    table = exhaustive.stack_table(["React", "Python"])
    assert table["modules"][-3:] == ["__init__.py", "import", "package"] and table["hooks"][0] == "useState"
    assert exhaustive.stack_table([]) == exhaustive.EXPANSIONS
    q = spark.createDataFrame([(1, "where are the hooks")], "qid int, question string")
    assert [r.variant for r in chunks.variants(q, table).orderBy("place").collect()][:2] == ["where are the hooks", "where are the useState"]
