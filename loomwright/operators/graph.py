"""Property graph: extraction by rules, traversal within bounds, export."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import paths
from loomwright.rules import ONCE, PARTIAL_MARKS, SCRIPT_FRAMEWORKS, SYMBOL_RULES, UI_IMPORT

MAX_HOPS, MAX_NODES, MAX_EDGES = 2, 32, 48


class Rule(NamedTuple):
    language: str
    kind: str
    pattern: str
    group: int = 1
    #: Names that don't count, as a pattern; empty: all count.
    skip: str = ""


#: Shallow extraction: one row for each kind of symbol of a language. Names are what `group` holds; `script` is either script language.
RULES = [Rule(*r) for r in SYMBOL_RULES]


def framework_of(path: Column, text: Column) -> Column:
    """The framework of a script, or null: the first that its text or path tells of."""
    says = lambda marks: F.array_contains(F.array(*[F.contains(text, F.lit(m)) for m in marks]), True)
    out = F.when(F.lit(False), F.lit(""))
    for name, marks in SCRIPT_FRAMEWORKS:
        here = says(marks)
        if name == "next":
            here = here | (F.contains(path, F.lit("/app/")) & F.contains(path, F.lit("/api/"))) | F.contains(path, F.lit("/pages/api/"))
        elif name == "react":
            here = here | (path.rlike(r"\.[jt]sx$") & F.contains(text, F.lit("return (")))
        out = out.when(here, name)
    return out


def has_components(path: Column, text: Column) -> Column:
    return path.rlike(r"\.[jt]sx$") | F.coalesce(framework_of(path, text).isin("react", "next", "shadcn"), F.lit(False))


def ui_parts(text: Column) -> Column:
    """array of struct(name, source): parts of a component library that a script imports by name; renamed ones don't count."""
    each = F.zip_with(found_in(text, UI_IMPORT, 1), found_in(text, UI_IMPORT, 2), lambda names, source: F.transform(F.filter(F.transform(F.split(names, ","), lambda n: F.trim(F.regexp_replace(n, r"\s", " "))), lambda n: (n != "") & ~F.contains(n, F.lit(" as "))), lambda n: F.struct(n.alias("name"), source.alias("source"))))
    return F.flatten(each)


def found_in(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of a pattern holds at each place; a point stands for all but a line feed, as do the ends of lines."""
    return F.regexp_extract_all(text, F.lit(f"(?d){pattern}"), F.lit(group))


def _names(r: Rule, path: Column, text: Column) -> Column:
    names = found_in(text, r.pattern, r.group)
    if r.skip:
        names = F.filter(names, lambda n: ~n.rlike(r.skip))
    if r.language == "markdown":  # the heading as a part of an address
        names = F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(F.lower(n), r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""))
    elif r.kind == "ngRoute":
        names = F.transform(names, lambda n: F.when(n.startswith("/"), n).otherwise(F.concat(F.lit("/"), n)))
    elif r.kind == "htmlAnchor":  # sections have their own kind
        section = next(x for x in RULES if x.kind == "htmlSection")
        names = F.array_except(names, found_in(text, section.pattern, section.group))
    return names


def _applies(r: Rule, path: Column, language: Column, text: Column) -> Column:
    """Whether a rule is for a file."""
    own = language.isin("javascript", "typescript") if r.language == "script" else language.isin("css", "scss", "sass", "less") if r.language == "css" else language == r.language
    if r.kind == "reactComponent":
        return own & has_components(path, text)
    if r.kind in ("ngComponent", "ngModule", "ngService"):
        return own & ((framework_of(path, text) == "angular") | F.contains(text, F.lit("@Component(")))
    if r.kind == "ngRoute":
        return own & ((framework_of(path, text) == "angular") | F.contains(path, F.lit("routing")) | F.contains(text, F.lit("Routes")))
    return own


def file_nodes(chunks: DataFrame) -> DataFrame:
    """chunks (path, base): one node for each path: id, kind, label, path, base."""
    kind = F.when(F.col("base") == "docs", "doc").otherwise("file")
    last = chunks.groupBy("path").agg(F.max("base").alias("base"))
    return last.select(F.concat_ws(":", kind, "path").alias("id"), kind.alias("kind"), paths.label_of(F.col("path")).alias("label"), "path", "base")


def symbols(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """files (path, language, text) -> path, language, kind, name, rule, pos: names in the order of rules and places.

    Names repeat, but for the kinds that a file has once a name. Without `rules`, pages have a row
    for themselves and scripts have one for each part of a component library that they import.
    """
    path, language, text = F.col("path"), F.col("language"), F.coalesce("text", F.lit(""))
    rows = lambda names, kind, rule: F.transform(names, lambda n, i: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), n.alias("name"), F.lit(rule).alias("rule"), i.alias("pos")))
    each = [F.when(_applies(r, path, language, text), rows(_names(r, path, text), r.kind, i)) for i, r in enumerate(rules or RULES)]
    if rules is None:
        whole = F.contains(text, F.lit("<html")) | F.contains(text, F.lit("<!DOCTYPE")) | F.contains(text, F.lit("<body"))
        partial = F.lower(path).rlike("|".join(PARTIAL_MARKS))
        stem = F.regexp_replace(paths.file_name(path), r"(?<=.)\.[^.]*$", "")
        each.append(F.when(language == "html", rows(F.array(stem), F.when(whole & ~partial, "htmlTemplate").otherwise("htmlPartial"), -1)))
        parts = F.transform(ui_parts(text), lambda p: p["name"])
        each.append(F.when(language.isin("javascript", "typescript") & F.contains(text, F.lit("@/components/ui")), rows(parts, "uiComponent", len(RULES))))
    found = files.select("path", "language", F.explode(F.flatten(F.filter(F.array(*each), lambda a: a.isNotNull()))).alias("s")).select("path", "language", "s.*")
    nth = F.row_number().over(Window.partitionBy("path", "kind", "name").orderBy("rule", "pos"))
    return found.withColumn("_n", nth).filter((F.col("_n") == 1) | ~F.col("kind").isin(ONCE)).drop("_n")


def limited(found: DataFrame, most: int | None) -> DataFrame:
    """The first `most` symbols of each file, in the order of rules and places."""
    if most is None:
        return found
    n = F.row_number().over(Window.partitionBy("path").orderBy("rule", "pos", "kind", "name"))
    return found.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def disambiguate(rows: DataFrame, *order: str) -> DataFrame:
    """rows (id): the n-th repeat of an id ends in #n, the first is bare."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return rows.withColumn("_n", n).withColumn("id", F.when(F.col("_n") > 1, F.concat_ws("#", "id", "_n")).otherwise(F.col("id"))).drop("_n")


def symbol_nodes(found: DataFrame) -> DataFrame:
    tag = paths.tag_of(F.col("path"))
    return disambiguate(found.select(F.concat_ws(":", F.lit("sym"), tag, "path", "kind", "name").alias("id"), "kind", F.col("name").alias("label"), "path", "rule", "pos"), "rule", "pos").drop("rule", "pos")


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(F.lit("edge:"), F.lower(F.hex(F.xxhash64(source, target))), F.lit("->"), kind)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, target), files (id, path): source path, target, and the first known file that the target may mean.

    A file has few endings to take off and an import many to try, so the files are spread, not the
    imports. Spark takes exploded rows for far fewer than they are, so the join is told to merge:
    else the driver may gather either side for a broadcast.
    """
    asked = imports.select("path", "target", paths.import_stem(F.col("path"), F.col("target")).alias("stem")).filter("stem is not null").distinct()
    known = files.select("id", F.explode(paths.import_stems(F.col("path"))).alias("s")).select("id", "s.rank", "s.stem")
    first = known.groupBy("stem").agg(F.min_by("id", "rank").alias("to_node"))
    return asked.join(first.hint("merge"), "stem").select("path", "target", "to_node")


def reach(edges: DataFrame, roots: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """root, node, hop: all nodes within `hops` edges of a root, in either direction, and the least number of edges. Each hop is one equi-join and one aggregation."""
    both = edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("next")).unionByName(edges.select(F.col("to_node").alias("node"), F.col("from_node").alias("next"))).distinct()
    front = seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        step = front.join(both, "node").select("root", F.col("next").alias("node")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def bounded(edges: DataFrame, roots: DataFrame, hops: int = MAX_HOPS, max_nodes: int = MAX_NODES) -> DataFrame:
    """As `reach`, but at most max_nodes nodes of a root, itself included: nearer ones first, then by id. What is over the cap goes no further, so a hub is walked through once and no more."""
    both = edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("next")).unionByName(edges.select(F.col("to_node").alias("node"), F.col("from_node").alias("next")))
    seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("hop"))
    first = F.row_number().over(Window.partitionBy("root").orderBy("hop", "node"))
    for h in range(1, hops + 1):
        step = seen.filter(F.col("hop") == h - 1).join(both, "node").select("root", F.col("next").alias("node"))
        step = step.distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(step).withColumn("_n", first).filter(F.col("_n") <= max_nodes).drop("_n")
    return seen


def edges_of(near: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """root and edges between nodes of its neighbourhood (root, node), the first max_edges of each by id."""
    ends = edges.join(near.select("root", F.col("node").alias("from_node")), "from_node").join(near.select("root", F.col("node").alias("to_node")), ["root", "to_node"])
    n = F.row_number().over(Window.partitionBy("root").orderBy("id"))
    return ends.withColumn("_n", n).filter(F.col("_n") <= max_edges).select("root", *edges.columns)


def capped_walk(edges: pd.DataFrame, root: str, hops: int = MAX_HOPS, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[list[str], list[str]]:
    """Breadth first from root within caps, over a neighbourhood that `reach` has bounded: nodes and edge ids in order; outgoing edges first, each once, ordered by id."""
    out, into = {}, {}
    for e in edges.sort_values("id").itertuples():
        out.setdefault(e.from_node, []).append((e.id, e.to_node))
        into.setdefault(e.to_node, []).append((e.id, e.from_node))
    nodes, used, front = [root], [], [root]
    for _ in range(hops):
        following = []
        for n in front:
            for e, m in out.get(n, []) + into.get(n, []):
                if e not in used and len(used) < max_edges:
                    used.append(e)
                    if m not in nodes and len(nodes) < max_nodes:
                        nodes.append(m)
                        following.append(m)
        front = following
    return nodes, used


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among the nodes (id), each once."""
    a = edges.join(nodes.select(F.col("id").alias("from_node")), "from_node", "left_semi")
    b = edges.join(nodes.select(F.col("id").alias("to_node")), "to_node", "left_semi")
    return a.select(*edges.columns).unionByName(b.select(*edges.columns)).distinct()


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("from_node")), "from_node", "left_semi").join(nodes.select(F.col("id").alias("to_node")), "to_node", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_node").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("to_node").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind and number of nodes and edges."""
    return nodes.select("kind").unionAll(edges.select("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def list_nodes(nodes: DataFrame, kinds: list[str] | None = None, label: str | None = None, path: str | None = None) -> DataFrame:
    """Nodes of some kinds, with a part of the label, below a path; a filter that is None lets all pass."""
    keep = F.lit(True) if kinds is None else F.col("kind").isin(kinds)
    if label is not None:
        keep = keep & F.contains(F.lower("label"), F.lit(label.lower()))
    if path is not None:
        keep = keep & F.col("path").startswith(path)
    return nodes.filter(keep)


def list_edges(edges: DataFrame, kinds: list[str] | None = None, node: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges of some kinds, at a node, from a node, to a node; a filter that is None lets all pass."""
    keep = F.lit(True) if kinds is None else F.col("kind").isin(kinds)
    if node is not None:
        keep = keep & ((F.col("from_node") == node) | (F.col("to_node") == node))
    if source is not None:
        keep = keep & (F.col("from_node") == source)
    if target is not None:
        keep = keep & (F.col("to_node") == target)
    return edges.filter(keep)


def capped(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For an export: the first nodes by id, and the first edges between them."""
    n = nodes if max_nodes is None else nodes.orderBy("id").limit(max_nodes)
    e = within(edges, n)
    return n, e if max_edges is None else e.orderBy("from_node", "to_node", "kind").limit(max_edges)


def budgeted(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> list[str]:
    """Ids of edges, taken one after the other in the order of ids, if both ends are nodes and still fit.

    An edge that doesn't fit never will: each node taken lowers what is left by one and what the
    edge needs by one at most. So a pass reads the next max_edges edges that fit at its start, and
    there are at most max_nodes + 2 passes; the driver holds the budget, not the graph.
    """
    whole = within(edges.select("id", "from_node", "to_node"), nodes)
    held: set[str] = set()
    taken: list[str] = []
    last = None
    while len(taken) < max_edges:
        room, known = max_nodes - len(held), list(held)
        needs = [F.when(F.col(c).isin(known) if known else F.lit(False), 0).otherwise(1) for c in ("from_node", "to_node")]
        need = F.when(F.col("from_node") == F.col("to_node"), needs[0]).otherwise(needs[0] + needs[1])
        fits = need <= room
        batch = whole.filter(fits if last is None else fits & (F.col("id") > last)).orderBy("id").limit(max_edges).collect()
        for e in batch:
            if len(taken) < max_edges and len(held | {e.from_node, e.to_node}) <= max_nodes:
                held |= {e.from_node, e.to_node}
                taken.append(e.id)
        if len(batch) < max_edges:
            break
        last = batch[-1].id
    return taken


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as JSON objects, one a row: nodes are part 0, edges within them part 1."""
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.to_json(F.struct(*nodes.columns)).alias("line"))
    e = within(edges, nodes).select(F.lit(1).alias("part"), F.concat_ws("|", "from_node", "to_node", "kind").alias("key"), F.to_json(F.struct(F.col("from_node").alias("from"), F.col("to_node").alias("to"), *[c for c in edges.columns if c not in ("from_node", "to_node")])).alias("line"))
    return n.unionByName(e)


def dot_text(c: Column) -> Column:
    """Escaped for a quoted DOT string."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph with a place for each."""
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.format_string('  "%s" [label="%s"];', dot_text(F.col("id")), dot_text(F.col("label"))).alias("line"))
    e = within(edges, nodes).select(F.lit(1).alias("part"), F.concat_ws("|", "from_node", "to_node", "kind").alias("key"), F.format_string('  "%s" -> "%s" [label="%s"];', dot_text(F.col("from_node")), dot_text(F.col("to_node")), dot_text(F.col("kind"))).alias("line"))
    return n.unionByName(e)


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    text = lambda c: F.replace(F.replace(c, F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit(" "))
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.format_string('  %s["%s"]', safe(F.col("id")), text(F.col("label"))).alias("line"))
    e = within(edges, nodes).select(F.lit(1).alias("part"), F.concat_ws("|", "from_node", "to_node", "kind").alias("key"), F.format_string("  %s -->|%s| %s", safe(F.col("from_node")), text(F.col("kind")), safe(F.col("to_node"))).alias("line"))
    return n.unionByName(e)
