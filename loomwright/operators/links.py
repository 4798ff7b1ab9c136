"""Edges out of source text, and the graph of all chunks: files, symbols, endpoints and what ties them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright import rules
from loomwright.functions import paths
from loomwright.operators import graph as G

RELATION = "array<struct<from_node:string,to_node:string,kind:string,props:string>>"


class Limits(NamedTuple):
    #: None: all of them.
    max_symbols: int | None = None
    max_imports: int | None = None
    symbols: bool = True
    endpoints: bool = True


class Graph(NamedTuple):
    #: id, kind, label, path, base, method, props
    nodes: DataFrame
    #: id, from_node, to_node, kind, props
    edges: DataFrame


def _words(lists: Column) -> Column:
    """The words of an array of texts."""
    return F.filter(F.flatten(F.transform(lists, lambda c: F.split(c, r"\s+"))), lambda w: w != "")


def _nothing() -> Column:
    return F.array().cast(RELATION)


def _edge(source: Column, target: Column, kind: str, **props: Column) -> Column:
    return F.struct(source.alias("from_node"), target.alias("to_node"), F.lit(kind).alias("kind"), F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])).alias("props"))


def imports_in(path: Column, text: Column) -> Column:
    """array of the targets that a text's import statements name, in their order, repeats too; empty for other languages."""
    out = F.array().cast("array<string>")
    for ends, pattern in rules.IMPORT_PATTERNS.items():
        either = F.zip_with(G.found_in(text, pattern, 1), G.found_in(text, pattern, 2), lambda a, b: F.when(a != "", a).otherwise(b))
        out = F.when(paths.extension(path).isin(ends.split()), either).otherwise(out)
    return out


def imports(files: DataFrame, most: int | None = None) -> DataFrame:
    """files (path, text) -> path, target, pos; the first `most` of each file."""
    found = imports_in(F.col("path"), F.coalesce("text", F.lit("")))
    return files.select("path", F.posexplode(found if most is None else F.slice(found, 1, most)).alias("pos", "target")).select("path", "target", "pos")


def _calls(tag: str, file: Column, path: Column, text: Column) -> Column:
    """Calls by name, of an object's method and, where the language has them, of a type's function."""
    known = rules.BUILT_IN[tag].split()
    pairs = lambda pattern: F.zip_with(G.found_in(text, pattern, 1), G.found_in(text, pattern, 2), lambda o, m: F.struct(o.alias("o"), m.alias("m")))
    to = lambda *parts: F.concat(F.lit(f"sym:{tag}:*:"), *parts)
    direct = F.array_distinct(F.filter(G.found_in(text, rules.DIRECT_CALL[tag]), lambda n: ~n.isin(known + rules.NOT_CALLS[tag].split())))
    methods = F.array_distinct(F.filter(pairs(rules.METHOD_CALL[tag]), lambda p: ~p.m.isin(known) & ~p.o.isin(rules.BUILT_IN_OBJECTS[tag].split())))
    out = [
        F.transform(direct, lambda n: _edge(file, to(F.lit("function:"), n), "calls", callee=n, callType=F.lit("direct"), unresolved=F.lit(True), sourceFile=path)),
        F.transform(methods, lambda p: _edge(file, to(F.lit("method:"), p.o, F.lit("#"), p.m), "calls", callee=p.m, receiver=p.o, callType=F.lit("method"), unresolved=F.lit(True), sourceFile=path)),
    ]
    if tag == "rs":
        typed = F.array_distinct(F.filter(pairs(rules.TYPE_CALL), lambda p: ~p.o.isin(rules.BUILT_IN_TYPES)))
        out.append(F.transform(typed, lambda p: _edge(file, to(F.lit("function:"), p.o, F.lit("::"), p.m), "calls", callee=p.m, type=p.o, callType=F.lit("associated"), unresolved=F.lit(True), sourceFile=path)))
    return F.concat(*[a.cast(RELATION) for a in out])


def _classes(file: Column, path: Column, names: Column) -> Column:
    return F.transform(F.array_distinct(names), lambda n: _edge(file, F.concat(F.lit("sym:css:*:styleClass:"), n), "usesClass", className=n, unresolved=F.lit(True), sourceFile=path)).cast(RELATION)


def _parts(file: Column, path: Column, text: Column) -> Column:
    return F.transform(G.ui_parts(text), lambda p: _edge(file, F.concat(F.lit("sym:js:@/components/ui/"), p["source"], F.lit(":uiComponent:"), p["name"]), "usesUiComponent", componentName=p["name"], library=F.lit("shadcn/ui"), sourceFile=path)).cast(RELATION)


def _declared(path: Column, text: Column) -> Column:
    """Components that a text's first module declares."""
    module = F.regexp_extract(text, rules.NG_MODULE, 1)
    names = F.filter(F.transform(F.split(F.regexp_extract(text, rules.NG_DECLARATIONS, 1), ","), lambda n: F.regexp_replace(n, r"^\s+|\s+$", "")), lambda n: n != "")
    sym = lambda kind, n: F.concat(F.lit("sym:js:"), path, F.lit(f":{kind}:"), n)
    return F.when(module != "", F.transform(names, lambda n: _edge(sym("ngComponent", n), sym("ngModule", module), "belongsToModule", moduleName=module, sourceFile=path)).cast(RELATION)).otherwise(_nothing())


def relations(files: DataFrame) -> DataFrame:
    """files (path, language, text) -> path, from_node, to_node, kind, props, pos: calls, classes, library parts and module members of scripts and pages. A target may be no node: `*` in its id stands for an unknown file."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    file = F.concat(F.lit("file:"), path)
    template = F.transform(G.found_in(text, rules.JSX_CLASS_TEMPLATES), lambda t: F.array_join(F.transform(F.split(t, r"\$\{"), lambda p: F.substring_index(p, "}", -1)), " "))
    jsx = _words(F.concat(G.found_in(text, rules.JSX_CLASSES), G.found_in(text, rules.JSX_CLASS_CALLS), template))
    script = F.concat(
        F.when(G.has_components(path, text), _classes(file, path, jsx)).otherwise(_nothing()),
        F.when(F.contains(text, F.lit("@/components/ui")), _parts(file, path, text)).otherwise(_nothing()),
        F.when(G.framework_of(path, text) == "angular", _declared(path, text)).otherwise(_nothing()),
        _calls("js", file, path, text),
    )
    language = F.col("language")
    found = (
        F.when(language.isin("javascript", "typescript"), script)
        .when(language == "python", _calls("py", file, path, text))
        .when(language == "rust", _calls("rs", file, path, text))
        .when(language == "html", _classes(file, path, _words(G.found_in(text, rules.HTML_CLASSES))))
    )
    return files.select("path", F.posexplode(found).alias("pos", "r")).select("path", "r.*", "pos")


def endpoints(files: DataFrame) -> DataFrame:
    """files (path, text) -> path, route, method: what route files answer."""
    routes = files.withColumn("route", paths.route_of(F.col("path"))).filter("route is not null")
    return routes.select("path", "route", F.explode(paths.methods_of(F.col("text"))).alias("method"))


def sync(chunks: DataFrame, limits: Limits | None = None) -> Graph:
    """chunks (path, base, text), a row for each path and base (of more, the greatest text counts): the whole graph, built anew.

    Imports, symbols, endpoints and relations come from the base `code` alone. Nodes and edges are
    there once each by id: a node with its first path, an edge with its last statement.
    """
    limits = limits or Limits()
    files = chunks.groupBy("path", "base").agg(F.max("text").alias("text"))
    code = files.filter("base = 'code'").select("path", "base", "text", paths.language_of(F.col("path")).alias("language"))
    none = F.lit(None).cast("string")
    own = G.file_nodes(files.select("path", "base"))
    nodes = own.select("id", "kind", "label", "path", "base", none.alias("method"), none.alias("props"))
    known = own.filter("kind = 'file'").select("id", "path")
    listed = imports(code, limits.max_imports)
    tied = G.resolve_imports(listed.select("path", "target").distinct(), known).select(F.concat(F.lit("file:"), "path").alias("from_node"), F.col("to_node"), F.lit("imports").alias("kind"), F.to_json(F.struct(F.col("target").alias("rawImport"))).alias("props"))
    edges = tied
    if limits.endpoints:
        e = endpoints(code).select("path", "route", "method", F.concat_ws(":", F.lit("endpoint"), "method", "route").alias("id"))
        nodes = nodes.unionByName(e.select("id", F.lit("endpoint").alias("kind"), F.col("route").alias("label"), "path", F.lit("code").alias("base"), "method", F.to_json(F.struct("route", F.col("method").alias("httpMethod"))).alias("props")))
        edges = edges.unionByName(e.select(F.concat(F.lit("file:"), "path").alias("from_node"), F.col("id").alias("to_node"), F.lit("definesEndpoint").alias("kind"), F.to_json(F.struct(F.col("method").alias("httpMethod"))).alias("props")))
    if limits.symbols:
        s = G.symbol_nodes(G.limited(G.symbols(code), limits.max_symbols))
        said = F.to_json(F.struct(F.col("kind").alias("symbolKind")))
        nodes = nodes.unionByName(s.select("id", "kind", "label", "path", F.lit("code").alias("base"), none.alias("method"), said.alias("props")))
        edges = edges.unionByName(s.select(F.concat(F.lit("file:"), "path").alias("from_node"), F.col("id").alias("to_node"), F.lit("defines").alias("kind"), said.alias("props")))
        edges = edges.unionByName(relations(code).select("from_node", "to_node", "kind", "props"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    nodes = nodes.withColumn("_n", first).filter("_n = 1").drop("_n")
    edges = edges.groupBy("from_node", "to_node", "kind").agg(F.max("props").alias("props"))
    return Graph(nodes, edges.select(G.edge_id(F.col("from_node"), F.col("to_node"), F.col("kind")).alias("id"), "from_node", "to_node", "kind", "props"))
