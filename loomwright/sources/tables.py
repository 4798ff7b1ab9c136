"""Readers of the driver's tables, JSON lines and HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the engine's own tables.
SCHEMAS = {
    "chunks": "id string, base string, branch string, file_path string, start_line int, end_line int, text string, vector_id bigint, indexed_at timestamp, revision_id string, source_id string, indexed_mtime bigint, indexed_size bigint, extra string",
    "vectors": "id bigint, vector array<float>, payload string, base string, branch string, source_type string, path string, tags array<string>, revision_id string, created_at timestamp, updated_at timestamp",
    "postings": "base string, branch string, term string, doc_id string, tf bigint",
    "doc_stats": "base string, branch string, doc_id string, length bigint",
    "nodes": "id string, kind string, label string, props string, branch string, created_at timestamp, updated_at timestamp",
    "edges": "id string, from_node string, to_node string, kind string, props string, branch string, created_at timestamp, updated_at timestamp",
    "timeline": "id string, parent_id string, branch string, git_commit string, timestamp timestamp, message string, operations array<struct<type:string,bases:array<string>,source_count:int,count:int,archived_count:int,deleted_count:int,base:string,from_model_id:string,to_model_id:string,tag:string,name:string,data:string>>",
    "pending": "id string, branch string, base string, kind string, uri string, added_at timestamp, status string, change_type string, last_error string, metadata string",
    "memory": "id string, created_at timestamp, updated_at timestamp, scope string, source string, title string, text string, tags array<string>, branch string, origin_revision string, extra string",
    "files": "path string, kind string, languages array<string>, file_count bigint",
    "deps": "manager string, name string, version string, scope string, manifest_path string",
    "tech": "kind string, name string, source string, confidence float",
    "ask_log": "timestamp timestamp, branch string, question string, bases array<string>, total_hits int, bundle_path string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the engine's tables as JSON lines: a bad line fails the read, blank lines don't count."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)


#: Folders that a scan never enters, and binary extensions that it skips.
IGNORED = ".git .hg .svn node_modules target dist build .venv venv __pycache__ .next .cache .idea .vscode".split()
BINARY = "png jpg jpeg gif bmp ico webp pdf zip gz tar tgz bz2 xz 7z rar exe dll so dylib a o bin class jar war wasm mp3 mp4 avi mov mkv wav ogg ttf otf woff woff2 eot db sqlite lock".split()


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the lines of an ignore file leave a path out: the last line that fits counts, and one with `!` takes paths in again, below folders that are left out too."""
    out = F.lit(False)
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        start, line = "^" if "/" in line else "(^|/)", line.lstrip("/")
        body = ""
        for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|.", line):
            body += {"**/": "(.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part.startswith("[") and len(part) > 1 else re.escape(part))
        out = F.when(path.rlike(start + body + ("/" if folder else "(/|$)")), F.lit(not back)).otherwise(out)
    return out


def directory(spark: SparkSession, root: str, ignore: list[str] | None = None, ignore_file: list[str] | None = None) -> DataFrame:
    """path (below root), size, mtime, text of the text files below a folder that Spark can read; `ignore` are further patterns of paths, `ignore_file` the lines of an ignore file. Text that isn't UTF-8 is null."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", r"^.*?" + "(?:" + root.rstrip("/").split("://")[-1].lstrip("/").replace(".", r"\.") + ")/", "")
    rows = found.select(below.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    skip = rf"(^|/)({'|'.join(x.replace('.', chr(92) + '.') for x in IGNORED)})/|(^|/)\.[^/]+|\.({'|'.join(BINARY)})$"
    rows = rows.filter(~F.col("path").rlike(skip))
    for pattern in ignore or []:
        rows = rows.filter(~F.col("path").rlike(pattern))
    return rows.filter(~ignored(F.col("path"), ignore_file)) if ignore_file else rows


#: What of a page is left out, where its content is looked for, in order, and the least size of that.
LEFT_OUT = "nav aside header footer script style noscript template [role=navigation] .sidebar .nav .menu .toc .table-of-contents".split()
CONTAINERS = [
    "[data-docs-container]", "[data-docs-content]", ".docs-content", ".markdown-body", ".prose", ".documentation", ".article-content", "article", "main article", "main .content", "[role=main] article", "main", "[role=main]",
    "#content", ".content", "body",
]
LEAST = 500
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HEADS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
BREAK = {"p", "div", "br", "li", "tr", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", *HEADS}


class _Element(NamedTuple):
    tag: str
    attrs: dict[str, str]
    #: Places of the tokens and of the characters where it begins.
    token: int
    char: int

    def fits(self, selector: str) -> bool:
        """A tag, .class, #id, [attribute] or [attribute=value]."""
        if selector[0] == ".":
            return selector[1:] in (self.attrs.get("class") or "").split()
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        if selector[0] == "[":
            name, eq, value = selector[1:-1].partition("=")
            return name in self.attrs and (not eq or self.attrs[name] == value)
        return self.tag == selector


class _Page(HTMLParser):
    """The pieces of a page without what is left out, and the first element of each kind of container."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        #: Elements that are open, with whether each is left out.
        self.open: list[tuple[_Element, bool]] = []
        self.hidden = 0
        self.pieces: list[tuple[str, str, str]] = []
        #: Container: begin, end among the pieces, and characters.
        self.first: dict[str, list[int]] = {}
        self.feed(html)
        self.close()
        self.shut(0, len(html))

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def shut(self, keep: int, char: int) -> None:
        while len(self.open) > keep:
            e, out = self.open.pop()
            self.hidden -= out
            for at in self.first.values():
                if at[0] == e.token and at[2] == -e.char - 1:
                    at[1:] = [len(self.pieces), char - e.char]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = _Element(tag, {k: v or "" for k, v in attrs}, len(self.pieces), self.here())
        out = any(e.fits(s) for s in LEFT_OUT)
        if not (self.hidden or out):
            for c in CONTAINERS:
                *above, own = c.split()
                if c not in self.first and e.fits(own) and (not above or any(o.fits(above[0]) for o, _ in self.open)):
                    self.first[c] = [e.token, -1, -e.char - 1]
            self.pieces.append(("start", tag, e.attrs.get("href", "")))
        if tag not in VOID:
            self.open.append((e, out))
            self.hidden += out

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0].tag == tag), None)
        if at is None:
            return
        hidden = self.hidden
        if not hidden:
            self.pieces.append(("end", tag, ""))
        self.shut(at, self.here() + len(tag) + 3)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(("data", data, ""))


def to_markdown(html: str) -> str:
    """Markdown of the first container whose source is longer than 500 characters, else of the whole page; without navigation."""
    page = _Page(html)
    begin, end = next(((a, b) for a, b, n in (page.first[c] for c in CONTAINERS if c in page.first) if n > LEAST), (0, len(page.pieces)))
    out, links = [], []
    for kind, what, href in page.pieces[begin:end]:
        if kind == "data":
            out.append(re.sub(r"\s+", " ", what))
        elif kind == "start":
            out.append(("\n" if what in BREAK else "") + (HEADS.get(what) or {"li": "- ", "a": "["}.get(what, "")))
            if what == "a":
                links.append(href)
        else:
            out.append((f"]({links.pop()})" if what == "a" and links else "") + ("\n" if what in BREAK else ""))
    lines = [" ".join(x.split()) for x in "".join(out).split("\n")]
    return "\n\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def markdown(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Markdown of pages; null stays null."""
    for s in html:
        yield s.map(lambda h: to_markdown(h) if h is not None else None)
