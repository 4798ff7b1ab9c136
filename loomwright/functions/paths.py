"""What a path tells: base, kind, language, type, label, route, imports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.rules import ARCHIVES, COMMON_NAMES, DOC_EXTENSIONS, HTTP_METHODS, IMPORT_ENDINGS, LANGUAGE_TAGS, LANGUAGES, PLAIN_FOLDERS


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """In lower case; empty without a point."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def is_url(path: Column) -> Column:
    return path.rlike(r"^(?i)https?://")


def base_of(path: Column) -> Column:
    """docs for URLs and document formats, else code."""
    return F.when(is_url(path) | extension(path).isin(DOC_EXTENSIONS), "docs").otherwise("code")


def kind_of(path: Column) -> Column:
    """url, archive, directory (a slash at the end), file (an extension) or unknown."""
    return F.when(is_url(path), "url").when(extension(path).isin(ARCHIVES), "archive").when(path.endswith("/"), "directory").when(extension(path) != "", "file").otherwise("unknown")


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("other"))


def tag_of(path: Column) -> Column:
    """The language as ids of symbols have it: scripts with types and without are told apart."""
    table = F.create_map(*[F.lit(x) for tag, ends in LANGUAGE_TAGS.items() for e in ends.split() for x in (e, tag)])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("unknown"))


def type_of(path: Column) -> Column:
    """The kind of file a name suggests; the first rule that fits counts."""
    f = F.lower(file_name(path))
    return (
        F.when(F.contains(f, F.lit("config")) | (f == "package.json"), "config")
        .when(f.rlike(r"\.(css|scss|sass|less)$"), "stylesheet")
        .when(f.endswith(".md") | F.contains(f, F.lit("readme")) | (f == "changelog"), "documentation")
        .when(f.rlike(r"\.(jsx|tsx)$"), "component")
        .when(f.rlike(r"^use.*\.(js|ts)$"), "hook")
        .when(f.rlike("helper|util|lib"), "utility")
        .when(f.rlike("api|service|client"), "api")
        .when(f.rlike(r"\.(js|ts)$"), "script")
        .when(f.endswith(".html"), "markup")
        .when(f.endswith(".json"), "data")
        .otherwise("code")
    )


def label_of(path: Column) -> Column:
    """The file name, with the folder above (or the one above that) where the name alone says little."""
    parts = F.split(path, "/")
    name, up, over = (F.coalesce(F.get(parts, F.size(parts) - i), F.lit("")) for i in (1, 2, 3))
    useful = lambda c: (c != "") & ~c.isin(PLAIN_FOLDERS)
    return F.when(~name.isin(COMMON_NAMES), name).when(useful(up), F.concat_ws("/", up, name)).when((up != "") & useful(over), F.concat_ws("/", over, name)).otherwise(name)


def route_of(path: Column) -> Column:
    """The API route of a route file, or null: five layouts, tried in order."""
    p = F.regexp_replace(path, r"\\", "/")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(\.tsx)+$", ""), r"(\.jsx)+$", ""), r"(\.ts)+$", ""), r"(\.js)+$", "")
    no_route, no_index = F.regexp_replace(bare, "(/route)+$", ""), F.regexp_replace(bare, "(/index)+$", "")
    file = p.rlike(r"(?i)/route\.(ts|tsx|js|jsx)$")
    script = p.rlike(r"(?i)\.(ts|tsx|js|jsx)$")
    cut = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    return (
        F.when(p.rlike("(?i)/app/api/"), cut(no_route, r"(?i)/app(/api/.*)$"))
        .when(p.rlike("(?i)/app/") & p.rlike("(?i)/api/") & file, cut(no_route, r"(?i)(/api/.*)$"))
        .when(p.rlike("(?i)/pages/api/"), cut(no_index, r"(?i)/pages(/api/.*)$"))
        .when(p.rlike(r"(?i)^(src/)?app/api/") & file, cut(no_route, r"(?i)^(?:src/)?app(/.*)$"))
        .when(p.rlike(r"(?i)^(src/)?pages/api/") & script, cut(no_index, r"(?i)^(?:src/)?pages(/.*)$"))
    )


def methods_of(text: Column) -> Column:
    """HTTP methods that a route file exports, each once, in order; GET where there is no text."""
    names = "|".join(HTTP_METHODS)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"export\s+(?:async\s+)?(?:function|const)\s+({names})\b"), F.lit(1)))
    return F.coalesce(found, F.array(F.lit("GET")))


def join_path(folder: Column, relative: Column) -> Column:
    """relative as seen from folder, without . and .. parts."""
    whole = F.when(relative.startswith("/"), relative).otherwise(F.concat_ws("/", folder, relative))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))), "/")


def import_stem(source: Column, target: Column) -> Column:
    """The path that an import names, its ending open; null unless it starts with . or /."""
    folder = F.regexp_extract(source, r"^(.*)/[^/]*$", 1)
    return F.when(target.rlike(r"^[./]"), join_path(folder, target))


def import_stems(path: Column) -> Column:
    """array of struct(rank, stem): the stems that a file answers to, each with the place of the ending that leads from it to the file."""
    ends = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("end")) for i, e in enumerate(IMPORT_ENDINGS)])
    return F.transform(F.filter(ends, lambda x: F.endswith(path, x["end"])), lambda x: F.struct(x["rank"].alias("rank"), F.substr(path, F.lit(1), F.length(path) - F.length(x["end"])).alias("stem")))


#: The name of a branch.
BRANCH = r"(?!/)(?!.*//)[A-Za-z0-9._/-]+(?<!/)"


def good_branch(name: Column) -> Column:
    return name.rlike(f"^{BRANCH}$")
