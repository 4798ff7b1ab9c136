"""Project inventory: languages, managers, technologies, dependencies from manifests."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright import rules
from loomwright.functions import paths
from loomwright.rules import LOCK_FILES

#: Packages and what they tell: (family, package, kind, tag).
TECHNOLOGIES = [
    (family, package, kind, tag)
    for family, rows in (("js", rules.JS_TECHNOLOGIES), ("python", rules.PYTHON_TECHNOLOGIES), ("rust", rules.RUST_TECHNOLOGIES), ("go", rules.GO_TECHNOLOGIES), ("ruby", rules.RUBY_TECHNOLOGIES), ("php", rules.PHP_TECHNOLOGIES))
    for kind, tag, packages in rows
    for package in packages.split()
]
FAMILY = {"npm": "js", "composer": "php", "cargo": "rust", "pip": "python", "poetry": "python", "pipenv": "python", "go": "go", "bundler": "ruby"}
DEPENDENCY = "manager string, name string, version string, scope string, manifest_path string"


def language_counts(files: DataFrame) -> DataFrame:
    """files (path): language and number of files."""
    return files.groupBy(paths.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def best_per(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """For each key the value of the least place; ties go to the least value."""
    return rows.groupBy(key).agg(F.min(F.struct(place, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def managers(files: DataFrame) -> DataFrame:
    """ecosystem, manager: the strongest lock or manifest file of each."""
    known = F.broadcast(files.sparkSession.createDataFrame(LOCK_FILES, "file string, manager string, ecosystem string, place int"))  # the fixed table
    return best_per(files.withColumn("file", paths.file_name(F.col("path"))).join(known, "file"), "ecosystem", "manager", "place")


def first_by(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Of rows of one name the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(*order))).filter("_n = 1").drop("_n")


def technologies(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """kind, name, source, confidence: languages, then dependencies, then files; the first to name a technology counts."""
    spark = files.sparkSession
    langs = language_counts(files).filter("language != 'other'").select(F.lit(0).alias("o"), F.lit("language").alias("kind"), F.initcap("language").alias("name"), F.lit("languages").alias("source"), F.lit(0.9).alias("confidence"))
    family = F.create_map(*[F.lit(x) for p in FAMILY.items() for x in p])
    known = F.broadcast(spark.createDataFrame(TECHNOLOGIES, "family string, package string, kind string, tag string"))  # the fixed table
    deps = dependencies.withColumn("family", F.element_at(family, F.col("manager"))).withColumnRenamed("name", "package_name")
    fits = (F.col("d.family") == F.col("k.family")) & ((F.col("package_name") == F.col("package")) | ((F.col("k.family") == "go") & F.contains("package_name", F.col("package"))))
    from_deps = deps.alias("d").join(known.alias("k"), fits).select(F.lit(1).alias("o"), "kind", F.col("tag").alias("name"), F.concat_ws(":", F.lit("dependency"), "package_name").alias("source"), F.lit(0.9).alias("confidence"))
    tags = F.array(*[F.when(F.col("path").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("name"))) for p, k, t in rules.FILE_TAGS])
    from_files = files.select("path", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("t")).select(F.lit(2).alias("o"), "t.kind", "t.name", F.concat_ws(":", F.lit("file"), "path").alias("source"), F.lit(0.85).alias("confidence"))
    return first_by(langs.unionByName(from_deps).unionByName(from_files), "name", ["o", "source"]).drop("o")


def parse_manifest(path: str, text: str) -> list[tuple[str, str, str, str]]:
    """(manager, name, version, scope) of the dependencies that a manifest lists; nothing for one that can't be parsed."""
    name = path.rsplit("/", 1)[-1]
    out: list[tuple[str, str, str, str]] = []

    def add(manager: str, table: dict | None, scope: str) -> None:
        for k, v in (table or {}).items():
            version = v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else ""
            out.append((manager, k, version, scope))

    def pep508(line: str, manager: str, scope: str) -> None:
        line = line.split("#", 1)[0].split(";", 1)[0].strip()
        if m := re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$", line):
            out.append((manager, m[1], m[2].strip().strip("()"), scope))

    try:
        if name == "package.json":
            data = json.loads(text)
            for key, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
                add("npm", data.get(key), scope)
        elif name == "composer.json":
            data = json.loads(text)
            add("composer", data.get("require"), "runtime")
            add("composer", data.get("require-dev"), "dev")
        elif name == "Cargo.toml":
            data = tomllib.loads(text)
            for key, scope in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
                add("cargo", data.get(key), scope)
                add("cargo", data.get("workspace", {}).get(key), scope)
        elif name == "pyproject.toml":
            data = tomllib.loads(text)
            for line in data.get("project", {}).get("dependencies", []):
                pep508(line, "pip", "runtime")
            for lines in data.get("project", {}).get("optional-dependencies", {}).values():
                for line in lines:
                    pep508(line, "pip", "optional")
            poetry = data.get("tool", {}).get("poetry", {})
            add("poetry", {k: v for k, v in poetry.get("dependencies", {}).items() if k != "python"}, "runtime")
            add("poetry", poetry.get("dev-dependencies"), "dev")
            for group, body in poetry.get("group", {}).items():
                add("poetry", body.get("dependencies"), "dev" if group == "dev" else group)
        elif re.fullmatch(r"requirements.*\.txt", name):
            for line in text.splitlines():
                if line.strip() and not line.strip().startswith(("#", "-")):
                    pep508(line, "pip", "dev" if "dev" in name else "runtime")
        elif name == "Pipfile":
            data = tomllib.loads(text)
            add("pipenv", data.get("packages"), "runtime")
            add("pipenv", data.get("dev-packages"), "dev")
        elif name == "go.mod":
            for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)(.*)$", text):
                out.append(("go", m[1], m[2], "indirect" if "indirect" in m[3] else "runtime"))
        elif name == "Gemfile":
            dev = False
            for line in text.splitlines():
                line = line.strip()
                if line.startswith("group"):
                    dev = bool(re.search(r":(development|test)", line))
                elif line == "end":
                    dev = False
                elif m := re.match(r"""gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?""", line):
                    out.append(("bundler", m[1], m[2] or "", "dev" if dev else "runtime"))
    except (ValueError, AttributeError, TypeError):
        return []
    return out


def dependencies(manifests: DataFrame) -> DataFrame:
    """manifests (path, text): their dependencies."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(*d, p) for p, t in zip(pdf.path, pdf.text.fillna(""), strict=True) for d in parse_manifest(p, t)]
            yield pd.DataFrame(rows, columns=["manager", "name", "version", "scope", "manifest_path"])

    return manifests.select("path", "text").mapInPandas(parse, DEPENDENCY)


def in_order(files: DataFrame, *keys: str | Column) -> DataFrame:
    return files.orderBy(*keys)
