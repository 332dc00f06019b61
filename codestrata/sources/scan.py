"""Scan of a Go module's source files into the seven relations.

Spark lists and reads the files, executors parse them, and one row per file is written to the scratch folder;
each relation is an explode of one of its columns. Only the names of the packages go through the driver's plan
again, as the other side of the join that says which imports lie within the workspace.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.patterns import is_standard_library
from codestrata.operators.schema import SCHEMAS

from .goparse import parse
from .scratch import saved

#: Systems and machines that a file name's suffix can name (fixed values of the toolchain).
SYSTEMS = frozenset("aix android darwin dragonfly freebsd hurd illumos ios js linux nacl netbsd openbsd plan9 solaris wasip1 windows zos".split())
MACHINES = frozenset("386 amd64 amd64p32 arm arm64 armbe arm64be loong64 mips mips64 mips64le mips64p32 mips64p32le mipsle ppc ppc64 ppc64le riscv riscv64 s390 s390x sparc sparc64 wasm".split())
UNIX = frozenset("aix android darwin dragonfly freebsd hurd illumos ios linux netbsd openbsd solaris".split())
BUILD = re.compile(rb"^\s*//go:build\s+(.+)$", re.M)
CLAUSE = re.compile(rb"^\s*package\s", re.M)
MODULE = re.compile(r"^\s*module\s+(?:\"([^\"]+)\"|`([^`]+)`|(\S+))", re.M)
VERSION = re.compile(r"go1\.\d+")

PARSED = (
    "package_id string, package_name string, filename string, test boolean, line int, col int, pkg_line int, pkg_col int, error_pos string, error_msg string, "
    "imports array<struct<line int, col int, path string, alias string>>, types array<struct<line int, col int, match string, name string, kind string>>, "
    "functions array<struct<line int, col int, match string, name string, receiver string>>, variables array<struct<line int, col int, match string, name string, kind string>>, "
    "calls array<struct<line int, col int, match string, callee string>>"
)


def tags(system: str = "linux", machine: str = "amd64") -> Callable[[str], bool]:
    """Which build tags hold."""
    return lambda t: t in (system, machine, "gc", "cgo") or t == "unix" and system in UNIX or bool(VERSION.fullmatch(t))


def name_fits(name: str, holds: Callable[[str], bool]) -> bool:
    """Whether the _GOOS, _GOARCH or _GOOS_GOARCH suffix of a file's name, if any, holds."""
    parts = name.removesuffix(".go").removesuffix("_test").split("_")[1:]
    if len(parts) >= 2 and parts[-2] in SYSTEMS and parts[-1] in MACHINES:
        return holds(parts[-2]) and holds(parts[-1])
    return not parts or parts[-1] not in SYSTEMS | MACHINES or holds(parts[-1])


def build_fits(data: bytes, holds: Callable[[str], bool]) -> bool:
    """Whether the build constraint before the package clause, if any, holds."""
    clause = CLAUSE.search(data)
    found = BUILD.search(data, 0, clause.start() + 1 if clause else len(data))
    if not found:
        return True
    words = re.findall(r"&&|\|\||[!()]|[\w.]+", found[1].decode("utf-8", "replace"))
    at = 0

    def either() -> bool:
        nonlocal at
        value = both()
        while at < len(words) and words[at] == "||":
            at += 1
            value = both() or value
        return value

    def both() -> bool:
        nonlocal at
        value = one()
        while at < len(words) and words[at] == "&&":
            at += 1
            value = one() and value
        return value

    def one() -> bool:
        nonlocal at
        if at >= len(words):
            return False
        word = words[at]
        at += 1
        if word == "!":
            return not one()
        if word == "(":
            value = either()
            at += 1
            return value
        return holds(word)

    return either()


def _url(folder: str) -> str:
    return folder.rstrip("/") if "://" in folder else "file://" + os.path.abspath(folder)


def _plain(path: str) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*:/*(?=/)", "", path)


def _listed(spark: SparkSession, url: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(url)


def module_of(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """The import path of a folder, and the folders below it that are modules of their own."""
    url = _url(folder)
    root = _plain(url)
    found = {os.path.dirname(_plain(r["path"])): bytes(r["content"]).decode("utf-8", "replace") for r in _listed(spark, url, "go.mod").select("path", "content").toLocalIterator()}
    text, above = found.pop(root, None), ""
    at = root
    while text is None and "://" not in folder and at != os.path.dirname(at):  # a folder inside a module
        above = f"/{os.path.basename(at)}{above}"
        at = os.path.dirname(at)
        if os.path.isfile(f"{at}/go.mod"):
            with open(f"{at}/go.mod") as f:
                text = f.read()
    name = MODULE.search(text or "")
    if not name:
        raise FileNotFoundError(f"no go.mod with a module path for {folder}")
    return next(g for g in name.groups() if g) + above, sorted(found)


def scan(spark: SparkSession, folder: str, report: Callable[[str], None] = lambda message: None, include_tests: bool = False) -> dict[str, DataFrame]:
    """The seven relations of the module in a folder; an error if it has no package."""
    report("Loading packages...")
    module, nested = module_of(spark, folder)
    url = _url(folder)
    root = _plain(url)
    holds = tags()

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                path, data = _plain(path), bytes(data)
                at, name = os.path.dirname(path), os.path.basename(path)
                parts = [p for p in at[len(root) :].split("/") if p]
                if any(p in ("testdata", "vendor") or p[0] in "._" for p in parts) or name[0] in "._":
                    continue
                if any(at == n or at.startswith(n + "/") for n in nested):
                    continue
                test = name.endswith("_test.go")
                if test and not include_tests or not name_fits(name, holds) or not build_fits(data, holds):
                    continue
                p = parse(data)
                if max(map(len, (p.imports, p.types, p.functions, p.variables, p.calls))) > PER_FILE:
                    raise ValueError(f"{path}: more than {PER_FILE} rows of one kind in a file")
                package = "/".join([module, *parts]) + ("_test" if test and p.package.endswith("_test") else "")
                pos, message = p.error or ("", "")
                rows.append((package, p.package, path, test, *p.file_place, *p.package_place, f"{path}:{pos}" if message else "", message, p.imports, p.types, p.functions, p.variables, p.calls))
            names = [c.split()[0] for c in re.split(r", (?=\w+ (?:string|int|boolean|array))", re.sub(r"struct<[^>]*>", "x", PARSED))]
            yield pd.DataFrame(rows, columns=names)

    parsed = _listed(spark, url, "*.go").select("path", "content").mapInPandas(rows_of, PARSED)
    files = saved(parsed.orderBy("package_id", "filename").withColumn("seq", F.monotonically_increasing_id()), "scan")
    if files.isEmpty():
        raise FileNotFoundError(f"no packages found in {folder}")
    return relations(files, report)


#: A file's rows are numbered below this; ord is the file's number times this, and the row's own.
PER_FILE = 1 << 20


def relations(files: DataFrame, report: Callable[[str], None] = lambda message: None) -> dict[str, DataFrame]:
    """The relations of parsed files."""
    number = F.shiftright("seq", 33) * (1 << 43) + F.col("seq").bitwiseAND((1 << 33) - 1) * PER_FILE

    def typed(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*[F.coalesce(F.col(f.name).cast(f.dataType.simpleString()), _absent(f.dataType.simpleString())).alias(f.name) for f in SCHEMAS[name]])

    def _absent(kind: str) -> Column:
        return F.lit("") if kind == "string" else F.lit(False) if kind == "boolean" else F.lit(0).cast(kind) if "array" not in kind else F.array().cast(kind)

    def entries(relation: str, column: str, label: str, **own: str) -> DataFrame:
        each = files.select(number.alias("base"), "package_id", "package_name", "filename", F.posexplode(column).alias("k", "e"))
        made = each.select((F.col("base") + F.col("k")).alias("ord"), "package_id", "package_name", "filename", "e.line", "e.col", F.lit(label).alias("kind"), F.col("e.match").alias("match"), *[F.col(f"e.{v}").alias(k) for k, v in own.items()])
        return typed(made, relation)

    per_package = files.groupBy("package_id").agg(
        F.min("seq").alias("first"), F.min_by("package_name", "seq").alias("package_name"), F.min_by("pkg_line", "seq").alias("line"), F.min_by("pkg_col", "seq").alias("col"),
        F.sort_array(F.collect_list(F.struct("seq", "filename", "error_pos", "error_msg"))).alias("held"),
    )
    broken = F.transform(F.filter("held", lambda x: x["error_msg"] != ""), lambda x: F.struct(x["error_pos"].alias("pos"), x["error_msg"].alias("msg"), F.lit(2).alias("kind")))
    packages = per_package.select(
        F.col("first").alias("ord"), "package_id", "package_name", F.col("held")[0]["filename"].alias("filename"), "line", "col", F.lit("package").alias("kind"),
        F.concat(F.lit("package "), "package_name").alias("match"), F.col("package_id").alias("id"), F.col("package_name").alias("name"),
        F.transform("held", lambda x: x["filename"]).alias("files"), broken.alias("errors"),
    )
    own = files.select(
        number.alias("ord"), "package_id", "package_name", "filename", "line", "col", F.lit("file").alias("kind"),
        F.when(F.col("package_name") != "", F.concat(F.lit("file package "), "package_name")).otherwise("file").alias("match"), F.col("filename").alias("file_filename"),
    )
    imports = files.select(number.alias("base"), "package_id", "package_name", "filename", F.posexplode("imports").alias("k", "e"))
    ids = files.select(F.col("package_id").alias("path"), F.lit(True).alias("known")).distinct()
    placed = imports.select((F.col("base") + F.col("k")).alias("ord"), "package_id", "package_name", "filename", "e.line", "e.col", F.col("e.path").alias("path"), F.col("e.alias").alias("target_package_name"))
    joined = placed.join(ids, "path", "left").withColumn("within_workspace", F.coalesce("known", F.lit(False)))
    where = F.when(F.col("within_workspace"), F.lit(" (workspace)")).otherwise(F.lit(" (external)"))
    dependencies = joined.select(
        "ord", "package_id", "package_name", "filename", "line", "col", F.lit("dependency").alias("kind"), F.concat(F.lit("dependency "), "path", where).alias("match"),
        F.col("path").alias("import_path"), "within_workspace", (~F.col("within_workspace")).alias("external"), is_standard_library(F.col("path")).alias("standard_library"), "target_package_name",
    )
    report("Indexed.")
    return {
        "packages": typed(packages, "packages"), "files": typed(own, "files"), "types": entries("types", "types", "type", name="name", type_kind="kind"),
        "functions": entries("functions", "functions", "function", name="name", receiver="receiver"), "variables": entries("variables", "variables", "variable", name="name", var_kind="kind"),
        "functioncalls": entries("functioncalls", "calls", "functioncall", callee="callee"), "dependencies": typed(dependencies, "dependencies"),
    }
