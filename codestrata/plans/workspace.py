"""A workspace: seven relations about one code base, and the queries that start from it."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from codestrata.operators.graph import PackageGraph
from codestrata.operators.relations import RELATIONS, Dependencies, Files, FunctionCalls, Functions, Matcher, Packages, Types, Variables
from codestrata.operators.tree import TreeNode, tree
from codestrata.sources import snapshot
from codestrata.sources.scan import scan

Reporter = Callable[[str], None]


@dataclass
class Workspace:
    packages: Packages
    files: Files
    types: Types
    functions: Functions
    variables: Variables
    function_calls: FunctionCalls
    dependencies: Dependencies

    @classmethod
    def of(cls, frames: dict[str, DataFrame]) -> Workspace:
        """From a DataFrame for each relation's name."""
        return cls(*[RELATIONS[f.name.replace("_", "")](frames[f.name.replace("_", "")]) for f in fields(cls)])

    def frames(self) -> dict[str, DataFrame]:
        return {f.name.replace("_", ""): getattr(self, f.name).frame for f in fields(self)}

    def create_views(self, prefix: str = "") -> None:
        """The relations as temporary views, for SQL."""
        for name, frame in self.frames().items():
            frame.createOrReplaceTempView(prefix + name)

    def module_root(self) -> str:
        return self.packages.module_root()

    def package_graph(self) -> PackageGraph:
        return PackageGraph.of(self.dependencies)

    def import_tree(self) -> TreeNode:
        return tree(self.dependencies.frame)


_LOADED: dict[tuple[str, bool, str | None], Workspace] = {}
_LOCKS: dict[tuple[str, bool, str | None], threading.Lock] = {}
_GUARD = threading.Lock()


def load_workspace(
    spark: SparkSession, folder: str, *, reporter: Reporter | None = None, in_memory: bool = False, disk_cache: bool = False, disk_cache_dir: str | None = None, include_tests: bool = False
) -> Workspace:
    """The workspace of the Go module in a folder.

    in_memory: one load a process for the same folder and options; callers that come meanwhile wait for it, and
    see its error if it fails. disk_cache: a snapshot that holds while no source file changes, in disk_cache_dir or,
    without one, in the user's cache folder.
    """
    where = disk_cache_dir or (snapshot.default_folder() if disk_cache else None)
    if not in_memory:
        return _load(spark, folder, reporter, where, include_tests)
    key = (os.path.abspath(folder), include_tests, where)
    with _GUARD:
        lock = _LOCKS.setdefault(key, threading.Lock())
    with lock:
        if key not in _LOADED:
            _LOADED[key] = _load(spark, folder, reporter, where, include_tests)
        return _LOADED[key]


def _load(spark: SparkSession, folder: str, reporter: Reporter | None, where: str | None, include_tests: bool) -> Workspace:
    report = reporter or (lambda message: None)
    parse = lambda: scan(spark, folder, report, include_tests)
    frames = snapshot.cached(spark, folder, where, parse, report, include_tests) if where else parse()
    return Workspace.of(frames)


def _matched(relation: Packages | Files | Types | Functions | Variables | FunctionCalls | Dependencies | None, matcher: Matcher | None) -> DataFrame | None:
    return None if relation is None else relation.match(matcher)


def match_packages(ws: Workspace | None, matcher: Matcher | None) -> DataFrame | None:
    """Source locations of the packages that the matcher accepts; None without a workspace. So for the other kinds."""
    return _matched(ws and ws.packages, matcher)


def match_files(ws: Workspace | None, matcher: Matcher | None) -> DataFrame | None:
    return _matched(ws and ws.files, matcher)


def match_types(ws: Workspace | None, matcher: Matcher | None) -> DataFrame | None:
    return _matched(ws and ws.types, matcher)


def match_functions(ws: Workspace | None, matcher: Matcher | None) -> DataFrame | None:
    return _matched(ws and ws.functions, matcher)


def match_variables(ws: Workspace | None, matcher: Matcher | None) -> DataFrame | None:
    return _matched(ws and ws.variables, matcher)


def match_function_calls(ws: Workspace | None, matcher: Matcher | None) -> DataFrame | None:
    return _matched(ws and ws.function_calls, matcher)


def match_dependencies(ws: Workspace | None, matcher: Matcher | None) -> DataFrame | None:
    return _matched(ws and ws.dependencies, matcher)
