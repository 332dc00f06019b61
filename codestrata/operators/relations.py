"""The seven relations as lazily filtered DataFrames.

Each method returns a new relation over a longer plan, so a chain is one conjunction that Catalyst merges
and pushes to the scan. Rows keep their order through the column ord; nothing is sorted before it is read.
Predicates are functions from a row's columns to a Column; a plain Python predicate is accepted through a UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any, Self

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import patterns
from codestrata.functions.modules import common_root
from codestrata.functions.re2 import to_java

from .schema import REF_COLUMNS, SCHEMAS

Matcher = Callable[[SimpleNamespace], Column]


def columns_of(frame: DataFrame) -> SimpleNamespace:
    return SimpleNamespace(**{c: frame[c] for c in frame.columns})


@dataclass(frozen=True)
class ByRow:
    """A predicate on Python values, called row by row in a UDF: slower than one on Columns, and so never by itself."""

    test: Callable[[Any], Any]


def by_row(test: Callable[[Any], Any]) -> ByRow:
    if not callable(test):
        raise TypeError("a predicate is a function")
    return ByRow(test)


def native(matcher: Callable[..., Any] | ByRow, frame: DataFrame) -> Column:
    """The matcher's Column. What goes wrong in the matcher is raised; Python values are had through ``by_row`` alone."""
    if isinstance(matcher, ByRow):
        names, test = frame.columns, matcher.test
        return F.udf(lambda *values: bool(test(SimpleNamespace(**dict(zip(names, values))))), "boolean")(*[frame[c] for c in names])
    return _column(matcher(columns_of(frame)))


def _column(made: Any) -> Column:
    if isinstance(made, bool):
        return F.lit(made)
    if not isinstance(made, Column):
        raise TypeError(f"a predicate returns a Column, not {type(made).__name__}; wrap one on Python values in by_row()")
    return made


class Relation:
    """Rows of one kind, and the filters that all kinds have."""

    name = ""
    package_column = "package_id"

    def __init__(self, frame: DataFrame) -> None:
        self.frame = frame

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[dict[str, Any] | Row | tuple]) -> Self:
        """A relation of literal rows; columns that a dict leaves out are absent, ord is the place in the list."""
        empty = {"string": "", "int": 0, "bigint": 0, "boolean": False}
        made = []
        for k, row in enumerate(rows):
            if isinstance(row, dict):
                row = {"ord": k} | row
                row = tuple(row.get(f.name, empty.get(f.dataType.simpleString(), [])) for f in SCHEMAS[cls.name])
            made.append(row)
        return cls(spark.createDataFrame(made, SCHEMAS[cls.name]))

    def plus(self, other: Self) -> Self:
        """The rows of both, duplicates included."""
        return type(self)(self.frame.unionByName(other.frame))

    def where(self, condition: Column) -> Self:
        return type(self)(self.frame.where(condition))

    def _file(self) -> Column:
        return F.col("filename")

    def _test(self) -> Column:
        return patterns.is_test_file(self._file())

    def in_package(self, *names: str) -> Self:
        """Rows of packages that match any pattern; without patterns, all rows."""
        return self.where(patterns.package_matches(F.col(self.package_column), *names)) if names else self

    def not_in_package(self, *names: str) -> Self:
        return self.where(~patterns.package_matches(F.col(self.package_column), *names)) if names else self

    def is_test(self) -> Self:
        return self.where(self._test())

    def is_not_test(self) -> Self:
        return self.where(~self._test())

    in_test = is_test
    not_in_test = is_not_test

    def matching(self, matcher: Matcher) -> Self:
        return self.where(native(matcher, self.frame))

    def match(self, matcher: Matcher | None) -> DataFrame:
        """The source locations of the rows that the matcher accepts; of none without a matcher."""
        return (self.where(F.lit(False)) if matcher is None else self.matching(matcher)).refs()

    def refs(self) -> DataFrame:
        return self.frame.select(*REF_COLUMNS)

    def all(self) -> list[Row]:
        return self.frame.orderBy("ord").collect()

    def len(self) -> int:
        return self.frame.count()

    __len__ = len

    def count(self) -> DataFrame:
        """The number of rows, as a row."""
        return self.frame.agg(F.count(F.lit(1)).alias("n"))


class Named(Relation):
    """Relations whose rows declare a name."""

    def is_exported(self) -> Self:
        return self.where(patterns.is_exported(F.col("name")))

    def is_unexported(self) -> Self:
        return self.where(~patterns.is_exported(F.col("name")))

    def name_matches(self, test: Callable[[Any], Any]) -> Self:
        """Names that a predicate accepts: from Column to Column, or, wrapped in ``by_row``, from str to bool."""
        return self.where(name_test(test))

    def name_matches_regex(self, pattern: str) -> Self:
        """Names in which the RE2 pattern is found; an invalid pattern raises ValueError here."""
        return self.where(F.col("name").rlike(to_java(pattern)))


def name_test(test: Callable[[Any], Any] | ByRow) -> Column:
    if isinstance(test, ByRow):
        own = test.test
        return F.udf(lambda n: bool(own(n)), "boolean")(F.col("name"))
    if not callable(test):
        raise TypeError("a name predicate is a function")
    return _column(test(F.col("name")))


def attached(frame: DataFrame, key: str, dependencies: Dependencies, by: str) -> DataFrame:
    """frame with a column imports: the import paths, in order, of the dependencies whose column by equals key."""
    held = dependencies.frame.groupBy(F.col(by).alias("of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "import_path"))), lambda x: x["import_path"]).alias("imports"))
    joined = frame.join(held, F.col(key) == F.col("of"), "left").drop("of")
    return joined.withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


class Packages(Relation):
    name = "packages"
    package_column = "id"

    def _test(self) -> Column:
        return F.exists("files", patterns.is_test_file)

    def refs(self) -> DataFrame:
        """A package is located at its first file, by its package clause if the scan has its position."""
        placed = self.frame.withColumns({
            "package_id": F.col("id"), "package_name": F.col("name"), "kind": F.lit("package"),
            "match": F.concat(F.lit("package "), F.col("name")),
            "filename": F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.try_element_at("files", F.lit(1)), F.lit("")),
            "col": F.when(F.col("line") > 0, F.col("col")).otherwise(1), "line": F.greatest("line", F.lit(1)),
        })
        return placed.select(*REF_COLUMNS)

    def with_dependencies(self, dependencies: Dependencies) -> DataFrame:
        """Each package with its dependencies' import paths in order; they meet by package id."""
        return attached(self.frame, "id", dependencies, "package_id")

    def group_by(self, key: Callable[[SimpleNamespace], Column]) -> DataFrame:
        """key and its package ids in order; rows whose key is empty are left out."""
        made = key(columns_of(self.frame))
        if not isinstance(made, Column):
            raise TypeError("a group key is a function from columns to a Column")
        keyed = self.frame.select(made.alias("key"), "ord", "id").where("key <> ''")
        return keyed.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("packages"))

    def groups(self, key: Callable[[SimpleNamespace], Column]) -> dict[str, Packages]:
        """A lazily filtered relation for each key."""
        made = key(columns_of(self.frame))
        keys = self.frame.select(made.alias("key")).where("key <> ''").distinct().collect()
        return {r["key"]: self.where(made == r["key"]) for r in keys}

    def root_bounds(self) -> DataFrame:
        return self.frame.agg(F.min("id").alias("least"), F.max("id").alias("greatest"))

    def module_root(self) -> str:
        """The path that all package ids share; '' without packages."""
        found = self.root_bounds().first()
        return common_root(found["least"], found["greatest"])


class Files(Relation):
    name = "files"

    def _file(self) -> Column:
        return F.col("file_filename")

    def without(self, dependencies: Dependencies) -> Files:
        """Files that have none of the dependencies."""
        return Files(self.frame.join(dependencies.frame.select(F.col("filename").alias("of")).distinct(), F.col("file_filename") == F.col("of"), "left_anti"))

    def having(self, dependencies: Dependencies) -> Files:
        return Files(self.frame.join(dependencies.frame.select(F.col("filename").alias("of")).distinct(), F.col("file_filename") == F.col("of"), "left_semi"))

    def with_dependencies(self, dependencies: Dependencies) -> DataFrame:
        """Each file with its dependencies' import paths in order; they meet by file name alone."""
        return attached(self.frame, "file_filename", dependencies, "filename")


class Types(Named):
    name = "types"


class Functions(Named):
    name = "functions"

    def is_method(self) -> Self:
        return self.where(F.col("receiver") != "")

    def is_function(self) -> Self:
        return self.where(F.col("receiver") == "")

    def has_receiver(self, part: str) -> Self:
        return self.where(F.col("receiver").contains(part))


class Variables(Named):
    name = "variables"


class FunctionCalls(Relation):
    name = "functioncalls"


class Dependencies(Relation):
    name = "dependencies"

    def is_within_workspace(self) -> Self:
        return self.where(F.col("within_workspace"))

    def is_external(self) -> Self:
        return self.where(F.col("external"))

    def is_standard_library(self) -> Self:
        return self.where(F.col("standard_library"))

    def is_third_party(self) -> Self:
        return self.where(F.col("external") & ~F.col("standard_library"))

    def depend_on(self, *names: str) -> Self:
        return self.where(patterns.package_matches(F.col("import_path"), *names)) if names else self

    depends_on = depend_on

    def do_not_depend_on(self, *names: str) -> Self:
        return self.where(~patterns.package_matches(F.col("import_path"), *names)) if names else self

    def unique_targets(self) -> DataFrame:
        return self.frame.select("import_path").distinct().orderBy("import_path")

    def unique_source_packages(self) -> DataFrame:
        return self.frame.select("package_id").distinct().orderBy("package_id")

    def group_by_source_package(self) -> DataFrame:
        """package_id, how many dependencies it has, and its distinct import paths in order."""
        return self.frame.groupBy("package_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("import_path")).alias("targets"))

    def group_by_target_package(self) -> DataFrame:
        """import_path, how many dependencies have it, and the distinct packages that do, in order."""
        return self.frame.groupBy("import_path").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("package_id")).alias("sources"))

    def rows_by_source_package(self) -> DataFrame:
        """The rows, those of a package together and in their order. A range sort splits a package of any size over tasks."""
        return self.frame.orderBy("package_id", "ord")

    def rows_by_target_package(self) -> DataFrame:
        """The rows, those with an import path together and in their order."""
        return self.frame.orderBy("import_path", "ord")

    def targets_by_source_package(self) -> DataFrame:
        """package_id, import_path, n: a row for each pair, so that no package's targets are gathered in one row."""
        return self.frame.groupBy("package_id", "import_path").agg(F.count(F.lit(1)).alias("n")).orderBy("package_id", "import_path")

    def by_source_package(self) -> dict[str, Dependencies]:
        """A lazily filtered relation for each source package."""
        return {r["package_id"]: self.where(F.col("package_id") == r["package_id"]) for r in self.unique_source_packages().collect()}

    def by_target_package(self) -> dict[str, Dependencies]:
        return {r["import_path"]: self.where(F.col("import_path") == r["import_path"]) for r in self.unique_targets().collect()}


RELATIONS: dict[str, type[Relation]] = {c.name: c for c in (Packages, Files, Types, Functions, Variables, FunctionCalls, Dependencies)}
