"""Predicates on package ids, file names and identifiers, as native Column expressions.

All columns are taken to be non-null ('' stands for absent), so a negated predicate keeps what it should.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TREE = "/..."


def _one(column: Column, pattern: str) -> Column | None:
    if not pattern:
        return None
    if not pattern.endswith(TREE):
        return column == pattern
    base = pattern[: -len(TREE)]
    return (column == base) | column.startswith(base + "/") if base else None


def package_matches(column: Column, *patterns: str) -> Column:
    """Whether a package id matches any pattern: equality, or with a trailing ``/...`` the package and all below it.

    No pattern, an empty id and an empty pattern match nothing. Equality and prefix tests reach the Parquet scan.
    """
    tests = [t for t in (_one(column, p) for p in patterns) if t is not None]
    return reduce(or_, tests) if tests else F.lit(False)


def is_test_file(column: Column) -> Column:
    """File names that end in ``_test.go``; the suffix holds no separator, so either kind may precede it."""
    return column.endswith("_test.go")


def is_exported(column: Column) -> Column:
    """Names whose first character is an upper-case letter."""
    return column.rlike(r"^\p{Lu}")


def is_standard_library(column: Column) -> Column:
    """The heuristic for import paths: no dot anywhere."""
    return ~column.contains(".")
