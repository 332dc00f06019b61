"""Source locations as text: one ref as a Column expression, and many as one string on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RefFormat:
    """What a formatted ref shows. The kind is shown only where the match text is off or empty."""

    package: bool = False
    kind: bool = False
    file: bool = True
    line: bool = True
    column: bool = True
    match: bool = True
    separator: str = "\n"


DEFAULT = RefFormat()
#: As rules report their violations.
REPORT = RefFormat(package=True, kind=True)


def location(options: RefFormat = DEFAULT) -> Column:
    """``file:line:col``; without a file ``line=L:C``, with neither ``column=C``; values below 1 are left out."""
    file = F.col("filename") if options.file else F.lit("")
    has_line = F.col("line") > 0 if options.line else F.lit(False)
    has_column = F.col("col") > 0 if options.column else F.lit(False)
    line, column = F.col("line").cast("string"), F.col("col").cast("string")
    with_line = F.when(has_line, F.when(file != "", F.concat(file, F.lit(":"), line)).otherwise(F.concat(F.lit("line="), line))).otherwise(file)
    with_column = F.when(with_line != "", F.concat(with_line, F.lit(":"), column)).otherwise(F.concat(F.lit("column="), column))
    return F.when(has_column, with_column).otherwise(with_line)


def format_ref(options: RefFormat = DEFAULT) -> Column:
    """One ref as text, from the ref columns of a row."""
    none = F.lit(None).cast("string")
    place = F.nullif(location(options), F.lit(""))
    package = F.when(F.col("package_id") != "", F.concat(F.lit("package "), F.col("package_id"))) if options.package else none
    kind = F.nullif(F.col("kind"), F.lit(""))
    text = F.nullif(F.col("match"), F.lit("")) if options.match else none
    shown = F.coalesce(text, kind) if options.kind else text
    return F.coalesce(F.nullif(F.concat_ws(" ", place, package, shown), F.lit("")), kind, F.lit("ref"))


def join_refs(texts: Iterable[str], separator: str = "\n") -> str:
    """Formatted refs as one string: bullets if there are several, one to a line."""
    texts = list(texts)
    if len(texts) > 1 and separator == "\n":
        texts = [f"* {t}" for t in texts]
    return separator.join(texts)


def joined(refs: DataFrame, separator: str) -> str:
    """All refs of a result, formatted by default, between separators and without bullets."""
    return separator.join(r["text"] for r in refs.select("ord", format_ref().alias("text")).orderBy("ord").collect())


def format_refs(refs: DataFrame, options: RefFormat = DEFAULT) -> str:
    """All refs of a result, in their order, as one string. For results that are meant to be read."""
    rows = refs.select("ord", format_ref(options).alias("text")).orderBy("ord").collect()
    return join_refs((r["text"] for r in rows), options.separator)


def ref_text(ref: Any, options: RefFormat = DEFAULT) -> str:
    """format_ref for one row on the driver."""
    place = ref["filename"] if options.file else ""
    if options.line and ref["line"] > 0:
        place = f"{place}:{ref['line']}" if place else f"line={ref['line']}"
    if options.column and ref["col"] > 0:
        place = f"{place}:{ref['col']}" if place else f"column={ref['col']}"
    package = f"package {ref['package_id']}" if options.package and ref["package_id"] else ""
    shown = (options.match and ref["match"]) or (options.kind and ref["kind"]) or ""
    return " ".join(p for p in (place, package, shown) if p) or ref["kind"] or "ref"
