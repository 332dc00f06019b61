r"""Operator 4: substring deduplication by hashing of lines and their clauses.

A text is cut into units: lines, cut again after ``.``, ``!``, ``?``, ``;``, ``:`` and ``,``, because passages
recur inside lines. A unit is normalised (A-Z in lower case, words joined by one space) and digested. Of equal
units in the whole corpus the earliest, by doc_id and then place, is the original; the others are repeats.
Neighbouring repeats are a run; units without words between two repeats belong to it. A run of ``least`` words
or more is a copied passage and is removed, each unit with its original offsets in code points. So text that
occurs once always stays, and so does a short phrase that many documents share; ``least=1`` removes every repeat.

Digests are grouped once. A worker first drops the repeats within each ROWS texts that it reads, which are
never the earliest, so even a unit that a third of all texts hold reaches its group only once for those.

Null texts count as empty and stay so. Repeated rows are documents of their own, in the order in which they
are read; a null doc_id comes first. A document that loses all its words stays in ``dedup`` with what is left.
Texts are read whole, however long. Empty tables give no rows. Other columns are kept, whatever their names:
the operator's own get underscores until no column has them (``own_names`` tells which).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import free_name
from .common import non_null_text, saved, table

#: Words of a run of repeats that make it a passage.
LEAST = 20
UNIT = r"[^.!?;:,\n]+[.!?;:,\n]*|[.!?;:,\n]+"
_UNIT = re.compile(UNIT)
#: Texts whose units a worker holds at a time.
ROWS = 1024
CANDIDATES = "row long, doc_id long, unit int, sure boolean, h1 long, h2 long"


def units(text: str) -> list[str]:
    """Joined, the units are the text again."""
    return _UNIT.findall(text)


def _words(unit: str) -> list[bytes]:
    return unit.encode("utf-8", "replace").lower().split()


def digest(unit: str) -> bytes | None:
    """16 bytes that equal units share; None for one without words."""
    words = _words(unit)
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def repeats(rows: DataFrame) -> DataFrame:
    """row and the numbers of its units that an earlier unit equals. rows: row, doc_id, text."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                count, number, raw = [], array("i"), bytearray()
                for text in part["text"]:
                    before = len(number)
                    for k, u in enumerate(units(text)):
                        h = digest(u)
                        if h is not None:
                            number.append(k)
                            raw += h
                    count.append(len(number) - before)
                if not raw:
                    continue
                h, unit = np.frombuffer(raw, "<i8").reshape(-1, 2), np.frombuffer(number, np.int32)
                row, doc = np.repeat(part["row"].to_numpy(), count), np.repeat(part["doc_id"].to_numpy(), count)
                order = np.lexsort((unit, row, doc, h[:, 1], h[:, 0]))
                again = np.zeros(len(row), bool)
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]).all(axis=1)
                h1, h2 = np.where(again, row, h[:, 0]), np.where(again, unit, h[:, 1])  # spread over the tasks
                yield pd.DataFrame({"row": row, "doc_id": doc, "unit": unit, "sure": again, "h1": h1, "h2": h2})

    first = F.coalesce("doc_id", F.lit(-(2**63)))
    found = rows.select("row", first.alias("doc_id"), "text").mapInPandas(rows_of, CANDIDATES)
    place = F.row_number().over(Window.partitionBy("sure", "h1", "h2").orderBy("doc_id", "row", "unit"))
    late = found.withColumn("place", place).where("sure OR place > 1")
    return late.groupBy("row").agg(F.collect_list("unit").alias("again"))


def removed_units(all_units: list[str], again: set[int], least: int = LEAST) -> list[int]:
    """The units of the runs of repeats that have so many words."""
    out: list[int] = []
    run: list[int] = []
    words, last = 0, 0
    for k, u in enumerate([*all_units, None]):
        if k in again:
            run.append(k)
            words += len(_words(u))
            last = len(run)
        elif run and u is not None and not _words(u):
            run.append(k)
        else:
            if words >= least:
                out += run[:last]
            run, words, last = [], 0, 0
    return out


def own_names(columns: Iterable[str]) -> tuple[str, str]:
    """The names of the columns that ``dedup`` adds: n_units and removed."""
    return free_name(columns, "n_units"), free_name(columns, "removed")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """docs with the text that stays, and two more columns: n_units, and removed, the [start, stop) of each removed unit."""
    names = docs.columns
    count, spans = own_names(names)
    row, of_row, again, done = (free_name(names, n) for n in ("row", "of_row", "again", "done"))
    kept = saved(docs.withColumn(row, F.monotonically_increasing_id()), "passages")
    plain = kept.select(F.col(f"`{row}`").alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"), non_null_text(f"`{text}`").alias("text"))
    late = repeats(plain).select(F.col("row").alias(of_row), F.col("again").alias(again))
    joined = kept.join(late, F.col(f"`{row}`") == F.col(of_row), "left")

    @F.pandas_udf("text string, n int, starts array<int>, stops array<int>")
    def cut(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        out = []
        for t, late in zip(texts, numbers):
            each = units(t or "")
            gone = removed_units(each, set(late), least) if late is not None else []
            starts, stops = [], []
            if gone:
                ends = np.cumsum([len(u) for u in each])
                drop = set(gone)
                starts, stops = [int(ends[k]) - len(each[k]) for k in gone], [int(ends[k]) for k in gone]
                t = "".join(u for k, u in enumerate(each) if k not in drop)
            out.append((t, len(each), starts, stops))
        return pd.DataFrame(out, columns=["text", "n", "starts", "stops"])

    span = lambda s: F.struct(s["starts"].alias("start"), s["stops"].alias("stop"))
    # else a filter on the result would run it once more below this projection
    made = joined.withColumn(done, cut.asNondeterministic()(f"`{text}`", F.col(again)))
    return made.select(
        *[F.col(f"`{done}`.text").alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.col(f"`{done}`.n").alias(count), F.transform(F.arrays_zip(F.col(f"`{done}`.starts"), F.col(f"`{done}`.stops")), span).alias(spans),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    text = non_null_text()
    return done.select(
        F.col("doc_id").cast("long"), F.col("n_units").cast("long"), F.size("removed").cast("long").alias("n_removed"), gone.alias("removed_chars"),
        spans.alias("removed_spans"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), text.alias("text"),
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT doc_id, unnest(p) AS unit, unnest(range(1, len(p) + 1)) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '{UNIT}') AS p FROM d)
),
n AS (
  SELECT doc_id, k, unit, regexp_extract_all(translate(unit, '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS words,
    CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop
  FROM u
),
r AS (
  SELECT *, len(words) AS w, len(words) > 0 AND row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, k) > 1 AS again FROM n
),
i AS (
  SELECT *, sum(CASE WHEN w > 0 AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM r
),
x AS (SELECT doc_id, island, min(k) AS first, max(k) AS last FROM i WHERE again GROUP BY doc_id, island HAVING sum(w) >= {LEAST}),
m AS (SELECT i.*, x.first IS NOT NULL AND i.k BETWEEN x.first AND x.last AS gone FROM i LEFT JOIN x ON x.doc_id = i.doc_id AND x.island = i.island),
g AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, CAST(coalesce(sum(length(unit)) FILTER (gone), 0) AS BIGINT) AS removed_chars,
    coalesce(string_agg((stop - length(unit)) || '-' || stop, ',' ORDER BY k) FILTER (gone), '') AS removed_spans,
    coalesce(string_agg(unit, '' ORDER BY k) FILTER (NOT gone), '') AS text
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars,
  coalesce(removed_spans, '') AS removed_spans, sha256(coalesce(g.text, '')) AS text_sha256, coalesce(g.text, '') AS text
FROM d LEFT JOIN g USING (doc_id)
"""
