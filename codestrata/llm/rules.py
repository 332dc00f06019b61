r"""Operator 3: quality rules compiled from a threshold table into one Spark projection.

Every measure is a built-in expression of the text alone, so nothing is shuffled and no Python runs on
the executors. Words are ``[^\x20\x09-\x0D]+``. A row of RULES is a ratio, with the least and the most
that a good document has; a document is kept if the base rules and every row hold.

n_repeat_words counts the words inside 8-word windows found at least twice in the text. Windows are
compared by a 64-bit hash of their words' hashes: array_distinct finds, in one pass, the texts that repeat
nothing, and only the others are sorted. All steps are linear or n log n in the words of one text.

A null or empty text has no words, fails the base and is not kept. Long texts are judged whole. Repeated rows
are judged alike, each for itself; a null doc_id stays null. Empty tables give no rows. Other columns, whatever
their names, are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, non_null_text, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent short words of the languages that the corpus holds (fixed values).
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not are this from or an at "
    "le la les de des du et en un une que qui dans pour pas sur au est par avec "
    "el los las del y una se no con su lo como más para "
    "der die das und den von zu mit sich dem nicht ist ein eine als auch auf für"
).split()
STOP_WORDS += [w.capitalize() for w in STOP_WORDS]


@dataclass(frozen=True)
class Rule:
    """A good document's ratio lies in [least, most]; per is the measure divided by."""

    name: str
    measure: str
    per: str
    least: float
    most: float


#: The threshold table.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols per word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("double exclamation marks per word", "n_shouts", "n_words", 0.0, 0.1),
    Rule("stop words per word", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", 0.0, 0.6),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluating value once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words that lie in windows whose hash occurs twice or more; hashes in the order of the windows."""
    field = lambda s, k: s[k].getField("h")

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        twice = lambda x, k: ((k > 0) & (field(s, F.greatest(k - 1, F.lit(0))) == x["h"])) | ((k < last) & (field(s, F.least(k + 1, last)) == x["h"]))
        return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

    def total(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW).cast("long"), lambda n, k: n + F.least(F.lit(WINDOW), p[k] - p[k - 1]).cast("long"))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.array_sort(pairs), lambda s: let(repeated(s), total))


def n_repeat_words(words: Column) -> Column:
    def of_windows(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_covered(hashes))

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW))), of_windows)

    own = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(own, of_words))


def measures(text: Column) -> Column:
    """A struct of the counts that the base and the table use."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    symbols = F.regexp_replace(text, f"[^{SYMBOLS}]+", "")
    return let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda words: let(
            lines,
            lambda each: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.length(symbols).cast("long").alias("n_symbols"),
                (F.size(each) - F.size(F.array_distinct(each))).cast("long").alias("n_dup_lines"),
                n_repeat_words(words).alias("n_repeat_words"),
                F.size(each).cast("long").alias("n_lines"),
                ((F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_shouts"),
                F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        ),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table compiled into one condition on the columns of measures()."""
    holds = F.lit(True)
    for r in rules:
        ratio = F.col(r.measure) / F.greatest(F.col(r.per), F.lit(1))
        holds = holds & ratio.between(r.least, r.most)
    return holds


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: the key as doc_id, the measures, base_failed and kept."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), measures(non_null_text(f"`{text}`")).alias("m"))
    rows = rows.select("doc_id", "m.*")
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("own"), measures(non_null_text(f"`{text}`")).alias("m")).select("own", "m.*")
    return rows.where(~base_failed() & verdict(rules)).select("own.*")


OUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(*OUT)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
),
r AS (
  SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM g WHERE n > 1) GROUP BY doc_id
),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines,
    (length(text) - length(replace(text, '!!', ''))) // 2 AS n_shouts,
    len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop_words
  FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(f"{r.measure} / greatest({r.per}, 1) BETWEEN {r.least} AND {r.most}" for r in RULES)} AS kept
FROM m
"""
