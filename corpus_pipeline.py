"""A corpus pipeline over documents: quality, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again, so no stage's plan holds another's
and a lost executor costs only tasks of the stage at hand. Each stage works on all its predecessor kept.

1. Documents that the quality classifier rejects go. It learns from the labels outside its held-out fold.
2. Of documents whose word shingles are linked by a similarity of 80 % or more, one of each class stays.
3. Passages that an earlier document holds are cut out; a document that loses all its words goes.
4. Sources are mixed to their target weights: a row for each pass of the mix over its document, with the words taken.
5. Texts are encoded, and decoded for the digest: doc_id, n_tokens, ids_sha256, decoded_sha256.

A null or empty text scores like a text without faults and is linked with nothing; the mix takes none of its words,
so it has no row after stage 4. A null doc_id is never the smallest of a class and stays there; a null source is one
more source; null n_chars stay null where the text stays. Texts of any length are read whole. Ties and repeated rows: equal texts are one
class and their smallest doc_id stays, once; rows without words stay until stage 4. Empty tables give empty tables. Other columns
are kept through stage 4, whatever their names, and n_chars is brought up to date where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import bpe, bytecnn, jaccard, mixing, passages
from codestrata.llm.common import WORD, discard, saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~bytecnn.held_out())
    return bytecnn.keep(docs, bytecnn.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done, (_, spans) = passages.dedup(docs), passages.own_names(docs.columns)
    cut = F.size(f"`{spans}`") > 0
    left = done.where(~cut | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(cut, length).otherwise(F.col("n_chars")))
    return left.select(*[f"`{c}`" for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources to target weights", mixture),
    ("BPE encoding", encoded),
]

#: A trained network and pseudorandom draws are not expressible in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = saved(made, f"stage-{k}")
            if k:
                discard(docs)
        docs = made
    return docs
