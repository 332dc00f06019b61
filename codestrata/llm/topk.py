"""Operator 2: exact top-k search by Fagin's threshold algorithm.

Candidates are cut into blocks of about CELLS integers, queries into blocks of a quarter of that; each pair of
blocks is one task, so what is copied of both grows with the number of the other's blocks alone. A block
sorts one list per dimension, once for all queries of the pair. A query walks all lists together, from the top
where its component is positive and from the bottom where it is negative, in strides that double. Every
vector met is scored whole at once. The sum over the lists of component times next unseen value bounds the
score of all vectors not met yet: once it is below the kth best score, the block is done. Ties need the
bound to be strictly below. The best k of each block are merged by query.

Vectors are turned into integers, floor(scale * x), x as double; scores are integer inner products. Vectors
that are null or hold null or non-finite components, and rows without vec_id, take no part. A query is a row
and never its own candidate; every other row is, be it equal or of the same vec_id. Vectors of another length
than the query's are no candidates, however long. Empty tables give no rows. Other columns are ignored. Scores
are exact below 2**53; beyond that they are added as 64-bit integers, which wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, saved, table

#: Integers of a candidate block: 16 MB.
CELLS = 1 << 21
STRIDE = 8
FOUND = "query long, query_id long, row long, vec_id long, score long"


def quantise(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: float = 256.0) -> DataFrame:
    """vec_id and its integers as array<long>, of the rows that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("x"))


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (rows @ query).astype(np.int64)


def threshold_search(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, stride: int = STRIDE, keys: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query (its number): the positions and scores of its k best rows, and how many rows it scored.

    keys: what tells the rows apart, ids if not given; the row of key own is not its query's candidate.
    """
    keys = ids if keys is None else keys
    n, dims = rows.shape
    order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)  # dims x n, ascending
    listed = np.take_along_axis(rows.T, order, axis=1)
    exact = max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)) < 2 ** ((52 - max(dims, 1).bit_length()) // 2)
    kind = np.float64 if exact else np.int64
    rows, listed = rows.astype(kind), listed.astype(kind)
    for number, query in enumerate(queries.astype(kind)):
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = keys == own[number]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        scored, depth, step = 0, 0, stride
        while not seen.all():
            to = min(n, depth + step)
            met = np.zeros(n, bool)
            met[order[up, n - to : n - depth]] = True
            met[order[down, depth:to]] = True
            if not len(up) and not len(down):
                met[:] = True  # every score is 0
            new = np.flatnonzero(met & ~seen)
            seen |= met
            if len(new):
                scored += len(new)
                got = _scores(rows[new], query)
                best, score = np.concatenate([best, new]), np.concatenate([score, got])
                if len(best) > k:
                    good = score >= np.partition(score, len(score) - k)[len(score) - k]
                    best, score = best[good], score[good]
                    first = np.lexsort((keys[best], ids[best], -score))[:k]
                    best, score = best[first], score[first]
            if to >= n:
                break
            bound = listed[up, n - to - 1] @ query[up] + listed[down, to] @ query[down]
            if len(best) >= k and bound < score.min():
                break
            depth, step = to, 2 * step
        yield number, best, score, scored


def search(vectors: DataFrame, queries: Column, k: int = 5, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all vectors for each vector that the condition on vec_id holds for.

    vectors: vec_id and x, as quantise() returns them.
    """
    vectors = saved(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = F.size("x").cast("long")
    total, asked = vectors.agg(F.sum(size), F.sum(F.when(queries, size))).first()
    total, asked = total or 0, asked or 0
    # a small table is cut finer, to keep all tasks busy: of the queries, which are fewer, more copies are made
    blocks = max(1, -(-total // cells), min(partitions(vectors.sparkSession), 16 * total // cells))
    query_blocks = max(1, -(-4 * asked // cells))
    part = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = vectors.withColumn("cb", part(blocks, 1)).withColumn("qb", upto(query_blocks))
    right = vectors.where(queries).withColumn("qb", part(query_blocks, 2)).withColumn("cb", upto(blocks))

    def one(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            lengths, wanted = rows["x"].map(len), asked["x"].map(len)
            for length in sorted(set(lengths) & set(wanted) - {0}):
                own, mine = rows[lengths == length], asked[wanted == length]
                ids, keys = own["vec_id"].to_numpy(np.int64), own["row"].to_numpy(np.int64)
                whose, query = mine["vec_id"].to_numpy(np.int64), mine["row"].to_numpy(np.int64)
                for q, best, score, _ in threshold_search(ids, np.stack(own["x"].to_numpy()), np.stack(mine["x"].to_numpy()), query, k, keys=keys):
                    found.append(pd.DataFrame({"query": query[q], "query_id": whose[q], "row": keys[best], "vec_id": ids[best], "score": score}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}, dtype="int64")

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(one, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(quantise(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.r, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0 AND len(q.x) > 0
),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, r) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5
"""
