"""Operator 6: a byte-level convolutional quality classifier in numpy.

A filter of the network looks at WIDTH neighbouring bytes. Bytes have learned embeddings, so a filter's
response is a sum of one table entry per byte; for scoring, neighbouring bytes are joined into tables of
65,536 pairs. A document is cut into chunks of CHUNK windows that start everywhere, so every byte and
every boundary between chunks is covered. Each chunk keeps its greatest response per filter; a document
keeps the greatest and the mean of its chunks' and a logistic unit combines them into one probability. Its
weights are at most 0: filters find what is wrong, so a short text isn't blamed for what it lacks.

Training gradients pass only through the windows that won a maximum. The sample is bounded by
SAMPLE_ROWS rows of label 0 and three times as many of label 1, taken in the order of a hash of doc_id among the labelled rows given, so
it is the same at every run, and by SAMPLE_BYTES of text, of which one row holds a hundredth at most. Scoring
covers every byte of every text; a long one is read in slices, whose chunks are those of the whole. If the sample
lacks a class, the score is the share of label 1 (one half without any row).

Null and empty texts hold no chunk and score as if no filter had found anything. Repeated rows score alike.
Extra columns are ignored by ``score`` and kept by ``keep``, whatever their names. Only the text enters a score.
Empty tables give no rows; without labelled rows every score is one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import non_null_text, table

WIDTH = 6
FILTERS = 16
DIMENSIONS = 8
CHUNK = 128
#: The most labelled rows of label 0 that training reads, and of label 1 three times as many.
SAMPLE_ROWS = 500
#: The most bytes of text that training reads.
SAMPLE_BYTES = 1 << 26
EPOCHS = 12
#: A small sample is gone through more often, until so many steps are made.
LEAST_STEPS = 400
THRESHOLD = 0.3
#: Bytes that are scored at a time: whole chunks, so that the cuts change no score.
SLICE = 1024 * CHUNK


def _chunk_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of so many windows, end to end: where each chunk starts, and whose it is."""
    per = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    begin = np.cumsum(lengths) - lengths
    return begin[owner] + (np.arange(len(owner)) - first[owner]) * CHUNK, owner


@dataclass
class Model:
    embed: np.ndarray  # 256 x DIMENSIONS
    filters: np.ndarray  # WIDTH x DIMENSIONS x FILTERS
    bias: np.ndarray  # FILTERS
    weight: np.ndarray  # 2 * FILTERS
    offset: float

    @staticmethod
    def fresh(seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        return Model(r.normal(0, 0.5, (256, DIMENSIONS)), r.normal(0, 0.25, (WIDTH, DIMENSIONS, FILTERS)), np.zeros(FILTERS), -abs(r.normal(0, 0.1, 2 * FILTERS)), 1.0)

    def tables(self) -> list[np.ndarray]:
        """One table for each pair of neighbouring bytes in a window."""
        single = np.einsum("bd,wdf->wbf", self.embed, self.filters)
        return [(single[w][:, None, :] + single[w + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for w in range(0, WIDTH, 2)]

    def responses(self, data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """A filter response for every window of data; data has WIDTH - 1 further bytes."""
        pairs = (data[:-1].astype(np.uint16) << 8) | data[1:]
        n = len(data) - WIDTH + 1
        out = tables[0][pairs[:n]]
        for k in range(1, WIDTH // 2):
            out += tables[k][pairs[2 * k : 2 * k + n]]
        return out

    def logit(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weight + self.offset


GAP = bytes(WIDTH - 1)


def _joined(pieces: list[bytes], before: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces end to end, each after the WIDTH - 1 bytes before it; for each, how many windows end in it, one a
    byte, and where the first of them begins."""
    data = np.frombuffer(b"".join(x for pair in zip(before, pieces) for x in pair), np.uint8)
    lengths = np.array([len(p) for p in pieces], np.int64)
    return data, lengths, np.cumsum(lengths + WIDTH - 1) - (lengths + WIDTH - 1)


def _chunks(lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, and piece of each chunk."""
    starts, owner = _chunk_starts(lengths)
    at = starts + (begin - (np.cumsum(lengths) - lengths))[owner]
    return at, np.minimum(at + CHUNK, (begin + lengths)[owner]), owner


def _features(model: Model, tables: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Greatest and mean chunk response of each text."""
    out = np.full((len(texts), 2 * FILTERS), -1.0)
    chunks, owners = [], []
    pieces: list[bytes] = []
    before: list[bytes] = []
    ids: list[int] = []

    def run() -> None:
        data, lengths, begin = _joined(pieces, before)
        response = model.responses(data, tables)
        at, ends, owner = _chunks(lengths, begin)
        edges = np.empty(2 * len(at), np.int64)
        edges[0::2], edges[1::2] = at, ends
        edges = edges[:-1] if edges[-1] >= len(response) else edges
        chunks.append(np.maximum.reduceat(response, edges, axis=0)[0::2])
        owners.append(np.array(ids)[owner])
        for held in (pieces, before, ids):
            held.clear()

    size = 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), SLICE):  # a slice's first windows begin in the bytes before it
            pieces.append(t[a : a + SLICE])
            before.append(t[a - WIDTH + 1 : a] if a else GAP)
            ids.append(i)
            size += len(pieces[-1])
            if size >= SLICE:
                run()
                size = 0
    if pieces:
        run()
    if not chunks:
        return out
    pooled, owner = np.tanh(np.concatenate(chunks) + model.bias), np.concatenate(owners)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    rows = owner[first]
    out[rows, :FILTERS] = np.maximum.reduceat(pooled, first, axis=0)
    out[rows, FILTERS:] = np.add.reduceat(pooled, first, axis=0) / np.diff(np.concatenate([first, [len(owner)]]))[:, None]
    return out


def predict(model: Model | float, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
    """A probability for each text."""
    if isinstance(model, float):
        return np.full(len(texts), model)
    z = model.logit(_features(model, tables or model.tables(), texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, least_steps: int = LEAST_STEPS, seed: int = 7) -> Model | float:
    """Fit the network."""
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.5
    model, r = Model.fresh(seed), np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "weight", "offset")
    first = {k: np.zeros_like(np.asarray(getattr(model, k), float)) for k in names}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    batches = max(1, len(texts) // 32)
    epochs = max(epochs, -(-least_steps // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for part in np.array_split(order, batches):
            step += 1
            rate = 0.02 * max(0.02, 1 - step / steps)
            grads = _gradients(model, [texts[i] for i in part], labels[part])
            for k in names:
                g = grads[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                moved = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                setattr(model, k, getattr(model, k) - moved)
            model.weight = np.minimum(model.weight, 0)
    model.offset = float(model.offset)
    return model


def _gradients(model: Model, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the log loss; only the window that won each chunk's maximum has a share."""
    single = np.einsum("bd,wdf->wbf", model.embed, model.filters).astype(np.float32)
    data, lengths, begin = _joined(texts, [GAP] * len(texts))
    n = max(len(data) - WIDTH + 1, 0)
    response = np.take(single[0], data[:n], axis=0)
    for w in range(1, WIDTH):
        response += np.take(single[w], data[w : w + n], axis=0)
    at, ends, owner = _chunks(lengths, begin)
    docs = len(texts)
    features = np.where((lengths == 0)[:, None], -1.0, np.zeros((docs, 2 * FILTERS)))
    won, pooled = np.zeros((0, FILTERS), np.int64), np.zeros((0, FILTERS))
    counts = np.maximum(np.bincount(owner, minlength=docs), 1)
    columns = np.arange(FILTERS)
    if len(at):
        inside = np.minimum(at[:, None] + np.arange(CHUNK), ends[:, None] - 1)
        won = at[:, None] + response[inside].argmax(axis=1)
        pooled = np.tanh(response[won, columns] + model.bias)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows = owner[first]
        features[rows, :FILTERS] = np.maximum.reduceat(pooled, first, axis=0)
        features[rows, FILTERS:] = np.add.reduceat(pooled, first, axis=0) / counts[rows][:, None]
    error = (1 / (1 + np.exp(-np.clip(model.logit(features), -30, 30))) - labels) / docs
    d_pooled = (error[:, None] * model.weight[FILTERS:] / counts[:, None])[owner]
    if len(at):  # of a document's greatest chunks the first has the share
        best = np.minimum.reduceat(np.where(pooled == features[owner, :FILTERS], np.arange(len(owner))[:, None], len(owner)), first, axis=0)
        d_pooled[best, columns] += error[rows][:, None] * model.weight[:FILTERS]
    d_z = d_pooled * (1 - pooled**2)
    d_embed, d_filters = np.zeros_like(model.embed), np.zeros_like(model.filters)
    for w in range(WIDTH):
        cell = data[won + w].astype(np.int64) * FILTERS + columns  # chunks x FILTERS
        table = np.bincount(cell.ravel(), d_z.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        d_filters[w] = model.embed.T @ table
        d_embed += table @ model.filters[w].T
    return {"embed": d_embed, "filters": d_filters, "bias": d_z.sum(axis=0), "weight": features.T @ error + 1e-4 * model.weight, "offset": error.sum()}


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality") -> tuple[list[bytes], np.ndarray]:
    """At most so many texts of label 0 and three times as many of label 1, in the order of a hash of doc_id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    picked = known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).unionByName(known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), non_null_text().alias("text"))
    few = texts.where(F.octet_length("text") <= SAMPLE_BYTES // 100).join(F.broadcast(picked.select(F.col("doc_id").cast("long"), "y")), "doc_id")
    few = few.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of a doc_id's texts the least
    held = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = few.withColumn("held", held).where(F.col("held") <= SAMPLE_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toPandas()
    return [t.encode() for t in got["text"]], got["y"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | float:
    return train(*sample(docs, labels, rows))


def _scores(model: Model | float):
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = None if isinstance(model, float) else model.tables()
        for batch in batches:
            yield pd.Series(predict(model, [t.encode() for t in batch], tables))

    return F.pandas_udf(scores, "double")


def score(docs: DataFrame, model: Model | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key as doc_id, and the score of its whole text."""

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), _scores(model)(non_null_text(f"`{text}`")).alias("score"))


def keep(docs: DataFrame, model: Model | float, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score the threshold or more, with their own columns."""

    return docs.where(_scores(model)(non_null_text(f"`{text}`")) >= threshold)


def held_out(key: str = "doc_id"):
    """The fold that training never sees."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
