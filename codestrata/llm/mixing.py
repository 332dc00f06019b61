r"""Operator 8: mixing sources to target weights.

The words of each source, its documents in order of doc_id, are packed end to end into blocks of BLOCK
words (the last one may be shorter). The mix is a list of slots, cut into output shards. Each shard's
counts of slots by source are drawn at random, as multinomial counts given the totals: shards are halved
again and again, and each half's counts are a draw without replacement from its parent's, so any shard's
counts follow from the seed by a few draws, no shard waits for another, and the totals come out exact. A
source's slots, numbered through all shards, are mapped to its blocks by a pseudorandom permutation of the
block indexes (a keyed Feistel network), one for each time the source is gone through. Slots and blocks
then meet in a join by (source, block).

Words are ``[^\x20\x09-\x0D]+``. Sources are ordered by code point, null (a source of its own) last. Their
weights repeat 5, 2, 1; together they get 150 % of all words; a target stops at 2 times its source's words
and the excess is shared by weight among the others. No block is taken more than twice, so no document
exceeds 2 times its size. Null and empty texts have size 0 and nothing is taken of them. A long text is spread
over as many blocks as its words fill. Repeated rows and ties of doc_id are documents of their own, in order of
size (or of text); a null doc_id comes first. Reruns agree: all draws follow from the seed. Empty tables, and
tables without a word, give no slots. Other columns are ignored by ``taken`` and kept by ``mixed_documents``,
whatever their names: they travel under names of the operator's own.

What the driver holds is one total per source and written part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, partitions, saved, table

BLOCK = 64
#: Slots of an output shard.
SHARD = 1 << 14
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 20


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words that each source is to give; sizes in the order of the sources."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    size = np.array(sizes, float)
    out, free, rest = np.zeros(len(size)), np.ones(len(size), bool), share * size.sum()
    while free.any():
        out[free] = rest * weight[free] / weight[free].sum()
        over = free & (out > most * size)
        if not over.any():
            break
        out[over] = most * size[over]
        rest -= out[over].sum()
        free &= ~over
    return out.tolist()


@dataclass
class Plan:
    """Per source, in order: words, target, blocks and slots; and where each written part of it starts."""

    names: list[str | None]
    words: list[int]
    target: list[float]
    starts: dict[tuple[int, str | None], int]
    block: int = BLOCK
    shard: int = SHARD
    seed: int = SEED

    @property
    def blocks(self) -> np.ndarray:
        return -(-np.array(self.words, np.int64) // self.block)

    @property
    def slots(self) -> np.ndarray:
        """Whole passes over the source, and the blocks that make up the rest of its target."""
        words = np.maximum(np.array(self.words, float), 1)
        whole = np.floor(np.array(self.target) / words)
        rest = np.round((np.array(self.target) - whole * words) / self.block)
        return np.minimum(whole * self.blocks + rest, MOST * self.blocks).astype(np.int64)

    @property
    def shards(self) -> int:
        return int(-(-self.slots.sum() // self.shard))


def _draw(counts: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """n of the slots in counts, without replacement, however many there are.

    Each slot is in by itself with a chance of n / total; the few too many, or too few, are then drawn one by one:
    of all sets of n slots each is as likely.
    """
    draw = np.random.default_rng(key)
    found = draw.binomial(counts, n / max(int(counts.sum()), 1))
    over = int(found.sum()) - n
    held = found if over > 0 else counts - found
    picked = draw.choice(int(held.sum()), abs(over), replace=False, shuffle=False) if over else np.zeros(0, np.int64)
    moved = np.bincount(np.searchsorted(np.cumsum(held), picked, side="right"), minlength=len(counts))
    return found - moved if over > 0 else found + moved


def shard_counts(plan: Plan, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots by source in a shard, and in all shards before it."""
    counts, before = plan.slots.copy(), np.zeros(len(plan.words), np.int64)
    low, high = 0, plan.shards
    while high - low > 1:
        mid = (low + high) // 2
        left = _draw(counts, (mid - low) * plan.shard, [plan.seed, low, high])
        if shard < mid:
            counts, high = left, mid
        else:
            counts, before, low = counts - left, before + left, mid
    return counts, before


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n), by a Feistel network that is walked until it is in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            mixed = (right + np.uint64(1 + turn)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_slots(plan: Plan, shard: int) -> pd.DataFrame:
    """The slots of one shard in a random order: which block of which source each holds, and in which pass."""
    counts, before = shard_counts(plan, shard)
    blocks, found = plan.blocks, []
    for s in np.flatnonzero(counts):
        turn, index = np.divmod(before[s] + np.arange(counts[s]), blocks[s])
        block = np.empty(len(index), np.int64)
        for t in np.unique(turn):
            block[turn == t] = permuted(index[turn == t], int(blocks[s]), hash((plan.seed, int(s), int(t))))
        found.append(pd.DataFrame({"source_no": int(s), "block": block, "turn": turn}))
    out = pd.concat(found, ignore_index=True)
    out.insert(0, "slot", np.random.default_rng([plan.seed, shard]).permutation(len(out)))
    out.insert(0, "shard", shard)
    return out


SLOTS = "shard long, slot long, source_no long, block long, turn long"


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """All slots of the mix."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                yield shard_slots(plan, int(shard))

    n = plan.shards
    # the planner takes these for as few rows as there are shards; the hint keeps it from broadcasting them
    return spark.range(0, n, 1, max(1, min(n, 4 * partitions(spark)))).mapInPandas(rows_of, SLOTS).hint("merge")


def layout(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, Plan]:
    """The documents in packed order, each with its place in its part of its source, and the plan of the mix.

    docs has doc_id, source, the carried columns, and size or, where ``text`` is carried, none: words are then
    counted once the rows are dealt out. Rows: row, part, at, doc_id, source, size, carried.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, now, at = TaskContext.get().partitionId(), 0, object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source = batch.column("source").to_pylist()
            size = np.asarray(batch.column("size"), np.int64)
            fresh = np.array([a != b for a, b in zip(source, [now, *source[:-1]])], bool)
            ends = np.cumsum(size)
            begins = ends - size
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(size)), -1))
            local = np.where(first >= 0, begins - begins[np.maximum(first, 0)], begins + at)
            at = int(local[-1] + size[-1])
            now = source[-1]
            own = {"row": (part << 40) + n + np.arange(len(size)), "part": np.full(len(size), part, np.int32), "at": local}
            n += len(size)
            yield pa.RecordBatch.from_arrays([*map(pa.array, own.values()), *batch.columns], names=[*own, *batch.schema.names])

    dealt = docs.repartitionByRange("source", "doc_id")
    if "size" not in docs.columns:
        dealt = dealt.withColumn("size", words(F.col("text")))
    dealt = dealt.select("doc_id", "source", "size", *carry).sortWithinPartitions("source", "doc_id", "size", *[c for c in carry if c == "text"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    rows = saved(dealt.mapInArrow(placed, f"row long, part int, at long, {fields}"), "mix-layout")
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("n")).collect()
    names = sorted({r.source for r in sums if r.source is not None}) + [None] * any(r.source is None for r in sums)
    starts, total = {}, dict.fromkeys(names, 0)
    for r in sorted(sums, key=lambda r: r.part):
        starts[r.part, r.source] = total[r.source]
        total[r.source] += r.n
    sizes = [total[n] for n in names]
    return rows, Plan(names, sizes, targets(sizes), starts)


def overlaps(rows: DataFrame, plan: Plan) -> DataFrame:
    """A row for each document and block that share words: row, source_no, block, and the words [lo, hi) of the document."""
    number = {name: i for i, name in enumerate(plan.names)}

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            source = [None if pd.isna(s) else s for s in batch["source"]]
            begin = batch["at"].to_numpy(np.int64) + np.array([plan.starts[p, s] for p, s in zip(batch["part"], source)], np.int64)
            size = batch["size"].to_numpy(np.int64)
            first = begin // plan.block
            n = np.where(size > 0, (begin + size - 1) // plan.block - first + 1, 0)
            doc = np.repeat(np.arange(len(batch)), n)
            block = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            lo = np.maximum(block * plan.block - begin[doc], 0)
            hi = np.minimum((block + 1) * plan.block - begin[doc], size[doc])
            yield pd.DataFrame({"row": batch["row"].to_numpy()[doc], "source_no": np.array([number[s] for s in source], np.int64)[doc], "block": block, "lo": lo, "hi": hi})

    return rows.select("row", "part", "at", "source", "size").mapInPandas(rows_of, "row long, source_no long, block long, lo long, hi long")


def per_source(spark: SparkSession, plan: Plan) -> DataFrame:
    """A row per source; an Arrow table becomes a local relation of known size, which Spark broadcasts only if it is small."""
    columns = [pa.array(plan.names, pa.string()), pa.array(plan.words, pa.int64()), pa.array(plan.target, pa.float64())]
    return spark.createDataFrame(pa.table(columns, names=["source", "source_size", "target"]))


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: written, so that words are counted once though range sampling and shuffle both read them."""
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size")), "sizes")


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix of docs by its places: the slots (shard, slot, source_no, block, turn) joined by index to the
    documents' words (row, lo, hi), and the documents by row."""
    spark = docs.sparkSession
    rows, plan = layout(sized(docs))
    return slots(spark, plan).join(overlaps(rows, plan), ["source_no", "block"]), rows


def taken(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, its source's size and target, and the words that the mix takes of it."""
    spark = docs.sparkSession
    rows, plan = layout(sized(docs))
    times = slots(spark, plan).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
    of_row = times.join(overlaps(rows, plan), ["source_no", "block"]).groupBy("row").agg(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))).alias("taken")).hint("merge")
    found = rows.select("row", "doc_id", "source", "size").join(of_row, "row", "left")
    sources = per_source(spark, plan)
    joined = found.join(sources, found["source"].eqNullSafe(sources["source"]))
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _word_edges(data: np.ndarray) -> np.ndarray:
    """Byte offset of each word's start, and the end of the text."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    start = ~space
    start[1:] &= space[:-1]
    return np.concatenate([np.flatnonzero(start), [len(data)]])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix holds them, with the same columns: for each pass over its source, a document's
    row has the words that the pass takes of it, in order; a pass that takes none has no row."""
    spark = docs.sparkSession
    own = ("doc_id", "source", "text")
    others = {c: f"carried{k}" for k, c in enumerate(c for c in docs.columns if c not in own)}
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", *[F.col(f"`{c}`").alias(x) for c, x in others.items()])
    rows, plan = layout(few, ("text", *others.values()))
    spans = slots(spark, plan).select("source_no", "block", "turn").hint("merge").join(overlaps(rows, plan), ["source_no", "block"])
    spans = spans.groupBy("row", "turn").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")).hint("merge")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, taken in zip(texts, spans):
            raw = text.encode()
            edge = _word_edges(np.frombuffer(raw, np.uint8))
            runs: list[list[int]] = []
            for s in taken:
                if runs and runs[-1][1] == s["lo"]:
                    runs[-1][1] = s["hi"]
                else:
                    runs.append([s["lo"], s["hi"]])
            out.append("\n".join(raw[edge[a] : edge[b]].decode().strip() for a, b in runs))
        return pd.Series(out, dtype=object)

    found = rows.join(spans, "row").select("doc_id", "source", *others.values(), cut.asNondeterministic()("text", "spans").alias("text"))
    if "n_chars" in others:
        found = found.withColumn(others["n_chars"], F.length("text"))
    kind = {f.name: f.dataType for f in docs.schema}
    return found.select(*[F.col(others.get(c, c)).cast(kind[c]).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))
