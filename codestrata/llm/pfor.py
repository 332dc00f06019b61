"""Operator 5: token-id files of patched frame-of-reference blocks.

A shard is one self-contained file image: a header, the documents' ids and ends, a block index, the
packed blocks and their exceptions. A block holds BLOCK ids. Its minimum is subtracted; the width is
the number of bits that a chosen percentile of the differences needs; each difference's low bits are
packed at that width, and the high bits of those that need more go, with their position, to the
exception list. The block index holds each block's start in the packed words and in the exceptions,
so that any document is read from its own blocks alone.

Spark writes the images (through its commit protocol, so lost executors leave no half files) as the
binary column of a Parquet dataset in any file system; ``export`` in turn makes plain files of them.

Null and empty texts give a document of only the end id. Rows are ordered by doc_id, null first, then
text; repeated rows are documents of their own. Long texts are one document, in as many blocks as they fill. An
empty table gives an empty dataset. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder
from .common import scratch, table

MAGIC = b"PFR2"
HEADER = struct.Struct("<4sIIIQQQ")  # magic, block, documents without an id, documents, ids, packed words, exceptions
BLOCK = 128
PERCENTILE = 90
#: A shard is closed once it holds so many ids; one document is never split.
SHARD_IDS = 1 << 18
SHARDS = "part int, shard int, base long, n_docs int, n_ids long, image binary"


def _pack_group(values: np.ndarray, width: int) -> np.ndarray:
    """(n, block) differences of at most width bits each -> (n, words) little-endian 64-bit words."""
    n, block = values.shape
    words = np.zeros((-(-block * width // 64), n), np.uint64)
    lanes = np.ascontiguousarray(values.T).astype(np.uint64)
    for j in range(block):
        word, shift = divmod(j * width, 64)
        words[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return words.T


def _unpack_group(words: np.ndarray, width: int, block: int) -> np.ndarray:
    lanes, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    out = np.empty((block, words.shape[0]), np.uint32)
    for j in range(block):
        word, shift = divmod(j * width, 64)
        v = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            v |= lanes[word + 1] << np.uint64(64 - shift)
        out[j] = v & mask
    return out.T


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 for 0."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, missing: int = 0, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The file image of documents whose ids lie end to end; the first so many have no doc_id."""
    n = len(ids)
    blocks = -(-n // block)
    grid = np.empty(blocks * block, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, block)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = grid - least[:, None]
    rank = max(0, -(-int(block * percentile) // 100) - 1)
    width = _bits(np.partition(diff, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.uint8)
    high = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, col = np.nonzero(high)
    per_block = np.bincount(row, minlength=blocks)
    words_of = (block * width.astype(np.int64) + 63) // 64
    starts, patches = np.concatenate([[0], np.cumsum(words_of)]), np.concatenate([[0], np.cumsum(per_block)])
    packed = np.zeros(int(starts[-1]), "<u8")
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        low = diff[at] & np.uint32((1 << int(w)) - 1)
        packed[starts[at][:, None] + np.arange(words_of[at[0]])] = _pack_group(low, int(w))
    parts = [
        HEADER.pack(MAGIC, block, missing, len(doc_ids), n, len(packed), len(row)),
        doc_ids.astype("<i8"), ends.astype("<u8"),
        starts[:-1].astype("<u4"), patches[:-1].astype("<u4"), least.astype("<u4"), width.astype("u1"),
        packed, high[row, col].astype("<u4"), col.astype("<u2"),
    ]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """Reads a file image; nothing is unpacked before it is asked for."""

    def __init__(self, image: bytes) -> None:
        magic, self.block, self.missing, n_docs, self.n_ids, n_words, n_patches = HEADER.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        blocks, at = -(-self.n_ids // self.block), HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(image, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids, self.ends = take("<i8", n_docs), take("<u8", n_docs)
        self.starts, self.patches, self.least, self.width = take("<u4", blocks), take("<u4", blocks), take("<u4", blocks), take("u1", blocks)
        self.words, self.high, self.at = take("<u8", n_words), take("<u4", n_patches), take("<u2", n_patches)

    def _blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks [first, last), end to end."""
        width = self.width[first:last]
        out = np.zeros((last - first, self.block), np.uint32)
        for w in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == w)
            words = self.words[self.starts[first:last][rows][:, None].astype(np.int64) + np.arange((self.block * int(w) + 63) // 64)]
            out[rows] = _unpack_group(words, int(w), self.block)
        a = int(self.patches[first]) if first < len(self.patches) else len(self.high)
        b = int(self.patches[last]) if last < len(self.patches) else len(self.high)
        row = np.searchsorted(self.patches[first:last], np.arange(a, b), side="right") - 1
        out[row, self.at[a:b]] |= self.high[a:b] << width[row].astype(np.uint32)
        return (out + self.least[first:last, None]).reshape(-1)

    def all(self) -> np.ndarray:
        return self._blocks(0, len(self.width))[: self.n_ids]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from its own blocks."""
        a, b = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        first = a // self.block
        return self._blocks(first, -(-b // self.block))[a - first * self.block : b - first * self.block]


def write(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = 0) -> None:
    """Encode documents in ascending order of their key, those without one first, each followed by the end id, and write the shards to path."""

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, part, end = encoder(vocabulary), TaskContext.get().partitionId(), np.array([end_id], "<u4")
        shard, base, size, missing = 0, 0, 0, 0
        keys: list[int] = []
        held: list[np.ndarray] = []

        def image() -> pd.DataFrame:
            nonlocal shard, base, size, missing, keys, held
            ends = np.cumsum([len(x) + 1 for x in held])
            made = pack(np.concatenate([x for ids in held for x in (ids, end)]), np.array(keys, np.int64), ends, missing)
            row = pd.DataFrame({"part": [part], "shard": [shard], "base": [base], "n_docs": [len(keys)], "n_ids": [size], "image": [made]})
            shard, base, size, missing, keys, held = shard + 1, base + size, 0, 0, [], []
            return row

        for batch in batches:
            for none, k, ids in zip(batch["none"], batch["k"], bpe.encode_all(batch["t"])):
                held.append(ids)
                keys.append(k)
                missing += none
                size += len(ids) + 1
                if size >= SHARD_IDS:
                    yield image()
        if keys:
            yield image()

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    rows.select(F.col("k").isNull().alias("none"), F.coalesce("k", F.lit(0)).alias("k"), "t").mapInPandas(shards, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shards in path, one row each."""
    return spark.read.schema(SHARDS).parquet(path)


def index(shards: DataFrame) -> DataFrame:
    """One row per document, unpacked from the shards: doc_id, start, n_tokens, ids_crc32.

    What is collected is one total per written part, of which there are as many as shuffle partitions.
    """
    before, total = {}, 0
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        before[part], total = total, total + n

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, base, image in zip(batch["part"], batch["base"], batch["image"]):
                shard = Shard(image)
                ids, ends = shard.all().astype("<u4"), shard.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(shard.doc_ids.astype(np.int64), np.arange(len(ends)) < shard.missing),
                    "start": starts + base + before[part], "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)],
                })

    return shards.select("part", "base", "image").mapInPandas(rows_of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(shards: DataFrame, folder: str) -> int:
    """Plain files of the images in a folder that this process can write to, one shard at a time; how many."""
    n = 0
    for row in shards.orderBy("part", "shard").select("part", "shard", "image").toLocalIterator():
        with open(f"{folder}/{row.part:06d}-{row.shard:06d}.pfr", "wb") as f:
            f.write(row.image)
        n += 1
    return n


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path)
    return index(read(spark, path))
