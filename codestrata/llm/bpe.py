"""Operator 1: BPE encoding and decoding by forced-boundary splitting.

Some pairs of neighbouring bytes occur inside no token of the vocabulary. No merge can ever join
across such a pair, so it is a *certain cut*: the fragments on both sides encode independently and
their ids are concatenated. A 256 x 256 table of the pairs that do occur, built from the vocabulary,
finds the cuts of many texts with one vectorised lookup. Fragments are short and recur, so a worker
remembers the ids of those of up to 16 bytes in a hash table of numpy arrays: all fragments of some texts are
looked up together, and only those not there are merged. A full table is emptied. The
merges of a fragment run in a compiled library where the vocabulary's ranks are its ids, else here.

A cut is used only where the pre-tokeniser cannot look across it either: never inside a character,
never after white space (a run's split depends on what follows), never before an apostrophe (a
contraction could seem to start there). A fragment is then pre-tokenised and merged on its own.

Null texts count as empty and give no ids. Special tokens in a text are recognised, as the public
library does by default. Ids that are not in the vocabulary decode to nothing. Byte runs that are
not UTF-8 decode to U+FFFD. Texts of any length are encoded window by window. Repeated rows give equal
rows. Empty tables give no rows. Other columns are kept by ``encode`` and ``decode``, whose own gets underscores
until no column has its name, and ignored by ``digests``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.json"
#: The pre-tokeniser's pattern, a fixed value of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 1 << 18
#: Bytes of text that are cut and looked up together.
GROUP = 1 << 19
#: Fragments of up to KEY bytes are remembered, in a table of 2**SLOTS places (25 MB) that is emptied when it is 60 % full.
KEY = 16
SLOTS = 20
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(own))
    return [letters[b] for b in range(256)]


class ForcedBoundaryBPE:
    """A byte-level BPE vocabulary file with its table of certain cuts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        raw = {token: bytes(map(to_byte.__getitem__, token)) for token in model["vocab"]}
        self.ids = {raw[token]: i for token, i in model["vocab"].items()}
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[raw[left], raw[right]] = rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.decimal = [str(i) for i in range(size)]
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cuts = self._certain_cuts()
        self._packed = [i.to_bytes(4, "little") for i in range(size)]
        self._forget()
        made = [self.ids[left + right] for left, right in self.ranks]
        self._ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={}) if made == sorted(made) else None

    def _certain_cuts(self) -> np.ndarray:
        """cuts[a << 8 | b]: no token holds byte a followed by byte b, and the pre-tokeniser can't look across."""
        joined = np.zeros((256, 256), bool)
        for token in self.ids:
            if len(token) > 1:
                t = np.frombuffer(token, np.uint8)
                joined[t[:-1], t[1:]] = True
        cuts = ~joined
        cuts[:, 0x80:0xC0] = False  # inside a character
        cuts[:, 0x27] = False
        cuts[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0], :] = False
        cuts[[*range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF], :] = False  # last bytes of the longer kinds of white space
        return cuts.reshape(-1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost first, in O(n log n)."""
        whole = self.ids.get(piece)
        n = len(piece)
        if n == 1:
            return [whole]
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j < 0 or part[i] != left or part[j] != right or part[i] is None:
                continue
            part[i], part[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(queue, (r, a, part[a], part[b]))
        return [self.ids[p] for p in part if p is not None]

    def fragment(self, fragment: bytes) -> bytes:
        """Ids of a stretch between two certain cuts, as little-endian 32-bit integers."""
        merge = self.merge if self._ranked is None else self._ranked._core_bpe.encode_single_piece
        pieces = self.pattern.findall(fragment.decode())
        ids = merge(fragment) if len(pieces) == 1 else chain.from_iterable(merge(piece.encode()) for piece in pieces)
        return b"".join(map(self._packed.__getitem__, ids))

    def fragments(self, text: bytes) -> list[bytes]:
        """The text split at its certain cuts; joined, they are the text again."""
        if len(text) < 2:
            return [text] if text else []
        b = np.frombuffer(text, np.uint8)
        at = np.flatnonzero(self.cuts[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        return np.insert(b, at, 0xFF).tobytes().split(b"\xff")  # 0xFF is in no UTF-8 text

    def _forget(self) -> None:
        n = 1 << SLOTS
        self._key = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self._length = np.zeros(n, np.uint8)  # 0: a free place
        self._at, self._count = np.zeros(n, np.int32), np.zeros(n, np.uint8)
        self._pool, self._used, self._held = np.zeros(1 << 16, "<u4"), 0, 0

    def _pooled(self, fragments: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merges the fragments: where the ids of each stand in the pool, which grows by doubling, and how many they are."""
        made = [self.fragment(f) for f in fragments]
        count = np.fromiter(map(len, made), np.int64, len(made)) // 4
        first, self._used = self._used, self._used + int(count.sum())
        while self._used > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[first : self._used] = np.frombuffer(b"".join(made), "<u4")
        return first + np.cumsum(count) - count, count

    def _slots(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, new: np.ndarray | None = None) -> np.ndarray:
        """The place in the table of each key; -1 if it has none or, of keys that are all new, the place it gets."""
        h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + length.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        place = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        found = np.full(len(low), -1, np.int64)
        todo = np.arange(len(low))
        while len(todo):
            s = place[todo]
            taken = self._length[s]
            if new is None:
                same = (taken == length[todo]) & (self._key[0][s] == low[todo]) & (self._key[1][s] == high[todo])
                found[todo[same]] = s[same]
                todo = todo[(taken > 0) & ~same]
            else:
                free = np.flatnonzero(taken == 0)
                _, first = np.unique(s[free], return_index=True)
                got = todo[free[first]]
                mine = place[got]
                self._length[mine], self._key[0][mine], self._key[1][mine] = length[got], low[got], high[got]
                found[got] = mine
                todo = todo[found[todo] < 0]
            place[todo] = (place[todo] + 1) & ((1 << SLOTS) - 1)
        return found

    def _group(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; a piece is a whole text or a window of it, and none is empty."""
        data = b"".join(pieces)
        n = len(data)
        b = np.frombuffer(data + bytes(32), np.uint8)
        size = np.array([len(p) for p in pieces])
        begin = np.cumsum(size) - size
        mark = np.zeros(n, bool)
        mark[1:] = self.cuts[(b[: n - 1].astype(np.uint16) << 8) | b[1:n]]
        mark[begin] = True
        at = np.flatnonzero(mark)
        length = np.diff(at, append=n)
        words = np.empty((n // 8 + 2, 8), "<u8")  # flat, the eight bytes from each place on
        for r in range(8):
            words[:, r] = b[r : r + 8 * len(words)].view("<u8")
        flat = words.reshape(-1)
        low, high = flat[at] & _MASK[np.minimum(length, 8)], flat[at + 8] & _MASK[np.clip(length - 8, 0, 8)]
        short = np.flatnonzero(length <= KEY)
        slot = np.full(len(at), -1, np.int64)
        slot[short] = self._slots(low[short], high[short], length[short])
        missing = short[slot[short] < 0]
        if len(missing):
            fresh: dict[bytes, int] = {}
            for k, i, m in zip(missing.tolist(), at[missing].tolist(), length[missing].tolist()):
                fresh.setdefault(data[i : i + m], k)
            if self._held + len(fresh) > 0.6 * (1 << SLOTS) and self._held:
                self._forget()
                return self._group(pieces)
            first = np.fromiter(fresh.values(), np.int64)
            place = self._slots(low[first], high[first], length[first], first)
            self._at[place], self._count[place] = self._pooled(fresh)
            self._held += len(fresh)
            slot[missing] = self._slots(low[missing], high[missing], length[missing])
        start, count = self._at[slot].astype(np.int64), self._count[slot].astype(np.int64)
        long, kept = np.flatnonzero(length > KEY), self._used
        if len(long):  # they stay in the pool only while they are read
            start[long], count[long] = self._pooled(data[i : i + m] for i, m in zip(at[long].tolist(), length[long].tolist()))
        ends = np.cumsum(count)
        out = self._pool[np.repeat(start - (ends - count), count) + np.arange(ends[-1])]
        self._used = kept
        return np.split(out, (ends - count)[np.searchsorted(at, begin[1:])])

    def _windows(self, text: bytes) -> Iterator[bytes]:
        start = 0
        while start < len(text):
            end = start + WINDOW
            while end < len(text):  # a window ends at a certain cut, so windows are independent too
                b = np.frombuffer(text, np.uint8, end - start, start)
                at = np.flatnonzero(self.cuts[(b[:-1].astype(np.uint16) << 8) | b[1:]])
                if len(at):
                    end = start + int(at[-1]) + 1
                    break
                end += WINDOW
            yield text[start:end]
            start = end

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit integers."""
        out: list[list[np.ndarray]] = []
        pieces: list[bytes] = []
        owners: list[int] = []
        size = 0

        def run() -> None:
            for i, ids in zip(owners, self._group(pieces) if pieces else ()):
                out[i].append(ids)
            pieces.clear()
            owners.clear()

        for i, text in enumerate(texts):
            out.append([])
            if not text:
                continue
            parts = [text] if self.special_pattern is None or not any(s in text for s in self.special) else self.special_pattern.split(text)
            for part in parts:
                if len(parts) > 1 and part in self.special:
                    run()  # in order
                    size = 0
                    out[i].append(np.array([self.special[part]], "<u4"))
                    continue
                for piece in self._windows(part.encode("utf-8", "replace")):
                    pieces.append(piece)
                    owners.append(i)
                    size += len(piece)
                    if size >= GROUP:
                        run()
                        size = 0
        run()
        return [found[0] if len(found) == 1 else np.concatenate([np.zeros(0, "<u4"), *found]) for found in out]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        size = len(self.tokens)
        return b"".join([self.tokens[i] for i in ids if 0 <= i < size])

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker and vocabulary file; path is a file that every executor has, or the name of a public vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path if "/" in path else vocabulary_path(path))
    return _LOADED[path]


def free_name(taken: Iterable[str], name: str) -> str:
    """name, or name with underscores added until no column has it."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def encode(docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with a column of token ids (array<int>); a clashing name gets underscores. Null text: no ids."""
    out = free_name(docs.columns, out)

    def ids_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(vocabulary)
        for batch in texts:
            yield pd.Series([ids.astype(np.int32) for ids in bpe.encode_all(batch)], dtype=object)

    return docs.withColumn(out, F.pandas_udf(ids_of, "array<int>")(F.col(f"`{text}`")))


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with the text of a column of token ids; null or empty ids: an empty text."""
    out = free_name(rows.columns, out)

    def texts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(vocabulary)
        for batch in batches:
            yield pd.Series([bpe.decode(i) if i is not None else "" for i in batch], dtype=object)

    return rows.withColumn(out, F.pandas_udf(texts_of, "string")(F.col(f"`{ids}`")))


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them.

    Encoding and decoding run back to back in a worker, so that ids never travel between processes.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(vocabulary)
        for batch in texts:
            n, a, b = [], [], []
            for ids in map(np.ndarray.tolist, bpe.encode_all(batch)):
                n.append(len(ids))
                a.append(hashlib.sha256(bpe.decimals(ids).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), made.asNondeterministic()(f"`{text}`").alias("made")).select("doc_id", "made.*")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
