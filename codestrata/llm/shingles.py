"""Word shingles as 62-bit hashes, computed for many texts at once in numpy.

A word's hash is a polynomial of its bytes, read off one running sum over the whole buffer; a shingle's
mixes its words' hashes in order. Equal shingles have equal hashes; different ones share a hash with a
chance of about 2**-62 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes hashed at a time.
SLICE = 1 << 19

_RANDOM = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODE = np.where(_SPACE, np.uint64(0), _RANDOM[_LOWER])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = np.array([pow(0xD1342543DE82EF95, k + 1, 2**64) for k in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, _INVERSE):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes each."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= SLICE:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles' hashes in ascending order: none without words, one with fewer than WORDS."""
    for first, last in _groups(texts):
        part = texts[first:last]
        data = np.frombuffer(b" " + b" ".join(part) + b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in part])
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        begin, stop = edge[0::2], edge[1::2]
        up, down = _powers(-(-len(data) // SLICE) * SLICE)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * up[: len(data)], dtype=np.uint64)])
        word = _mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))
        n = np.diff(np.concatenate([[0], np.searchsorted(begin, ends, side="right")]))
        count = len(word)
        if count >= WORDS:
            h = word[: count - WORDS + 1] * _PLACE[0]
            for k in range(1, WORDS):
                h = h + word[k : count - WORDS + 1 + k] * _PLACE[k]
            h = _mix(h) >> np.uint64(2)
        at = 0
        for m in n.tolist():
            if m >= WORDS:
                s = np.sort(h[at : at + m - WORDS + 1])
                fresh = np.empty(len(s), bool)
                fresh[0] = True
                np.not_equal(s[1:], s[:-1], out=fresh[1:])
                yield s[fresh]
            elif m:
                yield _mix((word[at : at + m] * _PLACE[:m]).sum(dtype=np.uint64, keepdims=True) + _PLACE[WORDS + m]) >> np.uint64(2)
            else:
                yield np.zeros(0, np.uint64)
            at += m


def set_id(shingles: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
