"""Vectorised word hashing shared by the shingle, window and feature operators.

A word is a run of bytes other than space and \\x09-\\x0D.  Every word of a
block of texts gets a 64-bit hash from one numpy pass over the UTF-8 bytes: a
polynomial in a random odd base over random byte values, then a finaliser.
Memory is bounded by cutting a batch into blocks of about ``BLOCK`` bytes; one
longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed at once.
BLOCK = 1 << 20

_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have, dtype=np.uint64)
        if size <= 4 * BLOCK:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: Sequence[str | None], lower: bool = False) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, UTF-8 texts) of blocks of bounded size; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        held.append(raw.lower() if lower else raw)
        size += len(raw)
        if size >= BLOCK:
            yield start, i + 1, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, start + len(held), held


def hash_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word (one more entry than texts)."""
    joined = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    word = ~_SPACE[joined]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * _powers(_BASE, len(joined)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _powers(_UNBASE, len(joined))[starts])
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    return hashes, np.searchsorted(starts, begins)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive words, by its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        if k % 8 == 7:
            out ^= out >> np.uint64(32)
    return mix(out)
