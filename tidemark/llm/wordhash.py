"""64-bit hashes of the words of many texts at once, as arrays.

Words are runs of bytes other than the six ASCII spaces.  The hash of a word is a
polynomial over a fixed table of random byte values, taken from prefix sums, so the
cost is a few array operations per byte and no Python step per word.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import SPACES, mix64

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_SECOND = 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            known[filled : 2 * filled] = known[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        if size <= 1 << 22:
            _powers[base] = known
    return known[:n]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of one byte array."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per text the index of its first word (one entry more than texts)."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    starts, ends = word_bounds(raw)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    first = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), first
    return span_hashes(raw, starts, ends), first


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Hashes of byte ranges that don't run past the end; ``second`` takes another base."""
    base, inverse = (_SECOND, pow(_SECOND, -1, 1 << 64)) if second else (_BASE, _INVERSE)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(base, len(raw)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(inverse, len(raw) + 1)[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (across texts too: the caller drops those)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(count, np.uint64)
    for k in range(n):
        value = value * np.uint64(_BASE) + words[k : k + count]
    return mix64(value)
