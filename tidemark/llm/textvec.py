"""Vectorised hashing of words and shingles in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Letters and digits; bytes of multi-byte characters count as letters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _BASE_INV)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the lower-cased texts, each followed by a space, and where each begins (one more at the end)."""
    raw = [t.lower().encode() for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8), begins


def prefix_hash(data: np.ndarray) -> np.ndarray:
    base, _ = powers(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * base[: len(data)])])


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans: equal spans have equal hashes wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, each text's first word (one more at the end), byte spans of the words, and the bytes' prefix hash.

    A word is a longest run of letters and digits of the lower-cased text.
    """
    data, begins = joined(texts)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], WORD[data], [False]])))
    starts, ends = edges[::2], edges[1::2]
    prefix = prefix_hash(data)
    return span_hash(prefix, starts, ends), np.searchsorted(starts, begins), starts, ends, prefix


def shingles(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Hashes of each text's word n-grams, in order; a text of fewer words has one, of all its words, and a text without words has none."""
    hashes, firsts = words(texts)[:2]
    run = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        run[: len(hashes) - k] += hashes[k:] * np.uint64(2 * k + 3)
    run = mix(run)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(run[a : b - size + 1])
        elif b > a:
            weights = np.arange(3, 2 * (b - a) + 3, 2, dtype=np.uint64)
            out.append(mix((hashes[a:b] * weights).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def multiset(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes of (element, how many times it has come before): two of these share as many values as the multisets share elements."""
    x = np.sort(hashes)
    if len(x) and (x[1:] == x[:-1]).any():
        begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        nth = np.arange(len(x)) - np.repeat(begins, np.diff(np.append(begins, len(x))))
        x = np.sort(np.where(nth > 0, mix(x + nth.astype(np.uint64) * _BASE), x))
    return x


def portions(sizes: np.ndarray, most: int, total: int) -> list[slice]:
    """Consecutive slices of at most ``most`` entries whose ``sizes`` add up to ``total`` at most; a larger entry is alone."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, first = [], 0
    while first < len(sizes):
        last = min(first + most, int(np.searchsorted(ends, ends[first] + total, "right")) - 1)
        out.append(slice(first, max(last, first + 1)))
        first = out[-1].stop
    return out


def in_portions(texts: list[str], most: int = 200, total: int = 1 << 19) -> list[list[str]]:
    """``texts`` in lists of bounded length, so that what is made of one follows neither their number nor their length."""
    return [texts[at] for at in portions(np.array([len(t) for t in texts], np.int64), most, total)]
