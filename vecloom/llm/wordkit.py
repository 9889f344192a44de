"""Vectorised word and shingle hashing of batches of texts.

Words are runs of bytes other than the six ASCII white-space characters, so UTF-8 is never cut inside a character.
Hashes are 64 bits wide; equal words and windows have equal hashes, and different ones meet with a chance of about
2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BYTE_BASE, _WORD_BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]))[:n]


def pieces(sizes: list[int], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text stands alone, whole."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the number of words of each text. lower: A-Z count as a-z."""
    joined = b"\n".join(texts)
    buf = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    new = np.empty(len(at), bool)
    new[0], new[1:] = True, np.diff(at) > 1
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    value = (buf[at].astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(value, first))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(at[first], ends), prepend=0)


def window_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of n consecutive words of one text: its hash, the text's index and the window's place there."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    last = len(words) - n + 1
    total = np.zeros(last, np.uint64)
    for k, p in enumerate(powers(_WORD_BASE, n)):
        total += words[k : k + last] * p
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(text[:last] == text[n - 1 :])
    starts = np.cumsum(counts) - counts
    return mix(total[whole]), text[whole], whole - starts[text[whole]]


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values."""
    first = run_starts(keys).tolist()
    return list(zip(first, [*first[1:], len(keys)][: len(first)], strict=True))
