"""Word shingles of whole texts as 64-bit hashes, computed by numpy over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text and number of texts that are hashed at once; they bound the working memory of a task.
CHUNK = 1 << 18
CHUNK_TEXTS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += 32
_U = np.uint64
#: Base of the words' polynomials, its inverse modulo 2 ** 64 and a factor for their lengths.
_BASE = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_LENGTH = _U(0xA0761D6478BD642F)
_KEPT = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(31)
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i below n at least, modulo 2 ** 64; those of a usual chunk are kept."""
    if n > len(_KEPT[0]):
        made = tuple(np.cumprod(np.r_[_U(1), np.full(max(n, 2 * CHUNK), b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE))
        if len(made[0]) > 4 * CHUNK:
            return made
        _KEPT[:] = made
    return _KEPT[0], _KEPT[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts, in order, and the index of the text of each.

    A word's hash is a polynomial in its bytes, taken from running sums over all bytes, with its bits mixed.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, stops = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(data))
    sums = np.cumsum(_LOWER[data] * up[: len(data)], dtype=np.uint64)
    hashes = mix((sums[stops - 1] - sums[starts - 1]) * down[starts] + (stops - starts).astype(np.uint64) * _LENGTH)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, starts - 1, side="right")


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, one after the other, and their number by text.

    A text with fewer words has its whole sequence as one shingle, one without words has none.
    """
    words, doc = word_hashes(texts)
    n = len(texts)
    per = np.bincount(doc, minlength=n)
    ends = np.cumsum(per)
    salt = mix(np.arange(1, k + 1, dtype=np.uint64) + _U(1000)) | _U(1)
    rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * salt[j]
    rolled = mix(rolled)
    sets: list[np.ndarray] = []
    for size, end in zip(per.tolist(), ends.tolist(), strict=True):
        if size >= k:
            part = np.sort(rolled[end - size : end - k + 1])
            new = np.empty(len(part), bool)
            new[0] = True
            np.not_equal(part[1:], part[:-1], out=new[1:])
            sets.append(part if new.all() else part[new])
        else:
            short = (words[end - size : end] * salt[:size]).sum(keepdims=True, dtype=np.uint64) + _U(size)
            sets.append(mix(short) if size else short[:0])
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes; a range ends with the text that fills it."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK or i + 1 - start >= CHUNK_TEXTS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
