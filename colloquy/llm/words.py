"""Words of many texts as 64-bit hashes, without a Python object for each word.

A word is a run of letters, marks, numbers and low lines of the lower-cased
text (a combining mark never splits a word).  Texts are read as arrays of code
points; a word's hash is a polynomial in its code points, taken from prefix
sums, so the cost is that of a few passes over the array.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
import xxhash

#: Letters that share a table of powers; a word longer than that is hashed by itself.
SPAN = 1 << 17
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a code point is part of a word; powers of the base, and of its inverse modulo 2^64."""
    own = np.zeros(0x110000, np.int8)
    for m in regex.finditer(r"[\p{L}\p{M}\p{N}_]+", "".join(map(chr, range(0x110000)))):
        own[m.start() : m.end()] = 1
    up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SPAN, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return own, up, down


def _hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, up, down = _tables()
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + SPAN, "right"))
        if j <= i:
            out[i] = xxhash.xxh3_64_intdigest(c[a : ends[i]].tobytes())
            i += 1
            continue
        part = c[a : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and how many each text has."""
    own, hashes, sizes = _tables()[0], [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        low, n, first = [], 0, at
        while at < len(texts) and (n < SPAN or at == first):
            low.append(texts[at].lower())
            n += len(low[-1]) + 1
            at += 1
        # a blank behind every text, so that no word goes on in the next
        c = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_word = own[c]
        turns = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        if is_word[0]:
            turns = np.concatenate([[0], turns])
        starts, ends = turns[::2], turns[1::2]
        stops = np.cumsum([len(x) + 1 for x in low])
        sizes[first:at] = np.diff(np.searchsorted(starts, stops), prepend=0)
        hashes.append(_hash(c, starts, ends))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), sizes


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; of each key its place among them; the sorting order; where each distinct key starts in it."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place, order, np.flatnonzero(fresh)
