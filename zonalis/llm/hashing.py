"""Words of UTF-8 texts as 64-bit hashes, by numpy over whole batches.

A word's hash is a polynomial over its bytes, taken from prefix sums modulo 2**64,
then mixed; equal words have equal hashes on every executor, and two of n different
words meet with a chance of about n*n / 2**65.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _PIECE + 1), _powers(_BASE_INV, _PIECE + 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix((_LOWER.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95))
_CASED = mix((np.arange(256).astype(U64) + U64(1)) * U64(0xD1342543DE82EF95))

#: Word bytes after A-Z is lower-cased: all but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Word bytes: ASCII letters and digits, and all of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACED, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, text by text: their hashes, and the words of each text;
    also where each word begins and ends in ``data``. ``fold``: A-Z counts as a-z."""
    n = len(data)
    value = _VALUE if fold else _CASED
    hashes, begins, ends = [], [], []
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    a = 0
    while a < n:
        b = min(n, a + _PIECE)
        if b < n and not cut[b] and is_word[data[b]] and is_word[data[b - 1]]:  # not within a word
            gap = np.flatnonzero(~is_word[data[a:b]] | cut[a:b])
            gap = gap[gap > 0]
            if len(gap):
                b = a + int(gap[-1])
            else:
                while b < n and not cut[b] and is_word[data[b]]:
                    on = is_word[data[b : b + _PIECE]]
                    b += int(np.argmin(np.append(on & ~cut[b : b + len(on)], False)))
        piece = data[a:b]
        on = is_word.take(piece, mode="clip")  # a byte cannot be out of bounds
        first = on.copy()
        first[1:] &= ~on[:-1] | cut[a + 1 : b]
        last = on.copy()
        last[:-1] &= ~on[1:] | cut[a + 1 : b]
        i, j = np.flatnonzero(first), np.flatnonzero(last) + 1
        pw, iv = (_POW, _INV) if len(piece) <= _PIECE else (_powers(_BASE, len(piece)), _powers(_BASE_INV, len(piece)))
        total = np.zeros(len(piece) + 1, U64)
        np.cumsum(value.take(piece, mode="clip") * pw[: len(piece)], out=total[1:])
        hashes.append(mix((total[j] - total[i]) * iv[i]))
        begins.append(i + a)
        ends.append(j + a)
        a = b
    if not hashes:
        empty = np.empty(0, np.int64)
        return np.empty(0, U64), np.zeros(len(offsets) - 1, np.int64), empty, empty
    at = np.concatenate(begins)
    return np.concatenate(hashes), np.diff(np.searchsorted(at, offsets)), at, np.concatenate(ends)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-word shingles of each text; a text of fewer words, but not none, has one
    of all its words."""
    ends = np.cumsum(counts)
    n = len(h)
    acc = np.full(max(0, n - k + 1), U64(k), U64)
    for j in range(k):
        acc = acc * U64(0xD6E8FEB86659FD93) + h[j : n - k + 1 + j]
    out_counts = np.maximum(counts - k + 1, 0)
    keep = np.zeros(len(acc), bool)
    long = counts >= k
    if len(acc):
        mark = np.zeros(len(acc) + 1, np.int64)
        np.add.at(mark, (ends - counts)[long], 1)
        np.add.at(mark, (ends - k + 1)[long], -1)
        keep = np.cumsum(mark[:-1]) > 0
    acc = mix(acc[keep])
    short = np.flatnonzero((counts > 0) & ~long)
    if len(short):
        own = np.full(len(short), U64(0), U64) + counts[short].astype(U64)
        for j in range(k - 1):
            on = counts[short] > j
            own[on] = own[on] * U64(0xD6E8FEB86659FD93) + h[(ends - counts)[short][on] + j]
        at = np.concatenate([[0], np.cumsum(out_counts)])[short]
        acc = np.insert(acc, at, mix(own))
        out_counts = out_counts.copy()
        out_counts[short] = 1
    return acc, out_counts


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.bincount(r[keep], minlength=len(counts)).astype(np.int64)


def prefixes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, lengths: range):
    """For each of ``lengths``, the hash of the leading bytes of every word; of words that
    are shorter it is without meaning. A-Z counts as a-z."""
    acc = np.full(len(begins), U64(7), U64)
    last = max(len(data) - 1, 0)
    for j in range(max(lengths)):
        acc = acc * U64(0xD6E8FEB86659FD93) + _VALUE[data[np.minimum(begins + j, last)]]
        if j + 1 in lengths:
            yield j + 1, mix(acc + U64(j))


def value_of(byte: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte; A-Z counts as a-z."""
    return _VALUE[byte]
