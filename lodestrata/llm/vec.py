"""Word and shingle hashing of many texts at once, in numpy.

A word is a maximal run of ASCII letters, digits and bytes of other scripts.
Hashes are 64-bit, the same on every machine and for every batching.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_GOLD = U(0x9E3779B97F4A7C15)

WORD = np.zeros(256, bool)
for _a, _b in ((48, 57), (65, 90), (97, 122), (128, 255)):
    WORD[_a : _b + 1] = True
#: All but ASCII white space and control characters.
VISIBLE = np.zeros(256, bool)
VISIBLE[33:] = True
VISIBLE[127] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, U(base))
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters all bits; works in place on its own copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes in *member*; none spans two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_in = member[data]
    start = is_in.copy()
    start[1:] &= ~is_in[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    start[edges] = is_in[edges]
    end = is_in.copy()
    end[:-1] &= ~is_in[1:]
    before = edges[edges > 0] - 1
    end[before] = is_in[before]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def doc_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that holds each start."""
    bounds = np.searchsorted(starts, offsets)
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(bounds))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every run, by prefix sums of a polynomial."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(_R, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_R_INV, max(n, 1))[starts])


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index) of all words, in order."""
    starts, ends = runs(data, offsets, member)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    return run_hashes(data, starts, ends), doc_of(starts, offsets)


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index) of all runs of k words; a shorter text has one shingle of all its words."""
    out, where = [], []
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    steps = [U(pow(0xD1342543DE82EF95, j + 1, 1 << 64)) for j in range(k)]
    n = len(hashes) - k + 1
    if n > 0:
        whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
        s = np.zeros(len(whole), U)
        for j in range(k):
            s += hashes[whole + j] * steps[j]
        out.append(mix(s))
        where.append(doc[whole])
    for short in range(1, k):
        d = np.flatnonzero(counts == short)
        if len(d):
            s = np.full(len(d), U(short))
            for j in range(short):
                s += hashes[first[d] + j] * steps[j]
            out.append(mix(s))
            where.append(d)
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h, w = np.concatenate(out), np.concatenate(where)
    if len(out) > 1:
        order = np.argsort(w, kind="stable")
        h, w = h[order], w[order]
    return h, w


def bags(hashes: np.ndarray, doc: np.ndarray, bits: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, element, count) of each text's distinct elements, which are the
    upper *bits* of the hashes, in order of text and element."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    key = (doc.astype(U) << U(bits)) | (hashes >> U(64 - bits))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> U(bits)).astype(np.int64), key & U((1 << bits) - 1), count
