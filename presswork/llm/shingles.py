"""Five-word shingles as 64-bit hashes, for a slice of texts at once.

Words are what lies between white space, unchanged. A text of one to four words is one shingle, all of
it; a text without words has none.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WIDTH = 5
#: Bytes up to which words are hashed all at once.
SHORT = 32
#: Distinct words whose hash a worker remembers.
WORDS = 150_000


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 40:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


_HASH = WordHash()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the texts in order, and how many each text has."""
    lists = [t.split() for t in texts]
    sizes = np.array([len(w) for w in lists], np.int64)
    flat = np.fromiter((h for w in lists for h in map(_HASH.__getitem__, w)), np.uint64, int(sizes.sum()))
    return _rolled(flat, sizes, width)


_GAPS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts in order, by eight bytes at a time, and how many words each text has."""
    raws = [(t if t.isascii() else _GAPS.sub(" ", t)).encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(raws) + bytes([32] * (SHORT + 1))
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    h = mix(size.astype(np.uint64))
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    who = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        who = who[size[who] > at]
        if not len(who):
            break
        word = np.ascontiguousarray(view[starts[who] + at]).view("<u8")[:, 0] & _MASK[np.minimum(size[who] - at, 8)]
        h[who] = mix(h[who] * np.uint64(0x9E3779B97F4A7C15) ^ word)
    for k in np.flatnonzero(size > SHORT).tolist():
        h[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    upto = np.cumsum(np.array([len(r) + 1 for r in raws], np.int64))
    return h, np.diff(np.searchsorted(starts, upto), prepend=0)


def _rolled(flat: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of texts of which the words' hashes are known."""
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    if not len(flat):
        return flat, counts
    rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(rolled)]
    starts = np.cumsum(sizes) - sizes
    where = np.repeat(starts, counts) + _ramp(counts)
    out = np.empty(len(where), np.uint64)
    long = np.repeat(sizes >= width, counts)
    out[long] = rolled[where[long]]
    begin = np.cumsum(counts) - counts
    for k in np.flatnonzero((sizes > 0) & (sizes < width)):
        h = int(sizes[k])
        for x in flat[starts[k] : starts[k] + sizes[k]].tolist():
            h = (h * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
        out[begin[k]] = h
    return mix(out), counts


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _by_owner(x: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """``x`` in ascending order within each of the ascending owners: by the owner and what of ``x`` fits
    beside it in 64 bits, and if that leaves any out of order, by both in full."""
    bits = np.uint64(max(1, owners.bit_length()))
    key = owner.astype(np.uint64) << (np.uint64(64) - bits) | x >> bits
    order = np.argsort(key)
    out, key = x[order], key[order]
    if ((key[1:] == key[:-1]) & (out[1:] < out[:-1])).any():
        return x[np.lexsort((x, owner))]
    return out


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of shingles: the distinct shingles of each text in ascending order, their counts, and
    how many distinct ones each text has."""
    x, counts = _rolled(*words(texts), WIDTH)
    owner = np.repeat(np.arange(len(texts)), counts)
    x = _by_owner(x, owner, len(texts))
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(x)))
    return x[at], weight, np.bincount(owner[at], minlength=len(texts))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], multiset: bool) -> float:
    """Jaccard of two bags (ascending shingles, counts): sum of minima over sum of maxima, or of the
    sets. Two empty bags are alike."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not multiset:
        return len(i) / (len(a[0]) + len(b[0]) - len(i))
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)
