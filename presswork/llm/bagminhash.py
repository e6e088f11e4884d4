"""MinHash near-dedup on multisets: BagMinHash signatures, banded, multiset overlap verified.

Each shingle owns a hierarchy of Poisson processes over its weight axis: the axis is cut at 1, 2, 4,
8, ... and the cell of size ``s`` has points at rate ``s`` in time, each with a place in the
cell and one of the signature's components, all drawn from a hash of (shingle, cell, number). A text in
which the shingle occurs ``w`` times sees the points whose place is below ``w``; a cell wholly below
needs no look at places. A component keeps the identity of its earliest point. Two texts agree in a
component exactly if the earliest point of both is in both, so the chance is their weighted
Jaccard, sum of minima over sum of maxima.

Points come in order of time, and only those up to a limit that fills all components but rarely are
drawn (rarely: the limit is then doubled), so a text costs its distinct shingles plus
``m log m`` points and not their product.

Defined cases: null and empty texts have no shingles and are one class; texts of one to four words
are one shingle; a null doc_id is less than any other; copies, ties and repeated rows share a class.
32 bands of 5 rows miss a pair at 0.8 with a chance of 3 in a million.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import near
from .near import Scheme
from .shingles import mix

BANDS, ROWS, THRESHOLD = 32, 5, 0.8
#: Points are drawn up to the time by which the chance of an empty component is exp(-SURE) or so.
SURE = 2.0
#: Points that are drawn in one pass where fewer processes are left.
DRAWN = 4096


def bag_sketch(x: np.ndarray, w: np.ndarray, n: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (texts by ``m``, 32 bits) of bags: shingles ``x`` with counts ``w``, ``n`` per text."""
    texts = len(n)
    owner = np.repeat(np.arange(texts), n)
    total = np.bincount(owner, w, texts)
    # cells: [0, 1) is number 0, [2**(j-1), 2**j) is number j
    cells = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(x)), cells)
    ends = np.cumsum(cells)
    j = np.arange(len(at)) - np.repeat(ends - cells, cells)
    low = np.where(j > 0, 2.0 ** (j - 1), 0.0)
    size = np.maximum(low, 1.0)
    seed = mix(x[at] + np.uint64(0x632BE59BD9B4E019) * (j.astype(np.uint64) + np.uint64(1)))
    out = np.zeros((texts, m), np.uint32)
    stretch, todo = 1.0, total > 0
    while todo.any():
        limit = np.where(todo, stretch * m * (np.log(m) + SURE) / np.maximum(total, 1.0), 0.0)
        live = np.flatnonzero(todo[owner[at]])
        slots, times, marks = [], [], []
        t, k = np.zeros(len(live)), 0
        lim, rate, sd = limit[owner[at[live]]], size[live], seed[live]
        lo, wt, own = low[live], w[at[live]].astype(np.float64), owner[at[live]]
        while len(t):
            # where few are left, as of a text of few shingles, many points of each are drawn at once
            block = max(1, DRAWN // len(t))
            step = np.uint64(0xD1B54A32D192ED03) * np.arange(k + 1, k + 1 + block, dtype=np.uint64)
            h = mix(sd[:, None] + step)
            gaps = np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
            np.negative(gaps, out=gaps)
            gaps[:, 0] += t
            till = np.cumsum(gaps, 1)
            on = till < lim[:, None]
            at_, h, ts = np.nonzero(on)[0], h[on], till[on]
            g = mix(h ^ np.uint64(0xA24BAED4963EE407))
            seen = lo[at_] + rate[at_] * ((g >> np.uint64(32)).astype(np.float64) * 2.0**-32) < wt[at_]
            part = ((g & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            slot = own[at_] * m + part.astype(np.int64)
            if seen.all():
                slots.append(slot), times.append(ts), marks.append(h)
            else:
                slots.append(slot[seen]), times.append(ts[seen]), marks.append(h[seen])
            go = on[:, -1]
            t, lim, rate, sd, lo, wt, own = (v[go] for v in (till[:, -1], lim, rate, sd, lo, wt, own))
            k += block
        slot, time, mark = np.concatenate(slots), np.concatenate(times), np.concatenate(marks)
        best = np.full(texts * m, np.inf)
        np.minimum.at(best, slot, time)
        won = np.flatnonzero(time == best[slot])[::-1]  # of equal times the first drawn is written last
        slot, mark = slot[won], mark[won]
        filled = np.zeros(texts * m, bool)
        filled[slot] = True
        whole = filled.reshape(texts, m).all(1) & todo
        flat = np.zeros(texts * m, np.uint32)
        flat[slot] = (mark >> np.uint64(16)).astype(np.uint32)
        out[whole] = flat.reshape(texts, m)[whole]
        todo &= ~whole
        stretch *= 2
    return out


def scheme(threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> Scheme:
    return Scheme(lambda x, w, n: bag_sketch(x, w, n, bands * rows), bands, rows, True, threshold)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classes of texts whose five-word bags have a weighted Jaccard of ``threshold`` or more."""
    return near.near_classes(docs, scheme(threshold))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the least doc_id, with all columns."""
    return near.keep_one(docs, scheme(threshold))
