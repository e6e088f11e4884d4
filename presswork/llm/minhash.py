"""Document fingerprints by MinHash: universal hash permutations over five-word shingles in numpy.

Permutation ``k`` takes a 32-bit shingle hash ``x`` to the high 32 bits of ``a_k x + b_k`` modulo 2**64 with 64-bit ``a_k`` and
``b_k`` (multiply-add-shift, a strongly universal family), and a signature component is the least value over a text's shingles. A
fingerprint is 128 components of 16 bits, in hexadecimal. ``near_classes`` joins 32 bands of 4 in Spark and verifies
the Jaccard of the shingle sets on the texts.

``edited_fingerprints`` is the edit test: each text against itself with its last third replaced by the
beginning of the next document's, in descending doc_id. Ids, row places and sizes alone are sorted first, and cut into blocks of
``BLOCK_BYTES`` of text by (id, place), so one id or none at all is cut like any others. A block also gets the first row of the one after it, so
texts are shuffled once and no task sees more than a block. The blocks' first rows, 16 bytes for each ``BLOCK_BYTES`` of the
corpus (50 MB for 100 TB), are what the driver and the workers hold.

Defined cases: a null text counts as empty; a text without words has the fingerprint of no shingles,
which is like itself alone; null ids come last; rows with equal ids follow each other in table order; of one row
only, the next is itself. Rows are known by their place in the table; what isn't a scan of files is written to one first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .common import SLICE_BYTES, in_place, pa_schema, slices, text_or_empty
from .near import Scheme
from .shingles import shingles

COMPONENTS, BANDS, ROWS, THRESHOLD = 128, 32, 4, 0.8
#: Bytes of text that one task puts in order and fingerprints.
BLOCK_BYTES = 32 << 20

_rng = np.random.default_rng(20240601)
_A = _rng.integers(0, 1 << 64, COMPONENTS, np.uint64)[:, None]
_B = _rng.integers(0, 1 << 64, COMPONENTS, np.uint64)[:, None]
#: Shingles that are permuted together: a block of 128 by this many stays in cache.
STEP = 512


def signatures(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Texts by 128 least values, of the shingles ``x``, ``n`` per text; all ones without shingles."""
    low = x >> np.uint64(32)
    out = np.full((len(n), COMPONENTS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    at = 0
    for k, count in enumerate(n.tolist()):
        for lo in range(at, at + count, STEP):
            block = low[lo : min(lo + STEP, at + count)] * _A
            block += _B
            np.minimum(out[k], block.min(1), out=out[k])
        at += count
    return (out >> np.uint64(32)).astype(np.uint32)


def short(sig: np.ndarray) -> np.ndarray:
    """The 16 bits of each component that a fingerprint keeps, of a mix of all its bits."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def set_sketch(x: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    return signatures(x, n) * np.uint32(0x9E3779B1) >> np.uint32(8)


def scheme(threshold: float = THRESHOLD) -> Scheme:
    return Scheme(set_sketch, BANDS, ROWS, False, threshold)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classes of texts whose sets of five-word shingles have a Jaccard of ``threshold`` or more."""
    return near.near_classes(docs, scheme(threshold))


def near_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return near.near_links(docs, scheme(threshold))


def fingerprints_of(texts: list[str]) -> np.ndarray:
    return short(signatures(*shingles(texts)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row. Row-local."""
    from .common import by_slices

    def run(part: pa.RecordBatch) -> dict[str, object]:
        said = fingerprints_of([t or "" for t in part.column("text").to_pylist()])
        return {"doc_id": part.column("doc_id"), "fingerprint": [s.tobytes().hex() for s in said]}

    return by_slices(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, fingerprint string")


def edited_text(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of ``after``."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _digest(rows: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
    texts = [t for _, t in rows] + [after]
    edited = [edited_text(t, nxt) for t, nxt in zip(texts, texts[1:], strict=False)]
    own, new = fingerprints_of(texts), fingerprints_of(edited)
    cols = [
        [d for d, _ in rows],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        [s.tobytes().hex() for s in own[:-1]],
        [s.tobytes().hex() for s in new],
        (own[:-1] == new).mean(1),
        (own[:-1] == own[1:]).mean(1),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, pa_schema(_OUT), strict=True)], schema=pa_schema(_OUT))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their blocks; a block's last row is the one that follows it."""
    at, held, size = None, [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            for block, doc, text in zip(*(part.column(c).to_pylist() for c in ("block", "doc_id", "text")), strict=True):
                if block == at and held and size > SLICE_BYTES // 2:
                    yield _digest(held, text)
                    held, size = [], 0
                elif block != at:
                    if len(held) > 1:
                        yield _digest(held[:-1], held[-1][1])
                    at, held, size = block, [], 0
                held.append((doc, text))
                size += len(text)
    if len(held) > 1:
        yield _digest(held[:-1], held[-1][1])


class Bounds:
    """First rows of the blocks, in order: by id descending, null ids last, then by place."""

    def __init__(self, heads: list[tuple[int | None, int]]):
        known = [h for h in heads if h[0] is not None]
        self.ids = np.array([~h[0] for h in known], np.int64)  # ~ turns the order round
        self.rows = np.array([h[1] for h in known], np.int64)
        self.nulls = np.array([h[1] for h in heads if h[0] is None], np.int64)
        self.first = {h[1] for h in heads}

    def block(self, ids: np.ndarray, none: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each row (id, whether it has none, place) the last block whose first row isn't after it."""
        out = np.empty(len(at), np.int64)
        turned = ~ids
        low, high = np.searchsorted(self.ids, turned, "left"), np.searchsorted(self.ids, turned, "right")
        out[:] = low
        split = np.flatnonzero(high > low)  # ids that begin a block, perhaps several
        for k in np.unique(low[split]):
            mine = split[low[split] == k]
            out[mine] = k + np.searchsorted(self.rows[k : high[mine[0]]], at[mine], "right")
        out[none] = len(self.ids) + np.searchsorted(self.nulls, at[none], "right")
        return out - 1


def _heads(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (doc_id, row, size) in order, each that begins a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = 0
        for batch in batches:
            ends = np.cumsum(batch.column("size").to_numpy())
            picked, at = [], 0
            while at < len(ends):
                base = ends[at - 1] if at else 0
                if room <= 0:
                    picked.append(at)
                    room = block
                upto = min(int(np.searchsorted(ends, base + room, "left")) + 1, len(ends))
                room -= int(ends[upto - 1] - base)
                at = upto
            if picked:
                yield batch.select(["doc_id", "row"]).take(pa.array(picked))

    return run


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = in_place(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("row")]
    sizes = rows.select("doc_id", "row", (F.octet_length("text") + 64).cast("long").alias("size"))
    heads = [(r["doc_id"], r["row"]) for r in sizes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_heads(BLOCK_BYTES), "doc_id long, row long").collect()]
    if not heads:
        return spark.createDataFrame([], _OUT)
    heads.sort(key=lambda h: (h[0] is None, -(h[0] or 0), h[1]))
    shared = spark.sparkContext.broadcast(heads)

    @F.pandas_udf("array<long>")
    def seats(ids: pd.Series, none: pd.Series, places: pd.Series) -> pd.Series:
        """A row's block, and for a block's first row also the block before it; the first block's goes with the last."""
        bounds = _bounds(shared)
        blocks = bounds.block(ids.to_numpy(np.int64), none.to_numpy(bool), places.to_numpy(np.int64)).tolist()
        return pd.Series([[b, b - 1 if b else len(bounds.first) - 1] if r in bounds.first else [b] for b, r in zip(blocks, places.tolist(), strict=True)])

    placed = rows.withColumn("seats", seats(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "row")).select(F.posexplode("seats").alias("last", "block"), "doc_id", "row", "text")
    return (
        placed.repartitionById(len(heads), F.col("block").cast("int")).sortWithinPartitions("block", "last", *order)  # a block is a task
        .select("block", "doc_id", "text").mapInArrow(_walk, _OUT)
    )


_BOUNDS: dict[int, Bounds] = {}


def _bounds(shared) -> Bounds:
    """Made once per worker and broadcast."""
    key = id(shared.value)
    if key not in _BOUNDS:
        _BOUNDS.clear()
        _BOUNDS[key] = Bounds(shared.value)
    return _BOUNDS[key]
