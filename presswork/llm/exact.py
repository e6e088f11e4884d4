"""Exact deduplication with Patricia-trie owners.

Texts are partitioned by length and content hash; within such a partition their full byte strings
go into a compressed radix trie, whose terminal nodes carry the owner: the identifier that stays.
Two texts share a node only if every byte agrees, so a hash collision can't merge them.

* Before the shuffle, each slice of a map task folds its own copies (also by trie), so a text that a
  third of all rows repeat crosses the network once per slice and not once per row. What was folded is
  written once and read by all that follows.
* After it, a task sees its rows sorted by (length, hash). One such subtree is in memory at a time;
  the others wait in Spark's external sorter, on its disks: that is the spill by subtree.
* A length and hash that more than ``HOT`` slices have is settled in two steps: first in parts of about the square root of
  that number, whose owners then meet. So no task sees more than the root's number of bodies of one text.
* The answer goes back to the rows over the slice's own owners, keys that occur at most a slice's
  rows times each, so no join key is hot.

Defined cases: a null text counts as empty and all of those are copies of each other; a null doc_id
is smaller than any other; of rows that agree in text and doc_id the first in the table stays; other columns don't
matter to the decision. Rows are known by their place in the table; what isn't a scan of files is written to one first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, by_slices, free_name, in_place, pa_schema, slices, stash

ROW = "_dedup_row"
#: Slices that share a length and hash beyond which they are settled in parts first.
HOT = 256


class Patricia:
    """A radix trie over byte strings with path compression; terminals hold a value."""

    __slots__ = ("edges", "value")

    def __init__(self, value=None):
        self.edges: dict[int, list] = {}  # first byte -> [label, child]
        self.value = value

    def owner(self, key: bytes, make: Callable[[], object]) -> object:
        """The value at ``key``'s terminal; ``make()`` is put there if there is none."""
        node, at = self, 0
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                child = Patricia()
                node.edges[key[at]] = [key[at:] if at else key, child]
                node, at = child, len(key)
                break
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = _shared(label, key, at)
            middle = Patricia()
            middle.edges[label[k]] = [label[k:], child]
            edge[0], edge[1] = label[:k], middle
            node, at = middle, at + k
        if node.value is None:
            node.value = make()
        return node.value


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Bytes that ``label`` shares with ``key`` from ``at``: binary search over slices, compared natively."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def content_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


_FOLDED = "row long, doc_id long, owner long, n long, h long, sha string, best_id long, best_row long, size long, body binary"


def _rank(keep_max: bool) -> Callable[[int | None, int], tuple]:
    """The greatest of these is the row that stays; a null id is less than any other."""
    if keep_max:
        return lambda doc, row: (doc is not None, doc or 0, -row)
    return lambda doc, row: (doc is None, -(doc or 0), -row)


def _fold(keep_max: bool, hasher: Callable[[bytes], int]) -> Callable[[pa.RecordBatch], dict[str, object]]:
    rank = _rank(keep_max)

    def fold(part: pa.RecordBatch) -> dict[str, object]:
        tries: dict[tuple[int, int], Patricia] = {}
        owners: dict[int, list] = {}
        rows = part.column("row").to_pylist()
        ids = part.column("doc_id").to_pylist()
        cols: dict[str, list] = {k: [] for k in ("owner", "n", "h", "sha", "best_id", "best_row", "size", "body")}
        for k, (row, doc, text) in enumerate(zip(rows, ids, part.column("text").to_pylist(), strict=True)):
            raw = (text or "").encode("utf-8", "surrogatepass")
            h = hasher(raw)
            mine = tries.setdefault((len(raw), h), Patricia()).owner(
                raw, lambda: [k, row, len(raw), h, hashlib.sha256(raw).hexdigest(), (doc, row), 0, raw]  # noqa: B023
            )
            mine[5] = max(mine[5], (doc, row), key=lambda at: rank(*at))
            mine[6] += 1
            owners[mine[0]] = mine
            cols["owner"].append(mine[1])
            cols["sha"].append(mine[4])
        for k in range(len(rows)):
            own = owners.get(k)
            cols["best_id"].append(own[5][0] if own else None)
            cols["best_row"].append(own[5][1] if own else None)
            for name, at in (("n", 2), ("h", 3), ("size", 6), ("body", 7)):
                cols[name].append(own[at] if own else None)
        return {"row": part.column("row"), "doc_id": part.column("doc_id"), **cols}

    return fold


_BODY = ["owner", "n", "h", "best_id", "best_row", "size", "body"]
_SETTLED = "owner long, top long, n long, h long, best_id long, best_row long, size long, body binary"


def _settle(keep_max: bool, parts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by (part, n, h): one trie at a time, its classes sent on when it is complete, a row for each of the owners it
    met: ``top`` is the class's first owner, whose row carries the body if these are ``parts`` that go on."""
    rank, schema = _rank(keep_max), pa_schema(_SETTLED)

    def flush(classes: list[list]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in schema]
        for best, size, owners, n, h, body in classes:
            for k, owner in enumerate(owners):
                for c, v in zip(cols, (owner, owners[0], n, h, *best, size, body if parts and not k else None), strict=True):
                    c.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie, here, done, held = None, Patricia(), [], [], 0
        for batch in batches:
            for piece in slices(batch, "body"):
                for part, owner, n, h, doc, row, size, body in zip(*(piece.column(c).to_pylist() for c in ("part", *_BODY)), strict=True):
                    if (part, n, h) != at:
                        done += here
                        at, trie, here = (part, n, h), Patricia(), []
                        if len(done) > 20_000 or held > SLICE_BYTES:
                            yield from flush(done)
                            done, held = [], 0

                    def first(n=n, h=h, doc=doc, row=row, body=body):
                        here.append([(doc, row), 0, [], n, h, body if parts else None])
                        return here[-1]

                    mine = trie.owner(body, first)
                    held += len(body) if parts and not mine[2] else 0
                    mine[0] = max(mine[0], (doc, row), key=lambda b: rank(*b))
                    mine[1] += size
                    mine[2].append(owner)
        yield from flush(done + here)

    return settle


def _settled(bodies: DataFrame, keep_max: bool) -> DataFrame:
    """Per owner: keep_id, keep_row, group_size."""
    many = bodies.groupBy("n", "h").count().where(F.col("count") > HOT).select("n", "h", F.ceil(F.sqrt("count")).cast("int").alias("parts"))
    many = stash(many, "hot")  # at most a HOT-th of all slices' texts

    def through(rows: DataFrame, parts: bool) -> DataFrame:
        return (
            rows.select("part", *_BODY).repartition("part", "n", "h").sortWithinPartitions("part", "n", "h", "owner")
            .mapInArrow(_settle(keep_max, parts), _SETTLED)
        )

    def told(settled: DataFrame) -> DataFrame:
        return settled.select("owner", F.col("best_id").alias("keep_id"), F.col("best_row").alias("keep_row"), F.col("size").alias("group_size"))

    none = F.lit(0).alias("part")
    if many.isEmpty():
        return told(through(bodies.select(none, "*"), False))
    split = bodies.join(many, ["n", "h"]).withColumn("part", F.pmod(F.xxhash64("owner"), F.col("parts")).cast("int"))
    first = stash(through(split, True), "parts")
    tops = first.where("owner = top").select(none, *_BODY)
    rest = bodies.join(many.select("n", "h"), ["n", "h"], "left_anti").select(none, *_BODY)
    final = told(through(rest.unionByName(tops), False))
    # an owner of no part is its own top
    back = first.where("owner <> top").select("owner", F.col("top").alias("_top"))
    others = back.join(final.withColumnRenamed("owner", "_top"), "_top").drop("_top")
    return final.unionByName(others)


def exact_groups(docs: DataFrame, keep: str = "max", hasher: Callable[[bytes], int] = content_hash, row: str = ROW) -> DataFrame:
    """One row per row of ``docs``: its place (``row``), doc_id, keep_id, group_size, kept,
    text_sha256. ``keep``: ``max`` or ``min`` doc_id stays."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    narrow = in_place(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    folded = stash(by_slices(narrow, _fold(keep == "max", hasher), _FOLDED, budget=4 * SLICE_BYTES), "folded")
    settled = _settled(folded.where("body is not null").select(*_BODY), keep == "max")
    return folded.select("row", "doc_id", "owner", "sha").join(settled, "owner").select(
        F.col("row").alias(row), "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. What is shuffled beside the texts is
    the dropped rows' places, usually the lesser part."""
    docs = in_place(docs)
    row = free_name(docs, ROW)
    gone = exact_groups(docs, keep, row=row).where("not kept").select(row)
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").drop(row)
