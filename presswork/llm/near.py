"""Near duplicates from banded signatures: candidates in Spark, verified on whole texts.

1. Every row gets a hash of its bag of shingles, a signature and band keys. Rows with equal bags
   are one node (grouped with a partial aggregate, so copies don't travel).
2. Round one: in each band bucket every node is a candidate of the bucket's least node, no pair else.
   Candidates whose sizes or signatures rule the threshold out are left; the others are verified on
   their texts. Links make components.
3. Round two: only buckets that still hold more than one component are looked at again. There,
   every node outside the bucket's largest component is compared (signature against signature, chunk by
   chunk, so no task holds a bucket) with every node of another component, and what may reach
   the threshold is verified. So of two texts that share a band and are alike, either their
   component is one already or their link is found: a bucket is never capped, and a family of
   near copies costs its size, not its square.
4. Components of all links give the classes.

A text travels once per round to each block where its candidates are verified, blocks being parts of some
``BLOCK_NODES`` pairs: of a family, or of one node's partners where these are more. Nothing is collected to the driver.
The answer goes back to the rows over their bags' hashes; those that more than a ``HEAVY``-th of all rows have are fewer than
``HEAVY``, so they are broadcast and only the others are shuffled. Tables that a later step doesn't read are deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, free_name, in_place, list_array, pa_schema, release, slices, stash
from .shingles import bags, likeness, mix

BLOCK_NODES, CHUNK_NODES = 128, 2000
#: Rows of (block, node), 16 bytes each, up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 400_000
#: Bytes of text that are sketched together; a sketch takes some thirty times that for the moment.
SKETCHED = 1 << 20
#: Standard deviations of the signature's estimate below the threshold at which a candidate is left.
SIGMAS = 4.5
ROW = "_near_row"
#: A share of one in so many rows makes a bag heavy.
HEAVY = 1000

Sketch = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Scheme:
    """How rows are sketched: ``sketch(shingles, weights, distinct per text)`` gives an array of texts by
    ``bands * rows`` 32-bit values; ``multiset`` says which Jaccard is meant."""

    def __init__(self, sketch: Sketch, bands: int, rows: int, multiset: bool, threshold: float):
        self.sketch, self.bands, self.rows, self.multiset, self.threshold = sketch, bands, rows, multiset, threshold

    @property
    def floor(self) -> float:
        t = self.threshold
        return t - SIGMAS * float(np.sqrt(t * (1 - t) / (self.bands * self.rows)))


def _hash_bands(sig: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band of each signature."""
    values = sig.reshape(len(sig), bands, -1).astype(np.uint64)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for k in range(values.shape[2]):
        h = mix(h ^ values[:, :, k]) + np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def _signed(scheme: Scheme) -> Callable[[pa.RecordBatch], dict[str, object]]:
    def run(part: pa.RecordBatch) -> dict[str, object]:
        texts = [t or "" for t in part.column("text").to_pylist()]
        x, w, n = bags(texts)
        owner = np.repeat(np.arange(len(texts)), n)
        weight = np.bincount(owner, w, len(texts)).astype(np.int64)
        size = weight if scheme.multiset else n
        # sums of two independent hashes of (shingle, count): 128 bits, no matter the order
        counted = x + np.uint64(0x9E3779B97F4A7C15) * (w.astype(np.uint64) if scheme.multiset else np.uint64(1))
        sums = []
        for salt in (0x1234567, 0x89ABCDEF01):
            total = np.zeros(len(texts), np.uint64)
            np.add.at(total, owner, mix(counted ^ np.uint64(salt)))
            sums.append(mix(total + weight.astype(np.uint64) if scheme.multiset else total).view(np.int64))
        sig = scheme.sketch(x, w, n)
        keys = _hash_bands(sig, scheme.bands).view(np.int64)
        keys = keys[n > 0]  # a text without shingles has its equals already
        short = (sig & 255).astype(np.uint8)
        return {
            "row": part.column("row"), "doc_id": part.column("doc_id"), "b1": pa.array(sums[0]), "b2": pa.array(sums[1]),
            "size": pa.array(size.astype(np.int64)), "sig": pa.array([s.tobytes() for s in short], pa.binary()),
            "bands": list_array(keys.reshape(-1), np.where(n > 0, scheme.bands, 0)),
        }

    return run


_SIGNED = "row long, doc_id long, b1 long, b2 long, size long, sig binary, bands array<long>"


def near_classes(docs: DataFrame, scheme: Scheme, row: str = ROW) -> DataFrame:
    """One row per row of ``docs``: its place (``row``), doc_id, class_id (the least doc_id of the
    class), class_rows, and kept (true for one row of the class, with that doc_id). Null ids are less than others."""
    docs = in_place(docs)
    nodes, rows = _nodes(docs, scheme)
    one, stars, two = _rounds(docs, scheme, nodes)
    # the stars of round one and the links of round two
    labels = components(stars.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(two.select("a", "b")))
    own = nodes.select("node", F.col("first.doc_id").alias("d"), "copies")
    full = own.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    classes = full.groupBy("class").agg(F.min(F.struct("d", "node")).alias("best"), F.sum("copies").alias("class_rows"))
    told = stash(
        full.select("node", "class").join(classes, "class").select("node", "best", "class_rows")
        .join(nodes.select("b1", "b2", "node", "copies"), "node").select("b1", "b2", "copies", "best", "class_rows"),
        "told",
    )
    release(nodes, one, stars, two)
    # a heavy bag's copies stay where they are
    total = told.agg(F.sum("copies").alias("_all"))
    heavy = F.broadcast(told.crossJoin(F.broadcast(total)).where(F.col("copies") * HEAVY > F.col("_all")).drop("_all"))  # fewer than HEAVY rows
    bag = ["b1", "b2"]
    answered = rows.join(heavy, bag).unionByName(rows.join(heavy.select(*bag), bag, "left_anti").join(told, bag))
    return answered.select(
        F.col("row").alias(row), "doc_id", F.col("best.d").alias("class_id"), "class_rows", (F.col("row") == F.col("best.node")).alias("kept")
    )


def _nodes(docs: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stash(by_slices(narrow, _signed(scheme), _SIGNED, budget=SKETCHED), "signed")
    rows = signed.select("row", "doc_id", "b1", "b2")
    grouped = rows.groupBy("b1", "b2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies"))
    firsts = grouped.select("b1", "b2", "first", "copies", F.col("first.row").alias("node"))
    rest = signed.select(F.col("row").alias("node"), "size", "sig", "bands")
    return stash(firsts.join(rest, "node"), "nodes"), rows


def near_links(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Verified links (a, b, jaccard) between nodes, enough of them that every pair at or over the
    threshold that shares a band is in one component."""
    docs = in_place(docs)
    one, _, two = _rounds(docs, scheme, _nodes(docs, scheme)[0])
    return one.unionByName(two)


def _rounds(docs: DataFrame, scheme: Scheme, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links of round one, their components' labels, and the links of round two."""
    texts = docs.select(F.monotonically_increasing_id().alias("node"), "text")
    buckets = nodes.select("node", "size", F.explode("bands").alias("key"))
    leads = buckets.groupBy("key").agg(F.min(F.struct("node", "size")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    # the seats of buckets with more than one node, usually the lesser part, serve both rounds
    shared = stash(buckets.join(leads, "key").select("key", "node", "size", "lead", "m"), "shared")
    pairs = (
        shared.where("node != lead.node")
        .where(F.least("size", "lead.size") >= scheme.threshold * F.greatest("size", "lead.size"))
        .select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    )
    one = _verified(_plausible(pairs, nodes, scheme), texts, scheme)
    labels = stash(components(one), "labels")

    # round two: buckets with more than one component
    placed = shared.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    inside = stash(placed.join(mixed.select("key"), "key").select("key", "node", "size", "comp", "m"), "mixed")
    by_comp = inside.groupBy("key", "comp").agg(F.count("*").alias("c"))
    major = by_comp.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top")).select("key", F.col("top.comp").alias("major"))
    chunks = F.ceil(F.col("m") / CHUNK_NODES).cast("int")
    seats = inside.join(major, "key").select(
        "key", "node", "comp", "size", (F.col("comp") != F.col("major")).alias("asks"),
        F.pmod(F.xxhash64("node"), chunks).cast("int").alias("seat"), chunks.alias("seats"),
    )
    seated = seats.select("key", F.col("seat").alias("chunk"), F.lit(0).alias("kind"), "node", "comp", "size").unionByName(
        seats.where("asks").select("key", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)).alias("chunk"), F.lit(1).alias("kind"), "node", "comp", "size")
    )
    compared = (
        seated.join(nodes.select("node", "sig"), "node")
        .repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind", "node")
        .select("key", "chunk", "kind", "node", "comp", "size", "sig")
        .mapInArrow(_compare(scheme), "a long, b long")
    )
    two = _verified(compared.distinct(), texts, scheme)
    release(shared, inside)
    return one, labels, two


def _plausible(pairs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs whose signatures don't rule the threshold out."""
    sigs = nodes.select("node", "sig")
    both = (
        pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    )
    floor = scheme.floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column("sa").to_pylist()), _matrix(batch.column("sb").to_pylist())
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= floor))

    return both.mapInArrow(run, "a long, b long")


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)


def _compare(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by block and kind: keep a block's seats, stream those that ask past them."""
    floor, threshold, schema = scheme.floor, scheme.threshold, pa_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seats = None, ([], [], [], [])
        table = None
        for batch in batches:
            key, chunk, kind = (batch.column(c).to_numpy() for c in ("key", "chunk", "kind"))
            node, comp, size = (batch.column(c).to_numpy() for c in ("node", "comp", "size"))
            sig = batch.column("sig").to_pylist()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if lo == hi:
                    continue
                if (key[lo], chunk[lo]) != at:
                    at, seats, table = (key[lo], chunk[lo]), ([], [], [], []), None
                if kind[lo] == 0:
                    for held, new in zip(seats, (node, comp, size, sig), strict=True):
                        held.extend(new[lo:hi])
                    continue
                if table is None:
                    table = (*(np.array(v, np.int64) for v in seats[:3]), _matrix(seats[3]) if seats[3] else np.zeros((0, 1), np.uint8))
                for k in range(lo, hi):
                    near = (
                        (table[1] != comp[k]) & (np.minimum(table[2], size[k]) >= threshold * np.maximum(table[2], size[k]))
                    )
                    if near.any():
                        who = np.flatnonzero(near)
                        who = who[(table[3][who] == np.frombuffer(sig[k], np.uint8)).mean(1) >= floor]
                        if len(who):
                            other = table[0][who]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.minimum(other, node[k])), pa.array(np.maximum(other, node[k]))], schema=schema
                            )

    return run


def _verified(pairs: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs at or over the threshold, computed on the texts' bags. The nodes ``b`` of one least
    partner form a family, cut into blocks; a node with more partners than a block takes is cut by these. A block
    gets each text that it needs once."""
    pairs = stash(pairs, "pairs")
    fam = pairs.groupBy("b").agg(F.min("a").alias("family"), F.count("*").alias("k"))
    crowd = fam.where(F.col("k") <= BLOCK_NODES).groupBy("family").agg(F.sum("k").alias("n"))
    home = fam.join(crowd, "family", "left").select("b", "family", "k", "n")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / BLOCK_NODES))
    block = F.when(F.col("k") > BLOCK_NODES, F.xxhash64("b", part("a", "k"))).otherwise(F.xxhash64("family", part("b", "n")))
    sent = pairs.join(home, "b").select(block.alias("block"), "a", "b")
    wanted = stash(sent.select("block", F.col("b").alias("node")).unionByName(sent.select("block", F.col("a").alias("node"))).distinct(), "wanted")
    # two numbers a row: where they are few, all texts needn't be shuffled to find theirs
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    bodies = texts.join(near, "node").select("block", F.lit(0).alias("kind"), "node", F.lit(None).cast("long").alias("b"), "text")
    asked = sent.select("block", F.lit(1).alias("kind"), F.col("a").alias("node"), "b", F.lit(None).cast("string").alias("text"))
    schema, threshold = "a long, b long, jaccard double", scheme.threshold
    target = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for part in slices(batch, "text"):
                kinds = part.column("kind").to_numpy()
                block, node = part.column("block").to_numpy(), part.column("node").to_numpy()
                b = part.column("b").to_pylist()
                rows = np.flatnonzero(kinds == 0)
                x, w, n = bags([t or "" for t in part.column("text").take(pa.array(rows)).to_pylist()])
                ends = np.append(0, np.cumsum(n))
                got: list[tuple[int, int, float]] = []
                k = 0
                for i in range(len(kinds)):
                    if block[i] != at:
                        at, held = block[i], {}
                    if kinds[i] == 0:
                        held[int(node[i])] = (x[ends[k] : ends[k + 1]].copy(), w[ends[k] : ends[k + 1]].copy())
                        k += 1
                    else:
                        j = likeness(held[int(node[i])], held[b[i]], scheme.multiset)
                        if j >= threshold:
                            got.append((int(node[i]), b[i], j))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), target, strict=True)], schema=target)

    links = stash(bodies.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind", "node").mapInArrow(run, schema), "links")
    release(pairs, wanted)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, label (the component's least node) of every node in ``links`` (a, b), by alternating
    large-star and small-star steps on tables in the shared folder until nothing changes, which each step brings nearer. Minima
    are partial aggregates joined back, so a node with any number of links is no hot spot for memory."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was, now = None, mark(edges)
    while now[0] and now != was:
        was, old = now, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = stash(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(),
            "edges",
        )
        release(old)
        now = mark(edges)
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops.select("node", F.col("node").alias("label")))


def keep_one(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """One row of each class, the one that ``near_classes`` keeps, with all its columns."""
    docs = in_place(docs)
    row = free_name(docs, ROW)
    gone = near_classes(docs, scheme, row).where("not kept").select(row)
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").drop(row)
