"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

A frame has ``frame`` slots, and source ``s`` gets ``w_s`` of them, its target weight in whole slots.
Its block ``k`` of a frame is released at slot ``floor(k * frame / w_s)`` and due by slot
``ceil((k + 1) * frame / w_s)``. Each slot goes to the released block that is due first. For unit
blocks whose weights fill the frame this meets every deadline, so at any moment a source is less than one
block from its share. The schedule repeats, so it is worked out for one frame (a table of ``frame`` rows,
folded from a literal, however large the corpus) and block ``k`` of the corpus takes slot
``(k div w_s) * frame + slot[s][k mod w_s]``.

Within a source, rows are ordered by the md5 of their id, then by their place in the table. Ranks don't sort a source in one task: its
rows are cut into ranges by the first digits of that md5, as many digits as leave about ``RANGE_ROWS`` rows of the largest source
in a range, counted (with a partial aggregate), and a row's rank is the rows in earlier ranges plus its rank in its own. An id that
more than a ``HEAVY``-th of all rows have (or none at all) would fill a range: its rows are cut by their place further.

For more than ``SQL_SOURCES`` sources the same schedule is worked out with a heap on the driver, as a table of the frame's rows.

Defined cases: a null source is a source of its own, "(null)"; a null id has the md5 of the empty
text; ties and repeated rows get different ranks; an empty table gives an empty result; clashing columns of the
input are replaced. A source without a target shares what the named ones leave, or has one slot.
No row is dropped: when a source runs out, its slots stay empty and the order of the others holds.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import clear_of, in_place

FRAME, BLOCK_ROWS = 840, 4
NULL_SOURCE = "(null)"
#: Most sources whose frame is folded in SQL.
SQL_SOURCES = 500
#: Rows of a source in a range that one task ranks; a share of one in so many rows makes an id heavy.
RANGE_ROWS, HEAVY = 1_000_000, 1000


def quantised(weights: dict[str, float], frame: int) -> dict[str, int]:
    """Whole slots per source that add up to the frame: one at least, the rest by largest remainder."""
    names = sorted(weights)
    total = sum(weights.values())
    spare = frame - len(names)
    exact = {n: weights[n] / total * spare for n in names}
    slots = {n: 1 + int(exact[n]) for n in names}
    for n in sorted(names, key=lambda n: (-(exact[n] - int(exact[n])), n))[: frame - sum(slots.values())]:
        slots[n] += 1
    return slots


def frame_sql(slots: dict[str, int], frame: int) -> str:
    """Spark SQL for one frame: rows (name, w, k, slot). The fold takes one slot at a time and holds
    each source's next block; a source that has had its blocks is due after the frame's end."""
    names = sorted(slots)
    w = "array(" + ", ".join(f"{slots[n]}L" for n in names) + ")"
    quoted = "array(" + ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names) + ")"
    last = len(names) - 1
    due = f"((element_at(acc.next, i + 1) + 1) * {frame}L + element_at({w}, i + 1) - 1) div element_at({w}, i + 1)"
    out = f"(element_at(acc.next, i + 1) * {frame}L) div element_at({w}, i + 1) <= t and element_at(acc.next, i + 1) < element_at({w}, i + 1)"
    pick = f"array_min(transform(filter(sequence(0, {last}), i -> {out}), i -> named_struct('due', {due}, 'i', i))).i"
    return f"""
      select element_at({quoted}, p.i + 1) as name, element_at({w}, p.i + 1) as w, p.k as k, cast(slot as bigint) as slot
      from (select posexplode(aggregate(
        sequence(0, {frame - 1}),
        named_struct('next', transform({w}, x -> 0L), 'out', cast(array() as array<struct<i: int, k: bigint>>)),
        (acc, t) -> element_at(transform(array({pick}), j -> named_struct(
            'next', transform(acc.next, (x, i) -> if(i = j, x + 1L, x)),
            'out', concat(acc.out, array(named_struct('i', j, 'k', element_at(acc.next, j + 1)))))), 1),
        acc -> acc.out)) as (slot, p))
    """


def frame_rows(slots: dict[str, int], frame: int) -> list[tuple[str, int, int, int]]:
    """The same rows as ``frame_sql``: the released block that is due first, of equals the first source."""
    names = sorted(slots)
    waiting = [(0, i) for i in range(len(names))]  # (release, source), a heap
    ready: list[tuple[int, int]] = []  # (due, source), a heap
    following, out = [0] * len(names), []
    for t in range(frame):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            w = slots[names[i]]
            heapq.heappush(ready, (((following[i] + 1) * frame + w - 1) // w, i))
        _, i = heapq.heappop(ready)
        w, k = slots[names[i]], following[i]
        out.append((names[i], w, k, t))
        following[i] = k + 1
        if k + 1 < w:
            heapq.heappush(waiting, ((k + 1) * frame // w, i))
    return out


def _md5(doc_id: str) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def default_weights(docs: DataFrame) -> dict[str, float]:
    """Square roots of the sources' sizes, counted over all rows: large sources are held back, small
    ones raised."""
    return {s: n**0.5 for s, n in sizes_of(docs).items()}


def sizes_of(docs: DataFrame) -> dict[str, int]:
    """Rows per source. Reads one column; the result has a row per source, as the target weights do that go with it."""
    return {r["s"]: r["count"] for r in docs.groupBy(F.coalesce(F.col("source"), F.lit(NULL_SOURCE)).alias("s")).count().collect()}


def _range(docs: DataFrame, rows: int, largest: int) -> Column:
    """The range of a row, in the order of (md5, place): the md5's first digits, and where there are heavy ids how many of their md5s are
    before the row's; at one of them also the row's input partition."""
    digits = 3
    while digits < 16 and 16**digits * RANGE_ROWS < largest:
        digits += 1
    ids = docs.groupBy(F.col("doc_id").cast("string").alias("d")).count().where(F.col("count") * HEAVY > max(rows, HEAVY * RANGE_ROWS // 16))
    heavy = sorted(r["m"] for r in ids.select(_md5("d").alias("m")).collect())  # fewer than HEAVY
    part = F.substring("_mix_md5", 1, digits)
    if not heavy:
        return part
    list_ = F.array(*[F.lit(m) for m in heavy])
    passed = F.size(F.filter(list_, lambda m: m < F.col("_mix_md5")))
    place = F.shiftright("_mix_row", 33)  # the input partition
    at = F.array_contains(list_, F.col("_mix_md5"))
    return F.concat(part, F.lpad(passed.cast("string"), 4, "0"), F.when(at, F.concat(F.lit("b"), F.lpad(place.cast("string"), 10, "0"))).otherwise("a"))


def pfair_order(docs: DataFrame, weights: dict[str, float] | None = None, frame: int = FRAME, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with mix_rank (place within the source), mix_block, mix_slot (the block's slot in the
    whole mix) and mix_due (the slot by whose end it was due). Order by mix_slot, mix_rank to read the mix."""
    spark = docs.sparkSession
    added = ("mix_rank", "mix_block", "mix_slot", "mix_due", "_mix_source", "_mix_md5", "_mix_part", "_mix_row")
    docs = clear_of(docs, *added)
    sizes = sizes_of(docs)
    known = {s: n**0.5 for s, n in sizes.items()} if weights is None else dict(weights)
    if weights is not None:
        left = max(0.0, 1.0 - sum(known.values()))
        new = [s for s in sizes if s not in known]
        known |= {s: (left / len(new)) or min(known.values()) / frame for s in new}
    if not known:
        empty = docs
        for c in ("mix_rank", "mix_block", "mix_slot", "mix_due"):
            empty = empty.withColumn(c, F.lit(None).cast(T.LongType()))
        return empty
    frame = max(frame, 2 * len(known))
    slots = quantised(known, frame)
    # frame rows, whatever the corpus
    if len(slots) <= SQL_SOURCES:
        plan = spark.sql(frame_sql(slots, frame))
    else:
        plan = spark.createDataFrame(frame_rows(slots, frame), "name string, w long, k long, slot long")

    keyed = (
        docs.withColumn("_mix_source", F.coalesce(F.col("source"), F.lit(NULL_SOURCE)))
        .withColumn("_mix_md5", _md5("doc_id"))
        .withColumn("_mix_row", F.monotonically_increasing_id())
    )
    keyed = keyed.withColumn("_mix_part", _range(docs, sum(sizes.values()), max(sizes.values(), default=0)))
    # rows before each range of a source
    before = (
        keyed.groupBy("_mix_source", "_mix_part").count()
        .select("_mix_source", "_mix_part", (F.sum("count").over(Window.partitionBy("_mix_source").orderBy("_mix_part")) - F.col("count")).alias("_mix_before"))
    )
    within = Window.partitionBy("_mix_source", "_mix_part").orderBy("_mix_md5", "doc_id", "_mix_row")
    ranked = keyed.withColumn("_mix_in", F.row_number().over(within)).join(before, ["_mix_source", "_mix_part"])
    ranked = ranked.withColumn("mix_rank", F.col("_mix_before") + F.col("_mix_in") - 1)
    ranked = ranked.withColumn("mix_block", F.floor(F.col("mix_rank") / block_rows))
    shares = spark.createDataFrame([(n, w) for n, w in sorted(slots.items())], "name string, _mix_w long")
    few = F.broadcast if len(slots) <= SQL_SOURCES else lambda df: df
    ranked = ranked.join(few(shares), ranked["_mix_source"] == shares["name"]).drop("name")
    ranked = ranked.withColumn("_mix_k", F.col("mix_block") % F.col("_mix_w"))
    place = plan.select(F.col("name").alias("_mix_name"), F.col("k").alias("_mix_pk"), F.col("slot").alias("_mix_at"))
    placed = ranked.join(
        few(place), (ranked["_mix_source"] == place["_mix_name"]) & (ranked["_mix_k"] == place["_mix_pk"])
    )
    base = F.expr("mix_block div _mix_w") * frame
    return (
        placed.withColumn("mix_slot", base + F.col("_mix_at"))
        .withColumn("mix_due", base + F.expr(f"((_mix_k + 1) * {frame} + _mix_w - 1) div _mix_w"))
        .drop("_mix_source", "_mix_part", "_mix_md5", "_mix_row", "_mix_in", "_mix_before", "_mix_w", "_mix_k", "_mix_name", "_mix_pk", "_mix_at")
    )


def placed(docs: DataFrame, weights: dict[str, float] | None = None, row: str = "_mix_place") -> DataFrame:
    """Of every row its place in the table (``row``), mix_slot and mix_rank; reads ids and sources only. It is the same for any table with the
    same ids and sources, rows that agree in both being free to change places."""
    narrow = in_place(docs).select(F.monotonically_increasing_id().alias(row), "doc_id", "source")
    return pfair_order(narrow, weights).select(row, "mix_slot", "mix_rank")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, with all the columns of ``docs``, of whatever name. The order is that
    of the files when written: ranges of slots, sorted within. Texts aren't ranked, only joined to their places; who reads the files
    gets the places again from ``placed``."""
    docs = in_place(docs)
    row, whole = "_mix_place", docs.select(F.monotonically_increasing_id().alias("_mix_place"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_whole"))
    return whole.join(placed(docs, weights, row), row).orderBy("mix_slot", "mix_rank").select("_mix_whole.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """What the query returns: the place of every document, without its text."""
    return pfair_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source")).select("doc_id", "source", "mix_rank", "mix_block", "mix_slot", "mix_due")


#: The same rows by DuckDB: sizes counted, slots quantised and one frame folded in SQL.
MIX_SQL = f"""
with recursive
src as (select coalesce(source, '{NULL_SOURCE}') s, sqrt(count(*)) x from documents group by 1),
fr as (select greatest({FRAME}, 2 * count(*)) f, count(*) n, sum(x) total from src),
sh as (select s, x / total * (f - n) e, f, n from src, fr),
rk as (select s, e, f, n, row_number() over (order by -(e - floor(e)), s) r, sum(1 + floor(e)) over () got from sh),
w as (select row_number() over (order by s) - 1 i, s, f, cast(1 + floor(e) as bigint) + case when r <= f - got then 1 else 0 end w from rk),
wl as (select list(w order by i) w, max(f) f from w),
fold(t, nxt, j, k) as (
  select -1, list_transform(w, lambda x: 0::bigint), -1::bigint, -1::bigint from wl
  union all
  select t + 1, list_transform(nxt, lambda x, i: case when i = p + 1 then x + 1 else x end), p, nxt[p + 1]
  from (
    select t, nxt, (
      select min({{'due': ((nxt[i + 1] + 1) * f + w[i + 1] - 1) // w[i + 1], 'i': i}})
      from range(len(nxt)) g(i)
      where (nxt[i + 1] * f) // w[i + 1] <= t + 1 and nxt[i + 1] < w[i + 1]
    ).i p
    from fold, wl where t + 1 < f
  )
),
frame as (select j, k, t slot from fold where t >= 0),
ranked as (
  select doc_id, source, coalesce(source, '{NULL_SOURCE}') s,
    row_number() over (partition by coalesce(source, '{NULL_SOURCE}') order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 mix_rank
  from documents
)
select cast(doc_id as bigint) doc_id, source, mix_rank, mix_rank // {BLOCK_ROWS} mix_block,
  cast((mix_rank // {BLOCK_ROWS}) // w.w * f + slot as bigint) mix_slot,
  cast((mix_rank // {BLOCK_ROWS}) // w.w * f + ((k + 1) * f + w.w - 1) // w.w as bigint) mix_due
from ranked join w using (s) join frame on j = w.i and k = (mix_rank // {BLOCK_ROWS}) % w.w
"""
