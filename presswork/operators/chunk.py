"""Cutting text into chunks: packed lines, hard-split long lines, overlap, plain slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import SPACES, col

CHUNK, ERROR_CHUNK, OVERLAP = 6000, 1500, 100


def is_error_dense(text: Column | str) -> Column:
    return (F.length(col(text)) >= 2 * ERROR_CHUNK) & P.ERROR_DENSE(col(text))


def chunk_size(text: Column | str, two_tier: bool = True) -> Column:
    return F.when(is_error_dense(text), ERROR_CHUNK).otherwise(CHUNK) if two_tier else F.lit(CHUNK)


def packed(text: str, size: str) -> Column:
    """Array of (text, hard_after): one fold over the lines inside the JVM. A line longer than the size gives
    full hard segments; what is left of it, if not blank, packs on with the lines after it."""
    segments = f"if(length(l) > {size}, (length(l) - 1) div {size}, 0)"
    flushed = "if(acc.n > 0, concat(acc.out, array(named_struct('text', acc.cur, 'hard', false))), acc.out)"
    peeled = (
        f"if({segments} = 0, acc, named_struct('out', concat({flushed}, transform(sequence(1, {segments}), "
        f"k -> named_struct('text', substring(l, (k - 1) * {size} + 1, {size}), 'hard', true))), 'cur', '', 'n', 0))"
    )
    added = (
        f"if(not rlike(r, '[^{SPACES}]'), acc, "
        f"if(acc.n > 0 and acc.n + length(r) + 1 > {size}, named_struct('out', {flushed}, 'cur', r, 'n', length(r) + 1), "
        "named_struct('out', acc.out, 'cur', if(acc.n = 0, r, concat(acc.cur, '\\n', r)), 'n', acc.n + length(r) + 1)))"
    ).replace("\\x", "\\\\x")
    # element_at(transform(array(x), ...), 1) names an intermediate value
    step = (
        f"element_at(transform(array(struct({peeled} as acc, substring(l, {segments} * {size} + 1) as r)), "
        f"s -> element_at(transform(array(s.r), r -> element_at(transform(array(s.acc), acc -> {added}), 1)), 1)), 1)"
    )
    zero = "named_struct('out', cast(array() as array<struct<text: string, hard: boolean>>), 'cur', '', 'n', 0)"
    return F.expr(f"aggregate(split({text}, '\\n', -1), {zero}, (acc, l) -> {step}, acc -> {flushed})")


def chunks(df: DataFrame, keys: list[str], text: str = "text", size: Column | int = CHUNK) -> DataFrame:
    """keys, chunk_idx (from 0), chunk, hard_after. Texts without any filled line have no chunk."""
    sized = df.select(*keys, F.col(text).alias("_t"), (F.lit(size) if isinstance(size, int) else size).cast("int").alias("_size"))
    return sized.select(*keys, F.posexplode(packed("_t", "_size")).alias("chunk_idx", "_c")).select(
        *keys, "chunk_idx", F.col("_c.text").alias("chunk"), F.col("_c.hard").alias("hard_after")
    )


def with_overlap(chunked: DataFrame, keys: list[str], overlap: int = OVERLAP) -> DataFrame:
    """Hard-split chunks get the first characters of the chunk after them; their number is kept."""
    after = F.lead("chunk").over(Window.partitionBy(*keys).orderBy("chunk_idx"))
    extra = F.when(F.col("hard_after") & after.isNotNull(), F.substring(after, 1, overlap)).otherwise("")
    return chunked.withColumn("_x", extra).select(
        *keys, "chunk_idx", F.concat("chunk", "_x").alias("chunk"), "hard_after", F.length("_x").cast("long").alias("overlap_after")
    )


def slices(df: DataFrame, keys: list[str], text: str = "text", width: int = 1000) -> DataFrame:
    """Each filled line in slices of ``width``, without packing."""
    cut = F.expr(
        f"flatten(transform(filter(split({text}, '\\n', -1), l -> trim(l) <> ''), "
        f"l -> transform(sequence(0, (length(l) - 1) div {width}), k -> substring(l, k * {width} + 1, {width}))))"
    )
    return df.select(*keys, F.posexplode(cut).alias("chunk_idx", "chunk"))
