"""Chunk policies: each takes chunks and adds ``p``, the probability that a chunk is worth keeping.

A policy is any function from a DataFrame with the keys, chunk_idx and chunk to the same with ``p``; one that calls
a hosted judge would be a ``mapInPandas`` that leaves ``p`` null on failure, which counts as keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import all_lines, lines, named, strip


def uniqueness(chunked: DataFrame) -> DataFrame:
    """Repetitive chunks (under 35 % distinct lines) 0.1, others 1."""
    ls = F.filter(F.transform(all_lines("chunk"), strip), lambda x: x != "")
    few = (F.size(ls) > 0) & (100 * F.size(F.array_distinct(ls)) < 35 * F.size(ls))
    return chunked.withColumn("p", F.when(few, 0.1).otherwise(1.0))


def boilerplate(chunked: DataFrame, transcript: str, order: list[str], noise: P.Pattern = P.HEARTBEAT) -> DataFrame:
    """0 for chunks of which 60 % of the lines occurred in an earlier chunk of the transcript or are short and noise.
    Occurrence before is a minimum over the line's chunks; lines are hashed for the shuffle."""
    spot = F.struct(*order)
    per_line = chunked.select(transcript, spot.alias("_at"), F.explode(lines("chunk")).alias("_l"))
    per_line = per_line.select(transcript, "_at", F.sha1("_l").alias("_h"), ((F.length("_l") < 200) & noise(F.col("_l"))).cast("int").alias("_noise"))
    first = per_line.groupBy(transcript, "_h").agg(F.min("_at").alias("_first"))
    told = (
        per_line.join(first, [transcript, "_h"]).groupBy(transcript, "_at")
        .agg(F.count("*").alias("_n"), F.sum((F.col("_first") < F.col("_at")).cast("int") + F.col("_noise")).alias("_bad"))
    )
    joined = chunked.withColumn("_at", spot).join(told, [transcript, "_at"], "left")
    keep = F.when(F.col("_n").isNull() | (10 * F.col("_bad") >= 6 * F.col("_n")), 0.0).otherwise(1.0)
    return joined.withColumn("p", keep).drop("_at", "_n", "_bad")


def contains_any(chunk: Column, needles: Column) -> Column:
    """Whether the chunk holds any of the needles (in lower case); the chunk is lowered once, not again for every needle."""
    return named(F.lower(chunk), lambda low: F.exists(needles, lambda n: F.contains(low, n)))


def evidence(chunked: DataFrame, needles: DataFrame, found: float = 0.95, lost: float = 0.05) -> DataFrame:
    """A perfect judge: chunks that hold any of the needles. The needles, a parameter of few rows, go as one array."""
    all_needles = needles.agg(F.collect_list(F.lower("needle")).alias("_needles"))
    return chunked.crossJoin(F.broadcast(all_needles)).withColumn("p", F.when(contains_any(F.col("chunk"), F.col("_needles")), found).otherwise(lost)).drop("_needles")


def fragments(chunked: DataFrame, needle: str, width: int = 6, found: float = 0.95, lost: float = 0.05) -> DataFrame:
    """A judge that knows a needle by any ``width`` characters of it."""
    grams = sorted({needle.lower()[k : k + width] for k in range(max(1, len(needle) - width + 1))})
    hit = F.exists(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.lower("chunk"), g))
    return chunked.withColumn("p", F.when(hit, found).otherwise(lost))


def priors(chunked: DataFrame, priors: DataFrame, keys: list[str], otherwise: float = 0.5) -> DataFrame:
    """What was decided of a message before (keys, p) as the probability of all its chunks; ``otherwise`` of messages that nothing was decided of."""
    return chunked.join(priors.select(*keys, F.col("p").alias("_p")), keys, "left").withColumn("p", F.coalesce("_p", F.lit(otherwise))).drop("_p")
