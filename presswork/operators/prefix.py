"""Prompt-cache prefixes: what is protected, what stayed stable, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import json_chars, tokens

READ, WRITE = 0.1, 1.25
TTLS = {"5min": (300, 1.25), "1hour": (3600, 2.0)}


def _running(transcript: str) -> Window:
    return Window.partitionBy(transcript).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def protect(messages: DataFrame, transcript: str, budget: int = 1024) -> DataFrame:
    """Adds tokens and ``protected``: the longest run of whole messages from the start within the budget. Every message costs at least a token, so
    the running sum alone tells."""
    t = messages.withColumn("tokens", tokens("content"))
    return t.withColumn("protected", F.sum("tokens").over(_running(transcript)) <= budget)


def message_chars(extra: Column | int = 0) -> Column:
    """Characters of a message (role, name, content) as one JSON object."""
    return json_chars("role") + json_chars("name") + json_chars("content") + F.lit(len('{"role": "", "name": "", "content": ""}')) + extra


def protect_turns(messages: DataFrame, transcript: str, chars: int) -> DataFrame:
    """Per turn (messages with turn_id; null ones are no turn): its characters as JSON, and ``protected``: the longest run of whole turns from the start
    within ``chars``."""
    turns = messages.where("turn_id is not null").groupBy(transcript, "turn_id").agg(F.sum(message_chars()).alias("chars"))
    w = Window.partitionBy(transcript).orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("protected", F.sum("chars").over(w) <= chars)


def stable_prefix(original: DataFrame, squeezed: DataFrame, transcript: str) -> DataFrame:
    """Tokens of the leading messages that are the same in both."""
    b = squeezed.select(transcript, "pos", F.col("role").alias("_r"), F.col("content").alias("_c"))
    both = original.join(b, [transcript, "pos"], "left").withColumn("_d", (~(F.col("role").eqNullSafe(F.col("_r")) & F.col("content").eqNullSafe(F.col("_c")))).cast("int"))
    held = both.withColumn("_bad", F.max("_d").over(_running(transcript)))
    return held.groupBy(transcript).agg(F.sum(F.when(F.col("_bad") == 0, tokens("content")).otherwise(0)).alias("stable"), F.sum(tokens("content")).alias("total"))


def next_turn_cost(stable: Column, total: Column, per_mtok: float = 3.0) -> tuple[Column, Column]:
    return (stable * READ + (total - stable)) * per_mtok / 1e6, total * per_mtok / 1e6


def session_cost(stable: Column, total: Column, turns: int = 10, per_mtok: float = 3.0) -> tuple[Column, Column]:
    aware, naive = next_turn_cost(stable, total, per_mtok)
    return stable * WRITE * per_mtok / 1e6 + turns * aware, turns * naive


def breakpoints(messages: DataFrame, transcript: str, budget: int = 1024) -> DataFrame:
    """Where to put cache marks: the last protected message and the last of all."""
    p = protect(messages, transcript, budget)
    ends = F.array_compact(F.array(F.max(F.when(F.col("protected"), F.col("pos"))), F.max("pos")))
    return p.groupBy(transcript).agg(F.array_distinct(ends).alias("marks"))


def cache_marks(blocks: Column, at: Column) -> Column:
    """Blocks (type, text) with ``cache_control`` on the last text block, if ``at``."""
    last = F.array_max(F.transform(blocks, lambda b, i: F.when(b["type"] == "text", i)))
    return F.transform(
        blocks, lambda b, i: F.struct(b["type"].alias("type"), b["text"].alias("text"), F.when(at & (i == last), "ephemeral").alias("cache_control"))
    )


def ttl(turns: DataFrame, session: str, prefix: int, dynamic: int, per_mtok: float = 3.0) -> DataFrame:
    """Per session and TTL: misses, hits and cost. ``turns`` has gap_sec, null at a session's first turn. The first turn misses, and any
    after a gap of more than the TTL."""
    aggs = []
    for name, (sec, write) in TTLS.items():
        miss = F.sum((F.col("gap_sec").isNull() | (F.greatest(F.lit(0.0), "gap_sec") > sec)).cast("long"))
        cost = (miss * (prefix * write) + (F.count("*") - miss) * (prefix * READ) + F.count("*") * F.lit(float(dynamic))) * per_mtok / 1e6
        aggs += [miss.alias(f"miss_{name}"), cost.alias(f"cost_{name}")]
    return turns.groupBy(session).agg(F.count("*").alias("n"), *aggs)


def recommend(simulated: DataFrame) -> DataFrame:
    a, b = F.round("cost_5min", 6), F.round("cost_1hour", 6)
    return simulated.withColumn("ttl", F.when(b < a, "1hour").otherwise("5min")).withColumn("saving", F.when(F.greatest(a, b) > 0, 1 - F.least(a, b) / F.greatest(a, b)).otherwise(0.0))
