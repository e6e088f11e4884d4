"""Transcripts to try operators on, with planted needles: the same rows for the same seed, made of ranges and arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEEDLES = ["pool exhausted at 128 of 128", "canary rate 0.4 over the limit", "recovered with p99 at 180"]


def signal_rounds(rounds: int, seed: int) -> list[int]:
    """The rounds in which a needle is planted, one for each."""
    return [(seed * 31 + k * (rounds // len(NEEDLES)) + k) % rounds for k in range(len(NEEDLES))]


def monitoring(spark: SparkSession, rounds: int = 60, seed: int = 7) -> DataFrame:
    """t, pos, role, name, content of a long watch: the same healthy answer round after round, and in a few rounds something that matters."""
    at = F.create_map(*[F.lit(x) for k, r in enumerate(signal_rounds(rounds, seed)) for x in (r, NEEDLES[k])])
    r = F.floor(F.col("id") / 2).cast("int")
    calm = F.repeat(F.lit("status 200, all nominal, heartbeat ok\n"), 40)
    said = F.when(F.col("id") % 2 == 0, F.concat(F.lit("[tool call: check "), r.cast("string"), F.lit("]"))).otherwise(
        F.when(at[r].isNotNull(), F.concat(F.lit("ERROR in round "), r.cast("string"), F.lit(": "), at[r], F.lit("\n"))).otherwise(calm)
    )
    body = spark.range(2 * rounds).select((F.col("id") + 1).alias("pos"), F.when(F.col("id") % 2 == 0, "assistant").otherwise("tool").alias("role"), said.alias("content"))
    ends = spark.createDataFrame([(0, "user", "Watch the service and tell what went wrong."), (2 * rounds + 1, "user", "What happened?")], "pos long, role string, content string")
    return body.unionByName(ends).select(F.lit("watch").alias("t"), "pos", "role", F.when(F.col("role") == "tool", "check").otherwise("").alias("name"), "content")


def repeated_tools(spark: SparkSession, agents: int = 3, dumps: int = 4, lines: int = 80) -> DataFrame:
    """agent, pos, role, name, text of agents that all read the same settings; each agent's last dump has one line of its own."""
    d = spark.range(agents * dumps).select((F.col("id") % dumps).alias("pos"), F.floor(F.col("id") / dumps).cast("long").alias("a"))
    base = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda i: F.concat(F.lit("option_"), i.cast("string"), F.lit(" = "), (i * 7).cast("string"))), "\n")
    own = F.when(F.col("pos") == dumps - 1, F.concat(F.lit("\nowner_of_agent = "), F.col("a").cast("string"))).otherwise("")
    return d.select(F.concat(F.lit("agent"), F.col("a").cast("string")).alias("agent"), "pos", F.lit("tool").alias("role"), F.lit("settings").alias("name"), F.concat(base, own).alias("text"))
