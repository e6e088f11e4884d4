"""How much evidence survives, and how well decisions agree with labels."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import filled, strip


def needle_recall(messages: DataFrame, needles: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per needle (needle_id, needle): the number of messages that hold it, in any case. Each message is looked at once, against the array
    of all needles, a parameter of few rows; only finds are shuffled."""
    few = needles.agg(F.collect_list(F.struct("needle_id", F.lower("needle").alias("n"))).alias("_n"))
    finds = messages.select(key, F.lower(text).alias("_t")).crossJoin(F.broadcast(few)).select(key, F.explode(F.expr("filter(_n, x -> contains(_t, x.n))")).alias("_f"))
    counts = finds.groupBy(F.col("_f.needle_id").alias("needle_id")).agg(F.count("*").alias("found_in"))
    return needles.join(counts, "needle_id", "left").select("needle_id", F.coalesce("found_in", F.lit(0)).cast("long").alias("found_in"))


def lost(needles: DataFrame, kept: DataFrame, on: str) -> DataFrame:
    return needles.join(kept, on, "left_anti")


def decision_quality(decided: DataFrame, labels: DataFrame, key: str, kept: str, label: str) -> DataFrame:
    both = decided.join(labels.where(F.col(label).isNotNull()), key)
    good, k = F.col(label) == 1, F.col(kept)
    return both.agg(F.count_if(k & good).alias("kept_good"), F.count_if(k & ~good).alias("kept_bad"), F.count_if(~k & good).alias("lost_good"), F.count_if(~k & ~good).alias("lost_bad"))


def digest(messages: DataFrame, transcript: str, budget: int = 4000, cut: int = 400) -> DataFrame:
    """Blocks for a compaction note: tool results first, then the others in order, until one would exceed the budget. Blocks have
    at least a character, so the running sum alone tells."""
    t = strip("content")
    label = F.when(F.col("role") == "tool", F.concat(F.lit("tool:"), "name")).otherwise(F.col("role"))
    m = messages.where(filled("content")).where(~((F.col("role") == "assistant") & F.startswith(t, F.lit("[tool call:"))))
    snippet = F.when(F.length(t) <= cut, t).otherwise(F.concat(F.substring(t, 1, cut), F.lit(" …")))
    b = m.withColumn("block", F.concat(F.lit("- ["), label, F.lit("] "), snippet)).withColumn("_o", F.when(F.col("role") == "tool", 0).otherwise(1))
    w = Window.partitionBy(transcript).orderBy("_o", "pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = b.withColumn("_sum", F.sum(F.length("block")).over(w)).where(F.col("_sum") <= budget)
    return kept.select(transcript, "pos", "block", F.col("_sum").cast("long").alias("used"))


def score(before: DataFrame, after: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Per input (key): size before and after in tokens, evidence strings (key, needle_id, needle) and those that some message still holds, in any case, and what was saved. Evidence is joined to an
    input's messages, so a string is looked for in its own input only; finds are few, messages never gathered by input (the strings, parameters of few rows, are broadcast)."""
    size = lambda df, name: df.groupBy(key).agg(F.floor(F.sum(F.length("content")) / 4).cast("long").alias(name))
    lists = evidence.groupBy(key).agg(F.collect_list(F.struct("needle_id", F.lower("needle").alias("n"))).alias("_n"), F.count("*").alias("evidence"))
    low = after.select(key, F.lower("content").alias("_t")).join(F.broadcast(lists.select(key, "_n")), key)
    finds = low.select(key, F.explode(F.expr("filter(_n, x -> contains(_t, x.n))")).alias("_f")).select(key, "_f.needle_id").distinct()
    hits = finds.groupBy(key).agg(F.count("*").alias("recalled"))
    out = size(before, "tokens_before").join(size(after, "tokens_after"), key).join(lists.drop("_n"), key, "left").join(hits, key, "left")
    none = F.lit(0).cast("long")
    return out.select(key, "tokens_before", "tokens_after", F.coalesce("evidence", none).alias("evidence"), F.coalesce("recalled", none).alias("recalled"), (F.col("tokens_before") - F.col("tokens_after")).alias("saved"))


def run_benches(benches: dict[str, Callable[[], object]], timeout: float = 300.0, tail: int = 3) -> list[tuple[str, bool, float, str]]:
    """Run named checks one after another: name, whether it ended without an error and in time, seconds, and the last lines of what it said."""
    out = []
    for name, bench in sorted(benches.items()):
        began, said = time.monotonic(), ""
        try:
            said, good = str(bench() or ""), True
        except Exception as e:  # a bench's failure is its outcome
            said, good = f"{type(e).__name__}: {e}", False
        took = time.monotonic() - began
        out.append((name, good and took <= timeout, round(took, 3), "\n".join(said.splitlines()[-tail:])))
    return out
