"""Keep or drop scored chunks and put the text together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from . import chunk as C
from . import prefix as X

THRESHOLD = 0.5


def keep(scored: DataFrame, keys: list[str], threshold: float = THRESHOLD, inverted: bool = False) -> DataFrame:
    """``keep``: p at or over the threshold, and where a message would lose all, its best chunk, the first of equals. A null p
    keeps. ``inverted``: p says that a chunk is redundant."""
    fair = F.coalesce("p", F.lit(0.0 if inverted else 1.0))
    above = fair < threshold if inverted else fair >= threshold
    w = Window.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(fair.asc() if inverted else fair.desc(), "chunk_idx"))
    none = ~F.max(above).over(w)
    return scored.withColumn("keep", above | (none & (best == 1)))


def keep_top(scored: DataFrame, transcript: list[str], order: list[str], keys: list[str], share: float = 0.25) -> DataFrame:
    """The best quarter of a transcript's chunks, one at least, and one of every message."""
    w = Window.partitionBy(*transcript)
    rank = F.row_number().over(w.orderBy(F.desc("p"), *order))
    top = rank <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))
    m = Window.partitionBy(*keys)
    marked = scored.withColumn("_top", top)
    return marked.withColumn("keep", F.col("_top") | (~F.max("_top").over(m) & (F.row_number().over(m.orderBy(F.desc("p"), "chunk_idx")) == 1))).drop("_top")


def reassemble(kept: DataFrame, keys: list[str], marker: str = "squeezed", always: bool = False, lines_only: bool = False) -> DataFrame:
    """Messages from chunks with ``keep``: overlap is cut off where the chunk after it stays, hard splits join
    with nothing and lines with a line feed (``lines_only``: both do), and a note says how many chunks stayed if not all did."""
    w = Window.partitionBy(*keys).orderBy("chunk_idx")
    over = F.col("overlap_after") if "overlap_after" in kept.columns else F.lit(0)
    cut = F.coalesce(F.lead("keep").over(w), F.lit(False)) & (over > 0)
    body = F.when(cut, F.expr("substring(chunk, 1, length(chunk) - cast(_over as int))")).otherwise(F.col("chunk"))
    parts = kept.withColumn("_over", over).withColumn("_body", body)
    piece = F.when(F.col("keep"), F.struct("chunk_idx", F.col("_body").alias("t"), F.when(F.col("hard_after") & F.lit(not lines_only), "").otherwise("\n").alias("s")))
    told = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("_p"), F.sum(F.col("keep").cast("int")).alias("n_kept"), F.count("*").alias("n_chunks"))
    text = F.expr("array_join(transform(_p, (x, i) -> if(i = size(_p) - 1, x.t, concat(x.t, x.s))), '')")
    note = F.concat(F.lit(f"[{marker}: kept "), "n_kept", F.lit("/"), "n_chunks", F.lit(" chunks]\n"))
    shown = note if always else F.when(F.col("n_kept") < F.col("n_chunks"), note).otherwise("")
    return told.select(*keys, F.concat(shown, text).alias("content"), F.col("n_kept").cast("long").alias("n_kept"), F.col("n_chunks").cast("long").alias("n_chunks"))


Policy = Callable[[DataFrame], DataFrame]


def squeeze(
    messages: DataFrame, transcript: str, policy: Policy, threshold: float = THRESHOLD, two_tier: bool = True, overlap: int = 0, verbatim: bool = False, first_form: bool = False
) -> DataFrame:
    """Rewrites tool messages (transcript, pos, role, name, content); others pass, and so do tool messages
    without a filled line. Adds n_kept and n_chunks (null where nothing was judged). Chunking loses blank lines; with ``verbatim`` a message
    that keeps all its chunks stays as it was. ``first_form`` is the older pruner's: its note always, and chunks joined by line feeds."""
    keys = [transcript, "pos"]
    tools = messages.where("role = 'tool'")
    cut = C.chunks(tools, keys, "content", C.chunk_size("content", two_tier))
    judged = C.with_overlap(cut, keys, overlap) if overlap else cut
    kept = keep(policy(judged), keys, threshold)
    out = (reassemble(kept, keys, "compressed", True, True) if first_form else reassemble(kept, keys)).withColumnRenamed("content", "_new")
    new = F.when(F.col("n_kept") < F.col("n_chunks"), F.col("_new")) if verbatim else F.col("_new")
    return messages.join(out, keys, "left").withColumn("content", F.coalesce(new, "content")).drop("_new")


def squeeze_stats(before: DataFrame, after: DataFrame, transcript: str) -> DataFrame:
    a = before.groupBy(transcript).agg(F.sum(tokens("content")).alias("tokens_before"))
    b = after.groupBy(transcript).agg(F.sum(tokens("content")).alias("tokens_after"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("judged"))
    return a.join(b, transcript).withColumn("saved", F.col("tokens_before") - F.col("tokens_after"))


def cache_aware(messages: DataFrame, transcript: str, policy: Policy, protect: int = 1024, **how) -> DataFrame:
    """``squeeze`` of what follows the protected prefix, which stays byte for byte so that a prompt cache still holds it: adds tokens (before),
    ``protected``, n_kept and n_chunks. Only the tail is chunked and judged."""
    told = X.protect(messages, transcript, protect)
    prefix = told.where("protected").withColumn("n_kept", F.lit(None).cast("long")).withColumn("n_chunks", F.lit(None).cast("long"))
    tail = squeeze(told.where("not protected"), transcript, policy, **how)
    return prefix.unionByName(tail)


def cache_aware_stats(squeezed: DataFrame, transcript: str) -> DataFrame:
    """Per transcript: tokens before, after, in the prefix and after it, and chunks in all and kept."""
    after, zero = tokens("content"), F.lit(0).cast("long")
    return squeezed.groupBy(transcript).agg(
        F.sum("tokens").alias("tokens_before"), F.sum(after).alias("tokens_after"), F.sum(F.when(F.col("protected"), after).otherwise(zero)).alias("protected_tokens"),
        F.sum(F.when(F.col("protected"), zero).otherwise(after)).alias("dynamic_tokens_after"),
        F.coalesce(F.sum("n_chunks"), zero).alias("chunks_total"), F.coalesce(F.sum("n_kept"), zero).alias("chunks_kept"),
    )
