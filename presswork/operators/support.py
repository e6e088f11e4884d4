"""Support threads: notice pleasantries, apologies, repeats and repeated verification; keep facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import lines, squash_lower
from . import admit as A

FULL_CHARS, HOLD_CHARS = 200, 120


def local(turns: DataFrame, text: str = "text") -> DataFrame:
    """Adds what a turn tells by itself: ``early`` (a notice that needs no memory, or null), again (it asks to verify), facts (lines), digest (of turns that may be repeats)."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = turns.withColumn("_l", lines(body)).withColumn("_norm", squash_lower(body))
    empty, nice, sorry = F.size("_l") == 0, F.forall("_l", lambda x: P.PLEASANTRY(x)), F.forall("_l", lambda x: P.APOLOGY(x))
    return (
        d.withColumn("early", F.when(empty, "[empty turn]").when(nice, "[pleasantries]").when(sorry, "[template apology]"))
        .withColumn("again", F.exists("_l", lambda x: P.REVERIFY(x))).withColumn("facts", F.filter("_l", lambda x: P.FACT(x)))
        .withColumn("digest", F.when(F.col("early").isNull() & (F.length("_norm") > 40), F.sha2("_norm", 256))).drop("_l", "_norm")
    )


def step(known: dict, r: object) -> tuple[dict, str, str]:
    """One turn after another, for streams: what is remembered then, decision, excerpt."""
    text, facts = r.text, list(r.facts)
    if isinstance(r.early, str):
        return known, "notice", r.early
    if isinstance(r.digest, str):
        if r.digest in known["seen"]:
            return known, "notice", "[duplicate of earlier turn]"
        known = known | {"seen": [*known["seen"], r.digest]}
    if r.again:
        return (known, "notice", "[re-verification; facts established earlier]") if known["known"] else (known, "keep_full", text)
    if facts:
        known = known | {"known": True}
    if len(text) <= FULL_CHARS:
        return known, "keep_full", text
    if facts:
        return known, "keep_excerpt", "\n".join(facts)
    return (known, "notice", "[no facts]") if len(text) > 600 else (known, "keep_full", text)


def judge(turns: DataFrame, thread: str, order: str, text: str = "text") -> DataFrame:
    """Adds decision and excerpt. What a turn remembers of earlier ones is two windows of the thread: whether its normal form occurred at an
    earlier turn that counts, and whether any earlier turn established a fact."""
    d = local(turns, text)
    # equal turns of one thread that count
    d = d.withColumn("_dup", F.col("digest").isNotNull() & (F.row_number().over(Window.partitionBy(thread, "digest").orderBy(order)) > 1))
    gives = F.col("early").isNull() & ~F.col("_dup") & ~F.col("again") & (F.size("facts") > 0)
    before = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_known", F.coalesce(F.max(gives.cast("int")).over(before), F.lit(0)) == 1)
    short = F.length(text) <= FULL_CHARS
    note = (
        F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("_dup"), "[duplicate of earlier turn]")
        .when(F.col("again") & F.col("_known"), "[re-verification; facts established earlier]")
        .when(~F.col("again") & ~short & (F.size("facts") == 0) & (F.length(text) > 600), "[no facts]")
    )
    part = note.isNull() & ~F.col("again") & ~short & (F.size("facts") > 0)
    return (
        d.withColumn("decision", F.when(note.isNotNull(), "notice").when(part, "keep_excerpt").otherwise("keep_full"))
        .withColumn("excerpt", F.when(note.isNotNull(), note).when(part, F.array_join("facts", "\n")).otherwise(F.col(text)))
        .withColumn("held", F.coalesce((F.col("decision") != "keep_full") & (F.length(text) > HOLD_CHARS), F.lit(False)))
        .drop("early", "again", "facts", "digest", "_dup", "_known")
    )


def squeeze(turns: DataFrame, thread: str, order: str, text: str = "text") -> DataFrame:
    """Turns of threads with decision, ref (numbered per thread and decision, of all that isn't kept in full and is longer than 120 characters) and out."""
    d = A.with_refs(judge(turns, thread, order, text), F.col("held"), F.concat(F.lit("support:"), "decision"), [thread], order)
    body = F.coalesce("excerpt", F.lit(""))
    return d.withColumn("out", F.when(F.col("ref").isNull(), body).otherwise(F.concat(body, F.lit(" [held: "), "ref", F.lit("]"))))


def stats(squeezed: DataFrame, thread: str, text: str = "text") -> DataFrame:
    return A.run_stats(squeezed, [thread], ["keep_full", "keep_excerpt", "notice"], text)
