"""The gate for tool results: keep, trim, notice or hold, with held text recalled by reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.tables import written
from ..functions.text import all_lines, col, strip

FLOOR, HARD_ERROR, HEAD, TAIL = 2000, 8000, 8, 8
#: References to plain names, and to names of anything but the closing bracket. They look ahead, as one may begin inside another.
REF, ANY_REF = r"(?=(⟦held:[a-zA-Z0-9_.\-]+/[0-9]{4,}⟧))", r"(?=(⟦held:[^⟧]+/[0-9]{4,}⟧))"
PRIORS = {"keep_full": 1.0, "trim": 0.5, "notice": 0.0, "hold": 0.0}

Policy = Callable[[Column, Column], tuple[Column, Column]]


def is_error(name: Column, text: Column) -> Column:
    return F.contains(F.lower(name), F.lit("error")) | P.SIGNAL(F.substring(text, 1, 4000))


def judged(relevance: Column, sufficient: Column) -> Column:
    """The decision of a judge with two answers."""
    return F.when(relevance < 0.2, "hold").when(relevance < 0.5, "notice").when(sufficient >= 0.6, "trim").otherwise("keep_full")


def two_questions(relevance: Column, sufficient: Column) -> tuple[Column, Column]:
    """Policy of a judge that is asked how relevant a text is and whether an excerpt would do: decision and confidence. A missing answer keeps the text."""
    decision = F.when(relevance.isNull() | sufficient.isNull(), "keep_full").otherwise(judged(relevance, sufficient))
    return decision, F.coalesce(F.when(relevance < 0.5, 1 - relevance).otherwise(relevance), F.lit(0.0))


def decide(rows: DataFrame, name: str = "name", text: str = "text", policy: Policy | None = None) -> DataFrame:
    """Adds decision and confidence. Errors up to 8000 characters and anything up to 2000 are kept without asking; an
    unknown answer of the policy means trim. What is expensive to tell of a text is told once, as columns that the decisions read."""
    t = col(text)
    if policy is not None:
        d = rows.withColumn("_e", is_error(col(name), t))
        decision, confidence = policy(t, F.col("_e"))
        decision = F.when(decision.isin(*PRIORS), decision).otherwise("trim")
        sure = (F.col("_e") & (F.length(t) <= HARD_ERROR)) | (F.length(t) <= FLOOR)
        return d.withColumn("decision", F.when(sure, "keep_full").otherwise(decision)).withColumn("confidence", F.when(sure, 1.0).otherwise(confidence)).drop("_e")
    long = F.length(t) > FLOOR
    # of a short text nothing is asked; a signal in its head makes an error
    asked = F.when(long, F.when(is_error(col(name), t), "error").when(P.SIGNAL(t), "signal").when(_dull(t), "dull").otherwise("plain"))
    d = rows.withColumn("_told", asked)
    said = F.col("_told")
    decision = F.when(said.isNull() | (said == "error"), "keep_full").when(said == "dull", "notice").otherwise("trim")
    return d.withColumn("decision", decision).withColumn("confidence", F.when(said == "signal", 0.9).when(said == "dull", 0.85).when(said == "plain", 0.8).otherwise(1.0)).drop("_told")


def _dull(text: Column) -> Column:
    """Whether fewer than half of the filled lines are distinct."""
    ls = F.filter(F.transform(all_lines(text), strip), lambda x: x != "")
    return F.aggregate(F.array(ls), F.lit(False), lambda acc, x: 2 * F.size(F.array_distinct(x)) < F.greatest(F.size(x), F.lit(1)))


def reference(name: Column, n: Column) -> Column:
    return F.format_string("⟦held:%s/%04d⟧", name, n)


def hold_refs(held: DataFrame, name: str = "name", order: str = "pos", start: DataFrame | None = None, within: list[str] | None = None) -> DataFrame:
    """Numbers held rows per name (and ``within``) in order, on from ``start`` (name, seq). A name's rows are counted in ranges of order
    first, so a name that a third of the rows have isn't numbered in one task."""
    by = [*(within or []), name]
    keyed = held.withColumn("_part", F.floor(F.col(order) / 65536))
    before = keyed.groupBy(*by, "_part").count().select(
        *by, "_part", (F.sum("count").over(Window.partitionBy(*by).orderBy("_part")) - F.col("count")).alias("_before")
    )
    n = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order)) + F.col("_before")
    out = keyed.join(before, [*by, "_part"])
    if start is not None:
        out = out.join(start.select(name, F.col("seq").alias("_start")), name, "left")
        n = n + F.coalesce("_start", F.lit(0))
    return out.withColumn("seq", n.cast("long")).withColumn("ref", reference(F.col(name), F.col("seq"))).drop("_part", "_before", "_start")


def with_refs(rows: DataFrame, held: Column, name: Column, keys: list[str], order: str) -> DataFrame:
    """Adds ``ref`` where ``held``, numbered per keys and name in order; only keys, order and names are shuffled for it."""
    picked = rows.where(held).select(*keys, order, name.alias("_name"))
    refs = hold_refs(picked, "_name", order, within=keys).select(*keys, order, "ref")
    return rows.join(refs, [*keys, order], "left")


def held_texts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The hold store of rows with ``ref``: keys, ref and the whole text."""
    return rows.where("ref is not null").select(*keys, "ref", F.col(text).alias("text"))


def readmit(refs: DataFrame, holds: DataFrame, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Every row of ``refs`` with the text held under its ref, byte for byte, and ``known``. ``strict``: an unknown ref is an error."""
    on = [*(keys or []), "ref"]
    out = refs.join(holds.select(*on, F.col("text").alias("held_text")), on, "left").withColumn("known", F.col("held_text").isNotNull())
    if strict:
        lost = F.raise_error(F.concat(F.lit("unknown reference: "), "ref")).cast("string")
        out = out.withColumn("held_text", F.when(F.col("known"), F.col("held_text")).otherwise(lost))
    return out


def join_chars(text: Column) -> Column:
    """Estimated tokens of all texts of a group joined by blanks, of at least one."""
    return F.greatest(F.lit(1), F.floor((F.coalesce(F.sum(F.length(text)), F.lit(0)) + F.count("*") - 1) / 4)).cast("long")


def run_stats(run: DataFrame, keys: list[str], decisions: list[str], text: str = "text", out: str = "out", more: list[Column] | None = None) -> DataFrame:
    """Per run: rows, counts of each decision, held rows, characters and tokens in and out."""
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in decisions]
    sizes = [F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long").alias(n) for c, n in ((text, "chars_in"), (out, "chars_out"))]
    tokens_ = [join_chars(F.col(c)).alias(n) for c, n in ((text, "tokens_in"), (out, "tokens_out"))]
    aggs = [F.count("*").alias("n"), *counts, F.count("ref").alias("held"), *sizes, *tokens_, *(more or [])]
    return run.groupBy(*keys).agg(*aggs) if keys else run.agg(*aggs)


def trimmed(text: Column, ref: Column) -> Column:
    ls = all_lines(text)
    n = F.size(ls)
    tail = F.when(n > HEAD + TAIL, F.slice(ls, -TAIL, TAIL)).otherwise(F.array().cast("array<string>"))
    gone = n - F.least(n, F.lit(HEAD)) - F.size(tail)
    note = F.concat(F.lit("[... "), gone.cast("string"), F.lit(" lines held verbatim under "), ref, F.lit(" ...]"))
    return F.array_join(F.concat(F.slice(ls, 1, HEAD), F.array(note), tail), "\n")


def admit(rows: DataFrame, name: str = "name", text: str = "text", order: str = "pos", policy: Policy | None = None, folder: str | None = None) -> DataFrame:
    """decision, confidence, ref (of all that isn't kept in full), admitted text and held characters. Decisions are needed twice, for the numbers and
    for the texts; with a shared ``folder`` they are written there, so texts are searched once."""
    told = decide(rows, name, text, policy).select(name, order, "decision", "confidence")
    if folder:
        told = written(told, folder, "decided")
    held = hold_refs(told.where("decision <> 'keep_full'").select(name, order), name, order).select(name, order, "ref")
    out = rows.join(told.join(held, [name, order], "left"), [name, order])
    body = (
        F.when(F.col("decision") == "keep_full", F.col(text)).when(F.col("decision") == "trim", trimmed(F.col(text), F.col("ref")))
        .when(F.col("decision") == "notice", F.concat(F.lit("[boilerplate held: "), F.length(text).cast("string"), F.lit(" chars under "), "ref", F.lit("]")))
        .otherwise(F.col("ref"))
    )
    return out.withColumn("admitted", body).withColumn("held_chars", F.when(F.col("ref").isNull(), 0).otherwise(F.length(text) - F.length("admitted")).cast("long"))


def stats(admitted: DataFrame, text: str = "text") -> DataFrame:
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in PRIORS]
    return admitted.agg(*counts, F.sum(F.length(text)).alias("chars_in"), F.sum(F.length("admitted")).alias("chars_out"), F.sum("held_chars").alias("held_chars"))


def mentioned(text: Column, form: str = REF) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(form), F.lit(1)))


def readmit_mentioned(messages: DataFrame, key: str, text: str, holds: DataFrame, form: str = REF) -> DataFrame:
    """Held texts whose references a message names, each once per message."""
    return messages.select(key, F.explode(mentioned(col(text), form)).alias("ref")).join(holds.select("ref", F.col("text").alias("held_text")), "ref")


def fingerprint(name: Column, text: Column) -> list[Column]:
    return [name.alias("name"), F.length(text).cast("long").alias("in_chars"), F.substring(F.sha1(F.left(text, F.lit(200))), 1, 16).alias("head_hash"), F.substring(F.sha1(F.right(text, F.lit(200))), 1, 16).alias("tail_hash")]


def match_annotations(messages: DataFrame, log: DataFrame, key: str, name: str = "name", text: str = "text") -> DataFrame:
    """key, decision, strict and p: the first log record with the same name, length and hashes, else with the same name and length."""
    strict = log.groupBy("name", "in_chars", "head_hash", "tail_hash").agg(F.min(F.struct("log_pos", "decision")).alias("s"))
    loose = log.groupBy("name", "in_chars").agg(F.min(F.struct("log_pos", "decision")).alias("l"))
    asked = messages.select(F.col(key), *fingerprint(col(name), col(text)))
    out = asked.join(strict, ["name", "in_chars", "head_hash", "tail_hash"], "left").join(loose, ["name", "in_chars"], "left")
    decision = F.coalesce("s.decision", "l.decision")
    prior = F.create_map(*[F.lit(v) for kv in PRIORS.items() for v in kv])
    return out.select(key, decision.alias("decision"), F.col("s").isNotNull().alias("strict"), F.coalesce(prior[decision], F.lit(0.5)).alias("p"))
