"""Pipeline steps: keep failures whole, fold progress, repeated schemas and repeated line patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.tables import written
from ..functions.text import filled, lines, squash_lower
from . import admit as A

FULL_CHARS = 400


def signal_lines(ls: Column) -> Column:
    return F.filter(ls, lambda x: P.STEP_ERROR(x) | P.METRIC(x) | P.SCHEMA(x))


def raw_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: filled(x))


def schema_key(ls: Column) -> Column:
    found = F.filter(ls, lambda x: P.SCHEMA(x))
    return F.when(F.size(found) > 0, F.sha2(squash_lower(F.array_join(F.array_sort(found), "\n")), 256))


def line_pattern(line: Column) -> Column:
    return squash_lower(F.regexp_replace(line, r"\p{Nd}[\p{Nd},.]*", "#"))


def pattern_stats(ls: Column) -> Column:
    """Of a step's lines: distinct line patterns (``kinds``) and the count of the most frequent (``top``, null beyond three kinds, where it doesn't matter): one walk over the
    patterns, each made once, that stops counting at a fourth kind."""
    start = F.struct(F.array().cast("array<string>").alias("k"), F.array().cast("array<int>").alias("n"))

    def counted(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["k"], x)
        known = F.struct(acc["k"].alias("k"), F.transform(acc["n"], lambda n, i: F.when(i + 1 == at, n + 1).otherwise(n)).alias("n"))
        new = F.struct(F.array_append(acc["k"], x).alias("k"), F.array_append(acc["n"], F.lit(1)).alias("n"))
        return F.when(at > 0, known).otherwise(new)

    def add(acc: Column, line: Column) -> Column:
        # get(transform(array(x), ...), 0) names an intermediate value
        return F.when(F.size(acc["k"]) > 3, acc).otherwise(F.get(F.transform(F.array(line_pattern(line)), lambda x: counted(acc, x)), F.lit(0)))

    return F.aggregate(ls, start, add, lambda acc: F.struct(F.size(acc["k"]).alias("kinds"), F.when(F.size(acc["k"]) <= 3, F.array_max(acc["n"])).alias("top")))


def judge(steps: DataFrame, run: str, order: str, name: str = "name", text: str = "text", folder: str | None = None) -> DataFrame:
    """Adds decision and excerpt. A schema counts as seen if an earlier step of the run with that schema got as far: a minimum
    per (run, schema), joined back. Texts without a schema's words aren't looked at for it, errors and short texts not for patterns.
    With a shared ``folder`` what is told of each text by itself is written there, so it is told once."""
    t = F.col(text)

    def told(d: DataFrame) -> DataFrame:
        d = d.withColumn("_full", (F.length(text) <= FULL_CHARS) | P.STEP_ERROR(t)).withColumn("_raw", F.when(~F.col("_full"), raw_lines(t)))
        d = d.withColumn("_idle", F.coalesce((F.size("_raw") > 0) & F.forall("_raw", lambda x: P.PROGRESS(x) | P.BANNER(x)), F.lit(False)))
        # lines with whether they tell of a schema, each asked once
        d = d.withColumn("_l", F.when(~F.col("_full") & ~F.col("_idle"), F.transform(lines(t), lambda x: F.struct(x.alias("x"), P.SCHEMA(x).alias("s")))))
        found = F.transform(F.filter("_l", lambda x: x["s"]), lambda x: x["x"])
        return d.withColumn("_key", F.when(F.size(found) > 0, F.sha2(squash_lower(F.array_join(F.array_sort(found), "\n")), 256)))

    def asked(d: DataFrame) -> DataFrame:
        # of an open step no line tells of an error, as then its text would
        told_lines = F.transform(F.filter("_l", lambda x: x["s"] | P.METRIC(x["x"])), lambda x: x["x"])
        d = told(d).withColumn("_sig", F.coalesce(told_lines, F.array().cast("array<string>")))
        return d.withColumn("_pat", F.when(~F.col("_full") & ~F.col("_idle"), pattern_stats(F.col("_raw")))).withColumn("_lines", F.size("_raw")).drop("_raw", "_l")

    each = asked(steps)
    if folder:
        each = written(each, folder, "told")
        keyed = each.where("_key is not null").select(run, order, "_key")
    else:
        keyed = told(steps.where(P.SCHEMA.may(t)).select(run, order, text)).where("_key is not null")
    first = keyed.groupBy(run, "_key").agg(F.min(order).alias("_first"))
    d = each.join(first, [run, "_key"], "left")
    seen, bare = F.coalesce(F.col(order) > F.col("_first"), F.lit(False)), F.size("_sig") == 0
    folded = F.coalesce((F.col("_pat.top") >= 6) & (F.col("_pat.kinds") <= 3), F.lit(False))
    n = F.col(name)
    note = (
        F.when(F.col("_full"), None)
        .when(F.col("_idle"), F.concat(F.lit("["), n, F.lit(": "), F.col("_lines").cast("string"), F.lit(" progress/heartbeat lines]")))
        .when(seen, F.concat(F.lit("["), n, F.lit(": schema identical to earlier step]")))
        .when(~folded & bare, F.concat(F.lit("["), n, F.lit(": no metrics/schema/errors]")))
    )
    part = F.when(~bare, F.array_join("_sig", "\n")).otherwise(F.concat(F.lit("["), n, F.lit(": pattern x"), F.col("_pat.top").cast("string"), F.lit("]")))
    return (
        d.withColumn("_note", note)
        .withColumn("decision", F.when(F.col("_full"), "keep_full").when(F.col("_note").isNotNull(), "notice").otherwise("keep_excerpt"))
        .withColumn("excerpt", F.when(F.col("_full"), F.col(text)).when(F.col("_note").isNotNull(), F.col("_note")).otherwise(part))
        .select(*steps.columns, "decision", "excerpt")
    )


def squeeze(steps: DataFrame, run: str, order: str, name: str = "name", text: str = "text", folder: str | None = None) -> DataFrame:
    """Steps of runs with decision, ref (of all that isn't kept in full, numbered per run and name) and out, the text with its reference. With a shared
    ``folder`` texts are judged once, not again for the numbers."""
    d = A.with_refs(judge(steps, run, order, name, text, folder), F.col("decision") != "keep_full", F.col(name), [run], order)
    return d.withColumn("out", F.when(F.col("ref").isNull(), F.col("excerpt")).otherwise(F.concat("excerpt", F.lit("\n[held:"), "ref", F.lit("]"))))


def stats(squeezed: DataFrame, run: str, text: str = "text") -> DataFrame:
    d = A.run_stats(squeezed, [run], ["keep_full", "keep_excerpt", "notice"], text)
    size = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / 4)).cast("long")
    return d.withColumn("tokens_in", size("chars_in")).withColumn("tokens_out", size("chars_out"))
