"""Fetched pages: drop boilerplate and error pages, keep lines that carry data, quotes or task words."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.tables import written
from ..functions.text import lines, named, squash_lower
from . import admit as A

FULL_CHARS = 800


def keywords(task: str) -> list[str]:
    import re

    return sorted({w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_\-]{3,}", task or "")})


def hits(line: Column, words: Column) -> Column:
    return named(F.lower(line), lambda low: F.size(F.filter(words, lambda k: F.contains(low, k))))


def is_signal(line: Column, words: Column) -> Column:
    n = F.length(line)
    return ((n > 25) & line.rlike(r"\p{Nd}")) | P.QUOTED(line) | ((n < 160) & P.LINK(line)) | ((n > 20) & (hits(line, words) >= 2))


def judge(pages: DataFrame, task: str, cited: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds decision and ``kept`` (kept line numbers, from 0). Quotes that are cited keep their lines; a page that would lose all keeps the line with most task words.
    Lines, decision and kept numbers are named, so a page is cut into lines once, and not again for each line kept."""
    words = F.array(*[F.lit(w) for w in keywords(task)]).cast("array<string>")
    quotes = [F.lit(q) for q in (cited or []) if q]
    full = F.length(text) <= FULL_CHARS

    def stays(x: Column) -> Column:
        quoted = functools.reduce(operator.or_, [F.contains(x, q) for q in quotes], F.lit(False))
        return quoted | (is_signal(x, words) & ~P.BOILERPLATE(x) & ~P.NOISE(F.regexp_replace(x, P.REPLY.java, "")))

    def numbers(ls: Column) -> Column:
        picked = F.filter(F.transform(ls, lambda x, i: F.when(stays(x), i)), lambda i: i.isNotNull())
        # most hits, earliest line
        best = F.array_max(F.transform(ls, lambda x, i: F.struct(hits(x, words).alias("h"), (-i).alias("i"))))["i"]
        return named(picked, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(-best)))

    def told(ls: Column) -> Column:
        notice = (F.size(ls) == 0) | F.exists(F.slice(ls, 1, 5), lambda x: P.ERROR_PAGE(x)) | F.forall(ls, lambda x: P.BOILERPLATE(x))
        none = F.array().cast("array<int>")
        kept = lambda how: F.when(how == "notice", none).when(how == "keep_full", F.transform(ls, lambda x, i: i)).otherwise(numbers(ls))
        excerpt = lambda k: F.array_join(F.transform(k, lambda i: F.get(ls, i)), "\n")
        decided = F.when(notice, "notice").when(full, "keep_full").otherwise("keep_quotes")
        return named(decided, lambda how: named(kept(how), lambda k: F.struct(how.alias("decision"), k.alias("kept"), excerpt(k).alias("excerpt"))))

    d = pages.withColumn("_j", named(lines(F.coalesce(F.col(text), F.lit(""))), told))
    return d.select(*pages.columns, "_j.decision", "_j.kept", "_j.excerpt")


def duplicates(pages: DataFrame, key: str = "pos", url: str = "url", text: str = "text") -> DataFrame:
    """Adds ``dup_of``: the url of the first page with the same text but for case and white space. Pages without text are no duplicates."""
    h = F.when(squash_lower(text) != "", F.sha2(squash_lower(text), 256))
    keyed = pages.withColumn("_h", h)
    first = keyed.where("_h is not null").groupBy("_h").agg(F.min(F.struct(key, url)).alias("_f"))
    return keyed.join(first, "_h", "left").withColumn("dup_of", F.when(F.col(key) != F.col(f"_f.{key}"), F.col(f"_f.{url}"))).drop("_h", "_f")


def squeeze(pages: DataFrame, task: str, cited: list[str] | None = None, key: str = "pos", url: str = "url", text: str = "text", folder: str | None = None) -> DataFrame:
    """Pages of a corpus (key in their order, url, text) with dup_of, decision, lines_kept, lines_total, ref (numbered per url, of all that isn't kept in full) and out:
    the excerpt under a line that says what was left out. With a shared ``folder`` the judged pages are written there, so they are judged once, not again for the numbers."""
    pages = pages.withColumn(text, F.coalesce(text, F.lit("")))
    judged = judge(pages, task, cited, text).withColumn("lines_total", F.size(lines(text)).cast("long"))
    told = duplicates(written(judged, folder, "judged") if folder else judged, key, url, text)
    dup = F.col("dup_of").isNotNull()
    d = told.withColumn("decision", F.when(dup, "notice").otherwise(F.col("decision")))
    d = d.withColumn("lines_kept", F.when(dup, 0).otherwise(F.size("kept")).cast("long"))
    d = A.with_refs(d, F.col("decision") != "keep_full", F.col(url), [], key)
    n, m = F.col("lines_kept").cast("string"), F.col("lines_total").cast("string")
    out = (
        F.when(dup, F.concat(F.lit("[duplicate of "), "dup_of", F.lit("; full page held]"))).when(F.col("decision") == "keep_full", F.col(text))
        .when(F.col("decision") == "notice", F.concat(F.lit("[page dropped: "), m, F.lit(" lines, "), F.length(text).cast("string"), F.lit(" chars; full page held]")))
        .otherwise(F.concat(F.lit("[kept "), n, F.lit("/"), m, F.lit(" lines; full page held]\n"), "excerpt"))
    )
    return d.withColumn("out", out).drop("kept", "excerpt")


def stats(squeezed: DataFrame, text: str = "text") -> DataFrame:
    return A.run_stats(squeezed, [], ["keep_full", "keep_quotes", "notice"], text, more=[F.count("dup_of").alias("duplicates")]).drop("tokens_out")
