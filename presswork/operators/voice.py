"""Spoken dialogue: notice silence, backchannels, fillers, restatements and re-asked facts; keep commitments.

Whether a turn is a restatement depends on which earlier turns were kept, so a conversation is walked in order, in a
grouped map. All that doesn't depend on earlier turns is computed before, as columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.tables import written
from ..functions.text import WORD, lines, squash_lower
from . import admit as A

FULL_CHARS, HOLD_CHARS, LEAST = 160, 100, 30


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), F.lit(1))


def _all_in(ws: Column, book: list[str]) -> Column:
    return (F.size(ws) > 0) & (F.size(F.array_except(ws, F.array(*[F.lit(w) for w in book]))) == 0)


def is_backchannel(line: Column) -> Column:
    return _all_in(F.filter(words(line), lambda w: ~w.isin(P.BACKCHANNEL_SKIPPED)), P.BACKCHANNEL_WORDS)


def is_filler(line: Column) -> Column:
    return _all_in(words(line), P.FILLER_WORDS)


def local(turns: DataFrame, text: str = "text", role: str = "role", interrupted: str | None = None, spoken: str | None = None) -> DataFrame:
    """Adds what a turn tells by itself: ``early`` (a notice that needs no memory, or null), confirms, commits, fact_lines, norm."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = turns.withColumn("_l", lines(t))
    early = F.when(F.size("_l") == 0, "[silence/no audio]").when(F.forall("_l", is_backchannel), "[backchannel]").when(F.forall("_l", is_filler), "[filler]")
    d = d.withColumn("cut_in", F.coalesce(F.col(interrupted), F.lit(False)) if interrupted else F.lit(False))
    d = d.withColumn("spoken", F.coalesce(F.col(spoken), F.lit("")) if spoken else F.lit(""))
    return (
        d.withColumn("early", early).withColumn("confirms", (F.col(role) == "agent") & P.CONFIRM(t)).withColumn("commits", P.COMMIT(t))
        .withColumn("fact_lines", F.filter("_l", lambda x: P.VOICE_FACT(x))).withColumn("norm", squash_lower(t)).drop("_l")
    )


def _alike(new: set[str], old_words: list[str], old: set[str]) -> bool:
    both = len(new & old)
    if new and old and both / len(new | old) >= 0.45:
        return True
    content = [w for w in old_words if w not in _SKIP]
    return len(content) >= 5 and sum(w in new for w in content) / len(content) >= 0.75


_SKIP = frozenset(P.CONTENTLESS)


def step(kept: list[list[str]], r: object) -> tuple[list[list[str]], str, str]:
    """One turn against the words of the kept turns before it: what is kept then, decision, excerpt."""
    text, norm = r.text or "", r.norm
    if r.cut_in:
        said = r.spoken.strip()
        return (kept, "keep_excerpt", "[interrupted; spoke only] " + said) if said else (kept, "notice", "[interrupted; nothing spoken]")
    if isinstance(r.early, str):
        return kept, "notice", r.early
    ws = re.findall(r"\w+", norm)
    mine = set(ws)
    if len(norm) > LEAST and any(_alike(mine, k, set(k)) for k in kept):
        return kept, "notice", "[restated; same intent as earlier turn]"
    if r.confirms and kept:
        return kept, "notice", "[confirmation re-ask; fact established earlier]"
    if len(norm) > LEAST:
        kept = [*kept, ws]
    if not r.commits and len(r.fact_lines) and len(text) > FULL_CHARS:
        return kept, "keep_excerpt", "\n".join(r.fact_lines)
    return kept, "keep_full", text


def _walk(turns: pd.DataFrame) -> pd.DataFrame:
    kept: list[list[str]] = []
    turns = turns.sort_values("pos")
    out = []
    for r in turns.itertuples(index=False):
        kept, *said = step(kept, r)
        out.append(said)
    done = turns[["conv", "pos"]].copy()
    done["decision"] = [d for d, _ in out]
    done["excerpt"] = [e for _, e in out]
    return done


def judge(turns: DataFrame, conversation: str, order: str, text: str = "text", role: str = "role", **barge: str) -> DataFrame:
    """conv, pos, decision, excerpt. One conversation is one group; conversations are short and many."""
    d = local(turns, text, role, **barge).select(
        F.col(conversation).alias("conv"), F.col(order).alias("pos"), F.col(text).alias("text"), "early", "confirms", "commits", "fact_lines", "norm", "cut_in", "spoken"
    )
    kinds = dict(d.dtypes)
    return d.groupBy("conv").applyInPandas(_walk, f"conv {kinds['conv']}, pos {kinds['pos']}, decision string, excerpt string")


def squeeze(turns: DataFrame, conversation: str, order: str, text: str = "text", role: str = "role", folder: str | None = None, **barge: str) -> DataFrame:
    """Turns of conversations with decision, ref (numbered per conversation and decision, of all that isn't kept in full and is longer than 100
    characters) and out. With a shared ``folder`` the judged turns are written there, so conversations are walked once."""
    said = judge(turns, conversation, order, text, role, **barge).withColumnsRenamed({"conv": conversation, "pos": order})
    if folder:
        said = written(said, folder, "voice")
    d = turns.join(said, [conversation, order])
    d = A.with_refs(d, (F.col("decision") != "keep_full") & (F.length(text) > HOLD_CHARS), F.concat(F.lit("voice:"), "decision"), [conversation], order)
    return d.withColumn("out", F.when(F.col("ref").isNull(), F.col("excerpt")).otherwise(F.concat("excerpt", F.lit(" [held: "), "ref", F.lit("]"))))


def stats(squeezed: DataFrame, conversation: str, text: str = "text") -> DataFrame:
    return A.run_stats(squeezed, [conversation], ["keep_full", "keep_excerpt", "notice"], text)
