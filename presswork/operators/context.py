"""Transcripts as turns and tool calls: parsing, pairing, stale results, outcome notes, decisions.

Two forms of transcript: messages whose content is text or a list of blocks (a VARIANT, parsed by ``api_blocks``), and messages
with a tool role and calls beside the text (``bench_turns``). Both give turns (transcript, turn_id, role, text) and pairs of a call and its result
(transcript, id, name, input, use_turn, result, is_error, has_result, result_turn, orphan, and k, the order in which they came up).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import filled, strip
from . import chunk as C

READS, WRITES = ["Read"], ["Edit", "NotebookEdit", "Write"]
PATH_KEYS, WHAT_KEYS = ["file_path", "path", "file", "notebook_path"], ["pattern", "query", "prompt", "description"]
KEEP, SUMMARISE, LEAST_TURN, RECENT = 0.5, 0.3, 800, 2
WINDOW, LEDGER = 6000, 12
NO_TASK = "complete the agent's task; preserve everything the final answer may depend on"


def infer_task(messages: DataFrame, transcript: str, most: int = 2000, fallback: str = NO_TASK) -> DataFrame:
    """The first filled user message per transcript, cut with an ellipsis; ``intent`` is the same without either."""
    users = messages.where((F.col("role") == "user") & filled("content")).groupBy(transcript).agg(F.min_by("content", "pos").alias("_c"))
    s = strip("_c")
    told = messages.select(transcript).distinct().join(users, transcript, "left")
    task = F.when(F.col("_c").isNull(), fallback).when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)
    return told.select(transcript, task.alias("task"), F.coalesce(F.substring(s, 1, most), F.lit("")).alias("intent"))


def merge_turns(messages: DataFrame, transcript: str) -> DataFrame:
    """Adds turn_id: user and assistant messages open turns and tool messages join the one before them; other roles are no turn (null) and end it,
    so a tool message after them is a turn by itself."""
    w = Window.partitionBy(transcript).orderBy("pos")
    prev = F.last(F.when(F.col("role") != "tool", F.col("role")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    talk = ["user", "assistant"]
    opens = F.col("role").isin(talk) | ((F.col("role") == "tool") & ~F.coalesce(prev, F.lit("")).isin(talk))
    n = F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return messages.withColumn("turn_id", F.when(F.col("role").isin([*talk, "tool"]), n))


def is_bench(messages: DataFrame, transcript: str) -> DataFrame:
    """Per transcript whether it is of the second form: whether any message has the tool role."""
    return messages.groupBy(transcript).agg(F.coalesce(F.bool_or(F.col("role") == "tool"), F.lit(False)).alias("bench"))


def _kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, BOOLEAN, VOID or a number's type; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def flatten(v: Column, depth: int = 4) -> Column:
    """A block's text: strings as they are, the text of text blocks, what ``content`` holds, lists joined by line feeds without empty parts. Objects in
    objects are followed ``depth`` deep; deeper ones are given as JSON."""
    kind, plain = _kind(v), F.try_variant_get(v, "$", "string")
    said = F.when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)
    if not depth:
        return F.when(v.isNull() | (kind == "VOID"), "").when(kind.isin("OBJECT", "ARRAY"), F.to_json(v)).otherwise(F.coalesce(said, F.lit("")))
    inner = F.when(F.try_variant_get(v, "$.type", "string") == "text", F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))).otherwise(
        flatten(F.try_variant_get(v, "$.content", "variant"), depth - 1)
    )
    listed = F.array_join(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: flatten(x, depth - 1)), lambda x: x != ""), "\n")
    return F.when(v.isNull() | (kind == "VOID"), "").when(kind == "OBJECT", inner).when(kind == "ARRAY", listed).otherwise(F.coalesce(said, F.lit("")))


def api_blocks(messages: DataFrame, transcript: str, content: str = "content") -> DataFrame:
    """transcript, turn_id, role, n and the block (kind, text, id, name, input, content, is_error) of messages (transcript, pos, role, content as
    VARIANT). Each message is a turn; roles but user and assistant count as user. Thinking is marked and left out; unknown blocks are text; empty ones drop."""
    w = Window.partitionBy(transcript).orderBy("pos")
    v = F.col(content)
    listed = F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(v.isNull() | (_kind(v) == "VOID"), F.array().cast("array<variant>")).otherwise(F.array(v))
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("user")
    turns = messages.select(transcript, (F.row_number().over(w) - 1).cast("long").alias("turn_id"), role.alias("role"), listed.alias("_b"))
    b = F.col("b")
    d = turns.select(transcript, "turn_id", "role", F.posexplode_outer("_b").alias("n", "b"))
    get = lambda k: F.coalesce(F.try_variant_get(b, f"$.{k}", "string"), F.lit(""))
    form, kind = _kind(b), F.try_variant_get(b, "$.type", "string")
    tag = (
        F.when(form == "STRING", "text").when(form != "OBJECT", None).when(kind.isin("text", "tool_use", "tool_result"), kind)
        .when(kind.isin("thinking", "redacted_thinking"), "thinking").otherwise("text")
    )
    told = d.select(
        transcript, "turn_id", "role", "n", tag.alias("kind"),
        F.when(tag == "text", F.when(form == "STRING", F.try_variant_get(b, "$", "string")).when(kind == "text", get("text")).otherwise(flatten(b))).alias("text"),
        F.when(tag == "tool_use", get("id")).when(tag == "tool_result", get("tool_use_id")).alias("id"), F.when(tag == "tool_use", get("name")).alias("name"),
        F.when(tag == "tool_use", F.coalesce(F.try_variant_get(b, "$.input", "map<string, string>"), F.create_map().cast("map<string, string>"))).alias("input"),
        F.when(tag == "tool_result", flatten(F.try_variant_get(b, "$.content", "variant"))).alias("content"),
        F.when(tag == "tool_result", F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False))).alias("is_error"),
    )
    return told.withColumn("kind", F.when((F.col("kind") == "text") & (F.col("text") == ""), None).otherwise(F.col("kind")))


def api_turns(blocks: DataFrame, transcript: str) -> DataFrame:
    """Turns of blocks: texts joined, white space at either end gone each time."""
    texts = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("n", "text"))))
    d = blocks.groupBy(transcript, "turn_id").agg(F.first("role").alias("role"), texts.alias("_t"))
    said = F.aggregate("_t", F.lit(""), lambda acc, x: strip(F.concat(acc, F.lit("\n"), x["text"])))
    return d.select(transcript, "turn_id", "role", said.alias("text"))


def api_pairs(blocks: DataFrame, transcript: str) -> DataFrame:
    """Pairs by id across the transcript: name and input of what came up first, the last call's turn, the last result. A result that comes up before any
    call of its id is an orphan without a name."""
    spot = F.struct("turn_id", "n")
    use, got = F.col("kind") == "tool_use", F.col("kind") == "tool_result"
    d = blocks.where(use | got).groupBy(transcript, "id").agg(
        F.min(spot).alias("_at"), F.min_by(F.struct("kind", "name", "input"), spot).alias("_f"), F.max(F.when(use, F.col("turn_id"))).alias("_u"),
        F.max_by(F.when(got, F.struct("content", "is_error", "turn_id")), F.when(got, spot)).alias("_r"),
    )
    orphan = F.col("_f.kind") == "tool_result"
    return d.select(
        transcript, "id", F.when(orphan, "").otherwise(F.col("_f.name")).alias("name"), F.when(~orphan, F.col("_f.input")).alias("input"),
        F.coalesce("_u", "_at.turn_id").alias("use_turn"), F.col("_r.content").alias("result"), F.coalesce("_r.is_error", F.lit(False)).alias("is_error"),
        F.col("_r").isNotNull().alias("has_result"), F.coalesce("_r.turn_id", "_u").alias("result_turn"), orphan.alias("orphan"),
        F.col("_at.turn_id").alias("turn_id"), F.row_number().over(Window.partitionBy(transcript, "_at.turn_id").orderBy("_at.n")).alias("k"),
    )


def bench_turns(messages: DataFrame, transcript: str) -> DataFrame:
    """Turns of messages with turn_id (``merge_turns``): the opener's role and stripped text; a tool message that opens one is an assistant's without text."""
    opener = F.min_by(F.struct("role", "content"), "pos")
    d = messages.where("turn_id is not null").groupBy(transcript, "turn_id").agg(opener.alias("_o"))
    alone = F.col("_o.role") == "tool"
    return d.select(transcript, "turn_id", F.when(alone, "assistant").otherwise(F.col("_o.role")).alias("role"), F.when(alone, "").otherwise(strip(F.coalesce("_o.content", F.lit("")))).alias("text"))


def bench_pairs(messages: DataFrame, transcript: str) -> DataFrame:
    """Pairs of messages (turn_id, pos, role, name, content, tool_call_id, tool_calls: array of (id, name, arguments)). A result belongs to the call with
    its id in its own turn, the last of equal ids; the last result counts. Others are orphans with the message's name, each a pair. Errors are told from the text."""
    keys = [transcript, "turn_id"]
    talk = messages.where("turn_id is not null")
    calls = talk.where("role <> 'tool'").select(*keys, F.posexplode("tool_calls").alias("k", "c")).select(
        *keys, F.col("k").cast("long").alias("k"), F.coalesce("c.id", F.lit("")).alias("id"), F.coalesce("c.name", F.lit("")).alias("name"), F.col("c.arguments").alias("input")
    )
    last = calls.groupBy(*keys, "id").agg(F.max("k").alias("k"))
    told = talk.where("role = 'tool'").select(*keys, "pos", F.coalesce("tool_call_id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("content", F.lit("")).alias("result"))
    met = told.join(last, [*keys, "id"], "left")
    best = met.where("k is not null").groupBy(*keys, "k").agg(F.max_by("result", "pos").alias("result"))
    used = calls.join(best, [*keys, "k"], "left").select(*keys, "k", "id", "name", "input", "result", F.lit(False).alias("orphan"))
    lone = met.where("k is null").select(
        *keys, (F.lit(1 << 32) + F.col("pos")).alias("k"), "id", "name", F.lit(None).cast("map<string, string>").alias("input"), "result", F.lit(True).alias("orphan")
    )
    both = used.unionByName(lone)
    has = F.col("result").isNotNull()
    return both.select(
        *keys, "k", "id", "name", "input", F.col("turn_id").alias("use_turn"), "result", F.coalesce(looks_like_error(F.col("result")), F.lit(False)).alias("is_error"),
        has.alias("has_result"), F.when(has, F.col("turn_id")).alias("result_turn"), "orphan",
    )


def pair_tools(uses: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with their results by id: the last result wins, a result without a call is an orphan with no name."""
    last = results.groupBy(*keys, "id").agg(F.max_by(F.struct("result", "is_error", F.col("turn").alias("result_turn")), "pos").alias("_r"))
    u = uses.select(*keys, "id", "name", "input", F.col("turn").alias("use_turn"), F.lit(True).alias("_used"))
    return u.join(last, [*keys, "id"], "full").select(
        *keys, "id", F.coalesce("name", F.lit("")).alias("name"), "input", "use_turn", F.col("_r.result").alias("result"), F.coalesce("_r.is_error", F.lit(False)).alias("is_error"),
        F.col("_r").isNotNull().alias("has_result"), F.coalesce("_r.result_turn", "use_turn").alias("result_turn"), F.col("_used").isNull().alias("orphan"),
    )


def looks_like_error(text: Column) -> Column:
    return P.TOOL_ERROR(F.substring(text, 1, 2000))


def file_path(inputs: Column) -> Column:
    return F.coalesce(*[F.nullif(inputs[k], F.lit("")) for k in PATH_KEYS], F.lit(""))


def target(name: Column, inputs: Column) -> Column:
    cut = lambda k: F.substring(F.nullif(inputs[k], F.lit("")), 1, 80)
    return F.coalesce(F.nullif(file_path(inputs), F.lit("")), cut("command"), *[cut(k) for k in WHAT_KEYS], name)


def stale(pairs: DataFrame, session: str) -> DataFrame:
    """Adds ``replacement``: reads of a path that was written at a later turn, or else read again. Both are a maximum per (session, path), joined back."""
    d = pairs.withColumn("_p", file_path(F.col("input")))
    read, write = F.col("name").isin(READS) & F.col("has_result"), F.col("name").isin(WRITES) & F.col("has_result")
    last = d.where((F.col("_p") != "") & (read | write)).groupBy(session, "_p").agg(
        F.max(F.when(write, F.col("result_turn"))).alias("_w"), F.max(F.when(read, F.col("result_turn"))).alias("_r")
    )
    out = d.join(last, [session, "_p"], "left")
    here = read & (F.col("_p") != "")
    note = F.when(here & (F.col("_w") > F.col("result_turn")), F.concat(F.lit("[read "), "_p", F.lit(": STALE — file edited afterwards; content outdated]"))).when(
        here & (F.col("_r") > F.col("result_turn")), F.concat(F.lit("[read "), "_p", F.lit(": SUPERSEDED — same file read again later]"))
    )
    return out.withColumn("replacement", note).drop("_p", "_w", "_r")


def later_success(pairs: DataFrame, session: str) -> DataFrame:
    """Adds resolved: a later turn has a call of the same tool on the same target that worked."""
    d = pairs.withColumn("_t", F.coalesce(F.nullif(file_path(F.col("input")), F.lit("")), target(F.col("name"), F.col("input"))))
    ok = d.where(F.col("has_result") & ~F.col("is_error")).groupBy(session, "name", "_t").agg(F.max("result_turn").alias("_ok"))
    return d.join(ok, [session, "name", "_t"], "left").withColumn("resolved", F.coalesce(F.col("_ok") > F.col("result_turn"), F.lit(False))).drop("_t", "_ok")


def outcome(name: Column, inputs: Column, result: Column, error: Column) -> Column:
    """One line in place of a dropped result."""
    tgt, n = target(name, inputs), F.when(F.coalesce(result, F.lit("")) == "", 0).otherwise(F.size(F.split(result, "\n")))
    cmd, count = F.substring(F.split(tgt, "\n")[0], 1, 60), n.cast("string")
    return (
        F.when(name.isin(READS), F.concat(F.lit("[read "), tgt, F.lit(": "), count, F.lit(" lines, no errors]")))
        .when(name == "Edit", F.concat(F.lit("[edited "), tgt, F.lit("]"))).when(name.isin(WRITES), F.concat(F.lit("[wrote "), tgt, F.lit("]")))
        .when((name == "Bash") & error, F.concat(F.lit("[ran `"), cmd, F.lit("`: failed]"))).when(name == "Bash", F.concat(F.lit("[ran `"), cmd, F.lit("`: ok, "), count, F.lit(" lines output]")))
        .when(name.isin("Grep", "Glob"), F.concat(F.lit("[searched "), tgt, F.lit(": "), count, F.lit(" lines]")))
        .when(error, F.concat(F.lit("["), name, F.lit(" "), tgt, F.lit(": errored]"))).otherwise(F.concat(F.lit("["), name, F.lit(" "), tgt, F.lit(": ok]")))
    )


def outlook(turns: DataFrame, transcript: str, ahead: int = 12, pairs: DataFrame | None = None) -> DataFrame:
    """Adds ``future``: one line for each of the next turns (turn_id, role, text), with what became of its pairs if they are given."""
    first = F.substring(F.split(strip("text"), "\n")[0], 1, 120)
    parts = F.when(first == "", F.array().cast("array<string>")).otherwise(F.array(first))
    d = turns
    if pairs is not None:
        head = F.concat("name", F.lit(" "), target(F.col("name"), F.col("input")))
        said = (
            F.when(F.col("replacement").isNotNull(), F.concat(F.lit("[tool "), head, F.lit(": "), F.substring("replacement", 1, 60), F.lit("]")))
            .when(F.col("has_result"), F.concat(F.lit("[tool "), head, F.lit(": "), F.length("result").cast("string"), F.lit(" chars"), F.when(F.col("is_error"), " ERROR").otherwise(""), F.lit("]")))
            .otherwise(F.concat(F.lit("[tool call "), head, F.lit("]")))
        )
        listed = pairs.groupBy(transcript, "turn_id").agg(F.array_sort(F.collect_list(F.struct("k", said.alias("line")))).alias("_l"))
        d = turns.join(listed, [transcript, "turn_id"], "left")
        parts = F.concat(parts, F.coalesce(F.transform("_l", lambda x: x["line"]), F.array().cast("array<string>")))
    core = F.when(F.size(parts) == 0, "(empty)").otherwise(F.array_join(parts, " | "))
    line = F.concat(F.lit("t"), F.col("turn_id").cast("string"), F.lit(" ["), "role", F.lit("]: "), F.substring(core, 1, 160))
    w = Window.partitionBy(transcript).orderBy("turn_id")
    return d.withColumn("_line", line).withColumn("future", F.collect_list("_line").over(w.rowsBetween(1, ahead))).select(*turns.columns, "future")


def pair_line(pairs: DataFrame) -> Column:
    """What a ledger says of a pair (with ``replacement``)."""
    head = F.concat(F.lit("[tool "), "name", F.lit(" "), target(F.col("name"), F.col("input")), F.lit("]: "))
    size = F.concat(F.lit(" ("), F.length("result").cast("string"), F.lit(" chars)"))
    return F.concat(head, F.when(F.col("replacement").isNotNull(), F.col("replacement")).when(~F.col("has_result"), "called, no result yet")
                    .when(F.col("is_error"), F.concat(F.lit("ERROR — kept verbatim"), size)).otherwise(F.concat(F.lit("kept"), size)))


def turn_line() -> Column:
    first = F.substring(F.split(strip("text"), "\n")[0], 1, 160)
    return F.concat(F.lit("t"), F.col("turn_id").cast("string"), F.lit(" ["), "role", F.lit("]: "), F.when(first == "", "(no text)").otherwise(first))


def ledger(turns: DataFrame, pairs: DataFrame, transcript: str, most: int = LEDGER) -> DataFrame:
    """transcript, turn_id, ledger: the last lines about what came before the turn, a line for each pair of an earlier turn that isn't a user's, in order, then its text's."""
    own = turns.select(transcript, "turn_id", F.lit(1 << 40).alias("k"), turn_line().alias("line"))
    calls = pairs.join(turns.where("role <> 'user'").select(transcript, "turn_id"), [transcript, "turn_id"]).select(transcript, "turn_id", "k", pair_line(pairs).alias("line"))
    lines = own.unionByName(calls)
    w = Window.partitionBy(transcript).orderBy("turn_id", "k")
    # all lines of a turn come after what came before its first one
    first = lines.withColumn("ledger", F.collect_list("line").over(w.rowsBetween(-most, -1)))
    return first.groupBy(transcript, "turn_id").agg(F.min_by("ledger", "k").alias("ledger"))


def turn_text(turns: DataFrame, pairs: DataFrame, transcript: str) -> DataFrame:
    """turns with ``judged_text``: the text and a line for each pair."""
    tgt = target(F.col("name"), F.col("input"))
    head = F.concat(F.lit("[tool "), "name", F.lit(" "), tgt)
    preview = F.substring(F.split(strip("result"), "\n")[0], 1, 200)
    line = (
        F.when(F.col("replacement").isNotNull(), F.concat(head, F.lit(": "), "replacement", F.lit("]")))
        .when(F.col("has_result"), F.concat(head, F.when(F.col("is_error"), " ERROR").otherwise(""), F.lit(": "), preview, F.lit("... ("), F.length("result").cast("string"), F.lit(" chars total)]")))
        .otherwise(F.concat(F.lit("[tool call "), "name", F.lit(" "), tgt, F.lit(": no result yet]")))
    )
    listed = pairs.groupBy(transcript, "turn_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("_l"))
    said = F.concat(F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.array("text")), F.coalesce(F.transform("_l", lambda x: x["line"]), F.array().cast("array<string>")))
    return turns.join(listed, [transcript, "turn_id"], "left").withColumn("judged_text", F.array_join(said, "\n")).drop("_l")


def turn_key(version: str) -> Column:
    """The cache key of a turn with ``judged_text``."""
    return F.sha2(F.concat(F.lit(version + "\n"), "role", F.lit("\n"), "judged_text"), 256)


def pair_key(version: str) -> Column:
    return F.sha2(F.concat(F.lit(version + "\npair\n"), "name", F.lit("\n"), target(F.col("name"), F.col("input")), F.lit("\n"), F.coalesce("result", F.lit(""))), 256)


def tool_units(pairs: DataFrame, transcript: str) -> DataFrame:
    """Each pair once with its place in the transcript: by turn, then as they came up."""
    return pairs.withColumn("unit", F.row_number().over(Window.partitionBy(transcript).orderBy("turn_id", "k")) - 1)


def windows(df: DataFrame, keys: list[str], text: str, size: int = WINDOW) -> DataFrame:
    """keys, window (from 0), body: the text in windows of packed lines; a text without a filled line has one empty window."""
    cut = F.transform(C.packed("_t", str(size)), lambda x: x["text"])
    d = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return d.select(*keys, F.posexplode(F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit("")))).alias("window", "body"))


def judge_pairs(pairs: DataFrame, transcript: str, judge: Callable[[Column], Column], kept: DataFrame | None = None, size: int = WINDOW) -> DataFrame:
    """Map-reduce judging of pairs (with ``replacement`` and ``resolved``): adds decision and sets replacement to the outcome note of what isn't kept. Pairs
    without a result and replaced ones aren't judged, unresolved errors are kept (``fail_safe``); of the others each window is scored by
    ``judge`` and the best counts; no answer keeps. ``kept`` (transcript, turn_id): turns of which nothing is judged."""
    keys = [transcript, "turn_id", "k"]
    d = pairs if kept is None else pairs.join(kept.select(transcript, "turn_id", F.lit(True).alias("_safe")), [transcript, "turn_id"], "left")
    safe = F.lit(False) if kept is None else F.coalesce("_safe", F.lit(False))
    asked = F.col("has_result") & F.col("replacement").isNull() & ~(F.col("is_error") & ~F.col("resolved")) & ~safe
    scored = windows(d.where(asked), keys, "result", size).withColumn("p", judge(F.col("body")))
    best = judge_units(scored, keys)
    out = d.join(best, keys, "left")
    decision = (
        F.when(safe, "protected").when(~F.col("has_result"), "open").when(F.col("replacement").isNotNull(), "replaced")
        .when(F.col("is_error") & ~F.col("resolved"), "fail_safe").when(F.col("p") >= KEEP, "keep").otherwise("note")
    )
    note = outcome(F.col("name"), F.col("input"), F.col("result"), F.col("is_error"))
    return out.withColumn("decision", decision).withColumn("replacement", F.when(F.col("decision") == "note", note).otherwise(F.col("replacement"))).drop("_safe")


def reassemble(messages: DataFrame, pairs: DataFrame, decided: DataFrame, transcript: str) -> DataFrame:
    """Messages of the second form with the decisions applied: a tool message says its turn's first pair of that id's replacement, if there is
    one; an assistant's text whose turn (``decided``: turn_id, decision) isn't kept goes, with its message if that has no calls. Messages that are no turn go."""
    first = pairs.groupBy(transcript, "turn_id", "id").agg(F.min_by("replacement", "k").alias("_new"))
    d = messages.where("turn_id is not null").withColumn("id", F.coalesce("tool_call_id", F.lit(""))).join(first, [transcript, "turn_id", "id"], "left")
    d = d.join(decided.select(transcript, "turn_id", F.col("decision").alias("_d")), [transcript, "turn_id"], "left")
    gone = (F.col("role") == "assistant") & (F.col("_d") != "keep")
    calls = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    content = F.when((F.col("role") == "tool") & F.col("_new").isNotNull(), F.col("_new")).when(gone, "").otherwise(F.col("content"))
    return d.where(F.coalesce(~gone | calls, F.lit(True))).withColumn("content", content).select(*messages.columns)


def judge_in_order(turns: DataFrame, pairs: DataFrame, transcript: str, judge: Callable[[str, list[str], list[str]], float | None], size: int = WINDOW) -> DataFrame:
    """The sequential judge: transcript, turn_id, k (null: the turn's text) and decision. ``judge`` (text, the last lines of the ledger so far, the lines of the
    next turns) answers for one window or text after another; what it says of one is in the ledger that it sees for the next, so a transcript
    is one group, walked in a worker. Where answers don't depend on the ledger the decisions are those of ``judge_pairs`` and ``decide_texts``."""
    cut = windows(pairs.where("has_result"), [transcript, "turn_id", "k"], "result", size).groupBy(transcript, "turn_id", "k").agg(F.array_sort(F.collect_list(F.struct("window", "body"))).alias("_w"))
    note = outcome(F.col("name"), F.col("input"), F.col("result"), F.col("is_error"))
    lined = pairs.withColumn("_note", note).withColumn("_head", F.concat(F.lit("[tool "), "name", F.lit(" "), target(F.col("name"), F.col("input")), F.lit("]: "))).withColumn("_size", F.length("result"))
    p = lined.join(cut, [transcript, "turn_id", "k"], "left").select(
        transcript, "turn_id", F.struct("k", "has_result", "replacement", "is_error", "resolved", "_note", "_head", "_size", F.transform("_w", lambda x: x["body"]).alias("windows")).alias("_p")
    )
    per = p.groupBy(transcript, "turn_id").agg(F.array_sort(F.collect_list("_p")).alias("_pairs"))
    rows = outlook(turns, transcript).join(per, [transcript, "turn_id"], "left").withColumn("_line", turn_line())
    rows = rows.select(F.col(transcript).alias("t"), "turn_id", "role", "text", "future", "_pairs", "_line")
    kind = dict(rows.dtypes)["t"]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        told: list[str] = []
        out: list[tuple] = []
        group = group.sort_values("turn_id")
        last = int(group["turn_id"].max())
        for r in group.itertuples(index=False):
            at = int(r.turn_id)
            pairs_ = [] if r[5] is None else list(r[5])
            ask = lambda text: judge(text, told[-LEDGER:], list(r.future))  # noqa: B023, E731
            if r.role == "user":
                out.append((at, None, "keep"))
                told.append(r[6])
                continue
            stuck = False
            for q in pairs_:
                line = q["replacement"]
                if not q["has_result"]:
                    decision, line = "open", "called, no result yet"
                elif line is not None:
                    decision = "replaced"
                elif q["is_error"] and not q["resolved"]:
                    decision = "fail_safe"
                else:
                    answers = [ask(w) for w in q["windows"]]
                    decision = "keep" if any(a is None or a >= KEEP for a in answers) else "note"
                if decision in ("keep", "fail_safe"):
                    line = f"ERROR — kept verbatim ({q['_size']} chars)" if q["is_error"] else f"kept ({q['_size']} chars)"
                    stuck = stuck or bool(q["is_error"])
                elif decision == "note":
                    line = q["_note"]
                out.append((at, int(q["k"]), decision))
                told.append(q["_head"] + line)
            decision = "keep"
            if at <= last - RECENT and len(r.text) >= LEAST_TURN:
                p = ask(r.text)
                p = 1.0 if p is None else KEEP if p < KEEP and stuck else p
                decision = "keep" if p >= KEEP else "summarise" if p >= SUMMARISE else "drop"
            out.append((at, None, decision))
            if decision != "summarise":
                told.append(f"t{at} [{r.role}]: text dropped" if decision == "drop" else r[6])
        done = pd.DataFrame(out, columns=["turn_id", "k", "decision"])
        done["k"] = done["k"].astype("Int64")
        done.insert(0, "t", group["t"].iloc[0])
        return done

    return rows.groupBy("t").applyInPandas(walk, f"t {kind}, turn_id long, k long, decision string").withColumnRenamed("t", transcript)


def judge_units(units: DataFrame, keys: list[str]) -> DataFrame:
    """Map-reduce judging: a unit's windows are scored apart (p), the unit has their maximum; no answer keeps it."""
    return units.groupBy(*keys).agg(F.max(F.coalesce("p", F.lit(1.0))).alias("p"))


def decide_texts(turns: DataFrame, transcript: str) -> DataFrame:
    """Adds judged and decision (keep, summarise, drop) for turns (turn_id, role, text, p, has_error): user turns, the last two and short ones
    aren't judged, and a turn with an unresolved error is never dropped."""
    last = F.max("turn_id").over(Window.partitionBy(transcript))
    judged = (F.col("role") != "user") & (F.col("turn_id") <= last - RECENT) & (F.length("text") >= LEAST_TURN)
    p = F.when(F.col("has_error") & (F.col("p") < SUMMARISE), KEEP).otherwise(F.col("p"))
    return turns.withColumn("judged", judged).withColumn("decision", F.when(~judged | (p >= KEEP), "keep").when(p >= SUMMARISE, "summarise").otherwise("drop"))


def guard_inflation(original: DataFrame, changed: DataFrame, transcript: str) -> DataFrame:
    """Messages of ``changed``, but the original ones of every transcript that grew."""
    a = original.groupBy(transcript).agg(F.sum(F.length("content")).alias("_a"))
    b = changed.groupBy(transcript).agg(F.sum(F.length("content")).alias("_b"))
    grew = a.join(b, transcript, "left").where(F.col("_b") > F.col("_a")).select(transcript)
    return changed.join(grew, transcript, "left_anti").unionByName(original.join(grew, transcript, "left_semi").select(*changed.columns))
