"""Queries over the readers and sinks: the driver's tables written in the forms that these read, and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import q_filled, q_strip
from ..sources import readers, sinks
from .inputs import scratch, table, tool_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _text_files(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """The folder of a table of lines, written as text."""
    path = _place(spark, name)
    lines.select("value").write.text(path)
    return path


_ROLE = "case when turn % 5 = 1 then 'function' when turn % 7 = 5 then 'critic' when turn % 11 = 3 then 'tool' else role end"
_SAID = "case when turn % 6 = 4 then null else text end"


def _told(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.expr(_ROLE).alias("role"), F.expr("case when turn % 11 = 3 then 'b' end").alias("name"), F.expr(_SAID).alias("content"))


def _listed(told: DataFrame) -> DataFrame:
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "name", "content"))), lambda x: F.struct(x["role"].alias("role"), x["name"].alias("name"), x["content"].alias("content")))
    return told.groupBy("conv_id").agg(m.alias("messages"))


READ = f"""with m as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 pos, {_ROLE} r, case when turn % 11 = 3 then 'b' end nm, coalesce({_SAID}, 'None') c from conversations),
k as (select conv_id, pos, case when r in ('tool', 'function') then 'tool' else r end role, case when r in ('tool', 'function') then coalesce(nm, 'tool') else '' end as name, sha1(c) content_sha from m where r <> 'critic')"""


@query(READ + " select conv_id, pos, role, name, content_sha from k")
def read_openai(spark: SparkSession, sf: str) -> DataFrame:
    docs = _listed(_told(spark, sf)).select(F.col("conv_id").alias("transcript"), F.parse_json(F.to_json(F.struct("messages"))).alias("v"))
    return readers.openai_messages(docs).select(F.col("transcript").alias("conv_id"), "pos", "role", "name", F.sha1("content").alias("content_sha"))


@query(READ + ", o as (select conv_id, row_number() over (partition by conv_id // 10 order by conv_id desc) - 1 o from (select distinct conv_id from conversations)) select 'a' || k.conv_id agent_id, cast(o as int) agent_ord, pos, role, name, content_sha from k join o using (conv_id)")
def read_fleet(spark: SparkSession, sf: str) -> DataFrame:
    """Fleets of ten agents, named in falling order; every other agent's messages are a bare list."""
    d = _listed(_told(spark, sf)).select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.to_json("messages")).otherwise(F.to_json(F.struct("messages"))).alias("j"))
    part = F.concat(F.lit('"a'), F.col("conv_id").cast("string"), F.lit('": '), "j")
    each = d.groupBy(F.floor(F.col("conv_id") / 10).alias("transcript")).agg(F.array_sort(F.collect_list(F.struct((-F.col("conv_id")).alias("o"), part.alias("p")))).alias("p"))
    raw = each.select("transcript", F.concat(F.lit('{"transcripts": {'), F.array_join(F.transform("p", lambda x: x["p"]), ", "), F.lit("}}")).alias("value"))
    return readers.fleet_messages(raw).select("agent_id", "agent_ord", "pos", "role", "name", F.sha1("content").alias("content_sha"))


def _entry(role: str, content: F.Column) -> F.Column:
    return F.concat(F.lit(f'{{"type": "{role}", "message": {{"role": "{role}", "content": '), content, F.lit("}}"))


def _json(text: str) -> F.Column:
    """A text column as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _block(kind: str, **fields: F.Column) -> F.Column:
    return F.concat(F.lit(f'{{"type": "{kind}"'), *[x for k, v in fields.items() for x in (F.lit(f', "{k}": '), v)], F.lit("}"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """file, line, value: entries of a session log by turn: plain text, a text and a call, a result, and lines that aren't JSON."""
    c = table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    turn = F.col("turn").cast("string")
    call = _block("tool_use", id=turn, name=F.lit('"ls"'), input=F.concat(F.lit('{"a":"'), turn, F.lit('"}')))
    use = _entry("assistant", F.concat(F.lit("["), _block("text", text=_json("text")), F.lit(", "), call, F.lit("]")))
    result = _entry("user", F.concat(F.lit("["), _block("tool_result", tool_use_id=F.concat(F.lit('"'), turn, F.lit('"')), content=F.concat(F.lit("["), _block("text", text=_json("text")), F.lit(", "), _block("text", text=F.lit('"end"')), F.lit("]"))), F.lit("]")))
    value = F.when(F.col("turn") % 7 == 6, "{bad").when(F.col("turn") % 3 == 0, _entry("user", _json("text"))).when(F.col("turn") % 3 == 1, use).otherwise(result)
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), value.alias("value"))


LOG = f"""with c as (select conv_id, turn, coalesce(text, '') as text from conversations where turn % 7 <> 6),
e as (select conv_id, turn, 0 n, 'user' r, text c, '' nm from c where turn % 3 = 0 and {q_filled('text')}
  union all select conv_id, turn, 0, 'assistant', text, '' from c where turn % 3 = 1 and {q_filled('text')}
  union all select conv_id, turn, 1, 'assistant', '[tool call: ls {{"a":"' || turn || '"}}]', '' from c where turn % 3 = 1
  union all select conv_id, turn, 0, 'tool', text || chr(10) || 'end', 'tool' from c where turn % 3 = 2)
select conv_id, row_number() over (partition by conv_id order by turn, n) - 1 pos, r role, nm as name, sha1(c) content_sha from e"""


@query(LOG)
def read_claude_log(spark: SparkSession, sf: str) -> DataFrame:
    d = readers.claude_entries(_log(spark, sf))
    return d.select(F.col("transcript").alias("conv_id"), "pos", "role", "name", F.sha1("content").alias("content_sha"))


@query(
    """with c as (select conv_id, turn, coalesce(text, '') as text from conversations where turn % 7 <> 6),
e as (select conv_id, turn, 'user' role, text c, null tid, null calls from c where turn % 3 = 0 and text <> ''
  union all select conv_id, turn, 'assistant', case when text <> '' then text end, null, turn || ':ls:' || turn from c where turn % 3 = 1
  union all select conv_id, turn, 'tool', case when text <> '' then text || chr(10) else '' end || 'end', cast(turn as varchar), null from c where turn % 3 = 2)
select conv_id, row_number() over (partition by conv_id order by turn) - 1 pos, role, sha1(coalesce(c, '')) content_sha, tid tool_call_id, calls from e"""
)
def read_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    d = readers.stream_events(_log(spark, sf))
    calls = F.array_join(F.transform("tool_calls", lambda x: F.concat(x["id"], F.lit(":"), x["name"], F.lit(":"), x["arguments"]["a"])), ",")
    return d.select(F.col("transcript").alias("conv_id"), "pos", "role", F.sha1(F.coalesce("content", F.lit(""))).alias("content_sha"), "tool_call_id", calls.alias("calls"))


@query("select doc_id pos, case when doc_id % 4 = 0 then 'tool' else source end as name, sha1(case when doc_id % 6 = 0 then '' else coalesce(text, '') end) text_sha from documents where doc_id % 9 <> 0")
def read_tool_log(spark: SparkSession, sf: str) -> DataFrame:
    """Names and texts missing or empty now and then; every ninth line is blank."""
    d = table(spark, sf, "documents")
    row = F.to_json(F.struct(F.when(F.col("doc_id") % 8 == 0, "").when(F.col("doc_id") % 4 != 0, F.col("source")).alias("name"), F.when(F.col("doc_id") % 6 != 0, F.col("text")).alias("text")))
    lines = d.select(F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 9 == 0, " ").otherwise(row).alias("value"))
    return readers.tool_results(lines).select("pos", "name", F.sha1("text").alias("text_sha"))


_SCHEMA = """'{"type":"object","properties":{"' || p_brand || '":{"type":"string"},"size_mm":{"type":"integer"}}}'"""


def tool_list(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a list of tool definitions, one document for each brand."""
    p = table(spark, sf, "part")
    schema = F.parse_json(F.expr(_SCHEMA))
    d = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.to_json(schema).alias("s")))).alias("tools"))
    one = F.transform("tools", lambda x: F.concat(F.lit('{"name": '), F.to_json(F.array(x["name"])).substr(F.lit(2), F.length(F.to_json(F.array(x["name"]))) - 2), F.lit(', "description": "'), x["description"], F.lit('", "input_schema": '), x["s"], F.lit("}")))
    listed = F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))
    return d.select(F.when(F.length("p_brand") % 2 == 0, listed).otherwise(F.concat(F.lit('{"tools": '), listed, F.lit("}"))).alias("value"))


@query("select row_number() over (partition by p_brand order by p_partkey) - 1 pos, p_name as name, p_type description, list_sort([p_brand, 'size_mm'])[1] first_property from part")
def read_tool_list(spark: SparkSession, sf: str) -> DataFrame:
    d = readers.tool_definitions(tool_list(spark, sf))
    return d.select(F.col("pos").cast("long").alias("pos"), "name", "description", F.array_min("properties").alias("first_property"))


@query(f"with l as (select unnest(string_split(text, chr(10))) x from benchmark) select {q_strip('x')} needle from l where {q_filled('x')}")
def read_needles(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "benchmark").select(F.explode(F.array(F.concat(F.lit("  "), "text", F.lit("\t")), F.lit(" "))).alias("value"))
    return readers.needles(spark, _text_files(spark, lines, "needles"))


_MARKS = "select doc_id pos, source as name, length(coalesce(text, '')) n, case when length(coalesce(text, '')) > 2000 then 'trim' else 'keep_full' end decision, substr(sha1(left(coalesce(text, ''), 200)), 1, 16) head_hash from documents"


@query(f"select name, n in_chars, decision, head_hash, count(*) records from ({_MARKS}) group by all")
def annotation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Written as a log by one session, next to another's, and read again."""
    rows = tool_rows(spark, sf)
    decided = rows.withColumn("decision", F.when(F.length("text") > 2000, "trim").otherwise("keep_full")).withColumn("ref", F.lit("r"))
    path = _place(spark, "annotations")
    sinks.append_annotations(decided, path, "one")
    sinks.append_annotations(decided.where("pos % 2 = 0"), path, "two")
    return readers.annotations(spark, path, "one").groupBy("name", "in_chars", "decision", "head_hash").agg(F.count("*").alias("records"))


@query(f"select name, n in_chars, decision from ({_MARKS}) where pos % 3 <> 0")
def read_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON lines, every third of them cut short."""
    rows = tool_rows(spark, sf)
    said = F.to_json(F.struct(F.lit(1.5).alias("ts"), F.when(F.length("text") > 2000, "trim").otherwise("keep_full").alias("decision"), "name", F.length("text").alias("in_chars")))
    lines = rows.select(F.col("pos").alias("line"), F.when(F.col("pos") % 3 == 0, F.substring(said, 1, 9)).otherwise(said).alias("value"))
    return readers.annotation_records(lines).select("name", "in_chars", "decision")


@query("""with h as (select doc_id pos, source as name, text, case when doc_id % 2 = 0 then 0 else 1 end b from documents where length(text) > 2000)
select name, row_number() over (partition by name order by b, pos) seq, printf('⟦held:%s/%04d⟧', name, row_number() over (partition by name order by b, pos)) ref, sha1(text) held_sha from h""")
def hold_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches held one after the other, the second of them twice, as when a stream repeats it."""
    rows = tool_rows(spark, sf).where(F.length("text") > 2000)
    path = _place(spark, "holds")
    for batch, odd in ((0, 0), (1, 1), (1, 1)):
        sinks.append_holds(spark, rows.where(F.col("pos") % 2 == odd), path, batch)
    return sinks.load_holds(spark, path).select("name", "seq", "ref", F.sha1("text").alias("held_sha"))


_KEYS = "'k' || (event_id % 50)"


@query(f"""with k as (select user_id, 'k' || user_id key from events group by all), d as (select {_KEYS} key, arg_max(event_type = 'error', event_id) miss from events group by 1)
select count(d.key) hits, count(*) - count(d.key) misses, count(*) filter (not miss) kept from k left join d using (key)""")
def decision_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions written in two parts, the latest of a key counts, looked up by user."""
    e = table(spark, sf, "events")
    d = e.select(F.expr("concat('k', event_id % 50)").alias("key"), (F.col("event_type") != "error").cast("int").alias("keep"), F.lit(0.5).alias("p"), F.col("event_id").cast("double").alias("ts"))
    path = _place(spark, "decisions")
    for part in (0, 1):
        sinks.append_decisions(d.where(F.pmod("ts", F.lit(2.0)) == part), path)
    asked = e.select(F.expr("concat('k', user_id)").alias("key")).distinct()
    found = readers.cached(asked, spark.read.parquet(path))
    return readers.cache_counts(found).crossJoin(found.agg(F.count_if(F.col("keep") == 1).alias("kept")))


@query(f"select {_KEYS} key, cast(arg_max((event_type <> 'error')::int, event_id) as int) keep, cast(max(event_id) as double) ts from events group by 1")
def decision_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    path = _place(spark, "decisions")
    sinks.append_decisions(e.select(F.expr("concat('k', event_id % 50)").alias("key"), (F.col("event_type") != "error").cast("int").alias("keep"), F.lit(0.5).alias("p"), F.col("event_id").cast("double").alias("ts")), path)
    return sinks.latest(spark.read.parquet(path)).select("key", "keep", "ts")


@query("""select event_id, case event_id % 6 when 0 then 'plain' when 1 then 'first' when 2 then event_type || chr(10) || 'x' when 3 then 'a' || chr(10) || event_type when 4 then cast(event_id as varchar) else 'out' end as text from events""")
def hook_text(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.col("event_id") % 6
    event = F.concat(F.lit('"'), "event_type", F.lit('"'))
    said = (
        F.when(k == 0, '"plain"').when(k == 1, '{"output": "", "text": "first", "content": "later"}').when(k == 2, F.concat(F.lit('{"p": '), event, F.lit(', "q": "x"}')))
        .when(k == 3, F.concat(F.lit('["a", '), event, F.lit("]"))).when(k == 4, F.col("event_id").cast("string")).otherwise('{"stdout": "out"}')
    )
    return e.select("event_id", readers.hook_text(said).alias("text"))


@query("select event_id, 400 - 200 * (event_id % 2) status, case when event_id % 2 = 1 then '{\"event_id\":' || event_id || ',\"said\":\"' || event_type || '\"}' else '{\"error\":\"no ' || event_type || '\"}' end body from events")
def http_reply(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("said"))
    return sinks.reply(e, F.col("event_id") % 2 == 1, F.concat(F.lit("no "), "said")).select("event_id", F.col("status").cast("long").alias("status"), "body")


@query("select event_id, '{\"hookSpecificOutput\":{\"hookEventName\":\"PostToolUse\",\"additionalContext\":\"' || event_type || '\"}}' said from events")
def hook_reply(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", sinks.hook_reply(F.col("event_type")).alias("said"))


@query(READ + " select conv_id, pos, role, name, content_sha from k")
def read_request(spark: SparkSession, sf: str) -> DataFrame:
    d = _listed(_told(spark, sf)).select(F.col("conv_id").alias("transcript"), F.when(F.col("conv_id") % 2 == 0, F.to_json("messages")).otherwise(F.to_json(F.struct("messages"))).alias("value"))
    return readers.request(d).select(F.col("transcript").alias("conv_id"), "pos", "role", "name", F.sha1("content").alias("content_sha"))


@query("select event_id line, case when event_id % 5 = 1 then null else cast(event_id as varchar) end id, case when event_id % 5 > 1 then event_type end \"method\", case when event_id % 5 = 1 then -32700 when event_id % 5 = 2 then null end error, case when event_id % 5 > 1 then 'v' end p from events where event_id % 5 <> 0 and event_id % 5 <> 2 union all select event_id, cast(event_id as varchar), null, -32600, null from events where event_id % 5 = 2".replace("when event_id % 5 = 2 then null end error", "end error"))
def read_rpc(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k, i = F.col("event_id") % 5, F.col("event_id").cast("string")
    full = F.concat(F.lit('{"jsonrpc": "2.0", "id": '), i, F.lit(', "method": "'), "event_type", F.lit('", "params": {"a": "v"}}'))
    value = F.when(k == 0, "").when(k == 1, "{no").when(k == 2, F.concat(F.lit('{"id": '), i, F.lit("}"))).otherwise(full)
    d = readers.rpc(e.select(F.col("event_id").alias("line"), value.alias("value")))
    return d.select("line", "id", "method", "error", F.try_variant_get("params", "$.a", "string").alias("p"))


@query("select conv_id, count(*) messages, cast(sum(length(coalesce(text, ''))) as bigint) chars, cast(count(*) * 2 as bigint) stat from conversations group by 1")
def result_file(spark: SparkSession, sf: str) -> DataFrame:
    """A result written as JSON and read again."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("transcript"), F.col("turn").alias("pos"), "role", F.lit("").alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    path = _place(spark, "result")
    sinks.result(c, c.groupBy("transcript").agg((F.count("*") * 2).alias("twice")), path)
    schema = "transcript long, messages array<struct<pos: long, role: string, name: string, content: string>>, stats struct<twice: long>"
    d = spark.read.schema(schema).json(path)
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x["content"]))
    return d.select(F.col("transcript").alias("conv_id"), F.size("messages").cast("long").alias("messages"), chars.alias("chars"), F.col("stats.twice").alias("stat"))


@query("select '| ' || source || ' | ' || count(*) || ' | ' || cast(count(*) filter (doc_id % 2 = 0) as bigint) || ' | ' || cast(round(100.0::double * (count(*) - count(*) filter (doc_id % 2 = 0)) / count(*), 2) as double) || '% | 1/2 |' line from documents group by source")
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("tokens_before"), F.count_if(F.col("doc_id") % 2 == 0).alias("tokens_after"))
    return sinks.score_table(s.withColumn("recalled", F.lit(1)).withColumn("evidence", F.lit(2)), _place(spark, "scores"))


@query("select count(*) filter (p) passed, count(*) total, array_to_string(list(source || ':' || p order by source), ',') listed from (select source, count(*) % 2 = 0 p from documents group by 1)")
def bench_file(spark: SparkSession, sf: str) -> DataFrame:
    """A bench's outcomes as one JSON object, read again."""
    s = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg((F.count("*") % 2 == 0).alias("passed")).withColumn("seconds", F.lit(1.0)).withColumn("tail", F.lit(""))
    path = _place(spark, "bench")
    sinks.bench_results(s, path)
    d = spark.read.schema("passed long, total long, results array<struct<name: string, passed: boolean>>").json(path)
    listed = F.array_join(F.transform("results", lambda x: F.concat(x["name"], F.lit(":"), x["passed"].cast("string"))), ",")
    return d.select("passed", "total", listed.alias("listed"))
