"""Readers: transcripts, logs, tool lists and needles from JSON files into tables with explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import filled, strip
from ..operators.context import flatten

ROLES = ["user", "assistant", "tool", "function", "system"]
CALL_CHARS = 500


def _text(v: Column) -> Column:
    """A variant as text: strings as they are, others as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """transcript (the file) and v (VARIANT) of JSON files, one document each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("transcript"), F.try_parse_json("value").alias("v"))


def openai(spark: SparkSession, path: str) -> DataFrame:
    """transcript, pos, role, name, content of files {"messages": [...]}, as ``openai_messages``."""
    return openai_messages(documents(spark, path))


def openai_messages(docs: DataFrame) -> DataFrame:
    """transcript, pos, role, name, content of documents (transcript, v). Function messages count as tool messages, which are called
    "tool" without a name; other roles are dropped; missing content is the text None."""
    return explode_openai(docs.select("transcript", F.try_variant_get("v", "$.messages", "array<variant>").alias("m")))


def explode_openai(docs: DataFrame) -> DataFrame:
    m = docs.select("transcript", F.posexplode("m").alias("pos", "m"))
    role = F.try_variant_get("m", "$.role", "string")
    tool = role.isin("tool", "function")
    content = F.coalesce(F.try_variant_get("m", "$.content", "string"), F.to_json(F.try_variant_get("m", "$.content", "variant")))
    content = F.when(content.isNull() | (content == "null"), "None").otherwise(content)
    return m.where(role.isin(ROLES)).select(
        "transcript", F.col("pos").cast("long").alias("pos"), F.when(tool, "tool").otherwise(role).alias("role"),
        F.when(tool, F.coalesce(F.nullif(F.try_variant_get("m", "$.name", "string"), F.lit("")), F.lit("tool"))).otherwise("").alias("name"), content.alias("content"),
    )


def fleet(spark: SparkSession, path: str) -> DataFrame:
    """agent_id, agent_ord, pos, role, name, content of files {"transcripts": {agent: {"messages": [...]} or [...]}}, as ``fleet_messages``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("transcript"), "value")
    return fleet_messages(raw)


def fleet_messages(raw: DataFrame) -> DataFrame:
    """agent_id, agent_ord, pos, role, name, content of documents (transcript, value: JSON text). Agents are in the order in which the document names them."""
    keys = F.json_object_keys(F.get_json_object("value", "$.transcripts"))
    agents = raw.select("transcript", F.try_parse_json("value").alias("v"), F.posexplode(keys).alias("agent_ord", "agent_id"))
    d = F.try_variant_get("v", "$.transcripts", "map<string, variant>")[F.col("agent_id")]
    listed = F.coalesce(F.try_variant_get(d, "$.messages", "array<variant>"), F.try_variant_get(d, "$", "array<variant>"))
    own = F.struct("transcript", "agent_id", "agent_ord")
    out = explode_openai(agents.select(own.alias("transcript"), listed.alias("m")))
    return out.select("transcript.agent_id", "transcript.agent_ord", "pos", "role", "name", "content")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and place in it; one file is one split, so places are in order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("block", "id")) - 1).select("file", "line", "value")


def claude_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """transcript, pos, role, name, content of session logs, one entry a line, as ``claude_entries``."""
    return claude_entries(_lines(spark, path))


def claude_entries(lines: DataFrame) -> DataFrame:
    """transcript, pos, role, name, content of lines (file, line, value). Lines that aren't JSON are skipped; listed content gives a row per
    block: calls as an assistant's note of up to 500 characters of input, results as tool messages, other blocks as text."""
    v = lines.select("file", "line", F.try_parse_json("value").alias("v")).where("v is not null")
    role = F.coalesce(F.try_variant_get("v", "$.message.role", "string"), F.try_variant_get("v", "$.type", "string"))
    blocks = F.try_variant_get("v", "$.message.content", "array<variant>")
    plain = F.when(F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant")) == "STRING", F.try_variant_get("v", "$.message.content", "string"))
    said = v.select("file", "line", F.lit(0).alias("n"), role.alias("role"), plain.alias("content")).where(filled("content")).withColumn("name", F.lit(""))
    b = v.select("file", "line", role.alias("r"), F.posexplode(blocks).alias("n", "b"))
    kind = F.try_variant_get("b", "$.type", "string")
    call = F.concat(F.lit("[tool call: "), F.coalesce(F.try_variant_get("b", "$.name", "string"), F.lit("")), F.lit(" "), F.substring(F.coalesce(F.to_json(F.try_variant_get("b", "$.input", "variant")), F.lit("{}")), 1, CALL_CHARS), F.lit("]"))
    parts = F.transform(F.try_variant_get("b", "$.content", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.to_json(x)))
    result = F.coalesce(F.array_join(parts, "\n"), F.try_variant_get("b", "$.content", "string"), F.lit(""))
    listed = b.select(
        "file", "line", "n", F.when(kind == "tool_use", "assistant").when(kind == "tool_result", "tool").otherwise(F.col("r")).alias("role"),
        F.when(kind == "tool_use", call).when(kind == "tool_result", result).otherwise(F.coalesce(F.try_variant_get("b", "$.text", "string"), F.lit(""))).alias("content"),
        F.when(kind == "tool_result", "tool").otherwise("").alias("name"),
    ).where(filled("content"))
    out = said.unionByName(listed).where(F.col("role").isin(ROLES))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("line", "n")).cast("long") - 1).select(F.col("file").alias("transcript"), "pos", "role", "name", "content")


def stream_json(spark: SparkSession, path: str) -> DataFrame:
    """Event streams, one event a line, as ``stream_events``."""
    return stream_events(_lines(spark, path))


CALLS = "array<struct<id: string, name: string, arguments: map<string, string>>>"


def stream_events(lines: DataFrame) -> DataFrame:
    """transcript, pos, role, name, content, tool_call_id, tool_calls of lines (file, line, value): assistant events as one message (texts joined, null
    without any, calls beside it), user events as a message per block, a tool message for a result; other events, and blocks without text, are skipped."""
    v = lines.select("file", "line", F.try_parse_json("value").alias("v")).where("v is not null")
    kind = F.try_variant_get("v", "$.type", "string")
    content = F.try_variant_get("v", "$.message.content", "variant")
    blocks = F.coalesce(F.try_variant_get("v", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    tag = lambda x: F.try_variant_get(x, "$.type", "string")
    said = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))
    texts = F.transform(F.filter(blocks, lambda x: (tag(x) == "text") & (said(x) != "")), said)
    calls = F.transform(F.filter(blocks, lambda x: tag(x) == "tool_use"), lambda x: F.struct(
        F.try_variant_get(x, "$.id", "string").alias("id"), F.try_variant_get(x, "$.name", "string").alias("name"),
        F.coalesce(F.try_variant_get(x, "$.input", "map<string, string>"), F.create_map().cast("map<string, string>")).alias("arguments")))
    none = F.lit(None).cast("string")
    told = v.where(kind == "assistant").select(
        "file", "line", F.lit(0).alias("n"), F.lit("assistant").alias("role"), F.lit("").alias("name"), F.when(F.size(texts) > 0, F.array_join(texts, "\n")).alias("content"),
        none.alias("tool_call_id"), F.when(F.size(calls) > 0, calls).cast(CALLS).alias("tool_calls"),
    )
    user = v.where(kind == "user").select("file", "line", F.when(F.schema_of_variant(content).startswith("ARRAY"), blocks).otherwise(F.array(content)).alias("_b"))
    b = user.select("file", "line", F.posexplode("_b").alias("n", "b"))
    result = tag(F.col("b")) == "tool_result"
    got = b.select(
        "file", "line", "n", F.when(result, "tool").otherwise("user").alias("role"), F.when(result, F.coalesce(F.try_variant_get("b", "$.name", "string"), F.lit(""))).otherwise("").alias("name"),
        F.when(result, flatten(F.try_variant_get("b", "$.content", "variant"))).otherwise(flatten(F.col("b"))).alias("content"),
        F.when(result, F.coalesce(F.try_variant_get("b", "$.tool_use_id", "string"), F.lit(""))).alias("tool_call_id"), F.lit(None).cast(CALLS).alias("tool_calls"),
    ).where((F.col("role") == "tool") | (F.col("content") != ""))
    out = told.unionByName(got)
    pos = F.row_number().over(Window.partitionBy("file").orderBy("line", "n")).cast("long") - 1
    return out.withColumn("pos", pos).select(F.col("file").alias("transcript"), "pos", "role", "name", "content", "tool_call_id", "tool_calls")


def any_transcript(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending, and for documents by what they hold: session logs, documents of messages, or of a fleet's transcripts (with agent_id and agent_ord)."""
    if path.endswith(".jsonl"):
        return claude_jsonl(spark, path)
    held = documents(spark, path).where(F.try_variant_get("v", "$.transcripts", "variant").isNotNull())
    return openai(spark, path) if held.isEmpty() else fleet(spark, path)


def request(body: DataFrame) -> DataFrame:
    """pos, role, name, content of request bodies (transcript, value): a list of messages or {"messages": [...]}."""
    v = body.select("transcript", F.try_parse_json("value").alias("v"))
    return explode_openai(v.select("transcript", F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")).alias("m")))


def rpc(lines: DataFrame) -> DataFrame:
    """line, id, method, params (VARIANT) and error of JSON-RPC requests, one a line (line, value): -32700 for what isn't JSON, -32600 for what isn't a request. Blank lines are skipped."""
    v = lines.where(filled("value")).select("line", F.try_parse_json("value").alias("v"))
    method = F.try_variant_get("v", "$.method", "string")
    return v.select("line", F.try_variant_get("v", "$.id", "string").alias("id"), method.alias("method"), F.try_variant_get("v", "$.params", "variant").alias("params"),
                    F.when(F.col("v").isNull(), -32700).when(method.isNull(), -32600).alias("error"))


def tool_log(spark: SparkSession, path: str) -> DataFrame:
    return tool_results(_lines(spark, path))


def tool_results(lines: DataFrame) -> DataFrame:
    """pos, name, text of a log of tool results (line, value); blank lines are skipped."""
    d = lines.where(filled("value")).select("line", F.from_json("value", "name string, text string").alias("r"))
    return d.select(F.col("line").cast("long").alias("pos"), F.coalesce(F.nullif(F.col("r.name"), F.lit("")), F.lit("tool")).alias("name"), F.coalesce("r.text", F.lit("")).alias("text"))


def tool_list(spark: SparkSession, path: str) -> DataFrame:
    return tool_definitions(spark.read.text(path, wholetext=True))


def tool_definitions(raw: DataFrame) -> DataFrame:
    """pos, name, description, input_schema (JSON text), properties of lists of definitions (value), bare or under "tools"."""
    v = raw.select(F.try_parse_json("value").alias("v"))
    t = v.select(F.posexplode(F.coalesce(F.try_variant_get("v", "$.tools", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("pos", "t"))
    get = lambda k: F.coalesce(F.try_variant_get("t", f"$.{k}", "string"), F.lit(""))
    schema = F.to_json(F.try_variant_get("t", "$.input_schema", "variant"))
    return t.select("pos", get("name").alias("name"), get("description").alias("description"), F.coalesce(schema, F.lit("{}")).alias("input_schema"),
                    F.coalesce(F.json_object_keys(F.get_json_object(schema, "$.properties")), F.array().cast("array<string>")).alias("properties"))


def needles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip("value").alias("needle")).where("needle <> ''")


ANNOTATION = "ts double, session_id string, decision string, ref string, cost_usd double, name string, in_chars bigint, head_hash string, tail_hash string"


def annotations(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """The annotation log in order; bad lines are skipped, a missing log is empty."""
    from pyspark.errors import AnalysisException

    try:
        lines = _lines(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], "log_pos bigint, " + ANNOTATION)
    d = annotation_records(lines)
    return d if session is None else d.where(F.col("session_id") == session)


def annotation_records(lines: DataFrame) -> DataFrame:
    """log_pos and the fields of records (line, value: JSON); bad ones are skipped."""
    return lines.select("line", F.from_json("value", ANNOTATION).alias("r")).where("r.decision is not null").select(F.col("line").cast("long").alias("log_pos"), "r.*")


def hook_text(response: Column) -> Column:
    """The text of a hook's tool response (JSON): a string, a number, the first filled of the usual fields, else all text values; lists joined."""
    v = F.try_parse_json(response)
    fields = [F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("output", "text", "result", "stdout", "content")]
    strings = F.array_join(F.map_values(F.try_variant_get(v, "$", "map<string, string>")), "\n")
    items = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), _text), "\n")
    return F.coalesce(*fields, F.nullif(strings, F.lit("")), items, F.try_variant_get(v, "$", "string"), response)


def cached(keys: DataFrame, cache: DataFrame, on: str = "key") -> DataFrame:
    """keys with the cached keep and p, null where the cache has none; the latest entry of a key counts."""
    last = cache.groupBy(on).agg(F.max_by(F.struct("keep", "p"), "ts").alias("_c"))
    return keys.join(last, on, "left").select(*keys.columns, F.col("_c.keep").alias("keep"), F.col("_c.p").alias("p"))


def cache_counts(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count("keep").alias("hits"), F.count_if(F.col("keep").isNull()).alias("misses"))
