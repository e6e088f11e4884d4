"""Queries over the domain operators, each with the same rows in DuckDB's SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import WORD, filled, lines, q_filled, q_lines, q_squash, q_strip, squash_lower
from ..operators import context as X
from ..operators import evaluate as E
from ..operators import pipeline, research, support, tools, voice
from .inputs import TOOLS, messages, table, tool_calls, tool_messages, tool_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def q_all(ls: str, p: P.Pattern) -> str:
    return f"(len(list_filter({ls}, lambda y: not {p.sql('y')})) = 0)"


def q_any(ls: str, p: P.Pattern) -> str:
    return f"(len(list_filter({ls}, lambda y: {p.sql('y')})) > 0)"


# ---- pages
TASK = "Compare the heart rates that other studies found, with dates and sample sizes"
CITED = ["onthe", "de la"]
_WORDS = "[" + ", ".join(f"'{w}'" for w in research.keywords(TASK)) + "]"
_HITS = f"len(list_filter({_WORDS}, lambda k: contains(lower(y), k)))"
_CITED = "(" + " or ".join(f"contains(y, '{c}')" for c in CITED) + ")"
_SIGNAL = f"((regexp_matches(y, '\\p{{Nd}}') and length(y) > 25) or {P.QUOTED.sql('y')} or ({P.LINK.sql('y')} and length(y) < 160) or ({_HITS} >= 2 and length(y) > 20))"
_STAYS = f"({_CITED} or (not {P.BOILERPLATE.sql('y')} and not {P.NOISE.sql(f'regexp_replace(y, {chr(39)}{P.REPLY.re2}{chr(39)}, {chr(39)}{chr(39)})')} and {_SIGNAL}))"
RESEARCH = f"""with l as (select doc_id, text, {q_lines("coalesce(text, '')")} ls from documents),
d as (select *, len(ls) = 0 or {q_any('ls[:5]', P.ERROR_PAGE)} or {q_all('ls', P.BOILERPLATE)} n, length(text) <= 800 f from l),
ln as (select doc_id, unnest(range(1, len(ls) + 1)) i, unnest(ls) y from d where not n and not f),
st as (select doc_id, i, y, {_STAYS} s, {_HITS} h from ln),
k as (select doc_id, case when count(*) filter (s) > 0 then list(i order by i) filter (s) else [arg_max(i, h * 1000000 - i)] end k from st group by 1)
select d.doc_id, case when n then 'notice' when f then 'keep_full' else 'keep_quotes' end decision,
  case when n then 0 when f then len(ls) else len(k.k) end::bigint n_kept,
  sha1(case when n then '' when f then array_to_string(ls, chr(10)) else array_to_string(list_transform(k.k, lambda j: ls[j]), chr(10)) end) excerpt_sha
from d left join k using (doc_id)"""


@query(RESEARCH)
def research_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select("doc_id", "text")
    d = research.judge(pages, TASK, CITED)
    return d.select("doc_id", "decision", F.size("kept").cast("long").alias("n_kept"), F.sha1("excerpt").alias("excerpt_sha"))


@query(
    f"""with n as (select doc_id pos, source || '/' || doc_id url, lower({q_squash("coalesce(text, '')")}) nf from documents)
select pos, url, case when nf <> '' and row_number() over (partition by nf order by pos) > 1 then first_value(url) over (partition by nf order by pos) end dup_of from n"""
)
def research_dups(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.concat_ws("/", "source", "doc_id").alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    return research.duplicates(pages).select("pos", "url", "dup_of")


@query(
    f"""with t as (select page_id, unnest({q_lines("regexp_replace(html, '<[^>]*>', chr(10), 'g')")}) y from pages)
select page_id, count(*) n, count(*) filter ({_SIGNAL}) signal, count(*) filter ({P.BOILERPLATE.sql('y')}) boilerplate, count(*) filter ({P.NOISE.sql('y')}) noise from t group by 1"""
)
def page_line_signal(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in research.keywords(TASK)])
    ls = table(spark, sf, "pages").select("page_id", F.explode(lines(F.regexp_replace("html", "<[^>]*>", "\n"))).alias("y"))
    y = F.col("y")
    return ls.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if(research.is_signal(y, words)).alias("signal"), F.count_if(P.BOILERPLATE(y)).alias("boilerplate"), F.count_if(P.NOISE(y)).alias("noise")
    )


# ---- support threads
SUPPORT = f"""with a as (select conv_id, turn, text, {q_lines("coalesce(text, '')")} ls, lower({q_squash("coalesce(text, '')")}) nf from conversations),
b as (select *, case when len(ls) = 0 then '[empty turn]' when {q_all('ls', P.PLEASANTRY)} then '[pleasantries]' when {q_all('ls', P.APOLOGY)} then '[template apology]' end early,
  {q_any('ls', P.REVERIFY)} again, list_filter(ls, lambda y: {P.FACT.sql('y')}) facts from a),
c as (select *, case when early is null and length(nf) > 40 then nf end h from b),
d as (select *, h is not null and row_number() over (partition by conv_id, h order by turn) > 1 dup from c),
e as (select *, coalesce(max((early is null and not dup and not again and len(facts) > 0)::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) = 1 known from d),
f as (select *, case when early is not null then early when dup then '[duplicate of earlier turn]' when again and known then '[re-verification; facts established earlier]'
  when not again and length(text) > 600 and len(facts) = 0 then '[no facts]' end note from e)
select conv_id, turn, case when note is not null then 'notice' when not again and length(text) > 200 and len(facts) > 0 then 'keep_excerpt' else 'keep_full' end decision,
  sha1(case when note is not null then note when not again and length(text) > 200 and len(facts) > 0 then array_to_string(facts, chr(10)) else text end) excerpt_sha from f"""


@query(SUPPORT)
def support_thread(spark: SparkSession, sf: str) -> DataFrame:
    d = support.judge(table(spark, sf, "conversations"), "conv_id", "turn")
    return d.select("conv_id", "turn", "decision", F.sha1("excerpt").alias("excerpt_sha"))


# ---- pipeline runs
_RAW = f"list_filter(string_split(text, chr(10)), lambda y: {q_filled('y')})"
_PAT = "list_transform(raw, lambda y: lower(" + q_squash("regexp_replace(y, '\\p{Nd}[\\p{Nd},.]*', '#', 'g')") + "))"
STEPS = f"""with {"a as (select source run, doc_id pos, source nm, coalesce(text, '') as text from documents)"},
b as (select *, {q_lines('text')} ls, {_RAW} raw from a),
c as (select *, length(text) <= 400 or {P.STEP_ERROR.sql('text')} fl, len(raw) > 0 and len(list_filter(raw, lambda y: not ({P.PROGRESS.sql('y')} or {P.BANNER.sql('y')}))) = 0 idle,
  list_filter(ls, lambda y: {P.SCHEMA.sql('y')}) sc, list_filter(ls, lambda y: {P.STEP_ERROR.sql('y')} or {P.METRIC.sql('y')} or {P.SCHEMA.sql('y')}) sig, {_PAT} pt from b),
d as (select *, case when not fl and not idle and len(sc) > 0 then lower({q_squash("array_to_string(list_sort(sc), chr(10))")}) end k,
  len(list_distinct(pt)) kinds, list_max(map_values(list_histogram(pt))) top from c),
e as (select *, k is not null and row_number() over (partition by run, k order by pos) > 1 seen from d),
f as (select *, case when fl then null when idle then '[' || nm || ': ' || len(raw) || ' progress/heartbeat lines]' when seen then '[' || nm || ': schema identical to earlier step]'
  when not coalesce(top >= 6 and kinds <= 3, false) and len(sig) = 0 then '[' || nm || ': no metrics/schema/errors]' end note from e)
select run, pos, case when fl then 'keep_full' when note is not null then 'notice' else 'keep_excerpt' end decision,
  sha1(case when fl then text when note is not null then note when len(sig) > 0 then array_to_string(sig, chr(10)) else '[' || nm || ': pattern x' || top || ']' end) excerpt_sha from f""".replace("list_histogram(pt)", "list_aggregate(pt, 'histogram')")


@query(STEPS)
def pipeline_steps(spark: SparkSession, sf: str) -> DataFrame:
    d = pipeline.judge(tool_rows(spark, sf).withColumnRenamed("agent", "run"), "run", "pos")
    return d.select("run", "pos", "decision", F.sha1("excerpt").alias("excerpt_sha"))


_DDL = "coalesce(text, '') || case when doc_id % 3 = 0 then chr(10) || 'create table t' || cast(doc_id % 4 as varchar(9)) || chr(10) || case when doc_id % 2 = 0 then 'a bigint' || chr(10) || 'b varchar' else 'b varchar' || chr(10) || 'a bigint' end else '' end"


@query(
    f"""with a as (select doc_id, source, {q_lines(_DDL)} ls from documents), b as (select *, list_filter(ls, lambda y: {P.SCHEMA.sql('y')}) sc from a),
k as (select doc_id, source, len(sc) n_schema, lower({q_squash("array_to_string(list_sort(sc), chr(10))")}) k from b where len(sc) > 0)
select doc_id, n_schema, row_number() over (partition by source, k order by doc_id) > 1 seen from k"""
)
def schema_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a table's definition after every third text, in one of four forms and either order of its columns."""
    said = F.expr(_DDL.replace("varchar(9)", "string"))
    ls = lines(said)
    d = table(spark, sf, "documents").select("doc_id", "source", pipeline.schema_key(ls).alias("k"), F.size(F.filter(ls, lambda x: P.SCHEMA(x))).cast("long").alias("n_schema")).where("k is not null")
    first = d.groupBy("source", "k").agg(F.min("doc_id").alias("f"))
    return d.join(first, ["source", "k"]).select("doc_id", "n_schema", (F.col("doc_id") > F.col("f")).alias("seen"))


@query(
    f"""with a as (select doc_id, unnest({_RAW}) y from documents), b as (select doc_id, lower({q_squash("regexp_replace(y, '\\p{Nd}[\\p{Nd},.]*', '#', 'g')")}) k from a),
c as (select doc_id, k, count(*) n from b group by 1, 2) select doc_id, count(*) kinds, cast(max(n) as bigint) top from c group by 1"""
)
def log_patterns(spark: SparkSession, sf: str) -> DataFrame:
    ls = table(spark, sf, "documents").select("doc_id", F.explode(pipeline.raw_lines(F.col("text"))).alias("y"))
    counts = ls.groupBy("doc_id", pipeline.line_pattern(F.col("y")).alias("k")).count()
    return counts.groupBy("doc_id").agg(F.count("*").alias("kinds"), F.max("count").alias("top"))


# ---- dialogue
def _q_words(y: str) -> str:
    return f"regexp_extract_all(lower({y}), '{WORD}+')"


def _q_book(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_BACK = f"list_filter({_q_words('y')}, lambda w: not list_contains({_q_book(P.BACKCHANNEL_SKIPPED)}, w))"
VOICE = f"""with a as (select conv_id, turn, role, coalesce(text, '') as text, {q_lines("coalesce(text, '')")} ls from conversations)
select conv_id, turn, case when len(ls) = 0 then '[silence/no audio]'
  when len(list_filter(ls, lambda y: not (len({_BACK}) > 0 and len(list_filter({_BACK}, lambda w: not list_contains({_q_book(P.BACKCHANNEL_WORDS)}, w))) = 0))) = 0 then '[backchannel]'
  when len(list_filter(ls, lambda y: not (len({_q_words('y')}) > 0 and len(list_filter({_q_words('y')}, lambda w: not list_contains({_q_book(P.FILLER_WORDS)}, w))) = 0))) = 0 then '[filler]' end early,
  role = 'assistant' and {P.CONFIRM.sql('text')} confirms, {P.COMMIT.sql('text')} commits, len(list_filter(ls, lambda y: {P.VOICE_FACT.sql('y')})) n_facts from a"""


def _voice_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")))


@query(VOICE)
def voice_local(spark: SparkSession, sf: str) -> DataFrame:
    return voice.local(_voice_turns(spark, sf)).select("conv_id", "turn", "early", "confirms", "commits", F.size("fact_lines").cast("long").alias("n_facts"))


@query()
def voice_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """A decision feeds later ones, so there is no SQL; tests hold it against the sequential rule."""
    d = voice.judge(_voice_turns(spark, sf), "conv_id", "turn")
    return d.select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), "decision", F.sha1("excerpt").alias("excerpt_sha"))


# ---- transcripts as turns and tool calls
@query(
    f"""with u as (select conv_id, arg_min(text, turn) c from conversations where role = 'user' and {q_filled("coalesce(text, '')")} group by 1),
t as (select distinct conv_id from conversations) select t.conv_id t, case when c is null then 'complete the agent''s task; preserve everything the final answer may depend on' when length({q_strip('c')}) > 300 then left({q_strip('c')}, 300) || '...' else {q_strip('c')} end task,
  coalesce(left({q_strip('c')}, 300), '') intent from t left join u using (conv_id)"""
)
def infer_task(spark: SparkSession, sf: str) -> DataFrame:
    return X.infer_task(messages(spark, sf), "t", 300)


_ROLE = "case when turn % 3 = 1 then 'tool' when turn % 7 = 5 then 'system' else role end"


@query(
    f"""with m as (select conv_id t, turn pos, {_ROLE} role from conversations),
p as (select *, last_value(case when role <> 'tool' then role end ignore nulls) over (partition by t order by pos rows between unbounded preceding and 1 preceding) prev from m)
select t, pos, role, case when role in ('user', 'assistant', 'tool') then cast(sum((role in ('user', 'assistant') or (role = 'tool' and coalesce(prev, '') not in ('user', 'assistant')))::int) over (partition by t order by pos rows unbounded preceding) - 1 as bigint) end turn_id from p"""
)
def turn_merge(spark: SparkSession, sf: str) -> DataFrame:
    """With some messages recast as tool and system messages, as the table has none."""
    m = messages(spark, sf).withColumn("role", F.expr(_ROLE.replace("turn", "pos")))
    return X.merge_turns(m, "t").select("t", "pos", "role", "turn_id")


_NAME = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in TOOLS.items()) + " else event_type end"
CALLS = f"""with e as (select *, row_number() over (partition by user_id order by ts, event_id) turn, {_NAME} name, json_extract_string(props, '$.k') k from events),
c as (select user_id session, cast(event_id as varchar) id, name, k, case when name in ('Read', 'Edit') then k else '' end path, k target, turn use_turn, turn + 1 result_turn, event_type = 'error' is_error from e)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return X.pair_tools(*tool_calls(spark, sf), ["session"])


@query(CALLS + " select session, id, name, target, use_turn, result_turn, is_error, false orphan from c")
def tool_pairing(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("session", "id", "name", X.target(F.col("name"), F.col("input")).alias("target"), "use_turn", "result_turn", "is_error", "orphan")


@query(
    CALLS
    + """, m as (select *, max(result_turn) filter (name = 'Edit') over (partition by session, path) lw, max(result_turn) filter (name = 'Read') over (partition by session, path) lr from c)
select session, id, case when lw > result_turn then '[read ' || path || ': STALE — file edited afterwards; content outdated]' when lr > result_turn then '[read ' || path || ': SUPERSEDED — same file read again later]' end replacement
from m where name = 'Read' and path <> ''"""
)
def stale_reads(spark: SparkSession, sf: str) -> DataFrame:
    return X.stale(_pairs(spark, sf), "session").where("name = 'Read'").select("session", "id", "replacement")


@query(
    CALLS
    + """, m as (select *, max(result_turn) filter (not is_error) over (partition by session, name, target) ok from c) select session, id, coalesce(ok > result_turn, false) resolved from m where is_error or name = 'Read'"""
)
def later_success(spark: SparkSession, sf: str) -> DataFrame:
    return X.later_success(_pairs(spark, sf), "session").where("is_error or name = 'Read'").select("session", "id", "resolved")


@query(
    CALLS
    + """ select session, id, case when name = 'Read' then '[read ' || target || ': 2 lines, no errors]' when name = 'Edit' then '[edited ' || target || ']'
  when name = 'Bash' then '[ran `' || target || '`: failed]' when name = 'Grep' then '[searched ' || target || ': 2 lines]' else '[' || name || ' ' || target || ': ok]' end note from c"""
)
def outcome_notes(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf)
    return p.select("session", "id", X.outcome(F.col("name"), F.col("input"), F.col("result"), F.col("is_error")).alias("note"))


_FIRST = "left(string_split(" + q_strip("text") + ", chr(10))[1], 120)"


@query(
    f"""with l as (select conv_id t, turn, 't' || turn || ' [' || role || ']: ' || left(case when {_FIRST} = '' then '(empty)' else {_FIRST} end, 160) line from conversations)
select t, turn turn_id, coalesce(sha1(string_agg(line, '|' order by turn) over (partition by t order by turn rows between 1 following and 12 following)), sha1('')) future_sha from l"""
)
def outlook(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("t"), F.col("turn").alias("turn_id"), "role", "text")
    return X.outlook(turns, "t").select("t", "turn_id", F.sha1(F.array_join("future", "|")).alias("future_sha"))


_P = "((length(text) % 10)::double / 10)"


@query(
    f"""with j as (select *, role <> 'user' and turn <= max(turn) over (partition by conv_id) - 2 and length(text) >= 800 judged, regexp_matches(text, 'rr') err from conversations),
p as (select *, case when err and {_P} < 0.3 then 0.5 else {_P} end p from j)
select conv_id t, turn turn_id, judged, case when not judged or p >= 0.5 then 'keep' when p >= 0.3 then 'summarise' else 'drop' end decision from p"""
)
def text_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Judge scores stand in: the last digit of the text's length; texts with "rr" count as holding an error."""
    units = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("t"), F.col("turn").alias("turn_id"), "role", "text", F.col("text").rlike("rr").alias("has_error"), ((F.length("text") % 10).cast("double") / 10).alias("p")
    )
    best = X.judge_units(units.select("t", "turn_id", "p"), ["t", "turn_id"])
    return X.decide_texts(units.drop("p").join(best, ["t", "turn_id"]), "t").select("t", "turn_id", "judged", "decision")


@query(
    """with c as (select conv_id t, turn pos, text, case when length(text) < 100 then text || repeat('x', 200) else left(text, 50) end n from conversations),
g as (select t, sum(length(n)) > sum(length(text)) grew from c group by 1) select t, pos, sha1(case when grew then text else n end) content_sha from c join g using (t)"""
)
def inflation_guard(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    changed = m.withColumn("content", F.when(F.length("content") < 100, F.concat("content", F.lit("x" * 200))).otherwise(F.substring("content", 1, 50)))
    return X.guard_inflation(m, changed, "t").select("t", "pos", F.sha1("content").alias("content_sha"))


@query(f"select doc_id, {P.TOOL_ERROR.sql('substr(text, 1, 2000)')} is_error from documents")
def error_detection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.looks_like_error(F.col("text")).alias("is_error"))


# ---- tool definitions
TOOL_TASK = "Find a small red bolt or a blue ring for the PR, from the standard series"
_VOCAB = tools.vocabulary(TOOL_TASK)
_STRUCTS = "[" + ", ".join(f"{{'w': '{w}', 's': {str(s).lower()}}}" for w, s in _VOCAB.items()) + "]"
JUDGED = f"""with h as (select p_partkey, p_name, p_type, list_filter({_STRUCTS}, lambda k: regexp_matches(lower(replace(p_name, '_', ' ') || ' ' || p_type), '\\b' || k.w || '\\b')) h from part),
s as (select *, p_name in ('hot gear') or len(h) >= 2 or len(list_filter(h, lambda k: k.s)) > 0 sel, case when p_name in ('hot gear') then 1.0 else least(1.0, len(h) / 4.0) end::double score from h),
j as (select *, case when sel or not bool_or(sel) over () then 'keep' else 'prune' end decision from s)"""


@query(
    "select * from (values " + ", ".join(f"('{w}', {str(s).lower()})" for w, s in _VOCAB.items()) + ") t(word, strong)"
)
def tool_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(tools.vocabulary(TOOL_TASK).items()), "word string, strong boolean")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    defs = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return tools.judge(defs, TOOL_TASK, ["hot gear"])


@query(JUDGED + " select p_partkey, array_to_string(list_transform(h, lambda k: k.w), ',') hits, score, decision from j")
def tool_prune(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("p_partkey", F.array_join("hits", ",").alias("hits"), "score", "decision")


_COST = "greatest(1, (length(p_name) + 1 + length(p_type)) // 4)"


@query(
    JUDGED
    + f" select count(*) tools_before, count(*) filter (decision = 'keep') tools_after, cast(sum({_COST}) as bigint) tokens_before, cast(sum(case when decision = 'keep' then {_COST} else 0 end) as bigint) tokens_after from j"
)
def tool_prune_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tools.prune_stats(_judged(spark, sf))


GATED = (
    CALLS
    + f""", ct as (select distinct name tool from c), tn as (select session, use_turn turn, cast(use_turn % 5 as bigint) state from c),
ca as (select st.state, tool, (length(tool) + st.state) % 3 <> 0 keep from (select distinct state from tn) st, ct where st.state < 4),
g as (select session, turn, tn.state, ct.tool, keep is null pending, coalesce(keep, true) selected from tn cross join ct left join ca on ca.state = tn.state and ca.tool = ct.tool)"""
)


def _gated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    uses = tool_calls(spark, sf)[0]
    turns = uses.select("session", F.col("turn").cast("long").alias("turn"), (F.col("turn") % 5).cast("long").alias("state"))
    catalog = uses.select(F.col("name").alias("tool")).distinct()
    cache = turns.select("state").distinct().where("state < 4").crossJoin(catalog).withColumn("keep", (F.length("tool") + F.col("state")) % 3 != 0)
    return tools.gate(turns, catalog, cache), uses.select("session", F.col("turn").cast("long").alias("turn"), F.col("name").alias("tool"))


@query(GATED + " select session, count(*) decisions, count(*) filter (pending) pending, count(*) filter (selected) selected from g group by 1")
def tool_gate(spark: SparkSession, sf: str) -> DataFrame:
    g = _gated(spark, sf)[0]
    return g.groupBy("session").agg(F.count("*").alias("decisions"), F.count_if("pending").alias("pending"), F.count_if("selected").alias("selected"))


RECALL = (
    GATED
    + """, s as (select session, turn, count(*) filter (selected) offered, list(tool) filter (selected) sel from g group by 1, 2),
r as (select s.session, count(*) turns, count(*) "using", count(*) filter (list_contains(coalesce(sel, []), c.name)) recalled, cast(sum(offered) as bigint) offered from s join c on c.session = s.session and c.use_turn = s.turn group by 1)"""
)


@query(RECALL + ' select session, turns, "using", recalled, offered from r')
def tool_gate_recall(spark: SparkSession, sf: str) -> DataFrame:
    return tools.recall(*_gated(spark, sf))


@query(RECALL + ' select cast(sum(turns) as bigint) turns, cast(sum("using") as bigint) "using", cast(sum(recalled) as bigint) recalled, sum(recalled)::double / greatest(1, sum("using"))::double recall, avg(offered) offered from r')
def tool_gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tools.summary(tool_gate_recall(spark, sf))


# ---- evaluation
@query("select item_id needle_id, (select count(*) from documents d where contains(lower(d.text), lower(b.text))) found_in from benchmark b")
def needle_recall(spark: SparkSession, sf: str) -> DataFrame:
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return E.needle_recall(table(spark, sf, "documents").select("doc_id", "text"), needles, "doc_id")


@query(
    """with j as (select quality, length(text) > 2000 k from documents join labels using (doc_id) where quality is not null)
select count(*) filter (k and quality = 1) kept_good, count(*) filter (k and quality <> 1) kept_bad, count(*) filter (not k and quality = 1) lost_good, count(*) filter (not k and quality <> 1) lost_bad from j"""
)
def decision_quality(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", (F.length("text") > 2000).alias("k"))
    return E.decision_quality(d, table(spark, sf, "labels"), "doc_id", "k", "quality")


@query(
    f"""with m as (select conv_id t, turn pos, {_ROLE} role, {q_strip("coalesce(text, '')")} s from conversations where {q_filled("coalesce(text, '')")}),
b as (select t, pos, '- [' || case when role = 'tool' then 'tool:conv' else role end || '] ' || case when length(s) <= 400 then s else left(s, 400) || ' …' end block, case when role = 'tool' then 0 else 1 end o from m where not (role = 'assistant' and starts_with(s, '[tool call:'))),
u as (select *, cast(sum(length(block)) over (partition by t order by o, pos rows unbounded preceding) as bigint) used from b) select t, pos, block, used from u where used <= 2000"""
)
def compaction_digest(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).withColumn("role", F.expr(_ROLE.replace("turn", "pos"))).withColumn("name", F.lit("conv"))
    return E.digest(m, "t", 2000)
