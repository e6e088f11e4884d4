"""Queries over compositions of the operators: whole squeezes and runs with their holds and statistics, transcripts parsed, judged and put together again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.tables import written
from ..functions.text import q_json_chars, q_squash, q_strip, q_tokens
from ..operators import admit as A
from ..operators import chunk as C
from ..operators import context as X
from ..operators import dedup as D
from ..operators import evaluate as E
from ..operators import pipeline, research, support, tools, voice
from ..operators import policy as Y
from ..operators import prefix as R
from ..operators import squeeze as S
from ..sources.synthetic import NEEDLES, monitoring, signal_rounds
from . import core, domains
from .inputs import api_messages, api_sql, bench_messages, bench_sql, holds, messages, scratch, table, tool_messages, tool_rows

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


# ---- squeezes of whole transcripts
def _chunks_of(src: str, size: str) -> str:
    return core.chunk_sql(size).replace("from documents", f"from {src}")


#: Repeated lines counted over a transcript (source), not within a document.
_BOIL = core.BOIL.replace("select doc_id, chunk_idx, unnest(", "select source, doc_id, chunk_idx, unnest(").replace(" l from ch)", " l from ch join tail using (doc_id))").replace(
    "min(chunk_idx) over (partition by doc_id, l)", "min(doc_id * 1000000 + chunk_idx) over (partition by source, l)"
).replace("first < chunk_idx", "first < doc_id * 1000000 + chunk_idx")
_BODY = core._RE.replace("chunk || x", "chunk")
_NOTE = "case when n_kept < n_chunks then '[squeezed: kept ' || n_kept || '/' || n_chunks || ' chunks]' || chr(10) else '' end || body"


def _keep(src: str) -> str:
    return core.KEEP.format(src=src).replace("select *, p >=", "select *, chr(0) x, p >=")


PROTECT = 20_000
AWARE = f"""with pr as (select doc_id, source, coalesce(text, '') as text, {q_tokens("coalesce(text, '')")} tk,
  sum({q_tokens("coalesce(text, '')")}) over (partition by source order by doc_id rows unbounded preceding) <= {PROTECT} protected from documents),
tail as (select * from pr where not protected), {_chunks_of('tail', core.TIER)}, {_BOIL}, {_keep('bo')}{_BODY},
aw as (select source t, pr.doc_id pos, tk, protected, n_kept, n_chunks, coalesce({_NOTE}, text) as content from pr left join re using (doc_id))"""


def _aware(spark: SparkSession, sf: str) -> DataFrame:
    return S.cache_aware(tool_messages(spark, sf), "t", lambda c: Y.boilerplate(c, "t", ["pos", "chunk_idx"]), PROTECT)


@query(AWARE + " select t, pos, protected, n_kept, n_chunks, sha1(content) content_sha from aw")
def cache_aware_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as transcripts: the first 20,000 tokens stay, the rest is squeezed."""
    return _aware(spark, sf).select("t", "pos", "protected", "n_kept", "n_chunks", F.sha1("content").alias("content_sha"))


@query(
    AWARE
    + f""" select t, cast(sum(tk) as bigint) tokens_before, cast(sum({q_tokens('content')}) as bigint) tokens_after, cast(coalesce(sum({q_tokens('content')}) filter (protected), 0) as bigint) protected_tokens,
  cast(coalesce(sum({q_tokens('content')}) filter (not protected), 0) as bigint) dynamic_tokens_after, cast(coalesce(sum(n_chunks), 0) as bigint) chunks_total, cast(coalesce(sum(n_kept), 0) as bigint) chunks_kept from aw group by 1"""
)
def cache_aware_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.cache_aware_stats(_aware(spark, sf), "t")


_FL = "fl as (select pos doc_id, agent source, content as text, text orig, is_dup from m)"
FLEET = f"""{core.DEDUP}, {_FL}, {_chunks_of('fl', core.TIER)}, {core.UNIQ}, {_keep('u')}{_BODY},
fs as (select source agent, doc_id pos, is_dup, orig, text deduped, n_chunks, coalesce({_NOTE}, text) as content from fl left join re using (doc_id))"""


def _fleet(spark: SparkSession, sf: str) -> DataFrame:
    rows = tool_rows(spark, sf).withColumn("role", F.lit("tool"))
    return D.fleet_squeeze(rows, ["agent", "pos"], Y.uniqueness)


@query(FLEET + " select agent, pos, is_dup, sha1(content) content_sha from fs")
def fleet_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return _fleet(spark, sf).select("agent", "pos", "is_dup", F.sha1("content").alias("content_sha"))


_SUMS = f"cast(sum({q_tokens('content')}) as bigint) tokens_after, cast(sum(is_dup::int) as bigint) collapsed, cast(coalesce(sum(n_chunks), 0) as bigint) chunks_total"


@query(f"{FLEET} select agent, cast(sum({q_tokens('deduped')}) as bigint) tokens_before, {_SUMS} from fs group by 1 union all select null, cast(sum({q_tokens('orig')}) as bigint), {_SUMS} from fs")
def fleet_squeeze_report(spark: SparkSession, sf: str) -> DataFrame:
    return D.fleet_squeeze_report(_fleet(spark, sf))


@query(
    f"with {core.chunk_sql('6000')}, {core.UNIQ}, {_keep('u')}{_BODY.replace('when hard_after then', 'when false then')} "
    "select doc_id pos, sha1(coalesce('[compressed: kept ' || n_kept || '/' || n_chunks || ' chunks]' || chr(10) || body, text)) content_sha from documents left join re using (doc_id)"
)
def first_form_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    """The older pruner's form: one size of chunk, joined by line feeds, with a note on every message."""
    out = S.squeeze(tool_messages(spark, sf), "t", Y.uniqueness, two_tier=False, first_form=True)
    return out.select("pos", F.sha1("content").alias("content_sha"))


_QUICK = core.BOIL.replace(P.HEARTBEAT.sql("l"), P.QUICK_NOISE.sql("l"))


@query(f"with {core.chunk_sql('1500')}, {_QUICK} select doc_id, cast(chunk_idx as int) chunk_idx, p from bo")
def policy_quickstart(spark: SparkSession, sf: str) -> DataFrame:
    return Y.boilerplate(core.chunk_lines(spark, sf), "doc_id", ["chunk_idx"], P.QUICK_NOISE).select("doc_id", "chunk_idx", "p")


@query(
    f"""{core.ANNOTATED}, pr as (select k.pos doc_id, case coalesce(sd, fd) when 'keep_full' then 1.0 when 'trim' then 0.5 when 'notice' then 0.0 when 'hold' then 0.0 else 0.5 end::double p
  from k left join s using (name, n, hh, th) left join f using (name, n)), {core.chunk_sql('6000').replace('f as (', 'cf as (').replace('from f)', 'from cf)')},
ap as (select ch.*, pr.p from ch join pr using (doc_id)), {_keep('ap').replace('k as (select', 'ka as (select', 1).replace('from k)', 'from ka)')}
select doc_id, cast(chunk_idx as int) chunk_idx, p, keep from kk"""
)
def policy_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """What the gate decided when a text came in, as the probability of its chunks in a later squeeze."""
    rows = tool_rows(spark, sf)
    log = A.decide(rows).select(F.col("pos").alias("log_pos"), "decision", *A.fingerprint(F.col("name"), F.col("text")))
    priors = A.match_annotations(rows, log, "pos").select(F.col("pos").alias("doc_id"), "p")
    scored = Y.priors(C.chunks(table(spark, sf, "documents"), ["doc_id"]), priors, ["doc_id"])
    return S.keep(scored, ["doc_id"]).select("doc_id", "chunk_idx", "p", "keep")


@query(f"with {core.chunk_sql('2000')}, w as (select doc_id, chunk_idx, chunk from ch union all select doc_id, 0, '' from documents where doc_id not in (select doc_id from ch)) select doc_id, cast(chunk_idx as int) \"window\", sha1(chunk) body_sha from w")
def judging_windows(spark: SparkSession, sf: str) -> DataFrame:
    return X.windows(table(spark, sf, "documents"), ["doc_id"], "text", 2000).select("doc_id", "window", F.sha1("body").alias("body_sha"))


# ---- near duplicates
_SETS = f"ts as (select pos k, list_sort(list_distinct(list_filter(string_split({q_squash('text')}, ' '), lambda x: x <> ''))) s from tool_rows where length(text) >= 60), tc as (select s, min(k) k from ts group by s)"
NEAR = f"""with recursive {core.TOOL_ROWS}, {_SETS},
nc as (select a.k a, b.k b, len(list_intersect(a.s, b.s)) i, len(a.s) + len(b.s) t from tc a join tc b on a.k < b.k and least(len(a.s), len(b.s)) >= 0.85 * greatest(len(a.s), len(b.s))),
np as (select a, b, cast(i as double) / (t - i) j from nc where i >= 0.85 * (t - i)),
no as (select b, list(a) la, row_number() over (order by b) i from np group by b),
ng(i, gone) as (select 0::bigint, []::bigint[] union all select ng.i + 1, case when len(list_filter(no.la, lambda x: not list_contains(ng.gone, x))) > 0 then list_append(ng.gone, no.b) else ng.gone end from ng join no on no.i = ng.i + 1),
gn as (select unnest(gone) k from ng where i = (select max(i) from ng))"""
core.ORACLES["near_dup_pairs"] = NEAR + " select a, b, j jaccard from np"
core.ORACLES["near_dup_clusters"] = NEAR + ", best as (select b k, max({'j': j, 'r': -a}) m from np where b in (select k from gn) and a not in (select k from gn) group by b) select k, -m.r rep, m.j jaccard from best"


@query(NEAR + " select k, min(k) over (partition by s) class from ts")
def near_dup_members(spark: SparkSession, sf: str) -> DataFrame:
    """Each text with the first one that has the same set of tokens; near_dup_pairs are between these."""
    return D.token_classes(tool_rows(spark, sf), "pos")


_DIFF = "list_filter(case when string_split(text, chr(10))[-1] = '' then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end, lambda x: not list_contains(case when string_split(ft, chr(10))[-1] = '' then string_split(ft, chr(10))[:-2] else string_split(ft, chr(10)) end, x))"


@query(
    NEAR
    + f""", rp as (select k rep, k from tc where k not in (select k from gn)), cl as (select ts.k, tc.k c from ts join tc using (s)),
cd as (select cl.k, rep, 1.0::double j from cl join rp on rep = c where rep < cl.k
  union all select cl.k, rep, j from cl join np on a = c join rp on rep = b where rep < cl.k union all select cl.k, rep, j from cl join np on b = c join rp on rep = a where rep < cl.k),
cb as (select k, max({{'j': j, 'r': -rep}}) m from cd group by k),
al as (select t.pos, t.text, -m.r rep, m.j j, f.agent owner, f.text ft from tool_rows t left join cb on cb.k = t.pos left join tool_rows f on f.pos = -m.r),
dl as (select *, array_to_string({_DIFF}, chr(10)) d, {q_squash('text')} = {q_squash('ft')} same, substr(sha1({q_squash('ft')}), 1, 12) ref, cast(floor(j * 100 + 0.5) as bigint) pc from al)
select pos, rep, j jaccard, case when rep is null then null when same then 'exact' else 'near' end kind, coalesce(not same and length(d) > 4000, false) "cut",
  sha1(case when rep is null then text when same then '[shared context: identical output already in agent ''' || owner || ''' transcript — ref ' || ref || ']'
  else '[shared context: near-duplicate of agent ''' || owner || ''' tool output — ref ' || ref || ', similarity ' || case when pc >= 100 then '1.00' else '0.' || lpad(pc::varchar, 2, '0') end || '; only the differing lines are kept below:' || chr(10)
    || case when d = '' then '(no line differences)' else left(d, 4000) end || ']' end) content_sha from dl"""
)
def near_dup_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats and near repeats across agents, with the lines in which they differ."""
    d = D.collapse(tool_rows(spark, sf), "pos", scratch(spark))
    return d.select("pos", "rep", "jaccard", "kind", "cut", F.sha1("content").alias("content_sha"))


@query(
    f"""with {core.TOOL_ROWS}, n as (select *, {q_squash('text')} nf from tool_rows), o as (select *, lead(text) over (partition by agent order by pos) nx from n),
h as (select pos, agent, nx, array_to_string({_DIFF.replace('ft', 'tmp').replace('text', 'nx').replace('tmp', 'text')}, chr(10)) d from o where nx is not null)
select pos, sha1(left(d, 4000)) diff_sha, case when length(d) > 4000 then printf('⟦held:%s/%04d⟧', agent, row_number() over (partition by agent, length(d) > 4000 order by pos)) end ref from h"""
)
def diff_holds(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's lines that the one before it lacks; what is cut is held whole."""
    d = D.with_next(tool_rows(spark, sf)).select("agent", "pos", D.differing(F.col("text"), F.col("nx"), None).alias("_d"))
    # the numbers need the lengths of all and the rows read both, so what was told of the texts is written
    d = written(d.select("agent", "pos", F.sha1(F.substring("_d", 1, D.DIFF_CHARS)).alias("diff_sha"), (F.length("_d") > D.DIFF_CHARS).alias("_long")), scratch(spark), "diffs")
    return A.with_refs(d, F.col("_long"), F.col("agent"), [], "pos").select("pos", "diff_sha", "ref")


# ---- prefixes in characters
_TURNS = domains._ROLE
_JSON = f"{q_json_chars('role')} + {q_json_chars('content')} + {len(json.dumps({'role': '', 'name': '', 'content': ''}))}"


@query(
    f"""with m as (select conv_id t, turn pos, {_TURNS} role, coalesce(text, '') as content from conversations),
p as (select *, last_value(case when role <> 'tool' then role end ignore nulls) over (partition by t order by pos rows between unbounded preceding and 1 preceding) prev from m),
i as (select *, case when role in ('user', 'assistant', 'tool') then sum((role in ('user', 'assistant') or (role = 'tool' and coalesce(prev, '') not in ('user', 'assistant')))::int) over (partition by t order by pos rows unbounded preceding) - 1 end turn_id from p),
c as (select t, cast(turn_id as bigint) turn_id, cast(sum({_JSON}) as bigint) chars from i where turn_id is not null group by all)
select t, turn_id, chars, sum(chars) over (partition by t order by turn_id rows unbounded preceding) <= 2000 protected from c"""
)
def protected_turns(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).withColumn("role", F.expr(_TURNS.replace("turn", "pos"))).withColumn("name", F.lit(""))
    return R.protect_turns(X.merge_turns(m, "t"), "t", 2000)


# ---- domain runs
def _last(sql: str, name: str, keep: str = "") -> str:
    """The query of a judge as a table with its texts: its last select, with the excerpt in place of its digest."""
    head, tail = sql.rsplit("\nselect ", 1)
    tail = tail.replace("sha1(case", "(case", 1).replace("excerpt_sha", "excerpt")
    return f"{head},\n{name} as (select {keep}{tail})"


def _stats(keys: str, decisions: list[str], src: str, out: str = "o", text: str = "text") -> str:
    counts = ", ".join(f"count(*) filter (decision = '{d}') {d}" for d in decisions)
    size = lambda c: f"cast(coalesce(sum(length({c})), 0) as bigint)"
    tok = lambda c: f"cast(greatest(1, (coalesce(sum(length({c})), 0) + count(*) - 1) // 4) as bigint)"
    return f"select {keys} count(*) n, {counts}, count(ref) held, {size(text)} chars_in, {size(out)} chars_out, {tok(text)} tokens_in, {tok(out)} tokens_out from {src}"


SUPPORT = _last(domains.SUPPORT, "s", "text, ") + """,
h as (select conv_id, turn, printf('⟦held:support:%s/%04d⟧', decision, row_number() over (partition by conv_id, decision order by turn)) ref from s where decision <> 'keep_full' and length(text) > 120),
r as (select s.*, ref, coalesce(excerpt, '') || case when ref is null then '' else ' [held: ' || ref || ']' end o from s left join h using (conv_id, turn))"""


@query(SUPPORT + " select conv_id, turn, decision, ref, sha1(o) out_sha from r")
def support_run(spark: SparkSession, sf: str) -> DataFrame:
    d = support.squeeze(table(spark, sf, "conversations"), "conv_id", "turn")
    return d.select("conv_id", "turn", "decision", "ref", F.sha1("out").alias("out_sha"))


@query(SUPPORT + " " + _stats("conv_id,", ["keep_full", "keep_excerpt", "notice"], "r") + " group by conv_id")
def support_stats(spark: SparkSession, sf: str) -> DataFrame:
    return support.stats(support.squeeze(table(spark, sf, "conversations"), "conv_id", "turn"), "conv_id")


STEPS = _last(domains.STEPS, "s", "nm, text, ") + """,
h as (select run, pos, printf('⟦held:%s/%04d⟧', nm, row_number() over (partition by run, nm order by pos)) ref from s where decision <> 'keep_full'),
r as (select s.*, ref, excerpt || case when ref is null then '' else chr(10) || '[held:' || ref || ']' end o from s left join h using (run, pos))"""


@query(STEPS + " select run, pos, decision, ref, sha1(o) out_sha from r")
def pipeline_run(spark: SparkSession, sf: str) -> DataFrame:
    d = pipeline.squeeze(tool_rows(spark, sf).withColumnRenamed("agent", "run"), "run", "pos", folder=scratch(spark))
    return d.select("run", "pos", "decision", "ref", F.sha1("out").alias("out_sha"))


@query(f"{STEPS} select * replace (greatest(1, chars_in // 4) as tokens_in, greatest(1, chars_out // 4) as tokens_out) from ({_stats('run,', ['keep_full', 'keep_excerpt', 'notice'], 'r')} group by run)")
def pipeline_stats(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.stats(pipeline.squeeze(tool_rows(spark, sf).withColumnRenamed("agent", "run"), "run", "pos", folder=scratch(spark)), "run")


RESEARCH = _last(domains.RESEARCH, "s", "text, len(ls) lines_total, ") + f""",
n as (select s.*, source || '/' || (doc_id % 40) url, lower({q_squash("coalesce(s.text, '')")}) nf from s join documents using (doc_id)),
u as (select *, case when nf <> '' and row_number() over (partition by nf order by doc_id) > 1 then first_value(url) over (partition by nf order by doc_id) end dup_of from n),
w as (select * replace (case when dup_of is not null then 'notice' else decision end as decision, case when dup_of is not null then 0 else n_kept end as n_kept) from u),
h as (select doc_id, printf('⟦held:%s/%04d⟧', url, row_number() over (partition by url order by doc_id)) ref from w where decision <> 'keep_full'),
r as (select w.*, ref, case when dup_of is not null then '[duplicate of ' || dup_of || '; full page held]' when decision = 'keep_full' then coalesce(text, '')
  when decision = 'notice' then '[page dropped: ' || lines_total || ' lines, ' || length(coalesce(text, '')) || ' chars; full page held]' else '[kept ' || n_kept || '/' || lines_total || ' lines; full page held]' || chr(10) || excerpt end o
  from w left join h using (doc_id))"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("pos"), F.concat_ws("/", "source", (F.col("doc_id") % 40).cast("string")).alias("url"), "text")


@query(RESEARCH + " select doc_id pos, decision, dup_of, cast(n_kept as bigint) lines_kept, cast(lines_total as bigint) lines_total, ref, sha1(o) out_sha from r")
def research_run(spark: SparkSession, sf: str) -> DataFrame:
    d = research.squeeze(_pages(spark, sf), domains.TASK, domains.CITED, folder=scratch(spark))
    return d.select("pos", "decision", "dup_of", "lines_kept", "lines_total", "ref", F.sha1("out").alias("out_sha"))


@query(f"{RESEARCH} select * exclude (tokens_out), (select count(dup_of) from r) duplicates from ({_stats('', ['keep_full', 'keep_quotes', 'notice'], 'r', text=chr(34) + 'text' + chr(34))})")
def research_stats(spark: SparkSession, sf: str) -> DataFrame:
    return research.stats(research.squeeze(_pages(spark, sf), domains.TASK, domains.CITED, folder=scratch(spark)))


def _voice(spark: SparkSession, sf: str) -> DataFrame:
    return voice.squeeze(domains._voice_turns(spark, sf), "conv_id", "turn", folder=scratch(spark))


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"


_NORM = f"lower({q_squash('text')})"
_CONTENT = "[" + ", ".join(f"'{w}'" for w in P.CONTENTLESS) + "]"
VOICE = f"""with recursive {domains.VOICE.removeprefix('with ').replace('select conv_id, turn, case', ', vl as (select conv_id, turn, text, list_filter(ls, lambda y: ' + P.VOICE_FACT.sql('y') + ') facts, case', 1)}),
vo as (select *, row_number() over (partition by conv_id order by turn) i, {_NORM} nf, {_words(_NORM)} ws from vl),
wk(conv_id, i, kept, decision, excerpt) as (
  select distinct conv_id, 0::bigint, []::struct(w varchar[])[], '', '' from vo
  union all
  select conv_id, i, case when decision in ('keep_full', 'keep_excerpt') and length(nf) > 30 then list_append(kept, {{'w': ws}}) else kept end, decision,
    case when decision = 'keep_excerpt' then array_to_string(facts, chr(10)) when decision = 'keep_full' then text when early is not null then early when again then '[restated; same intent as earlier turn]' else '[confirmation re-ask; fact established earlier]' end
  from (select *, case when early is not null or again or (confirms and len(kept) > 0) then 'notice' when not commits and len(facts) > 0 and length(text) > 160 then 'keep_excerpt' else 'keep_full' end decision
    from (select vo.*, kept, length(nf) > 30 and len(list_filter(kept, lambda k:
        (len(list_distinct(ws)) > 0 and len(k.w) > 0 and len(list_intersect(list_distinct(ws), list_distinct(k.w)))::double / len(list_distinct(list_concat(ws, k.w))) >= 0.45)
        or (len(list_filter(k.w, lambda c: not list_contains({_CONTENT}, c))) >= 5
          and len(list_filter(k.w, lambda c: not list_contains({_CONTENT}, c) and list_contains(ws, c)))::double / len(list_filter(k.w, lambda c: not list_contains({_CONTENT}, c))) >= 0.75))) > 0 again
      from wk join vo on vo.conv_id = wk.conv_id and vo.i = wk.i + 1))),
vd as (select conv_id, turn, text, decision, excerpt from wk join vo using (conv_id, i))"""
domains.ORACLES["voice_dialogue"] = VOICE + " select conv_id, turn, decision, sha1(excerpt) excerpt_sha from vd"
_VRUN = VOICE + """,
h as (select conv_id, turn, printf('⟦held:voice:%s/%04d⟧', decision, row_number() over (partition by conv_id, decision order by turn)) ref from vd where decision <> 'keep_full' and length(text) > 100),
r as (select vd.*, ref, excerpt || case when ref is null then '' else ' [held: ' || ref || ']' end o from vd left join h using (conv_id, turn))"""


@query(_VRUN + " select conv_id, turn, decision, ref, sha1(o) out_sha from r")
def voice_run(spark: SparkSession, sf: str) -> DataFrame:
    return _voice(spark, sf).select("conv_id", "turn", "decision", "ref", F.sha1("out").alias("out_sha"))


@query(_VRUN + " " + _stats("conv_id,", ["keep_full", "keep_excerpt", "notice"], "r") + " group by conv_id")
def voice_stats(spark: SparkSession, sf: str) -> DataFrame:
    return voice.stats(_voice(spark, sf), "conv_id")


# ---- holds
@query(core.GATE + " select ref, true known, sha1(text) held_sha from g where ref is not null union all select '⟦held:' || source || '/9999⟧', false, null from documents group by source")
def readmit_by_ref(spark: SparkSession, sf: str) -> DataFrame:
    h = holds(spark, sf)
    unknown = table(spark, sf, "documents").select(F.concat(F.lit("⟦held:"), "source", F.lit("/9999⟧")).alias("ref")).distinct()
    d = A.readmit(h.select("ref").unionByName(unknown), h)
    return d.select("ref", "known", F.sha1("held_text").alias("held_sha"))


@query(
    f"""with {core.TOOL_ROWS}, j as (select *, (length(text) % 11)::double / 10 r, case when length(text) % 13 = 0 then null else (length(text) % 7)::double / 6 end q, contains(lower(name), 'error') or {P.SIGNAL.sql('substr(text, 1, 4000)')} e from tool_rows)
select pos, case when length(text) <= 2000 or (e and length(text) <= 8000) then 'keep_full' when q is null then 'keep_full' when r < 0.2 then 'hold' when r < 0.5 then 'notice' when q >= 0.6 then 'trim' else 'keep_full' end decision from j"""
)
def two_question_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate under a judge of two answers, for which stand in what is left of the text's length by 11 and by 7; now and then it doesn't answer."""

    def policy(text: Column, error: Column) -> tuple[Column, Column]:
        n = F.length(text)
        return A.two_questions((n % 11).cast("double") / 10, F.when(n % 13 != 0, (n % 7).cast("double") / 6))

    return A.decide(tool_rows(spark, sf), policy=policy).select("pos", "decision")


# ---- transcripts
API = "with " + api_sql()


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return X.api_blocks(api_messages(spark, sf), "t")


@query(API + " select t, turn_id, kind, count(*) n, coalesce(cast(sum(length(coalesce(text, '') || coalesce(content, ''))) as bigint), 0) chars from ab group by all")
def api_blocks(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length(F.concat(F.coalesce("text", F.lit("")), F.coalesce("content", F.lit(""))))
    return _blocks(spark, sf).where("kind is not null").groupBy("t", "turn_id", "kind").agg(F.count("*").alias("n"), F.sum(size).alias("chars"))


@query(API + ", tx as (select t, turn_id, string_agg(trim(text), chr(10) order by n) s from ab where kind = 'text' group by all) select t, turn_id, role, coalesce(s, '') as text from am left join tx using (t, turn_id)")
def api_turns(spark: SparkSession, sf: str) -> DataFrame:
    return X.api_turns(_blocks(spark, sf), "t")


_API_PAIRS = API + """, f as (select t, id, arg_min({'kind': kind, 'name': name, 'path': path, 'turn': turn_id}, turn_id * 100 + n) f, max(turn_id) filter (kind = 'tool_use') u,
  arg_max({'c': content, 'e': is_error, 'turn': turn_id}, turn_id * 100 + n) filter (kind = 'tool_result') r from ab where kind in ('tool_use', 'tool_result') group by all)"""


@query(_API_PAIRS + " select t, id, case when f.kind = 'tool_use' then f.name else '' end as name, coalesce(u, f.turn) use_turn, r.c result, coalesce(r.e, false) is_error, r is not null has_result, coalesce(r.turn, u) result_turn, f.kind = 'tool_result' orphan from f")
def api_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = X.api_pairs(_blocks(spark, sf), "t")
    return d.select("t", "id", "name", "use_turn", "result", "is_error", "has_result", "result_turn", "orphan")


@query(f"with {bench_sql()} select t, bool_or(role = 'tool') bench from bm group by 1")
def transcript_form(spark: SparkSession, sf: str) -> DataFrame:
    return X.is_bench(bench_messages(spark, sf), "t")


JUDGED_WINDOW = 100
BENCH = f"""with {bench_sql()},
tu as (select t, turn_id, arg_min({{'r': role, 'c': content}}, pos) o from bt where turn_id is not null group by all),
tt as (select t, turn_id, case when o.r = 'tool' then 'assistant' else o.r end role, case when o.r = 'tool' then '' else {q_strip('o.c')} end as text from tu),
ca as (select t, turn_id, call_id id, tool as name, path, target from bt where call_id is not null),
tr as (select t, turn_id, pos, coalesce(tool_call_id, '') id, name, content from bt where role = 'tool'),
me as (select tr.*, ca.id is not null met from tr left join ca using (t, turn_id, id)),
bp2 as (select ca.t, ca.turn_id, 0::bigint k, ca.id, ca.name, path, target, r result, false orphan from ca left join (select t, turn_id, id, arg_max(content, pos) r from me where met group by all) using (t, turn_id, id)
  union all select t, turn_id, 4294967296 + pos, id, name, '', name, content, true from me where not met),
pa as (select *, result is not null has_result, coalesce({P.TOOL_ERROR.sql('substr(result, 1, 2000)')}, false) is_error from bp2)"""


def _bench(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = X.merge_turns(bench_messages(spark, sf), "t")
    return m, X.bench_turns(m, "t"), X.bench_pairs(m, "t")


@query(BENCH + " select t, turn_id, role, sha1(text) text_sha from tt")
def bench_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _bench(spark, sf)[1].select("t", "turn_id", "role", F.sha1("text").alias("text_sha"))


@query(BENCH + " select t, turn_id, k, id, name, target, result, has_result, is_error, orphan from pa")
def bench_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = _bench(spark, sf)[2]
    return d.select("t", "turn_id", "k", "id", "name", X.target(F.col("name"), F.col("input")).alias("target"), "result", "has_result", "is_error", "orphan")


@query(BENCH + " select t, row_number() over (partition by t order by turn_id, k) - 1 unit, id from pa")
def tool_units(spark: SparkSession, sf: str) -> DataFrame:
    return X.tool_units(_bench(spark, sf)[2], "t").select("t", F.col("unit").cast("long").alias("unit"), "id")


STALE = BENCH + f""",
st as (select *, max(turn_id) filter (name = 'Edit' and has_result and path <> '') over (partition by t, path) lw, max(turn_id) filter (name = 'Read' and has_result and path <> '') over (partition by t, path) lr,
  max(turn_id) filter (has_result and not is_error) over (partition by t, name, case when path <> '' then path else target end) ok from pa),
pd as (select *, case when name = 'Read' and has_result and path <> '' and lw > turn_id then '[read ' || path || ': STALE — file edited afterwards; content outdated]'
  when name = 'Read' and has_result and path <> '' and lr > turn_id then '[read ' || path || ': SUPERSEDED — same file read again later]' end replacement, coalesce(ok > turn_id, false) resolved,
  case when coalesce(result, '') = '' then 0 else len(string_split(result, chr(10))) end ln from st),
pn as (select *, case when name = 'Read' then '[read ' || target || ': ' || ln || ' lines, no errors]' when name = 'Edit' then '[edited ' || target || ']' when name = 'Bash' and is_error then '[ran `' || target || '`: failed]'
  when name = 'Bash' then '[ran `' || target || '`: ok, ' || ln || ' lines output]' when name = 'Grep' then '[searched ' || target || ': ' || ln || ' lines]'
  when is_error then '[' || name || ' ' || target || ': errored]' else '[' || name || ' ' || target || ': ok]' end note from pd)"""


def _settled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m, turns, pairs = _bench(spark, sf)
    return m, turns, X.later_success(X.stale(pairs, "t"), "t")


@query(
    STALE
    + """, ln2 as (select t, turn_id, k, case when replacement is not null then '[tool ' || name || ' ' || target || ': ' || replacement || ']'
  when has_result then '[tool ' || name || ' ' || target || case when is_error then ' ERROR' else '' end || ': ' || left(string_split(""" + q_strip("result") + """, chr(10))[1], 200) || '... (' || length(result) || ' chars total)]' else '[tool call ' || name || ' ' || target || ': no result yet]' end line from pd),
li as (select t, turn_id, string_agg(line, chr(10) order by k) s from ln2 group by all),
tj as (select tt.*, text || case when text <> '' and s is not null then chr(10) else '' end || coalesce(s, '') jt from tt left join li using (t, turn_id))
select t, turn_id, sha1(jt) text_sha, sha256('1' || chr(10) || role || chr(10) || jt) key from tj"""
)
def turn_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What a judge is shown of a turn, and its cache key."""
    _, turns, pairs = _settled(spark, sf)
    d = X.turn_text(turns, pairs, "t")
    return d.select("t", "turn_id", F.sha1("judged_text").alias("text_sha"), X.turn_key("1").alias("key"))


@query(STALE + " select t, turn_id, k, sha256('1' || chr(10) || 'pair' || chr(10) || name || chr(10) || target || chr(10) || coalesce(result, '')) key from pd")
def pair_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _settled(spark, sf)[2].select("t", "turn_id", "k", X.pair_key("1").alias("key"))


_TURN_LINE = "'t' || turn_id || ' [' || role || ']: ' || case when left(string_split(" + q_strip("text") + ", chr(10))[1], 160) = '' then '(no text)' else left(string_split(" + q_strip("text") + ", chr(10))[1], 160) end"


@query(
    STALE
    + f""", ll as (select t, turn_id, 1099511627776 k, {_TURN_LINE} line from tt union all
  select pd.t, pd.turn_id, k, '[tool ' || name || ' ' || target || ']: ' || case when replacement is not null then replacement when not has_result then 'called, no result yet' when is_error then 'ERROR — kept verbatim (' || length(result) || ' chars)' else 'kept (' || length(result) || ' chars)' end
  from pd join tt on tt.t = pd.t and tt.turn_id = pd.turn_id and tt.role <> 'user'),
lw as (select t, turn_id, k, coalesce(list(line) over (partition by t order by turn_id, k rows between 12 preceding and 1 preceding), []) l from ll)
select t, turn_id, sha1(coalesce(array_to_string(arg_min(l, k), '|'), '')) ledger_sha from lw group by all"""
)
def ledger_lines(spark: SparkSession, sf: str) -> DataFrame:
    _, turns, pairs = _settled(spark, sf)
    return X.ledger(turns, pairs, "t").select("t", "turn_id", F.sha1(F.array_join("ledger", "|")).alias("ledger_sha"))


@query(
    STALE
    + """, pl as (select t, turn_id, string_agg(case when replacement is not null then '[tool ' || name || ' ' || target || ': ' || left(replacement, 60) || ']' when has_result then '[tool ' || name || ' ' || target || ': ' || length(result) || ' chars' || case when is_error then ' ERROR' else '' end || ']'
  else '[tool call ' || name || ' ' || target || ']' end, ' | ' order by k) s from pd group by all),
fl as (select t, turn_id, role, left(string_split(text, chr(10))[1], 120) f, s from tt left join pl using (t, turn_id)),
fc as (select *, 't' || turn_id || ' [' || role || ']: ' || left(case when f = '' and s is null then '(empty)' else f || case when f <> '' and s is not null then ' | ' else '' end || coalesce(s, '') end, 160) line from fl)
select t, turn_id, coalesce(sha1(string_agg(line, '|') over (partition by t order by turn_id rows between 1 following and 12 following)), sha1('')) future_sha from fc"""
)
def future_lines(spark: SparkSession, sf: str) -> DataFrame:
    _, turns, pairs = _settled(spark, sf)
    return X.outlook(turns, "t", pairs=pairs).select("t", "turn_id", F.sha1(F.array_join("future", "|")).alias("future_sha"))


def _score(body: Column) -> Column:
    return (F.length(body) % 10).cast("double") / 10


_FOLD = core.fold_sql("coalesce(result, '')", str(JUDGED_WINDOW))
MAPPED = STALE + f""",
fw as (select *, {_FOLD} s from pn), fx as (select *, case when s.n > 0 then list_append(s.out, {{'t': s.cur, 'h': false}}) else s.out end w from fw),
fp as (select * exclude (s, w), case when len(w) = 0 then 0.0::double else list_max(list_transform(w, lambda x: (length(x.t) % 10)::double / 10)) end p from fx),
pj as (select *, case when not has_result then 'open' when replacement is not null then 'replaced' when is_error and not resolved then 'fail_safe' when p >= 0.5 then 'keep' else 'note' end decision from fp),
pr2 as (select * replace (case when decision = 'note' then note else replacement end as replacement) from pj),
er as (select t, turn_id, bool_or(has_result and is_error and replacement is null) e from pr2 group by all),
tp as (select tt.*, coalesce(e, false) e, (length(text) % 10)::double / 10 p, role <> 'user' and turn_id <= max(turn_id) over (partition by t) - 2 and length(text) >= 800 judged from tt left join er using (t, turn_id)),
td as (select *, case when not judged or (case when e and p < 0.5 then 0.5 else p end) >= 0.5 then 'keep' when p >= 0.3 then 'summarise' else 'drop' end decision from tp)"""


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, pairs and texts with their decisions; answers stand in: the last digit of a window's or text's length."""
    m, turns, pairs = _settled(spark, sf)
    done = X.judge_pairs(pairs, "t", _score, size=JUDGED_WINDOW)
    stuck = done.where("has_result and is_error and replacement is null").select("t", "turn_id", F.lit(True).alias("has_error")).distinct()
    texts = turns.join(stuck, ["t", "turn_id"], "left").withColumn("has_error", F.coalesce("has_error", F.lit(False))).withColumn("p", _score(F.col("text")))
    return m, done, X.decide_texts(texts, "t")


@query(MAPPED + " select t, turn_id, k, decision, sha1(coalesce(replacement, '')) said_sha from pr2")
def judge_units(spark: SparkSession, sf: str) -> DataFrame:
    """Map-reduce judging of tool results, in windows of 100 characters."""
    return _judged(spark, sf)[1].select("t", "turn_id", "k", "decision", F.sha1(F.coalesce("replacement", F.lit(""))).alias("said_sha"))


@query(MAPPED + " select t, turn_id, judged, decision from td")
def judge_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)[2].select("t", "turn_id", "judged", "decision")


@query(MAPPED + " select pr2.t, pr2.turn_id, k, pr2.decision from pr2 join tt on tt.t = pr2.t and tt.turn_id = pr2.turn_id and role <> 'user' union all select t, turn_id, null, decision from td")
def judge_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The sequential judge, with answers that don't depend on what it sees of other turns; so the decisions are the map-reduce ones."""
    _, turns, pairs = _settled(spark, sf)
    return X.judge_in_order(turns, pairs, "t", lambda text, ledger, future: len(text) % 10 / 10, JUDGED_WINDOW)


REASSEMBLED = MAPPED + """,
fi as (select t, turn_id, id, arg_min(replacement, k) filter (true) r, arg_min({'r': replacement}, k) rr from pr2 group by all),
ra as (select bt.t, bt.pos, bt.role, case when bt.role = 'tool' and rr.r is not null then rr.r when bt.role = 'assistant' and td.decision <> 'keep' then '' else bt.content end as content, bt.content orig
  from bt left join fi on fi.t = bt.t and fi.turn_id = bt.turn_id and fi.id = coalesce(bt.tool_call_id, '') left join td on td.t = bt.t and td.turn_id = bt.turn_id
  where bt.turn_id is not null and not (bt.role = 'assistant' and coalesce(td.decision <> 'keep', false) and call_id is null))"""


@query(REASSEMBLED + " select t, pos, role, sha1(content) content_sha from ra")
def reassembled_turns(spark: SparkSession, sf: str) -> DataFrame:
    m, pairs, texts = _judged(spark, sf)
    return X.reassemble(m, pairs, texts, "t").select("t", "pos", "role", F.sha1("content").alias("content_sha"))


# ---- tools
_SCHEMA_TEXT = """'{"properties": {"' || p_brand || '": {"type": "string"}, "size_mm": {"type": "integer"}}, "type": "object"}'"""
_HAY = "lower(replace(p_name, '_', ' ') || ' ' || p_type || ' ' || replace(p_brand, '_', ' ') || ' size mm')"
PRUNED = f"""with h as (select *, list_filter({domains._STRUCTS}, lambda k: regexp_matches({_HAY}, '\\b' || k.w || '\\b')) h, p_name || chr(10) || p_type || chr(10) || {_SCHEMA_TEXT} d from part),
s as (select *, p_name in ('hot gear') was, len(h) >= 2 or len(list_filter(h, lambda k: k.s)) > 0 hit from h),
j as (select *, case when was or hit or not bool_or(was or hit) over () then 'keep' else 'prune' end decision, case when was then 1.0 else least(1.0, len(h) / 4.0) end::double score,
  case when was then 'recently called — sacred' when hit then 'keyword hits: ' || array_to_string(list_transform(h, lambda k: k.w)[:6], ', ') else 'no task signal (' || len(h) || ' keyword hits)' end reason from s),
r as (select p_partkey, printf('⟦held:%s/%04d⟧', p_name, row_number() over (partition by p_name order by p_partkey)) ref from j where decision = 'prune'),
l as (select j.*, ref from j left join r using (p_partkey))"""


def _pruned(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    schema = F.to_json(F.parse_json(F.expr("""concat('{"type":"object","properties":{"', p_brand, '":{"type":"string"},"size_mm":{"type":"integer"}}}')""")))
    defs = p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), schema.alias("input_schema"))
    return tools.prune(defs, domains.TOOL_TASK, ["hot gear"])


@query(PRUNED + " select p_partkey pos, trim(p_name) as name, decision, round(score, 3) score, reason, ref from l")
def tool_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return tools.ledger(_pruned(spark, sf))


@query(PRUNED + " select count(*) tools_before, count(*) filter (decision = 'keep') tools_after, cast(sum(greatest(1, length(d) // 4)) as bigint) tokens_before, cast(sum(case when decision = 'keep' then greatest(1, length(d) // 4) else 0 end) as bigint) tokens_after from l")
def tool_definition_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tools.prune_stats(_pruned(spark, sf))


@query(PRUNED + ", a as (select distinct p_name as name from part union all select 'no such tool'), b as (select p_name as name, arg_max(ref, p_partkey) ref, arg_max({'d': d, 't': p_type, 's': " + _SCHEMA_TEXT + "}, p_partkey) x from l where ref is not null group by 1) select name, ref is not null known, ref, x.d definition, x.t description, x.s input_schema from a left join b using (name)")
def tool_readmit(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    names = names.unionByName(names.sparkSession.createDataFrame([("no such tool",)], "name string"))
    return tools.readmit(names, _pruned(spark, sf))


def _literal(rows: list[tuple], names: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") c({names})"


def _sent(n: str, d: str, s: dict) -> str:
    return json.dumps({"name": n, "description": d, "input_schema": s}, separators=(",", ":"))


_CATALOG = _literal([(i, n, f"- {n}: {d}" + (f" When to use: {w}" if w else ""), len(_sent(n, d, s))) for i, (n, d, s, _, w) in enumerate(tools.CATALOG)], "pos, name, listing, size")


@query(f"select pos, name, listing, size from {_CATALOG}")
def tool_catalog(spark: SparkSession, sf: str) -> DataFrame:
    c = tools.catalog(spark)
    return c.join(tools.wire(c).select("pos", F.length("sent").alias("size")), "pos").select("pos", "name", "listing", "size")


_LISTING = "\n".join(f"- {n}: {d}" + (f" When to use: {w}" if w else "") for n, d, _, _, w in tools.CATALOG)
_TOKENS = "(coalesce(sum(size), 0) + greatest(count(size) - 1, 0) + 2) // 4"


@query(f"select cast({_TOKENS} as bigint) tokens from {_CATALOG}")
def tool_catalog_tokens(spark: SparkSession, sf: str) -> DataFrame:
    w = tools.wire(tools.catalog(spark))
    return w.agg(tools.wire_tokens(w).alias("tokens"))


_GATE_TEXT = ORACLES["turn_texts"].rsplit("\nselect ", 1)[0]
STATES = _GATE_TEXT + f""",
nm as (select t, turn_id, string_agg(distinct name, ',' order by name) s from pd where name <> '' group by all),
gl as (select tj.*, trim('[t' || turn_id || ' ' || role || coalesce(' tools=' || s, '') || '] ' || left(replace(jt, chr(10), ' '), 160)) line from tj left join nm using (t, turn_id)),
gs as (select *, string_agg(line, chr(10)) over w before, left(lag(jt) over (partition by t order by turn_id), 1500) lt from gl window w as (partition by t order by turn_id rows between unbounded preceding and 1 preceding)),
it as (select t, left({q_strip('arg_min(text, turn_id)')}, 2000) intent from tt where role = 'user' and text <> '' group by t),
sa as (select t session, turn_id turn, 'Task: ' || coalesce(intent, '') || chr(10) || chr(10) || 'Tools:' || chr(10) || '{_LISTING.replace("'", "''")}' || chr(10) || chr(10) || 'So far:' || chr(10) || coalesce(before, '(nothing yet)') || chr(10) || chr(10) || 'Latest turn:' || chr(10) || coalesce(lt, '') state
  from gs left join it using (t) where role = 'assistant'),
sk as (select session, turn, sha256('1' || chr(10) || state) state from sa)"""


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    _, turns, pairs = _settled(spark, sf)
    intent = turns.where("role = 'user' and text <> ''").groupBy("t").agg(F.substring(F.min_by("text", "turn_id"), 1, 2000).alias("intent"))
    return tools.gate_states(turns, pairs, "t", intent, _LISTING), pairs


@query(STATES + " select session, turn, state state_key from sk")
def gate_states(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf)[0].select("session", "turn", "state_key")


REPLAY = STATES + f""", ct as (select name tool, size from {_CATALOG}),
gt as (select session, turn, tool, size, (length(tool) + ascii(state)) % 3 = 0 keep, ascii(state) % 5 = 0 pending from sk cross join ct), gg as (select *, pending or keep selected from gt),
us as (select t session, turn_id turn, list(distinct case when name = 'Agent' then 'Task' else name end) u from pd where name <> '' group by all),
se as (select session, turn, list(tool) filter (selected) l, count(*) filter (selected) offered, cast(case when count(*) filter (selected) = 0 then 0 else (coalesce(sum(size) filter (selected), 0) + greatest(count(*) filter (selected) - 1, 0) + 2) // 4 end as bigint) tok from gg group by all),
rp as (select session, count(*) turns, count(u) "using", count(*) filter (u is not null and len(list_filter(u, lambda x: not list_contains(coalesce(l, []), x))) = 0) recalled, cast(sum(offered) as bigint) offered,
  cast(count(*) * (select {_TOKENS} from ct) as bigint) tokens_before, cast(sum(tok) as bigint) tokens_after from se left join us using (session, turn) group by 1)"""


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Cached decisions stand in, by the first character of the state's key; a fifth of the states isn't cached."""
    states, pairs = _states(spark, sf)
    c = tools.catalog(spark)
    turns = states.select("session", "turn", F.col("state_key").alias("state"))
    names = c.select(F.col("name").alias("tool"))
    known = turns.select("state").distinct().where(F.ascii("state") % 5 != 0)
    cache = known.crossJoin(F.broadcast(names)).withColumn("keep", (F.length("tool") + F.ascii("state")) % 3 == 0)
    return tools.replay(tools.gate(turns, names, cache), tools.used_tools(pairs, "t"), tools.wire(c))


@query(REPLAY + " select * from rp")
def gate_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf)


@query(REPLAY + """, sm as (select count(*) sessions, cast(sum("using") as bigint) "using", sum(recalled)::double / greatest(1, sum("using"))::double recall, cast(sum(tokens_before) as bigint) tokens_before, cast(sum(tokens_after) as bigint) tokens_after from rp)
select *, (tokens_before - tokens_after) / 1e6::double * 3.0::double saved_usd, (tokens_before - tokens_after) / 1e6::double * 3.0::double - 0.25::double net_usd, (tokens_before - tokens_after) / 1e6::double * 3.0::double - 0.25::double > 0 pays from sm""")
def gate_replay_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tools.replay_summary(_replayed(spark, sf), judge_usd=0.25)


@query(
    f"""with {core.chunk_sql(core.TIER)}, {core.UNIQ}, {_keep('u')}{_BODY},
sq as (select doc_id, source t, coalesce(text, '') a, coalesce({_NOTE}, text, '') c from documents left join re using (doc_id)),
s as (select t, sum(length(a)) // 4 tokens_before, sum(length(c)) // 4 tokens_after from sq group by 1),
e as (select s.t, b.text needle from s, benchmark b), r as (select t, count(*) evidence, count(*) filter (exists (select 1 from sq where sq.t = e.t and contains(lower(c), lower(needle)))) recalled from e group by 1)
select s.t, cast(tokens_before as bigint) tokens_before, cast(tokens_after as bigint) tokens_after, evidence, recalled, cast(tokens_before - tokens_after as bigint) saved from s join r using (t)"""
)
def evidence_score(spark: SparkSession, sf: str) -> DataFrame:
    """Of every source, squeezed, which benchmark items survive."""
    before = tool_messages(spark, sf)
    after = S.squeeze(before, "t", Y.uniqueness)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return E.score(before, after, before.select("t").distinct().crossJoin(items), "t")


@query(PRUNED + ", n as (select distinct p_name as name from part where p_partkey % 3 = 0 union all select 'no such tool') select name from n where name not in (select p_name from l where decision = 'keep')")
def lost_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Tools that were wanted and aren't in the pruned list."""
    p = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_name").alias("name")).distinct()
    wanted = p.unionByName(p.sparkSession.createDataFrame([("no such tool",)], "name string"))
    return E.lost(wanted, _pruned(spark, sf).where("decision = 'keep'").select("name").distinct(), "name")




# ---- synthetic transcripts
_ROUNDS, _SEED = 60, 7
_PLANTED = _literal([(r, NEEDLES[k]) for k, r in enumerate(signal_rounds(_ROUNDS, _SEED))], "r, needle").replace(" c(", " pl(")
WATCH = f"""with i as (select unnest(range({2 * _ROUNDS})) id),
wt as (select id + 1 pos, case when id % 2 = 0 then 'assistant' else 'tool' end role, case when id % 2 = 0 then '[tool call: check ' || id // 2 || ']' when needle is not null then 'ERROR in round ' || r || ': ' || needle || chr(10)
  else repeat('status 200, all nominal, heartbeat ok' || chr(10), 40) end as content from i left join {_PLANTED} on r = id // 2
  union all select 0, 'user', 'Watch the service and tell what went wrong.' union all select {2 * _ROUNDS + 1}, 'user', 'What happened?')"""


@query(WATCH + " select cast(pos as bigint) pos, role, sha1(content) content_sha from wt")
def synthetic_watch(spark: SparkSession, sf: str) -> DataFrame:
    return monitoring(spark, _ROUNDS, _SEED).select("pos", "role", F.sha1("content").alias("content_sha"))


@query(f"select needle, 1::bigint found_in from {_PLANTED}")
def synthetic_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The planted needles in the squeezed transcript: all of them, once."""
    out = S.squeeze(monitoring(spark, _ROUNDS, _SEED), "t", lambda c: Y.boilerplate(c, "t", ["pos", "chunk_idx"]))
    needles = spark.createDataFrame([(k, n) for k, n in enumerate(NEEDLES)], "needle_id int, needle string")
    return E.needle_recall(out, needles, "pos", "content").join(needles, "needle_id").select("needle", "found_in")
