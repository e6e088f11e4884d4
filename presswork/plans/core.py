"""Queries over the core operators, each with the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import q_filled, q_lines, q_squash, q_strip, q_tokens, tokens
from ..operators import admit as A
from ..operators import chunk as C
from ..operators import dedup as D
from ..operators import policy as Y
from ..operators import prefix as X
from ..operators import squeeze as S
from .inputs import held_index, holds, messages, scratch, table, tool_messages, tool_rows, turn_gaps

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


TOOL_ROWS = "tool_rows as (select source agent, doc_id pos, source as name, coalesce(text, '') as text from documents)"
MESSAGES = "messages as (select conv_id t, turn pos, role, coalesce(text, '') as content from conversations)"


@query(f"select conv_id, turn, {q_tokens('text')} tokens from conversations")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tokens("text").alias("tokens"))


@query(f"select conv_id, count(*) n, cast(sum({q_tokens('text')}) as bigint) tokens from conversations group by 1")
def transcript_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(tokens("text")).alias("tokens"))


DEDUP = f"""with {TOOL_ROWS}, n as (select *, {q_squash('text')} nf from tool_rows),
d as (select *, case when length(text) >= 60 then substr(sha1(nf), 1, 12) end ref,
  case when length(text) >= 60 then first_value(agent) over (partition by nf order by agent, pos) end owner,
  length(text) >= 60 and row_number() over (partition by nf, length(text) >= 60 order by agent, pos) > 1 is_dup from n),
m as (select *, case when is_dup then '[shared context: identical output already in agent ''' || owner || ''' transcript — ref ' || ref || ']' else text end content from d)"""
# a normal form of 60 characters or more can't come from a shorter text, but a shorter one can
DEDUP = DEDUP.replace("first_value(agent) over (partition by nf order", "first_value(agent) over (partition by nf, length(text) >= 60 order")


@query(DEDUP + " select pos, agent, ref, owner, is_dup, sha1(content) content_sha from m")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = D.exact(tool_rows(spark, sf), ["agent", "pos"])
    return d.select("pos", "agent", "ref", "owner", "is_dup", F.sha1(D.marked(d)).alias("content_sha"))


@query(
    DEDUP
    + f""" select agent, count(*) n, cast(sum({q_tokens('content')}) as bigint) tokens_before, cast(sum(is_dup::int) as bigint) collapsed from m group by 1
  union all select null, count(*), cast(sum({q_tokens('text')}) as bigint), cast(sum(is_dup::int) as bigint) from m"""
)
def fleet_report(spark: SparkSession, sf: str) -> DataFrame:
    d = D.exact(tool_rows(spark, sf), ["agent", "pos"])
    return D.report(d.withColumn("content", D.marked(d)))


@query()
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return D.near_pairs(tool_rows(spark, sf), "pos", folder=scratch(spark))


@query()
def near_dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy representatives in key order."""
    return D.near_clusters(near_dup_pairs(spark, sf), scratch(spark))


@query(
    """with f as (select doc_id, source, string_split(text, chr(10)) ls, lead(string_split(text, chr(10))) over (partition by source order by doc_id) nx from documents),
g as (select doc_id, list_filter(case when nx[-1] = '' then nx[:-2] else nx end, lambda x: not list_contains(case when ls[-1] = '' then ls[:-2] else ls end, x)) d from f where nx is not null)
select doc_id, substr(array_to_string(d, chr(10)), 1, 4000) diff from g"""
)
def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the next one of its source."""
    return D.with_next(tool_rows(spark, sf)).select(F.col("pos").alias("doc_id"), D.differing(F.col("text"), F.col("nx")).alias("diff"))


_NL = "list_filter(list_transform(string_split(text, chr(10)), lambda l: " + q_strip("l") + "), lambda l: l <> '')"
GATE = f"""with {TOOL_ROWS}, a as (select *, {_NL} ls, (contains(lower(name), 'error') or {P.SIGNAL.sql('substr(text, 1, 4000)')}) e from tool_rows),
b as (select *, case when e or length(text) <= 2000 then 'keep_full' when {P.SIGNAL.sql('text')} then 'trim' when 2 * len(list_distinct(ls)) < greatest(1, len(ls)) then 'notice' else 'trim' end decision,
  case when e or length(text) <= 2000 then 1.0 when {P.SIGNAL.sql('text')} then 0.9 when 2 * len(list_distinct(ls)) < greatest(1, len(ls)) then 0.85 else 0.8 end::double confidence from a),
r as (select pos, row_number() over (partition by name order by pos) seq, printf('⟦held:%s/%04d⟧', name, row_number() over (partition by name order by pos)) ref from b where decision <> 'keep_full'),
l as (select b.*, ref, seq, case when string_split(text, chr(10))[-1] = '' then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end al from b left join r using (pos)),
t as (select *, array_to_string(list_concat(list_concat(al[:8], ['[... ' || (len(al) - least(8, len(al)) - case when len(al) > 16 then 8 else 0 end) || ' lines held verbatim under ' || ref || ' ...]']), case when len(al) > 16 then al[-8:] else [] end), chr(10)) ex from l),
g as (select *, case decision when 'keep_full' then text when 'trim' then ex when 'notice' then '[boilerplate held: ' || length(text) || ' chars under ' || ref || ']' else ref end admitted from t)"""


def _admitted(spark: SparkSession, sf: str) -> DataFrame:
    return A.admit(tool_rows(spark, sf), folder=scratch(spark))


@query(GATE + " select pos, name, decision, confidence, ref, sha1(admitted) admitted_sha, case when ref is null then 0 else length(text) - length(admitted) end held_chars from g")
def admit_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _admitted(spark, sf).select("pos", "name", "decision", "confidence", "ref", F.sha1("admitted").alias("admitted_sha"), "held_chars")


@query(
    GATE
    + """ select count(*) filter (decision = 'keep_full') keep_full, count(*) filter (decision = 'trim') trim, count(*) filter (decision = 'notice') notice, count(*) filter (decision = 'hold') hold,
  cast(sum(length(text)) as bigint) chars_in, cast(sum(length(admitted)) as bigint) chars_out, cast(sum(case when ref is null then 0 else length(text) - length(admitted) end) as bigint) held_chars from g"""
)
def admit_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.stats(_admitted(spark, sf))


@query(GATE + " select pos, admitted excerpt from g where decision = 'trim'")
def trim_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return _admitted(spark, sf).where("decision = 'trim'").select("pos", F.col("admitted").alias("excerpt"))


@query(GATE + " select name, seq, ref, pos, length(text) chars from g where ref is not null")
def hold_refs(spark: SparkSession, sf: str) -> DataFrame:
    return held_index(spark, sf).select("name", "seq", "ref", "pos", "chars")


@query(GATE + " select pos, ref, sha1(text) held_sha from g where ref is not null")
def readmit_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that name each reference twice and one that doesn't exist."""
    h = holds(spark, sf)
    said = h.select("pos", F.concat(F.lit("see "), "ref", F.lit(" and "), "ref", F.lit(" or ⟦held:none/9999⟧")).alias("said"))
    return A.readmit_mentioned(said, "pos", "said", h, A.ANY_REF).select("pos", "ref", F.sha1("held_text").alias("held_sha"))


ANNOTATED = (
    GATE
    + """, k as (select pos, name, decision, length(text) n, substr(sha1(left(text, 200)), 1, 16) hh, substr(sha1(right(text, 200)), 1, 16) th from g),
s as (select name, n, hh, th, arg_min(decision, pos) sd from k group by all), f as (select name, n, arg_min(decision, pos) fd from k group by all)"""
)


@query(
    ANNOTATED
    + """ select k.pos, coalesce(sd, fd) decision, sd is not null strict, case coalesce(sd, fd) when 'keep_full' then 1.0 when 'trim' then 0.5 when 'notice' then 0.0 when 'hold' then 0.0 else 0.5 end::double p
  from k left join s using (name, n, hh, th) left join f using (name, n)"""
)
def annotation_priors(spark: SparkSession, sf: str) -> DataFrame:
    rows = tool_rows(spark, sf)
    log = A.decide(rows).select(F.col("pos").alias("log_pos"), "decision", *A.fingerprint(F.col("name"), F.col("text")))
    return A.match_annotations(rows, log, "pos")


PREFIX = f"with {MESSAGES}, p as (select *, {q_tokens('content')} tokens, sum({q_tokens('content')}) over (partition by t order by pos rows unbounded preceding) <= 200 protected from messages)"


@query(PREFIX + " select t, pos, tokens, protected from p")
def protected_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return X.protect(messages(spark, sf), "t", 200).select("t", "pos", "tokens", "protected")


# the squeezed transcript of the cost queries: assistant turns over 800 characters are cut
CUT = "case when role = 'assistant' and length(content) > 800 then left(content, 800) else content end"
STABLE = f"""with {MESSAGES}, b as (select *, max((content <> {CUT})::int) over (partition by t order by pos rows unbounded preceding) bad from messages),
st as (select t, cast(sum(case when bad = 0 then {q_tokens('content')} else 0 end) as bigint) stable, cast(sum({q_tokens('content')}) as bigint) total from b group by 1)"""


def _stable(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    return X.stable_prefix(m, m.withColumn("content", F.expr(CUT.replace("left(", "substring(").replace("content, 800)", "content, 1, 800)"))), "t")


@query(STABLE + " select * from st")
def stable_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _stable(spark, sf)


@query(STABLE + " select t, (stable * 0.1::double + (total - stable)) * 3.0::double / 1e6 aware, total * 3.0::double / 1e6 naive from st")
def next_turn_cost(spark: SparkSession, sf: str) -> DataFrame:
    aware, naive = X.next_turn_cost(F.col("stable"), F.col("total"))
    return _stable(spark, sf).select("t", aware.alias("aware"), naive.alias("naive"))


@query(STABLE + " select t, stable * 1.25::double * 3.0::double / 1e6 + 10 * ((stable * 0.1::double + (total - stable)) * 3.0::double / 1e6) aware, 10 * (total * 3.0::double / 1e6) naive from st")
def session_cost(spark: SparkSession, sf: str) -> DataFrame:
    aware, naive = X.session_cost(F.col("stable"), F.col("total"))
    return _stable(spark, sf).select("t", aware.alias("aware"), naive.alias("naive"))


@query(PREFIX + ", e as (select t, max(pos) filter (protected) a, max(pos) b from p group by 1) select t, a protected_end, b last_message, case when a is null or a = b then 1 else 2 end::bigint n_marks from e")
def cache_breakpoints(spark: SparkSession, sf: str) -> DataFrame:
    b = X.breakpoints(messages(spark, sf), "t", 200)
    ends = X.protect(messages(spark, sf), "t", 200).groupBy("t").agg(F.max(F.when(F.col("protected"), F.col("pos"))).alias("protected_end"))
    return b.join(ends, "t").select("t", "protected_end", F.array_max("marks").alias("last_message"), F.size("marks").cast("long").alias("n_marks"))


@query("select conv_id t, turn pos, case when max(turn) over (partition by conv_id) = turn then text end marked_text from conversations")
def cache_control(spark: SparkSession, sf: str) -> DataFrame:
    """Marks on the last text block of the breakpoint messages."""
    m = messages(spark, sf).join(X.breakpoints(messages(spark, sf), "t", 0), "t")
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("").alias("text")))
    out = m.withColumn("b", X.cache_marks(blocks, F.array_contains("marks", F.col("pos"))))
    return out.select("t", "pos", F.get(F.transform(F.filter("b", lambda x: x["cache_control"].isNotNull()), lambda x: x["text"]), F.lit(0)).alias("marked_text"))


TTL = """with g as (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6::double gap from events),
m as (select user_id, count(*) n, cast(sum((gap is null or greatest(0, gap) > 300)::int) as bigint) miss_5min, cast(sum((gap is null or greatest(0, gap) > 3600)::int) as bigint) miss_1hour from g group by 1),
c as (select *, (miss_5min * 250000.0::double + (n - miss_5min) * 20000.0::double + n * 2000.0::double) * 3.0::double / 1e6 cost_5min, (miss_1hour * 400000.0::double + (n - miss_1hour) * 20000.0::double + n * 2000.0::double) * 3.0::double / 1e6 cost_1hour from m)"""


@query(TTL + " select user_id, n, miss_5min, cost_5min, miss_1hour, cost_1hour from c")
def ttl_simulation(spark: SparkSession, sf: str) -> DataFrame:
    return X.ttl(turn_gaps(spark, sf), "user_id", 200_000, 2_000)


@query(TTL + " select user_id, case when round(cost_1hour, 6) < round(cost_5min, 6) then '1hour' else '5min' end ttl from c")
def ttl_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return X.recommend(ttl_simulation(spark, sf)).select("user_id", "ttl")


def fold_sql(text: str, size: str) -> str:
    """The line fold in DuckDB: every list element is a state, as its reduce wants."""
    state = "{'out': []::struct(t varchar, h boolean)[], 'cur': l, 'n': 0::bigint}"
    seg = f"(case when length(x.cur) > {size} then (length(x.cur) - 1) // {size} else 0 end)"
    flush = "(case when a.n > 0 then list_append(a.out, {'t': a.cur, 'h': false}) else a.out end)"
    rest = f"substr(x.cur, {seg} * {size} + 1)"
    base = f"(case when {seg} > 0 then list_concat({flush}, list_transform(range(0, {seg}), lambda k: {{'t': substr(x.cur, k * {size} + 1, {size}), 'h': true}})) else a.out end)"
    n = f"(case when {seg} > 0 then 0 else a.n end)"
    cur = f"(case when {seg} > 0 then '' else a.cur end)"
    over = f"({n} > 0 and {n} + length({rest}) + 1 > {size})"
    step = (
        f"case when not {q_filled(rest)} then {{'out': {base}, 'cur': {cur}, 'n': {n}}} "
        f"when {over} then {{'out': list_append({base}, {{'t': {cur}, 'h': false}}), 'cur': {rest}, 'n': length({rest}) + 1}} "
        f"else {{'out': {base}, 'cur': case when {n} = 0 then {rest} else {cur} || chr(10) || {rest} end, 'n': {n} + length({rest}) + 1}} end"
    )
    init = "{'out': []::struct(t varchar, h boolean)[], 'cur': '', 'n': 0::bigint}"
    done = f"list_reduce(list_transform(string_split({text}, chr(10)), lambda l: {state}), lambda a, x: {step}, {init})"
    return done


def chunk_sql(size: str) -> str:
    return f"""f as (select doc_id, {size} size, {fold_sql('text', size)} s from documents),
cs as (select doc_id, case when s.n > 0 then list_append(s.out, {{'t': s.cur, 'h': false}}) else s.out end c from f),
ch as (select doc_id, i - 1 chunk_idx, c[i].t chunk, c[i].h hard_after from (select doc_id, c, unnest(range(1, len(c) + 1)) i from cs))"""


DENSE = f"(length(text) >= 3000 and {P.ERROR_DENSE.sql('text')})"


@query(f"with {chunk_sql('1500')} select doc_id, cast(chunk_idx as int) chunk_idx, chunk, hard_after from ch")
def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(table(spark, sf, "documents"), ["doc_id"], size=1500)


@query(f"select doc_id, {DENSE} dense, case when {DENSE} then 1500 else 6000 end size from documents")
def error_density(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", C.is_error_dense("text").alias("dense"), C.chunk_size("text").alias("size"))


OVER = """, ov as (select *, case when hard_after then coalesce(substr(lead(chunk) over (partition by doc_id order by chunk_idx), 1, 100), '') else '' end x from ch)"""


@query(f"with {chunk_sql('1500')}{OVER} select doc_id, cast(chunk_idx as int) chunk_idx, chunk || x chunk, length(x) overlap_after from ov where hard_after")
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = C.with_overlap(chunk_lines(spark, sf), ["doc_id"])
    return c.where("hard_after").select("doc_id", "chunk_idx", "chunk", "overlap_after")


SLICED = """s as (select doc_id, flatten(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), lambda l: list_transform(range(0, (length(l) - 1) // 1000 + 1), lambda k: substr(l, k * 1000 + 1, 1000)))) c from documents),
sl as (select doc_id, i - 1 chunk_idx, c[i] chunk from (select doc_id, c, unnest(range(1, len(c) + 1)) i from s))"""


@query(f"with {SLICED} select doc_id, cast(chunk_idx as int) chunk_idx, chunk from sl")
def slice_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.slices(table(spark, sf, "documents"), ["doc_id"])


UNIQ = f"u as (select *, case when len({q_lines('chunk')}) > 0 and 100 * len(list_distinct({q_lines('chunk')})) < 35 * len({q_lines('chunk')}) then 0.1 else 1.0 end::double p from ch)"


@query(f"with {chunk_sql('1500')}, {UNIQ} select doc_id, cast(chunk_idx as int) chunk_idx, p from u")
def policy_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return Y.uniqueness(chunk_lines(spark, sf)).select("doc_id", "chunk_idx", "p")


BOIL = f"""ln as (select doc_id, chunk_idx, unnest({q_lines('chunk')}) l from ch),
fi as (select *, min(chunk_idx) over (partition by doc_id, l) first from ln),
ba as (select doc_id, chunk_idx, count(*) n, sum((first < chunk_idx)::int + ({P.HEARTBEAT.sql('l')} and length(l) < 200)::int) bad from fi group by 1, 2),
bo as (select ch.*, case when n is null or 10 * bad >= 6 * n then 0.0 else 1.0 end::double p from ch left join ba using (doc_id, chunk_idx))"""


@query(f"with {chunk_sql('1500')}, {BOIL} select doc_id, cast(chunk_idx as int) chunk_idx, p from bo")
def policy_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return Y.boilerplate(chunk_lines(spark, sf), "doc_id", ["chunk_idx"]).select("doc_id", "chunk_idx", "p")


EVID = "ev as (select *, case when exists (select 1 from benchmark b where contains(lower(chunk), lower(b.text))) then 0.95 else 0.05 end::double p from ch)"


@query(f"with {chunk_sql('6000')}, {EVID} select doc_id, cast(chunk_idx as int) chunk_idx, p from ev")
def policy_evidence(spark: SparkSession, sf: str) -> DataFrame:
    needles = table(spark, sf, "benchmark").select(F.col("text").alias("needle"))
    return Y.evidence(C.chunks(table(spark, sf, "documents"), ["doc_id"]), needles).select("doc_id", "chunk_idx", "p")


@query(f"with {chunk_sql('6000')} select doc_id, cast(chunk_idx as int) chunk_idx, case when len(list_filter(range(1, 7), lambda k: contains(lower(chunk), substr('entheresther', k, 7)))) > 0 then 0.95 else 0.05 end::double p from ch")
def policy_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return Y.fragments(C.chunks(table(spark, sf, "documents"), ["doc_id"]), "entheresther", 7).select("doc_id", "chunk_idx", "p")


KEEP = """k as (select *, p >= 0.5 above from {src}), kk as (select *, above or (not max(above::int) over (partition by doc_id)::boolean and row_number() over (partition by doc_id order by p desc, chunk_idx) = 1) keep from k)"""


@query(f"with {chunk_sql('1500')}, {BOIL}, {KEEP.format(src='bo')} select doc_id, cast(chunk_idx as int) chunk_idx, p, keep from kk")
def squeeze_keep(spark: SparkSession, sf: str) -> DataFrame:
    scored = Y.boilerplate(chunk_lines(spark, sf), "doc_id", ["chunk_idx"])
    return S.keep(scored, ["doc_id"]).select("doc_id", "chunk_idx", "p", "keep")


REASM = """, w as (select *, coalesce(lead(keep) over (partition by doc_id order by chunk_idx), false) nk, x from kk),
bd as (select *, case when keep then case when nk then chunk else chunk || x end end body, case when keep then row_number() over (partition by doc_id, keep order by chunk_idx desc) end r from w),
re as (select doc_id, string_agg(body || case when r = 1 then '' when hard_after then '' else chr(10) end, '' order by chunk_idx) filter (keep) body, count(*) filter (keep) n_kept, count(*) n_chunks from bd group by 1)
select doc_id, case when n_kept < n_chunks then '[squeezed: kept ' || n_kept || '/' || n_chunks || ' chunks]' || chr(10) else '' end || body as content, n_kept, n_chunks from re"""
FRAG = "fr as (select *, case when len(list_filter(range(1, 7), lambda k: contains(lower(chunk || x), substr('entheresther', k, 7)))) > 0 then 0.95 else 0.05 end::double p from ov)"


@query(f"with {chunk_sql('1500')}{OVER}, {FRAG}, {KEEP.format(src='fr')}{REASM}")
def squeeze_reassemble(spark: SparkSession, sf: str) -> DataFrame:
    """With overlap, so that both the strip rule and gaps occur."""
    cut = C.with_overlap(chunk_lines(spark, sf), ["doc_id"])
    return S.reassemble(S.keep(Y.fragments(cut, "entheresther", 7), ["doc_id"]), ["doc_id"])


@query(f"with {chunk_sql('6000')}, {UNIQ}, k as (select *, p < 0.5 above from u), kk as (select *, above or (not max(above::int) over (partition by doc_id)::boolean and row_number() over (partition by doc_id order by p, chunk_idx) = 1) keep from k) select doc_id, cast(chunk_idx as int) chunk_idx, keep from kk")
def redundancy_keep(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted rule: p says that a chunk is redundant."""
    return S.keep(Y.uniqueness(C.chunks(table(spark, sf, "documents"), ["doc_id"])), ["doc_id"], inverted=True).select("doc_id", "chunk_idx", "keep")


@query(
    f"""with {SLICED}, sc as (select sl.*, source, (length(chunk) % 7)::double / 7 p from sl join documents using (doc_id)),
t as (select *, row_number() over (partition by source order by p desc, doc_id, chunk_idx) <= greatest(1, floor(count(*) over (partition by source) * 0.25)) top from sc)
select doc_id, cast(chunk_idx as int) chunk_idx, top or (not max(top::int) over (partition by doc_id)::boolean and row_number() over (partition by doc_id order by p desc, chunk_idx) = 1) keep from t"""
)
def rank_keep(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = C.slices(docs, ["source", "doc_id"]).withColumn("p", (F.length("chunk") % 7).cast("double") / 7)
    return S.keep_top(scored, ["source"], ["doc_id", "chunk_idx"], ["doc_id"]).select("doc_id", "chunk_idx", "keep")


_RE = REASM.split("select doc_id, case when n_kept")[0]
TIER = f"case when {DENSE} then 1500 else 6000 end"


@query(
    f"with {chunk_sql(TIER)}, {BOIL}, {KEEP.format(src='bo').replace('select *, p >=', 'select *, chr(0) x, p >=')}{_RE.replace('chunk || x', 'chunk')}, "
    + f"""sq as (select doc_id, source, text, coalesce(case when n_kept < n_chunks then '[squeezed: kept ' || n_kept || '/' || n_chunks || ' chunks]' || chr(10) else '' end || body, text) as content, coalesce(n_chunks, 0) judged from documents left join re using (doc_id))
select source t, cast(sum({q_tokens('text')}) as bigint) tokens_before, cast(sum({q_tokens('content')}) as bigint) tokens_after, cast(sum(judged) as bigint) judged, cast(sum({q_tokens('text')}) - sum({q_tokens('content')}) as bigint) saved from sq group by 1"""
)
def squeeze_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole transcripts (one per source), two tiers of chunk size; boilerplate is told within a document."""
    m = tool_messages(spark, sf)
    policy = lambda chunked: Y.boilerplate(chunked.withColumn("_d", F.col("pos")), "_d", ["chunk_idx"]).drop("_d")
    return S.squeeze_stats(m, S.squeeze(m, "t", policy), "t")
