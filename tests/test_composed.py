"""Compositions on edge rows: prefixes and tails, fleets, transcripts in both forms, holds and recalls, tool definitions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from presswork.functions import tables
from presswork.functions import text as X
from presswork.functions.patterns import METRIC, SIGNAL, Pattern
from presswork.operators import admit, context, dedup, evaluate, pipeline, policy, prefix, squeeze, support, tools, voice
from presswork.sources.synthetic import monitoring, repeated_tools

MESSAGES = "t string, pos int, role string, name string, content string"


def test_cache_aware_keeps_the_prefix_and_squeezes_the_tail(spark):
    noise = "ok\n" * 900
    rows = [("t", 0, "system", "", "s" * 400), ("t", 1, "tool", "b", noise), ("t", 2, "user", "", "q"), ("t", 3, "tool", "b", noise + "x\n" + noise), ("u", 0, "tool", "b", noise)]
    m = spark.createDataFrame(rows, MESSAGES)
    drop = lambda c: c.withColumn("p", F.when(F.col("chunk_idx") == 0, 0.9).otherwise(0.1))
    for budget, kept in ((0, 0), (99, 0), (100, 1), (100 + 675, 2), (10_000, 4)):
        out = {(r["t"], r["pos"]): r for r in squeeze.cache_aware(m, "t", drop, budget, two_tier=False).collect()}
        assert sum(r["protected"] for k, r in out.items() if k[0] == "t") == kept and len(out) == 5
        assert all(out[k]["content"] == c for *k, _, _, c in [(t, p, r, n, c) for t, p, r, n, c in rows] for k in [tuple(k[:2])] if out[k]["protected"])
    s = squeeze.cache_aware_stats(squeeze.cache_aware(m, "t", drop, 100, two_tier=False), "t").where("t = 't'").first()
    assert s["protected_tokens"] == 100 and s["tokens_before"] == s["tokens_after"] + s["tokens_before"] - s["protected_tokens"] - s["dynamic_tokens_after"]


def test_verbatim_and_first_form(spark):
    m = spark.createDataFrame([("t", 0, "tool", "b", "a\n\nb\n")], MESSAGES)
    keep = lambda c: c.withColumn("p", F.lit(1.0))
    assert squeeze.squeeze(m, "t", keep).first()["content"] == "a\nb"
    assert squeeze.squeeze(m, "t", keep, verbatim=True).first()["content"] == "a\n\nb\n"
    assert squeeze.squeeze(m, "t", keep, first_form=True).first()["content"] == "[compressed: kept 1/1 chunks]\na\nb"


def test_synthetic_watch_keeps_its_needles(spark):
    m = monitoring(spark)
    out = squeeze.squeeze(m, "t", lambda c: policy.boilerplate(c, "t", ["pos", "chunk_idx"]))
    s = squeeze.squeeze_stats(m, out, "t").first()
    assert s["tokens_after"] < s["tokens_before"] and out.where("content like '%pool exhausted%'").count() == 1


def test_fleet_and_near_collapse_on_repeated_tools(spark):
    rows = repeated_tools(spark)
    out = dedup.fleet_squeeze(rows, ["agent", "pos"], lambda c: c.withColumn("p", F.lit(1.0)))
    assert out.where("is_dup").count() == 8  # 9 equal dumps
    per = {r["agent"]: r for r in dedup.fleet_squeeze_report(out).collect()}
    assert per[None]["tokens_before"] > 5 * per[None]["tokens_after"] / 3 and per[None]["tokens_after"] == sum(r["tokens_after"] for a, r in per.items() if a)
    aware = dedup.fleet_squeeze(rows, ["agent", "pos"], lambda c: c.withColumn("p", F.lit(0.0)), protect=10_000)
    assert aware.select("agent", "pos", "content").exceptAll(out.select("agent", "pos", "content")).count() == 0


def blocks(spark, messages):
    d = spark.createDataFrame([("t", i, role, json.dumps(c)) for i, (role, c) in enumerate(messages)], "t string, pos int, role string, c string")
    return context.api_blocks(d.select("t", "pos", "role", F.parse_json("c").alias("content")), "t")


def test_api_blocks_turns_and_pairs(spark):
    b = blocks(spark, [
        ("system", "be good"), ("user", None), ("assistant", [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": " a "}, "b ", "", {"type": "text", "text": ""}, {"type": "tool_use", "id": "1", "name": "ls", "input": {"path": "/"}}, 7]),
        ("user", [{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "x"}, {"type": "other", "content": {"type": "text", "text": "y"}}], "is_error": True}, {"type": "tool_result", "tool_use_id": "9", "content": "lone"}]),
        ("user", [{"type": "tool_result", "tool_use_id": "1", "content": "late"}]), ("assistant", [{"type": "tool_use", "id": "9", "name": "cat"}, {"type": "tool_use", "id": "2", "name": "wc", "input": None}]), ("user", {"type": "text", "text": "one"}),
    ])
    turns = context.api_turns(b, "t").orderBy("turn_id").collect()
    assert [(r["role"], r["text"]) for r in turns] == [("user", "be good"), ("user", ""), ("assistant", "a\nb"), ("user", ""), ("user", ""), ("assistant", ""), ("user", "one")]
    p = {r["id"]: r for r in context.api_pairs(b, "t").collect()}
    assert set(p) == {"1", "9", "2"}
    assert (p["1"]["name"], p["1"]["result"], p["1"]["is_error"], p["1"]["use_turn"], p["1"]["result_turn"], p["1"]["orphan"]) == ("ls", "late", False, 2, 4, False)
    assert (p["9"]["name"], p["9"]["result"], p["9"]["use_turn"], p["9"]["orphan"]) == ("", "lone", 5, True)
    assert not p["2"]["has_result"] and p["2"]["input"] == {}
    units = context.tool_units(context.api_pairs(b, "t"), "t").orderBy("unit").collect()
    assert [r["id"] for r in units] == ["1", "9", "2"]


CALLS = "t string, pos int, role string, name string, content string, tool_call_id string, tool_calls array<struct<id: string, name: string, arguments: map<string, string>>>"


def test_bench_pairs_with_repeated_ids_and_reassembly(spark):
    call = lambda i, n, **a: (i, n, a)
    rows = [
        ("t", 0, "user", "", "do it", None, None), ("t", 1, "assistant", "", "x" * 900, None, [call("1", "Read", path="f"), call("1", "Read", path="g"), call("2", "Bash", command="c")]),
        ("t", 2, "tool", "r", "old", "1", None), ("t", 3, "tool", "r", "new", "1", None), ("t", 4, "tool", "odd", "error: no", "7", None), ("t", 5, "system", "", "s", None, None),
        ("t", 6, "tool", "even", "alone", "2", None), ("t", 7, "assistant", "", "y" * 900, None, None), ("t", 8, "assistant", "", "z", None, None), ("t", 9, "user", "", "bye", None, None),
    ]
    m = context.merge_turns(spark.createDataFrame(rows, CALLS), "t")
    p = context.bench_pairs(m, "t").orderBy("turn_id", "k").collect()
    assert [(r["turn_id"], r["id"], r["name"], r["result"], r["is_error"], r["orphan"]) for r in p] == [
        (1, "1", "Read", None, False, False), (1, "1", "Read", "new", False, False), (1, "2", "Bash", None, False, False), (1, "7", "odd", "error: no", True, True), (2, "2", "even", "alone", False, True)]
    pairs = context.later_success(context.stale(context.bench_pairs(m, "t"), "t"), "t")
    done = context.judge_pairs(pairs, "t", lambda body: F.lit(0.1))
    assert [r["decision"] for r in done.orderBy("turn_id", "k").collect()] == ["open", "note", "open", "fail_safe", "note"]
    assert {r["decision"] for r in context.judge_pairs(pairs, "t", lambda body: F.lit(None).cast("double")).collect()} == {"open", "keep", "fail_safe"}
    turns = context.bench_turns(m, "t")
    texts = context.decide_texts(turns.withColumn("p", F.lit(0.1)).withColumn("has_error", F.col("turn_id") == 1), "t")
    out = context.reassemble(m, done, texts, "t").orderBy("pos").collect()
    # the first of equal ids has no replacement; the dropped text of turn 3 goes with its message, an unresolved error keeps turn 1's
    assert [(r["pos"], r["content"]) for r in out if r["role"] == "tool"] == [(2, "old"), (3, "new"), (4, "error: no"), (6, "[even even: ok]")]
    assert [r["pos"] for r in out if r["role"] == "assistant"] == [1, 8]
    told = context.judge_in_order(turns, pairs, "t", lambda text, ledger, future: 0.1).collect()
    want = {(r["turn_id"], r["k"]): r["decision"] for r in done.collect()} | {(r["turn_id"], None): r["decision"] for r in texts.collect()}
    assert {(r["turn_id"], r["k"]): r["decision"] for r in told} == want


def test_windows_and_protected_turns(spark):
    d = spark.createDataFrame([(0, None), (1, " \n"), (2, "a" * 9)], "k int, x string")
    got = [(r["k"], r["window"], r["body"]) for r in context.windows(d, ["k"], "x", 4).orderBy("k", "window").collect()]
    assert got == [(0, 0, ""), (1, 0, ""), (2, 0, "aaaa"), (2, 1, "aaaa"), (2, 2, "a")]
    m = context.merge_turns(spark.createDataFrame([("t", 0, "user", "", 'é"\n😀'), ("t", 1, "tool", "b", "x")], MESSAGES), "t")
    own = sum(len(json.dumps({"role": r, "name": n, "content": c})) for r, n, c in (("user", "", 'é"\n😀'), ("tool", "b", "x")))
    for chars, kept in ((own - 1, False), (own, True)):
        r = prefix.protect_turns(m, "t", chars).first()
        assert r["chars"] == own and r["protected"] == kept


def test_readmit(spark):
    h = spark.createDataFrame([("⟦held:b/0001⟧", "text")], "ref string, text string")
    asked = spark.createDataFrame([("⟦held:b/0001⟧",), ("⟦held:b/0002⟧",)], "ref string")
    assert {r["ref"][-5:-1]: (r["known"], r["held_text"]) for r in admit.readmit(asked, h).collect()} == {"0001": (True, "text"), "0002": (False, None)}
    with pytest.raises(Exception, match="unknown reference"):
        admit.readmit(asked, h, strict=True).collect()


def test_domain_runs_hold_what_they_cut(spark):
    long = "nothing of note here " * 40
    t = spark.createDataFrame([("a", 0, "agent", long), ("a", 1, "agent", long), ("b", 0, "agent", None), ("b", 1, "agent", "Your order number A-12345 has shipped\n" + long)], "c string, pos int, role string, text string")
    s = support.squeeze(t, "c", "pos").orderBy("c", "pos").collect()
    assert [r["ref"] for r in s] == ["⟦held:support:notice/0001⟧", "⟦held:support:notice/0002⟧", None, "⟦held:support:keep_excerpt/0001⟧"]
    assert s[3]["out"].endswith(" [held: ⟦held:support:keep_excerpt/0001⟧]") and s[2]["out"] == "[empty turn]"
    st = {r["c"]: r for r in support.stats(support.squeeze(t, "c", "pos"), "c").collect()}
    assert st["a"]["held"] == 2 and st["a"]["notice"] == 2 and st["a"]["chars_in"] == 2 * len(long) and st["a"]["tokens_in"] == (2 * len(long) + 1) // 4
    held = admit.held_texts(support.squeeze(t, "c", "pos"), ["c"])
    back = admit.readmit(held.select("c", "ref"), held, ["c"], strict=True)
    assert {r["held_text"] for r in back.collect()} == {long, "Your order number A-12345 has shipped\n" + long}
    v = voice.squeeze(t, "c", "pos").collect()
    assert len(v) == 4 and all((r["ref"] is None) == (r["decision"] == "keep_full" or len(r["text"] or "") <= 100) for r in v)
    p = pipeline.squeeze(t.withColumn("name", F.lit("s")).withColumn("text", F.coalesce("text", F.lit(""))), "c", "pos").orderBy("c", "pos").collect()
    assert p[0]["out"].endswith("\n[held:⟦held:s/0001⟧]") and p[1]["ref"] == "⟦held:s/0002⟧" and p[2]["ref"] is None


def test_tool_definitions(spark):
    schema = {"type": "object", "required": ["b"], "properties": {"b": {"type": "string", "description": 'say "é"\n'}, "a": {"items": [1, 2.5, None, True, {"z": 1, "y": []}]}}}
    d = spark.createDataFrame([("n", "d", json.dumps(schema)), ("m", None, None)], "name string, description string, s string")
    got = [r[0] for r in d.select(tools.definition(F.col("name"), F.col("description"), F.col("s"))).collect()]
    assert got == ["n\nd\n" + json.dumps(schema, sort_keys=True, ensure_ascii=False), "m\n\n{}"]
    defs = spark.createDataFrame([(0, "git", "version control", "{}"), (1, "weather", "with rain", '{"properties": {"town": {}}}'), (2, "weather", "with snow", "{}"), (3, "", "x", "{}")], "pos int, name string, description string, input_schema string")
    p = tools.prune(defs, "open a PR")
    assert {r["pos"]: r["ref"] for r in p.collect()} == {0: None, 1: "⟦held:weather/0001⟧", 2: "⟦held:weather/0002⟧", 3: "⟦held:unnamed/0001⟧"}
    names = spark.createDataFrame([("weather",), ("git",)], "name string")
    r = {x["name"]: x for x in tools.readmit(names, p).collect()}
    assert r["weather"]["description"] == "with snow" and r["weather"]["input_schema"] == "{}" and not r["git"]["known"]
    with pytest.raises(Exception, match="unknown tool"):
        tools.readmit(names, p, strict=True).collect()
    by = {x["pos"]: x for x in tools.ledger(p).collect()}
    assert by[0]["decision"] == "keep" and by[1]["reason"] == "no task signal (0 keyword hits)"
    used = spark.createDataFrame([("s", 1, "Agent"), ("s", 1, "Task"), ("s", 2, "")], "t string, turn_id int, name string")
    assert [tuple(x) for x in tools.used_tools(used, "t").collect()] == [("s", 1, "Task")]


def test_two_questions(spark):
    d = spark.createDataFrame([(0.1, 0.9), (0.3, 0.9), (0.7, 0.6), (0.7, 0.5), (None, 0.9)], "r double, q double")
    assert [x[0] for x in d.select(admit.two_questions(F.col("r"), F.col("q"))[0]).collect()] == ["hold", "notice", "trim", "keep_full", "keep_full"]


def test_benches_run_and_fail():
    got = evaluate.run_benches({"b": lambda: 1 / 0, "a": lambda: "x\ny\nz\nlast", "c": lambda: None})
    assert [(n, ok) for n, ok, *_ in got] == [("a", True), ("b", False), ("c", True)] and got[0][3] == "y\nz\nlast" and "ZeroDivisionError" in got[1][3]


def test_literals_of_patterns():
    assert Pattern(["a(?:bc|bd)+e?", "xy?z"]).needs is None  # "xy?z" has none of two letters
    assert Pattern(["foo(?:bar|bazz)?", "(?:one|three)~+2"]).needs == ["foo", "one", "three"]
    assert METRIC.needs and SIGNAL.needs


def test_patterns_are_the_same_with_and_without_their_literals(spark):
    from presswork.functions import patterns as P

    words = ["ERROR", "Fſailed", "rowſ inserted: 5", "K", "İnt x", "create  table", "thanks", "account #1234", "md5: abcdef12", "ok", "NULL", "date of birth 1", "ſcheduled", "heartbeat", "drwx", "plain"]
    d = spark.createDataFrame([(w,) for w in words], "x string")
    for name, p in vars(P).items():
        if isinstance(p, Pattern) and p.needs:
            got = d.select(p(F.col("x")).alias("a"), F.col("x").rlike(p.java).alias("b")).collect()
            assert [r["a"] for r in got] == [r["b"] for r in got], name


def test_tables(spark, tmp_path):
    d = spark.range(10).coalesce(1)
    assert tables.spread(d)._jdf.queryExecution().toRdd().getNumPartitions() == 4 and tables.spread(d.repartition(9)) is not None
    w = tables.written(d, str(tmp_path))
    assert w.count() == 10 and len(list(tmp_path.iterdir())) == 1
    tables.drop(w)
    assert not list(tmp_path.iterdir())
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 500).alias("k"), "id")
    told = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("id").alias("m"))
    got = tables.beside(rows, told, ["k"])
    assert got.count() == 3000 and got.columns == ["k", "id", "m"] and got.where("m is null").isEmpty()
    assert X.filled(F.lit(" ")) is not None
