"""Readers, sinks and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from presswork.sources import readers, sinks
from presswork.streaming import gate


def test_openai_and_fleet(spark, tmp_path):
    msgs = [{"role": "user", "content": "hi"}, {"role": "function", "content": None}, {"role": "critic", "content": "x"}, {"role": "tool", "name": "b", "content": "out"}]
    (tmp_path / "a.json").write_text(json.dumps({"messages": msgs}))
    got = [tuple(r)[1:] for r in readers.any_transcript(spark, str(tmp_path / "a.json")).orderBy("pos").collect()]
    assert got == [(0, "user", "", "hi"), (1, "tool", "tool", "None"), (3, "tool", "b", "out")]
    (tmp_path / "f.json").write_text(json.dumps({"transcripts": {"z": msgs[:1], "y": {"messages": msgs[3:]}}}))
    got = {(r["agent_id"], r["agent_ord"], r["content"]) for r in readers.fleet(spark, str(tmp_path / "f.json")).collect()}
    assert got == {("z", 0, "hi"), ("y", 1, "out")}
    assert "agent_ord" in readers.any_transcript(spark, str(tmp_path / "f.json")).columns


def test_claude_jsonl(spark, tmp_path):
    rows = [
        {"type": "user", "message": {"role": "user", "content": "do it"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "ls", "input": {"a": 1}}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}},
        {"type": "user", "message": {"role": "user", "content": " "}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(rows[0]), "{bad", *map(json.dumps, rows[1:])]))
    got = [(r["role"], r["content"]) for r in readers.any_transcript(spark, str(tmp_path / "s.jsonl")).orderBy("pos").collect()]
    assert got == [("user", "do it"), ("assistant", "ok"), ("assistant", '[tool call: ls {"a":1}]'), ("tool", "x\ny")]


def test_logs_lists_needles(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"name": "", "text": "t"}\n\n{"name": "b"}\n')
    assert [tuple(r) for r in readers.tool_log(spark, str(tmp_path / "log.jsonl")).orderBy("pos").collect()] == [(0, "tool", "t"), (2, "b", "")]
    (tmp_path / "t.json").write_text(json.dumps({"tools": [{"name": "n", "description": "d", "input_schema": {"properties": {"p": {}, "q": {}}}}, {"name": "m"}]}))
    got = readers.tool_list(spark, str(tmp_path / "t.json")).orderBy("pos").collect()
    assert [r["name"] for r in got] == ["n", "m"] and sorted(got[0]["properties"]) == ["p", "q"] and got[1]["properties"] == []
    (tmp_path / "n.txt").write_text(" a \n\nb\n")
    assert [r["needle"] for r in readers.needles(spark, str(tmp_path / "n.txt")).collect()] == ["a", "b"]
    assert readers.annotations(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_holds_and_decisions(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0, "one"), ("b", 1, "two")], "name string, pos int, text string")
    path = str(tmp_path / "holds")
    sinks.append_holds(spark, rows, path)
    sinks.append_holds(spark, rows.limit(1), path)
    assert {r["ref"] for r in sinks.load_holds(spark, path).collect()} == {"⟦held:b/0001⟧", "⟦held:b/0002⟧", "⟦held:b/0003⟧"}
    d = spark.createDataFrame([("k", 1, 0.9, 1.0), ("k", 0, 0.1, 2.0)], "key string, keep int, p double, ts double")
    sinks.append_decisions(d, str(tmp_path / "d"))
    keys = spark.createDataFrame([("k",), ("m",)], "key string")
    told = readers.cached(keys, spark.read.parquet(str(tmp_path / "d")))
    assert tuple(readers.cache_counts(told).first()) == (1, 1) and told.where("keep = 0").count() == 1
    sinks.append_annotations(rows.withColumn("decision", F.lit("trim")).withColumn("ref", F.lit("r")), str(tmp_path / "a"), "s")
    assert readers.annotations(spark, str(tmp_path / "a"), "s").count() == 2 and readers.annotations(spark, str(tmp_path / "a"), "t").count() == 0


def test_holds_of_a_repeated_batch(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0, "one"), ("b", 1, "two")], "name string, pos int, text string")
    path = str(tmp_path / "h")
    sinks.append_holds(spark, rows, path)
    for batch in (0, 1, 1, 0):
        new = sinks.append_holds(spark, rows, path, batch).orderBy("pos").collect()
        assert [r["seq"] for r in new] == [3 + 2 * batch, 4 + 2 * batch]
    assert sorted(r["seq"] for r in sinks.load_holds(spark, path).collect()) == [1, 2, 3, 4, 5, 6]


def test_event_stream(spark, tmp_path):
    events = [
        {"type": "system"}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "1", "name": "ls", "input": {"d": "/", "n": 2}}, {"type": "text", "text": "b"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y"}]}, {"type": "text", "text": ""}, {"type": "doc", "content": "in"}]}},
        {"type": "assistant", "message": {"content": []}}, {"type": "user", "message": {"content": "bare"}},
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, events)))
    got = readers.stream_json(spark, str(tmp_path / "e.jsonl")).orderBy("pos").collect()
    assert [(r["role"], r["content"], r["tool_call_id"]) for r in got] == [("assistant", "a\nb", None), ("tool", "x\ny", "1"), ("user", "in", None), ("assistant", None, None), ("user", "bare", None)]
    assert [(c["id"], c["name"], c["arguments"]) for c in got[0]["tool_calls"]] == [("1", "ls", {"d": "/", "n": "2"})] and got[3]["tool_calls"] is None


def test_memory_streams_decide_as_batches(spark, tmp_path):
    from presswork.operators import support, voice

    say = "i would like to book a table for four people on friday evening please"
    turns = [("c", 0, "user", say), ("c", 1, "user", "so " + say), ("d", 0, "user", say), ("c", 2, "agent", "mm hmm okay"), ("c", 3, "agent", "Just to confirm, what was the phone number"), ("d", 1, "agent", None)]
    turns += [("e", i, "agent", t) for i, t in enumerate(["Please confirm your account number before we go on", "Your order number A-12345 has shipped today", "Please confirm your account number before we go on", "n" * 601, "Hello", "k" * 50, "k" * 50])]
    src = str(tmp_path / "turns")
    schema = "c string, pos long, role string, text string"
    # turn after turn, each a batch
    for pos in range(7):
        spark.createDataFrame([t for t in turns if t[1] == pos], schema).coalesce(1).write.mode("append").parquet(src)
    df = spark.createDataFrame(turns, schema)
    live = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for name, stream, batch in (("v", gate.voice_memory(live(), "c", "pos"), voice.judge(df, "c", "pos").withColumnRenamed("conv", "c")), ("s", gate.support_memory(live(), "c", "pos"), support.judge(df, "c", "pos"))):
        q = stream.writeStream.format("memory").queryName("memory_" + name).outputMode("append").option("checkpointLocation", str(tmp_path / ("ck" + name))).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = lambda d: sorted((r["c"], r["pos"], r["decision"], r["excerpt"] or "") for r in d.collect())
        assert rows(spark.table("memory_" + name)) == rows(batch)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("b", 0, "short"), ("b", 1, "x y\n" * 2000)], "name string, pos int, text string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("name string, pos int, text string").parquet(src)
    gate.write_gate(stream(), str(tmp_path / "h"), str(tmp_path / "adm"), str(tmp_path / "ck")).awaitTermination()
    got = {r["pos"]: r["decision"] for r in spark.read.parquet(str(tmp_path / "adm")).collect()}
    assert got == {0: "keep_full", 1: "notice"} and sinks.load_holds(spark, str(tmp_path / "h")).count() == 1

    ev = spark.createDataFrame([(1, 0), (1, 299), (1, 600), (2, 0)], "user_id int, s int").select("user_id", F.timestamp_seconds("s").alias("ts"), F.lit("a  b").alias("text"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema("user_id int, ts timestamp, text string").parquet(str(tmp_path / "ev"))
    for name, df, n in (("first", gate.first_wins(live), 1), ("sess", gate.cache_sessions(live), 3)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "first" else "complete").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
