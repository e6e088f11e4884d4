"""Online forms: the write-time gate, first-wins dedup within a horizon, and sessions by gap."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.text import squash
from ..operators import admit as A
from ..operators import support, voice
from ..sources import sinks


def decide(stream: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Decisions need no state."""
    return A.decide(stream, name, text)


def write_gate(stream: DataFrame, holds: str, admissions: str, checkpoint: str) -> StreamingQuery:
    """Gate each micro-batch of (name, pos, text): held texts are numbered on from what earlier batches hold, admissions
    are written next to them. Both have a folder for each batch number, so a repeated batch overwrites its own."""

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        told = A.decide(batch).persist()
        try:
            kept = told.where("decision <> 'keep_full'")
            refs = sinks.append_holds(spark, kept.select("name", "pos", "text"), holds, number).select("name", "pos", "ref")
            out = told.join(refs, ["name", "pos"], "left")
            out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{admissions}/batch={number}")
        finally:
            told.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _in_order(first: Callable[[], object], step: Callable[[object, object], tuple], forget: int) -> Callable:
    """A stateful function that takes a key's rows in order of ``pos``; the state is what ``step`` remembers, as JSON, and goes ``forget`` milliseconds after the key's last row."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = json.loads(state.get[0]) if state.exists else first()
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for r in rows.itertuples(index=False):
            known, decision, excerpt = step(known, r)
            out.append((r.key, int(r.pos), decision, excerpt))
        state.update((json.dumps(known),))
        state.setTimeoutDuration(forget)
        yield pd.DataFrame(out, columns=["key", "pos", "decision", "excerpt"])

    return run


def _remember(stream: DataFrame, conversation: str, step: Callable, first: Callable[[], object], forget: int) -> DataFrame:
    kind = dict(stream.dtypes)["key"]
    out = stream.groupBy("key").applyInPandasWithState(
        _in_order(first, step, forget), f"key {kind}, pos long, decision string, excerpt string", "known string", "append", "ProcessingTimeTimeout"
    )
    return out.withColumnRenamed("key", conversation)


def voice_memory(stream: DataFrame, conversation: str, order: str, text: str = "text", role: str = "role", forget: int = 3_600_000, **barge: str) -> DataFrame:
    """Voice decisions as turns come in; the memory of a conversation is its kept turns. Equal to the batch rule if its turns come in order and with no longer gap than ``forget``."""
    d = voice.local(stream, text, role, **barge).select(
        F.col(conversation).alias("key"), F.col(order).cast("long").alias("pos"), F.coalesce(F.col(text), F.lit("")).alias("text"), "early", "confirms", "commits", "fact_lines", "norm", "cut_in", "spoken"
    )
    return _remember(d, conversation, voice.step, list, forget)


def support_memory(stream: DataFrame, thread: str, order: str, text: str = "text", forget: int = 3_600_000) -> DataFrame:
    """Support decisions as turns come in; the memory of a thread is the digests of the turns it has seen and whether a fact was established."""
    d = support.local(stream, text).select(F.col(thread).alias("key"), F.col(order).cast("long").alias("pos"), F.coalesce(F.col(text), F.lit("")).alias("text"), "early", "again", "facts", "digest")
    return _remember(d, thread, support.step, lambda: {"seen": [], "known": False}, forget)


def first_wins(stream: DataFrame, time: str = "ts", text: str = "text", horizon: str = "1 hour") -> DataFrame:
    """The first row of each normal form; equal to the batch rule for repeats within the horizon."""
    return stream.withColumn("norm_sha", F.sha2(squash(text), 256)).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["norm_sha"])


def cache_sessions(stream: DataFrame, key: str = "user_id", time: str = "ts", ttl: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per run of turns without a gap over the TTL: as many rows as cache misses."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, ttl)).agg(F.count("*").alias("turns"))
