"""Sinks: results, held texts, annotations and decisions as files that only grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admit as A

HOLDS = "name string, seq bigint, ref string, text string"


def result(messages: DataFrame, stats: DataFrame, path: str) -> None:
    """Messages and stats of each transcript as one JSON object."""
    listed = messages.groupBy("transcript").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "name", "content"))).alias("messages"))
    both = listed.join(stats, "transcript", "left")
    both.select("transcript", "messages", F.struct(*[c for c in stats.columns if c != "transcript"]).alias("stats")).write.json(path)


def load_holds(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("recursiveFileLookup", "true").schema(HOLDS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], HOLDS)


def append_holds(spark: SparkSession, rows: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    """Number the rows (name, pos, text) on from what is held and append them; one writer at a time. With a ``batch`` number its rows have a folder of
    their own and go on from what earlier batches hold, so a batch that is repeated holds the same texts under the same references, once."""
    before, own, mode = load_holds(spark, path), path, "append"
    if batch is not None:
        own, mode = f"{path}/batch={batch}", "overwrite"
        if _exists(spark, path):
            before = before.where(F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_path, '/batch=([0-9]+)/', 1) as bigint)"), F.lit(-1)) < batch)
    start = before.groupBy("name").agg(F.max("seq").alias("seq"))
    new = A.hold_refs(rows, start=start)
    new.select("name", "seq", "ref", "text").write.mode(mode).parquet(own)
    return new


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_annotations(decided: DataFrame, path: str, session: str) -> None:
    row = decided.select(F.unix_millis(F.current_timestamp()).alias("_ms"), F.lit(session).alias("session_id"), "decision", "ref", F.lit(0.0).alias("cost_usd"), *A.fingerprint(F.col("name"), F.col("text")))
    row.select((F.col("_ms") / 1000.0).alias("ts"), *row.columns[1:]).write.mode("append").json(path)


def append_decisions(decisions: DataFrame, path: str) -> None:
    """key, keep, p, ts; readers take the latest of a key."""
    decisions.select("key", "keep", "p", "ts").write.mode("append").parquet(path)


def latest(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("key").agg(F.max_by(F.struct("keep", "p", "ts"), "ts").alias("d")).select("key", "d.*")


def reply(results: DataFrame, ok: Column, error: Column) -> DataFrame:
    """Adds status and body, the JSON answer to a request: what ``results`` says, or the error with 400."""
    body = F.when(ok, F.to_json(F.struct(*results.columns))).otherwise(F.to_json(F.struct(error.alias("error"))))
    return results.withColumn("status", F.when(ok, 200).otherwise(400)).withColumn("body", body)


def hook_reply(admitted: Column, event: str = "PostToolUse") -> Column:
    """What a hook prints for the admitted text of a tool result."""
    return F.to_json(F.struct(F.struct(F.lit(event).alias("hookEventName"), admitted.alias("additionalContext")).alias("hookSpecificOutput")))


def score_table(scores: DataFrame, path: str) -> DataFrame:
    """Writes the scores as JSON lines and returns them as the rows of a table in text: input, tokens before and after, reduction, evidence kept."""
    scores.write.mode("overwrite").json(path)
    share = F.when(F.col("tokens_before") > 0, F.round(100 * (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before"), 2)).otherwise(0.0)
    cells = [F.col(scores.columns[0]), F.col("tokens_before"), F.col("tokens_after"), F.concat(share.cast("string"), F.lit("%")), F.concat("recalled", F.lit("/"), "evidence")]
    return scores.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |")).alias("line"))


def bench_results(results: DataFrame, path: str) -> None:
    """One JSON object: each bench with its outcome and seconds, and how many passed."""
    listed = F.array_sort(F.collect_list(F.struct("name", "passed", "seconds", "tail")))
    results.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), listed.alias("results")).coalesce(1).write.mode("overwrite").json(path)
