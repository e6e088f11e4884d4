"""Tables on their way: written in the shared folder to be read more than once, dealt out where they come in few parts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where it names none, one of our own on one machine and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if where:
        return where.rstrip("/")
    if own.isDefined():
        return own.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="presswork-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def written(df: DataFrame, folder: str, name: str = "table") -> DataFrame:
    """``df`` as a table in ``folder``: what it took to make is done once, and not again when an executor is lost."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._written = path
    return made


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer parts than the session has cores (a small one) is dealt out among them; any other stays as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def beside(rows: DataFrame, told: DataFrame, on: list[str], many: int = 1000) -> DataFrame:
    """rows joined (left) to ``told``, a row per key with ``_n``, how many rows have it. Keys that more than a ``many``-th of all rows have are fewer than
    ``many``: they are broadcast, so the rows of a hot key aren't gathered; the others are shuffled."""
    total = told.agg(F.sum("_n").alias("_all"))
    hot = F.broadcast(told.crossJoin(F.broadcast(total)).where(F.col("_n") * many > F.col("_all")).drop("_all"))
    cold = rows.join(hot.select(*on), on, "left_anti").join(told, on, "left")
    return rows.join(hot, on).unionByName(cold).drop("_n")
