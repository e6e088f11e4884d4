"""Shared plumbing of the training-data operators.

Everything here is small on purpose: table access, the shared folder that cuts lineage, and
the slicing that keeps a Python worker's memory flat when a batch holds very long texts.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker looks at together.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, or one that
    was set on the context. Where neither is set, a session on one machine gets one made here and a cluster an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    own = sc._jsc.sc().getCheckpointDir()
    if where:
        return where.rstrip("/")
    if own.isDefined():
        return own.get()
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="presswork-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stashed = path
    return kept


def release(*stashed: DataFrame) -> None:
    """Delete tables that ``stash`` wrote and nothing reads any more."""
    for df in stashed:
        path = getattr(df, "_stashed", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Plans in which a row's place, as ``monotonically_increasing_id`` numbers it, is the same each time they run.
_FIXED = frozenset(["Project", "Filter", "LogicalRelation", "Relation", "SubqueryAlias"])


def in_place(df: DataFrame, name: str = "docs") -> DataFrame:
    """``df`` as a table whose rows can be known by their place: itself if it is a scan of files (with columns picked and rows
    filtered), else a stashed copy."""

    def fixed(plan) -> bool:
        kids = plan.children()
        return plan.nodeName().split(" ")[0] in _FIXED and kids.size() <= 1 and all(fixed(kids.apply(k)) for k in range(kids.size()))

    plan = df._jdf.queryExecution().analyzed()
    return df if plan.deterministic() and fixed(plan) else stash(df, name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if a column is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """Drop (any-case) columns that clash with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds more than ``budget`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + budget, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def by_slices(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, object]],
    schema: str,
    column: str = "text",
    setup: Callable[[], object] | None = None,
    budget: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded text. ``fn(slice[, state])`` returns columns by name;
    ``setup`` runs once per task."""
    target = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch, column, budget):
                out = fn(part, *state)
                yield pa.RecordBatch.from_arrays(
                    [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
    "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def pa_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.strip().split(" ", 1) for x in ddl.split(","))])


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
