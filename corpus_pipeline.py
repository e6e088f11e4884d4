"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing, tokens.

Each stage takes all that its predecessor kept, returns a DataFrame, and is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents.

The mix is an order of rows. Its stage writes the files in that order, but who reads several files gets them in any, so the
last stage states each row's place: mix_slot and mix_rank, which depend on the ids and sources of the rows alone. Sorting the
result by (mix_slot, mix_rank) gives the mix.

Defined cases: a null text counts as empty, in every stage; a null doc_id is less than any other, a null source a
source of its own; without labels all documents pass the filter; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import bagminhash, exact, mixing, quality, queries, tokens
from presswork.llm.common import in_place, stash, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, queries.quality_model(spark, docs, sf_dir))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the least doc_id stays."""
    return bagminhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair mix of their sources."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents, each with its place in the mix."""
    docs = in_place(docs)
    encoded = tokens.encode_documents(docs, queries.tokenizer_path("word_bpe_49k.json"), row="_mix_place")
    return encoded.join(mixing.placed(docs, row="_mix_place"), "_mix_place").drop("_mix_place")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix),
    ("bpe", encode),
]

#: The classifier and the near-duplicate classes aren't SQL; a test holds the run against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
