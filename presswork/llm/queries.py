"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, exact, html, langid, minhash, mixing, quality, suffix, tokens
from .common import crc_mod, table

QUALITY_FOLDS, QUALITY_HELD = 5, 0
LANG_FOLDS, LANG_HELD = 4, 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> bytes:
    return quality.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", QUALITY_FOLDS) != QUALITY_HELD)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.add_score(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", QUALITY_FOLDS) == QUALITY_HELD).alias("held_out"), "score", "predicted")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, crc_mod("doc_id", LANG_FOLDS) != LANG_HELD)
    said = langid.add_language(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), model)
    return said.select("doc_id", (crc_mod("doc_id", LANG_FOLDS) == LANG_HELD).alias("held_out"), "lang_pred", "score", "lang_second", "ambiguous")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digest(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop(exact.ROW)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = bagminhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", F.col("class_rows").cast("long").alias("class_rows"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_html, op3_langid, op4_suffix_dedup, op5_fingerprints, op6_bpe, op7_exact_dedup, op8_token_counts,
        op9_pfair_mix, op10_near_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        select cast(doc_id as bigint) doc_id, max(doc_id) over w keep_id, count(*) over w group_size,
          doc_id = max(doc_id) over w kept, sha256(coalesce(text, '')) text_sha256
        from documents window w as (partition by coalesce(text, ''))
    """,
    "op9_pfair_mix": mixing.MIX_SQL,
}
