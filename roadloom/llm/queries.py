"""Queries opN_<name> of the operators in this package, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, exactdedup, langid, licenses, neardup, packing, quality, suffixdedup, tokencount, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    """crc32 of the id as text, modulo ``n``; it deals rows into folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = _remainder(4).eqNullSafe(F.lit(2))
    return langid.identify(docs, langid.train(docs, ~out), extra={"held_out": out})


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokencount.default_path("piece_bpe_32k.model"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokencount.default_path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder(5) != 0)
    return rows.select("doc_id", _remainder(5).eqNullSafe(F.lit(0)).alias("held_out"), "score", "predicted")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarised(licenses.scan(_table(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.encode_documents(_table(spark, sf_dir, "documents"), tokencount.default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_bytes(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_exact_topk, op3_token_counts, op4_best_fit_packing, op5_quality, op6_minhash_near_dedup, op7_license_scan, op8_exact_dedup, op9_byte_bpe, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": topk.TOPK_SQL, "op8_exact_dedup": exactdedup.EXACT_SQL}
