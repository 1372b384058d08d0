"""Corpus pipeline over ``documents``: quality filter, exact dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), reads ``docs`` with the columns of ``documents`` and
returns a DataFrame; all but the last return these columns again. Stages call the operators
of ``roadloom.llm`` with their production parameters on every row. They decide about rows,
not ids: null and repeated ids, null and empty texts, repeated rows, empty tables and extra
columns of any name have defined results, stated by the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm import exactdedup, neardup, packing, quality, suffixdedup, textkit, tokencount

#: Documents that score below it are rejected.
QUALITY_THRESHOLD = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from all ``labels``, does not reject.

    Each row is judged by its own text, null as empty; see ``quality.keep``.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=QUALITY_THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, white space aside, whatever ids the rows have; see ``exactdedup.drop_copies``."""
    return exactdedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, whatever ids the rows have; see ``neardup.drop_near_copies``."""
    return neardup.drop_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages that a document with a smaller id has too; none is dropped; see ``suffixdedup.drop_passages``."""
    return suffixdedup.drop_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 2048 tokens, each row by itself, null texts as empty ones; see ``packing.pack_documents``."""
    return packing.pack_documents(docs, tokencount.default_path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    """``stage`` after what earlier stages have left in the shared folder is gone, unless its input still reads it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        textkit.release(spark, docs)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _tidy(quality_filter)),
    ("exact dedup", _tidy(exact_dedup)),
    ("MinHash near-dedup", _tidy(near_dedup)),
    ("suffix-array dedup", _tidy(passage_dedup)),
    ("best-fit packing", _tidy(pack)),
]

#: The classifier, the signatures and the packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = textkit.written(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
