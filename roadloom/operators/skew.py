"""Equi-joins in which one key may have a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that all rows are thought to be cut into; a key with more than one part's rows is dealt over several tasks.
PARTS = 1000


def dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, spread: Column) -> DataFrame:
    """``rows`` joined with ``table``, which has each of ``keys`` once and in ``count`` how many of the ``total`` rows have it.

    Frequent keys (more than a PARTS-th of the rows each, so PARTS of them at most) are sent
    to every task, which numbers their rows by a hash of ``spread``; their row of ``table``
    is there once for each number. All other keys meet as in any join.
    """
    share = max(1, total // PARTS)
    pieces = F.ceil(F.col(count) / share).cast("int")
    frequent = table.where(F.col(count) > share).select(*keys, pieces.alias("_pieces"))
    numbered = table.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > share, pieces - 1).otherwise(0))))
    marked = rows.join(F.broadcast(frequent), keys, "left").withColumn("_piece", F.pmod(F.xxhash64(spread), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    return marked.join(numbered, [*keys, "_piece"]).drop("_piece")
