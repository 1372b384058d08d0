"""Exact dedup by a 128-bit content hash and a comparison of bytes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import first_of_each, fresh, joined_by_key, written

#: White space that does not count when texts are compared.
IGNORED = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    """``text`` without the characters of ``IGNORED``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def _hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _stays(chars: Column, row_id: Column) -> list[Column]:
    """The order in which the first of equal texts stays."""
    return [-chars, row_id.isNull(), row_id]


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Rows are grouped by the 128-bit MD5 of the normalised text and, inside a hash group,
    by the normalised bytes themselves, so that a collision cannot join two texts. The row
    with the most code points in its original text stays, then the smallest id. Null texts
    count as empty and form one group with empty and blank ones. A null id loses against
    any other; of repeated rows with the same id each one is marked kept if the id is.
    Other columns are not read; an empty table gives an empty result. A group of any size
    leaves one row per map task before the shuffle. Groups, a row of digests each, are
    written to the shared folder once and joined back to their members; the members of a
    group with more than a thousandth of all rows are dealt into parts.
    """
    norm = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"))
    base = base.select("doc_id", "norm", "chars", _hash(F.col("norm")).alias("hash"))
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_stays(F.col("chars"), F.col("doc_id")))]))
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    groups = base.groupBy("hash", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("hash", F.unhex(sha).alias("sha"), F.col("best.o2").alias("keep_id"), "group_size"))
    rows = base.select("doc_id", "hash", F.unhex(sha).alias("sha"))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    met = joined_by_key(rows, groups, ["hash", "sha"], "group_size", total, F.col("doc_id"))
    return met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one for each text, chosen as in ``exact_groups``.

    It is a row that stays, not an id: rows that share an id or have a null one are judged
    each by its own text, and of rows equal in id and text one stays. Null texts count as
    empty; an empty table gives an empty result; columns of any name may be there. Rows
    are grouped by hash and bytes as in ``exact_groups``; each task keeps one row of a
    group before the shuffle.
    """
    hash_, norm, chars = fresh(docs.columns, "hash", "norm", "chars")
    rows = docs.withColumn(norm, normalised(F.col(text_col))).withColumns({hash_: _hash(F.col(norm)), chars: F.char_length(F.coalesce(F.col(text_col), F.lit("")))})
    return first_of_each(rows, [hash_, norm], _stays(F.col(chars), F.col(id_col))).select(*docs.columns)


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
