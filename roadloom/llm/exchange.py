"""Questions that blocks of a corpus ask about their distinct items, each answered once for the whole corpus."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import written

#: Rows that one task merges or answers at most, on average.
FAN = 256
#: Buckets that a bucket is cut into at the next level, where more distinct items meet.
SPLIT = 32
ASK = "block long, bucket long, payload binary, extra binary"
ANSWER = "block long, bucket long, payload binary"


def first_buckets(total: int, block_bytes: int, bucket_bytes: int) -> int:
    """Buckets that a block deals its items to: what FAN blocks of text, or all of ``total`` bytes if less, need at ``bucket_bytes`` each."""
    return max(1, -(-min(total, FAN * block_bytes) // bucket_bytes))


def asked(rows: DataFrame, blocks: int, merge: Callable[[pa.Table, int], list[tuple[int, bytes, bytes]]], answer: Callable[[pa.Table], list[bytes]], spread: Callable[[pa.Table, list[tuple[int, bytes]], int], list[bytes]], level: int = 0) -> DataFrame:
    """(block, bucket, payload) for each of ``rows`` (ASK): the answers to a block's items of a bucket, in the order in which it sent them.

    Up to FAN blocks are answered at once, one task for each bucket. More of them are
    merged first, FAN at a time, into parents that hold each distinct item once and are
    asked for in their place; so an item that every block has is one row for each parent,
    then one for each of their parents, and no task gets a row from every block. At every
    level a bucket is cut into SPLIT, so that items do not pile up in it either. Answers go
    down the same way. The rows of each level are written to the shared folder.

    ``merge(rows, level)`` gives (bucket within SPLIT, payload, extra) of the distinct items,
    ``answer(rows)`` a payload for each row, and ``spread(rows, answers, level)`` a payload
    for each row from the answers (bucket within SPLIT, payload) to what they were merged into.
    """

    def answered(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([table["block"], table["bucket"], pa.array(answer(table), pa.binary())], names=["block", "bucket", "payload"])

    if blocks <= FAN:
        return rows.groupBy("bucket").applyInArrow(answered, ANSWER)
    parents = -(-blocks // FAN)
    dealt = rows.withColumn("parent", F.pmod(F.xxhash64("block", F.lit(level)), F.lit(parents)))

    def merged(table: pa.Table) -> pa.Table:
        parts = merge(table, level)
        parent, bucket = table["parent"][0].as_py(), table["bucket"][0].as_py()
        columns = [[parent] * len(parts), [bucket * SPLIT + p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "payload", "extra"])

    up = written(dealt.groupBy("bucket", "parent").applyInArrow(merged, ASK))
    down = asked(up, parents, merge, answer, spread, level + 1)
    down = down.select(F.floor(F.col("bucket") / SPLIT).cast("long").alias("bucket"), F.col("block").alias("parent"), F.pmod("bucket", F.lit(SPLIT)).cast("int").alias("part"), "payload")

    def told(table: pa.Table, answers: pa.Table) -> pa.Table:
        known = sorted(zip(answers["part"].to_pylist(), answers["payload"].to_pylist(), strict=True))
        return pa.Table.from_arrays([table["block"], table["bucket"], pa.array(spread(table, known, level) if table.num_rows else [], pa.binary())], names=["block", "bucket", "payload"])

    return dealt.groupBy("bucket", "parent").cogroup(down.groupBy("bucket", "parent")).applyInArrow(told, ANSWER)
