"""Exact top-k inner-product search: matrix products of query blocks and shards, then lists merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import written

#: Components of a shard and of a block of queries, in bytes: what one tile holds on average.
SHARD_BYTES, BLOCK_BYTES = 32 << 20, 2 << 20
#: Lists that are merged at once.
FAN = 64
_STEP = 256


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as long; null where the vector is null or holds null, NaN or infinity."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale))))


def _matrix(values: np.ndarray, rows: int) -> np.ndarray:
    return values.reshape(rows, -1) if rows else values.reshape(0, 0)


def _tile(qid: np.ndarray, q: np.ndarray, sid: np.ndarray, s: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The k best of a shard (ids in order) for each query, some queries at a time: a product, a partial selection, then an exact order of what is left."""
    width = max(1, q.shape[1])
    big = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(s).max(initial=0)), 1) * width
    if big < 1 << 53:  # products and sums are exact in doubles
        q, s = q.astype(np.float64), s.astype(np.float64)
    st = np.ascontiguousarray(s.T)
    kk = min(k, len(s))
    for a in range(0, len(q), _STEP):
        score = (q[a : a + _STEP] @ st).astype(np.int64)
        own = sid[None, :] == qid[a : a + _STEP, None]
        score[own] = np.iinfo(np.int64).min
        limit = np.partition(score, score.shape[1] - kk, axis=1)[:, score.shape[1] - kk]
        row, col = np.nonzero((score >= limit[:, None]) & ~own)  # with all ties of the k-th score
        value = score[row, col]
        by = np.lexsort((sid[col], -value, row))
        row, col, value = row[by], col[by], value[by]
        first = np.searchsorted(row, np.arange(score.shape[0]))
        keep = np.arange(len(row)) - first[row] < k
        yield qid[a : a + _STEP][row[keep]], sid[col[keep]], value[keep]


def _query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """(dim, payload): the ids and components of queries, a block in one value."""

    def pack(table: pa.Table) -> pa.Table:
        ids, values = table["id"].to_numpy(), table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        raw = len(ids).to_bytes(8, "little") + ids.astype("<i8").tobytes() + values.astype("<i8").tobytes()
        return pa.Table.from_arrays([table["dim"].slice(0, 1), pa.array([raw], pa.binary())], names=["dim", "payload"])

    return queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).groupBy("dim", "block").applyInArrow(pack, "dim int, payload binary")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best inner products of each query with every other row.

    Components are quantised by ``quantised``. Ties go to the smaller id. Rows with a null
    id or vector, or with null or non-finite components, take no part; vectors meet only
    vectors of their own length. Repeated rows with one id all count as the query's own and
    never meet each other; as candidates of another query each stays a row of its own.
    Rows equal in id and vector are one row with a number, so no shard fills up with them.

    Rows are dealt by a hash into shards of bounded size and stay there; a task holds one
    shard and lets all blocks of queries pass, one at a time, each a tile of one product
    with a partial selection. So a row is shuffled once, and only queries, in blocks of
    bounded size, are repeated for each shard. Lists of a query are merged in a tree, FAN
    shards at a time. Neither side is broadcast or collected. An empty table gives an empty
    result; other columns are not read.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    v = written(v.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"), F.max("q").alias("q")).withColumn("dim", F.size("v")))
    size = 8 * F.sum("dim")
    total, asked = (x or 0 for x in v.agg(size, F.sum(F.when(F.col("q"), 8 * F.col("dim")))).first())
    shards, blocks = max(1, -(-total // SHARD_BYTES)), max(1, -(-asked // BLOCK_BYTES))
    null = lambda kind: F.lit(None).cast(kind)
    shard = F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(shards)).cast("int")
    held = v.select("dim", shard.alias("shard"), F.lit(0).alias("kind"), "id", F.least("copies", F.lit(k)).alias("copies"), "v", null("binary").alias("payload"))
    sent = written(_query_blocks(v.where("q").select("id", "v", "dim"), blocks))
    sent = sent.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), null("long").alias("id"), null("long").alias("copies"), null("array<long>").alias("v"), "payload")
    # a shard's rows come before its queries
    rows = held.unionByName(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        ids = matrix = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            own = batch.filter(pa.array(kind == 0))
            if own.num_rows:
                copies = own.column(4).to_numpy()
                values = _matrix(own.column(5).flatten().to_numpy(zero_copy_only=False), own.num_rows)
                parts.append((np.repeat(own.column(3).to_numpy(), copies), np.repeat(values, copies, axis=0)))
            passing = batch.filter(pa.array(kind == 1))
            if not passing.num_rows or not (parts or ids is not None):
                continue
            if ids is None:
                ids, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.argsort(ids, kind="stable")
                ids, matrix, parts = ids[order], matrix[order], []
            number = batch.column(1)[0].as_py()
            for payload in passing.column(6).to_pylist():
                n = int.from_bytes(payload[:8], "little")
                qid, q = np.frombuffer(payload, "<i8", n, 8), _matrix(np.frombuffer(payload, "<i8", -1, 8 + 8 * n), n)
                for found in _tile(qid, q, ids, matrix, k):
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(found[0]), pa.int32()), *[pa.array(x, pa.int64()) for x in found]], names=["shard", "query_id", "vec_id", "score"])

    lists = rows.groupBy("dim", "shard").applyInArrow(search, "shard int, query_id long, vec_id long, score long")
    return _merged(lists, shards, k)


def _merged(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """The ``k`` best of all lists of a query (shard, query_id, vec_id, score), FAN lists at a time."""
    rank = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.pmod("shard", F.lit(shards)))
        lists = lists.withColumn("rank", rank(["query_id", "shard"])).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", rank(["query_id"])).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
