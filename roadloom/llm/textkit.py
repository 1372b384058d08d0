"""Helpers that the text operators share: byte-balanced batches, word hashing, lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once in a Python worker; numpy temporaries are a small multiple of it.
BATCH_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def byte_runs(sizes: Iterable[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, stop) ranges holding about ``limit`` bytes each; a larger item is alone."""
    start = total = n = 0
    for n, size in enumerate(sizes, 1):
        if total and total + size > limit:
            yield start, n - 1
            start, total = n - 1, 0
        total += size
    if n > start:
        yield start, n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def random_table(n: int, seed: int) -> np.ndarray:
    """``n`` reproducible 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTES = random_table(256, 17)


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (self.base, self.inverse))
        return self.up, self.down


def trim() -> None:
    """Gives freed memory back to the system. Workers are reused, so what one operator's peak leaves behind would count for the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_POWERS = Powers(0x9E3779B97F4A7C15 | 1)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with len + 1 values; ``span_hash(h, s, e)`` then hashes bytes s to e of ``data``."""
    up, _ = _POWERS.get(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans hash alike wherever they stand."""
    _, down = _POWERS.get(len(h))
    return mix64((h[stop] - h[start]) * down[start] + (stop - start).astype(np.uint64))


def gram_hash(h: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of the ``size`` bytes from each place on, without a list of places."""
    n = max(len(h) - size, 0)
    _, down = _POWERS.get(len(h))
    return mix64((h[size:] - h[:n]) * down[:n] + np.uint64(size))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, a line feed after each, and where each text starts (with the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)[: starts[-1]], starts


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of digits, letters, non-ASCII; A-Z lowered) of joined texts: the lowered bytes, word starts, stops, and the first word of each text (with the end)."""
    low = _LOWER[data]
    inside = WORD_BYTE[low]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    return low, begin, end, np.searchsorted(begin, starts)


#: Bytes of an Arrow batch. Spark's own limit is rows, and a row may be a very long document.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches between the JVM and Python workers to ``ARROW_BYTES``, a setting of the session, where they may be larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


#: Folders written by ``written`` and ``written_in_buckets``, with their application.
_scratch: list[tuple[str, str]] = []


def release(spark: SparkSession, needed: DataFrame) -> None:
    """Deletes the folders that operators of this application have written, but for those that ``needed`` reads.

    For jobs of several steps that store each step's result: what a step has left behind
    is of no use then, and would add up.
    """
    app, files = spark.sparkContext.applicationId, needed.inputFiles()
    jvm = spark.sparkContext._jvm
    for entry in [e for e in _scratch if e[0] == app]:
        if not any(entry[1].rsplit("/", 1)[1] in f for f in files):
            path = jvm.org.apache.hadoop.fs.Path(entry[1])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _scratch.remove(entry)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary folder of this machine only where that is unset, as in local tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not top:
        import tempfile

        if re.match("local($|\\[)", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.gettempdir()
    path = f"{str(top).rstrip('/')}/stage-{uuid.uuid4().hex}"
    _scratch.append((spark.sparkContext.applicationId, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that ``joined_by_key`` may deal out: none of the others has more than a ``HOT_KEYS``-th of all rows.
HOT_KEYS = 1000


def joined_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int, spread: Column, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``keyed``, a table with one row for each key and, in column ``size``, how many of the ``total`` rows have it.

    A key with more than a HOT_KEYS-th of all rows is dealt by ``spread`` (a deterministic
    column of the rows, as different as can be within a key) into parts of about that size,
    and its row of ``keyed`` is repeated for each part. At most HOT_KEYS keys can be so
    frequent, so the list of them, which is broadcast, is bounded whatever the tables are.
    ``keyed`` is read twice, unless ``sizes`` has its keys and sizes; it should be stored or
    cheap. Null keys match nothing.
    """
    most = max(1, total // HOT_KEYS)
    parts = F.ceil(F.col(size) / F.lit(most)).cast("int")
    hot = (keyed if sizes is None else sizes).where(F.col(size) > most).select(*keys, parts.alias("_parts"))
    dealt = keyed.withColumn("_part", F.explode(F.when(F.col(size) > most, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    named = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    return named.join(dealt.hint("merge"), [*keys, "_part"]).drop("_part")


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that name a row by its id and text, nulls included; rows that share both share it."""
    tagged = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(tagged(F.col(id_col)), F.lit("\n"), tagged(F.col(text_col))).cast("binary")))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` with as many underscores in front as none of them needs to be among ``taken``, whatever the case."""
    held = {c.lower() for c in taken}
    mark = "_"
    while any((mark + n).lower() in held for n in names):
        mark += "_"
    return [mark + n for n in names]


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by ``order`` and then by a hash of all columns that have one.

    Each task keeps one row of a key before the shuffle, so a key of any size is no burden.
    """
    from pyspark.sql import Window

    hashed = [F.col(f"`{f.name}`") for f in rows.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*hashed) if hashed else F.lit(0)))
    (first,) = fresh(rows.columns, "first")
    return rows.withColumn(first, n).where(F.col(first) == 1).drop(first)


def _mix(h: int, k: int) -> int:
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
    h ^= k
    return ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF


def bucket_of(x: int, buckets: int) -> int:
    """The bucket of a long: Spark's 32-bit Murmur3 with seed 42, modulo ``buckets``."""
    h = _mix(_mix(42, x & 0xFFFFFFFF), x >> 32 & 0xFFFFFFFF) ^ 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def block_numbers(partition: int, buckets: int) -> Iterator[int]:
    """Numbers for the blocks of a task, all of one bucket, so that the task writes one file of a table in buckets."""
    x = partition << 32
    while True:
        if bucket_of(x, buckets) == partition % buckets:
            yield x
        x += 1


def table_buckets(spark: SparkSession, wanted: int) -> int:
    """Buckets of a table: as many as shuffle partitions at least; with fewer, Spark would shuffle the table after all."""
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


def written_in_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As ``written``, laid out by a hash of ``key`` into ``table_buckets``, so that grouping by it needs no shuffle of this side."""
    spark = df.sparkSession
    small_batches(spark)
    name = f"stage_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark)).bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    return table
