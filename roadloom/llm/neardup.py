"""Near-duplicate classes: ProbMinHash signatures, banding, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import BANDS, band_keys, signatures, weighted_shingles
from .textkit import byte_runs, first_of_each, fresh, joined_by_key, mix64, row_key, trim, written

#: Documents of a verification block; a tile compares two blocks.
BLOCK_DOCS = 1024
#: Shingles that more documents of a tile share go through a matrix product, the others through their pairs.
DENSE = 16
_CHUNK = 4096


def signed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, k1, k2, bands) of every row: its ``row_key``, a 128-bit hash of the set of shingles, and the band keys.

    Every shingle weighs the same, however often it occurs, so registers agree with the
    chance that is the Jaccard similarity by which links are verified. Without words k1, k2
    and bands are null.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_runs(pc.binary_length(batch.column(2)).to_pylist(), 1 << 21):
                value, _, starts = weighted_shingles(batch.column(2).slice(a, b - a).to_pylist())
                has = np.diff(starts) > 0
                keys = np.zeros((b - a, 2), np.uint64)
                if len(value):
                    mixed = mix64(value)
                    keys[has, 0] = np.add.reduceat(mixed, starts[:-1][has])
                    keys[has, 1] = np.add.reduceat(mix64(mixed + np.uint64(99)), starts[:-1][has])
                bands = np.zeros((b - a, BANDS), np.uint64)
                if len(value):
                    bands[has] = band_keys(signatures(value, np.ones(len(value)), np.concatenate([starts[:-1][has], starts[-1:]])))
                none = pa.array(~has)
                offsets = pa.array(np.where(np.append(has, True), np.concatenate([[0], np.cumsum(has * BANDS)]), 0).astype(np.int32), mask=np.append(~has, False))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(a, b - a) for k in (0, 1)], *[pc.if_else(none, None, pa.array(keys[:, k].view(np.int64))) for k in (0, 1)], pa.ListArray.from_arrays(offsets, pa.array(bands[has].view(np.int64).ravel()))],
                    names=["doc_id", "key", "k1", "k2", "bands"],
                )
        trim()

    return rows.mapInArrow(sign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, k1 long, k2 long, bands array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``rows`` (any columns, then text) with the sorted distinct shingles in place of the text."""
    names = rows.columns[:-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_runs(pc.binary_length(batch.columns[-1]).to_pylist()):
                part = batch.slice(a, b - a)
                value, _, starts = weighted_shingles(part.columns[-1].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(value.view(np.int64)))], names=[*names, "shingles"])
        trim()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(cut, f"{schema}, shingles array<long>")


def shared_counts(value: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each set of ``left`` shares with each set of ``right``; ``owner`` says whose a value is.

    Values of few sets add up over their pairs. Values of many sets become columns of 0/1
    matrices, some thousand at a time, whose products add up.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    size = int(owner.max(initial=0)) + 1
    row, col = np.full(size, -1), np.full(size, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(value)))
    for n in range(2, DENSE + 1):
        at = first[count == n]
        if len(at):
            members = owner[at[:, None] + np.arange(n)]
            for i in range(n):
                for j in range(n):
                    a, b = row[members[:, i]], col[members[:, j]]
                    ok = (a >= 0) & (b >= 0)
                    np.add.at(out, (a[ok], b[ok]), 1)
    dense = np.flatnonzero(count > DENSE)
    for k in range(0, len(dense), _CHUNK):
        part = dense[k : k + _CHUNK]
        n = count[part]
        at = np.repeat(first[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        column = np.repeat(np.arange(len(part)), n)
        a, b = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        ok = row[owner[at]] >= 0
        a[row[owner[at[ok]]], column[ok]] = 1
        ok = col[owner[at]] >= 0
        b[col[owner[at[ok]]], column[ok]] = 1
        out += a @ b.T
    return out


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph that joins ``left[i]`` and ``right[j]`` where ``links[i, j]``."""
    row, col = np.full(n, -1), np.full(n, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    new = np.ones(n, bool)
    a, b = [], []
    for start in range(n):
        if not new[start]:
            continue
        new[start] = False
        stack = [start]
        while stack:
            x = stack.pop()
            near = np.zeros(n, bool)
            if row[x] >= 0:
                near[right] |= links[row[x]]
            if col[x] >= 0:
                near[left] |= links[:, col[x]]
            found = np.flatnonzero(near & new)
            new[found] = False
            a += [x] * len(found)
            b += found.tolist()
            stack += found.tolist()
    return a, b


def _verified(table: pa.Table, threshold: float) -> pa.Table:
    """Edges that connect what a tile's exact similarities connect: two blocks against each other, or one with itself."""
    ids, block = table["node"].to_numpy(), table["block"].to_numpy()
    sets = table["shingles"].combine_chunks()
    size = pc.list_value_length(sets).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(ids)), size)
    i = block == block.min()
    left, right = np.flatnonzero(i), np.flatnonzero(~i)
    if not len(right):
        right = left
    shared = shared_counts(sets.flatten().to_numpy(zero_copy_only=False), owner, left, right)
    links = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-6
    a, b = _forest(links, left, right, len(ids))
    return pa.Table.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])


def _candidates(reps: DataFrame, total: int) -> DataFrame:
    """(a, b, n): representatives a and the smallest one b of each bucket of a band that holds a, and in how many bands that is so."""
    banded = reps.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = joined_by_key(banded, heads, ["band"], "n", total * BANDS, F.col("node")).where("node <> head")
    return met.groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _members(candidates: DataFrame) -> DataFrame:
    """(node, component, head) of all representatives with a candidate; head is the b with which a shares most bands, null for the smallest of a component."""
    found = components(candidates.select("a", "b"))
    best = candidates.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("n", (-F.col("b")).alias("less"))).alias("best"))
    return found.join(best.select("node", (-F.col("best.less")).alias("head")), "node", "left")


def _linked(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links by exact similarity that connect all that candidates connect; ``sets`` has node, component, head, shingles and is stored.

    Every representative is compared with its head first, one comparison each. What these
    links connect is a provisional class. Only where a component of candidates has several,
    pairs are compared in tiles of two blocks, and pairs of which both are in the largest
    class are not: with l representatives outside of it, of n, there are l * n comparisons.
    """
    total = sets.count()
    heads = sets.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("head is not null")
    headed = heads.join(sets.select(F.col("node").alias("head"), F.col("shingles").alias("other")), "head")
    pairs = joined_by_key(sets.where("head is not null").select("node", "head", "shingles"), headed, ["head"], "n", total, F.col("node"), heads)
    shared = F.size(F.array_intersect("shingles", "other"))
    direct = written(pairs.where(shared >= F.lit(threshold) * (F.size("shingles") + F.size("other") - shared) - 1e-6).select(F.col("node").alias("a"), F.col("head").alias("b")))
    of = sets.select("node", "component").join(components(direct).withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    of = written(of)
    sizes = of.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("component").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_DOCS)).cast("int")
    largest = written(largest.select("component", F.col("top.class").alias("top"), "n", "classes", blocks(F.col("top.n")).alias("inside"), blocks(F.col("n") - F.col("top.n")).alias("outside")))
    opened = joined_by_key(of, largest, ["component"], "n", total, F.col("node")).where("classes > 1")
    main = F.col("class") == F.col("top")
    # blocks of the largest class are 0, 1, ..., those of the others -1, -2, ...
    dealt = opened.select("node", "component", F.when(main, F.pmod(F.xxhash64("node"), "inside")).otherwise(-1 - F.pmod(F.xxhash64("node"), "outside")).cast("int").alias("block"), "inside", "outside")
    rows = sets.select("node", "shingles").join(dealt.hint("merge"), "node")
    rest = F.sequence(-F.col("outside"), F.lit(-1))
    other = F.when(F.col("block") >= 0, rest).otherwise(F.concat(rest, F.sequence(F.lit(0), F.col("inside") - 1)))
    tiles = rows.select("node", "shingles", "component", "block", F.explode(other).alias("other"))
    tiles = tiles.select("node", "shingles", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiled = tiles.groupBy("component", "i", "j").applyInArrow(lambda t: _verified(t.select(["node", "block", "shingles"]), threshold), "a long, b long")
    return direct.unionByName(tiled)


def near_classes(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every row: classes of documents that links of similarity connect; with ``with_key`` also ``row_key``.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity
    of at least ``threshold``; a class is what links connect, its id the smallest doc_id,
    and that document is kept. ProbMinHash signatures of the shingles, each of weight one, are
    cut into bands. Documents with equal sets become one representative first, by sums per
    task before the shuffle. Bands connect representatives to the smallest one of a
    bucket, never all pairs; what they connect is a component of candidates. Inside a
    component similarities are exact (see ``_linked``), and a group of any size is split
    over tasks; no link between candidates is lost.

    Null texts count as empty. A document without words is a class of its own. A null id
    counts as larger than any other; the id of a class without any other is null. Rows are
    judged by their own text, also where they share an id; of several rows with the
    smallest id the one whose ``row_key`` is smallest is kept. Rows equal in id and text are
    one document given more than once: each of them is marked. An empty table gives an
    empty result; other columns are not read.
    """
    rows = written(signed(docs, id_col=id_col, text_col=text_col))
    usable = rows.where("k1 is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "key")).alias("first")
    reps = usable.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))  # equal sets have equal bands
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()))  # read from files from here on, so nodes stay as they are
    total = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    members = _members(written(_candidates(reps, total[0])))
    wanted = members.join(reps.select("node", F.col("first.key").alias("key")), "node")
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("key").agg(F.any_value("text").alias("text"))  # a key has one text
    # members grow with the corpus, so the plan is one that holds at every size
    sets = written(shingle_sets(texts.join(wanted.hint("merge"), "key").select("node", "component", "head", "text")))
    classes = components(_linked(sets, threshold))
    named = reps.join(classes, "node", "left").select("k1", "k2", "copies", "first", F.coalesce("component", "node").alias("class"))
    whole = written(named.groupBy("class").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("reps")))
    named = joined_by_key(named.select("k1", "k2", "copies", "class"), whole, ["class"], "reps", total[0], F.col("k1"))
    named = written(named.select("k1", "k2", "copies", F.col("best.id").alias("class_id"), F.col("best.key").alias("kept_key"), "class_size"))
    out = joined_by_key(usable.select("doc_id", "key", "k1", "k2"), named, ["k1", "k2"], "copies", total[1], F.col("key"))
    out = out.select("doc_id", "class_id", "class_size", (F.col("key") == F.col("kept_key")).alias("kept"), "key")
    alone = rows.where("k1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "key")
    out = out.unionByName(alone)
    return out if with_key else out.drop("key")


def drop_near_copies(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each class of ``near_classes``.

    Decisions are joined on ``row_key``, not on the id, so rows that share an id or have a
    null one are judged each by its own text; of rows equal in id and text one stays, also
    where they have no words. An empty table gives an empty result; columns of any name may be there.
    """
    key, other = fresh(docs.columns, "key", "kept")
    kept = near_classes(docs, threshold=threshold, id_col=id_col, text_col=text_col, with_key=True).where("kept").select(F.col("key").alias(other))
    rows = first_of_each(docs.withColumn(key, row_key(id_col, text_col)), [key], [])
    return rows.join(kept.hint("merge"), F.col(key) == F.col(other), "left_semi").select(*docs.columns)
