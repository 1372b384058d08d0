"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import joined_by_key, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges with m, the smallest of all b of their a. The edges of a star's centre are dealt into parts."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return joined_by_key(edges, least, ["a"], "n", total, F.col("b"))


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    rows = _with_least(edges, total)
    # the smallest neighbour itself gets the edge to a, every other one an edge to the smallest
    return rows.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b); the component is its smallest node.

    Edges are undirected; loops and repeated edges do no harm; edges with a null end are
    left out. Each round is two joins on a node and sums per node before the shuffle; a
    node with very many edges is dealt into parts. The edges of a round are written to the
    shared folder, so the plan does not grow. The number of rounds grows with the logarithm
    of a component, and neither edges nor labels reach the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e)
    state = _state(e)
    while state[0]:
        wide = written(_large(e, state[0]))
        e = written(_small(wide, wide.count()))
        if (new := _state(e)) == state:
            break
        state = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
