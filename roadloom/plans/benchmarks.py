"""Benchmarks of the map operators: layouts for box queries, matching, routing, repair.

``python -m roadloom.plans.benchmarks NAME [--roads FILE] [--n N]`` prints one as a Markdown
table; without a file the roads are a synthetic grid, or the sample map's where a network is
needed.
"""

from __future__ import annotations

import argparse
import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import planar as p
from ..functions.types import LINE, ROAD_NODES
from ..operators import graph, matching, measures, spatial, topology
from ..operators.lineage import materialised
from ..sources import geojson
from . import sample

#: Rows of a leaf or node of a layout.
LEAF = 8


def _timed(make: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    began = time.perf_counter()
    return make(), (time.perf_counter() - began) * 1000.0


def layouts(roads: DataFrame) -> dict[str, tuple[Callable[[], DataFrame], Callable[[DataFrame, spatial.Box], DataFrame]]]:
    """For each layout how it is built from roads with boxes, and which of its rows it offers for a box, before the exact test."""
    boxes = roads.select("id", *spatial.BOX)
    middle = [(F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in ("lon", "lat")]

    def grid(rows: DataFrame, box: spatial.Box) -> DataFrame:
        (x1, y1), (x2, y2) = [[math.floor(v / spatial.CELL) for v in corner] for corner in (box[:2], box[2:])]  # as ``spatial.cells``
        return rows.where(F.col("cx").between(x1, x2) & F.col("cy").between(y1, y2)).dropDuplicates(["id"])

    def quadtree(rows: DataFrame, box: spatial.Box) -> DataFrame:
        prefixes, found = spatial.quadkeys_of_box(box), F.lit(False)
        for prefix in prefixes:  # nodes below a prefix, and those above it, whose boxes straddle its edge
            found = found | F.col("node").startswith(prefix) | F.col("node").isin([prefix[:k] for k in range(len(prefix))])
        return rows.where(found)

    def quad_node() -> DataFrame:
        corner = [spatial.quadkey(F.col(f"{s}_lon"), F.col(f"{s}_lat")) for s in ("min", "max")]
        digits = F.transform(F.sequence(F.lit(1), F.length("_a")), lambda i: F.substring(F.col("_a"), F.lit(1), i))
        node = F.coalesce(F.array_max(F.filter(digits, lambda x: F.col("_b").startswith(x))), F.lit(""))
        return materialised(boxes.withColumns({"_a": corner[0], "_b": corner[1]}).withColumn("node", node).drop("_a", "_b").repartitionByRange("node").sortWithinPartitions("node"))

    def packed(rows: DataFrame, box: spatial.Box) -> DataFrame:
        tiles = rows.select("tile_x", "tile_y", *[F.col(f"t_{c}").alias(c) for c in spatial.BOX]).distinct()
        return rows.join(spatial.roads_in_bbox(tiles, box).select("tile_x", "tile_y"), ["tile_x", "tile_y"], "left_semi")

    def tiled(tiles: Callable[[], DataFrame]) -> DataFrame:
        rows = materialised(tiles())
        own = spatial.tile_boxes(rows).select("tile_x", "tile_y", *[F.col(c).alias(f"t_{c}") for c in spatial.BOX])
        return materialised(rows.join(own, ["tile_x", "tile_y"]).repartitionByRange("tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y"))

    def sliced() -> DataFrame:
        lon, lat = boxes.agg(F.max(middle[0]) - F.min(middle[0]), F.max(middle[1]) - F.min(middle[1])).first()
        ranked = spatial.ranked(boxes.withColumn("_m", middle[0] if (lon or 0) >= (lat or 0) else middle[1]), ["_m", "id"], "_place")
        return ranked.withColumns({"tile_x": F.floor(F.col("_place") / LEAF).cast("long"), "tile_y": F.lit(0).cast("long")}).drop("_place", "_m")

    return {
        "brute_force": (lambda: materialised(boxes), lambda rows, box: rows),
        "grid": (lambda: materialised(spatial.covered(boxes).repartitionByRange("cx", "cy").sortWithinPartitions("cx", "cy")), grid),
        "quadtree": (quad_node, quadtree),
        "rtree": (lambda: tiled(sliced), packed),
        "str_rtree": (lambda: tiled(lambda: spatial.str_tiles(boxes, LEAF)), packed),
    }


def index_benchmark(roads: DataFrame, windows: list[spatial.Box], iterations: int = 1) -> DataFrame:
    """(index, build_ms, stored_bytes, candidate_count, false_positive_count, result_count, and latencies) of each layout over the windows.

    Counts are means over the windows; candidates are the rows that a layout offers, false
    positives those of them that fail the exact test.
    """
    spark, out = roads.sparkSession, []
    runs = []
    for name, (build, offer) in layouts(roads).items():
        rows, build_ms = _timed(build)
        counts = []
        for box in windows:
            exact = p.bbox_intersects(tuple(F.col(c) for c in spatial.BOX), tuple(F.lit(float(x)) for x in box))
            for _ in range(iterations):
                found, ms = _timed(lambda box=box, exact=exact, rows=rows, offer=offer: spatial.index_stats(offer(rows, box), exact).first())
                runs.append((name, ms))
            counts.append(found)
        mean = lambda c, counts=counts: sum(r[c] for r in counts) / max(len(counts), 1)
        out.append((name, build_ms, spatial.stored_bytes(rows), mean("candidate_count"), mean("false_positive_count"), mean("candidate_count") - mean("false_positive_count")))
    report = measures.latency_report(spark.createDataFrame(runs, "index string, latency_ms double"), ["index"]).select("index", F.col("n").alias("queries"), *[F.col(c).alias(f"{c}_ms") for c in ("mean", "p50", "p95", "p99")])
    return spark.createDataFrame(out, "index string, build_ms double, stored_bytes long, candidate_count double, false_positive_count double, result_count double").join(report, "index").orderBy("index")


def city_benchmark(roads: DataFrame, windows: int = 100, seed: int = 7) -> DataFrame:
    """``index_benchmark`` over random windows of 8 % of the extent a side, with the number of roads and their length."""
    box = spatial.bounds(roads).first()
    size = roads.agg(F.count(F.lit(1)).alias("roads"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length_m"))
    found = index_benchmark(roads, measures.random_windows(tuple(box), windows, seed=seed) if box[0] is not None else [])
    return found.crossJoin(size)  # one row


def matching_benchmark(legs: DataFrame, roads: DataFrame, k: int = 5) -> DataFrame:
    """(trajectory_id, precision, recall, exact_match, confidence, algorithm) of both matchers on the standard traces along routes.

    ``legs`` are routes (trajectory_id, leg, road_id, geometry), each a sequence of roads.
    """
    points = materialised(matching.trace_cases(legs))
    true = legs.groupBy("trajectory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("leg", "road_id"))), lambda x: x["road_id"]).alias("roads"))
    names = points.select("trajectory_id").distinct().withColumn("route", F.expr("substr(trajectory_id, instr(trajectory_id, ':') + 1)"))
    truth = names.join(true.select(F.col("trajectory_id").cast("string").alias("route"), "roads"), "route").select("trajectory_id", "roads")
    points, out = points.drop("case"), None
    for name, found in (("nearest", matching.matched_sequences(matching.match_nearest(points, roads, k))), ("hmm", matching.matched_sequences(matching.match_hmm(points, roads, k), 20.0))):
        part = matching.evaluation(found, truth).withColumn("algorithm", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def matching_latency(points: DataFrame, roads: DataFrame, times: int = 10, iterations: int = 3) -> DataFrame:
    """Latencies of the matchers on trajectories driven ``times`` times over."""
    longer = materialised(matching.repeated(points, times))
    cases = {"nearest": lambda: matching.match_nearest(longer, roads), "candidate_cost": lambda: matching.match_candidate_cost(longer, roads), "hmm": lambda: matching.match_hmm(longer, roads)}
    return measures.latency_report(measures.timed(points.sparkSession, cases, iterations), ["case"])


def routing_latency(roads: DataFrame, pairs: DataFrame, iterations: int = 3) -> DataFrame:
    """Latencies of routes between ``pairs`` (source, target) by algorithm and mode."""
    arcs = materialised(graph.arcs(roads))
    cases = {f"{a}_{m}": (lambda a=a, m=m: graph.routes(arcs, pairs, m, a)) for a in ("dijkstra", "astar") for m in ("shortest_distance", "shortest_time")}
    return measures.latency_report(measures.timed(roads.sparkSession, cases, iterations), ["case"])


# Fixed values of the dirty network: places of its nodes, and its roads as pairs of them.
DIRTY_PLACES = {"a": (0.0, 0.0), "b": (2.0, 0.0), "c": (1.0, -1.0), "d": (1.0, 1.0), "b_near": (2.00000001, 0.0)}
DIRTY_ROADS = {"horizontal": ("a", "b"), "vertical": ("c", "d"), "duplicate": ("a", "b_near")}
#: Stored length of each of its roads, and metres within which its nodes are snapped.
DIRTY_LENGTH, DIRTY_TOLERANCE_M = 2.0, 2.0


def dirty_network(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, roads): a crossing without a node and a duplicate that ends beside its twin."""
    nodes = spark.createDataFrame([(i, *xy, n) for n, (i, xy) in enumerate(DIRTY_PLACES.items())], ROAD_NODES)
    rows = [(i, a, b, [DIRTY_PLACES[a], DIRTY_PLACES[b]], DIRTY_LENGTH, n) for n, (i, (a, b)) in enumerate(DIRTY_ROADS.items())]
    roads = spark.createDataFrame(rows, f"id string, from_node string, to_node string, geometry {LINE}, length double, pos long")
    other = {"speed_limit": F.lit(40.0), "road_type": F.lit("local"), "oneway": F.lit(False), "direction": F.lit("both"), "road_class": F.lit("local"), "lane_count": F.lit(1), "turn_restrictions": F.array().cast("array<map<string,string>>"), "metadata": F.create_map().cast("map<string,string>")}
    return nodes, roads.withColumns(other)


def topology_benchmark(spark: SparkSession) -> DataFrame:
    """One row: milliseconds of the repair of the dirty network, its operations, and the issues before and after."""
    operations, ms = _timed(lambda: topology.repair(*dirty_network(spark), DIRTY_TOLERANCE_M)[2].collect())
    return spark.createDataFrame([(ms, *operations[0])], ["elapsed_ms", *operations[0].asDict()])


def main() -> None:
    names = ("index", "city", "matching", "matching_latency", "routing", "topology")
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("name", choices=names)
    parser.add_argument("--roads", help="a GeoJSON file of roads")
    parser.add_argument("--n", type=int, default=1000, help="roads of the synthetic grid, windows of the city benchmark")
    asked = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    read = geojson.read_features(spark, asked.roads) if asked.roads else geojson.payload_features(spark, sample.roads())
    nodes, roads = geojson.roads(read)
    roads = materialised(spatial.with_bbox(roads))
    points = geojson.trajectories(geojson.payload_features(spark, sample.trajectories()))
    ends = nodes.agg(F.min("id").alias("source"), F.max("id").alias("target"))
    legs = roads.select(F.lit("route").alias("trajectory_id"), F.col("pos").alias("leg"), F.col("id").alias("road_id"), "geometry").orderBy("leg").limit(3)
    found = {
        "index": lambda: index_benchmark(roads if asked.roads else spatial.with_bbox(measures.grid_roads(spark, asked.n)), measures.random_windows((116.0, 39.0, 116.1, 39.1), 5)),
        "city": lambda: city_benchmark(roads, asked.n),
        "matching": lambda: matching_benchmark(legs, roads),
        "matching_latency": lambda: matching_latency(points.drop("ts_raw"), roads),
        "routing": lambda: routing_latency(roads, ends),
        "topology": lambda: topology_benchmark(spark),
    }[asked.name]()
    print(measures.markdown(found))


if __name__ == "__main__":
    main()
