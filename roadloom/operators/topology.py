"""Road-network topology: validation, snapping, splitting, duplicate removal, repair.

Roads carry ``pos``, their place in the network; the first of several wins by it. Pairs of
segments are found on grid cells and tested exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import planar as p
from .graph import components, node_degree
from .lineage import materialised, numbered
from .spatial import BOX, bbox_join

#: Degrees within which a crossing counts as the end of a segment when roads are split.
SPLIT_EPS = 1e-9
#: Degrees of the cells on which segments of one road meet.
SELF_CELL = 0.001


def node_id(lon: Column, lat: Column) -> Column:
    """The id of a node that has none: its coordinates to seven places, with m for minus and _ for the point."""
    return F.translate(F.format_string("node_%.7f_%.7f", lon, lat), ".-", "_m")


def road_segments(roads: DataFrame) -> DataFrame:
    """(id, pos, from_node, to_node, n_seg, seg, x1, y1, x2, y2, box) of every segment of every road."""
    cut = roads.select("id", "pos", "from_node", "to_node", (F.size("geometry") - 1).alias("n_seg"), F.posexplode(p.segments(F.col("geometry"))).alias("seg", "s"))
    rows = cut.select("id", "pos", "from_node", "to_node", "n_seg", "seg", "s.*")
    box = (F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"))
    return rows.withColumns(dict(zip(BOX, box, strict=True)))


def _met(pairs: DataFrame) -> DataFrame:
    a, b = [F.col(f"l_{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"r_{c}") for c in ("x1", "y1", "x2", "y2")]
    return pairs.withColumn("_i", p.segment_intersection(*a, *b)).select("*", "_i.kind", "_i.x", "_i.y").drop("_i").where("kind <> 'none'")


def _at_end(eps: float) -> Column:
    ends = [(F.col(f"{s}_x{k}"), F.col(f"{s}_y{k}")) for s in "lr" for k in (1, 2)]
    return F.greatest(*[p.same_point(F.col("x"), F.col("y"), *e, eps) for e in ends])


def duplicate_edges(roads: DataFrame) -> DataFrame:
    """(first, duplicate) of roads between the same two ends, to seven places, whichever way and shape they have."""
    end = lambda i: F.struct(*[F.round(F.element_at("geometry", i)[c], 7).alias(c) for c in ("lon", "lat")])
    key = F.array_sort(F.array(end(1), end(-1)))
    order = Window.partitionBy("_key").orderBy("pos")
    rows = roads.select("id", "pos", key.alias("_key")).withColumns({"first": F.first("id").over(order), "_n": F.row_number().over(order)})
    return rows.where("_n > 1").select("first", F.col("id").alias("duplicate"))


def self_intersections(roads: DataFrame) -> DataFrame:
    """(road_id, seg_a, seg_b, lon, lat) where a road meets itself beyond neighbouring segments; a closed road's ends may meet. No place for an overlap."""
    s = road_segments(roads.where(F.size("geometry") > 3))
    pairs = bbox_join(s, s, SELF_CELL, by=("id",)).where(F.col("r_seg") >= F.col("l_seg") + 2)
    closed = (F.col("l_seg") == 0) & (F.col("r_seg") == F.col("l_n_seg") - 1) & p.same_point(F.col("l_x1"), F.col("l_y1"), F.col("r_x2"), F.col("r_y2"))
    return _met(pairs.where(~closed)).select(F.col("l_id").alias("road_id"), F.col("l_seg").alias("seg_a"), F.col("r_seg").alias("seg_b"), F.when(F.col("kind") == "point", F.col("x")).alias("lon"), F.when(F.col("kind") == "point", F.col("y")).alias("lat"))


def crossings(roads: DataFrame) -> DataFrame:
    """(type, first, second, seg_a, seg_b, lon, lat) of crossings and overlaps of roads that share no node; one row for each pair of segments.

    A crossing at an end of a segment does not count.
    """
    s = road_segments(roads)
    apart = ~F.col("l_from_node").isin(F.col("r_from_node"), F.col("r_to_node")) & ~F.col("l_to_node").isin(F.col("r_from_node"), F.col("r_to_node"))
    found = _met(bbox_join(s, s).where((F.col("l_pos") < F.col("r_pos")) & apart))
    found = found.where((F.col("kind") == "overlap") | ~_at_end(p.EPS))
    kind = F.when(F.col("kind") == "overlap", "overlapping_roads").otherwise("illegal_crossing")
    return found.select(kind.alias("type"), F.col("l_id").alias("first"), F.col("r_id").alias("second"), F.col("l_seg").alias("seg_a"), F.col("r_seg").alias("seg_b"), F.col("x").alias("lon"), F.col("y").alias("lat"))


def isolated_nodes(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    return node_degree(nodes, roads).where("degree = 0").select("node_id")


def dangling_edges(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """(road_id) of roads with an end that no other road has."""
    ends = roads.select(F.col("id").alias("road_id"), F.explode(F.array("from_node", "to_node")).alias("node_id"))
    return ends.join(node_degree(nodes, roads).where("degree <= 1"), "node_id").select("road_id").distinct()


def validate(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """All issues: type, severity, message, road_ids, node_ids, lon, lat; isolated, dangling, duplicate, self-intersection, crossing and overlap."""
    none, nowhere = F.array().cast("array<string>"), F.lit(None).cast("double")

    def made(df: DataFrame, kind: Column | str, severity: str, message: Column, road_ids: Column = none, node_ids: Column = none, lon: Column = nowhere, lat: Column = nowhere) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(kind.alias("type"), F.lit(severity).alias("severity"), message.alias("message"), road_ids.alias("road_ids"), node_ids.alias("node_ids"), lon.alias("lon"), lat.alias("lat"))

    c = F.col
    parts = [
        made(isolated_nodes(nodes, roads), "isolated_node", "warning", F.concat(F.lit("Node "), "node_id", F.lit(" is isolated")), node_ids=F.array("node_id")),
        made(dangling_edges(nodes, roads), "dangling_edge", "warning", F.concat(F.lit("Road "), "road_id", F.lit(" has a dangling endpoint")), F.array("road_id")),
        made(duplicate_edges(roads), "duplicate_edge", "error", F.concat(F.lit("Roads "), "first", F.lit(" and "), "duplicate", F.lit(" are duplicate")), F.array("first", "duplicate")),
        made(self_intersections(roads), "self_intersection", "error", F.concat(F.lit("Road "), "road_id", F.lit(" self-intersects")), F.array("road_id"), lon=c("lon"), lat=c("lat")),
        made(crossings(roads), c("type"), "error", F.concat(F.lit("Roads "), "first", F.lit(" and "), "second", F.when(c("type") == "illegal_crossing", " cross without a shared node").otherwise(" overlap")), F.array("first", "second"), lon=c("lon"), lat=c("lat")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """One row of counts of ``validate`` and the number of connected components."""
    issues = validate(nodes, roads)
    count = lambda kind: F.count_if(F.col("type") == kind)
    counts = issues.agg(
        count("isolated_node").alias("isolated_nodes"), count("dangling_edge").alias("dangling_edges"), count("duplicate_edge").alias("duplicate_edges"), count("self_intersection").alias("self_intersections"),
        count("illegal_crossing").alias("illegal_crossings"), count("overlapping_roads").alias("overlapping_roads"), F.count(F.lit(1)).alias("issues"),
    )
    of = components(nodes, roads.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")))
    parts = of.agg(F.count_if(F.col("node") == F.col("component")).alias("components"))
    return counts.crossJoin(parts)  # one row each


def snap_nodes(nodes: DataFrame, tolerance_m: float = 1.0) -> DataFrame:
    """(id, rep_id, lon, lat): the leader that each node joins and the mean position of its cluster.

    In the order of ``pos`` a node joins the first leader within the tolerance or becomes
    one itself. Leaders only matter inside a connected component of near pairs, so pairs
    are found on cells, components localise them, and each component replays the order,
    each node against the leaders of the cells around it.
    """
    margin = tolerance_m / 100_000.0 + 1e-9
    size = max(margin * 4, 1e-5)
    box = {"min_lon": F.col("lon") - margin * 10, "max_lon": F.col("lon") + margin * 10, "min_lat": F.col("lat") - margin, "max_lat": F.col("lat") + margin}
    spots = nodes.select("id", "pos", "lon", "lat").withColumns(box)
    near = bbox_join(spots, spots, max(size, margin * 20)).where((F.col("l_id") < F.col("r_id")) & (g.haversine(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat")) <= tolerance_m))
    of = components(nodes.select("id"), near.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")))
    rows = nodes.select(F.col("id").alias("node"), "pos", "lon", "lat").join(of, "node")

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        reps, at = first_leaders(group["lon"].to_numpy(), group["lat"].to_numpy(), tolerance_m), group["node"].to_numpy()
        return pd.DataFrame({"id": at, "rep_id": at[reps], "lon": group["lon"], "lat": group["lat"]})

    many = F.count(F.lit(1)).over(Window.partitionBy("component"))
    sized = rows.withColumn("_n", many)
    alone = sized.where("_n = 1").select(F.col("node").alias("id"), F.col("node").alias("rep_id"), "lon", "lat")
    led = sized.where("_n > 1").drop("_n").groupBy("component").applyInPandas(lead, "id string, rep_id string, lon double, lat double").unionByName(alone)
    mean = led.groupBy("rep_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return led.select("id", "rep_id").join(mean, "rep_id").select("id", "rep_id", "lon", "lat")


def first_leaders(lon: np.ndarray, lat: np.ndarray, tolerance_m: float) -> np.ndarray:
    """For each place, in order: the first earlier place that leads itself and is within the tolerance, or the place.

    Leaders stand in cells of a tolerance's size, so a place is compared with those of nine
    cells; of two in one cell one leads, but for its corners, so these are few.
    """
    x, y = np.radians(lon), np.radians(lat)
    rows = np.floor(y * g.RADIUS_M / tolerance_m).astype(np.int64)
    # a column is as wide as the tolerance where the row is widest, so at least as wide everywhere in the row
    wide = lambda r: np.maximum(np.cos(np.minimum(np.abs(r), np.abs(r + 1)) * tolerance_m / g.RADIUS_M), 1e-9)
    held: dict[tuple[int, int], list[int]] = {}
    out = np.arange(len(lon))
    for i in range(len(lon)):
        best = i
        for r in (rows[i] - 1, rows[i], rows[i] + 1):
            column = int(np.floor(x[i] * g.RADIUS_M * float(wide(r)) / tolerance_m))
            reach = 2 if abs(lat[i]) > 80 else 1  # rows of very different width
            for c in range(column - reach - 1, column + reach + 2):
                for k in held.get((int(r), c), ()):
                    if k < best and _metres(x[i], y[i], x[k], y[k]) <= tolerance_m:
                        best = k
        out[i] = best
        if best == i:
            held.setdefault((int(rows[i]), int(np.floor(x[i] * g.RADIUS_M * float(wide(rows[i])) / tolerance_m))), []).append(i)
    return out


def _metres(x1: float, y1: float, x2: float, y2: float) -> float:
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return float(2 * g.RADIUS_M * np.arcsin(min(1.0, np.sqrt(h))))


def snap(nodes: DataFrame, roads: DataFrame, tolerance_m: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, roads, mapping) after ``snap_nodes``: ends of roads move to their cluster; stored lengths stay."""
    mapping = materialised(snap_nodes(nodes, tolerance_m))
    first = nodes.select("id", "pos")
    snapped = mapping.where("id = rep_id").select("id", "lon", "lat").join(first, "id").select("id", "lon", "lat", "pos")
    side = lambda s: mapping.select(F.col("id").alias(f"{s}_node"), F.col("rep_id").alias(f"_{s}"), F.struct("lon", "lat").alias(f"_{s}_at"))
    rows = roads.join(side("from"), "from_node", "left").join(side("to"), "to_node", "left")
    n = F.size("geometry")
    line = F.transform("geometry", lambda q, i: F.when(i == 0, F.coalesce("_from_at", q)).when(i == n - 1, F.coalesce("_to_at", q)).otherwise(q))
    moved = rows.withColumns({"geometry": line, "from_node": F.coalesce("_from", "from_node"), "to_node": F.coalesce("_to", "to_node")})
    return snapped, moved.select(*roads.columns), mapping.select("id", "rep_id")


def split_roads(roads: DataFrame) -> DataFrame:
    """``roads`` cut where they cross others: a cut road becomes a road for each piece between vertices and cuts.

    Pieces are named after the road and numbered, have nodes named after their coordinates,
    and remember the road in their metadata. Crossings within SPLIT_EPS of the end of a
    segment cut nothing, so roads that merely share a node stay whole; cuts and vertices
    within SPLIT_EPS of each other are one. ``pos`` numbers all roads anew, pieces in the
    place of their road.
    """
    s = road_segments(roads)
    found = _met(bbox_join(s, s).where(F.col("l_pos") < F.col("r_pos"))).where((F.col("kind") == "point") & ~_at_end(SPLIT_EPS))
    cut = lambda side: found.select(F.col(f"{side}_id").alias("id"), F.col(f"{side}_seg").alias("seg"), p.segment_parameter(F.col("x"), F.col("y"), *[F.col(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2")]).alias("t"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    cuts = cut("l").unionByName(cut("r")).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("seg", "t", "lon", "lat"))).alias("cuts"))
    hit = roads.join(cuts, "id")
    vertices = F.transform("geometry", lambda q, i: F.struct(i.alias("seg"), F.lit(0.0).alias("t"), q["lon"].alias("lon"), q["lat"].alias("lat")))
    chain = F.transform(F.array_sort(F.concat(vertices, "cuts")), lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat")))
    pieces = hit.withColumn("_chain", _unified(chain)).select(*roads.columns, F.posexplode(p.segments(F.col("_chain"))).alias("_n", "_s"))
    a, b = (F.struct(F.col(f"_s.x{k}").alias("lon"), F.col(f"_s.y{k}").alias("lat")) for k in (1, 2))
    made = pieces.withColumns(
        {
            "metadata": F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "source_edge"), F.create_map(F.lit("source_edge"), F.col("id"))),
            "from_node": node_id(F.col("_s.x1"), F.col("_s.y1")),
            "to_node": node_id(F.col("_s.x2"), F.col("_s.y2")),
            "geometry": F.array(a, b),
            "length": g.haversine(F.col("_s.x1"), F.col("_s.y1"), F.col("_s.x2"), F.col("_s.y2")),
            "id": F.concat(F.col("id"), F.lit("_split_"), F.col("_n").cast("string")),
        }
    ).select(*roads.columns, "_n")
    whole = roads.join(cuts.select("id"), "id", "left_anti").select(*roads.columns).withColumn("_n", F.lit(0))
    every = whole.unionByName(made).withColumnRenamed("pos", "_pos").withColumn("_id", F.col("id"))
    return numbered(every, ["_pos", "_n", "_id"]).select(*roads.columns)


def _unified(chain: Column) -> Column:
    """A line without the points that lie within SPLIT_EPS of the last one that stays."""

    def step(acc: Column, q: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(p.same_point(last["lon"], last["lat"], q["lon"], q["lat"], SPLIT_EPS), F.lit(False))
        return F.when(same, acc).otherwise(F.concat(acc, F.array(q)))

    return F.aggregate(chain, F.slice(chain, 1, 0), step)


def without_duplicates(roads: DataFrame) -> DataFrame:
    """The first road between any two ends."""
    return roads.join(duplicate_edges(roads).select(F.col("duplicate").alias("id")), "id", "left_anti").select(*roads.columns)


def nodes_of(roads: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` and the ends of ``roads``; where both name a node the last road decides its place."""
    end = lambda name, i: roads.select(F.col(f"{name}_node").alias("id"), F.element_at("geometry", i)["lon"].alias("lon"), F.element_at("geometry", i)["lat"].alias("lat"), F.col("pos"), F.lit(1 if name == "from" else 2).alias("_k"))
    rows = end("from", 1).unionByName(end("to", -1)).unionByName(nodes.select("id", "lon", "lat", "pos", F.lit(0).alias("_k")))
    order = F.struct(F.col("_k") > 0, "pos", "_k")
    return rows.groupBy("id").agg(F.max_by("lon", order).alias("lon"), F.max_by("lat", order).alias("lat"), F.min("pos").alias("pos"))


def repair(nodes: DataFrame, roads: DataFrame, tolerance_m: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, roads, operations): snapped, split, without duplicates; operations is one row of counts and issues before and after."""
    before = summary(nodes, roads)
    snapped, moved, mapping = snap(nodes, roads, tolerance_m)
    moved = materialised(moved)
    cut = materialised(split_roads(moved))
    single = materialised(without_duplicates(cut))
    final = materialised(nodes_of(single, snapped))
    counts = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    after = summary(final, single)
    rename = lambda df, k: df.select(*[F.col(c).alias(f"{k}_{c}") for c in df.columns])
    operations = counts(mapping.where("id <> rep_id"), "snapped_nodes").crossJoin(counts(moved, "_a")).crossJoin(counts(cut, "_b")).crossJoin(counts(single, "_c"))  # one row each
    operations = operations.select("snapped_nodes", (F.col("_b") - F.col("_a")).alias("split_edges_added"), (F.col("_b") - F.col("_c")).alias("duplicate_edges_removed"), F.lit(0).cast("long").alias("merged_collinear_roads"))
    return final, single, operations.crossJoin(rename(before, "before")).crossJoin(rename(after, "after"))
