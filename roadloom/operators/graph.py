"""Road graph: arcs, degrees, components, shortest paths in batches, turn-aware routes.

A network of up to BROADCAST_ARCS arcs is counted first and then sent to every task, which
searches from its share of the sources. Beyond that, paths are found by relaxation: all
sources advance together, one join of the improved states with the arcs and one minimum per
state a round, until nothing improves; a round's states are written to the shared folder,
so the plan stays small. Both ways follow one rule: least cost, then fewest roads, then the
smallest last road and the smallest node before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy as g
from .lineage import materialised
from .skew import dealt_join

#: Arcs that a task may hold; some 50 bytes each.
BROADCAST_ARCS = 500_000
#: Metres a second that no road allows; a lower bound of the time to a place, for searches that head for it.
FASTEST_M_S = 33.33
#: What ``explained_routes`` tells of a route.
EXPLAINED = ("cost", "distance_m", "travel_time_s", "turn_cost_s", "road_class_cost", "steps")


def arcs(roads: DataFrame) -> DataFrame:
    """Directed edges of ``roads``: one along each road, one back unless it is one-way, with reversed geometry; heading from first to last vertex."""
    ends = lambda line: (F.element_at(line, 1), F.element_at(line, -1))
    seconds = g.travel_time(F.col("length"), F.col("speed_limit"))
    rest = [F.col("id").alias("edge_id"), "length", seconds.alias("travel_time"), "road_class", "speed_limit", "direction", "lane_count"]

    def made(df: DataFrame, a: str, b: str, line: Column) -> DataFrame:
        s, e = ends(line)
        return df.select(*rest, F.col(a).alias("from_node"), F.col(b).alias("to_node"), line.alias("geometry"), g.bearing(s["lon"], s["lat"], e["lon"], e["lat"]).alias("heading"))

    back = made(roads.where(~F.coalesce("oneway", F.lit(False))), "to_node", "from_node", F.reverse("geometry"))
    return made(roads, "from_node", "to_node", F.col("geometry")).unionByName(back)


def without(arc_rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """``arc_rows`` without the edges whose road_id ``blocked`` lists."""
    return arc_rows.join(blocked.select(F.col("road_id").alias("edge_id")), "edge_id", "left_anti")


def node_degree(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """(node_id, degree) of every node and every end of a road; a loop counts twice."""
    ends = roads.select(F.explode(F.array("from_node", "to_node")).alias("node_id"), F.lit(1).alias("n"))
    return ends.unionByName(nodes.select(F.col("id").alias("node_id"), F.lit(0).alias("n"))).groupBy("node_id").agg(F.sum("n").alias("degree"))


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges with m, the smallest neighbour b of their a; the edges of one node, however many, are dealt over tasks."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    return dealt_join(edges, least, ["a"], "_n", total, F.col("b")).drop("_n")


def _star(edges: DataFrame, total: int) -> DataFrame:
    """One large and one small star step over ``total`` edges (a > b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wide = _with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    wide = materialised(wide)
    return _with_least(wide, wide.count()).select(F.greatest("b", F.when(F.col("b") == F.col("m"), F.col("a"))).alias("a"), F.col("m").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of ``nodes`` (id) and the ends of ``edges`` (a, b); the component is its smallest node."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    while True:
        e = materialised(e)
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state or not now[0]:
            break
        state, e = now, _star(e, now[0])
    every = nodes.select(F.col("id").alias("node")).unionByName(edges.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    return every.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def network_components(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """(component, size, members) of the undirected network, largest first; members sorted. Meant for reports."""
    of = components(nodes, roads.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")))
    return of.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("node")).alias("members")).orderBy(F.desc("size"), "component")


def _relax(seeds: DataFrame, keys: list[str], advance, max_rounds: int | None, rounds_per_write: int = 3, useful=None) -> DataFrame:
    """The best state for each of ``keys``: ``advance`` turns improved states into new ones, ``v`` (a struct, cost first) decides.

    Goes on until no state improves; if round ``max_rounds`` still improves one, that is a
    RuntimeError. ``useful(new, best)`` leaves out improved states that need not go on.
    """
    best, new = seeds, seeds
    for r in count(1):
        offered = advance(new).groupBy(*keys).agg(F.min("v").alias("v"))
        known = best.select(*keys, F.col("v.cost").alias("_cost"), F.lit(True).alias("_known"))
        better = offered.join(known, keys, "left").where("_known is null or v.cost < _cost").drop("_cost", "_known")
        last = r == max_rounds
        if r % rounds_per_write and not last:
            best = best.join(better.select(*keys), keys, "left_anti").unionByName(better)
            new = better
            continue
        new = materialised(better)
        best = materialised(best.join(new.select(*keys), keys, "left_anti").unionByName(new))
        if new.isEmpty():
            return best
        if last:
            raise RuntimeError(f"states still improve in round {max_rounds}, the last that max_rounds allows")
        if useful is not None:
            new = useful(new, best)


def shortest_paths(
    arc_rows: DataFrame, sources: DataFrame, mode: str = "shortest_distance", *, max_cost: float | None = None, max_rounds: int | None = None, paths: bool = False, targets: DataFrame | None = None, algorithm: str = "dijkstra"
) -> DataFrame:
    """(source, node, cost, distance, travel_time, and edges with ``paths``) of every node that a source (column source) reaches.

    Cost is metres or, for ``shortest_time``, seconds. Of ways of equal cost the one with
    fewest roads is taken, then the one whose last road, and the node before it, is
    smallest. ``max_cost`` bounds the search by meaning, not by accident: farther nodes are
    not reported. With ``targets`` (source, target) only these pairs are reported, if there
    is a way, and a search ends as soon as all targets of its source are settled;
    ``sources`` is then not read. ``algorithm`` dijkstra or astar says in which order a
    search looks at nodes; astar, for one target a source, prefers those nearer to it by a
    bound that never exceeds the true rest, so both find the same costs. With ``paths`` a
    state carries its edge ids. Relaxation takes a round for each arc of the longest best
    path, however many; where ``max_rounds`` is given and does not suffice, a RuntimeError
    is raised.
    """
    if algorithm not in ("dijkstra", "astar"):
        raise ValueError(f"unknown algorithm: {algorithm}")
    weight = F.col("travel_time") if mode == "shortest_time" else F.col("length")
    at = F.element_at("geometry", 1), F.element_at("geometry", -1)
    steps = arc_rows.groupBy("from_node", "to_node").agg(F.min(F.struct(weight.alias("w"), "edge_id", "length", "travel_time", at[0].alias("a"), at[1].alias("b"))).alias("arc")).where("from_node <> to_node")
    steps = materialised(steps.select(F.col("from_node").alias("node"), "to_node", "arc.*"))
    if targets is not None:
        targets = targets.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).distinct()
        sources = targets.select("source").distinct()
    if steps.count() <= BROADCAST_ARCS:
        return _searched(steps, sources, max_cost, paths, targets, algorithm == "astar", mode)
    steps = steps.drop("a", "b")
    empty = F.array().cast("array<string>")
    parts = lambda cost, hops, edge, before, length, seconds, edges: F.struct(cost.alias("cost"), hops.alias("hops"), edge.alias("edge"), before.alias("before"), length.alias("distance"), seconds.alias("travel_time"), *([edges.alias("edges")] if paths else []))
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    seeds = sources.select(F.col("source").cast("string").alias("source")).distinct().withColumns({"node": F.col("source"), "v": parts(zero, F.lit(0), none, none, zero, zero, empty)})

    def advance(new: DataFrame) -> DataFrame:
        grown = new.join(steps, "node").select(
            "source", F.col("to_node").alias("node"),
            parts(F.col("v.cost") + F.col("w"), F.col("v.hops") + 1, F.col("edge_id"), F.col("node"), F.col("v.distance") + F.col("length"), F.col("v.travel_time") + F.col("travel_time"), F.concat("v.edges", F.array("edge_id")) if paths else empty).alias("v"),
        )
        return grown if max_cost is None else grown.where(F.col("v.cost") <= max_cost)

    def nearer_than_targets(new: DataFrame, best: DataFrame) -> DataFrame:
        got = targets.join(best.select("source", F.col("node").alias("target"), F.col("v.cost").alias("_c")), ["source", "target"], "left")
        farthest = got.groupBy("source").agg(F.max(F.coalesce("_c", F.lit(float("inf")))).alias("_farthest"))
        return new.join(farthest, "source").where(F.col("v.cost") < F.col("_farthest")).drop("_farthest")

    best = _relax(seeds, ["source", "node"], advance, max_rounds, useful=None if targets is None else nearer_than_targets)
    out = best.select("source", "node", "v.cost", "v.distance", "v.travel_time", *["v.edges"] * paths)
    return out if targets is None else out.join(targets.withColumnRenamed("target", "node"), ["source", "node"], "left_semi")


class _Network(NamedTuple):
    """Arcs in compact arrays, sorted by the node they leave: those of node i are first[i] to first[i + 1]. Numbers of nodes and edges are in the order of their ids."""

    nodes: pa.Array
    edges: pa.Array
    first: np.ndarray
    to: np.ndarray
    edge: np.ndarray
    w: np.ndarray
    length: np.ndarray
    seconds: np.ndarray
    places: np.ndarray | None


def _network(steps: DataFrame, places: bool) -> _Network:
    """``steps``, counted by the caller, as some 50 bytes an arc; ``places`` says whether the nodes' lon and lat are wanted."""
    rows = steps.select("node", "to_node", "edge_id", "w", "length", "travel_time", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("lon", "lat") if places]).toArrow().combine_chunks()
    ids = lambda *names: (lambda found: found.take(pc.sort_indices(found)))(pc.unique(pa.chunked_array([c for n in names for c in rows[n].chunks], pa.string())))
    number = lambda name, of: pc.index_in(rows[name], value_set=of).to_numpy().astype(np.int32)
    nodes, edges = ids("node", "to_node"), ids("edge_id")
    source, to, edge = number("node", nodes), number("to_node", nodes), number("edge_id", edges)
    order = np.argsort(source, kind="stable")
    at = None
    if places:
        at = np.zeros((len(nodes), 2))
        for end, number_of in (("a", source), ("b", to)):
            at[number_of] = np.stack([rows[f"{end}_{c}"].to_numpy() for c in ("lon", "lat")], axis=1)
    return _Network(nodes, edges, np.searchsorted(source[order], np.arange(len(nodes) + 1)), to[order], edge[order], *[rows[n].to_numpy()[order] for n in ("w", "length", "travel_time")], at)


def _searched(steps: DataFrame, sources: DataFrame, max_cost: float | None, paths: bool, targets: DataFrame | None, directed: bool, mode: str) -> DataFrame:
    """``shortest_paths`` on a network that fits every task: a search from each source on its own."""
    net = _network(steps, directed)
    least = np.inf
    if directed and len(net.to):
        a, b = np.radians(net.places[np.repeat(np.arange(len(net.nodes)), np.diff(net.first))]), np.radians(net.places[net.to])
        h = np.sin((b[:, 1] - a[:, 1]) / 2) ** 2 + np.cos(a[:, 1]) * np.cos(b[:, 1]) * np.sin((b[:, 0] - a[:, 0]) / 2) ** 2
        straight = 2 * g.RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
        least = float(np.min(net.w[straight > 0] / straight[straight > 0], initial=np.inf))
    # what a metre costs at least, on any road; a little less, so that rounding does not matter
    metre = 0.0 if not directed or not np.isfinite(least) else (1 - 1e-9) * min(least, 1 / FASTEST_M_S if mode == "shortest_time" else 1.0)
    sent = steps.sparkSession.sparkContext.broadcast(net)
    names = ["source", "node", "cost", "distance", "travel_time", *["edges"] * paths]
    rows = sources.select(F.col("source").cast("string").alias("source")).distinct().withColumn("targets", F.lit(None).cast("array<string>"))
    if targets is not None:
        rows = targets.groupBy("source").agg(F.collect_list("target").alias("targets"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        first, to_of, edge_of, w_of, length_of, seconds_of = (x.tolist() for x in net[2:8])
        numbers = lambda ids: pc.index_in(pa.array(ids, pa.string()), value_set=net.nodes).to_pylist()
        for batch in batches:
            for source, start, wanted in zip(batch["source"], numbers(batch["source"]), batch["targets"], strict=True):
                if start is None:  # a place that no arc touches reaches itself
                    if wanted is None or source in set(wanted):
                        yield pd.DataFrame([(source, source, 0.0, 0.0, 0.0, *[[]] * paths)], columns=names)
                    continue
                wanted = None if wanted is None else {n for n in numbers(list(wanted)) if n is not None}
                goal = net.places[next(iter(wanted))] if metre and wanted is not None and len(wanted) == 1 else None
                ahead = (lambda node, goal=goal: metre * _straight(net.places[node], goal)) if goal is not None else (lambda node: 0.0)
                settled: dict[int, tuple] = {}
                queue = [(0.0, 0.0, 0, -1, -1, start, 0.0, 0.0)]
                open_targets = None if wanted is None else set(wanted)
                while queue and open_targets != set():
                    _, cost, hops, edge, before, node, length, seconds = heapq.heappop(queue)
                    if node in settled:
                        continue
                    settled[node] = (cost, length, seconds, before, edge)
                    if open_targets is not None:
                        open_targets.discard(node)
                    for i in range(first[node], first[node + 1]):
                        to, total = to_of[i], cost + w_of[i]
                        if to not in settled and (max_cost is None or total <= max_cost):
                            heapq.heappush(queue, (total + ahead(to), total, hops + 1, edge_of[i], node, to, length + length_of[i], seconds + seconds_of[i]))
                shown = [n for n in settled if wanted is None or n in wanted]
                if not shown:
                    continue
                out = pd.DataFrame([(source, *settled[n][:3]) for n in shown], columns=["source", *names[2:5]])
                out.insert(1, "node", net.nodes.take(pa.array(shown)).to_pylist())
                if paths:
                    out["edges"] = [net.edges.take(pa.array(_edges(settled, start, n), pa.int32())).to_pylist() for n in shown]
                yield out

    schema = "source string, node string, cost double, distance double, travel_time double" + ", edges array<string>" * paths
    return rows.mapInPandas(search, schema)


def _edges(settled: dict[int, tuple], source: int, node: int) -> list[int]:
    out = []
    while node != source:
        out.append(settled[node][4])
        node = settled[node][3]
    return out[::-1]


def _straight(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Metres between two places (lon, lat)."""
    x1, y1, x2, y2 = np.radians([*a, *b])
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return float(2 * g.RADIUS_M * np.arcsin(min(1.0, np.sqrt(h))))


def routes(arc_rows: DataFrame, pairs: DataFrame, mode: str = "shortest_distance", algorithm: str = "dijkstra") -> DataFrame:
    """For each pair (source, target): found, distance, estimated_time, road_sequence, node_sequence, geometry.

    A pair of one node is found with nothing to travel. Later roads of the geometry drop
    their first vertex. ``algorithm`` as in ``shortest_paths``.
    """
    best = shortest_paths(arc_rows, pairs.select("source"), mode, paths=True, targets=pairs, algorithm=algorithm)
    got = pairs.select("source", "target").distinct().join(best.withColumnRenamed("node", "target"), ["source", "target"], "left")
    found = F.col("edges").isNotNull()
    out = got.select("source", "target", found.alias("found"), F.coalesce("distance", F.lit(0.0)).alias("distance"), F.coalesce("travel_time", F.lit(0.0)).alias("estimated_time"), F.coalesce("edges", F.array().cast("array<string>")).alias("road_sequence"))
    steps = out.select("source", "target", F.posexplode("road_sequence").alias("step", "edge_id"))
    alone = F.when(F.col("found"), F.array("source")).otherwise(F.array().cast("array<string>"))
    drawn = out.join(_drawn(steps, arc_rows), ["source", "target"], "left")
    return drawn.withColumns({"node_sequence": F.coalesce("node_sequence", alone), "geometry": F.coalesce("geometry", F.array().cast("array<struct<lon:double,lat:double>>"))})


def _drawn(steps: DataFrame, arc_rows: DataFrame) -> DataFrame:
    """Nodes and geometry of routes from (source, target, step, edge_id); which way a road is travelled follows from the road before and after."""
    ways = steps.join(arc_rows.select("edge_id", "from_node", "to_node", "geometry"), "edge_id")
    options = ways.groupBy("source", "target", "step").agg(F.collect_list(F.struct("from_node", "to_node", "geometry")).alias("ways"))
    routed = options.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("step", "ways"))).alias("steps"))

    def walk(acc: Column, s: Column) -> Column:
        way = F.element_at(F.filter(s["ways"], lambda w: w["from_node"] == F.element_at(acc["nodes"], -1)), 1)
        line = F.when(F.size(acc["line"]) > 0, F.slice(way["geometry"], 2, F.size(way["geometry"]))).otherwise(way["geometry"])
        return F.struct(F.concat(acc["nodes"], F.array(way["to_node"])).alias("nodes"), F.concat(acc["line"], line).alias("line"))

    zero = F.struct(F.array("source").alias("nodes"), F.array().cast("array<struct<lon:double,lat:double>>").alias("line"))
    drawn = routed.withColumn("d", F.aggregate("steps", zero, walk))
    return drawn.select("source", "target", F.col("d.nodes").alias("node_sequence"), F.col("d.line").alias("geometry"))


def merged_legs(legs: DataFrame, by: str) -> DataFrame:
    """Routes of several legs (``by``, leg, and the columns of ``routes``) as one row each; found only if every leg is."""
    ordered = legs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("leg", "found", "distance", "estimated_time", "road_sequence", "geometry"))).alias("legs"))
    total = lambda name: F.aggregate("legs", F.lit(0.0), lambda a, leg: a + leg[name])
    lines = F.transform("legs", lambda leg, i: F.when(i == 0, leg["geometry"]).otherwise(F.slice(leg["geometry"], 2, F.greatest(F.size(leg["geometry"]), F.lit(1)))))
    return ordered.select(
        by, F.forall("legs", lambda leg: leg["found"]).alias("found"), total("distance").alias("distance"), total("estimated_time").alias("estimated_time"),
        F.flatten(F.transform("legs", lambda leg: leg["road_sequence"])).alias("road_sequence"), F.flatten(lines).alias("geometry"),
    )


def explained_routes(
    arc_rows: DataFrame, pairs: DataFrame, mode: str = "shortest_distance", *, preferred: list[str] | None = None, turn_penalty_s: float = 8.0, max_rounds: int | None = None
) -> DataFrame:
    """For each pair (source, target) the cheapest route when turns and roads of other classes cost extra.

    (found, cost, distance_m, travel_time_s, turn_cost_s, road_class_cost, steps); a state
    of the search is a node and the road it was reached by; states that cost as much as the
    farthest target of their source, once all are reached, are not followed. Up to
    BROADCAST_ARCS arcs, tasks search by themselves as in ``shortest_paths``. Seconds of turns are added to
    whatever the mode counts, metres included. ``max_rounds`` as in ``shortest_paths``.
    """
    weight = F.col("travel_time") if mode == "shortest_time" else F.col("length")
    steps = arc_rows.select(F.col("from_node").alias("node"), "to_node", F.col("edge_id").alias("next_edge"), F.col("heading").alias("next_heading"), "length", "travel_time", weight.alias("w"), g.class_preference_cost(F.col("road_class"), F.col("length"), preferred or []).alias("class_cost"))
    steps = materialised(steps)
    if steps.count() <= BROADCAST_ARCS:
        best = _explained(steps, pairs, turn_penalty_s)
        got = pairs.select("source", "target").distinct().join(best, ["source", "target"], "left")
        return got.select("source", "target", F.col("cost").isNotNull().alias("found"), *EXPLAINED)
    step_type = "array<struct<edge_id:string,from_node:string,to_node:string,length:double,travel_time:double,turn_cost:double,road_class_cost:double>>"
    zero = F.lit(0.0)
    seeds = pairs.select("source").distinct().select(
        "source", F.col("source").alias("node"), F.lit("").alias("edge"),
        F.struct(zero.alias("cost"), zero.alias("distance_m"), zero.alias("travel_time_s"), zero.alias("turn_cost_s"), zero.alias("road_class_cost"), F.lit(None).cast("double").alias("heading"), F.array().cast(step_type).alias("steps")).alias("v"),
    )

    def advance(new: DataFrame) -> DataFrame:
        turn = g.turn_cost(F.nullif("edge", F.lit("")), F.col("v.heading"), F.col("next_edge"), F.col("next_heading"), turn_penalty_s)
        rows = new.join(steps, "node").withColumn("turn", turn)
        step = F.struct(F.col("next_edge").alias("edge_id"), F.col("node").alias("from_node"), "to_node", "length", "travel_time", F.col("turn").alias("turn_cost"), F.col("class_cost").alias("road_class_cost"))
        return rows.select(
            "source", F.col("to_node").alias("node"), F.col("next_edge").alias("edge"),
            F.struct(
                (F.col("v.cost") + F.col("w") + F.col("turn") + F.col("class_cost")).alias("cost"), (F.col("v.distance_m") + F.col("length")).alias("distance_m"), (F.col("v.travel_time_s") + F.col("travel_time")).alias("travel_time_s"),
                (F.col("v.turn_cost_s") + F.col("turn")).alias("turn_cost_s"), (F.col("v.road_class_cost") + F.col("class_cost")).alias("road_class_cost"), F.col("next_heading").alias("heading"), F.concat("v.steps", F.array(step)).cast(step_type).alias("steps"),
            ).alias("v"),
        )

    def nearer_than_targets(new: DataFrame, best: DataFrame) -> DataFrame:
        reached = best.groupBy("source", F.col("node").alias("target")).agg(F.min("v.cost").alias("_c"))
        farthest = pairs.select("source", "target").distinct().join(reached, ["source", "target"], "left").groupBy("source").agg(F.max(F.coalesce("_c", F.lit(float("inf")))).alias("_farthest"))
        return new.join(farthest, "source").where(F.col("v.cost") < F.col("_farthest")).drop("_farthest")

    best = _relax(seeds, ["source", "node", "edge"], advance, max_rounds, useful=nearer_than_targets).groupBy("source", F.col("node").alias("target")).agg(F.min("v").alias("v"))
    got = pairs.select("source", "target").distinct().join(best, ["source", "target"], "left")
    return got.select("source", "target", F.col("v").isNotNull().alias("found"), *[F.col(f"v.{c}") for c in EXPLAINED])


def _explained(steps: DataFrame, pairs: DataFrame, turn_penalty_s: float) -> DataFrame:
    """(source, target, EXPLAINED) of the pairs that have a route, on a network that fits every task: a search over nodes and roads they are reached by."""
    ways: dict[str, list[tuple]] = {}
    for r in steps.toPandas().itertuples(index=False):  # counted by the caller
        ways.setdefault(r.node, []).append((r.to_node, r.next_edge, r.next_heading, r.length, r.travel_time, r.w, r.class_cost))
    sent = steps.sparkSession.sparkContext.broadcast(ways)
    names = ["edge_id", "from_node", "to_node", "length", "travel_time", "turn_cost", "road_class_cost"]

    def turn(edge: str, heading: float, next_edge: str, next_heading: float) -> float:
        angle = abs((heading - next_heading + 180.0) % 360.0 - 180.0)
        return 0.0 if edge in ("", next_edge) or angle < 35 else 2 * turn_penalty_s if angle > 150 else turn_penalty_s * angle / 90.0

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways = sent.value
        for batch in batches:
            for source, targets in zip(batch["source"], batch["targets"], strict=True):
                left, out = set(targets), []
                settled: dict[tuple[str, str], tuple] = {}
                queue = [(0.0, 0, 0.0, 0.0, 0.0, 0.0, source, "", 0.0, None)]
                while queue and left:
                    cost, hops, metres, seconds, turns, classes, node, edge, heading, before = heapq.heappop(queue)
                    if (node, edge) in settled:
                        continue
                    settled[node, edge] = (before, metres, seconds, turns, classes)
                    if node in left:
                        left.discard(node)
                        out.append((source, node, cost, metres, seconds, turns, classes, _told(settled, (node, edge), ways, names, turn)))
                    for to, by, next_heading, length, longer, w, class_cost in ways.get(node, ()):
                        if (to, by) not in settled:
                            t = turn(edge, heading, by, next_heading)
                            heapq.heappush(queue, (cost + w + t + class_cost, hops + 1, metres + length, seconds + longer, turns + t, classes + class_cost, to, by, next_heading, (node, edge)))
                if out:
                    yield pd.DataFrame(out, columns=["source", "target", *EXPLAINED])

    schema = "source string, target string, cost double, distance_m double, travel_time_s double, turn_cost_s double, road_class_cost double, steps array<struct<" + ", ".join(f"{n}:{'string' if k < 3 else 'double'}" for k, n in enumerate(names)) + ">>"
    return pairs.groupBy("source").agg(F.collect_set("target").alias("targets")).mapInPandas(search, schema)


def _told(settled: dict, state: tuple[str, str], ways: dict, names: list[str], turn) -> list[dict]:
    """The steps of the way to a state, each with what it adds."""
    chain = []
    while state is not None:
        chain.append(state)
        state = settled[state][0]
    out, heading = [], 0.0
    for (node, edge), (to, by) in zip(chain[::-1], chain[-2::-1], strict=False):
        found = next(w for w in ways[node] if w[0] == to and w[1] == by)
        out.append(dict(zip(names, (by, node, to, found[3], found[4], turn(edge, heading, by, found[2]), found[6]), strict=True)))
        heading = found[2]
    return out
