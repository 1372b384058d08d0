"""Graph operators against Dijkstra in Python."""

from __future__ import annotations

import heapq

import pytest
from maps import node_table, road_table
from pyspark.sql import functions as F

from roadloom.operators import graph

PLACES = {f"n{i}": (116 + 0.01 * (i % 4), 39 + 0.013 * (i // 4)) for i in range(12)} | {"lost": (117.0, 39.0)}


@pytest.fixture(params=["broadcast", "relaxed"], autouse=True)
def way(request, monkeypatch):
    """Both ways to find paths."""
    if request.param == "relaxed":
        monkeypatch.setattr(graph, "BROADCAST_ARCS", 0)


@pytest.fixture(scope="module")
def town(spark):
    rows = []
    for i in range(12):
        for j, name in ((i + 1, "h"), (i + 4, "v"), (i + 5, "d")):
            if j < 12 and not (name in "hd" and i % 4 == 3) and not (name == "d" and i % 2):
                rows.append((f"{name}{i}", f"n{i}", f"n{j}", [PLACES[f"n{i}"], PLACES[f"n{j}"]]))
    return node_table(spark, PLACES), road_table(spark, rows)


def dijkstra(arcs, source, weight):
    best, queue = {}, [(0.0, source)]
    while queue:
        cost, node = heapq.heappop(queue)
        if node in best:
            continue
        best[node] = cost
        for a in arcs:
            if a["from_node"] == node:
                heapq.heappush(queue, (cost + a[weight], a["to_node"]))
    return best


def test_arcs_and_degrees(spark, town):
    nodes, roads = town
    arcs = graph.arcs(roads)
    assert arcs.count() == 2 * roads.count()
    assert graph.arcs(roads.withColumn("oneway", roads["id"] == "h0")).count() == 2 * roads.count() - 1
    degree = {r["node_id"]: r["degree"] for r in graph.node_degree(nodes, roads).collect()}
    assert degree["lost"] == 0 and degree["n5"] == sum("n5" in (r["from_node"], r["to_node"]) for r in roads.collect())


@pytest.mark.parametrize(("mode", "weight"), [("shortest_distance", "length"), ("shortest_time", "travel_time")])
def test_paths_are_shortest(spark, town, mode, weight):
    nodes, roads = town
    arcs = graph.arcs(roads)
    rows = arcs.collect()
    sources = spark.createDataFrame([("n0",), ("n7",), ("lost",)], "source string")
    got = {(r["source"], r["node"]): r["cost"] for r in graph.shortest_paths(arcs, sources, mode).collect()}
    want = {(s, n): c for s in ("n0", "n7", "lost") for n, c in dijkstra(rows, s, weight).items()}
    assert got == pytest.approx(want)


def test_a_bound_reports_nearer_nodes_only(spark, town):
    arcs = graph.arcs(town[1])
    source = spark.createDataFrame([("n0",)], "source string")
    want = {n: c for n, c in dijkstra(arcs.collect(), "n0", "length").items() if c <= 2000}
    assert {r["node"]: r["cost"] for r in graph.shortest_paths(arcs, source, max_cost=2000.0).collect()} == pytest.approx(want)


def test_routes_join_up(spark, town):
    nodes, roads = town
    arcs = graph.arcs(roads)
    pairs = spark.createDataFrame([("n0", "n11"), ("n11", "n0"), ("n3", "n3"), ("n0", "lost")], "source string, target string")
    got = {(r["source"], r["target"]): r for r in graph.routes(arcs, pairs).collect()}
    way = got["n0", "n11"]
    assert way["found"] and way["distance"] == pytest.approx(dijkstra(arcs.collect(), "n0", "length")["n11"])
    assert way["node_sequence"][0] == "n0" and way["node_sequence"][-1] == "n11" and len(way["node_sequence"]) == len(way["road_sequence"]) + 1
    assert [tuple(q) for q in way["geometry"]] == [pytest.approx(PLACES[n]) for n in way["node_sequence"]]
    assert got["n3", "n3"]["found"] and got["n3", "n3"]["distance"] == 0 and got["n3", "n3"]["node_sequence"] == ["n3"]
    assert not got["n0", "lost"]["found"]


def test_blocked_edges_are_avoided(spark, town):
    arcs = graph.arcs(town[1])
    source = spark.createDataFrame([("n0",)], "source string")
    blocked = spark.createDataFrame([("h0",), ("v0",), ("d0",)], "road_id string")
    assert {r["node"] for r in graph.shortest_paths(graph.without(arcs, blocked), source).collect()} == {"n0"}


def test_explained_route_weighs_turns(spark, town):
    nodes, roads = town
    arcs = graph.arcs(roads)
    rows = arcs.collect()
    pairs = spark.createDataFrame([("n0", "n10")], "source string, target string")
    got = graph.explained_routes(arcs, pairs, "shortest_time", turn_penalty_s=40.0).first()

    def turn(a, b):
        angle = abs((a["heading"] - b["heading"] + 180) % 360 - 180)
        return 0 if a["edge_id"] == b["edge_id"] or angle < 35 else 80 if angle > 150 else 40 * angle / 90

    best, queue, n = None, [(0.0, 0, "n0", None)], 0
    seen = {}
    while queue:
        cost, _, node, last = heapq.heappop(queue)
        if node == "n10":
            best = cost
            break
        key = (node, last and last["edge_id"])
        if seen.get(key, 1e18) <= cost:
            continue
        seen[key] = cost
        for a in rows:
            if a["from_node"] == node:
                n += 1
                heapq.heappush(queue, (cost + a["travel_time"] + (turn(last, a) if last else 0), n, a["to_node"], a))
    assert got["cost"] == pytest.approx(best)
    assert got["cost"] == pytest.approx(got["travel_time_s"] + got["turn_cost_s"])
    assert sum(s["turn_cost"] for s in got["steps"]) == pytest.approx(got["turn_cost_s"])
    assert [s["from_node"] for s in got["steps"]][0] == "n0" and [s["to_node"] for s in got["steps"]][-1] == "n10"
    assert all(a["to_node"] == b["from_node"] for a, b in zip(got["steps"], got["steps"][1:], strict=False))
    every = graph.explained_routes(arcs, spark.createDataFrame([("n0", "n0"), ("n0", "lost")], "source string, target string"), preferred=["local"]).collect()
    assert {(r["target"], r["found"], r["cost"]) for r in every} == {("n0", True, 0.0), ("lost", False, None)}


def test_more_arcs_than_rounds_is_no_silent_cut(spark):
    places = {f"c{i}": (116 + 0.01 * i, 39.0) for i in range(6)}
    arcs = graph.arcs(road_table(spark, [(f"r{i}", f"c{i}", f"c{i + 1}", [places[f"c{i}"], places[f"c{i + 1}"]]) for i in range(5)]))
    source, pairs = spark.createDataFrame([("c0",)], "source string"), spark.createDataFrame([("c0", "c5")], "source string, target string")
    want = dijkstra(arcs.collect(), "c0", "length")
    costs = lambda **more: {r["node"]: r["cost"] for r in graph.shortest_paths(arcs, source, **more).collect()}
    assert costs() == pytest.approx(want) and len(want) == 6
    if graph.BROADCAST_ARCS:
        assert costs(max_rounds=4) == pytest.approx(want)
    else:
        with pytest.raises(RuntimeError, match="max_rounds"):
            costs(max_rounds=4)
    assert graph.explained_routes(arcs, pairs).first()["found"]
    if not graph.BROADCAST_ARCS:
        with pytest.raises(RuntimeError, match="max_rounds"):
            graph.explained_routes(arcs, pairs, max_rounds=4)


def test_an_arc_of_unknown_length_ends_the_search(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ARCS", 0)
    places = {f"c{i}": (116 + 0.01 * i, 39.0) for i in range(3)}
    roads = road_table(spark, [(f"r{i}", f"c{i}", f"c{i + 1}", [places[f"c{i}"], places[f"c{i + 1}"]]) for i in range(2)])
    arcs = graph.arcs(roads.withColumn("length", F.when(F.col("id") != "r1", F.col("length"))))
    got = graph.shortest_paths(arcs, spark.createDataFrame([("c0",)], "source string"), max_rounds=30)
    assert {r["node"] for r in got.collect()} == {"c0", "c1", "c2"}


def test_ties_go_the_same_way_whatever_the_size(spark):
    """Four equal ways over a square grid: fewest roads, then the smallest last road and node before it."""
    places = {f"p{i}{j}": (0.01 * i, 0.0) for i in range(4) for j in range(4)}
    rows = []
    for i in range(4):
        for j in range(4):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < 4 and b < 4:
                    rows.append((f"e{9 - len(rows) % 10}{len(rows)}", f"p{i}{j}", f"p{a}{b}", [places[f"p{i}{j}"], places[f"p{a}{b}"]]))
    roads = road_table(spark, rows).withColumns({"length": F.lit(1.0), "oneway": F.lit(True)})
    pairs = spark.createDataFrame([("p00", "p33"), ("p00", "p22"), ("p11", "p33"), ("p00", "p30"), ("p33", "p00")], "source string, target string")
    arcs = graph.arcs(roads)
    got = {(r["source"], r["target"]): r["road_sequence"] for r in graph.routes(arcs, pairs).collect()}
    into = {}
    for e, a, b, _ in rows:
        into.setdefault(b, []).append((e, a))

    def smallest(source, node):  # every way from p00 to a node has as many roads
        reach = {source}
        for _ in range(6):
            reach |= {b for _, a, b, _ in rows if a in reach}
        if node not in reach:
            return []
        out = []
        while node != source:
            e, node = min((e, a) for e, a in into[node] if a in reach)
            out.append(e)
        return out[::-1]

    assert got == {(s, t): smallest(s, t) for s, t in got}
    goal = {(r["source"], r["target"]): r["road_sequence"] for r in graph.routes(arcs, pairs, algorithm="astar").collect()}
    assert {k: len(v) for k, v in goal.items()} == {k: len(v) for k, v in got.items()}


@pytest.mark.parametrize("mode", ["shortest_distance", "shortest_time"])
def test_goal_directed_search_finds_the_same_costs(spark, town, mode):
    nodes, roads = town
    short = roads.withColumn("length", F.when(F.col("id").startswith("d"), F.col("length") / 3).otherwise(F.col("length")))  # shorter than the straight line
    arcs = graph.arcs(short)
    pairs = nodes.select(F.col("id").alias("source")).crossJoin(nodes.select(F.col("id").alias("target")))
    cost = "distance" if mode == "shortest_distance" else "estimated_time"
    found = [{(r["source"], r["target"]): (r["found"], r[cost]) for r in graph.routes(arcs, pairs, mode, a).collect()} for a in ("dijkstra", "astar")]
    assert found[0].keys() == found[1].keys() and all(found[0][k] == pytest.approx(found[1][k]) for k in found[0])
    with pytest.raises(ValueError, match="unknown algorithm"):
        graph.routes(arcs, pairs, mode, "x")


def test_rows_are_the_pairs_asked_for(spark, town):
    arcs = graph.arcs(town[1])
    targets = spark.createDataFrame([("n0", "n5"), ("n0", "n10"), ("n3", "n3"), ("n7", "lost")], "source string, target string")
    got = {(r["source"], r["node"]): r["cost"] for r in graph.shortest_paths(arcs, None, targets=targets).collect()}
    rows = arcs.collect()
    assert got == pytest.approx({("n0", "n5"): dijkstra(rows, "n0", "length")["n5"], ("n0", "n10"): dijkstra(rows, "n0", "length")["n10"], ("n3", "n3"): 0.0})


def test_stars_are_dealt_out(spark, monkeypatch):
    from roadloom.operators import skew

    monkeypatch.setattr(skew, "PARTS", 3)
    edges = spark.createDataFrame([("hub", f"s{i:03d}") for i in range(200)] + [(f"s{i:03d}", f"s{i + 1:03d}") for i in range(0, 200, 7)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([("solo",)], "id string"), edges).collect()}
    assert got == {"hub": "hub", "solo": "solo", "x": "x", "y": "x"} | {f"s{i:03d}": "hub" for i in range(200)} | ({"s200": "hub"} if "s200" in got else {})


def test_components(spark, town):
    nodes, roads = town
    got = graph.network_components(nodes, roads.where("id in ('h0', 'h1', 'v8', 'v4', 'h8')")).collect()
    assert [r["members"] for r in got][:2] == [["n0", "n1", "n2"], ["n4", "n8", "n9"]]
    assert sum(r["size"] for r in got) == 13


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "x")], "a string, b string")
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([("solo",)], "id string"), edges).collect()}
    assert got == {f"{i:03d}": "000" for i in range(61)} | {"x": "x", "solo": "solo"}
