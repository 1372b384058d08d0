"""Topology on a small dirty network and on random lines."""

from __future__ import annotations

import numpy as np
import pytest
from maps import node_table, random_roads, road_table
from pyspark.sql import functions as F

from roadloom.operators import spatial, topology

PLACES = {"a": (0, 0), "b": (2, 0), "c": (1, -1), "d": (1, 1), "b_near": (2.00000001, 0)}


@pytest.fixture
def dirty(spark):
    roads = road_table(spark, [("horizontal", "a", "b", [(0, 0), (2, 0)]), ("vertical", "c", "d", [(1, -1), (1, 1)]), ("duplicate", "a", "b_near", [(0, 0), (2.00000001, 0)])])
    return node_table(spark, PLACES), roads


def test_issues_before_and_after_repair(spark, dirty):
    nodes, roads = dirty
    kinds = {r["type"] for r in topology.validate(nodes, roads).collect()}
    assert {"illegal_crossing", "dangling_edge"} <= kinds
    fixed_nodes, fixed, operations = topology.repair(nodes, roads.drop(*spatial.BOX), 2.0)
    done = operations.first()
    assert done["snapped_nodes"] == 1 and done["split_edges_added"] > 0 and done["duplicate_edges_removed"] >= 1
    assert done["before_illegal_crossings"] > 0 and done["after_illegal_crossings"] == 0
    assert {r["id"] for r in fixed.collect()} == {"horizontal_split_0", "horizontal_split_1", "vertical_split_0", "vertical_split_1"}
    assert all(r["metadata"]["source_edge"] in ("horizontal", "vertical") for r in fixed.collect())
    assert {r["id"] for r in fixed_nodes.collect()} >= {"a", "b", "c", "d", "node_1_0000000_0_0000000"}


def test_duplicates_ignore_direction_and_shape(spark):
    roads = road_table(spark, [("x", "a", "b", [(0, 0), (1, 0)]), ("y", "b", "a", [(1, 0), (0.5, 1), (0, 0)]), ("z", "a", "c", [(0, 0), (1, 1)])])
    assert [tuple(r) for r in topology.duplicate_edges(roads).collect()] == [("x", "y")]
    assert {r["id"] for r in topology.without_duplicates(roads).collect()} == {"x", "z"}


def test_self_intersections(spark):
    roads = road_table(
        spark,
        [("eight", "a", "b", [(0, 0), (2, 2), (2, 0), (0, 2)]), ("ring", "c", "c", [(0, 0), (1, 0), (1, 1), (0, 0)]), ("plain", "d", "e", [(0, 0), (1, 0), (2, 1), (3, 1)])],
    )
    got = topology.self_intersections(roads).collect()
    assert [(r["road_id"], r["seg_a"], r["seg_b"]) for r in got] == [("eight", 0, 2)]
    assert (got[0]["lon"], got[0]["lat"]) == pytest.approx((1, 1))


def test_overlaps_and_shared_nodes(spark):
    roads = road_table(spark, [("x", "a", "b", [(0, 0), (2, 0)]), ("y", "c", "d", [(1, 0), (3, 0)]), ("z", "a", "e", [(0, 0), (2, 0.0)])])
    got = {(r["type"], r["first"], r["second"]) for r in topology.crossings(roads).collect()}
    assert got == {("overlapping_roads", "x", "y"), ("overlapping_roads", "y", "z")}


def test_crossings_equal_brute_force(spark):
    rows, roads = random_roads(spark, 40, seed=3, span=0.01)
    got = {(r["first"], r["second"], r["seg_a"], r["seg_b"]) for r in topology.crossings(roads).collect()}

    def turn(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return 0 if abs(v) <= 1e-12 else np.sign(v)

    want = set()
    for i, (first, _, _, a) in enumerate(rows):
        for second, _, _, b in rows[i + 1 :]:
            for m, (p, q) in enumerate(zip(a, a[1:], strict=False)):
                for n, (r, s) in enumerate(zip(b, b[1:], strict=False)):
                    if turn(p, q, r) != turn(p, q, s) and turn(r, s, p) != turn(r, s, q):
                        want.add((first, second, m, n))
    assert got and got == want


def test_snapping_follows_the_order(spark):
    step = 0.9 / 111_195
    chain = node_table(spark, {f"n{i}": (i * step, 0.0) for i in range(5)} | {"far": (1.0, 1.0)})
    got = {r["id"]: (r["rep_id"], r["lon"]) for r in topology.snap_nodes(chain, 1.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {"n0": "n0", "n1": "n0", "n2": "n2", "n3": "n2", "n4": "n4", "far": "far"}
    assert got["n0"][1] == pytest.approx(step / 2)


def test_first_leaders_equal_the_loop():
    rng = np.random.default_rng(4)
    for centre, tolerance in ((39.0, 5.0), (0.0, 1.0), (-78.0, 20.0), (86.0, 50.0)):
        lon, lat = 116 + rng.normal(0, 0.0002 / np.cos(np.radians(centre)), 300), centre + rng.normal(0, 0.0002, 300)
        x, y = np.radians(lon), np.radians(lat)
        leaders, want = [], []
        for i in range(300):
            near = [k for k in leaders if topology._metres(x[i], y[i], x[k], y[k]) <= tolerance]
            want.append(near[0] if near else i)
            leaders += [] if near else [i]
        assert topology.first_leaders(lon, lat, tolerance).tolist() == want


def test_cuts_close_together_are_one(spark):
    roads = road_table(spark, [("x", "a", "b", [(0, 0), (2, 0)]), ("y", "c", "d", [(1, -1), (1, 1)]), ("z", "e", "f", [(1 + 5e-10, -1), (1 + 5e-10, 1)])])
    cut = topology.split_roads(roads.drop(*spatial.BOX)).orderBy("pos").collect()
    assert [r["id"] for r in cut] == ["x_split_0", "x_split_1", "y_split_0", "y_split_1", "z_split_0", "z_split_1"] and [r["pos"] for r in cut] == list(range(6))


def test_splitting_keeps_length(spark):
    _, roads = random_roads(spark, 40, seed=3, span=0.01)
    before = roads.agg(F.sum("length")).first()[0]
    cut = topology.split_roads(roads.drop(*spatial.BOX))
    assert cut.count() > roads.count()
    assert cut.agg(F.sum("length")).first()[0] == pytest.approx(before, rel=1e-6)
    assert cut.select("id").distinct().count() == cut.count()


def test_roads_that_share_a_node_stay_whole(spark):
    roads = road_table(spark, [("x", "a", "b", [(116.39, 39.9), (116.40, 39.91)]), ("y", "b", "c", [(116.40, 39.91), (116.41, 39.913)]), ("z", "b", "d", [(116.40, 39.91), (116.40, 39.92)])])
    assert {r["id"] for r in topology.split_roads(roads.drop(*spatial.BOX)).collect()} == {"x", "y", "z"}


def test_summary(spark, dirty):
    nodes, roads = dirty
    got = topology.summary(nodes, roads).first()
    assert got["components"] == 2 and got["isolated_nodes"] == 0 and got["issues"] >= 3
