"""Spatial operators against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from maps import FENCE, node_table, random_roads, road_table
from pyspark.sql import functions as F

from roadloom.operators import measures, spatial
from roadloom.operators.trajectory import _feet, distance_matrix


def _distance(point, line):
    line = np.array(line)
    return min(float(_feet(np.array([point]), a, b)[0]) for a, b in zip(line, line[1:], strict=False))


def test_nearest_roads_equal_brute_force(spark):
    rows, roads = random_roads(spark, 40)
    rng = np.random.default_rng(1)
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.array([116.0, 39.0]) + rng.uniform(-0.02, 0.07, (30, 2)))] + [(99, 118.0, 38.0)]
    points = spark.createDataFrame(places, "place int, lon double, lat double")
    got = {}
    for r in spatial.nearest_roads(points, roads, ["place"], 5).collect():
        got.setdefault(r["place"], []).append((r["cand_rank"], r["road_id"], r["distance"]))
    for place, x, y in places:
        best = sorted((round(_distance((x, y), line), 6), i) for i, _, _, line in rows)[:5]
        assert [g[1] for g in sorted(got[place])] == [i for _, i in best]
        assert [g[2] for g in sorted(got[place])] == pytest.approx([d for d, _ in best], abs=1e-5)


def test_nearest_roads_of_few_or_none(spark):
    _, roads = random_roads(spark, 2)
    points = spark.createDataFrame([(0, 116.0, 39.0), (1, None, 39.0)], "place int, lon double, lat double")
    assert spatial.nearest_roads(points, roads, ["place"], 5).count() == 2
    assert spatial.nearest_roads(points, roads.limit(0), ["place"], 5).count() == 0


def test_nearest_roads_never_broadcast(spark, monkeypatch):
    """Stored points compress so well that Spark takes millions of them for a few MB and sends them through the driver."""
    plans = []
    stored = spatial.materialised
    monkeypatch.setattr(spatial, "materialised", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    _, roads = random_roads(spark, 40)
    points = spark.range(200).select(F.col("id").alias("place"), (116.0 + F.col("id") * 0.0004).alias("lon"), F.lit(39.02).alias("lat"))
    found = spatial.nearest_roads(stored(points), stored(roads), ["place"], 1)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 200
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)


def test_points_of_one_cell_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SHARE", 20, raising=False)
    folders = []
    stored = spatial.materialised
    monkeypatch.setattr(spatial, "materialised", lambda df: folders.append(stored(df)) or folders[-1])
    rows, roads = random_roads(spark, 40)
    rng = np.random.default_rng(9)
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.array([116.02, 39.02]) + rng.uniform(0.0005, 0.0095, (300, 2)))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = spatial.nearest_roads(spark.createDataFrame(places, "place int, lon double, lat double"), roads, ["place"], 3)
        tasks = max(df.select(F.input_file_name()).distinct().count() for df in folders if "place" in df.columns)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = {}
    for r in found.collect():
        got.setdefault(r["place"], []).append((r["cand_rank"], r["road_id"]))
    assert len(got) == 300 and tasks > 1
    for place, x, y in places:
        assert [g[1] for g in sorted(got[place])] == [i for _, i in sorted((round(_distance((x, y), line), 6), i) for i, _, _, line in rows)[:3]]


def test_nearest_node(spark):
    nodes = node_table(spark, {f"n{i}": (116 + 0.01 * (i % 5), 39 + 0.01 * (i // 5)) for i in range(20)})
    points = spark.createDataFrame([(0, 116.012, 39.019), (1, 115.0, 39.0)], "place int, lon double, lat double")
    assert {r["place"]: r["node_id"] for r in spatial.nearest_node(points, nodes, ["place"]).collect()} == {0: "n11", 1: "n0"}


@pytest.mark.parametrize("size", [0.001, 0.01, 0.5])
def test_box_join_equals_brute_force(spark, size):
    _, roads = random_roads(spark, 30, seed=5)
    boxes = roads.select("id", *spatial.BOX)
    got = {(r["l_id"], r["r_id"]) for r in spatial.bbox_join(boxes, boxes, size).collect()}
    rows = boxes.collect()
    want = {(a["id"], b["id"]) for a in rows for b in rows if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert got == want
    assert spatial.bbox_join(boxes, boxes, size).count() == len(want)


def test_points_polygons_and_events(spark):
    fence = spatial.polygon_rows(spark, [FENCE[0][:-1]], "f")
    steps = [("t", 0, 116.39, 39.91), ("t", 1, 116.40, 39.91), ("t", 2, 116.401, 39.91), ("t", 3, 116.41, 39.91), ("t", 4, 116.406, 39.91), ("u", 0, 116.40, 39.91)]
    points = spark.createDataFrame(steps, "trajectory_id string, point_index int, lon double, lat double")
    held = {(r["trajectory_id"], r["point_index"], r["side"]) for r in spatial.points_in_polygons(points, fence).collect()}
    assert held == {("t", 1, "inside"), ("t", 2, "inside"), ("t", 4, "boundary"), ("u", 0, "inside")}
    events = {(r["trajectory_id"], r["point_index"], r["event"]) for r in spatial.fence_events(points, fence).collect()}
    assert events == {("t", 1, "enter"), ("t", 3, "exit"), ("t", 4, "enter"), ("u", 0, "enter")}


def test_roads_in_box_reach_the_scan(spark, tmp_path):
    _, roads = random_roads(spark, 20)
    spatial.write_str(roads, str(tmp_path / "roads"), 4)
    plan = spatial.roads_in_bbox(spark.read.parquet(str(tmp_path / "roads")), (116.0, 39.0, 116.01, 39.01)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(min_lon)" in plan and "geometry" not in plan.split("ReadSchema")[1]


def test_quadkeys_nest(spark):
    df = spark.createDataFrame([(116.39, 39.9)], "lon double, lat double")
    keys = df.select(spatial.quadkey(F.col("lon"), F.col("lat"), 12).alias("a"), spatial.quadkey(F.col("lon"), F.col("lat"), 6).alias("b")).first()
    assert keys["a"].startswith(keys["b"])


def test_tiles_equal_sorting(spark):
    _, roads = random_roads(spark, 61)
    got = {r["id"]: (r["tile_x"], r["tile_y"]) for r in spatial.str_tiles(roads.select("id", *spatial.BOX), 5).collect()}
    rows = sorted(roads.select("id", *spatial.BOX).collect(), key=lambda r: ((r[1] + r[3]) / 2, r[0]))
    slices = int(np.ceil(np.sqrt(61 / 5)))
    each, want = int(np.ceil(61 / slices)), {}
    for x in range(slices):
        for n, r in enumerate(sorted(rows[x * each : (x + 1) * each], key=lambda r: ((r[2] + r[4]) / 2, r[0]))):
            want[r[0]] = (x, n // 5)
    assert got == want
    assert spatial.tile_boxes(spatial.str_tiles(roads, 5)).agg(F.sum("n")).first()[0] == 61


def test_boxes_of_very_different_size_meet(spark):
    """A box as large as a continent is a few cells, and meets what it should, once."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        x, y = rng.uniform(-20, 20, 2)
        w = 10.0 ** rng.uniform(-5, 1.5)
        rows.append((f"b{i}", float(x), float(y), float(x + w), float(y + w * rng.uniform(0, 1))))
    rows += [("all", -180.0, -90.0, 180.0, 90.0), ("dot", 0.0, 0.0, 0.0, 0.0), ("none", None, None, None, None)]
    boxes = spark.createDataFrame(rows, "id string, min_lon double, min_lat double, max_lon double, max_lat double")
    got = spatial.bbox_join(boxes, boxes).select("l_id", "r_id").collect()
    want = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert set(map(tuple, got)) == want and len(got) == len(want)
    levels = spatial._levels(boxes, size=spatial.CELL)
    assert spatial.placed(boxes.where("id = 'all'"), levels).count() <= 9


def test_nearest_of_long_segments_dense_towns_and_the_far_away(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FAR", 16)
    monkeypatch.setattr(spatial, "FAR_PARTS", 7)
    monkeypatch.setattr(spatial, "CROWD", 3)
    rng = np.random.default_rng(3)
    rows = [("ferry", "a", "b", [(116.0, 39.0), (118.0, 40.0)])] + [(f"t{i:03d}", f"a{i}", f"b{i}", [tuple(q) for q in np.array([116.5, 39.5]) + rng.uniform(0, 0.002, (2, 2))]) for i in range(80)]
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate([(116.501, 39.501), (116.2, 39.1), (0.0, 0.0), (117.9, 39.0), (116.5005, 39.5015)])]
    got = {}
    for r in spatial.nearest_roads(spark.createDataFrame(places, "place int, lon double, lat double"), road_table(spark, rows), ["place"], 4).collect():
        got.setdefault(r["place"], []).append((r["cand_rank"], r["road_id"]))
    for place, x, y in places:
        best = sorted((round(_distance((x, y), line), 6), i) for i, _, _, line in rows)[:4]
        assert [g[1] for g in sorted(got[place])] == [i for _, i in best]


def test_quadkey_ranges_equal_the_box(spark):
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (500, 2)))], "id int, lon double, lat double").withColumn("quadkey", spatial.quadkey(F.col("lon"), F.col("lat"), 14))
    box = (-1.0, -0.5, 0.7, 2.0)
    want = {r["id"] for r in points.where("lon between -1 and 0.7 and lat between -0.5 and 2").collect()}
    assert {r["id"] for r in spatial.points_in_bbox_by_quadkey(points, box).collect()} == want
    key = points.first()["quadkey"]
    assert {r["id"] for r in spatial.under_quadkey(points, key[:5]).collect()} == {r["id"] for r in points.collect() if r["quadkey"].startswith(key[:5])}
    assert len(spatial.quadkeys_of_box((-180, -90, 180, 90))) <= 64


def test_index_stats_and_percentiles(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 21)], "latency_ms double").withColumn("index", F.lit("i"))
    got = measures.latency_report(rows, ["index"]).first()
    assert (got["n"], got["p50"], got["p95"], got["p99"]) == (20, 10.5, 19.0, 20.0)
    stats = spatial.index_stats(rows, F.col("latency_ms") > 5).first()
    assert (stats["candidate_count"], stats["false_positive_count"]) == (20, 5)
    assert measures.grid_roads(spark, 250).count() == 250
    assert measures.markdown(rows.limit(1)).startswith("| latency_ms | index |")


def test_distance_matrix_is_symmetric():
    a = np.array([(116.0, 39.0), (116.1, 39.1)])
    d = distance_matrix(a, a)
    assert d[0, 0] == 0 and d[0, 1] == pytest.approx(d[1, 0])
