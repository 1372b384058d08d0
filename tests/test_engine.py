"""The engine's answers on the sample grid."""

from __future__ import annotations

import json

import pytest
from maps import FENCE, payloads

from roadloom.engine import MapEngine, NotFound, register_sql_functions
from roadloom.sources import geojson


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = MapEngine(spark, str(tmp_path_factory.mktemp("map")))
    made.load_payloads(*payloads())
    return made


def test_counts_and_bounds(engine):
    got = engine.stats().first()
    assert (got["nodes"], got["roads"], got["arcs"], got["trajectories"], got["geofences"], got["pois"]) == (9, 13, 26, 1, 1, 3)
    assert got["length_m"] == pytest.approx(13190.69, abs=0.01)
    assert (got["min_lon"], got["max_lat"]) == pytest.approx((116.39, 39.92))


def test_nearby(engine):
    got = engine.nearby(116.4015, 39.9110, 3).collect()
    assert [(r["road_id"], round(r["distance"], 3)) for r in got] == [("edge_h_11_21", 111.195), ("edge_v_11_12", 127.937), ("edge_diag_00_11", 169.506)]


def test_spatial_queries(engine):
    box = {r["id"] for r in engine.roads_in_bbox((116.399, 39.909, 116.411, 39.911)).collect()}
    assert box == {"edge_diag_00_11", "edge_h_01_11", "edge_h_11_21", "edge_v_10_11", "edge_v_11_12", "edge_v_20_21", "edge_v_21_22"}
    assert "edge_h_11_21" in {r["id"] for r in engine.roads_in_polygon(FENCE).collect()}
    assert [r["id"] for r in engine.points_in_polygon(FENCE).collect()] == ["traj_001_2"]
    assert {r["id"] for r in engine.points_in_polygon(FENCE, "pois").collect()} == {"poi_station"}
    with pytest.raises(ValueError, match="unknown target"):
        engine.points_in_polygon(FENCE, "x")


def test_geofence_events(engine):
    assert {(r["point_index"], r["event"]) for r in engine.geofence_check().collect()} == {(2, "enter"), (3, "exit")}


def test_fences_of_a_request(engine):
    fences = engine.fence_rows([{"id": "x", "geometry": {"coordinates": FENCE}}, {"coordinates": [[(0, 0), (1, 0), (1, 1), (0, 0)]]}])
    assert [tuple(r)[:2] for r in fences.select("id", "name").collect()] == [("x", "x"), ("request_fence_1", "request_fence_1")]
    assert {r["fence_id"] for r in engine.geofence_check(fences=fences).collect()} == {"x"}


def test_sample_load_and_reset(spark, tmp_path):
    made = MapEngine(spark, str(tmp_path))
    assert tuple(made.health().first()) == ("ok", 9, 13, 1, 1, 3)
    assert {r["name"] for r in made.pois.collect()} == {"North Gate", "Delivery Station", "Parking Lot"} and made.points.where("ts_raw is not null").count() == 6
    made.load("geojson", roads_text=payloads()[0])
    assert made.current().first()["roads"] == 13 and made.current().first()["pois"] == 0
    path = tmp_path / "roads.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": json.loads(payloads()[0])["features"][:2]}))
    assert tuple(made.load("geojson", roads=str(path)).first())[:5] == (3, 2, 1, 1, 3)  # the other layers are the sample's
    made.clear()
    assert made.current().first()["roads"] == 0 and made.current().first()["min_lon"] is None
    assert made.reset().first()["roads"] == 13 and made.load().first()["roads"] == 13
    with pytest.raises(ValueError, match="unknown source"):
        made.load("geojson")


def test_repair_after_an_osm_load(spark, tmp_path):
    from test_sources import OSM

    (tmp_path / "map.osm").write_text(OSM)
    made = MapEngine(spark, str(tmp_path / "map"), empty=True)
    assert made.load("osm_file", path=str(tmp_path / "map.osm")).first()["roads"] == 3
    assert [r["id"] for r in made.roads.orderBy("pos").collect()] == ["osm_way_900_0", "osm_way_900_1", "osm_way_17_0"]
    done = made.repair(1.0, apply=True).first()
    assert done["before_issues"] >= 0 and made.current().first()["roads"] == 3
    assert [r["pos"] for r in made.roads.orderBy("pos").collect()] == [0, 1, 2]
    assert made.tidy() > 0


@pytest.mark.parametrize("algorithm", ["nearest", "candidate_cost", "hmm"])
def test_matching(engine, algorithm):
    rows = engine.match(engine.trajectory(), algorithm, 3).collect()
    assert len(rows) == 6
    with pytest.raises(ValueError, match="unknown algorithm"):
        engine.match(engine.trajectory(), "x")


def test_routes(engine):
    near, far = (116.39, 39.90), (116.41, 39.92)
    short = engine.route(near, far).first()
    assert short["distance"] == pytest.approx(3366.19, abs=0.01) and short["estimated_time"] == pytest.approx(378.48, abs=0.01)
    assert short["road_sequence"] == ["edge_diag_00_11", "edge_v_11_12", "edge_h_12_22"]
    assert engine.route(near, far, algorithm="dijkstra").first() == short
    with pytest.raises(ValueError, match="unknown algorithm"):
        engine.route(near, far, algorithm="x")
    fast = engine.route(near, far, mode="shortest_time").first()
    assert fast["estimated_time"] == pytest.approx(300.73, abs=0.01) and fast["distance"] == pytest.approx(3929.75, abs=0.01)
    around = engine.route(near, far, avoid=[FENCE]).first()
    assert "edge_h_11_21" not in around["road_sequence"] and around["found"]
    via = engine.route(near, far, [(116.41, 39.90)]).first()
    assert via["distance"] > short["distance"] and tuple(via["geometry"][0]) == near and tuple(via["geometry"][-1]) == far
    wall = [[(116.3, 39.895), (116.5, 39.895), (116.5, 39.905), (116.3, 39.905), (116.3, 39.895)]]
    with pytest.raises(NotFound):
        engine.route(near, far, avoid=[wall])


def test_explained_route(engine):
    got = engine.explain_route((116.39, 39.90), (116.41, 39.92), preferred=["primary"]).first()
    assert got["found"] and got["distance_m"] == pytest.approx(sum(s["length"] for s in got["steps"]))


def test_topology_and_repair(engine):
    assert {r["type"] for r in engine.validate().collect()} <= {"dangling_edge"}
    done = engine.repair(1.0).first()
    assert done["split_edges_added"] == 0 and done["duplicate_edges_removed"] == 0


def test_export(engine):
    got = engine.export().first()
    assert len(json.loads(got["roads"])["features"]) == 13 and len(json.loads(got["pois"])["features"]) == 3
    assert json.loads(got["trajectories"])["features"][0]["properties"]["timestamps"][0].startswith("2026")


def test_measures(engine):
    rows = {r["index"]: r for r in engine.benchmark_index(iterations=2).collect()}
    assert set(rows) == {"brute_force", "grid", "quadtree", "rtree", "str_rtree"}
    assert all(r["queries"] == 2 and r["result_count"] == 13 and r["build_ms"] > 0 and r["stored_bytes"] > 0 for r in rows.values())
    rows = engine.benchmark_boxes(3).collect()
    assert len({r["result_count"] for r in rows}) == 1 and rows[0]["roads"] == 13 and rows[0]["length_m"] == pytest.approx(13190.69, abs=0.01)
    assert [r["id"] for r in engine.experiments().collect()] == ["topology_repair", "spatial_index", "map_matching", "trajectory_analysis"]
    rows = engine.benchmark_matching(["edge_h_01_11", "edge_h_11_21", "edge_v_21_22"]).collect()
    assert {r["algorithm"] for r in rows} == {"nearest", "hmm"} and all(0 <= r["precision"] <= 1 for r in rows)


def test_layers_as_lines(engine, spark, tmp_path):
    engine.write_layers(str(tmp_path))
    again = geojson.roads(geojson.read_feature_lines(spark, f"{tmp_path}/roads"))[1]
    assert sorted(map(tuple, again.select("id", "from_node", "to_node", "length").collect())) == sorted(map(tuple, engine.roads.select("id", "from_node", "to_node", "length").collect()))


def test_a_layer_that_does_not_fit_a_text_is_an_error(engine, monkeypatch):
    monkeypatch.setattr(geojson, "TEXT_BYTES", 100)
    with pytest.raises(ValueError, match="too many"):
        engine.export()


def test_benchmarks(spark, engine):
    from roadloom.plans import benchmarks

    done = benchmarks.topology_benchmark(spark).first()
    assert done["split_edges_added"] > 0 and done["duplicate_edges_removed"] >= 1 and done["after_illegal_crossings"] == 0 and done["elapsed_ms"] > 0
    pairs = spark.createDataFrame([("node_00", "node_22")], "source string, target string")
    assert {r["case"] for r in benchmarks.routing_latency(engine.roads, pairs, 1).collect()} == {f"{a}_{m}" for a in ("dijkstra", "astar") for m in ("shortest_distance", "shortest_time")}


def test_missing_trajectory(engine):
    with pytest.raises(NotFound):
        engine.trajectory("nobody")
    assert [r["ts_raw"] for r in engine.trace([(0, 0), (1, 1)], timestamps=["8:00"]).orderBy("point_index").collect()] == ["8:00", None]
    assert len(engine.match(engine.trace([(116.391, 39.9098), (116.402, 39.9102)]), "nearest").collect()) == 2


def test_sql_functions(spark):
    register_sql_functions(spark)
    got = spark.sql("SELECT geo_distance(0D, 0D, 1D, 0D) AS d, geo_bearing(0D, 0D, 1D, 0D) AS b, geo_angle_difference(350D, 10D) AS a").first()
    assert got["d"] == pytest.approx(111195.08, abs=0.1) and got["b"] == pytest.approx(90) and got["a"] == pytest.approx(20)
