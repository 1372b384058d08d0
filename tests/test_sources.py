"""Formats read and written, and the stored map."""

from __future__ import annotations

import json

import pytest
from maps import payloads, road_table
from pyspark.sql import functions as F

from roadloom.functions.types import LANE_BOUNDARIES, LANES, TRAJECTORY_POINTS
from roadloom.sources import geojson, osm
from roadloom.sources import lanes as lane_maps
from roadloom.sources.store import MapStore

OSM = """<osm><node id="31" lon="8.50" lat="47.30"/><node id="32" lon="8.53" lat="47.30"/><node id="33" lon="8.56" lat="47.31"/><node id="34" lon="8.56" lat="47.34"/>
<way id="900"><nd ref="31"/><nd ref="77"/><nd ref="32"/><nd ref="33"/><tag k="highway" v="residential"/></way>
<way id="17"><nd ref="33"/><nd ref="34"/><tag k="highway" v="primary"/><tag k="oneway" v="yes"/><tag k="maxspeed" v="30 mph"/><tag k="lanes" v="2"/></way>
<way id="5"><nd ref="31"/><nd ref="34"/><tag k="building" v="yes"/></way></osm>"""


def one(spark, text):
    return geojson.payload_features(spark, json.dumps({"type": "FeatureCollection", "features": text}))


def feature(props=None, kind="LineString", coordinates=((0, 0), (1, 0)), **more):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates}} | more


def test_roads_and_defaults(spark):
    rows = one(
        spark,
        [
            feature({"speed_limit": "50 mph", "highway": "primary", "oneway": True, "length": 0, "x": 1}),
            feature(kind="Point", coordinates=(0, 0)),
            feature({"from": "a", "to": "b", "maxspeed": "40;60", "length": 7, "id": "own"}, coordinates=((0, 0, 5), (1, 0, 5))),
            feature({"lanes": "3"}, coordinates=((0, 0),)),
            feature(None, id="top"),
        ],
    )
    nodes, roads = geojson.roads(rows)
    got = {r["id"]: r for r in roads.collect()}
    assert set(got) == {"edge_0000", "own", "top"}
    first = got["edge_0000"]
    assert (first["speed_limit"], first["road_class"], first["road_type"], first["oneway"], first["direction"]) == (50.0, "primary", "primary", True, "forward")
    assert first["length"] == pytest.approx(111195.08, abs=0.1) and first["from_node"] == "node_0_0000000_0_0000000" and "x" in first["metadata"]
    assert got["own"]["length"] == 7 and got["own"]["speed_limit"] == 4060 and got["own"]["geometry"][0] == (0, 0)
    assert (got["top"]["speed_limit"], got["top"]["road_class"], got["top"]["lane_count"], got["top"]["oneway"]) == (40.0, "local", 1, False)
    assert {r["id"] for r in nodes.collect()} == {"a", "b", "node_0_0000000_0_0000000", "node_1_0000000_0_0000000"}


def test_trajectories_fences_and_places(spark):
    rows = one(
        spark,
        [
            feature({"trajectory_id": "p", "timestamp": "2"}, "Point", (1, 1)),
            feature({"timestamps": ["t0"]}, coordinates=((0, 0), (1, 0))),
            feature({"trajectory_id": "p", "timestamp": "1"}, "Point", (2, 2)),
            feature({"name": "spot", "k": "v"}, "Point", (3, 3)),
            feature({}, "Polygon", [[(0, 0), (1, 0), (1, 1), (0, 0)]]),
        ],
    )
    got = {(r["trajectory_id"], r["point_index"]): (r["lon"], r["ts_raw"]) for r in geojson.trajectories(rows).collect()}
    assert got == {("p", 0): (1, "2"), ("p", 1): (2, "1"), ("traj_0001", 0): (0, "t0"), ("traj_0001", 1): (1, None), ("traj_points", 0): (3, None)}
    fence = geojson.geofences(rows).first()
    assert (fence["id"], fence["name"]) == ("fence_0004", "fence_0004")
    place = {r["id"]: r for r in geojson.pois(rows).collect()}["poi_0003"]
    assert place["name"] == "spot" and place["properties"] == {"k": "v"}


def test_short_coordinates_are_an_error(spark):
    with pytest.raises(Exception, match="two numbers"):
        geojson.roads(one(spark, [feature({}, coordinates=((0,), (1, 0)))]))[1].collect()


def test_features_read_back(spark):
    nodes, roads = geojson.roads(geojson.payload_features(spark, payloads()[0]))
    text = geojson.feature_collection(geojson.road_features(roads)).first()["value"]
    again = geojson.roads(geojson.payload_features(spark, text))[1]
    columns = ["id", "from_node", "to_node", "geometry", "length", "speed_limit", "road_class"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, roads.select(columns).collect()))
    one_road = json.loads(text)["features"][0]
    assert one_road["properties"]["travel_time"] > 0 and one_road["geometry"]["type"] == "LineString"


def test_osm(spark, tmp_path):
    nodes, roads = osm.read_text(spark, OSM)
    got = {r["id"]: r for r in roads.collect()}
    assert [r["id"] for r in sorted(got.values(), key=lambda r: r["pos"])] == ["osm_way_900_0", "osm_way_900_1", "osm_way_17_0"] and sorted(r["pos"] for r in got.values()) == [0, 1, 2]
    assert got["osm_way_900_0"]["from_node"] == "osm_node_31" and got["osm_way_900_0"]["to_node"] == "osm_node_32"
    last = got["osm_way_17_0"]
    assert (last["oneway"], last["speed_limit"], last["lane_count"], last["road_class"]) == (True, 30.0, 2, "primary")
    assert got["osm_way_900_0"]["speed_limit"] == 35.0 and got["osm_way_900_0"]["length"] > 0
    assert [r["id"] for r in nodes.orderBy("pos").collect()] == ["osm_node_31", "osm_node_32", "osm_node_33", "osm_node_34"]
    (tmp_path / "map.osm").write_text(OSM)
    read = osm.read_file(spark, str(tmp_path / "map.osm"))[1]
    assert sorted(map(str, read.collect())) == sorted(map(str, roads.collect()))


def test_places_in_a_long_file(spark, tmp_path):
    ids = [(i * 7919) % 3000 for i in range(3000)]
    text = "<osm>" + "".join(f'<node id="{i}" lon="{8 + i / 1e4}" lat="47"/>' for i in ids) + "".join(f'<way id="{i}"><nd ref="{i}"/><nd ref="{(i + 1) % 3000}"/><tag k="highway" v="service"/></way>' for i in ids) + "</osm>"
    (tmp_path / "long.osm").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        nodes, roads = osm.read_file(spark, str(tmp_path / "long.osm"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["id"] for r in roads.orderBy("pos").select("id", "pos").collect()] == [f"osm_way_{i}_0" for i in ids]
    assert [r["id"] for r in nodes.orderBy("pos").collect()] == [f"osm_node_{i}" for i in ids]


def test_online_sources_ask_for_the_box(spark, tmp_path):
    asked = []

    def fetch(url, body=None):
        asked.append((url, body))
        return OSM if body else json.dumps([{"boundingbox": ["39", "40", "116", "117"]}])

    assert osm.download_place(spark, "somewhere", fetch)[1].count() == 3
    assert b"39.0%2C116.0%2C40.0%2C117.0" in asked[1][1]
    assert osm.save_place(spark, "somewhere", str(tmp_path / "roads"), fetch) == 3
    assert {r["id"] for r in geojson.read_feature_lines(spark, str(tmp_path / "roads")).collect()} == {"osm_way_900_0", "osm_way_900_1", "osm_way_17_0"}
    with pytest.raises(ValueError, match="no such place"):
        osm.geocode("nowhere", lambda url, body=None: "[]")


def lanes(spark):
    """Two lanes beside a tram stop, one behind the other, with a boundary whose colour needs escaping."""
    rows = [
        ("stop_east", [(8.541, 47.376), (8.5422, 47.3761), (8.5431, 47.3764)], "kerb", "rail", 30.0, "through", [], ["stop_exit"], {}),
        ("stop_exit", [], None, None, 45.0, "right", ["stop_east"], [], {}),
    ]
    bounds = [("kerb", [(8.541, 47.3759), (8.5431, 47.3763)], "curbstone", "grey"), ("rail", [(8.541, 47.3762), (8.5431, 47.3766)], "a<b&\"c\"", "none")]
    return spark.createDataFrame(rows, LANES), spark.createDataFrame(bounds, LANE_BOUNDARIES)


def test_opendrive_round_trip(spark, tmp_path):
    rows, bounds = lanes(spark)
    text = lane_maps.document(lane_maps.export_opendrive(rows, bounds), "OpenDRIVE").first()["value"]
    columns = ["id", "centerline", "left_boundary", "right_boundary", "speed_limit", "turn_type", "predecessor_ids", "successor_ids"]
    want = sorted(map(tuple, rows.select(columns).collect()))
    assert sorted(map(tuple, lane_maps.import_opendrive(spark, text).select(columns).collect())) == want
    (tmp_path / "map.xodr").write_text(text)
    assert sorted(map(tuple, lane_maps.read_opendrive(spark, str(tmp_path / "map.xodr")).select(columns).collect())) == want
    assert 'length="2.0"' in text and "a&lt;b&amp;&quot;c&quot;" in text


def test_lanelet2(spark):
    text = """<osm><node id="70" lon="8" lat="47"/><node id="71" lon="9" lat="47"/><node id="72" lon="8" lat="49"/><node id="73" lon="9" lat="49"/><node id="74" lon="10" lat="49"/>
    <way id="500"><nd ref="70"/><nd ref="71"/><tag k="subtype" v="dashed"/></way><way id="501"><nd ref="72"/><nd ref="73"/><nd ref="74"/><tag k="type" v="curbstone"/></way>
    <relation id="9000"><member type="way" ref="500" role="left"/><member type="way" ref="501" role="right"/><tag k="type" v="lanelet"/><tag k="speed_limit" v="27"/><tag k="successor" v="9003,9004"/></relation>
    <relation id="9001"><tag k="type" v="regulatory_element"/></relation></osm>"""
    got, bounds = lane_maps.import_lanelet2(spark, text)
    lane = got.first()
    assert got.count() == 1 and lane["id"] == "lanelet_9000" and [tuple(q) for q in lane["centerline"]] == [(8, 48), (9, 48)]
    assert (lane["speed_limit"], lane["turn_type"], lane["successor_ids"]) == (27.0, "through", ["9003", "9004"])
    assert {(r["id"], r["boundary_type"], r["color"]) for r in bounds.collect()} == {("boundary_500", "dashed", "unknown"), ("boundary_501", "curbstone", "unknown")}


def test_lanelet2_export_reads_back(spark):
    rows, edges = lanes(spark)
    text = lane_maps.export_lanelet2(rows, edges).first()["value"]
    got, bounds = lane_maps.import_lanelet2(spark, text)
    assert got.count() == 2 and bounds.count() == 2
    lane = got.where("size(successor_ids) = 1").first()
    assert [tuple(q) for q in lane["centerline"]] == [(8.541, 47.376), (8.5422, 47.3761), (8.5431, 47.3764)] and lane["speed_limit"] == 30.0


def test_store(spark, tmp_path):
    store = MapStore(spark, str(tmp_path))
    assert not store.has_roads() and store.layer("pois").count() == 0
    roads = road_table(spark, [("x", "a", "b", [(0, 0), (1, 0)]), ("y", "a", "b", [(0, 0), (1, 1)])])
    store.replace(road_edges=roads)
    assert store.has_roads() and "min_lon" in store.layer("road_edges").columns
    again = road_table(spark, [("x", "a", "c", [(0, 0), (2, 0)]), ("x", "a", "d", [(0, 0), (3, 0)]), ("z", "a", "e", [(0, 0), (4, 0)])])
    store.upsert("road_edges", again)
    got = store.layer("road_edges").orderBy("pos").collect()
    assert [(r["id"], r["to_node"]) for r in got] == [("y", "b"), ("x", "d"), ("z", "e")]
    points = spark.createDataFrame([("t", 0, 1.0, 1.0, "b"), ("t", 0, 2.0, 2.0, "c"), ("t", 0, 3.0, 3.0, None), ("t", 1, 4.0, 4.0, "a")], TRAJECTORY_POINTS)
    store.upsert("trajectory_points", points)
    store.upsert("trajectory_points", spark.createDataFrame([("t", 1, 9.0, 9.0, "z"), ("u", 0, 5.0, 5.0, None)], TRAJECTORY_POINTS))
    assert sorted(tuple(r)[:3] for r in store.layer("trajectory_points").collect()) == [("t", 0, 2.0), ("t", 1, 9.0), ("u", 0, 5.0)]
    store.clear()
    assert not store.has_roads()


def test_store_versions(spark, tmp_path):
    store = MapStore(spark, str(tmp_path))
    for n in range(5):
        store.replace(road_edges=road_table(spark, [(f"r{n}", "a", "b", [(0, 0), (1, 0)])]))
    folders = [f.name for f in tmp_path.iterdir() if f.is_dir()]
    assert len(folders) == 2 and sorted(f.name for f in tmp_path.iterdir() if f.is_file() and f.name.startswith("VERSION")) == ["VERSION-4", "VERSION-5"]
    old = MapStore(spark, str(tmp_path)).layer("road_edges")
    (tmp_path / "VERSION-6").write_text('{"road_edges": "half')  # a writer that stopped half-way
    assert store.layer("road_edges").first()["id"] == "r4" and old.first()["id"] == "r4"


def test_bare_polygons(spark):
    rows = spark.createDataFrame([("p", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], {"use": "park"})], "id string, rings array<array<struct<lon:double,lat:double>>>, properties map<string,string>")
    got = json.loads(geojson.polygon_features(rows).first()["feature"])
    assert got == {"type": "Feature", "id": "p", "properties": {"id": "p", "use": "park"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}


def test_tags_keep_the_last(spark):
    df = spark.createDataFrame([([("a", "1"), ("a", "2"), (None, "x")],)], "tag array<struct<_k:string,_v:string>>")
    assert df.select(osm.tag_map().alias("m")).first()["m"] == {"a": "2"}
    assert spark.range(1).select(osm.speed(F.lit("none"), F.lit("service")).alias("s")).first()["s"] == 20.0
