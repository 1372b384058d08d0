"""Small maps for tests."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from roadloom.functions import geodesy as g
from roadloom.functions.types import LINE, ROAD_NODES
from roadloom.operators.spatial import with_bbox

CLASSES = {0: ("residential", 35.0), 1: ("primary", 50.0), 2: ("residential", 35.0)}


def grid():
    """A three by three grid of nodes a hundredth of a degree apart, its streets, and one diagonal."""
    node = lambda c, r: (f"node_{c}{r}", (116.39 + c * 0.01, 39.9 + r * 0.01))
    roads = []
    for r in range(3):
        roads += [(f"edge_h_{c}{r}_{c + 1}{r}", node(c, r), node(c + 1, r), *CLASSES[r]) for c in range(2)]
    for c in range(3):
        roads += [(f"edge_v_{c}{r}_{c}{r + 1}", node(c, r), node(c, r + 1), "secondary", 45.0) for r in range(2)]
    roads.append(("edge_diag_00_11", node(0, 0), node(1, 1), "service", 25.0))
    return roads


TRACE = [(116.3910, 39.9098), (116.3975, 39.9101), (116.4020, 39.9102), (116.4080, 39.9100), (116.4102, 39.9145), (116.4101, 39.9190)]
FENCE = [[(116.398, 39.908), (116.406, 39.908), (116.406, 39.916), (116.398, 39.916), (116.398, 39.908)]]
POIS = {"poi_gate": (116.4000, 39.9200), "poi_station": (116.4015, 39.9110), "poi_parking": (116.4090, 39.9010)}


def _feature(fid, props, kind, coordinates):
    return {"type": "Feature", "id": fid, "properties": props, "geometry": {"type": kind, "coordinates": coordinates}}


def _collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def payloads():
    roads = _collection(*[_feature(i, {"from": a[0], "to": b[0], "road_type": k, "speed_limit": s, "oneway": False}, "LineString", [list(a[1]), list(b[1])]) for i, a, b, k, s in grid()])
    trace = _collection(_feature("traj_001", {"timestamps": [f"2026-01-01T10:00:{10 * i:02d}" for i in range(6)]}, "LineString", [list(c) for c in TRACE]))
    fence = _collection(_feature("fence_campus", {"name": "Campus Delivery Zone"}, "Polygon", FENCE))
    pois = _collection(*[_feature(i, {"name": i, "kind": "x"}, "Point", list(c)) for i, c in POIS.items()])
    return roads, trace, fence, pois


def road_table(spark, rows):
    """Roads (id, from, to, line) of one class, with measured lengths."""
    made = spark.createDataFrame([(i, a, b, [tuple(map(float, c)) for c in line], n) for n, (i, a, b, line) in enumerate(rows)], f"id string, from_node string, to_node string, geometry {LINE}, pos long")
    made = made.withColumns(
        {
            "length": g.polyline_length(F.col("geometry")), "speed_limit": F.lit(40.0), "road_type": F.lit("local"), "oneway": F.lit(False), "direction": F.lit("both"), "road_class": F.lit("local"), "lane_count": F.lit(1),
            "turn_restrictions": F.array().cast("array<map<string,string>>"), "metadata": F.create_map().cast("map<string,string>"),
        }
    )
    return with_bbox(made)


def node_table(spark, places):
    return spark.createDataFrame([(i, float(x), float(y), n) for n, (i, (x, y)) in enumerate(places.items())], ROAD_NODES)


def random_roads(spark, n, seed=0, span=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        start = np.array([116.0, 39.0]) + rng.uniform(0, span, 2)
        line = [start, *(start + np.cumsum(rng.normal(0, 0.002, (rng.integers(1, 4), 2)), axis=0))]
        rows.append((f"r{i:03d}", f"a{i}", f"b{i}", [tuple(c) for c in line]))
    return rows, road_table(spark, rows)
