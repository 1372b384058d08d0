"""Schemas of the map tables."""

from __future__ import annotations

POINT = "struct<lon:double,lat:double>"
LINE = f"array<{POINT}>"
RINGS = f"array<{LINE}>"

ROAD_NODES = "id string, lon double, lat double, pos long"
ROAD_EDGES = (
    f"id string, from_node string, to_node string, geometry {LINE}, length double, speed_limit double, road_type string, oneway boolean, "
    "direction string, road_class string, lane_count int, turn_restrictions array<map<string,string>>, metadata map<string,string>, pos long"
)
TRAJECTORY_POINTS = "trajectory_id string, point_index int, lon double, lat double, ts_raw string"
GEOFENCES = f"id string, name string, rings {RINGS}, pos long"
POIS = "id string, name string, lon double, lat double, properties map<string,string>, pos long"
LANES = f"id string, centerline {LINE}, left_boundary string, right_boundary string, speed_limit double, turn_type string, predecessor_ids array<string>, successor_ids array<string>, metadata map<string,string>"
LANE_BOUNDARIES = f"id string, geometry {LINE}, boundary_type string, color string"
LAYERS = {"road_nodes": ROAD_NODES, "road_edges": ROAD_EDGES, "trajectory_points": TRAJECTORY_POINTS, "geofences": GEOFENCES, "pois": POIS}
