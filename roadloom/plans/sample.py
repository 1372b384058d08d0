"""The sample map: a small grid of streets with one trip, one zone and three places, as GeoJSON texts."""

from __future__ import annotations

import json

# Fixed values of the sample map ------------------------------------------------------------------

#: West and south of the grid, its pitch in degrees, and its nodes a side.
ORIGIN, PITCH, SIDE = (116.39, 39.90), 0.01, 3
#: Type and speed of the streets of each row, of all columns, and of the diagonal.
ROW_STREETS = (("residential", 35), ("primary", 50), ("residential", 35))
COLUMN_STREETS = ("secondary", 45)
DIAGONAL = ("service", 25)
TRIP_ID = "traj_001"
TRIP = ((116.3910, 39.9098), (116.3975, 39.9101), (116.4020, 39.9102), (116.4080, 39.9100), (116.4102, 39.9145), (116.4101, 39.9190))
#: Date and hour of the trip's first point; one point every ten seconds.
TRIP_START = "2026-01-01T10:00"
ZONE_ID, ZONE_NAME = "fence_campus", "Campus Delivery Zone"
#: West, south, east, north.
ZONE = (116.398, 39.908, 116.406, 39.916)
PLACES = (("poi_gate", "North Gate", "entrance", 116.4000, 39.9200), ("poi_station", "Delivery Station", "logistics", 116.4015, 39.9110), ("poi_parking", "Parking Lot", "parking", 116.4090, 39.9010))


def feature(fid: str, props: dict, kind: str, coordinates: list) -> dict:
    return {"type": "Feature", "id": fid, "properties": props, "geometry": {"type": kind, "coordinates": coordinates}}


def collection(features: list[dict]) -> str:
    return json.dumps({"type": "FeatureCollection", "features": features})


def streets() -> list[tuple[tuple[int, int], tuple[int, int], str, str, int]]:
    """(from, to, kind, type, speed) by column and row: along rows, along columns, and one across the first square."""
    along = [((c, r), (c + 1, r), "h", *ROW_STREETS[r]) for r in range(SIDE) for c in range(SIDE - 1)]
    up = [((c, r), (c, r + 1), "v", *COLUMN_STREETS) for c in range(SIDE) for r in range(SIDE - 1)]
    return [*along, *up, ((0, 0), (1, 1), "diag", *DIAGONAL)]


def place(node: tuple[int, int]) -> list[float]:
    return [round(ORIGIN[k] + PITCH * node[k], 6) for k in (0, 1)]


def roads() -> str:
    name = lambda node: f"{node[0]}{node[1]}"
    return collection(
        [
            feature(f"edge_{kind}_{name(a)}_{name(b)}", {"from": f"node_{name(a)}", "to": f"node_{name(b)}", "road_type": road_type, "speed_limit": speed, "oneway": False}, "LineString", [place(a), place(b)])
            for a, b, kind, road_type, speed in streets()
        ]
    )


def trajectories() -> str:
    stamps = [f"{TRIP_START}:{10 * i:02d}" for i in range(len(TRIP))]
    return collection([feature(TRIP_ID, {"timestamps": stamps}, "LineString", [list(c) for c in TRIP])])


def geofences() -> str:
    w, s, e, n = ZONE
    return collection([feature(ZONE_ID, {"name": ZONE_NAME}, "Polygon", [[[w, s], [e, s], [e, n], [w, n], [w, s]]])])


def pois() -> str:
    return collection([feature(i, {"name": name, "category": kind}, "Point", [lon, lat]) for i, name, kind, lon, lat in PLACES])


def layers() -> dict[str, str]:
    return {"roads": roads(), "trajectories": trajectories(), "fences": geofences(), "pois": pois()}
