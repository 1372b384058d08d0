"""Geodesy and cost terms as column expressions; coordinates are degrees, distances metres, times seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius.
RADIUS_M = 6_371_008.8
#: Metres of a degree that ``expand_bbox`` uses; a little more than the radius gives.
METRES_PER_DEGREE = 111_320.0

#: How unlikely a road class is as the one travelled.
CLASS_PRIOR = {"motorway": 0.0, "trunk": 0.05, "primary": 0.08, "secondary": 0.12, "tertiary": 0.16, "residential": 0.22, "service": 0.32, "local": 0.22}
CLASS_PRIOR_OTHER = 0.25
#: km/h of a way without a speed tag.
CLASS_SPEED = {"motorway": 100.0, "trunk": 80.0, "primary": 60.0, "secondary": 50.0, "tertiary": 45.0, "residential": 35.0, "service": 20.0, "living_street": 15.0}
CLASS_SPEED_OTHER = 40.0


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * RADIUS_M) * F.asin(F.when(h > 1.0, F.lit(1.0)).otherwise(F.sqrt(h)))  # null stays null, which least() would lose


def distance(a: Column, b: Column) -> Column:
    """``haversine`` between two point structs."""
    return haversine(a["lon"], a["lat"], b["lon"], b["lat"])


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, on a plane that touches there."""
    return F.radians(lon - lon0) * F.lit(RADIUS_M) * F.cos(F.radians(lat0)), F.radians(lat - lat0) * F.lit(RADIUS_M)


def from_local_xy(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + F.degrees(x / (F.lit(RADIUS_M) * F.greatest(F.cos(F.radians(lat0)), F.lit(1e-12)))), lat0 + F.degrees(y / F.lit(RADIUS_M))


def segment_projection(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column, index: Column | int = 0) -> Column:
    """struct(distance, segment_index, t, plon, plat): the foot of a point on a segment, on the plane at the point.

    A segment shorter than a nanometre counts as its start. The segment's extent is taken
    from its own ends, not from their places around the point: two segments that are met in
    their common vertex are told apart by the last digits.
    """
    ax, ay = local_xy(x1, y1, lon, lat)
    dx, dy = F.radians(x2 - x1) * RADIUS_M * F.cos(F.radians(lat)), F.radians(y2 - y1) * RADIUS_M
    length = dx * dx + dy * dy
    t = F.when(length <= 1e-18, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / length)))
    qx, qy = ax + t * dx, ay + t * dy
    plon, plat = from_local_xy(qx, qy, lon, lat)
    index = index if isinstance(index, Column) else F.lit(index)
    return F.struct(F.sqrt(qx * qx + qy * qy).alias("distance"), index.cast("long").alias("segment_index"), t.alias("t"), plon.alias("plon"), plat.alias("plat"))


def near_segment(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column, tolerance_m: float = 0.25) -> Column:
    """Whether a point lies within a tolerance of a segment."""
    return segment_projection(lon, lat, x1, y1, x2, y2)["distance"] <= tolerance_m


def polyline_projection(lon: Column, lat: Column, line: Column) -> Column:
    """The nearest foot of a point on a polyline, the first of equal ones; of one vertex the vertex, of none null."""
    feet = F.transform(
        F.sequence(F.lit(1), F.size(line) - 1),
        lambda i: segment_projection(lon, lat, F.element_at(line, i)["lon"], F.element_at(line, i)["lat"], F.element_at(line, i + 1)["lon"], F.element_at(line, i + 1)["lat"], i - 1),
    )
    first = F.element_at(line, 1)
    alone = F.struct(haversine(lon, lat, first["lon"], first["lat"]).alias("distance"), F.lit(0).cast("long").alias("segment_index"), F.lit(0.0).alias("t"), first["lon"].alias("plon"), first["lat"].alias("plat"))
    return F.when(F.size(line) >= 2, F.array_min(feet)).when(F.size(line) == 1, alone)


def polyline_length(line: Column) -> Column:
    """Sum of ``haversine`` along a polyline; below two vertices 0."""
    legs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), distance)
    return F.when(F.size(line) >= 2, F.aggregate(legs, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360 from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360.0, F.lit(360.0))


def angle_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def expand_bbox(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, metres: Column | float) -> Column:
    """The box with a margin; a degree of longitude never counts as less than a tenth of one of latitude."""
    metres = num(metres)
    dy = metres / METRES_PER_DEGREE
    dx = metres / (F.lit(METRES_PER_DEGREE) * F.greatest(F.lit(0.1), F.abs(F.cos(F.radians((min_lat + max_lat) / 2)))))
    return F.struct((min_lon - dx).alias("min_lon"), (min_lat - dy).alias("min_lat"), (max_lon + dx).alias("max_lon"), (max_lat + dy).alias("max_lat"))


def bbox_center(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    return point((min_lon + max_lon) / 2, (min_lat + max_lat) / 2)


def corridor(line: Column, radius_m: Column | float) -> Column:
    """A closed rectangle, one ring, that contains everything within ``radius_m`` of a polyline; of no vertex one empty ring."""
    lons, lats = F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"])
    x1, x2, y1, y2 = F.array_min(lons), F.array_max(lons), F.array_min(lats), F.array_max(lats)
    radius = num(radius_m)
    dy = F.degrees(radius / RADIUS_M)
    dx = F.degrees(radius / (F.lit(RADIUS_M) * F.greatest(F.cos(F.radians((y1 + y2) / 2)), F.lit(1e-12))))
    west, east, south, north = x1 - dx, x2 + dx, y1 - dy, y2 + dy
    ring = F.array(point(west, south), point(east, south), point(east, north), point(west, north), point(west, south))
    return F.when(F.size(line) > 0, F.array(ring)).otherwise(F.array(F.slice(line, 1, 0)))


def degrees_distance_sq(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Squared degrees, longitude scaled by the cosine of the middle latitude; orders near points."""
    return F.pow((lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2)), F.lit(2.0)) + F.pow(lat1 - lat2, F.lit(2.0))


def travel_time(length: Column, speed_kmh: Column) -> Column:
    return length / (F.greatest(speed_kmh, F.lit(1.0)) * 1000.0 / 3600.0)


def arc_weight(length: Column, seconds: Column, mode: Column | str) -> Column:
    """Seconds for ``shortest_time``, metres for anything else."""
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    return F.when(mode == "shortest_time", seconds).otherwise(length)


def turn_cost(prev_edge: Column, prev_heading: Column, edge: Column, heading: Column, penalty_s: Column | float = 8.0) -> Column:
    """Seconds of a turn: none at the start, on one edge, or below 35 degrees; twice the penalty above 150, else in proportion to the angle."""
    angle, penalty = angle_difference(prev_heading, heading), num(penalty_s)
    return F.when(prev_edge.isNull() | (prev_edge == edge) | (angle < 35), F.lit(0.0)).when(angle > 150, 2 * penalty).otherwise(penalty * angle / 90.0)


def class_preference_cost(road_class: Column, length: Column, preferred: list[str]) -> Column:
    """15 % of the length on roads that are not of a preferred class."""
    return F.when(road_class.isin(preferred), F.lit(0.0)).otherwise(length * 0.15) if preferred else F.lit(0.0)


def class_prior(road_class: Column, road_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASS_PRIOR.items() for x in pair])
    return F.coalesce(F.try_element_at(table, road_class), F.try_element_at(table, road_type), F.lit(CLASS_PRIOR_OTHER))


def direction_cost(road_heading: Column, heading: Column, two_way: Column) -> Column:
    """The angle between road and travel, in half turns; against a two-way road the smaller of both senses, without a heading 0."""
    ahead, back = angle_difference(road_heading, heading), angle_difference(F.pmod(road_heading + 180.0, F.lit(360.0)), heading)
    return F.when(heading.isNull(), F.lit(0.0)).otherwise(F.when(two_way, F.least(ahead, back)).otherwise(ahead) / 180.0)


def turn_penalty(prev_road: Column, prev_heading: Column, road: Column, heading: Column) -> Column:
    """The angle between two matched roads, in half turns; none at the start or on one road."""
    return F.when(prev_road.isNull() | (prev_road == road), F.lit(0.0)).otherwise(angle_difference(prev_heading, heading) / 180.0)


def speed_feasibility(prev_speed: Column, speed: Column, gps_distance: Column, seconds: Column) -> Column:
    """0 if the speed in km/h stays below 1.35 times the faster road's and 10 more, else the excess in shares of that, 1 at most; 0 without a step."""
    observed, allowed = gps_distance / F.nullif(seconds, F.lit(0.0)) * 3.6, F.greatest(prev_speed, speed) * 1.35 + 10.0
    unknown = prev_speed.isNull() | gps_distance.isNull() | seconds.isNull() | (seconds <= 0)
    return F.when(unknown | (observed <= allowed), F.lit(0.0)).otherwise(F.least(F.lit(1.0), (observed - allowed) / F.greatest(allowed, F.lit(1.0))))


def emission_log(distance_m: Column, sigma: float) -> Column:
    return F.lit(-0.5) * F.pow(distance_m / max(sigma, 1.0), F.lit(2.0))


def emission_score(distance_m: Column, sigma: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance_m / max(sigma, 1.0))


def transition_log(network_m: Column, gps_m: Column, beta: float, turn: Column, prior: Column, turn_weight: float = 1.5, prior_weight: float = 0.5) -> Column:
    """Log weight of a step between candidates; a million below zero where the network has no way."""
    return F.when(network_m.isNull(), F.lit(-1e6)).otherwise(-F.abs(network_m - gps_m) / max(beta, 1.0) - turn_weight * turn - prior_weight * prior)
