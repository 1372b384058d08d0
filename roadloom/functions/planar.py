"""Planar predicates and polygon measures as column expressions, in degrees.

A polyline is an array of point structs (lon, lat); a polygon is an array of rings, the
exterior first, each closed by its first vertex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of all comparisons, in degrees (squared degrees for areas).
EPS = 1e-12


def orientation_value(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, eps: float = EPS) -> Column:
    """1 counter-clockwise, -1 clockwise, 0 collinear; the tolerance grows with the triangle but never shrinks below one degree's."""
    v = orientation_value(ax, ay, bx, by, cx, cy)
    scale = F.greatest(F.abs(bx - ax), F.abs(by - ay), F.abs(cx - ax), F.abs(cy - ay), F.lit(1.0))
    return F.when(F.abs(v) <= F.lit(eps) * scale * scale, F.lit(0)).when(v > 0, F.lit(1)).otherwise(F.lit(-1))


def on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, eps: float = EPS) -> Column:
    inside = (px >= F.least(x1, x2) - eps) & (px <= F.greatest(x1, x2) + eps) & (py >= F.least(y1, y2) - eps) & (py <= F.greatest(y1, y2) + eps)
    return inside & (orientation(x1, y1, x2, y2, px, py, eps) == 0)


def in_segment_box(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, eps: float = EPS) -> Column:
    """Whether a point lies in the box of a segment, on its line or not."""
    return (px >= F.least(x1, x2) - eps) & (px <= F.greatest(x1, x2) + eps) & (py >= F.least(y1, y2) - eps) & (py <= F.greatest(y1, y2) + eps)


def same_point(ax: Column, ay: Column, bx: Column, by: Column, eps: float = EPS) -> Column:
    return (F.abs(ax - bx) <= eps) & (F.abs(ay - by) <= eps)


def bbox_intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes as (min_lon, min_lat, max_lon, max_lat); touching counts."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def bbox_contains_point(box: tuple[Column, ...], lon: Column, lat: Column) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def bbox_contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def segment_parameter(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How far along a segment a point is, 0 at its start and 1 at its end; 0 on a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    return F.when(size <= 1e-24, F.lit(0.0)).otherwise(((px - x1) * dx + (py - y1) * dy) / size)


def segment_intersection(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """struct(kind, x, y, x2, y2) of segments a-b and c-d; kind is none, point or overlap.

    A proper or touching crossing of different lines comes first, then a shared endpoint,
    then an overlap on one line (x, y to x2, y2; a point if it has no length), then an
    endpoint of one on the other. The crossing is computed from a local origin, so that
    coordinates of any size lose no digits.
    """
    o1, o2 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy)
    o3, o4 = orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    # crossing of the lines, relative to a
    ux, uy, vx, vy, wx, wy = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    det = ux * vy - uy * vx
    t = (wx * vy - wy * vx) / F.nullif(det, F.lit(0.0))
    flat = F.abs(det) <= EPS
    null = F.lit(None).cast("double")
    made = lambda kind, x, y, x2=null, y2=null: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), x2.alias("x2"), y2.alias("y2"))
    crossing = made("point", F.when(flat, ax).otherwise(ax + t * ux), F.when(flat, ay).otherwise(ay + t * uy))
    shared_a = same_point(ax, ay, cx, cy) | same_point(ax, ay, dx, dy)
    shared_b = same_point(bx, by, cx, cy) | same_point(bx, by, dx, dy)
    by_x = F.abs(bx - ax) >= F.abs(by - ay)
    pick = lambda x, y: F.struct(F.when(by_x, x).otherwise(y).alias("k"), x.alias("x"), y.alias("y"))
    middle = F.array_sort(F.array(pick(ax, ay), pick(bx, by), pick(cx, cy), pick(dx, dy)))
    p, q = F.element_at(middle, 2), F.element_at(middle, 3)
    lines = (o1 == 0) & (o2 == 0) & (o3 == 0) & (o4 == 0)
    apart = F.when(by_x, (F.greatest(ax, bx) < F.least(cx, dx) - EPS) | (F.greatest(cx, dx) < F.least(ax, bx) - EPS)).otherwise((F.greatest(ay, by) < F.least(cy, dy) - EPS) | (F.greatest(cy, dy) < F.least(ay, by) - EPS))
    touch = F.coalesce(
        F.when((o1 == 0) & on_segment(cx, cy, ax, ay, bx, by), made("point", cx, cy)),
        F.when((o2 == 0) & on_segment(dx, dy, ax, ay, bx, by), made("point", dx, dy)),
        F.when((o3 == 0) & on_segment(ax, ay, cx, cy, dx, dy), made("point", ax, ay)),
        F.when((o4 == 0) & on_segment(bx, by, cx, cy, dx, dy), made("point", bx, by)),
    )
    return (
        F.when((o1 != o2) & (o3 != o4), F.when(shared_a, made("point", ax, ay)).when(shared_b, made("point", bx, by)).otherwise(crossing))
        .when(shared_a, made("point", ax, ay))
        .when(shared_b, made("point", bx, by))
        .when(lines & ~apart, F.when(same_point(p["x"], p["y"], q["x"], q["y"]), made("point", p["x"], p["y"])).otherwise(made("overlap", p["x"], p["y"], q["x"], q["y"])))
        .when(lines, made("none", null, null))
        .otherwise(F.coalesce(touch, made("none", null, null)))
    )


def segments(line: Column) -> Column:
    """array of struct(x1, y1, x2, y2) between consecutive vertices."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))


def line_bbox(line: Column) -> tuple[Column, ...]:
    """(min_lon, min_lat, max_lon, max_lat) of a polyline; nulls of an empty one."""
    lon, lat = F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"])
    return F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat)


def ring_side(px: Column, py: Column, ring: Column) -> Column:
    """inside, boundary or outside of one ring, which is not closed for the caller; fewer than three vertices are outside."""

    def step(acc: Column, s: Column) -> Column:
        crosses = (s["y1"] > py) != (s["y2"] > py)
        x = (s["x2"] - s["x1"]) * (py - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"]
        return F.struct(
            (acc["edge"] | on_segment(px, py, s["x1"], s["y1"], s["x2"], s["y2"])).alias("edge"),
            F.when(crosses & (px <= x + EPS), ~acc["odd"]).otherwise(acc["odd"]).alias("odd"),
        )

    zero = F.struct(F.lit(False).alias("edge"), F.lit(False).alias("odd"))
    side = F.aggregate(segments(ring), zero, step, lambda a: F.when(a["edge"], F.lit("boundary")).when(a["odd"], F.lit("inside")).otherwise(F.lit("outside")))
    return F.when(F.size(ring) >= 3, side).otherwise(F.lit("outside"))


def point_in_polygon(px: Column, py: Column, rings: Column) -> Column:
    """inside, boundary or outside of a polygon with holes; a hole's edge is boundary, its inside outside."""
    holes = F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: ring_side(px, py, r))
    outer = ring_side(px, py, F.element_at(rings, 1))
    first = F.try_element_at(F.filter(holes, lambda h: h != "outside"), F.lit(1))
    inner = F.when(first.isNull(), F.lit("inside")).when(first == "boundary", F.lit("boundary")).otherwise(F.lit("outside"))
    return F.when(F.coalesce(F.size(rings), F.lit(0)) <= 0, F.lit("outside")).when(outer != "inside", outer).otherwise(inner)


def segments_meet(a: Column, b: Column) -> Column:
    """Whether two segment structs have a point in common."""
    return segment_intersection(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"], b["x2"], b["y2"])["kind"] != "none"


def polyline_meets_polygon(line: Column, rings: Column) -> Column:
    """Boxes meet, and a vertex is not outside or a segment meets the exterior; edges of holes do not count."""
    outer = F.element_at(rings, 1)
    vertex = F.exists(line, lambda p: point_in_polygon(p["lon"], p["lat"], rings) != "outside")
    edge = F.exists(segments(line), lambda s: F.exists(segments(outer), lambda e: segments_meet(s, e)))
    return bbox_intersects(line_bbox(line), line_bbox(F.flatten(rings))) & (vertex | edge)


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace rule, in squared degrees; below three vertices 0."""
    total = F.aggregate(segments(ring), F.lit(0.0), lambda a, s: a + s["x1"] * s["y2"] - s["x2"] * s["y1"])
    return F.when(F.size(ring) >= 3, total / 2).otherwise(F.lit(0.0))


def ring_centroid(ring: Column) -> Column:
    """The centroid of a ring; without area the mean of its vertices, without vertices (0, 0)."""
    area = ring_area(ring)
    cross = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
    sx = F.aggregate(segments(ring), F.lit(0.0), lambda a, s: a + (s["x1"] + s["x2"]) * cross(s))
    sy = F.aggregate(segments(ring), F.lit(0.0), lambda a, s: a + (s["y1"] + s["y2"]) * cross(s))
    n = F.greatest(F.size(ring), F.lit(1))
    mx = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["lon"]) / n
    my = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["lat"]) / n
    flat = F.abs(area) <= EPS
    safe = F.nullif(6 * area, F.lit(0.0))
    return F.struct(F.when(flat, mx).otherwise(sx / safe).alias("lon"), F.when(flat, my).otherwise(sy / safe).alias("lat"))
