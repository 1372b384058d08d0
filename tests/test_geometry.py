"""Column expressions against literal cases and plain formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import geodesy as g
from roadloom.functions import planar as p
from roadloom.functions.types import LINE, RINGS
from roadloom.operators import trajectory


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*values):
    return [F.lit(float(v)) for v in values]


def line(points):
    return F.array(*[g.point(F.lit(float(x)), F.lit(float(y))) for x, y in points]).cast(LINE)


def rings(*parts):
    return F.array(*[line(r) for r in parts]).cast(RINGS)


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]


def test_orientation(spark):
    assert one(spark, p.orientation(*lits(0, 0, 1, 1, 2, 2))) == 0
    assert one(spark, p.orientation(*lits(0, 0, 1, 0, 1, 1))) == 1
    assert one(spark, p.orientation(*lits(0, 0, 1, 0, 1, -1))) == -1
    assert one(spark, p.on_segment(*lits(1, 1, 0, 0, 2, 2)))
    assert not one(spark, p.on_segment(*lits(1, 1.1, 0, 0, 2, 2)))


@pytest.mark.parametrize(
    ("segments", "kind", "place"),
    [
        ((0, 0, 2, 0, 1, 0, 3, 0), "overlap", (1, 0)),
        ((0, 0, 1, 1, 1, 1, 2, 0), "point", (1, 1)),
        ((0, 0, 2, 2, 0, 2, 2, 0), "point", (1, 1)),
        ((0, 0, 1, 0, 2, 0, 3, 0), "none", None),
        ((0, 0, 4, 0, 2, 0, 2, 3), "point", (2, 0)),
        ((0, 0, 1, 0, 0, 1, 1, 1), "none", None),
        ((0, 0, 1, 0, 1, 0, 2, 0), "point", (1, 0)),
        ((0, 0, 0, 2, 0, 1, 0, 3), "overlap", (0, 1)),
    ],
)
def test_segment_intersection(spark, segments, kind, place):
    got = one(spark, p.segment_intersection(*lits(*segments)))
    assert got["kind"] == kind
    if place:
        assert (got["x"], got["y"]) == pytest.approx(place)


def test_crossing_keeps_its_digits_far_from_the_origin(spark):
    got = one(spark, p.segment_intersection(*lits(116.39, 39.9, 116.40, 39.91, 116.39, 39.91, 116.40, 39.9)))
    assert (got["x"], got["y"]) == pytest.approx((116.395, 39.905), abs=1e-13)


@pytest.mark.parametrize(("at", "side"), [((0.5, 0.5), "inside"), ((1.5, 1.5), "outside"), ((1, 1.5), "boundary"), ((0, 2), "boundary"), ((5, 1), "outside"), ((4, 4), "boundary")])
def test_point_in_polygon(spark, at, side):
    assert one(spark, p.point_in_polygon(*lits(*at), rings(SQUARE, HOLE))) == side


def test_polygons_without_enough_vertices(spark):
    assert one(spark, p.point_in_polygon(*lits(0, 0), F.array().cast(RINGS))) == "outside"
    assert one(spark, p.point_in_polygon(*lits(0, 0), rings([(0, 0), (1, 1)]))) == "outside"


def test_area_and_centroid(spark):
    assert one(spark, p.ring_area(line(SQUARE))) == 16
    assert tuple(one(spark, p.ring_centroid(line(SQUARE)))) == pytest.approx((2, 2))
    assert tuple(one(spark, p.ring_centroid(line([(0, 0), (2, 0)])))) == (1, 0)
    assert one(spark, p.ring_area(line([(0, 0), (2, 0)]))) == 0


def test_polyline_meets_polygon(spark):
    assert one(spark, p.polyline_meets_polygon(line([(-1, 3), (5, 3)]), rings(SQUARE)))
    assert not one(spark, p.polyline_meets_polygon(line([(5, 5), (6, 6)]), rings(SQUARE)))
    assert not one(spark, p.polyline_meets_polygon(line([(1.2, 1.2), (1.8, 1.8)]), rings(SQUARE, HOLE)))


def test_boxes(spark):
    a, b, c = lits(0, 0, 2, 2), lits(1, 1, 3, 3), lits(2, 2, 3, 3)
    assert one(spark, p.bbox_intersects(tuple(a), tuple(b)))
    assert one(spark, p.bbox_intersects(tuple(a), tuple(c)))
    assert not one(spark, p.bbox_intersects(tuple(lits(0, 0, 1, 1)), tuple(c)))
    assert one(spark, p.bbox_contains(tuple(a), tuple(lits(0, 0, 2, 1))))


def test_distances(spark):
    assert one(spark, g.haversine(*lits(0, 0, 1, 0))) == pytest.approx(math.radians(1) * g.RADIUS_M)
    assert one(spark, g.polyline_length(line([(0, 0), (1, 0), (2, 0)]))) == pytest.approx(2 * math.radians(1) * g.RADIUS_M)
    assert one(spark, g.polyline_length(line([(0, 0)]))) == 0
    foot = one(spark, g.polyline_projection(*lits(116.4, 39.901), line([(116.39, 39.9), (116.41, 39.9)])))
    assert foot["distance"] > 100
    assert (foot["plon"], foot["plat"]) == pytest.approx((116.4, 39.9), abs=1e-4)
    assert one(spark, g.polyline_projection(*lits(0, 0), line([(1, 0)])))["distance"] == pytest.approx(math.radians(1) * g.RADIUS_M)
    assert one(spark, g.polyline_projection(*lits(0, 0), F.array().cast(LINE))) is None


def test_points_near_a_segment(spark):
    assert one(spark, g.near_segment(*lits(116.4, 39.900001, 116.39, 39.9, 116.41, 39.9)))
    assert not one(spark, g.near_segment(*lits(116.4, 39.90001, 116.39, 39.9, 116.41, 39.9)))


def test_angles(spark):
    assert one(spark, g.bearing(*lits(0, 0, 0, 1))) == 0
    assert one(spark, g.bearing(*lits(0, 0, 1, 0))) == pytest.approx(90)
    assert one(spark, g.bearing(*lits(0, 0, -1, 0))) == pytest.approx(270)
    assert one(spark, g.angle_difference(*lits(350, 10))) == pytest.approx(20)
    assert one(spark, g.angle_difference(*lits(0, 180))) == pytest.approx(180)


def test_cost_terms(spark):
    s = F.lit
    assert one(spark, g.travel_time(*lits(1000, 36))) == pytest.approx(100)
    assert one(spark, g.travel_time(*lits(1000, 0))) == pytest.approx(3600)
    assert one(spark, g.turn_cost(s(None).cast("string"), s(0.0), s("b"), s(90.0))) == 0
    assert one(spark, g.turn_cost(s("a"), s(0.0), s("a"), s(180.0))) == 0
    assert one(spark, g.turn_cost(s("a"), s(0.0), s("b"), s(90.0))) == pytest.approx(8)
    assert one(spark, g.turn_cost(s("a"), s(0.0), s("b"), s(170.0))) == pytest.approx(16)
    assert one(spark, g.turn_cost(s("a"), s(0.0), s("b"), s(30.0))) == 0
    assert one(spark, g.class_prior(s("primary"), s("x"))) == 0.08
    assert one(spark, g.class_prior(s("x"), s("service"))) == 0.32
    assert one(spark, g.class_prior(s("x"), s("y"))) == 0.25
    assert one(spark, g.direction_cost(*lits(0, 180), s(True))) == 0
    assert one(spark, g.direction_cost(*lits(0, 180), s(False))) == 1
    assert one(spark, g.direction_cost(s(0.0), s(None).cast("double"), s(False))) == 0
    assert one(spark, g.speed_feasibility(*lits(50, 30, 100, 10))) == 0
    assert one(spark, g.speed_feasibility(*lits(10, 10, 1000, 10))) == 1
    assert one(spark, g.speed_feasibility(s(None).cast("double"), *lits(10, 1000, 10))) == 0
    assert one(spark, g.class_preference_cost(s("a"), s(100.0), [])) == 0
    assert one(spark, g.class_preference_cost(s("a"), s(100.0), ["b"])) == 15


def test_boxes_in_metres(spark):
    wide = one(spark, g.expand_bbox(*lits(0, 0, 0, 0), 111_320.0))
    assert tuple(wide) == pytest.approx((-1, -1, 1, 1))
    ring = one(spark, g.corridor(line([(0, 0), (1, 0)]), 1000.0))[0]
    assert len(ring) == 5 and ring[0] == ring[-1]
    assert one(spark, g.corridor(F.array().cast(LINE), 1000.0)) == [[]]


def test_dynamic_programs_against_recursion():
    from functools import cache

    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.normal(size=(rng.integers(1, 6), 2)) / 100, rng.normal(size=(rng.integers(1, 6), 2)) / 100
        d = trajectory.distance_matrix(a, b)

        @cache
        def warp(i, j, d=d):
            before = [warp(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            return d[i, j] + (min(before) if before else 0)

        @cache
        def leash(i, j, d=d):
            before = [leash(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            return max(d[i, j], min(before)) if before else d[i, j]

        assert trajectory.dtw(a, b) == pytest.approx(warp(len(a) - 1, len(b) - 1))
        assert trajectory.frechet(a, b) == pytest.approx(leash(len(a) - 1, len(b) - 1))
    assert trajectory.dtw(np.zeros((0, 2)), np.zeros((1, 2))) == trajectory.frechet(np.zeros((0, 2)), np.zeros((1, 2))) == 0


def test_simplify_and_hull():
    assert trajectory.simplify(np.array([(0, 0), (1, 0.001), (2, 0)]), 10).sum() == 3
    assert trajectory.simplify(np.array([(0, 0), (1, 0.00001), (2, 0)]), 10).sum() == 2
    assert trajectory.simplify(np.array([(0.0, 0.0)]), 10).sum() == 1
    ring = trajectory.hull(np.array([(0, 0), (1, 0), (0, 1), (0.2, 0.2)]))
    assert tuple(ring[0]) == (0, 0) and tuple(ring[-1]) == (0, 0) and len(ring) == 4


def test_simplify_takes_the_first_of_vertices_equally_far():
    y = 39.00001
    line = np.array([(116.0, 39.0), (116.003, y), (116.006, np.nextafter(y, 90)), (116.009, 39.0)])  # the third is 8e-10 m farther
    assert trajectory.simplify(line, 1.0989).tolist() == [True, True, False, True]


def test_simplify_is_the_same_by_arrays_and_by_numbers(monkeypatch):
    rng = np.random.default_rng(3)
    many = [np.column_stack([116 + np.arange(n) * 0.0011, 39 + rng.integers(-1000, 1000, n) * 1e-6]) for n in (2, 3, 20, 70)]
    by_numbers = [trajectory.simplify(line, 5.0).tolist() for line in many]
    monkeypatch.setattr(trajectory, "SHORT", 0)
    assert [trajectory.simplify(line, 5.0).tolist() for line in many] == by_numbers
