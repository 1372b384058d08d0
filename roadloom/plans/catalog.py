"""All queries of the map engine by name, over the derived test map, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import planar as p
from ..operators import graph, matching, measures, spatial, topology, trajectory
from ..operators.lineage import shared_folder
from ..sources import geojson, osm
from ..sources import lanes as lane_maps
from ..sources.store import MapStore
from ..streaming import geofence
from . import benchmarks
from .testmap import TestMap, ctes, num

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[TestMap], DataFrame]], Query]:
    """Registers a function of the test map, and what must give the same rows over its common table expressions."""

    def register(make: Callable[[TestMap], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(TestMap(spark, sf_dir))

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        _QUERIES[make.__name__] = run
        if sql is not None:
            _SQL[make.__name__] = sql
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL fragments ----------------------------------------------------------------------------------

R = num(g.RADIUS_M)


def hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"(2 * {R} * asin(sqrt(power(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians({x2} - {x1}) / 2), 2))))"


def bear(x1: str, y1: str, x2: str, y2: str) -> str:
    d = f"radians({x2} - {x1})"
    return f"degrees(atan2(sin({d}) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos({d})))"


def wrapped(angle: str) -> str:
    return f"(({angle} + 360) - 360 * floor(({angle} + 360) / 360))"


def angle_diff(a: str, b: str) -> str:
    return f"abs(({a} - {b} + 180) - 360 * floor(({a} - {b} + 180) / 360) - 180)"


#: For each point and segment the distance to the segment, on the plane at the point.
FEET = f"""
legs AS (
  SELECT q.trajectory_id, q.point_index, q.lon, q.lat, s.id, s.seg,
         radians(s.x1 - q.lon) * {R} * cos(radians(q.lat)) AS ax, radians(s.y1 - q.lat) * {R} AS ay,
         radians(s.x2 - s.x1) * {R} * cos(radians(q.lat)) AS dx, radians(s.y2 - s.y1) * {R} AS dy
  FROM points q, segments s),
feet AS (
  SELECT trajectory_id, point_index, id AS road_id, min(sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2))) AS distance
  FROM (SELECT *, greatest({num(0)}, least({num(1)}, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM legs)
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, point_index ORDER BY round(distance, 6), road_id) AS cand_rank FROM feet)"""

LENGTHS = f"""
lengths AS (
  SELECT id, sum({hav("x1", "y1", "x2", "y2")}) AS length FROM segments GROUP BY id),
measured AS (SELECT r.*, l.length, l.length / (greatest(r.speed_limit, 1) * 1000 / 3600) AS travel_time FROM roads r JOIN lengths l USING (id)),
arcs AS (
  SELECT id AS edge_id, from_node, to_node, length, travel_time, road_class, x1, y1, x2, y2 FROM measured
  UNION ALL SELECT id, to_node, from_node, length, travel_time, road_class, x2, y2, x1, y1 FROM measured WHERE NOT oneway)"""

INSIDE = """
held AS (
  SELECT q.*, f.id AS fence_id,
    CASE WHEN box THEN abs(lon - cx) <= w AND abs(lat - cy) <= h ELSE abs(lon - cx) / w + abs(lat - cy) / h <= 1 END
    AND NOT (hole AND CASE WHEN box THEN abs(lon - cx) < w / 4 AND abs(lat - cy) < h / 4 ELSE abs(lon - cx) / w + abs(lat - cy) / h < 0.25 END) AS inside
  FROM {rows} q, fences f)"""

RINGS = """
corners AS (
  SELECT id, k, 0 AS ring, i, cx + (CASE WHEN box THEN bx ELSE dx END) * w AS x, cy + (CASE WHEN box THEN by_ ELSE dy END) * h AS y
  FROM fences, (VALUES (0, -1, -1, -1, 0), (1, 1, -1, 0, -1), (2, 1, 1, 1, 0), (3, -1, 1, 0, 1), (4, -1, -1, -1, 0)) v(i, bx, by_, dx, dy)),
sides AS (SELECT a.id AS fence_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corners a JOIN corners b ON a.id = b.id AND b.i = a.i + 1)"""


def side_of(a: str, b: str, c: str) -> str:
    """Orientation of three points given as prefixes of columns x and y, as in ``planar.orientation``."""
    (ax, ay), (bx, by), (cx, cy) = a.split(), b.split(), c.split()
    v = f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"
    s = f"power(greatest(abs({bx} - {ax}), abs({by} - {ay}), abs({cx} - {ax}), abs({cy} - {ay}), 1), 2)"
    return f"(CASE WHEN abs({v}) <= 1e-12 * {s} THEN 0 WHEN {v} > 0 THEN 1 ELSE -1 END)"


def cross_of(a: str, b: str) -> str:
    """Whether segments with prefixes a and b cross as ``planar.segment_intersection`` tests first."""
    p1, p2, q1, q2 = f"{a}.x1 {a}.y1", f"{a}.x2 {a}.y2", f"{b}.x1 {b}.y1", f"{b}.x2 {b}.y2"
    return f"({side_of(p1, p2, q1)} <> {side_of(p1, p2, q2)} AND {side_of(q1, q2, p1)} <> {side_of(q1, q2, p2)})"


def with_map(tail: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([ctes(), *more]) + "\n" + tail


BOX = (116.0351, 39.0049, 116.0949, 39.0251)

# Nearest neighbours -----------------------------------------------------------------------------


@query(with_map("SELECT trajectory_id, point_index, CAST(cand_rank AS BIGINT) AS cand_rank, road_id, round(distance, 3) AS distance FROM ranked WHERE cand_rank <= 5", FEET))
def nearby_roads_topk(m: TestMap) -> DataFrame:
    """The five nearest roads of every point."""
    rows = spatial.nearby_roads(m.points, m.roads, ["trajectory_id", "point_index"], 5)
    return rows.select("trajectory_id", "point_index", F.col("cand_rank").cast("long").alias("cand_rank"), "road_id", F.round("distance", 3).alias("distance"))


@query(
    with_map(
        f"""SELECT trajectory_id, point_index, node_id, round(distance, 3) AS distance FROM (
  SELECT q.trajectory_id, q.point_index, n.id AS node_id, {hav("q.lon", "q.lat", "n.lon", "n.lat")} AS distance,
         row_number() OVER (PARTITION BY q.trajectory_id, q.point_index ORDER BY round(power((q.lon - n.lon) * cos(radians((q.lat + n.lat) / 2)), 2) + power(q.lat - n.lat, 2), 18), n.id) AS rn
  FROM points q, nodes n) WHERE rn = 1"""
    )
)
def nearest_node(m: TestMap) -> DataFrame:
    rows = spatial.nearest_node(m.points, m.nodes, ["trajectory_id", "point_index"])
    return rows.select("trajectory_id", "point_index", "node_id", F.round("distance", 3).alias("distance"))


@query(with_map("SELECT trajectory_id, point_index, road_id, round(distance, 3) AS distance FROM ranked WHERE cand_rank = 1", FEET))
def match_nearest(m: TestMap) -> DataFrame:
    return matching.match_nearest(m.points, m.roads).select("trajectory_id", "point_index", "road_id", F.round("distance", 3).alias("distance"))


@query(
    with_map(
        """SELECT trajectory_id, array_to_string(list(road_id ORDER BY point_index), ',') AS roads
FROM (SELECT *, lag(road_id) OVER (PARTITION BY trajectory_id ORDER BY point_index) AS before FROM ranked WHERE cand_rank = 1)
WHERE before IS NULL OR before <> road_id GROUP BY trajectory_id""",
        FEET,
    )
)
def match_nearest_sequence(m: TestMap) -> DataFrame:
    rows = matching.matched_sequences(matching.match_nearest(m.points, m.roads))
    return rows.select("trajectory_id", F.array_join("matched_road_sequence", ",").alias("roads"))


@query(with_map("SELECT trajectory_id, round(1 / (1 + avg(distance) / 25), 3) AS confidence FROM ranked WHERE cand_rank = 1 GROUP BY trajectory_id", FEET))
def match_confidence(m: TestMap) -> DataFrame:
    return matching.matched_sequences(matching.match_nearest(m.points, m.roads)).select("trajectory_id", "confidence")


# Trajectories -----------------------------------------------------------------------------------

_STEPS = f"""
steps AS (
  SELECT *, coalesce({hav("plon", "plat", "lon", "lat")}, 0) AS step_m, {bear("lon", "lat", "nlon", "nlat")} AS ahead, {bear("plon", "plat", "lon", "lat")} AS back,
         {hav("lon", "lat", "nlon", "nlat")} AS next_m, {hav("plon", "plat", "nlon", "nlat")} AS by_m
  FROM (SELECT *, lag(lon) OVER t AS plon, lag(lat) OVER t AS plat, lead(lon) OVER t AS nlon, lead(lat) OVER t AS nlat FROM points WINDOW t AS (PARTITION BY trajectory_id ORDER BY point_index)))"""


@query(with_map("SELECT trajectory_id, point_index, round(step_m, 3) AS step_m FROM steps", _STEPS))
def haversine_step_distance(m: TestMap) -> DataFrame:
    return trajectory.step_distances(m.points).select("trajectory_id", "point_index", F.round("step_m", 3).alias("step_m"))


@query(with_map(f"SELECT trajectory_id, point_index, round({wrapped('coalesce(ahead, back)')}, 5) AS heading FROM steps", _STEPS))
def gps_heading(m: TestMap) -> DataFrame:
    return trajectory.headings(m.points).select("trajectory_id", "point_index", F.round("heading", 5).alias("heading"))


@query(with_map("SELECT trajectory_id, count(*) AS point_count, round(sum(step_m), 3) AS length_m FROM steps GROUP BY trajectory_id", _STEPS))
def trajectory_length(m: TestMap) -> DataFrame:
    return trajectory.lengths(m.points).select("trajectory_id", "point_count", F.round("length_m", 3).alias("length_m"))


_SPIKES = "SELECT trajectory_id, point_index FROM steps WHERE step_m > 220 AND next_m > 220 AND by_m < 220 AND plon IS NOT NULL AND nlon IS NOT NULL"


@query(with_map(_SPIKES, _STEPS))
def outliers(m: TestMap) -> DataFrame:
    return trajectory.outliers(m.points, 220.0)


_CHORD = f"""
chords AS (
  SELECT trajectory_id, arg_min(lon, point_index) AS x1, arg_min(lat, point_index) AS y1, arg_max(lon, point_index) AS x2, arg_max(lat, point_index) AS y2 FROM points GROUP BY trajectory_id),
away AS (
  SELECT trajectory_id, point_index, sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) AS d FROM (
    SELECT *, CASE WHEN dx * dx + dy * dy <= 1e-18 THEN 0 ELSE greatest({num(0)}, least({num(1)}, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM (
      SELECT q.trajectory_id, q.point_index, radians(c.x1 - q.lon) * {R} * cos(radians(q.lat)) AS ax, radians(c.y1 - q.lat) * {R} AS ay,
             radians(c.x2 - c.x1) * {R} * cos(radians(q.lat)) AS dx, radians(c.y2 - c.y1) * {R} AS dy
      FROM points q JOIN chords c USING (trajectory_id))))"""


def _chords(m: TestMap) -> DataFrame:
    end = lambda f: f(F.struct("lon", "lat"), "point_index")
    return m.points.groupBy("trajectory_id").agg(F.array(end(F.min_by), end(F.max_by)).alias("line"))


@query(with_map("SELECT trajectory_id, point_index, round(d, 3) AS deviation_m FROM away", _CHORD))
def point_to_polyline(m: TestMap) -> DataFrame:
    """The distance of each point from the chord of its trajectory."""
    return trajectory.deviations(m.points, _chords(m)).select("trajectory_id", "point_index", F.round("deviation_m", 3).alias("deviation_m"))


@query(with_map("SELECT trajectory_id, round(max(d), 3) AS max_m, round(avg(d), 3) AS mean_m, count(*) FILTER (d > 77.7) AS n_far, array_to_string(list(point_index ORDER BY point_index) FILTER (d > 77.7), ',') AS far FROM away GROUP BY trajectory_id", _CHORD))
def deviation_stats(m: TestMap) -> DataFrame:
    rows = trajectory.deviation_stats(m.points, _chords(m), 77.7)
    far = F.col("exceeds_threshold")
    return rows.select("trajectory_id", F.round("max_m", 3).alias("max_m"), F.round("mean_m", 3).alias("mean_m"), F.size(far).cast("long").alias("n_far"), F.when(F.size(far) > 0, F.array_join(far, ",")).alias("far"))


@query(
    with_map(
        f"""SELECT a, b, round(max(m), 3) AS hausdorff_m FROM (
  SELECT a, b, min(d) AS m FROM d GROUP BY a, b, i UNION ALL SELECT a, b, min(d) FROM d GROUP BY a, b, j) GROUP BY a, b""",
        f"""d AS (SELECT p.trajectory_id AS a, q.trajectory_id AS b, p.point_index AS i, q.point_index AS j, {hav("p.lon", "p.lat", "q.lon", "q.lat")} AS d FROM points p JOIN points q ON q.trajectory_id = p.trajectory_id + 1)""",
    )
)
def hausdorff(m: TestMap) -> DataFrame:
    """Each trajectory against the one with the next id."""
    rows = trajectory.hausdorff(m.points, m.points, _neighbours(m))
    return rows.select("a", "b", F.round("hausdorff_m", 3).alias("hausdorff_m"))


def _neighbours(m: TestMap) -> DataFrame:
    ids = m.points.select(F.col("trajectory_id").alias("a")).distinct()
    return ids.select("a", (F.col("a") + 1).alias("b")).join(ids.withColumnRenamed("a", "b"), "b", "left_semi")


#: Both programs a diagonal at a time: a row for each vertex of the first line holds the last two diagonals' values there.
_DIAGONALS = f"""
pair AS (SELECT a.trajectory_id AS a, b.trajectory_id AS b, a.n, b.n AS m FROM (SELECT trajectory_id, count(*) AS n FROM points GROUP BY 1) a JOIN (SELECT trajectory_id, count(*) AS n FROM points GROUP BY 1) b ON b.trajectory_id = a.trajectory_id + 1),
gap AS (SELECT r.a, r.b, p.point_index AS i, q.point_index AS j, {hav("p.lon", "p.lat", "q.lon", "q.lat")} AS d FROM pair r JOIN points p ON p.trajectory_id = r.a JOIN points q ON q.trajectory_id = r.b),
diag(a, b, k, i, dtw, dtw_old, leash, leash_old) AS (
  SELECT r.a, r.b, CAST(-1 AS BIGINT), p.point_index, CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE) FROM pair r JOIN points p ON p.trajectory_id = r.a
  UNION ALL
  SELECT a, b, k + 1, i, CASE WHEN d IS NULL THEN CAST('inf' AS DOUBLE) WHEN k = -1 THEN d ELSE d + least(dtw, dtw_up, dtw_across) END, dtw, CASE WHEN d IS NULL THEN CAST('inf' AS DOUBLE) WHEN k = -1 THEN d ELSE greatest(d, least(leash, leash_up, leash_across)) END, leash
  FROM (SELECT s.*, g.d, coalesce(lag(dtw) OVER w, CAST('inf' AS DOUBLE)) AS dtw_up, coalesce(lag(dtw_old) OVER w, CAST('inf' AS DOUBLE)) AS dtw_across, coalesce(lag(leash) OVER w, CAST('inf' AS DOUBLE)) AS leash_up, coalesce(lag(leash_old) OVER w, CAST('inf' AS DOUBLE)) AS leash_across
        FROM diag s JOIN pair r ON r.a = s.a AND r.b = s.b AND s.k + 1 <= r.n + r.m - 2 LEFT JOIN gap g ON g.a = s.a AND g.b = s.b AND g.i = s.i AND g.j = s.k + 1 - s.i WINDOW w AS (PARTITION BY s.a, s.b ORDER BY s.i)))"""


@query(with_map("SELECT d.a, d.b, round(d.dtw, 3) AS dtw_m, round(d.leash, 3) AS frechet_m FROM diag d JOIN pair r ON r.a = d.a AND r.b = d.b AND d.k = r.n + r.m - 2 AND d.i = r.n - 1", _DIAGONALS))
def dtw_frechet(m: TestMap) -> DataFrame:
    rows = trajectory.similarity(m.points, _neighbours(m))
    return rows.select("a", "b", F.round("dtw_m", 3).alias("dtw_m"), F.round("frechet_m", 3).alias("frechet_m"))


def _simplified(tolerance: float) -> str:
    """Stretches between kept points, each cut at its farthest point while that is beyond the tolerance."""
    return f"""
stretch(trajectory_id, a, b) AS (
  SELECT trajectory_id, min(point_index), max(point_index) FROM points GROUP BY trajectory_id
  UNION ALL
  SELECT trajectory_id, unnest([a, far]), unnest([far, b]) FROM (
    SELECT trajectory_id, a, b, arg_max(i, (round(d, 9), -i)) AS far, max(d) AS most FROM (
      SELECT *, sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) AS d FROM (
        SELECT *, CASE WHEN dx * dx + dy * dy <= 1e-18 THEN 0 ELSE greatest({num(0)}, least({num(1)}, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM (
          SELECT s.trajectory_id, s.a, s.b, q.point_index AS i, radians(u.lon - q.lon) * {R} * cos(radians(q.lat)) AS ax, radians(u.lat - q.lat) * {R} AS ay,
                 radians(v.lon - u.lon) * {R} * cos(radians(q.lat)) AS dx, radians(v.lat - u.lat) * {R} AS dy
          FROM stretch s JOIN points q ON q.trajectory_id = s.trajectory_id AND q.point_index > s.a AND q.point_index < s.b
          JOIN points u ON u.trajectory_id = s.trajectory_id AND u.point_index = s.a JOIN points v ON v.trajectory_id = s.trajectory_id AND v.point_index = s.b)))
    GROUP BY ALL HAVING max(d) > {tolerance})),
kept AS (SELECT trajectory_id, a AS point_index FROM stretch UNION SELECT trajectory_id, b FROM stretch)"""


@query(with_map("SELECT trajectory_id, point_index FROM kept", _simplified(60)))
def rdp_simplify(m: TestMap) -> DataFrame:
    return trajectory.simplified(m.points, 60.0).select("trajectory_id", "point_index")


@query(
    with_map(
        f"""SELECT trajectory_id, count(*) AS point_count, round(sum(step_m), 3) AS length_m, CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS simplified_point_count, count(*) FILTER (WHERE spike) AS n_outliers, round(max(away), 3) AS max_m, round(avg(away), 3) AS mean_m
FROM (SELECT s.*, k.point_index IS NOT NULL AS kept, s.step_m > 150 AND s.next_m > 150 AND s.by_m < 150 AND plon IS NOT NULL AND nlon IS NOT NULL AS spike, v.d AS away
      FROM steps s LEFT JOIN kept k USING (trajectory_id, point_index) JOIN (SELECT trajectory_id, point_index, min(d) AS d FROM reach GROUP BY ALL) v USING (trajectory_id, point_index))
GROUP BY trajectory_id""",
        _STEPS,
        _simplified(5),
        f"""legs_of AS (SELECT k.trajectory_id, p.lon AS x1, p.lat AS y1, lead(p.lon) OVER w AS x2, lead(p.lat) OVER w AS y2 FROM kept k JOIN points p USING (trajectory_id, point_index) WINDOW w AS (PARTITION BY k.trajectory_id ORDER BY k.point_index)),
reach AS (
  SELECT trajectory_id, point_index, sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) AS d FROM (
    SELECT *, CASE WHEN dx * dx + dy * dy <= 1e-18 THEN 0 ELSE greatest({num(0)}, least({num(1)}, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM (
      SELECT q.trajectory_id, q.point_index, radians(c.x1 - q.lon) * {R} * cos(radians(q.lat)) AS ax, radians(c.y1 - q.lat) * {R} AS ay, radians(c.x2 - c.x1) * {R} * cos(radians(q.lat)) AS dx, radians(c.y2 - c.y1) * {R} AS dy
      FROM points q JOIN legs_of c ON c.trajectory_id = q.trajectory_id AND c.x2 IS NOT NULL)))""",
    )
)
def trajectory_analyze(m: TestMap) -> DataFrame:
    """Each trajectory against its own simplification; no column of the query is a distance of whole lines."""
    rows = trajectory.analyse(m.points, measured=())
    return rows.select("trajectory_id", "point_count", F.round("length_m", 3).alias("length_m"), "simplified_point_count", F.size("outlier_indices").cast("long").alias("n_outliers"), F.round("max_m", 3).alias("max_m"), F.round("mean_m", 3).alias("mean_m"))


@query(
    with_map(
        """SELECT DISTINCT trajectory_id, round(x, 7) AS lon, round(y, 7) AS lat FROM rim r
WHERE NOT EXISTS (SELECT 1 FROM rim e WHERE e.trajectory_id = r.trajectory_id AND e.qx = r.x AND e.qy = r.y AND abs((r.x - e.x) * (r.qy - e.y) - (r.y - e.y) * (r.qx - e.x)) <= 1e-12)""",
        """rim AS (SELECT trajectory_id, x, y, qx, qy FROM (
  SELECT p.trajectory_id, p.lon AS x, p.lat AS y, q.lon AS qx, q.lat AS qy, min((q.lon - p.lon) * (r.lat - p.lat) - (q.lat - p.lat) * (r.lon - p.lon)) AS least
  FROM points p JOIN points q ON q.trajectory_id = p.trajectory_id AND (q.lon, q.lat) <> (p.lon, p.lat) JOIN points r ON r.trajectory_id = p.trajectory_id GROUP BY p.trajectory_id, p.lon, p.lat, q.lon, q.lat)
WHERE least >= -1e-12)""",
    )
)
def convex_hull(m: TestMap) -> DataFrame:
    """The corners of the hull of each trajectory's points."""
    return trajectory.convex_hulls(m.points, "trajectory_id").select("trajectory_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat")).distinct()


# Boxes ------------------------------------------------------------------------------------------

_BOXES = "boxes AS (SELECT id, min(least(x1, x2)) AS min_lon, min(least(y1, y2)) AS min_lat, max(greatest(x1, x2)) AS max_lon, max(greatest(y1, y2)) AS max_lat FROM segments GROUP BY id)"
_R7 = ", ".join(f"round({c}, 7) AS {c}" for c in spatial.BOX)


@query(with_map(f"SELECT id, {_R7} FROM boxes", _BOXES))
def road_bbox(m: TestMap) -> DataFrame:
    return m.roads.select("id", *[F.round(c, 7).alias(c) for c in spatial.BOX])


@query(with_map("SELECT round(min(min_lon), 7) AS min_lon, round(min(min_lat), 7) AS min_lat, round(max(max_lon), 7) AS max_lon, round(max(max_lat), 7) AS max_lat FROM boxes", _BOXES))
def dataset_bounds(m: TestMap) -> DataFrame:
    return spatial.bounds(m.roads).select(*[F.round(c, 7).alias(c) for c in spatial.BOX])


@query(with_map(" UNION ALL ".join(f"SELECT '{n}' AS layer, count(*) AS n FROM {n}" for n in ("nodes", "roads", "points", "fences", "pois"))))
def layer_counts(m: TestMap) -> DataFrame:
    parts = [getattr(m, n).agg(F.lit(n).alias("layer"), F.count(F.lit(1)).alias("n")) for n in ("nodes", "roads", "points", "fences", "pois")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_DY = f"(250 / {num(g.METRES_PER_DEGREE)})"
_DX = f"(250 / ({num(g.METRES_PER_DEGREE)} * greatest({num(0.1)}, abs(cos(radians((min_lat + max_lat) / 2))))))"


@query(with_map(f"SELECT id, round(min_lon - {_DX}, 7) AS min_lon, round(min_lat - {_DY}, 7) AS min_lat, round(max_lon + {_DX}, 7) AS max_lon, round(max_lat + {_DY}, 7) AS max_lat FROM boxes", _BOXES))
def bbox_expand(m: TestMap) -> DataFrame:
    wide = g.expand_bbox(*[F.col(c) for c in spatial.BOX], 250.0)
    return m.roads.withColumn("_w", wide).select("id", *[F.round(f"_w.{c}", 7).alias(c) for c in spatial.BOX])


_CX = f"degrees(40 / ({R} * greatest(cos(radians((min_lat + max_lat) / 2)), 1e-12)))"


@query(with_map(f"SELECT id, round(min_lon - {_CX}, 7) AS west, round(min_lat - degrees(40 / {R}), 7) AS south, round(max_lon + {_CX}, 7) AS east, round(max_lat + degrees(40 / {R}), 7) AS north FROM boxes", _BOXES))
def corridor_bbox(m: TestMap) -> DataFrame:
    ring = F.element_at(g.corridor(F.col("geometry"), 40.0), 1)
    a, b = F.element_at(ring, 1), F.element_at(ring, 3)
    return m.roads.select("id", F.round(a["lon"], 7).alias("west"), F.round(a["lat"], 7).alias("south"), F.round(b["lon"], 7).alias("east"), F.round(b["lat"], 7).alias("north"))


@query(with_map(f"SELECT id FROM boxes WHERE min_lon <= {num(BOX[2])} AND max_lon >= {num(BOX[0])} AND min_lat <= {num(BOX[3])} AND max_lat >= {num(BOX[1])}", _BOXES))
def roads_in_bbox(m: TestMap) -> DataFrame:
    return spatial.roads_in_bbox(m.roads, BOX).select("id")


@query(with_map("SELECT a.id AS road_id, f.id AS fence_id FROM boxes a JOIN fences f ON a.min_lon <= f.cx + f.w AND a.max_lon >= f.cx - f.w AND a.min_lat <= f.cy + f.h AND a.max_lat >= f.cy - f.h", _BOXES))
def roads_in_bbox_batch(m: TestMap) -> DataFrame:
    """Roads and the boxes of all fences."""
    rows = spatial.bbox_join(m.roads.select("id", *spatial.BOX), spatial.polygon_boxes(m.fences).select("id", *spatial.BOX))
    return rows.select(F.col("l_id").alias("road_id"), F.col("r_id").alias("fence_id"))


@query(with_map("SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id < b.id AND a.min_lon <= b.max_lon AND a.max_lon >= b.min_lon AND a.min_lat <= b.max_lat AND a.max_lat >= b.min_lat", _BOXES))
def grid_cell_self_join(m: TestMap) -> DataFrame:
    """Roads whose boxes meet, by grid cells."""
    boxes = m.roads.select("id", *spatial.BOX)
    return spatial.bbox_join(boxes, boxes, 0.004).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


@query(with_map("SELECT qx, qy, count(*) AS n FROM (SELECT CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS qx, CAST(floor((lat + 90) / 180 * 4096) AS BIGINT) AS qy FROM pois) GROUP BY qx, qy"))
def quadkey_counts(m: TestMap) -> DataFrame:
    """Places in each quadtree leaf of depth 12, the key decoded to its column and row."""
    digit = lambda bit: F.aggregate(F.split("key", ""), F.lit(0).cast("long"), lambda a, d: a * 2 + F.shiftright(F.coalesce(d.try_cast("int"), F.lit(0)), bit).bitwiseAND(F.lit(1)))
    keys = m.pois.groupBy(spatial.quadkey(F.col("lon"), F.col("lat")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keys.select(digit(0).alias("qx"), digit(1).alias("qy"), "n")


_TILES = """
ranked_x AS (SELECT id, (min_lon + max_lon) / 2 AS x, (min_lat + max_lat) / 2 AS y, row_number() OVER (ORDER BY (min_lon + max_lon) / 2, id) - 1 AS e, count(*) OVER () AS n FROM boxes),
slices AS (SELECT *, CAST(floor(e / ceil(n / greatest(1, ceil(sqrt(n / 8))))) AS BIGINT) AS tile_x FROM ranked_x)"""


@query(with_map("SELECT id, tile_x, CAST(floor((row_number() OVER (PARTITION BY tile_x ORDER BY y, id) - 1) / 8) AS BIGINT) AS tile_y FROM slices", _BOXES, _TILES))
def str_tiles(m: TestMap) -> DataFrame:
    """The leaf of each road in a sort-tile-recursive layout."""
    return spatial.str_tiles(m.roads.select("id", *spatial.BOX)).select("id", "tile_x", "tile_y")


@query(with_map(f"SELECT id FROM pois WHERE lon BETWEEN {num(BOX[0])} AND {num(BOX[2])} AND lat BETWEEN {num(BOX[1])} AND {num(BOX[3])}"))
def quadkey_range(m: TestMap) -> DataFrame:
    """Places in a box, by ranges of their quadkeys."""
    return spatial.points_in_bbox_by_quadkey(m.pois.withColumn("quadkey", spatial.quadkey(F.col("lon"), F.col("lat"), 14)), BOX).select("id")


@query(with_map(" UNION ALL ".join(f"SELECT '{n}' AS layout, (SELECT count(*) FROM boxes WHERE min_lon <= {num(BOX[2])} AND max_lon >= {num(BOX[0])} AND min_lat <= {num(BOX[3])} AND max_lat >= {num(BOX[1])}) AS n" for n in ("brute_force", "grid", "quadtree", "rtree", "str_rtree")), _BOXES))
def index_layouts(m: TestMap) -> DataFrame:
    """How many roads each layout finds in a box."""
    return benchmarks.index_benchmark(m.roads, [BOX]).select(F.col("index").alias("layout"), F.col("result_count").cast("long").alias("n"))


@query(
    with_map(
        f"""SELECT r.id, round((b.min_lon + b.max_lon) / 2, 7) AS lon, round((b.min_lat + b.max_lat) / 2, 7) AS lat, r.xm IS NOT NULL AND r.xm BETWEEN r.x1 AND r.x2 AND r.ym BETWEEN r.y1 AND r.y2 AS middle_in_chord_box,
  b.min_lon >= {num(BOX[0])} AND b.max_lon <= {num(BOX[2])} AND b.min_lat >= {num(BOX[1])} AND b.max_lat <= {num(BOX[3])} AS inside_box, round(CASE WHEN r.oneway THEN m.travel_time ELSE m.length END, 3) AS weight, r.xm IS NULL AS middle_near_chord
FROM roads r JOIN boxes b USING (id) JOIN measured m USING (id)""",
        _BOXES,
        LENGTHS,
    )
)
def road_kernels(m: TestMap) -> DataFrame:
    """Small predicates and measures on every road: its box, its middle vertex against its chord, its weight."""
    first, last = F.element_at("geometry", 1), F.element_at("geometry", -1)
    middle = F.when(F.size("geometry") == 3, F.element_at("geometry", 2)).otherwise(first)
    chord = (first["lon"], first["lat"], last["lon"], last["lat"])
    centre = g.bbox_center(*[F.col(c) for c in spatial.BOX])
    return m.roads.select(
        "id", F.round(centre["lon"], 7).alias("lon"), F.round(centre["lat"], 7).alias("lat"), ((F.size("geometry") == 3) & p.in_segment_box(middle["lon"], middle["lat"], *chord)).alias("middle_in_chord_box"),
        p.bbox_contains(tuple(F.lit(x) for x in BOX), tuple(F.col(c) for c in spatial.BOX)).alias("inside_box"), F.round(g.arc_weight(F.col("length"), g.travel_time(F.col("length"), F.col("speed_limit")), F.when(F.col("oneway"), "shortest_time").otherwise("shortest_distance")), 3).alias("weight"),
        g.near_segment(middle["lon"], middle["lat"], *chord).alias("middle_near_chord"),
    )


# Polygons and fences ----------------------------------------------------------------------------


@query(with_map("SELECT trajectory_id, point_index, fence_id FROM held WHERE inside", INSIDE.format(rows="points")))
def points_in_polygon_traj(m: TestMap) -> DataFrame:
    return spatial.points_in_polygons(m.points, m.fences).select("trajectory_id", "point_index", "fence_id")


@query(with_map("SELECT id, fence_id FROM held WHERE inside", INSIDE.format(rows="pois")))
def points_in_polygon_pois(m: TestMap) -> DataFrame:
    return spatial.points_in_polygons(m.pois, m.fences).select("id", "fence_id")


@query(with_map("SELECT fence_id, trajectory_id, point_index, CASE WHEN inside THEN 'enter' ELSE 'exit' END AS event FROM (SELECT *, lag(inside, 1, false) OVER (PARTITION BY fence_id, trajectory_id ORDER BY point_index) AS before FROM held) WHERE inside <> before", INSIDE.format(rows="points")))
def geofence_events(m: TestMap) -> DataFrame:
    return spatial.fence_events(m.points, m.fences)


@query(with_map("SELECT fence_id, count(*) AS n_points, count(DISTINCT trajectory_id) AS n_trajectories FROM held WHERE inside GROUP BY fence_id", INSIDE.format(rows="points")))
def geofence_dwell_counts(m: TestMap) -> DataFrame:
    return spatial.points_in_polygons(m.points, m.fences).groupBy("fence_id").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("trajectory_id").alias("n_trajectories"))


_MEET = f"""
vertices AS (SELECT id, x1 AS lon, y1 AS lat FROM segments UNION SELECT id, x2, y2 FROM segments)"""
_CUT = f"meets AS (SELECT DISTINCT road_id, fence_id FROM (SELECT s.id AS road_id, e.fence_id FROM segments s JOIN sides e ON {cross_of('s', 'e')} UNION ALL SELECT id, fence_id FROM held WHERE inside))"


@query(with_map("SELECT road_id, fence_id FROM meets", _MEET, INSIDE.format(rows="vertices"), RINGS, _CUT))
def roads_in_polygon(m: TestMap) -> DataFrame:
    return spatial.roads_in_polygons(m.roads, m.fences)


@query(with_map("SELECT DISTINCT road_id FROM meets", _MEET, INSIDE.format(rows="vertices"), RINGS, _CUT))
def blocked_edges(m: TestMap) -> DataFrame:
    return spatial.blocked_edges(m.roads, m.fences)


@query(with_map("SELECT id, round(CASE WHEN box THEN 4 * w * h ELSE 2 * w * h END, 9) AS area, round(cx, 6) AS lon, round(cy, 6) AS lat FROM fences"))
def polygon_area_centroid(m: TestMap) -> DataFrame:
    ring = F.element_at("rings", 1)
    moved = F.transform(ring, lambda q: F.struct((q["lon"] - F.element_at(ring, 1)["lon"]).alias("lon"), (q["lat"] - F.element_at(ring, 1)["lat"]).alias("lat")))
    middle = p.ring_centroid(moved)
    first = F.element_at(ring, 1)
    return m.fences.select("id", F.round(p.ring_area(ring), 9).alias("area"), F.round(middle["lon"] + first["lon"], 6).alias("lon"), F.round(middle["lat"] + first["lat"], 6).alias("lat"))


# Graph ------------------------------------------------------------------------------------------


@query(with_map("SELECT edge_id, from_node, to_node, round(length, 3) AS length, round(travel_time, 3) AS travel_time FROM arcs", LENGTHS))
def graph_arcs(m: TestMap) -> DataFrame:
    return graph.arcs(m.roads).select("edge_id", "from_node", "to_node", F.round("length", 3).alias("length"), F.round("travel_time", 3).alias("travel_time"))


_DEGREE = "degrees_ AS (SELECT n.id AS node_id, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS degree FROM nodes n LEFT JOIN (SELECT from_node AS id, 1 AS n FROM roads UNION ALL SELECT to_node, 1 FROM roads) e USING (id) GROUP BY n.id)"


@query(with_map("SELECT node_id, degree FROM degrees_", _DEGREE))
def node_degree(m: TestMap) -> DataFrame:
    return graph.node_degree(m.nodes, m.roads)


@query(with_map("SELECT node_id FROM degrees_ WHERE degree = 0", _DEGREE))
def isolated_nodes(m: TestMap) -> DataFrame:
    return topology.isolated_nodes(m.nodes, m.roads)


@query(with_map("SELECT DISTINCT r.id AS road_id FROM roads r JOIN degrees_ d ON d.node_id IN (r.from_node, r.to_node) WHERE d.degree <= 1", _DEGREE))
def dangling_edges(m: TestMap) -> DataFrame:
    return topology.dangling_edges(m.nodes, m.roads)


_LINKS = "links AS (SELECT from_node AS a, to_node AS b FROM roads UNION ALL SELECT to_node, from_node FROM roads)"
_REACH = "reach(node, component) USING KEY (node) AS (SELECT id, id FROM nodes UNION SELECT l.b, min(r.component) FROM reach r JOIN links l ON l.a = r.node LEFT JOIN recurring.reach x ON x.node = l.b WHERE x.component IS NULL OR r.component < x.component GROUP BY l.b)"


@query(with_map("SELECT node, component FROM reach", _LINKS, _REACH))
def connected_components(m: TestMap) -> DataFrame:
    return graph.components(m.nodes, m.roads.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")))


#: How far searches from every node go: metres, seconds.
NEAR_M, NEAR_S = 2500.0, 180.0


def _spread(weight: str, bound: float, where: str = "true") -> str:
    """The least cost from every node to all nodes within a bound."""
    return f"""best(source, node, cost) USING KEY (source, node) AS (
  SELECT id, id, {num(0)} FROM nodes UNION
  SELECT r.source, a.to_node, min(r.cost + a.{weight}) FROM best r JOIN arcs a ON a.from_node = r.node LEFT JOIN recurring.best x ON x.source = r.source AND x.node = a.to_node
  WHERE {where} AND r.cost + a.{weight} <= {bound} AND (x.cost IS NULL OR r.cost + a.{weight} < x.cost - 1e-9) GROUP BY r.source, a.to_node)"""


def _origins(m: TestMap) -> DataFrame:
    return m.nodes.select(F.col("id").alias("source"))


@query(with_map("SELECT source, node, round(cost, 2) AS distance FROM best", LENGTHS, _spread("length", NEAR_M)))
def shortest_distance(m: TestMap) -> DataFrame:
    """From every node to all nodes within NEAR_M."""
    return graph.shortest_paths(graph.arcs(m.roads), _origins(m), max_cost=NEAR_M).select("source", "node", F.round("distance", 2).alias("distance"))


@query(with_map("SELECT source, node, round(cost, 2) AS seconds FROM best", LENGTHS, _spread("travel_time", NEAR_S)))
def shortest_time(m: TestMap) -> DataFrame:
    return graph.shortest_paths(graph.arcs(m.roads), _origins(m), "shortest_time", max_cost=NEAR_S).select("source", "node", F.round("travel_time", 2).alias("seconds"))


@query(with_map("SELECT source, node, round(cost, 2) AS distance FROM best", LENGTHS, _MEET, INSIDE.format(rows="vertices"), RINGS, _CUT, _spread("length", NEAR_M, "a.edge_id NOT IN (SELECT road_id FROM meets)")))
def avoid_polygon(m: TestMap) -> DataFrame:
    """As ``shortest_distance`` on roads that meet no fence."""
    open_arcs = graph.without(graph.arcs(m.roads), spatial.blocked_edges(m.roads, m.fences))
    return graph.shortest_paths(open_arcs, _origins(m), max_cost=NEAR_M).select("source", "node", F.round("distance", 2).alias("distance"))


#: Stops of a route that starts at any node: its number and these steps on, as far as there are such nodes.
STOPS = (0, 26, 1, 27)


def _stop_pairs() -> str:
    """Legs between stops as rows of SQL."""
    legs = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(STOPS, STOPS[1:], strict=False)))
    return f"legs AS (SELECT n.k AS route, v.leg, a.id AS source, b.id AS target FROM nodes n, (VALUES {legs}) v(leg, x, y) JOIN nodes a ON a.k = n.k + v.x JOIN nodes b ON b.k = n.k + v.y)"


def _legs(m: TestMap) -> DataFrame:
    named = m.nodes.select(F.col("pos").alias("_k"), F.col("id"))
    pairs = F.array(*[F.struct(F.lit(i).alias("leg"), F.lit(a).alias("x"), F.lit(b).alias("y")) for i, (a, b) in enumerate(zip(STOPS, STOPS[1:], strict=False))])
    rows = m.nodes.select(F.col("pos").alias("route"), F.explode(pairs).alias("l")).select("route", "l.leg", (F.col("route") + F.col("l.x")).alias("a"), (F.col("route") + F.col("l.y")).alias("b"))
    return rows.join(named.select(F.col("_k").alias("a"), F.col("id").alias("source")), "a").join(named.select(F.col("_k").alias("b"), F.col("id").alias("target")), "b").select("route", "leg", "source", "target")


@query(
    with_map(
        "SELECT l.route, CAST(count(*) AS BIGINT) AS n_legs, bool_and(b.cost IS NOT NULL) AS found, round(sum(b.cost), 2) AS distance FROM legs l LEFT JOIN best b ON b.source = l.source AND b.node = l.target GROUP BY l.route",
        LENGTHS,
        _stop_pairs(),
        _spread("length", 1e9),
    )
)
def waypoint_route(m: TestMap) -> DataFrame:
    """From every node over three stops on the grid, the legs merged."""
    legs = _legs(m)
    merged = graph.merged_legs(legs.join(graph.routes(graph.arcs(m.roads), legs.select("source", "target"), algorithm="astar"), ["source", "target"]), "route")
    size = legs.groupBy("route").agg(F.count(F.lit(1)).alias("n_legs"))
    return merged.join(size, "route").select("route", "n_legs", "found", F.round("distance", 2).alias("distance"))


_HEADED = f"headed AS (SELECT *, {wrapped(bear('x1', 'y1', 'x2', 'y2'))} AS heading FROM arcs)"
_TURN = angle_diff("r.heading", "a.heading")
_EXPLAINED = f"""
state(source, node, edge, heading, cost) USING KEY (source, node, edge) AS (
  SELECT id, id, '', {num(0)}, {num(0)} FROM nodes UNION
  SELECT source, to_node, edge_id, any_value(next_heading), min(total) FROM (
    SELECT r.source, a.to_node, a.edge_id, a.heading AS next_heading, r.cost + a.length + CASE WHEN a.road_class IN ('primary', 'secondary') THEN 0 ELSE a.length * 0.15 END
           + CASE WHEN r.edge = '' OR r.edge = a.edge_id OR {_TURN} < 35 THEN 0 WHEN {_TURN} > 150 THEN 16 ELSE 8 * {_TURN} / 90 END AS total
    FROM state r JOIN headed a ON a.from_node = r.node) c LEFT JOIN (SELECT source AS s, node AS n, edge AS e, cost AS known FROM recurring.state) x ON x.s = c.source AND x.n = c.to_node AND x.e = c.edge_id
  WHERE (known IS NULL OR total < known - 1e-9) GROUP BY source, to_node, edge_id),
cheapest AS (SELECT source, node, min(cost) AS cost FROM state GROUP BY ALL)"""


@query(with_map("SELECT a.id AS source, b.id AS target, c.cost IS NOT NULL AS found, round(c.cost, 2) AS cost FROM nodes a JOIN nodes b ON b.k = a.k + 26 LEFT JOIN cheapest c ON c.source = a.id AND c.node = b.id", LENGTHS, _HEADED, _EXPLAINED))
def explained_route(m: TestMap) -> DataFrame:
    """From every node to the one a row and a column on, primary and secondary roads preferred."""
    ends = m.nodes.select(F.col("id").alias("target"), (F.col("pos") - 26).alias("pos"))
    pairs = m.nodes.select(F.col("id").alias("source"), "pos").join(ends, "pos").select("source", "target")
    return graph.explained_routes(graph.arcs(m.roads), pairs, preferred=["primary", "secondary"]).select("source", "target", "found", F.round("cost", 2).alias("cost"))


# Topology ---------------------------------------------------------------------------------------


@query(
    with_map(
        """SELECT first, id AS duplicate FROM (
  SELECT id, first_value(id) OVER w AS first, row_number() OVER w AS n
  FROM (SELECT *, least(from_node, to_node) AS a, greatest(from_node, to_node) AS b FROM roads) WINDOW w AS (PARTITION BY a, b ORDER BY pos)) WHERE n > 1"""
    )
)
def duplicate_edges(m: TestMap) -> DataFrame:
    return topology.duplicate_edges(m.roads)


_PAIRS = f"""
pairs AS (
  SELECT a.id AS first, b.id AS second, a.seg AS seg_a, b.seg AS seg_b, a.x1 + t * (a.x2 - a.x1) AS lon, a.y1 + t * (a.y2 - a.y1) AS lat
  FROM (SELECT a, b, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) AS t
        FROM segments a, segments b WHERE a.pos < b.pos AND a.from_node NOT IN (b.from_node, b.to_node) AND a.to_node NOT IN (b.from_node, b.to_node)
          AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2)
          AND {cross_of("a", "b")}))"""


@query(with_map("SELECT first, second, seg_a, seg_b, round(lon, 6) AS lon, round(lat, 6) AS lat FROM pairs", _PAIRS))
def illegal_crossings(m: TestMap) -> DataFrame:
    rows = topology.crossings(m.roads).where("type = 'illegal_crossing'")
    return rows.select("first", "second", F.col("seg_a").cast("long").alias("seg_a"), F.col("seg_b").cast("long").alias("seg_b"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_TRACE = """
shuffled AS (SELECT trajectory_id, lon, lat, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY point_index % 7, point_index) - 1 AS BIGINT) AS seg FROM points),
trace AS (SELECT trajectory_id, seg, lon AS x1, lat AS y1, lead(lon) OVER t AS x2, lead(lat) OVER t AS y2 FROM shuffled WINDOW t AS (PARTITION BY trajectory_id ORDER BY seg)),
cut AS (SELECT * FROM trace WHERE x2 IS NOT NULL)"""


@query(with_map(f"SELECT concat('t_', CAST(a.trajectory_id AS VARCHAR)) AS road_id, a.seg AS seg_a, b.seg AS seg_b FROM cut a JOIN cut b ON a.trajectory_id = b.trajectory_id AND b.seg >= a.seg + 2 WHERE {cross_of('a', 'b')}", _TRACE))
def self_intersections(m: TestMap) -> DataFrame:
    """Where a line meets itself that runs through a trajectory's points seven times, each time with every seventh."""
    order = Window.partitionBy("trajectory_id").orderBy(F.col("point_index") % 7, "point_index")
    points = m.points.withColumn("point_index", F.row_number().over(order) - 1)
    rows = trajectory.lines(points).select(F.concat(F.lit("t_"), F.col("trajectory_id").cast("string")).alias("id"), F.col("trajectory_id").alias("pos"), F.lit("a").alias("from_node"), F.lit("b").alias("to_node"), F.col("line").alias("geometry"))
    return topology.self_intersections(rows).select("road_id", F.col("seg_a").cast("long").alias("seg_a"), F.col("seg_b").cast("long").alias("seg_b"))


_DUPLICATES = """
duplicates AS (SELECT first, id AS duplicate FROM (
  SELECT id, first_value(id) OVER w AS first, row_number() OVER w AS n
  FROM (SELECT *, least(from_node, to_node) AS a, greatest(from_node, to_node) AS b FROM roads) WINDOW w AS (PARTITION BY a, b ORDER BY pos)) WHERE n > 1)"""
_ISSUES = """
issues AS (
  SELECT 'isolated_node' AS type, 'warning' AS severity, '' AS road_ids, node_id AS node_ids, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS lat FROM degrees_ WHERE degree = 0
  UNION ALL SELECT DISTINCT 'dangling_edge', 'warning', r.id, '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM roads r JOIN degrees_ d ON d.node_id IN (r.from_node, r.to_node) WHERE d.degree <= 1
  UNION ALL SELECT 'duplicate_edge', 'error', concat(first, ',', duplicate), '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM duplicates
  UNION ALL SELECT 'illegal_crossing', 'error', concat(first, ',', second), '', lon, lat FROM pairs)"""


@query(with_map("SELECT type, severity, road_ids, node_ids, round(lon, 6) AS lon, round(lat, 6) AS lat FROM issues", _DEGREE, _DUPLICATES, _PAIRS, _ISSUES))
def topology_issues(m: TestMap) -> DataFrame:
    rows = topology.validate(m.nodes, m.roads)
    return rows.select("type", "severity", F.array_join("road_ids", ",").alias("road_ids"), F.array_join("node_ids", ",").alias("node_ids"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


#: The nodes, and beside each one a twin, nearer than the next node but for every seventh, which is not near.
_TWINS = f"""
twins AS (SELECT id, lon, lat, k AS pos FROM nodes UNION ALL SELECT concat(id, '_b'), lon + CASE WHEN k % 7 = 0 THEN {num(0.005)} ELSE {num(0.002)} END, lat, k + 1000000 FROM nodes
  UNION ALL SELECT concat(id, '_c'), lon + {num(0.004)}, lat, k + 2000000 FROM nodes),
ordered AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM twins),
led(id, n, rep, lon, lat) USING KEY (id) AS (
  SELECT id, n, id, lon, lat FROM ordered WHERE n = 1 UNION
  SELECT o.id, o.n, coalesce(arg_min(l.id, l.n), o.id), o.lon, o.lat FROM (SELECT max(n) AS n FROM led) c JOIN ordered o ON o.n = c.n + 1
  LEFT JOIN recurring.led l ON l.rep = l.id AND {hav("l.lon", "l.lat", "o.lon", "o.lat")} <= 300 GROUP BY o.id, o.n, o.lon, o.lat),
middles AS (SELECT rep, avg(lon) AS lon, avg(lat) AS lat FROM led GROUP BY rep)"""


@query(with_map("SELECT l.id, l.rep AS rep_id, round(m.lon, 7) AS lon, round(m.lat, 7) AS lat FROM led l JOIN middles m ON m.rep = l.rep", _TWINS))
def snap_nodes(m: TestMap) -> DataFrame:
    """Nodes with two more beside each, snapped within 300 m: whoever comes first leads."""
    twin = lambda s, east, pos: m.nodes.select(F.concat("id", F.lit(s)).alias("id"), (F.col("lon") + east).alias("lon"), "lat", (F.col("pos") + pos).alias("pos"))
    near = m.nodes.unionByName(twin("_b", F.when(F.col("pos") % 7 == 0, F.lit(0.005)).otherwise(F.lit(0.002)), 1_000_000)).unionByName(twin("_c", F.lit(0.004), 2_000_000))
    return topology.snap_nodes(near, 300.0).select("id", "rep_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


#: Proper crossings of any two roads away from the ends of their segments, the places along each, and the pieces between vertices and such places.
_SPLIT = f"""
hits AS (SELECT a, b, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) AS t,
    ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) AS u
  FROM segments a, segments b WHERE a.pos < b.pos AND {cross_of("a", "b")} AND abs((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) > 1e-12),
cuts AS (SELECT a.id AS id, a.seg AS seg, t, a.x1 + t * (a.x2 - a.x1) AS x, a.y1 + t * (a.y2 - a.y1) AS y FROM hits WHERE t > 1e-6 AND t < 1 - 1e-6 AND u > 1e-6 AND u < 1 - 1e-6
  UNION ALL SELECT b.id, b.seg, u, b.x1 + u * (b.x2 - b.x1), b.y1 + u * (b.y2 - b.y1) FROM hits WHERE t > 1e-6 AND t < 1 - 1e-6 AND u > 1e-6 AND u < 1 - 1e-6),
chain AS (SELECT id, seg, t, x, y FROM cuts UNION ALL SELECT id, seg, 0, x1, y1 FROM segments WHERE id IN (SELECT id FROM cuts) UNION ALL SELECT id, max(seg) + 1, 0, arg_max(x2, seg), arg_max(y2, seg) FROM segments WHERE id IN (SELECT id FROM cuts) GROUP BY id),
single AS (SELECT id, seg, min(t) AS t, min(x) AS x, min(y) AS y FROM chain GROUP BY id, seg, round(x, 8), round(y, 8)),
runs AS (SELECT id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w - 1 AS n FROM single WINDOW w AS (PARTITION BY id ORDER BY seg, t)),
pieces AS (SELECT concat(id, '_split_', CAST(n AS VARCHAR)) AS id, x, y, nx, ny, {hav("x", "y", "nx", "ny")} AS length FROM runs WHERE nx IS NOT NULL),
final AS (SELECT id, x, y, nx, ny, length FROM pieces UNION ALL SELECT r.id, r.x1, r.y1, r.x2, r.y2, l.length FROM roads r JOIN lengths l USING (id) WHERE r.id NOT IN (SELECT id FROM cuts))"""


@query(with_map("SELECT id, round(x, 6) AS from_lon, round(y, 6) AS from_lat, round(nx, 6) AS to_lon, round(ny, 6) AS to_lat, round(length, 2) AS length FROM final", LENGTHS, _SPLIT))
def split_roads(m: TestMap) -> DataFrame:
    rows = topology.split_roads(m.roads.drop(*spatial.BOX))
    end = lambda i, c: F.round(F.element_at("geometry", i)[c], 6)
    return rows.select("id", end(1, "lon").alias("from_lon"), end(1, "lat").alias("from_lat"), end(-1, "lon").alias("to_lon"), end(-1, "lat").alias("to_lat"), F.round("length", 2).alias("length"))


@query(
    with_map(
        """SELECT CAST(0 AS BIGINT) AS snapped_nodes, (SELECT count(*) FROM final) - (SELECT count(*) FROM roads) AS split_edges_added,
  (SELECT count(*) FROM final) - (SELECT count(DISTINCT least(concat(round(x, 7), ' ', round(y, 7)), concat(round(nx, 7), ' ', round(ny, 7))) || '/' || greatest(concat(round(x, 7), ' ', round(y, 7)), concat(round(nx, 7), ' ', round(ny, 7)))) FROM final) AS duplicate_edges_removed,
  (SELECT count(*) FROM issues) AS before_issues, (SELECT count(*) FROM duplicates) AS before_duplicate_edges, (SELECT count(*) FROM pairs) AS before_illegal_crossings, (SELECT count(*) FROM reach WHERE node = component) AS before_components,
  CAST(0 AS BIGINT) AS after_duplicate_edges, CAST(0 AS BIGINT) AS after_illegal_crossings, CAST(0 AS BIGINT) AS after_isolated_nodes""",
        LENGTHS, _SPLIT, _DEGREE, _DUPLICATES, _PAIRS, _ISSUES, _LINKS, _REACH,
    )
)
def topology_repair_summary(m: TestMap) -> DataFrame:
    """Operations of a repair, issues before it, and that none of the kinds that it mends is left."""
    rows = topology.repair(m.nodes, m.roads.drop(*spatial.BOX), 1.0)[2]
    return rows.select("snapped_nodes", "split_edges_added", "duplicate_edges_removed", "before_issues", "before_duplicate_edges", "before_illegal_crossings", "before_components", "after_duplicate_edges", "after_illegal_crossings", "after_isolated_nodes")


# Cost terms -------------------------------------------------------------------------------------

_PRIOR = " ".join(f"WHEN '{k}' THEN {num(v)}" for k, v in g.CLASS_PRIOR.items())


@query(with_map(f"SELECT id, CASE road_class {_PRIOR} ELSE {num(g.CLASS_PRIOR_OTHER)} END AS prior, round(travel_time, 3) AS travel_time, round(CASE WHEN road_class = 'primary' THEN 0 ELSE 0.15 * length END, 3) AS preference_cost FROM measured", LENGTHS))
def road_costs(m: TestMap) -> DataFrame:
    return m.roads.select(
        "id", g.class_prior(F.col("road_class"), F.col("road_type")).alias("prior"), F.round(g.travel_time(F.col("length"), F.col("speed_limit")), 3).alias("travel_time"),
        F.round(g.class_preference_cost(F.col("road_class"), F.col("length"), ["primary"]), 3).alias("preference_cost"),
    )


_ANGLE = angle_diff("a.heading", "b.heading")


@query(with_map(f"SELECT a.edge_id AS prev_edge, b.edge_id, a.to_node AS node, round(CASE WHEN a.edge_id = b.edge_id OR {_ANGLE} < 35 THEN 0 WHEN {_ANGLE} > 150 THEN 16 ELSE 8 * {_ANGLE} / 90 END, 4) AS turn_s FROM headed a JOIN headed b ON a.to_node = b.from_node", LENGTHS, _HEADED))
def turn_cost_pairs(m: TestMap) -> DataFrame:
    arcs = graph.arcs(m.roads)
    a, b = arcs.select(F.col("edge_id").alias("prev_edge"), F.col("heading").alias("h1"), F.col("to_node").alias("node")), arcs.select("edge_id", F.col("heading").alias("h2"), F.col("from_node").alias("node"))
    return a.join(b, "node").select("prev_edge", "edge_id", "node", F.round(g.turn_cost(F.col("prev_edge"), F.col("h1"), F.col("edge_id"), F.col("h2")), 4).alias("turn_s"))


_FEASIBLE = "greatest(45, 25 + point_index % 30) * 1.35 + 10"


@query(with_map(f"SELECT trajectory_id, point_index, round(CASE WHEN point_index = 0 OR step_m / 5 * 3.6 <= {_FEASIBLE} THEN 0 ELSE least(1, (step_m / 5 * 3.6 - ({_FEASIBLE})) / ({_FEASIBLE})) END, 4) AS penalty FROM steps", _STEPS))
def speed_feasibility(m: TestMap) -> DataFrame:
    """Steps of five seconds between roads of 45 and of 25 to 54 km/h."""
    steps = trajectory.step_distances(m.points)
    before = F.when(F.col("point_index") > 0, F.lit(45.0))
    penalty = g.speed_feasibility(before, (F.lit(25) + F.col("point_index") % 30).cast("double"), F.col("step_m"), F.lit(5.0))
    return steps.select("trajectory_id", "point_index", F.round(penalty, 4).alias("penalty"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS p50, round(list_sort(list(value))[1 + CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT)], 6) AS p95, round(list_sort(list(value))[1 + CAST(round_even((count(*) - 1) * 0.99, 0) AS BIGINT)], 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles_nearest_rank(m: TestMap) -> DataFrame:
    """Event values by type, as if they were timings."""
    return measures.latency_report(m.table("events"), ["event_type"], "value").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


# Map matching and exchange ----------------------------------------------------------------------


#: Candidates with the heading of their nearest segment and of travel, the network between all nodes, and every pair of candidates of neighbouring points with its cost terms.
_PRIOR_OF = f"CASE s.road_class {_PRIOR} ELSE {num(g.CLASS_PRIOR_OTHER)} END"
_CANDIDATES = f"""
nearest_seg AS (
  SELECT *, row_number() OVER (PARTITION BY trajectory_id, point_index, id ORDER BY d, seg) AS rn FROM (
    SELECT *, sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) AS d FROM (SELECT *, greatest({num(0)}, least({num(1)}, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM legs))),
cands AS (
  SELECT k.trajectory_id, k.point_index, k.cand_rank, k.road_id, n.d AS distance, q.lon, q.lat, {wrapped(bear("g.x1", "g.y1", "g.x2", "g.y2"))} AS road_heading, {wrapped("coalesce(q.ahead, q.back)")} AS heading, s.oneway, s.from_node, s.to_node, {_PRIOR_OF} AS prior
  FROM ranked k JOIN nearest_seg n ON n.trajectory_id = k.trajectory_id AND n.point_index = k.point_index AND n.id = k.road_id AND n.rn = 1
  JOIN segments g ON g.id = k.road_id AND g.seg = n.seg JOIN steps q ON q.trajectory_id = k.trajectory_id AND q.point_index = k.point_index JOIN roads s ON s.id = k.road_id WHERE k.cand_rank <= 5),
directed AS (SELECT *, CASE WHEN heading IS NULL THEN 0 WHEN oneway THEN {angle_diff("road_heading", "heading")} / 180 ELSE least({angle_diff("road_heading", "heading")}, {angle_diff("((road_heading + 180) - 360 * floor((road_heading + 180) / 360))", "heading")}) / 180 END AS direction_cost FROM cands),
road_pairs AS (SELECT DISTINCT a.road_id AS prev_road, b.road_id, a.from_node AS f1, a.to_node AS t1, b.from_node AS f2, b.to_node AS t2 FROM cands a JOIN cands b ON a.trajectory_id = b.trajectory_id AND b.point_index = a.point_index + 1 AND a.road_id <> b.road_id),
net AS (SELECT p.prev_road, p.road_id, min(b.cost) AS network_m FROM road_pairs p LEFT JOIN best b ON b.source IN (p.f1, p.t1) AND b.node IN (p.f2, p.t2) GROUP BY ALL),
moves AS (
  SELECT b.trajectory_id, b.point_index, a.cand_rank AS prev_rank, b.cand_rank, b.distance, b.direction_cost, b.prior, CASE WHEN a.road_id = b.road_id THEN 0 ELSE n.network_m END AS network_m, {hav("a.lon", "a.lat", "b.lon", "b.lat")} AS gps_m,
         CASE WHEN a.road_id = b.road_id THEN 0 ELSE {angle_diff("a.road_heading", "b.road_heading")} / 180 END AS turn
  FROM directed a JOIN directed b ON a.trajectory_id = b.trajectory_id AND b.point_index = a.point_index + 1 LEFT JOIN net n ON n.prev_road = a.road_id AND n.road_id = b.road_id)"""
_GREEDY = f"""
walk(trajectory_id, point_index, cand_rank, total_cost) AS (
  SELECT trajectory_id, point_index, cand_rank, total FROM (SELECT *, distance + 30 * direction_cost + 12 * prior AS total, row_number() OVER (PARTITION BY trajectory_id ORDER BY round(distance + 30 * direction_cost + 12 * prior, 9), cand_rank) AS rn FROM directed WHERE point_index = 0) WHERE rn = 1
  UNION ALL
  SELECT trajectory_id, point_index, cand_rank, total FROM (
    SELECT m.trajectory_id, m.point_index, m.cand_rank, c.total, row_number() OVER (PARTITION BY m.trajectory_id ORDER BY round(c.total, 9), m.cand_rank) AS rn FROM walk w JOIN moves m ON m.trajectory_id = w.trajectory_id AND m.point_index = w.point_index + 1 AND m.prev_rank = w.cand_rank,
    LATERAL (SELECT m.distance + 30 * m.direction_cost + 0.02 * coalesce(m.network_m, {num(1_000_000.0)}) + 25 * m.turn + 12 * m.prior AS total) c) WHERE rn = 1)"""
_VITERBI = """
scored AS (SELECT *, -0.5 * power(distance / 20, 2) - 4 * direction_cost - 0.4 * prior AS emission, CASE WHEN network_m IS NULL THEN -1e6 ELSE -abs(network_m - gps_m) / 50 - 1.5 * turn - 0.5 * prior END AS transition FROM moves),
path(trajectory_id, point_index, cand_rank, score, states) AS (
  SELECT trajectory_id, point_index, cand_rank, -0.5 * power(distance / 20, 2) - 4 * direction_cost - 0.4 * prior, [cand_rank] FROM directed WHERE point_index = 0
  UNION ALL
  SELECT trajectory_id, point_index, cand_rank, score, states FROM (
    SELECT s.trajectory_id, s.point_index, s.cand_rank, p.score + s.transition + s.emission AS score, list_append(p.states, s.cand_rank) AS states, row_number() OVER (PARTITION BY s.trajectory_id, s.cand_rank ORDER BY round(p.score + s.transition, 9) DESC, s.prev_rank) AS rn
    FROM path p JOIN scored s ON s.trajectory_id = p.trajectory_id AND s.point_index = p.point_index + 1 AND s.prev_rank = p.cand_rank) WHERE rn = 1),
ends AS (SELECT trajectory_id, states FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY point_index DESC, round(score, 9) DESC, cand_rank) AS rn FROM path) WHERE rn = 1),
chosen AS (SELECT trajectory_id, unnest(range(0, len(states))) AS point_index, unnest(states) AS cand_rank FROM ends)"""


@query(with_map("SELECT w.trajectory_id, w.point_index, d.road_id, round(w.total_cost, 4) AS total_cost FROM walk w JOIN directed d USING (trajectory_id, point_index, cand_rank)", FEET, _STEPS, LENGTHS, _spread("length", 1e9), _CANDIDATES, _GREEDY))
def match_candidate_cost(m: TestMap) -> DataFrame:
    return matching.match_candidate_cost(m.points, m.roads).select("trajectory_id", "point_index", "road_id", F.round("total_cost", 4).alias("total_cost"))


@query(with_map("SELECT c.trajectory_id, c.point_index, d.road_id, round(d.distance, 3) AS distance FROM chosen c JOIN directed d USING (trajectory_id, point_index, cand_rank)", FEET, _STEPS, LENGTHS, _spread("length", 1e9), _CANDIDATES, _VITERBI))
def match_hmm(m: TestMap) -> DataFrame:
    return matching.match_hmm(m.points, m.roads).select("trajectory_id", "point_index", "road_id", F.round("distance", 3).alias("distance"))


_TRUTH = f"""
true_legs AS (SELECT q.trajectory_id, q.point_index, s.id, s.seg, radians(s.x1 - q.lon) * {R} * cos(radians(q.lat)) AS ax, radians(s.y1 - q.lat) * {R} AS ay, radians(s.x2 - s.x1) * {R} * cos(radians(q.lat)) AS dx, radians(s.y2 - s.y1) * {R} AS dy
  FROM (SELECT trajectory_id, point_index, lon, {num(39.0003)} + (trajectory_id % 4) * {num(0.01)} AS lat FROM points) q, segments s),
true_feet AS (SELECT trajectory_id, point_index, id AS road_id, min(sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2))) AS d FROM (SELECT *, greatest({num(0)}, least({num(1)}, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM true_legs) GROUP BY ALL),
true_road AS (SELECT trajectory_id, point_index, arg_min(road_id, (round(d, 6), road_id)) AS road_id FROM true_feet GROUP BY ALL),
truth AS (SELECT trajectory_id, list(road_id ORDER BY point_index) AS roads FROM (SELECT *, lag(road_id) OVER (PARTITION BY trajectory_id ORDER BY point_index) AS before FROM true_road) WHERE before IS NULL OR before <> road_id GROUP BY trajectory_id),
got AS (SELECT trajectory_id, list(road_id ORDER BY point_index) AS roads FROM (SELECT *, lag(road_id) OVER (PARTITION BY trajectory_id ORDER BY point_index) AS before FROM ranked WHERE cand_rank = 1) WHERE before IS NULL OR before <> road_id GROUP BY trajectory_id),
hits AS (SELECT t.trajectory_id, t.roads AS truth, g.roads AS got, len(list_filter(g.roads, lambda x: list_contains(t.roads, x))) AS n FROM truth t JOIN got g USING (trajectory_id))"""


@query(with_map("SELECT trajectory_id, round(n / len(got), 4) AS precision, round(n / len(truth), 4) AS recall, got = truth AS exact_match FROM hits", FEET, _TRUTH))
def match_evaluation(m: TestMap) -> DataFrame:
    """The nearest roads of all points against those of points without their noise, a little north of their line."""
    clean = m.points.withColumn("lat", F.lit(39.0003) + (F.col("trajectory_id") % 4) * 0.01)
    found, true = (matching.matched_sequences(matching.match_nearest(points, m.roads)) for points in (m.points, clean))
    return matching.evaluation(found, true.select("trajectory_id", F.col("matched_road_sequence").alias("roads"))).select("trajectory_id", "precision", "recall", "exact_match")


# Sources, sinks, engine -------------------------------------------------------------------------------


@query(
    with_map(
        """SELECT id, 'LineString' AS kind, CASE WHEN xm IS NULL THEN 2 ELSE 3 END AS size, round(x1, 6) AS lon, round(y1, 6) AS lat FROM roads
UNION ALL SELECT id, 'Polygon', CASE WHEN hole THEN 2 ELSE 1 END, round(CASE WHEN box THEN cx - w ELSE cx - w END, 6), round(CASE WHEN box THEN cy - h ELSE cy END, 6) FROM fences
UNION ALL SELECT CAST(id AS VARCHAR), 'Point', 2, round(lon, 6), round(lat, 6) FROM pois
UNION ALL SELECT CAST(trajectory_id AS VARCHAR), 'LineString', CAST(count(*) AS INTEGER), round(arg_min(lon, point_index), 6), round(arg_min(lat, point_index), 6) FROM points GROUP BY trajectory_id"""
    )
)
def geojson_features(m: TestMap) -> DataFrame:
    """Every feature of every layer as JSON, parsed again."""
    points = m.points.select(F.col("trajectory_id").cast("string").alias("trajectory_id"), "point_index", "lon", "lat", F.lit(None).cast("string").alias("ts_raw"))
    pois = m.pois.select(F.col("id").cast("string").alias("id"), "name", "lon", "lat", F.create_map().cast("map<string,string>").alias("properties"), F.lit(0).cast("long").alias("pos"))
    rows = geojson.road_features(m.roads).unionByName(geojson.geofence_features(m.fences)).unionByName(geojson.poi_features(pois)).unionByName(geojson.trajectory_features(points))
    at = lambda path: F.get_json_object("feature", path)
    kind = at("$.geometry.type")
    first = F.when(kind == "Point", at("$.geometry.coordinates")).when(kind == "Polygon", at("$.geometry.coordinates[0][0]")).otherwise(at("$.geometry.coordinates[0]"))
    pair = F.from_json(first, "array<double>")
    size = F.when(kind == "Point", F.lit(2)).otherwise(F.json_array_length(at("$.geometry.coordinates")))
    return rows.select(at("$.id").alias("id"), kind.alias("kind"), size.alias("size"), F.round(pair[0], 6).alias("lon"), F.round(pair[1], 6).alias("lat"))


_ROAD_COLUMNS = "SELECT r.id, r.from_node, r.to_node, round(l.length, 3) AS length, r.speed_limit, r.road_class, r.road_class AS road_type, r.oneway, CASE WHEN r.oneway THEN 'forward' ELSE 'both' END AS direction, CASE WHEN r.xm IS NULL THEN 2 ELSE 3 END AS n_vertices FROM roads r JOIN lengths l USING (id)"


@query(with_map(_ROAD_COLUMNS, LENGTHS))
def load_geojson_roads(m: TestMap) -> DataFrame:
    """All roads written as one GeoJSON text and loaded again."""
    text = geojson.feature_collection(geojson.road_features(m.roads))
    rows = geojson.roads(geojson.features(text))[1]
    return rows.select("id", "from_node", "to_node", F.round("length", 3).alias("length"), "speed_limit", "road_class", "road_type", "oneway", "direction", F.size("geometry").alias("n_vertices"))


@query(with_map("SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM nodes WHERE id IN (SELECT from_node FROM roads UNION ALL SELECT to_node FROM roads)"))
def load_geojson_nodes(m: TestMap) -> DataFrame:
    """The nodes that loading the roads makes, from files with a feature in a line."""
    folder = f"{shared_folder(m.spark)}/lines-{uuid.uuid4().hex}"
    geojson.write_features(geojson.road_features(m.roads), folder)
    return geojson.roads(geojson.read_feature_lines(m.spark, folder))[0].select("id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query(with_map("SELECT CAST(trajectory_id AS VARCHAR) AS trajectory_id, CAST(point_index AS INTEGER) AS point_index, round(lon, 7) AS lon, round(lat, 7) AS lat, CAST(point_index * 5 AS VARCHAR) AS ts_raw FROM points"))
def load_geojson_trajectories(m: TestMap) -> DataFrame:
    rows = m.points.select(F.col("trajectory_id").cast("string").alias("trajectory_id"), "point_index", "lon", "lat", (F.col("point_index") * 5).cast("string").alias("ts_raw"))
    read = geojson.trajectories(geojson.features(geojson.feature_collection(geojson.trajectory_features(rows))))
    return read.select("trajectory_id", "point_index", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "ts_raw")


@query(with_map("SELECT id, name, 'fence' AS layer, CASE WHEN hole THEN 2 ELSE 1 END AS size FROM fences UNION ALL SELECT CAST(id AS VARCHAR), name, 'poi', 2 FROM pois"))
def load_geojson_areas_and_places(m: TestMap) -> DataFrame:
    """Fences and places, each layer written and loaded again."""
    pois = m.pois.select(F.col("id").cast("string").alias("id"), "name", "lon", "lat", F.create_map(F.lit("kind"), F.lit("x")).alias("properties"), F.col("id").alias("pos"))
    fences = geojson.geofences(geojson.features(geojson.feature_collection(geojson.geofence_features(m.fences))))
    places = geojson.pois(geojson.features(geojson.feature_collection(geojson.poi_features(pois))))
    return fences.select("id", "name", F.lit("fence").alias("layer"), F.size("rings").alias("size")).unionByName(places.select("id", "name", F.lit("poi").alias("layer"), F.size("properties").alias("size")))


@query(
    with_map(
        """SELECT concat('osm_way_', id, '_', CAST(seg AS VARCHAR)) AS id, concat('osm_node_', CASE WHEN seg = 0 THEN from_node ELSE concat(id, '_m') END) AS from_node, concat('osm_node_', CASE WHEN seg = 0 AND xm IS NOT NULL THEN concat(id, '_m') ELSE to_node END) AS to_node,
  speed_limit, road_class, oneway, CAST(row_number() OVER (ORDER BY pos, seg) - 1 AS BIGINT) AS pos
FROM (SELECT r.id, r.from_node, r.to_node, r.xm, r.pos, r.speed_limit, r.road_class, r.oneway, s.seg FROM roads r JOIN segments s USING (id))"""
    )
)
def load_osm(m: TestMap) -> DataFrame:
    """All roads written as OSM XML, their middle vertices as nodes, and loaded again in the order of the file."""
    c, e = F.col, lane_maps.element
    ends = m.nodes.select("id", "lon", "lat")
    middle = m.roads.where(F.size("geometry") == 3).select(F.concat("id", F.lit("_m")).alias("id"), *[F.element_at("geometry", 2)[x].alias(x) for x in ("lon", "lat")])
    nodes = ends.unionByName(middle).select(F.lit(0).alias("layer"), F.lit(0).cast("long").alias("pos"), e("node", [("id", c("id")), ("lon", c("lon")), ("lat", c("lat"))]).alias("value"))
    refs = F.when(F.size("geometry") == 3, F.array("from_node", F.concat("id", F.lit("_m")), "to_node")).otherwise(F.array("from_node", "to_node"))
    tags = [("highway", c("road_class")), ("maxspeed", c("speed_limit")), ("oneway", F.when(c("oneway"), "yes").otherwise("no"))]
    body = F.concat(F.array_join(F.transform(refs, lambda r: e("nd", [("ref", r)])), ""), *[e("tag", [("k", F.lit(k)), ("v", v)]) for k, v in tags])
    ways = m.roads.select(F.lit(1).alias("layer"), "pos", e("way", [("id", c("id"))], body).alias("value"))
    text = lane_maps.document(nodes.unionByName(ways).select(F.struct("layer", "pos").alias("id"), "value"), "osm")
    roads = osm.read_text(m.spark, text.first()["value"])[1]  # one text, whose size is checked
    return roads.select("id", "from_node", "to_node", "speed_limit", "road_class", "oneway", "pos")


def _lanes(m: TestMap) -> tuple[DataFrame, DataFrame]:
    """A lane along each road, behind the one whose number is one less, with its own left boundary."""
    c = F.col
    lanes = m.roads.select(
        "id", c("geometry").alias("centerline"), F.concat("id", F.lit("_l")).alias("left_boundary"), F.lit(None).cast("string").alias("right_boundary"), "speed_limit", c("road_class").alias("turn_type"),
        F.array("from_node").alias("predecessor_ids"), F.array("to_node").alias("successor_ids"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return lanes, m.roads.select(F.concat("id", F.lit("_l")).alias("id"), "geometry", F.lit("solid").alias("boundary_type"), F.lit("white").alias("color"))


_LANE_COLUMNS = "SELECT id, CASE WHEN xm IS NULL THEN 2 ELSE 3 END AS n_vertices, round(x1, 7) AS lon, round(y1, 7) AS lat, {extra} speed_limit, road_class AS turn_type, from_node AS before, to_node AS after FROM roads"


def _lane_columns(rows: DataFrame, lane_id: Column, *extra: Column) -> DataFrame:
    first = F.element_at("centerline", 1)
    return rows.select(lane_id.alias("id"), F.size("centerline").alias("n_vertices"), F.round(first["lon"], 7).alias("lon"), F.round(first["lat"], 7).alias("lat"), *extra, "speed_limit", "turn_type", F.array_join("predecessor_ids", ",").alias("before"), F.array_join("successor_ids", ",").alias("after"))


@query(with_map(_LANE_COLUMNS.format(extra="concat(id, '_l') AS left_boundary,")))
def opendrive_round_trip(m: TestMap) -> DataFrame:
    """A lane for each road, written as OpenDRIVE and read again."""
    text = lane_maps.document(lane_maps.export_opendrive(*_lanes(m)), "OpenDRIVE").first()["value"]
    return _lane_columns(lane_maps.import_opendrive(m.spark, text), F.col("id"), F.col("left_boundary"))


@query(with_map(_LANE_COLUMNS.format(extra="1 AS n_boundaries,")))
def lanelet2_round_trip(m: TestMap) -> DataFrame:
    """The same as Lanelet2, whose tags keep the names."""
    lanes, bounds = lane_maps.import_lanelet2(m.spark, lane_maps.export_lanelet2(*_lanes(m)).first()["value"])
    held = lanes.join(bounds.select(F.col("id").alias("left_boundary"), F.lit(1).alias("n_boundaries")), "left_boundary", "left")
    return _lane_columns(held, F.col("metadata")["source_id"], F.coalesce("n_boundaries", F.lit(0)).alias("n_boundaries"))


@query(with_map("SELECT id, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END AS name, CAST(row_number() OVER (ORDER BY CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, k) - 1 AS BIGINT) AS place FROM fences"))
def store_upsert(m: TestMap) -> DataFrame:
    """Fences stored, every third one replaced, twice in one go: the last one wins and moves to the end."""
    store = MapStore(m.spark, f"{shared_folder(m.spark)}/store-{uuid.uuid4().hex}")
    store.replace(geofences=m.fences.withColumn("name", F.lit("old")))
    third = m.fences.where("pos % 3 = 0")
    store.upsert("geofences", third.withColumn("name", F.lit("lost")).unionByName(third.withColumns({"name": F.lit("new"), "pos": F.col("pos") + 1000})))
    return store.layer("geofences").select("id", "name", (F.row_number().over(Window.orderBy("pos")) - 1).cast("long").alias("place"))


@query(
    with_map(
        "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM roads) AS roads, (SELECT count(DISTINCT trajectory_id) FROM points) AS trajectories, (SELECT count(*) FROM fences) AS geofences, (SELECT count(*) FROM pois) AS pois, (SELECT count(*) FROM arcs) AS arcs, (SELECT round(sum(length), 2) FROM lengths) AS length_m",
        LENGTHS,
    )
)
def engine_stats(m: TestMap) -> DataFrame:
    """The statistics of an engine that holds the map."""
    held = engine_of(m)
    return held.stats().select("nodes", "roads", "trajectories", "geofences", "pois", "arcs", F.round("length_m", 2).alias("length_m"))


def engine_of(m: TestMap):
    """An engine on a store of its own that holds the derived map."""
    from ..engine import MapEngine

    made = MapEngine(m.spark, f"{shared_folder(m.spark)}/engine-{uuid.uuid4().hex}", empty=True)
    made.store.replace(road_nodes=m.nodes, road_edges=m.roads, trajectory_points=m.points, geofences=m.fences, pois=m.pois)
    return made


@query(with_map("SELECT fence_id, trajectory_id, point_index, CASE WHEN inside THEN 'enter' ELSE 'exit' END AS event FROM (SELECT *, lag(inside, 1, false) OVER (PARTITION BY fence_id, trajectory_id ORDER BY point_index) AS before FROM held) WHERE inside <> before", INSIDE.format(rows="points")))
def stream_fence_events(m: TestMap) -> DataFrame:
    """``geofence_events`` from a stream of all points, five seconds apart, in three files; a last one moves the watermark past them."""
    folder = f"{shared_folder(m.spark)}/stream-{uuid.uuid4().hex}"
    rows = m.points.select(F.col("trajectory_id").cast("string").alias("trajectory_id"), F.timestamp_seconds(F.col("point_index") * 5 + 1_000_000).alias("ts"), "lon", "lat")
    end = m.spark.createDataFrame([("", 0.0, 0.0)], "trajectory_id string, lon double, lat double").select("trajectory_id", F.timestamp_seconds(F.lit(9_000_000)).alias("ts"), "lon", "lat")
    for k in range(4):
        part = end if k == 3 else rows.where(F.pmod(F.xxhash64("trajectory_id", "ts"), F.lit(3)) == k)
        part.write.mode("append").parquet(f"{folder}/in")
        source = m.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        stream = geofence.fence_event_stream(source, m.fences).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    found = m.spark.read.schema("fence_id string, trajectory_id string, ts timestamp, event string").parquet(f"{folder}/out")
    index = ((F.unix_timestamp("ts") - 1_000_000) / 5).cast("long")
    return found.select("fence_id", F.col("trajectory_id").cast("long").alias("trajectory_id"), index.alias("point_index"), "event")
