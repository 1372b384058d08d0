"""Trajectory analysis: lengths, headings, outliers, simplification, similarity, deviation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import planar as p
from .lineage import materialised

#: Measures of two lines by the name of their column.
MEASURES = ("dtw_m", "frechet_m", "hausdorff_m")


def _order() -> WindowSpec:
    return Window.partitionBy("trajectory_id").orderBy("point_index")


def step_distances(points: DataFrame) -> DataFrame:
    """Points with step_m, the distance from the point before; 0 at the first."""
    lon, lat = F.lag("lon").over(_order()), F.lag("lat").over(_order())
    return points.withColumn("step_m", F.coalesce(g.haversine(lon, lat, F.col("lon"), F.col("lat")), F.lit(0.0)))


def headings(points: DataFrame) -> DataFrame:
    """``step_distances`` with heading, the bearing to the next point; at the last one that of the step before, of a single point null."""
    back = g.bearing(F.lag("lon").over(_order()), F.lag("lat").over(_order()), F.col("lon"), F.col("lat"))
    ahead = g.bearing(F.col("lon"), F.col("lat"), F.lead("lon").over(_order()), F.lead("lat").over(_order()))
    return step_distances(points).withColumn("heading", F.coalesce(ahead, back))


def lengths(points: DataFrame) -> DataFrame:
    """(trajectory_id, point_count, length_m)."""
    return step_distances(points).groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("point_count"), F.sum("step_m").alias("length_m"))


def lines(points: DataFrame) -> DataFrame:
    """(trajectory_id, line): the points of each trajectory in order. A trajectory is one row; meant for bounded ones."""
    rows = points.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("point_index", "lon", "lat"))).alias("_p"))
    return rows.select("trajectory_id", F.transform("_p", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"))).alias("line"))


def outliers(points: DataFrame, threshold_m: float = 150.0) -> DataFrame:
    """(trajectory_id, point_index) of spikes: far from both neighbours, which are near each other; ends never are."""
    w = _order()
    a, b = (F.lag("lon").over(w), F.lag("lat").over(w)), (F.lead("lon").over(w), F.lead("lat").over(w))
    here = (F.col("lon"), F.col("lat"))
    rows = points.withColumns({"_in": g.haversine(*a, *here), "_out": g.haversine(*here, *b), "_by": g.haversine(*a, *b)})
    return rows.where((F.col("_in") > threshold_m) & (F.col("_out") > threshold_m) & (F.col("_by") < threshold_m)).select("trajectory_id", "point_index")


def deviations(points: DataFrame, references: DataFrame) -> DataFrame:
    """(trajectory_id, point_index, deviation_m): the distance of each point to its reference (trajectory_id, line)."""
    first = F.element_at("line", 1)
    alone = F.array(F.struct(first["lon"].alias("x1"), first["lat"].alias("y1"), first["lon"].alias("x2"), first["lat"].alias("y2")))
    single = F.size("line") == 1
    legs = references.select("trajectory_id", single.alias("_single"), F.explode_outer(F.when(single, alone).when(F.size("line") > 1, p.segments(F.col("line")))).alias("_s")).select("trajectory_id", "_single", "_s.*")
    rows = points.select("trajectory_id", "point_index", "lon", "lat", F.monotonically_increasing_id().alias("_n")).join(legs, "trajectory_id")
    place = F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1")
    away = F.when(F.col("_single"), g.haversine(*place)).otherwise(g.segment_projection(*place, F.col("x2"), F.col("y2"))["distance"])
    return rows.groupBy("trajectory_id", "_n", "point_index").agg(F.min(away).alias("deviation_m")).drop("_n")


def deviation_stats(points: DataFrame, references: DataFrame, threshold_m: float = 30.0) -> DataFrame:
    """(trajectory_id, max_m, mean_m, exceeds_threshold): the indices beyond the threshold, in order."""
    far = F.array_sort(F.collect_list(F.when(F.col("deviation_m") > threshold_m, F.col("point_index"))))
    return deviations(points, references).groupBy("trajectory_id").agg(F.max("deviation_m").alias("max_m"), F.avg("deviation_m").alias("mean_m"), far.alias("exceeds_threshold"))


def hausdorff(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, hausdorff_m) of the vertices of trajectories named by ``pairs`` (a, b); 0 if one has no points."""
    return _measured(left, right, pairs, {"hausdorff_m": hausdorff_distance})


# The dynamic programs below work on one pair or trajectory in numpy.


def distance_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distances between rows (lon, lat)."""
    x, y = np.radians(a), np.radians(b)
    h = np.sin((y[None, :, 1] - x[:, None, 1]) / 2) ** 2 + np.cos(x[:, 1])[:, None] * np.cos(y[:, 1])[None, :] * np.sin((y[None, :, 0] - x[:, None, 0]) / 2) ** 2
    return 2 * g.RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def hausdorff_distance(a: np.ndarray, b: np.ndarray, block: int = 1024) -> float:
    """The farthest that any vertex of either line is from the other line's nearest vertex; of nothing 0. Distances are held a block at a time."""
    if not len(a) or not len(b):
        return 0.0
    there, back = 0.0, np.full(len(b), np.inf)
    for i in range(0, len(a), block):
        d = distance_matrix(a[i : i + block], b)
        there = max(there, float(d.min(axis=1).max()))
        back = np.minimum(back, d.min(axis=0))
    return max(there, float(back.max()))


def _diagonals(a: np.ndarray, b: np.ndarray, step) -> float:
    """The last value of a dynamic program over all pairs of vertices, ``step(distance, best of the three before)``, a diagonal at a time.

    Only two diagonals are held; a cell's three predecessors lie on the two before it.
    """
    n, m = len(a), len(b)
    x, y = np.radians(a), np.radians(b)
    old, now = np.full(n, np.inf), np.full(n, np.inf)  # by place on a
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        p, q = x[i], y[k - i]
        h = np.sin((q[:, 1] - p[:, 1]) / 2) ** 2 + np.cos(p[:, 1]) * np.cos(q[:, 1]) * np.sin((q[:, 0] - p[:, 0]) / 2) ** 2
        d = 2 * g.RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
        left, up = now[i], np.where(i > 0, now[i - 1], np.inf)  # (i, j - 1) and (i - 1, j)
        across = np.where(i > 0, old[i - 1], np.inf)
        best = np.minimum(np.minimum(left, up), across)
        new = np.full(n, np.inf)
        new[i] = step(d, best) if k else d
        old, now = now, new
    return float(now[n - 1])


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping: the least sum of distances of an alignment, neither normalised nor banded; of nothing 0."""
    return _diagonals(a, b, np.add) if len(a) and len(b) else 0.0


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete Frechet distance: the least longest leash of a walk along both; of nothing 0."""
    return _diagonals(a, b, np.maximum) if len(a) and len(b) else 0.0


#: Decimal places to which distances from a chord are equal.
TIE_DIGITS = 9
#: Vertices of a stretch up to which plain numbers are faster than arrays.
SHORT = 32


def _feet(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Distances of points to a segment, on the plane at each point."""
    cos = np.cos(np.radians(points[:, 1]))
    ax, ay = np.radians(start[0] - points[:, 0]) * g.RADIUS_M * cos, np.radians(start[1] - points[:, 1]) * g.RADIUS_M
    dx, dy = np.radians(end[0] - start[0]) * g.RADIUS_M * cos, np.radians(end[1] - start[1]) * g.RADIUS_M
    size = dx * dx + dy * dy
    t = np.where(size <= 1e-18, 0.0, np.clip(-(ax * dx + ay * dy) / np.where(size <= 1e-18, 1.0, size), 0.0, 1.0))
    x, y = ax + t * dx, ay + t * dy
    return np.sqrt(x * x + y * y)


def _farthest(lon: list[float], lat: list[float], cos: list[float], a: int, b: int) -> tuple[float, int]:
    """The greatest of ``_feet`` between vertices a and b, and the first vertex that is as far to TIE_DIGITS places; faster on a few vertices."""
    rad, size = math.radians, g.RADIUS_M
    x1, y1, wide, dy = lon[a], lat[a], rad(lon[b] - lon[a]) * size, rad(lat[b] - lat[a]) * size
    most, best, far = -1.0, -1, a + 1
    for i in range(a + 1, b):
        ax, ay, dx = rad(x1 - lon[i]) * size * cos[i], rad(y1 - lat[i]) * size, wide * cos[i]
        length = dx * dx + dy * dy
        t = 0.0 if length <= 1e-18 else min(1.0, max(0.0, -(ax * dx + ay * dy) / length))
        x, y = ax + t * dx, ay + t * dy
        d = math.sqrt(x * x + y * y)
        most = max(most, d)
        if (place := round(d * 10**TIE_DIGITS)) > best:
            best, far = place, i
    return most, far


def simplify(line: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Which vertices Ramer-Douglas-Peucker keeps: the ends, and between two kept ones the farthest from their chord if beyond the tolerance.

    Of vertices equally far, to TIE_DIGITS places, the first counts as the farthest.
    """
    keep = np.zeros(len(line), bool)
    if not len(line):
        return keep
    keep[[0, -1]] = True
    lon, lat, cos = line[:, 0].tolist(), line[:, 1].tolist(), np.cos(np.radians(line[:, 1])).tolist()
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        if b - a <= SHORT:
            most, far = _farthest(lon, lat, cos, a, b)
        else:
            d = _feet(line[a + 1 : b], line[a], line[b])
            most, far = d.max(), a + 1 + int(np.argmax(np.round(d, TIE_DIGITS)))
        if most > tolerance_m:
            keep[far] = True
            stack += [(a, far), (far, b)]
    return keep


def simplified(points: DataFrame, tolerance_m: float = 5.0) -> DataFrame:
    """The points of each trajectory that ``simplify`` keeps; a trajectory is one task's group."""
    rows = points.select("trajectory_id", "point_index", "lon", "lat")

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point_index")
        return group[simplify(group[["lon", "lat"]].to_numpy(), tolerance_m)]

    return rows.groupBy("trajectory_id").applyInPandas(cut, rows.schema)


def _measured(left: DataFrame, right: DataFrame, pairs: DataFrame, measures: dict) -> DataFrame:
    """``pairs`` (a, b) with measures of the two lines, computed in numpy; a pair is one row with both lines."""
    x_lines = lines(left).select(F.col("trajectory_id").alias("a"), F.col("line").alias("x"))
    y_lines = lines(right).select(F.col("trajectory_id").alias("b"), F.col("line").alias("y"))
    rows = pairs.select("a", "b").join(x_lines, "a", "left").join(y_lines, "b", "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def coordinates(column: pa.Array) -> list[np.ndarray]:
        flat = column.flatten()  # of null and empty lists nothing
        xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat")], axis=1) if len(flat) else np.zeros((0, 2))
        sizes = [0 if n is None else n for n in pc.list_value_length(column).to_pylist()]
        return np.split(xy, np.cumsum(sizes)[:-1]) if sizes else []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (coordinates(batch.column(batch.schema.get_field_index(c))) for c in "xy")
            found = [pa.array([f(u, v) for u, v in zip(x, y, strict=True)], pa.float64()) for f in measures.values()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in "ab"], *found], names=["a", "b", *measures])

    return rows.mapInArrow(measure, f"a {kinds['a']}, b {kinds['b']}" + "".join(f", {n} double" for n in measures))


def similarity(points: DataFrame, pairs: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(a, b, dtw_m, frechet_m) for ``pairs`` (a, b) of trajectories; b from ``reference`` where given."""
    return _measured(points, points if reference is None else reference, pairs, {"dtw_m": dtw, "frechet_m": frechet})


def analyse(points: DataFrame, reference: DataFrame | None = None, *, simplify_tolerance_m: float = 5.0, deviation_threshold_m: float = 30.0, measured: tuple[str, ...] = MEASURES) -> DataFrame:
    """One row for each trajectory: counts, length, outliers, deviation and distances from a reference, simplified line.

    ``reference`` (trajectory_id, point_index, lon, lat) defaults, for each trajectory that
    it does not name, to the simplified trajectory itself. ``measured`` names the distances
    of whole lines that are wanted; they take time that grows with the square of a line.
    """
    points = points.select("trajectory_id", "point_index", "lon", "lat")
    short = materialised(simplified(points, simplify_tolerance_m))  # read up to four times
    other = short
    if reference is not None:
        reference = reference.select(*short.columns)
        other = reference.unionByName(short.join(reference.select("trajectory_id").distinct(), "trajectory_id", "left_anti"))
    far = F.array_sort(F.collect_list("point_index")).alias("outlier_indices")
    spikes = outliers(points).groupBy("trajectory_id").agg(far)
    kept = short.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("simplified_point_count"))
    away = deviation_stats(points, lines(other), deviation_threshold_m)
    drawn = lines(short).withColumnRenamed("line", "simplified")
    rows = lengths(points)
    parts = [kept, spikes, away, drawn]
    if measured:
        of = {"dtw_m": dtw, "frechet_m": frechet, "hausdorff_m": hausdorff_distance}
        same = points.select(F.col("trajectory_id").alias("a"), F.col("trajectory_id").alias("b")).distinct()
        near = _measured(points, other, same, {name: of[name] for name in measured}).drop("b").withColumnRenamed("a", "trajectory_id")
        parts.insert(3, near)
    for part in parts:
        rows = rows.join(part, "trajectory_id", "left")
    return rows.withColumn("outlier_indices", F.coalesce("outlier_indices", F.array().cast("array<int>")))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, closed, counter-clockwise from the smallest point; points on its edges are left out."""
    points = np.unique(points, axis=0)
    if len(points) <= 1:
        return points

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 1e-12:
                out.pop()
            out.append(r)
        return out

    below, above = half(points), half(points[::-1])
    ring = [*below[:-1], *above[:-1]]
    return np.array([*ring, ring[0]])


def convex_hulls(points: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """(key, vertex, lon, lat) of the hull of each key's points: hulls of ``parts`` shares first, then the hull of their corners."""
    kind = points.schema[key].dataType.simpleString()

    def corners(group: pd.DataFrame) -> pd.DataFrame:
        ring = hull(group[["lon", "lat"]].to_numpy())
        return pd.DataFrame({key: group[key].iloc[0], "vertex": np.arange(len(ring)), "lon": ring[:, 0], "lat": ring[:, 1]})

    schema = f"{key} {kind}, vertex long, lon double, lat double"
    rows = points.where("lon is not null and lat is not null").select(key, "lon", "lat", F.pmod(F.xxhash64("lon", "lat"), F.lit(parts)).alias("_part"))
    return rows.groupBy(key, "_part").applyInPandas(lambda part: corners(part.drop(columns="_part")), schema).groupBy(key).applyInPandas(corners, schema)
