"""The engine as one object: load a map, ask it, repair it, export it. Every answer is a DataFrame."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geodesy as g
from .functions.types import GEOFENCES, TRAJECTORY_POINTS
from .operators import graph, lineage, matching, measures, spatial, topology, trajectory
from .plans import benchmarks, sample
from .sources import geojson, osm
from .sources.store import MapStore

Coordinate = tuple[float, float]


class NotFound(LookupError):
    """What was asked for is not in the map, or has no route."""


#: The experiments that a viewer offers and the layers that each shows.
EXPERIMENTS = (
    ("topology_repair", "Dirty Road Repair", ("roads", "fixed_roads", "illegal_crossings", "dangling_edges")),
    ("spatial_index", "Spatial Index Benchmark", ("query_bbox", "candidate_roads")),
    ("map_matching", "HMM Candidate/Viterbi", ("trajectories", "candidate_points", "matched_path")),
    ("trajectory_analysis", "Trajectory Error Heatmap", ("trajectories", "deviation_points")),
)


class MapEngine:
    """Queries over one stored map. ``root`` is a folder that all executors share; without roads in it the sample map is loaded, unless ``empty``."""

    def __init__(self, spark: SparkSession, root: str, empty: bool = False):
        self.spark, self.store = spark, MapStore(spark, root)
        if not empty and not self.store.has_roads():
            self.load_sample()

    # Data ----------------------------------------------------------------------------------

    @property
    def nodes(self) -> DataFrame:
        return self.store.layer("road_nodes")

    @property
    def roads(self) -> DataFrame:
        return self.store.layer("road_edges")

    @property
    def points(self) -> DataFrame:
        return self.store.layer("trajectory_points")

    @property
    def fences(self) -> DataFrame:
        return self.store.layer("geofences")

    @property
    def pois(self) -> DataFrame:
        return self.store.layer("pois")

    def _replace(self, roads: DataFrame, trajectories: DataFrame | None = None, fences: DataFrame | None = None, pois: DataFrame | None = None) -> DataFrame:
        nodes, edges = geojson.roads(roads)
        self.store.replace(
            road_nodes=nodes, road_edges=edges, trajectory_points=None if trajectories is None else geojson.trajectories(trajectories),
            geofences=None if fences is None else geojson.geofences(fences), pois=None if pois is None else geojson.pois(pois),
        )
        return self.current()

    def load(self, source: str = "sample", **what) -> DataFrame:
        """Replaces the map from a source by name: sample, geojson (paths, or texts as *_text), osm_file (path), osm_online (box or place)."""
        if source == "sample":
            return self.load_sample()
        if source == "geojson" and what.get("roads_text") is not None:
            return self.load_payloads(**{k.removesuffix("_text"): v for k, v in what.items() if k.endswith("_text")})
        if source == "geojson" and what.get("roads"):
            return self.load_geojson(**what)
        if source == "osm_file" and what.get("path"):
            return self.load_osm(what["path"])
        if source == "osm_online":
            return self.load_osm_online(**what)
        raise ValueError(f"unknown source, or nothing to load from it: {source}")

    def load_sample(self) -> DataFrame:
        """Replaces the map by the sample map."""
        return self.load_payloads(**sample.layers())

    def load_geojson(self, roads: str | None = None, trajectories: str | None = None, fences: str | None = None, pois: str | None = None) -> DataFrame:
        """Replaces the map by GeoJSON files; a layer without a file is the sample map's."""
        texts, paths = sample.layers(), {"roads": roads, "trajectories": trajectories, "fences": fences, "pois": pois}
        return self._replace(*[geojson.read_features(self.spark, path) if path else geojson.payload_features(self.spark, texts[name]) for name, path in paths.items()])

    def load_payloads(self, roads: str, trajectories: str | None = None, fences: str | None = None, pois: str | None = None) -> DataFrame:
        """As ``load_geojson`` with JSON texts; layers without one become empty."""
        read = lambda text: None if text is None else geojson.payload_features(self.spark, text)
        return self._replace(read(roads), read(trajectories), read(fences), read(pois))

    def load_osm(self, path: str) -> DataFrame:
        """Replaces the road network by an OSM file and keeps the other layers."""
        return self._network(*osm.read_file(self.spark, path))

    def load_osm_online(self, box: tuple[float, float, float, float] | None = None, place: str | None = None, fetch: osm.Fetch = osm.http_fetch) -> DataFrame:
        if box is None and place is None:
            raise ValueError("a box or a place is needed")
        return self._network(*(osm.download_bbox(self.spark, box, fetch) if box else osm.download_place(self.spark, place, fetch)))

    def _network(self, nodes: DataFrame, roads: DataFrame) -> DataFrame:
        self.store.replace(road_nodes=nodes, road_edges=roads)
        return self.current()

    def reset(self) -> DataFrame:
        """Back to the sample map."""
        return self.load_sample()

    def clear(self) -> None:
        """Empties all layers."""
        self.store.clear()

    def tidy(self, *needed: DataFrame) -> int:
        """Deletes what queries have left in the shared folder, but for what ``needed`` still reads."""
        return lineage.release(self.spark, *needed)

    def health(self) -> DataFrame:
        """One row: status ok and the numbers of ``current``."""
        return self.current().select(F.lit("ok").alias("status"), "nodes", "roads", "trajectories", "geofences", "pois")

    def current(self) -> DataFrame:
        """One row: rows of each layer and the box of the roads, null without roads."""
        n = lambda df, name, key="id": df.agg(F.count_distinct(key).alias(name))
        out = n(self.nodes, "nodes").crossJoin(n(self.roads, "roads")).crossJoin(n(self.points, "trajectories", "trajectory_id")).crossJoin(n(self.fences, "geofences")).crossJoin(n(self.pois, "pois"))
        return out.crossJoin(spatial.bounds(self.roads))  # one row each

    def stats(self) -> DataFrame:
        """``current`` with the number of directed arcs and the total length."""
        arcs = graph.arcs(self.roads).agg(F.count(F.lit(1)).alias("arcs"))
        return self.current().crossJoin(arcs).crossJoin(self.roads.agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("length_m")))

    def trajectory(self, trajectory_id: str | None = None) -> DataFrame:
        """The points of a trajectory, or of the one with the smallest id."""
        if trajectory_id is None:
            first = self.points.agg(F.min("trajectory_id")).first()[0]
            trajectory_id = first
        rows = self.points.where(F.col("trajectory_id") == F.lit(trajectory_id))
        if trajectory_id is None or rows.isEmpty():
            raise NotFound("no such trajectory")
        return rows

    def trace(self, coordinates: list[Coordinate], trajectory_id: str = "request_trajectory", timestamps: list[str] | None = None) -> DataFrame:
        """The points of a request; timestamps go by place, as far as there are any."""
        stamps = [None if t is None else str(t) for t in timestamps or []]
        rows = [(trajectory_id, i, float(c[0]), float(c[1]), stamps[i] if i < len(stamps) else None) for i, c in enumerate(coordinates)]
        return self.spark.createDataFrame(rows, TRAJECTORY_POINTS)

    def fence_rows(self, payload: list[dict]) -> DataFrame:
        """Fences from request objects with id, name and coordinates, or a geometry that has them."""
        rows = []
        for n, item in enumerate(payload):
            rings = item.get("coordinates") or (item.get("geometry") or {}).get("coordinates") or []
            fence_id = str(item.get("id") or f"request_fence_{n}")
            rows.append((fence_id, str(item.get("name") or fence_id), [[(float(c[0]), float(c[1])) for c in ring] for ring in rings], n))
        return self.spark.createDataFrame(rows, GEOFENCES)

    # Queries -------------------------------------------------------------------------------

    def nearby(self, lon: float, lat: float, k: int = 5) -> DataFrame:
        """The ``k`` roads nearest to a place, nearest first."""
        spot = self.spark.createDataFrame([(0, float(lon), float(lat))], "place int, lon double, lat double")
        return spatial.nearby_roads(spot, self.roads, ["place"], k).orderBy("cand_rank")

    def roads_in_bbox(self, box: spatial.Box) -> DataFrame:
        return spatial.roads_in_bbox(self.roads, box).orderBy("pos")

    def roads_in_polygon(self, rings: list) -> DataFrame:
        ids = spatial.roads_in_polygons(self.roads, spatial.polygon_rows(self.spark, rings)).select(F.col("road_id").alias("id"))
        return self.roads.join(ids, "id", "left_semi").orderBy("pos")

    def points_in_polygon(self, rings: list, target: str = "trajectory_points") -> DataFrame:
        """Trajectory points (named trajectory_index) or places inside a polygon or on its edge."""
        if target == "pois":
            return spatial.points_in_polygons(self.pois, spatial.polygon_rows(self.spark, rings)).drop("fence_id")
        if target != "trajectory_points":
            raise ValueError(f"unknown target: {target}")
        named = self.points.withColumn("id", F.concat("trajectory_id", F.lit("_"), F.col("point_index").cast("string")))
        return spatial.points_in_polygons(named, spatial.polygon_rows(self.spark, rings)).drop("fence_id")

    def geofence_check(self, points: DataFrame | None = None, fences: DataFrame | None = None) -> DataFrame:
        """Enter and exit events of each fence."""
        return spatial.fence_events(self.points if points is None else points, self.fences if fences is None else fences)

    def match(self, points: DataFrame, algorithm: str = "hmm", k: int = 5, sigma: float = 20.0, beta: float = 50.0) -> DataFrame:
        if algorithm == "nearest":
            return matching.match_nearest(points, self.roads, k)
        if algorithm == "candidate_cost":
            return matching.match_candidate_cost(points, self.roads, k)
        if algorithm == "hmm":
            return matching.match_hmm(points, self.roads, k, sigma, beta)
        raise ValueError(f"unknown algorithm: {algorithm}")

    def _stops(self, stops: list[Coordinate]) -> list[str]:
        rows = [(i, float(c[0]), float(c[1])) for i, c in enumerate(stops)]
        found = spatial.nearest_node(self.spark.createDataFrame(rows, "stop int, lon double, lat double"), self.nodes, ["stop"]).collect()  # as many as were asked for
        if len(found) < len(stops):
            raise NotFound("no routable network")
        return [r["node_id"] for r in sorted(found, key=lambda r: r["stop"])]

    def _arcs(self, avoid: list | None) -> DataFrame:
        arcs = graph.arcs(self.roads)
        for rings in avoid or []:
            arcs = graph.without(arcs, spatial.blocked_edges(self.roads, spatial.polygon_rows(self.spark, rings)))
        return arcs

    def route(self, start: Coordinate, end: Coordinate, waypoints: list[Coordinate] | None = None, mode: str = "shortest_distance", avoid: list | None = None, algorithm: str = "astar") -> DataFrame:
        """One row: the shortest way through all stops in their order, around the polygons ``avoid``.

        ``algorithm`` is dijkstra or astar; both find the least cost (see ``graph.shortest_paths``).
        """
        nodes = self._stops([start, *(waypoints or []), end])
        legs = self.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False))], "leg int, source string, target string")
        found = graph.routes(self._arcs(avoid), legs.select("source", "target"), mode, algorithm)
        merged = graph.merged_legs(legs.join(found, ["source", "target"]).withColumn("route_id", F.lit("route_001")), "route_id")
        if not merged.first()["found"]:
            raise NotFound("no route")
        return merged

    def explain_route(self, start: Coordinate, end: Coordinate, mode: str = "shortest_distance", preferred: list[str] | None = None, avoid: list | None = None, turn_penalty_s: float = 8.0) -> DataFrame:
        a, b = self._stops([start, end])
        pair = self.spark.createDataFrame([(a, b)], "source string, target string")
        return graph.explained_routes(self._arcs(avoid), pair, mode, preferred=preferred, turn_penalty_s=turn_penalty_s)

    def validate(self) -> DataFrame:
        return topology.validate(self.nodes, self.roads)

    def repair(self, tolerance_m: float = 1.0, apply: bool = False) -> DataFrame:
        """Counts of what a repair does; with ``apply`` the network is replaced by the repaired one."""
        nodes, roads, operations = topology.repair(self.nodes, self.roads.drop(*spatial.BOX), tolerance_m)
        if apply:
            self.store.replace(road_nodes=nodes, road_edges=roads)
        return operations

    def analyse(self, points: DataFrame, reference: DataFrame | None = None, simplify_tolerance_m: float = 5.0, deviation_threshold_m: float = 30.0) -> DataFrame:
        return trajectory.analyse(points, reference, simplify_tolerance_m=simplify_tolerance_m, deviation_threshold_m=deviation_threshold_m)

    # Export and measures -------------------------------------------------------------------

    def layers(self) -> dict[str, DataFrame]:
        """Each layer as one GeoJSON text (column value)."""
        parts = {"roads": geojson.road_features(self.roads), "trajectories": geojson.trajectory_features(self.points), "geofences": geojson.geofence_features(self.fences), "pois": geojson.poi_features(self.pois)}
        return {name: geojson.feature_collection(rows) for name, rows in parts.items()}

    def export(self) -> DataFrame:
        """One row: exported_at, a text for each layer, and the bounds."""
        out = self.spark.createDataFrame([(datetime.now(UTC).isoformat(),)], "exported_at string")
        for name, rows in self.layers().items():
            out = out.crossJoin(rows.withColumnRenamed("value", name))  # one row each
        return out.crossJoin(spatial.bounds(self.roads))

    def write_layers(self, path: str) -> None:
        """Each layer as files with one GeoJSON feature in a line, below ``path``; for maps of any size."""
        parts = {"roads": geojson.road_features(self.roads), "trajectories": geojson.trajectory_features(self.points), "geofences": geojson.geofence_features(self.fences), "pois": geojson.poi_features(self.pois)}
        for name, rows in parts.items():
            geojson.write_features(rows, f"{path}/{name}")

    def experiments(self) -> DataFrame:
        """(id, name, layers) of the experiments that a viewer offers; the base layers are those of ``layers``."""
        return self.spark.createDataFrame([(i, n, list(layers)) for i, n, layers in EXPERIMENTS], "id string, name string, layers array<string>")

    def benchmark_index(self, box: spatial.Box | None = None, iterations: int = 20) -> DataFrame:
        """Five layouts of the roads, built and asked for one box (that of all roads by default); see ``benchmarks.index_benchmark``."""
        return benchmarks.index_benchmark(self.roads, [box or tuple(spatial.bounds(self.roads).first())], iterations)

    def benchmark_boxes(self, windows: int = 20, seed: int = 7) -> DataFrame:
        """The same layouts asked for random windows."""
        return benchmarks.city_benchmark(self.roads, windows, seed)

    def benchmark_matching(self, route: list[str] | None = None, k: int = 5) -> DataFrame:
        """Precision and recall of both matchers on synthetic traces along ``route`` (road ids), or the first three roads."""
        ids = route or [r["id"] for r in self.roads.orderBy("pos").limit(3).select("id").collect()]
        legs = self.roads.where(F.col("id").isin(ids)).select(F.lit("route").alias("trajectory_id"), F.array_position(F.array(*map(F.lit, ids)), F.col("id")).alias("leg"), F.col("id").alias("road_id"), "geometry")
        return benchmarks.matching_benchmark(legs, self.roads, k)


#: Scalar SQL functions over coordinates, for sessions that want them by name.
SQL_FUNCTIONS = {
    "geo_distance": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        f"2 * {g.RADIUS_M}D * asin(sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))",
    ),
    "geo_bearing": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360D, 360D)",
    ),
    "geo_angle_difference": ("a DOUBLE, b DOUBLE", "abs(pmod(a - b + 180D, 360D) - 180D)"),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (arguments, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
