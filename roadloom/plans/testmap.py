"""A road map, traces, fences and places derived from the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions.types import LINE, RINGS
from ..operators.lineage import materialised, shared_folder
from ..operators.spatial import with_bbox

COLUMNS = 25


def num(x: float) -> str:
    """A number as a double in either dialect."""
    return f"CAST('{x}' AS DOUBLE)"


def ctes(div: str = "//", table=lambda name: name) -> str:
    """nodes, road_rows, segments, roads, points, fences, pois as common table expressions."""
    return f"""
nodes AS (
  SELECT CAST(s_suppkey AS BIGINT) AS k, concat('n_', CAST(s_suppkey AS VARCHAR(20))) AS id, s_suppkey % {COLUMNS} AS c, s_suppkey {div} {COLUMNS} AS r,
         {num(116)} + (s_suppkey % {COLUMNS}) * {num(0.01)} AS lon, {num(39)} + (s_suppkey {div} {COLUMNS}) * {num(0.01)} AS lat
  FROM {table("supplier")}),
road_rows AS (
  SELECT 'h' AS kind, 0 AS n, a.k, a.id AS from_node, b.id AS to_node, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM nodes a JOIN nodes b ON b.k = a.k + 1 WHERE a.c < {COLUMNS - 1}
  UNION ALL SELECT 'v', 1, a.k, a.id, b.id, a.lon, a.lat, b.lon, b.lat FROM nodes a JOIN nodes b ON b.k = a.k + {COLUMNS}
  UNION ALL SELECT 'd', 2, a.k, a.id, b.id, a.lon, a.lat, b.lon, b.lat FROM nodes a JOIN nodes b ON b.k = a.k + {COLUMNS + 1} WHERE a.c < {COLUMNS - 1} AND a.k % 7 = 0
  UNION ALL SELECT 'x', 3, a.k, a.id, b.id, a.lon, a.lat, b.lon, b.lat FROM nodes a JOIN nodes b ON b.k = a.k + {COLUMNS - 1} WHERE a.c > 0 AND a.k % 7 = 1
  UNION ALL SELECT 'p', 4, a.k, b.id, a.id, b.lon, b.lat, a.lon, a.lat FROM nodes a JOIN nodes b ON b.k = a.k + 1 WHERE a.c < {COLUMNS - 1} AND a.k % 11 = 0),
roads AS (
  SELECT concat(kind, '_', CAST(k AS VARCHAR(20))) AS id, from_node, to_node, x1, y1, x2, y2,
         CASE WHEN kind = 'h' AND k % 3 = 0 THEN (x1 + x2) / 2 END AS xm, CASE WHEN kind = 'h' AND k % 3 = 0 THEN y1 + {num(0.0012)} END AS ym,
         CASE (k + n) % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'residential' ELSE 'service' END AS road_class,
         CASE (k + n) % 4 WHEN 0 THEN {num(50)} WHEN 1 THEN {num(45)} WHEN 2 THEN {num(35)} ELSE {num(25)} END AS speed_limit,
         kind = 'v' AND k % 5 = 0 AS oneway, CAST(n * 10000000 + k AS BIGINT) AS pos
  FROM road_rows),
segments AS (
  SELECT id, CAST(0 AS BIGINT) AS seg, x1, y1, coalesce(xm, x2) AS x2, coalesce(ym, y2) AS y2, pos, from_node, to_node FROM roads
  UNION ALL SELECT id, CAST(1 AS BIGINT), xm, ym, x2, y2, pos, from_node, to_node FROM roads WHERE xm IS NOT NULL),
points AS (
  SELECT trajectory_id, point_index, event_id, {num(116)} + (trajectory_id % 5) * {num(0.04)} + point_index * {num(0.0011)} AS lon,
         {num(39)} + (trajectory_id % 4) * {num(0.01)} + ((event_id * 7919) % 2000 - 1000) * {num(0.000001)} + CASE WHEN event_id % 97 = 0 THEN {num(0.006)} ELSE {num(0)} END AS lat
  FROM (SELECT CAST(user_id AS BIGINT) AS trajectory_id, CAST(event_id AS BIGINT) AS event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS point_index FROM {table("events")}) e),
fences AS (
  SELECT concat('f_', CAST(n_nationkey AS VARCHAR(20))) AS id, n_name AS name, n_nationkey AS k, n_nationkey % 2 = 0 AS box, n_nationkey % 3 = 0 AS hole,
         {num(116.02)} + (n_nationkey % 5) * {num(0.05)} AS cx, {num(39.0041)} + (n_nationkey {div} 5) * {num(0.008)} AS cy, {num(0.01310037)} AS w, {num(0.00330037)} AS h
  FROM {table("nation")}),
pois AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, {num(116)} + ((c_custkey * 37) % 2500) * {num(0.0001)} AS lon, {num(39)} + ((c_custkey * 91) % 400) * {num(0.0001)} AS lat
  FROM {table("customer")})"""


class TestMap:
    """The derived layers as stored tables in the shapes that the operators take, written once for an application and scale."""

    __test__ = False
    _stored: dict[tuple[str, str], str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in self._stored:
            folder = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
            for name in ("nodes", "roads", "points", "fences", "pois"):
                getattr(self, f"_{name}")().write.parquet(f"{folder}/{name}")
            self._stored[key] = folder
        self._folder = self._stored[key]

    def _sql(self, tail: str) -> DataFrame:
        return self.spark.sql(f"WITH {ctes('div', lambda name: f'parquet.`{self.sf_dir}/{name}.parquet`')} {tail}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _layer(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}")

    nodes, roads, points, fences, pois = (property(lambda self, name=name: self._layer(name)) for name in ("nodes", "roads", "points", "fences", "pois"))

    def _nodes(self) -> DataFrame:
        return self._sql("SELECT id, lon, lat, k AS pos FROM nodes")

    def _roads(self) -> DataFrame:
        end = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
        line = F.when(F.col("xm").isNull(), F.array(end("x1", "y1"), end("x2", "y2"))).otherwise(F.array(end("x1", "y1"), end("xm", "ym"), end("x2", "y2"))).cast(LINE)
        rows = materialised(self._sql("SELECT * FROM roads").withColumn("geometry", line))
        rows = rows.select(
            "id", "from_node", "to_node", "geometry", g.polyline_length(F.col("geometry")).alias("length"), "speed_limit", F.col("road_class").alias("road_type"), "oneway", F.when(F.col("oneway"), "forward").otherwise("both").alias("direction"),
            "road_class", F.lit(1).alias("lane_count"), F.array().cast("array<map<string,string>>").alias("turn_restrictions"), F.create_map().cast("map<string,string>").alias("metadata"), "pos",
        )
        return with_bbox(rows)

    def _points(self) -> DataFrame:
        return self._sql("SELECT trajectory_id, point_index, lon, lat FROM points")

    def _fences(self) -> DataFrame:
        at = lambda i, j, s: F.struct((F.col("cx") + i * s * F.col("w")).alias("lon"), (F.col("cy") + j * s * F.col("h")).alias("lat"))

        def ring(s: float):
            box = F.array(at(-1, -1, s), at(1, -1, s), at(1, 1, s), at(-1, 1, s), at(-1, -1, s))
            diamond = F.array(at(-1, 0, s), at(0, -1, s), at(1, 0, s), at(0, 1, s), at(-1, 0, s))
            return F.when(F.col("box"), box).otherwise(diamond)

        rings = F.when(F.col("hole"), F.array(ring(1.0), ring(0.25))).otherwise(F.array(ring(1.0))).cast(RINGS)
        return self._sql("SELECT * FROM fences").select("id", "name", rings.alias("rings"), F.col("k").cast("long").alias("pos"))

    def _pois(self) -> DataFrame:
        return self._sql("SELECT id, name, lon, lat FROM pois")
