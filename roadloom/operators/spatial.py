"""Spatial queries: boxes, cell joins, nearest neighbours, polygons, fence events.

Range conditions become equi-joins on grid cells with the exact predicate behind them, so
no plan compares all rows with all rows. Tables may carry other columns; those named here
are used. Rows with a null coordinate or geometry match nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geodesy as g
from ..functions import planar as p
from .lineage import materialised, numbered

Box = tuple[float, float, float, float]
BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
#: Degrees of a grid cell.
CELL = 0.01
#: Segments that a crowded cell of the first ring should hold.
CROWD = 64
#: How many times wider than the first ring's cells the widest ring may be; segments of a part that points beyond it meet.
FAR, FAR_PARTS = 4096, 50_000
#: Points, and segments with their copies, that a group of the nearest-road search has, about; pairs of both that it looks at at once.
SHARE, GROUP_PARTS, PAIRS = 50_000, 500_000, 500_000
#: A degree.
RADIAN = math.pi / 180.0


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def with_bbox(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """``df`` with the four flat box columns that Parquet statistics and filters use."""
    return df.withColumns(dict(zip(BOX, p.line_bbox(F.col(geometry)), strict=True)))


def _box(df: DataFrame | None = None, names: tuple[str, ...] = BOX) -> tuple[Column, ...]:
    return tuple(F.col(n) if df is None else df[n] for n in names)


def bounds(df: DataFrame) -> DataFrame:
    """One row: the box of all boxes of ``df``, or of its lon and lat; nulls if there is none."""
    if "lon" in df.columns:
        return df.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    return df.agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def roads_in_bbox(roads: DataFrame, box: Box) -> DataFrame:
    """Rows whose box meets ``box``; touching counts. The condition is on flat columns and reaches the scan."""
    return roads.where(p.bbox_intersects(_box(), tuple(F.lit(float(x)) for x in box)))


def cells(x: Column, y: Column, size: float | Column = CELL) -> tuple[Column, Column]:
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def covered(df: DataFrame, size: float = CELL, margin: float = 0.0) -> DataFrame:
    """``df`` once for each grid cell (cx, cy) that its box, widened by ``margin`` degrees, touches. For boxes of few cells; see ``placed``."""
    x1, y1 = cells(F.col("min_lon") - margin, F.col("min_lat") - margin, size)
    x2, y2 = cells(F.col("max_lon") + margin, F.col("max_lat") + margin, size)
    return df.where(F.col("min_lon").isNotNull()).withColumn("cx", F.explode(F.sequence(x1, x2))).withColumn("cy", F.explode(F.sequence(y1, y2)))


def cell_level(size: float = CELL) -> Column:
    """The grid on which a row's box touches three cells a side at most: 0 for cells of ``size``, each level four times wider."""
    wide = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"), F.lit(0.0))
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(wide / (2 * size), F.lit(1e-9))))).cast("int")


def placed(df: DataFrame, levels: list[int], size: float = CELL) -> DataFrame:
    """``df`` with _own, its ``cell_level``, once for each cell (level, cx, cy) that its box touches on its own and every coarser one of ``levels``.

    Whatever a box's extent is, that is a few cells a level, of which there are as many as
    the tables' boxes have, some ten between a house and a continent.
    """
    rows = df.where(F.col("min_lon").isNotNull()).withColumn("_own", cell_level(size))
    rows = rows.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("_own"))))
    width = F.lit(float(size)) * F.pow(F.lit(4.0), F.col("level"))
    x1, y1 = cells(F.col("min_lon"), F.col("min_lat"), width)
    x2, y2 = cells(F.col("max_lon"), F.col("max_lat"), width)
    return rows.withColumn("cx", F.explode(F.sequence(x1, x2))).withColumn("cy", F.explode(F.sequence(y1, y2)))


def _levels(*tables: DataFrame, size: float) -> list[int]:
    """The levels that the boxes of the tables have; a few numbers."""
    rows = tables[0].select(*BOX)
    for t in tables[1:]:
        rows = rows.unionByName(t.select(*BOX))
    return sorted(r["l"] for r in rows.where("min_lon is not null").select(cell_level(size).alias("l")).distinct().collect())


def bbox_join(left: DataFrame, right: DataFrame, size: float = CELL, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose boxes meet, and which agree in the columns ``by``, each once: columns l_* and r_*.

    Both sides go to the cells of a grid as coarse as the larger box of a pair needs (see
    ``placed``); of the cells that a pair shares there, only the one that holds the lower
    left corner of the common box reports it, so no distinct is needed.
    """
    levels = _levels(left, right, size=size) or [0]
    side = lambda df, s: placed(df, levels, size).select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns], F.col("_own").alias(f"_{s}"), "level", "cx", "cy", *[F.col(c).alias(f"_by_{c}") for c in by])
    keys = ["level", "cx", "cy", *[f"_by_{c}" for c in by]]
    la, ra = tuple(F.col(f"l_{n}") for n in BOX), tuple(F.col(f"r_{n}") for n in BOX)
    x, y = cells(F.greatest(la[0], ra[0]), F.greatest(la[1], ra[1]), F.lit(float(size)) * F.pow(F.lit(4.0), F.col("level")))
    met = side(left, "l").join(side(right, "r"), keys)
    return met.where(p.bbox_intersects(la, ra) & (F.col("level") == F.greatest("_l", "_r")) & (F.col("cx") == x) & (F.col("cy") == y)).drop(*keys, "_l", "_r")


def quadkey(lon: Column, lat: Column, depth: int = 12) -> Column:
    """The path of a point in a quadtree over the globe, a digit for each level."""
    x = F.floor((lon + 180.0) / 360.0 * (1 << depth)).cast("long")
    y = F.floor((lat + 90.0) / 180.0 * (1 << depth)).cast("long")
    bits = [(F.shiftright(x, k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, k).bitwiseAND(F.lit(1))).cast("string") for k in range(depth - 1, -1, -1)]
    return F.concat(*bits)


def under_quadkey(points: DataFrame, prefix: str, key: str = "quadkey") -> DataFrame:
    """The rows below a node of the quadtree: a range of the sorted key, so files written in its order are skipped by their statistics."""
    return points.where((F.col(key) >= prefix) & (F.col(key) < prefix + "4"))


def quadkeys_of_box(box: Box, depth: int = 12, most: int = 64) -> list[str]:
    """Prefixes of the quadtree nodes that cover ``box``, of ``depth`` digits or as few as keep them below ``most``."""
    for d in range(depth, 0, -1):
        n = 1 << d
        xs = range(max(0, math.floor((box[0] + 180) / 360 * n)), min(n - 1, math.floor((box[2] + 180) / 360 * n)) + 1)
        ys = range(max(0, math.floor((box[1] + 90) / 180 * n)), min(n - 1, math.floor((box[3] + 90) / 180 * n)) + 1)
        if len(xs) * len(ys) <= most:
            return sorted("".join(str((x >> k & 1) + 2 * (y >> k & 1)) for k in range(d - 1, -1, -1)) for x in xs for y in ys)
    return [""]


def points_in_bbox_by_quadkey(points: DataFrame, box: Box, key: str = "quadkey") -> DataFrame:
    """``points`` (lon, lat, and their ``quadkey``) inside a box: ranges of the key first, then the exact test."""
    found = F.lit(False)
    for prefix in quadkeys_of_box(box):
        found = found | ((F.col(key) >= prefix) & (F.col(key) < prefix + "4"))
    return points.where(found & p.bbox_contains_point(tuple(F.lit(float(x)) for x in box), F.col("lon"), F.col("lat")))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in a total order of all of them."""
    return numbered(rows.withColumns({f"_o{i}": F.col(c) for i, c in enumerate(order)}).drop("pos"), [f"_o{i}" for i in range(len(order))]).withColumnRenamed("pos", name)


def str_tiles(df: DataFrame, leaf: int = 8, key: str = "id") -> DataFrame:
    """``df`` with tile_x and tile_y, its leaf in a sort-tile-recursive layout.

    Rows are sorted by the middle of their boxes, west to east, and cut into
    ceil(sqrt(n / leaf)) slices of equal numbers; each slice is sorted south to north by
    itself and cut into leaves of ``leaf`` rows. Ties go by ``key``. Sorting is done in
    ranges, so no task sees all rows.
    """
    n = df.count()
    slices = max(1, math.ceil(math.sqrt(n / leaf)))
    each = max(1, math.ceil(n / slices))
    x, y = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    kept = [c for c in df.columns if c != "pos"]
    rows = df.withColumns({"_x": x, "_y": y, **({"_pos": F.col("pos")} if "pos" in df.columns else {})})
    rows = ranked(rows, ["_x", key], "_east").withColumn("tile_x", F.floor(F.col("_east") / each).cast("long"))
    rows = ranked(rows, ["tile_x", "_y", key], "_north")
    tile_y = F.floor((F.col("_north") - F.col("tile_x") * each) / leaf).cast("long")
    return rows.select(*kept, *([F.col("_pos").alias("pos")] if "pos" in df.columns else []), "tile_x", tile_y.alias("tile_y"))


def write_str(df: DataFrame, path: str, leaf: int = 4096, key: str = "id") -> None:
    """Writes rows with boxes in the order of ``str_tiles``, so that near rows share files and row groups and box filters skip the others."""
    tiles = str_tiles(df, leaf, key)
    tiles.repartitionByRange("tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y").write.mode("overwrite").parquet(path)


def tile_boxes(tiles: DataFrame) -> DataFrame:
    """(tile_x, tile_y, n, box) of the leaves of ``str_tiles``."""
    least, most = [F.min(c).alias(c) for c in BOX[:2]], [F.max(c).alias(c) for c in BOX[2:]]
    return tiles.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), *least, *most)


def _parts(roads: DataFrame, about: dict[str, Column]) -> DataFrame:
    """(road_id, segment_index, x1, y1, x2, y2, box, about): the segments of each road whose ends are known; a road of one vertex is a segment without length."""
    first = F.element_at("geometry", 1)
    alone = F.array(F.struct(first["lon"].alias("x1"), first["lat"].alias("y1"), first["lon"].alias("x2"), first["lat"].alias("y2")))
    cut = F.when(F.size("geometry") == 1, alone).otherwise(p.segments(F.col("geometry")))
    rows = roads.drop(*BOX, "segment_index", "x1", "y1", "x2", "y2").select("*", F.posexplode(cut).alias("segment_index", "s")).select("*", "s.*").where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    rows = rows.select("road_id", F.col("segment_index").cast("long").alias("segment_index"), "x1", "y1", "x2", "y2", *[c.alias(name) for name, c in about.items()])
    box = (F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"))
    return rows.withColumns(dict(zip(BOX, box, strict=True)))


def _met(points: pa.Table, parts: pa.Table, k: int, size: float | None, schema: pa.Schema) -> pa.Table:
    """``points`` with ``near``, the nearest ``k`` roads among the segments in each one's cell; empty where a segment elsewhere might be nearer.

    ``size`` is the width of the cells; segments of a cell are all that come within that
    width of it. Without ``size`` the list is never empty, it may be shorter than ``k``.
    The arithmetic is that of ``geodesy.segment_projection``, in its order of operations.
    Pairs of a point and a segment are looked at PAIRS at a time.
    """
    number = lambda t, c: t[c].to_numpy()
    ids = pc.unique(parts["road_id"])
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    road = rank[pc.index_in(parts["road_id"], value_set=ids).to_numpy()] if len(ids) else rank
    cx, cy = number(points, "cx"), number(points, "cy")
    px, py = number(parts, "cx"), number(parts, "cy")
    least = [min(a.min(initial=2**62), b.min(initial=2**62)) for a, b in ((cx, px), (cy, py))]
    rows = max(cy.max(initial=least[1]), py.max(initial=least[1])) - least[1] + 1
    cell, held = (cx - least[0]) * rows + cy - least[1], (px - least[0]) * rows + py - least[1]
    order = np.lexsort((number(parts, "segment_index"), road, held))
    held, road = held[order], road[order]
    x1, y1, x2, y2 = (number(parts, c)[order] for c in ("x1", "y1", "x2", "y2"))
    lon, lat, cos = (number(points, c) for c in ("lon", "lat", "_cos"))
    start = np.searchsorted(held, cell, "left")
    ends = np.cumsum(np.searchsorted(held, cell, "right") - start)
    safe = np.full(len(lon), np.inf)
    if size is not None:
        east = np.minimum(lon - (cx - 1) * size, (cx + 2) * size - lon) * np.abs(cos)
        north = np.minimum(lat - (cy - 1) * size, (cy + 2) * size - lat)
        safe = np.minimum(east, north) * RADIAN * g.RADIUS_M * 0.999 - 0.001
    found = []
    first = 0
    while first < len(lon):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = np.diff(ends[first:last], prepend=before)
        i = np.repeat(np.arange(first, last), n)
        j = np.arange(len(i)) - np.repeat(ends[first:last] - n - before - start[first:last], n)
        first = last
        plon, plat, pcos = lon[i], lat[i], cos[i]
        ax, ay = (x1[j] - plon) * RADIAN * g.RADIUS_M * pcos, (y1[j] - plat) * RADIAN * g.RADIUS_M
        dx, dy = (x2[j] - x1[j]) * RADIAN * g.RADIUS_M * pcos, (y2[j] - y1[j]) * RADIAN * g.RADIUS_M
        length = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(length <= 1e-18, 0.0, np.minimum(1.0, np.maximum(0.0, -(ax * dx + ay * dy) / length)))
        qx, qy = ax + t * dx, ay + t * dy
        d = np.sqrt(qx * qx + qy * qy)
        near = np.flatnonzero(d <= safe[i] + 1e-5)
        i, j, d = i[near], j[near], d[near]
        by = np.lexsort((j, d, road[j], i))  # of one road the nearest segment, the first of equal ones
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(i[by]) != 0) | (np.diff(road[j[by]]) != 0)
        by = by[new]
        by = by[np.lexsort((road[j[by]], np.floor(d[by] * 1e6 + 0.5), i[by]))]
        i, j, d, near = i[by], j[by], d[by], near[by]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        sure = np.zeros(len(lon) + 1, bool)
        if size is None:
            sure[i] = True
        else:
            sure[i[(place == k - 1) & (d <= safe[i])]] = True
        kept = (place < k) & sure[i]
        found.append((i[kept], j[kept], d[kept], qx[near[kept]], qy[near[kept]]))
    i, j, d, qx, qy = (np.concatenate([f[c] for f in found]) for c in range(5))
    degree = 180.0 / math.pi
    made = {"distance": d, "plon": lon[i] + qx / (g.RADIUS_M * np.maximum(cos[i], 1e-12)) * degree, "plat": lat[i] + qy / g.RADIUS_M * degree}
    at = pa.array(order[j])
    kind = schema.field("near").type
    columns = [pa.array(made[f.name], f.type) if f.name in made else parts[f.name].take(at).combine_chunks().cast(f.type) for f in kind.value_type]
    values = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(lon)))]).astype(np.int32)
    near = pa.ListArray.from_arrays(pa.array(offsets), values, type=kind)
    return pa.Table.from_arrays([near if f.name == "near" else points[f.name].cast(f.type) for f in schema], schema=schema)


def _hash_share(held: DataFrame) -> Column:
    """How many shares the points of a cell are dealt into; 1 but for the cells of ``held`` (cx, cy, n) with more than SHARE points.

    There are no more such cells than shares. Their hashes are part of the expression: a
    power of two for each of them, some ten lists.
    """
    lists: dict[int, list[int]] = {}
    for r in held.where(F.col("n") > SHARE).select(F.xxhash64("cx", "cy").alias("h"), "n").collect():
        lists.setdefault(2 ** math.ceil(math.log2(r["n"] / SHARE)), []).append(r["h"])
    shares = F.lit(1)
    for n, hashes in lists.items():
        shares = F.when(F.xxhash64("cx", "cy").isin(hashes), F.lit(n)).otherwise(shares)
    return shares.cast("long")


def _nearest(points: DataFrame, parts: DataFrame, k: int, size: float | None) -> DataFrame:
    """``points``, which have cells (cx, cy), with ``near`` as in ``_met``, without their cells.

    Points go to groups of about SHARE by a hash of their cell; the points of a crowded cell
    are dealt into shares, each of which gets the cell's segments, so no task has more than
    its part however few cells the points are in.
    """
    held = materialised(points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")))
    wanted = materialised(parts.join(held.select("cx", "cy").hint("merge"), ["cx", "cy"], "left_semi"))
    groups = max(1, -(-(held.agg(F.sum("n")).first()[0] or 0) // SHARE), -(-wanted.count() // GROUP_PARTS))
    shares = _hash_share(held)
    kept = [c for c in points.columns if c not in ("cx", "cy", "_cos")]
    group = F.pmod(F.xxhash64("cx", "cy", "_share"), F.lit(groups)).cast("int")
    dealt = points.withColumn("_cos", F.cos(F.radians("lat"))).withColumn("_share", F.pmod(F.xxhash64(*kept), shares)).withColumn("_group", group)
    copies = wanted.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).withColumn("_group", group)
    made = T.StructType([f for f in parts.schema.fields if f.name not in ("cx", "cy", "x1", "y1", "x2", "y2")])
    for name in ("distance", "plon", "plat"):
        made = made.add(name, "double")
    made = T.StructType([T.StructField(f.name, f.dataType) for f in made])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in points.select(*kept).schema]).add("near", T.ArrayType(made))
    types = to_arrow_schema(schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _met(left, right, k, size, types)

    return dealt.groupBy("_group").cogroup(copies.groupBy("_group")).applyInArrow(meet, schema)


def _pieces(parts: DataFrame, width: float) -> DataFrame:
    """``parts`` once for each piece of at most four cells of ``width``, with the piece's box: what a segment covers grows with its length, not with its box."""
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / (4 * width)), F.lit(1))
    rows = parts.drop(*BOX).withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_n"))
    ends = [(at("x1", "x2", i), at("y1", "y2", i)) for i in (F.col("_i"), F.col("_i") + 1)]
    box = (F.least(ends[0][0], ends[1][0]), F.least(ends[0][1], ends[1][1]), F.greatest(ends[0][0], ends[1][0]), F.greatest(ends[0][1], ends[1][1]))
    return rows.withColumns(dict(zip(BOX, box, strict=True))).drop("_n", "_i")


def _start_width(parts: DataFrame, size: float) -> float:
    """``size``, or as much less as makes a crowded cell (the ninth tenth of the segments' cells) hold some CROWD segments."""
    x, y = cells((F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2, size)
    held = parts.groupBy(x.alias("cx"), y.alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    crowd = held.agg(F.percentile_approx("n", 0.9)).first()[0] or 1
    return size / 2 ** max(0, math.ceil(math.log2(crowd / CROWD) / 2)) if crowd > CROWD else size


def nearest_lists(points: DataFrame, roads: DataFrame, k: int = 5, size: float = CELL, about: dict[str, Column] | None = None) -> DataFrame:
    """``points`` that have lon and lat, stored, with ``near``: an array, nearest first, of their ``k`` nearest roads, exactly.

    An entry has road_id, segment_index, distance, plon, plat and ``about``, expressions on a
    segment (road_id, x1, y1, x2, y2) and the road's other columns. Points without any road
    are left out. Ties, to a micrometre, go to the smaller road_id. Rings of cells are
    searched outward, from cells as narrow as the roads are dense: a ring's answer for a
    point is final once its k-th distance is no more than what the ring covers around the
    point, and only the other points go on to the next, four times wider ring. Points and
    segments of roads meet on cells. No join may broadcast: Spark judges stored rows by
    their compressed files, in which millions of regular points or segments, each later in
    many cells, take a few MB. Points that no ring within FAR cells of the first answers
    are far from everything; they are compared with all segments, which are dealt into
    parts of FAR_PARTS, each part's best ``k`` first.
    """
    parts = materialised(_parts(roads.withColumnRenamed("id", "road_id"), about or {}))
    x1, y1, x2, y2 = bounds(parts).unionByName(bounds(points)).agg(F.min("min_lon"), F.min("min_lat"), F.max("max_lon"), F.max("max_lat")).first()
    left = points.where("lon is not null and lat is not null")
    width = size if x1 is None else _start_width(parts, size)
    span = 0.0 if x1 is None else max(x2 - x1, y2 - y1, size)
    rings, far = [], min(2 * span, width * FAR)
    while width <= far:
        x, y = cells(F.col("lon"), F.col("lat"), width)
        ring = materialised(_nearest(left.withColumns({"cx": x, "cy": y}), covered(_pieces(parts, width), width, width).drop(*BOX), k, width))
        rings.append(ring.where(F.size("near") > 0))
        left = ring.where(F.size("near") == 0).drop("near")
        if left.isEmpty():
            break
        width *= 4
    else:
        n = max(1, -(-parts.count() // FAR_PARTS))
        part = F.pmod(F.xxhash64("road_id", "x1", "y1", "x2", "y2"), F.lit(n))
        remote = materialised(left.withColumn("_point", F.monotonically_increasing_id()))
        all_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        dealt = _nearest(remote.select("_point", "lon", "lat").withColumns({"cx": all_parts, "cy": F.lit(0).cast("long")}), parts.withColumns({"cx": part, "cy": F.lit(0).cast("long")}).drop(*BOX), k, None)
        every = dealt.select("_point", F.explode("near").alias("c"))  # a road may have segments in several parts
        best = every.groupBy("_point", "c.road_id").agg(F.min_by("c", F.struct("c.distance", "c.segment_index")).alias("c"))
        order = Window.partitionBy("_point").orderBy(F.round("c.distance", 6), "road_id")
        best = best.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
        lists = best.groupBy("_point").agg(F.array_sort(F.collect_list(F.struct("_rank", "c"))).alias("near")).select("_point", F.transform("near", lambda e: e["c"]).alias("near"))
        rings.append(materialised(remote.join(lists.hint("merge"), "_point").drop("_point")))
    out = rings[0]
    for ring in rings[1:]:
        out = out.unionByName(ring)
    return out


def nearest_roads(points: DataFrame, roads: DataFrame, keys: list[str], k: int = 5, size: float = CELL) -> DataFrame:
    """For each point (keys, lon, lat) its ``k`` nearest roads, as in ``nearest_lists``: keys, lon, lat, road columns, distance, segment_index, plon, plat, cand_rank."""
    own = [c for c in roads.columns if c not in ("id", "lon", "lat", *BOX, *keys)]
    lists = nearest_lists(points.select(*keys, "lon", "lat"), roads.select("id", *own), k, size)
    rows = lists.select(*keys, "lon", "lat", F.posexplode("near").alias("_at", "_f")).select(*keys, "lon", "lat", "_f.*", (F.col("_at") + 1).alias("cand_rank"))
    met = rows.join(roads.select(F.col("id").alias("road_id"), *own).hint("merge"), "road_id")
    vertex = F.element_at("geometry", 1)
    distance = F.when(F.size("geometry") == 1, g.haversine(F.col("lon"), F.col("lat"), vertex["lon"], vertex["lat"])).otherwise(F.col("distance"))
    return met.select(*keys, "lon", "lat", "road_id", *own, distance.alias("distance"), "segment_index", "plon", "plat", "cand_rank")


def nearby_roads(points: DataFrame, roads: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """``nearest_roads`` with the heading of the segment that was met: what map matching takes as candidates."""
    found = nearest_roads(points, roads, keys, k)
    at = lambda i: F.element_at("geometry", (F.col("segment_index") + i).cast("int"))
    return found.withColumn("road_heading", g.bearing(at(1)["lon"], at(1)["lat"], at(2)["lon"], at(2)["lat"]))


def nearest_node(points: DataFrame, nodes: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """(keys, node_id, distance) of the node nearest to each point, by scaled degrees; ties to the smaller id.

    As ``nearest_roads``, in widening rings of cells.
    """
    lines = nodes.select("id", F.array(g.point(F.col("lon"), F.col("lat"))).alias("geometry"))
    found = nearest_roads(points, with_bbox(lines), keys, 8, size)
    q = F.element_at("geometry", 1)
    order = F.struct(F.round(g.degrees_distance_sq(F.col("lon"), F.col("lat"), q["lon"], q["lat"]), 18), F.col("road_id"))
    return found.groupBy(*keys).agg(F.min_by("road_id", order).alias("node_id"), F.min_by("distance", order).alias("distance"))


def polygon_boxes(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    return polygons.withColumns(dict(zip(BOX, p.line_bbox(F.flatten(F.col(rings))), strict=True)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs of a point and a polygon that holds it, its edge included: columns of ``points``, fence_id, side."""
    fences = covered(polygon_boxes(polygons.select(F.col("id").alias("fence_id"), "rings")), size)
    x, y = cells(F.col("lon"), F.col("lat"), size)
    met = points.withColumns({"cx": x, "cy": y}).join(fences, ["cx", "cy"]).where(p.bbox_contains_point(_box(), F.col("lon"), F.col("lat")))
    met = met.withColumn("side", p.point_in_polygon(F.col("lon"), F.col("lat"), F.col("rings"))).where("side <> 'outside'")
    return met.select(*points.columns, "fence_id", "side")


def roads_in_polygons(roads: DataFrame, polygons: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs (road_id, fence_id) of a road that meets a polygon: boxes first, then the exact test."""
    pairs = bbox_join(with_bbox(roads.select("id", "geometry")), polygon_boxes(polygons.select("id", "rings")), size)
    return pairs.where(p.polyline_meets_polygon(F.col("l_geometry"), F.col("r_rings"))).select(F.col("l_id").alias("road_id"), F.col("r_id").alias("fence_id"))


def blocked_edges(roads: DataFrame, polygons: DataFrame) -> DataFrame:
    """(road_id) of the roads that meet any polygon."""
    return roads_in_polygons(roads, polygons).select("road_id").distinct()


def polygon_rows(spark, rings: list, polygon_id: str = "query") -> DataFrame:
    """A literal polygon, rings of (lon, lat), as a table of one row; open rings are closed."""
    closed = [[(float(c[0]), float(c[1])) for c in (r if not r or tuple(r[0][:2]) == tuple(r[-1][:2]) else [*r, r[0]])] for r in rings]
    return spark.createDataFrame([(polygon_id, closed)], "id string, rings array<array<struct<lon:double,lat:double>>>")


def fence_events(points: DataFrame, fences: DataFrame, size: float = CELL) -> DataFrame:
    """(fence_id, trajectory_id, point_index, event) with event enter or exit.

    A trajectory starts outside; the edge counts as inside. Only points inside are joined
    to fences; a point is an enter if the one before it is not inside, and the point after
    a stay is an exit, so rows outside are never paired with fences.
    """
    keys = Window.partitionBy("trajectory_id").orderBy("point_index")
    steps = points.withColumn("_n", F.row_number().over(keys)).withColumn("_next", F.lead("point_index").over(keys))
    inside = points_in_polygons(steps.select("trajectory_id", "point_index", "_n", "_next", "lon", "lat"), fences, size)
    stay = Window.partitionBy("fence_id", "trajectory_id").orderBy("_n")
    runs = inside.withColumn("_before", F.lag("_n").over(stay)).withColumn("_after", F.lead("_n").over(stay))
    enter = runs.where("_before is null or _before < _n - 1").select("fence_id", "trajectory_id", "point_index", F.lit("enter").alias("event"))
    leave = runs.where("_next is not null and (_after is null or _after > _n + 1)").select("fence_id", "trajectory_id", F.col("_next").alias("point_index"), F.lit("exit").alias("event"))
    return enter.unionByName(leave)


def index_stats(candidates: DataFrame, exact: Column) -> DataFrame:
    """One row: how many candidates a box query gave and how many fail the exact test."""
    return candidates.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(~exact).alias("false_positive_count"))
