"""A map on disk: five Parquet layers in versioned folders, swapped as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.types import LAYERS
from ..operators.spatial import BOX, with_bbox

_KEYS = {"trajectory_points": ("trajectory_id", "point_index")}
#: Which of several rows with one key is the last, where there is no pos.
_ORDER = {"trajectory_points": ("ts_raw", "lon", "lat")}
#: Versions that stay when a new one is written, so that readers of the one before can finish.
KEPT_VERSIONS = 2


def keep_last(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key by ``order``, nulls first."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class MapStore:
    """Layers of one map below ``root``.

    A write makes new folders and then a file VERSION-n that names the folder of each
    layer; the highest complete one counts, and it is never changed, so readers see whole
    maps only and a write that fails half-way changes nothing. Folders that none of the
    last KEPT_VERSIONS names are deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[tuple[int, dict[str, str]]]:
        """Complete versions, the newest first."""
        fs, top = self._fs("")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        out = []
        for n in sorted((int(x.removeprefix("VERSION-")) for x in names if x.startswith("VERSION-")), reverse=True):
            _, path = self._fs(f"VERSION-{n}")
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream := fs.open(path), "UTF-8")
            stream.close()
            if text.endswith("}"):
                out.append((n, json.loads(text)))
        return out

    def current(self) -> dict[str, str]:
        """The folder of each layer; empty before the first write."""
        found = self._versions()
        return found[0][1] if found else {}

    def _point(self, folders: dict[str, str]) -> None:
        found = self._versions()
        fs, path = self._fs(f"VERSION-{found[0][0] + 1 if found else 1}")
        out = fs.create(path, False)  # of two writers one fails here
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        kept = [(0, folders), *found[: KEPT_VERSIONS - 1]]
        held = {f for _, version in kept for f in version.values()}
        for n, version in found[KEPT_VERSIONS - 1 :]:
            for folder in set(version.values()) - held:
                fs.delete(self._fs(folder)[1], True)
            fs.delete(self._fs(f"VERSION-{n}")[1], False)

    def layer(self, name: str) -> DataFrame:
        folder = self.current().get(name)
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], LAYERS[name])

    def has_roads(self) -> bool:
        return not self.layer("road_edges").isEmpty()

    def replace(self, **layers: DataFrame | None) -> None:
        """Writes the given layers (None: empty) and keeps the others; roads get their box columns."""
        folders = dict(self.current())
        for name, rows in layers.items():
            rows = self.spark.createDataFrame([], LAYERS[name]) if rows is None else rows
            if name == "road_edges" and not set(BOX) <= set(rows.columns):
                rows = with_bbox(rows)
            folders[name] = f"{name}-{uuid.uuid4().hex[:12]}"
            rows.write.parquet(f"{self.root}/{folders[name]}")
        self._point(folders)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows by key over those stored; a key is there once afterwards.

        Of several new rows with one key the last by pos wins and moves to the end; points
        of trajectories, which have no pos, go by ts_raw, then by their place.
        """
        keys = _KEYS.get(name, ("id",))
        old = self.layer(name)
        if "pos" in old.columns:
            last = old.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
            rows = keep_last(rows, keys, ("pos",)).withColumn("pos", F.col("pos") + last + 1)
        else:
            rows = keep_last(rows, keys, _ORDER[name])
        rows = rows if name != "road_edges" else with_bbox(rows)
        kept = old.join(rows.select(*keys), list(keys), "left_anti")
        self.replace(**{name: kept.unionByName(rows, allowMissingColumns=True)})

    def clear(self) -> None:
        self.replace(**dict.fromkeys(LAYERS))
