"""Fence events over a stream of positions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import planar as p
from ..operators.spatial import BOX, CELL, cells, covered, polygon_boxes

_EVENT = "fence_id string, trajectory_id string, ts timestamp, event string"


def held_positions(positions: DataFrame, fences: DataFrame, size: float = CELL) -> DataFrame:
    """(trajectory_id, ts, fence_id): every position with each fence of a static table that holds it, or with a null one, found on grid cells."""
    areas = covered(polygon_boxes(fences.select(F.col("id").alias("fence_id"), "rings")), size)
    x, y = cells(F.col("lon"), F.col("lat"), size)
    met = positions.select("trajectory_id", "ts", "lon", "lat").withColumns({"cx": x, "cy": y}).join(areas, ["cx", "cy"], "left")
    box = tuple(F.col(n) for n in BOX)
    inside = p.bbox_contains_point(box, F.col("lon"), F.col("lat")) & (p.point_in_polygon(F.col("lon"), F.col("lat"), F.col("rings")) != "outside")
    return met.select("trajectory_id", "ts", F.when(F.col("fence_id").isNotNull() & inside, F.col("fence_id")).alias("fence_id"))


def fence_event_stream(positions: DataFrame, fences: DataFrame, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """Enter and exit events of a stream of positions (trajectory_id, ts, lon, lat), in the order of time.

    Positions wait in the state until the watermark, ``late`` behind the newest one, has
    passed them; then they are taken in order, so one that arrives late but within the
    watermark counts like any other, and events are final. Positions beyond the watermark
    are dropped. The state of a trajectory is its waiting positions, the fences it is in
    and since when; it is forgotten once the watermark is ``idle`` past its last position,
    and a trajectory that comes back later starts outside.
    """
    rows = held_positions(positions.withWatermark("ts", late), fences)
    rest = int(pd.Timedelta(idle).total_seconds() * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, last, waiting = (set(json.loads(state.get[0])), state.get[1], {int(t): set(f) for t, f in json.loads(state.get[2])}) if state.exists else (set(), 0, {})
        for batch in [] if state.hasTimedOut else batches:
            for ts, fence in zip(batch["ts"].astype("datetime64[us]").astype("int64").tolist(), batch["fence_id"].tolist(), strict=True):
                if ts > last:
                    waiting.setdefault(ts, set()).update([fence] if isinstance(fence, str) else [])
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        for ts in sorted(t for t in waiting if t <= passed):
            now, when = waiting.pop(ts), pd.Timestamp(ts, unit="us")
            out += [(f, key[0], when, "exit") for f in sorted(inside - now)] + [(f, key[0], when, "enter") for f in sorted(now - inside)]
            inside, last = now, ts
        if waiting or passed <= last + rest * 1000:
            state.update((json.dumps(sorted(inside)), last, json.dumps([(t, sorted(f)) for t, f in sorted(waiting.items())])))
            due = min(waiting) // 1000 + 1 if waiting else last // 1000 + rest
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["fence_id", "trajectory_id", "ts", "event"])

    return rows.groupBy("trajectory_id").applyInPandasWithState(follow, _EVENT, "inside string, last long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def position_counts(positions: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, trajectory_id, n): positions in tumbling windows; late ones beyond the watermark are dropped."""
    rows = positions.withWatermark("ts", late).groupBy(F.window("ts", window), "trajectory_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("window.start", "window.end", "trajectory_id", "n")
