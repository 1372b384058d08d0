"""Fence events and counts over a stream of files."""

from __future__ import annotations

from datetime import datetime, timedelta

from maps import FENCE

from roadloom.operators import spatial
from roadloom.streaming import geofence

SCHEMA = "trajectory_id string, ts timestamp, lon double, lat double"
START = datetime(2026, 1, 1)


def run(spark, tmp_path, parts, **options):
    """The events and counts of files that arrive one after the other."""
    folder = str(tmp_path / "in")
    fence = spatial.polygon_rows(spark, FENCE, "f")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(SCHEMA).parquet(folder)
        for name, out in (("events", geofence.fence_event_stream(source, fence, **options)), ("counts", geofence.position_counts(source))):
            query = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    events = sorted(((r["ts"] - START).total_seconds() / 60, r["trajectory_id"], r["event"]) for r in spark.read.parquet(str(tmp_path / "events")).collect())
    return events, spark.read.parquet(str(tmp_path / "counts")).collect()


def at(minute, lon, lat=39.91, name="t"):
    return name, START + timedelta(minutes=minute), lon, lat


def test_events_in_order_and_windows(spark, tmp_path):
    """A position that arrives late but within the watermark counts; one beyond it does not."""
    inside, outside = 116.40, 116.39
    parts = [[at(0, outside), at(1, inside)], [at(3, outside), at(4, inside)], [at(2, 116.42), at(60, outside)], [at(5, outside), at(61, inside, name="u")], [at(200, outside), at(200, outside, name="u")]]
    events, counts = run(spark, tmp_path, parts)
    assert events == [(1, "t", "enter"), (2, "t", "exit"), (4, "t", "enter"), (60, "t", "exit"), (61, "u", "enter")]
    assert {(r["start"].minute, r["trajectory_id"], r["n"]) for r in counts if r["start"].hour == 0} >= {(0, "t", 5)}


def test_idle_trajectories_are_forgotten(spark, tmp_path):
    parts = [[at(0, 116.40)], [at(30, 116.40, name="u")], [at(500, 116.39, name="u")], [at(505, 116.40)], [at(900, 116.39, name="u")], [at(2000, 116.39, name="u")]]
    events, _ = run(spark, tmp_path, parts, idle="1 hour")
    assert [e for e in events if e[1] == "t"] == [(0, "t", "enter"), (505, "t", "enter")]
