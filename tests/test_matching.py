"""Map matching against exhaustive choice, and trajectory measures."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from maps import TRACE, payloads
from pyspark.sql import functions as F

from roadloom.operators import graph, matching, trajectory
from roadloom.sources import geojson


@pytest.fixture(scope="module")
def town(spark):
    nodes, roads = geojson.roads(geojson.payload_features(spark, payloads()[0]))
    points = matching.trace_rows(spark, [("traj_001", i, *c) for i, c in enumerate(TRACE)])
    return points, spark.createDataFrame(roads.collect(), roads.schema)


def test_viterbi_is_exhaustive():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 4, rng.integers(1, 5))
        e = [rng.normal(size=n) for n in sizes]
        t = [rng.normal(size=(a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        score = lambda s, e=e, t=t: sum(x[i] for x, i in zip(e, s, strict=True)) + sum(x[a, b] for x, a, b in zip(t, s, s[1:], strict=False))
        best = max(product(*map(range, sizes)), key=score)
        assert score(matching.viterbi(e, t)) == pytest.approx(score(best))


def test_nearest_follows_the_street(spark, town):
    points, roads = town
    rows = matching.match_nearest(points, roads)
    got = {r["point_index"]: (r["road_id"], r["distance"]) for r in rows.collect()}
    assert [got[i][0] for i in range(6)] == ["edge_h_01_11", "edge_h_01_11", "edge_h_11_21", "edge_h_11_21", "edge_v_21_22", "edge_v_21_22"]
    assert [got[i][1] for i in range(6)] == pytest.approx([22.239, 11.120, 22.239, 0.0, 17.057, 8.528], abs=1e-3)
    sequence = matching.matched_sequences(rows).first()
    assert sequence["matched_road_sequence"] == ["edge_h_01_11", "edge_h_11_21", "edge_v_21_22"]
    assert sequence["confidence"] == pytest.approx(round(1 / (1 + np.mean([22.239, 11.120, 22.239, 0.0, 17.057, 8.528]) / 25), 3))


def test_greedy_takes_the_cheapest_each_time(spark, town):
    points, roads = town
    cands = matching.candidates(points, roads, 3)
    pairs = [r.asDict() for r in matching.steps(cands, roads).collect()]
    got = {r["point_index"]: r["road_id"] for r in matching.match_candidate_cost(points, roads, 3).collect()}
    last = None
    for i in range(6):
        rows = [r for r in pairs if r["point_index"] == i and (last is None or r["prev_road"] == last)]
        cost = lambda r: r["distance"] + 30 * r["direction_cost"] + 0.02 * ((1e6 if r["network_m"] is None else r["network_m"]) if r["prev_rank"] else 0) + 25 * r["turn"] + 12 * r["prior"]
        last = min(rows, key=lambda r: (cost(r), r["cand_rank"]))["road_id"]
        assert got[i] == last


def test_hmm_is_the_best_sequence(spark, town):
    points, roads = town
    pairs = [r.asDict() for r in matching.steps(matching.candidates(points, roads, 2), roads).collect()]
    emission = lambda r: -0.5 * (r["distance"] / 20) ** 2 - 4 * r["direction_cost"] - 0.4 * r["prior"]
    move = lambda r: -1e6 if r["network_m"] is None else -abs(r["network_m"] - r["gps_m"]) / 50 - 1.5 * r["turn"] - 0.5 * r["prior"]
    of = {(r["point_index"], r["prev_rank"], r["cand_rank"]): r for r in pairs}

    def score(s):
        total = emission(of[0, None, s[0]])
        return total + sum(emission(of[i, s[i - 1], s[i]]) + move(of[i, s[i - 1], s[i]]) for i in range(1, 6))

    best = max(product((1, 2), repeat=6), key=score)
    rows = matching.match_hmm(points, roads, 2).collect()
    road = {(r["point_index"], r["cand_rank"]): r["road_id"] for r in pairs}
    assert [r["road_id"] for r in sorted(rows, key=lambda r: r["point_index"])] == [road[i, c] for i, c in enumerate(best)]
    assert {"emission_prob", "heading_cost", "road_class_prior"} <= set(rows[0].asDict())


@pytest.fixture(scope="module")
def drives(spark, town):
    """Trajectories of 1 to 12 points on the town's roads, one with a point that is nowhere, and the candidates' pairs of each."""
    rng = np.random.default_rng(4)
    rows = [(f"d{n:02d}", i, float(x), float(y)) for n in range(12) for i, (x, y) in enumerate(np.array(TRACE[0]) + np.cumsum(rng.normal(0.001, 0.002, (n + 1, 2)), axis=0))]
    rows += [("gap", 0, *TRACE[0]), ("gap", 1, None, None), ("gap", 2, *TRACE[2])]
    points = matching.trace_rows(spark, rows)
    pairs: dict = {}
    for r in matching.steps(matching.candidates(points, town[1], 3), town[1]).collect():
        pairs.setdefault(r["trajectory_id"], {}).setdefault(r["point_index"], []).append(r)
    return spark.createDataFrame(points.collect(), points.schema), pairs


def _chosen(spark, query, points, roads, name):
    """What a query of whole trajectories finds, its rows handed over seven at a time; no row of Python's input may be a pair of candidates."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = query(points, roads, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "prev_rank" not in plan
        return {(r["trajectory_id"], r["point_index"]): r[name] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_greedy_of_many_drives_at_once(spark, town, drives):
    points, pairs = drives
    got = _chosen(spark, matching.match_candidate_cost, points, town[1], "total_cost")
    want = {}
    for name, layers in pairs.items():
        last = None
        for i in sorted(layers):
            cost = lambda r: r["distance"] + 30 * r["direction_cost"] + 0.02 * ((1e6 if r["network_m"] is None else r["network_m"]) if r["prev_rank"] else 0) + 25 * r["turn"] + 12 * r["prior"]
            best = min((r for r in layers[i] if last is None or r["prev_rank"] == last), key=lambda r: (round(cost(r), 9), r["cand_rank"]))
            last, want[name, i] = best["cand_rank"], cost(best)
    assert got.keys() == want.keys() and len(want) == 80
    assert [got[k] for k in want] == pytest.approx(list(want.values()))


def test_hmm_of_many_drives_at_once(spark, town, drives):
    points, pairs = drives
    got = _chosen(spark, matching.match_hmm, points, town[1], "road_id")
    want = {}
    for name, layers in pairs.items():
        if name == "gap":  # a point without candidates
            continue
        best: dict = {}
        for i in sorted(layers):
            new: dict = {}
            for r in layers[i]:
                emission = -0.5 * (r["distance"] / 20) ** 2 - 4 * r["direction_cost"] - 0.4 * r["prior"]
                move = 0.0 if r["prev_rank"] is None else -1e6 if r["network_m"] is None else -abs(r["network_m"] - r["gps_m"]) / 50 - 1.5 * r["turn"] - 0.5 * r["prior"]
                before = (0.0, []) if r["prev_rank"] is None else best[r["prev_rank"]]
                new.setdefault(r["cand_rank"], []).append((-round(before[0] + move, 9), r["prev_rank"] or 0, before[0] + move + emission, [*before[1], r["road_id"]]))
            best = {rank: min(ways)[2:] for rank, ways in new.items()}
        roads = min((-round(score, 9), rank, way) for rank, (score, way) in best.items())[2]
        want |= {(name, i): road for i, road in zip(sorted(layers), roads, strict=True)}
    assert got == want and len(want) == 78


def test_evaluation(spark):
    sequences = spark.createDataFrame([("a", ["x", "y", "z"], 0.5), ("b", ["x"], 0.1)], "trajectory_id string, matched_road_sequence array<string>, confidence double")
    truth = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["x"]), ("c", ["q"])], "trajectory_id string, roads array<string>")
    got = {r["trajectory_id"]: tuple(r)[1:] for r in matching.evaluation(sequences, truth).collect()}
    assert got["a"] == (0.6667, 1.0, False, 0.5) and got["b"][:3] == (1.0, 1.0, True)
    assert got["c"][:2] == (0.0, 0.0)


def test_synthetic_traces(spark):
    line = lambda *c: [tuple(map(float, q)) for q in c]
    rows = [("r", 0, line((116, 39), (116.005, 39.4), (116.01, 39))), ("r", 1, line((116.01, 39), (116.01, 39.02))), ("s", 0, line((117, 39), (117, 39.01)))]
    routes = spark.createDataFrame(rows, "trajectory_id string, leg int, geometry array<struct<lon:double,lat:double>>")
    quiet = {(r[0], r[1]): (r[2], r[3]) for r in matching.noisy_traces(routes, 3, 0.0).collect()}
    assert [quiet["r", i] for i in range(6)] == [pytest.approx(q) for q in ((116, 39), (116.005, 39), (116.01, 39), (116.01, 39), (116.01, 39.01), (116.01, 39.02))]
    many = spark.range(2000).select(F.col("id").cast("string").alias("trajectory_id"), F.lit(0).alias("leg"), F.expr("array(named_struct('lon', 116D, 'lat', 39D), named_struct('lon', 116D, 'lat', 39D))").alias("geometry"))
    noisy = matching.noisy_traces(many, 2, 8.0, (0.0, 18.0)).toPandas()
    east, north = np.radians(noisy["lon"] - 116) * 6_371_008.8 * np.cos(np.radians(39)), np.radians(noisy["lat"] - 39) * 6_371_008.8
    assert (east.mean(), north.mean(), east.std(), north.std()) == pytest.approx((0, 18, 8, 8), abs=0.6) and abs(np.corrcoef(east, north)[0, 1]) < 0.1
    again = matching.noisy_traces(many.repartition(7), 2, 8.0, (0.0, 18.0)).toPandas()
    assert noisy.sort_values(["trajectory_id", "point_index"]).reset_index(drop=True).equals(again.sort_values(["trajectory_id", "point_index"]).reset_index(drop=True))
    cases = matching.trace_cases(routes).groupBy("trajectory_id").count().collect()
    assert {r[0]: r[1] for r in cases} == {"parallel_roads:r": 10, "parallel_roads:s": 5, "low_frequency_gps:r": 4, "low_frequency_gps:s": 2}


def test_repeated_trips_and_projection(spark, town):
    points, _ = town
    longer = matching.repeated(points, 3)
    got = longer.orderBy("point_index").collect()
    assert [r["point_index"] for r in got] == list(range(18)) and [(r["lon"], r["lat"]) for r in got] == TRACE * 3
    routes = spark.createDataFrame([("traj_001", 0, [(116.39, 39.9), (116.4, 39.9)]), ("traj_001", 1, [(116.4, 39.9), (116.41, 39.9)])], "trajectory_id string, leg int, geometry array<struct<lon:double,lat:double>>")
    feet = matching.project_to_chord(points, routes).orderBy("point_index").collect()
    assert [r["plat"] for r in feet] == pytest.approx([39.9] * 6) and feet[0]["plon"] == pytest.approx(116.391) and feet[4]["plon"] == pytest.approx(116.41)


def test_trajectory_measures(spark, town):
    points, _ = town
    assert trajectory.lengths(points).first()["length_m"] == pytest.approx(2486.472, abs=1e-3)
    heads = {r["point_index"]: r["heading"] for r in trajectory.headings(points).collect()}
    assert heads[4] == pytest.approx(heads[5])
    single = points.limit(1).withColumn("trajectory_id", F.lit("one"))
    assert trajectory.headings(single).first()["heading"] is None
    spike = matching.trace_rows(spark, [("s", 0, 0.0, 0.0), ("s", 1, 0.0, 0.01), ("s", 2, 0.0005, 0.0)])
    assert [r["point_index"] for r in trajectory.outliers(spike).collect()] == [1]
    got = trajectory.analyse(points).first()
    assert got["point_count"] == 6 and got["outlier_indices"] == [] and got["max_m"] <= 5 and got["dtw_m"] >= 0 and len(got["simplified"]) == got["simplified_point_count"]
    other = trajectory.analyse(points, points.withColumn("lat", F.col("lat") + 0.001)).first()
    assert other["hausdorff_m"] == pytest.approx(111.195, abs=0.01) and other["frechet_m"] == pytest.approx(111.195, abs=0.01) and other["exceeds_threshold"]
    pairs = spark.createDataFrame([("traj_001", "nobody")], "a string, b string")
    assert trajectory.hausdorff(points, points, pairs).first()["hausdorff_m"] == 0


def plain_dtw(a, b, add):
    d = trajectory.distance_matrix(a, b)
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0 if add else -np.inf
    for i in range(len(a)):
        for j in range(len(b)):
            before = min(best[i, j], best[i, j + 1], best[i + 1, j])
            best[i + 1, j + 1] = d[i, j] + before if add else max(d[i, j], before)
    return best[-1, -1]


def test_similarity_equals_recursion(spark):
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 7), (6, 1), (5, 9), (12, 4), (20, 20)):
        a, b = (np.array([116.0, 39.0]) + rng.normal(0, 0.01, (k, 2)) for k in (n, m))
        d = trajectory.distance_matrix(a, b)
        assert trajectory.dtw(a, b) == pytest.approx(plain_dtw(a, b, True)) and trajectory.frechet(a, b) == pytest.approx(plain_dtw(a, b, False))
        assert trajectory.hausdorff_distance(a, b, 3) == pytest.approx(max(d.min(axis=1).max(), d.min(axis=0).max()))
    assert trajectory.dtw(a, a[:0]) == trajectory.frechet(a[:0], a) == trajectory.hausdorff_distance(a, a[:0]) == 0


def test_hulls(spark):
    rng = np.random.default_rng(2)
    rows = [("k", float(x), float(y)) for x, y in rng.normal(size=(200, 2))]
    got = trajectory.convex_hulls(spark.createDataFrame(rows, "key string, lon double, lat double"), "key").orderBy("vertex").collect()
    want = trajectory.hull(np.array([r[1:] for r in rows]))
    assert [(r["lon"], r["lat"]) for r in got] == [tuple(q) for q in want]


def test_network_is_held_in_few_bytes_an_arc(spark):
    import tracemalloc

    roads = spark.range(10_000).selectExpr("concat('r', id) AS edge_id", "concat('n', id) AS from_node", "concat('n', id + 1) AS to_node", "1D AS length", "2D AS travel_time", "array(named_struct('lon', 116D + id * 1e-5, 'lat', 39D), named_struct('lon', 116D + (id + 1) * 1e-5, 'lat', 39D)) AS geometry")
    pairs = spark.createDataFrame([("n5", "n9"), ("n9", "n5"), ("elsewhere", "elsewhere"), ("n7", "n7"), ("n1", "elsewhere")], "source string, target string")
    tracemalloc.start()
    found = graph.shortest_paths(roads, pairs.select("source"), paths=True, targets=pairs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500 * 10_000
    assert {(r["source"], r["node"]): (r["cost"], r["travel_time"], r["edges"]) for r in found.collect()} == {("n5", "n9"): (4.0, 8.0, ["r5", "r6", "r7", "r8"]), ("elsewhere", "elsewhere"): (0.0, 0.0, []), ("n7", "n7"): (0.0, 0.0, [])}
