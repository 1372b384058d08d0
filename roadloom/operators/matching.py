"""Map matching: candidates, nearest, greedy by cost, hidden Markov model, synthetic traces, evaluation.

Candidates, network distances and all cost terms are relational and computed for all
trajectories at once. The choice along trajectories runs in Python, in arrays, for many
trajectories at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as g
from .graph import arcs, shortest_paths
from .lineage import materialised
from .spatial import nearby_roads, nearest_lists
from .trajectory import headings

#: Weights of distance, direction, connectivity, turn and class in the greedy cost.
GREEDY = (1.0, 30.0, 0.02, 25.0, 12.0)
#: Metres that count where the network has no way, in the greedy cost.
UNREACHABLE_M = 1_000_000.0
#: Decimal places to which costs and scores are equal.
TIE_DIGITS = 9


def candidates(points: DataFrame, roads: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest roads of every trajectory point, with heading of travel and cost terms that need no other point."""
    near = nearby_roads(points, roads, ["trajectory_id", "point_index"], k)
    along = headings(points).select("trajectory_id", "point_index", "heading", "step_m")
    rows = near.join(along, ["trajectory_id", "point_index"])
    return rows.withColumns({"direction_cost": g.direction_cost(F.col("road_heading"), F.col("heading"), ~F.coalesce("oneway", F.lit(False))), "prior": g.class_prior(F.col("road_class"), F.col("road_type"))})


def _candidate_lists(points: DataFrame, roads: DataFrame, k: int) -> DataFrame:
    """One row a point that has candidates, stored: trajectory_id, point_index, lon, lat, heading, points, how many its trajectory has, and near, its ``candidates`` in columns that matching reads."""
    every = F.count(F.lit(1)).over(Window.partitionBy("trajectory_id"))
    rows = headings(points).withColumn("points", every).where("trajectory_id is not null and point_index is not null")
    about = {"road_heading": g.bearing(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), "two_way": ~F.coalesce("oneway", F.lit(False)), "prior": g.class_prior(F.col("road_class"), F.col("road_type"))}
    lists = nearest_lists(rows.select("trajectory_id", "point_index", "lon", "lat", "heading", "points"), roads, k, about=about)
    return lists.where(F.size("near") > 0)


def _sequence(rows: DataFrame) -> Column:
    return F.array_sort(F.collect_list(F.struct("point_index", "road_id")))


def without_repeats(sequence: Column) -> Column:
    """An array without entries that equal the one before."""
    return F.filter(F.transform(sequence, lambda x, i: F.when((i == 0) | (x != F.try_element_at(sequence, i)), x)), lambda x: x.isNotNull())


def matched_sequences(matches: DataFrame, sigma: float | None = None) -> DataFrame:
    """(trajectory_id, matched_road_sequence, confidence) of matches (trajectory_id, point_index, road_id, distance).

    Confidence falls with the mean distance, on a scale of 25 m or of ``sigma``.
    """
    scale = 25.0 if sigma is None else max(sigma, 1.0)
    rows = matches.groupBy("trajectory_id").agg(_sequence(matches).alias("_s"), F.avg("distance").alias("_d"))
    ids = F.transform("_s", lambda x: x["road_id"])
    return rows.select("trajectory_id", without_repeats(ids).alias("matched_road_sequence"), F.round(1.0 / (1.0 + F.col("_d") / scale), 3).alias("confidence"))


def match_nearest(points: DataFrame, roads: DataFrame, k: int = 5) -> DataFrame:
    """The first candidate of every point that has one: trajectory_id, point_index, road_id, distance, plon, plat."""
    near = nearby_roads(points, roads, ["trajectory_id", "point_index"], 1)
    return near.select("trajectory_id", "point_index", "road_id", "distance", "plon", "plat")


def network_distances(roads: DataFrame, pairs: DataFrame, max_cost: float | None = None) -> DataFrame:
    """(prev_road, road, network_m) of distinct pairs of different roads: the shortest way from either end to either end; null without one."""
    ends = roads.select(F.col("id").alias("road"), F.array("from_node", "to_node").alias("ends"))
    wanted = pairs.where("prev_road <> road").select("prev_road", "road").distinct()
    od = wanted.join(ends.select(F.col("road").alias("prev_road"), F.explode("ends").alias("source")), "prev_road").join(ends.select("road", F.explode("ends").alias("node")), "road")
    found = shortest_paths(arcs(roads), od.select("source"), max_cost=max_cost, targets=od.select("source", F.col("node").alias("target"))).select("source", "node", "distance")
    return od.join(found, ["source", "node"], "left").groupBy("prev_road", "road").agg(F.min("distance").alias("network_m"))


def steps(cands: DataFrame, roads: DataFrame, max_cost: float | None = None) -> DataFrame:
    """Candidates with those of the point before: one row for each pair, or one with a null prev_rank at the first point.

    network_m is 0 on one road and null where there is no way.
    """
    order = Window.partitionBy("trajectory_id").orderBy("point_index")
    index = cands.select("trajectory_id", "point_index").distinct().withColumn("prev_index", F.lag("point_index").over(order))
    now = cands.join(index, ["trajectory_id", "point_index"])
    before = cands.select("trajectory_id", F.col("point_index").alias("prev_index"), F.col("cand_rank").alias("prev_rank"), F.col("road_id").alias("prev_road"), F.col("road_heading").alias("prev_heading"), F.col("lon").alias("_plon"), F.col("lat").alias("_plat"))
    pairs = now.join(before, ["trajectory_id", "prev_index"], "left")
    net = network_distances(roads, pairs.where("prev_road is not null").select("prev_road", F.col("road_id").alias("road")), max_cost)
    pairs = pairs.join(net.withColumnRenamed("road", "road_id"), ["prev_road", "road_id"], "left")
    same = F.col("prev_road") == F.col("road_id")
    return pairs.withColumns(
        {
            "network_m": F.when(same, F.lit(0.0)).otherwise(F.col("network_m")),
            "gps_m": g.haversine(F.col("_plon"), F.col("_plat"), F.col("lon"), F.col("lat")),
            "turn": g.turn_penalty(F.col("prev_road"), F.col("prev_heading"), F.col("road_id"), F.col("road_heading")),
        }
    ).drop("_plon", "_plat")


def _with_moves(lists: DataFrame, roads: DataFrame) -> DataFrame:
    """``lists`` with gps_m, the distance from the point before, and moves: for each candidate there the ``network_m`` to each one here, a row after the other.

    -1 stands for one road, null for no way; both columns are null at a first point. Ways
    are looked up once for all steps between the same two lists of roads.
    """
    order = Window.partitionBy("trajectory_id").orderBy("point_index")
    ids = F.transform("near", lambda c: c["road_id"])
    marked = lists.withColumn("ids", ids)
    marked = marked.withColumns({"prev_ids": F.lag("ids").over(order), "gps_m": g.haversine(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat"))})
    steps_between = materialised(marked.where("prev_ids is not null").select("prev_ids", "ids").distinct())
    one = steps_between.select("*", F.posexplode("prev_ids").alias("i", "prev_road")).select("*", F.posexplode("ids").alias("j", "road"))
    net = network_distances(roads, one.select("prev_road", "road"))
    found = one.join(net, ["prev_road", "road"], "left")
    metres = F.when(F.col("prev_road") == F.col("road"), F.lit(-1.0)).otherwise(F.col("network_m"))
    in_order = F.array_sort(F.collect_list(F.struct("i", "j", metres.alias("m"))))
    moves = materialised(found.groupBy("prev_ids", "ids").agg(in_order.alias("m")).select("prev_ids", "ids", F.transform("m", lambda x: x["m"]).alias("moves")))
    return marked.join(moves.hint("merge"), ["prev_ids", "ids"], "left").drop("prev_ids", "ids")


class _Steps(NamedTuple):
    """Whole trajectories one after the other, a row a point; candidates are padded to the longest list."""

    first: np.ndarray
    size: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray
    distance: np.ndarray
    direction: np.ndarray
    prior: np.ndarray
    network: np.ndarray
    gps: np.ndarray
    turn: np.ndarray

    def layers(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Step by step, the trajectories that go on, longest first, and their points."""
        longest = np.argsort(-self.size, kind="stable")
        ordered = -self.size[longest]
        for t in range(int(self.size.max(initial=0))):
            going = longest[: np.searchsorted(ordered, -t, "left")]
            yield going, self.first[going] + t


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(np.mod(a - b + 180.0, 360.0) - 180.0)


def _steps_of(rows: pa.Table) -> _Steps:
    """The numbers of ``_with_moves``, sorted by trajectory and point, in arrays."""
    ids = rows["trajectory_id"].combine_chunks()
    changes = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(ids) > 1 else np.array([], np.int64)
    first = np.concatenate([[0], changes]).astype(np.int64)
    size = np.diff(np.append(first, len(ids)))
    near = rows["near"].combine_chunks()
    flat = near.flatten()
    n = pc.list_value_length(near).to_numpy().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    most = int(n.max(initial=1))
    row, place = np.repeat(np.arange(len(n)), n), np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)

    def padded(name: str) -> np.ndarray:
        out = np.zeros((len(n), most))
        out[row, place] = flat.field(name).to_numpy(zero_copy_only=False)
        return out

    valid, heading, travel = np.zeros((len(n), most), bool), padded("road_heading"), rows["heading"].to_numpy()[:, None]
    valid[row, place] = True
    ahead, back = _angle(heading, travel), _angle(np.mod(heading + 180.0, 360.0), travel)
    direction = np.where(np.isnan(travel), 0.0, np.where(padded("two_way") > 0, np.minimum(ahead, back), ahead) / 180.0)
    lists = rows["moves"].combine_chunks()
    metres = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    began = np.zeros(len(n), bool)
    began[first] = True
    here, before = np.where(began, 0, n), np.where(began, 0, np.concatenate([[0], n[:-1]]))
    pairs = here * before
    at = np.repeat(np.arange(len(n)), pairs)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    network = np.full((len(n), most, most), np.nan)
    network[at, rank // np.maximum(here[at], 1), rank % np.maximum(here[at], 1)] = metres
    same = network == -1.0
    network[same] = 0.0
    turn = np.zeros_like(network)
    turn[1:] = _angle(heading[:-1, :, None], heading[1:, None, :]) / 180.0
    turn[same] = 0.0
    return _Steps(first, size, offsets, valid, padded("distance"), direction, padded("prior"), network, rows["gps_m"].to_numpy(), turn)


def _along(points: DataFrame, moves: DataFrame, choose: Callable[[_Steps], tuple[np.ndarray, np.ndarray]], whole: bool) -> DataFrame:
    """(trajectory_id, point_index, road_id, distance, plon, plat, direction_cost, prior, total_cost) of the candidate that ``choose`` takes at each point.

    ``choose`` gives its place and cost for many trajectories at once, those of a batch of
    rows; one that goes on in the next batch waits for it. With ``whole`` trajectories with
    a point without candidates are left out.
    """
    kind, index = (points.schema[c].dataType.simpleString() for c in ("trajectory_id", "point_index"))
    schema = f"trajectory_id {kind}, point_index {index}, road_id string, distance double, plon double, plat double, direction_cost double, prior double, total_cost double"

    def chosen(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        steps = _steps_of(rows)
        place, cost = choose(steps)
        kept = np.arange(rows.num_rows)
        if whole:
            full = steps.size == rows["points"].to_numpy()[steps.first]
            kept = kept[np.repeat(full, steps.size)]
        at = steps.offsets[:-1] + place
        flat, take = rows["near"].combine_chunks().flatten(), pa.array(at[kept])
        columns = [rows[c].take(pa.array(kept)).combine_chunks() for c in ("trajectory_id", "point_index")] + [flat.field(c).take(take) for c in ("road_id", "distance", "plon", "plat")]
        columns += [pa.array(steps.direction[kept, place[kept]]), flat.field("prior").take(take), pa.array(cost[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["trajectory_id", "point_index", "road_id", "distance", "plon", "plat", "direction_cost", "prior", "total_cost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column("trajectory_id")
            if not len(ids):
                continue
            last = pc.index(pc.equal(ids, ids[-1]), True).as_py()  # where the trajectory begins that may go on
            if last or (waiting and waiting[-1].column("trajectory_id")[-1] != ids[0]):
                ended = [*waiting, *([batch.slice(0, last)] if last else [])]
                yield from chosen(pa.Table.from_batches(ended))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield from chosen(pa.Table.from_batches(waiting))

    return moves.repartition("trajectory_id").sortWithinPartitions("trajectory_id", "point_index").mapInArrow(run, schema)


def match_candidate_cost(points: DataFrame, roads: DataFrame, k: int = 5, weights: tuple[float, ...] = GREEDY) -> DataFrame:
    """The cheapest candidate of each point in turn, given the one chosen before; ties to the nearer, then the smaller road."""

    def choose(s: _Steps) -> tuple[np.ndarray, np.ndarray]:
        place, cost = np.zeros(len(s.valid), np.int64), np.zeros(len(s.valid))
        for t, (_, at) in enumerate(s.layers()):
            connected = turn = 0.0
            if t:
                before = place[at - 1]
                connected, turn = s.network[at, before], s.turn[at, before]
                connected = np.where(np.isnan(connected), UNREACHABLE_M, connected)
            total = weights[0] * s.distance[at] + weights[1] * s.direction[at] + weights[2] * connected + weights[3] * turn + weights[4] * s.prior[at]
            total = np.where(s.valid[at], total, np.inf)
            place[at] = np.argmin(np.round(total, TIE_DIGITS), axis=1)
            cost[at] = total[np.arange(len(at)), place[at]]
        return place, cost

    rows = _along(points, _with_moves(_candidate_lists(points, roads, k), roads), choose, whole=False)
    return rows.select("trajectory_id", "point_index", "road_id", "distance", "plon", "plat", "total_cost")


def _viterbi(layers: list[np.ndarray], emission: np.ndarray, transition: np.ndarray, states: np.ndarray) -> None:
    """Writes to ``states`` the most likely state of each row. ``layers`` are rows of sequences step by step, each of some that the layer before had first; ``transition`` (row, previous, current) belongs to a row and the one before it.

    Ties, to TIE_DIGITS places, go to the first state.
    """
    score, parents = emission.copy(), np.zeros(emission.shape, np.int32)
    for at in layers[1:]:
        total = score[at - 1][:, :, None] + transition[at]
        parents[at] = parent = np.argmax(np.round(total, TIE_DIGITS), axis=1)
        score[at] = np.take_along_axis(total, parent[:, None, :], axis=1)[:, 0, :] + emission[at]
    for at, after in zip(layers[::-1], [layers[0][:0], *layers[:0:-1]], strict=True):
        going, ended = at[: len(after)], at[len(after) :]
        states[going] = parents[after, states[after]]
        states[ended] = np.argmax(np.round(score[ended], TIE_DIGITS), axis=1)


def viterbi(emission: list[np.ndarray], transition: list[np.ndarray]) -> list[int]:
    """The most likely state of each layer; ``transition[t]`` scores (previous, current). Ties, to TIE_DIGITS places, go to the first state."""
    n, most = len(emission), max(map(len, emission))
    e, t, states = np.full((n, most), -np.inf), np.zeros((n, most, most)), np.zeros(n, np.int64)
    for i, row in enumerate(emission):
        e[i, : len(row)] = row
    for i, row in enumerate(transition, 1):
        t[i, : row.shape[0], : row.shape[1]] = row
    _viterbi([np.array([i]) for i in range(n)], e, t, states)
    return states.tolist()


def match_hmm(points: DataFrame, roads: DataFrame, k: int = 5, sigma: float = 20.0, beta: float = 50.0, heading_weight: float = 4.0, class_weight: float = 0.4) -> DataFrame:
    """The most likely sequence of candidates: emission by distance, heading and class, transition by how network and GPS distance differ.

    The class counts in both, as emission and as transition. A trajectory with a point
    without candidates has no result.
    """

    def choose(s: _Steps) -> tuple[np.ndarray, np.ndarray]:
        emission = -0.5 * np.square(s.distance / max(sigma, 1.0)) - heading_weight * s.direction - class_weight * s.prior
        emission = np.where(s.valid, emission, -np.inf)
        move = -np.abs(s.network - s.gps[:, None, None]) / max(beta, 1.0) - 1.5 * s.turn - 0.5 * s.prior[:, None, :]
        states = np.zeros(len(emission), np.int64)
        _viterbi([at for _, at in s.layers()], emission, np.where(np.isnan(s.network), -1e6, move), states)
        return states, np.zeros(len(emission))

    rows = _along(points, _with_moves(_candidate_lists(points, roads, k), roads), choose, whole=True)
    scored = {"emission_prob": F.round(g.emission_score(F.col("distance"), sigma), 4), "heading_cost": F.round("direction_cost", 4), "road_class_prior": F.round("prior", 4)}
    return rows.select("trajectory_id", "point_index", "road_id", "distance", "plon", "plat", *[c.alias(name) for name, c in scored.items()])


def _uniform(seed: int, *what: Column | str | int) -> Column:
    """A number between 0 and 1, both left out, that a seed and these columns decide."""
    named = [F.lit(x) if isinstance(x, int) else x for x in what]
    return (F.pmod(F.xxhash64(F.lit(seed), *named), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _normal(seed: int, *what: Column | str | int) -> Column:
    """A normal deviate from two such numbers, by the Box-Muller transform."""
    return F.sqrt(-2.0 * F.log(_uniform(seed, *what, 1))) * F.cos(2.0 * math.pi * _uniform(seed, *what, 2))


def noisy_traces(routes: DataFrame, samples: int = 4, noise_m: float = 8.0, drift_m: tuple[float, float] = (0.0, 0.0), seed: int = 7) -> DataFrame:
    """(trajectory_id, point_index, lon, lat): noisy drives along many routes (trajectory_id, leg, geometry) at once.

    Each leg gives ``samples`` places at equal steps of the chord between its end vertices,
    both included. A place is displaced by ``drift_m`` metres east and north and a normal
    deviate of ``noise_m`` metres each way, which follows from the seed, the trajectory, the
    leg and the step, so any part of the table can be made anew and comes out the same.
    """
    start, end = F.element_at("geometry", 1), F.element_at("geometry", -1)
    places = routes.select("trajectory_id", "leg", start.alias("a"), end.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("step"))
    share = F.col("step") / F.lit(max(samples - 1, 1))
    along = places.select("trajectory_id", "leg", "step", *[(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share).alias(c) for c in ("lon", "lat")])
    metres = [F.lit(float(drift_m[k])) + F.lit(float(noise_m)) * _normal(seed, "trajectory_id", "leg", "step", k) for k in (0, 1)]
    lon, lat = g.from_local_xy(metres[0], metres[1], F.col("lon"), F.col("lat"))
    index = F.row_number().over(Window.partitionBy("trajectory_id").orderBy("leg", "step")) - 1
    return along.select("trajectory_id", index.cast("int").alias("point_index"), lon.alias("lon"), lat.alias("lat"))


#: Samples a leg, noise, drift to the north or none, and seed of the two standard cases.
TRACE_CASES = {"parallel_roads": (5, 4.0, 18.0, 11), "low_frequency_gps": (2, 10.0, 0.0, 17)}


def trace_cases(routes: DataFrame, drift_m: float | None = None) -> DataFrame:
    """``noisy_traces`` of every route for each of TRACE_CASES, the case in column ``case``; trajectories are named case:route."""
    out = None
    for name, (samples, noise, north, seed) in TRACE_CASES.items():
        named = routes.withColumn("trajectory_id", F.concat(F.lit(f"{name}:"), F.col("trajectory_id").cast("string")))
        part = noisy_traces(named, samples, noise, (0.0, north if drift_m is None or not north else drift_m), seed).withColumn("case", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def repeated(points: DataFrame, times: int) -> DataFrame:
    """Every trajectory driven ``times`` times over as one, with point_index going on; for load tests."""
    size = F.count(F.lit(1)).over(Window.partitionBy("trajectory_id"))
    rows = points.withColumn("_size", size).withColumn("_lap", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    order = Window.partitionBy("trajectory_id").orderBy("_lap", "point_index")
    return rows.withColumn("point_index", (F.row_number().over(order) - 1).cast(points.schema["point_index"].dataType)).drop("_size", "_lap").select(*points.columns)


def trace_rows(spark: SparkSession, rows: list[tuple[str, int, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "trajectory_id string, point_index int, lon double, lat double")


def project_to_chord(points: DataFrame, routes: DataFrame) -> DataFrame:
    """``points`` with plon and plat, their feet on the chord from the first to the last vertex of the route (trajectory_id, leg, geometry) of their trajectory."""
    ends = routes.groupBy("trajectory_id").agg(F.min_by(F.element_at("geometry", 1), "leg").alias("_a"), F.max_by(F.element_at("geometry", -1), "leg").alias("_b"))
    foot = g.segment_projection(F.col("lon"), F.col("lat"), F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"))
    return points.join(ends, "trajectory_id").withColumn("_f", foot).select(*points.columns, "_f.plon", "_f.plat")


def evaluation(sequences: DataFrame, truth: DataFrame) -> DataFrame:
    """(trajectory_id, precision, recall, exact_match, confidence) of matched sequences against truth (trajectory_id, roads).

    Repeats in a row are taken out of the truth first. Precision is the share of matched
    roads that are in the truth, recall the same number over the length of the truth.
    """
    rows = truth.select("trajectory_id", without_repeats(F.col("roads")).alias("truth")).join(sequences, "trajectory_id", "left")
    got = F.coalesce("matched_road_sequence", F.array().cast("array<string>"))
    hits = F.size(F.filter(got, lambda r: F.array_contains("truth", r)))
    share = lambda n: F.when(n > 0, F.round(hits / n, 4)).otherwise(F.lit(0.0))
    return rows.select("trajectory_id", share(F.size(got)).alias("precision"), share(F.size("truth")).alias("recall"), (got == F.col("truth")).alias("exact_match"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
