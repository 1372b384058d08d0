"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import byte_runs, joined_by_key, mix64, random_table, row_key, trim, written

#: Characters of an n-gram. A character is a lower-case letter of any script, or 0 for a run of anything else.
ORDER = 4
#: What a letter that a language never had may be: any code point.
CODE_POINTS = 0x110000
#: Training rows that calibrate the score, in expectation; the final model counts them too.
CALIBRATION_ROWS = 4096
#: Entries of a model that is sent to every task, some 16 bytes each. A larger one stays a table, and n-grams are joined with it.
BROADCAST_ENTRIES = 8_000_000
#: Steps of a margin's logarithm in which calibration rows are summed.
STEPS = 256
#: Keys of a batch's n-grams that are found by a table instead of by sorting.
TABLE_BITS = 24
UNDETERMINED = "und"
_TABLE: list[np.ndarray] = []
_FACTORS = random_table(ORDER, 29) | np.uint64(1)


def symbol_table() -> np.ndarray:
    """The symbol of each code point, made once in a worker: the lower-case letter's own code point, 0 for anything but letters."""
    if not _TABLE:
        table = np.zeros(CODE_POINTS, np.uint32)
        letters = np.array([i for i in range(CODE_POINTS) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()])
        table[letters] = [ord(c) if len(c := chr(i).lower()) == 1 else i for i in letters.tolist()]
        _TABLE.append(table)
    return _TABLE[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, a row of ORDER symbols each, and where each text's begin (with the end).

    Other characters count as one boundary for a run; each text begins with one. An n-gram
    at the start of a text is padded with boundaries. A text without a letter has none.
    """
    joined = "\n" + "\n".join(t or "" for t in texts)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = symbol_table()[points]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    first = np.zeros(len(symbols), bool)
    first[begin] = True
    keep = (symbols != 0) | first
    keep[1:] |= symbols[:-1] != 0
    at = np.flatnonzero(keep)
    symbols = symbols[at]
    starts = np.append(np.searchsorted(at, begin), len(at))
    distance = np.arange(len(symbols)) - np.repeat(starts[:-1], np.diff(starts))
    grams = np.zeros((len(symbols), ORDER), np.uint32)
    grams[:, -1] = symbols
    for k in range(1, ORDER):
        grams[k:, -1 - k] = symbols[:-k]
        grams[distance < k, -1 - k] = 0
    return grams[distance > 0], starts - np.arange(len(starts))  # the boundary that begins a text is context only


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``grams`` and which of them each row is.

    The symbols that occur are numbered, so that a row fits a small key: where keys are few
    enough a table finds them, else sorting does.
    """
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    held = np.bincount(grams[:, -1])
    held[0] += 1  # the boundary before a text
    used = np.flatnonzero(held)
    bits = max(1, (len(used) - 1).bit_length())
    if ORDER * bits > 64:
        return np.unique(grams, axis=0, return_inverse=True)
    place = np.zeros(len(held), np.uint64 if ORDER * bits > 32 else np.uint32)
    place[used] = np.arange(len(used))
    key, shift = np.zeros(len(grams), place.dtype), place.dtype.type(bits)
    for k in range(ORDER):
        key = key << shift | place[grams[:, k]]
    if ORDER * bits <= TABLE_BITS:
        there = np.zeros(1 << ORDER * bits, bool)
        there[key] = True
        keys = np.flatnonzero(there)
        rank = np.empty(len(there), np.uint32)
        rank[keys] = np.arange(len(keys))
        which = rank[key]
    else:
        keys = np.unique(key)
        which = np.searchsorted(keys, key)
    keys = keys.astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    rows = [used[(keys >> np.uint64(bits * (ORDER - 1 - k)) & mask).astype(np.int64)] for k in range(ORDER)]
    return np.stack(rows, axis=1).astype(np.uint32), which


def packed(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of four symbols as two longs, two symbols each."""
    wide = grams.astype(np.int64)
    return wide[:, 0] << 32 | wide[:, 1], wide[:, 2] << 32 | wide[:, 3]


def unpacked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.stack([high >> 32, high & 0xFFFFFFFF, low >> 32, low & 0xFFFFFFFF], axis=1).astype(np.uint32)


def hashes(grams: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """64-bit keys of the last 1, 2, ... ORDER symbols of each row, and of the same without the very last symbol."""
    mixed = mix64(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    whole, context = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
    keys, before = [], []
    for k in range(ORDER):
        whole = whole + _FACTORS[k] * mixed[:, -1 - k]
        if k:
            context = context + _FACTORS[k - 1] * mixed[:, -1 - k]
        keys.append(mix64(whole + np.uint64(k + 1)).view(np.int64))
        before.append(mix64(context + np.uint64(k)).view(np.int64))
    return keys, before


class SortedHash:
    """Values by key in sorted arrays; a key that is not held has ``missing``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.append(values[order], missing).astype(np.float64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.values[-1])
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[np.where(self.keys[i] == keys, i, -1)]


class KneserNey:
    """Interpolated Kneser-Ney of one language: for each order the discounted shares of n-grams and the weights of contexts."""

    def __init__(self, shares: list[SortedHash], weights: list[SortedHash]):
        self.shares, self.weights = shares, weights

    def probability(self, keys: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Of the last symbol of each n-gram (see ``hashes``) after the others."""
        p = np.full(len(keys[0]), 1.0 / CODE_POINTS)
        for k in range(ORDER):
            p = self.shares[k].get(keys[k]) + self.weights[k].get(before[k]) * p
        return p


@dataclass
class LanguageModel:
    """Models by language, as sorted arrays or, where they are too many entries to send, as a stored table; calibration.

    ``table`` has lang, level (order times two, less one for contexts), key, value.
    """

    languages: list[str] = field(default_factory=list)
    models: list[KneserNey] = field(default_factory=list)
    table: DataFrame | None = None
    slope: float = 2.0
    intercept: float = 0.0
    reject_below: float = 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each text (rows) under each language (columns), and the texts' numbers of symbols."""
        grams, starts = ngrams(texts)
        n = np.diff(starts)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(grams) or not self.languages:
            return out, n
        single, which = distinct(grams)
        keys, before = hashes(single)
        has = n > 0
        for k, model in enumerate(self.models):
            cost = -np.log(model.probability(keys, before))
            out[has, k] = np.add.reduceat(cost[which], starts[:-1][has])
        out[has] /= n[has, None]
        return out, n

    def margins(self, cost: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its cross-entropy, and how much more the next one costs (times the square root of the length)."""
        if not self.languages:
            return np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
        best = np.argmin(cost, axis=1)
        lowest = cost[np.arange(len(cost)), best]
        rest = cost.copy()
        rest[np.arange(len(cost)), best] = np.inf
        gap = rest.min(axis=1) - lowest if len(self.languages) > 1 else np.ones(len(cost))
        return best, lowest, gap * np.sqrt(n)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.log1p(np.maximum(margin, 0)) + self.intercept, -30, 30)))

    def calibrate(self, margin: np.ndarray, hits: np.ndarray, misses: np.ndarray, precision: float) -> None:
        """Platt scaling of the margin's logarithm by Newton steps, then the lowest score above which ``precision`` of the answers are right.

        ``hits`` and ``misses`` say how many rows have each margin.
        """
        total = hits + misses
        if not total.sum():
            return
        y = np.array([(hits.sum() + 1) / (hits.sum() + 2), 1 / (misses.sum() + 2)])
        x = np.stack([np.log1p(np.maximum(margin, 0)), np.ones(len(margin))], axis=1)
        prior = np.array([2.0, 0.0])  # keeps the score a function of the margin where no answer is wrong
        chance = lambda w: np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-13, 1 - 1e-13)
        want = hits * y[0] + misses * y[1]
        loss = lambda w, p: -np.sum(want * np.log(p) + (total - want) * np.log1p(-p)) + np.sum((w - prior) ** 2) / 2
        w = prior.copy()
        for _ in range(50):
            p = chance(w)
            step = np.linalg.solve((x * (total * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (total * p - want) + w - prior)
            while loss(w - step, chance(w - step)) > loss(w, p) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.intercept = max(float(w[0]), 0.0), float(w[1])
        score = self.score(margin)
        order = np.argsort(-score, kind="stable")
        good = np.cumsum(hits[order]) / np.cumsum(total[order])
        ok = np.flatnonzero(good >= precision)
        self.reject_below = float(score[order[ok[-1]]]) if len(ok) else 1.0


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, high, low, held, n): how often each n-gram occurs in the texts of a language, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, ...]] = {}

        def grouped(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((low, high))
            high, low, n = high[order], low[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
            return high[first], low[first], np.add.reduceat(n, first) if len(first) else n

        for batch in batches:
            for lang, held in {*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}:
                own = batch.column(2).filter(pc.and_(pc.equal(batch.column(0), lang), pc.equal(batch.column(1), held)))
                for a, b in byte_runs(pc.binary_length(own).to_pylist(), 1 << 22):
                    single, which = distinct(ngrams(own.slice(a, b - a).to_pylist())[0])
                    got = (*packed(single), np.bincount(which, minlength=len(single)))
                    sums[lang, held] = got if (lang, held) not in sums else grouped(*map(np.concatenate, zip(sums[lang, held], got, strict=True)))
        for (lang, held), (high, low, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([held] * len(n), pa.bool_()), pa.array(high), pa.array(low), pa.array(n)], names=["lang", "held", "high", "low", "n"])
        trim()

    parts = rows.select("lang", "held", "text").mapInArrow(count, "lang string, held boolean, high long, low long, n long")
    return parts.groupBy("lang", "high", "low", "held").agg(F.sum("n").alias("n"))


_KEYS = [f"{c}{k}" for k in range(1, ORDER + 1) for c in "kc"]


def _keyed(grams: DataFrame) -> DataFrame:
    """``grams`` (with high, low) and the keys k1, c1, ... of ``hashes``."""
    names = grams.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, before = hashes(unpacked(batch.column(names.index("high")).to_numpy(), batch.column(names.index("low")).to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for pair in zip(keys, before, strict=True) for x in pair]], names=[*names, *_KEYS])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grams.schema)
    return grams.mapInArrow(add, schema + "".join(f", {k} long" for k in _KEYS))


def _entries(counts: DataFrame) -> DataFrame:
    """(lang, level, key, value) of interpolated Kneser-Ney from counts of the longest n-grams (lang, high, low, n).

    Shorter n-grams count how many different symbols come before them. Level 2k has the
    discounted shares of n-grams of k symbols, 2k - 1 the weights of their contexts.
    """
    rows = _keyed(counts.groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))).drop("high", "low")
    orders = [rows]
    for k in range(ORDER - 1, 0, -1):
        orders.append(orders[-1].groupBy("lang", *_KEYS[: 2 * k]).agg(F.count(F.lit(1)).alias("n")))
    every = None
    for k, part in zip(range(ORDER, 0, -1), orders, strict=True):
        part = part.select("lang", F.lit(k).alias("k"), F.col(f"k{k}").alias("key"), F.col(f"c{k}").alias("context"), "n")
        every = part if every is None else every.unionByName(part)
    every = written(every)
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    discount = every.groupBy("lang", "k").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(F.lit(0.5)).alias("d"))
    contexts = every.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(discount, ["lang", "k"])
    shares = every.join(contexts, ["lang", "k", "context"]).select("lang", (2 * F.col("k")).alias("level"), "key", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value"))
    weights = contexts.select("lang", (2 * F.col("k") - 1).alias("level"), F.col("context").alias("key"), (F.col("d") * F.col("kinds") / F.col("total")).alias("value"))
    return written(shares.unionByName(weights))


def _model(counts: DataFrame) -> LanguageModel:
    """The models of all languages of ``counts``; sorted arrays if their entries, counted first, may be sent to every task."""
    entries = _entries(counts)
    languages = sorted(r["lang"] for r in entries.select("lang").distinct().collect())  # names only
    model = LanguageModel(languages, table=entries)
    if entries.count() <= BROADCAST_ENTRIES:
        got = entries.toArrow()
        lang, level, key, value = (got[c].to_numpy() for c in ("lang", "level", "key", "value"))
        for name in languages:
            own = lang == name
            part = lambda x, own=own: SortedHash(key[own & (level == x)], value[own & (level == x)], 0.0 if x % 2 == 0 else 1.0)
            model.models.append(KneserNey([part(2 * k) for k in range(1, ORDER + 1)], [part(2 * k - 1) for k in range(1, ORDER + 1)]))
    return model


def _costs_by_join(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(key, cost, n) of ``rows`` (key, text; a key once): ``cross_entropy`` where the model is a table.

    Each document sends its distinct n-grams; the distinct ones of all documents meet the
    entries on their keys, which gives an array of costs, one for each language; arrays go
    back to the documents and add up. A very frequent n-gram is dealt into parts.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                grams, _ = ngrams([text])
                if len(grams):
                    single, which = distinct(grams)
                    high, low = packed(single)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(high), pa.binary()), pa.array(high), pa.array(low), pa.array(np.bincount(which).astype(np.int64))], names=["key", "high", "low", "n"])

    parts = written(rows.select("key", "text").mapInArrow(cut, "key binary, high long, low long, n long"))
    asked = _keyed(parts.groupBy("high", "low").agg(F.count(F.lit(1)).alias("size")))
    level = F.explode(F.array(*[F.struct(F.lit(2 * k - (c == "c")).alias("level"), F.col(f"{c}{k}").alias("key")) for k in range(1, ORDER + 1) for c in "kc"]))
    asked = asked.select("high", "low", "size", level.alias("l")).select("high", "low", "size", "l.*")
    place = F.map_from_arrays(F.array(*map(F.lit, model.languages)), F.array(*map(F.lit, range(len(model.languages)))))
    floor = model.table.where("level = 1").select(place[F.col("lang")].alias("i"), "value")
    floors = floor.agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("f")).first()["f"]  # the weight of no context, a number for each language
    met = asked.where("level > 1").join(model.table.where("level > 1").select(place[F.col("lang")].alias("i"), "level", "key", "value"), ["level", "key"], "left")
    found = met.groupBy("high", "low", "size").agg(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "level", "value"))).alias("e"))
    low = F.array(*[F.lit(f["value"]) for f in floors])
    at = lambda i, x, none: F.coalesce(F.try_element_at(F.filter("e", lambda e: (e["i"] == i) & (e["level"] == x)), F.lit(1))["value"], F.lit(none))

    def cost(w1: Column, i: Column) -> Column:
        p = at(i, 2, 0.0) + w1 / CODE_POINTS
        for k in range(2, ORDER + 1):
            p = at(i, 2 * k, 0.0) + at(i, 2 * k - 1, 1.0) * p
        return -F.log(p)

    priced = written(found.select("high", "low", "size", F.transform(low, cost).alias("costs")))
    total = parts.count()
    back = joined_by_key(parts, priced, ["high", "low"], "size", total, F.col("key"))
    each = back.select("key", "n", F.posexplode("costs").alias("i", "cost")).groupBy("key", "i").agg(F.sum(F.col("n") * F.col("cost")).alias("cost"), F.sum("n").alias("n"))
    return each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("cost") / F.col("n")).alias("cost")))), lambda x: x["cost"]).alias("cost"), F.max("n").alias("n"))


def _costs(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows`` (any columns, then text) with cost (an array, one for each language) and n, the number of symbols, in place of the text."""
    names = rows.columns[:-1]
    if len(model.models) < len(model.languages):
        held = written(rows.withColumn("_key", row_key(rows.columns[0], "text")))
        found = _costs_by_join(held.groupBy("_key").agg(F.any_value("text").alias("text")).withColumnRenamed("_key", "key"), model)
        out = held.drop("text").join(found.withColumnRenamed("key", "_key").hint("merge"), "_key", "left").drop("_key")
        return out.select(*names, F.coalesce("cost", F.array_repeat(F.lit(0.0), len(model.languages))).alias("cost"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a, b in byte_runs((x or 0 for x in pc.binary_length(batch.columns[-1]).to_pylist()), 1 << 21):
                part = batch.slice(a, b - a)
                cost, n = model.cross_entropy(part.columns[-1].to_pylist())
                offsets = pa.array(np.arange(0, cost.size + 1, max(cost.shape[1], 1), dtype=np.int32) if cost.shape[1] else np.zeros(len(cost) + 1, np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(cost.ravel())), pa.array(n.astype(np.int64))], names=[*names, "cost", "n"])
        trim()

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(measure, f"{schema}cost array<double>, n long")


def _judged(costs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``_costs`` with _best (the language's place), _lowest and _margin, see ``LanguageModel.margins``."""
    lowest = F.array_min("cost")
    ordered = F.array_sort("cost")
    gap = F.try_element_at(ordered, F.lit(2)) - lowest if len(model.languages) > 1 else F.lit(1.0)
    return costs.withColumns({"_best": F.array_position("cost", lowest), "_lowest": lowest, "_margin": gap * F.sqrt("n")})


def train(docs: DataFrame, trained: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", precision: float = 0.99) -> LanguageModel:
    """A model from the rows where ``trained`` holds and text and language are known.

    Every such row is counted. About ``CALIBRATION_ROWS`` of them (by a hash of id and text)
    are left out of a first model, which they calibrate; the final model counts them as
    well. A language that only such rows have is known to the final model only. N-grams are
    counted in each task before the shuffle, and discounts, shares and weights are computed
    as tables. What reaches the driver is the languages' names, sums of calibration rows by
    margin, and a model's entries where there are few enough to be sent to every task.
    Rows with a null language or text are not used; without any the model has no language.
    """
    rows = docs.where(trained & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    every = max(4, -(-docs.count() // CALIBRATION_ROWS))
    held = F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0
    counts = written(_counted(rows.withColumn("held", held)))
    first = _model(counts.where("not held"))
    final = _model(counts) if not counts.where("held").isEmpty() else first
    if first.languages:
        seen = _judged(_costs(rows.where(held).select("lang", "text"), first), first).where("n > 0")
        right = F.element_at(F.array(*map(F.lit, first.languages)), F.col("_best").cast("int")) == F.col("lang")
        sums = seen.select(F.round(F.log1p(F.greatest("_margin", F.lit(0.0))) * STEPS).cast("int").alias("step"), right.alias("right"))
        sums = sums.groupBy("step").agg(F.count_if("right").alias("hits"), F.count_if(~F.col("right")).alias("misses")).orderBy("step").toPandas()  # a row for each step
        final.calibrate(np.expm1(sums["step"].to_numpy() / STEPS), sums["hits"].to_numpy(), sums["misses"].to_numpy(), precision)
    return final


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every row, and the ``extra`` columns.

    The prediction is the language of lowest cross-entropy per symbol over the whole text;
    ties go to the first name. ``score`` is the calibrated chance that it is right,
    ``rejected`` says that it lies below the calibrated limit. Null texts and texts without
    a letter are ``und`` with score 0, and so is everything if the model has no language.
    Null ids and repeated rows stay as they are; an empty table gives an empty result;
    other columns are not read, whatever their names.
    """
    extra = extra or {}
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in extra.items()], F.col(text_col).alias("text"))
    got = _judged(_costs(rows, model), model)
    known = (F.col("n") > 0) & F.lit(bool(model.languages))
    name = F.try_element_at(F.array(*map(F.lit, model.languages)).cast("array<string>"), F.col("_best").cast("int"))
    z = F.lit(model.slope) * F.log1p(F.greatest("_margin", F.lit(0.0))) + F.lit(model.intercept)
    score = F.when(known, 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).otherwise(F.lit(0.0))
    out = got.select("doc_id", F.when(known, name).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"), F.when(known, F.col("_lowest")).otherwise(F.lit(0.0)).alias("cross_entropy"), *extra)
    return out.select("doc_id", "lang_pred", "score", "cross_entropy", ((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < F.lit(model.reject_below))).alias("rejected"), *extra)
