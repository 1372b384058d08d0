"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import WORD_BYTE, byte_runs, joined, span_hash, prefix_hash, trim, words_of, written

#: Random Fourier features; the normal equations have as many rows and columns, plus one.
FEATURES = 192
#: Tasks whose sums are added at once.
FAN = 32
#: Bins of the raw score in which labels are summed before calibration.
BINS = 2000
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_bytes_sd", "letters", "digits", "spaces", "upper", "non_ascii", "marks", "rare_marks",
    "bars", "exclamations", "word_variety", "top_repeat", "same_next", "line_variety", "short_lines", "upper_words", "marked_words", "ended_lines",
)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` owners: its distinct values, and how often its most frequent value occurs."""
    key = (owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20))
    key, count = np.unique(key, return_counts=True)
    by = (key >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, by, count)
    return np.bincount(by, minlength=n), most


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS for each text, from its whole UTF-8 bytes; an empty text has zeros."""
    data, starts = joined(texts)
    n = len(texts)
    size = np.diff(starts) - 1  # without the line feed that joins
    low, begin, end, first = words_of(data, starts)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    length = (end - begin).astype(np.float64)
    h = prefix_hash(low)
    word = span_hash(h, begin, end)
    mean = _ratio(np.bincount(owner, length, n), count)
    square = _ratio(np.bincount(owner, length**2, n), count)
    variety, most = _distinct(owner, word, n)
    same = np.concatenate([(word[1:] == word[:-1]) & (owner[1:] == owner[:-1]), [False]]) if len(word) else np.zeros(0, bool)
    letters = ((low >= 97) & (low <= 122)) | (data >= 128)
    upper = (data >= 65) & (data <= 90)
    digits, spaces = (data >= 48) & (data <= 57), (data == 32) | (data == 10) | (data == 9) | (data == 13)
    marks = ~WORD_BYTE[low] & ~spaces
    usual = (data == 44) | (data == 46) | (data == 39) | (data == 45) | (data == 58) | (data == 59) | (data == 63) | (data == 34) | (data == 40) | (data == 41)
    line_end = np.flatnonzero(data == 10)
    line_begin = np.concatenate([[0], line_end[:-1] + 1])
    line_owner = np.searchsorted(starts, line_begin, side="right") - 1
    full = line_end > line_begin
    line_begin, line_end, line_owner = line_begin[full], line_end[full], line_owner[full]
    lines = np.bincount(line_owner, minlength=n)
    line_variety, _ = _distinct(line_owner, span_hash(h, line_begin, line_end), n)
    per_line = lambda flags: _ratio(np.bincount(line_owner, flags, n), lines)
    per_byte = lambda flags: _ratio(_sums(flags, starts).astype(np.float64), size)
    per_word = lambda flags: _ratio(np.bincount(owner, flags, n), count)
    capital = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    last = data[np.maximum(line_end - 1, 0)]
    after = low[np.minimum(end, len(low) - 1)] if len(end) else np.zeros(0, np.uint8)
    odd_after = marks[np.minimum(end, len(low) - 1)] & ~usual[np.minimum(end, len(low) - 1)] if len(end) else after.astype(bool)
    columns = [
        np.log1p(size), np.log1p(count), np.log1p(lines), mean, np.sqrt(np.maximum(square - mean**2, 0)), per_byte(letters), per_byte(digits), _ratio((_sums(spaces, starts) - 1).astype(np.float64), size),
        per_byte(upper), per_byte(data >= 128), per_byte(marks), per_byte(marks & ~usual), per_byte(data == 124), per_byte(data == 33), _ratio(variety, np.sqrt(np.maximum(count, 1))) / 10, _ratio(most, count),
        per_word(same), _ratio(line_variety, lines), per_line(line_end - line_begin < 20), per_word((capital[end] - capital[begin] > 1) & (capital[end] - capital[begin] >= 0.6 * length)), per_word(odd_after), per_line(last == 46),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class QualityModel:
    """Scaling, the random features, ridge weights, and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    seed: int = 7
    width: float = 4.0
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        w, b = rng.normal(size=(d, FEATURES)) / self.width, rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The rising step function that lies closest to the share of positives: pools adjacent violators."""
    level: list[list[float]] = []
    for n, p in zip(total.tolist(), positive.tolist(), strict=True):
        level.append([p, n, 1])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            p2, n2, c2 = level.pop()
            level[-1] = [level[-1][0] + p2, level[-1][1] + n2, level[-1][2] + c2]
    return np.concatenate([np.full(int(c), p / n) for p, n, c in level]) if level else np.zeros(0)


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats): STATISTICS of every row's whole text; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_runs(pc.binary_length(batch.column(1)).to_pylist()):
                stats = statistics(batch.column(1).slice(a, b - a).to_pylist())
                offsets = pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(stats.ravel()))], names=["doc_id", "stats"])
        trim()

    return rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(df: DataFrame, width: int) -> np.ndarray:
    """The sum of the ``v`` arrays of all rows, a tree: in each task, then FAN tasks' sums at a time, until few are left to add here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for v in batch.column(0):
                total += v.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    tasks = df.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        df = df.repartition(tasks).mapInArrow(add, "v array<double>")
    parts = df.collect()  # FAN rows of fixed size at most
    return np.sum([np.array(p[0]) for p in parts], axis=0) if parts else np.zeros(width)


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", ridge: float = 1e-3) -> QualityModel:
    """A model from the rows of ``stats`` that have a label 0 or 1 in ``labels``.

    All labelled rows count; their statistics are joined with the labels and written once.
    Each task sums its part of the normal equations, a matrix of fixed size; the sums of
    tasks are added in a tree, and a few of them reach the driver. Scaling and calibration use sums of fixed size too. Rows with a null id or
    label are not used; a document with several labels counts once for each. Without any
    label the score is 0.5.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    rows = written(stats.join(known, "doc_id").select("stats", "y"))
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * d + 1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                total += np.concatenate([x.sum(axis=0), (x**2).sum(axis=0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    total = _summed(rows.mapInArrow(moments, "v array<double>"), 2 * d + 1)
    n = max(total[-1], 1.0)
    mean = total[:d] / n
    model = QualityModel(mean, np.sqrt(np.maximum(total[d : 2 * d] / n - mean**2, 1e-9)) + 1e-6)
    if not total[-1]:
        return model
    k = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column(0)))
                left += z.T @ z
                right += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([left.ravel(), right])], pa.list_(pa.float64()))], names=["v"])

    total = _summed(rows.mapInArrow(equations, "v array<double>"), k * k + k)
    penalty = ridge * n * np.eye(k) / FEATURES
    penalty[-1, -1] = 0
    fitted = QualityModel(model.mean, model.scale, model.seed, model.width, np.linalg.solve(total[: k * k].reshape(k, k) + penalty + 1e-9 * np.eye(k), total[k * k :]))
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BINS)
        for batch in batches:
            if batch.num_rows:
                i = np.clip(np.searchsorted(edges, fitted.raw(_matrix(batch.column(0)))) - 1, 0, BINS - 1)
                total += np.concatenate([np.bincount(i, minlength=BINS), np.bincount(i, batch.column(1).to_numpy(), BINS)])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    total = _summed(rows.mapInArrow(histogram, "v array<double>"), 2 * BINS)
    has = total[:BINS] > 0
    fitted.knots = (edges[:-1] + edges[1:])[has] / 2
    fitted.values = isotonic(total[:BINS][has], total[BINS:][has])
    return fitted


def scored(stats: DataFrame, model: QualityModel, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``stats``."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(predict, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def score_column(model: QualityModel, text: Column) -> Column:
    """The score of a text column in place, for filters that should move nothing."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        parts = [model.score(statistics(values[a:b])) for a, b in byte_runs((len(t or "") for t in values))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def keep(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, whose score, learned from all ``labels``, reaches ``threshold``.

    Every row is judged by its text alone, so null ids and repeated rows need no care. The
    texts are measured twice, once to learn and once to filter, and never shuffled.
    """
    model = fit(written(text_statistics(docs, id_col=id_col, text_col=text_col)), labels, id_col=id_col, label_col=label_col)
    return docs.where(score_column(model, F.col(text_col)) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, trained: Column, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, learned from the labels where ``trained`` (a condition on their id) holds.

    Inputs of a score are statistics of the whole text and nothing else. Null texts count
    as empty and get a score like any text. Null ids and repeated rows stay as they are,
    one row out for each row in; an empty table gives an empty result; other columns are
    not read. The statistics, a row of numbers for each document, are written to the shared
    folder once, so texts are read once.
    """
    stats = written(text_statistics(docs, id_col=id_col, text_col=text_col))
    return scored(stats, fit(stats, labels.where(trained), id_col=id_col, label_col=label_col), threshold=threshold)
