"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics come from the bytes of each whole text. cos(W z + b) of the standardised statistics z approximates a
Gaussian kernel. The normal equations are summed over partitions, solved once (their size is fixed), and the raw
scores of the same rows, counted in fixed bins, are made monotone by pooling adjacent violators.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, written
from .wordhash import chunks, hashes, spans

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "stop", "beyond_ascii", "repeat", "distinct", "log_line", "repeated_lines", "marked_words")
WIDTH = 256  # random features
SPREAD = 0.35  # of the kernel: W is normal with this deviation
RIDGE = 1e-3  # for each row
BINS = 2000
_CLASS = {
    "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digit": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "symbol": np.isin(np.arange(256), list(b"#$%&*!@^~|<>{}[]=_+\\/")),
    "stop": np.isin(np.arange(256), list(b".,;:?")),
    "beyond_ascii": np.arange(256) >= 128,
}


def _per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[edges[1:]] - sums[edges[:-1]]


def _repeats(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many values of each row stand there earlier already."""
    row = np.repeat(np.arange(len(n) - 1), np.diff(n))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (row[1:] == row[:-1]))) if len(h) else np.zeros(0, bool)
    return np.bincount(row[again], minlength=len(n) - 1)


def statistics(col) -> np.ndarray:
    """One row of FEATURES for each text; null counts as empty, whose features are all 0."""
    out = []
    for _, _, data, off in chunks(col):
        s, e, n = spans(data, off)
        h = hashes(data, s, e)
        words, size = np.diff(n), np.diff(off)
        some, most = np.maximum(words, 1), np.maximum(size, 1)
        f = {name: _per_row(where[data], off) / most for name, where in _CLASS.items()}
        f["log_words"] = np.log1p(words)
        f["word_length"] = _per_row(e - s, n) / some
        same = np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
        same[n[:-1][n[:-1] < len(h)]] = False
        f["repeat"] = _per_row(same, n) / some
        f["distinct"] = 1 - _repeats(h, n) / some
        marks = np.concatenate(([0], np.cumsum(_CLASS["symbol"][data], dtype=np.int64)))
        f["marked_words"] = _per_row(marks[e] > marks[s], n) / some
        line_start = np.unique(np.concatenate((off[:-1][size > 0], np.flatnonzero(data == 10) + 1)))
        line_start = line_start[line_start < len(data)]
        line_end = np.concatenate((line_start[1:], [len(data)])) if len(line_start) else line_start
        lines = np.searchsorted(line_start, off)
        f["log_line"] = np.log1p(size / np.maximum(np.diff(lines), 1))
        f["repeated_lines"] = _repeats(hashes(data, line_start, line_end), lines) / np.maximum(np.diff(lines), 1)
        f["distinct"][words == 0] = 0
        out.append(np.column_stack([f[name] for name in FEATURES]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # of the random features and the constant
    level: np.ndarray  # calibrated score of each bin

    def raw(self, x: np.ndarray) -> np.ndarray:
        return random_features(np.clip((x - self.mean) / self.deviation, -8, 8)) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.level[bins(self.raw(x))]


def random_features(z: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(20240)
    w, b = rng.normal(0, SPREAD, (z.shape[1], WIDTH)), rng.uniform(0, 2 * np.pi, WIDTH)
    return np.column_stack((np.sqrt(2 / WIDTH) * np.cos(z @ w + b), np.ones(len(z))))


def bins(raw: np.ndarray) -> np.ndarray:
    """Fixed bins of raw scores from -0.5 to 1.5."""
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The non-decreasing levels closest to good / total; empty bins take the level below, the lowest the first."""
    blocks: list[list[float]] = []
    for at in np.flatnonzero(total):
        blocks.append([good[at], total[at], at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, n, _ = blocks.pop()
            blocks[-1][0] += g
            blocks[-1][1] += n
    if not blocks:
        return np.full(len(total), 0.5)
    starts, levels = np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
    return levels[np.maximum(np.searchsorted(starts, np.arange(len(total)), "right") - 1, 0)]


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def described(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `x`, the statistics of each whole text."""
    ready(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", x array<double>"

    def read(batches):
        for batch in batches:
            x = statistics(batch.column(batch.num_columns - 1))
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    return kept.mapInArrow(read, schema)


def _matrix(batch, i: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy().reshape(-1, len(FEATURES))


def fit(rows: DataFrame) -> Model:
    """The model of labelled rows (x, y), y being 0 or 1. Without rows its score is 0.5 everywhere."""
    d = len(FEATURES)
    sums = rows.select(F.count("y"), *[F.sum(F.col("x")[i]) for i in range(d)], *[F.sum(F.col("x")[i] * F.col("x")[i]) for i in range(d)]).first()
    n = sums[0]
    if not n:
        return Model(np.zeros(d), np.ones(d), np.zeros(WIDTH + 1), np.full(BINS, 0.5))
    mean = np.array(sums[1 : d + 1]) / n
    deviation = np.sqrt(np.maximum(np.array(sums[d + 1 :]) / n - mean**2, 0))
    model = Model(mean, np.where(deviation > 1e-9, deviation, 1), np.zeros(WIDTH + 1), np.zeros(BINS))
    size = WIDTH + 1
    upper = np.triu_indices(size)

    def equations(batches):
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = random_features(np.clip((_matrix(batch, 0) - model.mean) / model.deviation, -8, 8))
            gram += z.T @ z
            right += z.T @ batch.column(1).to_numpy().astype(float)
        values = np.concatenate((gram[upper], right))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    summed = rows.select("x", "y").mapInArrow(equations, "at long, value double").groupBy("at").agg(F.sum("value"))
    values = np.zeros(len(upper[0]) + size)
    for at, value in summed.collect():  # WIDTH**2 / 2 numbers, whatever the input
        values[at] = value
    gram = np.zeros((size, size))
    gram[upper] = values[: len(upper[0])]
    gram += np.triu(gram, 1).T
    model.weights = np.linalg.solve(gram + RIDGE * n * np.eye(size) / size, values[len(upper[0]) :])

    def binned(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bins(model.raw(_matrix(batch, 0)))), batch.column(1).cast(pa.int64())], names=["bin", "y"])

    counts = np.zeros((2, BINS))
    for at, total, good in rows.select("x", "y").mapInArrow(binned, "bin long, y long").groupBy("bin").agg(F.count("y"), F.sum("y")).collect():
        counts[:, at] = total, good
    model.level = isotonic(*counts)
    return model


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    """The model of the labelled documents outside the held-out fold."""
    learnt = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = labels.select(F.col(id_col).alias("__id"), F.col("quality").alias("y")).where("y in (0, 1)")
    rows = described(learnt, text, (id_col,))
    return fit(written(rows.join(known, rows[id_col] == known["__id"]).select("x", "y"), "labelled"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each document: id, held_out, score and predicted.

    labels has the id and `quality`; rows whose label is neither 0 nor 1 are not learnt from, and neither are those
    whose crc32 of the id as text is divisible by 5. A document whose id is repeated, or labelled more than once, is
    learnt from each time. Null ids are scored and never learnt from. Empty and null texts get the model's score
    of no statistics. An empty table gives no rows. Without labels every score is 0.5.
    """
    model = trained(docs, labels, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1))))], names=["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(read, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, unchanged, whose score reaches the threshold."""
    model, place = trained(docs, labels, id_col, text), docs.columns.index(text)

    def read(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column(place))) >= threshold))

    return docs.mapInArrow(read, docs.schema)
