"""Quality classifier on document statistics.

Method: random Fourier features approximate a Gaussian kernel over standardised statistics of a text; every partition sums
its share of the normal equations, the sums are added in two steps, and the ridge weights solve them. The raw scores of the
training rows are then binned, and an isotonic fit (pool adjacent violators over the bins) turns scores into
probabilities. Only text goes into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.textarrays import SPACE, add_in_tree, bounded, chunks, mix, released, small_batches, words
from tessella.plans.shared import materialize

#: Random features.
FEATURES = 256
#: Width of the Gaussian kernel in units of a statistic's standard deviation, for all statistics together.
WIDTH = 3.0
RIDGE = 1e-3
#: Bins of raw scores for the isotonic fit.
BINS = 512
NAMES = ["log_chars", "log_words", "word_mean", "word_std", "upper", "digit", "symbol", "sentence", "high", "space", "newline", "bar", "distinct_words", "repeated_symbols", "odd_words", "line_mean", "repeated_lines", "end_mark"]

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[x for x in b"!#$%&()*+/;<=>?@[\\]^_`{|}~\"'-:"]] = 3
_KIND[[x for x in b".,"]] = 4
_KIND[128:] = 5
_KIND[np.flatnonzero(SPACE)] = 6


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for every text; null is empty, and an empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for row, data, offsets in chunks(texts):
        n = np.diff(offsets)
        m = len(n)
        size = np.maximum(n, 1)

        def per_row(mask: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)))
            return total[offsets[1:]] - total[offsets[:-1]]

        kind = _KIND[data]
        hashes, length, first = words(data, offsets)
        count = np.diff(first)
        some = np.maximum(count, 1)
        owner = np.repeat(np.arange(m), count)
        mean = np.bincount(owner, length, m) / some
        std = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, m) / some - mean**2, 0))
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.zeros(0, bool)
        distinct = np.bincount(o[new], minlength=m)
        # The last byte of a word: how many words end in a symbol, and how many in the commonest way to.
        # A row's end ends a word, and its first byte repeats nothing, whatever stands in the neighbouring rows.
        space = SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) if len(data) else np.zeros(0, np.int64)
        in_row = np.searchsorted(offsets, ends, "right") - 1
        symbol_end = np.bincount(in_row[kind[ends] == 3], minlength=m)
        twice = np.zeros(len(data), bool)
        twice[1:] = (data[1:] == data[:-1]) & (kind[1:] == 3) & ~edge[1:-1]
        newline = data == 10
        lines = per_row(newline) + (n > 0)
        # Lines as sums of mixed bytes by place: equal lines are equal sums.
        cut = np.unique(np.concatenate((offsets[:-1][n > 0], np.flatnonzero(newline) + 1)))
        cut = cut[cut < len(data)]
        repeated = np.zeros(m)
        if len(cut):
            place = np.arange(len(data)) - np.repeat(cut, np.diff(np.concatenate((cut, [len(data)]))))
            value = np.add.reduceat(mix(place.astype(np.uint64) * np.uint64(256) + data), cut)
            at = np.searchsorted(offsets, cut, "right") - 1
            by = np.lexsort((value, at))
            v, a = value[by], at[by]
            same = np.concatenate(([False], (v[1:] == v[:-1]) & (a[1:] == a[:-1])))
            repeated = np.bincount(a[same], minlength=m) / np.maximum(np.bincount(a, minlength=m), 1)
        last = np.zeros(m)
        last[n > 0] = kind[offsets[1:][n > 0] - 1] == 4
        cols = [np.log1p(n), np.log1p(count), mean, std, per_row(kind == 1) / size, per_row(kind == 2) / size, per_row(kind == 3) / size, per_row(kind == 4) / size, per_row(kind == 5) / size, per_row(kind == 6) / size, per_row(newline) / size, per_row(data == 124) / size, distinct / some, per_row(twice) / size, symbol_end / some, np.log1p(n / np.maximum(lines, 1)), repeated, last]
        out[row : row + m] = np.stack(cols, 1)
    return out


@dataclass
class Model:
    """The fitted classifier."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / self.directions.shape[1])
        return np.concatenate((np.ones((len(x), 1)), waves), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        # Rounded, so that how rows are dealt to batches doesn't show in the last bits of a product.
        return np.clip(np.round(np.interp(self.raw(x), self.knots, self.heights), 9), 0, 1) if len(x) else np.zeros(0)


def isotonic(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing values that are nearest by weighted squares."""
    pools: list[list[float]] = []
    for v, w in zip(values, counts, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of `stats` as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum over rows(stats, label) of make(stats, label), a vector of a fixed width: by partition, then as a tree."""

    @released()
    def partial_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += make(_matrix(b.column("stats")), b.column("label").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_buffer(), float) for x in t.column("part")), np.zeros(width))
        return pa.table({"part": pa.array([total.tobytes()], pa.binary())})

    parts = add_in_tree(materialize(rows.select("stats", "label").mapInArrow(partial_sum, "at long, part binary"), "parts"), add, "part binary")
    return sum((np.frombuffer(bytes(r["part"]), float) for r in parts.collect()), np.zeros(width))


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 7) -> Model:
    """A model from rows(stats array<double>, label double), all of them. Without rows every score is 0.5."""
    d = len(NAMES)
    moments = _sums(rows, lambda x, y: np.concatenate(([len(x)], x.sum(0), (x**2).sum(0))), 1 + 2 * d)
    n = max(moments[0], 1)
    mean = moments[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(moments[1 + d :] / n - mean**2, 0))
    random = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1), random.normal(0, 1 / width, (d, features)), random.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not moments[0]:
        return model
    m = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return np.concatenate(((f.T @ f).ravel(), f.T @ y))

    total = _sums(rows, normal, m * m + m)
    model.weights = np.linalg.solve(total[: m * m].reshape(m, m) + ridge * n * np.eye(m) / features, total[m * m :])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)))

    held = _sums(rows, binned, 2 * BINS)
    count, ones = held[:BINS], held[BINS:]
    there = count > 0
    model.knots = ((np.arange(BINS) + 0.5) / BINS * 3 - 1)[there]
    model.heights = isotonic(ones[there] / count[there], count[there])
    return model


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of docs(doc_id, text, ...), as a written table."""

    @released()
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            x = statistics(b.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "stats"])

    docs = bounded(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return materialize(docs.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<double>"), "stats")


def held_out():
    """Rows that learning never sees: crc32 of the doc_id as text, modulo 5, is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from the statistics of labelled rows outside held_out(). A doc_id with several labels counts with their mean."""
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    return fit(stats.join(labels, "doc_id").select("stats", "label"))


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of stats. The model, a few hundred KB at any size, goes with the tasks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(_matrix(b.column("stats"))), pa.float64())], ["doc_id", "held_out", "score"])

    rows = stats.select("doc_id", held_out().alias("held_out"), "stats")
    rows = rows.mapInArrow(make, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text, ...), learnt from labels(doc_id, quality).

    Null and empty texts are scored as empty ones. Labels without document and null labels are ignored; without any
    label every score is 0.5. Repeated rows give repeated results; other columns never count.
    """
    stats = document_statistics(docs)
    return score(stats, train(stats, labels), threshold)


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs(text, ...) that score the threshold or more, all columns, without a join."""

    @released()
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            yield b.filter(pa.array(model.score(statistics(b.column("text"))) >= threshold))

    return bounded(docs).mapInArrow(make, docs.schema)
