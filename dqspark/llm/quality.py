"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each partition sums its part of the normal equations, so every labelled document counts and only sums move. Held-back
labelled documents, counted in bins of the raw score, calibrate it by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import CALIBRATES, HELD_OUT, fold, matrix_blocks, summed
from .work import add_columns, fresh, replace_columns, written
from .words import mix, word_hashes

_SIGNS = b".,!?|%&$*#:;-_=+<>()[]{}/\\'\""
_BINS = 1000
SIZE = 24 + len(_SIGNS)


def statistics(text: bytes | None) -> np.ndarray:
    """SIZE numbers about a whole text, none of them about its language, source or id. Null and empty texts give zeros."""
    out = np.zeros(SIZE, np.float32)
    if not text:
        return out
    letters = np.frombuffer(text, np.uint8)
    counts = np.bincount(letters, minlength=256).astype(float)
    n = len(letters)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    share = counts[counts > 0] / n
    out[:9] = np.log1p(n), upper / max(1, upper + lower), digits / n, counts[128:].sum() / n, counts[32] / n, counts[10] / n, -(share * np.log(share)).sum(), counts[:32].sum() / n, (upper + lower) / n
    out[24:] = np.sqrt(counts[list(_SIGNS)] / n)
    words = word_hashes(text)
    k = len(words)
    if not k:
        return out
    distinct, times = np.unique(words, return_counts=True)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    lines = [x for x in text.split(b"\n") if x]
    sentences = max(1.0, counts[46] + counts[33] + counts[63])
    chunks = text.split()
    sizes = np.fromiter(map(len, chunks), float, len(chunks))
    ends = np.fromiter((c[-1] for c in chunks), np.uint8, len(chunks))
    out[9:24] = (
        np.log1p(k), n / k, len(distinct) / k, times.max() / k, (words[1:] == words[:-1]).mean() if k > 1 else 0, len(np.unique(pairs)) / max(1, k - 1), len(set(lines)) / len(lines),
        np.log(n / len(lines)), np.log(k / sentences), sizes.mean(), sizes.std(), (sizes <= 3).mean(), (sizes >= 10).mean(), np.isin(ends, list(b"!%&$*#|")).mean(), (sizes == 1).mean(),
    )
    return out


@dataclass
class Model:
    """A fitted score. bins holds the calibrated score of each bin of the raw one."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    bins: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        standard = np.clip((rows - self.mean) / self.scale, -4, 4)
        return np.hstack([np.cos(standard @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.features(rows) @ self.weights, 0, 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), (np.arange(_BINS + 1)) / _BINS, self.bins)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def with_statistics(docs: DataFrame) -> tuple[DataFrame, str]:
    name = fresh(docs, "statistics")

    def compute(texts):
        made = [statistics(t) for t in texts.cast(pa.binary()).to_pylist()]
        flat = np.concatenate(made) if made else np.empty(0, np.float32)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * SIZE, pa.int32()), pa.array(flat))]

    return add_columns(docs, ["text"], [(name, T.ArrayType(T.FloatType()))], compute), name


def isotonic(positive: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing rates nearest to positive / n, by pooling adjacent violators, and lines between the pools' centres."""
    blocks: list[list[float]] = []
    for at in np.flatnonzero(n):
        blocks.append([positive[at], n[at], at * n[at]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    centres = [b[2] / b[1] for b in blocks]
    return np.interp(np.arange(len(n)), centres, [b[0] / b[1] for b in blocks])


def fit(measured: DataFrame, labels: DataFrame, features: int = 384, ridge: float = 1e-3, seed: int = 11) -> Model:
    """A model from measured (doc_id, statistics) and labels (doc_id, quality), without the held-out fold.

    Several labels of a document count as their mean, null ones not at all. With no label to learn from every score is
    0.5; with no label to calibrate with, the raw score stands.
    """
    random = np.random.default_rng(seed)
    mean_label = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    known = measured.join(mean_label, "doc_id").where(fold() != HELD_OUT).select("statistics", "label", (fold() == CALIBRATES).alias("calibrates"))
    known = written(known, "quality-labels")

    def moments(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, SIZE))
        for batch in stream:
            rows = _rows(batch.column(0))
            total += [np.full(SIZE, len(rows)), rows.sum(axis=0), (rows * rows).sum(axis=0)]
        yield matrix_blocks(total)

    learn = known.where(~F.col("calibrates"))
    n, first, second = summed(learn.select("statistics").mapInArrow(moments, "block int, bytes binary"), (3, SIZE))
    mean = first / np.maximum(n, 1)
    scale = np.sqrt(np.maximum(second / np.maximum(n, 1) - mean**2, 0))
    model = Model(
        mean, np.where(scale > 1e-6, scale, 1.0), random.standard_normal((SIZE, features)) / np.sqrt(SIZE), random.uniform(0, 2 * np.pi, features),
        np.append(np.zeros(features), 0.5), np.arange(_BINS + 1) / _BINS,
    )
    if not n[0]:
        return model

    def normal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in stream:
            z = model.features(_rows(batch.column(0)))
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield matrix_blocks(total)

    sums = summed(learn.select("statistics", "label").mapInArrow(normal, "block int, bytes binary"), (features + 1, features + 2)) / n[0]
    model.weights = np.linalg.solve(sums[:, :-1] + ridge * np.eye(features + 1) / np.sqrt(n[0]), sums[:, -1])
    scored, raw = _scored(known.where("calibrates").select("statistics", "label"), "statistics", model, raw=True)
    bins = scored.groupBy(F.round(F.col(raw) * _BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("positive")).collect()
    if bins:
        count, positive = np.zeros(_BINS + 1), np.zeros(_BINS + 1)
        for b in bins:
            count[b["bin"]], positive[b["bin"]] = b["n"], b["positive"]
        model.bins = isotonic(positive, count)
    return model


def _scored(rows: DataFrame, statistics_column: str, model: Model, raw: bool = False) -> tuple[DataFrame, str]:
    shared, name = rows.sparkSession.sparkContext.broadcast(model), fresh(rows, "score")

    def compute(column):
        own = _rows(column) if len(column) else np.empty((0, SIZE))
        return [pa.array(shared.value.raw(own) if raw else shared.value.score(own))]

    return add_columns(rows, [statistics_column], [(name, T.DoubleType())], compute), name


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. See statistics and fit for odd rows and labels."""
    measured, _ = with_statistics(docs.select("doc_id", "text"))
    measured = written(measured.select("doc_id", "statistics"), "quality-statistics")
    scored, name = _scored(measured, "statistics", fit(measured, labels))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least threshold, unchanged. Repeated rows share their fate."""
    measured, _ = with_statistics(docs.select("doc_id", "text"))
    model = fit(written(measured.select("doc_id", "statistics"), "quality-statistics"), labels)
    shared, score = docs.sparkSession.sparkContext.broadcast(model), fresh(docs, "score")

    def compute(texts):
        made = [statistics(t) for t in texts.cast(pa.binary()).to_pylist()]
        return [pa.array(shared.value.score(np.array(made, float)) if made else [], pa.float64())]

    scored = add_columns(docs, ["text"], [(score, T.DoubleType())], compute)
    return replace_columns(scored.where(F.col(score) >= threshold), docs, {})
