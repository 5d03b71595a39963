"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

Runs of one to four bytes of the folded text are hashed into buckets. A document is the mean of its buckets' embeddings.
The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import HELD_OUT, fold
from .work import add_columns, fresh, sliced
from .words import FOLD

BUCKETS = 4096
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # also matches numerals such as ½ and Ⅷ
_MANY = 1_000_000


def bucket_counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs in a whole text. Long texts are counted in parts that overlap by three bytes."""
    folded = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(folded), _MANY):
        part = folded[at : at + _MANY + 3].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for size in range(1, 5):
            code = code[: len(part) - size + 1] * np.uint32(0x01000193) + part[size - 1 :]
            total += np.bincount(((code * np.uint32(0x9E3779B1)) >> np.uint32(20))[:_MANY], minlength=BUCKETS)
    return total


@dataclass
class Model:
    """languages in order; table: the product of embeddings and output weights; a row's logits are its mean of rows."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, shares: np.ndarray) -> np.ndarray:
        return _softmax((shares @ self.table + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    x = np.exp(logits - logits.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(shares: np.ndarray, labels: np.ndarray, languages: list[str], size: int = 32, epochs: int = 12, rate: float = 8.0, precision: float = 0.99, seed: int = 3) -> Model:
    """A model from rows of bucket shares and the numbers of their languages. A fifth of the rows only calibrates.

    The temperature is the one with the least calibration loss. threshold is the least score from which on calibration
    rows are right at least to this precision.
    """
    random = np.random.default_rng(seed)
    order = random.permutation(len(shares))
    aside = order[: len(order) // 5] if len(order) >= 10 else order
    own = order[len(order) // 5 :] if len(order) >= 10 else order
    embeddings = random.standard_normal((BUCKETS, size)) / np.sqrt(size)
    output, bias = np.zeros((size, len(languages))), np.zeros(len(languages))
    spread = np.sqrt(BUCKETS)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        mixed = random.permutation(own)
        for at in range(0, len(mixed), 32):
            rows = mixed[at : at + 32]
            x = shares[rows]
            mean = x @ embeddings
            error = _softmax(mean @ output * spread + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            towards = x.T @ (error @ output.T)
            output -= step / spread * (mean.T @ error) * BUCKETS**0.5
            bias -= step / 10 * error.sum(axis=0)
            embeddings -= step / spread * towards * BUCKETS**0.5
    model = Model(languages, embeddings @ output * spread, bias, 1.0, 0.0)
    logits, truth = shares[aside] @ model.table + bias, labels[aside]
    at = np.arange(len(truth))
    losses = {t: -np.log(np.maximum(_softmax(logits / t)[at, truth], 1e-300)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)}
    model.temperature = min(losses, key=losses.get)
    p = _softmax(logits / model.temperature)
    best = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[best] == truth[best]) / (at + 1)
    good = np.flatnonzero(right >= precision)
    model.threshold = float(p.max(axis=1)[best[good[-1]]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, sample: int = 3000) -> Model | None:
    """A model from about sample rows with text and lang, not held out: as many of each language, chosen by a hash of
    doc_id and text. What reaches the driver is their shares by bucket. None if there is nothing to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT))
    rows_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows_of:
        return None
    most = sample / len(rows_of)
    share = F.create_map(*[x for lang, n in rows_of.items() for x in (F.lit(lang), F.lit(min(1.0, most / n)))])[F.col("lang")]
    picked = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(stream):
            counts = [bucket_counts(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            shares = [(c / max(1, c.sum())).astype("<f4").tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(shares, pa.binary())], names=["lang", "shares"])

    rows = picked.mapInArrow(batches, "lang string, shares binary").collect()
    languages = sorted(rows_of)
    if not rows:
        return Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0, 0.0)
    number = {lang: k for k, lang in enumerate(languages)}
    shares = np.empty((len(rows), BUCKETS), np.float32)
    for k, row in enumerate(rows):
        shares[k] = np.frombuffer(row["shares"], "<f4")
    order = np.lexsort((shares[:, 7], shares[:, 1], shares.argmax(axis=1)))
    return train(shares[order], np.array([number[rows[k]["lang"]] for k in order]), languages)


def predict(docs: DataFrame, model: Model | None) -> tuple[DataFrame, dict[str, str]]:
    """docs with three further columns and their names: lang_pred, score, accepted.

    A null text, one without a letter, and any text where there is no model is UNKNOWN with score 0, not accepted. A
    prediction whose score is below the model's threshold is given, but not accepted. Only the text is read.
    """
    names = {name: fresh(docs, name) for name in ("lang_pred", "score", "accepted")}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        model = shared.value
        found, scores, accepted = [], [], []
        for text in texts.to_pylist():
            if model is None or text is None or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
                found.append(UNKNOWN)
                scores.append(0.0)
                accepted.append(False)
                continue
            counts = bucket_counts(text.encode())
            p = model.probabilities((counts / counts.sum())[None])[0]
            best = int(p.argmax())
            found.append(model.languages[best])
            scores.append(float(p[best]))
            accepted.append(bool(p[best] >= model.threshold))
        return [pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]

    kinds = [(names["lang_pred"], T.StringType()), (names["score"], T.DoubleType()), (names["accepted"], T.BooleanType())]
    return add_columns(docs, ["text"], kinds, compute), names


def languages(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, accepted. See fit and predict for odd rows."""
    made, name = predict(docs.select("doc_id", "text"), fit(docs, sample))
    return made.select("doc_id", (fold() == HELD_OUT).alias("held_out"), *[F.col(name[c]).alias(c) for c in ("lang_pred", "score", "accepted")])
