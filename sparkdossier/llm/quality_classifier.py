"""Quality classifier: naive Bayes features in a support vector machine.

Indicators of n-grams are scaled by the log ratio of their rates in the two classes, and a linear model with hinge loss
is fitted to them by dual coordinate descent. N-grams are of two kinds: words (one and two in a row) and shapes of tokens
between blanks (one to three in a row), a shape being the case of the token, its last byte if that is a mark, whether
letters and marks mix, and whether it repeats the token before it. All are hashed into ``1 << BITS`` features.

The model is fitted on at most ``train_rows`` labelled rows of at most ``train_chars`` characters; scoring reads whole
texts in Arrow batches, in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.llm import _bytes as B
from sparkdossier.llm._labels import fold, sample_ids, sample_texts

BITS = 18
#: What ASCII bytes count as in a shape: 1 lower case or beyond ASCII, 2 upper case, 3 digit, 0 mark.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one per feature, the log ratio included
    bias: float
    slope: float  # from margin to log odds
    offset: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature numbers, sorted, each pair once."""
    n = len(offsets) - 1
    words = B.Words(data, offsets)
    tokens = B.Words(data, offsets, B.TOKENS)
    kind = _CLASS[data] if len(data) else np.zeros(0, np.uint8)
    size = tokens.end - tokens.start
    counts = []
    for c in range(4):
        s = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == c, out=s[1:])
        counts.append(s[tokens.end] - s[tokens.start])
    marks, lower, upper, digits = counts
    case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 2, 1))
    last = data[tokens.end - 1] if len(size) else np.zeros(0, np.uint8)
    end = np.where(_CLASS[last] == 0, last, 0).astype(np.uint64) if len(size) else np.zeros(0, np.uint64)
    again = np.zeros(len(size), bool)
    again[1:] = (tokens.hash[1:] == tokens.hash[:-1]) & (tokens.doc[1:] == tokens.doc[:-1])
    shape = end | (case.astype(np.uint64) << np.uint64(8)) | ((marks == size).astype(np.uint64) << np.uint64(10)) | ((digits > 0).astype(np.uint64) << np.uint64(11))
    shape |= (np.minimum(marks, 3).astype(np.uint64) << np.uint64(12)) | (again.astype(np.uint64) << np.uint64(14))
    shapes = B.Words.__new__(B.Words)
    shapes.hash, shapes.at, shapes.count, shapes.doc = B.mix(shape + np.uint64(1 << 40)), tokens.at, tokens.count, tokens.doc
    grams = [words.grams(1), words.grams(2), shapes.grams(1), shapes.grams(2), shapes.grams(3)]
    none = np.flatnonzero((tokens.count == 0))
    grams.append((none, np.full(len(none), 7, np.uint64)))  # a text without tokens has one feature of its own
    key = np.concatenate([(d.astype(np.uint64) << np.uint64(BITS)) | (B.mix(h + np.uint64(i)) >> np.uint64(64 - BITS)) for i, (d, h) in enumerate(grams)])
    doc = np.concatenate([d for d, _ in grams])
    key = key[np.argsort(doc, kind="stable")]
    at = B.rows_of((key >> np.uint64(BITS)).astype(np.int64), n)
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        key[a:z].sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scaled by the root of the number of indicators, so that long texts are not sure by length alone."""
    n = len(offsets) - 1
    doc, f = features(data, offsets)
    size = np.bincount(doc, minlength=n)
    return np.bincount(doc, weights=weights[f], minlength=n) / np.sqrt(np.maximum(size, 1)) + bias


def dual_descent(
    rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, top: np.ndarray, rounds: int, rng: np.random.Generator, width: int = 1 << BITS
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables that minimise 0.5 (|w|^2 + b^2) + sum of ``top`` times the hinge loss, row by row."""
    w, b, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            g = sign[i] * (float(w[f] @ v) + b) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), top[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[f] += step * v
                b += step
                alpha[i] = new
                most = max(most, abs(step) * norm[i] ** 0.5)
        if most < 1e-3:
            break
    return w, b, alpha


def fit(texts: pa.ChunkedArray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, smooth: float = 1.0) -> Model:
    """Log count ratios, then min 0.5 |w|^2 + cost * sum of hinge losses by coordinate descent on its dual."""
    if len(set(y.tolist())) < 2:  # one class, or none: the share of label 1 for every text
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    rows: list[np.ndarray] = []
    for _, _, data, offsets in B.pieces(*B.text_buffer(texts), B.FIT_BYTES):
        doc, f = features(data, offsets)
        at, f = B.rows_of(doc, len(offsets) - 1), f.astype(np.int32)
        rows += [f[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    one, zero = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for f, label in zip(rows, y.tolist(), strict=True):
        (one if label else zero)[f] += 1
    n1 = int(y.sum())
    ratio = np.log(one / (n1 + 2 * smooth)) - np.log(zero / (len(y) - n1 + 2 * smooth))
    rng = np.random.default_rng(7)
    sign = np.where(y > 0, 1.0, -1.0)
    values = [(ratio[f] / np.sqrt(max(1, len(f)))).astype(np.float32) for f in rows]

    top = np.where(y > 0, cost * len(y) / (2.0 * max(1, n1)), cost * len(y) / (2.0 * max(1, len(y) - n1)))

    def descend(use: np.ndarray) -> tuple[np.ndarray, float]:
        w, b, _ = dual_descent([rows[i] for i in use], [values[i] for i in use], sign[use], top[use], rounds, rng)
        return w, b

    # Log odds from margins that the model was not fitted to.
    held = np.zeros(len(rows))
    part = np.arange(len(rows)) % 2
    for k in range(2):
        w, b = descend(np.flatnonzero(part != k))
        for i in np.flatnonzero(part == k):
            held[i] = float(w[rows[i]] @ values[i]) + b
    w, b = descend(np.arange(len(rows)))
    slope, offset = platt(held, y)
    return Model((w * ratio).astype(np.float32), b, slope, offset)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by Newton steps with a small ridge."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (p - t) + 1e-3 * (a - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a = a - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(a[0], 1e-3)), float(a[1])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, offsets in B.pieces(*B.text_buffer(batch.column(batch.num_columns - 1))):
                m = margins(data, offsets, model.weights, model.bias)
                score = 1 / (1 + np.exp(-np.clip(model.slope * m + model.offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(score)], ["key", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 3000, train_chars: int = 20_000) -> Model:
    """Fits on rows whose crc32(doc_id as text) mod 5 is not 0, at most ``train_rows`` of them, first by hash."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(fold("doc_id", 5) != 0)
    got = sample_texts(docs, sample_ids(rows, train_rows), train_chars)
    return fit(got.column("text"), got.column("label").to_numpy().astype(np.int64))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    A null text is an empty one; both have one feature of their own, so they get a score too. Repeated rows, equal texts
    and null ids have a result each, equal texts the same score. Without labelled rows all scores are equal.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = d.mapInArrow(_score(model), "doc_id long, score double")
    return got.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(model: Model, text: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            for a, z, data, offsets in B.pieces(*B.text_buffer(column.cast(pa.string()))):
                m = margins(data, offsets, model.weights, model.bias)
                score = 1 / (1 + np.exp(-np.clip(model.slope * m + model.offset, -30, 30)))
                yield batch.slice(a, z - a).filter(pa.array(score >= threshold))

    return run


def keep_quality_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, as they are.

    A null text is scored as an empty one and stays a null. Repeated rows and null ids are judged each, equal texts alike. An
    empty table gives no rows; without labelled rows all texts score the same, so all stay or none.
    """
    return docs.mapInArrow(_keep(model, "text", threshold), docs.schema)
