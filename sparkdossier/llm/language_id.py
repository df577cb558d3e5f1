"""Language identification by error-correcting output codes.

Each language has a codeword of bits. A binary logistic classifier per bit, over rates of hashed byte n-grams (one to
four bytes, ASCII in lower case), predicts the bit; the language whose codeword has the least loss-weighted distance to
the predictions is chosen. Where the runner-up is almost as near, the document is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.llm import _bytes as B
from sparkdossier.llm._labels import fold, sample_ids, sample_texts

BITS = 12
GRAMS = (1, 2, 3, 4)
#: Letters, A-Z as a-z, and bytes beyond ASCII; all else is a blank. A run of blanks is one.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = range(97, 123)
_LETTERS[128:] = range(128, 256)
#: Bytes and texts counted at once: each text takes a row of all features.
PIECE, PIECE_TEXTS = 1 << 20, 512


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    codes: np.ndarray  # languages x bits of -1 and 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray


def codewords(n: int, bits: int = 15) -> np.ndarray:
    """Codes of -1 and 1: every split for up to five languages, else the best separated of seeded random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, float).T
    rng, best, most = np.random.default_rng(11), None, -1
    bits = max(bits, int(4 * np.ceil(np.log2(n))))
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, bits))
        far = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if far > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, far
    return best


def rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the share of each hashed n-gram in a text, texts x features; zero rows for texts without letters."""
    n, width = len(offsets) - 1, 1 << BITS
    b = _LETTERS[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (doc[1:] != doc[:-1])
    b, doc = b[keep].astype(np.uint32), doc[keep]
    out = np.zeros(n * width, np.float32)
    h = np.zeros(len(b), np.uint32)
    for k in GRAMS:
        if len(b) < k:
            break
        h = (h[: len(b) - k + 1] * np.uint32(0x01000193)) ^ ((b[k - 1 :] + np.uint32(k)) * np.uint32(0x9E3779B1))
        same = doc[: len(h)] == doc[k - 1 :]
        at = doc[: len(h)][same] * width + ((h[same] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
        out += np.bincount(at, minlength=n * width).astype(np.float32)
    out = out.reshape(n, width)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def fit(texts: pa.ChunkedArray, labels: list[str], rounds: int = 150, ridge: float = 1e-4) -> Model:
    """One logistic model per bit, by gradient steps with momentum over all rows, languages weighted alike."""
    langs = tuple(sorted(set(labels)))
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((1 << BITS, code.shape[1]), np.float32), np.ones(code.shape[1], np.float32))
    x = np.concatenate([rates(data, offsets) for _, _, data, offsets in B.pieces(*B.text_buffer(texts), B.FIT_BYTES, PIECE_TEXTS)])
    number = np.array([langs.index(v) for v in labels])
    target = ((code[number] + 1) / 2).astype(np.float32)
    share = (1.0 / (len(langs) * np.bincount(number, minlength=len(langs))[number]))[:, None].astype(np.float32)
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target) * share
        vw = 0.9 * vw - 20.0 * (x.T @ e + ridge * w)
        vb = 0.9 * vb - 2.0 * e.sum(axis=0)
        w, b = w + vw, b + vb
    return Model(langs, code, w.astype(np.float32), b)


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest codeword, its posterior share, and the share of the runner-up, by logistic loss per bit."""
    z = np.clip(x @ model.weights + model.bias, -30, 30)
    loss = np.stack([np.log1p(np.exp(-z * c)).sum(axis=1) for c in model.codes], 1)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")
    rows = np.arange(len(p))
    second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
    return order[:, 0], p[rows, order[:, 0]], second


def _predict(model: Model, gap: float):
    names = np.array(model.langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(1)
            for a, z, data, offsets in B.pieces(*B.text_buffer(texts), PIECE, PIECE_TEXTS):
                n = z - a
                # ASCII letters settle most texts; only the others are searched for letters beyond ASCII.
                s = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))))
                lettered = s[offsets[1:]] > s[offsets[:-1]]
                for i in np.flatnonzero(~lettered).tolist():
                    v = texts[a + i].as_py()
                    lettered[i] = bool(v) and letter.search(v) is not None
                lang, score, close = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
                if len(model.langs):
                    best, p, second = decode(model, rates(data, offsets))
                    lang[lettered], score[lettered] = names[best[lettered]], p[lettered]
                    close[lettered] = (p - second < gap)[lettered]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(lang, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"]
                )

    return run


def train(docs: DataFrame, train_rows: int = 2000, train_chars: int = 20_000) -> Model:
    """Fits on rows with a language whose crc32(doc_id as text) mod 4 is not 2, at most ``train_rows``, first by hash."""
    rows = docs.select("doc_id", F.col("lang").alias("label")).where(fold("doc_id", 4) != 2)
    got = sample_texts(docs, sample_ids(rows, train_rows), train_chars)
    return fit(got.column("text"), got.column("label").to_pylist())


def identify_language(docs: DataFrame, model: Model, gap: float = 0.2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for each row.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was learned. Repeated
    rows and null ids have a result each; equal texts get equal results. Of equally near codewords the first by name wins.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = d.mapInArrow(_predict(model, gap), "doc_id long, lang_pred string, score double, ambiguous boolean")
    return got.select("doc_id", (F.coalesce(fold("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
