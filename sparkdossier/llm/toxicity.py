"""Toxic spans by a linear-chain conditional random field.

Tokens of labelled documents are marked toxic where their document is, and where the word or its first bytes are far more
frequent among toxic documents than among others. A two-state chain over hashed token features (word, and prefixes of three
to six bytes) is fitted to the marked tokens by its gradient, which forward-backward gives. Marginals of all tokens of a
text, from forward-backward over its whole length, make its score (greatest marginal and expected number of toxic tokens,
through a logistic fit to the document labels) and its offending spans.

No token is labelled in the tables: the marks are guessed from labels of documents, and the chain learns the guess.

Forward-backward runs over many texts at once, bounded by their tokens, one token position at a time.
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

BITS = 17
PREFIXES = (3, 4, 5, 6)
#: A word or prefix marks tokens if so large a share of toxic training documents has it, its rate there is so many
#: times the rate elsewhere, and the log likelihood ratio of that is so large.
SUPPORT, TIMES, EVIDENCE = 0.03, 12.0, 9.0
#: Tokens that forward-backward works on at once; a text of more is worked on alone.
GROUP_TOKENS = 1 << 20


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32: log odds of state toxic by feature
    bias: float
    moves: np.ndarray  # log potentials of the four moves between states
    document: np.ndarray  # logistic weights: largest log odds, log expected count, constant


def token_features(w: B.Words) -> np.ndarray:
    """Feature numbers, one row for the word and one per prefix."""
    rows = [B.mix(w.hash + np.uint64(1))]
    rows += [B.mix(w.span_hash(w.start, np.minimum(w.start + k, w.end)) + np.uint64(k << 32)) for k in PREFIXES]
    return np.stack(rows) >> np.uint64(64 - BITS)


def marginals(e: np.ndarray, at: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of state toxic from what stands before, from what follows, and emission factors; ``at`` bounds the texts."""
    a00, a01, a10, a11 = np.exp(moves)
    x = np.exp(np.clip(e, -30, 30)).astype(np.float64)
    count = np.diff(at)
    order = np.argsort(-count, kind="stable")
    start, size = at[:-1][order], count[order]
    o, q = x.copy(), np.ones(len(x))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest + 1), "left")
    for t in range(1, longest):
        i = start[: active[t]] + t
        r = o[i - 1]
        o[i] = x[i] * (a01 + a11 * r) / (a00 + a10 * r)
    for t in range(longest - 2, -1, -1):
        i = start[: active[t + 1]] + t
        r = q[i + 1] * x[i + 1]
        q[i] = (a10 + a11 * r) / (a00 + a01 * r)
    return o, q, x


def _chance(odds: np.ndarray) -> np.ndarray:
    return odds / (1 + odds)


def _document(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: log odds of the greatest marginal, log of one plus the expected count, and 1; texts without tokens lowest."""
    n = len(at) - 1
    full = np.flatnonzero(np.diff(at))
    top, total = np.full(n, 1e-6), np.zeros(n)
    if len(full):
        top[full] = np.maximum.reduceat(p, at[:-1][full])
        total[full] = np.add.reduceat(p, at[:-1][full])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log1p(total), np.ones(n)], 1)


def emissions(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    out = np.zeros(f.shape[1])
    for row in f:
        out += w[row]
    return out


def weak_labels(f: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts that have a telling word or prefix."""
    width = 1 << BITS
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    tells = np.zeros(width, bool)
    for row, name in enumerate((0, *PREFIXES)):
        pairs = np.unique(doc.astype(np.int64) << BITS | f[row].astype(np.int64))
        which = pairs & (width - 1)
        toxic = y[pairs >> BITS] > 0
        one = np.bincount(which[toxic], minlength=width)
        zero = np.bincount(which[~toxic], minlength=width)
        both = np.maximum(one + zero, 1)
        share = n1 / (n1 + n0)
        evidence = one * np.log(np.maximum(one, 1e-9) / both / share) + zero * np.log(np.maximum(zero, 1e-9) / both / (1 - share))
        good = (one >= SUPPORT * n1) & ((one + 0.5) / n1 >= TIMES * (zero + 0.5) / n0) & (evidence >= EVIDENCE)
        if name != 3:  # three bytes are too few to tell by themselves
            tells |= good
    return (tells[f[[0, 2, 3, 4]]].any(axis=0) & (y[doc] > 0)).astype(np.float64)


def fit(texts: pa.ChunkedArray, y: np.ndarray, share: float, rounds: int = 60) -> Model:
    """``share``: of label 1 among all labelled rows, to which the score's constant is set."""
    width = 1 << BITS
    feats, docs, at, first = [], [], [0], 0
    for a, _, data, offsets in B.pieces(*B.text_buffer(texts), B.FIT_BYTES):
        w = B.Words(data, offsets)
        feats.append(token_features(w).astype(np.int32))
        docs.append((w.doc + a).astype(np.int32))
        at += (w.at[1:] + first).tolist()
        first += len(w.hash)
    if first == 0 or len(set(y.tolist())) < 2:
        return Model(np.zeros(width, np.float32), -5.0, np.zeros(4), np.array([0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    f, doc, at = np.concatenate(feats, 1), np.concatenate(docs), np.array(at)
    mark = weak_labels(f, doc, y)
    # Toxic texts without a marked token would teach that their words are clean.
    found = np.bincount(doc, weights=mark, minlength=len(y)) > 0
    use = (found | (y == 0))[doc]
    count = np.diff(at)[found | (y == 0)]
    sub = np.concatenate(([0], np.cumsum(count)))
    g, m = f[:, use], mark[use]
    later = np.ones(len(m), bool)
    later[sub[:-1][count > 0]] = False
    later = np.flatnonzero(later)
    seen = np.array([((m[later - 1] == i) & (m[later] == j)).sum() for i in (0, 1) for j in (0, 1)], float)
    w, bias, moves = np.zeros(width), -4.0, np.zeros(4)
    state = [np.zeros(width + 5), np.zeros(width + 5)]
    n = max(1.0, m.sum())
    for step in range(1, rounds + 1):
        o, q, x = marginals(emissions(w, g) + bias, sub, moves)
        p = _chance(o * q)
        diff = m - p
        grad = np.zeros(width + 5)
        for row in g:
            grad[:width] += np.bincount(row, weights=diff, minlength=width)
        grad[width] = diff.sum()
        r, s = o[later - 1], x[later] * q[later]
        a = np.exp(moves)
        joint = np.stack([np.full(len(r), a[0]), a[1] * s, a[2] * r, a[3] * r * s])
        grad[width + 1 :] = seen - (joint / joint.sum(axis=0)).sum(axis=1)
        grad = grad / n - np.concatenate((1e-4 * w, np.zeros(1), 1e-3 * moves))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.3 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
        w, bias, moves = w + move[:width], bias + move[width], moves + move[width + 1 :]
    o, q, _ = marginals(emissions(w, f) + bias, at, moves)
    x = _document(_chance(o * q), at)
    d = np.zeros(3)
    for _ in range(60):
        c = 1 / (1 + np.exp(-np.clip(x @ d, -30, 30)))
        hess = (x * (c * (1 - c))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (c - y) + 1e-2 * d)
        d = d - np.clip(step, -1, 1)
        if abs(step).max() < 1e-8:
            break
    drawn = float(y.mean())
    d[2] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Model(w.astype(np.float32), float(bias), moves, d)


def document_scores(model: Model, p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of texts from the marginals of their tokens."""
    return 1 / (1 + np.exp(-np.clip(_document(p, at) @ model.document, -30, 30)))


def _score(model: Model):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def finish(ids: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        """Scores and spans of the texts of some pieces."""
        sizes = [len(w.hash) for _, _, w, _ in held]
        first = np.cumsum([0, *sizes])
        at = np.concatenate(([0], *(w.at[1:] + f for (_, _, w, _), f in zip(held, first))))
        o, q, _ = marginals(np.concatenate([e for _, _, _, e in held]), at, model.moves)
        p = _chance(o * q)
        score = document_scores(model, p, at)
        starts, ends, rows, row = [], [], [], 0
        for (data, offsets, w, _), base in zip(held, first):
            bad = np.flatnonzero(p[base : base + len(w.hash)] >= 0.5)
            if len(bad):
                head = np.ones(len(bad), bool)  # neighbours in a text make one span
                head[1:] = (bad[1:] != bad[:-1] + 1) | (w.doc[bad[1:]] != w.doc[bad[:-1]])
                tail = np.append(head[1:], True)
                point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
                shift = point[offsets[w.doc[bad[head]]]]
                starts.append(point[w.start[bad[head]]] - shift)
                ends.append(point[w.end[bad[tail]]] - shift)
                rows.append(w.doc[bad[head]] + row)
            row += len(offsets) - 1
        n = np.bincount(np.concatenate(rows), minlength=row) if rows else np.zeros(row, np.int64)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (starts, ends)], fields=list(span))
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), flat)
        return pa.RecordBatch.from_arrays([ids, pa.array(score), spans], ["doc_id", "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, tokens, begin = [], 0, 0
            for _, z, data, offsets in B.pieces(*B.text_buffer(batch.column(1))):
                w = B.Words(data, offsets)
                e = np.full(len(w.hash), np.float32(model.bias))
                for row in token_features(w):
                    e += model.weights[row]
                held.append((data, offsets, w, e))
                tokens += len(w.hash)
                if tokens >= GROUP_TOKENS or z == batch.num_rows:
                    yield finish(batch.column(0).slice(begin, z - begin), held)
                    held, tokens, begin = [], 0, z

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_each: int = 600, train_chars: int = 20_000) -> Model:
    """Fits on rows whose crc32(doc_id as text) mod 5 is not 0: at most ``rows_each`` of either label, first by hash."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(fold("doc_id", 5) != 0)
    ids = sample_ids(rows.where("label = 1"), rows_each).unionByName(sample_ids(rows.where("label = 0"), rows_each))
    share = rows.agg(F.avg("label").alias("m")).first()["m"]
    got = sample_texts(docs, ids, train_chars)
    return fit(got.column("text"), got.column("label").to_numpy().astype(np.int64), min(max(float(share or 0.0), 1e-3), 1 - 1e-3))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for each row; ``spans`` are code point offsets of toxic words.

    A null or wordless text has the lowest document features and no spans. Repeated rows, equal texts and null ids have a
    result each, equal texts the same one. Without labelled rows of both kinds all texts get the same score.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = d.mapInArrow(_score(model), "doc_id long, score double, spans array<struct<start: long, end: long>>")
    return got.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
