import random

import numpy as np
import pyarrow as pa
from llm_helpers import docs_of

from sparkdossier.llm import language_id, quality_classifier, toxicity


def labelled(spark, n=240, seed=1):
    r = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ra", "li", "mo", "nu", "se")]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(30, 120))]
        good, toxic = i % 4 > 0, i % 3 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(("zzbad", "zzworse")))
        if not good:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", "s"))
        labels.append((i, int(good), int(toxic)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, odd_docs, no_docs):
    docs, labels = labelled(spark)
    model = quality_classifier.train(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.score_quality(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held and sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    odd = quality_classifier.score_quality(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (4, 5)}) == 1
    assert quality_classifier.score_quality(no_docs, model).count() == 0
    assert quality_classifier.keep_quality_documents(odd_docs, model).columns == odd_docs.columns
    none = quality_classifier.train(docs, labels.limit(0))
    assert len({r.score for r in quality_classifier.score_quality(odd_docs, none).collect()}) == 1


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held and sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    found = {text[i][s.start : s.end] for i, r in got.items() for s in r.spans}
    assert found and all("zz" in x for x in found)
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(no_docs, model).count() == 0


def test_marginals_against_all_paths():
    import itertools

    r = np.random.default_rng(2)
    at = np.array([0, 4, 4, 5, 8])
    e, moves = r.normal(size=8), r.normal(size=4)
    o, q, _ = toxicity.marginals(e, at, moves)
    got = o * q / (1 + o * q)
    for a, z in zip(at[:-1], at[1:]):
        n, total, one = z - a, 0.0, np.zeros(z - a)
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[a + i] for i in range(n) if path[i]) + sum(moves[2 * path[i] + path[i + 1]] for i in range(n - 1)))
            total += w
            one += w * np.array(path)
        if n:
            assert np.allclose(got[a:z], one / total)


def test_languages(spark, odd_docs, no_docs, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language_id.identify_language(docs, model).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    odd = {r.doc_id: r for r in language_id.identify_language(odd_docs, model).collect() if r.doc_id}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (4, 5, 6, 7)) and odd[11].lang_pred != "und"
    assert language_id.identify_language(no_docs, model).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(odd_docs, language_id.train(no_docs)).collect()} == {"und"}


def test_codes_tell_all_languages_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = language_id.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 1


def test_coordinate_descent_separates():
    texts = pa.chunked_array([["good fine text here"] * 5 + ["bad *** %%% &&&"] * 5])
    y = np.array([1] * 5 + [0] * 5)
    m = quality_classifier.fit(texts, y)
    from sparkdossier.llm import _bytes as B

    s = quality_classifier.margins(*B.text_buffer(texts), m.weights, m.bias)
    assert (s[:5] > 0).all() and (s[5:] < 0).all()


def test_dual_descent_against_a_plain_solver():
    """The dual objective and the weights of projected gradient steps on the whole quadratic program."""
    r = np.random.default_rng(4)
    rows = [np.sort(r.choice(12, r.integers(2, 7), replace=False)) for _ in range(40)]
    values = [r.normal(size=len(f)) for f in rows]
    sign, top = r.choice((-1.0, 1.0), 40), r.uniform(0.2, 2, 40)
    w, b, alpha = quality_classifier.dual_descent(rows, values, sign, top, 3000, np.random.default_rng(1), 12)
    x = np.zeros((40, 13))
    for i, (f, v) in enumerate(zip(rows, values)):
        x[i, f] = v
    x[:, 12] = 1
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    plain = np.zeros(40)
    for _ in range(200_000):
        plain = np.clip(plain - (q @ plain - 1) / np.linalg.norm(q, 2), 0, top)
    dual = lambda a: a.sum() - 0.5 * a @ q @ a
    assert abs(dual(alpha) - dual(plain)) < 1e-3
    both = (plain * sign) @ x
    assert np.allclose(w, both[:12], atol=0.02) and abs(b - both[12]) < 0.02


def test_log_count_ratios_scale_the_features():
    texts = pa.chunked_array([["red red blue", "red green", "blue grey", "grey grey green", "red blue"]])
    y = np.array([1, 1, 0, 0, 1])
    m = quality_classifier.fit(texts, y)
    from sparkdossier.llm import _bytes as B

    doc, f = quality_classifier.features(*B.text_buffer(texts))
    sets = [set(f[doc == i].tolist()) for i in range(5)]
    for x in set(f.tolist()):
        one, zero = (sum(x in s for s, label in zip(sets, y) if label == k) + 1 for k in (1, 0))
        ratio = np.log(one / 5) - np.log(zero / 4)
        assert ratio != 0 or m.weights[x] == 0


def plain_rates(text):
    """Roots of shares of hashed n-grams, a byte at a time."""
    b, out = [], np.zeros(1 << language_id.BITS)
    for c in text.encode():
        c = c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
        if not (c == 32 and b and b[-1] == 32):
            b.append(c)
    for k in language_id.GRAMS:
        for i in range(len(b) - k + 1):
            h = 0
            for j in range(1, k + 1):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ ((b[i + j - 1] + j) * 0x9E3779B1 & 0xFFFFFFFF)
            out[(h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - language_id.BITS] += 1
    return np.sqrt(out / max(out.sum(), 1))


def test_languages_against_a_plain_decoder(spark, sf):
    """Every text's features, loss-weighted distances and answer, one at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    model = language_id.train(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r.doc_id: r for r in language_id.identify_language(docs, model).collect()}
    for r in docs.collect():
        x = plain_rates(r.text)
        z = [float(x @ model.weights[:, j]) + float(model.bias[j]) for j in range(model.weights.shape[1])]
        loss = [sum(np.log1p(np.exp(-np.clip(v, -30, 30) * c)) for v, c in zip(z, code)) for code in model.codes]
        p = np.exp(-np.array(loss))
        p /= p.sum()
        if r.text and any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == model.langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4
            assert abs(got[r.doc_id].score - p.max()) < 1e-3
            assert got[r.doc_id].ambiguous == (np.sort(p)[-1] - np.sort(p)[-2] < 0.2) or abs(np.sort(p)[-1] - np.sort(p)[-2] - 0.2) < 1e-3


def test_toxicity_score_against_a_plain_chain(spark, monkeypatch):
    """Marginals by sums over all states, a token at a time, and the score from them; groups of few tokens too."""
    import re

    docs, labels = labelled(spark, 150)
    model = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "GROUP_TOKENS", 100)
    from functools import partial

    from sparkdossier.llm import _bytes as B

    monkeypatch.setattr(B, "pieces", partial(B.pieces, rows=4))
    rows = docs.limit(30).collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in rows]), pa.array([r.text for r in rows])], ["doc_id", "text"])
    out = list(toxicity._score(model)(iter([batch])))
    assert len(out) > 5
    got = {i: s for x in out for i, s in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    a = np.exp(model.moves).reshape(2, 2)
    for r in rows:
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", r.text.lower())
        e = []
        for w in words:
            x = B.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
            e.append(model.bias + sum(float(model.weights[f[0]]) for f in toxicity.token_features(x)))
        f = [np.array([1.0, np.exp(np.clip(e[0], -30, 30))])]
        for v in e[1:]:
            x = (f[-1] @ a) * [1.0, np.exp(np.clip(v, -30, 30))]
            f.append(x / x.sum())
        b = [np.ones(2)]
        for v in e[:0:-1]:
            x = a @ (b[-1] * [1.0, np.exp(np.clip(v, -30, 30))])
            b.append(x / x.sum())
        p = np.array([(x * y)[1] / (x * y).sum() for x, y in zip(f, b[::-1])])
        top = min(max(p.max(), 1e-6), 1 - 1e-6)
        want = 1 / (1 + np.exp(-np.clip(model.document @ [np.log(top / (1 - top)), np.log1p(p.sum()), 1.0], -30, 30)))
        assert abs(want - got[r.doc_id]) < 1e-3


def test_a_labelled_id_on_many_texts_is_one_row(spark):
    from sparkdossier.llm._labels import sample_ids, sample_texts

    docs = docs_of(spark, [(1, f"text {i % 3}", "en", "s") for i in range(3000)] + [(2, None, "en", "s"), (3, "x" * 50, "en", "s")])
    ids = sample_ids(spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, label int"), 10)
    got = sample_texts(docs, ids, 20)
    assert got.num_rows == 1 and got.column("label").to_pylist() == [1]
