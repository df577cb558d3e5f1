import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from llm_helpers import docs_of

from sparkdossier.llm import mixing, packing


def fill(budget, children):
    """Water filling by repeated sharing, in real numbers."""
    got, open_ = {k: 0.0 for k in children}, dict(children)
    left = budget
    while open_ and left > 1e-9:
        w = sum(x[0] for x in open_.values())
        full = {k: x for k, x in open_.items() if x[1] <= left * x[0] / w}
        if not full:
            for k, x in open_.items():
                got[k] = left * x[0] / w
            return got
        for k, x in full.items():
            got[k] = x[1]
            left -= x[1]
            del open_[k]
    return got


def test_budgets_against_water_filling(spark):
    r = random.Random(4)
    leaves = [(f"d{a}", f"l{b}", f"s{c}", r.randrange(10, 10_000)) for a in range(3) for b in range(3) for c in range(3)]
    mix = mixing.Mix({"d0": 5, "d1": 1}, {"l0": 3}, {"s1": 2}, max_epochs=2)
    got = {(x.domain, x.language, x.origin): x.take for x in mixing.budgets(spark.createDataFrame(leaves, "domain string, language string, origin string, tokens long"), mix).collect()}
    cap = lambda *p: 2 * sum(x[3] for x in leaves if x[: len(p)] == p)
    total = sum(x[3] for x in leaves)
    top = fill(total, {a: (mix.domains.get(a, 1), cap(a)) for a in ("d0", "d1", "d2")})
    for a, budget in top.items():
        for b, share in fill(budget, {b: (mix.languages.get(b, 1), cap(a, b)) for b in ("l0", "l1", "l2")}).items():
            for c, take in fill(share, {c: (mix.origins.get(c, 1), cap(a, b, c)) for c in ("s0", "s1", "s2")}).items():
                assert abs(got[a, b, c] - take) <= 3
    assert sum(got.values()) == total


def test_mix_odd_rows(spark, odd_docs, no_docs):
    plan = mixing.mix_plan(odd_docs).collect()
    assert all(x.tokens_used <= x.tokens for x in plan)
    assert sum(x.tokens_used for x in plan) == sum(len((r.text or "").split()) for r in odd_docs.select("text").collect())
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() > 0
    drawn = sorted((x.doc_id or -1, len((x.text or "").split())) for x in mixed.collect())
    assert drawn == sorted((x.doc_id or -1, x.tokens_used) for x in plan)
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


def test_mix_of_repeated_and_null_ids(spark):
    """One leaf short of its budget, rows alike: passes and prefix take each as often as if they were told apart."""
    rows = [(None, "a b c", "en", "s")] * 40 + [(7, " d e\n", "en", "s")] * 25 + [(7, "f g h i", "en", "s"), (8, "j", "fr", "s")]
    docs = docs_of(spark, rows)
    mix = mixing.Mix({}, {"en": 5, "fr": 1}, max_epochs=3, budget_milli=400)
    plan = mixing.mix_plan(docs, mix).collect()
    total = 40 * 3 + 25 * 2 + 4 + 1
    assert sum(r.tokens_used for r in plan) == total * 400 // 1000
    got = mixing.mix_documents(docs, mix).collect()
    assert sorted((r.doc_id or -1, len(r.text.split())) for r in got) == sorted((r.doc_id or -1, r.tokens_used) for r in plan)
    assert all(any(r.text == x[1] or x[1].startswith(r.text) for x in rows) and r.n_chars in (3, 5, len(r.text), 7, 1) for r in got)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(corpus_pipeline.tokenizer_path())


def test_ids_are_the_tokenizers(encoder, spark, sf):
    odd = ["  a  b\n\nc  \n d\t\te ", "", " ", "\n", "it's a'b 'll", "né×e «q»", "日本 text", "a<|endoftext|> b", "A1b2 3c\r\n\r\n x", " lead", "trail \n", "ſß ²³ ½", "\x00\x1c a\x85b\xa0c"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    assert [x.tolist() for x in encoder.many(texts)] == [encoder.whole(t).tolist() for t in texts]


def check_pieces(rows, tokens):
    """Whole cover of every document, gapless sequences, and no padding."""
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_seq.setdefault(x.sequence_id, []).append(x)
    for i, want in tokens.items():
        at = 0
        for x in sorted(by_doc[i], key=lambda x: x.start):
            assert x.start == at and x.length > 0 and x.doc_tokens == len(want)
            assert x.ids_crc32 == zlib.crc32(np.array(want[at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(want)
    for pieces in by_seq.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_pack(spark, sf, encoder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, corpus_pipeline.tokenizer_path()).collect()
    check_pieces(rows, {r.doc_id: [*encoder.whole(r.text).tolist(), 0] for r in docs.collect()})


def test_pack_odd_rows(spark, odd_docs, no_docs, encoder):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(docs, corpus_pipeline.tokenizer_path()).collect()
    check_pieces(rows, {r.doc_id: [*encoder.whole(r.text or "").tolist(), 0] for r in docs.collect()})
    assert packing.pack_documents(odd_docs, corpus_pipeline.tokenizer_path()).where("start = 0").count() == odd_docs.count()
    assert packing.pack_documents(no_docs, corpus_pipeline.tokenizer_path()).count() == 0


def test_neighbours_are_bm25_ranked():
    r = np.random.default_rng(3)
    tokens = [r.integers(1, 60, r.integers(5, 40)).astype(np.uint32) for _ in range(50)]
    index = packing.Shard(tokens)
    n, mean = len(tokens), np.mean([len(t) for t in tokens])
    df = {w: sum(w in t for t in tokens) for w in range(60)}
    terms = [w for w in set(tokens[7].tolist()) if df[w] > 1]

    def score(t):
        out = 0.0
        for w in terms:
            tf = int((t == w).sum())
            out += np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) if tf else 0
        return out

    want = sorted((i for i in range(n) if i != 7 and score(tokens[i]) > 0), key=lambda i: -score(tokens[i]))
    unused = np.ones(n, bool)
    unused[7] = False
    got = list(index.nearest(7, unused))
    assert len(got) == len(want) and np.allclose([score(tokens[i]) for i in got], [score(tokens[i]) for i in want])


def test_all_terms_of_a_long_seed_count():
    """A seed of some 400 distinct ids: exact scores, and neighbours that share only its common ones."""
    r = np.random.default_rng(8)
    seed = np.arange(1, 401, dtype=np.uint32)
    tokens = [seed] + [r.choice(np.arange(1, 900), r.integers(5, 300)).astype(np.uint32) for _ in range(60)]
    tokens += [np.array([w, 5000 + w], np.uint32) for w in range(1, 401)]
    n, mean, size = len(tokens), np.mean([len(t) for t in tokens]), np.array([len(t) for t in tokens])
    tf = np.zeros((n, 6000))
    for i, t in enumerate(tokens):
        np.add.at(tf[i], t, 1)
    df = (tf > 0).sum(axis=0)
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)[:, None])
    score = weight[:, seed][:, df[seed] > 1].sum(axis=1)
    unused = np.ones(n, bool)
    unused[0] = False
    got = list(packing.Shard(tokens).nearest(0, unused))
    assert sorted(got) == [i for i in range(1, n) if score[i] > 0] and len(got) > 400
    assert np.allclose(score[got], np.sort(score[1:][score[1:] > 0])[::-1])


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_unlike_pieces_of_equal_polynomial_hash_keep_their_ids(encoder, monkeypatch):
    texts = [" ".join(thue_morse(n)) for n in (16, 64, 128, 2048)] + ["x" * 70 + " " + "x" * 69 + "y"]
    assert [x.tolist() for x in encoder.many(texts)] == [encoder.whole(t).tolist() for t in texts]
    # And whatever the hash: here all pieces share one.
    monkeypatch.setattr(packing.B.Spans, "hash", lambda self, start, end: np.zeros(len(start), np.uint64))
    texts = ["one two one three two", *texts]
    assert [x.tolist() for x in encoder.many(texts)] == [encoder.whole(t).tolist() for t in texts]


def plain_pack(tokens, stats):
    """The same filling rule, a token at a time."""
    n, left = len(tokens), sum(map(len, tokens))
    tf = [{w: int((t == w).sum()) for w in set(t.tolist())} for t in tokens]
    here = {w for x in tf for w in x if sum(w in y for y in tf) > 1}

    def score(q, d):
        out = 0.0
        for w in tf[q]:
            if w in here and w in tf[d]:
                f = tf[d][w]
                out += np.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tokens[d]) / stats.mean))
        return out

    lengths = [1024] * (left // 1024) + [1 << b for b in range(10, -1, -1) if left % 1024 >> b & 1]
    unused, windows, rest = list(range(n)), [], None
    for length in lengths:
        window, seed = [], None
        while len(window) < length:
            if rest is None:
                near = [d for d in unused if seed is not None and score(seed, d) > 0]
                d = max(near, key=lambda d: (round(score(seed, d), 6), -d)) if near else unused[0]
                unused.remove(d)
                rest = (d, 0)
            d, at = rest
            seed = d if seed is None else seed
            take = min(len(tokens[d]) - at, length - len(window))
            window += [(d, at + i) for i in range(take)]
            rest = (d, at + take) if at + take < len(tokens[d]) else None
        windows.append(window)
    return windows


def test_windows_are_filled_by_the_seeds_neighbours():
    r = np.random.default_rng(12)
    tokens = [np.append(r.zipf(1.3, r.integers(1, 900)) % 400 + 1, 0).astype(np.uint16) for _ in range(70)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tokens]), minlength=500)
    stats = packing.Statistics(len(tokens), float(np.mean([len(t) for t in tokens])), df)
    got = {}
    for d, start, length, sequence, offset in packing.pack(tokens, stats):
        got.setdefault(sequence, {}).update({offset + i: (d, start + i) for i in range(length)})
    want = plain_pack(tokens, stats)
    assert [[x[i] for i in range(len(x))] for x in (got[k] for k in sorted(got))] == want


def test_shards_do_not_depend_on_the_split(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "PLAN_DOCS", 40)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [sorted(packing.pack_documents(docs.repartition(n), corpus_pipeline.tokenizer_path()).collect()) for n in (1, 4, 23)]
    assert got[0] == got[1] == got[2] and len({r.sequence_id >> 32 for r in got[0]}) > 3


def test_large_topics_are_split(spark, encoder, monkeypatch):
    """One text on all rows, ids repeated and null: no shard takes more than its share."""
    monkeypatch.setattr(packing, "PLAN_DOCS", 50)
    docs = docs_of(spark, [(None if i % 3 else 7, "the same text", "en", "s") for i in range(900)])
    rows = packing.pack_documents(docs, corpus_pipeline.tokenizer_path()).where("start = 0").collect()
    sizes = {}
    for r in rows:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 900 and len(sizes) == 18 and max(sizes.values()) < 150


def test_statistics_are_of_all_documents(spark, encoder):
    """A word that is rare in its own split and common in the other one weighs little in both."""
    first = [(0, "red blue", "en", "s"), (1, "red cat", "en", "s"), (2, "dog blue", "en", "s")]
    other = [(10 + i, "red fish", "en", "s") for i in range(20)]
    docs = docs_of(spark, first).coalesce(1).union(docs_of(spark, other).coalesce(1))
    rows = packing.pack_documents(docs, corpus_pipeline.tokenizer_path()).where("start = 0 and doc_id < 10").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))] == [0, 2, 1]
    ids = [[*encoder.whole(x[1]).tolist(), 0] for x in first + other]
    table = spark.createDataFrame([(np.array(t, "<u4").tobytes(),) for t in ids], "ids binary").repartition(3)
    n, mean, df = packing.statistics(table)
    assert n == 23 and np.isclose(mean, np.mean([len(t) for t in ids]))
    assert {i: x for i, x in enumerate(df.tolist()) if x} == {i: sum(i in t for t in ids) for t in ids for i in t}
    assert packing.statistics(table.limit(0))[:2] == (0, 0)


def test_pipeline_against_plain_python(spark, sf, encoder):
    """Each stage on what its predecessor kept, against a plain version of it."""
    from test_jaccard import brute
    from test_rules_and_licenses import base

    from sparkdossier.llm import quality_classifier

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = corpus_pipeline.scratch(spark, "test")
        if name == "quality_classifier":
            model = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = {r.doc_id for r in quality_classifier.score_quality(docs, model).where("score >= 0.3").collect()}
        elif name == "quality_rules":
            want = set()
            for r in before:
                n, chars, symbols, dup, again = base(r.text)
                lines = [x for x in r.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                upper, letters = sum(c.isupper() for c in r.text), sum(c.isalpha() for c in r.text)
                bad = n < 50 or 100 * again > 50 * n or symbols > 0.1 * n or dup > 0.5 * len(lines) or not 2 * n <= chars <= 20 * n or 2 * upper > letters
                want |= set() if bad else {r.doc_id}
        elif name == "jaccard_join":
            want = {c for c, _ in brute([(r.doc_id, r.text) for r in before]).values()}
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            rows = docs.collect()
        else:
            assert docs.columns == columns, name
            seen[name] = docs.collect()
            if name != "mixing":
                assert sorted(r.doc_id for r in seen[name]) == sorted(want), name
                kept = {r.doc_id: r for r in before}
                assert all(r == kept[r.doc_id] for r in seen[name])
    # Mixing: documents, at most one of a leaf cut, and exactly as many tokens as there were.
    unique = {r.doc_id: r for r in seen["jaccard_join"]}
    parts = [r for r in seen["mixing"] if r != unique[r.doc_id]]
    assert all(unique[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text) for r in parts)
    leaves = [(r.lang, r.source) for r in parts]
    assert len(leaves) == len(set(leaves))
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert size(unique.values()) == size(seen["mixing"])
    # Packing: every drawn document whole, sequences gapless, no padding.
    drawn = [(r.doc_id, len(encoder.whole(r.text)) + 1) for r in seen["mixing"]]
    assert sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == sorted(drawn)
    assert sum(r.length for r in rows) == sum(n for _, n in drawn)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_repeats_beyond_one_part(spark):
    from pyspark.sql import functions as F

    from sparkdossier.llm.mixing import repeated, slice_digits

    rows = spark.createDataFrame([("a", 3), ("b", 0), ("c", 600), ("d", 256), ("e", 257)], "x string, times long")
    got = {}
    for r in repeated(rows, "times").collect():
        got.setdefault(r.x, []).append(r.mix_i)
    assert {x: sorted(v) for x, v in got.items()} == {x: list(range(1, n + 1)) for x, n in (("a", 3), ("c", 600), ("d", 256), ("e", 257))}
    digits = spark.sql("SELECT explode(array(0L, 1L, 100000L, 1000000000L, 100000000000L)) AS n").select(slice_digits(F.col("n"))).collect()
    assert [d[0] for d in digits] == [3, 3, 3, 4, 6]
