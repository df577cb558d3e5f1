"""URL filters, vector codes and spelling variants against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdossier.llm import spelling_variants as S
from sparkdossier.llm import url_filters as U
from sparkdossier.llm import vector_codes as V


# --- vector codes


def plain_codes(rows, rounds=2, entries=64):
    """``{(vec_id, code, error, label_error)}`` and the digest, for rows whose vectors are all of one length."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    cut = lambda v: [v[p * w : p * w + w] for p in range(16)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(16):
            of = {}
            for _, v, _ in kept:
                of.setdefault(nearest(p, cut(v)[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        best = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    per = Counter()
    for _, _, e, label in out:
        per[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, per[label]) for i, c, e, label in out), key=repr), digest


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, n int, points string, places int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "e", 1, "p", 2) for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("width", [1, 4])
def test_codes_against_plain(spark, width):
    r = random.Random(width)
    rows = [(i, [r.choice([0.0, 0.25, -1.5, r.gauss(0, 1)]) for _ in range(16 * width)], r.choice([None, 1, 2])) for i in range(300)]
    rows += [rows[7], rows[7], (None, rows[8][1], 3), (400, None, 1), (401, [], 1), (402, [float("nan")] * 16 * width, 1), (403, [None] * 16 * width, 1), (404, [float("inf")] * 16 * width, 2)]
    want, digest = plain_codes(rows)
    for parts in (1, 7):
        got = V.encode_vectors(vectors_of(spark, rows).repartition(parts)).collect()
        assert sorted(((x.vec_id, x.code, x.error, x.label_error) for x in got), key=repr) == want
        assert {x.codebooks_sha256 for x in got} == {digest}


def test_codes_of_odd_vectors(spark):
    rows = [(1, [1.0] * 16, 1), (2, [2.0] * 32, 1), (3, [1e30] * 16, 1), (4, [-3.5] * 16, None), (5, [1.0] * 3, None)]
    got = {x.vec_id: (x.code, x.error, x.label_error) for x in V.encode_vectors(vectors_of(spark, rows)).collect()}
    assert got == {1: ("00" * 16, 0, 0), 4: ("01" * 16, 0, 0), 2: (None, None, 0), 3: (None, None, 0), 5: (None, None, 0)}
    assert V.encode_vectors(vectors_of(spark, [])).count() == 0
    alone = V.encode_vectors(vectors_of(spark, [(5, [1.0] * 3, None)])).collect()
    assert [(x.vec_id, x.code, x.error) for x in alone] == [(5, None, None)]


def test_forest_assigns_as_all_distances_do():
    r = np.random.default_rng(5)
    for rows, k in ((1, 1), (13, 64), (900, 64)):
        parts = r.integers(-6, 6, (16, rows, 3)) * r.choice([1, 1000])
        books = np.stack([parts[:, r.integers(0, rows), :] + r.integers(-1, 2, (16, 3)) for _ in range(k)], 1)
        code, sums, counts = V.Forest.build(parts).assign(books)
        gap = ((parts[:, :, None, :] - books[:, None, :, :]) ** 2).sum(3)
        want = gap.argmin(2)
        assert (code == want).all()
        for p in range(16):
            for e in range(k):
                assert counts[p * k + e] == (want[p] == e).sum()
                assert (sums[p * k + e] == parts[p][want[p] == e].sum(0)).all()


def test_forest_assigns_subtrees_whole(monkeypatch):
    r = np.random.default_rng(1)
    parts = np.concatenate([r.integers(0, 50, (16, 2000, 4)), r.integers(100_000, 100_050, (16, 2000, 4))], 1)
    books = np.stack([np.full((16, 4), 25), np.full((16, 4), 100_025)], 1)
    monkeypatch.setattr(V.Forest, "_leaves", None)  # two far groups never come down to a leaf
    _, _, counts = V.Forest.build(parts).assign(books)
    assert (counts == 2000).all()


def test_label_errors_beyond_the_broadcast(spark):
    rows = spark.createDataFrame([(i, "c", i, i % 7 if i % 5 else None) for i in range(200)], "vec_id long, code string, error long, vq_label int")
    a, b = (sorted(map(tuple, V._with_label_error(rows, limit).collect())) for limit in (100, 2))
    assert a == b and len(a) == 200


# --- spelling variants


def plain_variants(docs):
    count = Counter()
    low = str.maketrans(S._UPPER, S._LOWER)
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: {o for o in words if one_letter(w, o)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def one_letter(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_words_against_all_pairs(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abÿ") for _ in range(r.randrange(1, 8))) for _ in range(400)})
    got = S.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    want = {(a, b) for a, b in itertools.permutations(words, 2) if one_letter(a, b)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_variants_against_plain(spark, odd_docs):
    r = random.Random(4)
    base = ["alphabet", "alphabets", "alphebet", "straße", "strasse", "ÉCOLE", "école", "École", "aaaaaa", "aaaaa", "aaabaaa", "garden", "gardens", "warden"]
    rows = [(i, " ".join(r.choice(base) + r.choice(["", "", "-x", "×", "s"]) for _ in range(60))) for i in range(80)] + [(None, "garden garden"), (3, None), (4, ""), (5, "日本 ×÷ 12")]
    docs = spark.createDataFrame([(*row, 1, "w", "f") for row in rows], "doc_id long, text string, n int, word string, form string")
    got = {(x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in S.spelling_variants(docs).collect()}
    assert got == plain_variants(rows)
    odd = [(x.doc_id, x.text) for x in odd_docs.collect()]
    got = [(x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in S.spelling_variants(odd_docs).collect()]
    assert set(got) == plain_variants(odd) and len(got) == len(set(got))
    assert S.spelling_variants(odd_docs.where(F.lit(False))).count() == 0


def test_roots_follow_long_chains(spark):
    counts = {"aaaaa" + "b" * k: 3 * 2**k for k in range(9)}
    docs = spark.createDataFrame([(None, " ".join([w] * n)) for w, n in counts.items()], "doc_id long, text string")
    assert {(x.word, x.root) for x in S.spelling_variants(docs).collect()} == {(w, "aaaaa" + "b" * 8) for w in counts}


# --- URL filters


def test_urls_and_rules(spark):
    urls = [
        ("http://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("x://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"), ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"), ("http://a.com/de", "a.com", "/de", None, "allow"),
        ("http://a.com/de/#x", "a.com", "/de/", "com/de/", "block"), ("http://org", "org", "", None, "allow"), ("http://a.org:80/", "a.org:80", "/", None, "allow"), (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?q", "", "", None, "allow"), ("a://b://c/", "b:", "//c/", None, "allow"), ("http://İé.net/\n/z", "İé.net", "/\n/z", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "h", "r", 1, "w") for i, (u, *_) in enumerate(urls)], "page_id long, url string, html string, host string, rule string, n int, word string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in U.judge_urls(pages.unionByName(pages)).collect()}
    assert got == {i: tuple(w) for i, (_, *w) in enumerate(urls)}
    assert U.judge_urls(pages).count() == len(urls)
    assert U.judge_urls(pages.where(F.lit(False))).count() == 0


def test_viterbi_against_all_splits():
    known = {"a": 50, "ab": 9, "b": 40, "abc": 2, "bca": 3, "c": 1}
    total = float(sum(known.values()))
    for name in map("".join, itertools.product("abcd", repeat=5)):
        parts = {(i, j): math.log(total) - math.log(known[name[i:j]]) for i in range(5) for j in range(i + 1, 6) if name[i:j] in known}
        cost = lambda i, j: parts.get((i, j), math.log(total) - math.log(10) + (j - i) * math.log(10))  # noqa: E731, B023
        splits = [[0, *c, 5] for n in range(5) for c in itertools.combinations(range(1, 5), n)]
        least = min(sum(cost(i, j) for i, j in itertools.pairwise(s)) for s in splits)
        got = np.cumsum([0, *map(len, U.best_split(name, parts, total))]).tolist()
        assert abs(sum(cost(i, j) for i, j in itertools.pairwise(got)) - least) < 1e-9


def test_hosts_are_split_and_scored(spark):
    r = random.Random(1)
    good, bad = ["river", "garden", "museum", "library"], ["casino", "lucky", "spin"]
    rows = []
    for _ in range(200):
        words = r.sample(good, 2) if r.random() < 0.7 else ["casino", r.choice(bad[1:])]
        rows.append((f"http://{''.join(words)}.net/{'win' if 'casino' in words else 'read'}/{r.randrange(99)}", f"<p class=x>{' '.join(r.choices(good + bad, k=12))}</p>&amp;"))
    rows += [("http://luckyspin.net/win/1", ""), ("http://rivergarden.net/read/1", None), ("http://" + "x" * 70 + ".net/read/", "")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {x.page_id: x for x in U.judge_urls(pages).collect()}
    assert got[200].host_words == "lucky spin net" and got[200].verdict == "block"  # a host no sample was made of
    assert got[201].host_words == "river garden net" and got[201].verdict == "allow"
    assert got[202].host_words == "x" * 70 + " net"
    assert all((got[i].verdict == "block") == ("casino" in u) for i, (u, _) in enumerate(rows[:200]))
    # Naive Bayes by hand.
    tokens = [(["h:" + w for w in got[i].host_words.split()] + ["p:" + w for w in re.findall("[a-z]+|0", re.sub("[0-9]+", "0", got[i].path))], "casino" in got[i].host_words) for i in got]
    count = {c: Counter(t for ts, s in tokens if s == c for t in ts) for c in (True, False)}
    seen = len(set(count[True]) | set(count[False]))
    log = lambda c, t: math.log(count[c][t] + 0.5) - math.log(sum(count[c].values()) + 0.5 * seen)
    n = Counter(s for _, s in tokens)
    for (ts, _), i in zip(tokens, got, strict=True):
        odds = math.log(n[True] + 0.5) - math.log(n[False] + 0.5) + sum(log(True, t) - log(False, t) for t in ts)
        assert abs(got[i].score - 1 / (1 + math.exp(-odds))) < 1e-4


def test_hot_and_other_hosts_join_alike(spark):
    urls = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"h{i}") for i in range(3000)], "page_id long, host string")
    hosts = urls.groupBy("host").agg(F.count("*").alias("n")).selectExpr("host", "n", "host as host_words", "array(1) as host_buckets", "false as sample")
    got = U._with_hosts(urls, hosts, 3000)
    assert got.count() == 3000 and got.where("host = host_words").count() == 3000
