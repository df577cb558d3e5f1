import itertools
import random
import re

import pytest
from llm_helpers import docs_of
from sparkdossier.llm.jaccard_join import jaccard_classes, keep_one_per_class

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    """Class and links of each row, by comparing all pairs."""
    sets = [(i, shingles(x)) for i, x in rows]
    links, parent = {i: 0 for i, _ in sets}, {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12:
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in links}


def test_against_all_pairs_with_large_groups(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(40, 200))]
        for _ in range(r.choice((1, 2, 5, 60))):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base).upper() + "!"))
    want = brute(rows)
    got = jaccard_classes(docs_of(spark, [(i, x, "en", "s") for i, x in rows])).collect()
    true, found = sum(n for _, n in want.values()), sum(x.n_links for x in got)
    assert found <= true and found >= 0.99 * true
    assert sum(want[x.doc_id][0] == x.class_id for x in got) >= 0.99 * len(rows)


def test_marginal_pairs_beside_a_hot_group(spark):
    """Pairs near the least similarity that share no whole path, alone and beside close copies that all do."""
    import numpy as np

    from sparkdossier.llm import jaccard_join as J

    def misses(a, b):
        data = np.frombuffer((a + b).encode(), np.uint8)
        doc, h = J.text_sets(data, np.array([0, len(a), len(a) + len(b)]), 5)
        x, y = J.signatures(doc, h, 2).reshape(2, J.TREES, J.DEPTH)
        return not (x == y).all(axis=1).any()

    pairs = []
    for i in range(200):
        w = [f"p{i}x{j}" for j in range(100)]
        a, b = " ".join(w), " ".join(w[:90] + [f"q{i}x{j}" for j in range(10)])
        if misses(a, b):
            pairs += [a, b]
    assert len(pairs) > 8
    base = [f"h{j}" for j in range(300)]
    hot = [" ".join([*base[:-1], f"last{i}"]) for i in range(60)]
    for texts in (pairs, pairs + hot):
        want = brute(list(enumerate(texts)))
        got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_classes(docs_of(spark, [(i, x, "en", "s") for i, x in enumerate(texts)])).collect()}
        assert got == want
    assert J.path_depth(0.8, 0.999) == 4
    with pytest.raises(ValueError):
        J.path_depth(0.3, 0.999)
    with pytest.raises(ValueError):
        J.path_depth(0.5, 0.999, least_depth=4)


def test_sf_recall(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(x.doc_id, x.text) for x in docs.collect()])
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_classes(docs).collect()}
    assert got == want


@pytest.mark.parametrize("by_rows", [False, True])
def test_blocks_meet(spark, monkeypatch, by_rows):
    from sparkdossier.llm import jaccard_join as J

    monkeypatch.setattr(J, "BLOCK_MEMBERS", 10**9 if by_rows else 300)
    monkeypatch.setattr(J, "BLOCK_ROWS", 7 if by_rows else 128)
    r = random.Random(6)
    base = [f"x{i}" for i in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        w[r.randrange(80)] = f"y{i}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_classes(docs_of(spark, [(i, x, "en", "s") for i, x in rows])).collect()}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert all(x.class_id == 1 and x.text_id == 1 and x.copies == 3 for x in by[1]) and by[2][0].class_id == 1 and by[3][0].class_id == 1
    assert by[9][0].class_id == 8 and by[8][0].n_links == 1
    assert all(by[i][0].class_id == i and by[i][0].n_links == 0 for i in (4, 5, 6, 7, 10, 12))
    assert all(x.class_id is None for x in by[None])
    assert jaccard_classes(no_docs).count() == 0
    kept = keep_one_per_class(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 10, 11, 12]


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_unlike_words_of_equal_polynomial_hash_are_two_classes(spark):
    for n in (16, 64, 2048):
        got = jaccard_classes(docs_of(spark, [(i, x, "en", "s") for i, x in enumerate(thue_morse(n), 1)])).collect()
        assert sorted((x.class_id, x.n_links) for x in got) == [(1, 0), (2, 0)]


def test_one_id_on_several_texts(spark):
    """Each text has its own class; none is lost, and one row of each class stays."""
    one, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, one), (1, other), (2, one + " more"), (3, other), (1, one), (4, third), (4, None), (4, "?"), (4, None), (None, third)]
    docs = docs_of(spark, [(i, x, "en", "s") for i, x in rows])
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in jaccard_classes(docs).where("doc_id is not null").collect())
    assert got == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 4, 0), (4, 4, 0), (4, 4, 0), (4, 4, 0)]
    kept = sorted((x.doc_id, x.text or "") for x in keep_one_per_class(docs).where("doc_id is not null").collect())
    assert kept == sorted([(1, one), (1, other), (4, third), (4, ""), (4, "?")])
    assert keep_one_per_class(docs).where("doc_id is null").count() == 1


def test_recall_at_low_similarity(spark):
    """At 0.5 prefixes are shortened to one component; all pairs of some hundred are found."""
    r = random.Random(9)
    rows = []
    for _ in range(40):
        base = [f"v{r.randrange(4000)}" for _ in range(80)]
        for cut in (80, r.randrange(50, 80)):
            rows.append((len(rows), " ".join(base[:cut] + [f"u{r.randrange(4000)}" for _ in range(r.randrange(0, 20))])))
    sets = {i: shingles(x) for i, x in rows}
    want = sum(2 for a, b in itertools.combinations(sets.values(), 2) if len(a & b) >= 0.5 * len(a | b))
    got = sum(x.n_links for x in jaccard_classes(docs_of(spark, [(i, x, "en", "s") for i, x in rows]), least=0.5).collect())
    assert want > 60 and got == want


def test_many_short_near_copies(spark):
    """Some thousand messages of a few runs in one cluster: blocks are bounded by rows, and every link is counted."""
    from pyspark.sql import functions as F

    n = 6000
    head = " ".join(f"h{i}" for i in range(40))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(head + " tail"), F.col("id").cast("string")).alias("text"))
    got = jaccard_classes(docs).groupBy("class_id", "n_text_links", "n_links").count().collect()
    assert [tuple(x) for x in got] == [(0, n - 1, n - 1, n)]


def test_a_chain_is_compared_by_its_prefix_groups(spark):
    """Each text is near its two neighbours only; a component of all of them is never compared as a whole."""
    from sparkdossier.llm import jaccard_join as J

    n, step, words = 600, 8, 64
    rows = [(i, " ".join(f"t{i * step + j}" for j in range(words)), "en", "s") for i in range(n)]
    rows += [(n + i, rows[5][1], "en", "s") for i in range(3)]  # copies of one of them
    got = {r.doc_id: r for r in J.jaccard_classes(docs_of(spark, rows), least=0.7).collect()}
    assert all(got[i].class_id == 0 for i in got)
    assert [got[i].n_text_links for i in range(n)] == [1] + [2] * (n - 2) + [1]
    assert got[4].n_links == 2 + 3 and got[5].n_links == 2 + 3 and got[7].n_links == 2


def test_a_pair_counts_in_its_first_trie():
    from sparkdossier.llm import jaccard_join as J

    left, right = [[1, 2, 3], [1, 9, 9]], [[1, 2, 3], [7, 2, 3], [7, 8, 3]]
    assert J._met_before(left, right, 0).tolist() == [[False] * 3] * 2
    assert J._met_before(left, right, 1).tolist() == [[True, False, False], [True, False, False]]
    assert J._met_before(left, right, 2).tolist() == [[True, True, False], [True, False, False]]
