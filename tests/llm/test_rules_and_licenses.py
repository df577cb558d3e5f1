import re
from collections import Counter

from sparkdossier.llm import license_scan, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.judge_quality(docs).collect():
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]), r.doc_id
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_order_never_changes_the_verdict(spark, odd_docs, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    kept = {r.doc_id for r in quality_rules.judge_quality(docs).where("kept").collect()}
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        assert {r.doc_id for r in quality_rules.keep_quality(docs, rules).collect()} == kept


def test_odd_rows(spark, odd_docs, no_docs):
    got = quality_rules.judge_quality(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in got if r.doc_id in (4, 5, 6))
    assert quality_rules.keep_quality(odd_docs).columns == odd_docs.columns
    assert quality_rules.judge_quality(no_docs).count() == 0 and quality_rules.keep_quality(no_docs).count() == 0


def test_licenses(spark, odd_docs, no_docs):
    from llm_helpers import docs_of

    texts = [
        "The MIT License and the mit-license, not mit licenses", "Licensed under the Apache License, Version 2.0. Licensed under the GNU General Public License, version 3",
        "Licensed under the very same Apache License, Version 2.0", "Licensed under CC BY-NC 4.0", "general public licence", "MKIT License MIT Lİcense", None, "",
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, [(i, x, "en", "s") for i, x in enumerate(texts)])).collect()}
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels) for i in range(8)] == [
        (2, 1, 5, "mit", "mit"), (2, 3, 12, "apache,gpl", "apache,gpl"), (1, 5, 5, "apache", "apache"), (0, None, None, "", "cc-by-nc"),
        (0, None, None, "", ""), (0, None, None, "", ""), (0, None, None, "", ""), (0, None, None, "", ""),
    ]
    assert got[6].n_words == 0 and got[6].score == 0.0 and got[1].spans[0].label in ("apache", "gpl")
    odd = license_scan.scan_licenses(odd_docs).collect()
    assert len(odd) == odd_docs.select("doc_id", "text").distinct().count()
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_a_position_counts_once_over_diagonals(spark):
    """Words of a license repeated do not stand for the ones that are missing."""
    from llm_helpers import docs_of

    texts = [
        "general public license general public license general public license", "licensed under the gnu lesser general public license",
        "licensed under the gnu licensed under the gnu general public license public license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "permission granted permission granted free person obtaining charge copy software and associated documentation files " * 4,
        "this work is of the and to any it is free of the program under the terms of it and or the of this " * 40,
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, [(i, x, "en", "s") for i, x in enumerate(texts)])).collect()}
    assert [(got[i].n_base, got[i].labels) for i in range(6)] == [(3, "gpl"), (1, "gpl,lgpl"), (1, "gpl"), (0, "mit"), (0, ""), (0, "")]
    assert got[3].spans[0].coverage == 1.0


def test_windows_of_a_long_text(spark):
    """Numbers of windows take as many bits as they need: 70,000 words, and short texts beside."""
    from llm_helpers import docs_of

    words = [f"w{i}" for i in range(70_000)]
    words[69_000:69_005] = words[100:105]
    texts = [" ".join(words), "a b c a b c", "a b", "a b c", ""]
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs_of(spark, [(i, x, "en", "s") for i, x in enumerate(texts)])).collect()}
    assert [(got[i].n_words, got[i].n_repeat_words) for i in range(5)] == [(base(x)[0], base(x)[4]) for x in texts]


def test_sample_of_one_text_many_times(spark):
    from llm_helpers import docs_of

    docs = docs_of(spark, [(7, "one text", "en", "s")] * 5000)
    order = quality_rules.order_rules(docs, sample_rows=100)
    assert {r.name: share for r, _, share in order}["few_words"] == 1.0


def plain_labels(text):
    """Labels by trying every window of every island of every template."""
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
    out = set()
    for x in license_scan.TEMPLATES:
        t = x.words.split()
        runs = [f"{a} {b}" for a, b in zip(t, t[1:])]
        by = {}
        for p, gram in enumerate(pairs):
            for q, run in enumerate(runs):
                if gram == run:
                    by.setdefault(p - q, set()).add((p, q))
        telling = lambda d: any(x.base or any(len(v) >= license_scan.LONG_WORD or v in license_scan.NAMES for v in runs[q].split()) for _, q in by[d])  # noqa: E731, B023
        islands = []
        for d in sorted(d for d in by if telling(d)):
            if islands and d - islands[-1][-1] <= (0 if x.base else license_scan.GAP):
                islands[-1].append(d)
            else:
                islands.append([d])
        for island in islands:
            hits = [h for d in island for h in by[d]]
            wide = license_scan.STRETCH * len(t) - license_scan.K
            best = max(len({q for p, q in hits if end - wide <= p <= end}) for end, _ in hits)
            if best >= (1.0 if x.base else license_scan.COVERAGE) * len(runs):
                out.add(x.label)
    return ",".join(sorted(out))


def test_chains_are_cut_at_their_best_window(spark):
    import random

    from llm_helpers import docs_of

    r = random.Random(8)
    words = ["licensed", "under", "the", "gnu", "lesser", "general", "public", "license", "mozilla", "x", "terms", "of"]
    notice = "licensed under the gnu lesser general public license"
    texts = [notice + " public license" * 6, "public license " * 9 + notice, "the gnu " * 30 + notice + " general public" * 40]
    texts += [" ".join(r.choice([notice, r.choice(words), "public license", "under the gnu", "lesser general"]) for _ in range(r.randrange(2, 40))) for _ in range(60)]
    texts += [" ".join(r.choice(words) for _ in range(400)) for _ in range(20)]
    got = {x.doc_id: x for x in license_scan.scan_licenses(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert all(got[i].labels == "gpl,lgpl" for i in range(3))
    assert [got[i].labels for i in range(len(texts))] == [plain_labels(t) for t in texts]
