"""Costs that must not grow faster than the input, and whole tables that must not pass through the driver."""

import time

from pyspark.sql import functions as F

from sparkdossier.functions import scanners

DATED = "Dato 3. mars 1996, frist 1997-03-01, ugyldig 31.02.2001, kort 3/3/96 og March 3, 2020, sist 02 . 03 .2004kr, 1.1.1700, 20261231"


def best(f, times=5):
    taken = []
    for _ in range(times):
        at = time.perf_counter()
        for _ in range(200):
            f()
        taken.append(time.perf_counter() - at)
    return min(taken)


def test_placing_dates_costs_no_more_than_finding_them():
    assert best(lambda: scanners._dates(DATED, 2026)) < 4 * best(lambda: scanners.date_hits(DATED, 2026))


def broadcasts(df):
    return str(df._jdf.queryExecution().executedPlan()).count("BroadcastExchange")


def stored(df, path):
    """``df`` as a table of a known, small size."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_field_guard_sends_no_table_through_the_driver(spark, tmp_path):
    from sparkdossier.operators import guards

    answers = stored(spark.createDataFrame([(1, 1, "Hvor stort gebyr?", "kr 12,50")], "id long, doc_id long, sporsmal string, svar string"), tmp_path / "a")
    sources = stored(spark.createDataFrame([(1, "Dagsats: kr 12,50")], "doc_id long, tekst string"), tmp_path / "s")
    assert broadcasts(guards.field_guard(answers, sources)) == 0


def test_near_words_send_no_table_through_the_driver(spark, tmp_path):
    from sparkdossier.llm import spelling_variants

    words = stored(spark.createDataFrame([("kontoret",), ("kontorat",)], "word string"), tmp_path / "w")
    assert broadcasts(spelling_variants.near_words(words)) == 0


def test_hits_are_judged_in_the_scan_as_by_expressions(spark):
    import random

    from pyspark.sql import functions as F

    from sparkdossier.functions import identifiers as I

    draw = random.Random(3)
    numbers = [f"{draw.randint(1, 75):02d}{draw.randint(1, 93):02d}{draw.randrange(10**7):07d}" for _ in range(4000)]
    numbers += [str(draw.randrange(10 ** draw.randint(2, 26))) for _ in range(2000)] + [f"{draw.randrange(10**9):09d}" for _ in range(500)]
    checks = {I.is_person: I.valid_person, I.is_account: I.valid_account, I.is_company: I.valid_company, I.is_payment_reference: I.valid_payment_reference}
    c = F.col("n")
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", *(f(c).alias(f"c{i}") for i, f in enumerate(checks.values()))).collect()
    for row in rows:
        assert [f(row["n"]) for f in checks] == list(row[1:]), row["n"]
    assert all(sum(row[i] for row in rows) > 5 for i in range(1, 5))


def test_binomial_tail_needs_no_array_of_all_terms():
    from math import comb

    from sparkdossier.operators import evaluation

    for a, b in ((0, 0), (3, 9), (40, 30), (500, 520)):
        assert abs(evaluation.binomial_tail(a, b) - sum(comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b)) < 1e-9
    assert best(lambda: evaluation.binomial_tail(10**6, 10**6 + 1000), 1) < 20


def test_resampling_weights_by_a_table_are_those_of_the_hashes():
    import math

    import numpy as np
    import pyarrow as pa

    from sparkdossier.operators.evaluation import _resample

    ids, rounds, seed, mask = [5, -3, 10**12, 77, *range(40)], 300, 9, (1 << 64) - 1
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    want = np.zeros(rounds)
    for r in range(rounds):
        for i in ids:
            h = (i & mask) ^ ((r + 1 + seed) * 0x9E3779B97F4A7C15 & mask)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> shift)) * factor & mask
            want[r] += np.searchsorted(edges, ((h ^ (h >> 31)) >> 11) / float(1 << 53), "right")
    ones = pa.array(np.ones(len(ids)))
    got = next(_resample(rounds, seed)(iter([pa.RecordBatch.from_arrays([pa.array(ids), ones, ones], ["id", "e", "c"])])))
    assert got.column(1).to_numpy().tolist() == want.tolist()


def test_pages_are_folded_many_at_a_time(spark):
    from sparkdossier.operators import layout

    regions = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 9.0, 9.0, "a")], "doc_id long, side int, nr int, x0 double, y0 double, x1 double, y1 double, tekst string")
    lines = layout.lines(layout.cells(regions.drop("y1")))
    for df in (layout.reading_order(regions), layout.tables(lines)):
        assert "InPandas" not in str(df._jdf.queryExecution().executedPlan())


def test_unsupported_numbers_take_one_shuffle_and_rows_that_repeat_change_nothing(spark):
    from sparkdossier.operators import spans

    answers = [(1, "kr 1 200,50 og 12.03.2024, 999"), (1, "999 og 1 200,50"), (2, "500"), (None, "700")]
    sources = [(1, "12. mars 2024, 1200,5"), (1, "1200,5"), (None, "700")]
    a = spark.createDataFrame(answers * 3, "id long, svar string")
    got = spans.unsupported_numbers(a, spark.createDataFrame(sources * 2, "id long, kilde string"))
    plan = str(got._jdf.queryExecution().executedPlan())
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "999"), (2, "500"), (None, "700")], key=str)


def test_a_period_takes_one_shuffle_and_one_sort_of_its_dates(spark):
    from sparkdossier.operators import documents
    from sparkdossier.plans import more_queries

    rows = [(1, 1, 1, "2024-01-01"), (1, 2, 1, "2024-03-01"), (1, 3, None, "2024-03-01"), (2, 1, 1, "2024-01-01"), (3, 1, None, None)]
    dates = spark.createDataFrame(rows, "doc_id long, nr long, side int, dato string").withColumn("dato", F.to_date("dato"))
    got = documents.period_of(dates).selectExpr("doc_id", "string(fra)", "string(til)", "datoer", "sider", "flere").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "2024-01-01", "2024-03-01", 2, 1, False), (2, "2024-01-01", "2024-01-01", 1, 1, False), (3, None, None, 0, 0, False)]
    plan = str(more_queries.a21_bundle_period(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Expand" not in plan


def test_distance_by_a_band_is_that_of_the_whole_square(spark):
    import random

    from sparkdossier.operators import evaluation

    draw = random.Random(1)
    word = lambda: "".join(draw.choice("thaeø") for _ in range(draw.randrange(24)))
    rows = spark.createDataFrame([(word(), word()) for _ in range(500)] + [("a", None), (None, None)], "a string, b string")
    got = rows.select(evaluation.distance(F.col("a"), F.col("b")).alias("x"), F.levenshtein("a", "b").alias("y"))
    assert got.where("not (x <=> y)").count() == 0 and got.where("x > 6").count() > 50 and got.where("x between 1 and 6").count() > 50


def test_components_are_sought_among_heads_only(spark, monkeypatch):
    from sparkdossier.operators import cases

    sought = []
    whole = cases.connected_components
    monkeypatch.setattr(cases, "connected_components", lambda edges, *names: sought.append(edges.count()) or whole(edges, *names))
    rows = [(i, "1", None) for i in range(5, 40)] + [(40, "1", "J"), (41, " 2", "J"), (42, "2", None), (43, None, None), (44, None, "K"), (3, None, "K"), (None, "1", "K")]
    docs = spark.createDataFrame(rows, "doc_id long, saksnummer string, journalnummer string")
    got = {r.doc_id: r.sak for r in cases.group_cases(docs).collect()}
    assert got == {i: 5 for i in range(5, 43)} | {43: 43, 44: 3, 3: 3, None: None}
    assert len(sought) == 1 and sought[0] <= 2


def test_totals_need_no_window_and_rows_that_repeat_stay_apart(spark):
    from sparkdossier.operators import labelled

    docs = spark.createDataFrame([(1, "Sum kr:"), (1, "x\nkr 9,00"), (2, "Sum\nkr 7,00"), (3, None), (4, "Sum")], "doc_id long, tekst string")
    got = labelled.totals(docs)
    assert "Window" not in str(got._jdf.queryExecution().executedPlan())
    assert [tuple(r) for r in got.collect()] == [(2, 7.0)]


def test_identifier_answers_merge_and_scan_each_text_once(spark, tmp_path):
    from sparkdossier.operators import redaction, service
    from sparkdossier.plans import service_queries

    asked = spark.createDataFrame([(1, 1, "Hva er e-posten?"), (2, 2, "Telefonnummer?"), (3, 1, "Hvor?")], "id long, doc_id long, sporsmal string")
    docs = stored(spark.createDataFrame([(1, "b@x.no, a@x.no og b@x.no"), (1, "a@x.no"), (2, "ingen"), (None, "c@x.no")], "doc_id long, tekst string"), tmp_path / "d")
    got = service.identifier_answers(stored(asked, tmp_path / "q"), redaction.redacted_spans(docs, ("epost", "telefon")))
    assert broadcasts(got) == 0
    assert sorted(map(tuple, got.collect())) == [(1, "a@x.no,b@x.no"), (2, None)]
    plan = str(service_queries.z3_identifier_questions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
    assert plan.count("BroadcastExchange") == 0 and plan.count("ArrowEvalPython") == 2


def test_identifiers_are_found_and_removed_in_one_pass(spark):
    from sparkdossier.operators import redaction

    docs = spark.createDataFrame([(1, "Konto 12345678903, ring +47 22334455 eller skriv til a.b@x.no, kr 500"), (1, "org.nr 123456789"), (2, None), (3, "")], "doc_id long, tekst string")
    for got in (redaction.redact(docs), redaction.suspects(docs), redaction.redaction_report(docs)):
        plan = str(got._jdf.queryExecution().executedPlan())
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    rows = {(r.doc_id, r.sladdet): r.antall for r in redaction.redact(docs).collect()}
    assert rows == {(1, "Konto [SLADDET kontonummer], ring [SLADDET telefon] eller skriv til [SLADDET epost], kr 500"): {"epost": 1, "kontonummer": 1, "telefon": 1}, (1, "org.nr 123456789"): {}, (2, None): {}, (3, ""): {}}
    assert [(r.type, r.posisjon, r.lengde, r.grunn) for r in redaction.suspects(docs).collect()] == [("organisasjonsnummer", 7, 9, "kontrollsiffer_feilet")]


def test_amounts_and_runs_are_ruled_out_before_they_are_sought():
    assert scanners.amount_hits("Skriv i nokså ordre 12, kroken 7") == [] and [a[2] for a in scanners.amount_hits("7 KR og Nok 8, 9 Kr")] == ["7", "8", "9"]
    assert scanners._runs("12 34\r\n5 - 6 78, 9") == [[(0, 2), (3, 5), (7, 8)], [(11, 12), (13, 15)]]
    assert [d for _, _, d in scanners.phone_hits("004722334455, 99922334455, 22 33 44 55, ordrenr: 22334455")] == ["22334455", "22334455"]
    assert [m[2] for m in scanners._mails("a@b.co+x@y.no, b@c.no@d.no " + "a" * 65 + "@x.no")] == ["a@b.co", "b@c.no"]
    longs = "x" * 400_000 + "@"
    assert best(lambda: list(scanners._mails(longs)), 1) < 5


def test_dates_are_classified_in_the_scan_and_rows_that_repeat_stay_apart(spark):
    from sparkdossier.operators import dates

    docs = spark.createDataFrame([(1, "FØDT 1.2.1980 - 3.4.1990"), (1, "Mottatt 5.6.2020"), (2, None), (3, "")], "doc_id long, tekst string")
    got = dates.classify(docs, 2026)
    plan = str(dates.stamps(got)._jdf.queryExecution().executedPlan())
    assert "Window" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") == 1
    assert sorted((r.nr, r.type, str(r.dato)) for r in got.collect()) == [(0, "mottatt", "2020-06-05"), (0, "periode_start", "1980-02-01"), (1, "periode_slutt", "1990-04-03")]
    assert dates.nearest_label("FØDT og søknad datert ") == ("soknadsdato", "søknad datert") and dates.nearest_label("FØDT ") == ("fodselsdato", "FØDT")
    assert dates.nearest_label("f.o.m. sett ", '[["SETT", "egen"]]') == ("egen", "sett") and dates.nearest_label("uten ") is None


def test_a_period_shuffles_its_ends_only(spark):
    from sparkdossier.operators import dates

    docs = spark.createDataFrame([(1, "Fra 1.1.1990 til 2.2.1991. Mottatt 3.3.1992"), (2, "Mottatt 3.3.1992"), (3, "1.1.1990 - 2.2.1991, 3.3.1993 - 4.4.1994")], "doc_id long, tekst string")
    got = dates.period(dates.classify(docs, 2026))
    plan = str(got._jdf.queryExecution().executedPlan())
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
    assert sorted((r.doc_id, str(r.fra), str(r.til)) for r in got.collect()) == [(1, "1990-01-01", "1991-02-02"), (3, "1990-01-01", "1991-02-02")]


def test_page_texts_are_built_in_one_pass_over_pages_that_batches_cut(spark):
    from sparkdossier.operators import layout

    names, size = ["Navn", "Dager", "Sum"], "spark.sql.execution.arrow.maxRecordsPerBatch"
    words = [(d, 1, r * 3 + k, 50.0 + 100 * k, 100.0 + 14 * r, 80.0 + 100 * k, names[k] if r == 0 else str(r * 10 + k)) for d in range(30) for r in range(1 + d % 5) for k in range(3)]
    w = spark.createDataFrame(words, "doc_id long, side int, nr int, x0 double, y0 double, x1 double, tekst string")
    pages = spark.createDataFrame([(d, 1, "kort") for d in range(31)], "doc_id long, side int, tekst string")
    old = spark.conf.get(size)
    spark.conf.set(size, "4")
    try:
        got = layout.page_texts(w, pages)
        plan = str(got._jdf.queryExecution().executedPlan())
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and plan.count("Join") == 1
        rows = {r.doc_id: r.tekst for r in got.collect()}
    finally:
        spark.conf.set(size, old)
    line = lambda r: f"Navn: {r * 10} | Dager: {r * 10 + 1} | Sum: {r * 10 + 2}"
    assert rows == {d: "\n".join(["[TABELL: Navn, Dager, Sum]", *map(line, range(1, 1 + d % 5))]) if d < 30 and d % 5 >= 2 else "kort" for d in range(31)}


def test_field_guard_takes_one_join_and_keys_of_a_text_are_bound_once(spark, tmp_path):
    from sparkdossier.operators import guards

    answers = [(1, 1, "Hvor stort gebyr gebyr?", "kr 12,50"), (2, 1, "Dagsatsen?", "kr 12,50"), (3, 2, "Gebyr?", "kr 12,50"), (4, None, "Gebyr?", "kr 12,50"), (5, 1, None, "12,50 og 99,00")]
    a = stored(spark.createDataFrame(answers, "id long, doc_id long, sporsmal string, svar string"), tmp_path / "a")
    s = stored(spark.createDataFrame([(1, "Dagsats: kr\r\n12,50"), (2, " \u00a0\n"), (None, "12,50")], "doc_id long, tekst string"), tmp_path / "s")
    got = guards.field_guard(a, s)
    plan = str(got._jdf.queryExecution().executedPlan())
    assert plan.count("Join") == 1 and plan.count("Exchange hash") == 2 and broadcasts(got) == 0
    assert {r.id: (r.gjelder, r.verdier, r.fravaerende) for r in got.collect()} == {
        1: (True, ["12,50"], ["stort", "gebyr", "gebyr"]), 2: (False, ["12,50"], []), 3: (False, [], []), 4: (False, [], []), 5: (False, ["12,50", "99,00"], []),
    }


def test_signatures_are_sought_only_where_their_letters_stand():
    from sparkdossier.operators import dates

    for words in ("sign.", "SIGNATUR", "Underskrift", "underskrevet", "undertegnet", "Med vennlig hilsen", "MVH", "vennlig  hilsen", "sted/dato", "Dato og sted", "ſignatur"):
        assert dates._SIGNATURE.search(words) and scanners._may_hold(words, dates._IN_SIGNATURES), words
    text = "Linje uten noe\n" * 20 + "Stempel og hilsen fra arkivet om x 05.05.1991\n" + "Vi viser til samtalen\n" * 3
    assert best(lambda: dates.classified_dates(text, 2026, "[]", 200)) < 5 * best(lambda: scanners.date_hits(text, 2026))
