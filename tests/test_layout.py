"""Rows, cells, tables and reading order on pages of their own, at several parallelisms."""

import pytest
from pyspark.sql import functions as F

from sparkdossier.operators import layout

W = "doc_id long, side int, nr int, x0 double, y0 double, x1 double, tekst string"


def words_of(spark, rows, doc=1, side=1):
    return spark.createDataFrame([(doc, side, i, float(x0), float(y0), float(x1), t) for i, (x0, y0, x1, t) in enumerate(rows)], W)


def test_pieces_words_and_cells(spark):
    rows = [(10, 100, 20, "Dr"), (19.8, 100.5, 25, "a"), (25.1, 99, 35, "mm"), (35, 100, 40, "en"), (46, 100, 60, "by"), (90, 101, 110, "1"), (112, 101, 130, "970"), (10, 120, 30, "ny"), (0, 121, 5, "  "), (10, 103.2, 20, "egen")]
    got = layout.lines(layout.cells(words_of(spark, rows))).orderBy("linje").collect()
    assert [[c.tekst for c in r.celler] for r in got] == [["Drammen by", "1 970"], ["egen"], ["ny"]]
    assert [r.biter for r in got] == [3, 0, 0]


def table_words(sum_row):
    rows = [(50 + 100 * k, 100, 80 + 100 * k, t) for k, t in enumerate(("Periode", "Dager", "Dagsats", "Sum"))]
    for i in range(3):
        rows += [(50, 120 + 20 * i, 70, f"uke{i}"), (152, 120 + 20 * i, 160, str(5 + i)), (250, 120 + 20 * i, 280, "1970,41"), (350, 120 + 20 * i, 380, "9852,05")]
    return rows + sum_row


def test_a_row_with_an_empty_cell_keeps_its_columns(spark):
    words = words_of(spark, [(10, 10, 60, "Beregning"), *table_words([(50, 180, 70, "SUM"), (151, 180, 160, "18"), (350, 180, 380, "29556,15")])])
    got = layout.tables(layout.lines(layout.cells(words.repartition(5)))).orderBy("rad", "kolonne").collect()
    assert [r.tekst for r in got if r.rad == 4] == ["SUM", "18", "", "29556,15"]
    assert {r.overskrift for r in got if r.rad == 0} == {True} and {r.overskrift for r in got if r.rad} == {False}
    pages = spark.createDataFrame([(1, 1, "Beregning ..."), (1, 2, "urørt"), (2, 1, None)], "doc_id long, side int, tekst string")
    text = {(r.doc_id, r.side): r for r in layout.page_texts(words, pages).collect()}
    assert text[(1, 1)].tekst.split("\n")[1:3] == ["[TABELL: Periode, Dager, Dagsats, Sum]", "Periode: uke0 | Dager: 5 | Dagsats: 1970,41 | Sum: 9852,05"]
    assert text[(1, 1)].tekst.endswith("Periode: SUM | Dager: 18 | Sum: 29556,15") and text[(1, 1)].byttet
    assert text[(1, 2)].tekst == "urørt" and text[(2, 1)].tekst == "" and not text[(1, 2)].byttet
    long = pages.withColumn("tekst", F.repeat(F.lit("x"), 2000))
    assert not any(r.byttet for r in layout.page_texts(words, long).collect())


def test_tables_need_three_rows_that_fit(spark):
    two = [(50 + 100 * k, 100 + 20 * i, 80 + 100 * k, f"{i}{k}") for i in range(2) for k in range(3)]
    apart = [(50 + 130 * k, 140 + 20 * i, 80 + 130 * k, "x") for i in range(3) for k in range(3)]
    assert layout.tables(layout.lines(layout.cells(words_of(spark, two)))).count() == 0
    got = layout.tables(layout.lines(layout.cells(words_of(spark, two + apart)))).collect()
    assert {r.linje for r in got} == {2, 3, 4} and len(got) == 9  # the third line begins again as a first one
    assert layout.tables(layout.lines(layout.cells(words_of(spark, [])))).count() == 0


@pytest.mark.parametrize("parts", [1, 200])
def test_reading_order(spark, parts):
    # A tall letter in the second line overlaps the first by less than 45 %.
    rows = [(1, 1, 0, 200.0, 11.0, 260.0, 21.0, "to"), (1, 1, 1, 10.0, 10.0, 60.0, 20.0, " en "), (1, 1, 2, 10.0, 17.0, 60.0, 35.0, "tre"), (1, 1, 3, 80.0, 24.0, 99.0, 34.0, "fire"), (1, 1, 4, 300.0, 9.0, 350.0, 19.0, ""),
            (2, 1, 0, 5.0, 5.0, 9.0, 5.0, "flat"), (2, 1, 1, 1.0, 5.0, 4.0, 5.0, "a"), (2, 2, 0, 1.0, 1.0, 2.0, None, "x")]
    regions = spark.createDataFrame(rows, "doc_id long, side int, nr int, x0 double, y0 double, x1 double, y1 double, tekst string").repartition(parts)
    placed = layout.reading_order(regions)
    got = {(r.doc_id, r.side): r.tekst for r in layout.ordered_text(placed).collect()}
    assert got == {(1, 1): "en to\ntre fire", (2, 1): "a\nflat"}
    assert all(got[(r.doc_id, r.side)][r.start : r.slutt] == r.tekst for r in placed.collect())


def test_pages_are_read_once_and_odd_heights_lie_in_no_row(spark):
    words = words_of(spark, [(10, 100, 20, "a"), (10, float("inf"), 20, "b"), (40, 101, 50, "c"), (10, float("nan"), 20, "d")])
    got = layout.word_lines(words)
    plan = str(got._jdf.queryExecution().executedPlan())
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    rows = got.orderBy("linje").collect()
    assert [(r.linje, [c.tekst for c in r.celler], r.biter) for r in rows] == [(0, ["bd"], 1), (1, ["a", "c"], 0)]
    assert [(r.linje, r.celler, r.biter) for r in layout.lines(layout.cells(words)).orderBy("linje").collect()] == [(r.linje, r.celler, r.biter) for r in rows]
