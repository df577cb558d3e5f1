"""Queries over contact data, digit runs, words and answer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.operators import contact as C
from sparkdossier.plans.queries import query
from sparkdossier.sources.tables import bare, derived

_LETTER = (
    "SELECT o_orderkey AS doc_id, 'Tlf: +47 ' || CAST(20 + o_orderkey % 70 AS STRING) || ' 12 34 5' || CAST(o_orderkey % 10 AS STRING) || chr(10) || 'Kundenr: 2' || lpad(CAST(o_custkey AS STRING), 7, '0') || chr(10) "
    "|| CASE o_orderkey % 3 WHEN 0 THEN 'Sum kr 100' WHEN 1 THEN 'Sum 100 eur' ELSE 'Sum 100' END || chr(10) || 'Forfallsdato: ' || CAST(day(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(year(o_orderdate) AS STRING) || chr(10) "
    "|| lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || ' Oslo' || chr(10) || 'postboks 1234 Oslo' AS tekst FROM {orders}"
)


@query("SELECT o_orderkey AS doc_id, CAST(20 + o_orderkey % 70 AS STRING) || '12345' || CAST(o_orderkey % 10 AS STRING) AS telefon FROM orders")
def i11_phones(spark, d):
    return derived(spark, d, _LETTER, deal=True).select("doc_id", F.array_join(C.phones(F.col("tekst")), ",").alias("telefon"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'NOK' WHEN 1 THEN 'EUR' END AS valuta FROM orders")
def b5_currency(spark, d):
    return derived(spark, d, _LETTER, deal=True).select("doc_id", C.currency(F.col("tekst")).alias("valuta"))


@query("SELECT o_orderkey AS doc_id, lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || ' Oslo' AS sted FROM orders")
def x1_post_places(spark, d):
    return derived(spark, d, _LETTER, deal=True).select("doc_id", F.array_join(C.post_places(F.col("tekst")), ",").alias("sted"))


_BOX = "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 90 AS DOUBLE) AS x0, CAST(l_suppkey % 90 AS DOUBLE) AS y0, CAST(l_partkey % 90 + l_quantity - 5 AS DOUBLE) AS x1, CAST(l_suppkey % 90 + 10 AS DOUBLE) AS y1, 640 AS bredde, 480 AS hoyde, l_discount * 10 AS konfidens, CASE WHEN l_linestatus = 'O' THEN 'handskrift' ELSE 'trykt' END AS skrift FROM {lineitem}"


@query(
    f"SELECT id, round(100.0::DOUBLE * x0 / 640, 4) AS x, round(100.0::DOUBLE * y0 / 480, 4) AS y, round(100.0::DOUBLE * (x1 - x0) / 640, 4) AS width, round(100.0::DOUBLE * (y1 - y0) / 480, 4) AS height, "
    f"CASE WHEN konfidens < 0.35 THEN 'Uleselig' WHEN skrift = 'handskrift' THEN 'Håndskrift' ELSE 'Trykt tekst' END AS etikett, round(konfidens, 3) AS score FROM ({bare(_BOX)}) WHERE x1 > x0 AND y1 > y0"
)
def v10_rectangles(spark, d):
    return C.rectangles(derived(spark, d, _BOX))


_PAGES = "SELECT conv_id AS doc_id, turn AS side, text AS tekst FROM {conversations}"
_KEYS = "SELECT conv_id AS sporsmal, conv_id AS doc_id, CASE WHEN conv_id % 7 = 0 THEN 'negativ' ELSE 'modell' END AS type, substr(text, 5, 12) AS bit FROM {conversations} WHERE turn = 1"


@query(
    f"WITH p AS ({bare(_PAGES)}), q AS ({bare(_KEYS)}), t AS (SELECT doc_id, count(DISTINCT side) AS alle FROM p GROUP BY doc_id), h AS (SELECT q.sporsmal, list_sort(list(DISTINCT p.side)) AS treff FROM q JOIN p USING (doc_id) WHERE q.type <> 'negativ' AND length(q.bit) >= 3 AND contains(p.tekst, q.bit) GROUP BY q.sporsmal) "
    "SELECT DISTINCT sporsmal, CASE WHEN type = 'negativ' THEN '' WHEN len(treff) * 2 <= alle THEN array_to_string(treff, ',') END AS sider FROM q JOIN t USING (doc_id) LEFT JOIN h USING (sporsmal)"
)
def x18_answer_pages(spark, d):
    return C.answer_pages(derived(spark, d, _KEYS), derived(spark, d, _PAGES))
