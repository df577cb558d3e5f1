"""Queries over the places of words and regions on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.operators import layout
from sparkdossier.plans.queries import query
from sparkdossier.sources.tables import bare, derived

# One to six lines for each order.
_LINES = (
    "(SELECT o_orderkey AS l_orderkey, n AS l_linenumber, o_custkey * 7 + n AS l_partkey, o_custkey + n AS l_suppkey, (o_orderkey + n) % 50 AS l_quantity FROM {orders}, "
    "(SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS u WHERE n <= 1 + o_orderkey % 6)"
)
# A page for each order with a row for each line of it: period, days (missing on every third), rate and a sum in two pieces, below
# a row of names. Heights of a row's words differ by up to two points.
_WORDS = f"""
SELECT o_orderkey AS doc_id, 1 AS side, 0 * 10 + k AS nr, CAST(50 + 100 * k AS DOUBLE) AS x0, CAST(100 AS DOUBLE) AS y0, CAST(80 + 100 * k AS DOUBLE) AS x1,
  CASE k WHEN 0 THEN 'Periode' WHEN 1 THEN 'Dager' WHEN 2 THEN 'Sats' ELSE 'Sum' END AS tekst FROM {{orders}}, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS v
UNION ALL SELECT l_orderkey, 1, l_linenumber * 10 + k, CAST(CASE k WHEN 0 THEN 48 WHEN 1 THEN 152 WHEN 2 THEN 255 WHEN 3 THEN 350 ELSE 365 END AS DOUBLE),
  CAST(100 + 14 * l_linenumber + (l_partkey + k) % 3 AS DOUBLE), CAST(CASE k WHEN 0 THEN 75 WHEN 1 THEN 165 WHEN 2 THEN 280 WHEN 3 THEN 365 ELSE 375 END AS DOUBLE),
  CASE k WHEN 0 THEN 'uke' || CAST(l_suppkey % 52 AS STRING) WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) WHEN 2 THEN CAST(l_partkey % 1000 AS STRING) WHEN 3 THEN CAST(100 + l_partkey % 900 AS STRING) ELSE ',' || CAST(10 + l_suppkey % 90 AS STRING) END
FROM {_LINES}, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS v WHERE NOT (k = 1 AND l_linenumber % 3 = 0)
"""
_PAGES = "SELECT o_orderkey AS doc_id, 1 AS side, CASE WHEN o_orderkey % 10 = 0 THEN repeat('x', 5000) ELSE 'Periode Dager Sats Sum' END AS tekst FROM {orders}"
_CELLS = f"""
r AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rad, 'uke' || CAST(l_suppkey % 52 AS VARCHAR) AS a,
  CASE WHEN l_linenumber % 3 > 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END AS b, CAST(l_partkey % 1000 AS VARCHAR) AS c, CAST(100 + l_partkey % 900 AS VARCHAR) || ',' || CAST(10 + l_suppkey % 90 AS VARCHAR) AS d FROM {bare(_LINES)}),
h AS (SELECT o_orderkey AS doc_id, 0 AS n, 0 AS rad, 'Periode' AS a, 'Dager' AS b, 'Sats' AS c, 'Sum' AS d FROM orders),
g AS (SELECT * FROM h UNION ALL SELECT * FROM r)
"""


@query(f"WITH {_CELLS} SELECT doc_id, rad AS linje, CAST(CASE WHEN b = '' THEN 3 ELSE 4 END AS INTEGER) AS celler, concat_ws('|', a, nullif(b, ''), c, d) AS tekst, CAST(CASE WHEN rad > 0 THEN 1 ELSE 0 END AS INTEGER) AS biter FROM g")
def w15_rows_and_cells(spark, d):
    got = layout.word_lines(derived(spark, d, _WORDS, deal=True))
    return got.select("doc_id", "linje", F.size("celler").alias("celler"), F.array_join(F.transform("celler", lambda c: c["tekst"]), "|").alias("tekst"), "biter")


@query(
    f"WITH {_CELLS}, big AS (SELECT l_orderkey AS doc_id FROM {bare(_LINES)} GROUP BY 1 HAVING count(*) >= 2) "
    "SELECT doc_id, rad, kolonne, CASE kolonne WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END AS tekst, rad = 0 AS overskrift FROM g JOIN big USING (doc_id), (VALUES (0), (1), (2), (3)) AS v(kolonne)"
)
def w16_tables(spark, d):
    return layout.tables(layout.word_lines(derived(spark, d, _WORDS, deal=True))).select("doc_id", "rad", "kolonne", "tekst", "overskrift")


@query(
    f"WITH {_CELLS}, big AS (SELECT l_orderkey AS doc_id FROM {bare(_LINES)} GROUP BY 1 HAVING count(*) >= 2), "
    "t AS (SELECT doc_id, rad, CASE WHEN big.doc_id IS NULL THEN concat_ws(' ', a, nullif(b, ''), c, d) WHEN rad = 0 THEN '[TABELL: Periode, Dager, Sats, Sum]' "
    "ELSE 'Periode: ' || a || CASE WHEN b <> '' THEN ' | Dager: ' || b ELSE '' END || ' | Sats: ' || c || ' | Sum: ' || d END AS linje FROM g LEFT JOIN big USING (doc_id)), "
    "n AS (SELECT doc_id, string_agg(linje, chr(10) ORDER BY rad) AS ny, count(*) AS rader FROM t GROUP BY doc_id), "
    "o AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN repeat('x', 5000) ELSE 'Periode Dager Sats Sum' END AS gammel FROM orders) "
    "SELECT doc_id, CASE WHEN rader > 1 AND length(ny) >= 0.8 * length(gammel) THEN ny ELSE gammel END AS tekst, rader > 1 AND length(ny) >= 0.8 * length(gammel) AS byttet FROM o LEFT JOIN n USING (doc_id)"
)
def w17_page_texts(spark, d):
    return layout.page_texts(derived(spark, d, _WORDS, deal=True), derived(spark, d, _PAGES)).drop("side")


# Two regions for each line of an order, a tall one among them, in no order.
_REGIONS = f"""
SELECT l_orderkey AS doc_id, 1 AS side, (8 - l_linenumber) * 2 + k AS nr, CAST(200 - 150 * k AS DOUBLE) AS x0, CAST(20 * l_linenumber + l_partkey % 4 - CASE WHEN l_partkey % 7 = 0 THEN 6 ELSE 0 END AS DOUBLE) AS y0,
  CAST(300 AS DOUBLE) AS x1, CAST(20 * l_linenumber + 12 + l_partkey % 4 AS DOUBLE) AS y1, CASE k WHEN 0 THEN 'h' ELSE ' v' END || CAST(l_linenumber AS STRING) AS tekst
FROM {_LINES}, (SELECT 0 AS k UNION ALL SELECT 1) AS v
"""


@query(f"SELECT l_orderkey AS doc_id, string_agg('v' || CAST(l_linenumber AS VARCHAR) || ' h' || CAST(l_linenumber AS VARCHAR), chr(10) ORDER BY l_linenumber) AS tekst FROM {bare(_LINES)} GROUP BY 1")
def w13_reading_order(spark, d):
    return layout.ordered_text(layout.reading_order(derived(spark, d, _REGIONS))).drop("side")
