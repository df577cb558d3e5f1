"""Queries over answer keys, calibration pairs and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.operators import scoring as G
from sparkdossier.plans.queries import query
from sparkdossier.sources.tables import bare, derived

_WANT = "SELECT o_orderkey AS doc_id, 'f' || CAST(o_custkey % 3 AS STRING) AS felt, CASE o_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' ELSE 'count' END AS art, CASE o_custkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'T' ELSE CAST(o_orderkey % 3 AS STRING) END AS fasit FROM {orders}"
_HAVE = "SELECT o_orderkey AS doc_id, 'f' || CAST(o_custkey % 3 AS STRING) AS felt, CASE WHEN o_orderkey % 9 > 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'O' ELSE o_orderpriority END END AS verdi, CAST(o_orderkey % 2 AS INTEGER) AS antall FROM {orders}"


@query(
    f"WITH w AS ({bare(_WANT)}), h AS ({bare(_HAVE)}) SELECT w.doc_id, w.felt, CASE WHEN verdi IS NULL THEN 'mangler' WHEN CASE art WHEN 'exact' THEN verdi = fasit WHEN 'contains' THEN contains(verdi, fasit) ELSE antall = try_cast(fasit AS INTEGER) END THEN 'riktig' ELSE 'galt' END AS utfall FROM w LEFT JOIN h USING (doc_id, felt)"
)
def a2_outcomes(spark, d):
    return G.outcomes(derived(spark, d, _WANT), derived(spark, d, _HAVE))


_ASKED = "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'kode' ELSE 'modell' END AS svares_av, o_custkey % 5 > 0 AS bestatt FROM {orders}"


@query(f"SELECT svares_av, count(*) AS antall, count(*) FILTER (WHERE bestatt) AS bestatt FROM ({bare(_ASKED)}) GROUP BY svares_av")
def a16_totals(spark, d):
    return G.totals(derived(spark, d, _ASKED))


_TASKS = "SELECT CASE WHEN p_partkey % 10 > 0 THEN CAST(p_partkey % 120 AS DOUBLE) END AS konfidens, p_name AS lest, CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN p_type ELSE p_name END AS rettet FROM {part}"


@query(
    f"WITH t AS (SELECT *, CASE WHEN konfidens IS NULL THEN 'mangler_konfidens' WHEN trim(rettet) = '' THEN 'ingen_retting' WHEN konfidens / 100 > 1 THEN 'utenfor' ELSE 'par' END AS grunn FROM ({bare(_TASKS)})) SELECT grunn, count(*) AS antall, count(*) FILTER (WHERE grunn = 'par' AND lest = rettet) AS riktige FROM t GROUP BY grunn"
)
def a28_calibration_pairs(spark, d):
    return G.calibration_pairs(derived(spark, d, _TASKS))


_IDS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'AF' || CAST(c_custkey AS STRING) WHEN 1 THEN c_name WHEN 2 THEN repeat('a', CAST(c_custkey % 80 AS INTEGER)) END AS sak FROM {customer}"


@query(f"SELECT id, coalesce(regexp_matches(lower(sak), '^[0-9a-f]{{1,64}}$'), false) AS gyldig FROM ({bare(_IDS)})")
def p7_valid_case_ids(spark, d):
    return derived(spark, d, _IDS).select("id", G.valid_case_id(F.col("sak")).alias("gyldig"))


@query("SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS kode, CASE c_nationkey % 3 WHEN 0 THEN 'dagpenger' WHEN 1 THEN 'sykepenger' END AS term FROM customer")
def p9_code_pairs(spark, d):
    terms = spark.sql("SELECT * FROM VALUES (0, 'dagpenger'), (1, 'sykepenger') AS v(kode, term)")
    rows = derived(spark, d, "SELECT c_custkey AS id, CAST(c_nationkey % 3 AS INTEGER) AS k FROM {customer}")
    return G.code_pair(rows, "k", terms).select("id", "par.kode", "par.term")


_BETWEEN = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN '2020-01-01 - 2020-02-01' WHEN 1 THEN '2020-01-01 til 2020-02-01' ELSE '2020-01-01 og 2020-02-01' END AS tekst FROM {orders}"


@query("SELECT o_orderkey AS doc_id, DATE '2020-01-01' AS fra, DATE '2020-02-01' AS til FROM orders WHERE o_orderkey % 3 < 2")
def w2_date_pairs(spark, d):
    t = derived(spark, d, _BETWEEN)
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("slutt")), F.struct((F.length("tekst") - 10).alias("start"), F.length("tekst").alias("slutt")))
    dates = t.select("doc_id", "tekst", F.inline(spans)).withColumn("dato", F.expr("CAST(substring(tekst, start + 1, 10) AS DATE)"))
    return G.date_pairs(dates)


_SAID = "SELECT o_orderkey AS id, 'Summen er  12 ' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ' Kroner' AS svar, '12' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || ' kroner' AS fasit FROM {orders}"


@query("SELECT o_orderkey AS id, o_orderkey % 1000 = o_custkey % 1000 AS riktig FROM orders")
def x17_answers(spark, d):
    return derived(spark, d, _SAID).select("id", G.loosely_equal(F.col("svar"), F.col("fasit")).alias("riktig"))


_REFS = "SELECT o_orderkey AS id, '8-' || CAST(o_orderkey % 9 AS STRING) AS paragraf FROM {orders}"


@query("SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 1 THEN 'a-loven' WHEN 2 THEN 'flertydig' WHEN 3 THEN 'b-loven' ELSE 'ukjent' END AS lov FROM orders")
def j5_resolved(spark, d):
    chapters = spark.sql("SELECT * FROM VALUES ('8-1', 'a-loven'), ('8-2', 'a-loven'), ('8-2', 'b-loven'), ('8-3', 'b-loven') AS v(paragraf, lov)")
    return G.resolve(derived(spark, d, _REFS), chapters)


_ASK = "SELECT text AS innhold, lang AS parametre FROM {documents}"


@query("SELECT sha256(concat_ws('|', text, lang)) AS nokkel, CAST(1 AS BIGINT) AS lest, count(*) - 1 AS fra_lager FROM documents GROUP BY text, lang")
def z8_cache(spark, d):
    return G.cached(derived(spark, d, _ASK))


@query("SELECT l_orderkey AS doc_id, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_partkey END) AS personer, count(*) AS treff FROM lineitem GROUP BY l_orderkey")
def a22_persons(spark, d):
    return G.count_persons(derived(spark, d, "SELECT l_orderkey AS doc_id, CASE WHEN l_linestatus = 'O' THEN 'fnr' ELSE 'konto' END AS type, l_partkey AS tall FROM {lineitem}"))
