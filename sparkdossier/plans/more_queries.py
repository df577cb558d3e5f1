"""Queries over dates, bundles, regions, answers and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.operators import documents as D
from sparkdossier.plans.queries import _TEXTS, query
from sparkdossier.sources import tables as S
from sparkdossier.sources.tables import bare, derived, table

@query("SELECT o_orderkey AS doc_id, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS INTEGER) AS dager, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') / 365.25, 2) + 0.0 AS aar, CAST(o_orderdate AS DATE) > DATE '1998-01-01' AS fremtid FROM orders")
def d8_age(spark, d):
    days, years, future = D.age(F.col("o_orderdate").cast("date"), "1998-01-01")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), days.alias("dager"), years.alias("aar"), future.alias("fremtid"))


_LINES = "SELECT l_orderkey AS doc_id, l_linenumber + l_partkey * 10 AS nr, l_suppkey % 3 + 1 AS side, l_partkey % 6 AS rang, CAST(l_shipdate AS DATE) AS dato, CASE WHEN l_partkey % 2 = 0 THEN 'start' ELSE 'slutt' END AS type FROM {lineitem}"
_L = f"WITH l AS (SELECT DISTINCT doc_id, nr, side, rang, dato, type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, nr ORDER BY side, rang, dato) AS rn FROM ({bare(_LINES)})) WHERE rn = 1) "


def _lines(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "nr").orderBy("side", "rang", "dato")
    # Dealt by document, which all that follows goes by.
    return derived(spark, d, _LINES).repartition("doc_id").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query(_L + ", x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rang, side <> 1, nr) AS p FROM l) SELECT doc_id, max(dato) FILTER (WHERE p = 1) AS dato, count(*) - 1 AS alternativer FROM x WHERE p <= 6 GROUP BY doc_id")
def w1_document_date(spark, d):
    return D.best_date(_lines(spark, d))


@query(
    _L + ", x AS (SELECT *, last_value(CASE WHEN type = 'start' THEN dato END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fra FROM l) "
    "SELECT doc_id, nr, fra, dato AS til FROM x WHERE type = 'slutt' AND fra IS NOT NULL"
)
def w3_periods(spark, d):
    return D.periods(_lines(spark, d))


@query(_L + "SELECT doc_id, min(dato) AS fra, max(dato) AS til, count(DISTINCT dato) AS datoer, count(DISTINCT side) AS sider, count(DISTINCT dato) > 1 AND count(DISTINCT side) > 1 AS flere FROM l GROUP BY doc_id")
def a21_bundle_period(spark, d):
    return D.period_of(_lines(spark, d))


_BUNDLE = "SELECT user_id AS doc_id, event_id AS side, CASE WHEN event_id % 3 = 0 THEN event_type END AS tittel, CASE WHEN event_id % 4 = 0 THEN CAST(ts AS DATE) END AS dato FROM {events}"


@query(
    f"WITH p AS ({bare(_BUNDLE)}), x AS (SELECT *, last_value(tittel IGNORE NULLS) OVER w AS t0, last_value(dato IGNORE NULLS) OVER w AS d0, row_number() OVER (PARTITION BY doc_id ORDER BY side) AS rn FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "n AS (SELECT *, sum(CASE WHEN tittel <> t0 OR dato <> d0 OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY side) AS nr FROM x) "
    "SELECT doc_id, CAST(nr AS BIGINT) AS nr, min(side) AS fra, max(side) AS til, count(*) AS sider FROM n GROUP BY doc_id, nr"
)
def w4_subdocuments(spark, d):
    return D.subdocuments(derived(spark, d, _BUNDLE))


_BOXES = "SELECT l_orderkey AS side, l_linenumber + 10 * l_partkey AS id, CAST(l_partkey % 50 AS DOUBLE) AS x0, CAST(l_suppkey % 50 AS DOUBLE) AS y0, CAST(l_partkey % 50 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 50 + 20 AS DOUBLE) AS y1, l_discount AS konfidens FROM {lineitem}"


@query(
    f"WITH RECURSIVE b AS ({bare(_BOXES)}), k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY konfidens DESC, id, x0, y0, x1, y1) AS n FROM b), "
    "r AS (SELECT side, n, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'id': id}] AS a FROM k WHERE n = 1 UNION ALL SELECT k.side, k.n, CASE WHEN len(list_filter(r.a, lambda y: greatest(0, least(k.x1, y.x1) - greatest(k.x0, y.x0)) * greatest(0, least(k.y1, y.y1) - greatest(k.y0, y.y0)) > 0.5 * least((k.x1 - k.x0) * (k.y1 - k.y0), (y.x1 - y.x0) * (y.y1 - y.y0)))) > 0 THEN r.a ELSE list_append(r.a, {'x0': k.x0, 'y0': k.y0, 'x1': k.x1, 'y1': k.y1, 'id': k.id}) END FROM r JOIN k ON k.side = r.side AND k.n = r.n + 1), "
    "f AS (SELECT side, arg_max(a, n) AS a FROM r GROUP BY side) SELECT side, u.id AS id FROM (SELECT side, unnest(a) AS u FROM f)"
)
def w14_suppressed(spark, d):
    return D.suppress(derived(spark, d, _BOXES))


_FIND = "SELECT o_orderkey AS doc_id, o_orderkey % 150 AS start, o_orderkey % 150 + 30 AS slutt FROM {orders}"
_REG = "SELECT l_orderkey AS doc_id, l_partkey % 200 AS start, l_partkey % 200 + 20 AS slutt FROM {lineitem}"


@query(f"WITH f AS ({bare(_FIND)}), r AS ({bare(_REG)}) SELECT f.doc_id, f.start, f.slutt, count(r.doc_id) AS regioner FROM f LEFT JOIN r ON r.doc_id = f.doc_id AND r.start < f.slutt AND f.start < r.slutt GROUP BY ALL")
def j12_regions(spark, d):
    return D.regions_of(derived(spark, d, _FIND), derived(spark, d, _REG))


_QUESTIONS = "SELECT c_custkey AS sporsmal, c_custkey AS sak, CASE c_custkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS type FROM {customer}"
_CASETYPES = "SELECT o_custkey AS sak, o_orderstatus AS type, o_orderkey AS doc_id FROM {orders}"


@query(f"WITH q AS ({bare(_QUESTIONS)}), t AS (SELECT sak, type, min(doc_id) AS doc_id FROM ({bare(_CASETYPES)}) GROUP BY ALL HAVING count(*) = 1) SELECT sporsmal, doc_id FROM q JOIN t USING (sak, type)")
def j13_routed_questions(spark, d):
    return D.single_type(derived(spark, d, _QUESTIONS), derived(spark, d, _CASETYPES))


@query("WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber % 2 = 0) AS a, list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1) SELECT k, CASE WHEN len(a) > 0 AND len(b) > 0 THEN list_has_any(a, b) END AS samme FROM s")
def j14_same_person(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey"))).alias("b")
    )
    return g.select("k", D.same_person(F.col("a"), F.col("b")).alias("samme"))


@query(
    "WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_linenumber) FILTER (WHERE l_discount > 0.04) AS v, list(DISTINCT l_linenumber) FILTER (WHERE l_tax > 0.03) AS f FROM lineitem GROUP BY 1), "
    "x AS (SELECT len(list_intersect(coalesce(v, []), f)) AS h, len(coalesce(v, [])) AS nv, len(f) AS nf FROM s WHERE len(f) > 0) SELECT round(avg(h / nullif(nv, 0)), 4) AS presisjon, round(avg(h / nf), 4) AS recall, round(avg(CAST(h = nf AS DOUBLE)), 4) AS komplett, count(*) AS antall FROM x"
)
def a15_evidence(spark, d):
    line = F.col("l_linenumber")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_discount") > 0.04, line)).alias("valgt"), F.collect_set(F.when(F.col("l_tax") > 0.03, line)).alias("fasit"))
    return D.evidence(g)


@query("SELECT o_orderkey AS id, abs(o_totalprice - round(o_totalprice, 0)) < 0.005 AS lik FROM orders")
def p2_same_value(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.same_value(F.col("o_totalprice"), F.round("o_totalprice", 0)).alias("lik"))


@query(
    "WITH a AS (SELECT p_partkey AS k, p_brand, CAST(p_size AS STRING) AS p_size FROM part WHERE p_partkey % 7 > 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_brand END AS p_brand, CAST(p_size + CAST(p_partkey % 11 = 0 AS INTEGER) AS STRING) AS p_size FROM part), "
    "la AS (SELECT k, 'p_brand' AS sti, p_brand AS v FROM a UNION ALL SELECT k, 'p_size', p_size FROM a), lb AS (SELECT k, 'p_brand' AS sti, p_brand AS v FROM b UNION ALL SELECT k, 'p_size', p_size FROM b) "
    "SELECT k, sti, la.v AS venstre, lb.v AS hoyre FROM la FULL JOIN lb USING (k, sti) WHERE la.v IS DISTINCT FROM lb.v"
)
def p5_differences(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "k")
    changed = p.select("k", F.when(F.col("k") % 9 == 0, "x").otherwise(F.col("p_brand")).alias("p_brand"), (F.col("p_size") + (F.col("k") % 11 == 0).cast("int")).alias("p_size"))
    return D.differences(p.where("k % 7 > 0"), changed, ["k"], ["p_brand", "p_size"])


_ASKED = "SELECT * FROM VALUES ('q1', 'the'), ('q1', 'with'), ('q2', 'idiot'), ('q2', 'attionable') AS v(sporsmal, ord)"


@query(
    "WITH q(sporsmal, ord) AS (VALUES ('q1', 'the'), ('q1', 'with'), ('q2', 'idiot'), ('q2', 'attionable')), t AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\d]+'))) AS ord FROM documents) "
    "SELECT sporsmal, doc_id, round(sum(1 + least(length(ord), 12) / 12), 3) AS poeng FROM t JOIN q USING (ord) GROUP BY sporsmal, doc_id"
)
def x14_page_scores(spark, d):
    return D.page_scores(table(spark, d, "documents").withColumnRenamed("text", "tekst"), spark.sql(_ASKED))


@query("SELECT p_partkey AS k, CAST(levenshtein(p_name, p_type) AS INTEGER) AS avstand FROM part")
def x10_distance(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.levenshtein("p_name", "p_type").alias("avstand"))


_READ_PAGES = "SELECT l_orderkey AS doc_id, l_linenumber AS side, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE l_comment END AS tekst, CASE WHEN l_orderkey % 3 > 0 THEN CAST(l_orderkey % 6 AS INTEGER) END AS antall FROM (SELECT *, 'x' AS l_comment FROM {lineitem})"


@query(
    f"WITH p AS ({bare(_READ_PAGES)}), g AS (SELECT doc_id, count(DISTINCT side) FILTER (WHERE trim(tekst) <> '') AS lest, max(antall) AS antall FROM p GROUP BY doc_id) SELECT *, CASE WHEN antall IS NULL THEN 'ukjent' WHEN lest >= antall THEN 'full' ELSE 'delvis' END AS dekning FROM g"
)
def x19_coverage(spark, d):
    return D.coverage(derived(spark, d, _READ_PAGES))


_CHECKS = "SELECT o_custkey AS fil, o_orderkey % 3 <> 0 AS ok, o_orderkey % 2 = 0 AS hard FROM {orders}"


@query(f"SELECT fil, CASE WHEN bool_or(NOT ok AND hard) THEN 'avvis' WHEN bool_and(ok) THEN 'god' ELSE 'tvilsom' END AS dom FROM ({bare(_CHECKS)}) GROUP BY fil")
def z4_precheck(spark, d):
    return D.precheck(derived(spark, d, _CHECKS), "fil")


@query("SELECT user_id, min(event_id) AS forste, count(*) - 1 AS gjentatt FROM events GROUP BY user_id")
def z11_idempotency(spark, d):
    return D.first_request(table(spark, d, "events"), "user_id", "event_id")


_READINGS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus = 'O' AS ocr, l_partkey % 13 = 0 AS handskrift, l_partkey % 100 AS tegn, l_discount * 10 AS konfidens, l_suppkey % 3 AS mangler FROM {lineitem}"


@query(f"SELECT *, handskrift OR tegn < 20 OR konfidens < 0.6 OR (konfidens < 0.85 AND mangler > 0) AS sendes FROM ({bare(_READINGS)}) WHERE ocr")
def z7_review(spark, d):
    return D.review(derived(spark, d, _READINGS))


@query("SELECT conv_id AS doc_id, string_agg('[Side ' || CAST(turn AS STRING) || ' av 9]' || chr(10) || text, chr(10) ORDER BY turn, text) AS tekst FROM conversations GROUP BY conv_id")
def m11_selected_text(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("side"), F.col("text").alias("tekst"))
    return D.selected_text(c, 9)


@query(_TEXTS + "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '8-' || CAST(doc_id % 30 + 1 AS STRING) END AS paragraf, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN (doc_id % 30 + 1) % 2 = 0 THEN 'kapittel 8, jevn' END AS kapittel FROM t")
def j7_provisions(spark, d):
    from sparkdossier.functions.text import statutes

    chapters = spark.sql("SELECT concat('8-', id) AS paragraf, 'kapittel 8, jevn' AS kapittel FROM range(2, 32, 2)")
    cited = derived(spark, d, S.CASE_TEXTS).select("doc_id", F.explode_outer(statutes(F.col("tekst"))).alias("paragraf"))
    return cited.join(F.broadcast(chapters), "paragraf", "left").select("doc_id", "paragraf", "kapittel")


@query("SELECT event_id, json_extract_string(props, '$.k') AS verdi, json_exists(props, '$.k') AS finnes FROM events")
def p1_path(spark, d):
    v = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", v.alias("verdi"), F.coalesce(F.array_contains(F.json_object_keys("props"), "k"), F.lit(False)).alias("finnes"))
