"""The engine's queries over the tables of a folder, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdossier.functions import identifiers as I
from sparkdossier.functions import text as T
from sparkdossier.operators import cases, evaluation, extraction, logs, spans
from sparkdossier.sources import tables as S
from sparkdossier.sources.tables import bare, derived, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def cased(spark: SparkSession, d: str) -> DataFrame:
    return cases.group_cases(derived(spark, d, S.CASE_DOCS))


# Case grouping in SQL: the least document reachable over shared keys, by a recursive union.
_CASED = f"""
WITH RECURSIVE docs AS ({bare(S.CASE_DOCS)}),
m AS (SELECT doc_id, 's' || replace(saksnummer, ' ', '') AS v FROM docs WHERE saksnummer IS NOT NULL UNION ALL SELECT doc_id, 'j' || journalnummer FROM docs WHERE journalnummer IS NOT NULL),
h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY v) AS head FROM m),
e AS (SELECT DISTINCT doc_id AS a, head AS b FROM h WHERE doc_id <> head UNION SELECT DISTINCT head, doc_id FROM h WHERE doc_id <> head),
r AS (SELECT doc_id AS node, doc_id AS label FROM docs UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
c AS (SELECT node AS doc_id, min(label) AS sak FROM r GROUP BY node),
cased AS (SELECT docs.*, c.sak, coalesce(dato, behandlingsdato) AS d FROM docs JOIN c USING (doc_id))
"""


@query(_CASED + "SELECT doc_id, sak FROM cased")
def j8_case_groups(spark, d):
    return cased(spark, d).select("doc_id", "sak")


@query(
    _CASED + "SELECT sak, CASE WHEN min(saksnummer) IS NOT NULL THEN 'saksnummer' WHEN min(journalnummer) IS NOT NULL THEN 'journalnummer' END AS felt, "
    "coalesce(min(replace(saksnummer, ' ', '')), min(journalnummer)) AS verdi, count(*) AS dokumenter FROM cased GROUP BY sak"
)
def w9_case_names(spark, d):
    return cases.case_names(cased(spark, d))


@query(_CASED + "SELECT fnr, count(DISTINCT sak) AS antall_saker, min(sak) AS forste, max(sak) AS siste FROM cased WHERE fnr IS NOT NULL GROUP BY fnr HAVING count(DISTINCT sak) >= 2")
def j9_person_relations(spark, d):
    return cases.person_relations(cased(spark, d))


@query(
    _CASED + "SELECT sak, doc_id, d AS hendelsesdato, CASE WHEN dato IS NOT NULL THEN 'dokumentdato' ELSE 'behandlingsdato' END AS dato_kilde, type, "
    "CAST(row_number() OVER (PARTITION BY sak ORDER BY d, filnavn, doc_id) AS INTEGER) AS nr FROM cased WHERE d IS NOT NULL"
)
def w8_timeline(spark, d):
    return cases.timeline(cased(spark, d))


_C1 = "SELECT sak, 'flere_personer' AS sjekk, '' AS felt, CAST(NULL AS DATE) AS dato, count(DISTINCT fnr) AS n FROM cased GROUP BY sak HAVING count(DISTINCT fnr) > 1"
_C2 = " UNION ALL ".join(
    f"SELECT sak, 'umulig_rekkefolge', '{a}<{b}', min(d) FILTER (WHERE type = '{b}'), CAST(1 AS BIGINT) FROM cased GROUP BY sak HAVING min(d) FILTER (WHERE type = '{b}') < min(d) FILTER (WHERE type = '{a}')"
    for a, b in cases.ORDER_RULES
)
_C3 = " UNION ALL ".join(f"SELECT sak, 'ulikt_belop', '{f}', d, count(DISTINCT round({f}, 2)) FROM cased WHERE d IS NOT NULL GROUP BY sak, d HAVING count(DISTINCT round({f}, 2)) > 1" for f in cases.AMOUNTS)
_NAMED = "SELECT * FROM ({}) AS t(sak, sjekk, felt, dato, n)"


@query(_CASED + _C1)
def c1_several_persons(spark, d):
    return cases.several_persons(cased(spark, d))


@query(_CASED + _NAMED.format(_C2))
def c2_impossible_order(spark, d):
    return cases.impossible_order(cased(spark, d))


@query(_CASED + _NAMED.format(_C3))
def c3_unequal_amounts(spark, d):
    return cases.unequal_amounts(cased(spark, d))


@query(_CASED + _NAMED.format(f"{_C1} UNION ALL {_C2} UNION ALL {_C3}"))
def c4_contradictions(spark, d):
    return cases.contradictions(cased(spark, d))


@query(
    _CASED + "SELECT sak, count(*) AS antall_dokumenter, count(DISTINCT fnr) AS antall_personer, CASE WHEN count(DISTINCT fnr) = 1 THEN min(fnr) END AS part, "
    "coalesce(bool_or(type = 'klage' AND d IS NOT NULL), false) AS klaget, "
    "arg_max(type, (d, filnavn)) FILTER (WHERE type IN ('vedtak', 'klagevedtak') AND d IS NOT NULL) AS avgjorelse, "
    "max(d) FILTER (WHERE type IN ('vedtak', 'klagevedtak')) AS avgjort, min(d) AS fra, max(d) AS til FROM cased GROUP BY sak"
)
def a27_case_summaries(spark, d):
    return cases.summaries(cased(spark, d))


@query(
    f"WITH o AS ({bare(S.OUTCOMES)}), c AS (SELECT felt, count(*) FILTER (WHERE utfall = 'riktig') AS riktig, count(*) FILTER (WHERE utfall = 'mangler') AS mangler, count(*) FILTER (WHERE utfall = 'galt') AS galt FROM o GROUP BY felt) "
    "SELECT *, round(riktig / nullif(riktig + galt, 0), 4) AS presisjon, round(riktig / (riktig + galt + mangler), 4) AS recall FROM c"
)
def a1_precision_recall(spark, d):
    return evaluation.precision_recall(derived(spark, d, S.OUTCOMES))


_CAL = (
    f"WITH p AS ({bare(S.CONFIDENCES)}), t AS (SELECT CASE WHEN konfidens >= 0 AND konfidens < 0.5 THEN 0 WHEN konfidens < 0.7 AND konfidens >= 0.5 THEN 1 WHEN konfidens < 0.8 AND konfidens >= 0.7 THEN 2 "
    "WHEN konfidens < 0.9 AND konfidens >= 0.8 THEN 3 ELSE 4 END AS botte, count(*) AS antall, avg(konfidens) AS o, avg(CAST(riktig AS DOUBLE)) AS f FROM p GROUP BY 1), "
    "k AS (SELECT botte, antall, round(o, 4) AS oppgitt, round(f, 4) AS faktisk, round(f - o, 4) AS avvik FROM t) "
)


@query(_CAL + "SELECT * FROM k")
def a3_calibration(spark, d):
    return evaluation.calibration(derived(spark, d, S.CONFIDENCES))


@query(_CAL + "SELECT coalesce(round(sum(antall * abs(avvik)) / sum(antall), 4), 0.0) AS ece FROM k")
def a4_calibration_error(spark, d):
    return evaluation.expected_calibration_error(derived(spark, d, S.CONFIDENCES))


@query(_CAL + "SELECT * FROM k WHERE avvik < -0.05")
def a5_overconfident(spark, d):
    return evaluation.overconfident(derived(spark, d, S.CONFIDENCES))


@query(
    f"WITH l AS (SELECT *, CASE WHEN coalesce(klient_id, '') = '' THEN '-' ELSE klient_id END AS navn FROM ({bare(S.ACCESS)})) "
    "SELECT * FROM (SELECT navn, sti, count(*) AS kall, count(*) FILTER (WHERE kode >= 400) AS feil, CAST(grouping(navn, sti) AS INTEGER) AS nivaa FROM l GROUP BY GROUPING SETS ((navn), (navn, sti), ())) WHERE nivaa <> 0 OR navn <> '-'"
)
def a6_client_usage(spark, d):
    return logs.usage(derived(spark, d, S.ACCESS))


@query(f"SELECT klient_id, count(*) AS kall FROM ({bare(S.ACCESS)}) WHERE sti = '/sak' AND klient_id IS NOT NULL GROUP BY klient_id")
def a7_callers(spark, d):
    return logs.callers(derived(spark, d, S.ACCESS), "/sak")


# Readings are compared line by line, a line being 60 characters: all of every text is compared.
def _read(spark, d):
    # A text is cut in one go: to seek each line from the text's beginning costs the square of its length.
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit("(?s).{1,60}"), 0)).alias("fasit"))
    return lines.withColumn("lest", F.replace("fasit", F.lit("th"), F.lit("t")))


@query(
    "WITH l AS (SELECT doc_id, substr(text, CAST(i AS BIGINT) * 60 + 1, 60) AS fasit FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 60 + 1)) AS i FROM documents WHERE length(text) > 0)), "
    "x AS (SELECT doc_id, sum(levenshtein(fasit, replace(fasit, 'th', 't'))) AS feil, sum(length(fasit)) AS tegn FROM l GROUP BY doc_id) SELECT round(sum(feil) / sum(tegn), 4) AS mikro, round(avg(feil / tegn), 4) AS makro FROM x"
)
def a8_error_rates(spark, d):
    return evaluation.error_rates(_read(spark, d), "id")


@query()
def a9_bootstrap_interval(spark, d):
    rows = _read(spark, d).groupBy("id").agg(F.sum(evaluation.distance(F.col("fasit"), F.col("lest"))).alias("e"), F.sum(F.length("fasit")).alias("c"))
    return evaluation.bootstrap_interval(rows, "e", "c")


_LIVE = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE 1 END AS utfall FROM {lineitem}"
_NEXT = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 5 = 0 AND l_suppkey % 2 = 0 THEN 1 WHEN l_partkey % 5 = 0 OR l_suppkey % 8 = 0 THEN 0 ELSE 1 END AS utfall FROM {lineitem}"
_MCNEMAR = f"""
WITH a AS (SELECT id, min(utfall) AS u FROM ({bare(_LIVE)}) GROUP BY id), b AS (SELECT id, min(utfall) AS u FROM ({bare(_NEXT)}) GROUP BY id),
n AS (SELECT count(*) FILTER (WHERE a.u = 0 AND b.u = 1) AS rettet, count(*) FILTER (WHERE a.u = 1 AND b.u = 0) AS odelagt, count(*) AS alle FROM a JOIN b USING (id)),
q AS (SELECT *, CASE WHEN rettet + odelagt = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(rettet, odelagt) + 1),
  lambda k: exp(lgamma(rettet + odelagt + 1) - lgamma(k + 1) - lgamma(rettet + odelagt - k + 1) + (rettet + odelagt) * ln(0.5))))) END AS p0 FROM n),
p AS (SELECT rettet, odelagt, alle, round(p0, 6) AS p FROM q)
"""


def _outcomes(spark, d, sql):
    return derived(spark, d, sql).groupBy("id").agg(F.min("utfall").alias("utfall"))


@query(_MCNEMAR + "SELECT rettet, odelagt, p FROM p")
def a12_mcnemar(spark, d):
    return evaluation.mcnemar(_outcomes(spark, d, _LIVE), _outcomes(spark, d, _NEXT), "id", "utfall")


# Measured candidates of every kind: not measured, worse at routing, not repeatable, inventing numbers, and by p.
_MEASURED = (
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 90 + 1 END AS n, 9 AS kode_live, CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE 9 END AS kode_kandidat, o_orderkey % 4 <> 0 AS deterministisk, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'hoy' ELSE 'normal' END AS tallvakt, CASE WHEN o_custkey % 11 <> 0 THEN CAST(o_custkey % 10 AS DOUBLE) / 100 END AS p, o_custkey % 8 AS rettet, o_orderkey % 8 AS odelagt FROM {orders}"
)


@query(
    f"SELECT id, grunn, grunn = 'bedre' AS godkjent FROM (SELECT id, CASE WHEN n IS NULL THEN 'ikke_maalt' WHEN kode_kandidat < kode_live THEN 'ruting_brutt' WHEN NOT deterministisk THEN 'ikke_deterministisk' WHEN tallvakt = 'hoy' THEN 'dikter_tall' "
    f"WHEN p IS NULL OR p >= 0.05 THEN 'ikke_skillbar' WHEN rettet > odelagt THEN 'bedre' ELSE 'daarligere' END AS grunn FROM ({bare(_MEASURED)}))"
)
def a13_verdict(spark, d):
    return evaluation.verdict(derived(spark, d, _MEASURED)).select("id", "grunn", "godkjent")


@query(
    f"WITH r AS (SELECT kode, sekunder AS v, row_number() OVER (PARTITION BY kode ORDER BY sekunder) AS i, count(*) OVER (PARTITION BY kode) AS n FROM ({bare(S.ACCESS)})) "
    "SELECT kode, count(*) AS antall, round(min(v), 3) AS min, round(median(v), 3) AS median, "
    "round(max(v) FILTER (WHERE i = least(n, greatest(1, round_even(0.95::DOUBLE * n + 0.5, 0)))), 3) AS p95, round(max(v) FILTER (WHERE i = least(n, greatest(1, round_even(0.99::DOUBLE * n + 0.5, 0)))), 3) AS p99, "
    "round(max(v), 3) AS maks, round(avg(v), 3) AS snitt FROM r GROUP BY kode"
)
def a14_latency(spark, d):
    return evaluation.latency(derived(spark, d, S.ACCESS), "kode", "sekunder")


@query(
    "SELECT event_type, CAST(sum(CASE WHEN event_id % 5 = 0 AND user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stoppet, count(*) AS antall_svar, round(sum(CASE WHEN event_id % 5 = 0 AND user_id % 2 = 0 THEN 1 ELSE 0 END) / count(*), 4) AS rate, "
    "CASE WHEN sum(CASE WHEN event_id % 5 = 0 AND user_id % 2 = 0 THEN 1 ELSE 0 END) / count(*) >= 0.25 THEN 'hoy' WHEN sum(CASE WHEN event_id % 5 = 0 AND user_id % 2 = 0 THEN 1 ELSE 0 END) = 0 THEN 'null' ELSE 'normal' END AS dom FROM events GROUP BY event_type"
)
def a17_guard_verdict(spark, d):
    rows = table(spark, d, "events").select("event_type", F.expr("event_id % 5 = 0 AND user_id % 2 = 0").alias("stoppet"))
    return evaluation.guard_verdict(rows, "event_type")


_VARIANTS = "SELECT p_type AS type, p_size % 3 AS variant, p_brand AS felt, p_partkey % 3 <> 0 AS funnet FROM {part}"


@query(
    f"WITH v AS ({bare(_VARIANTS)}), n AS (SELECT type, count(DISTINCT variant) AS alle FROM v GROUP BY type) "
    "SELECT type, felt, count(DISTINCT variant) FILTER (WHERE funnet) AS antall, count(DISTINCT variant) FILTER (WHERE funnet) = any_value(alle) AS kandidat FROM v JOIN n USING (type) GROUP BY type, felt"
)
def a18_found_in_all(spark, d):
    return evaluation.found_in_all(derived(spark, d, _VARIANTS))


@query("SELECT lang, round(sum((doc_id % 100) / 100 * greatest(length(trim(text)), 1)) / sum(greatest(length(trim(text)), 1)), 6) AS konfidens FROM documents GROUP BY lang")
def a20_weighted_confidence(spark, d):
    r = table(spark, d, "documents").select("lang", F.col("text").alias("tekst"), (F.col("doc_id") % 100 / 100).alias("konfidens"))
    return evaluation.weighted_confidence(r, "lang")


_ROUTE = "CASE " + " ".join(f"WHEN p = '{r}' OR starts_with(p, '{r}/') THEN '{r}'" for r in T.ROUTES) + " ELSE 'annet' END"
_ROUTED = f"WITH l AS (SELECT *, regexp_replace(split_part(sti, '?', 1), '^(/api/v1)+', '') AS p FROM ({bare(S.ACCESS)})), r AS (SELECT *, {_ROUTE} AS rute FROM l) "


@query(_ROUTED + "SELECT rute, kode, count(*) AS kall FROM r GROUP BY rute, kode")
def p6_routes(spark, d):
    return logs.routes(derived(spark, d, S.ACCESS))


@query(_ROUTED + "SELECT rute, " + ", ".join(f"count(*) FILTER (WHERE sekunder <= {b}) AS le_{f'{b:g}'.replace('.', '_')}" for b in logs.LATENCY_BOUNDS) + ", count(*) AS antall, round(sum(sekunder), 3) AS sum FROM r GROUP BY rute")
def a19_histogram(spark, d):
    return logs.histogram(derived(spark, d, S.ACCESS))


@query(_ROUTED + "SELECT printf('forespoersler_total{rute=\"%s\",kode=\"%d\"} %d', rute, kode, count(*)) AS linje FROM r GROUP BY rute, kode")
def s16_exposition(spark, d):
    return logs.exposition(derived(spark, d, S.ACCESS))


@query(
    f"WITH m AS (SELECT date_trunc('minute', t) AS minutt, klient_id, count(*) AS kall FROM ({bare(S.ACCESS)}) WHERE klient_id IS NOT NULL GROUP BY ALL) SELECT *, kall - 1 AS avvist FROM m WHERE kall > 1"
)
def t8_rate_limit(spark, d):
    return logs.over_rate(derived(spark, d, S.ACCESS), 1)


@query(
    f"WITH l AS (SELECT klient_id, t, CASE WHEN t < lag(t) OVER w + INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS ny FROM ({bare(S.ACCESS)}) WHERE klient_id IS NOT NULL WINDOW w AS (PARTITION BY klient_id ORDER BY t)), "
    "s AS (SELECT *, sum(ny) OVER (PARTITION BY klient_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS nr FROM l) "
    "SELECT klient_id, min(t) AS fra, max(t) + INTERVAL 1800 SECOND AS til, count(*) AS kall FROM s GROUP BY klient_id, nr"
)
def t7_sessions(spark, d):
    return logs.sessions(derived(spark, d, S.ACCESS))


_STATES = "SELECT user_id AS jobb, ts, event_id AS id, CASE event_id % 7 WHEN 0 THEN 'kø' WHEN 1 THEN 'Sender ' WHEN 2 THEN 'pågår' WHEN 3 THEN 'sammenstiller' WHEN 4 THEN 'ferdig' WHEN 5 THEN 'avbrytes' ELSE 'ukjent' END AS tilstand FROM {events}"
_PUBLIC = "CASE lower(trim({0})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in logs.STATES.items()) + " ELSE 'feil' END"
_ALLOWED = " OR ".join(f"(fra = '{k}' AND til IN ({', '.join(repr(x) for x in v)}))" for k, v in logs.MOVES.items())


@query(
    f"WITH s AS (SELECT jobb, id, {_PUBLIC.format('lag(tilstand) OVER w')} AS fra, {_PUBLIC.format('tilstand')} AS til, lag(tilstand) OVER w IS NOT NULL AS har FROM ({bare(_STATES)}) WINDOW w AS (PARTITION BY jobb ORDER BY ts, id)) "
    f"SELECT jobb, id, fra, til, fra = til OR {_ALLOWED} AS lovlig FROM s WHERE har"
)
def t4_transitions(spark, d):
    return logs.transitions(derived(spark, d, _STATES))


_FILES = "SELECT o_orderkey AS sti, CAST(o_orderdate AS DATE) AS endret, CAST(o_totalprice AS BIGINT) * 0 + o_orderkey AS bytes FROM {orders}"


@query(f"SELECT CASE WHEN endret < DATE '1998-01-01' - 30 THEN 'slettet' ELSE 'beholdt' END AS utfall, count(*) AS antall, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({bare(_FILES)}) GROUP BY 1")
def t6_retention(spark, d):
    return logs.retention(derived(spark, d, _FILES), "1998-01-01")


_POSTS = "SELECT o_custkey AS kunde, o_orderpriority AS prioritet FROM {orders}"


@query("SELECT DISTINCT o_custkey AS kunde, o_orderpriority AS prioritet FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def t2_new_posts(spark, d):
    stored = derived(spark, d, _POSTS + " WHERE o_orderkey % 2 = 1").distinct()
    return logs.new_posts(stored, derived(spark, d, _POSTS + " WHERE o_orderkey % 2 = 0"), ["kunde", "prioritet"])


@query("SELECT c_custkey AS bilde FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
def j10_waiting_images(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_custkey").alias("bilde"), (F.col("o_orderstatus") == "F").alias("annotert"))
    return logs.waiting_images(table(spark, d, "customer").select(F.col("c_custkey").alias("bilde")), tasks)


@query(
    "WITH a AS (SELECT p_partkey AS sti, sha256(p_name) AS s FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT p_partkey AS sti, sha256(CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_name END) AS s FROM part WHERE p_partkey % 13 <> 0) "
    "SELECT * FROM (SELECT sti, CASE WHEN b.s IS NULL THEN 'mangler' WHEN a.s IS NULL THEN 'ekstra' WHEN a.s <> b.s THEN 'endret' END AS utfall FROM a FULL JOIN b USING (sti)) WHERE utfall IS NOT NULL"
)
def s15_manifest(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("sti"), F.sha2("p_name", 256).alias("sum"))
    b = p.where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("sti"), F.sha2(F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name")), 256).alias("sum"))
    return logs.manifest_diff(a, b)


@query("WITH k AS (SELECT c_name AS navn, substr(sha256(CAST(c_nationkey AS STRING)), 1, 20 + c_nationkey % 10) AS nokkel FROM customer) SELECT nokkel, count(DISTINCT navn) AS antall, min(navn) AS forste, length(nokkel) < 24 AS kort FROM k GROUP BY nokkel HAVING length(nokkel) < 24 OR count(DISTINCT navn) > 1")
def p10_duplicate_keys(spark, d):
    c = table(spark, d, "customer")
    key = F.expr("substr(sha2(CAST(c_nationkey AS STRING), 256), 1, 20 + c_nationkey % 10)")
    return logs.duplicate_keys(c.select(F.col("c_name").alias("navn"), key.alias("nokkel")))


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256('kalibrering:' || CAST(doc_id AS STRING)), 1, 8) AS BIGINT) % 10000 < 1000")
def p12_sampled(spark, d):
    return table(spark, d, "documents").where(T.sampled(F.col("doc_id").cast("string"), 0.1)).select("doc_id")


def _digits(c: str, weights, first: int = 1) -> str:
    return " + ".join(f"CAST(substr({c}, {i + first}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights))


def _check(c: str, weights) -> str:
    return f"(11 - ({_digits(c, weights)}) % 11) % 11 = CAST(substr({c}, {len(weights) + 1}, 1) AS INTEGER)"


_NUM = f"WITH n AS ({bare(S.NUMBERS)}) "


@query(_NUM + f"SELECT doc_id, orgnr FROM n WHERE {_check('orgnr', I.COMPANY)}")
def i5_company_ids(spark, d):
    return derived(spark, d, S.NUMBERS).where(I.valid_company(F.col("orgnr"))).select("doc_id", "orgnr")


@query(_NUM + f"SELECT doc_id, konto FROM n WHERE {_check('konto', I.ACCOUNT)}")
def i4_accounts(spark, d):
    return derived(spark, d, S.NUMBERS).where(I.valid_account(F.col("konto"))).select("doc_id", "konto")


@query(
    _NUM + ", r AS (SELECT doc_id, kid, list_transform(range(0, length(kid)), lambda i: CAST(substr(kid, length(kid) - i, 1) AS INTEGER)) AS x FROM n), "
    "v AS (SELECT doc_id, kid, list_sum(list_transform(range(0, len(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[i + 1] WHEN x[i + 1] > 4 THEN x[i + 1] * 2 - 9 ELSE x[i + 1] * 2 END)) % 10 = 0 AS luhn, "
    "(11 - coalesce(list_sum(list_transform(range(1, len(x)), lambda i: x[i + 1] * ((i - 1) % 6 + 2))), 0) % 11) % 11 = x[1] AS m11 FROM r WHERE length(kid) BETWEEN 3 AND 25) SELECT doc_id, kid FROM v WHERE luhn OR m11"
)
def i6_payment_references(spark, d):
    return derived(spark, d, S.NUMBERS).where(I.valid_payment_reference(F.col("kid"))).select("doc_id", "kid")


_BIRTH = _NUM + (
    ", a AS (SELECT doc_id, fnr, CAST(substr(fnr, 1, 2) AS INTEGER) AS dd, CAST(substr(fnr, 3, 2) AS INTEGER) AS mm, CAST(substr(fnr, 5, 2) AS INTEGER) AS yy, CAST(substr(fnr, 7, 3) AS INTEGER) AS s FROM n), "
    "b AS (SELECT *, CASE WHEN dd > 40 THEN dd - 40 ELSE dd END AS d2, CASE WHEN mm > 80 THEN mm - 80 WHEN mm > 40 THEN mm - 40 ELSE mm END AS m2, "
    "CASE WHEN s >= 500 AND yy <= 39 THEN 2000 WHEN s >= 900 THEN 1900 WHEN s >= 500 AND yy >= 54 THEN 1800 ELSE 1900 END + yy AS y2 FROM a), "
    "f AS (SELECT doc_id, fnr, try_cast(printf('%04d-%02d-%02d', y2, m2, d2) AS DATE) AS fodt FROM b) "
)


@query(_BIRTH + "SELECT doc_id, fodt FROM f")
def i3_birth_dates(spark, d):
    return derived(spark, d, S.NUMBERS).select("doc_id", I.birth_date(F.col("fnr")).alias("fodt"))


@query(_BIRTH + f"SELECT doc_id, fnr FROM f WHERE fodt IS NOT NULL AND {_check('fnr', I.PERSON_FIRST)} AND {_check('fnr', I.PERSON_SECOND)}")
def i2_person_ids(spark, d):
    return derived(spark, d, S.NUMBERS).where(I.valid_person(F.col("fnr"))).select("doc_id", "fnr")


def _words(ws) -> str:
    return " + ".join(f"(length(t) - length(replace(t, ' {w} ', ''))) // {len(w) + 2}" for w in ws)


@query(f"WITH x AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents), y AS (SELECT doc_id, {_words(T.NORWEGIAN)} AS n, {_words(T.ENGLISH)} AS e FROM x) SELECT doc_id, CASE WHEN n >= 2 AND n > e THEN 'norsk' WHEN e >= 2 AND e > n THEN 'engelsk' ELSE '' END AS sprak FROM y")
def x7_language(spark, d):
    return table(spark, d, "documents").select("doc_id", T.guess_language(F.col("text")).alias("sprak"))


@query("SELECT doc_id, " + "replace(" * 6 + "lower(text), 'æ', 'a'), 'ae', 'a'), 'å', 'a'), 'aa', 'a'), 'ø', 'o'), 'oe', 'o') AS tekst FROM documents")
def x3_folded(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("tekst"))


@query("SELECT doc_id, round(greatest(0.0, 1 - 3.0 * len(regexp_extract_all(lower(text), '[^\\x00-\\x7Fæøåéèêóòôäöü]')) / length(regexp_replace(lower(text), '\\s', '', 'g')))::DOUBLE, 6) AS norsk FROM documents")
def x11_plausibility(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.plausibility(F.col("text")), 6).alias("norsk"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'easyocr' WHEN len(regexp_extract_all(CAST(l_partkey AS STRING), '\\d')) >= 2 AND l_discount * 10 >= 0.35 THEN 'easyocr' WHEN l_discount * 10 < 0.45 AND l_tax * 12 >= 0.5 THEN 'norhand' WHEN l_tax * 12 - l_discount * 10 > 0.3 THEN 'norhand' ELSE 'easyocr' END AS motor FROM lineitem"
)
def x12_engine(spark, d):
    other = F.when(F.col("l_returnflag") != "N", "x")
    motor = T.pick_engine(F.col("l_partkey").cast("string"), F.col("l_discount") * 10, other, F.col("l_tax") * 12)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", motor.alias("motor"))


_TEXTS = f"WITH t AS ({bare(S.CASE_TEXTS)}) "


@query(
    _TEXTS + "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'vedtak' WHEN 1 THEN 'klage' ELSE 'soknad' END AS type, CASE doc_id % 3 WHEN 0 THEN 'dagpenger' WHEN 2 THEN 'sykepenger' END AS ytelse, "
    "lpad(CAST(doc_id AS STRING), 7, '0') AS saksnummer, vedtaksdato AS dato, sats + 0.5::DOUBLE AS dagsats, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '8-' || CAST(doc_id % 30 + 1 AS STRING) END AS hjemler FROM t"
)
def m3_fields(spark, d):
    return extraction.fields(derived(spark, d, S.CASE_TEXTS))


@query(
    _TEXTS + "SELECT doc_id, 1 AS side, CAST(0 AS BIGINT) AS start, length(tekst) AS lengde, false AS blank FROM t UNION ALL SELECT doc_id, 2, strpos(tekst, '[Side 2') - 1, length(tekst), doc_id % 4 = 0 FROM t"
)
def s3_pages(spark, d):
    t = derived(spark, d, S.CASE_TEXTS)
    return spans.pages(t).join(t.select("doc_id", F.length("tekst").cast("long").alias("lengde")), "doc_id").select("doc_id", "side", "start", "lengde", (F.col("tekst") == "").alias("blank"))


@query(_TEXTS + "SELECT doc_id, k AS id, length(tekst) * k // 3 AS pos, CASE WHEN length(tekst) * k // 3 >= strpos(tekst, '[Side 2') - 1 THEN 2 ELSE 1 END AS side FROM t, (VALUES (1), (2)) AS v(k)")
def j1_page_of(spark, d):
    t = derived(spark, d, S.CASE_TEXTS)
    points = t.select("doc_id", F.length("tekst").alias("n"), F.explode(F.array(F.lit(1), F.lit(2))).alias("id")).select("doc_id", "id", F.expr("n * id div 3").alias("pos"))
    return spans.page_of(points, spans.pages(t)).select("doc_id", F.col("id").cast("int").alias("id"), "pos", "side")


_SPANS = "SELECT l_orderkey AS doc_id, l_partkey % 200 AS start, l_partkey % 200 + CAST(l_quantity AS BIGINT) AS slutt FROM {lineitem}"


@query(
    f"WITH c AS (SELECT DISTINCT * FROM ({bare(_SPANS)} WHERE l_linenumber % 2 = 0)), o AS (SELECT * FROM ({bare(_SPANS)} WHERE l_linenumber % 2 = 1)) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = c.doc_id AND o.start < c.slutt AND o.slutt > c.start)"
)
def j2_free_spans(spark, d):
    return spans.free_spans(derived(spark, d, _SPANS + " WHERE l_linenumber % 2 = 0").distinct(), derived(spark, d, _SPANS + " WHERE l_linenumber % 2 = 1"))


@query(f"WITH c AS (SELECT DISTINCT * FROM ({bare(_SPANS)})) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.start <= c.start AND o.slutt >= c.slutt AND o.slutt - o.start > c.slutt - c.start)")
def j3_outermost(spark, d):
    return spans.outermost(derived(spark, d, _SPANS).distinct())


@query(
    f"WITH RECURSIVE c AS (SELECT DISTINCT * FROM ({bare(_SPANS)})), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, slutt DESC) AS n FROM c), "
    "r AS (SELECT doc_id, start, slutt, n, slutt AS e, true AS tatt FROM k WHERE n = 1 UNION ALL SELECT k.doc_id, k.start, k.slutt, k.n, CASE WHEN k.start >= r.e THEN k.slutt ELSE r.e END, k.start >= r.e FROM r JOIN k ON k.doc_id = r.doc_id AND k.n = r.n + 1) "
    "SELECT doc_id, start, slutt FROM r WHERE tatt"
)
def w6_greedy(spark, d):
    return spans.greedy(derived(spark, d, _SPANS).distinct())


_SCORED = "SELECT l_orderkey AS sporsmal, l_linenumber AS side, max(round(l_discount * 30, 3)) AS poeng FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@query(
    f"WITH s AS ({bare(_SCORED)}), x AS (SELECT *, count(*) OVER (PARTITION BY sporsmal) AS n, count(*) FILTER (WHERE poeng >= 1.5) OVER (PARTITION BY sporsmal) AS k, row_number() OVER (PARTITION BY sporsmal ORDER BY poeng DESC, side) AS r FROM s) "
    "SELECT sporsmal, side, poeng FROM x WHERE k = 0 OR k = n OR (poeng >= 1.5 AND r <= 3)"
)
def w10_best_pages(spark, d):
    return spans.best_pages(derived(spark, d, _SCORED))


_LAWS = "SELECT * FROM VALUES ('a-loven', DATE '1990-01-01', DATE '1995-05-01'), ('b-loven', DATE '1995-05-01', CAST(NULL AS DATE)) AS v(lov, fra, til)"


@query("SELECT o_orderkey AS doc_id, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1995-05-01' THEN 'b-loven' WHEN CAST(o_orderdate AS DATE) >= DATE '1990-01-01' THEN 'a-loven' END AS lov FROM orders")
def j4_valid_law(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("dato"))
    return spans.valid_at(rows, "dato", spark.sql(_LAWS))


_FOUND = "SELECT l_orderkey AS doc_id, CASE l_orderkey % 2 WHEN 0 THEN 'vedtak' ELSE 'klage' END AS type, 'felt' || CAST(l_linenumber AS STRING) AS felt, CASE WHEN l_partkey % 4 > 0 THEN l_partkey END AS verdi FROM {lineitem}"
_EXPECTED = "SELECT * FROM VALUES ('vedtak', 'felt1'), ('vedtak', 'felt3'), ('klage', 'felt2') AS v(type, felt)"


@query(
    f"WITH f AS ({bare(_FOUND)}), e(type, felt) AS (VALUES ('vedtak', 'felt1'), ('vedtak', 'felt3'), ('klage', 'felt2')) SELECT d.doc_id, e.felt FROM (SELECT DISTINCT doc_id, type FROM f) d JOIN e USING (type) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND f.felt = e.felt AND f.verdi IS NOT NULL)"
)
def j15_missing_fields(spark, d):
    return spans.missing_fields(spark.sql(_EXPECTED), derived(spark, d, _FOUND))


# An amount, a date and a customer's number in each answer; its source has them grouped, with a dot, as another date, off by a factor or not.
_ANSWERS = """
SELECT id, 'Svar: kr ' || CAST(n AS STRING) || ',50 den ' || lpad(CAST(day(dato) AS STRING), 2, '0') || '.' || lpad(CAST(month(dato) AS STRING), 2, '0') || '.' || CAST(year(dato) AS STRING) || ', kunde ' || CAST(kunde AS STRING) || ',00' AS svar,
  'Kilde: ' || CASE id % 4 WHEN 0 THEN CAST(CAST(floor(n / 1000) AS BIGINT) AS STRING) || ' ' || lpad(CAST(n % 1000 AS STRING), 3, '0') || ',50' WHEN 1 THEN CAST(n AS STRING) || '50' WHEN 2 THEN CAST(n AS STRING) || '.5' ELSE CAST(n AS STRING) END
  || ' kroner, dato ' || CASE id % 3 WHEN 0 THEN CAST(dato AS STRING) WHEN 1 THEN CAST(day(dato) AS STRING) || '/' || CAST(month(dato) AS STRING) || '/' || CAST(year(dato) AS STRING) ELSE 'ukjent' END
  || ' for ' || CASE WHEN id % 5 = 0 THEN CAST(kunde + 1 AS STRING) ELSE CAST(kunde AS STRING) END AS kilde
FROM (SELECT o_orderkey AS id, o_orderkey + 1000 AS n, CAST(o_orderdate AS DATE) AS dato, 900000000000 + o_custkey AS kunde FROM {orders})
"""


@query(
    "WITH o AS (SELECT o_orderkey AS id, o_orderkey + 1000 AS n, CAST(o_orderdate AS DATE) AS dato, 900000000000 + o_custkey AS kunde FROM orders) SELECT id, CAST(n AS STRING) || ',50' AS tall FROM o WHERE id % 4 IN (1, 3) "
    "UNION ALL SELECT id, strftime(dato, '%d.%m.%Y') FROM o WHERE id % 3 = 2 UNION ALL SELECT id, CAST(kunde AS STRING) || ',00' FROM o WHERE id % 5 = 0"
)
def z1_unsupported_numbers(spark, d):
    a = derived(spark, d, _ANSWERS, deal=True)
    return spans.unsupported_numbers(a.select("id", "svar"), a.select("id", "kilde"))
