"""Queries over runs held against each other, folders that grow by calls, and answers about cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.operators import case_answers, cases, folders, runs
from sparkdossier.plans.queries import _C1, _C2, _C3, _CASED, cased, query
from sparkdossier.sources import tables as S
from sparkdossier.session import cut
from sparkdossier.sources.tables import bare, derived, table


def _answers(spark, d, changed: bool):
    """A JSON answer for each order; changed, with its names in another order, and one of four changes in four of five."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    kind = key % 5 if changed else F.lit(0)
    amount = (customer + (kind == 1).cast("long")).alias("belop")
    status = F.when(kind != 2, F.col("o_orderstatus")).alias("status")
    fields = F.to_json(F.struct(status, amount) if changed else F.struct(amount, status))
    fields = F.when(kind == 4, F.to_json(F.array(customer))).otherwise(fields)
    pages = F.when(kind == 3, "[1,2,3]").otherwise("[1,2]")
    parts = [F.concat(F.lit('"felter":'), fields), F.concat(F.lit('"sider":'), pages), F.concat(F.lit('"tid_sekunder":'), (key % 7 + int(changed)).cast("string"))]
    text = F.concat(F.lit("{"), F.concat_ws(",", *(parts[::-1] if changed else parts)), F.lit("}"))
    orders = table(spark, d, "orders")
    return (orders.where("o_orderkey % 7 > 0") if changed else orders).select(key.alias("doc_id"), text.alias("json"))


@query(
    "SELECT o_orderkey AS doc_id, '(rot)' AS sti, 'finnes' AS venstre, 'MANGLER' AS hoyre FROM orders WHERE o_orderkey % 7 = 0 UNION ALL "
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN '.felter.belop' WHEN 2 THEN '.felter.status' WHEN 3 THEN '.sider[]' ELSE '.felter' END, "
    "CASE o_orderkey % 5 WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'finnes' WHEN 3 THEN '2 elementer' ELSE 'objekt' END, "
    "CASE o_orderkey % 5 WHEN 1 THEN CAST(o_custkey + 1 AS VARCHAR) WHEN 2 THEN 'MANGLER' WHEN 3 THEN '3 elementer' ELSE 'liste' END "
    "FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0"
)
def p5_tree_differences(spark, d):
    return runs.tree_differences(_answers(spark, d, False), _answers(spark, d, True), ["doc_id"])


@query(
    "SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS BIGINT) AS antall, "
    "CAST(o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 AS BIGINT) AS avvikende, CAST(o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 AS BIGINT) + 1 AS ulike FROM orders"
)
def p4_determinism(spark, d):
    both = [_answers(spark, d, changed).withColumn("kjoring", F.lit(int(changed))) for changed in (False, True)]
    return runs.determinism(both[0].unionByName(both[1]), ["doc_id"], "kjoring")


_SENT = (
    "SELECT l_suppkey AS mappe, l_orderkey AS kall, l_linenumber AS plass, l_linestatus AS filnavn, l_returnflag AS tittel, CAST(NULL AS DATE) AS dato, CAST(NULL AS DATE) AS behandlingsdato, "
    "CAST(l_partkey % 20 AS STRING) AS saksnummer, CASE WHEN l_returnflag = 'A' THEN '' END AS journalnummer, CAST(NULL AS STRING) AS fnr FROM {lineitem}"
)
_STORED, _COMING = _SENT + " WHERE l_orderkey % 10 = 0", _SENT + " WHERE l_orderkey % 10 > 0"
_CALLS = (
    f"WITH s AS (SELECT DISTINCT mappe, filnavn, tittel, saksnummer FROM ({bare(_STORED)})), i AS (SELECT *, row_number() OVER (PARTITION BY mappe, filnavn, tittel, saksnummer ORDER BY kall, plass) AS n FROM ({bare(_COMING)})), "
    "c AS (SELECT mappe, kall, count(*) AS sendt, count(*) FILTER (WHERE n = 1 AND s.tittel IS NULL) AS lagt_til FROM i LEFT JOIN s USING (mappe, filnavn, tittel, saksnummer) GROUP BY mappe, kall) "
)


def _appended(spark, d):
    coming = derived(spark, d, _COMING)
    return folders.calls(coming, folders.new_posts(derived(spark, d, _STORED), coming))


@query(_CALLS + "SELECT mappe, kall, lagt_til, sendt - lagt_til AS duplikater FROM c")
def t2_appended_calls(spark, d):
    return _appended(spark, d)


@query(_CALLS + "SELECT mappe, count(*) FILTER (WHERE lagt_til > 0) AS versjon, CAST(sum(lagt_til) AS BIGINT) AS dokumenter, CAST(sum(sendt - lagt_til) AS BIGINT) AS duplikater FROM c GROUP BY mappe")
def t2_folder_versions(spark, d):
    return folders.versions(_appended(spark, d))


_FOLDERS = f"SELECT CAST(doc_id % 3 AS STRING) AS mappe, doc_id, saksnummer, journalnummer FROM ({S.CASE_DOCS})"
_REGROUPED = f"""
WITH RECURSIVE docs AS ({bare(_FOLDERS)}),
m AS (SELECT doc_id, mappe || 's' || replace(saksnummer, ' ', '') AS v FROM docs WHERE saksnummer IS NOT NULL UNION ALL SELECT doc_id, mappe || 'j' || journalnummer FROM docs WHERE journalnummer IS NOT NULL),
h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY v) AS head FROM m),
e AS (SELECT DISTINCT doc_id AS a, head AS b FROM h WHERE doc_id <> head UNION SELECT DISTINCT head, doc_id FROM h WHERE doc_id <> head),
r AS (SELECT doc_id AS node, doc_id AS label FROM docs UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
c AS (SELECT docs.*, x.sak FROM docs JOIN (SELECT node AS doc_id, min(label) AS sak FROM r GROUP BY node) AS x USING (doc_id)),
n AS (SELECT sak, min(replace(saksnummer, ' ', '')) AS s, min(journalnummer) AS j FROM c GROUP BY sak)
SELECT mappe, sak, CASE WHEN s IS NOT NULL THEN 'saksnummer' WHEN j IS NOT NULL THEN 'journalnummer' END AS felt, coalesce(s, j) AS verdi,
  count(*) FILTER (WHERE CASE WHEN s IS NOT NULL THEN replace(saksnummer, ' ', '') = s ELSE journalnummer = j END) AS baerer, count(*) AS dokumenter,
  CASE WHEN s IS NULL AND j IS NULL THEN 'ingen_bevist_saksnokkel' END AS grunn
FROM c JOIN n USING (sak) GROUP BY mappe, sak, s, j
"""


@query(_REGROUPED)
def t3_folder_cases(spark, d):
    return folders.case_grounds(folders.folder_cases(derived(spark, d, _FOLDERS)))


# Benefits and lacking fields by document, questions by case; the state of each case in SQL.
_BENEFIT = "CASE WHEN doc_id % 3 = 0 THEN 'sykepenger' WHEN doc_id % 50 = 1 THEN 'dagpenger' END"
_ASKED = (
    "Hva ble det til slutt?", "Hvem gjelder saken?", "Ble det klaget?", "Hva mangler i saken?", "Er det noe feil her?", "Hvor står saken?", "Hva er dagsatsen?",
)
_STATE = f"""{_CASED},
found AS (SELECT sak, count(*) AS n FROM ({_C1} UNION ALL {_C2} UNION ALL {_C3}) AS f GROUP BY sak),
g AS (SELECT sak, count(*) AS docs, count(DISTINCT fnr) AS persons, count(fnr) AS carrying, min(fnr) AS p, min({_BENEFIT}) AS y0, max({_BENEFIT}) AS y1,
  max(d) FILTER (WHERE type = 'klagevedtak') AS k, max(d) FILTER (WHERE type = 'vedtak') AS v, max(d) FILTER (WHERE type IN ('dokumentasjonskrav', 'purring')) AS asked,
  count(d) FILTER (WHERE type = 'soknad') > 0 AS applied, count(d) FILTER (WHERE type = 'klage') > 0 AS appealed,
  string_agg(DISTINCT CAST(d AS VARCHAR), ', ' ORDER BY CAST(d AS VARCHAR)) FILTER (WHERE type = 'klage') AS days, count(*) FILTER (WHERE doc_id % 11 = 0) AS lacking FROM cased GROUP BY sak),
s AS (SELECT g.*, coalesce(n, 0) AS findings, coalesce(k, v) AS decided,
  CASE WHEN k IS NOT NULL THEN 'avgjort_etter_klage' WHEN asked IS NOT NULL AND (v IS NULL OR v < asked) THEN 'venter_paa_dokumentasjon' WHEN v IS NOT NULL THEN 'avgjort' WHEN applied THEN 'under_behandling' ELSE 'ukjent' END AS status FROM g LEFT JOIN found USING (sak)),
t AS (SELECT *, CASE status WHEN 'avgjort_etter_klage' THEN 'Klageinstansen har avgjort saken (' || k || ').' WHEN 'venter_paa_dokumentasjon' THEN 'Dokumentasjon ble etterspurt ' || asked || ', og ingen avgjørelse er datert etter det.'
  WHEN 'avgjort' THEN 'Vedtak datert ' || v || ', og ingen klage er avgjort etter det.' WHEN 'under_behandling' THEN 'Søknad finnes, men ingen avgjørelse.'
  ELSE 'Ingen av dokumentene avgjør noe, og ingen søknad er datert. Saken kan ikke plasseres.' END AS why,
  CASE status WHEN 'avgjort_etter_klage' THEN 'Avgjort etter klage' WHEN 'venter_paa_dokumentasjon' THEN 'Venter på dokumentasjon' WHEN 'avgjort' THEN 'Avgjort' WHEN 'under_behandling' THEN 'Under behandling' ELSE 'Ukjent' END AS name,
  CASE persons WHEN 0 THEN 'Ingen av dokumentene bærer et fødselsnummer under en etikett som viser hvem saken gjelder.' WHEN 1 THEN 'Fastslått av ' || carrying || ' dokument(er) med samme fødselsnummer.'
  ELSE 'Saken bærer ' || persons || ' ulike fødselsnummer — hvem den gjelder kan ikke avgjøres. Se «motsigelser».' END AS ground FROM s)
"""


def _documents(spark, d):
    docs = cased(spark, d).withColumn("ytelse", F.expr(_BENEFIT)).withColumn("tittel", F.lit(None).cast("string"))
    return cut(docs.withColumn("mangler", F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("dato")))))


def _states(documents):
    return case_answers.case_states(documents, cases.findings(documents))


@query(
    _STATE + "SELECT t.sak, docs AS antall_dokumenter, persons AS antall_personer, CASE WHEN persons = 1 THEN p END AS part, ground AS grunnlag, CASE WHEN y0 = y1 THEN y0 END AS ytelse, "
    "appealed AS klaget, CASE WHEN k IS NOT NULL THEN 'klagevedtak' WHEN v IS NOT NULL THEN 'vedtak' END AS avgjorelse, decided AS avgjort, x.navn AS avgjort_i, status, why AS begrunnelse, lacking AS ufullstendige, findings AS motsigelser "
    "FROM t LEFT JOIN (SELECT sak, type, d, max(filnavn) AS navn FROM cased GROUP BY sak, type, d) AS x ON x.sak = t.sak AND x.d = decided AND x.type = CASE WHEN k IS NOT NULL THEN 'klagevedtak' ELSE 'vedtak' END"
)
def a27_case_states(spark, d):
    return _states(_documents(spark, d)).drop("klagedatoer")


@query(
    _STATE + "SELECT sak AS sporsmal_id, sak, CASE sak % 7 WHEN 0 THEN 'utfall' WHEN 1 THEN 'part' WHEN 2 THEN 'klage' WHEN 3 THEN 'mangler' WHEN 4 THEN 'motsigelse' WHEN 5 THEN 'status' END AS svartype, CASE sak % 7 "
    "WHEN 0 THEN CASE WHEN decided IS NULL THEN 'Ingen av dokumentene i saken avgjør noe. ' || why ELSE CASE WHEN k IS NOT NULL THEN 'Klagevedtak' ELSE 'Vedtak' END || ' datert ' || decided || ' er den som gjelder. Status: ' || name || ' — ' || why END "
    "WHEN 1 THEN CASE WHEN persons = 1 THEN 'Saken gjelder personen med fødselsnummer ' || p || '. ' || ground ELSE 'Hvem saken gjelder kan ikke fastslås. ' || ground END "
    "WHEN 2 THEN CASE WHEN appealed THEN 'Ja, det er klaget i saken (' || days || ').' ELSE 'Nei, ingen klage finnes blant dokumentene i saken.' END "
    "WHEN 3 THEN CASE WHEN lacking > 0 THEN lacking || ' dokument(er) mangler felter som er målt for typen sin.' ELSE 'Ingen av dokumentene mangler noen av de feltene som er MÅLT for typen sin. Det er ikke det samme som at saken er komplett — bare målte felter kan mangle.' END "
    "WHEN 4 THEN CASE WHEN findings > 0 THEN 'Ja — ' || findings || ' motsigelse(r) ble funnet. Se «motsigelser» for hver enkelt med begrunnelse.' ELSE 'Ingen av de motsigelsene systemet kan bevise ble funnet. Se «motsigelser.sjekket» for hva som faktisk ble undersøkt.' END "
    "WHEN 5 THEN name || ' — ' || why END AS svar FROM t"
)
def m9_case_answers(spark, d):
    states = cut(_states(_documents(spark, d)))
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("sak") % len(_ASKED)).cast("int") + 1)
    return case_answers.answers(states.select(F.col("sak").alias("sporsmal_id"), "sak", asked.alias("sporsmal")), states)


@query(
    _CASED + ", last AS (SELECT sak, coalesce(max(struct_pack(d := d, n := filnavn)) FILTER (WHERE type = 'klagevedtak' AND d IS NOT NULL), max(struct_pack(d := d, n := filnavn)) FILTER (WHERE type = 'vedtak' AND d IS NOT NULL)) AS x FROM cased GROUP BY sak) "
    "SELECT sak AS sporsmal_id, x.n AS dokument, CAST(NULL AS VARCHAR) AS tekst FROM last WHERE sak % 7 = 0 AND x IS NOT NULL UNION ALL SELECT sak, filnavn, NULL FROM cased WHERE sak % 7 = 2 AND type = 'klage' AND d IS NOT NULL "
    "UNION ALL SELECT sak, filnavn, 'dato' FROM cased WHERE sak % 7 = 3 AND doc_id % 11 = 0"
)
def m9_answer_sources(spark, d):
    documents = _documents(spark, d)
    states = cut(case_answers.case_states(documents))
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("sak") % len(_ASKED)).cast("int") + 1)
    answered = case_answers.answers(states.select(F.col("sak").alias("sporsmal_id"), "sak", asked.alias("sporsmal")), states)
    return case_answers.sources(answered, states, documents)
