"""Queries of the guards on answers and of whom a document is about."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.functions import identifiers as I
from sparkdossier.operators import guards, owners
from sparkdossier.plans.queries import query
from sparkdossier.sources import tables as S
from sparkdossier.sources.tables import bare, derived

# A question and answer for each case text: a fee that no text names, the day rate that one does, a date for another, a number
# that no text has, a refusal, and words.
_QUESTIONS = """
SELECT o_orderkey AS id, o_orderkey AS doc_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'Hvor stort gebyr skal betales?' WHEN 1 THEN 'Hva er dagsatsen?' WHEN 2 THEN 'Hvilken frist gjelder for klagen?' WHEN 3 THEN 'Hvor stort gebyr skal betales?'
    WHEN 4 THEN 'Hvor stort gebyr skal betales?' WHEN 5 THEN 'Hva gjelder saken?' ELSE 'Hva er saksnummeret i vedtaket?' END AS sporsmal,
  CASE o_orderkey % 7 WHEN 0 THEN 'kr ' || CAST(o_orderkey % 90000 AS STRING) || ',50' WHEN 1 THEN CAST(o_orderkey % 90000 AS STRING) || ',50'
    WHEN 2 THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' || CAST(year(o_orderdate) AS STRING)
    WHEN 3 THEN 'kr 99 999 999,00' WHEN 4 THEN 'Gebyr på 12,50 finnes ikke' WHEN 5 THEN 'Dagpenger' ELSE '12,50 og ' || CAST(o_orderkey % 90000 AS STRING) || ',50' END AS svar
FROM {orders}
"""
_STOP = ", ".join(f"'{w}'" for w in guards.STOP_WORDS)
_KIN = "(starts_with(a, b) OR starts_with(b, a) OR (length(a) >= 4 AND length(b) >= 4 AND left(a, 4) = left(b, 4)))"
_WORDS = "regexp_extract_all(lower({}), '[a-zæøå0-9]{{3,}}')"
_SPELL = "replace(replace(replace({}, 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa')"
_FLAT = r"regexp_replace(regexp_replace({}, '(\d)[ .](\d)', '\1\2', 'g'), '(\d)[ .](\d)', '\1\2', 'g')"


@query(
    f"""
WITH t AS (SELECT doc_id, tekst FROM ({bare(S.CASE_TEXTS)})), q AS ({bare(_QUESTIONS)}),
j AS (SELECT id, doc_id, sporsmal, list_transform(regexp_extract_all(svar, '\\d{{1,3}}(?:[ .]\\d{{3}})+(?:,\\d+)?|\\d{{1,2}}[./]\\d{{1,2}}[./]\\d{{2,4}}|\\d+,\\d{{2}}|\\d{{4}}-\\d{{2}}-\\d{{2}}'), lambda v: trim(v)) AS verdier
      FROM q WHERE NOT ({' OR '.join(f"contains(lower(svar), '{r}')" for r in guards.REFUSALS)})),
s AS (SELECT id, doc_id, nr, ord FROM (SELECT id, doc_id, unnest({_WORDS.format('sporsmal')}) AS ord, generate_subscripts({_WORDS.format('sporsmal')}, 1) AS nr FROM j) WHERE ord NOT IN ({_STOP})),
v AS (SELECT DISTINCT id, doc_id, {_FLAT.format('v')} AS v FROM (SELECT id, doc_id, unnest(verdier) AS v FROM j) WHERE length(v) >= 4),
l AS (SELECT doc_id, nr, linje, coalesce(lag(linje) OVER (PARTITION BY doc_id ORDER BY nr), '') || ' ' || linje AS naer FROM
      (SELECT doc_id, unnest(string_split(tekst, chr(10))) AS linje, generate_subscripts(string_split(tekst, chr(10)), 1) AS nr FROM t)),
h AS (SELECT v.id, v.v, l.naer FROM v JOIN l USING (doc_id) WHERE regexp_matches({_FLAT.format('linje')}, '(^|[^0-9])' || replace(v.v, '.', '\\.') || '([^0-9]|$)')),
k AS (SELECT DISTINCT id, v FROM (SELECT h.id, h.v, {_SPELL.format('s.ord')} AS a, unnest(list_transform({_WORDS.format('h.naer')}, lambda w: {_SPELL.format('w')})) AS b FROM h JOIN s USING (id)) WHERE {_KIN}),
ok AS (SELECT v.id FROM v GROUP BY v.id HAVING count(*) = (SELECT count(DISTINCT h.v) FROM h WHERE h.id = v.id) AND (SELECT count(*) FROM k WHERE k.id = v.id) = 0),
d AS (SELECT DISTINCT doc_id, {_SPELL.format('w')} AS w FROM (SELECT doc_id, unnest({_WORDS.format('tekst')}) AS w FROM t WHERE doc_id IN (SELECT doc_id FROM q JOIN ok USING (id)))),
m AS (SELECT s.id, s.nr, s.ord FROM s JOIN ok USING (id) WHERE length(ord) >= 5 AND NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = s.doc_id AND
      (starts_with({_SPELL.format('s.ord')}, d.w) OR starts_with(d.w, {_SPELL.format('s.ord')}) OR (length(d.w) >= 4 AND left({_SPELL.format('s.ord')}, 4) = left(d.w, 4))))),
r AS (SELECT id, string_agg(ord, ',' ORDER BY nr) AS fravaerende FROM m GROUP BY id)
SELECT q.id, r.id IS NOT NULL AS gjelder, coalesce(array_to_string(list_filter(j.verdier, lambda v: length(v) >= 4), ';'), '') AS verdier, coalesce(fravaerende, '') AS fravaerende
FROM q LEFT JOIN j USING (id) LEFT JOIN r USING (id)
"""
)
def x15_field_guard(spark, d):
    got = guards.field_guard(derived(spark, d, _QUESTIONS, deal=True), derived(spark, d, S.CASE_TEXTS, deal=True).select("doc_id", "tekst"))
    return got.select("id", "gjelder", F.array_join("verdier", ";").alias("verdier"), F.array_join("fravaerende", ",").alias("fravaerende"))


# A bundle for each customer with a page for each order, and a question about one of three people.
_BUNDLES = """
SELECT o_custkey AS doc_id, o_orderkey AS side, CASE o_orderkey % 3 WHEN 0 THEN 'Vedtak for Ola Nordmann' WHEN 1 THEN 'Legeerklæring for MARIT TESTPERSON' ELSE 'Generell informasjon' END || chr(10)
  || 'Grunnlag: kr ' || CAST(10000 + o_orderkey % 11 AS STRING) || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN 'Arbeidsgiver: N o r d b y g g' || chr(10) || 'Entreprenør AS' ELSE '' END AS tekst
FROM {orders}
"""
_PERSON_QUESTIONS = """
SELECT c_custkey AS id, c_custkey AS doc_id, 'Hva er grunnlaget til ' || CASE c_custkey % 4 WHEN 0 THEN 'Ola Nordmann?' WHEN 1 THEN 'Marit Testperson?' WHEN 2 THEN 'Marit Hansen?' ELSE 'Ola Nordmann, eller Marit?' END AS sporsmal,
  CASE c_custkey % 5 WHEN 0 THEN 'Nordbygg Entreprenør AS' WHEN 1 THEN 'Det er ikke kjent' ELSE 'kr ' || CAST(10000 + c_custkey % 11 AS STRING) END AS svar
FROM {customer}
"""
_NAME = "CASE id % 4 WHEN 0 THEN CASE WHEN ola > 0 THEN 'Ola Nordmann' END WHEN 1 THEN CASE WHEN marit > 0 THEN 'Marit Testperson' END WHEN 2 THEN CASE WHEN marit > 0 THEN 'Marit' END ELSE CASE WHEN ola > 0 AND marit = 0 THEN 'Ola Nordmann' WHEN ola = 0 AND marit > 0 THEN 'Marit' END END"


@query(
    f"""
WITH p AS ({bare(_BUNDLES)}), q AS ({bare(_PERSON_QUESTIONS)}),
b AS (SELECT doc_id, count(*) AS sider, count(*) FILTER (WHERE contains(lower(tekst), 'ola nordmann')) AS ola, count(*) FILTER (WHERE contains(lower(tekst), 'marit')) AS marit FROM p GROUP BY doc_id HAVING count(*) >= 2),
n AS (SELECT q.*, {_NAME} AS navn, regexp_extract(svar, '\\d{{4,}}') AS tall FROM q JOIN b USING (doc_id)),
f AS (SELECT n.id, n.navn, p.side, contains(lower(p.tekst), lower(n.navn)) AS person,
        CASE WHEN tall <> '' THEN contains(p.tekst, tall) ELSE contains(replace(replace(lower(p.tekst), ' ', ''), chr(10), ''), replace(lower(svar), ' ', '')) END AS funnet FROM n JOIN p USING (doc_id) WHERE navn IS NOT NULL),
g AS (SELECT id, navn, count(*) FILTER (WHERE person) AS personsider, count(*) FILTER (WHERE funnet) AS funnet_paa, count(*) FILTER (WHERE person AND funnet) AS begge FROM f GROUP BY id, navn)
SELECT q.id, CASE WHEN funnet_paa > 0 AND begge = 0 THEN 'feil_person' WHEN funnet_paa > 0 THEN 'samme_person' ELSE 'ikke_vurdert' END AS dom, g.navn,
  CAST(coalesce(personsider, 0) AS INTEGER) AS personsider, CAST(coalesce(funnet_paa, 0) AS INTEGER) AS funnet_paa FROM q LEFT JOIN g USING (id)
"""
)
def x16_person_guard(spark, d):
    got = guards.person_guard(derived(spark, d, _PERSON_QUESTIONS), derived(spark, d, _BUNDLES))
    return got.select("id", "dom", "navn", F.size("personsider").alias("personsider"), F.size("funnet_paa").alias("funnet_paa"))


def _control(column: str, weights: tuple[int, ...]) -> str:
    return f"(11 - ({' + '.join(f'{w} * CAST(substr({column}, {i + 1}, 1) AS INTEGER)' for i, w in enumerate(weights))}) % 11) % 11"


def _person(alias: str, serial: str) -> tuple[str, str, str]:
    """The nine digits of a person's number, its first control digit and its second, as three steps of SQL; null where there is none."""
    nine = f"lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0') || lpad(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0') || CAST(70 + o_orderkey % 20 AS STRING) || CAST({serial} AS STRING) AS {alias}9"
    ten = f"CASE WHEN {_control(alias + '9', I.PERSON_FIRST)} < 10 THEN {alias}9 || CAST({_control(alias + '9', I.PERSON_FIRST)} AS STRING) END AS {alias}10"
    return nine, ten, f"CASE WHEN {_control(alias + '10', I.PERSON_SECOND)} < 10 THEN {alias}10 || CAST({_control(alias + '10', I.PERSON_SECOND)} AS STRING) END AS {alias}"


_A, _B = _person("a", "100 + o_custkey % 300"), _person("b", "401 + o_orderkey % 90")
_PEOPLE = f"SELECT o_orderkey AS doc_id, {_A[2]}, {_B[2]} FROM (SELECT *, {_A[1]}, {_B[1]} FROM (SELECT *, {_A[0]}, {_B[0]} FROM {{orders}}))"
# Who stands where, by the key: owner and doctor, a doctor's name in the genitive, a name above, two owners, no label, no number.
_OWNED = f"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Opplysninger om: Ola Nordmann' || chr(10) || 'Fodselsnummer: ' || x || chr(10) || 'Lege: ' || y WHEN 1 THEN 'Et brev.' || chr(10) || 'Legens navn: Kari Hansen ' || x
  WHEN 2 THEN 'Vedtak' || chr(10) || 'Per Olsen' || chr(10) || substr(x, 1, 6) || ' ' || substr(x, 7, 5) WHEN 3 THEN 'Bruker: ' || x || chr(10) || 'Søker: ' || y WHEN 4 THEN 'Referanse ' || x || ' og ' || y ELSE 'Uten nummer' END AS tekst
FROM (SELECT doc_id, coalesce(a, '00000000000') AS x, coalesce(b, '00000000000') AS y FROM ({_PEOPLE}))
"""


@query(
    f"""
WITH p AS ({bare(_PEOPLE)}),
r(m, hvem, rolle, etikett, navn) AS (VALUES (0, 'a', 'eier', 'Opplysninger om', 'Ola Nordmann'), (0, 'b', 'annen', 'Lege', NULL), (1, 'a', 'annen', 'Legens', 'Kari Hansen'), (2, 'a', 'umerket', NULL, 'Per Olsen'),
  (3, 'a', 'eier', 'Bruker', NULL), (3, 'b', 'eier', 'Søker', NULL), (4, 'a', 'umerket', NULL, NULL), (4, 'b', 'umerket', NULL, NULL))
SELECT doc_id, CASE hvem WHEN 'a' THEN a ELSE b END AS fnr, rolle, etikett, navn FROM p JOIN r ON doc_id % 6 = m WHERE CASE hvem WHEN 'a' THEN a ELSE b END IS NOT NULL
"""
)
def w5_numbers_with_labels(spark, d):
    return owners.numbers_with_labels(derived(spark, d, _OWNED, deal=True)).drop("posisjon")


@query(
    f"""
WITH p AS (SELECT *, CAST(a IS NOT NULL AS INTEGER) AS na, CAST(b IS NOT NULL AS INTEGER) AS nb, doc_id % 6 AS m FROM ({bare(_PEOPLE)})),
q AS (SELECT *, CASE m WHEN 0 THEN na + nb WHEN 1 THEN na WHEN 2 THEN na WHEN 5 THEN 0 ELSE na + nb END AS n FROM p),
s AS (SELECT *, CASE WHEN n = 0 THEN 'ingen' WHEN m = 0 THEN CASE WHEN na = 1 THEN 'merket' ELSE 'bare_andre_roller' END WHEN m = 1 THEN 'bare_andre_roller' WHEN m = 3 THEN CASE WHEN n = 2 THEN 'flertydig' ELSE 'merket' END ELSE 'umerket' END AS sikkerhet FROM q)
SELECT doc_id, sikkerhet, CASE WHEN sikkerhet = 'merket' THEN coalesce(a, b) END AS fnr, CASE WHEN sikkerhet = 'merket' AND m = 0 THEN 'Ola Nordmann' END AS navn,
  CAST(n - CASE WHEN sikkerhet = 'merket' THEN 1 ELSE 0 END AS INTEGER) AS andre FROM s
"""
)
def x9_document_owners(spark, d):
    got = owners.document_owners(derived(spark, d, _OWNED, deal=True))
    return got.select("doc_id", "sikkerhet", "fnr", "navn", F.size("andre").alias("andre"))
