"""Queries of what a document is and concerns, and of where the values of its profile come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.operators import provenance, subjects
from sparkdossier.plans.queries import query
from sparkdossier.sources.tables import bare, derived

# A headed text for each document: titles and benefits in several spellings by its id, then the whole of its own text.
_HEADED = """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '[Side 1 av 1]' || chr(10) || 'Vedtaksdato: 1.2.2024' || chr(10) || 'Klage på vedtak om dagpenger' WHEN 1 THEN 'SØKNAD OM SJUKEPENGAR' WHEN 2 THEN 'Referat fra dialogmøtereferat'
    WHEN 3 THEN 'Legeerklæring ved sykdom' WHEN 4 THEN 'Klagevedtak' WHEN 5 THEN 'Innkalling' WHEN 6 THEN 'NAV 04-01.03' || chr(10) || 'Uten titler' WHEN 7 THEN '' ELSE 'Telefonnotat og purring' END || chr(10) || 'Linje to' || chr(10)
  || CASE doc_id % 7 WHEN 0 THEN 'Det gjelder uførepensjon, ikke barnepensjon eller uførepensjonen.' WHEN 1 THEN 'arbeidsavklaringspengar og kontantstøtte og KONTANTSTOETTE' WHEN 2 THEN 'en faktura, en attest til og attesten'
    WHEN 3 THEN 'Opplæringspenger' WHEN 4 THEN 'krav om dokumentasjon og avtale' ELSE '' END || chr(10) || coalesce(text, '') AS tekst
FROM {documents}
"""
_FOLDED = "lower(tekst)"
for _old, _new in (("æ", "a"), ("ø", "o"), ("å", "a"), ("ae", "a"), ("oe", "o"), ("aa", "a")):
    _FOLDED = f"replace({_FOLDED}, '{_old}', '{_new}')"
_TITLE = r"""
lower(array_to_string(list_filter(list_transform(regexp_split_to_array(tekst, '\r\n|[\n\r\x0B\x0C]'), lambda x: trim(x, ' ' || chr(9))),
  lambda x: x <> '' AND NOT regexp_matches(x, '^\[Side \d+ av \d+\]$') AND NOT regexp_matches(x, '^[\pL\pN_ ./-]{2,30}:\s*\S'))[1:2], chr(10)))
"""


def _benefit_steps(text: str, name: str) -> str:
    """Steps of SQL that end in ``name`` (doc_id, navn as a list): every place of every spelling, less those inside a longer one."""
    forms = ", ".join(f"('{w}', '{b}')" for w, b in sorted(subjects.FORMS.items()))
    return f"""
{name}f(form, ytelse) AS (VALUES {forms}), {name}t AS (SELECT doc_id, {_FOLDED} AS flat FROM (SELECT doc_id, {text} AS tekst FROM t)),
{name}s AS (SELECT doc_id, form, ytelse, string_split(flat, form) AS deler FROM {name}t JOIN {name}f ON contains(flat, form)),
{name}h AS (SELECT doc_id, ytelse, length(form) AS n, list_sum(list_transform(deler[1:k], lambda p: length(p))) + (k - 1) * length(form) AS fra FROM (SELECT *, unnest(range(1, len(deler))) AS k FROM {name}s)),
{name}o AS (SELECT doc_id, ytelse, min(fra) AS fra FROM {name}h h WHERE NOT EXISTS (SELECT 1 FROM {name}h o WHERE o.doc_id = h.doc_id AND o.fra <= h.fra AND o.fra + o.n >= h.fra + h.n AND o.n > h.n) GROUP BY doc_id, ytelse),
{name} AS (SELECT doc_id, list(ytelse ORDER BY fra) AS navn FROM {name}o GROUP BY doc_id)"""


def _type_steps() -> str:
    """Steps of SQL that end in ``ty`` (doc_id, i_tittel, i_tekst)."""
    kinds = ", ".join(f"({i}, '{k}', '{w}')" for i, (k, w) in enumerate(subjects.TYPES.items()))
    return f"""
ty_m(nr, type, ord) AS (VALUES {kinds}), ty_t AS (SELECT doc_id, lower(tekst) AS lav, {_TITLE} AS tittel FROM t),
ty_h AS (SELECT doc_id, type, length(regexp_extract(tittel, '(?s)^(.*?)(?:' || ord || ')', 1)) AS fra, length(regexp_extract(tittel, ord)) AS n FROM ty_t JOIN ty_m ON regexp_matches(tittel, ord)),
ty_a AS (SELECT doc_id, min(struct_pack(fra := fra, n := -n, type := type)).type AS i_tittel FROM ty_h GROUP BY doc_id),
ty_b AS (SELECT doc_id, type, nr, len(regexp_extract_all(lav, ord)) AS antall FROM ty_t JOIN ty_m ON regexp_matches(lav, ord)),
ty_c AS (SELECT doc_id, max(struct_pack(antall := antall, nr := -nr, type := type)).type AS i_tekst FROM ty_b GROUP BY doc_id),
ty AS (SELECT doc_id, i_tittel, i_tekst FROM t LEFT JOIN ty_a USING (doc_id) LEFT JOIN ty_c USING (doc_id))"""


@query(f"WITH t AS ({bare(_HEADED)}), {_type_steps()} SELECT doc_id, coalesce(i_tittel, i_tekst, '') AS type, CASE WHEN i_tittel IS NOT NULL THEN 'tittel' WHEN i_tekst IS NOT NULL THEN 'tekst' END AS kilde FROM ty")
def w12_document_types(spark, d):
    return subjects.document_types(derived(spark, d, _HEADED))


# Form numbers and their benefits, one of them unknown to the list of benefits.
_FORMS = "SELECT DISTINCT 'NAV 04-01.0' || CAST(r_regionkey AS STRING) AS nummer, CASE r_regionkey WHEN 3 THEN 'dagpenger' ELSE 'sykepenger' END AS ytelse FROM {region}"


@query(
    f"""
WITH t AS ({bare(_HEADED)}), {_type_steps()}, {_benefit_steps('tekst', 'alt')}, {_benefit_steps(_TITLE, 'tit')}, s AS ({bare(_FORMS)}),
j AS (SELECT doc_id, s.ytelse AS av_skjema, tit.navn AS tit, coalesce(alt.navn, []) AS alle, coalesce(i_tittel, i_tekst, '') AS type FROM t JOIN ty USING (doc_id) LEFT JOIN alt USING (doc_id) LEFT JOIN tit USING (doc_id)
  LEFT JOIN s ON s.nummer = 'NAV ' || nullif(regexp_extract(t.tekst, '\\bNAV\\s?(\\d{{2}}-\\d{{2}}\\.\\d{{2}})\\b', 1), '')),
k AS (SELECT *, CASE WHEN av_skjema IS NOT NULL THEN 'skjemanummer' WHEN tit IS NOT NULL THEN 'tittel' WHEN len(alle) = 1 AND type NOT IN ('legeerklaring', 'egenerklaring') THEN 'tekst' END AS kilde FROM j),
g AS (SELECT *, CASE WHEN kilde IS NULL AND len(alle) > 0 THEN CASE WHEN type IN ('legeerklaring', 'egenerklaring') THEN 'generisk_blankett' ELSE 'flere_i_teksten' END END AS grunn FROM k)
SELECT doc_id, CASE kilde WHEN 'skjemanummer' THEN av_skjema WHEN 'tittel' THEN tit[1] WHEN 'tekst' THEN alle[1] END AS navn, kilde, grunn, CASE WHEN grunn IS NULL THEN '' ELSE array_to_string(alle, ',') END AS kandidater, array_to_string(alle, ',') AS alle FROM g
"""
)
def x4_document_benefits(spark, d):
    got = subjects.document_benefits(derived(spark, d, _HEADED), derived(spark, d, _FORMS))
    return got.withColumns({c: F.array_join(c, ",") for c in ("kandidater", "alle")})


# A profile for each order beside a text of three pages (or none), in which its values stand as found, in another spelling, twice, before
# the first page or not at all.
_PROFILES = """
SELECT o_orderkey AS doc_id, 'd' || CAST(o_orderkey AS STRING) AS saksnummer, lpad(CAST(o_orderkey * 104729 + 12345678901 AS STRING), 11, '0') AS konto, CAST(o_orderkey % 9000 + 1000 AS DOUBLE) + 0.5 AS sats,
  'k' || CAST(o_custkey AS STRING) || '@post.no' AS epost, CASE o_orderkey % 5 WHEN 0 THEN 'etikett' WHEN 1 THEN 'flertydig' WHEN 2 THEN 'bare_andre_roller' WHEN 3 THEN 'umerket' END AS grunnlag,
  CASE o_orderkey % 5 WHEN 0 THEN lpad(CAST(o_custkey * 7919 AS STRING), 11, '1') END AS fnr, CASE o_orderkey % 4 WHEN 0 THEN 'posisjon' WHEN 1 THEN 'pdf_metadata' WHEN 2 THEN 'etikett' END AS dato_kilde,
  CASE o_orderkey % 3 WHEN 0 THEN 'hoy' WHEN 1 THEN '' END AS dato_sikkerhet, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 3 + 1 AS INTEGER) END AS dato_side, CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderkey % 60 AS INTEGER) END AS sted
FROM {orders}
"""
_PROFILED = f"""
SELECT *, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN 'Uten merker ' || epost || ' ' || saksnummer
  ELSE CASE WHEN doc_id % 3 = 0 THEN 'Omslag til ' || saksnummer || chr(10) ELSE '' END || '[Side 1 av 3]' || chr(10) || 'Konto ' || substr(konto, 1, 4) || '.' || substr(konto, 5, 2) || '.' || substr(konto, 7) || chr(10)
    || CASE WHEN doc_id % 4 = 0 THEN 'Til ' || upper(epost) || chr(10) ELSE '' END || '[Side 2 av 3]' || chr(10) || 'kr ' || substr(CAST(sats AS STRING), 1, 1) || ' ' || substr(CAST(sats AS STRING), 2, 3) || ',50' || chr(10)
    || CASE WHEN doc_id % 5 = 0 THEN 'Fnr ' || coalesce(fnr, '') || chr(10) ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN 'konto ' || konto || chr(10) ELSE '' END
    || '[Side 3 av 3]' || chr(10) || 'Sak ' || saksnummer || ', ' || epost || CASE WHEN doc_id % 7 = 0 THEN ' og ' || epost ELSE '' END END AS tekst
FROM ({_PROFILES})
"""
_NUMBERED = "regexp_replace(lower({}), '[^\\pL\\pN]', '', 'g')"
_MARKER = "'\\[Side \\d+ av \\d+\\]'"
_SURE = "CASE grunnlag WHEN 'etikett' THEN 'hoy' WHEN 'flertydig' THEN 'lav' WHEN 'umerket' THEN 'lav' ELSE 'ingen' END"


@query(
    f"""
WITH p AS ({bare(_PROFILED)}), r AS (
  SELECT doc_id, '/dokumentprofil/part/fnr' AS peker, CASE grunnlag WHEN 'etikett' THEN 'etikett' ELSE 'ingen' END AS metode, {_SURE} AS konfidens, fnr AS verdi, NULL AS annen, sted, CAST(NULL AS INTEGER) AS side FROM p
  UNION ALL SELECT doc_id, '/dokumentprofil/dokument/dato', CASE dato_kilde WHEN 'etikett' THEN 'etikett' WHEN 'posisjon' THEN 'posisjon' WHEN 'pdf_metadata' THEN 'metadata' ELSE 'ingen' END, coalesce(nullif(dato_sikkerhet, ''), 'ingen'), NULL, NULL, NULL, dato_side FROM p
  UNION ALL SELECT doc_id, '/dokumentprofil/sak/saksnummer', 'etikett', 'hoy', saksnummer, NULL, NULL, NULL FROM p
  UNION ALL SELECT doc_id, '/dokumentprofil/okonomi/dagsats', 'etikett', 'hoy', CAST(sats AS STRING), printf('%.2f', sats), NULL, NULL FROM p
  UNION ALL SELECT doc_id, '/dokumentprofil/okonomi/kontonummer/0', 'sjekksum', 'hoy', konto, NULL, NULL, NULL FROM p
  UNION ALL SELECT doc_id, '/dokumentprofil/kontakt/eposter/0', 'regel', 'hoy', epost, NULL, NULL, NULL FROM p),
f AS (SELECT r.*, p.tekst, {_NUMBERED.format('p.tekst')} AS flat, {_NUMBERED.format('verdi')} AS n, {_NUMBERED.format('annen')} AS m, regexp_split_to_array(p.tekst, {_MARKER}) AS deler, regexp_extract_all(p.tekst, {_MARKER}) AS merker FROM r JOIN p USING (doc_id)),
s AS (SELECT *, CASE WHEN sted IS NOT NULL THEN sted + 1 ELSE nullif(strpos(tekst, verdi), 0) END AS i, CASE WHEN contains(flat, n) THEN strpos(flat, n) ELSE nullif(strpos(flat, m), 0) END AS j,
  list_transform(range(1, len(merker) + 1), lambda k: list_sum(list_transform(deler[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(merker[1:k - 1], lambda x: length(x))), 0)) AS starter,
  list_transform(range(1, len(merker) + 1), lambda k: list_sum(list_transform(deler[1:k], lambda x: length({_NUMBERED.format('x')}))) + coalesce(list_sum(list_transform(merker[1:k - 1], lambda x: length({_NUMBERED.format('x')}))), 0)) AS flate FROM f),
b AS (SELECT *, CASE WHEN i IS NOT NULL THEN len(list_filter(starter, lambda x: x < i)) WHEN j IS NOT NULL THEN len(list_filter(flate, lambda x: x < j)) END AS foran,
  CASE WHEN (length(tekst) - length(replace(tekst, verdi, ''))) / length(verdi) >= 2 THEN 2 ELSE (length(flat) - length(replace(flat, n, ''))) / length(n) END AS antall FROM s)
SELECT doc_id, peker, metode, konfidens, CASE WHEN side IS NOT NULL THEN side WHEN sted IS NOT NULL AND tekst IS NULL THEN 1 WHEN foran IS NULL THEN NULL WHEN len(merker) = 0 THEN 1 WHEN foran > 0 THEN CAST(regexp_extract(merker[foran], '\\d+') AS INTEGER) END AS side,
  CASE WHEN side IS NOT NULL OR sted IS NOT NULL THEN true WHEN verdi IS NOT NULL AND tekst IS NOT NULL THEN antall < 2 END AS side_entydig FROM b
"""
)
def m7_provenance(spark, d):
    p = derived(spark, d, _PROFILED)
    profile = p.select(
        "doc_id", "tekst", F.struct("fnr", "grunnlag", F.col("sted").alias("posisjon")).alias("part"), F.struct("dato_kilde", "dato_sikkerhet", "dato_side").alias("dokument"),
        F.struct("saksnummer").alias("sak"), F.struct(F.array("konto").alias("kontonummer"), F.col("sats").alias("dagsats")).alias("okonomi"), F.struct(F.array("epost").alias("eposter")).alias("kontakt"),
    )
    return provenance.provenance(profile, "alle").drop("begrunnelse")
