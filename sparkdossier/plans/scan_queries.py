"""Queries over scanned texts: dates and what they are, identifiers and their redaction, amounts and labelled fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.functions import identifiers as I
from sparkdossier.functions import scanners
from sparkdossier.functions import text as T
from sparkdossier.operators import contact as C
from sparkdossier.operators import dates as D
from sparkdossier.operators import labelled as L
from sparkdossier.operators import redaction as R
from sparkdossier.plans.contact_queries import _LETTER
from sparkdossier.plans.queries import _BIRTH, _NUM, ORACLE, _check, _digits, query
from sparkdossier.sources import tables as S
from sparkdossier.sources.tables import bare, dealt, derived, table

YEAR = 2026
_DMY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' || CAST(year(o_orderdate) AS STRING)"
_NAMES = list(scanners.MONTHS)[:12]
_MONTH = "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(_NAMES)) + " END"
# All five grammars, dates that are none, and one date written twice.
_DATED = (
    f"SELECT o_orderkey AS doc_id, 'Dato ' || CAST(day(o_orderdate) AS STRING) || '. ' || {_MONTH} || ' ' || CAST(year(o_orderdate) AS STRING) || ', frist ' || "
    "CAST(year(o_orderdate) + 1 AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-01, ugyldig 31.02.2001, kort ' || CAST(day(o_orderdate) AS STRING) || '/' || "
    "CAST(month(o_orderdate) AS STRING) || '/' || substr(CAST(year(o_orderdate) AS STRING), 3, 2) || ' og March 3, 2020, sist 02 . 03 .2004kr, 1.1.1700, 20261231' AS tekst FROM {orders}"
)


def _days(c: F.Column) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("SELECT o_orderkey AS doc_id, CAST(CAST(o_orderdate AS DATE) AS STRING) || ',' || CAST(year(o_orderdate) + 1 AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-01,2020-03-03,2004-03-02' AS datoer FROM orders")
def d1_dates(spark, d):
    return derived(spark, d, _DATED, deal=True).select("doc_id", _days(D.distinct_dates(scanners.scan_days(F.col("tekst"), YEAR))).alias("datoer"))


_SHORT = "SELECT o_orderkey AS doc_id, 'den ' || CAST(o_orderkey % 28 + 1 AS STRING) || '.' || CAST(o_orderkey % 12 + 1 AS STRING) || '.' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || ' og 31.12.1999' AS tekst FROM {orders}"


@query(
    f"SELECT o_orderkey AS doc_id, try_cast(CAST(CASE WHEN o_orderkey % 100 <= {YEAR % 100} THEN 2000 ELSE 1900 END + o_orderkey % 100 AS STRING) || '-' || lpad(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0') || '-' "
    "|| lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0') AS DATE) AS dato, TRUE AS antatt, DATE '1999-12-31' AS sikker FROM orders"
)
def d2_short_years(spark, d):
    hits = derived(spark, d, _SHORT, deal=True).select("doc_id", scanners.scan_days(F.col("tekst"), YEAR).alias("h"))
    return hits.select("doc_id", F.col("h")[0]["dato"].alias("dato"), F.col("h")[0]["antatt"].alias("antatt"), D.unambiguous(F.col("h")).alias("sikker"))


_ODD = "SELECT o_orderkey AS doc_id, lpad(CAST(o_orderkey % 35 AS STRING), 2, '0') || '.' || lpad(CAST(o_orderkey % 14 AS STRING), 2, '0') || '.' || CAST(1840 + o_orderkey % 200 AS STRING) AS tekst FROM {orders}"


@query(
    f"WITH x AS (SELECT o_orderkey AS doc_id, 1840 + o_orderkey % 200 AS y, try_cast(CAST(1840 + o_orderkey % 200 AS STRING) || '-' || lpad(CAST(o_orderkey % 14 AS STRING), 2, '0') || '-' || lpad(CAST(o_orderkey % 35 AS STRING), 2, '0') AS DATE) AS dato FROM orders) "
    f"SELECT doc_id, dato FROM x WHERE dato IS NOT NULL AND y BETWEEN 1854 AND {YEAR + 1}"
)
def d3_valid_dates(spark, d):
    return derived(spark, d, _ODD, deal=True).select("doc_id", F.explode(scanners.scan_days(F.col("tekst"), YEAR)).alias("h")).select("doc_id", "h.dato")


@query("SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS dato FROM orders")
def d4_first_date(spark, d):
    return derived(spark, d, _DATED, deal=True).select("doc_id", D.unambiguous(scanners.scan_days(F.col("tekst"), YEAR)).alias("dato"))


@query(
    f"SELECT o_orderkey AS doc_id, {_DMY} AS norsk, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS dato FROM orders"
)
def d5_renderings(spark, d):
    written = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("date").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-M-d'T'")).otherwise("2020-02-30")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), D.norwegian(F.col("o_orderdate").cast("date")).alias("norsk"), D.strict_iso(written).alias("dato"))


# A date behind one of several labels or none, then an interval, a stamped date, and a date in a sentence.
_LETTERED = (
    "SELECT o_orderkey AS doc_id, '[Side 1 av 1]' || chr(10) || CASE o_orderkey % 8 WHEN 0 THEN 'Vedtaksdato: ' WHEN 1 THEN 'Mottatt ' WHEN 2 THEN 'Frist: ' WHEN 3 THEN 'Søknad datert ' WHEN 4 THEN 'Oslo, ' WHEN 5 THEN '' "
    f"WHEN 6 THEN 'Utbetalt i perioden f.o.m. ' ELSE 'Sendt ' END || {_DMY} || chr(10) || 'Dagpenger for perioden 01.01.1990 til 31.12.1990' || chr(10) || 'Stempel og hilsen fra arkivet 05.05.1991' || chr(10) "
    "|| 'Vi viser til samtalen med saksbehandleren vår om dette den 6. juni 1991 på kontoret i byen.' AS tekst FROM {orders}"
)
_KIND = "CASE o_orderkey % 8 WHEN 0 THEN 'vedtaksdato' WHEN 1 THEN 'mottatt' WHEN 2 THEN 'frist' WHEN 3 THEN 'soknadsdato' WHEN 6 THEN 'periode_start' WHEN 7 THEN 'sendt' ELSE 'brevdato_sannsynlig' END"
_KINDS_SQL = (
    f"WITH k AS (SELECT o_orderkey AS doc_id, 0 AS nr, CAST(o_orderdate AS DATE) AS dato, {_KIND} AS type FROM orders UNION ALL SELECT o_orderkey, 1, DATE '1990-01-01', 'periode_start' FROM orders "
    "UNION ALL SELECT o_orderkey, 2, DATE '1990-12-31', 'periode_slutt' FROM orders UNION ALL SELECT o_orderkey, 3, DATE '1991-05-05', 'ukjent' FROM orders UNION ALL SELECT o_orderkey, 4, DATE '1991-06-06', 'i_lopende_tekst' FROM orders), "
    "r AS (SELECT *, CASE WHEN type IN ('vedtaksdato', 'soknadsdato', 'brevdato_sannsynlig', 'sendt') THEN 'dokument' WHEN type = 'mottatt' THEN 'behandling' WHEN type = 'ukjent' THEN 'ukjent' ELSE 'innhold' END AS rolle FROM k) "
)


def _classified(spark, d):
    return D.classify(derived(spark, d, _LETTERED, deal=True), YEAR)


@query(_KINDS_SQL + "SELECT doc_id, nr, dato, type, rolle FROM r")
def d6_classified_dates(spark, d):
    return _classified(spark, d).select("doc_id", "nr", "dato", "type", "rolle")


_ALL_KINDS = [k for kinds in D.ROLES.values() for k in kinds] + ["fodselsdato", "frist", "utlop", "en_ny_type"]
_PICK = f"CASE o_orderkey % {len(_ALL_KINDS) + 1} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_ALL_KINDS)) + " END"


@query(
    f"WITH v(type, rolle) AS (VALUES {', '.join(f'({k!r}, {r!r})' for r, kinds in D.ROLES.items() for k in kinds)}) "
    f"SELECT doc_id, CASE WHEN o.type IS NULL THEN 'ukjent' ELSE coalesce(v.rolle, 'innhold') END AS rolle FROM (SELECT o_orderkey AS doc_id, {_PICK} AS type FROM orders) o LEFT JOIN v ON v.type = o.type"
)
def d7_roles(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), D.role(F.expr(_PICK)).alias("rolle"))


@query("SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS forfall FROM orders")
def d9_due_dates(spark, d):
    return derived(spark, d, _LETTER, deal=True).select("doc_id", L.due_date(F.col("tekst"), YEAR).alias("forfall"))


@query(_KINDS_SQL + "SELECT doc_id, dato, type FROM r WHERE rolle = 'behandling' OR nr = 3")
def d10_stamps(spark, d):
    return D.stamps(_classified(spark, d)).select("doc_id", "dato", "type")


@query(
    _KINDS_SQL + ", c AS (SELECT *, CASE type WHEN 'sendt' THEN 2 WHEN 'brevdato_sannsynlig' THEN 2 ELSE 1 END AS rang FROM r WHERE rolle = 'dokument'), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rang, nr) AS plass, count(*) OVER (PARTITION BY doc_id) AS n FROM c) "
    "SELECT doc_id, dato, type, CASE rang WHEN 1 THEN 'hoy' ELSE 'middels' END AS konfidens, CAST(n - 1 AS INTEGER) AS alternativer FROM p WHERE plass = 1"
)
def w1_from_text(spark, d):
    return D.document_date(_classified(spark, d), "2026-01-01").select("doc_id", "dato", "type", "konfidens", F.size("alternativer").alias("alternativer"))


@query(_KINDS_SQL + "SELECT doc_id, DATE '1990-01-01' AS fra, DATE '1990-12-31' AS til FROM r WHERE nr = 0")
def w3_period_of_text(spark, d):
    return D.period(_classified(spark, d))


@query("SELECT doc_id, list_aggregate(list_transform(range(0, 3), lambda i: CAST(DATE '2001-01-01' + CAST(i AS INTEGER) AS STRING)), 'string_agg', ',') AS datoer FROM (SELECT o_orderkey AS doc_id FROM orders)")
def w18_first_dates(spark, d):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.format_string("%02d.01.2001", F.greatest(i - 1, F.lit(1)))), " ; ")
    return dealt(table(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), _days(D.distinct_dates(scanners.scan_days(text, YEAR), 3)).alias("datoer"))


# Numbers are written with blanks, dots and hyphens or over two lines, beside a date and an amount that they must not take in.
_HIDDEN = (
    "SELECT doc_id, 'Nr ' || substr(fnr, 1, 6) || CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE chr(10) END || substr(fnr, 7, 5) || ' og kontonr. ' || substr(konto, 1, 4) || '.' || substr(konto, 5, 2) || '.' || substr(konto, 7, 5) "
    f"|| ', org ' || orgnr || ' slutt 01.01.2024 114 kroner, kr 103 456 789' AS tekst FROM ({S.NUMBERS})"
)
_PERSON = "fodt IS NOT NULL AND " + _check("tall", I.PERSON_FIRST) + " AND " + _check("tall", I.PERSON_SECOND)
_BOTH = (
    _NUM + ", alle AS (SELECT doc_id, fnr AS tall, 0 AS merket FROM n UNION ALL SELECT doc_id, konto, 1 FROM n), "
    "a AS (SELECT *, CAST(substr(tall, 1, 2) AS INTEGER) AS dd, CAST(substr(tall, 3, 2) AS INTEGER) AS mm, CAST(substr(tall, 5, 2) AS INTEGER) AS yy, CAST(substr(tall, 7, 3) AS INTEGER) AS s FROM alle), "
    "b AS (SELECT *, CASE WHEN dd > 40 THEN dd - 40 ELSE dd END AS d2, CASE WHEN mm > 80 THEN mm - 80 WHEN mm > 40 THEN mm - 40 ELSE mm END AS m2, "
    "CASE WHEN s >= 500 AND yy <= 39 THEN 2000 WHEN s >= 900 THEN 1900 WHEN s >= 500 AND yy >= 54 THEN 1800 ELSE 1900 END + yy AS y2 FROM a), "
    "f AS (SELECT *, try_cast(printf('%04d-%02d-%02d', y2, m2, d2) AS DATE) AS fodt FROM b), "
    f"p AS (SELECT doc_id, tall, merket, CASE WHEN merket = 1 AND {_check('tall', I.ACCOUNT)} THEN 'kontonummer' WHEN {_PERSON} THEN 'fodselsnummer' WHEN {_check('tall', I.ACCOUNT)} THEN 'kontonummer' END AS type FROM f), "
    f"i AS (SELECT DISTINCT doc_id, tall, type FROM p WHERE type IS NOT NULL UNION SELECT doc_id, orgnr, 'organisasjonsnummer' FROM n WHERE {_check('orgnr', I.COMPANY)}) "
)


def _identified(spark, d):
    return R.candidates(derived(spark, d, _HIDDEN, deal=True), ("fodselsnummer", "kontonummer", "organisasjonsnummer")).select("doc_id", F.col("verdi").alias("tall"), "type").distinct()


@query(_BOTH + "SELECT doc_id, tall, type FROM i")
def i7_identifiers(spark, d):
    return _identified(spark, d)


@query(_BOTH + "SELECT type, count(*) AS antall FROM i WHERE type <> 'organisasjonsnummer' GROUP BY type")
def i8_number_kinds(spark, d):
    return _identified(spark, d).where("type <> 'organisasjonsnummer'").groupBy("type").agg(F.count(F.lit(1)).alias("antall"))


# A person's number stands before the account in the text, so the one that is not labelled comes first.
_EACH = "arg_min(tall, plass) FILTER (WHERE type = '{0}') AS {0}, coalesce(string_agg(tall, ',' ORDER BY plass) FILTER (WHERE type = '{0}'), '') AS alle_{0}"


@query(
    _BOTH
    + ", m AS (SELECT doc_id, tall, type, min(merket) AS plass FROM p WHERE type IS NOT NULL GROUP BY doc_id, tall, type UNION ALL SELECT doc_id, tall, type, 2 FROM i WHERE type = 'organisasjonsnummer') "
    + f"SELECT doc_id, {', '.join(_EACH.format(k) for k in ('fodselsnummer', 'kontonummer', 'organisasjonsnummer'))} FROM m GROUP BY doc_id"
)
def i9_numbers_of_document(spark, d):
    got = R.numbers_of_documents(derived(spark, d, _HIDDEN, deal=True))
    return got.withColumns({c: F.array_join(c, ",") for c in got.columns if c.startswith("alle_")})


@query(_NUM + f"SELECT doc_id, (11 - ({_digits('orgnr', I.COMPANY)}) % 11) % 11 AS siffer FROM n")
def i1_control_digits(spark, d):
    return derived(spark, d, S.NUMBERS).select("doc_id", I.mod11(F.col("orgnr"), I.COMPANY).alias("siffer"))


_PAY = f"SELECT doc_id, 'Betal innen fristen, ' || CASE doc_id % 3 WHEN 0 THEN 'KID-nummer: ' WHEN 1 THEN 'KID ' ELSE 'referanse ' END || substr(kid, 1, 2) || ' ' || substr(kid, 3) || ' til oss' AS tekst FROM ({S.NUMBERS})"


@query(f"SELECT doc_id, kid FROM ({ORACLE['i6_payment_references']}) WHERE doc_id % 3 <> 2")
def i10_references(spark, d):
    found = derived(spark, d, _PAY, deal=True).select("doc_id", F.explode(scanners.scan("references", F.col("tekst"))).alias("x")).select("doc_id", F.col("x.tall").alias("kid"))
    return found.where(I.valid_payment_reference(F.col("kid")))


_MAIL = r"[\pL\pN_.+-]{1,64}@[\pL\pN_-]{1,63}\.[\pL\pN_.]{2,24}"


@query(f"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '{_MAIL}'))) AS INTEGER) AS antall FROM documents WHERE contains(text, '@')")
def i12_emails(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", F.size(T.emails(F.col("text"))).alias("antall"))


# Each kind once; whether the person's number and the account pass depends on the row.
_PRIVATE = (
    "SELECT doc_id, 'Skriv til kåre' || CAST(doc_id AS STRING) || '@post.no eller ring 22 33 44 ' || CAST(10 + doc_id % 90 AS STRING) || '. Org.nr ' || orgnr || ', kontonummer ' || konto || ', ordrenr 2233445' || CAST(doc_id % 10 AS STRING) || '.' AS tekst "
    f"FROM ({S.NUMBERS})"
)
_GONE = f"CASE WHEN {_check('konto', I.ACCOUNT)} THEN '[SLADDET kontonummer]' ELSE konto END"


@query(
    _NUM + ", q AS (SELECT doc_id, konto AS fnr, konto, orgnr FROM n), " + _BIRTH[len(_NUM) + 2 :].replace("FROM n)", "FROM q)", 1).rstrip() + ", "
    f"t AS (SELECT q.*, fodt IS NOT NULL AND {_check('q.konto', I.PERSON_FIRST)} AND {_check('q.konto', I.PERSON_SECOND)} AS person FROM q JOIN f USING (doc_id)) "
    f"SELECT doc_id, 'Skriv til [SLADDET epost] eller ring [SLADDET telefon]. Org.nr ' || CASE WHEN {_check('orgnr', I.COMPANY)} THEN '[SLADDET organisasjonsnummer]' ELSE orgnr END || ', kontonummer ' || "
    f"CASE WHEN {_check('konto', I.ACCOUNT)} THEN '[SLADDET kontonummer]' WHEN person THEN '[SLADDET fodselsnummer]' ELSE konto END || ', ordrenr 2233445' || CAST(doc_id % 10 AS STRING) || '.' AS tekst FROM t"
)
def i13_redacted(spark, d):
    return R.redact(derived(spark, d, _PRIVATE, deal=True)).select("doc_id", F.col("sladdet").alias("tekst"))


@query(_NUM + f"SELECT 'epost' AS type, count(*) AS antall FROM n UNION ALL SELECT 'telefon', count(*) FROM n UNION ALL SELECT 'organisasjonsnummer', count(*) FROM n WHERE {_check('orgnr', I.COMPANY)}")
def a24_redaction_counts(spark, d):
    return R.redacted_spans(derived(spark, d, _PRIVATE, deal=True), ("epost", "telefon", "organisasjonsnummer")).groupBy("type").agg(F.count(F.lit(1)).alias("antall"))


_LEAK = f"SELECT doc_id, 'Fødselsnummer: ' || CASE WHEN doc_id % 3 = 0 THEN substr(fnr, 1, 7) ELSE fnr END || ' er oppgitt, org.nr. ' || orgnr || '.' AS tekst FROM ({S.NUMBERS})"


@query(
    _BIRTH + f"SELECT doc_id, 'fodselsnummer' AS type, CASE WHEN doc_id % 3 = 0 THEN 'feil_lengde' ELSE 'kontrollsiffer_feilet' END AS grunn FROM f "
    f"WHERE doc_id % 3 = 0 OR NOT (fodt IS NOT NULL AND {_check('fnr', I.PERSON_FIRST)} AND {_check('fnr', I.PERSON_SECOND)} OR {_check('fnr', I.ACCOUNT)}) "
    f"UNION ALL SELECT doc_id, 'organisasjonsnummer', 'kontrollsiffer_feilet' FROM n WHERE NOT {_check('orgnr', I.COMPANY)}"
)
def i14_suspects(spark, d):
    return R.suspects(derived(spark, d, _LEAK, deal=True)).select("doc_id", "type", "grunn")


@query(
    _BIRTH + ", s AS (SELECT doc_id FROM f "
    f"WHERE doc_id % 3 = 0 OR NOT (fodt IS NOT NULL AND {_check('fnr', I.PERSON_FIRST)} AND {_check('fnr', I.PERSON_SECOND)} OR {_check('fnr', I.ACCOUNT)}) "
    f"UNION SELECT doc_id FROM n WHERE NOT {_check('orgnr', I.COMPANY)}) SELECT n.doc_id, s.doc_id IS NULL AS fullstendig FROM n LEFT JOIN s USING (doc_id)"
)
def z5_redaction_report(spark, d):
    return R.redaction_report(derived(spark, d, _LEAK, deal=True)).select("doc_id", "fullstendig")


_FORM = "CASE o_orderkey % 6 WHEN 0 THEN 'kr 1 2O' || CAST(o_orderkey % 10 AS STRING) || ',50' WHEN 1 THEN '12.345,-' WHEN 2 THEN '463,0' || CAST(o_orderkey % 10 AS STRING) WHEN 3 THEN 'NOK 6380.0' || CAST(o_orderkey % 10 AS STRING) WHEN 4 THEN '500,-' ELSE '12 500 kroner' END"
_NUMBER = "CASE o_orderkey % 6 WHEN 0 THEN 1200.5 + o_orderkey % 10 WHEN 1 THEN 12345 WHEN 2 THEN 463 + (o_orderkey % 10) / 100.0 WHEN 3 THEN 6380 + (o_orderkey % 10) / 100.0 WHEN 4 THEN NULL ELSE 12500 END"
_BILL = f"SELECT o_orderkey AS doc_id, 'Nr 20261, ' || {_FORM} || ' og 7 km' || chr(10) || 'Total km 99' || chr(10) || 'Sum kr:' || chr(10) || 'kr 486,00' || chr(10) || 'Total: kr 1,00' AS tekst FROM {{orders}}"
_RAW = "CASE o_orderkey % 5 WHEN 0 THEN '500,-' WHEN 1 THEN '1 240,-' WHEN 2 THEN '46.3' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') WHEN 3 THEN '6380.' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') ELSE CAST(o_orderkey % 1000 AS STRING) || ' OO1,25' END"


@query(
    "SELECT o_orderkey AS id, CAST(CASE o_orderkey % 5 WHEN 0 THEN 500 WHEN 1 THEN 1240 WHEN 2 THEN 46300 + o_orderkey % 100 WHEN 3 THEN 6380 + (o_orderkey % 100) / 100.0 ELSE (o_orderkey % 1000) * 1000 + 1.25 END AS DOUBLE) AS belop FROM orders"
)
def b1_amounts(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.amount(F.expr(_RAW)).alias("belop"))


@query(f"SELECT o_orderkey AS doc_id, CAST(coalesce({_NUMBER}, 486) AS DOUBLE) AS belop FROM orders")
def b2_first_amount(spark, d):
    return derived(spark, d, _BILL, deal=True).select("doc_id", L.first_amount(F.col("tekst")).alias("belop"))


@query(f"SELECT o_orderkey AS doc_id, CAST({_NUMBER} AS DOUBLE) AS verdi FROM orders WHERE o_orderkey % 6 <> 4 UNION ALL SELECT o_orderkey, 486 FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders")
def b3_all_amounts(spark, d):
    return L.all_amounts(derived(spark, d, _BILL, deal=True)).select("doc_id", "verdi")


@query("SELECT o_orderkey AS doc_id, CAST(486 AS DOUBLE) AS total FROM orders")
def b4_totals(spark, d):
    return L.totals(derived(spark, d, _BILL, deal=True))


# A form with every labelled field, some woven into sentences, and a heading that names a label without being one.
_FILLED = (
    "SELECT o_orderkey AS doc_id, 'Inntektsmelding fra arbeidsgiver' || chr(10) || 'Innsendt 28.04.2026' || chr(10) || 'Arbeidsgiver: Firma ' || CAST(o_custkey AS STRING) || ' AS, Oslo' || chr(10) || 'Stilling: Kokk' || chr(10) "
    "|| 'Stillingsprosent: ' || CAST(o_orderkey % 130 AS STRING) || ' %' || chr(10) || 'Saksnummer: ' || CAST(10000 + o_custkey AS STRING) || chr(10) || 'Journalnr. 2026/' || CAST(1000 + o_orderkey % 9000 AS STRING) || chr(10) "
    "|| 'Vedtaksnr: ' || CAST(70000 + o_orderkey % 9 AS STRING) || chr(10) || 'Vår referanse: AB-' || CAST(o_orderkey AS STRING) || chr(10) || 'Dekning 100 %, dagsatsen er kr 1 ' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ',50 per dag' || chr(10) "
    "|| 'Månedsbeløp: 80 prosent' || chr(10) || 'Utbetalingsdato: ' || " + _DMY + " || chr(10) || 'Ansatt fra 3. mars 2019, årslønn kr 500 000' || chr(10) || 'Månedslønn: 41 667,-' AS tekst FROM {orders}"
)


@query("SELECT o_orderkey AS doc_id, CAST(10000 + o_custkey AS STRING) AS saksnummer, '2026/' || CAST(1000 + o_orderkey % 9000 AS STRING) AS journalnummer, CAST(70000 + o_orderkey % 9 AS STRING) AS vedtaksnummer, CAST(NULL AS STRING) AS dokumentnummer, 'AB-' || CAST(o_orderkey AS STRING) AS referanse FROM orders")
def l4_case_fields(spark, d):
    return derived(spark, d, _FILLED, deal=True).select("doc_id", *(c.alias(n) for n, c in L.case_fields(F.col("tekst")).items()))


@query("SELECT o_orderkey AS doc_id, CAST(1000.5 + o_orderkey % 1000 AS DOUBLE) AS dagsats, CAST(NULL AS DOUBLE) AS manedsbelop, CAST(NULL AS DOUBLE) AS utbetalt_belop, CAST(NULL AS DOUBLE) AS tilbakebetalingsbelop, CAST(o_orderdate AS DATE) AS utbetalingsdato FROM orders")
def l5_money_fields(spark, d):
    return derived(spark, d, _FILLED, deal=True).select("doc_id", *(c.alias(n) for n, c in L.money_fields(F.col("tekst"), YEAR).items()))


@query(
    "SELECT o_orderkey AS doc_id, 'Firma ' || CAST(o_custkey AS STRING) || ' AS' AS arbeidsgiver, 'Kokk' AS stilling, CAST(CASE WHEN o_orderkey % 130 BETWEEN 1 AND 100 THEN o_orderkey % 130 END AS INTEGER) AS stillingsprosent, DATE '2019-03-03' AS startdato, "
    "CAST(NULL AS DATE) AS sluttdato, CAST(500000 AS DOUBLE) AS arsinntekt, CAST(41667 AS DOUBLE) AS manedslonn FROM orders"
)
def l6_work_fields(spark, d):
    return derived(spark, d, _FILLED, deal=True).select("doc_id", *(c.alias(n) for n, c in L.work_fields(F.col("tekst"), YEAR).items()))


_REFERRED = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Saksnr. 21/' || CAST(1000 + o_orderkey % 9000 AS STRING) WHEN 1 THEN 'Skjema ETAT 04-01.03, sakstilvising: ' || CAST(50000 + o_custkey AS STRING) ELSE 'Skjema ETAT 04-01.03' END AS tekst FROM {orders}"


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN '21/' || CAST(1000 + o_orderkey % 9000 AS STRING) WHEN 1 THEN CAST(50000 + o_custkey AS STRING) ELSE 'ETAT 04-01.03' END AS saksnummer FROM orders")
def l7_case_numbers(spark, d):
    return derived(spark, d, _REFERRED).select("doc_id", L.case_number(F.col("tekst")).alias("saksnummer"))


_LAW = "SELECT o_orderkey AS doc_id, 'Etter §§ 8-' || CAST(o_orderkey % 30 + 1 AS STRING) || 'a og § 12, jf. § 8 - ' || CAST(o_orderkey % 30 + 1 AS STRING) || 'a, kapittel ' || CAST(o_orderkey % 20 + 1 AS STRING) || ' om dette.' AS tekst FROM {orders}"


@query("SELECT o_orderkey AS doc_id, '§ 8-' || CAST(o_orderkey % 30 + 1 AS STRING) || 'a,§ 12,kapittel ' || CAST(o_orderkey % 20 + 1 AS STRING) AS hjemler FROM orders")
def x5_statute_references(spark, d):
    return derived(spark, d, _LAW).select("doc_id", F.array_join(L.statute_references(F.col("tekst")), ",").alias("hjemler"))


_CODED = "SELECT o_orderkey AS doc_id, 'Vare ' || CAST(1000 + o_custkey AS STRING) || ' kode AB12CD' || CAST(o_orderkey % 10 AS STRING) || ', igjen ' || CAST(1000 + o_custkey AS STRING) || ' og 123' AS tekst FROM {orders}"


@query("SELECT o_orderkey AS doc_id, 1 AS nr, CAST(1000 + o_custkey AS STRING) AS kode FROM orders UNION ALL SELECT o_orderkey, 2, 'AB12CD' || CAST(o_orderkey % 10 AS STRING) FROM orders")
def x8_codes(spark, d):
    return L.codes(derived(spark, d, _CODED, deal=True)).select("doc_id", "nr", "kode")


@query(
    "WITH w AS (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS a, split_part(lower(p_type), ' ', 1) AS b FROM part), "
    "x AS (SELECT *, least(length(a), length(b)) AS n, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS delt FROM w) "
    "SELECT p_partkey, a = b OR (n >= 4 AND (starts_with(b, a) OR (delt >= 5 AND delt >= 0.7 * CASE WHEN starts_with(a, b) THEN length(a) ELSE n END))) AS samme FROM x"
)
def x13_same_word(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return p.select("p_partkey", C.same_word(F.split("a", " ")[0], F.split("b", " ")[0]).alias("samme"))
