"""Queries over what a service does around its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdossier.operators import evaluation, labelled
from sparkdossier.operators import redaction as R
from sparkdossier.operators import service as V
from sparkdossier.plans.queries import query
from sparkdossier.plans.scan_queries import _PRIVATE
from sparkdossier.sources.tables import bare, derived, table

_POINTERS = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'part.navn' WHEN 1 THEN 'kontakt' WHEN 2 THEN 'partner.navn' ELSE 'datoer.0.dato' END AS sti FROM {orders}"


@query(f"SELECT doc_id, sti FROM ({bare(_POINTERS)}) WHERE sti IN ('partner.navn', 'datoer.0.dato')")
def p3_without_sections(spark, d):
    return V.without_sections(derived(spark, d, _POINTERS), "sti", ("part", "kontakt"))


# Braces name tables in derived SQL, so these texts are written with others, which are then turned.
_BRACED = "replace(replace({}, '<', chr(123)), '>', chr(125))"
_RUNS = "SELECT o_orderkey AS doc_id, " + _BRACED.format("'<\"svar\":' || CAST(o_custkey AS STRING) || CASE o_orderkey % 2 WHEN 0 THEN ',\"tid_sekunder\":0.' || CAST(o_orderkey AS STRING) ELSE '' END || ',\"x\":<\"tid_sekunder\":1.5>>'") + " AS json FROM {orders}"


@query("SELECT o_orderkey AS doc_id, sha256('{\"svar\":' || CAST(o_custkey AS STRING) || ',\"x\":{}}') AS hash FROM orders")
def p4_stable_hashes(spark, d):
    return derived(spark, d, _RUNS).select("doc_id", V.stable_hash(F.col("json")).alias("hash"))


_TYPED = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'legeerklaring' WHEN 1 THEN 'egenerklaring' WHEN 2 THEN 'vedtak' END AS type FROM {orders}"


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 4 < 2")
def p8_generic_forms(spark, d):
    return derived(spark, d, _TYPED).where(F.col("type").isin(*V.GENERIC_FORMS)).select("doc_id")


_CALLS = "SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'gammel' ELSE 'k' || CAST(user_id % 40 AS STRING) END AS nokkel FROM {events}"
_KEYS = "SELECT 'k' || CAST(n_nationkey AS STRING) AS verdi, n_name AS navn FROM {nation} UNION ALL SELECT 'k' || CAST(n_nationkey AS STRING), 'Z' || n_name FROM {nation} UNION ALL SELECT 'gammel', 'A' FROM {region}"


@query(f"WITH c AS ({bare(_CALLS)}), k AS (SELECT verdi, min(navn) AS navn FROM ({bare(_KEYS)}) GROUP BY verdi) SELECT id, c.nokkel, CASE WHEN c.nokkel = 'gammel' THEN 'eldre' ELSE navn END AS klient FROM c LEFT JOIN k ON k.verdi = c.nokkel")
def p11_clients_of_keys(spark, d):
    return V.client_of_key(derived(spark, d, _CALLS), derived(spark, d, _KEYS), "gammel")


@query()
def a10_bootstrap_share(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 7 == 0).cast("int").alias("e"), F.lit(1).alias("c"))
    return evaluation.bootstrap_interval(rows, "e", "c", seed=20260814)


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_discount <= l_tax + 0.02 AND l_tax <= l_discount + 0.03 AS overlapper FROM lineitem")
def a11_overlaps(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), V.overlaps(c("l_discount"), c("l_discount") + 0.03, c("l_tax"), c("l_tax") + 0.02).alias("overlapper"))


_CELLS = "SELECT l_orderkey AS doc_id, l_suppkey % 2 AS tabell, l_linenumber AS rad, CASE WHEN l_partkey % 3 = 0 THEN 'Dager' ELSE 'Beløp' END AS kolonne, CASE WHEN l_linenumber = 1 THEN 'Sum' ELSE CAST(l_quantity AS STRING) END AS verdi, 'dager' AS spurt FROM {lineitem}"


@query(
    "WITH c AS (SELECT l_orderkey AS doc_id, l_suppkey % 2 AS tabell, l_linenumber AS rad, l_partkey % 3 = 0 AS hit FROM lineitem), s AS (SELECT doc_id, tabell, rad, max(CASE WHEN rad = 1 THEN 1 ELSE 0 END) AS sumrad FROM c GROUP BY ALL), "
    "h AS (SELECT DISTINCT c.doc_id, c.tabell, c.rad FROM c JOIN s USING (doc_id, tabell, rad) WHERE hit AND sumrad = 0), t AS (SELECT doc_id, tabell, count(*) AS rader FROM h GROUP BY ALL) "
    "SELECT doc_id, 'Dager' AS kolonne, max(rader) AS rader FROM t GROUP BY doc_id HAVING count(*) = 1"
)
def a23_table_rows(spark, d):
    return V.table_rows(derived(spark, d, _CELLS))


_FOLDERS = "SELECT event_id AS id, ts AS endret, event_id % 5000 AS byte FROM {events}"


@query(f"WITH f AS ({bare(_FOLDERS)}), n AS (SELECT CAST(max(ts) AS TIMESTAMP) - INTERVAL 30 DAY AS g FROM events) SELECT count(*) FILTER (WHERE endret < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY) AS slettet, count(*) FILTER (WHERE NOT endret < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY) AS beholdt, CAST(coalesce(sum(byte) FILTER (WHERE endret < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY), 0) AS BIGINT) AS frigjort_byte FROM f")
def a25_retention_totals(spark, d):
    return V.retention_totals(derived(spark, d, _FOLDERS), "2024-01-20 00:00:00", 10)


_ARCHIVE = "SELECT o_orderkey AS oppgave_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'dok' || CAST(o_custkey AS STRING) END AS kilde_dokument, o_orderkey % 3 AS annotasjoner FROM {orders}"


@query(f"SELECT nullif(kilde_dokument, '') AS kilde, count(*) AS antall FROM ({bare(_ARCHIVE)}) GROUP BY 1")
def a26_erasure_overview(spark, d):
    return V.erasure_overview(derived(spark, d, _ARCHIVE))


@query(f"SELECT oppgave_id FROM ({bare(_ARCHIVE)}) WHERE annotasjoner > 0 AND oppgave_id % 7 <> 0")
def s13_new_exports(spark, d):
    tasks = derived(spark, d, _ARCHIVE)
    return V.new_exports(tasks, tasks.where("oppgave_id % 7 = 0"), "oppgave_id").select("oppgave_id")


_SPANS = "SELECT l_orderkey AS doc_id, l_linenumber AS id, l_partkey % 100 AS start, l_partkey % 100 + 10 AS slutt FROM {lineitem}"
_AREAS = "SELECT l_orderkey AS doc_id, l_linenumber AS region, l_suppkey % 100 AS start, l_suppkey % 100 + 15 AS slutt FROM {lineitem}"


@query(f"SELECT s.doc_id, s.id, r.region FROM ({bare(_SPANS)}) s JOIN ({bare(_AREAS)}) r ON r.doc_id = s.doc_id AND r.start < s.slutt AND s.start < r.slutt")
def j11_regions_of_spans(spark, d):
    return V.regions_of_span(derived(spark, d, _SPANS), derived(spark, d, _AREAS))


@query("SELECT count(*) AS nye, max(event_id) AS neste FROM events WHERE event_id > 100")
def t1_event_cursor(spark, d):
    new, after = V.poll(table(spark, d, "events"), 100)
    return new.agg(F.count(F.lit(1)).alias("nye"), after)


@query("SELECT c_custkey AS id, greatest(x - greatest(x - greatest(y, 1), 1), 1) AS interaktiv, greatest(x - greatest(y, 1), 1) AS batch FROM (SELECT c_custkey, c_custkey % 9 + 1 AS x, c_custkey % 5 AS y FROM customer)")
def t9_admission(spark, d):
    c = table(spark, d, "customer")
    live, batch = V.admission(c["c_custkey"] % 9 + 1, c["c_custkey"] % 5)
    return c.select(c["c_custkey"].alias("id"), live.alias("interaktiv"), batch.alias("batch"))


@query("SELECT o_custkey AS id, list_reduce(list_prepend(list_value(''), list_transform(list_value(CAST(o_custkey % 3 AS VARCHAR), 'b', CAST(o_custkey % 3 AS VARCHAR), 'a', 'b'), lambda x: list_value(x))), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END)[2:] AS unike FROM (SELECT DISTINCT o_custkey FROM orders)")
def w7_first_occurrences(spark, d):
    k = (F.col("id") % 3).cast("string")
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return ids.select("id", F.array_distinct(F.array(k, F.lit("b"), k, F.lit("a"), F.lit("b"))).alias("unike"))


_SCORED = "SELECT o_custkey AS sporsmal, 'dok' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS navn, CAST(CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_orderkey % 5 END AS DOUBLE) AS poeng, o_custkey % 4 <> 0 AND o_orderkey % 6 = 0 AS type_nevnt FROM {orders}"


@query(
    f"WITH s AS (SELECT sporsmal, navn, poeng + CASE WHEN type_nevnt THEN 10 ELSE 0 END AS sum FROM ({bare(_SCORED)})), m AS (SELECT *, max(CASE WHEN sum > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sporsmal) AS noen FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY sporsmal ORDER BY CASE WHEN noen = 1 THEN -sum END, navn) AS rang FROM m) SELECT sporsmal, navn, rang, round(sum, 2) AS poeng FROM r WHERE rang <= 3 AND (noen = 0 OR sum > 0)"
)
def w11_best_documents(spark, d):
    return V.best_documents(derived(spark, d, _SCORED))


_ASKED = "SELECT conv_id * 100 + turn AS id, conv_id AS doc_id, 'Hva står på side ' || CAST(turn + 1 AS STRING) || '?' AS sporsmal FROM {conversations}"
_PAGED = "SELECT conv_id AS doc_id, turn AS side, text AS tekst FROM {conversations}"


@query(f"WITH q AS (SELECT conv_id * 100 + turn AS id, conv_id AS doc_id, turn + 1 AS side FROM conversations), p AS ({bare(_PAGED)}), l AS (SELECT doc_id, max(side) AS siste FROM p GROUP BY doc_id) SELECT q.id, CAST(q.side AS INTEGER) AS side, p.tekst, CASE WHEN q.side > siste THEN 'utenfor' WHEN trim(coalesce(p.tekst, '')) = '' THEN 'tom' ELSE 'lest' END AS utfall FROM q LEFT JOIN l USING (doc_id) LEFT JOIN p ON p.doc_id = q.doc_id AND p.side = q.side")
def z2_page_questions(spark, d):
    return V.page_answers(derived(spark, d, _ASKED), derived(spark, d, _PAGED))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'kåre' || CAST(o_orderkey AS STRING) || '@post.no' ELSE '223344' || CAST(10 + o_orderkey % 90 AS STRING) END AS svar FROM orders")
def z3_identifier_questions(spark, d):
    docs = derived(spark, d, _PRIVATE, deal=True)
    asked = docs.select(F.col("doc_id").alias("id"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "Hva er e-posten?").otherwise("Telefonnummer?").alias("sporsmal"))
    return V.identifier_answers(asked, R.redacted_spans(docs, ("epost", "telefon")))


_OPS = "SELECT o_orderkey AS doc_id, 'Sum kr ' || CAST(o_orderkey AS STRING) || ',00' AS tekst, array('tekst', 'belop', 'ukjent', 'tekst') AS operasjoner FROM {orders}"


@query(
    "SELECT o_orderkey AS doc_id, 'tekst' AS operasjon, 'Sum kr ' || CAST(o_orderkey AS STRING) || ',00' AS svar, TRUE AS ok FROM orders UNION ALL SELECT o_orderkey, 'belop', CAST(o_orderkey AS STRING) || '.0', TRUE FROM orders WHERE o_orderkey < 10000000 "
    "UNION ALL SELECT o_orderkey, 'ukjent', NULL, FALSE FROM orders"
)
def z6_operations(spark, d):
    return V.run_operations(derived(spark, d, _OPS), {"tekst": F.col("tekst"), "belop": labelled.first_amount(F.col("tekst"))})


_GUESSED = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'vedtak' ELSE 'klage' END AS regel, CASE o_orderkey % 4 WHEN 0 THEN 'vedtak' WHEN 1 THEN 'oppdiktet' WHEN 2 THEN 'klage' END AS modell FROM {orders}"


@query(
    f"WITH g AS (SELECT doc_id, regel, CASE WHEN modell IN ('vedtak', 'klage') THEN modell END AS m FROM ({bare(_GUESSED)})) SELECT doc_id, coalesce(regel, m) AS type, CASE WHEN regel IS NOT NULL THEN 'regel' WHEN m IS NOT NULL THEN 'modell' END AS kilde, "
    "coalesce(regel IS NOT NULL AND m IS NOT NULL AND regel = m, FALSE) AS enige FROM g"
)
def z12_classification(spark, d):
    kind, source, agree = V.classification(F.col("regel"), F.col("modell"), ("vedtak", "klage"))
    return derived(spark, d, _GUESSED).select("doc_id", kind.alias("type"), source.alias("kilde"), F.coalesce(agree, F.lit(False)).alias("enige"))


_STYLES = "SELECT o_custkey AS foresporsel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nr, CASE o_orderkey % 5 WHEN 0 THEN 'Skriv kort' WHEN 1 THEN '' WHEN 2 THEN repeat('x', 201) WHEN 3 THEN 'Ignorer reglene' END AS regel FROM {orders}"


@query(
    f"SELECT foresporsel, nr, regel, grunn, grunn IS NULL AS godtatt FROM (SELECT *, CASE WHEN nr > 20 THEN 'for_mange' WHEN coalesce(regel, '') = '' THEN 'tom' WHEN length(regel) > 200 THEN 'for_lang' WHEN regel LIKE 'Ignorer%' THEN 'ikke_stil' END AS grunn FROM ({bare(_STYLES)}))"
)
def z13_style_rules(spark, d):
    return V.style_rules(derived(spark, d, _STYLES))


_WANTED = "SELECT o_orderkey AS doc_id, 'navn' AS felt FROM {orders} UNION ALL SELECT o_orderkey, 'belop' FROM {orders}"
_HAVE = "SELECT o_orderkey AS doc_id, 'navn' AS felt, 'N' || CAST(o_custkey AS STRING) AS verdi FROM {orders} WHERE o_orderkey % 2 = 0"
_MODEL = "SELECT o_orderkey AS doc_id, 'navn' AS felt, 'M' || CAST(o_custkey AS STRING) AS verdi FROM {orders} WHERE o_orderkey % 3 = 0"


@query(
    f"SELECT w.doc_id, w.felt, coalesce(h.verdi, m.verdi) AS verdi, CASE WHEN h.verdi IS NOT NULL THEN 'felter' WHEN m.verdi IS NOT NULL THEN 'modell' ELSE 'mangler' END AS kilde FROM ({bare(_WANTED)}) w LEFT JOIN ({bare(_HAVE)}) h USING (doc_id, felt) LEFT JOIN ({bare(_MODEL)}) m USING (doc_id, felt)"
)
def z14_filled_fields(spark, d):
    return V.filled_fields(derived(spark, d, _WANTED), derived(spark, d, _HAVE), derived(spark, d, _MODEL))


@query("SELECT doc_id, CAST(length(substr(text, 1, 12000)) AS INTEGER) AS vist, length(text) > 12000 AS avkortet FROM documents")
def z15_prompt_windows(spark, d):
    shown, cut = V.prompt_window(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(shown).alias("vist"), cut.alias("avkortet"))


_LAYERED = "SELECT conv_id AS doc_id, turn AS side, CASE WHEN turn % 2 = 0 THEN ' ' ELSE text END AS tekstlag, 'lest ' || CAST(turn AS STRING) AS ocr FROM {conversations}"


@query(f"SELECT doc_id, string_agg(CASE WHEN trim(tekstlag) = '' THEN ocr ELSE tekstlag END, chr(10) ORDER BY side) AS tekst, count(*) FILTER (WHERE trim(tekstlag) = '') AS ocr_sider FROM ({bare(_LAYERED)}) GROUP BY doc_id")
def z9_merged_pages(spark, d):
    return V.merged_pages(derived(spark, d, _LAYERED))


@query(f"SELECT doc_id, coalesce(regel, CASE WHEN length(modell) = 6 THEN modell END) AS verdi FROM ({bare(_GUESSED)})")
def m2_merged_entities(spark, d):
    return derived(spark, d, _GUESSED).select("doc_id", V.merged_entities(F.col("regel"), F.col("modell"), F.length("modell") == 6).alias("verdi"))


_BARCODES = "SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 2 = 0 THEN 'QRCODE' ELSE 'EAN13' END AS type, l_linenumber AS side, CAST(l_suppkey AS STRING) AS verdi, l_orderkey % 5 <> 0 AS lest FROM {lineitem}"


@query(
    f"WITH b AS ({bare(_BARCODES)}) SELECT doc_id, CASE WHEN bool_or(lest) THEN count(*) FILTER (WHERE type = 'QRCODE') END AS qr, CASE WHEN bool_or(lest) THEN count(*) FILTER (WHERE type <> 'QRCODE') END AS strekkoder, "
    "CASE WHEN bool_or(lest) THEN min(side) FILTER (WHERE type = 'QRCODE') END AS qr_side, CASE WHEN bool_or(lest) THEN min(side) FILTER (WHERE type <> 'QRCODE') END AS strekkode_side FROM b GROUP BY doc_id"
)
def x20_codes_by_page(spark, d):
    return V.codes_by_page(derived(spark, d, _BARCODES))


_LAWS = "SELECT 'lov' || CAST(r_regionkey AS STRING) AS lov, '# Lov' || chr(10) || '## Kapittel ' || CAST(r_regionkey + 1 AS STRING) || '. Dagpenger ved arbeidsløyse.' || chr(10) || 'Tekst om kapittel 9' || chr(10) || 'Kapittel 8 A. Sykepengene' || chr(10) || 'Kapittel 8 Alderspensjon' AS tekst FROM {region}"
_CHAPTERS = "SELECT 'lov' || CAST(r_regionkey AS STRING) AS lov, CAST(r_regionkey + 1 AS STRING) AS kapittel, 'Dagpenger ved arbeidsløyse' AS tittel FROM region UNION ALL SELECT 'lov' || CAST(r_regionkey AS STRING), '8 A', 'Sykepengene' FROM region UNION ALL SELECT 'lov' || CAST(r_regionkey AS STRING), '8', 'Alderspensjon' FROM region"


@query(_CHAPTERS)
def s5_chapters(spark, d):
    return V.chapters(derived(spark, d, _LAWS))


_NAMED = "SELECT CASE n_nationkey % 4 WHEN 0 THEN 'dagpenger' WHEN 1 THEN 'Arbeidsløyse' WHEN 2 THEN 'alderstrygd' ELSE 'uføretrygd' END AS ytelse FROM {nation}"


@query(
    f"WITH c AS ({_CHAPTERS}), y AS (SELECT DISTINCT ytelse FROM ({bare(_NAMED)})) SELECT ytelse, lov, kapittel, tittel FROM y JOIN c ON (ytelse IN ('dagpenger', 'Arbeidsløyse') AND tittel LIKE 'Dagpenger%') OR (ytelse = 'alderstrygd' AND tittel = 'Alderspensjon')"
)
def j6_benefit_chapters(spark, d):
    return V.benefit_chapters(derived(spark, d, _NAMED), V.chapters(derived(spark, d, _LAWS)))


_REFS = "SELECT o_orderkey AS id, CAST(o_orderkey % 9 + 1 AS STRING) AS kapittel, CASE WHEN o_orderkey % 7 = 0 THEN 'lov9' END AS lov_gitt, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS dato FROM {orders}"
_FORCE = "SELECT 'lov' || CAST(r_regionkey AS STRING) AS lov, CAST(DATE '1992-01-01' AS DATE) + CAST(r_regionkey AS INT) * 365 AS fra, CASE WHEN r_regionkey < 3 THEN DATE '1992-01-01' + (CAST(r_regionkey AS INT) + 1) * 365 END AS til FROM {region}"


@query(
    f"WITH r AS ({bare(_REFS)}), v AS ({bare(_FORCE)}), c AS ({_CHAPTERS}), h AS (SELECT kapittel, count(DISTINCT lov) AS antall, min(lov) AS eneste FROM c GROUP BY kapittel), "
    "f AS (SELECT r.id, min(v.lov) AS lov_dato FROM r JOIN v ON v.fra <= r.dato AND (v.til IS NULL OR r.dato < v.til) WHERE r.lov_gitt IS NULL GROUP BY r.id) "
    "SELECT r.id, coalesce(lov_gitt, lov_dato, CASE WHEN antall = 1 THEN eneste END) AS lov, coalesce(lov_gitt, lov_dato) IS NULL AND coalesce(antall, 0) > 1 AS flertydig, CAST(coalesce(antall, 0) AS BIGINT) AS antall FROM r LEFT JOIN f USING (id) LEFT JOIN h USING (kapittel)"
)
def j5_law_of_reference(spark, d):
    return V.resolve(derived(spark, d, _REFS), V.chapters(derived(spark, d, _LAWS)), derived(spark, d, _FORCE))


_REGISTRY = "SELECT r_regionkey AS id, '# laws' || chr(10) || '[[lov:a' || CAST(r_regionkey AS STRING) || ']]' || chr(10) || 'tittel = Lov om ' || r_name || chr(10) || 'gjelder_fra = 1997-05-01' || chr(10) || chr(10) || '[[lov:b]]' || chr(10) || 'fil=b=c.md' AS tekst FROM {region}"


@query("SELECT r_regionkey AS nr, 'a' || CAST(r_regionkey AS STRING) AS id, 'tittel' AS felt, 'Lov om ' || r_name AS verdi FROM region UNION ALL SELECT r_regionkey, 'a' || CAST(r_regionkey AS STRING), 'gjelder_fra', '1997-05-01' FROM region UNION ALL SELECT r_regionkey, 'b', 'fil', 'b=c.md' FROM region")
def s6_registry(spark, d):
    return derived(spark, d, _REGISTRY).select(F.col("id").alias("nr"), F.explode(V.registry(F.col("tekst"))).alias("x")).select("nr", "x.*")


_PROMPTS = "SELECT n_nationkey AS id, 'kommentar' || chr(10) || '[[svar]]' || chr(10) || 'Svar om $land' || chr(10) || n_name || chr(10) || '[[/svar]]' || chr(10) || '[[feil]]' || chr(10) || 'uten slutt' AS tekst FROM {nation}"


@query("SELECT n_nationkey AS id, 'svar' AS navn, 'Svar om $land' || chr(10) || n_name AS tekst FROM nation")
def s11_prompt_blocks(spark, d):
    return derived(spark, d, _PROMPTS).select("id", F.explode(V.prompt_blocks(F.col("tekst"))).alias("x")).select("id", "x.*")


@query("SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) > 0 AS BOOLEAN) AS har_tekst FROM pages WHERE html IS NOT NULL AND NOT regexp_matches(html, '(?i)<(script|style)|<!--')")
def s7_page_texts(spark, d):
    """Whether a page has a text; the text itself is tested on a fixture."""
    p = table(spark, d, "pages").where("html is not null").where(~F.col("html").rlike("(?i)<(script|style)|<!--"))
    return p.select("page_id", (F.length(V.plain_text(F.col("html"))) > 0).alias("har_tekst"))


_TEMPLATES = (
    "SELECT o_orderkey AS doc_id, " + _BRACED.format("'<\"a\": \"<belop>\", \"b\": \"Sak <sak>: <belop> kr, <borte>\", \"c\": [\"<sak>\", 1]>'") + " AS mal, "
    + _BRACED.format("'<\"belop\": ' || CAST(o_custkey AS STRING) || ', \"sak\": \"S' || CAST(o_orderkey AS STRING) || '\">'") + " AS felter FROM {orders}"
)


@query(
    "SELECT o_orderkey AS doc_id, '{\"ukjente\": [\"borte\"], \"utfylt\": {\"a\": ' || CAST(o_custkey AS STRING) || ', \"b\": \"Sak S' || CAST(o_orderkey AS STRING) || ': ' || CAST(o_custkey AS STRING) || ' kr, {borte}\", \"c\": [\"S' || CAST(o_orderkey AS STRING) || '\", 1]}}' AS json, 'belop,borte,sak' AS felt FROM orders"
)
def m4_merged_templates(spark, d):
    t = derived(spark, d, _TEMPLATES)
    return t.select("doc_id", V.merge_template(F.col("mal"), F.col("felter")).alias("json"), F.array_join(V.referenced_fields(F.col("mal")), ",").alias("felt"))


_PLACED = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Hilsen ETAT Grünerløkka' WHEN 1 THEN 'ETAT Bergen vest i dag' ELSE 'ETAT 04-01.03' END AS tekst FROM {orders}"


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'ETAT Grünerløkka' WHEN 1 THEN 'ETAT Bergen vest' END AS kontor FROM orders")
def x2_offices(spark, d):
    return derived(spark, d, _PLACED).select("doc_id", V.office(F.col("tekst"), "ETAT").alias("kontor"))


_WEIGHTS = "SELECT p_partkey AS fil, p_size AS byte, 'h' || CAST(p_partkey % 50 AS STRING) AS sha FROM {part}"


@query("SELECT p_partkey AS fil, CASE WHEN p_partkey % 9 = 0 THEN 'mangler' WHEN p_partkey % 8 = 0 THEN 'ukjent' WHEN p_partkey % 7 = 0 THEN 'endret' ELSE 'ok' END AS utfall FROM part")
def v9_fingerprints(spark, d):
    w = derived(spark, d, _WEIGHTS)
    found = w.where("fil % 9 <> 0").withColumn("byte", F.when((F.col("fil") % 7 == 0) & (F.col("fil") % 8 != 0), F.col("byte") + 1).otherwise(F.col("byte")))
    return V.fingerprints(w.where("fil % 8 <> 0 or fil % 9 = 0"), found)
