"""What a document service does around its texts: selection, routing, keys, retention, exports, laws, templates and cursors."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkdossier.functions import text as T
from sparkdossier.functions import trees

# Forms that say little of a document's type; words that end a benefit's name; what a case's folder is kept for.
GENERIC_FORMS = ("legeerklaring", "egenerklaring")
BENEFIT_ENDS = r"s?(penger|trygd|pensjon|stonad|stotte|erstatning)$"
KEEP_DAYS = 30
MOST_RULES, RULE_CHARS = 20, 200
WINDOW_CHARS = 12_000


def without_sections(pointers: DataFrame, path: str, omitted: Sequence[str]) -> DataFrame:
    """Rows whose path lies in none of the omitted sections."""
    gone = F.lit(False)
    for s in omitted:
        gone = gone | (F.col(path) == s) | F.startswith(F.col(path), F.lit(s + "."))
    return pointers.where(~gone)


def stable_hash(json: Column, volatile: str = "tid_sekunder") -> Column:
    """Hash of a JSON text's content, whatever the order of its names, without the member ``volatile`` at any depth.

    Null where the text is null or no JSON.
    """
    return F.sha2(trees.canonical(json, (volatile,)), 256)


def client_of_key(calls: DataFrame, keys: DataFrame, legacy: str = "") -> DataFrame:
    """Calls (``nokkel``) with the client that holds the key: ``eldre`` for the legacy key, else the first by name, null for none."""
    named = keys.where("verdi <> ''").groupBy("verdi").agg(F.min("navn").alias("navn"))
    found = calls.join(named, calls["nokkel"] == named["verdi"], "left").drop("verdi")
    return found.withColumn("klient", F.when((F.lit(legacy) != "") & (F.col("nokkel") == legacy), "eldre").otherwise(F.col("navn"))).drop("navn")


def overlaps(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Whether two closed intervals share a point."""
    return (a_low <= b_high) & (b_low <= a_high)


def table_rows(cells: DataFrame) -> DataFrame:
    """``doc_id, kolonne, rader`` of the only table of a document that has the asked column: its rows but for sums.

    ``cells`` holds ``doc_id, tabell, rad, kolonne, verdi, spurt``. Documents with no such table, or several, give no row.
    """
    sums = cells.groupBy("doc_id", "tabell", "rad").agg(F.max(F.lower(F.trim("verdi")).isin("sum", "total", "totalt")).alias("sumrad"))
    hit = cells.where("verdi <> '' and lower(kolonne) = lower(spurt)").join(sums, ["doc_id", "tabell", "rad"]).where("not sumrad")
    tables = hit.groupBy("doc_id", "tabell").agg(F.max("kolonne").alias("kolonne"), F.count_distinct("rad").alias("rader"))
    return tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kolonne").alias("kolonne"), F.max("rader").alias("rader")).where("n = 1").drop("n")


def retention_totals(files: DataFrame, now: str, days: int = KEEP_DAYS) -> DataFrame:
    """``slettet, beholdt, frigjort_byte`` over files with a time ``endret`` and a size ``byte``."""
    old = F.col("endret") < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return files.agg(F.count_if(old).alias("slettet"), F.count_if(~old).alias("beholdt"), F.coalesce(F.sum(F.when(old, F.col("byte"))), F.lit(0)).cast("long").alias("frigjort_byte"))


def erasure_overview(rows: DataFrame, key: str = "kilde_dokument") -> DataFrame:
    """``kilde, antall``: rows by source; under a null those without a key."""
    return rows.groupBy(F.when(F.col(key) != "", F.col(key)).alias("kilde")).agg(F.count(F.lit(1)).alias("antall"))


def erase(rows: DataFrame, gone: DataFrame, key: str = "kilde_dokument") -> DataFrame:
    """Rows that belong to none of the sources to be erased; rows without a key stay."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def regions_of_span(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions whose part of the text overlaps a span: ``doc_id, id, region``."""
    r = regions.select(F.col("doc_id").alias("rd"), "region", F.col("start").alias("rs"), F.col("slutt").alias("re"))
    return spans.join(r, (F.col("doc_id") == F.col("rd")) & (F.col("rs") < F.col("slutt")) & (F.col("start") < F.col("re"))).select("doc_id", "id", "region")


def new_exports(tasks: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    """Annotated tasks that no earlier export holds."""
    return tasks.where("annotasjoner > 0").join(exported.select(key).distinct(), key, "left_anti")


def poll(events: DataFrame, cursor: int, order: str = "event_id") -> tuple[DataFrame, Column]:
    """Events behind a cursor, and the expression over them of the next cursor."""
    return events.where(F.col(order) > cursor), F.coalesce(F.max(order), F.lit(cursor)).alias("neste")


def admission(slots: Column, reserve: Column) -> tuple[Column, Column]:
    """Slots for interactive and for batch work: the reserve is at least one, and batch work always has one."""
    kept = F.greatest(reserve, F.lit(1))
    batch = F.greatest(slots - kept, F.lit(1))
    return F.greatest(slots - batch, F.lit(1)), batch


def best_documents(scored: DataFrame, most: int = 3, bonus: float = 10.0) -> DataFrame:
    """Up to ``most`` documents per question (``sporsmal, navn, poeng, type_nevnt``) by score and name; if none scores, the first by name."""
    s = scored.withColumn("sum", F.col("poeng") + F.when(F.col("type_nevnt"), bonus).otherwise(0.0))
    q = Window.partitionBy("sporsmal")
    s = s.withColumn("noen", F.max(F.col("sum") > 0).over(q))
    ranked = s.withColumn("rang", F.row_number().over(q.orderBy(F.when(F.col("noen"), -F.col("sum")), "navn")))
    return ranked.where((F.col("rang") <= most) & (~F.col("noen") | (F.col("sum") > 0))).select("sporsmal", "navn", "rang", F.round("sum", 2).alias("poeng"))


def asked_page(question: Column) -> Column:
    """The page that a question names, or null."""
    n = F.regexp_extract(question, r"(?i)\bside\s+(\d{1,5})\b", 1)
    return F.when(n != "", n.cast("int"))


def page_answers(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, side, tekst, utfall``: a question that names a page reads that page alone; beyond the last one code answers."""
    last = pages.groupBy("doc_id").agg(F.max("side").alias("siste"))
    q = questions.withColumn("side", asked_page(F.col("sporsmal"))).where("side is not null").join(last, "doc_id", "left")
    found = q.join(pages.select("doc_id", "side", "tekst"), ["doc_id", "side"], "left")
    kind = F.when(F.col("siste").isNull() | (F.col("side") > F.col("siste")) | (F.col("side") < 1), "utenfor").when(F.trim(F.coalesce("tekst", F.lit(""))) == "", "tom").otherwise("lest")
    return found.select("id", "side", "tekst", kind.alias("utfall"))


def asked_kind(question: Column) -> Column:
    """The kind of identifier a question asks for, answered by extraction; null for any other question."""
    low = F.lower(question)
    out = F.lit(None).cast("string")
    for pattern, kind in ((r"e-?post", "epost"), (r"telefon|\btlf", "telefon"), (r"\bkid\b", "kid"), (r"org(?:anisasjons)?\.?\s?n(?:umme)?r", "organisasjonsnummer"), (r"konto", "kontonummer"), (r"f[øo]dselsnummer|\bfnr", "fodselsnummer")):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def identifier_answers(questions: DataFrame, found: DataFrame) -> DataFrame:
    """``id, svar``: all identifiers of the asked kind in the document, in order of their places; null where there is none.

    Both tables may be large, whatever Spark takes texts made by expressions to weigh, so their join merges.
    """
    q = questions.withColumn("type", asked_kind(F.col("sporsmal"))).where("type is not null")
    placed = F.array_sort(F.collect_list(F.struct("start", "verdi")))
    hits = found.groupBy("doc_id", "type").agg(F.array_distinct(placed["verdi"]).alias("v"))
    return q.join(hits.hint("merge"), ["doc_id", "type"], "left").select("id", F.array_join("v", ",").alias("svar"))


def run_operations(docs: DataFrame, operations: dict[str, Column]) -> DataFrame:
    """``doc_id, operasjon, svar, ok``: each asked operation of a document (``operasjoner``); an unknown one fails alone."""
    asked = docs.withColumn("operasjon", F.explode(F.array_distinct("operasjoner")))
    answer = F.lit(None).cast("string")
    for name, value in operations.items():
        answer = F.when(F.col("operasjon") == name, value.cast("string")).otherwise(answer)
    return asked.select("doc_id", "operasjon", answer.alias("svar"), F.col("operasjon").isin(*operations).alias("ok"))


def classification(rule: Column, model: Column, codes: Sequence[str]) -> tuple[Column, Column, Column]:
    """Type, source and whether both agree: the rule wins, the model may only name a listed code."""
    known = F.when(model.isin(*codes), model)
    return F.coalesce(rule, known), F.when(rule.isNotNull(), "regel").when(known.isNotNull(), "modell"), rule.isNotNull() & known.isNotNull() & (rule == known)


def style_rules(rules: DataFrame) -> DataFrame:
    """``foresporsel, nr, regel, godtatt, grunn``: the first rules of a request, none empty, too long, or that asks for other facts."""
    trimmed = F.trim("regel")
    reason = (
        F.when(F.col("nr") > MOST_RULES, "for_mange").when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, "tom").when(F.length(trimmed) > RULE_CHARS, "for_lang")
        .when(F.lower(trimmed).rlike(r"ignorer|se bort fra|finn p[åa]|dikt|systemprompt"), "ikke_stil")
    )
    return rules.withColumn("grunn", reason).withColumn("godtatt", F.col("grunn").isNull())


def filled_fields(asked: DataFrame, found: DataFrame, model: DataFrame, engine: str = "auto") -> DataFrame:
    """``doc_id, felt, verdi, kilde``: each field of a form from extraction, else from the model's checked answers, by engine."""
    j = asked.join(found.withColumnRenamed("verdi", "fra_felter"), ["doc_id", "felt"], "left").join(model.withColumnRenamed("verdi", "fra_modell"), ["doc_id", "felt"], "left")
    fields = F.col("fra_felter") if engine in ("auto", "felter") else F.lit(None).cast("string")
    guess = F.col("fra_modell") if engine in ("auto", "modell") else F.lit(None).cast("string")
    source = F.when(fields.isNotNull(), "felter").when(guess.isNotNull(), "modell").otherwise("mangler")
    return j.select("doc_id", "felt", F.coalesce(fields, guess).alias("verdi"), source.alias("kilde"))


def prompt_window(text: Column, most: int = WINDOW_CHARS) -> tuple[Column, Column]:
    """What of a text a model is shown, and whether the fields of the whole text must be added to it."""
    return F.substring(text, 1, most), F.length(text) > most


def merged_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, tekst, ocr_sider``: pages in order, read from the text layer or, where that is blank, by OCR."""
    blank = F.trim(F.coalesce("tekstlag", F.lit(""))) == ""
    page = F.struct("side", F.when(blank, F.coalesce("ocr", F.lit(""))).otherwise(F.col("tekstlag")).alias("t"))
    g = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("p"), F.count_if(blank).alias("ocr_sider"))
    return g.select("doc_id", F.array_join(F.col("p.t"), "\n").alias("tekst"), "ocr_sider")


def merged_entities(found: Column, model: Column, valid: Column) -> Column:
    """The extracted value, else the model's if it passes its check."""
    return F.coalesce(found, F.when(valid, model))


def codes_by_page(codes: DataFrame) -> DataFrame:
    """``doc_id, qr, strekkoder, qr_side, strekkode_side``; all null for a document whose codes were not read (``lest`` false)."""
    qr = F.lower("type").contains("qr")
    read = F.max("lest")
    pick = lambda c: F.when(read, c)
    return codes.groupBy("doc_id").agg(
        pick(F.count_if(qr & F.col("verdi").isNotNull())).alias("qr"), pick(F.count_if(~qr & F.col("verdi").isNotNull())).alias("strekkoder"),
        pick(F.min(F.when(qr, F.col("side")))).alias("qr_side"), pick(F.min(F.when(~qr, F.col("side")))).alias("strekkode_side"),
    )


def registry(text: Column) -> Column:
    """Entries ``id, felt, verdi`` of ``[[lov:id]]`` blocks with lines ``key = value``."""
    blocks = F.filter(F.split(text, r"\[\[lov:", -1), lambda b: b.contains("]]"))

    def lines(b: Column) -> Column:
        held = F.filter(F.split(F.substring_index(F.regexp_replace(b, r"^[^\]]*\]\]", ""), "[[", 1), "\n", -1), lambda x: x.contains("="))
        return F.transform(held, lambda x: F.struct(F.substring_index(b, "]]", 1).alias("id"), F.trim(F.substring_index(x, "=", 1)).alias("felt"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("verdi")))

    return F.flatten(F.transform(blocks, lines))


def chapters(laws: DataFrame) -> DataFrame:
    """``lov, kapittel, tittel`` of ``Kapittel n`` headings; a letter belongs to the number unless a word begins with it."""
    line = F.explode(F.split("tekst", "\n", -1)).alias("linje")
    heading = r"^#{0,6}\s*Kapittel\s+(\d+(?:\s?[A-Z](?![A-Za-zÆØÅæøå]))?)\s*[.:–-]?\s*(.*)$"
    rows = laws.select("lov", line).where(F.col("linje").rlike(heading))
    title = F.regexp_replace(F.trim(F.regexp_extract("linje", heading, 2)), r"\.$", "")
    return rows.select("lov", F.regexp_replace(F.regexp_extract("linje", heading, 1), r"(\d)([A-Z])", "$1 $2").alias("kapittel"), title.alias("tittel"))


def benefit_chapters(benefits: DataFrame, titles: DataFrame) -> DataFrame:
    """Chapters whose folded title holds a benefit's folded name; where none does, its stem of five letters or more.

    The chapters of all laws in force are a small table and stand in the plan once for each name.
    """
    b = benefits.select("ytelse", T.fold(F.trim("ytelse")).alias("navn")).where("navn <> ''").distinct()
    b = b.withColumn("stamme", F.regexp_replace("navn", BENEFIT_ENDS, ""))
    t = titles.select("lov", "kapittel", "tittel", T.fold(F.col("tittel")).alias("lav"))
    whole = b.join(t, F.contains("lav", "navn"))
    left = b.join(whole.select("ytelse").distinct(), "ytelse", "left_anti").where("length(stamme) >= 5 and stamme <> navn")
    return whole.unionByName(left.join(t, F.contains("lav", "stamme"))).select("ytelse", "lov", "kapittel", "tittel")


def resolve(refs: DataFrame, chapters_: DataFrame, valid: DataFrame) -> DataFrame:
    """``id, lov, flertydig, antall``: the law of a reference: that given, else that in force on the document's date, else the only one that has it.

    ``refs`` holds ``id, kapittel, lov_gitt, dato``; ``valid`` laws with ``fra, til`` (open where null), the first id of several.
    """
    v = valid.select(F.col("lov").alias("lov_dato"), "fra", "til")
    in_force = refs.where("lov_gitt is null and dato is not null").join(v, (F.col("fra") <= F.col("dato")) & (F.col("til").isNull() | (F.col("dato") < F.col("til")))).groupBy("id").agg(F.min("lov_dato").alias("lov_dato"))
    holds = chapters_.groupBy("kapittel").agg(F.count_distinct("lov").alias("antall"), F.min("lov").alias("eneste"))
    j = refs.join(in_force, "id", "left").join(holds, "kapittel", "left")
    chosen = F.coalesce("lov_gitt", "lov_dato")
    n = F.coalesce("antall", F.lit(0))
    return j.select("id", F.coalesce(chosen, F.when(n == 1, F.col("eneste"))).alias("lov"), (chosen.isNull() & (n > 1)).alias("flertydig"), n.cast("long").alias("antall"))


def prompt_blocks(text: Column) -> Column:
    """``navn, tekst`` of ``[[name]] … [[/name]]`` blocks, each mark on a line of its own."""
    pattern = r"(?ms)^\[\[(\w+)\]\][ \t]*\n(.*?)\n?^\[\[/\1\]\][ \t]*$"
    names, bodies = (F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2))
    return F.arrays_zip(names.alias("navn"), bodies.alias("tekst"))


def _merge(template, fields: dict) -> tuple[object, list[str]]:
    import re

    missing: list[str] = []

    def fill(x):
        if isinstance(x, dict):
            return {k: fill(v) for k, v in x.items()}
        if isinstance(x, list):
            return [fill(v) for v in x]
        if not isinstance(x, str):
            return x
        names = re.findall(r"\{(\w+)\}", x)
        missing.extend(n for n in names if n not in fields)
        if len(names) == 1 and x.strip() == "{" + names[0] + "}":
            return fields.get(names[0], x)  # the whole value: its type stays
        return re.sub(r"\{(\w+)\}", lambda m: m[0] if m[1] not in fields else "" if fields[m[1]] is None else str(fields[m[1]]), x)

    return fill(template), sorted(set(missing))


def _merge_all(template: pd.Series, fields: pd.Series) -> pd.Series:
    import json

    out = []
    for t, f in zip(template, fields, strict=True):
        try:
            value, missing = _merge(json.loads(t), json.loads(f))
            out.append(json.dumps({"utfylt": value, "ukjente": missing}, ensure_ascii=False, sort_keys=True))
        except (TypeError, ValueError):
            out.append(None)  # no JSON on either side
    return pd.Series(out, dtype=object)


def merge_template(template: Column, fields: Column) -> Column:
    """JSON ``utfylt, ukjente``: a template whose ``{field}`` is all of a value takes the field with its type, within one as text."""
    return F.pandas_udf(_merge_all, StringType())(template, fields)


def referenced_fields(template: Column) -> Column:
    """Names of the fields that a template's text asks for, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), 1)))


def office(text: Column, agency: str) -> Column:
    """The agency's name with the place behind it; null without one, and for the number of a form."""
    found = F.regexp_extract(text, rf"\b{agency}\s+([A-ZÆØÅ][\p{{L}}\d_-]+(?:\s+[a-zæøå][\p{{L}}\d_-]{{2,}})?)", 1)
    return F.when(found != "", F.concat(F.lit(agency + " "), F.trim(found)))


def plain_text(html: Column) -> Column:
    """A page's text: headings marked by their level, list items by a dash, scripts, comments and tags gone, blanks made one."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<li\b[^>]*>", "\n- "), r"(?i)</?(p|div|br|tr|ul|ol|table|h[1-6])\b[^>]*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", ""), r"[ \t\r\x0b\x0c]+", " ")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def fingerprints(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``fil, utfall`` by size and hash: ok, endret, mangler (expected only), ukjent (found only)."""
    e = expected.select("fil", F.struct("byte", "sha").alias("e"))
    j = e.join(found.select("fil", F.struct("byte", "sha").alias("f")), "fil", "full_outer")
    return j.select("fil", F.when(F.col("f").isNull(), "mangler").when(F.col("e").isNull(), "ukjent").when(F.col("e") == F.col("f"), "ok").otherwise("endret").alias("utfall"))
