"""What each date of a text is: its kind and role, the document's own date, its period, and dates of stamps."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from sparkdossier.functions import identifiers as I
from sparkdossier.functions import scanners

# Labels before a date and the kind they name; of labels that end at one place the longest counts, then the first.
LABELS = (
    (r"f[øo]ds?elsdato|f[øo]dt", "fodselsdato"), (r"frist|innen|senest", "frist"), (r"vedtaksdato|vedtak\s+av", "vedtaksdato"),
    (r"s[øo]knadsdato|s[øo]knad\s+datert", "soknadsdato"), (r"mottatt", "mottatt"), (r"sendt", "sendt"), (r"utstedt|utstedelsesdato", "utstedt"),
    (r"dokumentdato|brevdato|datert", "dokumentdato"), (r"gyldig\s+til|utl[øo]per|utl[øo]psdato", "utlop"), (r"gyldig\s+fra", "gyldig_fra"),
    (r"avreise", "avreise"), (r"ankomst", "ankomst"), (r"signert|underskrift|signatur", "signaturdato"),
    (r"betalingsdato|utbetalt|utbetaling|betalt", "utbetalingsdato"), (r"arkivert|journalf[øo]rt", "arkivert"),
    (r"periode|fra\s+og\s+med|f\.o\.m", "periode_start"), (r"til\s+og\s+med|t\.o\.m", "periode_slutt"), (r"dato", "merket_dato"),
)
# Roles of kinds; any other kind is of the content, none is unknown.
ROLES = {
    "dokument": ("dokumentdato", "vedtaksdato", "utstedt", "signaturdato", "soknadsdato", "brevdato_sannsynlig", "signaturdato_sannsynlig", "sendt", "merket_dato", "pdf_opprettet", "pdf_endret"),
    "behandling": ("mottatt", "arkivert"),
    "ukjent": ("ukjent",),
}
# How well a kind speaks for the document's date, and by what; confidence by rank.
RANKS = {
    "dokumentdato": (1, "etikett"), "vedtaksdato": (1, "etikett"), "utstedt": (1, "etikett"), "signaturdato": (1, "etikett"), "soknadsdato": (1, "etikett"),
    "sendt": (2, "etikett"), "brevdato_sannsynlig": (2, "posisjon"), "signaturdato_sannsynlig": (2, "posisjon"), "merket_dato": (3, "etikett"),
    "pdf_opprettet": (4, "pdf_metadata"), "pdf_endret": (5, "pdf_metadata"),
}
CONFIDENCE = {1: "hoy", 2: "middels", 3: "middels"}
# Words of a signature block, a place before a date, words of a stamp.
SIGNATURE = r"(?i)\(?\bsign\b\.?\)?|signatur|underskrift|underskrevet|underteg|med\s+vennlig\s+hilsen|\bmvh\b|vennlig\s+hilsen|sted\s*[/og]{1,2}\s*dato|dato\s*[/og]{1,2}\s*sted"
PLACE = r"[A-ZÆØÅ][a-zæøåA-ZÆØÅ\- ]{1,25},\s*$"
STAMP = r"(?i)\b(stempel|stemplet|mottatt|innkommet|registrert|journalf[øo]rt|arkivert|ekspedert|skannet|innlest|postmottak|dokumentsenter)\b"
BETWEEN = r"(?i)[-–—]|til"
#: One of these stands in all that ``SIGNATURE`` can match.
_IN_SIGNATURES = ("sign", "underskr", "underteg", "vennlig", "mvh", "sted")
_PLACE, _SIGNATURE, _BETWEEN, _EDGES = re.compile(PLACE), re.compile(SIGNATURE), re.compile(BETWEEN), re.compile(r"\A[\s.,;:\-–—]+|[\s.,;:\-–—]+\Z")


def role(kind: Column) -> Column:
    """Role of a kind of date: unknown without one, content for all that are not listed."""
    out = F.when(kind.isNull(), "ukjent")
    for name, kinds in ROLES.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("innhold")


def _needed(pattern: str) -> tuple[str, ...]:
    """Of each way to write a label the longest part that is always the same."""
    return tuple(max(re.split(r"\[øo\]|s\?|\\s\+", way.replace("\\.", ".")), key=len) for way in pattern.split("|"))


#: Labels with what a text must hold for one to match, so that most patterns need not be tried.
_LABELS = tuple((re.compile(pattern, re.I), kind, _needed(pattern)) for pattern, kind in LABELS)


@functools.lru_cache(4096)
def nearest_label(before: str, own: str = "[]") -> tuple[str, str] | None:
    """Kind and wording of the label that ends last in ``before``, then the longest, then the first; ``own`` labels (JSON) come first."""
    low = before.lower() if not any(c in before for c in scanners._ODD_LETTERS) else None
    for labels in (_own_labels(own), _LABELS):
        best, rank = None, (0, 0)
        for pattern, kind, needed in labels:
            if low is None or not needed or any(part in low for part in needed):
                for m in pattern.finditer(before):
                    if (m.end(), len(m[0])) > rank:
                        best, rank = (kind, m[0]), (m.end(), len(m[0]))
        if best:
            return best
    return None


@functools.lru_cache(64)
def _own_labels(own: str) -> list[tuple[re.Pattern, str, tuple[str, ...]]]:
    return [(re.compile(re.escape(word), re.I), kind, ()) for word, kind in json.loads(own)]


def classified_dates(text: str, as_of_year: int, own: str, most: int) -> list[tuple]:
    """The first ``most`` dates of a text by place, with their kinds (fields: ``_CLASSIFIED``)."""
    hits = scanners.date_hits(text, as_of_year)
    if not hits:
        return []
    placing, out, second = scanners.Placing(text), [], False
    for nr, (start, end, date, assumed) in enumerate(hits[:most]):
        head, foot, page, line_in_page, low = placing.of(start, end)
        line = text[head:foot]
        short, before, kind, label = len(line.strip()) <= 60, text[max(head, start - 80) : start], None, None
        gap = hits[nr + 1][0] - end if nr + 1 < len(hits) else 9
        first = gap <= 8 and _BETWEEN.search(text, end, end + max(gap, 0)) is not None
        if first or second:
            kind = "periode_start" if first else "periode_slutt"
        elif found := nearest_label(before[-35:], own):
            kind, label = found
        elif short and before.rstrip().endswith(",") and _PLACE.search(before):
            kind = "signaturdato_sannsynlig" if low else "brevdato_sannsynlig"
        elif low and short and scanners._may_hold(near := text[max(0, start - 120) : end + 200], _IN_SIGNATURES) and _SIGNATURE.search(near):
            kind = "signaturdato_sannsynlig"
        elif not low and line_in_page < 14 and len(line.strip()) <= 40:
            kind = "brevdato_sannsynlig"
        elif low and _EDGES.sub("", line) == text[start:end]:
            kind = "signaturdato_sannsynlig"
        else:
            kind = "ukjent" if short else "i_lopende_tekst"
        out.append((nr, date, text[start:end], kind, label, page, assumed, not short, start, before, scanners.context(text, start, end)))
        second = first
    return out


_CLASSIFIED = "array<struct<nr:int,dato:date,raa:string,type:string,etikett:string,side:int,antatt:boolean,i_lopende_tekst:boolean,start:int,foran:string,kontekst:string>>"


@functools.cache
def _classifying():
    made = to_arrow_type(DataType.fromDDL(_CLASSIFIED))

    def run(text: pa.Array, year: pa.Array, own: pa.Array, most: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), year.to_pylist(), own.to_pylist(), most.to_pylist(), strict=True)
        return scanners.listed([[] if t is None else classified_dates(t, *given) for t, *given in rows], made)

    return F.arrow_udf(run, _CLASSIFIED)


def classify(docs: DataFrame, as_of_year: int, own_labels: Sequence[tuple[str, str]] = (), most: int = 200) -> DataFrame:
    """Each date of ``doc_id, tekst``: ``nr, dato, raa, type, rolle, etikett, side, antatt, i_lopende_tekst, start, foran, kontekst``.

    A date is, in this order: an end of an interval; what the nearest label before it in its line says (``own_labels``, plain words
    and kinds, come first); by a place name or signature words, the document's date; by its place at the top or bottom of its
    page, the same; else in running text or unknown. Birth dates in persons' numbers follow, one for each number, without a
    page. A text gives its first ``most`` dates. Null and empty texts give none. Each row is a text by itself, also where a doc_id
    repeats: the scan that finds its dates tells what they are, without a shuffle.
    """
    found = _classifying()(F.col("tekst"), F.lit(as_of_year), F.lit(json.dumps([list(x) for x in own_labels])), F.lit(most))
    rows = docs.select("doc_id", F.explode(found).alias("d")).select("doc_id", "d.*")
    persons = person_numbers(docs).groupBy("doc_id", "tall").agg(F.min("start").alias("start"))
    born = persons.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "tall")) + 1_000_000).alias("nr"), I.birth_date(F.col("tall")).alias("dato"),
        F.concat(F.substring("tall", 1, 6), F.lit("*****")).alias("raa"), F.lit("fodselsdato_fra_fnr").alias("type"), F.lit(None).cast("string").alias("etikett"), F.lit(None).cast("int").alias("side"),
        F.lit(False).alias("antatt"), F.lit(False).alias("i_lopende_tekst"), "start", F.lit("").alias("foran"), F.lit("").alias("kontekst"),
    ).where((F.year("dato") >= 1854) & (F.year("dato") <= as_of_year + 1))
    return rows.unionByName(born).withColumn("rolle", role(F.col("type")))


def person_numbers(docs: DataFrame) -> DataFrame:
    """``doc_id, start, slutt, tall`` of the persons' numbers of each text."""
    found = docs.select("doc_id", F.explode(scanners.scan_judged(F.col("tekst"), ["elleve"])).alias("n")).select("doc_id", "n.*")
    return found.where("type = 'fodselsnummer'").select("doc_id", "start", "slutt", "tall")


def document_date(dates: DataFrame, as_of: str, ocr: bool = False, keep: int = 5) -> DataFrame:
    """The document's own date of classified dates: ``doc_id, dato, type, kilde, konfidens, side, alternativer, advarsler``.

    Candidates are dates whose role is the document; they stand by rank, first page first, then by place. Up to ``keep``
    alternatives follow. Warnings: the century was assumed, the date is to come, it is a scan's file date, or dates of the
    same rank differ (not where the file holds several dated documents). A document without a candidate has no row.
    """
    rank, source = F.lit(6), F.lit("etikett")
    for kind, (r, s) in RANKS.items():
        rank, source = F.when(F.col("type") == kind, r).otherwise(rank), F.when(F.col("type") == kind, s).otherwise(source)
    c = dates.where("rolle = 'dokument'").withColumn("rang", rank).withColumn("kilde", source)
    by = Window.partitionBy("doc_id")
    c = c.withColumn("plass", F.row_number().over(by.orderBy("rang", F.coalesce("side", F.lit(1)) != 1, "nr")))
    c = c.withColumn("like", F.size(F.collect_set(F.when(F.col("rang") == F.min("rang").over(by), F.col("dato"))).over(by)))
    c = c.withColumn("flere", (F.size(F.collect_set("dato").over(by)) > 1) & (F.size(F.collect_set(F.coalesce("side", F.lit(1))).over(by)) > 1))
    first = F.col("plass") == 1
    sure = F.lit("lav")
    for r, name in CONFIDENCE.items():
        sure = F.when(F.col("rang") == r, name).otherwise(sure)
    scan = (F.col("kilde") == "pdf_metadata") & F.lit(ocr)
    warnings = F.array_compact(F.array(
        F.when(scan, "skannedato"), F.when(F.col("antatt"), "aarhundre_antatt"), F.when(F.col("dato") > F.lit(as_of).cast("date"), "fram_i_tid"),
        F.when(F.col("flere"), "flere_dokumenter"), F.when((F.col("like") > 1) & ~F.col("flere"), "ulike_kandidater"),
    ))
    best = F.max(F.when(first, F.struct("dato", "type", "kilde", F.when(scan, "lav").otherwise(sure).alias("konfidens"), "side", warnings.alias("advarsler")))).alias("b")
    others = F.array_sort(F.collect_list(F.when((F.col("plass") > 1) & (F.col("plass") <= keep + 1), F.struct("plass", "dato", "type", sure.alias("konfidens"))))).alias("alternativer")
    return c.groupBy("doc_id").agg(best, others).select("doc_id", "b.dato", "b.type", "b.kilde", "b.konfidens", "b.side", "alternativer", "b.advarsler")


def period(dates: DataFrame) -> DataFrame:
    """``doc_id, fra, til``: the first period end that follows a period start, with the last start before it."""
    dates = dates.where(F.col("type").isin("periode_start", "periode_slutt")).select("doc_id", "nr", "dato", "type")
    upto = Window.partitionBy("doc_id").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("type") == "periode_start", F.col("dato")), ignorenulls=True).over(upto)
    ends = dates.withColumn("fra", start).where("type = 'periode_slutt' and fra is not null")
    return ends.groupBy("doc_id").agg(F.min_by(F.struct("fra", F.col("dato").alias("til")), "nr").alias("p")).select("doc_id", "p.fra", "p.til")


def stamps(dates: DataFrame) -> DataFrame:
    """``doc_id, dato, raa, type, side``: dates of handling, or with a stamp's word in the 40 characters before them in their line.

    The document's own dates are never stamps. A date that stands in several is one, the first.
    """
    hit = (F.col("rolle") == "behandling") | F.right(F.col("foran"), F.lit(40)).rlike(STAMP)
    found = dates.where((F.col("rolle") != "dokument") & hit)
    return found.groupBy("doc_id", "dato").agg(F.min_by(F.struct("raa", "type", "side"), "nr").alias("f")).select("doc_id", "dato", "f.raa", "f.type", "f.side")


def unambiguous(hits: Column) -> Column:
    """The first date of a scan whose century is not assumed."""
    return F.get(F.filter(hits, lambda h: ~h["antatt"]), 0)["dato"]


def distinct_dates(hits: Column, most: int = 100) -> Column:
    """The first ``most`` different dates of a scan, in the order of their places."""
    return F.slice(F.array_distinct(F.transform(hits, lambda h: h["dato"])), 1, most)


def norwegian(date: Column) -> Column:
    return F.date_format(date, "dd.MM.yyyy")


def strict_iso(text: Column) -> Column:
    """A date written yyyy-mm-dd and nothing else, or null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
