"""Labelled fields of case texts: values, amounts and dates behind a label; amounts, totals, codes and statute references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdossier.functions import scanners
from sparkdossier.functions import text as T
from sparkdossier.operators import dates as D

# Inflections after a label, words that bind it to its value, and the labels of each field.
A, O = "(?:å|aa|a)", "(?:ø|oe|o)"  # noqa: E741
WORD_END = r"(?:en|et|er|ene|ne|a|n)?(?![A-Za-zÆØÅæøå])"
BINDING = rf"(?:\s+(?:er|var|p{A}|utgj{O}r|blir|settes\s+til|med|lyder\s+p{A}))?"
CASE_NUMBER = r"[0-9]{2,4}/[0-9]{3,6}|[0-9]{4,12}"
NUMBERS = {
    "journalnummer": (r"journalnummer|journalnr\.?|journalpost|\bjnr\b", CASE_NUMBER),
    "vedtaksnummer": (r"vedtaksnummer|vedtaksnr\.?|vedtak\s+nr\.?", CASE_NUMBER),
    "dokumentnummer": (r"dokumentnummer|dokumentnr\.?|dok\.?nr\.?", CASE_NUMBER),
    "referanse": (rf"v{A}r\s+referanse|v{A}r\s+ref\.?|deres\s+referanse|deres\s+ref\.?|referansenummer|\breferanse\b", r"[A-Za-z0-9][A-Za-z0-9/\-]{2,30}"),
}
AMOUNTS = {
    "dagsats": rf"dagsats|dagsatsen|sats\s+per\s+dag|bel{O}p\s+per\s+dag",
    "manedsbelop": rf"m{A}nedsbel{O}p|m{A}nedlig\s+bel{O}p|bel{O}p\s+per\s+m{A}ned|per\s+m{A}ned|m{A}nedlig\s+utbetaling|m{A}nedss?ats",
    "utbetalt_belop": rf"utbetalt\s+bel{O}p|utbetalingsbel{O}p|til\s+utbetaling|utbetalt|utbetales",
    "tilbakebetalingsbelop": rf"tilbakebetaling|tilbakebetalings?bel{O}p|krever\s+tilbake|skyldig\s+bel{O}p|restbel{O}p",
    "arsinntekt": rf"{A}rsinntekt|{A}rsl{O}nn|inntekt\s+per\s+{A}r|brutto\s+{A}rsinntekt",
    "manedslonn": rf"m{A}nedsl{O}nn|l{O}nn\s+per\s+m{A}ned|brutto\s+m{A}nedsl{O}nn",
}
WORK = {
    "arbeidsgiver": (r"arbeidsgiver|arbeidsgivers?\s+navn|virksomhet|bedrift|foretak", r"[A-ZÆØÅ0-9][^\n,;]{1,58}?(?=\s*(?:,|\n|$|[Oo]rg\.?\s?nr))"),
    "stilling": (r"stilling|stillingstittel|\byrke\b|stillingsbetegnelse", r"[A-Za-zÆØÅæøå][^\n,;]{1,48}"),
}
DATES = {
    "utbetalingsdato": r"utbetalingsdato|utbetales\s+den|utbetalt\s+den",
    "startdato": rf"startdato|ansatt\s+fra|tiltr{A}dt|ansettelsesdato|arbeidsforhold\s+fra",
    "sluttdato": rf"sluttdato|fratr{A}dt|siste\s+arbeidsdag|arbeidsforhold\s+til|opph{O}rsdato",
    "forfallsdato": None,
}
# Labels of a due date, beginnings of a total, the number of a form.
DUE = r"(?:forfalls?dato|forfall|betalingsfrist)\b[:\s]*"
TOTAL = r"(?i)^\W*(?:total(?:sum|t|beløp|belop)?|sum|å\s*betale|aa\s*betale|til\s*betaling|bel(?:ø|oe?)p\s+(?:å|aa)\s+betale)\b"
FORM = r"\b([A-ZÆØÅ]{2,6})\s?(\d{2}-\d{2}\.\d{2})\b"


def _none(c: Column) -> Column:
    return F.when(c != "", c)


def value(text: Column, labels: str, form: str) -> Column:
    """The value behind one of the labels, that of a label that begins its line if there is one, else the first; null without."""
    rest = rf"(?:{labels}){WORD_END}{BINDING}\s*(?:nr\.?|nummer)?\s*[:.\-]?\s*({form})"
    at_start = _none(F.trim(F.regexp_extract(text, rf"(?im)^[^\S\n]*{rest}", 1)))
    return F.coalesce(at_start, _none(F.trim(F.regexp_extract(text, f"(?i){rest}", 1))))


def labelled_amount(text: Column, labels: str) -> Column:
    """The first amount behind one of the labels that is no percentage, as a number; null without.

    No part of the number may be given up to make the rest fit: what is a percentage as a whole is no amount in part.
    """
    number = scanners.NUMBER.replace(r"\d+", r"\d++", 1).replace("{0,7}", "{0,7}+") + "+"
    pattern = rf"(?i)(?:{labels}){WORD_END}{BINDING}\s*[:.\-]?\s*(?:kr\.?|NOK)?\s*({number})(?!\d)(?!\s*(?:%|prosent|pst\.?)(?![a-zæøåA-ZÆØÅ0-9]))"
    return T.amount(_none(F.regexp_extract(text, pattern, 1)))


def labelled_date(text: Column, labels: str, as_of_year: int, within: int = 32) -> Column:
    """The first date whose century is not assumed in the ``within`` characters behind the first label; null without."""
    near = F.regexp_extract(text, rf"(?is)(?:{labels}){WORD_END}{BINDING}\s*[:.\-]?\s*(.{{0,{within}}})", 1)
    return D.unambiguous(scanners.scan_days(near, as_of_year))


def due_date(text: Column, as_of_year: int) -> Column:
    """A date in the 24 characters behind the first label of a due date."""
    return D.unambiguous(scanners.scan_days(F.regexp_extract(text, rf"(?is){DUE}(.{{0,24}})", 1), as_of_year))


def case_number(text: Column) -> Column:
    """A labelled ``nn/nnn``, else a labelled number of 5 to 9 digits, else the number of a form behind its agency's letters."""
    slash = F.regexp_extract(text, r"(?i)(?:saksnr\.?|saksnummer|ref\.?|referanse)[:\s]+([0-9]{2,4}/[0-9]{3,6})", 1)
    plain = F.regexp_extract(text, r"(?i)(?:saksnr\.?|saksnummer|sakstilvising)[:\s]+(\d{5,9})\b", 1)
    form = F.concat_ws(" ", F.regexp_extract(text, FORM, 1), F.regexp_extract(text, FORM, 2))
    return F.coalesce(_none(slash), _none(plain), _none(F.trim(form)))


def position_percent(text: Column) -> Column:
    """1 to 100 behind a label, else before ``% stilling``; null beyond."""
    by_label = F.regexp_extract(text, rf"(?i)(?:stillingsprosent|stillingsandel|stillingsst{O}rrelse)\s*[:.\-]?\s*(\d{{1,3}})\s*%?", 1)
    found = F.coalesce(_none(by_label), _none(F.regexp_extract(text, r"(?i)\b(\d{1,3})\s*%\s*stilling\b", 1))).cast("int")
    return F.when((found > 0) & (found <= 100), found)


def case_fields(text: Column) -> dict[str, Column]:
    return {name: value(text, labels, form) for name, (labels, form) in NUMBERS.items()} | {"saksnummer": case_number(text)}


def money_fields(text: Column, as_of_year: int) -> dict[str, Column]:
    names = ("dagsats", "manedsbelop", "utbetalt_belop", "tilbakebetalingsbelop")
    return {n: labelled_amount(text, AMOUNTS[n]) for n in names} | {"utbetalingsdato": labelled_date(text, DATES["utbetalingsdato"], as_of_year)}


def work_fields(text: Column, as_of_year: int) -> dict[str, Column]:
    out = {name: value(text, labels, form) for name, (labels, form) in WORK.items()} | {"stillingsprosent": position_percent(text)}
    out |= {n: labelled_date(text, DATES[n], as_of_year) for n in ("startdato", "sluttdato")}
    return out | {n: labelled_amount(text, AMOUNTS[n]) for n in ("arsinntekt", "manedslonn")}


def first_amount(text: Column) -> Column:
    """The first amount of a text as a number."""
    return T.amount(F.get(scanners.scan("amounts", text), 0)["raa"])


def all_amounts(docs: DataFrame, most: int = 100) -> DataFrame:
    """``doc_id, nr, verdi, raatekst, kontekst`` of the first ``most`` amounts of each text."""
    rows = docs.select("doc_id", F.posexplode(F.slice(scanners.scan("amounts", F.col("tekst")), 1, most)).alias("nr", "x"))
    return rows.select("doc_id", "nr", T.amount(F.col("x.raa")).alias("verdi"), F.col("x.tekst").alias("raatekst"), F.col("x.kontekst").alias("kontekst")).where("verdi is not null")


def totals(docs: DataFrame) -> DataFrame:
    """``doc_id, total``: the amount on the first line that begins as a total and has one, or on the next line if its own has no digit."""
    split = F.split("tekst", r"\r\n|[\n\r\x0b\x0c]", -1)
    both = F.arrays_zip(split.alias("linje"), F.slice(split, 2, F.size(split)).alias("neste"))  # each line with the next one
    lines = docs.select("doc_id", F.posexplode(both).alias("nr", "l")).select("doc_id", "nr", "l.linje", "l.neste").where(F.trim("linje").rlike(TOTAL))
    lines = lines.withColumn("egen", first_amount(F.col("linje"))).withColumn("under", first_amount(F.when(~F.col("linje").rlike(r"\d"), F.col("neste"))))
    found = lines.withColumn("total", F.coalesce("egen", "under")).where("total is not null")
    return found.groupBy("doc_id").agg(F.min_by("total", "nr").alias("total"))


def codes(docs: DataFrame, most: int = 25) -> DataFrame:
    """``doc_id, nr, kode, kontekst``: the first ``most`` different numbers of 4 to 10 digits and codes of capitals and digits."""
    rows = docs.select("doc_id", F.posexplode(scanners.scan("codes", F.col("tekst"))).alias("i", "x")).select("doc_id", "i", F.col("x.tall").alias("kode"), F.col("x.foran").alias("kontekst"))
    first = rows.groupBy("doc_id", "kode").agg(F.min("i").alias("i"), F.min_by("kontekst", "i").alias("kontekst"))
    return first.withColumn("nr", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).where(F.col("nr") <= most).select("doc_id", "nr", "kode", "kontekst")


def statute_references(text: Column) -> Column:
    """References as ``§ a-b``, ``§ n`` or ``kapittel n``, in order, each once."""
    hits = F.regexp_extract_all(text, F.lit(r"(§{1,2}\s*\d{1,2}\s*[-–]\s*\d{1,2}[a-zA-Z]?|§{1,2}\s*\d{1,2}[a-zA-Z]?(?!\s*[-–]\s*\d)|\bkap(?:\.|ittel)?\s*\d{1,2}\s*(?:[A-Z]\b)?)"), 1)

    def name(x: Column) -> Column:
        both = F.regexp_extract(x, r"(\d{1,2})\s*[-–]\s*(\d{1,2}[a-zA-Z]?)", 0)
        bare = F.regexp_replace(both, r"\s*[-–]\s*", "-")
        chapter = F.regexp_replace(F.regexp_extract(x, r"(\d{1,2}\s*[A-Z]?)", 1), r"\s", "")
        return F.when(F.startswith(x, F.lit("§")), F.concat(F.lit("§ "), F.when(both != "", bare).otherwise(F.regexp_extract(x, r"(\d{1,2}[a-zA-Z]?)", 1)))).otherwise(F.concat(F.lit("kapittel "), chapter))

    return F.array_distinct(F.transform(hits, name))
