"""Fields of case texts: type, number, dates, labelled amounts, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.functions import text as T

# The words that name a document's type and some benefits.
TYPES = (("klagevedtak", "klagevedtak"), ("klage", "klage"), ("vedtak", "vedtak"), ("søknad", "soknad"), ("purring", "purring"))
BENEFITS = ("dagpenger", "sykepenger", "foreldrepenger", "uføretrygd")


def document_type(title: F.Column) -> F.Column:
    """The type whose word comes first in a title in lower case, the longest at one place; null without one."""
    hits = [F.when(F.locate(w, title) > 0, F.struct(F.locate(w, title).alias("p"), F.lit(-len(w)).alias("n"), F.lit(code).alias("kode"))) for w, code in TYPES]
    return F.array_min(F.array_compact(F.array(*hits)))["kode"]


def benefit(low: F.Column) -> F.Column:
    """The benefit whose name comes first in a folded text; null without one."""
    hits = [F.when(F.locate(T.folded(b), low) > 0, F.struct(F.locate(T.folded(b), low).alias("p"), F.lit(b).alias("navn"))) for b in BENEFITS]
    return F.array_min(F.array_compact(F.array(*hits)))["navn"]


def labelled(text: F.Column, label: str, value: str) -> F.Column:
    """The first value after a label that begins a line; null without one."""
    v = F.regexp_extract(text, rf"(?im)^[ \t]*{label}[ \t]*:?[ \t]*({value})", 1)
    return F.when(v != "", v)


def norwegian_date(raw: F.Column, as_of_year: int = 2100) -> F.Column:
    """A date written d.m.yyyy, from 1854 to the year after ``as_of_year``."""
    d = F.try_to_date(F.regexp_replace(raw, r"\s", ""), "d.M.yyyy")
    return F.when(F.year(d).between(1854, as_of_year + 1), d)


def fields(docs: DataFrame) -> DataFrame:
    """One row per document of the fields that a case needs."""
    t = F.col("tekst")
    rate = labelled(t, "Dagsats", r"(?:kr[ \t]*)?\d[\d .]{0,20}(?:,\d{2})?(?![\d,]*[ \t]*(?:%|prosent|pst))")
    # Title and folded text stand in a projection of their own, so that each is computed once a row.
    docs = docs.withColumns({"x_tittel": F.lower(F.array_join(T.title_lines(t), "\n")), "x_lav": T.fold(t)})
    return docs.select(
        "doc_id", document_type(F.col("x_tittel")).alias("type"), benefit(F.col("x_lav")).alias("ytelse"), labelled(t, "Saksnummer", r"\d{5,9}").alias("saksnummer"),
        norwegian_date(labelled(t, "Vedtaksdato", r"\d{1,2}\.\s?\d{1,2}\.\s?\d{4}")).alias("dato"),
        T.amount(F.regexp_replace(rate, r"(?i)^kr[ \t]*", "")).alias("dagsats"), F.array_join(T.statutes(t), ",").alias("hjemler"),
    )
