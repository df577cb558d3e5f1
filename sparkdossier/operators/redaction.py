"""Redaction of what can be proved: spans of identifiers, the redacted text, counts, and what looks like one but fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdossier.functions import scanners

# Kinds that are redacted.
KINDS = ("fodselsnummer", "kontonummer", "organisasjonsnummer", "kid", "telefon", "epost")
#: Forms in which a kind is written.
_FORMS = {"fodselsnummer": "elleve", "kontonummer": "elleve", "organisasjonsnummer": "ni"}


def candidates(docs: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """``doc_id, start, slutt, type, verdi`` of all that passes its checksum or form, overlaps included."""
    return docs.select("doc_id", F.explode(_spans(kinds)).alias("x")).select("doc_id", "x.start", "x.slutt", "x.type", "x.verdi")


def _forms(kinds: Sequence[str], *more: str) -> list[str]:
    """The forms of the kinds, and more."""
    return sorted({_FORMS.get(k, k) for k in kinds} | set(more))


def _spans(kinds: Sequence[str]) -> Column:
    """``start, slutt, type, verdi`` of all in the text that proves to be of one of the kinds, by one scan."""
    return scanners.scan_proved(F.col("tekst"), _forms(kinds), kinds)


def numbers_of_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, of each kind that has a checksum, the first number and all numbers (each once, in order of first place).

    Documents without any number give no row; the numbers of rows that repeat a doc_id are put together.
    """
    kinds = ("fodselsnummer", "kontonummer", "organisasjonsnummer")
    found = candidates(docs, kinds).groupBy("doc_id", "type", "verdi").agg(F.min("start").alias("start"))
    each = [F.array_sort(F.collect_list(F.when(F.col("type") == k, F.struct("start", "verdi"))))["verdi"].alias(f"alle_{k}") for k in kinds]
    rows = found.groupBy("doc_id").agg(*each)
    return rows.select("doc_id", *(c for k in kinds for c in (F.get(f"alle_{k}", F.lit(0)).alias(k), F.col(f"alle_{k}"))))


def redacted_spans(docs: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """``doc_id, start, slutt, type, verdi`` without overlap: from the left, the longer first, each that begins behind the last kept.

    The spans of rows that repeat a doc_id are put together. Rows without spans are not filtered out before that: Spark would scan
    every text a second time for the filter, below the dealing of the rows.
    """
    spans = docs.select("doc_id", _spans(kinds).alias("s"))
    kept = spans.groupBy("doc_id").agg(scanners.leftmost_spans(F.flatten(F.collect_list("s"))).alias("s"))
    return kept.select("doc_id", F.explode("s").alias("x")).select("doc_id", "x.start", "x.slutt", "x.type", "x.verdi")


def _removed(kinds: Sequence[str]) -> Column:
    """``sladdet, typer, mistenkt`` of each row's text, by one pass that finds all kinds and removes them; nothing is shuffled.

    An array of it is exploded in the select that makes it: of a column Spark would first ask whether it is empty, by a scan of its own.
    """
    return scanners.remove_identifiers(F.col("tekst"), _forms(kinds, "merket"), kinds)


def _counts(types: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)).cast("long"))))


def redact(docs: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """``doc_id, sladdet, antall``: the text with a visible mark for each span, and the number of spans by kind.

    A text without findings, empty or null, stays as it is, with an empty map. Each row is redacted by itself, repeated ones too.
    """
    return docs.select("doc_id", _removed(kinds).alias("r")).select("doc_id", "r.sladdet", _counts(F.col("r.typer")).alias("antall"))


def suspects(docs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``doc_id, type, posisjon, lengde, grunn``: labelled numbers that fail their checksum and lie in no redacted span.

    Without ``spans`` each row is held against its own spans of all kinds, by the scan that finds its suspects.
    """
    if spans is None:
        found = docs.select("doc_id", F.explode(_removed(KINDS)["mistenkt"]).alias("x"), "tekst")
        digits = F.length(F.regexp_replace(F.col("tekst").substr(F.col("x.start") + 1, F.col("x.slutt") - F.col("x.start")), r"[ .-]", ""))
        return found.select("doc_id", "x.type", F.col("x.start").alias("posisjon"), digits.alias("lengde"), "x.grunn")
    hits = docs.select("doc_id", F.explode(scanners.scan_judged(F.col("tekst"), ["merket"])).alias("x")).where("x.grunn is not null")
    out = hits.select("doc_id", F.substring_index("x.form", ":", -1).alias("type"), F.col("x.start").alias("posisjon"), "x.slutt", F.length("x.tall").alias("lengde"), "x.grunn")
    s = spans.select(F.col("doc_id").alias("sd"), F.col("start").alias("ss"), F.col("slutt").alias("se"))
    free = out.join(s, (F.col("doc_id") == F.col("sd")) & (F.col("ss") <= F.col("posisjon")) & (F.col("slutt") <= F.col("se")), "left_anti")
    return free.drop("slutt")


def redaction_report(docs: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """``doc_id, sladdet, antall, mistenkt, fullstendig``: the redacted text, what was removed, and what looks like a number but stayed.

    ``mistenkt`` (``posisjon, type, grunn`` by place) is null where nothing is suspected. Each row is reported by itself.
    """
    out = docs.select("doc_id", _removed(kinds).alias("r")).select("doc_id", "r.sladdet", _counts(F.col("r.typer")).alias("antall"), F.transform("r.mistenkt", lambda m: F.struct(m["start"].alias("posisjon"), m["type"].alias("type"), m["grunn"].alias("grunn"))).alias("m"))
    out = out.select("doc_id", "sladdet", "antall", F.when(F.size("m") > 0, F.col("m")).alias("mistenkt"))
    return out.withColumn("fullstendig", F.col("mistenkt").isNull())
