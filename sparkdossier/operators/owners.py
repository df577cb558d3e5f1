"""Whom a document is about: the label that controls each person's number, the name beside it, and what follows for the document.

Each number's label is the last one in the 250 characters before it; a label of the owner and one of somebody else on the same
line are in the genitive order, so there the first controls. All is read by expressions over that window; only the places of
the numbers come from a scanner.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdossier.functions import scanners

# Labels of the owner, labels of everybody else, a label over a name, names, and what only looks like one.
OWNER = (
    r"dokumentet\s+gjelder|saken\s+gjelder|gjelder\s+person|vedr[øo]rende|ang[åa]ende|personopplysninger|\bnavn\b|\bs[øo]ker\b|s[øo]kers?\s+navn|\bbruker\b|brukers?\s+navn|"
    r"den\s+sykmeldte|sykmeldt\b|arbeidstaker|\bmedlem\b|\bpasient\b|\belev\b|\bdeltaker\b|\bklient\b|sakens\s+part|personen\s+dette\s+gjelder|opplysninger\s+om"
)
_END = r"(?:ns|n|s|en|ene|es)?"
OTHER = (
    rf"saksbehandler{_END}|behandlende\s+lege{_END}|\bfastlege{_END}\b|\blege{_END}\b|tannlege{_END}|psykolog{_END}|fysioterapeut{_END}|\bbehandler{_END}\b|kontaktperson{_END}|"
    rf"arbeidsgiver{_END}|n[æa]rmeste\s+leder|\bkopi\b|kopimottaker|\bmottaker{_END}\b|\bavsender{_END}\b|utsteder{_END}|utstedt\s+av|signert\s+av|underskrevet\s+av|attestert\s+av|"
    rf"\bveileder{_END}\b|konsulent{_END}|\bvitne{_END}\b|\bverge{_END}\b|fullmektig{_END}|p[åa]r[øo]rende|ektefelle{_END}|samboer{_END}|\bforelder\b|\bvergem[åa]l\b|revisor{_END}|"
    rf"regnskapsf[øo]rer{_END}"
)
OWNER_LETTERS, OTHER_LETTERS = "dsgvapnbmeko", "sbfltpkanmuver"
NAME_LABEL = r"^\s*(?:etternavn,?\s*fornavn|fornavn,?\s*etternavn|navn\s*p[åa]\s*\w+|etternavn|fornavn|\bnavn\b)\s*:?\s*$"
NAME_WORD = r"[A-ZÆØÅ][a-zæøåé']{1,20}(?:-[A-ZÆØÅa-zæøåé']{1,20})?"
NO_NAME = r"^(?:fnr|f[øo]dselsnummer|personnummer|navn|dato|side|nav|saksnummer|adresse|telefon|postnummer|org)\b"
#: How far before a number its label may stand, and how many lines above an unlabelled one its name.
WINDOW, LINES_ABOVE = 250, 3


def _last(window: Column, labels: str, letters: str) -> Column:
    """``slutt, etikett`` of the last label in the window; null without one. ``letters`` are those that labels begin with.

    Each match takes what lies between it and the one before, so the end of the last one is the length of all matches.
    """
    # A letter is compared far faster than a word's edge is found.
    quick = re.sub(r"(^|\|)\\b([a-z])", r"\1(?=\2)\\b\2", labels)
    pattern = rf"(?s)\G(.*?)((?iuU)(?=[{letters}])(?:{quick}))"
    found = F.regexp_extract_all(window, F.lit(pattern), 2)
    end = F.length(F.array_join(F.regexp_extract_all(window, F.lit(pattern), 0), ""))
    return F.when(F.size(found) > 0, F.struct(end.alias("slutt"), F.element_at(found, -1).alias("etikett")))


def _names(text: Column) -> Column:
    """The first name in a text: two to four words in capitals on one line; null without one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?U)((?=[A-ZÆØÅ])\b{NAME_WORD}(?:[ \t]+{NAME_WORD}){{1,3}}\b)"), 1)
    return F.get(F.filter(found, lambda n: ~n.rlike(f"(?iuU){NO_NAME}")), 0)


def _full_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def numbers_with_labels(docs: DataFrame) -> DataFrame:
    """``doc_id, fnr, posisjon, rolle, etikett, navn``: each place of a valid person's number of ``docs`` (``doc_id, tekst``).

    ``rolle`` is ``eier``, ``annen`` or ``umerket``. The name is that below a label of names or the first one between the label
    and the number; an unlabelled number also takes one of the last three lines above it, up to the number before. Null texts
    have no numbers. Of a repeated doc_id each row is a document of its own, all their places together.
    """
    hit = docs.select("doc_id", F.explode(scanners.scan_persons(F.col("tekst"), WINDOW, LINES_ABOVE)).alias("x"))
    return _read_labels(hit)


def _read_labels(hit: DataFrame) -> DataFrame:
    """The places of ``hit`` (``doc_id, x``), a row of ``scan_persons`` each; a null one stays as a row without a number."""
    hit = hit.select("doc_id", F.col("x.start").alias("start"), F.col("x.tall").alias("fnr"), F.col("x.vindu").alias("vindu"), F.col("x.over").alias("over"))
    hit = hit.withColumn("o", _last(F.col("vindu"), OWNER, OWNER_LETTERS)).withColumn("a", _last(F.col("vindu"), OTHER, OTHER_LETTERS))
    o, a = (F.col(f"{c}.slutt") - F.length(f"{c}.etikett") for c in "oa")
    between = F.substring("vindu", F.least(o, a) + 1, F.greatest(o, a) - F.least(o, a))
    same_line = ~between.contains("\n")
    other_wins = F.when(F.col("o").isNull() | F.col("a").isNull(), F.col("a").isNotNull()).when(same_line, a < o).otherwise(a >= o)
    label = F.when(F.col("a").isNull() & F.col("o").isNull(), F.lit(None)).when(other_wins, F.col("a")).otherwise(F.col("o"))
    hit = hit.withColumn("etikett", label).withColumn("rolle", F.when(F.col("etikett").isNull(), "umerket").when(other_wins, "annen").otherwise("eier"))
    to_number = F.when(F.col("etikett").isNotNull(), F.substring("vindu", F.col("etikett.slutt") + 1, F.length("vindu"))).otherwise("")
    hit = hit.withColumn("mellom", to_number)
    name_label = f"(?imuU){NAME_LABEL}"
    below = F.when(F.col("mellom").rlike(name_label), F.get(_full_lines(F.element_at(F.split("mellom", name_label, -1), -1)), 0))
    below = F.when(~below.rlike(f"(?iuU){NO_NAME}"), below)
    above = F.reverse(_full_lines(F.col("over")))
    above = F.get(F.filter(F.transform(F.slice(above, 1, LINES_ABOVE), _names), lambda n: n.isNotNull()), 0)
    name = F.coalesce(below, _names(F.col("mellom")), F.when(F.col("rolle") == "umerket", above))
    return hit.select("doc_id", "fnr", F.col("start").alias("posisjon"), "rolle", F.trim("etikett.etikett").alias("etikett"), name.alias("navn"))


def document_owners(docs: DataFrame) -> DataFrame:
    """``doc_id, navn, fnr, sikkerhet, posisjon, andre`` for each doc_id of ``docs`` (``doc_id, tekst``).

    ``sikkerhet`` is a ladder: ``ingen`` (no valid number), ``merket`` (one number stands under labels of the owner, which is
    then given with the first name beside it), ``flertydig`` (several do), ``bare_andre_roller`` (all stand under labels of others) and
    ``umerket``. ``andre`` lists all other numbers once, each as it stands first.
    """
    places = _read_labels(docs.select("doc_id", F.explode_outer(scanners.scan_persons(F.col("tekst"), WINDOW, LINES_ABOVE)).alias("x")))
    owner = F.col("rolle") == "eier"
    per = places.groupBy("doc_id", "fnr").agg(
        F.min(F.struct("posisjon", "rolle", "etikett", "navn")).alias("first"), F.min(F.when(owner, F.col("posisjon"))).alias("owner_at"),
        F.min_by("navn", F.when(owner & F.col("navn").isNotNull(), F.col("posisjon"))).alias("owner_name"), F.bool_and(F.col("rolle") == "annen").alias("others"),
    )
    # A document without a number has one row, without a number: so no second reading of the texts is joined.
    some = F.col("fnr").isNotNull()
    item = F.struct(F.col("first.posisjon").alias("posisjon"), "fnr", F.col("first.rolle").alias("rolle"), F.col("first.etikett").alias("etikett"), F.col("first.navn").alias("navn"))
    d = per.groupBy("doc_id").agg(
        F.count("fnr").alias("numbers"), F.count("owner_at").alias("owners"), F.bool_and(F.when(some, F.col("others"))).alias("others"), F.min_by("fnr", "owner_at").alias("fnr"), F.min("owner_at").alias("posisjon"),
        F.min_by("owner_name", "owner_at").alias("navn"), F.array_sort(F.collect_list(F.when(some, item))).alias("alle"),
    )
    sure = F.when(F.col("numbers") == 0, "ingen").when(F.col("owners") == 1, "merket").when(F.col("owners") > 1, "flertydig").when(F.col("others"), "bare_andre_roller").otherwise("umerket")
    one = F.col("owners") == 1
    rest = F.filter("alle", lambda x: ~((F.col("owners") == 1) & (x["fnr"] == F.col("fnr"))))
    return d.select("doc_id", *(F.when(one, F.col(c)).alias(c) for c in ("navn", "fnr")), sure.alias("sikkerhet"), F.when(one, F.col("posisjon")).alias("posisjon"), rest.alias("andre"))
