"""What a document is and what it concerns: its type by title or body, the benefits it names, and the one it is about."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdossier.functions import automaton
from sparkdossier.functions import text as T

# Benefits, without letters that are spelled in two ways.
BENEFITS = (
    "dagpenger", "grunnstonad", "hjelpestonad", "gravferdsstonad", "sykepenger", "omsorgspenger", "pleiepenger", "opplaeringspenger", "arbeidsavklaringspenger", "tilleggsstonad",
    "uforetrygd", "yrkesskadeerstatning", "foreldrepenger", "svangerskapspenger", "engangsstonad", "overgangsstonad", "gjenlevendepensjon", "barnepensjon", "alderspensjon",
    "uforepensjon", "etterlattepensjon", "attforingspenger", "rehabiliteringspenger", "barnetrygd", "kontantstotte",
)
# Types of documents and the words for each, in the order in which they win ties.
TYPES = {
    "faktura": r"faktura|forfallsdato|\bkid\b",
    "kvittering": r"kvittering|betaling mottatt|kj[øo]pskvittering",
    "vedtak": r"\bvedtak",
    "soknad": r"s(?:ø|oe|o)knad",
    "legeerklaring": r"legeerkl(?:æ|ae|a)ring",
    "inntektsmelding": r"inntektsmelding",
    "sykmelding": r"sykmelding|sjukmelding",
    "klage": r"\bklage[nr]?\b|\bklagar\b|klage p(?:å|aa|a)",
    "egenerklaring": r"egenerkl(?:æ|ae|a)ring",
    "returslipp": r"returslipp|retur[- ]?slipp|dokumentkontroll",
    "kontoutskrift": r"kontoutskrift|kontoutdrag|kontoutskr",
    "meldekort": r"meldekort",
    "pensjonsbrev": r"pensjonsbrev",
    "attest": r"\battest",
    "kontrakt": r"kontrakt|l[æa]rekontrakt|avtale",
    "boardingkort": r"boardingkort|boarding",
    "klagevedtak": r"klagevedtak|vedtak i klagesak|klageavgj(?:ø|oe|o)relse",
    "journalnotat": r"journalnotat|journalf(?:ø|oe|o)rt notat",
    "telefonnotat": r"telefonsamtalenotat|telefonnotat|notat fra telefonsamtale",
    "oppfolgingsnotat": r"oppf(?:ø|oe|o)lgingsnotat|oppf(?:ø|oe|o)lgingssamtale",
    "internvurdering": r"intern vurdering|internvurdering|faglig vurdering|saksvurdering",
    "dokumentasjonskrav": r"dokumentasjonskrav|krav om dokumentasjon|innhenting av dokumentasjon",
    "purring": r"\bpurring|purrebrev|p(?:å|aa)minnelse om",
    "veiledningsbrev": r"veiledningsbrev|orienteringsbrev",
    "arbeidsgiveropplysninger": r"arbeidsgiveropplysninger|opplysninger fra arbeidsgiver",
    "legeopplysninger": r"legeopplysninger|opplysninger fra lege|legeuttalelse",
    "referat": r"\breferat\b|m(?:ø|oe|o)tereferat|dialogm(?:ø|oe|o)tereferat",
    "brev": r"med vennlig hilsen|kj[æa]re",
}
# Types whose forms list benefits that they may be used for; form numbers; lines that are a field; lines of a title.
GENERIC = ("legeerklaring", "egenerklaring")
FORM_NUMBER = r"(?U)\bNAV\s?(\d{2}-\d{2}\.\d{2})\b"
FIELD_LINE = r"(?U)^[\w æøåÆØÅ./-]{2,30}:\s*\S"
TITLE_LINES = 2

_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def stems(words: str) -> list[str]:
    """For each alternative of a type's words the longest plain text in it: what a text must hold for the words to stand in it."""
    out = []
    for alternative in re.split(r"\|(?![^(]*\))", words):
        out.append(max(re.split(r"\\b|\(\?:[^)]*\)|\[[^]]*\]\??", alternative), key=len))
    return out


def spellings(benefit: str) -> set[str]:
    """A benefit's name in both written languages: endings -penger and -pengar, beginnings syke- and sjuke-."""
    out = {benefit} | ({benefit.removesuffix("penger") + "pengar"} if benefit.endswith("penger") else set())
    return out | {"sjuke" + w.removeprefix("syke") for w in out if w.startswith("syke")}


#: Folded spellings and the benefit each stands for.
FORMS = {T.folded(w): b for b in BENEFITS for w in spellings(b)}


def title(text: Column) -> Column:
    """The first two lines that are neither blank, a page marker, nor a field with its value; empty without any."""
    lines = F.transform(F.split(text, _LINES, -1), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\[Side \d+ av \d+\]$") & ~x.rlike(FIELD_LINE))
    return F.coalesce(F.array_join(F.slice(kept, 1, TITLE_LINES), "\n"), F.lit(""))


def type_in_title(low: Column) -> Column:
    """The type whose word comes first in a title in lower case, the longest at one place, then by name; null without one."""
    hits = []
    for kind, words in TYPES.items():
        at = F.regexp_instr(low, F.lit(f"(?U){words}"))
        hits.append(F.when(at > 0, F.struct(at.alias("p"), (-F.length(F.regexp_substr(low, F.lit(f"(?U){words}")))).alias("n"), F.lit(kind).alias("type"))))
    return F.array_min(F.array_compact(F.array(*hits)))["type"]


def type_in_body(low: Column) -> Column:
    """The type whose words stand most often in a text in lower case, the first listed of equals; null where none stands."""
    counts = []
    for i, (kind, words) in enumerate(TYPES.items()):
        # Patterns cost some fifty times what a plain search does, so one runs only where a text holds a stem of its words.
        held = functools.reduce(operator.or_, (low.contains(stem) for stem in stems(words)))
        counts.append(F.when(held, F.struct(F.regexp_count(low, F.lit(f"(?U){words}")).alias("antall"), F.lit(-i).alias("plass"), F.lit(kind).alias("type"))))
    best = F.array_max(F.array_compact(F.array(*counts)))
    return F.when(best["antall"] > 0, best["type"])


def document_types(docs: DataFrame) -> DataFrame:
    """``doc_id, type, kilde`` of each row of ``doc_id, tekst``: by the title if that names a type, else by counts over the whole text.

    ``type`` is empty, and ``kilde`` null, for texts that name no type, null and empty ones among them. Repeated rows stay.
    """
    # Title and text in lower case stand in projections of their own, so that each is computed once a row.
    rows = docs.select("doc_id", F.lower("tekst").alias("lav"), F.lower(title(F.col("tekst"))).alias("tittel")).withColumn("i_tittel", type_in_title(F.col("tittel")))
    rows = rows.withColumn("type", F.when(F.col("i_tittel").isNotNull(), F.col("i_tittel")).otherwise(type_in_body(F.col("lav"))))
    return rows.select("doc_id", F.coalesce("type", F.lit("")).alias("type"), F.when(F.col("i_tittel").isNotNull(), "tittel").when(F.col("type").isNotNull(), "tekst").alias("kilde"))


def _named(hits: Column) -> Column:
    """The benefits of hits, each once, in order of first place."""
    known = F.create_map(*(F.lit(x) for pair in sorted(FORMS.items()) for x in pair))
    return F.array_distinct(F.transform(hits, lambda h: known[h["ord"]]))


def benefits(text: Column) -> Column:
    """All benefits that a text names, in order of first place, in whatever spelling; of names inside one another the longest."""
    return _named(automaton.scan_words(T.fold(text), FORMS))


def read_form_benefits(spark: SparkSession, path: str) -> DataFrame:
    """``nummer, ytelse`` of a rule file of lines ``number = benefit``; ``#`` begins a remark, the last line of a number counts.

    Lines with an unknown benefit, and files that are empty, give no rows.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\uFEFF", ""), r"\r?\n")).alias("linje", "v"))
    rule = lines.select("linje", F.trim(F.split("v", "#")[0]).alias("v")).where(F.col("v").contains("="))
    pairs = rule.select("linje", F.trim(F.substring_index("v", "=", 1)).alias("nummer"), F.lower(F.trim(F.expr("substr(v, instr(v, '=') + 1)"))).alias("ytelse"))
    return pairs.where(F.col("ytelse").isin(*BENEFITS)).groupBy("nummer").agg(F.max_by("ytelse", "linje").alias("ytelse"))


def document_benefits(docs: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """``doc_id, navn, kilde, grunn, kandidater, alle``: the benefit a document concerns, which may not be the one it names most.

    Its printed form number decides, where ``forms`` (``nummer, ytelse``, one row a number) knows it; then the first benefit of the
    title; then the text, if it names only one and is no form for several. Else ``navn`` is null, ``grunn`` says why and
    ``kandidater`` lists what is named. ``alle`` are all benefits of the text. Null and empty texts name none; repeated rows stay.
    """
    number = F.regexp_extract("tekst", FORM_NUMBER, 1)
    rows = docs.select("doc_id", "tekst", F.when(number != "", F.concat(F.lit("NAV "), number)).alias("nummer"), title(F.col("tekst")).alias("tittel"))
    if forms is not None:
        rows = rows.join(forms.select("nummer", F.col("ytelse").alias("av_skjema")), "nummer", "left")
    else:
        rows = rows.withColumn("av_skjema", F.lit(None).cast("string"))
    rows = rows.withColumns({"i_tittel": benefits(F.col("tittel")), "alle": benefits(F.col("tekst")), "lav": F.lower("tekst"), "tittel": F.lower("tittel")})
    open_ = F.col("av_skjema").isNull() & (F.size("i_tittel") == 0) & (F.size("alle") > 0)
    # The type is asked for only where it matters: after a form number, a title or a text without benefits it does not.
    rows = rows.withColumn("type", F.when(open_, F.coalesce(type_in_title(F.col("tittel")), type_in_body(F.col("lav")), F.lit(""))))
    source = (
        F.when(F.col("av_skjema").isNotNull(), "skjemanummer").when(F.size("i_tittel") > 0, "tittel")
        .when(open_ & ~F.col("type").isin(*GENERIC) & (F.size("alle") == 1), "tekst")
    )
    rows = rows.withColumn("kilde", source)
    name = F.when(F.col("kilde") == "skjemanummer", F.col("av_skjema")).when(F.col("kilde") == "tittel", F.get("i_tittel", F.lit(0))).when(F.col("kilde") == "tekst", F.get("alle", F.lit(0)))
    unsure = open_ & F.col("kilde").isNull()
    return rows.select(
        "doc_id", name.alias("navn"), "kilde", F.when(unsure, F.when(F.col("type").isin(*GENERIC), "generisk_blankett").otherwise("flere_i_teksten")).alias("grunn"),
        F.when(unsure, F.col("alle")).otherwise(F.array().cast("array<string>")).alias("kandidater"), "alle",
    )
