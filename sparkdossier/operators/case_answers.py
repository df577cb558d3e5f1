"""What is known of a case from the kinds and dates of its documents, and the answers that follow from that alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdossier.operators.cases import event_date, key_value

# Names of states, the kinds of document that ask for papers, and what each sort of question looks like, in the
# order in which they are tried.
STATES = {
    "avgjort_etter_klage": "Avgjort etter klage",
    "avgjort": "Avgjort",
    "venter_paa_dokumentasjon": "Venter på dokumentasjon",
    "under_behandling": "Under behandling",
    "ukjent": "Ukjent",
}
ASKING = ("dokumentasjonskrav", "purring")
QUESTIONS = {
    "utfall": r"\b(hva ble (det|utfallet|resultatet)|hvordan (endte|gikk) (det|saken)|siste vedtak|endelig (vedtak|avgj[øo]relse)|til slutt)\b",
    "part": r"\b(hvem (gjelder|handler|er parten)|hvilken person|hvem er saken om)\b",
    "klage": r"\b(ble det klaget|er det (en )?klage|har (bruker|han|hun|parten) klaget)\b",
    "mangler": r"\b(hva mangl\w+|hvilke dokumenter mangl\w+|er noe ufullstendig)\b",
    "motsigelse": r"\b(motsier|motsigelse\w*|stemmer (ikke|alt)|er det (noe )?feil)\b",
    "status": r"\b(hvor st[åa]r saken|status(en)? (i|p[åa]) saken|hva er status)\b",
}
#: Kinds of document that move a case.
MOVING = ("soknad", "vedtak", "klage", "klagevedtak", "dokumentasjonskrav", "purring")


def document_name() -> Column:
    """The file's name, else the title, else that there is none; empty ones are none."""
    filled = [F.when(F.col(c) != "", F.col(c)) for c in ("filnavn", "tittel")]
    return F.coalesce(*filled, F.lit("dokument uten navn"))


def course(cased: DataFrame) -> DataFrame:
    """``sak, dato, type, dokument`` of the dated documents that move a case; sort by date and document to read it."""
    d = cased.where(F.col("type").isin(*MOVING)).select("sak", event_date().alias("dato"), "type", document_name().alias("dokument"))
    return d.where("dato is not null")


def missing_fields(cased: DataFrame) -> DataFrame:
    """``sak, dokument, type, mangler`` of the documents that lack fields expected of their type (``mangler``, an array)."""
    return cased.where(F.size("mangler") > 0).select("sak", document_name().alias("dokument"), "type", "mangler")


def case_states(cased: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row for each case: whom and which benefit it is about, its last decision, where it stands, and why.

    ``cased`` holds ``sak, filnavn, tittel, type, dato, behandlingsdato, fnr, ytelse, mangler``; ``findings`` the
    contradictions (``sak``), if they were looked for. All is one aggregate by case, whose largest value is the set of days on
    which an appeal came in. The person and the benefit are null unless the documents agree; a decision on an appeal stands
    before any other, whatever its date; documents without a date decide nothing.
    """
    kind, person = F.col("type"), key_value("fnr")
    d = cased.withColumn("_d", event_date())
    last = lambda *kinds: F.max(F.when(kind.isin(*kinds) & F.col("_d").isNotNull(), F.struct("_d", document_name().alias("navn"))))
    g = d.groupBy("sak").agg(
        F.count(F.lit(1)).alias("antall_dokumenter"), F.min(person).alias("_p0"), F.max(person).alias("_p1"), F.count_distinct(person).alias("antall_personer"), F.count(person).alias("_med"),
        F.min(F.when(F.col("ytelse") != "", F.col("ytelse"))).alias("_y0"), F.max("ytelse").alias("_y1"), last("klagevedtak").alias("_k"), last("vedtak").alias("_v"),
        F.max(F.when(kind.isin(*ASKING), F.col("_d"))).alias("_asked"), F.coalesce(F.max((kind == "soknad") & F.col("_d").isNotNull()), F.lit(False)).alias("_applied"),
        F.array_sort(F.collect_set(F.when(kind == "klage", F.col("_d")))).alias("klagedatoer"), F.count_if(F.size("mangler") > 0).alias("ufullstendige"),
    )
    decided = F.coalesce("_k", "_v")
    waits = F.col("_asked").isNotNull() & (decided.isNull() | (decided["_d"] < F.col("_asked")))
    state = (
        F.when(F.col("_k").isNotNull(), "avgjort_etter_klage").when(waits, "venter_paa_dokumentasjon").when(decided.isNotNull(), "avgjort")
        .when(F.col("_applied"), "under_behandling").otherwise("ukjent")
    )
    date = decided["_d"].cast("string")
    why = (
        F.when(F.col("_k").isNotNull(), F.format_string("Klageinstansen har avgjort saken (%s).", date))
        .when(waits, F.format_string("Dokumentasjon ble etterspurt %s, og ingen avgjørelse er datert etter det.", F.col("_asked").cast("string")))
        .when(decided.isNotNull(), F.format_string("Vedtak datert %s, og ingen klage er avgjort etter det.", date))
        .when(F.col("_applied"), "Søknad finnes, men ingen avgjørelse.")
        .otherwise("Ingen av dokumentene avgjør noe, og ingen søknad er datert. Saken kan ikke plasseres.")
    )
    ground = (
        F.when(F.col("antall_personer") == 0, "Ingen av dokumentene bærer et fødselsnummer under en etikett som viser hvem saken gjelder.")
        .when(F.col("antall_personer") == 1, F.format_string("Fastslått av %d dokument(er) med samme fødselsnummer.", "_med"))
        .otherwise(F.format_string("Saken bærer %d ulike fødselsnummer — hvem den gjelder kan ikke avgjøres. Se «motsigelser».", "antall_personer"))
    )
    out = g.select(
        "sak", "antall_dokumenter", "antall_personer", F.when(F.col("antall_personer") == 1, F.col("_p0")).alias("part"), ground.alias("grunnlag"),
        F.when(F.col("_y0") == F.col("_y1"), F.col("_y0")).alias("ytelse"), "klagedatoer", (F.size("klagedatoer") > 0).alias("klaget"),
        F.when(F.col("_k").isNotNull(), "klagevedtak").when(F.col("_v").isNotNull(), "vedtak").alias("avgjorelse"), decided["_d"].alias("avgjort"), decided["navn"].alias("avgjort_i"),
        state.alias("status"), why.alias("begrunnelse"), "ufullstendige",
    )
    if findings is None:
        return out.withColumn("motsigelser", F.lit(0).cast("long"))
    found = findings.groupBy("sak").agg(F.count(F.lit(1)).alias("_n"))
    return out.join(found, "sak", "left").withColumn("motsigelser", F.coalesce("_n", F.lit(0))).drop("_n")


def question_kind(question: Column) -> Column:
    """The first sort of question that the text is, or null where none of them is met."""
    low = F.coalesce(question, F.lit(""))
    return F.coalesce(*[F.when(F.rlike(low, F.lit("(?iuU)" + p)), k) for k, p in QUESTIONS.items()])


def state_name(code: Column) -> Column:
    return F.coalesce(*[F.when(code == k, v) for k, v in STATES.items()])


def answers(questions: DataFrame, states: DataFrame) -> DataFrame:
    """``sporsmal_id, sak, svartype, svar`` for questions (``sporsmal_id, sak, sporsmal``) that the state of the case answers.

    Others, and questions about a case that is not there, have nulls: they are for a model. Which documents lack what is a
    table of its own (``sources``), since the answer of a large case would hold them all.
    """
    j = questions.select("sporsmal_id", "sak", question_kind(F.col("sporsmal")).alias("svartype")).join(states, "sak", "left")
    name = state_name(F.col("status"))
    decision = F.concat(F.initcap("avgjorelse"), F.lit(" datert "), F.col("avgjort").cast("string"), F.lit(" er den som gjelder. Status: "), name, F.lit(" — "), F.col("begrunnelse"))
    text = {
        "utfall": F.when(F.col("avgjorelse").isNull(), F.concat(F.lit("Ingen av dokumentene i saken avgjør noe. "), F.col("begrunnelse"))).otherwise(decision),
        "part": F.when(F.col("part").isNull(), F.concat(F.lit("Hvem saken gjelder kan ikke fastslås. "), F.col("grunnlag")))
        .otherwise(F.concat(F.lit("Saken gjelder personen med fødselsnummer "), F.col("part"), F.lit(". "), F.col("grunnlag"))),
        "klage": F.when(F.col("klaget"), F.concat(F.lit("Ja, det er klaget i saken ("), F.array_join(F.col("klagedatoer").cast("array<string>"), ", "), F.lit(").")))
        .otherwise("Nei, ingen klage finnes blant dokumentene i saken."),
        "mangler": F.when(F.col("ufullstendige") > 0, F.format_string("%d dokument(er) mangler felter som er målt for typen sin.", "ufullstendige")).otherwise(
            "Ingen av dokumentene mangler noen av de feltene som er MÅLT for typen sin. Det er ikke det samme som at saken er komplett — bare målte felter kan mangle."
        ),
        "motsigelse": F.when(F.col("motsigelser") > 0, F.format_string("Ja — %d motsigelse(r) ble funnet. Se «motsigelser» for hver enkelt med begrunnelse.", "motsigelser"))
        .otherwise("Ingen av de motsigelsene systemet kan bevise ble funnet. Se «motsigelser.sjekket» for hva som faktisk ble undersøkt."),
        "status": F.concat(name, F.lit(" — "), F.col("begrunnelse")),
    }
    known = F.col("status").isNotNull()
    answer = F.coalesce(*[F.when(known & (F.col("svartype") == k), v) for k, v in text.items()])
    return j.select("sporsmal_id", "sak", F.when(known, F.col("svartype")).alias("svartype"), answer.alias("svar"))


def sources(answered: DataFrame, states: DataFrame, cased: DataFrame) -> DataFrame:
    """``sporsmal_id, dokument, tekst``: a row for each document that an answer rests on, with what it lacks where that was asked."""
    none = F.lit(None).cast("string")
    rests = (
        states.where("avgjort_i is not null").select("sak", F.lit("utfall").alias("svartype"), F.col("avgjort_i").alias("dokument"), none.alias("tekst"))
        .unionByName(course(cased).where("type = 'klage'").select("sak", F.lit("klage").alias("svartype"), "dokument", none.alias("tekst")))
        .unionByName(missing_fields(cased).select("sak", F.lit("mangler").alias("svartype"), "dokument", F.array_join("mangler", ", ").alias("tekst")))
    )
    return answered.join(rests, ["sak", "svartype"]).select("sporsmal_id", "dokument", "tekst")
