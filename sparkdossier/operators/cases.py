"""Cases: documents grouped by shared keys, their timeline, contradictions and summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdossier.operators.graph import connected_components
from sparkdossier.session import cut, written

# Labelled amounts that are compared, and type pairs of which the second cannot come first.
AMOUNTS = ("dagsats", "manedsbelop", "utbetalt_belop", "tilbakebetalingsbelop")
ORDER_RULES = (("klage", "klagevedtak"), ("soknad", "vedtak"), ("dokumentasjonskrav", "purring"))
KEYS = ("saksnummer", "journalnummer")


def key_value(c: str) -> F.Column:
    """A key without white space; empty is none."""
    v = F.regexp_replace(F.col(c), r"(?U)\s", "")
    return F.when(v != "", v)


def event_date() -> F.Column:
    return F.coalesce("dato", "behandlingsdato")


def group_cases(docs: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``sak``: the least doc_id among all that share a key, directly or by way of others.

    With ``within``, only keys of documents that agree in those columns (a folder, say) count as shared.

    Each key value stands for its least document, its head, so no pairs are made. Components are sought among heads only, over
    those documents that have two: a document takes the case of its least head. A document without keys is a case of its own.
    """
    marks = docs.select("doc_id", *within, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), key_value(k).alias("v")) for k in KEYS])).alias("x"))
    marks = marks.select("doc_id", *within, "x.k", "x.v").where("v is not null and doc_id is not null")
    heads = marks.groupBy(*within, "k", "v").agg(F.min("doc_id").alias("head"))
    headed = marks.join(heads, [*within, "k", "v"]).select("doc_id", "head")
    by = Window.partitionBy("doc_id")
    headed = headed.select("doc_id", "head", F.min("head").over(by).alias("least"), F.row_number().over(by.orderBy("head")).alias("nr"))
    headed, _ = written(headed, "heads")
    found = connected_components(headed.where("head <> least").select("head", "least").distinct(), "head", "least")
    own = headed.where("nr = 1").select("doc_id", "least").join(found.withColumnRenamed("node", "least"), "least", "left")
    own = own.select("doc_id", F.coalesce("component", "least").alias("component"))
    return docs.join(own, "doc_id", "left").withColumn("sak", F.coalesce("component", "doc_id")).drop("component")


def case_names(cased: DataFrame) -> DataFrame:
    """Per case the name of its strongest key: the least case number, else the least journal number."""
    low = cased.groupBy("sak").agg(*[F.min(key_value(k)).alias(k) for k in KEYS], F.count(F.lit(1)).alias("dokumenter"))
    field = F.when(F.col("saksnummer").isNotNull(), "saksnummer").when(F.col("journalnummer").isNotNull(), "journalnummer")
    return low.select("sak", field.alias("felt"), F.coalesce(*KEYS).alias("verdi"), "dokumenter")


def person_relations(cased: DataFrame) -> DataFrame:
    """Persons found in two or more cases; the cases are related, not merged."""
    pairs = cased.where("fnr is not null").select("fnr", "sak").distinct()
    return pairs.groupBy("fnr").agg(F.count(F.lit(1)).alias("antall_saker"), F.min("sak").alias("forste"), F.max("sak").alias("siste")).where("antall_saker >= 2")


def timeline(cased: DataFrame) -> DataFrame:
    """Dated events of each case in order of date, file and document, with the kind of date."""
    dated = cased.withColumn("hendelsesdato", event_date()).where("hendelsesdato is not null")
    place = Window.partitionBy("sak").orderBy("hendelsesdato", "filnavn", "doc_id")
    kind = F.when(F.col("dato").isNotNull(), "dokumentdato").otherwise("behandlingsdato")
    return dated.select("sak", "doc_id", "hendelsesdato", kind.alias("dato_kilde"), "type", F.row_number().over(place).cast("int").alias("nr"))


def several_persons(cased: DataFrame) -> DataFrame:
    return (
        cased.groupBy("sak").agg(F.count_distinct("fnr").alias("n")).where("n > 1")
        .select("sak", F.lit("flere_personer").alias("sjekk"), F.lit("").alias("felt"), F.lit(None).cast("date").alias("dato"), "n")
    )


def impossible_order(cased: DataFrame) -> DataFrame:
    """Cases in which the earliest of a later kind comes before the earliest of the kind it answers."""
    first = cased.withColumn("d", event_date()).groupBy("sak").agg(*[F.min(F.when(F.col("type") == t, F.col("d"))).alias(t) for pair in ORDER_RULES for t in pair])
    rows = F.array(*[F.when(F.col(b) < F.col(a), F.struct(F.lit(f"{a}<{b}").alias("felt"), F.col(b).alias("dato"))) for a, b in ORDER_RULES])
    found = first.select("sak", F.explode(F.array_compact(rows)).alias("x"))
    return found.select("sak", F.lit("umulig_rekkefolge").alias("sjekk"), "x.felt", "x.dato", F.lit(1).cast("long").alias("n"))


def unequal_amounts(cased: DataFrame) -> DataFrame:
    """The same labelled amount with different values in documents of one case and date."""
    long = cased.withColumn("d", event_date()).where("d is not null").unpivot(["sak", "d"], list(AMOUNTS), "felt", "verdi").where("verdi is not null")
    grouped = long.groupBy("sak", "felt", "d").agg(F.count_distinct(F.round("verdi", 2)).alias("n")).where("n > 1")
    return grouped.select("sak", F.lit("ulikt_belop").alias("sjekk"), "felt", F.col("d").alias("dato"), "n")


def findings(cased: DataFrame) -> DataFrame:
    """Findings of the three checks, by two aggregates: one by case for persons and order, one by case and day for amounts.

    ``cased`` is read twice; write it first where it is dear (``contradictions`` does).
    """
    kinds = sorted({t for pair in ORDER_RULES for t in pair})
    g = cased.withColumn("d", event_date()).groupBy("sak").agg(F.count_distinct("fnr").alias("n"), *[F.min(F.when(F.col("type") == t, F.col("d"))).alias(t) for t in kinds])
    none = F.lit(None).cast("date")
    row = lambda check, field, date, n: F.struct(F.lit(check).alias("sjekk"), F.lit(field).alias("felt"), date.alias("dato"), n.alias("n"))
    persons = F.when(F.col("n") > 1, row("flere_personer", "", none, F.col("n")))
    order = [F.when(F.col(b) < F.col(a), row("umulig_rekkefolge", f"{a}<{b}", F.col(b), F.lit(1).cast("long"))) for a, b in ORDER_RULES]
    by_case = g.select("sak", F.explode(F.array_compact(F.array(persons, *order))).alias("x")).select("sak", "x.sjekk", "x.felt", "x.dato", "x.n")
    return by_case.unionByName(unequal_amounts(cased))


def contradictions(cased: DataFrame) -> DataFrame:
    """Findings of the three checks, over what they need of the cases, written once."""
    return findings(cut(cased.select("sak", "fnr", "type", "dato", "behandlingsdato", *AMOUNTS)))


def summaries(cased: DataFrame) -> DataFrame:
    """Party (only if one person), counts, whether appealed, and the latest decision of each case."""
    d = cased.withColumn("d", event_date())
    decision = F.col("type").isin("vedtak", "klagevedtak") & F.col("d").isNotNull()
    last = F.max(F.when(decision, F.struct("d", "filnavn", "type")))
    out = d.groupBy("sak").agg(
        F.count(F.lit(1)).alias("antall_dokumenter"), F.count_distinct("fnr").alias("antall_personer"), F.min("fnr").alias("fnr"),
        F.max((F.col("type") == "klage") & F.col("d").isNotNull()).alias("klaget"), last.alias("siste"), F.min("d").alias("fra"), F.max("d").alias("til"),
    )
    return out.select(
        "sak", "antall_dokumenter", "antall_personer", F.when(F.col("antall_personer") == 1, F.col("fnr")).alias("part"), "klaget",
        F.col("siste.type").alias("avgjorelse"), F.col("siste.d").alias("avgjort"), "fra", "til",
    )
