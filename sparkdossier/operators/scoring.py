"""Scoring against answer keys, calibration pairs, and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcomes(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Outcome of each expected field: ``exact`` and ``contains`` keys against the found text, ``count`` against its number."""
    j = expected.join(found, ["doc_id", "felt"], "left")
    right = F.when(F.col("art") == "exact", F.col("verdi") == F.col("fasit")).when(F.col("art") == "contains", F.contains("verdi", "fasit")).when(F.col("art") == "count", F.col("antall") == F.col("fasit").try_cast("int"))
    out = F.when(F.col("verdi").isNull(), "mangler").when(right, "riktig").otherwise("galt")
    return j.select("doc_id", "felt", out.alias("utfall"))


def totals(rows: DataFrame) -> DataFrame:
    """Questions passed, split by who answered."""
    return rows.groupBy("svares_av").agg(F.count(F.lit(1)).alias("antall"), F.count_if("bestatt").alias("bestatt"))


def calibration_pairs(tasks: DataFrame) -> DataFrame:
    """Reason for which a corrected task gives no pair, or ``par``, counted."""
    c = F.col("konfidens") / 100
    reason = (
        F.when(F.col("konfidens").isNull(), "mangler_konfidens").when(F.coalesce(F.trim("rettet"), F.lit("")) == "", "ingen_retting")
        .when((c < 0) | (c > 1), "utenfor").otherwise("par")
    )
    return tasks.groupBy(reason.alias("grunn")).agg(F.count(F.lit(1)).alias("antall"), F.count_if((reason == "par") & (F.levenshtein("lest", "rettet") == 0)).alias("riktige"))


def valid_case_id(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^[0-9a-f]{1,64}$"), F.lit(False))


def code_pair(rows: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """A code with its term; a code that is not in the table gives a pair of nulls, never a null pair."""
    t = terms.select(F.col("kode").alias("t_kode"), "term")
    return rows.join(F.broadcast(t), F.col(key) == F.col("t_kode"), "left").withColumn("par", F.struct(F.col("t_kode").alias("kode"), "term")).drop("t_kode", "term")


def date_pairs(dates: DataFrame) -> DataFrame:
    """Neighbouring dates with at most eight characters between them, among these a dash or ``til``: a period."""
    w = Window.partitionBy("doc_id").orderBy("start")
    d = dates.withColumn("til", F.lead("dato").over(w)).withColumn("neste", F.lead("start").over(w))
    between = F.expr("substring(tekst, slutt + 1, neste - slutt)")
    return d.where((F.col("neste") - F.col("slutt") <= 8) & between.rlike(r"[-–—]|til")).select("doc_id", F.col("dato").alias("fra"), "til")


def loosely_equal(answer: Column, key: Column) -> Column:
    """Whether the key stands in the answer, case, blanks between digits and blanks as such apart."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?<=\d)[ .](?=\d{3})", ""), r"\s+", " "))
    return F.contains(norm(answer), norm(key))


def resolve(references: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each reference with its one law, ``flertydig`` for several, ``ukjent`` for none."""
    g = references.join(F.broadcast(chapters), "paragraf", "left").groupBy("id").agg(F.count_distinct("lov").alias("n"), F.min("lov").alias("lov"))
    return g.select("id", F.when(F.col("n") == 1, F.col("lov")).when(F.col("n") > 1, "flertydig").otherwise("ukjent").alias("lov"))


def cached(requests: DataFrame) -> DataFrame:
    """Requests by content hash and parameters: how many were read and how many answered from the cache."""
    key = F.sha2(F.concat_ws("|", "innhold", "parametre"), 256)
    return requests.groupBy(key.alias("nokkel")).agg(F.lit(1).cast("long").alias("lest"), (F.count(F.lit(1)) - 1).alias("fra_lager"))


def count_persons(found: DataFrame) -> DataFrame:
    """Numbers found by type, and distinct ones, per document."""
    return found.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("type") == "fnr", F.col("tall"))).alias("personer"), F.count(F.lit(1)).alias("treff"))
