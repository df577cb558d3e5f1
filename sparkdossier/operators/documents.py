"""Dates, periods, sub-documents, pages and regions of documents; answers and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def age(date: Column, as_of: str) -> tuple[Column, Column, Column]:
    """Days, years of 365.25 days to two places, and whether the date is to come."""
    days = F.datediff(F.lit(as_of).cast("date"), date)
    return days, F.round(days / 365.25, 2), days < 0


def best_date(dates: DataFrame, keep: int = 5) -> DataFrame:
    """The document's date by rank, first page first, then order; with its alternatives' number."""
    w = Window.partitionBy("doc_id").orderBy("rang", F.col("side") != 1, "nr")
    d = dates.withColumn("plass", F.row_number().over(w)).where(F.col("plass") <= keep + 1)
    return d.groupBy("doc_id").agg(F.max(F.when(F.col("plass") == 1, F.col("dato"))).alias("dato"), (F.count(F.lit(1)) - 1).alias("alternativer"))


def periods(dates: DataFrame) -> DataFrame:
    """Each period end with the last start before it."""
    w = Window.partitionBy("doc_id").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("type") == "start", F.col("dato")), ignorenulls=True).over(w)
    return dates.withColumn("fra", start).where("type = 'slutt' and fra is not null").select("doc_id", "nr", "fra", F.col("dato").alias("til"))


def subdocuments(pages: DataFrame) -> DataFrame:
    """Pages numbered by document of the bundle: a new one begins at another title or at another date of its own."""
    w = Window.partitionBy("doc_id").orderBy("side")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    title, date = F.last("tittel", ignorenulls=True).over(before), F.last("dato", ignorenulls=True).over(before)
    new = (F.col("tittel") != title) | (F.col("dato") != date) | (F.row_number().over(w) == 1)
    marked = pages.withColumn("ny", F.coalesce(new, F.lit(False)).cast("int"))
    return marked.withColumn("nr", F.sum("ny").over(w)).groupBy("doc_id", "nr").agg(F.min("side").alias("fra"), F.max("side").alias("til"), F.count(F.lit(1)).alias("sider"))


def suppress(regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Regions by falling confidence, without those that overlap a kept one by more than ``share`` of the smaller."""
    inside = "(greatest(0D, least(x.x1, y.x1) - greatest(x.x0, y.x0)) * greatest(0D, least(x.y1, y.y1) - greatest(x.y0, y.y0)))"
    least = "least((x.x1 - x.x0) * (x.y1 - x.y0), (y.x1 - y.x0) * (y.y1 - y.y0))"
    fold = F.expr(f"aggregate(r, slice(r, 1, 0), (a, x) -> if(exists(a, y -> {inside} > {share}D * {least}), a, concat(a, array(x))))")
    rows = regions.groupBy("side").agg(F.array_sort(F.collect_list(F.struct((-F.col("konfidens")).alias("k"), "id", "x0", "y0", "x1", "y1"))).alias("r"))
    return rows.select("side", F.explode(fold).alias("x")).select("side", "x.id")


def regions_of(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages with the number of regions that their findings overlap; pages without are kept."""
    r = regions.select(F.col("doc_id").alias("rd"), F.col("start").alias("rs"), F.col("slutt").alias("re"))
    j = findings.join(r, (F.col("doc_id") == F.col("rd")) & (F.col("rs") < F.col("slutt")) & (F.col("start") < F.col("re")), "left")
    return j.groupBy("doc_id", "start", "slutt").agg(F.count("rd").alias("regioner"))


def single_type(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Routes a question to the one document of the one type it names; others are not routed."""
    types = docs.groupBy("sak", "type").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return questions.join(types, ["sak", "type"]).select("sporsmal", "doc_id")


def same_person(a: Column, b: Column) -> Column:
    """Null where either side has no person."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))


def evidence(rows: DataFrame) -> DataFrame:
    """Precision, recall and share of complete evidence of chosen pages against the key; rows without a key are left out."""
    hit = F.size(F.array_intersect("valgt", "fasit"))
    r = rows.where("size(fasit) > 0").select(F.try_divide(hit, F.size("valgt")).alias("p"), (hit / F.size("fasit")).alias("r"), (hit == F.size("fasit")).cast("double").alias("k"))
    return r.agg(F.round(F.avg("p"), 4).alias("presisjon"), F.round(F.avg("r"), 4).alias("recall"), F.round(F.avg("k"), 4).alias("komplett"), F.count(F.lit(1)).alias("antall"))


def period_of(dates: DataFrame) -> DataFrame:
    """First and last date, their number, and whether a bundle holds several documents, of ``dates`` (``doc_id, nr, side, dato``).

    Windows that follow one order by document: rows dealt by doc_id and sorted by doc_id and nr are neither dealt nor sorted again.
    What is held at a time is the different dates and pages of one document.
    """
    by = Window.partitionBy("doc_id")
    different = lambda c: F.size(F.collect_set(c).over(by)).cast("long")
    d = dates.select("doc_id", F.min("dato").over(by).alias("fra"), F.max("dato").over(by).alias("til"), different("dato").alias("datoer"), different("side").alias("sider"), F.row_number().over(by.orderBy("nr")).alias("rn"))
    return d.where("rn = 1").drop("rn").withColumn("flere", (F.col("datoer") > 1) & (F.col("sider") > 1))


def same_value(a: Column, b: Column) -> Column:
    """Numbers within 0.005; two nulls are equal."""
    return F.coalesce(F.abs(a - b) < 0.005, a.isNull() & b.isNull())


def differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Paths at which two tables differ, with both values."""
    long = lambda df, name: df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "sti", name)
    j = long(a, "venstre").join(long(b, "hoyre"), [*keys, "sti"], "full_outer")
    return j.where(~F.col("venstre").eqNullSafe(F.col("hoyre")))


def page_scores(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Sum over a question's words found on a page of 1 + min(length, 12) / 12."""
    tokens = pages.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("tekst"), r"[^\p{L}\d]+"))).alias("ord"))
    hit = tokens.join(F.broadcast(words), "ord").groupBy("sporsmal", "doc_id")
    return hit.agg(F.round(F.sum(1 + F.least(F.length("ord"), F.lit(12)) / 12), 3).alias("poeng"))


def coverage(pages: DataFrame) -> DataFrame:
    """Whether all pages of a document were read: full, partial, or unknown without a page count."""
    g = pages.groupBy("doc_id").agg(F.count_distinct(F.when(F.trim("tekst") != "", F.col("side"))).alias("lest"), F.max("antall").alias("antall"))
    return g.withColumn("dekning", F.when(F.col("antall").isNull(), "ukjent").when(F.col("lest") >= F.col("antall"), "full").otherwise("delvis"))


def precheck(rows: DataFrame, by: str) -> DataFrame:
    """``god`` where every check passes, ``avvis`` where a hard one fails, else ``tvilsom``."""
    g = rows.groupBy(by).agg(F.bool_and("ok").alias("alle"), F.bool_or(~F.col("ok") & F.col("hard")).alias("stopp"))
    return g.select(by, F.when(F.col("stopp"), "avvis").when(F.col("alle"), "god").otherwise("tvilsom").alias("dom"))


def first_request(requests: DataFrame, key: str, order: str) -> DataFrame:
    """The first request of each key; later ones replay its answer."""
    return requests.groupBy(key).agg(F.min(order).alias("forste"), (F.count(F.lit(1)) - 1).alias("gjentatt"))


def review(rows: DataFrame) -> DataFrame:
    """Who looks at a reading: handwriting, hardly any text or low confidence go to a person, a middle band only if a field lacks."""
    send = F.col("handskrift") | (F.col("tegn") < 20) | (F.col("konfidens") < 0.6) | ((F.col("konfidens") < 0.85) & (F.col("mangler") > 0))
    return rows.where("ocr").withColumn("sendes", send)


def selected_text(pages: DataFrame, most: int) -> DataFrame:
    """Chosen pages of a document in order, each below its marker."""
    block = F.concat(F.lit("[Side "), F.col("side").cast("string"), F.lit(" av "), F.lit(most).cast("string"), F.lit("]\n"), F.col("tekst"))
    g = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("side", block.alias("b")))).alias("x"))
    return g.select("doc_id", F.array_join(F.col("x.b"), "\n").alias("tekst"))
