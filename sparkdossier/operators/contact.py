"""Contact data, currencies, words but for inflection, rectangles and answer pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdossier.functions import scanners


def phones(text: Column) -> Column:
    """Telephone numbers without blanks, in order, each once; not after a label of another number."""
    return F.array_distinct(F.transform(scanners.scan("phones", text), lambda x: x["tall"]))


def currency(text: Column) -> Column:
    """The first code, NOK for a bare ``kr``, null without a mark."""
    hit = F.regexp_extract(text, r"(?i)\b(NOK|SEK|DKK|EUR|USD|GBP|kr)\b", 1)
    return F.when(hit == "", None).when(F.lower(hit) == "kr", "NOK").otherwise(F.upper(hit))


def post_places(text: Column) -> Column:
    """``nnnn PLACE`` that stand on a line of their own, as ``nnnn place``."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^(\d{4} [A-ZÆØÅ][A-Za-zÆØÅæøå ]{1,30})$"), 1)


def same_word(asked: Column, found: Column) -> Column:
    """One word but for inflection, letters of either spelling alike.

    Words of four letters or more are the same if the found one begins with the asked, or if they share at least five letters from
    the start and 70 % of the shorter; where the asked one goes on behind the whole of the found, of the asked.
    """
    spelled = lambda c: F.replace(F.replace(F.replace(c, F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("oe")), F.lit("å"), F.lit("aa"))
    a, b = spelled(asked), spelled(found)
    n = F.least(F.length(a), F.length(b))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    share = shared >= 0.7 * F.when(F.startswith(a, b), F.length(a)).otherwise(n)
    return (a == b) | ((n >= 4) & (F.startswith(b, a) | ((shared >= 5) & share)))


def rectangles(regions: DataFrame) -> DataFrame:
    """Boxes as percent of their page with a label by confidence and script; empty boxes are left out."""
    label = F.when(F.col("konfidens") < 0.35, "Uleselig").when(F.col("skrift") == "handskrift", "Håndskrift").otherwise("Trykt tekst")
    pct = lambda a, b: F.round(100.0 * a / b, 4)
    return regions.where("x1 > x0 and y1 > y0").select(
        "id", pct(F.col("x0"), F.col("bredde")).alias("x"), pct(F.col("y0"), F.col("hoyde")).alias("y"), pct(F.col("x1") - F.col("x0"), F.col("bredde")).alias("width"),
        pct(F.col("y1") - F.col("y0"), F.col("hoyde")).alias("height"), label.alias("etikett"), F.round("konfidens", 3).alias("score"),
    )


def answer_pages(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that hold a question's key strings: none on purpose for negative questions, null where underivable."""
    total = pages.groupBy("doc_id").agg(F.count_distinct("side").alias("alle"))
    hit = questions.where("type <> 'negativ' and length(bit) >= 3").join(pages, "doc_id").where(F.contains("tekst", "bit")).groupBy("sporsmal").agg(F.array_sort(F.collect_set("side")).alias("treff"))
    q = questions.select("sporsmal", "doc_id", "type").distinct().join(total, "doc_id").join(hit, "sporsmal", "left")
    few = F.when(F.size("treff") * 2 <= F.col("alle"), F.array_join("treff", ","))
    return q.select("sporsmal", F.when(F.col("type") == "negativ", "").otherwise(few).alias("sider"))
