"""Joins and folds over positions in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdossier.functions import scanners


def pages(docs: DataFrame) -> DataFrame:
    """``doc_id, side, start, tekst`` of each marked page; texts without markers give none. ``start`` is the marker's place."""
    marker = r"\[Side \d+ av \d+\]"
    parts = F.split("tekst", marker, -1)
    marks = F.regexp_extract_all("tekst", F.lit(r"(\[Side \d+ av \d+\])"), 1)
    rows = docs.select("doc_id", parts.alias("parts"), marks.alias("marks")).where("size(marks) > 0")
    rows = rows.select("doc_id", "parts", "marks", F.posexplode("marks").alias("i", "mark"))
    start = F.expr("aggregate(slice(parts, 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(marks, 1, i), 0, (a, x) -> a + length(x))")
    return rows.select("doc_id", F.regexp_extract("mark", r"Side (\d+)", 1).cast("int").alias("side"), start.cast("long").alias("start"), F.regexp_replace(F.get("parts", F.col("i") + 1), r"^\s+|\s+$", "").alias("tekst"))


def page_of(points: DataFrame, marks: DataFrame, default: int | None = 1) -> DataFrame:
    """As-of join: the page of the last marker at or before each position; before the first one, ``default``.

    Markers and points are merged and sorted by document, so the join is one shuffle on doc_id and no pairs are made.
    """
    a = marks.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("kind"), F.col("side").alias("mark"), F.lit(None).cast("long").alias("id"))
    b = points.select("doc_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("mark"), F.col("id").cast("long").alias("id"))
    w = Window.partitionBy("doc_id").orderBy("pos", "kind", "mark").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("side", F.last("mark", ignorenulls=True).over(w))
    return both.where("kind = 1").select("doc_id", "id", "pos", F.coalesce("side", F.lit(default).cast("int")).alias("side"))


def free_spans(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """Candidates that overlap nothing taken in their document."""
    t = taken.select("doc_id", F.col("start").alias("ts"), F.col("slutt").alias("te"))
    return candidates.join(t, (candidates["doc_id"] == t["doc_id"]) & (F.col("ts") < F.col("slutt")) & (F.col("te") > F.col("start")), "left_anti")


def outermost(matches: DataFrame) -> DataFrame:
    """Matches that lie inside no longer match of their document."""
    o = matches.select("doc_id", F.col("start").alias("os"), F.col("slutt").alias("oe"))
    inside = (F.col("os") <= F.col("start")) & (F.col("oe") >= F.col("slutt")) & (F.col("oe") - F.col("os") > F.col("slutt") - F.col("start"))
    return matches.join(o, (matches["doc_id"] == o["doc_id"]) & inside, "left_anti")


def greedy(spans: DataFrame) -> DataFrame:
    """Spans kept from left to right, the longer first at one start, if they begin at or after the end of the last kept."""
    fold = F.expr(
        "aggregate(s, named_struct('end', -1L, 'kept', slice(s, 1, 0)), (a, x) -> if(x.start >= a.end, named_struct('end', x.slutt, 'kept', concat(a.kept, array(x))), a), a -> a.kept)"
    )
    rows = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (-(F.col("slutt") - F.col("start"))).alias("n"), "slutt"))).alias("s"))
    return rows.select("doc_id", F.explode(fold).alias("x")).select("doc_id", "x.start", "x.slutt")


def best_pages(scored: DataFrame, most: int = 3, least: float = 1.5) -> DataFrame:
    """Up to ``most`` pages per question by score and page; where none or all reach ``least``, every page."""
    q = Window.partitionBy("sporsmal")
    ok = F.col("poeng") >= least
    s = scored.withColumn("n", F.count(F.lit(1)).over(q)).withColumn("k", F.count_if(ok).over(q)).withColumn("rang", F.row_number().over(q.orderBy(F.desc("poeng"), "side")))
    return s.where((F.col("k") == 0) | (F.col("k") == F.col("n")) | (ok & (F.col("rang") <= most))).select("sporsmal", "side", "poeng")


def valid_at(rows: DataFrame, date: str, laws: DataFrame) -> DataFrame:
    """The first statute by id whose validity ``[fra, til)`` holds the row's date; null without one."""
    j = rows.join(F.broadcast(laws), (F.col(date) >= F.col("fra")) & (F.col("til").isNull() | (F.col(date) < F.col("til"))), "left")
    return j.groupBy("doc_id").agg(F.min("lov").alias("lov"))


def missing_fields(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected fields of a document's type that were not found."""
    want = found.select("doc_id", "type").distinct().join(F.broadcast(expected), "type")
    return want.join(found.where("verdi is not null"), ["doc_id", "felt"], "left_anti").select("doc_id", "felt")


def unsupported_numbers(answers: DataFrame, sources: DataFrame, least: int = 3) -> DataFrame:
    """``id, tall``: dates and numbers, as an answer (``id, svar``) writes them, that its source (``id, kilde``) lacks, each once.

    Dates are equal in all spellings. Blanks and dots between digits, zeros at the end of decimals, and a dot or comma before them
    make no difference, but decimals do: 268,00 is 268 and not 26800. A run of blocks also passes if each of its blocks stands in
    the source. Numbers of fewer than ``least`` digits (decimals among them) are not asked for. An answer without a source has no
    support; null texts have no numbers. Rows that repeat an id are one answer, and one source.
    """
    stated = answers.select("id", F.explode(scanners.scan("stated", F.col("svar"))).alias("x")).select("id", "x.*")
    stated = stated.where(F.length(F.regexp_replace("tall", r"\D", "")) >= least)
    # A number counts as whole (part 0) or by its blocks: it lacks support if both its whole and one of its blocks are unknown.
    parts = stated.select("id", "raa", F.posexplode(F.concat(F.array("tall"), "deler")).alias("del", "tall"))
    known = sources.where("id is not null").select("id", F.explode(scanners.scan("known", F.col("kilde"))).alias("tall"))
    # Rows that repeat change none of the three answers below, so nothing is made distinct, and one shuffle serves both groupings.
    both = parts.unionByName(known, allowMissingColumns=True).repartition("id")
    found = both.withColumn("kjent", F.max(F.col("raa").isNull()).over(Window.partitionBy("id", "tall"))).where("raa is not null")
    whole = F.col("del") == 0
    seen = found.groupBy("id", "raa").agg(F.bool_or(whole & F.col("kjent")).alias("hele"), F.count_if(~whole).alias("n"), F.count_if(~whole & F.col("kjent")).alias("k"))
    return seen.where(~F.col("hele") & ((F.col("n") == 0) | (F.col("k") < F.col("n")))).select("id", F.col("raa").alias("tall"))
