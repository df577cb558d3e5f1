"""License scans by diagonal voting, in DataFrame expressions only.

Every run of two words of a text is hashed and joined to the positions of template phrases. A match, whose words are compared
themselves, at text position p and template position q votes for the diagonal p - q. Votes are gathered by text, template and
diagonal as a set of template positions; diagonals of a template that lie close to each other (words put in or left out) are
merged, and so are their sets: a position that several diagonals matched counts once. A merged island stands if enough of the
template's positions are in the set of its best window, the first of those not much longer than the template that has most.
Base phrases allow no gap and no missing word.

Runs of common words alone find nothing: a text takes part from the first run that has a long word or a license's name, and
so does a diagonal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False


#: Base phrases and their labels, then license notices as their licenses word them.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
#: Share of a template's runs that a notice must show, the gap between diagonals that are merged, and how many times its
#: own length a span may have.
COVERAGE, GAP, STRETCH = 0.8, 3, 2
#: A run is telling if one of its words has so many letters or is among the names of licenses.
LONG_WORD = 6
NAMES = ("mit", "gnu", "cc", "bsd", "nc", "sa", "by")


def template_runs(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, int, str, int, int, str, bool, bool]]:
    """``t, q, gram, runs, span, label, base, telling`` of every run of every template.

    A template has at most 63 runs (a set of its positions is one long), and one that is telling at least.
    """
    rows = []
    for t, x in enumerate(templates):
        w = x.words.split()
        runs = [w[q : q + K] for q in range(len(w) - K + 1)]
        telling = [x.base or any(len(v) >= LONG_WORD or v in NAMES for v in r) for r in runs]
        if not 0 < len(runs) < 64 or not any(telling):
            raise ValueError(f"a template needs 1 to 63 runs, one of them telling: {x.words!r}")
        rows += [(t, q, " ".join(r), len(runs), len(w), x.label, x.base, telling[q]) for q, r in enumerate(runs)]
    return rows


def template_values(templates: tuple[Template, ...] = TEMPLATES) -> str:
    return ", ".join(f"({t}, {q}, '{gram}', {runs}, {span}, '{label}', {base}, {telling})".lower() for t, q, gram, runs, span, label, base, telling in template_runs(templates))


def template_table(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per run, of a size that the templates in the code fix."""
    rows = f"SELECT * FROM VALUES {template_values(templates)} AS v(t, q, gram, runs, span, label, base, telling)"
    return spark.sql(rows).withColumn("gram_hash", F.xxhash64("gram"))


def window_unit(templates: tuple[Template, ...] = TEMPLATES) -> int:
    """A common multiple of how far apart a span's first and last run may begin, for each template: positions are measured in
    shares of it, so that one window fits all templates."""
    unit = math.lcm(*(STRETCH * len(x.words.split()) - K for x in templates))
    if unit > 1 << 31:
        raise ValueError("the templates' lengths have no common multiple below 2^31")
    return unit


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for each document.

    Words are runs of digits, letters and characters beyond ASCII, A-Z taken as a-z. ``spans`` lists the verified
    ``(label, first_word, last_word, coverage)`` in order. ``score`` is the greatest coverage, 0 without a span. A null or
    empty text has no words and no labels (labels are then empty strings). Rows that repeat a doc_id and a text are one
    document; a doc_id that stands on several texts has a row for each; a null doc_id is an id like any other.
    """
    spark = docs.sparkSession
    tt = template_table(spark, templates)
    # The Kelvin sign is the one character beyond ASCII whose lower case is an ASCII letter; it must not become one.
    low = F.lower(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    d = docs.select("doc_id", F.xxhash64("text").alias("lic_text"), F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1).alias("lic_words"))
    d = d.withColumn("n_words", F.size("lic_words").cast("long"))
    runs = F.expr(f"CASE WHEN size(lic_words) >= {K} THEN transform(sequence(0, size(lic_words) - {K}), i -> concat_ws(' ', lic_words[i], lic_words[i + 1])) END")
    telling = F.array(*[F.lit(g) for g in sorted({r[2] for r in template_runs(templates) if r[7]})])
    d = d.withColumn("lic_runs", runs).withColumn("lic_runs", F.when(F.arrays_overlap("lic_runs", telling), F.col("lic_runs")))
    each = d.select("doc_id", "lic_text", "n_words", F.posexplode_outer("lic_runs").alias("p", "lic_run"))
    each = each.withColumn("lic_hash", F.xxhash64("lic_run"))
    # A text's first run stays without a match too, so that one pass gives a row for every text.
    hit = each.join(F.broadcast(tt), (F.col("lic_hash") == F.col("gram_hash")) & (F.col("lic_run") == F.col("gram")), "left")
    hit = hit.where("t is not null or p is null or p = 0")

    doc = ["doc_id", "lic_text", "n_words"]
    votes = hit.groupBy(*doc, "t", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, q)")).alias("places"), F.min("p").alias("p0"), F.max("p").alias("p1"), F.coalesce(F.max("telling"), F.lit(True)).alias("telling"),
        F.max("runs").alias("runs"), F.max("span").alias("span"), F.max("label").alias("label"), F.max("base").alias("base"),
    )
    # A text that has no telling diagonal keeps its row by that of its first run, which has no template.
    votes = votes.withColumns({c: F.when(F.col("telling"), F.col(c)) for c in ("t", "places", "p0", "p1", "runs", "span", "label", "base")})
    line = Window.partitionBy(*doc, "t").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("base"), 0).otherwise(GAP)) | F.lag("diagonal").over(line).isNull()
    merged = votes.withColumn("far", far.cast("int")).withColumn("island", F.sum("far").over(line))
    # An island may chain many notices and repeats of their words: it is judged by its best window, one that is as wide as a
    # notice may be. A diagonal and its set of positions give back where each match stands.
    places = F.expr("filter(sequence(0, 62), q -> (shiftrightunsigned(places, q) & 1) = 1)")
    match = merged.select(*doc, "t", "island", "diagonal", "runs", "label", "base", "span", F.explode_outer(places).alias("q"))
    match = match.withColumn("p", F.col("diagonal") + F.col("q"))
    unit = window_unit(templates)
    window = Window.partitionBy(*doc, "t", "island").orderBy(F.expr(f"p * ({unit}L div ({STRETCH} * span - {K}))")).rangeBetween(-unit, 0)
    match = match.withColumn("seen", F.bit_count(F.bit_or(F.expr("shiftleft(1L, q)")).over(window))).withColumn("p0", F.min("p").over(window))
    spans = match.groupBy(*doc, "t", "island").agg(
        F.max(F.struct("seen", (-F.col("p")).alias("p1"), "p0")).alias("best"), F.min("diagonal").alias("diagonal"),
        F.max("runs").alias("runs"), F.max("label").alias("label"), F.max("base").alias("base"),
    )
    spans = spans.select("*", F.col("best.seen").alias("votes"), F.col("best.p0").alias("p0"), (-F.col("best.p1")).alias("p1"))
    coverage = F.col("votes") / F.col("runs")
    stands = F.when(F.col("base"), F.col("votes") == F.col("runs")).otherwise(coverage >= COVERAGE)
    spans = spans.withColumn("coverage", coverage).withColumn("ok", F.coalesce(stands, F.lit(False)))
    base = F.col("ok") & F.col("base")
    names = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy(*doc).agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("ok")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.round("coverage", 6))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("ok") & ~F.col("base"), F.struct(F.col("p0").alias("first_word"), (F.col("p1") + K - 1).alias("last_word"), "label", "coverage")))).alias("spans"),
    ).drop("lic_text")


#: The same results in DuckDB SQL, without ``spans``.
SQL = rf"""
WITH tt(t, q, gram, runs, span, label, base, telling) AS (VALUES {template_values()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 2),
hit AS (SELECT doc_id, p, tt.* FROM g JOIN tt ON tt.gram = w[p + 1] || ' ' || w[p + 2]),
v AS (SELECT doc_id, t, p - q AS diagonal, list(DISTINCT q) AS qs, min(p) AS p0, max(p) AS p1, max(runs) AS runs, max(span) AS span, max(label) AS label, bool_or(base) AS base
      FROM hit GROUP BY doc_id, t, p - q HAVING bool_or(telling)),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER u <= CASE WHEN base THEN 0 ELSE {GAP} END THEN 0 ELSE 1 END AS far FROM v WINDOW u AS (PARTITION BY doc_id, t ORDER BY diagonal)),
i AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS island FROM f),
m AS (SELECT doc_id, t, island, diagonal, runs, span, label, base, unnest(qs) AS q, diagonal + unnest(qs) AS p FROM i),
e AS (SELECT *, bit_count(bit_or(CAST(1 AS BIGINT) << CAST(q AS INTEGER)) OVER (PARTITION BY doc_id, t, island ORDER BY p RANGE BETWEEN {STRETCH} * span - {K} PRECEDING AND CURRENT ROW)) AS seen FROM m),
s AS (SELECT doc_id, t, island, max(seen) AS votes, min(diagonal) AS diagonal, max(runs) AS runs, max(label) AS label, bool_or(base) AS base FROM e GROUP BY ALL),
k AS (SELECT *, votes / runs AS coverage FROM s WHERE CASE WHEN base THEN votes = runs ELSE votes / runs >= {COVERAGE} END)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE base) AS BIGINT) AS n_base,
       CAST(min(diagonal) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (WHERE base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE label IS NOT NULL), '') AS labels,
       coalesce(max(round(coverage, 6)), 0.0)::DOUBLE AS score
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""
