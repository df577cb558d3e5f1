"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule names the measures it needs and a predicate that rejects. On a sample the cost of each rule (seconds to
evaluate it) and its selectivity (share rejected) are measured; rules then run in the order of rejection per cost, and
each is evaluated only for rows that no earlier rule has rejected. The order changes the time taken, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measures over ``text`` in the order in which they can be computed: name, what it needs, SQL.
#: A measure that is used inside a lambda function stands in a projection of its own and is used more than once there,
#: so that it is computed once per row and sorted as primitive longs.
MEASURES: dict[str, tuple[tuple[str, ...], str]] = {
    "q_words": ((), r"regexp_extract_all(q_text, '[^\\x20\\x09-\\x0D]+', 0)"),
    "n_words": (("q_words",), "CAST(size(q_words) AS BIGINT)"),
    "word_chars": (("q_words",), "CAST(length(array_join(q_words, '')) AS BIGINT)"),
    "n_symbols": ((), r"CAST(regexp_count(q_text, '[#*$%&|<>]') AS BIGINT)"),
    "q_lines": ((), r"filter(split(q_text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
    "n_lines": (("q_lines",), "CAST(size(q_lines) AS BIGINT)"),
    "n_dup_lines": (("q_lines",), "CAST(size(q_lines) - size(array_distinct(q_lines)) AS BIGINT)"),
    "n_upper": ((), r"CAST(regexp_count(q_text, '\\p{Lu}') AS BIGINT)"),
    "n_letters": ((), r"CAST(regexp_count(q_text, '\\p{L}') AS BIGINT)"),
    # Hash of each 3-word window, then the window's number in as many low bits as the text's numbers take, below the high bits
    # of its hash: sorted, equal windows are neighbours. Those few are told apart by the whole hash.
    "q_hash": (("q_words",), "CASE WHEN size(q_words) >= 3 THEN transform(sequence(0, size(q_words) - 3), i -> xxhash64(q_words[i], q_words[i + 1], q_words[i + 2])) END"),
    "q_bits": (("q_hash",), "length(bin(coalesce(size(q_hash), 0)))"),
    "q_low": (("q_bits",), "shiftleft(1L, q_bits) - 1"),
    "q_keys": (("q_hash", "q_low"), "sort_array(transform(q_hash, (x, i) -> (x & ~q_low) | CAST(i AS BIGINT)))"),
    "q_near": (
        ("q_keys", "q_bits"),
        "filter(q_keys, (x, j) -> coalesce(shiftright(get(q_keys, j - 1), q_bits) = shiftright(x, q_bits), false) OR coalesce(shiftright(get(q_keys, j + 1), q_bits) = shiftright(x, q_bits), false))",
    ),
    "q_pairs": (
        ("q_near", "q_hash", "q_low"),
        "CASE WHEN size(q_near) > 0 THEN array_sort(transform(q_near, x -> named_struct('h', q_hash[CAST(x & q_low AS INT)], 'i', CAST(x & q_low AS INT)))) END",
    ),
    "q_same": (("q_pairs",), "filter(q_pairs, (x, j) -> coalesce(get(q_pairs, j - 1).h = x.h, false) OR coalesce(get(q_pairs, j + 1).h = x.h, false))"),
    "q_at": (("q_same",), "sort_array(transform(q_same, x -> x.i))"),
    # Windows cover three words from their start; where the next begins sooner, only the words up to it.
    "n_repeat_words": (("q_at",), "coalesce(aggregate(transform(q_at, (x, j) -> least(3, coalesce(get(q_at, j + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: str


RULES = (
    Rule("few_words", ("n_words",), "n_words < 50"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "n_symbols > 0.1 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "n_dup_lines > 0.5 * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", ("n_upper", "n_letters"), "2 * n_upper > n_letters"),
)
#: Rules whose verdict the base columns hold already.
BASE_RULES = ("few_words", "repeated_words")


def needed(names: tuple[str, ...]) -> list[str]:
    """The measures to compute for ``names``, in order."""
    want: set[str] = set()

    def add(name: str) -> None:
        if name not in want:
            want.add(name)
            for x in MEASURES[name][0]:
                add(x)

    for name in names:
        add(name)
    return [m for m in MEASURES if m in want]


def measure(df: DataFrame, names: tuple[str, ...], have: set[str], alive: str | None = None) -> DataFrame:
    """Adds the measures not in ``have``; where ``alive`` is given, only for rows on which it holds."""
    for m in needed(names):
        if m not in have:
            have.add(m)
            value = F.expr(MEASURES[m][1])
            df = df.withColumn(m, F.when(F.col(alive), value) if alive else value)
    return df


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> list[tuple[Rule, float, float]]:
    """Rules with seconds per row and share rejected on about ``sample_rows`` rows, by rejection per cost.

    Rows are drawn one by one, whatever their ids and texts, and at most twice ``sample_rows`` are taken, so repeated texts
    neither fill nor empty the sample. Seconds are measured, so the order may differ from run to run; the verdict does not.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("q_text")).sample(share, 17).limit(2 * sample_rows)
    sample = sample.repartition(4).persist()
    try:
        rows = max(1, sample.count())
        found = []
        for rule in rules:
            df = measure(sample, rule.needs, set()).agg(F.sum(F.when(F.expr(rule.rejects), 1).otherwise(0)).alias("n"))
            took = []
            for _ in range(2):  # the first run also compiles
                began = time.perf_counter()
                rejected = df.first()["n"] or 0
                took.append(time.perf_counter() - began)
            found.append((rule, min(took) / rows, rejected / rows))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-(x[2] + 1e-6) / max(x[1], 1e-9), x[0].name))


def cascade(df: DataFrame, rules: list[Rule], have: set[str], alive: str = "q_alive") -> DataFrame:
    """Sets ``alive`` to false, and ``rejected_by`` to the rule, at the first rule that rejects."""
    df = df.withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        df = measure(df, rule.needs, have, alive)
        hit = F.col(alive) & F.coalesce(F.expr(rule.rejects), F.lit(False))
        df = df.withColumn("rejected_by", F.when(hit, F.lit(rule.name)).otherwise(F.col("rejected_by")))
        df = df.withColumn(alive, F.col(alive) & F.col("rejected_by").isNull())
    return df


def fence(df: DataFrame) -> tuple[DataFrame, F.Column]:
    """``df`` and a condition that always holds; no filter on a column that depends on it is moved below ``df``.

    A filter moved below the measures would hold a copy of each, evaluated anew at every use, but the optimizer moves none
    below a column that is not deterministic.
    """
    return df.withColumn("q_bar", F.monotonically_increasing_id()), F.col("q_bar") >= 0


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Base measures and verdict of each row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rejected_by``.

    A null or empty text has no words: its counts are 0 and it fails. Repeated rows, and rows with a null doc_id, are
    judged like any other, one result each. Windows are told apart by 64-bit hashes, however many a text has.
    ``rejected_by`` is the first rule that rejects in the measured order, so of several it may name another in another run.
    """
    order = [r for r, _, _ in order_rules(docs, tuple(r for r in rules if r.name not in BASE_RULES), sample_rows)]
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("q_text"))
    have: set[str] = set()
    df = measure(df, BASE, have).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("q_alive", ~F.col("base_failed"))
    df, bar = fence(cascade(df, order, have))
    out = {c: c for c in (*BASE, "base_failed")} | {"kept": "q_alive", "rejected_by": "rejected_by"}
    return df.select("doc_id", *[F.when(bar, F.col(c)).alias(name) for name, c in out.items()])


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; costly measures are computed only for rows still in the running."""
    order = [r for r, _, _ in order_rules(docs, rules, sample_rows)]
    df = docs.select(F.struct("*").alias("q_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("q_text"), F.lit(True).alias("q_alive"))
    df, bar = fence(cascade(df, order, set()))
    return df.where(F.col("q_alive") & bar).select("q_row.*")


#: The same verdict in DuckDB SQL, over a relation ``documents``.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '\p{L}')) AS n_letters
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols > 0.1 * n_words OR n_dup_lines > 0.5 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_upper > n_letters) AS kept
FROM b
"""
