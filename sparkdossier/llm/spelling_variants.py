"""Spelling variants by anagram hashing, in DataFrame expressions.

A word's key is the sum of its letters' values, a letter's value being the fifth power of its number in the alphabet, so
anagrams share a key and a change of one letter changes the key by that letter's value. Words whose keys differ by the value
of one letter are candidates for an insertion or deletion, words whose keys differ by the difference of two values for an
exchange. Both come from one equality join: of each word the keys that are left when a letter is taken away, joined to the
whole keys of words one letter shorter and, for exchanges, to each other. Letter order is verified by edit distance.

A change leaves one half of a word as it was, so keys are joined together with the hash of that half: a class of anagrams
then meets only where half of the letters stand in the same order, however many anagrams there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.session import cut, scratch

LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, every: int = 97) -> DataFrame:
    """``word, n``: the runs of letters of all texts, some with one letter taken away, and how often each stands.

    ``crc32('<doc_id>:<run>')`` decides: if ``every`` divides it, the run loses the letter at that number modulo its length. A
    null doc_id has no such number and its runs stay as they are. Counts are summed on each mapper first.
    """
    low = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.col("doc_id").cast("string").alias("sv_id"), F.explode(F.regexp_extract_all(low, F.lit(f"([{LETTERS}]+)"), 1)).alias("run"))
    h = F.crc32(F.encode(F.concat("sv_id", F.lit(":"), "run"), "UTF-8"))
    runs = runs.select("run", h.alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _value(letter: F.Column) -> F.Column:
    """Fifth power of the letter's number: a to z are 1 to 26, the letters from U+00C0 on 27 to 90.

    90 to the fifth times the longest possible string is still a long.
    """
    code = F.ascii(letter).cast("long")
    number = F.when(code < 128, code - 96).otherwise(code - 0xC0 + 27)
    return number * number * number * number * number


def _letters(text: F.Column) -> F.Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def near_words(words: DataFrame) -> DataFrame:
    """``word, other`` for all words that differ by one inserted, deleted or replaced letter, in both directions.

    ``words`` has ``word`` (distinct, not null). An empty table gives no rows.
    """
    w = words.select("word", F.char_length("word").alias("size"))
    w = w.withColumn("key", F.aggregate(F.filter(F.split("word", ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s + _value(c)))

    def halves(size: F.Column) -> dict[str, tuple[F.Column, F.Column]]:
        """For each side the half that stays and the part in which a letter changes, of a word one half of which is half of ``size``."""
        half = F.floor(size / 2).cast("int")
        stays = {"first": F.substring("word", F.lit(1), half), "last": F.substring("word", F.col("size") - (size - half) + 1, size - half)}
        return {
            "first": (stays["first"], F.substring("word", half + 1, F.col("size"))),
            "last": (stays["last"], F.substring("word", F.lit(1), F.col("size") - (size - half))),
        }

    def without_a_letter(size: F.Column) -> DataFrame:
        """A row for each letter that may be taken away: what the key is then, and the half that is left alone."""
        sides = [F.struct(F.lit(side).alias("side"), F.xxhash64(stays).alias("half"), _letters(part).alias("letters")) for side, (stays, part) in halves(size).items()]
        each = w.select("word", size.alias("size_left"), "key", F.explode(F.array(*sides)).alias("s"))
        each = each.select("word", "size_left", "key", "s.side", "s.half", F.explode("s.letters").alias("letter"))
        return each.select("word", "size_left", "side", "half", (F.col("key") - _value(F.col("letter"))).alias("key_left"))

    on = ["size_left", "side", "half", "key_left"]
    one = without_a_letter(F.col("size"))
    swaps = one.join(one.withColumnRenamed("word", "other").hint("merge"), on).where("word < other")
    swaps = swaps.where(F.levenshtein("word", "other", 1) == 1).select("word", "other")

    longer = without_a_letter(F.col("size") - 1)
    whole = [F.struct(F.lit(side).alias("side"), F.xxhash64(stays).alias("half")) for side, (stays, _) in halves(F.col("size")).items()]
    shorter = w.select(F.col("word").alias("other"), F.col("size").alias("size_left"), F.col("key").alias("key_left"), F.explode(F.array(*whole)).alias("s"))
    shorter = shorter.select("other", "size_left", "key_left", "s.side", "s.half")
    half = F.floor(F.col("size_left") / 2).cast("int")
    # A letter beside its like may be taken from either half: such a pair counts by its first half.
    again = (F.col("side") == "last") & (F.substring("word", F.lit(1), half) == F.substring("other", F.lit(1), half))
    cuts = longer.join(shorter.hint("merge"), on).where(~again).where(F.levenshtein("word", "other", 1) == 1).select("word", "other")
    pairs = swaps.unionByName(cuts)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


def spelling_variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, ratio: int = 2, every: int = 97) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each word of at least ``least_letters`` letters that stands ``least_count`` times.

    ``form`` is the near word that stands most often (of equals the first in code-point order) if it stands at least ``ratio``
    times as often, else null; ``root`` follows forms to the last. Null and wordless texts have no words; repeated rows count
    each; an empty table gives no rows. Forms at least double the count, so ``root`` is found in as many doublings of the path
    as the logarithm of its length. All joins merge: a table of words, however well its file is packed, is not for the driver.
    """
    spark = docs.sparkSession
    path = scratch(spark, "spelling-words")
    corpus_words(docs, every).where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count)).write.parquet(path)
    words = spark.read.parquet(path)
    pairs = near_words(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "other")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    got = words.join(best.hint("merge"), "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    got = cut(
        got.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
        )
    )
    step = got.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(step.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return got.join(step.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
