"""URL filters: rules on host and path first, then naive Bayes on the words of host and path.

Host names are written without blanks, so each letter run of a host is split into words by a unigram Viterbi. Its word counts
are those of all page texts and of the hyphened parts of all hosts. Parts of names are looked up by a join of the distinct
names to the word counts, so no dictionary is held anywhere whole; a task only sees the matches of one name at a time.

The classes are learned without labels of pages: a host one of whose words is in a list of words (a parameter) is a sample of
what to block, all others of what to allow; pages that a rule judges are not learned from. Tokens are counted over all pages
in ``1 << BITS`` buckets, which bounds the model whatever the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.session import cut, scratch

BITS = 18
#: The longest word that is looked up, and the longest name that is split: no label of a host may be longer.
WORD, NAME = 24, 63
#: Letters: a to z and all characters beyond ASCII.
_LETTERS = r"([^\x00-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query, and words that make a host a sample of what to block.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
BLOCK_WORDS = (
    "adult", "ads", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "lottery", "pills", "poker", "porn", "sex", "slots", "spam", "viagra",
    "warez", "xxx",
)


def lower(text: F.Column) -> F.Column:
    return F.translate(text, _UPPER, _LOWER)


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path; both empty for a null or where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    return lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: F.Column, path: F.Column, rules: tuple[Rule, ...]) -> F.Column:
    """Name of the longest rule that fits (of equally long ones the first by name), else null."""
    fits = [F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(r.name)) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def word_counts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``word, n`` over all page texts and the parts of hyphened labels of hosts, words of at most ``WORD`` letters.

    ``hosts`` has ``host, n``. A part of a hyphened label counts for each page of its host.
    """
    text = F.regexp_replace(F.col("html").cast("string"), r"<[^<>]*>|&[A-Za-z0-9#]{1,12};", " ")
    texts = pages.select(F.explode(F.regexp_extract_all(lower(text), F.lit(_LETTERS), 1)).alias("word"), F.lit(1).cast("long").alias("n"))
    label = hosts.select("n", F.explode(F.split("host", r"\.")).alias("label")).where(F.col("label").contains("-"))
    parts = label.select(F.explode(F.regexp_extract_all("label", F.lit(_LETTERS), 1)).alias("word"), "n")
    return texts.unionByName(parts).where(F.char_length("word") <= WORD).groupBy("word").agg(F.sum("n").alias("n"))


def best_split(name: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """Words of ``name`` of least cost; ``known`` has the cost of parts by start and end, others cost more by their length.

    Of equal costs fewer words win, then the longer last word.
    """
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    base = np.log(total) - np.log(10.0)
    for end in range(1, len(name) + 1):
        least = None
        for start in range(max(0, end - WORD), end):
            cost = known.get((start, end))
            if cost is None:
                cost = base + (end - start) * np.log(10.0)
            here = (best[start][0] + float(cost), best[start][1] + 1, start)
            if least is None or here < least:
                least = here
        best.append(least)
    words, end = [], len(name)
    while end:
        start = best[end][2]
        words.append(name[start:end])
        end = start
    return words[::-1]


def _viterbi(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            words = []
            for name, parts in zip(names, batch.column(1), strict=True):
                known = {(p["at"], p["at"] + p["size"]): float(np.log(total) - np.log(p["n"])) for p in parts.as_py() or []}
                words.append(best_split(name, known, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return run


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` for each distinct ``name``; a name longer than ``NAME`` letters is one word."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    size = F.char_length("name")
    short = names.where(size <= NAME)
    at = short.select("name", F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    part = at.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD), size - F.col("at")))).alias("size"))
    part = part.withColumn("word", F.substring("name", F.col("at") + 1, F.col("size")))
    found = part.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("at", "size", "n")).alias("parts"))
    got = short.join(found, "name", "left").select("name", "parts").mapInArrow(_viterbi(total), "name string, words array<string>")
    return got.unionByName(names.where(size > NAME).select("name", F.array("name").alias("words")))


def _buckets(tokens: F.Column, kind: str) -> F.Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(F.concat(F.lit(kind), t)), F.lit(1 << BITS)).cast("int"))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # log odds of each bucket
    prior: float


def fit(judged: DataFrame, smooth: float = 0.5) -> Model:
    """Multinomial naive Bayes from ``sample`` and the token buckets of all pages that no rule judges.

    What reaches the driver has at most two rows for each bucket.
    """
    free = judged.where("rule is null")
    docs = {bool(r.sample): r.n for r in free.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros((2, 1 << BITS))
    token = free.select("sample", F.explode(F.concat("host_buckets", "path_buckets")).alias("bucket"))
    for r in token.groupBy("sample", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[int(r["sample"]), r["bucket"]] = r["n"]
    used = max(1, int((counts.sum(0) > 0).sum()))
    log = np.log(counts + smooth) - np.log(counts.sum(1, keepdims=True) + smooth * used)
    weights = np.where(counts.sum(0) > 0, log[1] - log[0], 0.0)
    return Model(weights.astype(np.float32), float(np.log(docs.get(True, 0) + smooth) - np.log(docs.get(False, 0) + smooth)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.full(batch.num_rows, model.prior)
            for name in ("host_buckets", "path_buckets"):
                lists = batch.column(name)
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), size)
                odds += np.bincount(row, model.weights[lists.flatten().to_numpy(zero_copy_only=False)], batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            kept = ["page_id", "host", "path", "rule", "host_words"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, "score"])

    return run


def _with_hosts(urls: DataFrame, hosts: DataFrame, rows: int) -> DataFrame:
    """Joins each url to what is known of its host: hosts with a thousandth of all rows broadcast, others shuffled.

    So many rows can have fewer than a thousand hosts, and only names that are legal in length are broadcast.
    """
    often = (F.col("n") * 1000 > rows) & (F.char_length("host") <= 255)
    known = hosts.select("host", "host_words", "host_buckets", "sample", often.alias("often"))
    hot = known.where("often").drop("often")
    rest = urls.join(F.broadcast(hot.select("host")), "host", "left_anti").join(known.where(~F.col("often")).drop("often"), "host")
    return urls.join(F.broadcast(hot), "host").unionByName(rest)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, block_words: tuple[str, ...] = BLOCK_WORDS, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score, host_words`` for each row of ``pages`` (``page_id, url, html``).

    The longest rule that fits decides; elsewhere the verdict is block where the score (of what to block, 0 to 1) is at least
    ``threshold``. A null url or one without ``://`` has an empty host and path, no words and the score of the prior. Null
    html has no words; repeated rows are judged each; an empty table gives no rows. Digits of a path count as one token.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    tokens = F.regexp_extract_all(F.regexp_replace(lower(F.col("path")), "[0-9]+", "0"), F.lit(r"([^\x00-\x2F\x31-\x60\x7B-\x7F]+)"), 1)
    urls = urls.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"), _buckets(tokens, "p:").alias("path_buckets"))
    place = scratch(spark, "urls")
    urls.write.parquet(place)
    urls = spark.read.parquet(place)

    hosts = cut(urls.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    place = scratch(spark, "url-words")
    word_counts(pages, hosts).write.parquet(place)
    counts = spark.read.parquet(place)
    each = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(_LETTERS), 1)).alias("at", "name"))
    words = each.join(segment_names(each.select("name").distinct(), counts), "name")
    words = words.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    known = hosts.join(words, "host", "left").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))
    sample = F.arrays_overlap("host_words", F.array(*map(F.lit, block_words)).cast("array<string>"))
    known = cut(known.select("host", "n", F.array_join("host_words", " ").alias("host_words"), _buckets(F.col("host_words"), "h:").alias("host_buckets"), sample.alias("sample")))

    place = scratch(spark, "url-tokens")
    _with_hosts(urls, known, urls.count()).write.parquet(place)
    judged = spark.read.parquet(place)
    scored = judged.mapInArrow(_score(fit(judged)), "page_id bigint, host string, path string, rule string, host_words string, score double")
    by_rule = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))
    verdict = F.coalesce(by_rule, F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "host_words")
