"""Scores of extraction: precision and recall, calibration, paired tests, latency and error rates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bounds of the confidence buckets.
BUCKETS = ((0.0, 0.5), (0.5, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01))


def precision_recall(outcomes: DataFrame) -> DataFrame:
    """Per field; precision is null where nothing was answered."""
    n = lambda v: F.count_if(F.col("utfall") == v)
    out = outcomes.groupBy("felt").agg(n("riktig").alias("riktig"), n("mangler").alias("mangler"), n("galt").alias("galt"))
    share = lambda a, b: F.round(F.try_divide(F.col(a), b), 4)
    return out.select(
        "felt", "riktig", "mangler", "galt", share("riktig", F.col("riktig") + F.col("galt")).alias("presisjon"),
        share("riktig", F.col("riktig") + F.col("mangler") + F.col("galt")).alias("recall"),
    )


def bucket(c: F.Column) -> F.Column:
    """Number of the bucket; what lies outside all is in the last."""
    out = F.lit(len(BUCKETS) - 1)
    for i, (a, z) in enumerate(BUCKETS):
        out = F.when((c >= a) & (c < z), i).otherwise(out)
    return out


def calibration(pairs: DataFrame) -> DataFrame:
    """Per bucket with rows: count, mean stated, share right and their difference."""
    out = pairs.groupBy(bucket(F.col("konfidens")).alias("botte")).agg(
        F.count(F.lit(1)).alias("antall"), F.avg("konfidens").alias("o"), F.avg(F.col("riktig").cast("double")).alias("f")
    )
    return out.select("botte", "antall", F.round("o", 4).alias("oppgitt"), F.round("f", 4).alias("faktisk"), F.round(F.col("f") - F.col("o"), 4).alias("avvik"))


def expected_calibration_error(pairs: DataFrame) -> DataFrame:
    t = calibration(pairs)
    return t.agg(F.coalesce(F.round(F.sum(F.col("antall") * F.abs("avvik")) / F.sum("antall"), 4), F.lit(0.0)).alias("ece"))


def overconfident(pairs: DataFrame, limit: float = 0.05) -> DataFrame:
    return calibration(pairs).where(F.col("avvik") < -limit)


def binomial_tail(a: int, b: int) -> float:
    """Probability of at most ``min(a, b)`` heads in ``a + b`` throws: terms from the largest down, until what is left counts for nothing.

    Terms fall off like a normal distribution's, so they are as many as the root of the throws at most, and none is kept.
    """
    n, k = a + b, min(a, b)
    term, total = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + n * math.log(0.5)), 0.0
    while k >= 0 and term > 1e-20:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return total


def _tails(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(map(binomial_tail, a.to_pylist(), b.to_pylist()), type=pa.float64())


def mcnemar(live: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """Fixed, broken and the exact two-sided binomial probability, from outcomes joined by question."""
    both = live.select(key, F.col(value).alias("a")).join(candidate.select(key, F.col(value).alias("b")), key)
    n = both.agg(F.count_if(F.expr("a = 0 and b = 1")).alias("rettet"), F.count_if(F.expr("a = 1 and b = 0")).alias("odelagt"))
    tail = F.arrow_udf(_tails, "double")("rettet", "odelagt")
    p = F.when(F.col("rettet") + F.col("odelagt") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
    return n.withColumn("p", F.round(p, 6))


def verdict(rows: DataFrame) -> DataFrame:
    """Whether a candidate takes over: ``grunn`` and ``godkjent`` from counts, routing, determinism, guard and p."""
    reason = (
        F.when(F.col("n").isNull() | (F.col("n") == 0), "ikke_maalt")
        .when(F.col("kode_kandidat") < F.col("kode_live"), "ruting_brutt")
        .when(~F.col("deterministisk"), "ikke_deterministisk")
        .when(F.col("tallvakt") == "hoy", "dikter_tall")
        .when(F.col("p").isNull() | (F.col("p") >= 0.05), "ikke_skillbar")
        .when(F.col("rettet") > F.col("odelagt"), "bedre")
        .otherwise("daarligere")
    )
    return rows.withColumn("grunn", reason).withColumn("godkjent", F.col("grunn") == "bedre")


def guard_verdict(rows: DataFrame, by: str, limit: float = 0.25) -> DataFrame:
    """How often the number guard stepped in, per group."""
    out = rows.groupBy(by).agg(F.sum(F.col("stoppet").cast("long")).alias("stoppet"), F.count(F.lit(1)).alias("antall_svar"))
    rate = F.try_divide(F.col("stoppet"), F.col("antall_svar"))
    return out.withColumn("rate", F.round(rate, 4)).withColumn("dom", F.when(rate >= limit, "hoy").when(F.col("stoppet") == 0, "null").otherwise("normal"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, extremes, mean, median, and 95th and 99th percentiles by nearest rank with half-even rounding.

    Equal values are counted first, by an aggregate that mappers begin, so what a group sorts are its different values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(by)
    r = counted.withColumn("til", F.sum("k").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(w))

    def at(p: float) -> F.Column:
        return F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.lit(p) * F.col("n") + 0.5)))

    pick = lambda i: F.min(F.when(F.col("til") >= i, F.col("v")))
    half = (F.col("n") + 1) / 2
    return r.groupBy(by).agg(
        F.max("n").alias("antall"), F.round(F.min("v"), 3).alias("min"), F.round((pick(F.floor(half)) + pick(F.ceil(half))) / 2, 3).alias("median"),
        F.round(pick(at(0.95)), 3).alias("p95"), F.round(pick(at(0.99)), 3).alias("p99"), F.round(F.max("v"), 3).alias("maks"), F.round(F.sum(F.col("v") * F.col("k")) / F.max("n"), 3).alias("snitt"),
    )


def distance(a: F.Column, b: F.Column, near: int = 6) -> F.Column:
    """Edit distance: by a narrow band first, by the whole square only where the texts are further apart than ``near``."""
    banded = F.levenshtein(a, b, near)
    return F.when(a == b, 0).when(banded >= 0, banded).otherwise(F.levenshtein(a, b))


def error_rates(pairs: DataFrame, by: str) -> DataFrame:
    """Character error rates over lines of documents: over all characters, and the mean of the documents' own."""
    d = pairs.where(F.length("fasit") > 0).groupBy(by).agg(F.sum(distance(F.col("fasit"), F.col("lest"))).alias("feil"), F.sum(F.length("fasit")).alias("tegn"))
    return d.agg(F.round(F.sum("feil") / F.sum("tegn"), 4).alias("mikro"), F.round(F.avg(F.col("feil") / F.col("tegn")), 4).alias("makro"))


def _resample(rounds: int, seed: int):
    """Per round the resampled sums of the rows here; weights are Poisson, drawn from a hash of seed, round and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
        # The weight by the upper 16 bits; -1 where an edge lies among the numbers that share them, which the lower bits decide.
        first = np.arange(1 << 16) / float(1 << 16)
        low, high = np.searchsorted(edges, first, "right"), np.searchsorted(edges, first + (1 / (1 << 16) - 1 / (1 << 53)), "right")
        table = np.where(low == high, low, -1).astype(float)
        salt = (np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        sums = np.zeros((2, rounds))
        rows = 16  # whose hashes stay in the cache
        hashes, shifted, weights = np.empty((rows, rounds), np.uint64), np.empty((rows, rounds), np.uint64), np.empty((rows, rounds))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            values = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2)])
            for at in range(0, len(ids), rows):
                n = min(rows, len(ids) - at)
                h, x, w = hashes[:n], shifted[:n], weights[:n]
                np.bitwise_xor(ids[at : at + n, None], salt, out=h)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    np.right_shift(h, np.uint64(shift), out=x)
                    h ^= x
                    h *= np.uint64(factor)
                np.right_shift(h, np.uint64(31), out=x)
                h ^= x
                np.right_shift(h, np.uint64(48), out=x)
                np.take(table, x.view(np.int64), out=w, mode="clip")
                unsure = w < 0
                if unsure.any():
                    w[unsure] = np.searchsorted(edges, (h[unsure] >> np.uint64(11)) / float(1 << 53), "right")
                sums += values[:, at : at + n] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, rounds + 1)), pa.array(sums[0]), pa.array(sums[1])], ["r", "e", "c"])

    return run


def bootstrap_interval(rows: DataFrame, errors: str, chars: str, rounds: int = 2000, seed: int = 20260807) -> DataFrame:
    """95 % interval of the micro error rate: Poisson resampling with weights drawn from a hash of seed, round and row's ``id``.

    Each task gives one partial sum per round, so rows are never gathered nor multiplied.
    """
    r = rows.where(F.col("id").isNotNull()).select(F.col("id").cast("long"), F.col(errors).cast("double").alias("e"), F.col(chars).cast("double").alias("c"))
    rates = r.mapInArrow(_resample(rounds, seed), "r long, e double, c double").groupBy("r").agg((F.sum("e") / F.sum("c")).alias("rate"))
    place = rates.withColumn("i", F.row_number().over(Window.orderBy("rate")))  # as many rows as rounds
    pick = lambda q: F.max(F.when(F.col("i") == int(q * rounds) + 1, F.col("rate")))
    return place.agg(F.round(pick(0.025), 4).alias("lav"), F.round(pick(0.975), 4).alias("hoy"))


def found_in_all(variants: DataFrame) -> DataFrame:
    """Fields per type with the number of variants that have them, and whether all have."""
    n = variants.groupBy("type").agg(F.count_distinct("variant").alias("alle"))
    return variants.groupBy("type", "felt").agg(F.count_distinct(F.when(F.col("funnet"), F.col("variant"))).alias("antall")).join(n, "type").select("type", "felt", "antall", (F.col("antall") == F.col("alle")).alias("kandidat"))


def weighted_confidence(regions: DataFrame, by: str) -> DataFrame:
    w = F.greatest(F.length(F.trim(F.coalesce("tekst", F.lit("")))), F.lit(1))
    return regions.groupBy(by).agg(F.round(F.sum(F.col("konfidens") * w) / F.sum(w), 6).alias("konfidens"))
