"""Access logs, metrics, job states and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdossier.functions.text import route

# Upper bounds of the latency histogram in seconds.
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)
# Public names of internal job states, end states, and the moves that are allowed.
STATES = {
    "kø": "i_ko", "ko": "i_ko", "i_ko": "i_ko", "sender": "sender", "pågår": "kjorer", "paagaar": "kjorer", "arbeider": "kjorer", "kjorer": "kjorer",
    "sammenstiller": "sammenstiller", "ferdig": "ferdig", "delvis": "delvis", "feil": "feil", "avbrutt": "avbrutt", "avbrytes": "kjorer",
}
END_STATES = ("ferdig", "delvis", "feil", "avbrutt")
MOVES = {
    "i_ko": ("sender", "kjorer", "avbrutt", "feil"),
    "sender": ("kjorer", "avbrutt", "feil"),
    "kjorer": ("sammenstiller", "ferdig", "delvis", "avbrutt", "feil"),
    "sammenstiller": ("ferdig", "delvis", "feil", "avbrutt"),
}


def usage(log: DataFrame) -> DataFrame:
    """Calls and errors by client and by client and path, and the total, anonymous rows apart, in one pass."""
    named = log.withColumn("navn", F.when(F.coalesce("klient_id", F.lit("")) == "", "-").otherwise(F.col("klient_id")))
    out = named.groupingSets([["navn"], ["navn", "sti"], []], "navn", "sti").agg(
        F.count(F.lit(1)).alias("kall"), F.count_if(F.col("kode") >= 400).alias("feil"), F.grouping_id().cast("int").alias("nivaa")
    )
    return out.where("nivaa <> 0 or navn <> '-'")


def callers(log: DataFrame, path: str) -> DataFrame:
    """Calls by client of one path. A path that the log does not have is an error, not an empty result."""
    if log.where(F.col("sti") == path).limit(1).count() == 0:
        raise ValueError(f"no such path in the log: {path}")
    return log.where((F.col("sti") == path) & F.col("klient_id").isNotNull()).groupBy("klient_id").agg(F.count(F.lit(1)).alias("kall"))


def routes(log: DataFrame) -> DataFrame:
    return log.groupBy(route(F.col("sti")).alias("rute"), "kode").agg(F.count(F.lit(1)).alias("kall"))


def histogram(log: DataFrame, value: str = "sekunder") -> DataFrame:
    """Cumulative buckets by route, with the unbounded one, sum and count."""
    le = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in LATENCY_BOUNDS]
    return log.groupBy(route(F.col("sti")).alias("rute")).agg(*le, F.count(F.lit(1)).alias("antall"), F.round(F.sum(value), 3).alias("sum"))


def exposition(log: DataFrame, name: str = "forespoersler_total") -> DataFrame:
    """Counter lines in text form."""
    line = F.format_string(f'{name}{{rute="%s",kode="%d"}} %d', "rute", "kode", "kall")
    return routes(log).select(line.alias("linje"))


def over_rate(log: DataFrame, limit: int) -> DataFrame:
    """Calls a client made beyond ``limit`` in one minute."""
    m = log.where("klient_id is not null").groupBy(F.window("t", "1 minute").start.alias("minutt"), "klient_id").agg(F.count(F.lit(1)).alias("kall"))
    return m.where(F.col("kall") > limit).withColumn("avvist", F.col("kall") - limit)


def sessions(log: DataFrame, idle: str = "1800 seconds") -> DataFrame:
    """Runs of a client's calls with no pause of ``idle`` or more."""
    s = log.where("klient_id is not null").groupBy(F.session_window("t", idle).alias("w"), "klient_id").agg(F.count(F.lit(1)).alias("kall"))
    return s.select("klient_id", F.col("w.start").alias("fra"), F.col("w.end").alias("til"), "kall")


def public_state(c: F.Column) -> F.Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.lit("feil")
    for k, v in STATES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def legal_move(before: F.Column, after: F.Column) -> F.Column:
    a, b = public_state(before), public_state(after)
    allowed = F.lit(False)
    for k, v in MOVES.items():
        allowed = F.when(a == k, b.isin(*v)).otherwise(allowed)
    return (a == b) | allowed


def transitions(states: DataFrame) -> DataFrame:
    """Each job's moves in time with whether they are allowed; end states are left by none."""
    w = Window.partitionBy("jobb").orderBy("ts", "id")
    t = states.withColumn("fra", F.lag("tilstand").over(w)).where("fra is not null")
    return t.select("jobb", "id", public_state(F.col("fra")).alias("fra"), public_state(F.col("tilstand")).alias("til"), legal_move(F.col("fra"), F.col("tilstand")).alias("lovlig"))


def retention(files: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Count and bytes of what is kept and of what is older than ``days``."""
    old = F.col("endret") < F.date_sub(F.lit(as_of).cast("date"), days)
    return files.groupBy(F.when(old, "slettet").otherwise("beholdt").alias("utfall")).agg(F.count(F.lit(1)).alias("antall"), F.sum("bytes").alias("bytes"))


def new_posts(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming posts that are not stored yet, each once."""
    return incoming.dropDuplicates(keys).join(stored, keys, "left_anti")


def waiting_images(images: DataFrame, tasks: DataFrame) -> DataFrame:
    """Images that no open task points to; where tasks can't be had (None), none, so that nothing is deleted."""
    if tasks is None:
        return images.limit(0)
    return images.join(tasks.where("not annotert").select("bilde").distinct(), "bilde", "left_anti")


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files missing, changed or extra against a manifest of checksums, each in one class only."""
    j = before.select("sti", F.col("sum").alias("a")).join(now.select("sti", F.col("sum").alias("b")), "sti", "full_outer")
    kind = F.when(F.col("b").isNull(), "mangler").when(F.col("a").isNull(), "ekstra").when(F.col("a") != F.col("b"), "endret")
    return j.withColumn("utfall", kind).where("utfall is not null").select("sti", "utfall")


def duplicate_keys(keys: DataFrame) -> DataFrame:
    """Key values that several clients share, or that are too short."""
    g = keys.groupBy("nokkel").agg(F.count_distinct("navn").alias("antall"), F.min("navn").alias("forste"))
    return g.withColumn("kort", F.length("nokkel") < 24).where("kort or antall > 1")
