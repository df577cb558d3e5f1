"""Streams over access events: rate limits, histograms and new posts, with the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkdossier.functions.text import route


def calls_per_minute(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls by minute and client; rows later than ``late`` behind the newest are left out by the watermark."""
    named = log.where("klient_id is not null").withWatermark("t", late)
    out = named.groupBy(F.window("t", "1 minute").alias("w"), "klient_id").agg(F.count(F.lit(1)).alias("kall"))
    return out.select(F.col("w.start").alias("minutt"), "klient_id", "kall")


def client_sessions(log: DataFrame, idle: str = "1800 seconds", late: str = "10 minutes") -> DataFrame:
    named = log.where("klient_id is not null").withWatermark("t", late)
    out = named.groupBy(F.session_window("t", idle).alias("w"), "klient_id").agg(F.count(F.lit(1)).alias("kall"))
    return out.select("klient_id", F.col("w.start").alias("fra"), F.col("w.end").alias("til"), "kall")


def route_counts(log: DataFrame) -> DataFrame:
    """Running counters by route and status, for update or complete mode."""
    return log.groupBy(route(F.col("sti")).alias("rute"), "kode").agg(F.count(F.lit(1)).alias("kall"))


def first_posts(posts: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each post once, however often it is sent within the watermark."""
    return posts.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_new(posts: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends posts that the Parquet table at ``path`` lacks. A batch that is sent again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        new.write.mode("append").parquet(path)

    return posts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
