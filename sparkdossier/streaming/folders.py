"""Folders of documents as a stream: each call's posts are added once, whatever is sent or computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkdossier.operators import folders


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def keep_posts(posts: DataFrame, path: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Adds a stream of posts (``mappe, kall, plass``, the fields of a post) to the tables ``poster`` and ``kall`` at ``path``.

    A batch writes its own folder and reads only what earlier batches wrote, so a batch that is run again writes the same.
    Posts lie by ``del``, a hash of their folder: a batch reads only the parts its folders fall into, at most ``parts``
    numbers, which are all that comes to the driver. A path goes with one checkpoint: with a new one, batches count from zero and
    would write over those that are there. Calls must come whole within a batch to be counted as one.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posts.schema.fields) + ", del int, bunke long"

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = f"{path}/poster"
        batch = batch.where("mappe is not null").persist()
        try:
            spot = F.pmod(F.xxhash64("mappe"), F.lit(parts)).cast("int")
            touched = [r[0] for r in batch.select(spot).distinct().collect()]
            if _exists(spark, stored):
                before = _table(spark, stored, schema).where(F.col("bunke") < number).where(F.col("del").isin(touched))
            else:
                before = spark.createDataFrame([], schema)
            into = f"{stored}/bunke={number}"
            folders.new_posts(before, batch).withColumn("del", spot).write.mode("overwrite").partitionBy("del").parquet(into)
            added = spark.read.schema(schema).parquet(into)
            folders.calls(batch, added).write.mode("overwrite").parquet(f"{path}/kall/bunke={number}")
        finally:
            batch.unpersist()

    return posts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder_versions(spark: SparkSession, path: str) -> DataFrame:
    """Version, documents and duplicates of each folder that ``keep_posts`` keeps at ``path``."""
    reports = spark.read.option("basePath", f"{path}/kall").parquet(f"{path}/kall")
    # A call that lies in two batches is still one call.
    once = reports.groupBy("mappe", "kall").agg(F.sum("lagt_til").alias("lagt_til"), F.sum("duplikater").alias("duplikater"))
    return folders.versions(once)


def folder_posts(spark: SparkSession, path: str) -> DataFrame:
    """All posts that ``keep_posts`` keeps at ``path``."""
    return spark.read.option("basePath", f"{path}/poster").parquet(f"{path}/poster").drop("del", "bunke")
