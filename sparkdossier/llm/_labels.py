"""Bounded samples of labelled rows, drawn by hash so that they do not depend on partitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(column: str, parts: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def sample_ids(labelled: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``(doc_id, label)``, those first by hash; rows with a null in either are left out."""
    clean = labelled.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sample_texts(docs: DataFrame, ids: DataFrame, max_chars: int) -> pa.Table:
    """``(doc_id, text, label)`` of the sampled rows whose text has at most ``max_chars`` characters, by doc_id.

    ``ids`` has a bounded row count, so it is broadcast and the documents are not shuffled. Of the texts of a repeated doc_id
    that which is least by hash is taken, so at most a row for each sampled id goes to the driver.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    got = d.join(F.broadcast(ids), "doc_id").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    one = got.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"), F.max("label").alias("label"))
    return one.select("doc_id", "one.text", "label").toArrow().sort_by([("doc_id", "ascending")])
