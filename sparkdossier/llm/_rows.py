"""Rows of a table of documents by their id and text, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``(doc_id, text_hash)`` of ``keys``: of rows that repeat both the least by a hash of its columns.

    The row is chosen by an aggregate that each mapper begins, before anything is joined, so a mapper sends one row for an id
    and text however often they are repeated. The keys are joined on the same two columns, so texts are shuffled once.
    """
    k = keys.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
    row = docs.select(F.struct("*").alias("key_row"), F.col("doc_id").cast("long").alias("key_id"), F.xxhash64(F.col("text").cast("string")).alias("key_hash"))
    plain = [F.col(f"key_row.`{f.name}`") for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = row.groupBy("key_id", "key_hash").agg(F.min_by("key_row", F.xxhash64(*plain) if plain else F.lit(0)).alias("key_row"))
    return one.join(k, ["key_id", "key_hash"], "left_semi").select("key_row.*")
