"""Runs of the same work held against each other: is the result the same, and where is it not?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.functions import trees


def tree_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], json: str = "json") -> DataFrame:
    """``keys, sti, venstre, hoyre`` for each path at which the JSON of a row differs between two tables.

    One join by the keys, which name a row in each table; rows of equal text go no further. A row of one table only
    differs as a whole.
    """
    both = a.select(*keys, F.col(json).alias("_a")).join(b.select(*keys, F.col(json).alias("_b")), list(keys), "full_outer")
    unlike = both.where(~F.col("_a").eqNullSafe(F.col("_b")))
    found = unlike.select(*keys, F.explode(trees.differences(F.col("_a"), F.col("_b"))).alias("_d"))
    return found.select(*keys, "_d.sti", "_d.venstre", "_d.hoyre")


def determinism(runs: DataFrame, keys: Sequence[str], run: str, json: str = "json") -> DataFrame:
    """``keys, antall, avvikende, ulike``: runs of each work, those that differ from its first run, and different results.

    Runs are counted by result before results are counted by work, so work of very many runs is summed in parts. A result
    that cannot be read is one of its own.
    """
    text = F.coalesce(F.sha2(trees.canonical(F.col(json)), 256), F.lit(""))
    results = runs.select(*keys, F.col(run).alias("_run"), text.alias("_hash")).groupBy(*keys, "_hash")
    results = results.agg(F.count(F.lit(1)).alias("_n"), F.min("_run").alias("_first"))
    out = results.groupBy(*keys).agg(F.sum("_n").alias("antall"), F.min_by("_n", "_first").alias("_same"), F.count(F.lit(1)).alias("ulike"))
    return out.select(*keys, "antall", (F.col("antall") - F.col("_same")).alias("avvikende"), "ulike")
