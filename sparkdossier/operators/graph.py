"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.session import remove, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table; component is the least node id.

    Only joins and minimum aggregates with map-side combine are used, so a node with very many edges
    is pre-aggregated on each mapper, and no neighbour list is ever gathered. Each round is written to the
    shared folder, and the round before it removed. Edges with a null end and self loops add nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    e, path = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join stands on two plain exchanges and a hub's edges can be split among tasks.
        low, low_path = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e, new = written(small.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        remove(spark, path)
        remove(spark, low_path)
        path = new
        # Sums of 32-bit hashes, which no number of edges and no size of ids can carry beyond a long.
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long")), F.max("u")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
