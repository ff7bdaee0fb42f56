"""Connected components of a link table, by alternating large-star and small-star rounds of joins and aggregations.

Every round is written to the shared folder, so lineage stays short and a lost executor costs one round. Nothing is
gathered on the driver but one count. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import table_in_shared_dir


def _both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node in ``links``: label is the least node of its component."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        near = _both_ways(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: every larger neighbour is tied to the least node around
        edges = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node itself, is tied to the least
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u")
        edges = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = table_in_shared_dir(edges, "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
