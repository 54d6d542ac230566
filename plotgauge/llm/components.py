"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of `edges` (a, b) that isn't itself the smallest.

    Each round is two joins on nodes and writes its edges, which only get fewer or closer to stars, so rounds grow with the
    logarithm of the longest path. It ends when no node is both an end and a centre; nothing but that answer comes to the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = write_table(e, "edges")
    for _ in range(most_rounds):
        loose = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u").unionByName(e.join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").select("u"))
        if not loose.limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # both minima are written, so that the joins have plain tables on both sides and Spark can split a hot centre's edges
        least = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_table(large, "large")
        low = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = write_table(small.unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct(), "edges")
    raise RuntimeError("components did not settle")
