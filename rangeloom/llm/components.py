"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): each linked node but the least of its component, with that least node.

    Every step joins on nodes and keeps at most as many rows as links; each is written to the shared folder, so
    nothing is collected and lost executors cost a step at most. Null ends and loops are no links, repeated links are one, other
    columns are ignored, and an empty table gives no rows.
    """
    spark = edges.sparkSession
    pair = F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e, at = table(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(pair.alias("p")).select("p.*").distinct(), "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(least, both["u"] == least["k"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_at = table(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, large["u"] == low["k"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where(F.col("u") != F.col("v")).distinct()
        new, new_at = table(small, "links")
        drop(spark, at, large_at)
        e, at = new, new_at
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count_distinct("v")).first())
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = now
