"""Connected components of small pair tables by repeated linking to the smallest neighbour and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): every vertex of a pair with the smallest id it is tied to. Null sides and loops tie nothing.

    Large-star and small-star in turn: each vertex points at the smallest of its neighbours, and its other neighbours at that one, so that paths
    halve. Minima are combined before each shuffle. Stops when no edge changes; only a count reaches the driver.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def star(df: DataFrame, larger: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else df
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("m", "u").alias("m"))
        j = both.join(least, "u")
        kept = j.filter("v > u") if larger else j
        linked = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
        return linked.filter("u <> v").distinct()

    while True:
        after = cut(star(star(edges, True), False))
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
