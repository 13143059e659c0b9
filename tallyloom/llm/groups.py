"""Pairwise matches -> groups, by low-diameter decomposition.

Every vertex starts a cluster at an exponentially shifted time; clusters grow along the edges, a vertex joining the cluster that reaches it first
(its shift counted in), until no vertex changes. An edge is cut with a probability of at most BETA and a cluster's radius is at most the
greatest shift, ln n / BETA in expectation (Miller, Peng and Xu). Clusters become super-vertices, the edges between clusters the next
level's graph, until no edge is left. The assignments are then composed from the last level down, so that the whole work is that of a
geometric series over the first level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, path_exists, write_cut

#: Rate of the exponential shifts: the share of edges that a level leaves at most, in expectation.
BETA = 0.2


def shift(vertex: Column, level: int) -> Column:
    """An exponential variate that depends on vertex and level only, so that a lost task computes the same again."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(BETA)


def spread(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(id, cluster, at, changed): one step of growth. The vertices of ``state`` (the same columns) that have changed offer their cluster to their neighbours.

    Offers are combined before the shuffle: a vertex with a third of all edges gets one row per map task; where it is the one that offers,
    the adaptive skew join splits its edges (it has one row on the other side). Few changed vertices are broadcast by their written size,
    and the edges are then not shuffled.
    """
    offers = edges.join(state.filter("changed").select(F.col("id").alias("src"), "cluster", "at"), "src")
    offers = offers.select(F.col("dst").alias("id"), "cluster", (F.col("at") + 1).alias("at"), F.lit(None).cast("double").alias("own"))
    both = offers.unionByName(state.select("id", "cluster", "at", F.col("at").alias("own")))
    best = both.groupBy("id").agg(F.min_by("cluster", "at").alias("cluster"), F.min("at").alias("at"), F.min("own").alias("own"))
    return best.select("id", "cluster", "at", (F.col("at") < F.col("own")).alias("changed"))


def grow(edges: DataFrame, level: int) -> tuple[DataFrame, int]:
    """(id, cluster) of one level, and the number of steps, which go on until no vertex changes. ``edges`` (src, dst) holds both directions of each
    edge once. Each step is one small plan over written tables, so plans do not grow with the steps."""
    spark = edges.sparkSession
    start = (-shift(F.col("id"), level)).alias("at")
    state = edges.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("cluster"), start, F.lit(True).alias("changed"))
    schema, steps = state.schema, 0
    path = write_cut(state, "changed")
    while path_exists(spark, f"{path}/changed=true"):
        state = spark.read.schema(schema).parquet(path)
        path = write_cut(spread(edges, state), "changed")
        steps += 1
    return spark.read.schema(schema).parquet(path).select("id", "cluster"), steps


def contract(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """The edges between different clusters, each once."""
    one = edges.join(clusters.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").select("a", "dst")
    both = one.join(clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
    return both.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def connected_groups(pairs: DataFrame, a: str, b: str, trace: list[tuple[int, int]] | None = None) -> DataFrame:
    """(id, group_id) of every vertex that a pair ties to another one; ``group_id`` is the smallest id of the group.

    Pairs with a null side and pairs of a vertex with itself tie nothing; direction, order and repetition do not matter; no pairs give no
    rows. Nothing but whether rows are left reaches the driver. Each level is written to the shared checkpoint folder. ``trace``
    takes, for each level, the number of steps and of edges (both directions) that it began with; counting them takes a job a level.
    """
    one = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src is not null and dst is not null and src <> dst")
    edges = cut(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        clusters, steps = grow(edges, len(levels))
        levels.append(clusters)
        if trace is not None:
            trace.append((steps, edges.count()))
        edges = cut(contract(edges, clusters))
    if not levels:
        return one.select(F.col("src").alias("id"), F.col("src").alias("group_id")).limit(0)
    whole = levels.pop()
    while levels:
        below = levels.pop()
        up = whole.select(F.col("id").alias("cluster"), F.col("cluster").alias("top"))
        whole = cut(below.join(up, "cluster", "left").select("id", F.coalesce("top", "cluster").alias("cluster")))
    least = whole.groupBy("cluster").agg(F.min("id").alias("group_id"))
    return whole.join(least, "cluster").select("id", "group_id")


def decided_pairs(decisions: DataFrame) -> DataFrame:
    """(a, b): the pairs of names whose latest decision, in either direction, is a match.

    A null id is looked up by the exact spelling (outer spaces aside) on other rows; a row that still lacks a side ties nothing. Of decisions
    at the same time the one with the highest ``match_id`` holds; a null time is the earliest, a null verdict is no match.
    """
    sides = [("name_id", "item_name"), ("canonical_id", "canonical_name")]
    spelled = None
    for i, n in sides:
        s = decisions.filter(f"{i} is not null").select(F.trim(n).alias("spelling"), F.col(i).alias("known")).filter("spelling <> ''")
        spelled = s if spelled is None else spelled.unionByName(s)
    spelled = spelled.groupBy("spelling").agg(F.min("known").alias("known"))
    rows = decisions.select("match_id", "decided_at", F.lower(F.trim("verdict")).alias("verdict"), *(c for side in sides for c in side))
    for i, n in sides:
        whole, lacking = rows.filter(f"{i} is not null"), rows.filter(f"{i} is null").drop(i)
        found = lacking.withColumn("spelling", F.trim(n)).join(spelled, "spelling").withColumnRenamed("known", i).drop("spelling")
        rows = whole.unionByName(found)
    pair = rows.filter("name_id <> canonical_id").select(
        F.least("name_id", "canonical_id").alias("a"), F.greatest("name_id", "canonical_id").alias("b"), "verdict", "decided_at", "match_id"
    )
    last = pair.groupBy("a", "b").agg(F.max_by("verdict", F.struct("decided_at", "match_id")).alias("verdict"))
    return last.filter("verdict = 'match'").select("a", "b")
