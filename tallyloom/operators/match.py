"""Different spellings of a product's name -> one canonical name."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import is_blank, jaccard, normal_name, token_set, volume_key
from tallyloom.operators.components import components

#: Likeness from which two names of a block are one.
THRESHOLD = 0.90


def names_of(rows: DataFrame, order: str) -> DataFrame:
    """(name, brand, freq, first_seen): different names with their number of rows; the brand is that of the first row."""
    named = rows.filter(~is_blank(F.col("item_name"))).select(F.trim("item_name").alias("name"), F.trim(F.coalesce("brand", F.lit(""))).alias("brand"), F.col(order).alias("o"))
    return named.groupBy("name").agg(F.min_by("brand", "o").alias("brand"), F.count("*").alias("freq"), F.min("o").alias("first_seen"))


def names_of_all(frames: Sequence[DataFrame], order: str) -> DataFrame:
    """As ``names_of`` over several tables together: every row counts, and rows of an earlier table come first. Tables without ``item_name`` have no names."""
    rows = None
    for k, f in enumerate(frames):
        if "item_name" in f.columns:
            brand = F.col("brand").cast("string") if "brand" in f.columns else F.lit(None).cast("string")
            part = f.select(F.col("item_name").cast("string").alias("item_name"), brand.alias("brand"), F.struct(F.lit(k).alias("table"), F.col(order).cast("long").alias("row")).alias("_at"))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no table has names")
    return names_of(rows, "_at").withColumn("first_seen", F.col("first_seen.row") + F.col("first_seen.table") * F.lit(1 << 40))


def with_blocks(names: DataFrame) -> DataFrame:
    """Adds ``tokens`` and ``block``: the first word of the normalised name (the brand if it has none) and the volume key."""
    n = names.select("*", F.explode(F.array(normal_name(F.col("name")))).alias("normal"))
    first = F.when(F.col("normal") != "", F.split("normal", " ")[0]).otherwise(F.lower("brand"))
    return n.withColumn("tokens", F.sort_array(token_set(F.col("normal")))).withColumn("block", F.concat_ws("|", first, volume_key(F.col("name"))))


def blocks(names: DataFrame) -> DataFrame:
    """(block, n_names) of the blocks with two names or more."""
    return with_blocks(names).groupBy("block").agg(F.count_distinct("name").alias("n_names")).filter("n_names >= 2")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): pairs of different token sets of a block with a likeness of ``threshold`` or more.

    A set with fewer than t / (1 - t) words is like no other set, so only longer ones take part; of these two can only be alike if they share one
    of their n - ceil(t n) + 1 first words in the order of rarity. Sizes must differ by no more than the factor t.
    """
    least = math.ceil(round(threshold / (1 - threshold), 9)) if threshold < 1 else None
    long = sets.filter(F.size("tokens") >= least) if least is not None else sets.limit(0)
    counts = long.select(F.explode("tokens").alias("t")).groupBy("t").count()
    words = long.select("id", "block", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(counts, "t")
    ranked = words.groupBy("id", "block", "n").agg(F.array_sort(F.collect_list(F.struct("count", "t"))).alias("ws"))
    prefix = ranked.select("id", "block", "n", F.explode(F.slice("ws", 1, (F.col("n") - F.ceil(F.round(F.col("n") * threshold, 9)) + 1).cast("int"))).alias("w"))
    prefix = prefix.select("id", "block", "n", "w.t")
    a, b = (prefix.select("block", "t", F.col("id").alias(f"{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    pairs = a.join(b, ["block", "t"]).filter(f"a < b and na >= nb * {threshold} and nb >= na * {threshold}").select("a", "b").distinct()
    at = sets.select("id", "tokens")
    j = pairs.join(at.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(at.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return j.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("score")).filter(F.col("score") >= threshold)


def canonical_names(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, canonical_name) of the names that are not their own canonical one.

    Names of a block with equal word sets are one from the start (for names of up to eight words that is all, at 0.90), the others by pairs and
    their closure. Canonical is the most frequent name, then the longest, then the first seen. Names without words match nothing.
    """
    rows = with_blocks(names).filter(F.size("tokens") > 0)
    sets = rows.groupBy("block", "tokens").agg(F.min("first_seen").alias("id"))
    groups = components(similar_sets(sets, threshold), "a", "b")
    of = sets.join(groups, "id", "left").select("block", "tokens", F.coalesce("component", "id").alias("group"))
    members = rows.join(of, ["block", "tokens"]).select("name", "freq", "first_seen", "group")
    best = members.groupBy("group").agg(F.max_by("name", F.struct("freq", F.length("name"), -F.col("first_seen"))).alias("canonical_name"))
    return members.join(best, "group").filter("name <> canonical_name").select("name", "canonical_name")


def with_canonical(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds ``canonical_name``: the match of the name, else the name itself."""
    m = matches.select(F.col("name").alias("_name"), "canonical_name")
    j = rows.join(m, F.trim(rows["item_name"]) == F.col("_name"), "left")
    return j.select(*rows.columns, F.coalesce("canonical_name", F.trim("item_name")).alias("canonical_name"))
