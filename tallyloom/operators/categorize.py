"""Products -> target categories with a confidence, by columns alone (no Python at run time)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import STOP_WORDS, category_tokens, composite_key, is_blank, normal_category, weighted_jaccard
from tallyloom.operators.keywords import CATEGORY_CLUSTERS, PRODUCT_CLUSTERS, SOURCE_PHRASES, TARGET_CATEGORIES


@dataclass(frozen=True)
class Target:
    """A target category, prepared: its normalised text, words and clusters."""

    name: str
    norm: str
    tokens: tuple[str, ...]
    clusters: tuple[str, ...]


def targets(names: Sequence[str] = TARGET_CATEGORIES) -> list[Target]:
    """Prepared target categories, in the order given. A cluster belongs to a category that holds one of the cluster's substrings for categories,
    or one of its first three for products."""
    out = []
    for name in names:
        norm = re.sub(r"\b\d+[.,]?\d*\s*(мл|л|г|гр|кг|шт|уп|пак|рул|ml|l|g|kg|pcs)\b", " ", name.lower().strip())
        norm = " ".join(re.sub(r"[^\w\s]", " ", norm).split())
        tokens = tuple(dict.fromkeys(t for t in norm.split() if len(t) >= 3 and t not in STOP_WORDS))
        clusters = [c for c, subs in CATEGORY_CLUSTERS.items() if any(s in norm for s in subs)]
        clusters += [c for c, subs in PRODUCT_CLUSTERS.items() if c not in clusters and any(s in norm for s in subs[:3])]
        out.append(Target(name, norm, tokens, tuple(clusters)))
    return out


def clusters_in(text: Column, clusters: Mapping[str, Sequence[str]]) -> Column:
    """The clusters of which ``text`` holds a substring."""
    def any_of(subs: Sequence[str]) -> Column:
        c = F.contains(text, F.lit(subs[0]))
        for s in subs[1:]:
            c = c | F.contains(text, F.lit(s))
        return c

    return F.array_compact(F.array(*(F.when(any_of(subs), F.lit(c)) for c, subs in clusters.items())))


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def best(scores: Sequence[tuple[Target, Column]]) -> Column:
    """(score, name) of the greatest score above 0; of equal ones the first."""
    options = [F.when(s > 0, F.struct(s.alias("score"), F.lit(-k).alias("order"), F.lit(t.name).alias("name"))) for k, (t, s) in enumerate(scores)]
    return F.array_max(F.array_compact(F.array(*options)))


def overlap(found: Column, goals: Sequence[Target]) -> Column:
    """Best target by common clusters over the greater number of clusters of either side; also ``common`` and ``of`` as whole numbers."""
    n = F.size(found)
    return best([(t, F.size(F.array_intersect(found, strings(t.clusters))) / F.greatest(n, F.lit(len(t.clusters)))) for t in goals if t.clusters])


def confidence(base: float, slope: float, score: Column) -> Column:
    """round(min(base + slope x score, 0.93), 2). Scores of clusters are fractions of small numbers, for which the values are made beforehand."""
    fractions = sorted({(a, b) for b in range(1, 41) for a in range(1, b + 1)})
    known = {round(a / b, 9): round(min(base + slope * (a / b), 0.93), 2) for a, b in fractions}
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, F.round(score, 9)), F.round(F.least(base + slope * score, F.lit(0.93)), 2))


def result(name: Column, conf: Column) -> Column:
    return F.struct(name.alias("target_category"), conf.alias("category_confidence"))


NOTHING = ("", 0.0)


def by_source(df: DataFrame, cats: str, goals: Sequence[Target], out: str = "by_source") -> DataFrame:
    """Adds the category told by source categories (an array of texts), or null: a target's text within them (0.95), clusters of phrases,
    or common words of 0.20 and more by length."""
    cols = df.columns
    stage = df.select(*cols, F.explode(F.array(normal_category(F.array_join(cats, " ")))).alias("_n"))
    found = F.struct(clusters_in(F.col("_n"), SOURCE_PHRASES).alias("_c"), category_tokens(F.col("_n")).alias("_t"))
    stage = stage.select(*cols, "_n", F.inline(F.array(found)))
    verbatim = F.coalesce(*(F.when(F.contains("_n", F.lit(t.norm)), F.lit(t.name)) for t in goals if t.norm))
    words = best([(t, weighted_jaccard(F.col("_t"), strings(t.tokens))) for t in goals if t.tokens])
    stage = stage.select(*cols, F.inline(F.array(F.struct(verbatim.alias("_v"), overlap(F.col("_c"), goals).alias("_o"), words.alias("_w")))))
    told = (
        F.when(F.col("_v").isNotNull(), result(F.col("_v"), F.lit(0.95)))
        .when(F.col("_o").isNotNull(), result(F.col("_o.name"), confidence(0.60, 0.35, F.col("_o.score"))))
        .when(F.col("_w.score") >= 0.20, result(F.col("_w.name"), F.round(F.least(0.55 + 0.40 * F.col("_w.score"), F.lit(0.93)), 2)))
    )
    return stage.select(*cols, told.alias(out))


def by_name(df: DataFrame, name: str, goals: Sequence[Target], out: str = "by_name") -> DataFrame:
    """Adds the category told by the product's name: clusters of keywords, or without any of them common words (0.30). Empty with 0 if neither."""
    cols = df.columns
    stage = df.select(*cols, F.explode(F.array(normal_category(F.coalesce(F.col(name), F.lit(""))))).alias("_n"))
    found = F.struct(clusters_in(F.col("_n"), PRODUCT_CLUSTERS).alias("_c"), category_tokens(F.col("_n")).alias("_t"))
    stage = stage.select(*cols, F.inline(F.array(found)))
    words = best([(t, weighted_jaccard(F.col("_t"), strings(t.tokens))) for t in goals if t.tokens])
    stage = stage.select(*cols, F.inline(F.array(F.struct((F.size("_c") > 0).alias("_any"), overlap(F.col("_c"), goals).alias("_o"), words.alias("_w")))))
    told = (
        F.when(F.col("_o").isNotNull(), result(F.col("_o.name"), confidence(0.50, 0.45, F.col("_o.score"))))
        .when(~F.col("_any") & F.col("_w").isNotNull(), result(F.col("_w.name"), F.lit(0.30)))
        .otherwise(result(F.lit(NOTHING[0]), F.lit(NOTHING[1])))
    )
    return stage.select(*cols, told.alias(out))


def classified(products: DataFrame, names: Sequence[str] = TARGET_CATEGORIES) -> DataFrame:
    """Adds ``target_category`` and ``category_confidence`` to products (name, src_cats): by source categories, else by name."""
    goals = targets(names)
    cols = products.columns
    rows = products.withColumn("src_cats", F.filter(F.coalesce("src_cats", strings([])), lambda c: ~is_blank(c)))
    both = by_name(by_source(rows, "src_cats", goals), "name", goals)
    told = F.coalesce(F.when(F.size("src_cats") > 0, F.col("by_source")), F.col("by_name"))
    return both.select(*cols, told["target_category"].alias("target_category"), told["category_confidence"].alias("category_confidence"))


def with_precedence(products: DataFrame, overrides: DataFrame, cache: DataFrame) -> DataFrame:
    """Category of each name and brand: the override (confidence 1 if it states none), else the cached one, else empty with 0.

    ``overrides`` and ``cache`` have key, target_category and category_confidence, one row per key.
    """
    keyed = products.withColumn("key", composite_key(F.col("name"), F.col("brand")))
    o = overrides.select("key", F.col("target_category").alias("_oc"), F.coalesce("category_confidence", F.lit(1.0)).alias("_of"))
    c = cache.select("key", F.col("target_category").alias("_cc"), F.col("category_confidence").alias("_cf"))
    j = keyed.join(o, "key", "left").join(c, "key", "left")
    return j.select(
        *products.columns,
        F.coalesce("_oc", "_cc", F.lit("")).alias("target_category"),
        F.when(F.col("_oc").isNotNull(), F.col("_of")).otherwise(F.coalesce("_cf", F.lit(0.0))).alias("category_confidence"),
    )


def apply_categories(rows: DataFrame, order: str, overrides: DataFrame | None = None, names: Sequence[str] = TARGET_CATEGORIES, retry_empty: bool = True) -> DataFrame:
    """``rows`` (item_name, brand, category_*) with category and confidence: different products are classified once and joined back.

    Of the rows of one key the first by ``order`` that gets a category decides; with ``retry_empty=False`` the first row, category or not.
    """
    cats = F.array(*(c for c in rows.columns if c.startswith("category_")))
    keyed = rows.withColumn("_key", composite_key(F.col("item_name"), F.col("brand")))
    products = keyed.filter(~is_blank(F.col("item_name"))).groupBy("_key", F.col("item_name").alias("name"), cats.alias("src_cats")).agg(F.min(order).alias("_first"))
    told = classified(products, names)
    empty = (F.col("target_category") == "") if retry_empty else F.lit(False)
    first = F.min_by(F.struct("target_category", "category_confidence"), F.struct(empty, F.col("_first"), F.col("name"))).alias("t")
    cache = told.groupBy("_key").agg(first).select("_key", "t.*")
    j = keyed.join(cache, "_key", "left")
    if overrides is not None:
        o = overrides.select(F.col("key").alias("_key"), F.col("target_category").alias("_oc"), F.coalesce("category_confidence", F.lit(1.0)).alias("_of"))
        j = j.join(o, "_key", "left")
    else:
        j = j.withColumns({"_oc": F.lit(None).cast("string"), "_of": F.lit(None).cast("double")})
    return j.select(
        *rows.columns, F.coalesce("_oc", "target_category", F.lit("")).alias("target_category"), F.coalesce("_of", "category_confidence", F.lit(0.0)).alias("category_confidence")
    )


def edited(original: DataFrame, changed: DataFrame) -> DataFrame:
    """Overrides (key, target_category, category_confidence 1) of the products whose category was changed by hand."""
    o = original.select("name", "brand", F.col("target_category").alias("_was"))
    j = changed.join(o, ["name", "brand"]).filter(~F.col("target_category").eqNullSafe(F.col("_was")))
    return j.select(composite_key(F.col("name"), F.col("brand")).alias("key"), "target_category", F.lit(1.0).alias("category_confidence"))


def new_keys(products: DataFrame, cache: DataFrame, overrides: DataFrame) -> DataFrame:
    """Products that neither the cache (an empty category counts as none) nor the overrides know."""
    keyed = products.withColumn("key", composite_key(F.col("name"), F.col("brand")))
    return keyed.join(cache.filter("target_category <> ''"), "key", "left_anti").join(overrides, "key", "left_anti").drop("key")
