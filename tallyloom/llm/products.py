"""Catalogue listings that offer the same product.

Listings -> readings (one parse of every listing) -> different descriptions -> pairs of descriptions within blocks -> levels of agreement ->
weights by expectation-maximisation -> links -> groups.
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.lexicon import SCENTS
from tallyloom.llm.attributes import VARIETIES, traits
from tallyloom.llm.groups import connected_groups
from tallyloom.llm.linkage import Weights, fit, near_words
from tallyloom.operators.units import READINGS, chain_of, leaf_category, resolved
from tallyloom.session import cut

#: Compared within a kind: brand (same, near, differ), variety and content (same, missing, differ).
FIELDS = ("brand", "variety", "content")
#: How many times as frequent as a spelling a brand a letter away must be for the two to be near: a slip is rarer than what was meant.
FREQUENT = 5
#: A pair is a link if its probability is this share at least of that of full agreement, the most that three fields can tell. Brands that are a letter apart
#: by chance agree otherwise no more than any two brands do, and stay far below; slips in a brand come close to it.
LEAST_SHARE = 0.25
_SCHEMA = f"brand string, concepts array<string>, {READINGS}"


def _traits(name, brand, maker, supplier, weight, unit) -> pd.DataFrame:
    none = lambda s: s.astype(object).where(s.notna(), None)
    return pd.DataFrame([traits(*r) for r in zip(*map(none, (name, brand, maker, supplier, weight, unit)))], columns=["brand", "concepts", *(c.split()[0] for c in READINGS.split(", "))])


_traits.__annotations__ = {k: pd.Series for k in ("name", "brand", "maker", "supplier", "weight", "unit")} | {"return": pd.DataFrame}


def with_traits(listings: DataFrame) -> DataFrame:
    """(listing_id, item_code, chain, brand, kind, variety, content, content_base, pieces); the content comes from the operator of units, in the same parse."""
    read = F.pandas_udf(_traits, _SCHEMA)("item_name", "brand", "manufacturer", "supplier", "weight", "unit")
    rows = listings.select("listing_id", "item_code", chain_of(F.col("source_file")).alias("chain"), leaf_category(listings).alias("category"), read.alias("r"))
    rows = resolved(cut(rows.select("listing_id", "item_code", "chain", "category", "r.*")))
    return rows.select("listing_id", "item_code", "chain", "brand", "kind", variety(F.col("concepts"), F.col("kind")).alias("variety"), "content", "content_base", "pieces")


def variety(concepts: Column, kind: Column) -> Column:
    """Of the concepts of a name those that tell varieties of its kind, joined by +; null where there are none."""
    words = lambda ws: F.array(*map(F.lit, ws))
    of_kind = F.lit(None).cast("array<string>")
    for k, ws in VARIETIES.items():
        of_kind = F.coalesce(F.when(kind == k, words(ws)), of_kind)
    return F.nullif(F.array_join(F.array_sort(F.array_intersect(concepts, F.coalesce(of_kind, words(SCENTS)))), "+"), F.lit(""))


def content_key() -> Column:
    """Amount, unit and pieces as one value; null where there is no amount."""
    return F.when(F.col("content").isNotNull(), F.concat_ws("|", F.col("content").cast("string"), "content_base", F.col("pieces").cast("string")))


def pattern_counts(described: DataFrame, near: DataFrame) -> list[tuple[tuple[str, ...], int]]:
    """The number of pairs of listings of one kind for each pattern of levels, over the whole table.

    No pair is made. ``described`` (kind, brand, variety, content as one key, n listings) has a kind and a brand in every row. For variety and
    content three conditions nest: equal, stated on both sides, anything. The sizes of the groups that agree under each of the nine
    combinations give the pairs that fulfil it, n * (n - 1) / 2 each, for equal brands and for any brand; those of ``near`` brands
    (w, other, each pair once) come from products of sizes. Differences of these sums are the patterns. At most 27 rows reach the driver.
    """
    nested = ("same", "both", "any")
    key = lambda c, how: {"same": F.col(c), "both": F.when(F.col(c).isNotNull(), F.lit("*")), "any": F.lit("*")}[how]
    ways = [
        F.struct(F.lit(f"{v} {c}").alias("way"), F.col("kind").alias("k"), key("variety", v).alias("v"), key("content", c).alias("c"))
        for v, c in product(nested, nested)
    ]
    sizes = described.select("brand", "n", F.inline(F.array(*ways))).filter("v is not null and c is not null").groupBy("brand", "way", "k", "v", "c").agg(F.sum("n").alias("n"))
    sizes = cut(sizes)
    pairs = lambda df: df.groupBy("way").agg(F.sum(F.expr("n * (n - 1.0) / 2")).alias("p"))
    other = sizes.select(F.col("brand").alias("other"), "way", "k", "v", "c", F.col("n").alias("m"))
    close = sizes.join(near, F.col("brand") == F.col("w")).join(other, ["other", "way", "k", "v", "c"]).groupBy("way").agg(F.sum(F.expr("n * m * 1.0")).alias("p"))
    everything = sizes.groupBy("way", "k", "v", "c").agg(F.sum("n").alias("n"))
    every = [df.select(F.lit(brand).alias("brand"), "way", F.col("p").cast("double").alias("p")) for brand, df in (("same", pairs(sizes)), ("near", close), ("any", pairs(everything)))]
    sums = {(r["brand"], r["way"]): r["p"] for r in every[0].unionByName(every[1]).unionByName(every[2]).collect()}
    parts = {"same": (("same", 1),), "differ": (("both", 1), ("same", -1)), "missing": (("any", 1), ("both", -1))}
    brands = {"same": (("same", 1),), "near": (("near", 1),), "differ": (("any", 1), ("same", -1), ("near", -1))}
    out = []
    for b, v, c in product(brands, parts, parts):
        n = sum(x * y * z * sums.get((i, f"{p} {q}"), 0.0) for i, x in brands[b] for p, y in parts[v] for q, z in parts[c])
        if n >= 0.5:
            out.append(((b, v, c), round(n)))
    return out


def candidates(described: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b, a level for each of FIELDS): pairs of different descriptions that share a block.

    A block is a kind and a brand, or one a slip away, together with the content or with the variety. In a block two descriptions meet only if they
    differ in no more than one of brand, variety and content: equal contents with one variety missing or brands near, equal varieties
    with one content missing. Thus a description meets its brand's few others, not all of its block.
    """
    side = lambda s: described.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "kind", "brand", "variety", "content")))
    a, b = side("a"), side("b")
    pairs = lambda j, brand, variety, content: j.select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), *(F.lit(x).alias(f) for f, x in zip(FIELDS, (brand, variety, content)))
    )
    same = lambda *cols: [F.col(f"{c}_a") == F.col(f"{c}_b") for c in ("kind", *cols)]
    lacking = lambda c: (F.col(f"{c}_a").isNull(), F.col(f"{c}_b").isNotNull())
    no_variety, with_variety = lacking("variety")
    no_content, with_content = lacking("content")
    close = near.select(F.col("w").alias("brand_a"), F.col("other").alias("near_b"))
    a_near = a.join(close, "brand_a")
    found = pairs(a.filter(no_variety).join(b.filter(with_variety), same("brand", "content")), "same", "missing", "same")
    found = found.unionByName(pairs(a.filter(no_content).join(b.filter(with_content), same("brand", "variety")), "same", "same", "missing"))
    at = F.col("near_b") == F.col("brand_b")
    found = found.unionByName(pairs(a_near.join(b, [*same("variety", "content"), at]), "near", "same", "same"))
    # a slip in the brand and something missing: each direction of the pair of brands
    back = near.select(F.col("other").alias("brand_a"), F.col("w").alias("near_b"))
    either = a.join(close.unionByName(back), "brand_a")
    found = found.unionByName(pairs(either.filter(no_content).join(b.filter(with_content), [*same("variety"), at]), "near", "same", "missing"))
    return found.unionByName(pairs(either.filter(no_variety).join(b.filter(with_variety), [*same("content"), at]), "near", "missing", "same"))


def with_weights(pairs: DataFrame, weights: Weights) -> DataFrame:
    """``pairs`` with ``probability`` and ``share``, its part of the probability of full agreement: a table of the 27 patterns, joined."""
    parts = ("same", "missing", "differ")
    whole = weights.probability(("same",) * len(FIELDS))
    rows = [(*p, (x := float(weights.probability(p))), x / whole) for p in product(("same", "near", "differ"), parts, parts)]
    schema = ", ".join(f"{f} string" for f in FIELDS) + ", probability double, share double"
    return pairs.join(F.broadcast(pairs.sparkSession.createDataFrame(rows, schema)), list(FIELDS))


def product_links(described: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, levels, probability) of the pairs that are links, and (id) of the descriptions that fit several products.

    A pair is a link from LEAST_SHARE on. Something missing fits every product that has the rest, so a description that lacks the content
    or the variety is linked only where all its links lead to one such description; where the content is missing the statement of the
    problem takes that as enough, whatever the weights.
    """
    weights = fit(pattern_counts(described, near) or [(("differ",) * len(FIELDS), 1)], ("same", "near"), 0.01, silent=("missing",))
    scored = with_weights(candidates(described, near), weights)
    links = cut(scored.filter((F.col("share") >= LEAST_SHARE) | ((F.col("content") == "missing") & (F.col("brand") == "same"))))
    lacking = (F.col("variety") == "missing") | (F.col("content") == "missing")
    part = described.filter("variety is null or content is null").select("id")
    ends = links.filter(lacking)
    # the side that lacks something, and the product that it may belong to
    sides = ends.withColumn("other", F.col("b")).withColumnRenamed("a", "id").drop("b").unionByName(ends.withColumn("other", F.col("a")).withColumnRenamed("b", "id").drop("a"))
    sides = sides.join(part, "id", "left_semi").join(part.withColumnRenamed("id", "other"), "other", "left_anti")
    # equal brands come before near ones
    best = sides.groupBy("id").agg(F.min(F.col("brand") != "same").alias("near_only"))
    chosen = sides.join(best, "id").filter((F.col("brand") != "same") == F.col("near_only"))
    fits = cut(chosen.groupBy("id").agg(F.min("other").alias("b"), F.max("other").alias("high"), *(F.min(c).alias(c) for c in (*FIELDS, "probability"))))
    led = fits.filter("b = high").select(F.col("id").alias("a"), "b", *FIELDS, "probability")
    return links.filter(~lacking).select("a", "b", *FIELDS, "probability").unionByName(led), fits.filter("b <> high").select("id")


def same_product(listings: DataFrame) -> DataFrame:
    """(listing_id, product): listings of one product share the number, the smallest listing_id among them.

    Listings of equal descriptions (brand, kind, variety, content, pieces) are one vertex from the start, so a product with very many listings makes
    no pairs. Different descriptions are compared within blocks, weighed and linked (``product_links``), and the links closed to groups. The
    weights are fitted on all pairs of listings of one kind. Listings without content that have no product with one to belong to are together the only product
    of their other traits; those that fit several products stay alone, each for itself, as do listings without variety that nothing is
    linked to, and listings without brand or kind; but rows of a chain with one item code are deliveries of one listing. Null columns state nothing; repeated rows count once; an empty table gives an empty one.
    """
    rows = cut(with_traits(listings))
    keyed = rows.withColumn("content", content_key()).drop("content_base", "pieces")
    known = keyed.filter("brand is not null and kind is not null")
    described = cut(known.groupBy("brand", "kind", "variety", "content").agg(F.min("listing_id").alias("id"), F.countDistinct("listing_id").alias("n")))
    near = cut(near_words(described.groupBy(F.col("brand").alias("w")).agg(F.sum("n").alias("n"))).filter(F.col("w") < F.col("other")).filter(F.greatest("n", "other_n") >= F.least("n", "other_n") * FREQUENT).select("w", "other"))
    links, open_ended = product_links(described, near)
    groups = connected_groups(links, "a", "b")
    of = described.join(groups, "id", "left").join(open_ended.withColumn("alone", F.lit(True)), "id", "left")
    product_of = F.when(F.col("variety").isNotNull() & F.col("alone").isNull() | F.col("group_id").isNotNull(), F.coalesce("group_id", "id"))
    of = of.select("brand", "kind", F.col("variety").alias("v"), F.col("content").alias("c"), product_of.alias("p"))
    at = keyed.select("listing_id", "item_code", "chain", F.col("brand").alias("rb"), F.col("kind").alias("rk"), F.col("variety").alias("rv"), F.col("content").alias("rc"))
    j = at.join(of, (F.col("rb") == F.col("brand")) & (F.col("rk") == F.col("kind")) & F.col("rv").eqNullSafe(F.col("v")) & F.col("rc").eqNullSafe(F.col("c")), "left")
    out = j.select("listing_id", "chain", "item_code", "p")
    delivered = out.join(out.filter("p is null").select("chain", "item_code").distinct(), ["chain", "item_code"], "left_semi")
    delivered = delivered.groupBy("chain", "item_code").agg(F.min("p").alias("by_code"), F.min("listing_id").alias("first_id"))
    out = out.join(delivered, ["chain", "item_code"], "left")
    # a listing delivered with two descriptions under one id belongs to the smaller product
    out = out.groupBy("listing_id").agg(F.min(F.coalesce("p", "by_code", "first_id", "listing_id")).alias("p"))
    return out.join(out.groupBy("p").agg(F.min("listing_id").alias("product")), "p").select("listing_id", "product")
