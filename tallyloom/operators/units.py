"""Contents of listings in common units (millilitres, grams, pieces), and any column of quantities in canonical units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.lexicon import KIND_BASE, concept, kind_of, words
from tallyloom.functions.measures import NUMBER, UNITS, lookup, parse_content, quantity_of
from tallyloom.session import cut

#: Share of a category's listings, of those whose name tells a kind, that must be of one kind for the category to tell it.
SPECIFIC = 0.9
READINGS = (
    "name_kind string, size double, size_base string, counted double, factor double, ounces boolean, weight_amount double, weight_base string, "
    "weight_ounces boolean, bare double"
)
_OUNCES = re.compile(r"\d\s*(?:oz|унц)")
_LAYERS = re.compile(r"(?<!\d)[1-4]\s*-?\s*сл(?![а-я])")


def readings(name: str | None, weight: str | None, unit: str | None) -> tuple:
    """What one listing states, column by column: the kind by the words of its name; size, counted pieces and multiplier by its name; content by
    weight and unit; a weight without unit. Layers of paper are no centilitres: one to four of them in a name of paper or beside a count."""
    low = (name or "").lower()
    kind = kind_of(filter(None, map(concept, words(name))))
    c = parse_content(name, layers=kind == "toilet_paper")
    if c.pieces is not None and c.size is not None and _LAYERS.search(low):
        c = parse_content(name, layers=True)
    w_amount = w_base = bare = None
    q = quantity_of(weight)
    if q is not None and q.value > 0:
        if q.exponents != NUMBER:
            w_amount, w_base = q.value, q.base()
        elif (u := lookup(unit)) is not None:
            w_amount, w_base = q.value * u.scale + u.offset, u.base()
        elif not (unit or "").strip():
            bare = q.value
    if w_base not in ("ml", "g", "pcs"):
        w_amount = w_base = None
    w_ounces = w_base == "g" and (lookup(unit) is UNITS["oz"] or bool(_OUNCES.search((weight or "").lower())))
    return kind, c.size, c.base, c.pieces, c.pieces_factor, bool(_OUNCES.search(low)), w_amount, w_base, w_ounces, bare


def _readings(name: pd.Series, weight: pd.Series, unit: pd.Series) -> pd.DataFrame:
    none = lambda s: s.astype(object).where(s.notna(), None)
    rows = [readings(*r) for r in zip(*map(none, (name, weight, unit)))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in READINGS.split(", ")])


def chain_of(file: Column) -> Column:
    return F.split(file, "_")[0]


def leaf_category(listings: DataFrame) -> Column:
    """The deepest of the middle category levels that is not blank."""
    levels = [F.nullif(F.trim(F.col(f"category_{k}")), F.lit("")) for k in (3, 2, 1) if f"category_{k}" in listings.columns]
    return F.coalesce(*levels, F.lit(None).cast("string"))


def category_kinds(rows: DataFrame) -> DataFrame:
    """(category, category_kind) of the categories that hold one kind: at least SPECIFIC of the listings whose name tells a kind agree on it.

    Learned from the whole table; one row per category and kind is shuffled for each map task.
    """
    counts = rows.filter("category is not null and name_kind is not null").groupBy("category", "name_kind").agg(F.count("*").alias("n"))
    best = counts.groupBy("category").agg(F.max_by("name_kind", F.struct("n", "name_kind")).alias("category_kind"), F.max("n").alias("top"), F.sum("n").alias("all"))
    return best.filter(F.col("top") >= F.col("all") * SPECIFIC).select("category", "category_kind")


def with_kind(rows: DataFrame) -> DataFrame:
    """Adds ``kind`` (by the category where that is specific, else by the name) and ``kind_base``, the unit that the kind is measured in."""
    bases = F.create_map(*(F.lit(x) for pair in KIND_BASE.items() for x in pair))
    j = rows.join(category_kinds(rows), "category", "left").withColumn("kind", F.coalesce("category_kind", "name_kind"))
    return j.withColumn("kind_base", F.try_element_at(bases, F.col("kind"))).drop("category_kind")


def with_stated(rows: DataFrame) -> DataFrame:
    """Adds to readings with a kind: ``amount`` and ``base`` by the name, ``pieces`` of the pack, and the weight's amount in the kind's unit.

    A size holds unless the kind is counted; a count is the content of counted and unknown kinds. Ounces of what is measured by volume are
    fluid ounces.
    """
    ml_of_ounce = F.lit(UNITS["floz"].scale / UNITS["oz"].scale)
    packs = F.coalesce("counted", F.lit(1.0)) * F.col("factor")
    by_size = F.col("size").isNotNull() & ~F.col("kind_base").eqNullSafe("pcs")
    by_count = ~by_size & F.col("counted").isNotNull() & F.coalesce(F.col("kind_base") == "pcs", F.lit(True))
    liquid = F.coalesce(F.col("kind_base") == "ml", F.lit(False))
    fluid = by_size & F.col("ounces") & liquid & (F.col("size_base") == "g")
    weighed = F.col("weight_amount").isNotNull() & ((F.col("weight_base") != "pcs") | F.coalesce(F.col("kind_base") == "pcs", F.lit(True)))
    w_fluid = weighed & F.col("weight_ounces") & liquid
    return rows.withColumns(
        {
            "amount": F.when(by_size, F.col("size") * packs * F.when(fluid, ml_of_ounce).otherwise(1.0)).when(by_count, packs),
            "base": F.when(fluid, "ml").when(by_size, F.col("size_base")).when(by_count, "pcs"),
            "pieces": F.when(by_count, 1.0).otherwise(packs),
            "weight_amount": F.when(weighed, F.col("weight_amount") * F.when(w_fluid, ml_of_ounce).otherwise(1.0)),
            "weight_base": F.when(w_fluid, "ml").when(weighed, F.col("weight_base")),
        }
    )


def chain_habits(rows: DataFrame) -> DataFrame:
    """(chain, base, scale): the scale of weights without a unit that most of a chain's listings with a stated content agree on.

    One row per chain and dimension, whatever the number of listings.
    """
    seen = rows.filter("bare > 0 and amount > 0 and base = kind_base and pieces = 1").select("chain", "base", F.round(F.log10(F.col("amount") / F.col("bare"))).cast("int").alias("power"))
    counts = seen.groupBy("chain", "base", "power").count()
    return counts.groupBy("chain", "base").agg(F.max_by(F.pow(F.lit(10.0), F.col("power")), F.struct("count", -F.col("power"))).alias("scale"))


def resolved(rows: DataFrame) -> DataFrame:
    """Rows of readings (with ``chain`` and ``category``; read three times, so give them written) with ``kind``, ``pieces``, ``content`` and ``content_base``.

    The name's content holds first, then weight with a unit (times the pieces of a pack that the name states), then a weight without unit by
    the habit of the chain.
    """
    own = [c for c in rows.columns if c not in {x.split()[0] for x in READINGS.split(", ")}]
    stated = with_stated(with_kind(rows))
    habits = chain_habits(stated).withColumnRenamed("base", "kind_base")
    j = stated.join(habits, ["chain", "kind_base"], "left")
    scale = F.coalesce("scale", F.when(F.col("kind_base") == "pcs", 1.0))  # a bare number of counted things is their count
    by_habit = F.col("bare") * scale * F.col("pieces")
    exact = F.coalesce("amount", F.col("weight_amount") * F.col("pieces"), by_habit)
    base = F.coalesce("base", "weight_base", F.when(by_habit.isNotNull(), F.col("kind_base")))
    return j.select(*own, "kind", "pieces", F.when(exact > 0, F.round(exact)).cast("long").alias("content"), base.alias("content_base"))


def contents(listings: DataFrame) -> DataFrame:
    """(listing_id, kind, amount, base_unit) of every listing; amount and unit are null where the content cannot be told.

    Texts are parsed once, and the readings written before the habits of chains and categories are learned from all of them. Null, empty or
    unreadable columns state nothing; repeated rows give repeated results; an empty table an empty one.
    """
    read = F.pandas_udf(_readings, READINGS)("item_name", "weight", "unit")
    rows = listings.select("listing_id", chain_of(F.col("source_file")).alias("chain"), leaf_category(listings).alias("category"), read.alias("r"))
    rows = cut(rows.select("listing_id", "chain", "category", "r.*"))
    return resolved(rows).select("listing_id", "kind", F.col("content").alias("amount"), F.col("content_base").alias("base_unit"))


def _measured(texts: pd.Series) -> pd.DataFrame:
    found = [quantity_of(t if isinstance(t, str) else None) for t in texts]
    rows = [(q.value, q.base(), list(q.exponents)) if q is not None else (None, None, None) for q in found]
    return pd.DataFrame(rows, columns=["value", "unit", "exponents"])


def measured(df: DataFrame, column: str, out: str = "measured") -> DataFrame:
    """Adds the struct ``out`` (value, unit, exponents): the quantity that a text column denotes, in the canonical unit of its vector.

    ``unit`` is null for a vector without a name (its value still compares with others of equal exponents). Null where the text is no quantity.
    """
    return df.withColumn(out, F.pandas_udf(_measured, "value double, unit string, exponents array<int>")(F.col(column)))
