"""Several extracts -> one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import is_blank, to_number
from tallyloom.sources.colmap import fields_of
from tallyloom.sources.schema import FIELDS, METRICS, OUTPUT_ORDER


def canonical(df: DataFrame, drop: bool = True) -> DataFrame:
    """Columns renamed to their canonical fields (other columns stay), in the output order with the others behind.

    Fields whose action is ``drop`` (codes and barcodes) are left out; ``drop=False`` keeps them for a step that needs them, such as
    pseudonyms by store code.
    """
    df = df.toDF(*(c.strip() for c in df.columns))
    of = {h: f for f, h in fields_of(df.columns).items()}
    taken = set(of.values())
    # a column that belongs to no field but has a field's name gives way
    df = df.select(*(F.col(f"`{c}`").alias(of.get(c, f"{c}_other" if c in taken else c)) for c in df.columns))
    if drop:
        df = df.drop(*(f for f, action in FIELDS.items() if action == "drop"))
    first = [c for c in OUTPUT_ORDER if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def merged(tables: Sequence[DataFrame], aggregate: bool = False) -> DataFrame:
    """Union of the columns that all tables have, in the output order; types that differ are brought to text.

    No tables is an error. With ``aggregate`` the measures are summed over all other columns.
    """
    if not tables:
        raise ValueError("nothing to merge")
    common = set(tables[0].columns).intersection(*(t.columns for t in tables[1:]))
    order = [c for c in OUTPUT_ORDER if c in common] + sorted(common - set(OUTPUT_ORDER))
    kinds = {c: {dict(t.dtypes)[c] for t in tables} for c in order}
    same = lambda t: t.select(*(F.col(c) if len(kinds[c]) == 1 else F.col(c).cast("string").alias(c) for c in order))
    out = reduce(DataFrame.unionByName, map(same, tables))
    return aggregated(out) if aggregate else out


def aggregated(df: DataFrame) -> DataFrame:
    """Measures summed over all other columns, null keys included; what is no number counts as 0. Unchanged without measures or keys."""
    metrics = [c for c in METRICS if c in df.columns]
    keys = [c for c in df.columns if c not in metrics]
    if not metrics or not keys:
        return df
    number = lambda c: F.col(c) if not dict(df.dtypes)[c].startswith("string") else to_number(F.col(c))
    return df.groupBy(*keys).agg(*(F.sum(F.coalesce(number(c), F.lit(0))).alias(c) for c in metrics))


def corpus(df: DataFrame, order: str) -> DataFrame:
    """One row per name and brand, the last one by ``order``: its source categories as a list and joined; blank names are left out."""
    cats = F.filter(F.array(*(F.trim(c) for c in df.columns if c.startswith("category_"))), lambda c: ~is_blank(c))
    rows = df.filter(~is_blank(F.col("item_name"))).select(F.trim("item_name").alias("name"), F.trim(F.coalesce("brand", F.lit(""))).alias("brand"), F.col(order).alias("o"), cats.alias("src_cats"))
    last = rows.groupBy("name", "brand").agg(F.max_by("src_cats", "o").alias("src_cats"))
    return last.withColumn("source_category", F.array_join("src_cats", " / "))


def suggested_categories(df: DataFrame, file: str) -> DataFrame:
    """The different values of each file's first category level that holds any."""
    levels = [c for c in sorted(df.columns) if c.startswith("category_")]
    first = df.groupBy(file).agg(*(F.max(~is_blank(F.col(c))).alias(f"has_{c}") for c in levels))
    case = F.coalesce(*(F.when(F.col(f"has_{c}"), F.lit(k)) for k, c in enumerate(levels)))
    chosen = first.select(file, case.alias("level"))
    values = df.select(file, F.posexplode(F.array(*levels)).alias("level", "value")).filter(~is_blank(F.col("value")))
    return values.join(chosen, [file, "level"]).select(F.trim("value").alias("category")).distinct()
