"""Totals and averages over trailing periods, inactive periods included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.periods import EPOCH_MONDAY, with_iso_week


def latest_per_step(df: DataFrame, keys: Sequence[str], step: str, value: Column, order: Column) -> DataFrame:
    """One row per keys and step: the ``value`` of the row with the greatest ``order``.

    An aggregate with map-side combine, so that a series with a third of all rows reaches its task as one row per step and
    map task.
    """
    return df.groupBy(*keys, step).agg(F.max_by(value, order).alias("value"))


def with_calendar(sparse: DataFrame, keys: Sequence[str], step: str, values: Sequence[str]) -> DataFrame:
    """Adds a row of zeros for each step without a row between the first and the last one of a series.

    ``sparse`` has one row per keys and step. Adds ``age``, 1 at the first step. Each row makes the rows up to the next one,
    so there is neither a join with a calendar nor a task larger than one series of distinct steps.
    """
    w = Window.partitionBy(*keys).orderBy(step)
    gap = F.coalesce(F.lead(step).over(w) - 1, F.col(step))
    first = F.min(step).over(Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    at = F.explode(F.sequence(F.col(step), F.col("_until"))).alias("_at")
    active = F.col("_at") == F.col(step)
    return (
        sparse.select(*keys, step, *values, gap.alias("_until"), first.alias("_first"))
        .select(*keys, step, *values, "_first", at)
        .select(
            *keys,
            F.col("_at").alias(step),
            (F.col("_at") - F.col("_first") + 1).alias("age"),
            *(F.when(active, F.coalesce(F.col(v), F.lit(0))).otherwise(0).alias(v) for v in values),
        )
    )


def rolling_totals(
    sparse: DataFrame, keys: Sequence[str], step: str, values: Mapping[str, int], periods: Sequence[int] = (4, 13)
) -> DataFrame:
    """Trailing totals and averages for every step of every series' life.

    ``sparse`` holds whole numbers (minor units), one row per keys and step; ``values`` maps a column to the minor units of
    one unit (1 for pieces, 100 for kopecks), so totals are exact. For each period p there are ``<value>_total_<p>`` and
    ``<value>_avg_<p>``; the denominator of an average is always p, also while a series is younger than that. Null values
    count as 0. An empty input gives an empty result.
    """
    dense = with_calendar(sparse, keys, step, list(values))
    w = Window.partitionBy(*keys).orderBy(step)
    totals = [
        F.sum(v).over(w.rangeBetween(-(p - 1), 0)).alias(f"_{v}_{p}") for p in periods for v in values
    ]
    out = dense.select(*keys, step, "age", *values, *totals)
    return out.select(
        *keys,
        step,
        "age",
        *((F.col(v) / F.lit(unit)).alias(v) for v, unit in values.items()),
        *((F.col(f"_{v}_{p}") / F.lit(unit)).alias(f"{v}_total_{p}") for p in periods for v, unit in values.items()),
        *((F.col(f"_{v}_{p}") / F.lit(unit * p)).alias(f"{v}_avg_{p}") for p in periods for v, unit in values.items()),
    )


def finite(c: Column) -> Column:
    """``c``, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


#: Weeks before and after its loading that a row may belong to: a century and a year. Without a bound one slip in a year fills a calendar.
BEFORE, AFTER = 5218, 53


def weekly_sales(sales: DataFrame) -> DataFrame:
    """Sales rows of a store and item with ``week_no``; rows without store, item or readable week are left out, and so are those whose week lies more than
    BEFORE weeks before or AFTER weeks after ``loaded_at``."""
    rows = sales.filter("store_code is not null and item_code is not null")
    rows = rows.select("row_id", "store_code", "item_code", "week", "year", "loaded_at", "qty_sold", "sales_rub", "cost_rub")
    loaded = F.floor(F.datediff(F.col("loaded_at").cast("date"), F.lit(EPOCH_MONDAY).cast("date")) / 7)
    rows = with_iso_week(rows, "week", "year", "loaded_at")
    # an explode of one element keeps the optimizer from writing the week out again for each comparison
    rows = rows.select(*(c for c in rows.columns if c != "week_no"), F.explode(F.array("week_no")).alias("week_no")).filter("week_no is not null")
    return rows.filter(F.coalesce(F.col("week_no").between(loaded - BEFORE, loaded + AFTER), F.lit(True)))


def weekly_totals(sales: DataFrame) -> DataFrame:
    """One row per store, item and week: the row loaded last (then the highest ``row_id``), as whole pieces and kopecks.

    A null ``loaded_at`` counts as the earliest, a null measure as 0.
    """
    value = F.struct(
        F.coalesce(F.round(finite(F.col("qty_sold"))).cast("long"), F.lit(0)).alias("qty_sold"),
        F.coalesce(F.round(finite(F.col("sales_rub")) * 100).cast("long"), F.lit(0)).alias("sales_rub"),
    )
    rows = weekly_sales(sales).select(
        "store_code", "item_code", "week_no", value.alias("v"), F.struct("loaded_at", "row_id").alias("o")
    )
    last = latest_per_step(rows, ["store_code", "item_code"], "week_no", F.col("v"), F.col("o"))
    return last.select("store_code", "item_code", "week_no", "value.*")
