"""Calendar columns: ISO weeks written in several ways, week numbers, period keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Week number 0 begins on this Monday.
EPOCH_MONDAY = "1970-01-05"


def first_week(year: Column) -> Column:
    """Number of week 1 of an ISO year, by the day count of its January 4 (proleptic Gregorian, as Spark's dates)."""
    y = year.cast("int") - 1
    january4 = y * 365 + _quarters(y) - 719159
    return F.floor((january4 - 4) / 7).cast("int")


def _quarters(y: Column) -> Column:
    return (F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)).cast("int")


def with_iso_week(df: DataFrame, text: str, year: str, loaded: str, out: str = "week_no") -> DataFrame:
    """Adds the week number of a week text such as ``27``, ``W27``, ``нед. 27``, ``202027``, ``2020-W27`` or ``27 неделя 2020``.

    The year is the text's own, else ``year``, else the latest one in which the week is not after ``loaded``. Null where no
    valid week can be read, week 53 of a year with 52 weeks included. The digits of a text are read once: an explode of one
    element is a stage of its own in generated code, which the optimizer neither merges nor repeats in filters.
    """
    cols = df.columns
    runs, day = F.col("_runs"), F.col(loaded).cast("date")
    df = df.select(*cols, F.explode(F.array(F.regexp_extract_all(F.col(text), F.lit(r"(\d+)"), F.lit(1)))).alias("_runs"))
    first, second, n = F.get(runs, F.lit(0)), F.get(runs, F.lit(1)), F.size(runs)
    joined, swapped = (n == 1) & (F.length(first) == 6), (n == 2) & (F.length(first) != 4)
    y = F.when(joined, F.substring(first, 1, 4)).when(swapped, second).when(n == 2, first)
    w = F.when(joined, F.substring(first, 5, 2)).when(swapped | (n == 1), first).when(n == 2, second)
    parts = F.struct(
        F.when(F.length(y) == 4, y.cast("int")).alias("_y"), F.when(F.length(w) <= 2, w.cast("int")).alias("_w")
    )
    df = df.select(*cols, F.inline(F.array(parts)))
    guess = F.year(F.date_add(F.trunc(day, "week"), 3)) - F.when(F.col("_w") > F.weekofyear(day), 1).otherwise(0)
    given = F.when(F.col(year).between(1, 9999), F.col(year).cast("int"))
    whole = F.struct(F.coalesce("_y", given, guess).alias("_y"), F.col("_w").alias("_w"))
    df = df.select(*cols, F.inline(F.array(whole)))
    known = F.col("_w").between(1, 52) | ((F.col("_w") == 53) & (first_week(F.col("_y") + 1) - first_week(F.col("_y")) == 53))
    return df.select(*cols, F.when(known, first_week(F.col("_y")) + F.col("_w") - 1).alias(out))


def monday_of_number(number: Column) -> Column:
    return F.date_add(F.lit(EPOCH_MONDAY).cast("date"), number * 7)


def iso_year_week(number: str) -> tuple[Column, Column]:
    """``year`` and ``week`` of the ISO week with this number."""
    monday = monday_of_number(F.col(number))
    return F.year(F.date_add(monday, 3)).alias("year"), F.weekofyear(monday).alias("week")


def period_key(year: Column, month: Column) -> Column:
    """``YYYY-MM``, or ``MM`` where there is no year; null and dirty numbers count as 0."""
    m = F.lpad(F.coalesce(month.try_cast("int"), F.lit(0)).cast("string"), 2, "0")
    return m if year is None else F.concat_ws("-", F.coalesce(year.try_cast("int"), F.lit(0)).cast("string"), m)
