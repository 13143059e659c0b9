"""Questions about consolidated sales. Each function takes a DataFrame of canonical columns and returns one; nothing is collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import is_blank
from tallyloom.session import cut


def measure(name: str) -> Column:
    """revenue, qty, cost or profit; a missing number counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return {"revenue": zero("sales_rub"), "qty": zero("qty_sold"), "cost": zero("cost_rub"), "profit": zero("sales_rub") - zero("cost_rub")}[name]


def filtered(df: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose trimmed text is among the chosen values, for every column that has a choice."""
    for column, values in chosen.items():
        if values:
            df = df.filter(F.trim(F.col(column).cast("string")).isin(*values))
    return df


def options(df: DataFrame, column: str) -> DataFrame:
    """The different values of a column to choose from; null, blank and ``nan`` are none."""
    value = F.trim(F.col(column).cast("string"))
    return df.select(value.alias("value")).filter(~is_blank(F.col("value"))).distinct()


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def kpi(df: DataFrame) -> DataFrame:
    """One row: total revenue, items, average per item, stores, gross margin in percent (null without revenue)."""
    s = df.agg(
        F.coalesce(F.sum(measure("revenue")), F.lit(0)).alias("rev"), F.coalesce(F.sum(measure("cost")), F.lit(0)).alias("cost"),
        F.count_distinct("item_name").alias("items"), F.count_distinct("store_name").alias("stores"),
    )
    return s.select(
        F.col("rev").cast("double").alias("revenue"), "items", ratio(F.col("rev"), F.greatest("items", F.lit(1))).alias("revenue_per_item"), "stores",
        (ratio(F.col("rev") - F.col("cost"), F.col("rev")) * 100).alias("gross_margin_pct"),
    )


def sums(df: DataFrame, keys: Sequence[str], *measures: str) -> DataFrame:
    """Sums by keys; rows with a null key are left out."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*(F.sum(measure(m)).alias(m) for m in measures))


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def share(df: DataFrame, key: str, name: str = "revenue") -> DataFrame:
    """Sum and share in percent by a key; blank keys are left out, also of the whole."""
    s = sums(df.filter(~is_blank(F.col(key))), [key], name)
    whole = s.agg(F.sum(name).alias("whole"))
    j = s.crossJoin(F.broadcast(whole))  # one row
    return j.select(key, F.col(name).cast("double").alias(name), (ratio(F.col(name), F.col("whole")) * 100).alias("share_pct"))


def coverage(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, rows with a key that is not blank, their share in percent."""
    s = df.agg(F.count("*").alias("n_rows"), F.count_if(~is_blank(F.col(key))).alias("n_with"))
    return s.select("n_rows", "n_with", (ratio(F.col("n_with"), F.col("n_rows")) * 100).alias("coverage_pct"))


def summary(df: DataFrame, key: str) -> DataFrame:
    """Revenue, quantity, cost and profit by a key."""
    s = sums(df, [key], "revenue", "qty", "cost")
    return as_double(s.withColumn("profit", F.col("revenue") - F.col("cost")), "revenue", "qty", "cost", "profit")


def store_ranking(df: DataFrame, n: int = 50) -> DataFrame:
    """The n stores with the greatest revenue (rounded to whole roubles), with the number of their items."""
    s = df.filter("store_name is not null").groupBy("store_name").agg(F.sum(measure("revenue")).alias("r"), F.count_distinct("item_name").alias("items"))
    return s.orderBy(F.desc("r"), "store_name").limit(n).select("store_name", F.round("r", 0).cast("double").alias("revenue"), "items")


def top(df: DataFrame, key: str, n: int = 15, name: str = "revenue", width: int = 42) -> DataFrame:
    """The n keys with the greatest sum; ties by key; labels cut to ``width``."""
    s = sums(df, [key], name).orderBy(F.desc(name), key).limit(n)
    return s.select(F.substring(key, 1, width).alias("label"), key, F.col(name).cast("double").alias(name))


def running_total(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds ``running`` (sum of ``value`` from the greatest down, ties by key) and ``whole`` without sorting everything in one task.

    Rows are put into ranges of value and key, as many as the session has shuffle partitions, so that a value shared by very many keys is
    split as well; a window runs inside each range, and the ranges' totals, one row each, are added to it.
    """
    rows = cut(df.repartitionByRange(F.desc(value), F.col(key)).withColumn("_range", F.spark_partition_id()))
    totals = rows.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"), F.sum("_total").over(everything).alias("whole"))
    inside = Window.partitionBy("_range").orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, 0)
    j = rows.withColumn("_run", F.sum(value).over(inside)).join(F.broadcast(starts), "_range")  # one row per range
    return j.withColumn("running", F.col("_run") + F.col("_start")).drop("_range", "_run", "_start")


def abc(df: DataFrame, key: str, name: str = "revenue") -> DataFrame:
    """Class A up to 80 % of the running total of positive sums, B up to 95 %, C beyond."""
    s = running_total(sums(df, [key], name).filter(F.col(name) > 0), name, key)
    part = ratio(F.col("running"), F.col("whole"))
    return s.select(
        key, F.col(name).cast("double").alias(name), part.alias("cum_share"), F.when(part <= 0.80, "A").when(part <= 0.95, "B").otherwise("C").alias("abc")
    )


def abc_summary(df: DataFrame, key: str, name: str = "revenue") -> DataFrame:
    s = abc(df, key, name).groupBy("abc").agg(F.count("*").alias("n"), F.sum(F.col(name).cast("decimal(38,4)")).alias("total"))
    w = s.agg(F.sum("total").alias("whole"))
    return s.crossJoin(F.broadcast(w)).select("abc", "n", F.col("total").cast("double").alias("total"), F.round(ratio(F.col("total"), F.col("whole")) * 100, 1).alias("share_pct"))


def period_moments(df: DataFrame, key: str, period: str, name: str, last: bool) -> DataFrame:
    """Per key over all periods of the data, absent ones as 0: n, mean, std (sample), and with ``last`` the last period's sum, which then stays
    out of the rest. No grid of keys and periods is made; the zeros enter through n."""
    s = sums(df, [key, period], name).withColumn("v", F.col(name).cast("double"))
    axis = sums(df, [period], name).agg(F.count("*").alias("periods"), F.max(period).alias("last_period"))
    j = s.crossJoin(F.broadcast(axis))  # one row
    inside = F.lit(True) if not last else F.col(period) < F.col("last_period")
    base = F.when(inside, F.col("v"))
    g = j.groupBy(key).agg(
        F.max("periods").alias("periods"), F.count(base).alias("k"), F.avg(base).alias("m"), F.var_pop(base).alias("s2"),
        F.sum(F.when(F.col(period) == F.col("last_period"), F.col("v")).otherwise(0.0)).alias("last_value"),
    )
    n = F.col("periods") - (1 if last else 0)
    m, k = F.coalesce("m", F.lit(0.0)), F.col("k")
    # squared deviations of the periods that are there, and of the zeros' mean from theirs: sums of squares, so nothing cancels
    squares = F.coalesce("s2", F.lit(0.0)) * k + m * m * k * (n - k) / n
    return g.select(key, "periods", (m * k / n).alias("mean"), F.sqrt(F.try_divide(squares, n - 1)).alias("std"), "last_value")


def xyz(df: DataFrame, key: str, period: str, name: str = "revenue") -> DataFrame:
    """Class by the coefficient of variation over all periods: X up to 0.10, Y up to 0.25, else Z; no rows under three periods.

    A mean of 0 makes it infinite, a negative mean negative and so class X.
    """
    m = period_moments(df, key, period, name, last=False).filter("periods >= 3")
    cv = F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("std"), F.col("mean")))
    m = m.withColumn("cv", F.round(cv, 6))
    return m.select(key, "cv", F.when(F.col("cv") <= 0.10, "X").when(F.col("cv") <= 0.25, "Y").otherwise("Z").alias("xyz"))


def abc_xyz(df: DataFrame, key: str, period: str) -> DataFrame:
    """Number of keys by both classes; keys without an XYZ class count as Z."""
    j = abc(df, key).join(xyz(df, key, period), key, "left").withColumn("xyz", F.coalesce("xyz", F.lit("Z")))
    counts = (F.count_if(F.col("xyz") == c).alias(c.lower()) for c in "XYZ")
    return j.groupBy("abc").agg(*counts)


def pareto(df: DataFrame, key: str, n: int = 40, width: int = 30) -> DataFrame:
    """The n greatest keys with rank, sum and cumulative share of everything."""
    s = sums(df, [key], "revenue")
    whole = s.agg(F.sum("revenue").alias("whole"))
    first = s.orderBy(F.desc("revenue"), key).limit(n)
    w = Window.orderBy(F.desc("revenue"), key)  # over n rows
    r = first.select(key, "revenue", F.row_number().over(w).alias("rank"), F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    j = r.crossJoin(F.broadcast(whole))
    return j.select("rank", F.substring(key, 1, width).alias("label"), F.col("revenue").cast("double").alias("revenue"), (ratio(F.col("run"), F.col("whole")) * 100).alias("cum_pct"))


def compare(df: DataFrame, key: str, period: str, first: str | None = None, second: str | None = None) -> DataFrame:
    """Sums of two periods (the first and the last if not given), their difference, and that in percent (null on a base of 0), in one pass."""
    s = sums(df, [key, period], "revenue")
    ends = s.agg(F.min(period).alias("p1"), F.max(period).alias("p2"))
    if first is not None:
        ends = ends.select(F.lit(first).alias("p1"), F.lit(second).alias("p2"))
    j = s.crossJoin(F.broadcast(ends))
    of = lambda p: F.sum(F.when(F.col(period) == F.col(p), F.col("revenue")).otherwise(0)).alias(p[-1])
    g = j.filter((F.col(period) == F.col("p1")) | (F.col(period) == F.col("p2"))).groupBy(key).agg(of("p1"), of("p2"))
    a, b = F.col("1"), F.col("2")
    return g.select(key, a.cast("double").alias("period_a"), b.cast("double").alias("period_b"), (b - a).cast("double").alias("delta"), (ratio(b - a, a) * 100).alias("delta_pct"))


def movers(df: DataFrame, key: str, period: str, n: int = 10) -> DataFrame:
    """The n greatest and the n smallest differences, each key once."""
    c = compare(df, key, period)
    up, down = c.orderBy(F.desc("delta"), key).limit(n), c.orderBy("delta", key).limit(n)
    return up.unionByName(down).dropDuplicates([key])


def low_margin(df: DataFrame, key: str, below: float = 5.0, n: int = 100) -> DataFrame:
    """Keys with a margin under ``below`` percent, the lowest first."""
    s = sums(df, [key], "revenue", "cost")
    margin = ratio(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100
    s = s.select(key, F.col("revenue").cast("double").alias("revenue"), F.col("cost").cast("double").alias("cost"), margin.alias("margin_pct"))
    return s.filter(F.col("margin_pct") < below).orderBy("margin_pct", key).limit(n)


def last_period_anomalies(df: DataFrame, key: str, period: str, least: float = 2.0) -> DataFrame:
    """Keys whose last period lies ``least`` deviations or more from the mean of the periods before (three periods at least; no deviation, no case)."""
    m = period_moments(df, key, period, "revenue", last=True).filter("periods >= 3 and std > 1e-9")
    z = F.round((F.col("last_value") - F.col("mean")) / F.col("std"), 6)
    return m.select(key, F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("last_value", 4).alias("last_value"), z.alias("z")).filter(F.abs("z") >= least)


def forecast(df: DataFrame, period: str, horizon: int = 3) -> DataFrame:
    """Period totals and a straight line through them carried on, never under 0. One row per period; two periods at least."""
    s = sums(df, [period], "revenue").select(period, F.col("revenue").cast("double").alias("y"))
    t = s.withColumn("x", F.row_number().over(Window.orderBy(period)) - 1)  # one row per period of the calendar
    line = t.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("n")).filter("n >= 2")
    ahead = line.select("slope", "intercept", "n", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    x = F.col("n") - 1 + F.col("h")
    future = ahead.select(F.concat(F.lit("+"), F.col("h").cast("string")).alias("period"), F.round(F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * x), 2).alias("value"), F.lit("forecast").alias("kind"))
    past = t.select(F.col(period).alias("period"), F.round("y", 2).alias("value"), F.lit("fact").alias("kind"))
    return past.unionByName(future)
