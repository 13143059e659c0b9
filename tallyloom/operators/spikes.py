"""Implausible readings: Hampel filter, stuck runs and physical bounds per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.rolling import finite, weekly_sales

#: Makes the median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826


def hampel(df: DataFrame, keys: Sequence[str], step: str, value: str, half_window: int | None = None) -> DataFrame:
    """Adds ``<value>_median`` and ``<value>_mad`` over the trailing and leading ``half_window`` steps of each series.

    ``df`` has one row per keys and step. With ``half_window=None`` the window is the whole series. Nulls take no part; a
    window without values gives null for both.
    """
    w = Window.partitionBy(*keys)
    if half_window is not None:
        w = w.orderBy(step).rangeBetween(-half_window, half_window)
        near = df.withColumn("_near", F.collect_list(value).over(w))
        med = near.withColumn(f"{value}_median", array_median(F.col("_near")))
        dev = F.transform("_near", lambda x: F.abs(x - F.col(f"{value}_median")))
        return med.withColumn(f"{value}_mad", array_median(dev)).drop("_near")
    med = df.withColumn(f"{value}_median", F.percentile(value, F.lit(0.5)).over(w))
    return med.withColumn(f"{value}_mad", F.percentile(F.abs(F.col(value) - F.col(f"{value}_median")), F.lit(0.5)).over(w))


def hampel_of_all(df: DataFrame, keys: Sequence[str], step: str, values: Sequence[str], half_window: int) -> DataFrame:
    """As ``hampel`` over a window of steps, for several values with one frame."""
    w = Window.partitionBy(*keys).orderBy(step).rangeBetween(-half_window, half_window)
    cols = df.columns
    df = df.select(*cols, F.collect_list(F.struct(*values)).over(w).alias("_near"))
    near = lambda v: F.sort_array(F.array_compact(F.col("_near")[v]))
    df = df.select(*cols, F.inline(F.array(F.struct(*(near(v).alias(f"_{v}") for v in values)))))
    df = df.select(*cols, *(f"_{v}" for v in values), F.inline(F.array(F.struct(*(sorted_median(F.col(f"_{v}")).alias(f"{v}_median") for v in values)))))
    far = lambda v: F.sort_array(F.transform(f"_{v}", lambda x: F.abs(x - F.col(f"{v}_median"))))
    df = df.select(*cols, *(f"{v}_median" for v in values), F.inline(F.array(F.struct(*(far(v).alias(f"_{v}") for v in values)))))
    return df.select(*cols, *(f"{v}_median" for v in values), *(sorted_median(F.col(f"_{v}")).alias(f"{v}_mad") for v in values))


def medians_of_all(df: DataFrame, keys: Sequence[str], step: str, values: Sequence[str], half_window: int) -> DataFrame:
    """As ``hampel_of_all``, medians only."""
    w = Window.partitionBy(*keys).orderBy(step).rangeBetween(-half_window, half_window)
    cols = df.columns
    df = df.select(*cols, F.collect_list(F.struct(*values)).over(w).alias("_near"))
    # each array is sorted once: the inline of one struct is a stage of its own
    df = df.select(*cols, F.inline(F.array(F.struct(*(F.sort_array(F.array_compact(F.col("_near")[v])).alias(f"_{v}") for v in values)))))
    return df.select(*cols, *(sorted_median(F.col(f"_{v}")).alias(f"{v}_median") for v in values))


def sorted_median(s: Column) -> Column:
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def array_median(values: Column) -> Column:
    return sorted_median(F.sort_array(values))


def beyond_hampel(value: Column, median: Column, mad: Column, sigmas: float) -> Column:
    """Farther from the median than ``sigmas`` scaled deviations; a series without deviation flags any other value."""
    return F.abs(value - median) > F.lit(sigmas * MAD_SCALE) * mad


SERIES = ["store_code", "item_code"]


def series_weeks(sales: DataFrame) -> DataFrame:
    """One row per store, item and week with the measures of the row loaded last, and the kopecks of the row with the lowest id."""
    rows = weekly_sales(sales)
    last = F.struct(*(finite(F.col(c)).alias(c) for c in ("qty_sold", "sales_rub", "cost_rub")))
    kopecks = F.struct(*(F.round(finite(F.col(c)) * 100).cast("long").alias(f"{c}_first") for c in ("sales_rub", "cost_rub")))
    return (
        rows.groupBy(*SERIES, "week_no")
        .agg(F.max_by(last, F.struct("loaded_at", "row_id")).alias("l"), F.min_by(kopecks, "row_id").alias("f"))
        .select(*SERIES, "week_no", "l.*", "f.*")
    )


MEASURES = ("qty_sold", "sales_rub", "cost_rub")


def hampel_flags(sales: DataFrame, half_window: int = 13, sigmas: float = 3.0, least: int = 5) -> DataFrame:
    """(store_code, item_code, week_no, field, value, median, mad) of each weekly reading beyond the Hampel bounds of the weeks around it.

    A reading is flagged if it lies farther than ``sigmas`` scaled median absolute deviations from the median of the ``half_window`` weeks before
    and after it, itself included, of which ``least`` have a reading. The bounds follow a slow drift of the series, which bounds over the whole
    series do not. The row loaded last holds for a week. Null and non-finite readings take no part; where more than half the readings
    around are equal any other is flagged. An empty table gives an empty result.
    """
    weeks = series_weeks(sales).select(*SERIES, "week_no", *MEASURES)
    w = Window.partitionBy(*SERIES).orderBy("week_no").rangeBetween(-half_window, half_window)
    weeks = weeks.withColumns({f"{c}_n": F.count(c).over(w) for c in MEASURES})
    weeks = hampel_of_all(weeks, SERIES, "week_no", MEASURES, half_window)
    flag = lambda c: (F.col(f"{c}_n") >= least) & beyond_hampel(F.col(c), F.col(f"{c}_median"), F.col(f"{c}_mad"), sigmas)
    found = F.array_compact(
        F.array(*(F.when(flag(c), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), F.col(f"{c}_median").alias("median"), F.col(f"{c}_mad").alias("mad"))) for c in MEASURES))
    )
    return weeks.select(*SERIES, "week_no", F.inline(found))


def series_profile(sales: DataFrame, stuck_weeks: int, half_window: int | None) -> DataFrame:
    """Per store, item and week what is usual (the median, also of price and cost of a piece) and the values that stand still.

    The input of the windows has one row per series and week, whatever the number of rows delivered, so no window is larger
    than the weeks of one series.
    """
    weeks = series_weeks(sales)
    piece = F.when(F.col("qty_sold") > 0, F.col("qty_sold"))
    weeks = weeks.withColumns({f"{c}_piece": F.col(c) / piece for c in ("sales_rub", "cost_rub")})
    by = Window.partitionBy(*SERIES)
    w = by.orderBy("week_no")
    measures = (*MEASURES, "sales_rub_piece", "cost_rub_piece")
    if half_window is None:
        weeks = weeks.withColumns({f"{c}_median": F.percentile(c, F.lit(0.5)).over(by) for c in measures})
    else:
        weeks = medians_of_all(weeks, SERIES, "week_no", measures, half_window)
    for c in ("sales_rub", "cost_rub"):
        weeks = weeks.withColumn(f"{c}_new", F.when(F.col(f"{c}_first") == F.lag(f"{c}_first").over(w), 0).otherwise(1))
    for c in ("sales_rub", "cost_rub"):
        weeks = weeks.withColumn(f"{c}_run", F.sum(f"{c}_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for c in ("sales_rub", "cost_rub"):
        size = F.count(F.col(f"{c}_first")).over(Window.partitionBy(*SERIES, f"{c}_run"))
        weeks = weeks.withColumn(f"{c}_stuck", F.when(size >= stuck_weeks, F.col(f"{c}_first")))
    return weeks


def implausible_readings(sales: DataFrame, times: float = 10.0, stuck_weeks: int = 5, half_window: int | None = None) -> DataFrame:
    """(row_id, field, reason) of each reading that cannot be right beside the ordinary weeks of its store and item.

    * spike: more than ``times`` the median. In a series without returns that is always beyond the Hampel bounds of three scaled deviations:
      the deviation is the median at most, so the bounds end at 5.5 times the median; it is therefore not computed here (``hampel_flags``);
    * price: per piece less than the median divided by ``times``, the quantity being ordinary and positive;
    * sign: negative, while another measure of the row is positive;
    * stuck: ``sales_rub`` or ``cost_rub`` the same to the kopeck over ``stuck_weeks`` recorded weeks, and ``qty_sold`` of
      the rows in which both are.

    A reading has the first reason that holds of spike, sign, price, stuck. ``half_window=None`` takes the whole series for the median. Null and
    non-finite readings are no case, nor are rows without store, item or readable week. A series whose median is 0 or null has no spikes.
    """
    profile = series_profile(sales, stuck_weeks, half_window)
    stats = [f"{c}_median" for c in (*MEASURES, "sales_rub_piece", "cost_rub_piece")]
    profile = profile.select(*SERIES, "week_no", *stats, "sales_rub_stuck", "cost_rub_stuck")
    rows = weekly_sales(sales).select(
        "row_id", *SERIES, "week_no", *(finite(F.col(c)).alias(c) for c in ("qty_sold", "sales_rub", "cost_rub"))
    )
    j = rows.join(profile, [*SERIES, "week_no"])
    q, fields = F.col("qty_sold"), MEASURES

    def spike(c: str) -> Column:
        m = F.col(f"{c}_median")
        return (m > 0) & (F.abs(F.col(c)) > m * times)

    ordinary = (q > 0) & ~F.coalesce(spike("qty_sold"), F.lit(False))

    def cheap(c: str) -> Column:
        m, x = F.col(f"{c}_piece_median"), F.col(c) / F.when(q > 0, q)
        return ordinary & (m > 0) & (x * times < m)

    def sign(c: str) -> Column:
        return (F.col(c) < 0) & (F.greatest(*(F.col(o) for o in fields if o != c)) > 0)

    stuck = {c: F.round(F.col(c) * 100).cast("long") == F.col(f"{c}_stuck") for c in ("sales_rub", "cost_rub")}
    stuck["qty_sold"] = stuck["sales_rub"] & stuck["cost_rub"]
    found = F.array_compact(
        F.array(
            *(
                F.when(
                    F.col(c).isNotNull(),
                    F.when(spike(c), F.struct(F.lit(c).alias("field"), F.lit("spike").alias("reason")))
                    .when(sign(c), F.struct(F.lit(c).alias("field"), F.lit("sign").alias("reason")))
                    .when(F.lit(False) if c == "qty_sold" else cheap(c), F.struct(F.lit(c).alias("field"), F.lit("price").alias("reason")))
                    .when(stuck[c], F.struct(F.lit(c).alias("field"), F.lit("stuck").alias("reason"))),
                )
                for c in fields
            )
        )
    )
    return j.select("row_id", F.explode(found).alias("x")).select("row_id", "x.field", "x.reason")
