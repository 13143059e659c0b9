"""Queries on the retail tables: trailing totals (p1), implausible readings (p2), drifting schemas (p4), units (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.periods import iso_year_week
from tallyloom.operators.drift import promotions, schema_changes, unified
from tallyloom.operators.rolling import rolling_totals, weekly_totals
from tallyloom.operators.spikes import hampel_flags, implausible_readings
from tallyloom.operators.units import contents
from tallyloom.session import table

UNITS = {"qty_sold": 1, "sales_rub": 100}


def p1_rolling_totals(spark: SparkSession, folder: str) -> DataFrame:
    """For every store, item and week of its life the totals and averages of the last 4 and 13 weeks."""
    out = rolling_totals(weekly_totals(table(spark, folder, "sales")), ["store_code", "item_code"], "week_no", UNITS)
    return out.select(*iso_year_week("week_no"), *(c for c in out.columns if c != "week_no"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks in which sales have more than doubled beside the last quarter, for pieces and roubles alike."""
    out = rolling_totals(weekly_totals(table(spark, folder, "sales")), ["store_code", "item_code"], "week_no", UNITS)
    for v, unit in UNITS.items():
        # in whole minor units: average over 4 > 2 x average over 13
        four, thirteen = (F.round(F.col(f"{v}_total_{p}") * unit).cast("long") for p in (4, 13))
        out = out.filter((thirteen > 0) & (four * 13 > thirteen * 8))
    return out.filter("age >= 13").select("store_code", "item_code", *iso_year_week("week_no"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of sales that cannot be right."""
    return implausible_readings(table(spark, folder, "sales")).select("row_id", "field")


def p2_hampel_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the median of the 27 weeks around each week instead of the whole series."""
    return implausible_readings(table(spark, folder, "sales"), half_window=13)


def p2_hampel_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly readings beyond three scaled median absolute deviations from the median of the 27 weeks around them."""
    return hampel_flags(table(spark, folder, "sales")).select("store_code", "item_code", *iso_year_week("week_no"), "field", "value")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Columns added, removed, renamed or retyped against the file of the feed received before."""
    return schema_changes(table(spark, folder, "raw_extracts")).select("file_id", "field", "change")


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all files in one table of canonical fields."""
    return unified(table(spark, folder, "raw_extracts"))


def p4_promotions(spark: SparkSession, folder: str) -> DataFrame:
    """Files that make the type of a field of their feed rise."""
    return promotions(table(spark, folder, "raw_extracts")).select("file_id", "field", "before", "after")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The content of every listing that states one, in millilitres, grams or pieces."""
    return contents(table(spark, folder, "listings")).filter("amount is not null").select("listing_id", "amount", "base_unit").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_rolling_totals": p1_rolling_totals,
    "p2_found": p2_found,
    "p2_hampel_rolling": p2_hampel_rolling,
    "p2_hampel_flags": p2_hampel_flags,
    "p4_found": p4_found,
    "p4_unified": p4_unified,
    "p4_promotions": p4_promotions,
    "p5_found": p5_found,
}

#: Weekly series as the task states them: digits of the week text, its own year first.
_WEEKS = """
d as (select *, regexp_extract_all(week, '[0-9]+') r from sales where store_code is not null and item_code is not null),
e as (select *, case when len(r) = 1 and length(r[1]) = 6 then r[1][1:4] when len(r) = 2 and length(r[1]) = 4 then r[1] when len(r) = 2 then r[2] end ys,
  case when len(r) = 1 and length(r[1]) = 6 then r[1][5:6] when len(r) = 1 then r[1] when len(r) = 2 and length(r[1]) = 4 then r[2] when len(r) = 2 then r[1] end ws from d),
f as (select *, coalesce(try_cast(ys as int), year, isoyear(loaded_at)::int - (case when try_cast(ws as int) > weekofyear(loaded_at) then 1 else 0 end)) yy,
  try_cast(ws as int) ww from e),
g0 as (select *, (date_diff('day', date '1970-01-05', date_trunc('week', make_date(yy, 1, 4))::date) // 7 + ww - 1)::int week_no,
  date_diff('day', date '1970-01-05', loaded_at::date) // 7 loaded_week from f where ww between 1 and 53),
g as (select * exclude (loaded_week) from g0 where coalesce(week_no between loaded_week - 5218 and loaded_week + 53, true))"""

_ROLLING = f"""with {_WEEKS},
h as (select store_code, item_code, week_no, arg_max(struct_pack(q := coalesce(round(qty_sold)::bigint, 0), s := coalesce(round(sales_rub * 100)::bigint, 0)), (loaded_at, row_id)) v from g group by all),
span as (select store_code, item_code, min(week_no) a, max(week_no) b from h group by all),
cal as (select store_code, item_code, a, unnest(generate_series(a, b))::int week_no from span),
i as (select c.store_code, c.item_code, c.week_no, c.week_no - a + 1 age, coalesce(v.q, 0) q, coalesce(v.s, 0) s from cal c left join h using (store_code, item_code, week_no)),
t as (select *, sum(q) over w4 q4, sum(s) over w4 s4, sum(q) over w13 q13, sum(s) over w13 s13, date '1970-01-05' + week_no * 7 monday from i
  window w4 as (partition by store_code, item_code order by week_no range between 3 preceding and current row),
  w13 as (partition by store_code, item_code order by week_no range between 12 preceding and current row))"""

#: Readings that cannot be right: the median of a series, or of the weeks around each (``med`` is per series and week).
_LAST = f"""with {_WEEKS},
last as (select store_code, item_code, week_no, arg_max(struct_pack(q := qty_sold, s := sales_rub, c := cost_rub), (loaded_at, row_id)) v,
  arg_min(struct_pack(s := round(sales_rub * 100)::bigint, c := round(cost_rub * 100)::bigint), row_id) f from g group by all)"""
_MEDIANS = """select store_code, item_code, week_no, median(v.q) over w mq, median(v.s) over w ms, median(v.c) over w mc,
  median(case when v.q > 0 then v.s / v.q end) over w mps, median(case when v.q > 0 then v.c / v.q end) over w mpc from last"""
_SERIES_WINDOW, _AROUND = "w as (partition by store_code, item_code)", "w as (partition by store_code, item_code order by week_no range between 13 preceding and 13 following)"


def _implausible(window: str) -> str:
    return f"""{_LAST},
med as ({_MEDIANS} window {window}),
flags as (select *, f.s fs, f.c fc, case when f.s = lag(f.s) over w then 0 else 1 end ns, case when f.c = lag(f.c) over w then 0 else 1 end nc
  from last window w as (partition by store_code, item_code order by week_no)),
runs as (select *, sum(ns) over w rs, sum(nc) over w rc from flags window w as (partition by store_code, item_code order by week_no rows unbounded preceding)),
stuck as (select *, case when count(fs) over (partition by store_code, item_code, rs) >= 5 then fs end ss, case when count(fc) over (partition by store_code, item_code, rc) >= 5 then fc end sc from runs),
j as (select g.*, m.* exclude (store_code, item_code, week_no), round(sales_rub * 100)::bigint = ss st_s, round(cost_rub * 100)::bigint = sc st_c from g
  join med m using (store_code, item_code, week_no) join stuck using (store_code, item_code, week_no)),
k as (select *, qty_sold > 0 and not coalesce(mq > 0 and abs(qty_sold) > 10 * mq, false) okq from j)
select row_id, unnest([case when qty_sold is null then null when spike_q then ['qty_sold', 'spike'] when sign_q then ['qty_sold', 'sign'] when st_s and st_c then ['qty_sold', 'stuck'] end,
  case when spike_s then ['sales_rub', 'spike'] when sign_s then ['sales_rub', 'sign'] when cheap_s then ['sales_rub', 'price'] when st_s then ['sales_rub', 'stuck'] end,
  case when spike_c then ['cost_rub', 'spike'] when sign_c then ['cost_rub', 'sign'] when cheap_c then ['cost_rub', 'price'] when st_c then ['cost_rub', 'stuck'] end]) x from (
 select *, mq > 0 and abs(qty_sold) > 10 * mq spike_q, ms > 0 and abs(sales_rub) > 10 * ms spike_s, mc > 0 and abs(cost_rub) > 10 * mc spike_c,
  qty_sold < 0 and greatest(sales_rub, cost_rub) > 0 sign_q, sales_rub < 0 and greatest(qty_sold, cost_rub) > 0 sign_s, cost_rub < 0 and greatest(qty_sold, sales_rub) > 0 sign_c,
  okq and mps > 0 and sales_rub / qty_sold * 10 < mps cheap_s, okq and mpc > 0 and cost_rub / qty_sold * 10 < mpc cheap_c from k)"""


ORACLE = {
    "p1_rolling_totals": _ROLLING
    + """ select isoyear(monday)::int "year", weekofyear(monday)::int "week", store_code, item_code, age::int age, q::double qty_sold, s / 100.0::double sales_rub,
 q4::double qty_sold_total_4, s4::double / 100 sales_rub_total_4, q13::double qty_sold_total_13, s13::double / 100 sales_rub_total_13,
 q4::double / 4 qty_sold_avg_4, s4::double / 400 sales_rub_avg_4, q13::double / 13 qty_sold_avg_13, s13::double / 1300 sales_rub_avg_13 from t""",
    "p1_found": _ROLLING
    + """ select store_code, item_code, isoyear(monday)::int "year", weekofyear(monday)::int "week" from t
 where age >= 13 and q13 > 0 and s13 > 0 and q4 * 13 > q13 * 8 and s4 * 13 > s13 * 8""",
    "p2_found": f"select row_id, x[1] field from ({_implausible(_SERIES_WINDOW)}) where x is not null",
    "p2_hampel_rolling": f"select row_id, x[1] field, x[2] reason from ({_implausible(_AROUND)}) where x is not null",
    "p2_hampel_flags": f"""{_LAST},
r as (select store_code, item_code, week_no, unnest([struct_pack(f := 'qty_sold', x := v.q), struct_pack(f := 'sales_rub', x := v.s), struct_pack(f := 'cost_rub', x := v.c)]) o from last),
t as (select store_code, item_code, week_no, o.f f, o.x x from r where o.x is not null),
h as (select *, median(x) over w m, mad(x) over w d, count(*) over w n, date '1970-01-05' + week_no * 7 monday from t
  window w as (partition by store_code, item_code, f order by week_no range between 13 preceding and 13 following))
select store_code, item_code, isoyear(monday)::int "year", weekofyear(monday)::int "week", f field, x "value" from h where n >= 5 and abs(x - m) > 3 * 1.4826 * d""",
}
