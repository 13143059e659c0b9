"""Edge cases of the operators on weekly series, drifting files and units."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.lexicon import concept, kind_of, one_edit, words
from tallyloom.functions.measures import UNITS, convert, parse_content, quantity_of
from tallyloom.functions.periods import first_week, with_iso_week
from tallyloom.operators.drift import promotions, schema_changes, unified
from tallyloom.operators.rolling import rolling_totals, weekly_totals
from tallyloom.operators.spikes import hampel, hampel_flags, hampel_of_all, implausible_readings
from tallyloom.operators.units import category_kinds, contents, measured, readings
from tallyloom.plans.problems import p2_hampel_rolling
from tallyloom.sources.colmap import map_headers

SALES = "row_id long, week string, month int, year int, store_code long, item_code long, qty_sold double, sales_rub double, cost_rub double, source_file string, loaded_at timestamp_ntz, extra string"


def sales(spark, rows):
    day = dt.datetime(2021, 1, 1)
    full = [(k, w, None, y, s, i, q, r, c, "f", day + dt.timedelta(hours=h), "x") for k, (w, y, s, i, q, r, c, h) in enumerate(rows, 1)]
    return spark.createDataFrame(full, SALES)


def test_first_week_is_python_s(spark):
    rows = spark.range(1, 2300).select(F.col("id").cast("int").alias("y")).withColumn("w", first_week(F.col("y"))).collect()
    for r in rows:
        assert dt.date(1970, 1, 5) + dt.timedelta(weeks=r.w) == dt.date.fromisocalendar(r.y, 1, 1)


@pytest.mark.parametrize(
    ("text", "year", "loaded", "monday"),
    [
        (" 27 ", 2020, None, "2020-06-29"), ("W53", 2020, None, "2020-12-28"), ("53", 2021, None, None), ("202101", None, None, "2021-01-04"), ("2020-W53", 2019, None, "2020-12-28"),
        ("5 неделя 2021", None, None, "2021-02-01"), ("нед. 50", None, "2021-01-04", "2020-12-07"), ("99", 2020, None, None), (None, 2020, None, None), ("x", None, None, None), ("", 2020, None, None),
    ],
)
def test_week_texts(spark, text, year, loaded, monday):
    df = spark.createDataFrame([(text, year, loaded)], "w string, y int, l string").withColumn("l", F.expr("timestamp(l)"))
    n = with_iso_week(df, "w", "y", "l").first().week_no
    assert (None if n is None else str(dt.date(1970, 1, 5) + dt.timedelta(weeks=n))) == monday


def test_rolling_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"2021-W{rng.randint(1, 40):02}", None, rng.choice([1, 2, None]), rng.choice([5, None]), rng.choice([None, -2.0, 3.4, 7.0]), rng.choice([None, 10.11, 5.0]), 1.0, rng.randint(0, 3)) for _ in range(150)]
    df = sales(spark, rows)
    last = {}
    for k, (w, _, s, i, q, r, _c, h) in enumerate(rows, 1):
        if s is not None and i is not None:
            key = (s, i, int(w[-2:]))
            last[key] = max(last.get(key, (-1, 0, 0, 0)), (h, k, q or 0, r or 0))
    got = {(r.store_code, r.item_code, r.week_no): r for r in rolling_totals(weekly_totals(df), ["store_code", "item_code"], "week_no", {"qty_sold": 1, "sales_rub": 100}).collect()}
    base = (dt.date.fromisocalendar(2021, 1, 1) - dt.date(1970, 1, 5)).days // 7 - 1
    whole = lambda x: int(abs(x) + 0.5) * (1 if x >= 0 else -1)
    n = 0
    for s, i in {k[:2] for k in last}:
        weeks = sorted(k[2] for k in last if k[:2] == (s, i))
        for w in range(weeks[0], weeks[-1] + 1):
            r = got[s, i, base + w]
            n += 1
            for p in (4, 13):
                part = [last.get((s, i, x), (0, 0, 0, 0)) for x in range(w - p + 1, w + 1)]
                assert r[f"qty_sold_total_{p}"] == sum(whole(x[2]) for x in part)
                assert r[f"sales_rub_total_{p}"] == pytest.approx(sum(x[3] for x in part))
                assert r[f"sales_rub_avg_{p}"] == pytest.approx(sum(x[3] for x in part) / p)
    assert n == len(got)


def test_a_slip_in_a_year_makes_no_calendar(spark):
    rows = [("2021-W01", None, 1, 1, 1.0, 1.0, 1.0, 0), ("5", 9999, 1, 1, 1.0, 1.0, 1.0, 0), ("1500-W01", None, 1, 1, 1.0, 1.0, 1.0, 0), ("2021-W03", None, 1, 1, 1.0, 1.0, 1.0, 0)]
    assert rolling_totals(weekly_totals(sales(spark, rows)), ["store_code", "item_code"], "week_no", {"qty_sold": 1, "sales_rub": 100}).count() == 3


def test_empty_sales(spark):
    empty = sales(spark, []) if False else spark.createDataFrame([], SALES)
    assert rolling_totals(weekly_totals(empty), ["store_code", "item_code"], "week_no", {"qty_sold": 1, "sales_rub": 100}).count() == 0
    assert implausible_readings(empty).count() == 0


def test_implausible_readings(spark):
    week = lambda w: f"2021-W{w:02}"
    rows = [(week(w), None, 1, 1, 5.0 + w % 2, 100.0 + w, 70.0 + w, 0) for w in range(1, 21)]
    rows[3] = (week(4), None, 1, 1, 500.0, 104.0, 74.0, 0)  # row 4: quantity
    rows[5] = (week(6), None, 1, 1, 5.0, 1.0, 76.0, 0)  # row 6: price of a piece
    rows[7] = (week(8), None, 1, 1, 5.0, -108.0, 78.0, 0)  # row 8: sign
    rows[9] = (week(10), None, 1, 1, -5.0, -110.0, -80.0, 0)  # row 10: a return is right
    for w in range(12, 17):
        rows[w - 1] = (week(w), None, 1, 1, 5.0, 111.11, 70.0 + w, 0)  # rows 12 to 16: stuck
    rows += [(week(13), None, 1, 1, 6.0, 111.11, 83.0, 0), (week(14), None, 1, 1, 6.0, 200.0, 84.0, 1), (week(9), None, None, 1, 9999.0, 1.0, 1.0, 0), ("?", None, 1, 1, 9999.0, 1.0, 1.0, 0)]
    found = {(r.row_id, r.field, r.reason) for r in implausible_readings(sales(spark, rows)).collect()}
    assert found == {(4, "qty_sold", "spike"), (6, "sales_rub", "price"), (8, "sales_rub", "sign"), *((k, "sales_rub", "stuck") for k in (12, 13, 14, 15, 16, 21))}


def test_rolling_hampel_against_brute_force(spark):
    rng = random.Random(3)
    vals = {(k, w): rng.choice([None, rng.random() * 10]) for k in (1, 2) for w in range(12)}
    df = spark.createDataFrame([(k, w, v) for (k, w), v in vals.items()], "k int, w int, v double")
    one, all_ = (sorted(map(tuple, d.select("k", "w", "v_median", "v_mad").collect())) for d in (hampel(df, ["k"], "w", "v", 2), hampel_of_all(df, ["k"], "w", ["v"], 2)))
    assert one == all_
    for r in hampel(df, ["k"], "w", "v", 2).collect():
        near = sorted(v for (k, w), v in vals.items() if k == r.k and abs(w - r.w) <= 2 and v is not None)
        want = None if not near else (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2
        assert r.v_median == (want if want is None else pytest.approx(want))


def test_rolling_window_outlasts_a_level_error(spark, tmp_path):
    rows = [(f"2021-W{w:02}", None, 1, 1, 5.0, 5000.0 + w if 17 <= w <= 23 else 100.0 + w, 70.0 + w, 0) for w in range(1, 41)]
    sales(spark, rows).write.parquet(str(tmp_path / "sales.parquet"))
    found = {(r.row_id, r.field, r.reason) for r in p2_hampel_rolling(spark, str(tmp_path)).collect()}
    assert found == {(w, "sales_rub", "spike") for w in range(17, 24)}


def test_hampel_follows_a_drift(spark):
    """A level that doubles over two years: a reading that was ordinary a year ago stands out now, which bounds over the whole series cannot see."""
    weeks = [(f"{2020 + k // 50}-W{k % 50 + 1:02}", None, 1, 1, 10.0 + k + k % 3, 1000.0, None, 0) for k in range(100)]
    weeks[80] = (*weeks[80][:4], 25.0, 1000.0, None, 0)  # ordinary at week 15
    weeks[20] = (*weeks[20][:4], 95.0, 1000.0, None, 0)  # ordinary at week 85
    weeks[50] = (*weeks[50][:5], 1001.0, None, 0)
    df = sales(spark, weeks)
    got = {(r.field, r.value) for r in hampel_flags(df).collect()}
    assert got == {("qty_sold", 25.0), ("qty_sold", 95.0), ("sales_rub", 1001.0)}
    whole = hampel(df.select("store_code", "row_id", "qty_sold"), ["store_code"], "row_id", "qty_sold").filter(F.abs(F.col("qty_sold") - F.col("qty_sold_median")) > 3 * 1.4826 * F.col("qty_sold_mad"))
    assert whole.count() == 0 and implausible_readings(df).filter("reason = 'spike'").count() == 0
    assert hampel_flags(df.limit(4)).count() == 0 and hampel_flags(df.limit(0)).count() == 0


RAW = "raw_id long, file_id long, feed string, file_name string, received_at timestamp_ntz, line_no int, payload string"


def test_schema_changes(spark):
    day = lambda d: dt.datetime(2021, 1, d)
    rows = [
        (1, 10, "a", "f1", day(1), 1, '{"Регион": "Юг", "Кол-во": 5, "Вес": 1.5}'), (2, 10, "a", "f1", day(1), 2, '{"Регион": null, "Комментарий": "x"}'),
        (3, 11, "a", "f2", day(2), 1, '{" регион.": "Юг", "Количество": "5 шт", "Бренд": null}'), (4, 11, "a", "f2", day(2), 2, None), (5, 11, "a", "f2", day(2), 3, "no json"), (6, 12, "b", "g", day(3), 1, '{"Бренд": "x"}'),
        (7, 13, "c", "h", day(3), 1, "[1]"), (8, 14, "c", "h2", day(4), 1, '{"Бренд": ""}'),
    ]
    df = spark.createDataFrame(rows, RAW)
    got = {(r.file_id, r.field, r.change) for r in schema_changes(df).collect()}
    assert got == {(11, "qty_sold", "renamed"), (11, "qty_sold", "retyped"), (11, "weight", "removed"), (11, "brand", "added"), (14, "brand", "added")}
    table = {r.raw_id: r for r in unified(df).collect()}
    assert len(table) == 8 and table[1].region == "Юг" and table[1].weight == 1.5 and table[3].qty_sold == "5 шт" and table[4].region is None
    assert schema_changes(spark.createDataFrame([], RAW)).count() == 0 and unified(spark.createDataFrame([], RAW)).count() == 0


def test_promotions(spark):
    day = lambda d: dt.datetime(2021, 1, d)
    values = ['{"Вес": null, "Неделя": "2021-01-04", "Бренд": true, "Регион": 1}', '{"Вес": 5, "Неделя": "2021-01-04", "Бренд": true, "Регион": {"a": 1}}', '{"Вес": 5.5, "Неделя": "2021-01-04 10:00", "Бренд": 1}', '{"Вес": 1, "Неделя": "x"}']
    df = spark.createDataFrame([(k, k, "a", "f", day(k + 1), 1, v) for k, v in enumerate(values)], RAW)
    got = {(r.file_id, r.field, r.before, r.after) for r in promotions(df).collect()}
    assert got == {(1, "weight", "void", "bigint"), (2, "weight", "bigint", "double"), (2, "week", "date", "timestamp"), (3, "week", "timestamp", "string"), (2, "brand", "boolean", "string"), (1, "region", "bigint", "string")}
    types = dict(unified(df).dtypes)
    assert (types["weight"], types["week"], types["brand"], types["region"]) == ("double", "string", "string", "string")
    assert dict(unified(df.filter("raw_id <= 2")).dtypes)["week"] == "timestamp" and promotions(df.limit(0)).count() == 0
    assert [r.region for r in unified(df).orderBy("raw_id").collect()][:2] == ["1", '{"a":1}']


def test_headers():
    assert map_headers(["Регион сбыта", "Название точки", "Категория ур. 0", "Комментарий", "Остаток на конец"]) == {"Регион сбыта": "region", "Название точки": "store_name", "Категория ур. 0": "category_0"}
    assert map_headers(["Выручка с НДС", "packaging quantity"]) == {"Выручка с НДС": "sales_rub"}
    canonical = ["item_name", "qty_sold", "cost_rub", "item_code", "category_1", "store_code", "store_name", "sales_rub"]
    assert map_headers(canonical) == {c: c for c in canonical}
    assert map_headers(["Вес", "Масса нетто"]) == {"Вес": "weight"}
    assert map_headers([]) == {}


@pytest.mark.parametrize(
    ("name", "size", "base", "pieces", "factor"),
    [
        ("Соль 6 шт по 3 кг.", 3000, "g", 6, 1), ("Бальз. 2х400мл", 400, "ml", None, 2), ("Мыло 75 гр*3", 75, "g", None, 3), ("Соль 1500гр. х 6", 1500, "g", None, 6), ("Диски №60", None, None, 60, 1),
        ("Таб. 5 дюж.", None, None, 60, 1), ("Гель 0,4 L 2шт", 400, "ml", 2, 1), ("Шампунь 30 CL №1 выбор pH 5.5 арт.8888 -20% 3в1", 300, "ml", None, 1), ("Паста 75 ml (СНБ):1/24", 75, "ml", None, 1),
        ("Чай 3.17oz", 89.868, "g", None, 1), ("Крем х2 эффект", None, None, None, 1), ("", None, None, None, 1), (None, None, None, None, 1),
    ],
)
def test_contents_of_names(name, size, base, pieces, factor):
    c = parse_content(name)
    assert (c.size if c.size is None else round(c.size, 3), c.base, c.pieces, c.pieces_factor) == (size, base, pieces, factor)


def test_layers_are_no_volume():
    assert readings("Туалетная бумага 2сл 8ШТ", None, None)[:4] == ("toilet_paper", None, None, 8.0)
    assert readings("Бумага таул. 2сл 4шт", None, None)[1:4] == (None, None, 4.0)
    assert readings("Крем для рук 5 сл", None, None)[1:3] == (50.0, "ml")


@pytest.mark.parametrize(
    ("name", "content"),
    [
        ("Соус 5 г/л", (None, None, None, 1)), ("Гель 500 мл + 250 мл", (750, "ml", None, 1)), ("Сок 1 000 мл", (1000, "ml", None, 1)), ("Сахар 1 1/2 кг", (1500, "g", None, 1)),
        ("Сыр 20 lb 4 oz", (9185.245, "g", None, 1)), ("Мыло 200 x 5 г", (5, "g", None, 200)), ("Мыло 150*5 г", (5, "g", None, 150)), ("Салфетки 20х30 см 60 шт", (None, None, 60, 1)),
        ("Пакет 1 кг 1000 г", (1000, "g", None, 1)), ("Чай 12 шт х 5 г/шт", (5, "g", 12, 1)), ("Диски 5+1 шт", (None, None, 6, 1)), ("Фольга 2 м² 1 шт", (None, None, 1, 1)), ("Мука 1/2 кг", (500, "g", None, 1)),
    ],
)
def test_grammar_of_contents(name, content):
    c = parse_content(name)
    assert (c.size if c.size is None else round(c.size, 3), c.base, c.pieces, c.pieces_factor) == content


def test_vectors():
    assert quantity_of("10 см x 5 см x 2 см") == quantity_of("100 мл") and quantity_of("4 шт х 5 г/шт") == quantity_of("20 г")
    assert quantity_of("0,9 kg/m^3").base() == "g/ml" and quantity_of("5 г/л").value == pytest.approx(0.005)
    assert convert("86 °F", "°C") == pytest.approx(30) and convert("300 кельвин", "°c") == pytest.approx(26.85) and convert("20 lb 4 oz", "кг") == pytest.approx(9.1852454925)
    assert convert("1 л", "г") is None and convert("2 м", "см") == 200 and convert("1 час", "мин") == pytest.approx(60) and convert("x", "г") is None and convert(None, "г") is None
    assert (UNITS["мл"] / UNITS["см"] ** 3).exponents == (0,) * 5 and not UNITS["мл"].converts(UNITS["см"])
    with pytest.raises(ValueError):
        UNITS["°f"] * UNITS["г"]
    with pytest.raises(ValueError):
        quantity_of("1 г") + quantity_of("1 мл")
    assert quantity_of("500 мл и ещё") is None and quantity_of("") is None and quantity_of("1/0 кг").value == 0


def test_measured_columns(spark):
    df = spark.createDataFrame([("1 1/2 кг", 1), ("5 г/л", 2), ("5 м^4", 3), ("x", 4), (None, 5), ("", 6)], "t string, value int")
    got = {r.value: r.measured for r in measured(df, "t").collect()}
    assert (got[1].value, got[1].unit) == (1500.0, "g") and got[2].unit == "g/ml" and got[3].unit is None and list(got[3].exponents) == [4, 0, 0, 0, 0]
    assert all(got[k].value is None for k in (4, 5, 6)) and measured(df.limit(0), "t").count() == 0


def test_categories_of_one_kind(spark):
    rows = [("a", "soap")] * 9 + [("a", "tea"), ("a", None), ("b", "soap"), ("b", "tea"), (None, "tea"), ("c", None)]
    assert {tuple(r) for r in category_kinds(spark.createDataFrame(rows, "category string, name_kind string")).collect()} == {("a", "soap")}


LISTING = "listing_id long, item_code long, item_name string, brand string, manufacturer string, supplier string, weight string, unit string, barcode string, category_0 string, category_1 string, category_2 string, category_3 string, category_4 string, source_file string, loaded_at timestamp_ntz"


def listing(spark, rows):
    full = [(k, c, n, b, m, s, w, u, None, None, None, None, None, None, f, None) for k, (c, n, b, m, s, w, u, f) in enumerate(rows, 1)]
    return spark.createDataFrame(full, LISTING)


def test_contents_with_habits(spark):
    rows = [
        (1, "Шампунь X 500 мл", None, None, None, "0.5", None, "z_1"), (2, "Шампунь Y", None, None, None, "0,25", None, "z_2"), (3, "Шампунь Z", None, None, None, "250", None, "t_1"), (4, "Шампунь Q 300 ml", None, None, None, "300", "", "t_1"),
        (5, None, None, None, None, None, None, "t_1"), (6, "Шампунь", None, None, None, "50", "сл", "i_1"), (7, "Шампунь", None, None, None, None, "шт", "d_1"), (8, "Салфетки", None, None, None, "100", None, "z_1"), (9, "Шампунь", None, None, None, "7", None, "unknown"),
    ]
    got = {r.listing_id: (r.amount, r.base_unit) for r in contents(listing(spark, rows)).collect()}
    assert got == {1: (500, "ml"), 2: (250, "ml"), 3: (250, "ml"), 4: (300, "ml"), 5: (None, None), 6: (500, "ml"), 7: (None, None), 8: (100, "pcs"), 9: (None, None)}
    assert contents(spark.createDataFrame([], LISTING)).count() == 0


def test_words_with_slips():
    assert one_edit("волос", "воос") and one_edit("мыло", "мыол") and not one_edit("мыло", "мел") and one_edit("", "a")
    assert concept("туаленая") == "bar" and concept("xyz") is None
    assert kind_of(filter(None, map(concept, words("З/паста с мёдом")))) == "toothpaste"
