"""Names, categories, pseudonyms, analytics and evaluation on small cases."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import code_text, jaccard, normal_name, to_number, token_set, volume_key
from tallyloom.operators import analytics as a
from tallyloom.operators import anonymize as an
from tallyloom.operators import categorize as cat
from tallyloom.operators import evaluate as ev
from tallyloom.operators import match as m
from tallyloom.operators.components import components


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_names(spark):
    texts = ["Super+ Гель (ABC):4/20", "Щётка Зубная", "Ariel Color 900мл", "Ariel 0,5л", "Шампунь 400 мл 2шт", "Блок 3х50г", "Прокладки 36-45лет", "Соль 2.5г", "", None]
    assert column(spark, texts, normal_name) == ["super plus gel", "schetka zubnaya", "ariel color 900ml", "ariel 0 5l", "shampun 400 ml 2sht", "blok 3kh50g", "prokladki 36 45let", "sol 2 5g", "", None]
    assert column(spark, texts, volume_key) == ["", "", "900ml", "500ml", "2pcs+400ml", "50g", "", "2g", "", ""]
    assert column(spark, ["1.5", "x", "5d", "", None], to_number) == [1.5, None, None, None, None]


def test_matching(spark):
    ten = "a b c d e f g h i j"
    names = ["Ariel Color 900мл", "ariel, COLOR 900мл", "Ariel Colour 900мл", "Ariel Color 900 мл", "Color Ariel 900мл", ten, "a b c d e f g h i", "b c d e f g h i j k", "!!!", "a b c d e f g h", None, "nan"]
    df = spark.createDataFrame([(k, n, "B", "e") for k, n in enumerate(names)], "id int, item_name string, brand string, other string")
    got = {r.name: r.canonical_name for r in m.canonical_names(m.names_of(df, "id")).collect()}
    assert got == {"Ariel Color 900мл": "ariel, COLOR 900мл", "a b c d e f g h i": ten}
    w = m.with_canonical(df, m.canonical_names(m.names_of(df, "id")))
    assert {r.id: r.canonical_name for r in w.collect()}[0] == "ariel, COLOR 900мл"


def test_matching_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(14)]
    names = sorted({"x " + " ".join(sorted(rng.sample(words, rng.randint(7, 13)))) for _ in range(60)})
    sets = spark.createDataFrame([(k, "b", sorted(set(n.split()))) for k, n in enumerate(names)], "id long, block string, tokens array<string>")
    for t in (0.7, 0.8, 0.9):
        got = {(r.a, r.b) for r in m.similar_sets(sets, t).collect()}
        toks = [set(n.split()) for n in names]
        assert got == {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if len(toks[i] & toks[j]) / len(toks[i] | toks[j]) >= t and toks[i] != toks[j]}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(30)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(None, 5), (7, 7)]
    parent = {x: x for p in pairs for x in p if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        if x is not None and y is not None and x != y:
            parent[max(root(x), root(y))] = min(root(x), root(y))
    touched = {x for x, y in pairs if x is not None and y is not None and x != y} | {y for x, y in pairs if x is not None and y is not None and x != y}
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_categories(spark):
    rows = [
        ("x", ["Мыло твердое"], "МЫЛО", 0.95), ("x", ["Средства для стирки"], "СТИРКА", 0.93), ("x", ["Уход за кожей лица"], "ЛИЦО", 0.93), ("x", ["Уход за кожей тела"], "ТЕЛО", 0.65), ("Fairy 900мл", [], "КУХНЯ (ручн)", 0.93),
        ("Таблетки для ПММ Finish", None, "ПММ", 0.93), ("Domestos гель для унитаза", ["Бытовая химия"], "", 0.0), ("Зубная паста Colgate 100 мл", ["nan", None], "", 0.0), (None, None, "", 0.0), ("", [""], "", 0.0),
    ]
    df = spark.createDataFrame([(k, n, c) for k, (n, c, _, _) in enumerate(rows)], "id int, name string, src_cats array<string>")
    got = {r.id: (r.target_category, r.category_confidence) for r in cat.classified(df).collect()}
    assert got == {k: (t, c) for k, (_, _, t, c) in enumerate(rows)}


def test_apply_categories(spark):
    rows = [(1, "Нечто", "B", None), (2, "нечто", "b", "Мыло твердое"), (3, "Fairy", None, None), (4, None, None, None), (5, "Fairy", "", "Средства для стирки")]
    df = spark.createDataFrame(rows, "id int, item_name string, brand string, category_1 string")
    got = {r.id: r.target_category for r in cat.apply_categories(df, "id").collect()}
    assert got == {1: "МЫЛО", 2: "МЫЛО", 3: "КУХНЯ (ручн)", 4: "", 5: "КУХНЯ (ручн)"}
    over = spark.createDataFrame([("нечто|||b", "СВОЯ", None)], "key string, target_category string, category_confidence double")
    top = {r.id: (r.target_category, r.category_confidence) for r in cat.apply_categories(df, "id", over, retry_empty=False).collect()}
    assert top[1] == ("СВОЯ", 1.0) and top[3] == ("КУХНЯ (ручн)", 0.93)
    changed = df.select(F.col("item_name").alias("name"), "brand", F.lit("Z").alias("target_category"))
    same = changed.withColumn("target_category", F.when(F.col("name") == "Нечто", "Z").otherwise("Y"))
    assert [r.key for r in cat.edited(same, changed.filter("name in ('Нечто', 'нечто')")).collect()] == ["нечто|||b"]


def items(spark, values, key="item_name"):
    return spark.createDataFrame([(f"i{k}", float(v), 0.0, "s", "r", p) for k, vs in enumerate(values) for p, v in enumerate(vs)], f"{key} string, sales_rub double, cost_rub double, store_name string, region string, period int")


def test_abc_xyz(spark):
    assert [r.abc for r in a.abc(items(spark, [[50.0], [30.0], [15.0], [4.0], [1.0]]), "item_name").orderBy("item_name").collect()] == list("AABCC")
    assert [r.abc for r in a.abc(items(spark, [[90.0], [10.0]]), "item_name").orderBy("item_name").collect()] == list("BC")
    assert [r.xyz for r in a.xyz(items(spark, [[10.0, 10, 10], [10.0, 12, 14], [0.0, 10, 20]]), "item_name", "period").orderBy("item_name").collect()] == list("XYZ")
    assert a.xyz(items(spark, [[1.0, 2]]), "item_name", "period").count() == 0
    assert a.abc(items(spark, []), "item_name").count() == 0


def test_running_total_is_the_sorted_sum(spark):
    rng = random.Random(2)
    vals = [(f"k{k}", rng.choice([1, 2, 2, 5, rng.randint(1, 10**6)])) for k in range(500)]
    run, want = 0, {}
    for k, v in sorted(vals, key=lambda x: (-x[1], x[0])):
        run += v
        want[k] = run
    got = a.running_total(spark.createDataFrame(vals, "k string, v long"), "v", "k").collect()
    assert {r.k: r.running for r in got} == want and {r.whole for r in got} == {run}


def test_anomaly_forecast_compare(spark):
    got = a.last_period_anomalies(items(spark, [[10.0, 12, 14, 20], [10.0, 10, 10, 99]]), "item_name", "period").collect()
    assert [(r.item_name, r.z) for r in got] == [("i0", 4.0)]
    f = a.forecast(items(spark, [[1.0, 3, 4]]).withColumn("period", F.col("period").cast("string")), "period")
    assert sorted(r.value for r in f.filter("kind = 'forecast'").collect()) == [5.67, 7.17, 8.67]
    c = a.compare(items(spark, [[0.0, 5.0], [4.0, 1.0]]), "item_name", "period").orderBy("item_name").collect()
    assert [(r.delta, r.delta_pct) for r in c] == [(5.0, None), (-3.0, -75.0)]
    assert a.kpi(items(spark, [])).first().gross_margin_pct is None


def test_pseudonyms(spark):
    keys = spark.createDataFrame([(f"brand {k}",) for k in range(300)] + [(None,), ("",)], "b string")
    one = an.pseudonyms(keys, "b", "brands")
    names = {r.key: r.pseudonym for r in one.collect()}
    assert len(names) == 300 == len(set(names.values()))
    more = an.pseudonyms(keys.unionByName(spark.createDataFrame([(f"new {k}",) for k in range(300)], "b string")), "b", "brands", known=one).collect()
    assert len(more) == 300 and not {r.pseudonym for r in more} & set(names.values())
    df = spark.createDataFrame([("brand 1", 100.0, 3.0, "n", "c", "extra")], "brand string, sales_rub double, qty_sold double, canonical_name string, item_code string, other string")
    r = an.anonymized(df, {"brands": one}).first()
    assert r.brand == names["brand 1"] and r.sales_rub == pytest.approx(111.7) and r.qty_sold == 5 and r.canonical_name != "n" and "item_code" not in r and r.other == "extra"


def test_evaluation(spark):
    pairs = spark.createDataFrame([("гель 500мл", "гель 500мл", "match"), ("гель", "мыло", "non-match"), ("гель", None, "match")], "a string, b string, label string")
    s = ev.scored_pairs(pairs.filter("b is not null"), "a", "b")
    assert {round(r.score, 6) for r in s.collect()} == {1.0, 0.0}
    rows = {r.threshold: r for r in ev.confusion(s, "label").collect()}
    assert len(rows) == 12 and rows[0.9].f1 == 1.0
    none = ev.confusion(s.withColumn("score", F.lit(0.0)), "label", [0.5]).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    assert column(spark, [["a"], [], None], lambda c: jaccard(c, F.array(F.lit("a"))), "array<string>") == [1.0, 0.0, 0.0]
    g = spark.createDataFrame([("a", "b", "match")], "a string, b string, label string")
    assert ev.new_golden(g, g.unionByName(spark.createDataFrame([("b", "a", "match")], "a string, b string, label string"))).count() == 2
    assert token_set(F.lit("a")) is not None


def test_pairs_over_a_corpus(spark):
    names = ["gel mint 5", "gel mint 6", "soap", "gel mint", "gel", "mint", "gel mint 5", None]
    corpus = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = spark.createDataFrame([("gel mint", "gel mint aloe", "match"), ("Гель Mint", "gel, mint", "match"), ("soap", "mint", "non-match")], "a string, b string, label string")

    def grams(name):
        words = [f" {w} " for w in name.split()]
        return Counter(w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1))

    def want(*more):
        normal = {n: n.lower().replace("гель", "gel").replace(",", "") for n in {*more, "gel mint", "gel mint aloe", "Гель Mint", "gel, mint", "soap", "mint"} if n}
        df = Counter(g for n in normal.values() for g in set(grams(n)))
        vec = {n: {g: c * (math.log((1 + len(normal)) / (1 + df[g])) + 1) for g, c in grams(normal[n]).items()} for n in normal}
        size = {n: math.sqrt(sum(x * x for x in v.values())) for n, v in vec.items()}
        return {(r.a, r.b): sum(x * vec[r.b].get(g, 0) for g, x in vec[r.a].items()) / size[r.a] / size[r.b] for r in pairs.collect()}

    for given, more in ((None, ()), (corpus, names)):
        got = {(r.a, r.b): r.score for r in ev.scored_pairs(pairs, "a", "b", given).collect()}
        assert got == pytest.approx(want(*more)) and got["Гель Mint", "gel, mint"] == pytest.approx(1.0)
    assert want(*names)["gel mint", "gel mint aloe"] != pytest.approx(want()["gel mint", "gel mint aloe"], abs=0.01)
    rarest = ev.with_rarest(ev.scored_pairs(pairs, "a", "b", corpus), "a", "b", corpus)
    assert {(r.a, r.b): r.rarest for r in rarest.collect()} == {("gel mint", "gel mint aloe"): 1, ("Гель Mint", "gel, mint"): None, ("soap", "mint"): 1}
    assert {r.a: (r.prediction, r.reason) for r in ev.gated(rarest, "a", "b", 0.5).collect()} == {"gel mint": ("review", "rare"), "Гель Mint": ("match", "none"), "soap": ("non-match", "score")}


def test_plans_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("Fairy 900мл", ["x"])], "name string, src_cats array<string>")
    for d in (cat.classified(df), df.select(normal_name(F.col("name")), volume_key(F.col("name")))):
        assert "Python" not in d._jdf.queryExecution().executedPlan().toString()


def test_stores_go_by_their_code(spark):
    df = spark.createDataFrame([(5.0, "Заря", "a"), (6.0, "Заря", "b"), (7.0, None, None), (5.0, "Заря-2", "c"), (None, "Маяк", "d")], "store_code double, store_name string, address string")
    maps = {"stores": an.pseudonyms(df, an.store_key(df), "stores")}
    assert {r.key for r in maps["stores"].collect()} == {"5", "6", "7"}
    rows = [(r.store_name, r.address) for r in an.anonymized(df, maps).collect()]
    assert len(rows) == 5 and len({n for n, _ in rows if n}) == 3 and len({a for _, a in rows if a}) == 3 and [r[0] for r in rows].count(None) == 1
    assert "store_code" not in an.anonymized(df, maps).columns
    texts = spark.createDataFrame([("5.0",), (" 05 ",), ("x.0",), (None,)], "c string")
    assert [r[0] for r in texts.select(code_text(texts, "c")).collect()] == ["5", "05", "x.0", None]


def test_many_keys_of_one_word(spark, monkeypatch):
    monkeypatch.setattr(an, "SYLLABLES", 1)
    keys = spark.range(2000).select(F.col("id").cast("string").alias("b"))
    assert an.pseudonyms(keys, "b", "brands").select("pseudonym").distinct().count() == 2000


def test_spread_of_great_values_does_not_cancel(spark):
    rows = items(spark, [[1e9, 1e9 + 1, 1e9 + 2, 1e9 + 1]])
    r = a.period_moments(rows, "item_name", "period", "revenue", last=False).first()
    assert r.mean == pytest.approx(1e9 + 1) and r.std == pytest.approx(math.sqrt(2 / 3), rel=1e-6)


def test_running_total_splits_equal_values(spark):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"), F.lit(7).cast("long").alias("v"))
    got = {r.k: r.running for r in a.running_total(rows, "v", "k").collect()}
    assert got == {f"k{i:04}": 7 * (i + 1) for i in range(1000)}
