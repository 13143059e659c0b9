"""The operators of the sub-package against brute force, exact round trips and small cases."""

from __future__ import annotations

import os
import random

import oracle
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries
from tallyloom.llm.addresses import parse
from tallyloom.llm.attributes import VARIETIES, brand_of, concepts_of
from tallyloom.llm.encode import ByteBpe, default_pattern, default_vocabulary, encoded
from tallyloom.llm.groups import connected_groups, decided_pairs
from tallyloom.llm.leaks import leaked_items, reading
from tallyloom.llm.linkage import fit
from tallyloom.llm.lookalike import canonical, look_alike_pairs
from tallyloom.llm.passages import coverage, seeds_of
from tallyloom.llm.places import pairs_of, same_building
from tallyloom.llm.products import pattern_counts, same_product

FOLDER = f"{oracle.DATA}/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name):
    oracle.compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], FOLDER)


@needs_tables
@pytest.mark.parametrize(("pairs", "groups", "table", "key", "group"), [("p3_found", "p3_buildings", "stores", "store_code", "building"), ("p7_found", "p7_products", "listings", "listing_id", "product")])
def test_pairs_are_those_of_the_groups(spark, pairs, groups, table, key, group):
    members = {}
    for r in queries.QUERIES[groups](spark, FOLDER).collect():
        members.setdefault(r[group], set()).add(r[key])
    assert all(g == min(ms) for g, ms in members.items()) and sum(map(len, members.values())) == len(set().union(*members.values()))
    assert {tuple(r) for r in queries.QUERIES[pairs](spark, FOLDER).collect()} == {(a, b) for ms in members.values() for a in ms for b in ms if a < b}
    known = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    assert set().union(*members.values()) <= known and len(members) < len(known)


@needs_tables
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_ids_of_all_documents(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(default_vocabulary().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = dict(map(tuple, spark.read.parquet(f"{oracle.DATA}/{folder}/documents.parquet").select("doc_id", "text").collect()))
    got = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, f"{oracle.DATA}/{folder}").collect()}
    assert got == {k: t.encode(x, add_special_tokens=False).ids if x else [] for k, x in texts.items()}


@needs_tables
def test_classes_of_all_documents(spark):
    rows = {r.doc_id: r for r in queries.p10_canonical(spark, FOLDER).collect()}
    texts = dict(map(tuple, spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()))
    assert rows.keys() == texts.keys()
    pairs = {tuple(r) for r in queries.p10_found(spark, FOLDER).collect()}
    by_class = {}
    for k, r in rows.items():
        if r.class_id is not None:
            by_class.setdefault(r.class_id, []).append(k)
    assert pairs == {(a, b) for ks in by_class.values() for a in ks for b in ks if a < b and texts[a] != texts[b]} and pairs
    assert all(rows[c].class_id == c and rows[c].form in {texts[k] for k in ks} for c, ks in by_class.items())


def union_find(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def test_groups(spark):
    rng = random.Random(4)
    chain, hub = [(k, k + 1) for k in range(60)], [(1000, k) for k in range(1001, 1040)]
    loose = [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)]
    pairs = [*chain, *hub, *loose, *loose[:5], (None, 3), (5, None), (9, 9), (500, 500), (61, 60)]
    got = {r.id: r.group_id for r in connected_groups(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == union_find(pairs)
    assert connected_groups(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long"), "a", "b").count() == 0


def test_decisions(spark):
    schema = "match_id long, name_id long, item_name string, canonical_id long, canonical_name string, score double, verdict string, decided_at timestamp_ntz"
    t = lambda d: f"2021-01-{d:02}"
    rows = [
        (1, 1, "a", 2, "b", None, " MATCH ", t(1)), (2, 2, " b ", 1, "a", None, "non-match", t(2)), (3, 3, "c", None, "b", None, "Match", t(1)), (4, None, " a", 4, "d", None, "match", t(1)), (5, 4, "d", 1, "a", None, None, None),
        (6, 5, "e", 5, "e", None, "match", t(1)), (7, 6, "f", None, None, None, "match", t(1)), (8, None, "unknown", 1, "a", None, "match", t(1)), (9, 7, "g", 8, "h", None, "match", t(1)), (10, 8, "h", 7, "g", None, "review", t(1)), (11, None, "A", 9, "i", None, "match", t(1)),
    ]
    df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string")).withColumn("decided_at", F.col("decided_at").cast("timestamp_ntz"))
    assert {(r.a, r.b) for r in decided_pairs(df).collect()} == {(2, 3), (1, 4)}
    assert decided_pairs(df.limit(0)).count() == 0


def test_look_alikes(spark):
    texts = ["Сода 5 кг", "Cодa 5 кг", "Сода 5 кг", "Со​да ５ кг", "сода 5 кг", "Сода 6 кг", "ёлка", "ёлка", None, "", " ​ ", "\n", "Сода 5 кг", "Сода 5  кг", "йод", "йод", "co‑op", "co-op"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, form string")
    got = {(r.doc_id_a, r.doc_id_b) for r in look_alike_pairs(df, "doc_id", "text").collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (1, 12), (2, 12), (3, 12), (6, 7), (14, 15), (16, 17)}
    forms = {r.doc_id: r for r in canonical(df.drop("form"), "doc_id", "text").collect()}
    assert len(forms) == len(texts) and forms[12].class_id == 0 == forms[3].class_id and forms[8].form is None and forms[10].form is None and forms[4].class_id == 4
    assert look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = default_vocabulary().replace(".tiktoken", ".json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["", "  ", "a", "Привет, мир!", "<|endoftext|>", "don't  stop\n\n  now", "ａ👍🏽‍﻿", "x" * 3000, "щ" * 2000, "12345 6.7%", "\t\r\n", "數量"]
    texts += ["".join(rng.choice("абвgh 1,\n'’ёÄ漢̆") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    rows = encoded(spark.createDataFrame([(k, x) for k, x in enumerate([*texts, None])], "k int, text string"), "text").collect()
    got = {r.k: list(r.ids) for r in rows}
    for k, x in enumerate(texts):
        assert got[k] == t.encode(x, add_special_tokens=False).ids, x[:50]
    assert got[len(texts)] == [] == got[0]
    assert encoded(spark.createDataFrame([], "text string"), "text").count() == 0


def test_cuts_are_whole():
    bpe = ByteBpe(default_vocabulary(), default_pattern())
    for piece in (b"", b"abc", "щётка".encode(), bytes(range(256))):
        cut = bpe.cuts(piece)
        assert b"".join(cut) == piece
        assert all(a[-1:] + b[:1] not in bpe.together for a, b in zip(cut, cut[1:]) if a and b)


ITEM = "Контрольная задача: партия Вувозему миновала 4421 километров от пристани Кубрадагорск до рынка Брализогорск, потеряв 98 брикетов, тогда как ведомость обещала 4549 единиц вместе с тарой; вычислите остаток и укажите порядок округления."
OTHER = "Контрольная задача: партия Жарагрозу миновала 1234 километров от пристани Релебригорск до рынка Рижолуйск, потеряв 92 брикетов, тогда как ведомость обещала 3244 единиц вместе с тарой; вычислите остаток и обоснуйте виновника."


def test_leaks(spark):
    half = ITEM[: int(len(ITEM) * 0.6)]
    slips = ITEM.replace("партия", "патрия").replace("рынка", "самого рынка").replace("ведомость", "ведомсоть").upper()
    docs = [ITEM, "Начало. " + half + " Конец.", "x " + slips, ITEM[: len(ITEM) // 4], "вместе с тарой", None, "", OTHER, ITEM.replace(" ", "\n​").replace("а", "a"), half[:70] + " слово " * 30 + half[70:], ITEM + " " + OTHER]
    d = spark.createDataFrame([(k, t, "c") for k, t in enumerate(docs)], "doc_id long, text string, item string")
    items = spark.createDataFrame([(1, ITEM, "k"), (2, OTHER, "k"), (3, None, "k"), (4, "...", "k")], "item_id long, text string, doc string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(d, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (7, 2), (8, 1), (9, 1), (10, 1), (10, 2)}
    assert leaked_items(d.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaked_items(d, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_slips_and_short_items(spark):
    words = ITEM.split()
    slipped = " ".join(w[:2] + w[3:] if k % 6 == 3 and len(w) > 4 else w for k, w in enumerate(words))  # a letter lost in every sixth word
    half = slipped[: int(len(slipped) * 0.62)]
    docs = [slipped, "пролог " * 30 + half + " эпилог" * 30, "проверочная тарификация", "другое Проверочная, тарификация другое", "да нет", " ".join(reversed(words))]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(docs)] + [(0, slipped)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "Проверочная тарификация!"), (3, "да нет"), (1, ITEM)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaked_items(d, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(0, 1), (1, 1), (2, 2), (3, 2)]


@needs_tables
def test_leaks_against_all_pairs(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "eval_items"))
    got = {tuple(r) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect()}
    flat = lambda df, k: {r[0]: r[1].replace(" ", "") for r in df.select(k, reading(F.col("text"))).collect() if r[1]}
    d, i = flat(docs, "doc_id"), flat(items, "item_id")
    seeds = {k: seeds_of(v) for k, v in i.items()}
    assert got == {(x, y) for x, t in d.items() for y, s in i.items() if coverage(s, seeds[y], t) >= 0.5}


@pytest.mark.parametrize(
    ("text", "town", "kind", "ordinal", "name", "house", "unit"),
    [
        ("200674, г. Фафалигорск, пр-кт Гончарынй, 49, оф. 30", "фафалигорск", "проспект", None, "гончарынй", "49", None), ("Dolgopolnyy kray, g.Pistemask, 2-aya Ozernaya ul., d.79 lit. B, of. 33", "пистемаск", "улица", "2", "озерная", "79", "б"),
        ("60/2, УЛИЦА ТКАЧЕЙ, Г.СОПУВОВО, БРУСНИЧНАЯ ОБЛ., ТЦ «ПОЛЯНА»", "сопувово", "улица", None, "ткачей", "60", "2"), ("Зебокаво,Ул. Хлебная,д.45 к. 2,1 этаж", "зебокаво", "улица", None, "хлебная", "45", "2"),
        ("Домиреск, Кленовая у., д. 80\"Б\"", "домиреск", "улица", None, "кленовая", "80", "б"), ("14, у. 2 Рябиновая, г.Лутогрийск", "лутогрийск", "улица", "2", "рябиновая", "14", None), ("Корабелов,д. 46,г.Пистемаск", "пистемаск", None, None, "корабелов", "46", None),
        ("200003 Брусничная обл. Сопувово Речное ш № 51", "сопувово", "шоссе", None, "речное", "51", None), ("№ 74 б-р Вокзальный 201528 пом. 5", None, "бульвар", None, "вокзалный", "74", None),
    ],
)
def test_addresses(text, town, kind, ordinal, name, house, unit):
    a = parse(text)
    assert (a.town, a.kind, a.ordinal, a.name, a.house, a.unit) == (town, kind, ordinal, name, house, unit)


def test_unusable_addresses():
    assert all(parse(x) is None for x in (None, "", "  ", "-", "нет данных", "адрес в договоре", "уточняется", "г. Домиреск"))


def test_buildings(spark):
    rows = [
        (1, "Т", "г. Домиреск, ул. Кленовая, д. 80 лит. Б", None), (2, "Т", "Кленовая ул., 80б, Домиреск, оф. 3", None), (3, "Магазин (Домиреск)", "ул. Кленовая, 80-Б", None), (4, "Т", "г. Домиреск, ул. Кленовая, д. 80", None), (5, "Т", "г. Домреск, ул. Клееновая, 80Б", None),
        (6, "Т", "г. Пистемаск, ул. Кленовая, д. 80 лит. Б", None), (7, "Т", None, None), (8, "Т", "нет данных", None), (9, "Т", "г. Домиреск, наб. Кленовая, д. 80 лит. Б", None), (10, "Т", "г. Домиреск, 2-я Кленовая ул., д. 80 лит. Б", None), (1, "Т", "г. Домиреск, ул. Кленовая, д. 80 лит. Б", None),
    ]
    more = [(100 + k, "Т", f"г. Городок{k % 7}ск, ул. {s}, д. {k}", None) for k, s in enumerate(["Лесная", "Речная", "Садовая", "Полевая", "Мельников"] * 8)]
    more += [(200 + k, "Т", f"улица {s} {k}, Городок{k % 7}ск", None) for k, s in enumerate(["Лесная", "Речная", "Садовая", "Полевая", "Мельников"] * 8)]
    df = spark.createDataFrame(rows + more, "store_code long, store_name string, address string, region string")
    got = {(r.store_code_a, r.store_code_b) for r in pairs_of(same_building(df), "store_code", "building").collect()}
    assert {p for p in got if p[1] < 100} == {(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)}
    assert {p for p in got if p[1] >= 100} == {(100 + k, 200 + k) for k in range(40)}
    assert same_building(df.limit(0)).count() == 0


def test_weights_find_the_classes():
    rng = random.Random(8)
    counts = {}
    truth = {}
    for _ in range(20000):
        match = rng.random() < 0.1
        p = tuple("missing" if rng.random() < 0.1 else "same" if rng.random() < (0.9 if match else 0.15) else "differ" for _ in range(4))
        counts[p] = counts.get(p, 0) + 1
        truth[p] = truth.get(p, 0) + match
    w = fit(list(counts.items()), ("same",), 0.3)
    assert abs(w.share - 0.1) < 0.02
    assert all(abs(w.probability(p) - truth[p] / n) < 0.12 for p, n in counts.items() if n > 300)


def test_traits():
    rows = [
        ("Бежабаже Family Салфетки влажные с облепихой 120 шт", "Bezhabazhe", None, None), ("WET WIPES BUCKTHORN облепиха №120", "ООО «Бежабажепром»", None, "БЕЖАБАЖЕ"),
        ("Влажн. салф. облепиховый", None, "АО «Бежабаже Трейд»", "ТД «Опт»"),
    ]
    assert {brand_of(b, m, s) for _, b, m, s in rows} == {"bezhabazhe"}
    assert all("buckthorn" in concepts_of(n) for n, *_ in rows)
    assert brand_of(None, None, None) is None and concepts_of(None) == [] and brand_of("нет бренда", None, None) is None
    assert {"two_ply"} == set(concepts_of("Туалетная бумага 2-слойная")) & set(VARIETIES["toilet_paper"])


LISTING = "listing_id long, item_code long, item_name string, brand string, manufacturer string, supplier string, weight string, unit string, category_1 string, category_2 string, category_3 string, source_file string, product string"


def test_products(spark):
    rows = [
        (1, 11, "Жидкое мыло Альфа лимон 500 мл", "Альфа", "a_1"), (2, 21, "LIQUID SOAP LEMON 0,5 l хит", "ALFA", "b_1"), (3, 31, "Альфа мыло жидк. с лимоном", "Альфа", "c_1"), (4, 41, "Жидкое мыло Альфа мята 500 мл", "Альфа", "a_1"), (5, 51, "Жидкое мыло Альфа мята 250 мл", "Альфа", "a_1"),
        (6, 61, "Жидкое мыло Альфа мята", "Альфа", "b_1"), (7, 61, "Жидкое мыло Альфа мята", "Альфа", "b_1"), (8, 81, "Жидкое мыло Альфа алоэ 2х250 мл", "Альфа", "a_1"), (9, None, None, None, "a_1"), (10, None, "", "", None), (11, 91, "Жидкое мыло Бета лимон 500 мл", "Бета", "a_1"),
    ]
    rng = random.Random(1)
    some = rng.sample([(b, s, v) for b in ("Альфа", "Бета", "Гамма", "Дельта", "Лямбда", "Сигма") for s in ("лимон", "мята", "алоэ", "мёд", "шалфей", "кокос") for v in (200, 400, 750, 500, 250)], 30)
    more = [(100 + 100 * c + k, 1000 + 100 * c + k, f"Шампунь {s} {v} мл", b, f"{'xyz'[c]}_1") for c in range(3) for k, (b, s, v) in enumerate(some)]
    df = spark.createDataFrame([(i, c, n, b, None, None, None, None, None, None, None, f, "x") for i, c, n, b, f in rows + more], LISTING)
    got = {(r.listing_id_a, r.listing_id_b) for r in pairs_of(same_product(df), "listing_id", "product").collect()}
    assert {p for p in got if p[1] < 100} == {(1, 2), (1, 3), (2, 3), (6, 7)}
    assert {p for p in got if p[1] >= 100} == {(100 * x + k, 100 * y + k) for k in range(30) for x, y in ((1, 2), (1, 3), (2, 3))}
    assert same_product(df).count() == len(rows) + len(more)
    assert same_product(df.limit(0)).count() == 0


def test_listing_without_content_needs_no_other_listings(spark):
    rows = [(1, "Шампунь лимон 200 мл", "Альфа"), (2, "Шампунь лимон", "Альфа"), (3, "Шампунь мята 200 мл", "Бета"), (4, "Шампунь мята 400 мл", "Бета"), (5, "Шампунь мята", "Бета")]
    df = spark.createDataFrame([(i, i, n, b, None, None, None, None, None, None, None, f"x{i}_1", "x") for i, n, b in rows], LISTING)
    for some, want in ((df.filter("listing_id <= 2"), {(1, 2)}), (df, {(1, 2)})):  # 5 has two products to belong to
        assert {(r.listing_id_a, r.listing_id_b) for r in pairs_of(same_product(some), "listing_id", "product").collect()} == want


def test_pattern_counts(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["alpha", "beta1", "beta2"]), rng.choice("kl"), rng.choice(["x", "y", None]), rng.choice(["1", "2", None]), 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "brand string, kind string, variety string, content string, n int")
    near = spark.createDataFrame([("beta1", "beta2")], "w string, other string")
    level = lambda x, y: "missing" if x is None or y is None else "same" if x == y else "differ"
    want = {}
    for i in range(60):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[1] == b[1]:
                p = ("same" if a[0] == b[0] else "near" if {a[0], b[0]} == {"beta1", "beta2"} else "differ", level(a[2], b[2]), level(a[3], b[3]))
                want[p] = want.get(p, 0) + 1
    assert dict(pattern_counts(df, near)) == want


def groups_of(df):
    found = {}
    for r in same_product(df).collect():
        found.setdefault(r.product, set()).add(r.listing_id)
    return {frozenset(g) for g in found.values()}


@needs_tables
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_misspelt_brands_find_their_products(spark, folder):
    """One listing in twenty loses a letter of its brand; what belonged together still does."""
    rows = spark.read.parquet(f"{oracle.DATA}/{folder}/listings.parquet")
    spelt = F.col("brand")
    hit = (F.pmod(F.xxhash64("listing_id"), F.lit(20)) == 0) & (F.length(spelt) >= 7) & ~spelt.contains("«") & ~spelt.contains(" ")
    slips = rows.withColumn("brand", F.when(hit, F.concat(F.substring(spelt, 1, 3), spelt.substr(F.lit(5), F.lit(50)))).otherwise(spelt))
    n = slips.join(rows.select("listing_id", F.col("brand").alias("was")), "listing_id").filter("brand <> was").count()
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    want, got = pairs(groups_of(rows)), pairs(groups_of(slips))
    assert n >= 3 and len(want & got) >= 0.99 * len(want) and len(want & got) >= 0.99 * len(got), (n, len(want), len(got), len(want & got))


def test_listings_without_content(spark):
    rows = [(1, "Шампунь лимон"), (2, "Шампунь лимон"), (3, "Шампунь мята 200 мл"), (4, "Шампунь мята 400 мл"), (5, "Шампунь мята"), (6, "Шампунь мята"), (7, "Шампунь 300 мл"), (8, "Шампунь 300 мл"), (9, None), (9, None)]
    df = spark.createDataFrame([(i, i, n, "Альфа", None, None, None, None, None, None, None, "x_1", "x") for i, n in rows], LISTING)
    assert groups_of(df) == {frozenset(g) for g in ([1, 2], [3], [4], [5], [6], [7], [8], [9])}


@pytest.mark.parametrize(
    ("one", "other", "same"),
    [("𝐀bc １", "Abc 1", True), ("Ⅳ том", "IV том", True), ("ｶﾞｽ", "ガス", True), ("ᎪᏴ", "AB", True), ("ﬁn", "fin", True), ("Օk", "Ok", True), ("x²", "x2", False), ("①", "1", False), ("ёж", "еж", False), ("е́", "é", True), ("З", "3", False), ("a", "A", False)],
)
def test_wide_table_of_look_alikes(spark, one, other, same):
    df = spark.createDataFrame([(1, one + " хвост"), (2, other + " хвост"), (3, other + " хвост")], "doc_id long, text string")
    got = {tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()}
    assert got == ({(1, 2), (1, 3)} if same else set())


def test_brands_that_are_near_by_chance_stay_apart(spark):
    """Many brands, two of them a letter apart, nothing misspelt: no product holds both."""
    rng = random.Random(12)
    brands = ["Альфабет", "Альфавет", *("".join(rng.choice("бвгдкл") + rng.choice("аоуи") for _ in range(4)).capitalize() for _ in range(40))]
    rows = [(k, f"Шампунь {rng.choice(['лимон', 'мята', 'алоэ', 'мёд', 'шалфей', 'кокос'])} {rng.choice([200, 250, 300, 400, 500, 750])} мл", rng.choice(brands)) for k in range(4000)]
    df = spark.createDataFrame([(i, i, n, b, None, None, None, None, None, None, None, f"x{i}_1", "x") for i, n, b in rows], LISTING)
    brand = {i: b for i, _, b in rows}
    assert all(len({brand[i] for i in g}) == 1 for g in groups_of(df))
