"""Queries of the sales engine over the driver's tables, and the same in DuckDB SQL.

The star-schema tables are read as canonical sales (one row per order line); texts come from the catalogue listings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.lexicon import words_of
from tallyloom.functions.text import composite_key, is_blank, jaccard, key_seed, normal_category, normal_name, to_number, token_set, transliterate, volume_key
from tallyloom.operators import analytics as a
from tallyloom.operators import anonymize as an
from tallyloom.operators import categorize as cat
from tallyloom.operators import consolidate as co
from tallyloom.operators import evaluate as ev
from tallyloom.operators import match as m
from tallyloom.operators.keywords import PRODUCT_CLUSTERS, SOURCE_PHRASES
from tallyloom.session import table
from tallyloom.streaming.commands import commands, windowed


def sales(spark: SparkSession, d: str) -> DataFrame:
    """The star schema as canonical sales. Money is decimal, so sums do not depend on order."""
    li, o, c, n, r, p, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier"))
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    store = c.join(place, c.c_nationkey == place.n_nationkey)
    j = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(store, o.o_custkey == store.c_custkey)
        .join(p, li.l_partkey == p.p_partkey)
        .join(s, li.l_suppkey == s.s_suppkey)
    )
    money = lambda x: F.col(x).cast("decimal(12,2)")
    return j.select(
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.col("c_custkey").alias("store_code"),
        F.col("c_name").alias("store_name"),
        F.col("n_name").alias("address"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("store_format"),
        F.col("p_type").alias("category_1"),
        F.col("o_orderpriority").alias("category_2"),
        F.col("p_partkey").alias("item_code"),
        F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("ml"))).alias("item_name"),
        F.col("p_brand").alias("brand"),
        F.col("s_name").alias("supplier"),
        F.col("l_quantity").cast("decimal(12,2)").alias("qty_sold"),
        (money("l_extendedprice") * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))).alias("sales_rub"),
        (money("p_retailprice") * F.col("l_quantity").cast("decimal(12,2)")).alias("cost_rub"),
        F.concat(F.lit("part_"), (F.col("l_orderkey") % 3).cast("string")).alias("source_file"),
    )


SALES = """sales_view as (select year(o_orderdate)::int "year", month(o_orderdate)::int "month", strftime(o_orderdate, '%Y-%m') period, c_custkey store_code, c_name store_name, n_name address, r_name region,
 c_mktsegment store_format, p_type category_1, o_orderpriority category_2, p_partkey item_code, p_name || ' ' || p_size || 'ml' item_name, p_brand brand, s_name supplier, l_quantity::decimal(12,2) qty_sold,
 l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2)) sales_rub, p_retailprice::decimal(12,2) * l_quantity::decimal(12,2) cost_rub, 'part_' || (l_orderkey % 3) source_file
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""


def over_sales(f, *args, **kwargs):
    return lambda spark, d: f(sales(spark, d), *args, **kwargs)


def listings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings")


def listing_products(spark: SparkSession, d: str) -> DataFrame:
    cats = F.array(*(f"category_{k}" for k in range(5)))
    return listings(spark, d).select("listing_id", F.col("item_name").alias("name"), "brand", cats.alias("src_cats"))


def merge_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    """Three extracts with different headers and columns."""
    s = sales(spark, d)
    parts = [s.filter(F.col("source_file") == f"part_{k}").drop("source_file", "period") for k in range(3)]
    parts[0] = parts[0].withColumnsRenamed({"store_name": "Название магазина", "sales_rub": "Выручка", "qty_sold": "Кол-во"}).withColumn("Примечание", F.lit("x"))
    parts[1] = parts[1].withColumnsRenamed({"region": "Регион сбыта", "category_1": "Уровень 1", "cost_rub": "Себестоимость"}).drop("supplier")
    return [co.canonical(p) for p in parts]


def merge_union(spark: SparkSession, d: str) -> DataFrame:
    return co.merged(merge_tables(spark, d)).groupBy("region", "category_1", "year").agg(F.count("*").alias("n"), F.sum("sales_rub").cast("double").alias("sales_rub"))


def merge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    few = [t.select("year", "region", "category_1", "brand", "qty_sold", "sales_rub", "cost_rub") for t in merge_tables(spark, d)]
    return a.as_double(co.merged(few, aggregate=True), "qty_sold", "sales_rub", "cost_rub")


def classified_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with both names and a clear verdict, as labelled pairs. A spelling that is missing on a row is found by its id on another."""
    v = F.lower(F.trim("verdict"))
    rows = table(spark, d, "name_matches")
    sides = (("name_id", "item_name", "a"), ("canonical_id", "canonical_name", "b"))
    spelled = [rows.select(F.col(i).alias("id"), F.trim(n).alias("s")) for i, n, _ in sides]
    spelled = spelled[0].unionByName(spelled[1]).filter("id is not null and s is not null").groupBy("id").agg(F.min("s").alias("s"))
    t = rows.filter(v.isin("match", "non-match")).select("name_id", "item_name", "canonical_id", "canonical_name", v.alias("label"))
    for i, n, out in sides:
        t = t.join(spelled.select(F.col("id").alias(i), F.col("s").alias(f"_{out}")), i, "left").withColumn(out, F.coalesce(F.trim(n), f"_{out}"))
    return t.filter("a is not null and b is not null").select("a", "b", "label").distinct()


def confusion_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(ev.scored_pairs(classified_pairs(spark, d), "a", "b"), "label")


def gated_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = classified_pairs(spark, d)
    names = listings(spark, d).filter(~is_blank(F.col("item_name"))).select(F.trim("item_name").alias("name"))
    g = ev.gated(ev.with_rarest(ev.scored_pairs(pairs, "a", "b", names), "a", "b", names), "a", "b")
    return g.groupBy("label", "prediction", "reason").count()


def token_alerts(spark: SparkSession, d: str) -> DataFrame:
    p = classified_pairs(spark, d)
    known = p.filter("label = 'match'").select(F.explode(token_set(normal_name(F.col("a")))).alias("token"))
    return ev.token_alerts(p.filter("label = 'non-match'"), "a", "b", known)


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = classified_pairs(spark, d)
    score = jaccard(token_set(normal_name(F.col("a"))), token_set(normal_name(F.col("b"))))
    return p.select("a", "b", score.alias("score"))


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return m.canonical_names(m.names_of(listings(spark, d), "listing_id"))


def new_keys_anti(spark: SparkSession, d: str) -> DataFrame:
    p = listing_products(spark, d)
    cache = p.filter("listing_id % 2 = 0").select(composite_key(F.col("name"), F.col("brand")).alias("key"), F.when(F.col("listing_id") % 4 == 0, "x").otherwise("").alias("target_category"))
    over = p.filter("listing_id % 5 = 0").select(composite_key(F.col("name"), F.col("brand")).alias("key"))
    return cat.new_keys(p.select("listing_id", "name", "brand"), cache, over)


def override_precedence(spark: SparkSession, d: str) -> DataFrame:
    p = listing_products(spark, d).select("listing_id", "name", "brand")
    key = composite_key(F.col("name"), F.col("brand"))
    over = p.filter("listing_id % 3 = 0").groupBy(key.alias("key")).agg(F.lit("ручная").alias("target_category"), F.lit(None).cast("double").alias("category_confidence"))
    cache = p.filter("listing_id % 2 = 0").groupBy(key.alias("key")).agg(F.lit("из кэша").alias("target_category"), F.lit(0.5).alias("category_confidence"))
    return cat.with_precedence(p, over, cache)


def applied(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d).select("listing_id", "item_name", "brand", *(f"category_{k}" for k in range(5)))
    return cat.apply_categories(rows, "listing_id").select("listing_id", "target_category", "category_confidence")


def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, d).filter("category_confidence < 0.70")


def command_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "purchase", " /merge ").otherwise(F.col("event_type")).alias("value"))
    return commands(e).select("event_id")


def anonymized_lines(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d).select("store_code", "store_name", "address", "region", "brand", "supplier", "category_1", "item_name", "item_code", "qty_sold", "sales_rub", "cost_rub")
    maps = {"brands": an.pseudonyms(s, "brand", "brands"), "stores": an.pseudonyms(s, an.store_key(s), "stores"), "companies": an.pseudonyms(s, "supplier", "companies")}
    keys = ("region", "brand", "store_name", "address", "supplier")
    return an.anonymized(s, maps).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("sales_rub"), 2).alias("sales_rub"), F.sum("qty_sold").alias("qty_sold"), F.min("item_name").alias("first_item"))


def corpus_unique(spark: SparkSession, d: str) -> DataFrame:
    return co.corpus(listings(spark, d), "listing_id").select("name", "brand", "source_category")


def suggest(spark: SparkSession, d: str) -> DataFrame:
    return co.suggested_categories(listings(spark, d), "source_file")


def name_columns(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("item_name")
    return listings(spark, d).select("listing_id", normal_name(c).alias("normal"), transliterate(F.lower(c)).alias("latin"))


def by_column(column, name="volume"):
    return lambda spark, d: listings(spark, d).select("listing_id", column(F.col("item_name")).alias(name))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("listing_id", to_number(F.regexp_replace("weight", ",", ".")).alias("number"), key_seed(F.col("item_name")).alias("seed"), an.changed_price(F.col("listing_id") / 7).alias("price"))


QUERIES = {
    "sales_filtered": over_sales(lambda s: a.as_double(a.sums(a.filtered(s, {"region": ["ASIA", "EUROPE"], "year": ["1996", "1997"], "brand": []}), ["region", "year"], "revenue"), "revenue")),
    "filter_options": over_sales(a.options, "brand"),
    "kpi": over_sales(a.kpi),
    "category_share": over_sales(a.share, "category_1"),
    "category_coverage": over_sales(a.coverage, "category_2"),
    "region_sales": over_sales(lambda s: a.as_double(a.sums(s, ["region"], "revenue"), "revenue")),
    "category_region_heatmap": over_sales(lambda s: a.as_double(a.sums(s, ["category_1", "region"], "revenue"), "revenue")),
    "period_category": over_sales(lambda s: a.as_double(a.sums(s, ["period", "category_1"], "revenue"), "revenue")),
    "period_series": over_sales(lambda s: a.as_double(a.sums(s, ["period"], "revenue", "qty"), "revenue", "qty")),
    "store_ranking": over_sales(a.store_ranking),
    "category_summary": over_sales(a.summary, "category_1"),
    "brand_summary": over_sales(a.summary, "brand"),
    "abc_class": over_sales(a.abc, "item_name"),
    "abc_summary": over_sales(a.abc_summary, "item_name"),
    "xyz_class": over_sales(a.xyz, "brand", "period"),
    "abc_xyz_matrix": over_sales(a.abc_xyz, "brand", "period"),
    "pareto_top40": over_sales(a.pareto, "item_name"),
    "top_brands": over_sales(a.top, "brand"),
    "top_items": over_sales(a.top, "item_name"),
    "period_compare": over_sales(a.compare, "category_1", "period", "1996-01", "1997-01"),
    "top_movers": over_sales(a.movers, "brand", "year"),
    "low_margin": over_sales(a.low_margin, "item_name", 50.0),
    "zscore_anomalies": over_sales(a.last_period_anomalies, "brand", "period"),
    "forecast_linear": over_sales(a.forecast, "period"),
    "source_row_counts": over_sales(lambda s: s.groupBy("source_file").count()),
    "merge_union": merge_union,
    "merge_aggregate": merge_aggregate,
    "name_norm": name_columns,
    "category_norm": by_column(normal_category, "for_category"),
    "volume_key": by_column(volume_key),
    "number_functions": numbers,
    "block_candidates": lambda spark, d: m.blocks(m.names_of(listings(spark, d), "listing_id")),
    "jaccard_pairs": jaccard_pairs,
    "canonical_names": canonical_names,
    "classify_src": lambda spark, d: cat.by_source(listing_products(spark, d), "src_cats", cat.targets()).select("listing_id", F.col("by_source.target_category").alias("target"), F.col("by_source.category_confidence").alias("conf")),
    "classify_name": lambda spark, d: cat.by_name(listing_products(spark, d), "name", cat.targets()).select("listing_id", F.col("by_name.target_category").alias("target"), F.col("by_name.category_confidence").alias("conf")),
    "apply_categories": applied,
    "low_confidence_queue": low_confidence,
    "suggest_categories": suggest,
    "corpus_unique": corpus_unique,
    "anonymize_brand": lambda spark, d: an.pseudonyms(sales(spark, d), "brand", "brands").select("key", "pseudonym"),
    "anonymize_store": lambda spark, d: an.pseudonyms(sales(spark, d), "store_code", "stores").select("key", "pseudonym"),
    "anonymize_company": lambda spark, d: an.pseudonyms(sales(spark, d), "supplier", "companies").select("key", "pseudonym"),
    "anonymize_measures": anonymized_lines,
    "confusion_sweep": confusion_sweep,
    "gated_pairs": gated_pairs,
    "token_alerts": token_alerts,
    "doc_freq": lambda spark, d: ev.document_frequency(listings(spark, d), "item_name"),
    "new_keys_anti": new_keys_anti,
    "override_precedence": override_precedence,
    "command_filter": command_filter,
    "event_windows": lambda spark, d: windowed(table(spark, d, "events")),
}

# -- DuckDB ---------------------------------------------------------------------------------------------------------------


def _sales_sql(select: str) -> str:
    return f"with {SALES} {select}"


_MULTI = [("щ", "sch"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya")]


def _latin(x: str) -> str:
    for c, l in _MULTI:
        x = f"replace({x}, '{c}', '{l}')"
    return f"replace(replace(translate({x}, 'абвгдеёзийклмнопрстуфыэ', 'abvgdeeziyklmnoprstufye'), 'ъ', ''), 'ь', '')"


def _normal(x: str) -> str:
    s = rf"regexp_replace(trim(lower({x})), '\s*\([^)]+\)\s*:\s*\d[\d/]*\s*$|\s*:\s*\d[\d/]*\s*$', '')"
    s = f"replace({s}, '+', ' plus ')"
    return _latin(rf"trim(regexp_replace(regexp_replace({s}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))")


_UNIT = r"(?i)(\d+[.,]?\d*)\s*(мл|л|г|гр|кг|шт|уп|пак|рул|ml|l|g|kg|pcs)(?:[^\p{L}\p{N}_]|$)"


def _volume(x: str) -> str:
    pairs = f"list_zip(regexp_extract_all({x}, '{_UNIT}', 1), regexp_extract_all({x}, '{_UNIT}', 2))"
    v = "replace(p[1], ',', '.')::double"
    one = (
        f"case when lower(p[2]) in ('л', 'l') then round_even({v} * 1000, 0)::bigint || 'ml' when lower(p[2]) in ('мл', 'ml') then round_even({v}, 0)::bigint || 'ml' "
        f"when lower(p[2]) in ('кг', 'kg') then round_even({v} * 1000, 0)::bigint || 'g' when lower(p[2]) in ('г', 'гр', 'g') then round_even({v}, 0)::bigint || 'g' else round_even({v}, 0)::bigint || 'pcs' end"
    )
    return f"coalesce(array_to_string(list_sort(list_distinct(list_transform({pairs}, lambda p: {one}))), '+'), '')"


def _for_category(x: str) -> str:
    s = f"trim(lower({x}))"
    for _ in range(2):  # the second time for sizes side by side
        s = rf"regexp_replace({s}, '(^|[^\p{{L}}\p{{N}}_])\d+[.,]?\d*\s*(мл|л|г|гр|кг|шт|уп|пак|рул|ml|l|g|kg|pcs)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"
    return rf"trim(regexp_replace(regexp_replace({s}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


_LABELLED = """sp as (select i, min(s) s from (select name_id i, trim(item_name) s from name_matches union all select canonical_id, trim(canonical_name) from name_matches)
 where i is not null and s is not null group by i),
lp as (select distinct coalesce(trim(item_name), x.s) a, coalesce(trim(canonical_name), y.s) b, lower(trim(verdict)) label from name_matches left join sp x on x.i = name_id left join sp y on y.i = canonical_id
 where coalesce(trim(item_name), x.s) is not null and coalesce(trim(canonical_name), y.s) is not null and lower(trim(verdict)) in ('match', 'non-match'))"""

_STOP = "'средство','средства','для','и','в','на','с','по','от','уход','за','а','не','при','из'"


def _classify(text: str, clusters, base: float, slope: float, source: bool) -> str:
    """One target per product by lists of substrings; the same rules, evaluated as joins over small value tables."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    subs = ", ".join(f"({q(c)}, {q(s)})" for c, ss in clusters.items() for s in ss)
    goals = cat.targets()
    tg = ", ".join(f"({k}, {q(t.name)}, {q(t.norm)}, [{', '.join(map(q, t.tokens))}]::varchar[], [{', '.join(map(q, t.clusters))}]::varchar[])" for k, t in enumerate(goals))
    verbatim = "v as (select id, arg_min(name, k) name from n join tg on contains(n.t, tg.norm) group by id)," if source else "v as (select null::bigint id, null name where false),"
    accept = f"w.s >= 0.2 then round(least(0.55 + 0.40 * w.s, 0.93), 2)" if source else "not n.anyc and w.s > 0 then 0.30"
    named = "w.s >= 0.2 then w.name" if source else "not n.anyc and w.s > 0 then w.name"
    empty = ("null", "null") if source else ("''", "0.0")
    length = lambda l: f"coalesce(list_sum(list_transform({l}, lambda t: length(t))), 0)"
    return f"""with subs(c, s) as (values {subs}), tg(k, name, norm, toks, cl) as (values {tg}),
n0 as (select listing_id id, {text} t from listings),
m as (select id, list(distinct c) cs from n0 join subs on contains(t, s) group by id),
n as (select n0.id, t, coalesce(cs, []) cs, cs is not null anyc, list_distinct(list_filter(string_split(t, ' '), lambda x: length(x) >= 3 and not list_contains([{_STOP}], x))) toks from n0 left join m using (id)),
{verbatim}
o0 as (select id, k, name, len(list_intersect(cs, cl))::double / greatest(len(cs), len(cl)) s from n join tg on len(list_intersect(cs, cl)) > 0),
o as (select id, arg_max(name, (s, -k)) name, max(s) s from o0 group by id),
w0 as (select id, k, name, {length('list_intersect(n.toks, tg.toks)')}::double / {length('list_distinct(list_concat(n.toks, tg.toks))')} s from n join tg on len(list_intersect(n.toks, tg.toks)) > 0),
w as (select id, arg_max(name, (s, -k)) name, max(s) s from w0 group by id)
select n.id listing_id, case when v.name is not null then v.name when o.name is not null then o.name when {named} else {empty[0]} end target,
 case when v.name is not null then 0.95::double when o.name is not null then round(least({base} + {slope} * o.s, 0.93) - 1e-9, 2) when {accept} else {empty[1]} end::double conf
from n left join v using (id) left join o using (id) left join w using (id)"""


def _tfidf(names: str) -> str:
    """Weights of the 2- to 4-grams within words of the normalised names of a select of different ``t``."""
    grams = " || ".join(f"list_transform(range(1, greatest(length(w) + 2 - {n} + 2, 1)), lambda i: substr(' ' || w || ' ', i, {n}))" for n in (2, 3, 4))
    return f"""names as (select t, {_normal("t")} z from ({names}) where t is not null),
grams as (select t, unnest(list_concat({grams.replace(" || list_transform", ", list_transform")})) gram from (select t, unnest(list_filter(string_split_regex(lower(z), '\\s+'), lambda w: w <> '')) w from names)),
tf as (select t, gram, count(*) tf from grams group by all), dfs as (select gram, count(distinct t) df from grams group by 1),
w as (select t, gram, tf * (ln((1 + (select count(*) from names))::double / (1 + df)) + 1) w from tf join dfs using (gram)),
v as (select t, gram, w / sqrt(sum(w * w) over (partition by t)) w from w)"""


_SCORED = """dots as (select a, b, sum(x.w * y.w) dot from (select distinct a, b from lp) join v x on x.t = a join v y on y.t = b and y.gram = x.gram group by all),
scored as (select lp.*, coalesce(dot, 0.0) score from lp left join dots using (a, b))"""


def _signature(x: str, pattern: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({x}), '{pattern}', 1)))"


def _conflict(concepts) -> str:
    listed = ", ".join(f"'{w}': '{c}'" for w, c in words_of(concepts).items())
    of = lambda x: f"list_filter(list_transform(regexp_split_to_array(translate(lower({x}), 'ё', 'е'), '[^a-zа-я0-9]+'), lambda t: map {{{listed}}}[t]), lambda c: c is not null)"
    return f"(len({of('s.a')}) > 0 and len({of('s.b')}) > 0 and not list_has_any({of('s.a')}, {of('s.b')}))"


_CATS = "array_to_string(list_filter([category_0, category_1, category_2, category_3, category_4], lambda c: c is not null), ' ')"

ORACLE = {
    "sales_filtered": _sales_sql('select region, "year", sum(sales_rub)::double revenue from sales_view where region in (\'ASIA\', \'EUROPE\') and "year" in (1996, 1997) group by all'),
    "filter_options": _sales_sql("select distinct trim(brand) \"value\" from sales_view where brand is not null and trim(brand) <> '' and lower(trim(brand)) <> 'nan'"),
    "kpi": _sales_sql("select sum(sales_rub)::double revenue, count(distinct item_name) items, sum(sales_rub)::double / count(distinct item_name) revenue_per_item, count(distinct store_name) stores, (sum(sales_rub) - sum(cost_rub))::double / sum(sales_rub)::double * 100 gross_margin_pct from sales_view"),
    "category_share": _sales_sql("select category_1, sum(sales_rub)::double revenue, sum(sales_rub)::double / (select sum(sales_rub)::double from sales_view) * 100 share_pct from sales_view group by 1"),
    "category_coverage": _sales_sql("select count(*) n_rows, count(*) filter (trim(category_2) <> '') n_with, count(*) filter (trim(category_2) <> '')::double / count(*) * 100 coverage_pct from sales_view"),
    "region_sales": _sales_sql("select region, sum(sales_rub)::double revenue from sales_view group by 1"),
    "category_region_heatmap": _sales_sql("select category_1, region, sum(sales_rub)::double revenue from sales_view group by all"),
    "period_category": _sales_sql("select period, category_1, sum(sales_rub)::double revenue from sales_view group by all"),
    "period_series": _sales_sql("select period, sum(sales_rub)::double revenue, sum(qty_sold)::double qty from sales_view group by 1"),
    "store_ranking": _sales_sql("select store_name, round(sum(sales_rub), 0)::double revenue, count(distinct item_name) items from sales_view group by 1 order by sum(sales_rub) desc, 1 limit 50"),
    **{f"{n}_summary": _sales_sql(f"select {c}, sum(sales_rub)::double revenue, sum(qty_sold)::double qty, sum(cost_rub)::double cost, (sum(sales_rub) - sum(cost_rub))::double profit from sales_view group by 1") for n, c in (("category", "category_1"), ("brand", "brand"))},
    "abc_class": _sales_sql(", s as (select item_name, sum(sales_rub) r from sales_view group by 1 having r > 0), c as (select item_name, r::double revenue, (sum(r) over (order by r desc, item_name))::double / (sum(r) over ())::double cum_share from s) select *, case when cum_share <= 0.8 then 'A' when cum_share <= 0.95 then 'B' else 'C' end abc from c"),
    "abc_summary": _sales_sql(", s as (select item_name, sum(sales_rub) r from sales_view group by 1 having r > 0), c as (select r, (sum(r) over (order by r desc, item_name))::double / (sum(r) over ())::double x from s), d as (select r, case when x <= 0.8 then 'A' when x <= 0.95 then 'B' else 'C' end abc from c) select abc, count(*) n, sum(r)::double total, round(sum(r)::double / (select sum(r)::double from d) * 100, 1) share_pct from d group by 1"),
    "xyz_class": _sales_sql(", g as (select brand, period, coalesce(sum(sales_rub), 0)::double v from (select distinct brand from sales_view) b cross join (select distinct period from sales_view) p left join sales_view using (brand, period) group by all), c as (select brand, round(stddev_samp(v) / avg(v), 6) cv from g group by 1) select brand, cv, case when cv <= 0.1 then 'X' when cv <= 0.25 then 'Y' else 'Z' end xyz from c"),
    "abc_xyz_matrix": _sales_sql(", s as (select brand, sum(sales_rub) r from sales_view group by 1 having r > 0), c as (select brand, (sum(r) over (order by r desc, brand))::double / (sum(r) over ())::double x from s), g as (select brand, period, coalesce(sum(sales_rub), 0)::double v from (select distinct brand from sales_view) b cross join (select distinct period from sales_view) p left join sales_view using (brand, period) group by all), z as (select brand, round(stddev_samp(v) / avg(v), 6) cv from g group by 1), k as (select case when x <= 0.8 then 'A' when x <= 0.95 then 'B' else 'C' end abc, case when cv <= 0.1 then 'X' when cv <= 0.25 then 'Y' else 'Z' end xyz from c join z using (brand)) select abc, count(*) filter (xyz = 'X') x, count(*) filter (xyz = 'Y') y, count(*) filter (xyz = 'Z') z from k group by 1"),
    "pareto_top40": _sales_sql(", s as (select item_name, sum(sales_rub) r from sales_view group by 1) select (row_number() over w)::int \"rank\", substr(item_name, 1, 30) label, r::double revenue, (sum(r) over w)::double / (select sum(r)::double from s) * 100 cum_pct from s window w as (order by r desc, item_name rows unbounded preceding) order by 1 limit 40"),
    "top_brands": _sales_sql("select substr(brand, 1, 42) label, brand, sum(sales_rub)::double revenue from sales_view group by brand order by sum(sales_rub) desc, brand limit 15"),
    "top_items": _sales_sql("select substr(item_name, 1, 42) label, item_name, sum(sales_rub)::double revenue from sales_view group by item_name order by sum(sales_rub) desc, item_name limit 15"),
    "period_compare": _sales_sql(", s as (select category_1, coalesce(sum(sales_rub) filter (period = '1996-01'), 0) a, coalesce(sum(sales_rub) filter (period = '1997-01'), 0) b from sales_view where period in ('1996-01', '1997-01') group by 1) select category_1, a::double period_a, b::double period_b, (b - a)::double delta, case when a <> 0 then (b - a)::double / a::double * 100 end delta_pct from s"),
    "top_movers": _sales_sql(', e as (select min("year") p1, max("year") p2 from sales_view), s as (select brand, coalesce(sum(sales_rub) filter ("year" = p1), 0) a, coalesce(sum(sales_rub) filter ("year" = p2), 0) b from sales_view, e where "year" in (p1, p2) group by 1), r as (select *, row_number() over (order by b - a desc, brand) u, row_number() over (order by b - a, brand) d from s) select brand, a::double period_a, b::double period_b, (b - a)::double delta, case when a <> 0 then (b - a)::double / a::double * 100 end delta_pct from r where u <= 10 or d <= 10'),
    "low_margin": _sales_sql(", s as (select item_name, sum(sales_rub)::double revenue, sum(cost_rub)::double cost, (sum(sales_rub) - sum(cost_rub))::double / nullif(sum(sales_rub)::double, 0) * 100 margin_pct from sales_view group by 1) select * from s where margin_pct < 50 order by margin_pct, item_name limit 100"),
    "zscore_anomalies": _sales_sql(", g as (select brand, period, coalesce(sum(sales_rub), 0)::double v from (select distinct brand from sales_view) b cross join (select distinct period from sales_view) p left join sales_view using (brand, period) group by all), e as (select max(period) last from g), c as (select brand, avg(v) filter (period < last) mean, stddev_samp(v) filter (period < last) std, sum(v) filter (period = last) last_value from g, e group by 1) select brand, round(mean, 4) mean, round(std, 4) std, round(last_value, 4) last_value, round((last_value - mean) / std, 6) z from c where std > 1e-9 and abs(round((last_value - mean) / std, 6)) >= 2"),
    "forecast_linear": _sales_sql(", s as (select period, sum(sales_rub)::double y from sales_view group by 1), t as (select *, row_number() over (order by period) - 1 x from s), l as (select regr_slope(y, x) k, regr_intercept(y, x) b, count(*) n from t) select period, round(y, 2) \"value\", 'fact' kind from t union all select '+' || h, round(greatest(0, b + k * (n - 1 + h)), 2), 'forecast' from l, generate_series(1, 3) g(h)"),
    "source_row_counts": _sales_sql("select source_file, count(*) \"count\" from sales_view group by 1"),
    "merge_union": _sales_sql('select region, category_1, "year", count(*) n, sum(sales_rub)::double sales_rub from sales_view group by all'),
    "merge_aggregate": _sales_sql('select "year", region, category_1, brand, sum(qty_sold)::double qty_sold, sum(sales_rub)::double sales_rub, sum(cost_rub)::double cost_rub from sales_view group by all'),
    "name_norm": f"select listing_id, {_normal('item_name')} normal, {_latin('lower(item_name)')} latin from listings",
    "category_norm": f"select listing_id, {_for_category('item_name')} for_category from listings",
    "volume_key": f"select listing_id, {_volume('item_name')} volume from listings",
    "number_functions": "select listing_id, try_cast(trim(replace(weight, ',', '.')) as double) number, ('0x' || substr(md5(item_name), 1, 8))::bigint seed, round_even(listing_id / 7 * 1.117 * 100, 0) / 100 price from listings",
    "block_candidates": f"with n as (select distinct trim(item_name) nm from listings where item_name is not null and trim(item_name) <> '' and lower(trim(item_name)) <> 'nan'), b as (select nm, string_split({_normal('nm')}, ' ')[1] || '|' || {_volume('nm')} block from n) select block, count(*) n_names from b group by 1 having count(*) >= 2",
    "jaccard_pairs": f"with {_LABELLED}, t as (select a, b, {_tokens(_normal('a'))} x, {_tokens(_normal('b'))} y from lp) select a, b, case when len(x) > 0 and len(y) > 0 then len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) else 0 end score from t",
    "canonical_names": f"""with recursive n as (select trim(item_name) nm, count(*) f, min(listing_id) o from listings where item_name is not null and trim(item_name) <> '' and lower(trim(item_name)) <> 'nan' group by 1),
b as (select nm, f, o, {_normal('nm')} z, {_volume('nm')} vol from n), c as (select *, string_split(z, ' ')[1] || '|' || vol block, {_tokens('z')} t from b where z <> ''),
e as (select x.nm p, y.nm q from c x join c y on x.block = y.block and len(list_intersect(x.t, y.t)) >= 0.9 * len(list_distinct(list_concat(x.t, y.t)))),
r(p, q) as (select p, q from e union select r.p, e.q from r join e on r.q = e.p),
g as (select p, min(q) grp from r group by p), h as (select g.p nm, grp, f, o from g join c on c.nm = g.p), k as (select grp, arg_max(nm, (f, length(nm), -o)) canonical_name from h group by grp)
select nm "name", canonical_name from h join k using (grp) where nm <> canonical_name""",
    "classify_src": _classify(_for_category(_CATS), SOURCE_PHRASES, 0.60, 0.35, True),
    "classify_name": _classify(_for_category("item_name"), PRODUCT_CLUSTERS, 0.50, 0.45, False),
    "suggest_categories": "with f as (select source_file, case when count(nullif(trim(category_0), '')) > 0 then 0 when count(nullif(trim(category_1), '')) > 0 then 1 when count(nullif(trim(category_2), '')) > 0 then 2 when count(nullif(trim(category_3), '')) > 0 then 3 else 4 end k from listings group by 1) select distinct trim(c) category from (select case k when 0 then category_0 when 1 then category_1 when 2 then category_2 when 3 then category_3 else category_4 end c from listings join f using (source_file)) where c is not null and trim(c) <> ''",
    "corpus_unique": "select trim(item_name) \"name\", trim(coalesce(brand, '')) brand, arg_max(array_to_string(list_filter([trim(category_0), trim(category_1), trim(category_2), trim(category_3), trim(category_4)], lambda c: c is not null and c <> '' and lower(c) <> 'nan'), ' / '), listing_id) source_category from listings where item_name is not null and trim(item_name) <> '' group by 1, 2",
    "doc_freq": f"select t token, count(*) df from (select unnest({_tokens(_normal('item_name'))}) t from listings) group by 1",
    "new_keys_anti": "with k as (select listing_id, item_name \"name\", brand, lower(trim(coalesce(item_name, ''))) || '|||' || lower(trim(coalesce(brand, ''))) key from listings) select listing_id, \"name\", brand from k where key not in (select key from k where listing_id % 4 = 0) and key not in (select key from k where listing_id % 5 = 0)",
    "override_precedence": "with k as (select listing_id, item_name \"name\", brand, lower(trim(coalesce(item_name, ''))) || '|||' || lower(trim(coalesce(brand, ''))) key from listings) select listing_id, \"name\", brand, case when key in (select key from k where listing_id % 3 = 0) then 'ручная' when key in (select key from k where listing_id % 2 = 0) then 'из кэша' else '' end target_category, case when key in (select key from k where listing_id % 3 = 0) then 1.0 when key in (select key from k where listing_id % 2 = 0) then 0.5 else 0.0 end::double category_confidence from k",
    "token_alerts": f"with {_LABELLED}, t as (select label, {_tokens(_normal('a'))} x, {_tokens(_normal('b'))} y from lp), d as (select unnest(list_distinct(list_concat(list_filter(x, lambda i: not list_contains(y, i)), list_filter(y, lambda i: not list_contains(x, i))))) token from t where label = 'non-match') select token, count(*) n from d where length(token) >= 3 and token not in (select unnest(x) from t where label = 'match') group by 1 having count(*) > 2",
    "confusion_sweep": f"""with {_LABELLED}, {_tfidf("select a t from lp union select b from lp")},
{_SCORED}
select h::double / 100 threshold, count(*) filter (p and y) tp, count(*) filter (p and not y) fp, count(*) filter (not p and y) fn, count(*) filter (not p and not y) tn,
 coalesce(tp::double / nullif(tp + fp, 0), 0) "precision", coalesce(tp::double / nullif(tp + fn, 0), 0) recall, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) f1
from (select h, label = 'match' y, score >= h::double / 100 p from scored, generate_series(70, 92, 2) g(h)) group by h""",
    "gated_pairs": f"""with {_LABELLED}, {_tfidf("select a t from lp union select b from lp union select trim(item_name) from listings where item_name is not null and trim(item_name) <> '' and lower(trim(item_name)) <> 'nan'")},
{_SCORED},
tok as (select token, count(*) df from (select t, unnest({_tokens("z")}) token from names) group by 1),
d as (select a, b, {_tokens(_normal("a"))} x, {_tokens(_normal("b"))} y from (select distinct a, b from lp)),
diff as (select a, b, unnest(list_distinct(list_concat(list_filter(x, lambda i: not list_contains(y, i)), list_filter(y, lambda i: not list_contains(x, i))))) token from d),
rare as (select a, b, min(df) rarest from diff join tok using (token) group by all),
g as (select s.*, case when {_volume("s.a")} <> {_volume("s.b")} then 'size' {" ".join(f"when {_signature('s.a', p)} <> {_signature('s.b', p)} then '{k}'" for k, p in ev.SIGNATURES.items())}
 when {_conflict(ev.TYPES)} then 'type' when {_conflict(ev.VARIANTS)} then 'variant' when score < 0.86 then 'score' when {_signature('s.a', '([0-9]+)')} <> {_signature('s.b', '([0-9]+)')} then 'numbers'
 when rarest <= {ev.RARE_DF} then 'rare' else 'none' end reason from scored s left join rare r on r.a = s.a and r.b = s.b)
select label, case when reason = 'none' then 'match' when reason in ('numbers', 'rare') then 'review' else 'non-match' end prediction, reason, count(*) "count" from g group by all""",
    "command_filter": "select event_id from events where event_type = 'purchase'",
    "event_windows": "select date_trunc('day', ts) \"start\", event_type, count(*) n, sum(value::decimal(20,6))::double total from events group by all",
}



def _word(key: str, salt: str) -> str:
    """The made-up word of a key; operands as in Spark."""
    seed, out, n = f"('0x' || substr(md5({key} || '{salt}'), 1, 8))::bigint", [], len(an.CONSONANTS) * len(an.VOWELS)
    for k in range(an.SYLLABLES):
        out.append(f"substr('{an.CONSONANTS}', ({seed} // {n**k} // {len(an.VOWELS)} % {len(an.CONSONANTS)} + 1)::int, 1)")
        out.append(f"substr('{an.VOWELS}', ({seed} // {n**k} % {len(an.VOWELS)} + 1)::int, 1)")
    return "(" + " || ".join(out) + ")"


def _initcap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def _pseudonyms(column: str, base: str, between: str) -> str:
    return (
        f"(select key, base || case when i > 0 then '{between}' || i else '' end pseudonym from (select *, row_number() over (partition by base order by key) - 1 i "
        f"from (select key, {base} base from (select distinct trim({column}::varchar) key from sales_view))))"
    )


_PSEUDONYMS = {
    "brand": _pseudonyms("brand", _word("key", "b"), ""),
    "store": _pseudonyms("store_code", f"'Магазин ' || {_initcap(_word('key', 'n'))}", " "),
    "company": _pseudonyms("supplier", f"'Фирма ' || {_initcap(_word('key', 'c'))}", " "),
}
_APPLIED = f"""with src as ({ORACLE["classify_src"]}), nam as ({ORACLE["classify_name"]}),
k as (select listing_id id, item_name nm, lower(trim(coalesce(item_name, ''))) || '|||' || lower(trim(coalesce(brand, ''))) key from listings),
t as (select k.*, coalesce(src.target, nam.target) target, case when src.target is not null then src.conf else nam.conf end conf from k join src on src.listing_id = id join nam on nam.listing_id = id),
c as (select key, arg_min(struct_pack(t := target, c := conf), (target = '', id, nm)) x from t where nm is not null and trim(nm) <> '' and lower(trim(nm)) <> 'nan' group by key)
select id listing_id, coalesce(x.t, '') target_category, coalesce(x.c, 0.0)::double category_confidence from k left join c using (key)"""
ORACLE["apply_categories"] = _APPLIED
ORACLE["low_confidence_queue"] = f"select * from ({_APPLIED}) where category_confidence < 0.70"
ORACLE |= {f"anonymize_{name}": _sales_sql(f"select key, pseudonym from {q}") for name, q in _PSEUDONYMS.items()}
_SEED = "('0x' || substr(md5({}), 1, 8))::bigint"
ORACLE["anonymize_measures"] = _sales_sql(
    f"""select region, b.pseudonym brand, s.pseudonym store_name, c.pseudonym supplier,
 'г. ' || {_initcap(_word('store_code::varchar', 't'))} || ', ул. ' || {_initcap(_word('store_code::varchar', 'a'))} || ', д. ' || ({_SEED.format('store_code::varchar')} % 99 + 1) address, count(*) n,
 round(sum(round_even(sales_rub::double * 1.117 * 100, 0) / 100), 2) sales_rub, sum(qty_sold::double + 2) qty_sold,
 min(b.pseudonym || ' ' || category_1 || ' ' || {_initcap(_word('item_name', 'v'))} || ' ' || (({_SEED.format("item_name || 'p'")} % 40 + 1) * 50) || ' мл') first_item
 from sales_view join {_PSEUDONYMS['brand']} b on b.key = trim(brand) join {_PSEUDONYMS['store']} s on s.key = store_code::varchar join {_PSEUDONYMS['company']} c on c.key = trim(supplier) group by all"""
)
