"""Queries of the sub-package and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.groups import connected_groups, decided_pairs
from tallyloom.llm.encode import encoded
from tallyloom.llm.leaks import leaked_items
from tallyloom.llm.lookalike import canonical, look_alike_pairs
from tallyloom.llm.places import pairs_of, same_building
from tallyloom.llm.products import same_product
from tallyloom.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of store records in the same building."""
    return pairs_of(same_building(table(spark, folder, "stores")), "store_code", "building")


def p3_buildings(spark: SparkSession, folder: str) -> DataFrame:
    """Every store record with a usable address and its building."""
    return same_building(table(spark, folder, "stores"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every name that is tied to another one, with the smallest id of its group."""
    groups = connected_groups(decided_pairs(table(spark, folder, "name_matches")), "a", "b")
    return groups.select(F.col("id").alias("name_id"), "group_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of listings of the same product."""
    return pairs_of(same_product(table(spark, folder, "listings")), "listing_id", "product")


def p7_products(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing with its product."""
    return same_product(table(spark, folder, "listings"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its ids by byte_bpe_50k."""
    return encoded(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item, with the item."""
    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same but differ in characters."""
    return look_alike_pairs(table(spark, folder, "documents"), "doc_id", "text")


def p10_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of look-alike texts and the text that stands for the class."""
    return canonical(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {
    "p3_found": p3_found,
    "p3_buildings": p3_buildings,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_products": p7_products,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_canonical": p10_canonical,
}

ORACLE = {
    "p6_found": """with recursive sp as (select s, min(i) i from (select trim(item_name) s, name_id i from name_matches union all select trim(canonical_name), canonical_id from name_matches)
  where i is not null and s <> '' group by s),
r as (select m.*, coalesce(name_id, x.i) n, coalesce(canonical_id, y.i) c from name_matches m left join sp x on x.s = trim(item_name) left join sp y on y.s = trim(canonical_name)),
p as (select least(n, c) a, greatest(n, c) b, arg_max(coalesce(lower(trim(verdict)), ''), (decided_at, match_id)) v from r where n <> c group by all),
e as (select a, b from p where v = 'match' union select b, a from p where v = 'match'),
t(name_id, other) as (select a, a from e union select t.name_id, e.b from t join e on t.other = e.a)
select name_id, min(other) group_id from t group by name_id""",
}
