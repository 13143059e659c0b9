"""Address records that denote the same building."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.addresses import Address, parse, townish_words
from tallyloom.llm.groups import connected_groups
from tallyloom.llm.linkage import level, missing, near, near_words, with_probability
from tallyloom.session import cut

PARTS = list(Address._fields)
COMPARED = ["postcode_level", "town_level", "region_level", "name_level", "kind_level", "ordinal_level"]
#: How many times as frequent as a spelling another one must be to replace it.
FREQUENT = 5
#: Probability from which a pair is a link.
LEAST_PROBABILITY = 0.5


def _parse(address: pd.Series, name: pd.Series) -> pd.DataFrame:
    text = lambda x: x if isinstance(x, str) else None
    rows = [(*(parse(text(a)) or Address()), townish_words(text(n))) for a, n in zip(address, name)]
    return pd.DataFrame(rows, columns=[*PARTS, "named"]).astype(object)


def parsed(stores: DataFrame) -> DataFrame:
    """(store_code, parts, named) of the records with a usable address; the region is the address's own, else the record's; ``named`` are the words of
    the store's name that look like towns."""
    schema = ", ".join(f"{p} string" for p in PARTS) + ", named array<string>"
    rows = stores.select("store_code", "region", F.pandas_udf(_parse, schema)("address", "store_name").alias("a")).filter("a.house is not null")
    named = F.lower(F.trim("region"))
    own = F.concat_ws(" ", F.regexp_replace(F.regexp_extract(F.translate(named, "ё", "е"), r"^([а-я]+)", 1), "(?:ая|яя|ой|ый|ий|ое|ее)$", ""), F.when(named.contains("край"), "край").otherwise("обл"))
    parts = [F.col(f"a.{p}").alias(p) for p in PARTS if p != "region"]
    return rows.select("store_code", *parts, F.coalesce("a.region", F.when(named.isNotNull(), own)).alias("region"), "a.named")


def with_named_town(records: DataFrame) -> DataFrame:
    """``records`` without ``named``: where an address has no town, the last word of the store's name that is a town.

    Towns and names of chains look alike; a word is taken for a town if the stores that have it in their names stand in that town at least as often
    as in others, of those whose address states one. A word that no such store has is a town if some address states it. The words are
    counted over all records, with map-side combine.
    """
    words = records.filter("town is not null").select("town", F.explode(F.array_distinct("named")).alias("w"))
    seen = words.groupBy("w").agg(F.count_if(F.col("w") == F.col("town")).alias("there"), F.count("*").alias("all"))
    towns = records.filter("town is not null").select(F.col("town").alias("w")).distinct().withColumn("stated", F.lit(True))
    is_town = towns.join(seen, "w", "full").filter(F.coalesce(F.col("there") * 2 >= F.col("all"), F.lit(True))).select("w")
    bare = records.filter("town is null").select("store_code", F.posexplode("named").alias("k", "w")).join(is_town, "w")
    last = bare.groupBy("store_code").agg(F.max_by("w", "k").alias("by_name"))
    j = records.join(last, "store_code", "left")
    return j.withColumn("town", F.coalesce("town", "by_name")).drop("named", "by_name")


def sound(name: str) -> F.Column:
    """A street's name by sound: consonants with voiced and unvoiced ones together, doubles once, the ending aside."""
    c = F.regexp_replace(F.col(name), "(?:ая|яя|ой|ый|ий|ое|ее)$", "")
    c = F.translate(c, "бвгдзжщчйаеиоуыэюяьъ", "пфктсшшш")
    return F.regexp_replace(c, r"(.)\1+", "$1")


def corrected(addresses: DataFrame, column: str) -> DataFrame:
    """``addresses`` with rare spellings in a column replaced by the frequent one (FREQUENT times as many records) that is a slip away.

    Works on the different words.
    """
    words = addresses.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("w")).agg(F.sum("n").alias("n"))
    slips = near_words(words).filter(F.col("other_n") >= F.col("n") * FREQUENT).select("w", F.col("other").alias("good"), F.col("other_n").alias("good_n"))
    best = slips.groupBy("w").agg(F.max_by("good", F.struct("good_n", "good")).alias("good"))
    j = addresses.join(best, F.col(column) == F.col("w"), "left")
    return j.withColumn(column, F.coalesce("good", column)).drop("w", "good")


def with_town_of_postcode(addresses: DataFrame) -> DataFrame:
    """``addresses`` with the town that most records of a postcode have, where the address has none or one a slip away."""
    seen = addresses.filter("postcode is not null and town is not null").groupBy("postcode", F.col("town").alias("t")).agg(F.sum("n").alias("k"))
    usual = seen.groupBy("postcode").agg(F.max_by("t", F.struct("k", "t")).alias("usual"))
    j = addresses.join(usual, "postcode", "left")
    town = F.when(F.col("usual").isNotNull() & (F.col("town").isNull() | near(F.col("town"), F.col("usual"))), F.col("usual")).otherwise(F.col("town"))
    return j.withColumn("town", town).drop("usual")


def candidates(addresses: DataFrame) -> DataFrame:
    """(a, b): pairs of different addresses that share a block: street, house and unit, together with the postcode, the beginning or the end of the
    town's name, or the region.

    Streets are the same by sound, or by their letters a slip away: every address stands in the blocks of its own street and looks into those of
    the streets near it, so a town's many first houses do not meet.
    """
    here = lambda street: F.concat_ws("|", street, F.col("house"), F.coalesce("unit", F.lit("")))

    def keys(street: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(F.col("postcode").isNotNull(), F.concat_ws("|", F.lit("p"), "postcode", here(street))),
                F.when(F.col("town").isNotNull(), F.concat_ws("|", F.lit("b"), F.substring("town", 1, 3), here(street))),
                F.when(F.col("town").isNotNull(), F.concat_ws("|", F.lit("e"), F.reverse(F.substring(F.reverse("town"), 1, 5)), here(street))),
                F.when(F.col("region").isNotNull(), F.concat_ws("|", F.lit("s"), "region", here(street))),
            )
        )

    rows = addresses.withColumn("sound", sound("name"))
    names = rows.groupBy(F.col("name").alias("w")).agg(F.first("sound").alias("n"))
    # streets a slip away whose sounds differ
    slips = near_words(names).filter(F.col("n") != F.col("other_n")).select(F.col("w").alias("name"), F.col("other_n").alias("near_sound"))
    blocks = rows.select("id", F.explode(keys(F.col("sound"))).alias("key"))
    looks = rows.join(slips, "name").select(F.col("id").alias("a"), F.explode(keys(F.col("near_sound"))).alias("key"))
    looks = blocks.withColumnRenamed("id", "a").unionByName(looks)
    met = looks.join(blocks.withColumnRenamed("id", "b"), "key").filter("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compared(addresses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with a level of agreement for each part."""
    sides = [addresses.select(*(F.col(c).alias(f"{c}_{s}") for c in ["id", *PARTS])) for s in "ab"]
    j = pairs.join(sides[0], F.col("a") == F.col("id_a")).join(sides[1], F.col("b") == F.col("id_b"))
    x = lambda p: (F.col(f"{p}_a"), F.col(f"{p}_b"))
    same = lambda p: x(p)[0] == x(p)[1]
    gender_clash = F.coalesce(F.col("gender_a") != F.col("gender_b"), F.lit(False))
    return j.select(
        "a",
        "b",
        level(("same", same("postcode")), ("missing", missing(*x("postcode")))).alias("postcode_level"),
        level(("same", same("town")), ("missing", missing(*x("town"))), ("near", near(*x("town")))).alias("town_level"),
        level(("same", same("region")), ("missing", missing(*x("region")))).alias("region_level"),
        level(("same", same("name")), ("near", near(*x("name")))).alias("name_level"),
        level(("same", same("kind")), ("differ", gender_clash), ("missing", missing(*x("kind")))).alias("kind_level"),
        level(("same", x("ordinal")[0].eqNullSafe(x("ordinal")[1]))).alias("ordinal_level"),
    )


def same_building(stores: DataFrame) -> DataFrame:
    """(store_code, building): records of one building share the number, the smallest store_code among them.

    Records without a usable address (null, empty, a placeholder, no house number) are left out. Equal addresses are one vertex from the
    start, so neither a building with very many records nor a repeated row makes pairs. A link needs a probability of LEAST_PROBABILITY and
    agreement (a slip aside) of street, number and place; an address without town and postcode joins the only building that fits it.
    """
    records = cut(with_named_town(cut(parsed(stores))))
    addresses = cut(records.groupBy(*PARTS).agg(F.min("store_code").alias("id"), F.count("*").alias("n")))
    stated = addresses.select("id", *(F.col(p).alias(f"stated_{p}") for p in PARTS))
    addresses = cut(with_town_of_postcode(corrected(corrected(addresses, "town"), "name")))
    pairs = cut(compared(addresses, candidates(addresses)))
    alike = lambda p: F.when(F.col(p).isNull(), "missing").otherwise("same").alias(f"{p}_level")
    equal = addresses.filter("n > 1").select(
        *(alike(p) for p in ("postcode", "town", "region", "name", "kind")), F.lit("same").alias("ordinal_level"), F.expr("n * (n - 1) / 2").alias("count")
    )
    scored = with_probability(pairs, COMPARED, ("same", "near"), equal=equal)
    street = F.col("name_level").isin("same", "near") & (F.col("kind_level") != "differ") & (F.col("ordinal_level") == "same")
    place = ((F.col("postcode_level") == "same") & (F.col("town_level") != "differ")) | (F.col("town_level").isin("same", "near") & (F.col("postcode_level") != "differ"))
    links = scored.filter(street & (F.col("probability") >= LEAST_PROBABILITY))
    strong = connected_groups(links.filter(place), "a", "b")
    known = addresses.join(strong, "id", "left").select("id", F.coalesce("group_id", "id").alias("building"))
    # addresses that name no place: the one building that their links lead to
    bare = addresses.filter("town is null and postcode is null").select("id")
    weak = links.filter((F.col("town_level") == "missing") & (F.col("region_level") == "same"))
    ends = weak.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(weak.select(F.col("b").alias("id"), F.col("a").alias("other")))
    ends = ends.join(bare, "id", "left_semi").join(bare.withColumnRenamed("id", "other"), "other", "left_anti")
    led = ends.join(known.select(F.col("id").alias("other"), "building"), "other").groupBy("id").agg(
        F.min("building").alias("low"), F.max("building").alias("high")
    )
    led = led.filter("low = high").select("id", F.col("low").alias("led_to"))
    final = stated.join(known, "id").join(led, "id", "left").withColumn("building", F.coalesce("led_to", "building"))
    same = [F.col(f"r.{p}").eqNullSafe(F.col(f"f.stated_{p}")) for p in PARTS]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    out = records.alias("r").join(final.alias("f"), condition).select("r.store_code", "f.building")
    least = out.groupBy("building").agg(F.min("store_code").alias("least"))
    return out.join(least, "building").select("store_code", F.col("least").alias("building"))


def pairs_of(groups: DataFrame, key: str, group: str) -> DataFrame:
    """(<key>_a, <key>_b): the pairs of records of each group, the smaller key first."""
    rows = groups.select(key, group).distinct()
    a, b = (rows.select(F.col(key).alias(f"{key}_{s}"), group) for s in "ab")
    return a.join(b, group).filter(f"{key}_a < {key}_b").select(f"{key}_a", f"{key}_b")
