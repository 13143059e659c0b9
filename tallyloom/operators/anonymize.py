"""Pseudonyms for stores, brands, companies and products, and changed measures. The same key has the same pseudonym in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import code_text, key_seed
from tallyloom.sources.schema import FIELDS

#: What prices are multiplied by and what quantities grow by.
PRICE_FACTOR, QTY_SHIFT = 1.117, 2

#: Letters of made-up words: a word is a row of syllables, each a consonant and a vowel chosen by the key's digest.
CONSONANTS, VOWELS = "БВГДЖЗКЛМНПРСТФХ", "АЕИОУ"
#: Syllables of a word by kind: with three there are 512 000 words, so that few keys share one however many there are beside each other.
SYLLABLES = 3


def word(key: Column, salt: str, syllables: int = SYLLABLES) -> Column:
    """A word of so many syllables by the key's seed."""
    seed, out = key_seed(F.concat(key, F.lit(salt))), []
    for k in range(syllables):
        part = F.floor(seed / F.lit((len(CONSONANTS) * len(VOWELS)) ** k)).cast("long")
        for letters, each in ((CONSONANTS, len(VOWELS)), (VOWELS, 1)):
            at = F.pmod(F.floor(part / F.lit(each)).cast("long"), F.lit(len(letters))).cast("int")
            out.append(F.substring(F.lit(letters), at + 1, F.lit(1)))
    return F.concat(*out)


def numbered(df: DataFrame, key: str, base: str, between: str = "", taken: DataFrame | None = None) -> DataFrame:
    """Pseudonyms without repeats: base, base1, base2 and so on in the order of keys, after those that ``taken`` (base, n) holds already.

    The numbers are made per base word, of which there are hundreds of thousands, so no task has more than its share of the keys.
    """
    w = Window.partitionBy(base).orderBy(key)
    at = F.row_number().over(w) - 1
    if taken is not None:
        df = df.join(taken.select(F.col("base").alias(base), F.col("n").alias("_n")), base, "left")
        at = at + F.coalesce("_n", F.lit(0))
    return df.withColumn("pseudonym", F.concat(F.col(base), F.when(at > 0, F.concat(F.lit(between), at.cast("string"))).otherwise("")))


def named(kind: str) -> tuple:
    """How a kind of key is named: the base word, and what stands before its number."""
    words = {"brands": lambda k: word(k, "b"), "stores": lambda k: F.concat(F.lit("Магазин "), F.initcap(word(k, "n"))), "companies": lambda k: F.concat(F.lit("Фирма "), F.initcap(word(k, "c")))}
    return words[kind], "" if kind == "brands" else " "


def pseudonyms(df: DataFrame, column: str, kind: str, known: DataFrame | None = None) -> DataFrame:
    """(key, pseudonym, base) of the keys of a column that ``known`` (same columns) does not hold; the numbering goes on behind the known ones."""
    base, between = named(kind)
    keys = df.select(code_text(df, column).alias("key")).filter("key is not null and key <> ''").distinct()
    taken = None
    if known is not None:
        keys = keys.join(known.select("key"), "key", "left_anti")
        taken = known.groupBy("base").agg(F.count("*").alias("n"))
    return numbered(keys.withColumn("base", base(F.col("key"))), "key", "base", between, taken).select("key", "pseudonym", "base")


def store_key(df: DataFrame) -> str | None:
    """The column that stores are told by: the code, else the name."""
    return next((c for c in ("store_code", "store_name") if c in df.columns), None)


def store_address(key: Column) -> Column:
    """A made-up town, street and house."""
    house = (F.pmod(key_seed(key), F.lit(99)) + 1).cast("string")
    return F.concat_ws(", ", F.concat(F.lit("г. "), F.initcap(word(key, "t"))), F.concat(F.lit("ул. "), F.initcap(word(key, "a"))), F.concat(F.lit("д. "), house))


def product_pseudonym(key: Column, category: Column, brand: Column) -> Column:
    """Brand, category (which is not hidden), a made-up variety and a pack size; products are not numbered, since different ones may look alike."""
    pack = F.concat(((F.pmod(key_seed(F.concat(key, F.lit("p"))), F.lit(40)) + 1) * 50).cast("string"), F.lit(" мл"))
    what = F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("Товар"))
    return F.concat_ws(" ", F.coalesce(brand, F.lit("БРЕНД")), what, F.initcap(word(key, "v")), pack)


def changed_price(c: Column) -> Column:
    """Multiplied and rounded to kopecks, halves to even."""
    return F.rint(c * F.lit(PRICE_FACTOR) * 100) / 100


def anonymized(df: DataFrame, maps: dict[str, DataFrame], fields: dict[str, str] = FIELDS) -> DataFrame:
    """``df`` by the action of each field: kept, dropped, looked up (a key without pseudonym gives null), multiplied or shifted.

    ``canonical_name`` is covered like the product's name. ``maps`` has brands, stores (by ``store_key``) and companies as ``pseudonyms`` makes them.
    """
    out, columns = df, []
    if "canonical_name" in df.columns:
        fields = fields | {"canonical_name": "anon_product"}
    kinds = {"anon_brand": "brands", "anon_store": "stores", "anon_company": "companies"}
    brand, at_store = F.lit(None).cast("string"), store_key(df)
    for c in df.columns:
        kind = kinds.get(fields.get(c, "keep"))
        of = at_store if kind == "stores" else c  # names of stores go by the store's code
        if kind and c != "address" and of:
            m = maps[kind].select(F.col("key").alias(f"_k_{c}"), F.col("pseudonym").alias(f"_p_{c}"))
            out = out.join(m, code_text(df, of) == F.col(f"_k_{c}"), "left")
            brand = F.col(f"_p_{c}") if c == "brand" else brand
    category = F.coalesce(*(F.col(c) for c in df.columns if c.startswith("category_")), F.lit(""))
    for c in df.columns:
        action = fields.get(c, "keep")
        if action == "drop":
            continue
        if c == "address" and action == "anon_store":
            columns.append(store_address(code_text(df, at_store) if at_store else F.col(c)).alias(c))
        elif action in kinds:
            columns.append(F.col(f"_p_{c}").alias(c))
        elif action == "anon_product":
            columns.append(F.when(F.col(c).isNotNull(), product_pseudonym(F.col(c), category, brand)).alias(c))
        elif action == "mul_price":
            columns.append(changed_price(F.col(c).cast("double")).alias(c))
        elif action == "add_qty":
            columns.append((F.col(c).cast("double") + QTY_SHIFT).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
