"""Text columns: normalised names, transliteration, volume keys, token sets and their likeness. No Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Transliteration of Cyrillic letters.
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
LATIN = [
    "a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "sch", "", "y", "", "e", "yu", "ya",
]
# Units that count things, sizes in a name, what suppliers append to names.
COUNTED = ("шт", "уп", "пак", "рул", "pcs")
VOLUME = r"(?iU)(\d+[.,]?\d*)\s*(мл|л|г|гр|кг|шт|уп|пак|рул|ml|l|g|kg|pcs)\b"
SIZES = r"(?iU)\b\d+[.,]?\d*\s*(мл|л|г|гр|кг|шт|уп|пак|рул|ml|l|g|kg|pcs)\b"
SUPPLIER_SUFFIX = r"(?U)\s*\([^)]+\)\s*:\s*\d[\d/]*\s*$|\s*:\s*\d[\d/]*\s*$"
# Words that tell nothing about a category.
STOP_WORDS = ("средство", "средства", "для", "и", "в", "на", "с", "по", "от", "уход", "за", "а", "не", "при", "из")


def squeeze(c: Column) -> Column:
    """Single spaces, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_blank(c: Column) -> Column:
    """Null, blank, or the text ``nan`` that a missing value left behind."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan")


def transliterate(c: Column) -> Column:
    """Cyrillic to Latin. Letters that give one Latin letter or none go in one pass, the others by replacement before it."""
    single = [(a, b) for a, b in zip(CYRILLIC, LATIN) if len(b) == 1]
    for a, b in zip(CYRILLIC, LATIN):
        if len(b) > 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "".join(a for a, _ in single) + "ъь", "".join(b for _, b in single))


def normal_name(c: Column) -> Column:
    """Name for matching: lower case, no supplier suffix, ``+`` as a word, words with single spaces, Latin letters."""
    c = F.regexp_replace(F.trim(F.lower(c)), SUPPLIER_SUFFIX, "")
    c = F.replace(c, F.lit("+"), F.lit(" plus "))
    return transliterate(squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", " ")))


def volume_key(c: Column) -> Column:
    """All sizes and counts of a name in ml, g and pcs, different ones sorted and joined with +; empty if there are none."""
    numbers, units = (F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(VOLUME), F.lit(k)) for k in (1, 2))

    def one(n: Column, u: Column) -> Column:
        v, u = F.regexp_replace(n, ",", ".").cast("double"), F.lower(u)
        whole = lambda x: F.bround(x).cast("long").cast("string")
        return (
            F.when(u.isin("л", "l"), F.concat(whole(v * 1000), F.lit("ml")))
            .when(u.isin("мл", "ml"), F.concat(whole(v), F.lit("ml")))
            .when(u.isin("кг", "kg"), F.concat(whole(v * 1000), F.lit("g")))
            .when(u.isin("г", "гр", "g"), F.concat(whole(v), F.lit("g")))
            .otherwise(F.concat(whole(v), F.lit("pcs")))
        )

    return F.array_join(F.sort_array(F.array_distinct(F.zip_with(numbers, units, one))), "+")


def token_set(normal: Column) -> Column:
    """The different words of a normalised name."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if either side is empty or null."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(0.0)


def letters(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, t: s + F.length(t))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Share of common elements by their length; 0 if either side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), letters(F.array_intersect(a, b)) / letters(F.array_union(a, b))).otherwise(0.0)


def normal_category(c: Column) -> Column:
    """Text for categorising: lower case, without sizes and punctuation."""
    c = F.regexp_replace(F.trim(F.lower(c)), SIZES, " ")
    return squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def category_tokens(normal: Column) -> Column:
    """Words of three letters or more that are no stop-words."""
    return F.filter(token_set(normal), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def composite_key(name: Column, brand: Column) -> Column:
    """Lower-case name and brand joined by three pipes."""
    return F.concat_ws("|||", F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.trim(F.coalesce(brand, F.lit("")))))


def to_number(c: Column) -> Column:
    """A number, or null where the text is none (a trailing d or f included)."""
    text = F.trim(c.cast("string"))
    return F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))


def code_text(df: DataFrame, column: str) -> Column:
    """A code as text, outer spaces aside: a number without fraction is written without one, whether it came as a number or as text."""
    text = F.trim(F.col(column).cast("string"))
    if dict(df.dtypes)[column] in ("double", "float"):
        text = F.when(F.col(column) == F.floor(F.col(column)), F.col(column).cast("decimal(38,0)").cast("string")).otherwise(text)
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def key_seed(c: Column) -> Column:
    """A whole number that depends on the key only: the first eight hex digits of its MD5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
