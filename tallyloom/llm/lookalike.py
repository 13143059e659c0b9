"""Texts that look alike but differ in characters.

``fold`` maps look-alike characters onto one of them inside the JVM. What remains of differences in encoding (combining accents against
composed letters, further ignorable characters) is left to Unicode collation: groups are made under the accent-sensitive collation UNICODE.
Before that, digests of what collation cannot make equal keep most texts from being shuffled at all.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

# Letters of other alphabets and the Latin letters they look like.
LOOK_ALIKES = [
    ("АВЕКМНОРСТУХЅІЈԚԜѴӀ", "ABEKMHOPCTYXSIJQWVI"),
    ("аеорсухѕіјһԁԛԝѵ", "aeopcyxsijhdqwv"),
    ("ЁёЇїЀѐ", "ËëÏïÈè"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj"),
    ("αονρϲ", "aovpc"),
    ("ՕՍՏօոսհցզ", "OUSonuhgq"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓠꓡꓢꓣꓥꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFNLSRΛVHWXYAEIOU"),
    ("ɑɡıʏʀɢʜ", "agıYRGH"),
]


def _by_width_and_font() -> tuple[str, str]:
    """Characters that are another width or another font of one character (Unicode's compatibility mappings of these sorts), and that character."""
    out = {}
    for block in (range(0x2100, 0x2150), range(0xFB20, 0xFB2A), range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800), range(0x1EE00, 0x1EEF0)):
        for c in map(chr, block):
            if unicodedata.decomposition(c).split(" ")[0] in ("<wide>", "<narrow>", "<font>") and len(m := unicodedata.normalize("NFKC", c)) == 1:
                out[c] = m
    out |= {k: v for k, v in zip("ﾞﾟ", "゙゚")}
    return "".join(out), "".join(out.values())


def _several() -> dict[str, str]:
    """Characters written as one that look like several: ligatures and Roman numerals, by their compatibility mappings."""
    out = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0xFB00, 0xFB07), *range(0x2160, 0x2180), 0x01C7, 0x01C8, 0x01C9, 0x01CA, 0x01CB, 0x01CC, 0x0132, 0x0133])}
    return {c: m for c, m in out.items() if m != c} | {"ў": "y\u0306", "Ў": "Y\u0306"}


PLAIN = _by_width_and_font()
SEVERAL = _several()
# Kinds of a space and of a hyphen.
SPACES = "               　⠀"
HYPHENS = "‐‑⁃﹣"
#: Format characters (zero-width, soft hyphen, direction marks), controls but tab and line ends, variation selectors, fillers.
INVISIBLE = r"[\p{Cf}\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{34f}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{fe00}-\x{fe0f}]"


def fold(text: Column) -> Column:
    """``text`` with one character for all that look alike; letters keep case and accents, digits and punctuation stay. Null stays null."""
    c = F.regexp_replace(text, INVISIBLE, "")
    c = F.regexp_replace(c, r"\r\n?|[\u0085\u2028\u2029]", "\n")
    several = c
    for a, b in SEVERAL.items():
        several = F.replace(several, F.lit(a), F.lit(b))
    c = F.when(text.rlike("[" + "".join(SEVERAL) + "]"), several).otherwise(c)
    c = F.translate(c, PLAIN[0] + SPACES + HYPHENS, PLAIN[1] + " " * len(SPACES) + "-" * len(HYPHENS))
    return F.translate(c, "".join(a for a, _ in LOOK_ALIKES), "".join(b for _, b in LOOK_ALIKES))


def trace(folded: Column) -> Column:
    """A digest that is the same for all texts equal under the collation: that of the characters which only equal themselves.

    These are ASCII and the Cyrillic letters without an accent; a letter before combining marks, which may be one with a composed one, is left
    out with them, as is everything else.
    """
    bare = F.when(folded.rlike(r"\p{M}"), F.regexp_replace(folded, r"\P{M}\p{M}+", "")).otherwise(folded)
    return F.xxhash64(F.regexp_replace(bare, r"[^\x20-\x7eа-ик-яА-ИК-Я]+", ""))


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, trace, key): one row per different text that is not null or blank, with its smallest key. Texts are not shuffled."""
    # an explode of one element keeps the optimizer from writing the fold out again wherever it is used
    rows = df.select(F.col(key).alias("key"), F.md5(text).alias("digest"), F.explode(F.array(fold(F.col(text)))).alias("f")).filter(F.col("f").rlike(r"[^ \t\n]"))
    rows = rows.select("key", "digest", trace(F.col("f")).alias("trace"))
    return rows.groupBy("digest").agg(F.min("key").alias("key"), F.first("trace").alias("trace"))


def classes(df: DataFrame, key: str, text: str, texts: DataFrame | None = None) -> DataFrame:
    """(digest, class_id, form, n_texts) of the texts that look like another one; those that look alike share class and form.

    ``class_id`` is the smallest key of the class, ``form`` the text of the class that comes first in code-point order, n_texts the number of
    different texts. Exact copies are brought together by digest first, so a text with a third of all rows costs one row per map task. Only
    texts that share a trace with a different one are read again and grouped under the collation. Null and blank texts (nothing but spaces
    and invisible characters) are in no class. ``texts`` is ``signed`` of the same, if it has been written already.
    """
    texts = cut(signed(df, key, text)) if texts is None else texts
    shared = texts.groupBy("trace").agg(F.count("*").alias("n")).filter("n > 1").select("trace")
    some = cut(texts.join(shared, "trace", "left_semi"))
    again = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(some, "key").filter(F.md5("text") == F.col("digest"))
    again = again.groupBy("digest", "trace").agg(F.first("key").alias("key"), F.first("text").alias("text"))
    again = cut(again.withColumn("fold", fold(F.col("text"))))
    alike = F.collate(F.col("fold"), "UNICODE")
    groups = again.groupBy("trace", alike.alias("like")).agg(F.min("key").alias("class_id"), F.min("text").alias("form"), F.count("*").alias("n_texts")).filter("n_texts > 1")
    found = again.withColumn("like", alike).select("digest", "trace", "like").join(groups, ["trace", "like"])
    return found.select("digest", "class_id", "form", "n_texts")


def canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, form, n_texts) of every row: the canonical member of its class joined back, its own text where no other looks like it. Null for null and
    blank texts."""
    texts = cut(signed(df, key, text))
    several = cut(classes(df, key, text, texts))
    alone = texts.join(several.select("digest"), "digest", "left_anti").select("digest", F.col("key").alias("own"))
    rows = df.select(F.col(key), F.col(text).alias("_text"), F.md5(text).alias("digest"))
    j = rows.join(several, "digest", "left").join(alone, "digest", "left")
    single = F.col("own").isNotNull()
    return j.select(
        key, F.coalesce("class_id", "own").alias("class_id"), F.coalesce("form", F.when(single, F.col("_text"))).alias("form"), F.coalesce("n_texts", F.when(single, F.lit(1).cast("long"))).alias("n_texts")
    )


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(<key>_a, <key>_b) of rows whose texts look the same but differ in a character, the smaller key first.

    Only rows of classes with several texts are paired; copies of one text form no pair with each other.
    """
    several = cut(classes(df, key, text).select("digest", "class_id"))
    rows = cut(df.select(F.col(key).alias("key"), F.md5(text).alias("digest")).join(several, "digest"))
    a, b = (rows.select("class_id", F.col("key").alias(f"{key}_{s}"), F.col("digest").alias(f"d_{s}")) for s in "ab")
    return a.join(b, "class_id").filter(f"{key}_a < {key}_b and d_a <> d_b").select(f"{key}_a", f"{key}_b").distinct()
