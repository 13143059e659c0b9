"""Evaluation items whose text stands in documents, wholly or in part."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.lookalike import fold
from tallyloom.llm.passages import coverage, seeds_of
from tallyloom.session import cut

#: Share of an item's letters that passages must cover.
LEAST_COVERAGE = 0.5
#: Words of a shingle. Five would be spoilt too easily: a slip in one word spoils as many shingles as a shingle has words.
WORDS = 3
#: Share of an item's different shingles that a document must hold to be looked at: half of the text with a slip in every fifth word.
LEAST_SHINGLES = 0.2
#: Shingles of an item's prefix that a document must hold; the prefix is longer by as much.
PREFIX_HITS = 3
#: Shingles that a stretch of a document as long as the item must hold for them to count.
LEAST_IN_WINDOW = 2


def reading(text: Column) -> Column:
    """Letters and digits as a reader takes them: look-alikes, case, accents and punctuation aside; words with single spaces between."""
    c = F.lower(fold(text))
    c = F.translate(c, "вкмнтёëй", "bkmhteeи")  # small letters whose capitals look alike
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{M}", ""), r"[^\p{L}\p{N}]+", " "))


def once(column: Column) -> Column:
    """A column made by an explode of one element, which the optimizer neither merges with its uses nor repeats for each of them."""
    return F.explode(F.array(column))


@lru_cache(maxsize=20_000)
def _seeds(item: str) -> dict[str, list[int]]:
    return seeds_of(item)


def _covers(text: pd.Series, item: pd.Series) -> pd.Series:
    return pd.Series([coverage(i, _seeds(i), t) >= LEAST_COVERAGE for t, i in zip(text, item)], dtype=bool)


def shingles(texts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n, pos, h): the digest of the ``size`` words from each position of ``r`` on; n is the number of words of the text."""
    words = texts.select(key, once(F.split("r", " ")).alias("ws")).filter(F.size("ws") >= size)
    runs = F.arrays_zip(*(F.slice("ws", F.lit(k + 1), F.size("ws") - size + 1).alias(f"w{k}") for k in range(size)))
    rows = words.select(key, F.size("ws").alias("n"), F.posexplode(runs).alias("pos", "run"))
    return rows.select(key, "n", "pos", F.xxhash64(F.lit(size), *(F.col(f"run.w{k}") for k in range(size))).alias("h"))


def ranked_prefix(items: DataFrame, held: DataFrame) -> DataFrame:
    """(item, needed, h): the rarest n - t + needed of an item's n shingles. A document with a share LEAST_SHINGLES of them, which is t, holds ``needed`` of these.

    Rarity is the number of documents that hold a shingle, over all documents.
    """
    counts = held.groupBy("h").agg(F.count_distinct("doc").alias("n_docs"))
    ranked = items.select("item", "h").distinct().join(counts, "h", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "h"))).alias("hs"))
    n = F.size("hs")
    least = F.ceil(n * F.lit(LEAST_SHINGLES))
    needed = F.least(F.lit(PREFIX_HITS), least)
    prefix = ranked.select("item", needed.alias("needed"), F.explode(F.slice("hs", F.lit(1), (n - least + needed).cast("int"))).alias("x"))
    return prefix.select("item", "needed", "x.h").filter("x.n_docs > 0")


def within_windows(hits: DataFrame) -> DataFrame:
    """(doc, item) of the pairs in which enough of the item's shingles stand together.

    ``hits`` (doc, item, n words and m shingles of the item, pos in the document, h). A document is cut into stretches of n words, once from its
    beginning and once from half a stretch before it; shingles alone in their stretch are chance, those of the others must be LEAST_SHINGLES of
    the item's (one of an item of very few).
    """
    half = F.floor(F.col("n") / 2)
    cuts = F.explode(F.array(F.struct(F.lit(0).alias("shift"), F.floor(F.col("pos") / F.col("n")).alias("at")), F.struct(F.lit(1).alias("shift"), F.floor((F.col("pos") + half) / F.col("n")).alias("at"))))
    stretches = hits.select("doc", "item", "m", "h", cuts.alias("c")).groupBy("doc", "item", "m", "c.shift", "c.at").agg(F.count_distinct("h").alias("k"))
    needed = F.least(F.lit(LEAST_IN_WINDOW), F.ceil(F.col("m") * F.lit(LEAST_SHINGLES)))
    sums = stretches.filter(F.col("k") >= needed).groupBy("doc", "item", "m", "shift").agg(F.sum("k").alias("k"))
    return sums.filter(F.col("k") >= F.col("m") * F.lit(LEAST_SHINGLES)).select("doc", "item").distinct()


def candidates(corpus: DataFrame, read: DataFrame) -> DataFrame:
    """(doc, item): the pairs that the prefix-filtered join and the windows leave. ``corpus`` (doc, r) and ``read`` (item, r) hold normalised texts."""
    # items of fewer words than a shingle are one shingle: at most WORDS different sizes
    size = F.least(F.size(F.split("r", " ")), F.lit(WORDS))
    sizes = sorted(r["s"] for r in read.select(size.alias("s")).distinct().collect())
    of_items, of_docs = None, None
    for k in sizes:
        i, d = shingles(read.filter(size == k), "item", k), shingles(corpus, "doc", k).select("doc", "pos", "h")
        of_items, of_docs = (i, d) if of_items is None else (of_items.unionByName(i), of_docs.unionByName(d))
    if of_items is None:
        return corpus.select("doc").limit(0).join(read.select("item").limit(0))
    m = F.count_distinct("h").alias("m")
    of_items = cut(of_items)
    totals = of_items.groupBy("item", "n").agg(m)
    held = cut(of_docs.join(of_items.select("h").distinct(), "h", "left_semi"))
    met = held.select("doc", "h").distinct().join(cut(ranked_prefix(of_items, held)), "h").groupBy("doc", "item", "needed").agg(F.count("*").alias("k"))
    met = met.filter("k >= needed").select("doc", "item")
    # all shingles of an item in a document that holds one of its prefix: by both keys, so that a common shingle is no hot key
    wanted = met.join(of_items.select("item", "h").distinct(), "item").join(totals, "item")
    return within_windows(wanted.join(held, ["doc", "h"]))


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(<doc_id>, <item_id>): the document holds at least LEAST_COVERAGE of the item's letters in running passages.

    A prefix-filtered set join finds candidates: shingles of WORDS words, an item's ordered by rarity in the corpus, its prefix joined with the
    documents' shingles; then the shingles must stand together in stretches as long as the item. What remains is compared letter by letter,
    slips allowed, over the whole text; only these documents are normalised again. Null and empty texts hold nothing, an item
    without words or of fewer letters than a seed leaks nowhere, and repeated rows count once. Extra columns do not matter.
    """
    read = cut(items.select(F.col(item_id).alias("item"), once(reading(F.col(item_text))).alias("r")).filter("r <> ''").dropDuplicates(["item"]))
    corpus = docs.select(F.col(doc_id).alias("doc"), once(reading(F.col(text))).alias("r")).filter("r <> ''")
    found = cut(candidates(corpus, read))
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    few = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).join(found, "doc").join(read.select("item", squeezed(F.col("r")).alias("s")), "item")
    few = few.select("doc", "item", "s", once(squeezed(reading(F.col("t")))).alias("t")).filter(F.length("t") >= F.length("s") * LEAST_COVERAGE)
    out = few.filter(F.pandas_udf(_covers, "boolean")("t", "s"))
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()
