"""How well names are matched: TF-IDF likeness, gates, confusion, threshold sweep, and what reviewers reject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.lexicon import SCENTS, words_of
from tallyloom.functions.text import normal_name, token_set, volume_key

#: Thresholds of the sweep.
SWEEP = [round(0.70 + 0.02 * k, 2) for k in range(12)]
#: A word that so many names hold at most is rare. An own value: the engine's is not published.
RARE_DF = 2
#: What two names must agree in where it is stated: patterns whose first group is compared, all hits of a name as a set. Own ones, as the engine's
#: bodies are not published.
SIGNATURES = {
    "layers": r"([0-9])\s*-?\s*(?:сло[йяе]|сл[.,; ]|сл$|ply)",
    "rolls": r"([0-9]+)\s*(?:рул|roll)",
    "shade": r"(?:тон|оттенок|shade|№)\s*([0-9]+(?:[.,/][0-9]+)?)",
    "dye": r"(?:^|[ (])([0-9]{1,2}[/-][0-9]{1,3})(?:$|[ ),])",
    "count": r"([0-9]+)\s*(?:таб|капс|саше|пар[ыа]?(?:$| ))",
}
#: Concepts of which two names that both state some must share one: sorts of product, and scents and colours.
TYPES = (
    "soap", "gel", "shampoo", "balm", "cream", "powder", "paste", "toothpaste", "rinse", "mouthwash", "softener", "conditioner", "tablets", "salt", "tea", "soda", "water", "wipes",
    "paper", "diapers", "cotton_pads", "cotton_wool",
)
VARIANTS = (*SCENTS, "white", "color", "black", "baby")


def document_frequency(names: DataFrame, column: str) -> DataFrame:
    """(token, df): the number of names that hold a word."""
    return names.select(F.explode(token_set(normal_name(F.col(column)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def char_grams(text: Column, sizes: Sequence[int] = (2, 3, 4)) -> Column:
    """Character n-grams inside word bounds: each word with a space on both sides; a word shorter than n gives itself once."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        def runs(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.length(padded) - n + 1)
            short = F.array(padded) if n == sizes[0] else F.array().cast("array<string>")
            return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(short)

        grams = [runs(n) for n in sizes]
        return F.concat(*grams)

    return F.flatten(F.transform(words, of))


def tfidf(texts: DataFrame, key: str, text: str, corpus: DataFrame | None = None) -> DataFrame:
    """(key, gram, weight): counts times ln((1 + n) / (1 + df)) + 1, each text scaled to length 1.

    n and df are those of ``corpus`` (the same columns), of which ``texts`` is a part; without it those of ``texts``.
    """
    corpus = texts if corpus is None else corpus
    grams = texts.select(key, F.explode(char_grams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    df = corpus.select(F.explode(F.array_distinct(char_grams(F.col(text)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    n = corpus.agg(F.count_distinct(key).alias("n"))
    w = grams.join(df, "gram").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def names_together(pairs: DataFrame, a: str, b: str, corpus: DataFrame | None = None) -> DataFrame:
    """(t): the different names of the pairs and of ``corpus`` (name), nulls left out."""
    names = pairs.select(F.col(a).alias("t")).unionByName(pairs.select(F.col(b).alias("t")))
    if corpus is not None:
        names = names.unionByName(corpus.select(F.col("name").alias("t")))
    return names.filter("t is not null").distinct()


def scored_pairs(pairs: DataFrame, a: str, b: str, corpus: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``score``: the cosine of the TF-IDF vectors of both normalised names, over the different names of the pairs and of ``corpus`` (name)."""
    normal = lambda names: names.select("t", normal_name(F.col("t")).alias("normal"))
    v = tfidf(normal(names_together(pairs, a, b)), "t", "normal", None if corpus is None else normal(names_together(pairs, a, b, corpus)))
    keyed = pairs.select(a, b).distinct()
    x, y = v.select(F.col("t").alias(a), "gram", F.col("weight").alias("wa")), v.select(F.col("t").alias(b), "gram", F.col("weight").alias("wb"))
    dots = keyed.join(x, a).join(y, [b, "gram"]).groupBy(a, b).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dots, [a, b], "left").withColumn("score", F.coalesce("dot", F.lit(0.0))).drop("dot")


def with_rarest(pairs: DataFrame, a: str, b: str, corpus: DataFrame | None = None) -> DataFrame:
    """Adds ``rarest``: of the words in which both names differ, the least number of names (of the pairs and of ``corpus``) that hold one; null if none differs."""
    df = document_frequency(names_together(pairs, a, b, corpus), "t")
    differing = pairs.select(a, b).distinct().select(a, b, F.explode(differing_tokens(pairs, a, b)).alias("token"))
    return pairs.join(differing.join(df, "token").groupBy(a, b).agg(F.min("df").alias("rarest")), [a, b], "left")


def signature(name: Column, pattern: str) -> Column:
    """The different hits of a pattern in a name, sorted; empty for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(pattern), F.lit(1))))


def concepts_in(name: Column, concepts: Sequence[str]) -> Column:
    """The concepts (of these) whose words stand in a name."""
    words = F.create_map(*(F.lit(x) for w, c in words_of(concepts).items() for x in (w, c)))
    tokens = F.split(F.translate(F.lower(F.coalesce(name, F.lit(""))), "ё", "е"), "[^a-zа-я0-9]+")
    return F.array_distinct(F.array_compact(F.transform(tokens, lambda t: F.try_element_at(words, t))))


def conflict(a: Column, b: Column) -> Column:
    """Whether two arrays both hold something and nothing in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def gated(pairs: DataFrame, a: str, b: str, threshold: float = 0.86, rare_df: int = RARE_DF, brands: tuple[str, str] | None = None, subbrands: Sequence[str] = ()) -> DataFrame:
    """Adds ``prediction`` and ``reason``, the first that holds.

    Hard gates make a non-match: sizes, layers, rolls, shades, dye codes or counts that differ, sorts of product or variants that have nothing
    in common. So does a likeness below the threshold. Soft gates make a case for review: brands (columns ``brands``) that both are stated and
    differ, different numbers, a differing word that is one of ``subbrands`` or that at most ``rare_df`` names hold (``rarest``). Else it is a match.
    """
    x, y = F.col(a), F.col(b)
    hard = {"size": volume_key(x) != volume_key(y)} | {k: signature(x, p) != signature(y, p) for k, p in SIGNATURES.items()}
    hard |= {"type": conflict(concepts_in(x, TYPES), concepts_in(y, TYPES)), "variant": conflict(concepts_in(x, VARIANTS), concepts_in(y, VARIANTS)), "score": F.col("score") < threshold}
    soft = {"numbers": signature(x, "([0-9]+)") != signature(y, "([0-9]+)"), "rare": F.col("rarest") <= rare_df}
    if subbrands:
        soft = {"subbrand": F.arrays_overlap(differing_tokens(pairs, a, b), F.array(*map(F.lit, subbrands)))} | soft
    if brands:
        one, other = (F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in brands)
        soft = {"brand": one != other} | soft
    reason = F.coalesce(*(F.when(c, F.lit(k)) for k, c in (hard | soft).items()), F.lit("none"))
    prediction = F.when(F.col("reason").isin(*hard), "non-match").when(F.col("reason").isin(*soft), "review").otherwise("match")
    return pairs.withColumn("reason", reason).withColumn("prediction", prediction)


def confusion(scored: DataFrame, label: str, thresholds: Sequence[float] = tuple(SWEEP)) -> DataFrame:
    """Per threshold the confusion matrix, precision, recall and F1 (0 where the denominator is 0), in one pass over the scored pairs."""
    at = scored.select((F.col(label) == "match").alias("y"), "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    p = F.col("score") >= F.col("threshold")
    g = at.groupBy("threshold").agg(
        F.count_if(p & F.col("y")).alias("tp"), F.count_if(p & ~F.col("y")).alias("fp"), F.count_if(~p & F.col("y")).alias("fn"), F.count_if(~p & ~F.col("y")).alias("tn")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = g.withColumn("precision", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))))
    return g.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def differing_tokens(pairs: DataFrame, a: str, b: str) -> Column:
    ta, tb = token_set(normal_name(F.col(a))), token_set(normal_name(F.col(b)))
    return F.array_union(F.array_except(ta, tb), F.array_except(tb, ta))


def token_alerts(rejected: DataFrame, a: str, b: str, known: DataFrame, least: int = 2) -> DataFrame:
    """(token, n): words of three letters or more in which rejected pairs differ more than ``least`` times and that ``known`` (token) does not hold."""
    tokens = rejected.select(F.explode(differing_tokens(rejected, a, b)).alias("token")).filter(F.length("token") >= 3)
    return tokens.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > least).join(known.select("token").distinct(), "token", "left_anti")


def new_golden(golden: DataFrame, accepted: DataFrame) -> DataFrame:
    """``golden`` (a, b, label) and the accepted pairs that it does not hold yet, in this order of a and b."""
    fresh = accepted.select("a", "b", "label").dropDuplicates(["a", "b"]).join(golden.select("a", "b"), ["a", "b"], "left_anti")
    return golden.select("a", "b", "label").unionByName(fresh.select("a", "b", "label"))


def decisions(log: DataFrame) -> DataFrame:
    """A decision log with ``accepted`` for matches; rows that are neither match nor review are left out."""
    verdict = F.lower(F.trim("verdict"))
    return log.withColumn("accepted", verdict == "match").filter(verdict.isin("match", "review"))
