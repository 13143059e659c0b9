"""Probabilistic record linkage: weights of comparison levels by expectation-maximisation (after Fellegi and Sunter)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Iterations at most, and the change of the share of matches at which they stop.
ITERATIONS, CLOSE = 500, 1e-6


def level(*cases: tuple[str, Column], otherwise: str = "differ") -> Column:
    """The name of the first case that holds; a case with a null condition does not hold."""
    c = F.when(cases[0][1], cases[0][0])
    for name, condition in cases[1:]:
        c = c.when(condition, name)
    return c.otherwise(otherwise)


def missing(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull()


def near(a: Column, b: Column) -> Column:
    """One letter added, lost or changed, or two letters swapped, in words of five letters or more."""
    d = F.levenshtein(a, b, 2)
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b))
    return (F.length(a) >= 5) & (F.length(b) >= 5) & ((d.between(0, 1)) | swapped)


def near_words(words: DataFrame) -> DataFrame:
    """(w, n, other, other_n): each pair of different words that are ``near``, in both orders. ``words`` holds each word ``w`` once, with ``n``.

    A word meets those with which it shares a form with at most one letter removed: every near pair does, and few others. No null, no word
    shorter than five letters takes part.
    """
    cut_out = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, F.length("w"))))
    forms = words.filter("length(w) >= 5").select("w", "n", F.explode(F.array_distinct(F.concat(F.array("w"), cut_out))).alias("form"))
    other = forms.select(F.col("w").alias("other"), F.col("n").alias("other_n"), "form")
    return forms.join(other, "form").filter(F.col("w") != F.col("other")).filter(near(F.col("w"), F.col("other"))).select("w", "n", "other", "other_n").distinct()


@dataclass
class Weights:
    """Share of matches and, for each field, the share of each level among matches and among the rest."""

    share: float
    m: list[dict[str, float]]
    u: list[dict[str, float]]
    silent: tuple[str, ...] = ()

    def bits(self, pattern: Sequence[str]) -> float:
        """Weight of the evidence for a match, in bits; a silent level or one never seen says nothing."""
        return sum(math.log2(m[v] / u[v]) for v, m, u in zip(pattern, self.m, self.u) if v not in self.silent and v in m)

    def probability(self, pattern: Sequence[str]) -> float:
        """Probability of a match."""
        odds = self.bits(pattern) * math.log(2) + math.log(self.share) - math.log1p(-self.share)
        return 1 / (1 + math.exp(max(-700.0, min(700.0, -odds))))


def fit(patterns: Sequence[tuple[tuple[str, ...], int]], agreeing: Sequence[str], share: float, silent: tuple[str, ...] = ()) -> Weights:
    """Weights by expectation-maximisation over ``patterns``, the different patterns of levels with their numbers of pairs.

    ``agreeing`` are the levels that speak for a match, from which the first guess is made; ``share`` is the first guess of the share of
    matches. A missing value is a level of its own with its own weight, unless ``silent`` names it. Fields are taken as independent
    within matches and within the rest.
    """
    fields = range(len(patterns[0][0]))
    levels = [sorted({p[f] for p, _ in patterns} - set(silent)) for f in fields]
    w = Weights(share, [{v: 0.9 if v in agreeing else 0.1 for v in vs} for vs in levels], [{v: 0.2 if v in agreeing else 0.8 for v in vs} for vs in levels], silent)
    total = sum(n for _, n in patterns)
    for _ in range(ITERATIONS):
        matched = [(p, n, n * w.probability(p)) for p, n in patterns]
        for f in fields:
            for weights, part in ((w.m, lambda n, x: x), (w.u, lambda n, x: n - x)):
                sums = {v: 1e-3 for v in levels[f]}
                for p, n, x in matched:
                    if p[f] in sums:
                        sums[p[f]] += part(n, x)
                whole = sum(sums.values())
                weights[f] = {v: s / whole for v, s in sums.items()}
            if sum(v for k, v in w.m[f].items() if k in agreeing) < sum(v for k, v in w.u[f].items() if k in agreeing):
                w.m[f] = dict(w.u[f])  # agreement never speaks against a match
        new = min(max(sum(x for _, _, x in matched) / total, 1e-9), 1 - 1e-9)
        close = abs(new - w.share) < CLOSE * new
        w.share = new
        if close:
            break
    return w


def with_probability(pairs: DataFrame, fields: Sequence[str], agreeing: Sequence[str], share: float = 0.2, equal: DataFrame | None = None) -> DataFrame:
    """``pairs`` with the probability of a match, fitted on the counts of all patterns of the level columns ``fields``.

    ``equal`` holds further patterns (the same columns and ``count``): those of pairs that were never made because both sides are equal.

    Only the counts reach the driver: at most the product of the numbers of levels, however many pairs there are. The table of probabilities
    that goes back has as many rows, and is therefore broadcast.
    """
    counts = [(tuple(r[f] for f in fields), r["count"]) for r in pairs.groupBy(*fields).count().collect()]
    if equal is not None:
        counts += [(tuple(r[f] for f in fields), int(r["count"])) for r in equal.groupBy(*fields).agg(F.sum("count").alias("count")).collect() if r["count"]]
        merged: dict[tuple[str, ...], int] = {}
        for p, n in counts:
            merged[p] = merged.get(p, 0) + n
        counts = list(merged.items())
    if not counts:
        return pairs.withColumn("probability", F.lit(None).cast("double"))
    weights = fit(counts, agreeing, share)
    schema = ", ".join(f"{f} string" for f in fields) + ", probability double"
    table = pairs.sparkSession.createDataFrame([(*p, weights.probability(p)) for p, _ in counts], schema)
    return pairs.join(F.broadcast(table), list(fields))
