"""Working through cases by hand: presets of filters, previews, queues of open cases, decisions, overrides and patches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import is_blank
from tallyloom.operators.analytics import filtered
from tallyloom.sources.read import read_json, write_json

#: Rows of a preview.
PREVIEW = 200


class Presets:
    """Named choices of filter values, kept in a JSON file."""

    def __init__(self, path: str) -> None:
        self.path = path

    def names(self) -> list[str]:
        return sorted(read_json(self.path, {}))

    def save(self, name: str, chosen: Mapping[str, Sequence[str]]) -> None:
        write_json(self.path, read_json(self.path, {}) | {name: {k: list(v) for k, v in chosen.items() if v}})

    def delete(self, name: str) -> None:
        write_json(self.path, {k: v for k, v in read_json(self.path, {}).items() if k != name})

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` by a preset; columns that it lacks are left aside, an unknown name chooses everything."""
        chosen = read_json(self.path, {}).get(name, {})
        return filtered(df, {c: v for c, v in chosen.items() if c in df.columns})


def uncategorised(df: DataFrame, column: str = "target_category") -> DataFrame:
    """Rows without a category: null, blank or ``nan``."""
    return df.filter(is_blank(F.col(column)))


def preview(df: DataFrame, n: int = PREVIEW, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, by ``order`` where it is given; a report for the eye."""
    return (df.orderBy(*order) if order else df).limit(n)


def upserted(table: DataFrame, changed: DataFrame, key: str = "key") -> DataFrame:
    """``table`` with the rows of ``changed`` in the place of those with their keys, and behind those where the key is new. One row per key of
    ``changed``; a null key is never replaced."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed.select(*table.columns))


def review_queue(scored: DataFrame, decided: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs for review that nobody has decided yet, in either order of their names; each once, the likeliest first."""
    keyed = lambda df: df.withColumns({"_x": F.least(a, b), "_y": F.greatest(a, b)})
    done = keyed(decided.select(a, b)).select("_x", "_y").distinct()
    waiting = keyed(scored.filter("prediction = 'review'")).dropDuplicates(["_x", "_y"]).join(done, ["_x", "_y"], "left_anti")
    return waiting.drop("_x", "_y").orderBy(F.desc("score"), a, b)


def override_rates(decisions: DataFrame) -> DataFrame:
    """(suggested, verdict, n, share): how people decided on what was suggested to them; the share is that of the suggestion."""
    verdict = lambda c: F.lower(F.trim(c))
    g = decisions.filter("suggested is not null and verdict is not null").groupBy(verdict("suggested").alias("suggested"), verdict("verdict").alias("verdict")).agg(F.count("*").alias("n"))
    whole = g.groupBy("suggested").agg(F.sum("n").alias("whole"))
    return g.join(whole, "suggested").select("suggested", "verdict", "n", (F.col("n") / F.col("whole")).alias("share"))


def merged_patch(state: Mapping, patch: Mapping) -> dict:
    """A state with a patch laid over it: lists are joined without repeats, objects merged, anything else replaced. Neither is changed."""
    out = dict(state)
    for k, v in patch.items():
        old = out.get(k)
        if isinstance(old, Mapping) and isinstance(v, Mapping):
            out[k] = merged_patch(old, v)
        elif isinstance(old, list) and isinstance(v, list):
            out[k] = old + [x for i, x in enumerate(v) if x not in old and x not in v[:i]]
        else:
            out[k] = v
    return out
