"""Headers of an extract -> canonical fields (names only; works on the few dozen headers of one file)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

from tallyloom.sources.schema import ALIASES, MORE_ALIASES, VAT_ENDINGS

LEAST_SCORE = 0.60
_PUNCTUATION = re.compile(r"[\W_]+")


def normal_alias(name: str) -> str:
    """Lower case, with single spaces for punctuation and underscores."""
    return " ".join(_PUNCTUATION.sub(" ", str(name).lower()).split())


@lru_cache(maxsize=100_000)
def normal_header(name: str) -> str:
    """As ``normal_alias``, without an ending about VAT.

    One normaliser for aliases and headers, so that a canonical name is always mapped to itself.
    """
    s = str(name).lower().strip()
    for end in VAT_ENDINGS:
        s = s.removesuffix(end)
    return normal_alias(s)


def look(name: str) -> str:
    """What stays of a header when case, spaces and punctuation do not count."""
    return _PUNCTUATION.sub("", str(name).lower())


_ALIASES = {f: tuple(dict.fromkeys(normal_alias(a) for a in [f, *names, *MORE_ALIASES.get(f, ())])) for f, names in ALIASES.items()}
_EXACT: dict[str, str] = {}
for _f, _names in _ALIASES.items():
    for _a in _names:
        _EXACT.setdefault(_a, _f)


@lru_cache(maxsize=100_000)
def score(header: str, field: str) -> float:
    """Likeness of a normalised header and a field in [0, 1]: 1 for an alias, 0.6 + 0.4 x coverage for an alias of at least five letters
    that covers half of the header or more, or the share of common words."""
    best, own = 0.0, set(header.split())
    for alias in _ALIASES[field]:
        if alias == header:
            return 1.0
        if len(alias) >= 5 and alias in header and (cover := len(alias) / len(header)) >= 0.5:
            best = max(best, 0.6 + 0.4 * cover)
        words = set(alias.split())
        if own and words:
            best = max(best, len(own & words) / len(own | words))
    return best


def map_headers(headers: Sequence[str]) -> dict[str, str]:
    """header -> field, one to one.

    Exact names first, the earlier column holding; a header with an exact name takes part no further. Then the best remaining pair of at
    least LEAST_SCORE, again and again (ties by header, then field).
    """
    result: dict[str, str] = {}
    taken: set[str] = set()
    rest: list[tuple[str, str]] = []
    for h in headers:
        n = normal_header(h)
        field = _EXACT.get(n)
        if field is None:
            rest.append((h, n))
        elif field not in taken:
            taken.add(field)
            result[h] = field
    pairs = sorted((-score(n, f), h, f) for h, n in rest for f in _ALIASES if f not in taken and score(n, f) >= LEAST_SCORE)
    for _, h, f in pairs:
        if h not in result and f not in taken:
            taken.add(f)
            result[h] = f
    return result


def fields_of(headers: Iterable[str]) -> dict[str, str]:
    """field -> header: ``map_headers`` the other way round."""
    return {f: h for h, f in map_headers(list(headers)).items()}


def schema_report(headers: Sequence[str]) -> dict[str, object]:
    """Number of mapped headers and the list of those that belong to no field."""
    mapped = map_headers(headers)
    return {"mapped": len(mapped), "unmapped": [h for h in headers if h not in mapped]}
