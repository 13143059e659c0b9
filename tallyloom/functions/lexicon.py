"""Words of household and food listings in two languages, with spelling slips: product kinds, varieties, their units.

A token stands for a concept when it is one of its words, or one edit (letter added, lost, changed, or two swapped) away from a word of
four letters or more. Kinds are told by sets of concepts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

# The words of each concept.
CONCEPTS = {
    # nouns and uses that make a kind
    "soap": "мыло мыла soap", "liquid": "жидкое жидк liquid", "bar": "туалетное туалетнае туалетн туал туалетная кусковое куск твердое bar toilet",
    "gel": "гель gel", "shower": "душа душ shower", "wash": "стирки стирка стирк стиральный стиральн стир laundry washing смс",
    "plumbing": "сантехники сантехника сантехн унитаза унитаз bathroom", "paste": "паста pasta paste", "tooth": "зубная зубн", "toothpaste": "toothpaste",
    "rinse": "ополаскиватель ополаск ополаскив rinse", "mouth": "рта рот полости mouth", "mouthwash": "mouthwash", "linen": "белья бельё белье linen",
    "conditioner": "кондиционер конд conditioner", "softener": "softener", "balm": "бальзам бальз balm", "hair": "волос волосы hair",
    "shampoo": "шампунь шамп shampoo", "cream": "крем cream", "hand": "рук руки hand", "dish": "посуды посуда dish", "salt": "соль salt",
    "bath": "ванн ванны ванна bath", "dishwasher": "пмм посудомоек посудомоечных посудомоечной посудомойки посудомоечн dishwasher",
    "tablets": "таблетки таб табл tablets tabs", "tea": "чай tea", "herbal": "травяной трав herbal", "powder": "порошок powder",
    "clean": "чистящий чистящее чист чистящ cleaning cleanser", "soda": "сода soda", "water": "вода water", "wipes": "салфетки салф wipes",
    "wet": "влажные влажн wet", "cotton_pads": "диски pads", "cotton_wool": "ватные ватн", "paper": "бумага paper", "diapers": "подгузники подгузн diapers",
    "agent": "средство ср ср-во",
    # scents
    "aloe": "алоэ aloe", "buckthorn": "облепиха облепихой облепиховый облепихи", "lemon": "лимон лимоном лимонный лимона lemon",
    "chamomile": "ромашка ромашкой ромашки chamomile", "sage": "шалфей шалфеем шалфея sage", "mint": "мята мятой мятный мяты mint",
    "honey": "мед медом меда honey", "sea": "морская морской sea", "green": "зеленым зеленый зеленого green", "coconut": "кокос кокосом кокосовый coconut",
    "grapefruit": "грейпфрут грейпфрутом грейпфр грейпфрута grapefruit", "lavender": "лаванда лавандой лавандовый лаванды lavender",
    "cotton": "хлопок хлопком хлопковый cotton", "unscented": "unscented", "smell": "отдушки запаха",
    # purposes, forms and size classes
    "white": "белого white", "color": "цветного color colour", "black": "черного black", "baby": "детского детское baby", "universal": "универсальный универс универсальн универсальное universal",
    "coarse": "крупная крупн крупнокристаллич крупнокристаллическая", "fine": "мелкая мелк", "granules": "гранулы гранулир гранулированная",
    "eco": "эко eco", "phosphate_free": "бесфосфатные", "round": "круглые кругл", "oval": "овальные овал", "embossed": "тиснением тисн рисунком рис",
    "still": "негазированная негаз н/газ", "sparkling": "газированная газ", "gas": "газа газом", "bucket": "ведро ведре", "pack": "пачка пачке",
    "two_ply": "двухслойный двухслойная", "three_ply": "трехслойный трехслойная",
    "size_s": "s", "size_m": "m", "size_l": "l", "size_xl": "xl",
}
# Kinds as (name, base unit, sets of concepts of which one must be there); the first that fits holds.
KINDS = [
    ("tablets", "pcs", ["tablets"]), ("dishwasher_salt", "g", ["salt dishwasher"]), ("bath_salt", "g", ["salt bath"]), ("toothpaste", "ml", ["toothpaste", "paste tooth"]),
    ("mouthwash", "ml", ["mouthwash", "rinse mouth"]), ("softener", "ml", ["softener", "rinse linen", "conditioner linen", "conditioner"]), ("balm", "ml", ["balm"]),
    ("shampoo", "ml", ["shampoo"]), ("hand_cream", "ml", ["cream"]), ("liquid_soap", "ml", ["soap liquid"]), ("soap", "g", ["soap"]), ("plumbing_gel", "ml", ["plumbing"]),
    ("laundry_powder", "g", ["powder wash"]), ("cleaning_powder", "g", ["powder clean", "powder"]), ("laundry_gel", "ml", ["gel wash"]), ("shower_gel", "ml", ["gel shower"]),
    ("dish_liquid", "ml", ["dish"]), ("wipes", "pcs", ["wipes"]), ("cotton_pads", "pcs", ["cotton_pads", "cotton_wool"]), ("toilet_paper", "pcs", ["paper"]),
    ("diapers", "pcs", ["diapers"]), ("soda", "g", ["soda"]), ("water", "ml", ["water"]), ("tea", "g", ["tea"]),
    ("mouthwash", "ml", ["rinse"]), ("toothpaste", "ml", ["tooth"]), ("shower_gel", "ml", ["shower"]), ("bath_salt", "g", ["salt"]),
]
KIND_SETS = [(name, frozenset(c.split())) for name, _, sets in KINDS for c in sets]
KIND_BASE = {name: base for name, base, _ in KINDS}
SCENTS = ("aloe", "buckthorn", "lemon", "chamomile", "sage", "mint", "honey", "sea", "green", "coconut", "grapefruit", "lavender", "cotton", "unscented")

_EXACT = {w: c for c, words in CONCEPTS.items() for w in words.split()}
_EXACT["туалетная"] = "bar"


def words_of(concepts: Iterable[str]) -> dict[str, str]:
    """word -> concept, for the words of these concepts."""
    wanted = set(concepts)
    return {w: c for w, c in _EXACT.items() if c in wanted}


def deletions(word: str) -> set[str]:
    """``word`` and all its forms with one letter removed."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


_NEAR: dict[str, list[str]] = {}
for _w in _EXACT:
    if len(_w) >= 4:
        for _d in deletions(_w):
            _NEAR.setdefault(_d, []).append(_w)


def one_edit(a: str, b: str) -> bool:
    """At most one letter added, lost, changed or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


@lru_cache(maxsize=200_000)
def concept(token: str) -> str | None:
    """The concept a lower-case token stands for."""
    if token in _EXACT:
        return _EXACT[token]
    if len(token) < 4:
        return None
    near = sorted({w for d in deletions(token) for w in _NEAR.get(d, ()) if one_edit(token, w)})
    return _EXACT[near[0]] if near else None


_SPLIT = re.compile(r"[^a-zа-я0-9]+")


def words(text: str | None) -> list[str]:
    """Lower-case words of a name; ``ё`` is ``е``, ``ср-во`` and ``н/газ`` stay whole."""
    s = (text or "").lower().replace("ё", "е").replace("ср-во", " средство ").replace("н/газ", " негаз ")
    s = re.sub(r"(?<![а-я])з/п", "зубная п", s)
    s = re.sub(r"(?<![а-я])т/б", "туалетная б", s)
    s = re.sub(r"(?<![а-я])д/", " для ", s)
    return [w for w in _SPLIT.split(s) if w]


def kind_of(concepts: Iterable[str]) -> str | None:
    have = set(concepts)
    return next((name for name, need in KIND_SETS if need <= have), None)
