"""Traits of a catalogue listing: brand, kind, variety, content, pieces, line. Plain Python, for one listing."""

from __future__ import annotations

import re

from tallyloom.functions.lexicon import SCENTS, concept, words
from tallyloom.operators.units import readings


# Latin spellings of Cyrillic letters in brands.
_TO_LATIN = dict(zip("абвгдеёзийклмнопрстуфыэ", "abvgdeeziyklmnoprstufye")) | {
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya", "ъ": "", "ь": "",
}
_MAKER = re.compile(r"^(?:ооо|ао|пк|тд|зао|оао|ип)\s*[«\"](.+?)[»\"]$")
_MAKER_END = re.compile(r"(?:пром|хим|\s+трейд)$")
# Concepts of a variety by kind; kinds not named here have scents.
VARIETIES = {
    "laundry_gel": ("white", "color", "black", "baby", "universal"), "laundry_powder": ("white", "color", "black", "baby", "universal"),
    "dishwasher_salt": ("coarse", "fine", "granules"), "tablets": (*SCENTS, "eco"), "soda": ("bucket", "pack"), "water": ("still", "sparkling"),
    "diapers": ("size_s", "size_m", "size_l", "size_xl"), "cotton_pads": (*SCENTS, "round", "oval"),
    "toilet_paper": (*SCENTS, "two_ply", "three_ply", "embossed"),
}
_LAYERS = re.compile(r"(?<!\d)([23])\s*-?\s*сл(?:о[йяе]\w*|ойн\w*)?(?![а-я])")


# What stands in the brand column where there is no brand.
_NO_BRAND = {"netbrenda", "bezbrenda", "noname", "nan", "none", "net"}


def latin(text: str) -> str:
    return "".join(_TO_LATIN.get(c, c) for c in text.lower())


def key_of(name: str) -> str:
    """Letters and digits of a name in Latin."""
    return re.sub(r"[^a-z0-9]", "", latin(name))


def brand_of(brand: str | None, maker: str | None, supplier: str | None) -> str | None:
    """The brand in Latin letters: the brand column, or the supplier column where the brand column holds a company, else by the maker's name."""
    b, m, s = ((x or "").strip() for x in (brand, maker, supplier))
    company = _MAKER.match(b.lower())
    if key_of(b) in _NO_BRAND:
        b = ""
    if b and not company:
        return key_of(b) or None
    if company and s and not _MAKER.match(s.lower()):
        return key_of(s) or None
    company = company or _MAKER.match(m.lower())
    return key_of(_MAKER_END.sub("", company[1].strip())) or None if company else None


def concepts_of(name: str | None) -> list[str]:
    """The concepts that may make a variety, whatever the kind; sorted."""
    low = (name or "").lower().replace("ё", "е").replace("эко-линия", " ").replace("эко линия", " ")
    listed = words(low)
    found = set()
    for k, c in enumerate(map(concept, listed)):
        before = listed[k - 1] if k else ""
        if c == "smell" or c == "unscented":
            found.add("unscented")
        elif c == "gas":
            found.add("still" if before == "без" else "sparkling")
        elif c == "phosphate_free":
            found.add("eco")
        elif c and (not c.startswith("size_") or len(listed[k]) <= 2):
            found.add(c)
    if m := _LAYERS.search(low):
        found.add("two_ply" if m[1] == "2" else "three_ply")
    sizes = {c for c in found if c.startswith("size_")}
    if len(sizes) > 1:  # "1 l" is no size
        found -= sizes - ({c for c in sizes if re.search(rf"(?:р-р|размер|size)\s*{c[5:]}(?![a-z])", low)} or sizes)
    return sorted(found)


def traits(name: str | None, brand: str | None, maker: str | None, supplier: str | None, weight: str | None, unit: str | None) -> tuple:
    """Brand, concepts of the name, and the readings of kind and content."""
    return brand_of(brand, maker, supplier), concepts_of(name), *readings(name, weight, unit)
