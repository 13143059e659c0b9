"""Parts of a Russian postal address written in any order, with abbreviations, slips and parts missing. Plain Python, for one text."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


class Address(NamedTuple):
    """``kind`` is the sort of street, ``name`` its name as one word, ``unit`` a letter or the number of a block."""

    postcode: str | None = None
    region: str | None = None
    town: str | None = None
    kind: str | None = None
    ordinal: str | None = None
    name: str | None = None
    gender: str | None = None
    house: str | None = None
    unit: str | None = None


# Latin spellings of Cyrillic letters, longest first.
_LATIN = [
    ("shch", "щ"), ("sch", "щ"), ("aya", "ая"), ("yaya", "яя"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yy", "ый"), ("iy", "ий"), ("oy", "ой"),
    ("ay", "ай"), ("ey", "ей"), ("uy", "уй"), ("a", "а"), ("b", "б"), ("v", "в"), ("g", "г"), ("d", "д"), ("e", "е"), ("z", "з"), ("i", "и"), ("y", "ы"),
    ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("h", "х"), ("c", "к"),
    ("j", "й"), ("w", "в"), ("x", "кс"), ("q", "к"),
]
_LATIN_RE = re.compile("|".join(a for a, _ in _LATIN))
_LATIN_MAP = dict(_LATIN)
# Sorts of streets with their spellings, and the gender their names agree with.
_KINDS = {
    "улица": r"улица|ул|у", "переулок": r"переулок|пер-к|пер", "проспект": r"проспект|просп|пр-кт|пр-т", "бульвар": r"бульвар|бульв|бул|б-р",
    "набережная": r"набережная|наб", "шоссе": r"шоссе|ш", "площадь": r"площадь|пл", "проезд": r"проезд|пр-д",
}
GENDER = {"улица": "f", "набережная": "f", "площадь": "f", "переулок": "m", "проспект": "m", "бульвар": "m", "проезд": "m", "шоссе": "n"}
_NOT_USABLE = re.compile(r"^\W*(?:нет данных|уточняется|адрес в договоре|не указан\w*)?\W*$")
# Remarks that are no part of an address.
_NOISE = re.compile(r"вход\s+(?:со?|через|из)\s+[а-я]+|\d+\s*(?:-?й\s*)?этаж\w*|этаж\s*\d+|т[рц]?ц\s*«[^»]*»|тц\s+\w+|(?<![а-я])(?:оф(?:ис)?|пом(?:ещение)?|комн?)\.?\s*\d+\w?")
_POSTCODE = re.compile(r"(?<!\d)\d{6}(?!\d)")
_REGION = re.compile(r"([а-я]+)\s+(обл(?:асть)?|край)(?![а-я])\.?")
_TOWN = re.compile(r"(?<![а-я])(?:город|гор|г)(?![а-я])[.\s]*([а-я]{3,}(?:-[а-я]+)*)")
_ORDINALS = {"первая": "1", "первый": "1", "первое": "1", "вторая": "2", "второй": "2", "второе": "2", "третья": "3", "третий": "3", "третье": "3"}
_ORDINAL = re.compile(r"(?<!\d)(\d{1,2})\s*-\s*(?:ая|я|ый|ий|й|ой|ое|е)(?![а-я])|(?<![а-я])(" + "|".join(_ORDINALS) + r")(?![а-я])")
_KIND = re.compile("|".join(rf"(?P<{chr(97 + k)}>(?<![а-я-])(?:{p})(?![а-я-]))" for k, p in enumerate(_KINDS.values())))
_BARE_ORDINAL = re.compile(rf"(?<![а-я-])(?:{'|'.join(_KINDS.values())})\.?\s*(\d)\s+(?!корп|к\b|лит|г\b|город|стр)([а-я]{{3,}})")
_UNIT = (
    r"(?:[\s,]*(?:корп(?:ус)?|к|стр(?:оение)?)\.?\s*(?P<block>\d+)|\s*/\s*(?P<slash>\d+)|[\s,]*лит(?:ера)?\.?\s*[\"«]?(?P<lit>[а-я])(?![а-я])[\"»]?"
    r"|\s*[\"«-]?\s*(?P<letter>[а-и])[\"»]?(?![а-я-]))?"
)
_HOUSE = re.compile(rf"(?:(?<![а-я])(?:дом|д)(?![а-я])\.?|№)\s*(?P<no>\d{{1,4}}){_UNIT}")
_BARE_HOUSE = re.compile(rf"(?<![\d-])(?P<no>\d{{1,4}})(?!\d){_UNIT}")
_ADJECTIVE = re.compile(r"(?:ая|яя|ой|ый|ий|ое|ее)$")
_TOWNISH = re.compile(r"(?:ск|град|поль|во|горск|бург|но|ино)$")
_STREETISH = re.compile(r"(?:ая|яя|ый|ий|ой|ое|ее|ов|ев|ей|ка)$")


def plain(text: str) -> str:
    """Lower-case Cyrillic: transliterated words back in Cyrillic, ``ё`` as ``е``, single spaces."""
    s = text.lower().replace("ё", "е")
    if len(re.findall(r"[a-z]", s)) > len(re.findall(r"[а-я]", s)):
        s = _LATIN_RE.sub(lambda m: _LATIN_MAP[m[0]], s)
    return " ".join(s.replace("сч", "щ").split())  # sch stands for both


def stem_gender(name: str) -> tuple[str, str | None]:
    """A name without its adjective's ending, and the gender of the ending (``ой`` may be either)."""
    m = _ADJECTIVE.search(name)
    if not m or len(name) < 5:
        return name, None
    g = {"ая": "f", "яя": "f", "ое": "n", "ее": "n", "ый": "m", "ий": "m", "ой": "m"}[m[0]]
    return name[: m.start()], g


def _house(s: str) -> tuple[str | None, str | None, str]:
    m = _HOUSE.search(s) or _BARE_HOUSE.search(s)
    if not m:
        return None, None, s
    unit = m["letter"] or m["lit"] or m["slash"] or m["block"]
    rest = s[: m.start()] + " , " + s[m.end() :]
    if unit is None and (b := re.search(r"(?<![а-я-])(?:(?:корп(?:ус)?|к)\.?\s*\d+|лит(?:ера)?\.?\s*[а-я])(?![а-я])", rest)):
        unit, rest = b[0].split(".")[-1].split()[-1], rest[: b.start()] + " , " + rest[b.end() :]
    return m["no"].lstrip("0") or "0", unit, rest


def _street(s: str, town_known: bool) -> tuple[str | None, str | None, str]:
    """Sort and name of the street, and the text without them."""
    m = _KIND.search(s)
    word = re.compile(r"[а-я]{3,}")
    if m:
        kind = list(_KINDS)[ord(m.lastgroup) - 97]
        after, before = s[m.end() :], s[: m.start()]
        right = re.match(r"[.\s]*([а-я]{3,})", after)
        left = re.search(r"([а-я]{3,})\s*$", before)
        if right and left:  # neither is set apart by a comma: the one that looks like a street
            take_left = bool(_STREETISH.search(left[1])) and not _STREETISH.search(right[1])
            right, left = (None, left) if take_left else (right, None)
        if right:
            return kind, right[1], before + " , " + after[right.end() :]
        if left:
            return kind, left[1], before[: left.start()] + " , " + after.lstrip(".")
        s = before + " , " + after
    else:
        kind = None
    words = word.findall(s)
    street = next((w for w in words if _STREETISH.search(w) and not _TOWNISH.search(w)), None)
    if street is None and words:
        street = next((w for w in words if not _TOWNISH.search(w)), words[0] if town_known else None)
    return kind, street, s.replace(street, " ", 1) if street else s


@lru_cache(maxsize=100_000)
def parse(address: str | None) -> Address | None:
    """The parts of an address. None for a placeholder or no house number."""
    s = plain(address or "")
    if _NOT_USABLE.match(s):
        return None
    s = _NOISE.sub(" , ", s)
    postcode = m[0] if (m := _POSTCODE.search(s)) else None
    s = _POSTCODE.sub(" , ", s)
    region = None
    if m := _REGION.search(s):
        region = stem_gender(m[1])[0] + (" край" if m[2] == "край" else " обл")
        s = s[: m.start()] + " , " + s[m.end() :]
    town = None
    if m := _TOWN.search(s):
        town = m[1]
        s = s[: m.start()] + " , " + s[m.end() :]
    ordinal = None
    if m := _ORDINAL.search(s):
        ordinal = m[1] or _ORDINALS[m[2]]
        s = s[: m.start()] + " " + s[m.end() :]
    elif m := _BARE_ORDINAL.search(s):
        ordinal = m[1]
        s = s[: m.start(1)] + " " + s[m.end(1) :]
    house, unit, s = _house(s)
    kind, name, s = _street(" ".join(s.split()), town is not None)
    if name is None or house is None:
        return None
    if town is None:
        rest = [w for w in re.findall(r"[а-я]{4,}", s) if w not in ("город",)]
        town = next((w for w in rest if _TOWNISH.search(w)), rest[0] if rest else None)
    gender = stem_gender(name)[1]
    return Address(postcode, region, hard(town), kind, ordinal, hard(name), GENDER.get(kind, gender), house, unit)


def hard(word: str | None) -> str | None:
    """Without soft and hard signs, which transliteration leaves out."""
    return word and word.replace("ь", "").replace("ъ", "")


def townish_words(store_name: str | None) -> list[str]:
    """The words of a store's name that have the look of a town's name, in their order."""
    return [hard(w) for w in re.findall(r"[а-я]{4,}", plain(store_name or "")) if _TOWNISH.search(w)]
