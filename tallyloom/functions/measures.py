"""Quantities in text: a grammar of numbers, units and multipliers, and units as scaled exponent vectors.

A unit is a vector of exponents over BASES with a scale and an offset to the canonical unit of that vector. Products and quotients of
units add and subtract vectors; a sum, a comparison or a conversion needs equal vectors. A millilitre is a cubic centimetre, so volume is
the third power of length and ``g/l`` a mass by the third power of length.

Grammar, over the tokens of a text (words that are no unit separate quantities):

    sum      := quantity { ("+" quantity) | smaller quantity of the same vector }      500 мл + 250 мл, 20 lb 4 oz
    quantity := number [unit] | "№" number                                             1 000 мл, 1 1/2 кг, 0,5 л, №60
    unit     := power { ("/" | "·" | "*") power }                                      г/л, kg/m^3
    power    := WORD [ "^" n | "²" | "³" ]                                             см²
    chain    := (sum | number) { ("x" | "*" | "по") (sum | number) }                   2х400 мл, 6 шт по 450 мл
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

#: Base dimensions.
BASES = ("cm", "g", "pcs", "s", "degC")


@dataclass(frozen=True)
class Unit:
    """value in canonical units = value * scale + offset"""

    exponents: tuple[int, ...]
    scale: float
    offset: float = 0.0

    def base(self) -> str | None:
        """The name of the canonical unit, None for a vector without a name."""
        return CANONICAL.get(self.exponents)

    def __mul__(self, other: Unit) -> Unit:
        if self.offset or other.offset:
            raise ValueError("a unit with an offset has no products")
        return Unit(tuple(a + b for a, b in zip(self.exponents, other.exponents)), self.scale * other.scale)

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def __pow__(self, n: int) -> Unit:
        if self.offset:
            raise ValueError("a unit with an offset has no powers")
        return Unit(tuple(a * n for a in self.exponents), self.scale**n)

    def converts(self, other: Unit) -> bool:
        return self.exponents == other.exponents


@dataclass(frozen=True)
class Quantity:
    """A value in the canonical unit of its vector; the zero vector is a plain number."""

    value: float
    exponents: tuple[int, ...]

    def base(self) -> str | None:
        return CANONICAL.get(self.exponents)

    def __add__(self, other: Quantity) -> Quantity:
        if self.exponents != other.exponents:
            raise ValueError("quantities of different vectors have no sum")
        return Quantity(self.value + other.value, self.exponents)

    def __mul__(self, other: Quantity) -> Quantity:
        return Quantity(self.value * other.value, tuple(a + b for a, b in zip(self.exponents, other.exponents)))

    def to(self, unit: Unit) -> float:
        if self.exponents != unit.exponents:
            raise ValueError("not convertible")
        return (self.value - unit.offset) / unit.scale


def _vector(**powers: int) -> tuple[int, ...]:
    return tuple(powers.get(b, 0) for b in BASES)


NUMBER = _vector()
CANONICAL = {
    NUMBER: "1", _vector(cm=1): "cm", _vector(cm=2): "cm2", _vector(cm=3): "ml", _vector(g=1): "g", _vector(pcs=1): "pcs", _vector(s=1): "s", _vector(degC=1): "degC",
    _vector(g=1, cm=-3): "g/ml", _vector(g=1, cm=-2): "g/cm2", _vector(g=1, pcs=-1): "g/pcs", _vector(cm=3, pcs=-1): "ml/pcs",
}
_ML, _G, _PCS, _CM, _S, _C = (_vector(**p) for p in ({"cm": 3}, {"g": 1}, {"pcs": 1}, {"cm": 1}, {"s": 1}, {"degC": 1}))

# Spellings of units and their size in the canonical unit.
_SPELLINGS = [
    (("мл", "ml", "миллилитр", "миллилитра", "миллилитров"), Unit(_ML, 1)),
    (("cl", "сл", "cл", "сl"), Unit(_ML, 10)),
    (("dl", "дл"), Unit(_ML, 100)),
    (("л", "l", "литр", "литра", "литров", "liter", "litre", "лит"), Unit(_ML, 1000)),
    (("floz",), Unit(_ML, 29.5735295625)),
    (("мг", "mg"), Unit(_G, 0.001)),
    (("г", "g", "гр", "gr", "грамм", "грамма", "граммов", "gram"), Unit(_G, 1)),
    (("кг", "kg", "килограмм", "килограмма", "килограммов"), Unit(_G, 1000)),
    (("oz", "унц", "унция", "унции", "унций"), Unit(_G, 28.349523125)),
    (("lb", "lbs", "фунт", "фунта", "фунтов"), Unit(_G, 453.59237)),
    (("шт", "штук", "штука", "штуки", "pcs", "pc", "piece", "pieces", "упак/шт", "уп/шт"), Unit(_PCS, 1)),
    (("дюж", "дюжина", "дюжины", "дюжин", "dozen", "doz"), Unit(_PCS, 12)),
    (("мм", "mm"), Unit(_CM, 0.1)),
    (("см", "cm"), Unit(_CM, 1)),
    (("м", "m", "метр", "метра", "метров", "meter", "metre"), Unit(_CM, 100)),
    (("дюйм", "дюйма", "дюймов", "inch"), Unit(_CM, 2.54)),
    (("сек", "sec"), Unit(_S, 1)),
    (("мин", "min"), Unit(_S, 60)),
    (("час", "часа", "часов", "hour", "hours"), Unit(_S, 3600)),
    (("°c", "°с", "degc"), Unit(_C, 1)),
    (("°f", "degf"), Unit(_C, 5 / 9, -160 / 9)),
    (("k", "кельвин"), Unit(_C, 1, -273.15)),
]
UNITS = {s: u for spellings, u in _SPELLINGS for s in spellings}

#: In running text a single k is a letter, and a single m a size unless it has a power.
_WORDS = "|".join(sorted((re.escape(u) for u in UNITS if u not in ("k", "m")), key=len, reverse=True)) + r"|m(?=\s*\^|[²³])"
# parts of a name that hold numbers but no content
NOISE = re.compile(
    r"(?:\([^()]*\))?\s*:\s*\d+(?:/\d+)*\s*$|\bph\s*\d+(?:[.,]\d+)?|\bарт\.?\s*\d+|№\s*1\s+выбор|[-+]?\d+\s*%|\b\d+\s*в\s*\d+\b|"
    r"\b\d+\s*ч\b|[xх×]\s*2\s+эффект|\b\d+\s*-?\s*(?:сло[йяе]\w*|слойн\w*|ply)\b"
)
_POWERS = {"²": 2, "³": 3}
_TOKEN = re.compile(
    rf"(?P<unit>(?<![a-zа-я])(?:fl\.?\s*oz|{_WORDS})(?![a-zа-я]))(?:(?P<power>\s*\^\s*-?\d|[²³]))?"
    r"|(?P<times>[*×·]|(?<![a-zа-я])[xх](?![a-zа-я])|(?<![a-zа-я])по(?![a-zа-я]))|(?P<over>/)|(?P<plus>\+)|(?P<count>№)"
    r"|(?P<number>(?<!\w)(?:\d{1,3}(?:[   ]\d{3})+(?=[.,]\d|\s*[a-zа-я°])|\d+\s+\d+/\d+|\d+/\d+(?=\s*[a-zа-я°])|\d+)(?:[.,]\d+)?"
    r"|(?<=[xх×*])\d+(?:[.,]\d+)?|(?<![\d.,])\d+(?:[.,]\d+)?)"
    r"|(?P<gap>[\s.]+)|(?P<word>[^\W\d_]+|.)"
)


def number(text: str) -> float:
    """A whole, decimal, grouped (``1 000``) or mixed (``1 1/2``) number."""
    s = text.replace(" ", " ").replace(" ", " ").replace(",", ".").strip()
    if "/" in s:
        *whole, fraction = s.split()
        a, b = fraction.split("/")
        return float(whole[0] if whole else 0) + (float(a) / float(b) if float(b) else 0.0)
    return float(s.replace(" ", ""))


def lookup(word: str | None) -> Unit | None:
    """The unit of a spelling; case, dots and outer spaces aside."""
    w = re.sub(r"[\s.]+", "", (word or "").lower())
    return UNITS.get(w)


class Token(NamedTuple):
    """A number (``n``), unit (``u``), multiplication (``x``), division (``/``), plus (``+``), number sign (``#``) or word (``w``)."""

    sort: str
    value: float = 0.0
    unit: Unit | None = None
    glued: bool = False


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    glued = False  # nothing stands between this token and the one before
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup != "power" else "unit"
        if kind == "gap":
            glued = False
            continue
        if kind == "unit":
            n = m["power"]
            u = lookup(m["unit"])
            out.append(Token("u", 0.0, u if not n else u ** (_POWERS.get(n) or int(n.replace("^", ""))), glued))
        elif kind == "number":
            out.append(Token("n", number(m["number"]), None, glued))
        else:
            out.append(Token({"times": "x", "over": "/", "plus": "+", "count": "#", "word": "w"}[kind], 0.0, None, glued))
        glued = True
    return out


class Parser:
    """Recursive descent over the tokens of one text."""

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def sort(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k].sort if k < len(self.tokens) else ""

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def unit(self) -> Unit | None:
        """Units joined by division or multiplication without spaces."""
        if self.sort() != "u":
            return None
        u = self.take().unit
        while self.sort() in ("/", "x") and self.sort(1) == "u" and self.tokens[self.at].glued and self.tokens[self.at + 1].glued:
            over = self.take().sort == "/"
            v = self.take().unit
            u = u / v if over else u * v
        return u

    def quantity(self) -> Quantity | None:
        if self.sort() == "#" and self.sort(1) == "n":
            self.at += 1
            return Quantity(self.take().value, _PCS)
        if self.sort() != "n":
            return None
        n = self.take().value
        u = self.unit()
        return Quantity(n, NUMBER) if u is None else Quantity(n * u.scale + u.offset, u.exponents)

    def sum(self) -> tuple[Quantity, float] | None:
        """The sum and the size of one unit of its last part, which a smaller part that follows without a sign must stay under."""
        begun = self.at
        q = self.quantity()
        if q is None:
            return None
        step = self.step(begun)
        while True:
            back = self.at
            if self.sort() == "+":
                self.at += 1
                more = self.quantity()
                if more is not None and q.exponents == NUMBER != more.exponents and more.base() == "pcs":
                    q = Quantity(q.value, more.exponents)  # 5+1 шт
                if more is None or more.exponents != q.exponents:
                    self.at = back
                    return q, step
            elif self.sort() == "n":
                more = self.quantity()
                if more is None or q.exponents == NUMBER or more.base() in (None, "pcs") or more.exponents != q.exponents or not 0 < more.value < step:
                    self.at = back
                    return q, step
            else:
                return q, step
            q, step = q + more, self.step(back)

    def step(self, begun: int) -> float:
        units = [t.unit.scale for t in self.tokens[begun : self.at] if t.unit is not None]
        return units[-1] if units else 0.0

    def items(self) -> list[Quantity | str]:
        """The quantities of a text with the multiplication signs between them; words are left out."""
        out: list[Quantity | str] = []
        while self.at < len(self.tokens):
            got = self.sum()
            if got is not None:
                out.append(got[0])
            elif self.take().sort == "x":
                out.append("x")
        return out


def quantity_of(text: str | None) -> Quantity | None:
    """The quantity that a whole text denotes, such as ``20 lb 4 oz``, ``5 г/л`` or ``10 см x 5 см``; None if it is anything else."""
    p = Parser((text or "").lower().replace("ё", "е"))
    factors = []
    while (got := p.sum()) is not None:
        factors.append(got[0])
        if p.at == len(p.tokens):
            return reduce(Quantity.__mul__, factors)
        if p.take().sort != "x":
            return None
    return None


def convert(text: str | None, unit: str) -> float | None:
    """The value of a text in a unit; None where the text is no quantity or has another vector."""
    q, u = quantity_of(text), lookup(unit)
    return q.to(u) if q is not None and u is not None and q.exponents == u.exponents else None


@dataclass(frozen=True)
class Content:
    """What a text states: size of one piece in a base unit, and the number of pieces (each None if not stated)."""

    size: float | None = None
    base: str | None = None
    pieces: float | None = None
    pieces_factor: float = 1.0


#: Vectors that a content may have: plain numbers, sizes, counts, and sizes of a piece.
_CONTENTS = ("1", "ml", "g", "pcs", "g/pcs", "ml/pcs")


def chains(items: list[Quantity | str]) -> list[list[Quantity]]:
    """Quantities in runs joined by multiplication signs; a sign without a quantity on one side joins nothing but marks the run (None)."""
    out: list[list[Quantity | None]] = []
    joined = False
    for i in items:
        if i == "x":
            if not joined and out:
                out[-1].append(None)
            elif not out:
                out.append([None])
            joined = True
        elif joined:
            out[-1].append(i)
            joined = False
        else:
            out.append([i])
    return out


def parse_content(text: str | None, layers: bool = False) -> Content:
    """Reads sizes, counts and multipliers of a name such as ``6 шт по 450мл``, ``2х400 мл``, ``75 гр*3``, ``№60``, ``5 дюж.``.

    ``layers``: ``2 сл`` means layers (paper), not centilitres. Null or empty text states nothing. Of several sizes the first holds; counts
    multiply, and whole plain numbers multiply where a multiplication sign stands beside them, however large. A run with a length, an area, a time or a
    concentration in it is a measurement of another sort and no content.
    """
    s = NOISE.sub(" ", (text or "").lower().replace("ё", "е"))
    if layers:
        s = re.sub(r"\d+\s*-?\s*сл\b\.?", " ", s)
    size = base = pieces = None
    factor = 1.0
    for chain in chains(Parser(s).items()):
        some = [q for q in chain if q is not None]
        if any(q.base() not in _CONTENTS for q in some):
            continue
        times = len(chain) > 1
        for q in some:
            if q.value <= 0:
                continue
            if q.exponents == NUMBER:
                if times and q.value == int(q.value):
                    factor *= q.value
            elif q.base() == "pcs":
                if pieces is None:
                    pieces = q.value
                elif times:
                    factor *= q.value
            elif size is None:
                size, base = q.value, q.base().removesuffix("/pcs")
    return Content(size, base, pieces, factor)
