"""Binary workbooks (XLSB, the BIFF12 records of the public [MS-XLSB] specification): rows of the first sheet as text, on the standard library."""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

# Numbers of the record types that hold rows, cells and shared texts.
ROW, BLANK, RK, ERROR, BOOL, REAL, TEXT, SHARED = 0, 1, 2, 3, 4, 5, 6, 7
FORMULA_TEXT, FORMULA_REAL, FORMULA_BOOL, FORMULA_ERROR = 8, 9, 10, 11
SHARED_ITEM = 19
_CELLS = range(BLANK, FORMULA_ERROR + 1)


def records(f: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(type, body) of each record: a type of one or two bytes and a length of up to four, seven bits in each."""

    def number(most: int) -> int | None:
        n = 0
        for k in range(most):
            b = f.read(1)
            if not b:
                return None
            n |= (b[0] & 0x7F) << 7 * k
            if b[0] < 0x80:
                break
        return n

    while True:
        first = f.read(1)
        if not first:
            return
        kind = first[0]
        if kind & 0x80:
            second = f.read(1)
            kind = (kind & 0x7F) | ((second[0] & 0x7F) << 7)
        size = number(4)
        if size is None:
            return
        yield kind, f.read(size)


def wide_text(body: bytes, at: int) -> str:
    """A text with its length in UTF-16 units before it."""
    (n,) = struct.unpack_from("<I", body, at)
    return body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", errors="replace")


def rk_number(raw: int) -> float:
    """A number of 30 bits: whole or the upper part of a double, perhaps in hundredths."""
    if raw & 2:
        value = float((raw >> 2) - (1 << 30) if raw & 0x80000000 else raw >> 2)
    else:
        (value,) = struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))
    return value / 100 if raw & 1 else value


def plain(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def cell_text(kind: int, body: bytes, shared: list[str]) -> str | None:
    """The value behind a cell's column and style (eight bytes); null for blanks and errors."""
    if kind == RK:
        return plain(rk_number(struct.unpack_from("<I", body, 8)[0]))
    if kind in (REAL, FORMULA_REAL):
        return plain(struct.unpack_from("<d", body, 8)[0])
    if kind in (TEXT, FORMULA_TEXT):
        return wide_text(body, 8)
    if kind == SHARED:
        return shared[struct.unpack_from("<I", body, 8)[0]]
    if kind in (BOOL, FORMULA_BOOL):
        return str(body[8])
    return None


def is_xlsb(book: zipfile.ZipFile) -> bool:
    return "xl/workbook.bin" in book.namelist()


def xlsb_rows(book: zipfile.ZipFile) -> Iterator[list[str | None]]:
    """Rows of the first sheet, read as a stream; rows without a record are not there, as in the text form of a workbook."""
    names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.bin", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if not names:
        raise ValueError("no sheet")
    shared: list[str] = []
    if "xl/sharedStrings.bin" in book.namelist():
        with book.open("xl/sharedStrings.bin") as f:
            shared = [wide_text(body, 1) for kind, body in records(f) if kind == SHARED_ITEM]
    row: list[str | None] | None = None
    with book.open(names[0]) as f:
        for kind, body in records(f):
            if kind == ROW and len(body) >= 8:
                if row is not None:
                    yield row
                row = []
            elif kind in _CELLS and row is not None and len(body) >= 8:
                (at,) = struct.unpack_from("<I", body, 0)
                row += [None] * (at + 1 - len(row))
                row[at] = cell_text(kind, body, shared)
    if row is not None:
        yield row
