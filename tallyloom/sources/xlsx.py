"""XLSX and XLSB workbooks without further libraries: a Spark data source that reads the first sheet, and a writer for small results."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.sources.xlsb import is_xlsb, xlsb_rows

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_TAG = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(reference: str) -> int:
    """0 for A1, 25 for Z9, 26 for AA3."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def first_sheet(book: zipfile.ZipFile) -> str:
    names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if not names:
        raise ValueError("no sheet")
    return names[0]


def rows_of(path: str) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text, read as a stream."""
    if not zipfile.is_zipfile(path):
        raise ValueError("not a workbook of the zip form; the older binary form (.xls) needs a library that is not installed")
    with zipfile.ZipFile(path) as book:
        if is_xlsb(book):
            yield from xlsb_rows(book)
            return
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, e in ET.iterparse(f):
                    if e.tag == _TAG + "si":
                        shared.append("".join(t.text or "" for t in e.iter(_TAG + "t")))
                        e.clear()
        with book.open(first_sheet(book)) as f:
            for _, e in ET.iterparse(f):
                if e.tag != _TAG + "row":
                    continue
                row: list[str | None] = []
                for c in e.iter(_TAG + "c"):
                    at = column_number(c.get("r")) if c.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    v = c.find("m:v", _NS)
                    if c.get("t") == "s" and v is not None:
                        row[at] = shared[int(v.text)]
                    elif c.get("t") == "inlineStr":
                        row[at] = "".join(t.text or "" for t in c.iter(_TAG + "t"))
                    elif v is not None:
                        row[at] = v.text
                yield row
                e.clear()


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").load(path)``: the first sheet, its first row as header, all columns as text. One workbook is one task."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        header = next(rows_of(self.options["path"]), [])
        seen: dict[str, int] = {}
        names = []
        for k, h in enumerate(header):
            name = (h or f"column_{k + 1}").strip()
            seen[name] = seen.get(name, 0) + 1
            names.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], len(schema))


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = rows_of(partition.value)
        next(rows, None)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


# Fixed values of the style: header fill 1F4E79 with white bold Arial 10, body Arial 10.
_STYLES = (
    '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font><sz val="10"/><name val="Arial"/></font>'
    '<font><b/><sz val="10"/><color rgb="FFFFFFFF"/><name val="Arial"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FF1F4E79"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="2"><xf fontId="0" fillId="0"/><xf fontId="1" fillId="2" applyFill="1" applyFont="1"/></cellXfs></styleSheet>'
)


def _cell(value, style: int) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c s="{style}"><v>{value}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(header: Sequence[str], rows: Sequence[Sequence]) -> str:
    widths = [min(max([len(str(h)), *(len(str(r[k])) for r in rows[:200] if r[k] is not None)]) + 3, 52) for k, h in enumerate(header)]
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    body = "".join(f"<row>{''.join(_cell(v, s) for v in r)}</row>" for s, r in [(1, header), *((0, r) for r in rows)])
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}">{view}<cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>'


def write_xlsx(path: str, sheets: dict[str, tuple[Sequence[str], Sequence[Sequence]]]) -> None:
    """A workbook of named sheets (header, rows): coloured header, first row frozen, widths by the first 200 rows."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>{parts}</Types>',
        )
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="s{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="st" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        for k, (header, rows) in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", _sheet(header, rows))
