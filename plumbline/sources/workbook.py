"""Workbooks (``.xlsx``) as a Spark data source: one partition per sheet, read with the standard library.

``spark.read.format("workbook").option("content", <base64>)`` reads an uploaded workbook; ``readers.read_xlsx`` takes the
content or a path on any storage that Spark reads. The first row with a cell is the header; rows without any cell are left out.
A column is boolean, whole, floating, a time or text by what all its cells are; anything mixed is text.
"""

from __future__ import annotations

import base64
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Number formats of the file format that show dates and times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """Sheets of one workbook held in memory; a sheet's rows are read as a stream."""

    def __init__(self, content: bytes):
        try:
            self.files = zipfile.ZipFile(io.BytesIO(content))
            book = ElementTree.fromstring(self.files.read("xl/workbook.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as problem:
            raise ValueError("not a workbook") from problem
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.files.read("xl/_rels/workbook.xml.rels"))}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(targets[s.get(_LINK)]) for s in book.iter(f"{_MAIN}sheet")}
        settings = book.find(f"{_MAIN}workbookPr")
        late = settings is not None and settings.get("date1904") in ("1", "true")
        self.zero = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        names = set(self.files.namelist())
        self.shared = self._shared() if "xl/sharedStrings.xml" in names else []
        self.dates = self._dates() if "xl/styles.xml" in names else set()

    @staticmethod
    def _text(node) -> str:
        """Text of a cell or string: its runs, without phonetic hints."""
        parts = [node.find(f"{_MAIN}t"), *[r.find(f"{_MAIN}t") for r in node.findall(f"{_MAIN}r")]]
        return "".join(p.text or "" for p in parts if p is not None)

    def _shared(self) -> list[str]:
        return [self._text(si) for si in ElementTree.fromstring(self.files.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]

    def _dates(self) -> set[int]:
        """Cell styles that show a date."""
        styles = ElementTree.fromstring(self.files.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search("[ymdhs]", _QUOTED.sub("", f.get("formatCode", "")), re.I)}
        cells = styles.find(f"{_MAIN}cellXfs")
        return {n for n, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in own | _DATE_FORMATS}

    def _value(self, cell):
        kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = cell.find(f"{_MAIN}is")
            return self._text(inline) if inline is not None else None
        if value is None or value.text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(value.text)]
        if kind == "str":
            return value.text
        if kind == "b":
            return value.text == "1"
        if kind == "d":
            return datetime.fromisoformat(value.text.replace("Z", ""))
        number = float(value.text)
        if int(cell.get("s", 0)) in self.dates:
            return self.zero + timedelta(milliseconds=round(number * 86_400_000))
        return int(number) if number.is_integer() and abs(number) < 2**53 else number

    def rows(self, sheet: str) -> Iterator[dict[int, object]]:
        """Cells by column number, row by row; only one row is held."""
        with self.files.open(self.sheets[sheet]) as body:
            for _, row in ElementTree.iterparse(body):
                if row.tag == f"{_MAIN}row":
                    cells, at = {}, -1
                    for cell in row.findall(f"{_MAIN}c"):
                        at = _column(cell.get("r")) if cell.get("r") else at + 1
                        value = self._value(cell)
                        if value is not None and value != "":
                            cells[at] = value
                    row.clear()
                    if cells:
                        yield cells

    def header(self, sheet: str) -> dict[int, str]:
        """Column numbers and names: the first row with a cell, names made unique."""
        first, names, taken = next(self.rows(sheet), {}), {}, set()
        for at in sorted(first):
            name = stem = str(first[at]).strip() or f"column_{at + 1}"
            n = 1
            while name in taken:
                name, n = f"{stem}.{n}", n + 1
            taken.add(name)
            names[at] = name
        return names


def _merged(a: str | None, b: str) -> str:
    return b if a in (None, b) else "double" if {a, b} == {"long", "double"} else "string"


_KINDS = {bool: "boolean", int: "long", float: "double", datetime: "timestamp", str: "string"}
_TYPES = {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampNTZType(), "string": T.StringType()}


def _as(kind: str, value):
    if value is None or kind in ("boolean", "long", "timestamp"):
        return value
    if kind == "double":
        return float(value)
    return value if isinstance(value, str) else value.isoformat(" ") if isinstance(value, datetime) else str(value)


class WorkbookSource(DataSource):
    """Options: ``content`` (base64), ``sheet`` (a name; all sheets by default, which must then have one header)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _book(self) -> tuple[Workbook, list[str]]:
        book = Workbook(base64.b64decode(self.options["content"]))
        wanted = [self.options["sheet"]] if "sheet" in self.options else list(book.sheets)
        if not set(wanted) <= set(book.sheets):
            raise ValueError(f"no sheet {wanted[0]!r}")
        return book, [s for s in wanted if book.header(s)]

    def schema(self) -> T.StructType:
        book, sheets = self._book()
        if not sheets:
            raise ValueError("the workbook has no rows")
        names = list(book.header(sheets[0]).values())
        kinds: dict[str, str] = {}
        for sheet in sheets:
            header = book.header(sheet)
            if sorted(header.values()) != sorted(names):
                raise ValueError(f"sheet {sheet!r} has other columns than {sheets[0]!r}; name one")
            rows = book.rows(sheet)
            next(rows)
            for row in rows:
                for at, value in row.items():
                    if at in header:
                        kinds[header[at]] = _merged(kinds.get(header[at]), _KINDS[type(value)])
        return T.StructType([T.StructField(n, _TYPES[kinds.get(n, "string")]) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Sheets(self.options["content"], self._book()[1], schema)


class _Sheet(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Sheets(DataSourceReader):
    def __init__(self, content: str, sheets: list[str], schema: T.StructType):
        self.content, self.sheets = content, sheets
        self.columns = [(f.name, next(k for k, t in _TYPES.items() if t == f.dataType)) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(s) for s in self.sheets]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        book = Workbook(base64.b64decode(self.content))
        at = {name: n for n, name in book.header(partition.name).items()}
        rows = book.rows(partition.name)
        next(rows, None)
        for row in rows:
            yield tuple(_as(kind, row.get(at[name])) for name, kind in self.columns)


# ---------------------------------------------------------------- writing


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, datetime):
        days = (value - datetime(1899, 12, 30)) / timedelta(days=1)
        return f'<c s="1"><v>{days!r}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook_bytes(sheets: dict[str, tuple[list[str], Iterator]]) -> bytes:
    """A workbook of ``{sheet: (column names, rows)}``; rows may be an iterator and are written as they come."""
    main, links = _MAIN[1:-1], "http://schemas.openxmlformats.org/package/2006/relationships"
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as files:
        numbers = range(1, len(sheets) + 1)
        files.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                       '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                       f'<Override PartName="/xl/workbook.xml" ContentType="{parts}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{parts}.styles+xml"/>'
                       + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{parts}.worksheet+xml"/>' for n in numbers) + "</Types>")
        files.writestr("_rels/.rels", f'<Relationships xmlns="{links}"><Relationship Id="r1" Type="{kinds}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        files.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts><font/></fonts><fills><fill/></fills><borders><border/></borders>'
                       '<cellStyleXfs><xf/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        files.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{links}">' + "".join(
            f'<Relationship Id="r{n}" Type="{kinds}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
            + f'<Relationship Id="styles" Type="{kinds}/styles" Target="styles.xml"/></Relationships>')
        files.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{kinds}"><sheets>' + "".join(
            f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{n}" r:id="r{n}"/>' for n, name in zip(numbers, sheets)) + "</sheets></workbook>")
        for n, (columns, rows) in zip(numbers, sheets.values()):
            with files.open(f"xl/worksheets/sheet{n}.xml", "w") as body:
                body.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for row in [columns]:
                    body.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                for row in rows:
                    body.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                body.write(b"</sheetData></worksheet>")
    return out.getvalue()
