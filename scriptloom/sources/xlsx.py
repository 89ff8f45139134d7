"""Workbooks without a library: a ZIP of XML parts, read and written with what Python has (survey S10, F8, F12, F17, T3).

Only what tables of text need: cells of strings and numbers; formulas give their stored value, styles are ignored.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Rows that a sheet may have by the format.
MOST_ROWS = 1 << 20
#: Characters that XML can't hold are written as ``_xHHHH_``, and so is an underscore that would read as one.
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNSAFE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\r]|_(?=x[0-9A-Fa-f]{4}_)")


def column_name(n: int) -> str:
    """A, B, ... Z, AA for 0, 1, ... 25, 26."""
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_number(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(ref: str, value) -> str:
    text = escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value)))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """The bytes of a workbook of named sheets, each a list of rows; None is an empty cell."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + text, zipfile.ZIP_DEFLATED)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        put("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, name in enumerate(sheets, 1))
        put("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            if len(rows) > MOST_ROWS:
                raise ValueError("too many rows for one sheet")
            lines = [f'<row r="{n}">' + "".join(_cell(f"{column_name(c)}{n}", v) for c, v in enumerate(row) if v is not None) + "</row>" for n, row in enumerate(rows, 1)]
            put(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def read_workbook(data: bytes) -> dict[str, list[list[str]]]:
    """Sheets by name, in order: rows of texts; missing cells and rows are empty."""
    tag = lambda name: f"{{{_MAIN}}}{name}"
    text_of = lambda node: _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in node.iter(tag("t"))))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [text_of(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(tag("sheet")):
            path = targets[sheet.get(f"{{{_REL}}}id")]
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(path.lstrip("/") if path.startswith("/") else f"xl/{path}")).iter(tag("row")):
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - len(rows))]
                for cell in row.iter(tag("c")):
                    at = column_number(re.match("[A-Z]+", cell.get("r"))[0]) if cell.get("r") else len(rows[-1])
                    rows[-1] += [""] * (at + 1 - len(rows[-1]))
                    value = cell.find(tag("v"))
                    kind = cell.get("t")
                    rows[-1][at] = text_of(cell) if kind == "inlineStr" else "" if value is None else shared[int(value.text)] if kind == "s" else value.text or ""
            out[sheet.get("name")] = rows
    return out
