"""Small XLSX files on the driver: one sheet as a table, or a workbook's sheets and names (inline strings, no styles)."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from ..plans.formula import column_index, column_letters
from ..plans.rows import ROW

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MOST_ROWS = 1_048_576


#: Fixed values of the format.
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def write_xlsx(df: DataFrame, path: str) -> None:
    """A sheet of at most MOST_ROWS rows, in _row order."""
    write_workbook({"Sheet1": df}, path)


def _sheet_xml(df: DataFrame) -> str:
    cols = [c for c in df.columns if c != ROW]

    def cell(r: int, c: int, v) -> str:
        at = f'r="{column_letters(c)}{r}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v!r}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = ["<row>" + "".join(cell(1, i, c) for i, c in enumerate(cols)) + "</row>"]
    for n, row in enumerate(df.orderBy(ROW).select(*[f"`{c}`" for c in cols]).toLocalIterator()):
        if n + 2 > MOST_ROWS:
            raise ValueError("too many rows for a sheet")
        lines.append("<row>" + "".join(cell(n + 2, i, v) for i, v in enumerate(row)) + "</row>")
    return f'{HEAD}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def write_workbook(sheets: dict[str, DataFrame], path: str, names: dict[str, str] | None = None) -> None:
    """Sheets (with _row) in order, headers in their first rows, and workbook-wide names."""
    titles = list(sheets)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in range(1, len(titles) + 1))
    listed = "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1))
    defined = "".join(f"<definedName name={quoteattr(n)}>{escape(x)}</definedName>" for n, x in (names or {}).items())
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINKS}"><sheets>{listed}</sheets>' + (f"<definedNames>{defined}</definedNames>" if defined else "") + "</workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(titles) + 1)) + "</Relationships>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, HEAD + text)
        for i, t in enumerate(titles, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(sheets[t]))


def _listed(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part) in the workbook's order."""
    targets = {}
    for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        to = r.get("Target")
        targets[r.get("Id")] = to.lstrip("/") if to.startswith("/") else "xl/" + to
    return [(s.get("name"), targets[s.get(f"{{{LINKS}}}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(MAIN + "sheet")]


def read_workbook(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All sheets by name, in order, and the workbook-wide names."""
    with zipfile.ZipFile(path) as z:
        sheets = {name: _table(spark, z, part) for name, part in _listed(z)}
        names = {n.get("name"): n.text or "" for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(MAIN + "definedName") if n.get("localSheetId") is None}
    return sheets, names


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The workbook's first sheet: headers from its first row (made unique), formulas as their text, columns typed by content."""
    with zipfile.ZipFile(path) as z:
        return _table(spark, z, _listed(z)[0][1])


def _table(spark: SparkSession, z: zipfile.ZipFile, part: str) -> DataFrame:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(MAIN + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(MAIN + "si")]
    rows = [_cells(r, shared) for r in ElementTree.fromstring(z.read(part)).iter(MAIN + "row")]
    width = max([max(r, default=-1) + 1 for r in rows], default=0)
    heads: list[str] = []
    for i in range(width):
        name = str(rows[0].get(i) or f"column{i + 1}")
        # a name that was there before gets the number of its column
        heads.append(name if name.lower() not in {h.lower() for h in heads} else f"{name}_{i + 1}")
    from .paged import from_columns

    body = [[r.get(i) for i in range(width)] for r in rows[1:]]
    columns = {}
    for i, h in enumerate(heads):
        vals = [b[i] for b in body]
        kinds = {type(v) for v in vals if v is not None}
        columns[h] = vals if len(kinds) == 1 else [None if v is None else str(v) for v in vals]
    return from_columns(spark, columns)


def _cells(row, shared: list[str]) -> dict[int, object]:
    out: dict[int, object] = {}
    for n, c in enumerate(row.iter(MAIN + "c")):
        at = column_index(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else n
        kind, v, f = c.get("t"), c.find(MAIN + "v"), c.find(MAIN + "f")
        if f is not None and f.text:
            out[at] = "=" + f.text
        elif kind == "inlineStr":
            out[at] = "".join(t.text or "" for t in c.iter(MAIN + "t"))
        elif v is not None and v.text is not None:
            out[at] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e") else float(v.text)
    return out
