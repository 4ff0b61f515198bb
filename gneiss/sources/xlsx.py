"""A small writer of Excel workbooks from the standard library."""

from __future__ import annotations

import math
import zipfile
from xml.sax.saxutils import escape

import pandas as pd

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v) -> str:
    if v is None or (isinstance(v, float) and not math.isfinite(v)) or v is pd.NaT:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def _sheet(frame: pd.DataFrame, scales: dict[str, tuple], bars: dict[str, tuple]) -> str:
    rows = [list(map(str, frame.columns)), *frame.itertuples(index=False, name=None)]
    width = [min(60, 2 + max((len(f"{r[i]:.4f}" if isinstance(r[i], float) else str(r[i])) for r in rows), default=8)) for i in range(len(frame.columns))]
    out = [f'{_HEAD}<worksheet xmlns="{_MAIN}"><cols>', *[f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(width)], "</cols><sheetData>"]
    if not width:
        out = [f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>']
    for k, row in enumerate(rows):
        out.append(f'<row r="{k + 1}">' + "".join(_cell(f"{column_name(i)}{k + 1}", v) for i, v in enumerate(row)) + "</row>")
    out.append("</sheetData>")
    at = {c: i for i, c in enumerate(frame.columns)}
    n, priority = len(rows), 1
    for name, points in scales.items():
        if name in at and n > 1:
            ref = f"{column_name(at[name])}2:{column_name(at[name])}{n}"
            out.append(f'<conditionalFormatting sqref="{ref}"><cfRule type="colorScale" priority="{priority}"><colorScale>' + "".join(f'<cfvo type="num" val="{v}"/>' for v, _ in points) + "".join(f'<color rgb="FF{c}"/>' for _, c in points) + "</colorScale></cfRule></conditionalFormatting>")
            priority += 1
    for name, (low, high, color) in bars.items():
        if name in at and n > 1:
            ref = f"{column_name(at[name])}2:{column_name(at[name])}{n}"
            out.append(f'<conditionalFormatting sqref="{ref}"><cfRule type="dataBar" priority="{priority}"><dataBar><cfvo type="num" val="{low}"/><cfvo type="num" val="{high}"/><color rgb="FF{color}"/></dataBar></cfRule></conditionalFormatting>')
            priority += 1
    return "".join([*out, "</worksheet>"])


def write_workbook(path: str, sheets: dict[str, tuple[pd.DataFrame, dict, dict]]) -> None:
    """Sheets of (table, colour scales by column, data bars by column)."""
    names = list(sheets)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names))) + "</Types>")
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", _sheet(*sheets[n]))
