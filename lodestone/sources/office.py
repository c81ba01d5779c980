"""Office files by zipfile and XML alone: Word bodies, slides in order, sheets with cached values."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from .parsers import Event, table

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("DTDs and entities aren't taken")
    return ET.fromstring(data)


def _said(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    rels = _xml(z, f"{folder}/_rels/{name}.rels")
    return {r.get("Id"): f"{folder}/{r.get('Target')}" if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in rels}


def docx(data: bytes) -> Iterator[Event]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml").find(f"{W}body")
        for node in body:
            if node.tag == f"{W}p":
                style = node.find(f"{W}pPr/{W}pStyle")
                name = style.get(f"{W}val", "") if style is not None else ""
                text = _said(node, f"{W}t")
                if m := re.fullmatch(r"Heading(\d)", name):
                    yield "heading", text, {"level": int(m[1])}, {}
                elif name == "Title":
                    yield "heading", text, {"level": 1}, {}
                else:
                    kind = "list" if node.find(f"{W}pPr/{W}numPr") is not None else "paragraph"
                    yield kind, text, {}, {}
            elif node.tag == f"{W}tbl":
                rows = [[_said(c, f"{W}t") for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")]
                if rows:
                    yield table(rows[0], rows[1:], {})
        for name in z.namelist():
            if name.startswith("word/media/"):
                yield "figure", "", {"reference": name}, {}


def pptx(data: bytes) -> Iterator[Event]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        deck = _xml(z, "ppt/presentation.xml")
        to = _targets(z, "ppt/presentation.xml")
        ids = [n.get(f"{R}id") for n in deck.iter() if n.tag.endswith("}sldId")]
        for k, i in enumerate(ids, 1):
            for j, p in enumerate(_xml(z, to[i]).iter(f"{A}p")):
                if text := _said(p, f"{A}t"):
                    yield ("heading", text, {"level": 1}, {"slide": k}) if j == 0 else ("paragraph", text, {}, {"slide": k})


def column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def xlsx(data: bytes) -> Iterator[Event]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_said(x, f"{S}t") for x in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        to = _targets(z, "xl/workbook.xml")
        for sheet in _xml(z, "xl/workbook.xml").iter(f"{S}sheet"):
            root = _xml(z, to[sheet.get(f"{R}id")])
            grid: dict[int, dict[int, str]] = {}
            for c in root.iter(f"{S}c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                v = c.find(f"{S}v")
                kind = c.get("t")
                value = shared[int(v.text)] if kind == "s" and v is not None else _said(c, f"{S}t") if kind == "inlineStr" else v.text if v is not None else ""
                if m and value:
                    grid.setdefault(int(m[2]), {})[column(m[1])] = value
            if grid:
                width = max(max(r) for r in grid.values())
                numbers = sorted(grid)
                rows = [[grid[n].get(i, "") for i in range(1, width + 1)] for n in numbers]
                merged = [x.get("ref") for x in root.iter(f"{S}mergeCell")]
                yield "heading", sheet.get("name"), {"level": 1}, {"sheet": sheet.get("name")}
                yield table(rows[0], rows[1:], {"sheet": sheet.get("name"), "row_numbers": numbers[1:], "merged_ranges": merged})


OFFICE = {"docx": docx, "pptx": pptx, "xlsx": xlsx}
