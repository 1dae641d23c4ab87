"""Word, spreadsheet and presentation files as blocks, read from the XML in their archives with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: A block: page, kind, text, depth, table, row, column, rows, columns, and spans of text, formats and style.
Block = tuple[int, str, str, int, int | None, int | None, int | None, int | None, int | None, list[tuple[str, list[str], str]]]


def _parts(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def _styles(archive: zipfile.ZipFile) -> dict[str, tuple[str, str | None, dict[str, str]]]:
    """By id of a Word style: its name, the style that it is based on, and its own run properties."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    found = {}
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
        name, based = style.find(f"{_W}name"), style.find(f"{_W}basedOn")
        found[style.get(f"{_W}styleId", "")] = (name.get(f"{_W}val", "") if name is not None else "", based.get(f"{_W}val") if based is not None else None, _run_properties(style.find(f"{_W}rPr")))
    return found


def _run_properties(node: ElementTree.Element | None) -> dict[str, str]:
    out = {}
    for child in node if node is not None else []:
        tag = child.tag.removeprefix(_W)
        if tag in ("b", "i", "u", "strike"):
            out[tag] = "" if child.get(f"{_W}val", "1") in ("0", "false", "none") else "1"
        elif tag in ("color", "sz", "vertAlign"):
            out[tag] = child.get(f"{_W}val", "")
    return out


def _inherited(style: str | None, styles: dict) -> dict[str, str]:
    chain, seen = [], set()
    while style in styles and style not in seen:
        seen.add(style)
        chain.append(styles[style][2])
        style = styles[style][1]
    out: dict[str, str] = {}
    for own in reversed(chain):
        out |= own
    return out


def _word_spans(paragraph: ElementTree.Element, styles: dict, style: str | None) -> list[tuple[str, list[str], str]]:
    spans = []
    names = {"b": "bold", "i": "italic", "u": "underline", "strike": "strike"}
    for run in paragraph.iter(f"{_W}r"):
        text = "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in run)
        if not text:
            continue
        given = run.find(f"{_W}rPr")
        own = given.find(f"{_W}rStyle") if given is not None else None
        p = _inherited(style, styles) | (_inherited(own.get(f"{_W}val"), styles) if own is not None else {}) | _run_properties(given)
        formats = sorted([n for k, n in names.items() if p.get(k)] + [x for x in ("superscript", "subscript") if p.get("vertAlign") == x])
        css = "; ".join(x for x in (f"color: #{p['color']}" if re.fullmatch("[0-9A-Fa-f]{6}", p.get("color", "")) else "", f"font-size: {int(p['sz']) / 2}pt" if p.get("sz", "").isdigit() else "") if x)
        spans.append((text, formats, css))
    return spans


def word_blocks(content: bytes) -> Iterator[Block]:
    """Paragraphs and table cells of a Word file in order; a paragraph's and a run's styles are inherited."""
    archive = _parts(content)
    styles = _styles(archive)
    body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    tables = 0

    def paragraph(node: ElementTree.Element) -> tuple[str, int, list]:
        given = node.find(f"{_W}pPr")
        style = given.find(f"{_W}pStyle") if given is not None else None
        id_ = style.get(f"{_W}val") if style is not None else None
        name = styles.get(id_, (id_ or "", None, {}))[0].lower()
        listed = given.find(f"{_W}numPr") if given is not None else None
        level = listed.find(f"{_W}ilvl") if listed is not None else None
        heading = re.fullmatch(r"heading ?([1-6])", name)
        kind = f"heading{heading[1]}" if heading else "list_bullet" if listed is not None or name.startswith("list") else "quote" if "quote" in name else "body"
        return kind, int(level.get(f"{_W}val", "0")) + 1 if level is not None else 0, _word_spans(node, styles, id_)

    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            kind, depth, spans = paragraph(node)
            if text := "".join(s[0] for s in spans).strip():
                yield 0, kind, text, depth, None, None, None, None, None, spans
        elif node.tag == f"{_W}tbl":
            yield from _word_table(node, tables, paragraph)
            tables += 1


def _word_table(table: ElementTree.Element, number: int, paragraph) -> Iterator[Block]:
    cells, open_ = [], {}
    for r, row in enumerate(table.iter(f"{_W}tr")):
        c = 0
        for cell in row.findall(f"{_W}tc"):
            given = cell.find(f"{_W}tcPr")
            span = given.find(f"{_W}gridSpan") if given is not None else None
            merge = given.find(f"{_W}vMerge") if given is not None else None
            width = int(span.get(f"{_W}val", "1")) if span is not None else 1
            if merge is not None and merge.get(f"{_W}val") != "restart" and c in open_:
                open_[c][7] += 1
            else:
                spans = [s for p in cell.findall(f"{_W}p") for s in paragraph(p)[2]]
                cells.append([0, "cell", "".join(s[0] for s in spans).strip(), 0, number, r, c, 1, width, spans])
                open_.pop(c, None)
                if merge is not None:
                    open_[c] = cells[-1]
            c += width
    yield from map(tuple, cells)


def _place(reference: str) -> tuple[int, int]:
    """B3 to row 2, column 1."""
    letters, digits = re.fullmatch("([A-Z]+)([0-9]+)", reference).groups()
    column = 0
    for x in letters:
        column = 26 * column + ord(x) - 64
    return int(digits) - 1, column - 1


def sheet_blocks(content: bytes) -> Iterator[Block]:
    """Cells of a spreadsheet file; a sheet is a page with one table, and a merged range is its first cell."""
    archive = _parts(content)
    strings: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        strings = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    for page, sheet in enumerate(ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet")):
        target = links[sheet.get(_R)]
        root = ElementTree.fromstring(archive.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        merged, covered = {}, set()
        for given in root.iter(f"{_S}mergeCell"):
            (r0, c0), (r1, c1) = map(_place, given.get("ref", "A1:A1").split(":"))
            merged[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
            covered |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
        for cell in root.iter(f"{_S}c"):
            at = _place(cell.get("r", "A1"))
            value = cell.find(f"{_S}v")
            text = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if cell.get("t") == "inlineStr" else value.text or "" if value is not None else ""
            if cell.get("t") == "s" and text:
                text = strings[int(text)]
            if at not in covered and (text.strip() or at in merged):
                rows, columns = merged.get(at, (1, 1))
                yield page, "cell", text.strip(), 0, page, *at, rows, columns, [(text, [], "")]


def slide_blocks(content: bytes) -> Iterator[Block]:
    """Paragraphs and table cells of a presentation, a slide a page; the title is a heading."""
    archive = _parts(content)
    slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)), key=lambda n: int(re.sub("[^0-9]", "", n)))
    for page, name in enumerate(slides):
        root, tables = ElementTree.fromstring(archive.read(name)), 0
        inside = {id(p) for t in root.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
        titles = {id(p) for shape in root.iter() if any(x.tag.endswith("}ph") and x.get("type") in ("title", "ctrTitle") for x in shape.iter()) and shape.tag.endswith("}sp") for p in shape.iter(f"{_A}p")}
        for node in root.iter():
            if node.tag == f"{_A}p" and id(node) not in inside:
                if text := "".join(t.text or "" for t in node.iter(f"{_A}t")).strip():
                    given = node.find(f"{_A}pPr")
                    yield page, "heading1" if id(node) in titles else "body", text, int(given.get("lvl", "0")) if given is not None else 0, None, None, None, None, None, _slide_spans(node)
            elif node.tag == f"{_A}tbl":
                for r, row in enumerate(node.iter(f"{_A}tr")):
                    for c, cell in enumerate(row.findall(f"{_A}tc")):
                        if cell.get("hMerge") != "1" and cell.get("vMerge") != "1":
                            text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in cell.iter(f"{_A}p")).strip()
                            yield page, "cell", text, 0, tables, r, c, int(cell.get("rowSpan", "1")), int(cell.get("gridSpan", "1")), [s for p in cell.iter(f"{_A}p") for s in _slide_spans(p)]
                tables += 1


def _slide_spans(paragraph: ElementTree.Element) -> list[tuple[str, list[str], str]]:
    spans = []
    for run in paragraph.iter(f"{_A}r"):
        given, text = run.find(f"{_A}rPr"), "".join(t.text or "" for t in run.iter(f"{_A}t"))
        on = lambda k: given is not None and given.get(k) not in (None, "0", "none", "false", "noStrike")  # noqa: E731, B023
        size = given.get("sz", "") if given is not None else ""
        spans.append((text, sorted(n for k, n in (("b", "bold"), ("i", "italic"), ("u", "underline"), ("strike", "strike")) if on(k)), f"font-size: {int(size) / 100}pt" if size.isdigit() else ""))
    return spans
