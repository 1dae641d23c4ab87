"""HTML as rows: headings, paragraphs, list items, quotes, rules and table cells, with the formats of their spans.

A page is read tag by tag, in one pass over Arrow batches, without a shuffle. What a tag or a style attribute sets holds
for what is inside it. Scripts, styles and the head are left out; white space is collapsed. Null pages have no blocks.

Character references are read as browsers do: old names also without their semicolon (`&amp` is &). Pages with texts that
were cut within a reference can be read strictly: then only a whole reference is one, and any other & is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags by what they do (fixed values).
UNREAD = {"script", "style", "head", "noscript", "template"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "table", "tr", "td", "th", "hr", "pre", "article", "section", "header", "footer", "nav", "body", "html", "main", "aside", "form"}
FORMATS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "s": "strike", "del": "strike", "strike": "strike", "sup": "superscript", "sub": "subscript"}
EMPTY = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "source", "wbr"}

SPAN = "struct<text:string,formats:array<string>,style:string,link:string>"
COLUMNS = f"block int, kind string, text string, depth int, align string, tab int, row_ix int, col_ix int, rows int, cols int, spans array<{SPAN}>"
_NAMES = ["block", "kind", "text", "depth", "align", "tab", "row_ix", "col_ix", "rows", "cols", "spans"]


class Reader(HTMLParser):
    """Collects the blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.open: list[tuple[str, str | None, str, str | None]] = []  # tag, format, style, link
        self.unread = 0
        self.lists: list[str] = []
        self.quotes = self.tables = 0
        self.grid: list[list[int]] = []  # of each open table: number, row, next column
        self.taken: list[dict[int, int]] = []  # of each open table: columns that a cell above still covers, by rows left
        self.spans: list[dict] = []
        self.kind, self.align, self.cell = "body", None, (None, None, None, None, None)

    def _is_open(self, tag: str) -> bool:
        return any(t == tag for t, *_ in self.open)

    def flush(self) -> None:
        text = re.sub(r"[ \t\n\r\f]+", " ", "".join(s["text"] for s in self.spans)).strip(" ")
        if text:
            depth = len(self.lists) if self.kind.startswith("list") else self.quotes
            self.blocks.append((len(self.blocks), self.kind, text, depth, self.align, *self.cell, self.spans))
        self.spans = []

    def _within(self) -> None:
        """The kind of a block that no tag of its own names."""
        self.flush()
        self.kind = "quote" if self.quotes else "body"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in UNREAD:
            self.unread += 1
        if self.unread:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.handle_data("\n")
        elif tag == "hr":
            self.blocks.append((len(self.blocks), "rule", "---", 0, None, None, None, None, None, None, []))
        if tag in EMPTY:
            return
        if tag in ("ul", "ol"):
            self.lists.append(tag)
        elif tag == "li":
            self.kind = "list_number" if self.lists and self.lists[-1] == "ol" else "list_bullet"
        elif tag == "blockquote":
            self.quotes += 1
            self.kind = "quote"
        elif re.fullmatch("h[1-6]", tag):
            self.kind = f"heading{tag[1]}"
        elif tag == "pre":
            self.kind = "pre"
        elif tag == "table":
            self.grid.append([self.tables, -1, 0])
            self.taken.append({})
            self.tables += 1
        elif tag == "tr" and self.grid:
            self.grid[-1][1:] = [self.grid[-1][1] + 1, 0]
            self.taken[-1] = {c: n - 1 for c, n in self.taken[-1].items() if n > 1}
        elif tag in ("td", "th") and self.grid:
            self._begin_cell(tag, given)
        elif tag in ("p", "div") and not (self.kind.startswith(("list", "cell", "header")) and (self._is_open("li") or self.grid)):
            self.kind = "quote" if self.quotes else "body"
        style = given.get("style", "")
        align = re.search(r"text-align\s*:\s*(left|right|center|justify)", style)
        if tag in BLOCKS:
            self.align = align[1] if align else None
        self.open.append((tag, FORMATS.get(tag) or ("bold" if re.fullmatch("h[1-6]", tag) else None), style, given.get("href") if tag == "a" else None))

    def _begin_cell(self, tag: str, given: dict[str, str]) -> None:
        size = lambda name: int(given[name]) if given.get(name, "").isdigit() and int(given[name]) > 0 else 1
        table, row, col = self.grid[-1]
        while col in self.taken[-1]:
            col += 1
        rows, cols = size("rowspan"), size("colspan")
        if rows > 1:
            self.taken[-1] |= {c: rows for c in range(col, col + cols)}
        self.grid[-1][2] = col + cols
        self.kind, self.cell = ("header_cell" if tag == "th" else "cell"), (table, max(row, 0), col, rows, cols)

    def handle_endtag(self, tag: str) -> None:
        if tag in UNREAD:
            self.unread = max(0, self.unread - 1)
            return
        if self.unread:
            return
        if tag in BLOCKS:
            self._within() if not self.grid or tag in ("table", "td", "th") else self.flush()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "blockquote":
            self.quotes = max(0, self.quotes - 1)
            self.kind = "quote" if self.quotes else "body"
        elif tag == "table" and self.grid:
            self.grid.pop()
            self.taken.pop()
        if tag in ("table", "td", "th"):
            self.cell = (None, None, None, None, None)
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at]
                break

    def handle_data(self, data: str) -> None:
        if self.unread or not data:
            return
        formats = sorted({f for _, f, _, _ in self.open if f})
        style = "; ".join(s.strip().rstrip(";") for _, _, s, _ in self.open if s)
        link = next((x for *_, x in reversed(self.open) if x is not None), None)
        last = self.spans[-1] if self.spans else None
        if last and (last["formats"], last["style"], last["link"]) == (formats, style, link):
            last["text"] += data
        else:
            self.spans.append({"text": data, "formats": formats, "style": style, "link": link})


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")


def whole_references(html: str) -> str:
    """html with each & that begins no whole reference written as one."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", html)


def read(html: str | None, strict: bool = False) -> list[tuple]:
    reader = Reader()
    reader.feed(whole_references(html or "") if strict else html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def blocks(pages: DataFrame, id_: str, html: str, strict: bool = False) -> DataFrame:
    """A row for each block of each page, in order: kind, text, depth in lists or quotes, alignment, place in a table, spans.

    strict: only character references with their semicolon are read.

    Spans have their formats, the style texts of all tags around them (`text.css_value` reads a property), and their link.
    """
    kind = pages.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *b) for i, h in zip(batch[id_], batch[html], strict=True) for b in read(h, strict)]
            yield pd.DataFrame(rows, columns=[id_, *_NAMES]).astype({c: "Int32" for c in ("block", "depth", "tab", "row_ix", "col_ix", "rows", "cols")})

    return pages.select(id_, html).mapInPandas(run, f"{id_} {kind}, {COLUMNS}")


def _ordered(order: str, value: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]), between)


def rendered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """text, markdown, html and json of each group's blocks (kind and text) in order."""
    c = F.col
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    level = F.regexp_extract("kind", "^heading([1-6])$", 1)
    tag = F.when(level != "", F.concat(F.lit("h"), level)).when(c("kind").startswith("list"), "li").when(c("kind") == "quote", "blockquote").when(c("kind") == "pre", "pre").otherwise("p")
    mark = (
        F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "))).when(c("kind") == "list_bullet", "- ").when(c("kind") == "list_number", "1. ").when(c("kind") == "quote", "> ").otherwise("")
    )
    plain = F.when(c("kind") == "list_bullet", F.concat(F.lit("• "), "text")).otherwise(c("text"))
    page = F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))
    each = F.to_json(F.struct("kind", "text"))
    return rows.groupBy(*by).agg(
        _ordered(order, plain, "\n").alias("text"),
        _ordered(order, F.concat(mark, "text"), "\n\n").alias("markdown"),
        _ordered(order, page, "\n").alias("html"),
        F.concat(F.lit("["), _ordered(order, each, ","), F.lit("]")).alias("json"),
    )
