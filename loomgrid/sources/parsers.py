"""Files of any format as blocks: one plug point for parsers, with one output schema.

A parser takes a file's bytes and yields blocks. Those for text, HTML, Word, spreadsheets and presentations are here; one for
another format (PDF, scanned pages, a service) is added by `register` and needs nothing else. A file is one row and is
parsed in one task; a file that its parser cannot read is one row with the error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loomgrid.operators import html
from loomgrid.sources import office
from loomgrid.sources.stores import read_binaries

Parser = Callable[[bytes], Iterator[tuple]]

SPAN = "struct<text:string,formats:array<string>,style:string>"
#: What every parser's blocks become. page counts from 0; table, row_ix and col_ix are set in tables only.
SCHEMA = f"path string, page int, block int, kind string, text string, depth int, tab int, row_ix int, col_ix int, rows int, cols int, spans array<{SPAN}>, error string"
_NAMES = ["path", "page", "block", "kind", "text", "depth", "tab", "row_ix", "col_ix", "rows", "cols", "spans", "error"]


def _text_blocks(content: bytes) -> Iterator[tuple]:
    for page, body in enumerate(content.decode("utf-8", "replace").split("\f")):
        for line in body.splitlines():
            if line.strip():
                yield page, "body", line.strip(), 0, None, None, None, None, None, [(line, [], "")]


def _html_blocks(content: bytes) -> Iterator[tuple]:
    for _, kind, text, depth, _, *place, spans in html.read(content.decode("utf-8", "replace")):
        yield 0, kind, text, depth, *place, [(s["text"], s["formats"], s["style"]) for s in spans]


_PARSERS: dict[str, Parser] = {"txt": _text_blocks, "html": _html_blocks, "htm": _html_blocks, "docx": office.word_blocks, "xlsx": office.sheet_blocks, "pptx": office.slide_blocks}


def register(extension: str, parser: Parser) -> None:
    """Files that end so are parsed by it from now on. It is sent to the workers with each query."""
    _PARSERS[extension.lower().lstrip(".")] = parser


def formats() -> list[str]:
    return sorted(_PARSERS)


def parse(files: DataFrame, page_range: tuple[int, int] | None = None) -> DataFrame:
    """Blocks of files (path, content) by the parser of each one's extension; of the pages in the range (both ends) if one is given."""
    parsers = dict(_PARSERS)

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        extension = path.rsplit(".", 1)[-1].lower()
        try:
            if extension not in parsers:
                raise ValueError(f"no parser for {extension}")
            found = list(parsers[extension](content))
        except Exception as e:  # a broken file must not end the others' parsing
            yield path, None, None, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for i, (page, kind, text, depth, tab, row, column, n_rows, n_columns, spans) in enumerate(found):
            if page_range is None or page_range[0] <= page <= page_range[1]:
                yield path, page, i, kind, text, depth, tab, row, column, n_rows, n_columns, [{"text": t, "formats": f, "style": s} for t, f, s in spans], None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = pd.DataFrame(list(rows_of(path, bytes(content))), columns=_NAMES)
                yield found.astype({c: "Int32" for c in ("page", "block", "depth", "tab", "row_ix", "col_ix", "rows", "cols")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, pattern: str = "*", page_range: tuple[int, int] | None = None) -> DataFrame:
    return parse(read_binaries(spark, path, pattern), page_range)
