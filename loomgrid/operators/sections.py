"""Contents of sections on pages: clipping by height, page furniture, paragraphs as HTML, lookups by number and title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions import text as T
from loomgrid.operators.intervals import contained

#: Lines that are page furniture (fixed patterns).
CHROME = r"(?i)^page [0-9]+|^confidential$|^[0-9]{1,4}$|^pf-[0-9]+|^protocol [a-z]|^\(continued\)$|^table [a-z0-9_]+ \(continued\)|^continued from"
SLACK = 2


def clipped_lines(lines: DataFrame, sections: DataFrame, width: int = 16) -> DataFrame:
    """The lines of each section: from its start (page and y) to its end, both less SLACK, without blank lines and furniture.

    lines: doc_id, page, y, line; sections: doc_id, number, page, start_y, end_page, end_y. Pages between are taken whole.
    """
    ends = sections.select("doc_id", "number", F.col("page").alias("first_page"), "start_y", "end_page", "end_y")
    rows = contained(lines, ends, ["doc_id"], "page", "first_page", "end_page", width)
    after = (F.col("page") > F.col("first_page")) | (F.col("y") >= F.col("start_y") - SLACK)
    before = (F.col("page") < F.col("end_page")) | F.col("end_y").isNull() | (F.col("y") <= F.col("end_y") - SLACK)
    kept = rows.where(after & before).withColumn("line", F.trim("line"))
    return kept.where((F.col("line") != "") & ~F.col("line").rlike(CHROME)).select("doc_id", "number", "page", "y", "line")


def section_html(lines: DataFrame) -> DataFrame:
    """HTML of each section's clipped lines in reading order: headings, list items and paragraphs, with linked references."""
    style = T.line_style(F.col("line"))
    body = T.auto_link(T.escape_html(T.line_text(F.col("line"))))
    tag = F.when(style.startswith("heading"), F.concat(F.lit("h"), F.right(style, F.lit(1)))).when(style.startswith("list"), "li").otherwise("p")
    piece = F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "y", piece.alias("v"))))
    return lines.groupBy("doc_id", "number").agg(F.array_join(F.transform(ordered, lambda s: s["v"]), "\n").alias("html"))


def find_sections(sections: DataFrame, number: Column | None = None, title: Column | None = None) -> DataFrame:
    """Sections with the number, or whose title has the text in any case; the first by page and number of each document."""
    hit = (F.col("number") == number) if number is not None else F.lit(True)
    if title is not None:
        hit = hit & F.contains(F.lower("title"), F.lower(title))
    best = F.min(F.struct("page", "number", "title"))
    return sections.where(hit).groupBy("doc_id").agg(best.alias("m")).select("doc_id", "m.*")


def find_tables(requests: DataFrame, tables: DataFrame, sections: DataFrame, width: int = 16) -> DataFrame:
    """The table that each request such as `Table 3 from Section 2.1` names: by its number in the title, within the section's pages if one is named.

    requests: doc_id, request; tables: doc_id, page, title; sections: doc_id, number, page, end_page. The first page counts.
    """
    number = F.regexp_extract("request", r"(?i)table\s+([0-9]+(?:\.[0-9]+)?)", 1)
    section = F.regexp_extract("request", r"(?i)section\s+([0-9]+(?:\.[0-9]+)*)", 1)
    asked = requests.select("doc_id", "request", number.alias("table"), section.alias("number")).where("table <> ''")
    titled = tables.withColumn("table", F.regexp_extract("title", r"(?i)^table\s+([0-9]+(?:\.[0-9]+)?)", 1)).where("table <> ''")
    everywhere = asked.where("number = ''").join(titled, ["doc_id", "table"]).select("doc_id", "request", "page", "title")
    ranges = asked.where("number <> ''").join(sections.select("doc_id", "number", F.col("page").alias("first_page"), "end_page"), ["doc_id", "number"])
    within = contained(titled.withColumnRenamed("table", "own"), ranges, ["doc_id"], "page", "first_page", "end_page", width).where("own = table").select("doc_id", "request", "page", "title")
    best = F.min(F.struct("page", "title"))
    return everywhere.unionByName(within).groupBy("doc_id", "request").agg(best.alias("m")).select("doc_id", "request", "m.*")
