"""Lines and spans of pages: paragraph breaks, spacing repair, section texts, page offsets, tables with spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.intervals import contained

BREAK = 1.5
SPACE = 0.25


def breaks(lines: DataFrame, by: list[str], order: str, gap: Column, size: Column) -> DataFrame:
    """lines with paragraph, from 0: a new one begins after a gap of more than BREAK sizes, or where the size changes."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when((gap > BREAK * size) | (size != F.lag(size).over(w)), 1).otherwise(0)
    first = F.lag(F.lit(1)).over(w).isNull()
    flagged = lines.withColumn("__new", F.when(first, 0).otherwise(new))
    return flagged.withColumn("paragraph", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def joined_spans(spans: DataFrame, by: list[str], order: str) -> DataFrame:
    """The text of each line, with a space between letters that stand more than SPACE sizes apart. spans: text, x0, x1, size."""
    w = Window.partitionBy(*by).orderBy(order)
    apart = F.lag("text").over(w).rlike("[A-Za-z]$") & F.col("text").rlike("^[A-Za-z]") & (F.col("x0") - F.lag("x1").over(w) > SPACE * F.col("size"))
    pieces = spans.withColumn("__piece", F.concat(F.when(apart, " ").otherwise(""), "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__piece").alias("v")))), lambda s: s["v"]), "")
    return pieces.groupBy(*by).agg(text.alias("text"))


def section_texts(lines: DataFrame, sections: DataFrame, width: int) -> DataFrame:
    """The lines of each section (start and stop line, both included) in order. lines: doc_id, i, line; sections: doc_id, number, start, stop."""
    rows = contained(lines, sections, ["doc_id"], "i", "start", "stop", width)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy("doc_id", "number").agg(text.alias("text"))


def calibrated(toc: DataFrame, lines: DataFrame) -> DataFrame:
    """toc pages moved by the distance from the first chapter's entry to the first page after it that begins with its title. toc: doc_id, number, title, page; lines: doc_id, page, line."""
    first = toc.groupBy("doc_id").agg(F.min(F.struct("page", "title")).alias("f")).select("doc_id", F.col("f.page").alias("said"), F.col("f.title").alias("chapter"))
    seen = lines.join(first, "doc_id").where((F.col("page") >= F.col("said")) & F.lower("line").contains(F.lower("chapter")))
    offset = seen.groupBy("doc_id", "said").agg(F.min("page").alias("at")).select("doc_id", (F.col("at") - F.col("said")).alias("offset"))
    return toc.join(offset, "doc_id", "left").withColumn("page", F.col("page") + F.coalesce("offset", F.lit(0))).drop("offset")


def table_html(cells: DataFrame, by: list[str]) -> DataFrame:
    """HTML of grids whose cells may span rows and columns: places that a span covers get no cell of their own. cells: row_ix, col_ix, rows, cols, raw_value."""
    covered = cells.where("rows > 1 OR cols > 1").select(
        *by, F.col("row_ix").alias("r0"), F.col("col_ix").alias("c0"), F.explode(F.sequence(F.col("row_ix"), F.col("row_ix") + F.col("rows") - 1)).alias("row_ix"), F.col("cols")
    )
    covered = covered.select(*by, "r0", "c0", "row_ix", F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("cols") - 1)).alias("col_ix")).where("row_ix <> r0 OR col_ix <> c0")
    shown = cells.join(covered.select(*by, "row_ix", "col_ix").distinct(), [*by, "row_ix", "col_ix"], "left_anti")
    size = lambda name, n: F.when(F.col(n) > 1, F.concat(F.lit(f' {name}="'), F.col(n).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), size("rowspan", "rows"), size("colspan", "cols"), F.lit(">"), F.col("raw_value"), F.lit("</td>"))
    in_order = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]), "")
    per_row = shown.groupBy(*by, "row_ix").agg(F.concat(F.lit("<tr>"), in_order("col_ix", cell), F.lit("</tr>")).alias("tr"))
    return per_row.groupBy(*by).agg(F.concat(F.lit("<table>"), in_order("row_ix", F.col("tr")), F.lit("</table>")).alias("html"))
