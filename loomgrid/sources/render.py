"""Rendering of ordered rows as text, HTML, Markdown tables and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.text import escape_html


def _ordered(order: str, value: Column) -> Column:
    """The values of a group in order; a group is one document's lines."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"])


def to_text(rows: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(_ordered(order, F.col(line)), "\n").alias("text"))


def to_html(rows: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(_ordered(order, F.concat(F.lit("<p>"), escape_html(F.col(line)), F.lit("</p>"))), "").alias("html"))


def to_markdown_table(cells: DataFrame, by: list[str]) -> DataFrame:
    """A pipe table of a dense grid (row_ix, col_ix, raw_value)."""
    per_row = cells.groupBy(*by, "row_ix").agg(_ordered("col_ix", F.col("raw_value")).alias("v"))
    text = F.concat(F.lit("| "), F.array_join("v", " | "), F.lit(" |"))
    return per_row.groupBy(*by).agg(F.array_join(_ordered("row_ix", text), "\n").alias("markdown"))


def to_graph_json(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """One JSON text for each value of by: nodes (id, kind), edges (src, dst, kind) and counts by kind."""
    n = nodes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("id", "kind"))).alias("nodes"))
    e = edges.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "kind"))).alias("edges"))
    return n.join(e, by, "left").select(by, F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"))).alias("graph"))
