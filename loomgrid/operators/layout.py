"""Spanning headers, boxes, table offsets, and stitching of table regions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.grid import is_not_procedure
from loomgrid.functions.text import base_title

#: Weights of the continuity score.
COLUMNS, NAMES, MARKED, TITLE, PROXIMITY, MISMATCH = 0.35, 0.25, 0.25, 0.20, 0.15, 0.15
STITCH_FROM = 0.45
#: Similarities of what is not known (fixed values).
UNKNOWN_COLUMNS, UNKNOWN_NAMES = 0.5, 0.3


def propagate_spans(cells: DataFrame, parents: list[int], width: int) -> DataFrame:
    """Cells that a mark under a spanning header implies: where all its columns are blank, those that have no cell, at 0.9 of its confidence."""
    kids = cells.where(F.col("col_ix").isin(*parents) & (F.col("raw_value") != "")).select(
        "doc_id", "row_ix", F.col("raw_value"), F.col("col_ix").alias("parent_col"), F.explode(F.sequence(F.col("col_ix") + 1, F.col("col_ix") + width)).alias("col_ix")
    )
    there = cells.select("doc_id", "row_ix", "col_ix", F.col("raw_value").alias("own"))
    joined = kids.join(there, ["doc_id", "row_ix", "col_ix"], "left")
    blank = joined.groupBy("doc_id", "row_ix", "parent_col").agg(F.max(F.coalesce((F.col("own") != "").cast("int"), F.lit(0))).alias("marked")).where("marked = 0")
    return joined.where("own IS NULL").join(blank, ["doc_id", "row_ix", "parent_col"]).select("doc_id", "row_ix", "col_ix", "raw_value", "parent_col")


def outside(boxes: DataFrame, others: DataFrame, by: str, slack: float) -> DataFrame:
    """Boxes (x0, x1, y0, y1) that overlap no other box of their group, even with the slack."""
    o = others.select(F.col(by).alias("__by"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "x1", "y0", "y1")])
    apart = [F.col("x0") < F.col("o_x1") + slack, F.col("o_x0") < F.col("x1") + slack, F.col("y0") < F.col("o_y1") + slack, F.col("o_y0") < F.col("y1") + slack]
    return boxes.join(o, [F.col(by) == F.col("__by"), *apart], "left_anti")


def table_offsets(cells: DataFrame) -> DataFrame:
    """Where each table's rows begin if the tables of a document stand below each other."""
    sizes = cells.groupBy("doc_id", "tab").agg((F.max("row_ix") + 1).cast("long").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("tab").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("doc_id", "tab", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_offset"))


def _column_similarity(a: Column, b: Column) -> Column:
    """Of two lists of headers: 0.4 for their numbers, 0.6 for common ones; 0.5 where either is empty."""
    n = 1 - F.abs(F.size(a) - F.size(b)) / F.greatest(F.size(a), F.size(b))
    words = lambda x: F.array_distinct(F.filter(F.transform(x, F.lower), lambda h: F.trim(h) != ""))
    x, y = words(a), words(b)
    common = F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(n)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 0.4 * n + 0.6 * common).otherwise(UNKNOWN_COLUMNS)


def _name_share(before: Column, names: Column) -> Column:
    """1.2 times the share of names of more than three letters that can be procedures, at most 1; 0.3 where either list is empty."""
    known = F.filter(names, lambda x: ~is_not_procedure(x, []) & (F.length(x) > 3))
    return F.when((F.size(before) > 0) & (F.size(names) > 0), F.least(F.lit(1.0), 1.2 * F.size(known) / F.size(names))).otherwise(UNKNOWN_NAMES)


def continuity(regions: DataFrame) -> DataFrame:
    """How likely each region continues the one before it. regions: region, title, first_page, last_page, marked, headers, names (arrays)."""
    w = Window.partitionBy("doc_id").orderBy("first_page", "region")
    base = base_title(F.col("title"))
    gap = F.col("first_page") - F.lag("last_page").over(w)
    same = base == F.lag(base).over(w)
    near = F.when(gap <= 1, 1.0).when(gap <= 3, 0.7).when(gap <= 5, 0.3).otherwise(0.0)
    columns = _column_similarity(F.lag("headers").over(w), F.col("headers"))
    score = COLUMNS * columns + NAMES * _name_share(F.lag("names").over(w), F.col("names")) + F.when(F.col("marked"), MARKED).otherwise(0) + F.when(same, TITLE + 0.05).otherwise(-MISMATCH) + PROXIMITY * near
    scored = regions.withColumn("__same", same).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return scored.where("__same IS NOT NULL").drop("__same")


def continues(before: dict, after: dict) -> float:
    """The score of `continuity` for two regions; `known` is the share of names of the second that can be procedures."""
    gap = after["first_page"] - before["last_page"]
    near = 1.0 if gap <= 1 else 0.7 if gap <= 3 else 0.3 if gap <= 5 else 0.0
    a, b = before["headers"], after["headers"]
    columns = UNKNOWN_COLUMNS
    if a and b:
        n = 1 - abs(len(a) - len(b)) / max(len(a), len(b))
        x, y = ({h.lower() for h in z if h.strip()} for z in (a, b))
        columns = 0.4 * n + 0.6 * (len(x & y) / max(len(x), len(y)) if x and y else n)
    names = min(1.0, 1.2 * after["known"]) if before["named"] and after["named"] else UNKNOWN_NAMES
    score = COLUMNS * columns + NAMES * names + (MARKED if after["marked"] else 0) + (TITLE + 0.05 if after["base"] == before["base"] else -MISMATCH) + PROXIMITY * near
    return max(0.0, min(1.0, score))


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by document and page; only the open tables of the current document are kept, each as its last region."""
    doc, groups = None, []
    for rows in batches:
        out = []
        for r in rows.to_dict("records"):
            r["headers"] = list(r["headers"] if r["headers"] is not None else [])
            if r["doc_id"] != doc:
                doc, groups = r["doc_id"], []
            best = next((i for i in range(len(groups) - 1, -1, -1) if continues(groups[i], r) >= STITCH_FROM), None)
            if best is None:
                groups.append(r | {"table": int(r["region"])})
            else:
                g = groups[best]
                g["last_page"] = max(g["last_page"], r["last_page"])
            out.append(groups[-1 if best is None else best]["table"])
        yield pd.DataFrame({"doc_id": rows["doc_id"], "region": rows["region"], "table_id": out})


def stitch(regions: DataFrame) -> DataFrame:
    """region and table_id (its first region): in page order, a region joins the last table that it continues well enough.

    A merged table keeps its first region's title, headers and names, and its last page.
    """
    known = F.filter("names", lambda x: ~is_not_procedure(x, []) & (F.length(x) > 3))
    rows = regions.withColumns({"base": base_title(F.col("title")), "named": F.size("names") > 0, "known": F.when(F.size("names") > 0, F.size(known) / F.size("names")).otherwise(0.0)})
    rows = rows.select("doc_id", "region", "first_page", "last_page", "marked", "base", "headers", "named", "known")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "first_page", "region").mapInPandas(_stitch, "doc_id long, region long, table_id long")
