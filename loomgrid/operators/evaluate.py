"""Evaluation that is sequential in itself: table matching, sequence distance of grids, sequence ratios."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.intervals import in_order

LEAST_OVERLAP = 2


def match_tables(found: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, tab, truth, overlap: tables (doc_id, tab, name) matched by the most common names, each truth once.

    The pairs of a document's tables are taken in order of overlap; what is held is its tables that are taken.
    """
    a, b = found.distinct(), truth.distinct().withColumnRenamed("tab", "truth")
    pairs = a.join(b, ["doc_id", "name"]).groupBy("doc_id", "tab", "truth").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= LEAST_OVERLAP)

    def step(state: tuple, pair: tuple) -> tuple[tuple, tuple | None]:
        (tabs, truths), (tab, own, _) = state, pair
        if tab in tabs or own in truths:
            return state, None
        tabs.add(tab)
        truths.add(own)
        return state, pair

    long = pairs.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("tab", "truth", "overlap")])
    return in_order(long, ["doc_id"], [F.col("overlap").desc(), F.col("tab"), F.col("truth")], ["tab", "truth", "overlap"], "tab long, truth long, overlap long", lambda: (set(), set()), step)


def edit_distance(a: list[str], b: list[str]) -> float:
    """Unit insertions and deletions; a change costs 1 - the share of equal leading characters."""
    if not a or not b:
        return float(len(a) + len(b))
    row = np.arange(len(b) + 1, dtype=float)
    kinds, at = np.unique(np.array(b, object), return_inverse=True)
    costs: dict[str, np.ndarray] = {}  # by distinct node, to each distinct one of the other side
    for x in a:
        if x not in costs:
            costs[x] = np.array([0.0 if x == y else 1 - difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for y in kinds])
        change = costs[x][at]
        new = np.empty_like(row)
        new[0] = row[0] + 1
        best = np.minimum(row[1:] + 1, row[:-1] + change)
        for j in range(len(b)):  # an insertion follows the place before it
            new[j + 1] = min(best[j], new[j] + 1)
        row = new
    return float(row[-1])


def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(left, right, strict=True):
        a, b = list(a if a is not None else []), list(b if b is not None else [])
        n = max(len(a), len(b))
        out.append(1.0 if not n else max(0.0, 1 - edit_distance(a, b) / n))
    return pd.Series(out)


def grid_similarity(truth: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and similarity: 1 - distance / longer length of the cells in reading order, as `row:value` nodes. A document's cells are one array."""
    similar = F.pandas_udf(_similar, "double")

    def nodes(cells: DataFrame, name: str) -> DataFrame:
        node = F.struct("row_ix", "col_ix", F.concat_ws(":", F.col("row_ix").cast("string"), "raw_value").alias("v"))
        return cells.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(node)), lambda s: s["v"]).alias(name))

    return nodes(truth, "a").join(nodes(found, "b"), "doc_id", "full").select("doc_id", F.round(similar("a", "b"), 6).alias("similarity"))


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in zip(left, right, strict=True)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity."""
    return F.round(F.pandas_udf(_ratio, "double")(a, b), 6)
