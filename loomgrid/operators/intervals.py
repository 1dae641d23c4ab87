"""Ordered and range operators: sessions, interval merges, gaps, containment, offsets, overlaps, nearest.

Range joins are equi joins on bins of the range, so no side is compared with the whole other side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, by: list[str], at: str, gap: int = 1) -> DataFrame:
    """rows with session, from 0: a new one begins where at is more than gap beyond the one before."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def merge_intervals(rows: DataFrame, by: list[str], start: str, end: str, touch: int = 1) -> DataFrame:
    """Intervals that overlap, or touch within the distance, as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + touch), 1).otherwise(0)
    numbered = rows.withColumn("__new", new).withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__group")


def fill_gaps(rows: DataFrame, by: list[str], at: str, widest: int = 3) -> DataFrame:
    """The values of at, and those between two neighbours that are at most widest apart; filled says which."""
    w = Window.partitionBy(*by).orderBy(at)
    following = F.lead(at).over(w)
    last = F.when(following - F.col(at) <= widest, F.greatest(F.col(at), following - 1)).otherwise(F.col(at))
    return rows.select(*by, F.col(at).alias("__at"), last.alias("__last")).select(*by, F.explode(F.sequence("__at", "__last")).alias(at), "__at").select(*by, at, (F.col(at) != F.col("__at")).alias("filled"))


def contained(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """points joined with the ranges that hold them (both ends included). Ranges are cut into bins of the width."""
    bins = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("__bin", F.floor(F.col(at) / width)).join(bins, [*by, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__bin")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of half-open intervals (l_start, l_end) and (r_start, r_end) that overlap, each once: at the bin of the later start."""
    cut = lambda df, s, e: df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    joined = cut(left.where("l_start < l_end"), "l_start", "l_end").join(cut(right.where("r_start < r_end"), "r_start", "r_end"), [*by, "__bin"])
    once = F.col("__bin") == F.floor(F.greatest("l_start", "r_start") / width)
    return joined.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & once).drop("__bin")


def running_offsets(rows: DataFrame, by: list[str], order: list[str], length: Column, between: int = 1) -> DataFrame:
    """start and end of each piece if all are joined with separators of the length between."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length + between).over(w) - between
    return rows.withColumn("end", end).withColumn("start", F.col("end") - length)


def section_ends(sections: DataFrame) -> DataFrame:
    """end_page: the page before the next section's (its own at least), or the document's last page (n_pages - 1)."""
    w = Window.partitionBy("doc_id").orderBy("page", "number")
    following = F.lead("page").over(w)
    return sections.withColumn("end_page", F.greatest(F.col("page"), F.coalesce(following, F.col("n_pages")) - 1))


def in_order(rows: DataFrame, by: list[str], order: list[Column], columns: list[str], schema: str, first: Callable[[], tuple], step: Callable[[tuple, tuple], tuple[tuple, tuple | None]]) -> DataFrame:
    """What a sequential pass over each group's rows gives: step takes the state and a row's columns, and returns the next
    state and an output row or None. Partitions are sorted by group, and only one group's state is held, so the work is
    linear in the rows. Output has the group's columns and then those of the schema.
    """
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    names = [*by, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, first()
        for batch in batches:
            out = []
            for k, values in zip(zip(*(batch[c].tolist() for c in by), strict=True), zip(*(batch[c].tolist() for c in columns), strict=True), strict=True):
                if k != key:
                    key, state = k, first()
                state, found = step(state, values)
                if found is not None:
                    out.append((*k, *found))
            yield pd.DataFrame(out, columns=names)

    dealt = rows.select(*dict.fromkeys([*by, *columns])).repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInPandas(run, f"{kinds}, {schema}")


def greedy_apart(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each group's spans (start, end) those that a pass by start, the longest first, keeps without overlap."""

    def step(state: tuple, span: tuple) -> tuple[tuple, tuple | None]:
        start, end = span
        return ((end,), span) if start >= state[0] else (state, None)

    spans = rows.select(*by, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return in_order(spans, by, [F.col("start"), F.col("end").desc()], ["start", "end"], "start long, end long", lambda: (-1,), step)


def clusters(rows: DataFrame, by: list[str], at: str, reach: float) -> DataFrame:
    """Per group, the values of at in clusters: a new one begins more than reach beyond the first of the current."""

    def step(state: tuple, value: tuple) -> tuple[tuple, tuple | None]:
        begin, n = state
        if begin is None or value[0] - begin > reach:
            begin, n = value[0], n + 1
        return (begin, n), (value[0], n)

    return in_order(rows.select(*by, F.col(at).cast("double").alias("at")), by, [F.col("at")], ["at"], "at double, cluster int", lambda: (None, -1), step)


def nearest(points: DataFrame, centres: DataFrame, by: list[str], at: str, centre: str, within: float) -> DataFrame:
    """Each point with its nearest centre, the smaller of two as near, if it is within the distance. A group's centres are one array."""
    lists = centres.groupBy(*by).agg(F.array_sort(F.collect_set(F.col(centre).cast("double"))).alias("__c"))
    best = F.array_min(F.transform("__c", lambda c: F.struct(F.abs(F.col(at) - c).alias("distance"), c.alias("centre"))))
    return points.join(lists, by).withColumn("__b", best).where(F.col("__b.distance") <= within).withColumn("centre", F.col("__b.centre")).drop("__c", "__b")


def shift_pages(rows: DataFrame) -> DataFrame:
    """Rows of pages that begin again below the running offset, moved behind it. Input: doc_id, page, least, most; output has shift."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        page, least, most = row
        shift = state[0] if least < state[0] else 0
        return (most + shift + 1,), (page, shift)

    pages = rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("page", "least", "most")])
    return in_order(pages, ["doc_id"], [F.col("page")], ["page", "least", "most"], "page long, shift long", lambda: (0,), step)
