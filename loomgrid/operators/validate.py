"""Structure checks of extracted grids, dense grids, and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import NULL_WORDS
from loomgrid.operators.reconcile import KEY

NULL_SHARE, MISSING_SHARE = 0.2, 0.3


def structure(cells: DataFrame, by: list[str]) -> DataFrame:
    """Missing rows, repeated places and the share of null words; an error, a warning or ok."""
    rows = F.max("row_ix") - F.min("row_ix") + 1
    missing = rows - F.countDistinct("row_ix")
    nulls = F.avg(F.lower(F.trim("raw_value")).isin(*NULL_WORDS).cast("int"))
    found = cells.groupBy(*by).agg(
        F.count("*").alias("n_cells"), missing.alias("missing_rows"), (F.count("*") - F.countDistinct("row_ix", "col_ix")).alias("duplicates"), nulls.alias("null_share"), rows.alias("__rows")
    )
    verdict = F.when(F.col("null_share") > NULL_SHARE, "error").when(F.col("missing_rows") > MISSING_SHARE * F.col("__rows"), "warning").otherwise("ok")
    return found.withColumn("verdict", verdict).drop("__rows")


def unusual_rows(cells: DataFrame) -> DataFrame:
    """Rows whose number of cells is not their document's commonest; of equally common ones the smaller counts."""
    per_row = cells.groupBy("doc_id", "row_ix").agg(F.count("*").alias("n"))
    usual = per_row.groupBy("doc_id", "n").agg(F.count("*").alias("k")).groupBy("doc_id").agg(F.max_by("n", F.struct("k", -F.col("n"))).alias("usual"))
    return per_row.join(usual, "doc_id").where("n <> usual")


def dense_grid(cells: DataFrame, value: Column, filler: str) -> DataFrame:
    """Every place up to the document's last row and column, with the filler where there is no cell."""
    size = cells.groupBy("doc_id").agg(F.max("row_ix").alias("rows"), F.max("col_ix").alias("cols"))
    places = size.select("doc_id", "cols", F.explode(F.sequence(F.lit(1), "rows")).alias("row_ix")).select("doc_id", "row_ix", F.explode(F.sequence(F.lit(1), "cols")).alias("col_ix"))
    return places.join(cells.select(*KEY, value.alias("raw_value")), KEY, "left").withColumn("raw_value", F.coalesce("raw_value", F.lit(filler)))


def apply_corrections(cells: DataFrame, log: DataFrame) -> DataFrame:
    """The latest correction of each cell (log: KEY, at, value) in place of its value."""
    last = log.groupBy(*KEY).agg(F.max_by("value", "at").alias("__value"))
    joined = cells.join(last, KEY, "left")
    return joined.withColumn("corrected", F.col("__value").isNotNull()).withColumn("raw_value", F.coalesce("__value", "raw_value")).drop("__value")


def orphans(uses: DataFrame, definitions: DataFrame, on: list[str]) -> DataFrame:
    """Uses without a definition."""
    return uses.join(definitions.select(*on).distinct(), on, "left_anti")
