"""Grid views of the driver's tables, in Spark and in SQL, from which the registered queries are made.

A lineitem row is an extraction of the cell (l_orderkey, l_linenumber, l_suppkey % 8 + 1). Several rows may name one
cell; the greatest in a total order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.reconcile import KEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PICK = {"part": "l_partkey", "supp": "l_suppkey", "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax", "flag": "l_returnflag", "status": "l_linestatus"}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY, the picked columns, and raw_value: X, Xa or empty by return flag."""
    one = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row_ix"), (F.col("l_suppkey") % 8 + 1).cast("int").alias("col_ix"))
        .agg(F.max(F.struct(*[F.col(c).alias(n) for n, c in _PICK.items()])).alias("m"))
    )
    return one.select(*KEY, "m.*").withColumn("raw_value", F.when(F.col("flag") == "R", "X").when(F.col("flag") == "A", "Xa").otherwise(""))


CELLS = f"""cells AS (
  SELECT doc_id, row_ix, col_ix, m.*, CASE m.flag WHEN 'R' THEN 'X' WHEN 'A' THEN 'Xa' ELSE '' END AS raw_value
  FROM (SELECT l_orderkey AS doc_id, l_linenumber::INT AS row_ix, (l_suppkey % 8 + 1)::INT AS col_ix,
          max({{{', '.join(f"'{n}': {c}" for n, c in _PICK.items())}}}) AS m
        FROM lineitem GROUP BY 1, 2, 3))"""


def pass_of(all_cells: DataFrame, number: int) -> DataFrame:
    """A pass misses the cells of every 7th, 5th or 3rd part and reads some values differently."""
    every = {1: 7, 2: 5, 3: 3}[number]
    raw = {
        1: F.col("raw_value"),
        2: F.when(F.col("part") % 11 == 0, "Y").when(F.col("flag") == "A", "X").otherwise(F.col("raw_value")),
        3: F.when(F.col("part") % 13 == 0, "Z").otherwise(F.col("raw_value")),
    }[number]
    return all_cells.where(F.col("part") % every != 0).withColumn("raw_value", raw)


PASSES = """
p1 AS (SELECT * FROM cells WHERE part % 7 <> 0),
p2 AS (SELECT * REPLACE (CASE WHEN part % 11 = 0 THEN 'Y' WHEN flag = 'A' THEN 'X' ELSE raw_value END AS raw_value) FROM cells WHERE part % 5 <> 0),
p3 AS (SELECT * REPLACE (CASE WHEN part % 13 = 0 THEN 'Z' ELSE raw_value END AS raw_value) FROM cells WHERE part % 3 <> 0)"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenges: a lineitem with a discount of 0.08 or more questions its cell, some without saying which."""
    rows = table(spark, sf_dir, "lineitem").where("l_discount >= 0.08")
    known = F.col("l_partkey") % 17 != 0
    return rows.select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(known, F.col("l_linenumber").cast("int")).alias("row_ix"),
        F.when(known, (F.col("l_suppkey") % 8 + 1).cast("int")).alias("col_ix"),
        (F.col("l_discount") * 5).alias("severity"),
    )


ISSUES = """
issues AS (
  SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 17 <> 0 THEN l_linenumber::INT END AS row_ix,
    CASE WHEN l_partkey % 17 <> 0 THEN (l_suppkey % 8 + 1)::INT END AS col_ix, l_discount * 5 AS severity
  FROM lineitem WHERE l_discount >= 0.08),
challenged AS (
  SELECT doc_id, row_ix, col_ix, max(severity) AS max_severity, count(*) AS n_issues FROM issues WHERE row_ix IS NOT NULL GROUP BY 1, 2, 3)"""


def tier(size: Column) -> Column:
    return F.when(size > 45, "VERY_HIGH").when(size > 35, "HIGH").when(size > 20, "MEDIUM").otherwise("LOW")


TIER = "CASE WHEN p_size > 45 THEN 'VERY_HIGH' WHEN p_size > 35 THEN 'HIGH' WHEN p_size > 20 THEN 'MEDIUM' ELSE 'LOW' END"


def tiers(spark: SparkSession, sf_dir: str, all_cells: DataFrame) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), tier(F.col("p_size")).alias("cost_tier"))
    return all_cells.select(*KEY, "part").join(parts, "part").select(*KEY, "cost_tier")


TIERS = f"""
tiers AS (SELECT doc_id, row_ix, col_ix, {TIER} AS cost_tier FROM cells JOIN part ON part = p_partkey)"""

VOTE = (
    "lower(CASE WHEN length({v}) <= 3 THEN regexp_replace({v}, '([a-zA-Z])[0-9]$', '\\1') ELSE {v} END)"
).replace("{v}", "regexp_replace({x}, '([A-Z])[a-f]$', '\\1')")


def vote_sql(column: str) -> str:
    return VOTE.replace("{x}", f"trim({column})")


RECONCILED = f"""
merged AS (
  SELECT doc_id, row_ix, col_ix, p1.raw_value AS raw1, p2.raw_value AS raw2,
    {vote_sql("p1.raw_value")} = {vote_sql("p2.raw_value")} AS agree
  FROM p1 FULL JOIN p2 USING (doc_id, row_ix, col_ix)),
valued AS (
  SELECT doc_id, row_ix, col_ix,
    CASE WHEN agree AND length(raw2) > length(raw1) THEN raw2 ELSE coalesce(raw1, raw2) END AS raw_value,
    CASE WHEN raw1 IS NULL OR raw2 IS NULL THEN 0.70 WHEN agree THEN 0.95 ELSE 0.50 END::DOUBLE AS base,
    coalesce(NOT agree, false) AS conflict FROM merged),
reconciled AS (
  SELECT *, confidence < (CASE WHEN cost_tier IN ('HIGH', 'VERY_HIGH') THEN 0.95 ELSE 0.85 END)::DOUBLE AS flagged
  FROM (SELECT doc_id, row_ix, col_ix, raw_value, base * (1 - coalesce(max_severity, 0) * 0.5::DOUBLE) AS confidence, conflict, max_severity, cost_tier
        FROM valued LEFT JOIN challenged USING (doc_id, row_ix, col_ix) LEFT JOIN tiers USING (doc_id, row_ix, col_ix)))"""

WITH_CELLS = f"WITH {CELLS}"
WITH_PASSES = f"{WITH_CELLS},{PASSES}"
WITH_RECONCILED = f"{WITH_PASSES},{ISSUES},{TIERS},{RECONCILED}"
