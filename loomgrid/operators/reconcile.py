"""Reconciliation of extraction passes on the cell grid, consensus, and comparison of runs.

A cell is keyed by KEY. Every operator takes cells that are unique by key (`latest_cells` makes them so) and joins on
the key, so one partitioning serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import vote_value

KEY = ["doc_id", "row_ix", "col_ix"]
AGREE, DISAGREE, SINGLE, CONSENSUS = 0.95, 0.50, 0.70, 0.90
THRESHOLD, COSTLY_THRESHOLD = 0.85, 0.95
COSTLY = ["HIGH", "VERY_HIGH"]


def latest_cells(cells: DataFrame, order: list[str], first: bool = False) -> DataFrame:
    """One cell for each key: the last (or first) in the total order of the columns given."""
    pick = F.min_by if first else F.max_by
    rest = [c for c in cells.columns if c not in KEY]
    one = cells.groupBy(*KEY).agg(pick(F.struct(*rest), F.struct(*order)).alias("one"))
    return one.select(*KEY, "one.*")


def challenge_map(issues: DataFrame) -> DataFrame:
    """KEY, max_severity and n_issues; issues that name no cell are left out."""
    return issues.where(F.col("row_ix").isNotNull() & F.col("col_ix").isNotNull()).groupBy(*KEY).agg(F.max("severity").alias("max_severity"), F.count("*").alias("n_issues"))


def cost_map(cells: DataFrame, procedures: DataFrame) -> DataFrame:
    """KEY and cost_tier of cells with a row header that is a procedure's raw or canonical name (of equal names the last, the raw one before the canonical)."""
    both = procedures.select(F.lower("raw_name").alias("name"), "pos", F.lit(1).alias("side"), "cost_tier").union(procedures.select(F.lower("canonical_name"), "pos", F.lit(0), "cost_tier"))
    names = both.groupBy("name").agg(F.max_by("cost_tier", F.struct("pos", "side")).alias("cost_tier"))
    return cells.where("row_header <> ''").join(names, F.lower("row_header") == names["name"], "left").select(*KEY, F.coalesce("cost_tier", F.lit("LOW")).alias("cost_tier"))


def _judge(cells: DataFrame, challenges: DataFrame, tiers: DataFrame) -> DataFrame:
    joined = cells.join(challenge_map(challenges), KEY, "left").join(tiers.select(*KEY, "cost_tier"), KEY, "left")
    threshold = F.when(F.col("cost_tier").isin(*COSTLY), COSTLY_THRESHOLD).otherwise(THRESHOLD)
    confidence = F.col("confidence") * (1 - F.coalesce("max_severity", F.lit(0.0)) * 0.5)
    return joined.withColumn("confidence", confidence).withColumn("flagged", F.col("confidence") < threshold).drop("n_issues")


def reconcile(pass1: DataFrame, pass2: DataFrame, challenges: DataFrame, tiers: DataFrame) -> DataFrame:
    """KEY, raw_value, confidence, conflict, flagged (and max_severity, cost_tier) from two passes.

    Equal values after vote normalisation: AGREE and the longer raw value, of equal lengths the first pass'. Different:
    DISAGREE and the first pass'. One pass only: SINGLE. Challenges take half their greatest severity off.
    """
    a = pass1.select(*KEY, F.col("raw_value").alias("raw1"), F.lit(True).alias("in1"))
    b = pass2.select(*KEY, F.col("raw_value").alias("raw2"), F.lit(True).alias("in2"))
    both = F.col("in1").isNotNull() & F.col("in2").isNotNull()
    agree = vote_value(F.col("raw1")) == vote_value(F.col("raw2"))
    value = F.when(both & agree & (F.length("raw2") > F.length("raw1")), F.col("raw2")).otherwise(F.coalesce("raw1", "raw2"))
    merged = a.join(b, KEY, "full").select(
        *KEY, value.alias("raw_value"), F.when(~both, SINGLE).when(agree, AGREE).otherwise(DISAGREE).alias("confidence"), (both & ~agree).alias("conflict")
    )
    return _judge(merged, challenges, tiers)


def reconcile_single(cells: DataFrame, challenges: DataFrame, tiers: DataFrame) -> DataFrame:
    """As `reconcile` for one pass, which keeps its own confidence."""
    return _judge(cells.select(*KEY, "raw_value", "confidence", F.lit(False).alias("conflict")), challenges, tiers)


def consensus(reconciled: DataFrame, passes: list[DataFrame], below: float = 0.8) -> DataFrame:
    """Cells below the bound that the last pass has too: two of three equal values give CONSENSUS and the longest raw value, the earliest of equal lengths."""
    votes = None
    for number, p in enumerate(passes, 1):
        rows = p.select(*KEY, F.col("raw_value").alias("raw"), F.lit(number).alias("pass_no"))
        votes = rows if votes is None else votes.unionByName(rows)
    counted = votes.groupBy(*KEY, vote_value(F.col("raw")).alias("value")).agg(
        F.count("*").alias("n"), F.max_by("raw", F.struct(F.length("raw"), -F.col("pass_no"))).alias("best"), F.min("pass_no").alias("first")
    )
    winner = counted.groupBy(*KEY).agg(F.max_by(F.struct("n", "best"), F.struct("n", -F.col("first"))).alias("w"))
    last = passes[-1].select(*KEY, F.lit(True).alias("in_last"))
    joined = reconciled.join(winner, KEY, "left").join(last, KEY, "left")
    resolved = F.coalesce((F.col("confidence") < below) & F.col("in_last") & (F.col("w.n") >= 2), F.lit(False))
    return joined.withColumns(
        {"resolved": resolved, "raw_value": F.when(resolved, F.col("w.best")).otherwise(F.col("raw_value")), "confidence": F.when(resolved, CONSENSUS).otherwise(F.col("confidence"))}
    ).drop("w", "in_last")


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """KEY, old_value, new_value and status: unchanged, changed, added or removed."""
    a = old.select(*KEY, F.col("raw_value").alias("old_value"), F.lit(1).alias("a"))
    b = new.select(*KEY, F.col("raw_value").alias("new_value"), F.lit(1).alias("b"))
    status = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.trim("old_value") == F.trim("new_value"), "unchanged").otherwise("changed")
    return a.join(b, KEY, "full").withColumn("status", status).drop("a", "b")


def stability(compared: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each status, and stability_pct: unchanged among the cells that both runs have."""
    n = {s: F.count_if(F.col("status") == s) for s in ("unchanged", "changed", "added", "removed")}
    both = n["unchanged"] + n["changed"]
    return compared.groupBy(*by).agg(*[v.alias(f"n_{k}") for k, v in n.items()], F.when(both > 0, 100.0 * n["unchanged"] / both).otherwise(100.0).alias("stability_pct"))


def accuracy(truth: DataFrame, found: DataFrame, by: list[str], weight: Column | float = 1.0) -> DataFrame:
    """Matched, missing and extra cells, and the (weighted) share of matched cells that are equal without case and outer blanks."""
    a = truth.select(*KEY, *[c for c in by if c not in KEY], F.col("raw_value").alias("want"), (weight if isinstance(weight, Column) else F.lit(weight)).alias("weight"))
    b = found.select(*KEY, F.col("raw_value").alias("got"), F.lit(1).alias("b"))
    joined = a.withColumn("a", F.lit(1)).join(b, KEY, "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    equal = both & (F.lower(F.trim("want")) == F.lower(F.trim("got")))
    return joined.groupBy(*by).agg(
        F.count_if(both).alias("n_matched"),
        F.count_if(F.col("b").isNull()).alias("n_missing"),
        F.count_if(F.col("a").isNull()).alias("n_extra"),
        F.count_if(equal).alias("n_correct"),
        (F.sum(F.when(equal, F.col("weight")).otherwise(0)) / F.nullif(F.sum(F.when(both, F.col("weight")).otherwise(0)), F.lit(0))).alias("accuracy"),
    )


def repeatability(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per cell: how many runs, the share of the commonest value (a missing cell counts as empty), and whether it is stable. runs has a column run."""
    keys = keys or KEY
    n_runs = runs.select("run").distinct().count()
    counted = runs.groupBy(*keys, F.trim("raw_value").alias("value")).agg(F.countDistinct("run").alias("n"))
    seen = counted.groupBy(*keys).agg(F.sum("n").alias("present"), F.max("n").alias("most"), F.max(F.when(F.col("value") == "", F.col("n")).otherwise(0)).alias("blank"))
    top = F.greatest("most", F.col("blank") + n_runs - F.col("present"))
    return seen.select(*keys, F.lit(n_runs).alias("n_runs"), (top / n_runs).alias("stability"), (top == n_runs).alias("is_stable"))
