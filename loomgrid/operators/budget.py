"""Visits, budget lines and schedules from marked cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import compound_terms, is_not_procedure, mark, unit_cost

#: Mean confidence by mark, and defaults of cycles.
MARK_CONFIDENCE = {"firm": 0.95, "conditional": 0.7, "span": 0.85}
DEFAULT_CYCLES, MONTHS, CYCLE_DAYS = 6, 9, 21


def cycle_total(cycles: int, treat_to_progression: bool, months: int = MONTHS, cycle_days: int = CYCLE_DAYS, default: int = DEFAULT_CYCLES) -> tuple[int, int]:
    """Cycles that are shown and that are expected; equal where nothing is to be multiplied."""
    if cycles <= 1:
        return 1, 1
    total = int(months * 30 / cycle_days) if treat_to_progression and cycle_days > 0 else default
    return cycles, max(cycles, total)


def budget_lines(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per group: firm and conditional visits (sorted, distinct), mean confidence, occurrences. cells: raw_value, visit, confidence and by."""
    marked = cells.withColumn("m", mark(F.col("raw_value")))
    kind = F.col("m.mark_type")
    firm = kind.isin("firm", "span")
    lines = marked.groupBy(*by).agg(
        F.array_sort(F.collect_set(F.when(firm, F.col("visit")))).alias("firm_visits"),
        F.array_sort(F.collect_set(F.when(kind == "conditional", F.col("visit")))).alias("conditional_visits"),
        F.avg("confidence").alias("avg_confidence"),
        F.sum(F.when(kind != "empty", F.coalesce("m.occurrences", F.lit(1))).otherwise(0)).alias("total_occurrences"),
        F.count_if(firm).alias("n_firm"),
        F.count_if(kind == "conditional").alias("n_conditional"),
    )
    return lines.where("total_occurrences > 0")


def procedure_lines(cells: DataFrame, names: DataFrame, notes: DataFrame, cycles: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """A budget line for each procedure of each named row of each document.

    cells: doc_id, row_ix, col_ix, visit, raw_value, confidence; names: doc_id, row_ix, name; notes: doc_id, row_ix, col_ix,
    kind, text, pos; cycles: doc_id, shown, expected. A marked cell is conditional by its text or its note, of modified
    frequency by its note, and else firm. A span counts its occurrences, and one that names none is one visit from the first
    to the last such column. If more cycles are expected than shown, firm and conditional occurrences are multiplied and
    rounded down; those of modified frequency are not. A row that names several procedures makes a line for each; names that
    are no procedure make none. The mean confidence is of all cells beside the first column, 0.5 without any.
    """
    place = ["doc_id", "row_ix", "col_ix"]
    noted = notes.groupBy(*place).agg(F.max_by("kind", "pos").alias("note_kind"), F.max_by("text", "pos").alias("note_text"))
    rows = cells.where("col_ix > 0").join(noted, place, "left").withColumn("m", mark(F.col("raw_value")))
    kind = F.col("m.mark_type")
    conditional = (kind == "conditional") | ((kind == "firm") & (F.col("note_kind") == "CONDITIONAL"))
    modified = (kind == "firm") & (F.col("note_kind") == "FREQUENCY_MODIFIER")
    endless = (kind == "span") & F.col("m.occurrences").isNull()
    firm = (kind == "firm") & ~F.coalesce(F.col("note_kind").isin("CONDITIONAL", "FREQUENCY_MODIFIER"), F.lit(False)) | ((kind == "span") & ~endless)
    yes = lambda c: F.coalesce(c, F.lit(False))
    lines = rows.groupBy("doc_id", "row_ix").agg(
        (F.sum(F.when(yes(firm), F.col("m.occurrences")).otherwise(0)) + F.max(endless.cast("int"))).alias("n_firm"),
        F.count_if(yes(conditional)).alias("n_conditional"),
        F.count_if(yes(modified)).alias("n_modified"),
        F.array_sort(F.collect_set(F.when(yes(modified), F.col("note_text")))).alias("modifier_notes"),
        F.min_by("visit", F.when(endless, F.col("col_ix"))).alias("from"),
        F.max_by("visit", F.when(endless, F.col("col_ix"))).alias("to"),
        F.coalesce(F.avg("confidence"), F.lit(0.5)).alias("avg_confidence"),
    )
    factor = F.when(F.col("shown") > 0, F.col("expected") / F.col("shown"))
    joined = lines.where("n_firm + n_conditional + n_modified > 0").join(cycles.select("doc_id", factor.alias("factor")), "doc_id", "left")
    base = F.col("n_firm") + F.col("n_conditional")
    multiplied = F.when(F.col("factor") > 1, F.floor(base * F.col("factor"))).otherwise(base)
    named = joined.join(names, ["doc_id", "row_ix"]).where(~is_not_procedure(F.col("name"), patterns or []))
    each = named.withColumn("total_occurrences", multiplied + F.col("n_modified")).withColumn("procedure", F.explode(compound_terms(F.col("name"))))
    return each.where(~is_not_procedure(F.col("procedure"), patterns or [])).select(
        "doc_id", "row_ix", "procedure", "n_firm", "n_conditional", "n_modified", "total_occurrences", F.greatest(F.coalesce("factor", F.lit(1.0)), F.lit(1.0)).alias("cycle_multiplier"),
        F.array_join(F.slice("modifier_notes", 1, 2), "; ").alias("modifier_notes"), F.when(F.col("from").isNotNull(), F.concat("from", F.lit("→"), "to", F.lit(" (continuous)"))).alias("span"), "avg_confidence",
    )


def merge_lines(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines of several tables as one: visits united, the greatest total, and the fields of the first table's line."""
    return lines.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("firm_visits")))).alias("firm_visits"),
        F.max("total_occurrences").alias("total_occurrences"),
        F.min_by("avg_confidence", "table_id").alias("avg_confidence"),
        F.count("*").alias("n_tables"),
    )


def totals(lines: DataFrame) -> DataFrame:
    """Subtotals by category and the grand total (category null): firm only and up to. lines: category, cost_tier, n_firm, total_occurrences."""
    cost = unit_cost(F.col("cost_tier"))
    return lines.rollup("category").agg(
        F.count("*").alias("n_lines"), F.sum(cost * F.col("n_firm")).alias("firm_total"), F.sum(cost * F.col("total_occurrences")).alias("up_to_total"), F.grouping("category").cast("int").alias("is_total")
    )


def schedule(entries: DataFrame, by: list[str]) -> DataFrame:
    """Firm, conditional and total occurrences; excluded entries do not count. entries: mark_type, occurrences, visit and by."""
    kind = F.col("mark_type")
    score = F.when(F.lit(False), 0.0)
    for name, value in MARK_CONFIDENCE.items():
        score = score.when(kind == name, value)
    rows = entries.where(kind != "excluded").groupBy(*by).agg(
        F.sum(F.when(kind != "conditional", F.col("occurrences")).otherwise(0)).alias("firm"),
        F.sum(F.when(kind == "conditional", F.col("occurrences")).otherwise(0)).alias("conditional"),
        F.sum("occurrences").alias("total"),
        F.round(F.avg(score.otherwise(1.0)), 3).alias("avg_confidence"),
        F.array_sort(F.collect_set("visit")).alias("visits"),
    )
    return rows.where("total > 0")


def frequency(entries: DataFrame, by: list[str]) -> DataFrame:
    """How often each is done in all, excluded entries too, and whether it is ever conditional."""
    return entries.groupBy(*by).agg(
        F.count("*").alias("n_entries"), F.sum("occurrences").alias("total"), F.bool_or(F.col("mark_type") == "conditional").alias("ever_conditional"), F.countDistinct("visit").alias("n_visits")
    )


def timeline(visits: DataFrame, entries: DataFrame) -> DataFrame:
    """Every visit with its number of procedures, by day; visits without a day come last."""
    counts = entries.where(F.col("mark_type") != "excluded").groupBy("visit").agg(F.countDistinct("procedure").alias("n_procedures"))
    joined = visits.join(counts, "visit", "left").withColumn("n_procedures", F.coalesce("n_procedures", F.lit(0)))
    return joined.orderBy(F.asc_nulls_last("target_day"), "visit")
