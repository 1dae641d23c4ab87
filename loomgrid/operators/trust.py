"""Trust scores of cells, rows and documents, and review effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights, bands and minutes.
PASSES, OCR, CHALLENGER, MAPPING, FOOTNOTES = 0.35, 0.20, 0.20, 0.15, 0.10
HIGH, MEDIUM = 0.90, 0.75
MINUTES_FLAGGED, MINUTES_UNMAPPED = 0.5, 2.0
MATCH_SCORES = {"unmatched": 0.0, "exact": 1.0, "alias": 0.95, "starts_with": 0.85}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cell_trust(passes_agree: Column, ocr_grounded: Column, max_severity: Column) -> Column:
    """passes_agree null: one pass only; ocr_grounded null: not checked, its weight goes to the rest."""
    passes = F.when(passes_agree.isNull(), 0.65).when(passes_agree, 1.0).otherwise(0.30)
    ocr = F.when(ocr_grounded.isNull(), 0.0).when(ocr_grounded, 1.0).otherwise(0.40)
    weights = PASSES + CHALLENGER + F.when(ocr_grounded.isNull(), 0.0).otherwise(OCR)
    return clamp((PASSES * passes + OCR * ocr + CHALLENGER * (1 - F.coalesce(max_severity, F.lit(0.0)))) / weights)


def row_trust(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells has confidence, flagged, and constant by group: match_method, match_score, has_code, effort_based, footnotes, footnotes_resolved."""
    first = {c: F.max(c) for c in ("match_method", "match_score", "has_code", "effort_based", "footnotes", "footnotes_resolved")}
    rows = cells.groupBy(*by).agg(F.count("*").alias("n_cells"), F.avg("confidence").alias("avg_confidence"), F.count_if("flagged").alias("n_flagged"), *[v.alias(k) for k, v in first.items()])
    match = F.when(F.lit(False), 0.0)
    for name, value in MATCH_SCORES.items():
        match = match.when(F.col("match_method") == name, value)
    code = F.when(F.col("has_code"), 1.0).when(F.col("effort_based"), 0.8).otherwise(0.3)
    notes = F.when(F.col("footnotes") > 0, F.col("footnotes_resolved") / F.greatest("footnotes", F.lit(1))).otherwise(1.0)
    whole = F.col("avg_confidence") * (PASSES + OCR + CHALLENGER) + match.otherwise(F.col("match_score")) * MAPPING + notes * FOOTNOTES + code * 0.05
    return rows.withColumn("composite", clamp(whole - F.col("n_flagged") * 0.05))


def document_trust(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells has confidence, conflict, flagged, row_ix, col_ix, is_mapped, note_markers and note_resolved; flagged places count once over all tables."""
    n = F.count("*")
    agreement = (n - F.count_if("conflict")) / n
    mapping = F.count_if("is_mapped") / n
    notes = F.sum("note_resolved") / F.greatest(F.sum("note_markers"), F.lit(1))
    rows = cells.groupBy(*by).agg(
        n.alias("n_cells"),
        F.count_if(F.col("confidence") >= HIGH).alias("n_high"),
        F.count_if((F.col("confidence") < HIGH) & (F.col("confidence") >= MEDIUM)).alias("n_medium"),
        F.count_if(F.col("confidence") < MEDIUM).alias("n_low"),
        F.countDistinct(F.when(F.col("flagged"), F.struct("row_ix", "col_ix"))).alias("n_flagged"),
        agreement.alias("agreement"),
        mapping.alias("mapping"),
        F.least(F.lit(1.0), F.avg("confidence") * 0.40 + agreement * 0.25 + mapping * 0.20 + notes * 0.15).alias("overall"),
        F.count_if(~F.col("is_mapped")).alias("n_unmapped"),
    )
    band = F.when((F.col("mapping") >= 0.90) & (F.col("agreement") >= 0.95), "HIGH").when((F.col("mapping") >= 0.70) & (F.col("agreement") >= 0.80), "MEDIUM").otherwise("LOW")
    return rows.withColumn("budget_confidence", band).withColumn("review_minutes", review_minutes(F.col("n_flagged"), F.col("n_unmapped")))


def review_minutes(flagged: Column, unmapped: Column) -> Column:
    return F.floor(flagged * MINUTES_FLAGGED + unmapped * MINUTES_UNMAPPED).cast("int")
