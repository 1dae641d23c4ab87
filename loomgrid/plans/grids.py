"""Queries on cell grids: reconciliation, comparison, cleaning, trust and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import grid
from loomgrid.operators import reconcile as rec
from loomgrid.operators import trust
from loomgrid.operators import validate
from loomgrid.operators.reconcile import KEY
from loomgrid.plans.registry import registry
from loomgrid.plans.views import CELLS, ISSUES, PASSES, TIERS, WITH_CELLS, WITH_PASSES, WITH_RECONCILED, cells, issues, pass_of, table, tier, tiers

QUERIES, SQL, query = registry()


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    return rec.reconcile(pass_of(all_cells, 1), pass_of(all_cells, 2), issues(spark, sf_dir), tiers(spark, sf_dir, all_cells))


@query(f"{WITH_RECONCILED} SELECT doc_id, row_ix, col_ix, raw_value, round(confidence, 6) AS confidence, conflict, flagged FROM reconciled")
def d1_reconcile_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir).select(*KEY, "raw_value", F.round("confidence", 6).alias("confidence"), "conflict", "flagged")


@query(f"""{WITH_CELLS},{ISSUES},{TIERS}
SELECT doc_id, row_ix, col_ix, round(confidence, 6) AS confidence, confidence < (CASE WHEN cost_tier IN ('HIGH', 'VERY_HIGH') THEN 0.95 ELSE 0.85 END)::DOUBLE AS flagged
FROM (SELECT doc_id, row_ix, col_ix, cost_tier, (1 - tax) * (1 - coalesce(max_severity, 0) * 0.5::DOUBLE) AS confidence
      FROM cells LEFT JOIN challenged USING (doc_id, row_ix, col_ix) LEFT JOIN tiers USING (doc_id, row_ix, col_ix))""")
def d2_reconcile_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    one = rec.reconcile_single(all_cells.withColumn("confidence", 1 - F.col("tax")), issues(spark, sf_dir), tiers(spark, sf_dir, all_cells))
    return one.select(*KEY, F.round("confidence", 6).alias("confidence"), "flagged")


@query(f"""{WITH_RECONCILED},
votes AS (SELECT doc_id, row_ix, col_ix, raw_value AS raw, 1 AS pass_no FROM p1 UNION ALL SELECT doc_id, row_ix, col_ix, raw_value, 2 FROM p2 UNION ALL SELECT doc_id, row_ix, col_ix, raw_value, 3 FROM p3),
normed AS (SELECT *, lower(regexp_replace(trim(raw), '([A-Z])[a-f]$', '\\1')) AS value FROM votes),
counted AS (
  SELECT doc_id, row_ix, col_ix, value, count(*) AS n, min(pass_no) AS first, arg_max(raw, length(raw) * 10 - pass_no) AS best FROM normed GROUP BY 1, 2, 3, 4),
winner AS (SELECT doc_id, row_ix, col_ix, max(n) AS n, arg_max(best, n * 10 - first) AS best FROM counted GROUP BY 1, 2, 3)
SELECT doc_id, row_ix, col_ix, CASE WHEN ok THEN best ELSE raw_value END AS raw_value, round(CASE WHEN ok THEN 0.9 ELSE confidence END, 6)::DOUBLE AS confidence, ok AS resolved
FROM (SELECT r.*, w.best, coalesce(r.confidence < 0.8 AND p3.doc_id IS NOT NULL AND w.n >= 2, false) AS ok
      FROM reconciled r LEFT JOIN winner w USING (doc_id, row_ix, col_ix) LEFT JOIN p3 USING (doc_id, row_ix, col_ix))""")
def d3_three_way_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    passes = [pass_of(all_cells, n) for n in (1, 2, 3)]
    found = rec.consensus(reconciled(spark, sf_dir), passes)
    return found.select(*KEY, "raw_value", F.round("confidence", 6).alias("confidence"), "resolved")


@query(f"WITH {ISSUES.strip()} SELECT doc_id, row_ix, col_ix, round(max_severity, 6) AS max_severity, n_issues FROM challenged")
def d4_challenge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.challenge_map(issues(spark, sf_dir)).withColumn("max_severity", F.round("max_severity", 6))


@query(f"""{WITH_CELLS},
names AS (
  SELECT name, arg_max(cost_tier, pos * 2 + side) AS cost_tier
  FROM (SELECT lower(p_name) AS name, p_partkey AS pos, 1 AS side, CASE WHEN p_size > 45 THEN 'VERY_HIGH' WHEN p_size > 35 THEN 'HIGH' WHEN p_size > 20 THEN 'MEDIUM' ELSE 'LOW' END AS cost_tier FROM part
        UNION ALL SELECT lower(p_type), p_partkey, 0, CASE WHEN p_size > 45 THEN 'VERY_HIGH' WHEN p_size > 35 THEN 'HIGH' WHEN p_size > 20 THEN 'MEDIUM' ELSE 'LOW' END FROM part) GROUP BY name)
SELECT doc_id, row_ix, col_ix, coalesce(cost_tier, 'LOW') AS cost_tier
FROM (SELECT cells.*, CASE part % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_type ELSE 'no such row' END AS row_header FROM cells JOIN part ON part = p_partkey)
LEFT JOIN names ON lower(row_header) = name WHERE row_header <> ''""")
def d5_cost_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    header = F.when(F.col("part") % 3 == 0, F.upper("p_name")).when(F.col("part") % 3 == 1, F.col("p_type")).otherwise("no such row")
    named = cells(spark, sf_dir).join(parts, F.col("part") == F.col("p_partkey")).withColumn("row_header", header)
    procedures = parts.select(F.col("p_name").alias("raw_name"), F.col("p_type").alias("canonical_name"), F.col("p_partkey").alias("pos"), tier(F.col("p_size")).alias("cost_tier"))
    return rec.cost_map(named, procedures)


@query(f"""{WITH_PASSES}, compared AS (
  SELECT CASE WHEN p3.doc_id IS NULL THEN 'removed' WHEN p1.doc_id IS NULL THEN 'added' WHEN trim(p1.raw_value) = trim(p3.raw_value) THEN 'unchanged' ELSE 'changed' END AS status, row_ix
  FROM p1 FULL JOIN p3 USING (doc_id, row_ix, col_ix))
SELECT row_ix, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'added') AS n_added,
  count(*) FILTER (status = 'removed') AS n_removed,
  round(coalesce(100.0 * count(*) FILTER (status = 'unchanged') / nullif(count(*) FILTER (status IN ('unchanged', 'changed')), 0), 100), 6)::DOUBLE AS stability_pct
FROM compared GROUP BY row_ix""")
def d17_e20_run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    compared = rec.compare_runs(pass_of(all_cells, 1), pass_of(all_cells, 3))
    return rec.stability(compared, ["row_ix"]).withColumn("stability_pct", F.round("stability_pct", 6))


@query(f"""{WITH_PASSES}, weighted AS (SELECT p1.*, CASE status WHEN 'F' THEN 'TEXT' ELSE 'MARKER' END AS data_type, CASE WHEN qty > 40 THEN 25 WHEN qty > 25 THEN 10 WHEN qty > 10 THEN 3 ELSE 1 END AS w FROM p1),
j AS (SELECT a.data_type, a.w, a.doc_id AS ad, b.doc_id AS bd, lower(trim(a.raw_value)) = lower(trim(b.raw_value)) AS eq FROM weighted a FULL JOIN p2 b USING (doc_id, row_ix, col_ix))
SELECT data_type, count(*) FILTER (ad IS NOT NULL AND bd IS NOT NULL) AS n_matched, count(*) FILTER (bd IS NULL) AS n_missing, count(*) FILTER (ad IS NULL) AS n_extra,
  count(*) FILTER (eq) AS n_correct, round(sum(CASE WHEN eq THEN w ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN ad IS NOT NULL AND bd IS NOT NULL THEN w ELSE 0 END), 0), 6) AS accuracy FROM j GROUP BY data_type""")
def d18_e15_weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    weight = F.when(F.col("qty") > 40, 25).when(F.col("qty") > 25, 10).when(F.col("qty") > 10, 3).otherwise(1)
    truth = pass_of(all_cells, 1).withColumn("data_type", F.when(F.col("status") == "F", "TEXT").otherwise("MARKER"))
    return rec.accuracy(truth, pass_of(all_cells, 2), ["data_type"], weight).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""{WITH_PASSES} SELECT CASE WHEN p1.qty > 35 THEN 'hard' WHEN p1.qty > 15 THEN 'moderate' ELSE 'trivial' END AS difficulty, count(*) AS n,
  round(avg(coalesce(lower(p1.raw_value) = lower(p2.raw_value), false)::INT), 6) AS precision_ FROM p1 LEFT JOIN p2 USING (doc_id, row_ix, col_ix) GROUP BY 1""")
def d19_e18_precision_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    got = pass_of(all_cells, 2).select(*KEY, F.col("raw_value").alias("got"))
    difficulty = F.when(F.col("qty") > 35, "hard").when(F.col("qty") > 15, "moderate").otherwise("trivial")
    right = F.coalesce((F.lower("raw_value") == F.lower("got")).cast("int"), F.lit(0))
    return pass_of(all_cells, 1).join(got, KEY, "left").groupBy(difficulty.alias("difficulty")).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("precision_"))


@query(f"""{WITH_PASSES}, runs AS (SELECT doc_id, row_ix, col_ix, trim(raw_value) AS v, 1 AS run FROM p1 UNION ALL SELECT doc_id, row_ix, col_ix, trim(raw_value), 2 FROM p2 UNION ALL SELECT doc_id, row_ix, col_ix, trim(raw_value), 3 FROM p3),
keys AS (SELECT DISTINCT doc_id, row_ix, col_ix FROM runs),
grid AS (SELECT k.*, r.run, coalesce(runs.v, '') AS v FROM keys k CROSS JOIN (SELECT unnest([1, 2, 3]) AS run) r LEFT JOIN runs USING (doc_id, row_ix, col_ix, run)),
top AS (SELECT doc_id, row_ix, col_ix, max(n) AS n FROM (SELECT doc_id, row_ix, col_ix, v, count(*) AS n FROM grid GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, row_ix, col_ix, 3 AS n_runs, round(n / 3.0, 6)::DOUBLE AS stability, n = 3 AS is_stable FROM top""")
def e19_repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    runs = [pass_of(all_cells, n).select(*KEY, "raw_value", F.lit(n).alias("run")) for n in (1, 2, 3)]
    return rec.repeatability(runs[0].union(runs[1]).union(runs[2])).withColumn("stability", F.round("stability", 6))


@query(f"""{WITH_RECONCILED}
SELECT doc_id, count(*) AS n_cells, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (conflict) AS n_conflicts, round(avg(confidence), 9) AS avg_confidence FROM reconciled GROUP BY doc_id""")
def e10_e32_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("n_cells"), F.count_if("flagged").alias("n_flagged"), F.count_if("conflict").alias("n_conflicts"), F.round(F.avg("confidence"), 9).alias("avg_confidence")
    )


_TRUST = """CASE WHEN p2.doc_id IS NULL THEN 0.65 WHEN p1.raw_value = p2.raw_value THEN 1 ELSE 0.3 END * 0.35"""


@query(f"""{WITH_PASSES},{ISSUES}
SELECT doc_id, row_ix, col_ix, round(greatest(0, least(1, ({_TRUST} + CASE WHEN p1.part % 4 = 0 THEN 0 WHEN p1.part % 4 = 1 THEN 0.4 * 0.2 ELSE 0.2 END + 0.2 * (1 - coalesce(max_severity, 0)))
  / (0.55 + CASE WHEN p1.part % 4 = 0 THEN 0 ELSE 0.2 END))), 6)::DOUBLE AS trust
FROM p1 LEFT JOIN p2 USING (doc_id, row_ix, col_ix) LEFT JOIN challenged USING (doc_id, row_ix, col_ix)""")
def e6_cell_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    second = pass_of(all_cells, 2).select(*KEY, F.col("raw_value").alias("other"))
    joined = pass_of(all_cells, 1).join(second, KEY, "left").join(rec.challenge_map(issues(spark, sf_dir)), KEY, "left")
    grounded = F.when(F.col("part") % 4 != 0, F.col("part") % 4 != 1)
    return joined.select(*KEY, F.round(trust.cell_trust(F.col("raw_value") == F.col("other"), grounded, F.col("max_severity")), 6).alias("trust"))


@query(f"""{WITH_RECONCILED}, j AS (SELECT r.*, c.part, p_size FROM reconciled r JOIN cells c USING (doc_id, row_ix, col_ix) JOIN part ON p_partkey = c.part),
g AS (SELECT row_ix, p_size, count(*) AS n_cells, avg(confidence) AS a, count(*) FILTER (flagged) AS n_flagged FROM j GROUP BY 1, 2)
SELECT row_ix, p_size, n_cells, n_flagged, round(greatest(0, least(1, a * 0.75 + CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0.95 ELSE 0.6 END * 0.15
  + CASE WHEN p_size % 3 > 0 THEN (p_size % 3 - 1) / (p_size % 3)::DOUBLE ELSE 1 END * 0.10 + CASE WHEN p_size % 2 = 0 THEN 1 WHEN p_size % 5 = 0 THEN 0.8 ELSE 0.3 END * 0.05 - n_flagged * 0.05)), 6)::DOUBLE AS composite FROM g""")
def e7_row_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_size")
    size = F.col("p_size")
    joined = reconciled(spark, sf_dir).join(cells(spark, sf_dir).select(*KEY, "part"), KEY).join(parts, "part")
    described = joined.withColumns(
        {
            "match_method": F.when(size % 4 == 0, "unmatched").when(size % 4 == 1, "exact").when(size % 4 == 2, "alias").otherwise("fuzzy"),
            "match_score": F.lit(0.6),
            "has_code": size % 2 == 0,
            "effort_based": size % 5 == 0,
            "footnotes": size % 3,
            "footnotes_resolved": F.greatest(size % 3 - 1, F.lit(0)),
        }
    )
    return trust.row_trust(described, ["row_ix", "p_size"]).select("row_ix", "p_size", "n_cells", "n_flagged", F.round("composite", 6).alias("composite"))


@query(f"""{WITH_RECONCILED}, j AS (SELECT r.*, c.part, c.supp, c.qty FROM reconciled r JOIN cells c USING (doc_id, row_ix, col_ix)),
g AS (SELECT supp, count(*) AS n, count(*) FILTER (confidence >= 0.9) AS n_high, count(*) FILTER (confidence < 0.9 AND confidence >= 0.75) AS n_medium, count(*) FILTER (confidence < 0.75) AS n_low,
  count(DISTINCT CASE WHEN flagged THEN row_ix * 100 + col_ix END) AS n_flagged, (count(*) - count(*) FILTER (conflict)) / count(*)::DOUBLE AS agreement, count(*) FILTER (part % 6 <> 0) / count(*)::DOUBLE AS mapping,
  sum(CASE WHEN qty > 30 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN qty > 20 THEN 1 ELSE 0 END), 1)::DOUBLE AS notes, avg(confidence) AS a, count(*) FILTER (part % 6 = 0) AS n_unmapped FROM j GROUP BY supp)
SELECT supp, n AS n_cells, n_high, n_medium, n_low, n_flagged, round(least(1, a * 0.40 + agreement * 0.25 + mapping * 0.20 + notes * 0.15), 4)::DOUBLE AS overall,
  CASE WHEN mapping >= 0.9 AND agreement >= 0.95 THEN 'HIGH' WHEN mapping >= 0.7 AND agreement >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS budget_confidence, floor(n_flagged * 0.5 + n_unmapped * 2)::INT AS review_minutes FROM g""")
def e8_e9_document_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = reconciled(spark, sf_dir).join(cells(spark, sf_dir).select(*KEY, "part", "supp", "qty"), KEY)
    described = joined.withColumns({"is_mapped": F.col("part") % 6 != 0, "note_markers": (F.col("qty") > 20).cast("int"), "note_resolved": (F.col("qty") > 30).cast("int")})
    found = trust.document_trust(described, ["supp"])
    return found.select("supp", "n_cells", "n_high", "n_medium", "n_low", "n_flagged", F.round("overall", 4).alias("overall"), "budget_confidence", "review_minutes")


_RAW = "CASE part % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Section 4.1' WHEN 2 THEN 'SAE' WHEN 3 THEN 'Vital signs' WHEN 4 THEN '12.5' WHEN 5 THEN repeat('body ', 40) ELSE raw_value END"
_DATA_TYPE = "CASE WHEN v = '' THEN 'EMPTY' WHEN regexp_matches(v, '^[XxYy][A-Ga-g,0-9\\s^]*$') OR upper(v) IN ('YES') THEN 'MARKER' WHEN regexp_matches(v, '^[0-9]+(\\.[0-9]+)?$') THEN 'NUMERIC' ELSE 'TEXT' END"


def messy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("part") % 9
    raw = F.when(k == 0, "N/A").when(k == 1, "Section 4.1").when(k == 2, "SAE").when(k == 3, "Vital signs").when(k == 4, "12.5").when(k == 5, F.repeat(F.lit("body "), 40)).otherwise(F.col("raw_value"))
    rows = cells(spark, sf_dir).withColumn("raw_value", raw).withColumn("col_ix", (F.col("col_ix") - 1).cast("int"))
    return rows.withColumn("data_type", grid.data_type(F.col("raw_value"))).withColumn("confidence", 1 - F.col("disc"))


MESSY = f"""{WITH_CELLS}, messy AS (SELECT doc_id, row_ix, (col_ix - 1)::INT AS col_ix, v AS raw_value, {_DATA_TYPE.replace("v ", "trim(v) ").replace("(v,", "(trim(v),").replace("upper(v)", "upper(trim(v))")} AS data_type, 1 - disc AS confidence
  FROM (SELECT *, {_RAW} AS v FROM cells))"""


@query(f"""{MESSY}, judged AS (SELECT *, lower(trim(raw_value)) IN ('none', 'null', 'n/a', 'nan') AS nul,
  col_ix = 0 AND data_type = 'TEXT' AND (raw_value LIKE 'Section %' OR lower(raw_value) = 'sae' OR length(trim(raw_value)) > 150) AS noise FROM messy WHERE row_ix <= 500 AND col_ix <= 200)
SELECT doc_id, row_ix, col_ix, CASE WHEN nul OR noise THEN '' ELSE raw_value END AS raw_value, CASE WHEN nul OR noise THEN 'EMPTY' ELSE data_type END AS data_type,
  round(CASE WHEN nul THEN least(confidence, 0.3) WHEN noise THEN 0.1 ELSE confidence END, 6)::DOUBLE AS confidence FROM judged""")
def c5_c6_c10_clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.clean_cells(messy_cells(spark, sf_dir))
    return found.select(*KEY, "raw_value", "data_type", F.round("confidence", 6).alias("confidence"))


@query(f"""{MESSY} SELECT doc_id, count(*) AS n_cells, max(row_ix) - min(row_ix) + 1 - count(DISTINCT row_ix) AS missing_rows, count(*) - count(DISTINCT row_ix * 100 + col_ix) AS duplicates,
  round(avg((lower(trim(raw_value)) IN ('none', 'null', 'n/a', 'nan'))::INT), 6) AS null_share,
  CASE WHEN avg((lower(trim(raw_value)) IN ('none', 'null', 'n/a', 'nan'))::INT) > 0.2 THEN 'error' WHEN (max(row_ix) - min(row_ix) + 1 - count(DISTINCT row_ix)) > 0.3 * (max(row_ix) - min(row_ix) + 1) THEN 'warning' ELSE 'ok' END AS verdict
  FROM messy GROUP BY doc_id""")
def e22_structural_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.structure(messy_cells(spark, sf_dir), ["doc_id"]).withColumn("null_share", F.round("null_share", 6))


@query(f"""{WITH_CELLS}, per_row AS (SELECT doc_id, row_ix, count(*) AS n FROM cells GROUP BY 1, 2), common AS (SELECT doc_id, arg_max(n, k * 1000 - n) AS usual FROM (SELECT doc_id, n, count(*) AS k FROM per_row GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, row_ix, n, usual FROM per_row JOIN common USING (doc_id) WHERE n <> usual""")
def e22_rows_of_unusual_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.unusual_rows(cells(spark, sf_dir))


@query(f"""{WITH_CELLS}, b AS (SELECT doc_id, max(row_ix) AS rows_, max(col_ix) AS cols FROM cells GROUP BY 1),
g AS (SELECT doc_id, r AS row_ix, unnest(range(1, cols + 1)) AS col_ix FROM (SELECT *, unnest(range(1, rows_ + 1)) AS r FROM b))
SELECT doc_id, row_ix::INT AS row_ix, col_ix::INT AS col_ix, coalesce(raw_value, 'EMPTY') AS raw_value FROM g LEFT JOIN cells USING (doc_id, row_ix, col_ix)""")
def b5_dense_review_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dense_grid(cells(spark, sf_dir), F.col("raw_value"), "EMPTY")


@query(f"""{WITH_PASSES} SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id, row_ix, col_ix FROM p1 INTERSECT SELECT doc_id, row_ix, col_ix FROM p2)
UNION ALL SELECT 'first only', count(*) FROM (SELECT doc_id, row_ix, col_ix FROM p1 EXCEPT SELECT doc_id, row_ix, col_ix FROM p2)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id, row_ix, col_ix FROM p1 UNION SELECT doc_id, row_ix, col_ix FROM p2)
UNION ALL SELECT 'bag', (SELECT count(*) FROM p1) + (SELECT count(*) FROM p2)""")
def h1_h5_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    a, b = (pass_of(all_cells, n).select(*KEY) for n in (1, 2))
    sets = {"both": a.intersect(b), "first only": a.exceptAll(b), "either": a.union(b).distinct(), "bag": a.unionByName(b)}
    out = None
    for name, rows in sets.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


_CRITIQUE = {
    "conflict": ("high", "conflict"), "low confidence": ("medium", "confidence < 0.6"), "empty costly": ("high", "raw_value = '' AND cost_tier IN ('HIGH', 'VERY_HIGH')"),
    "challenged": ("medium", "max_severity IS NOT NULL"), "flagged": ("low", "flagged"), "unpriced": ("low", "cost_tier IS NULL"),
}


@query(WITH_RECONCILED + " UNION ALL ".join(f" SELECT '{k}' AS category, '{s}' AS severity, count(*) AS n FROM reconciled WHERE {c}" for k, (s, c) in _CRITIQUE.items()))
def c22_review_critique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six categories in one scan of the reconciled cells, the severest first."""
    counts = reconciled(spark, sf_dir).agg(*[F.count_if(F.expr(c)).alias(k) for k, (_, c) in _CRITIQUE.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.lit(s).alias("severity"), F.col(f"`{k}`").alias("n")) for k, (s, _) in _CRITIQUE.items()])).alias("r")).select("r.*")
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return rows.orderBy(rank, "category")


@query(f"""{WITH_CELLS}, log AS (SELECT doc_id, row_ix, col_ix, arg_max(v, at_) AS v FROM (SELECT l_orderkey AS doc_id, l_linenumber::INT AS row_ix, (l_suppkey % 8 + 1)::INT AS col_ix, l_partkey * 100000 + l_suppkey AS at_, 'fixed ' || l_partkey AS v FROM lineitem WHERE l_partkey % 19 = 0) GROUP BY 1, 2, 3)
SELECT doc_id, row_ix, col_ix, coalesce(v, raw_value) AS raw_value, v IS NOT NULL AS corrected FROM cells LEFT JOIN log USING (doc_id, row_ix, col_ix)""")
def d31_k6_latest_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_partkey % 19 = 0")
    log = li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row_ix"), (F.col("l_suppkey") % 8 + 1).cast("int").alias("col_ix"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("at"), F.concat(F.lit("fixed "), F.col("l_partkey").cast("string")).alias("value"),
    )
    return validate.apply_corrections(cells(spark, sf_dir), log).select(*KEY, "raw_value", "corrected")
