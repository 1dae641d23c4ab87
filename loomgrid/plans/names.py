"""Queries on vocabularies, budgets and schedules. The vocabulary is made of part types, with brands as aliases of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import grid
from loomgrid.operators import budget, vocabulary
from loomgrid.plans.registry import registry
from loomgrid.plans.views import TIER, table, tier

QUERIES, SQL, query = registry()


def part_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each part name: its first part's type, size band and code; brands of its parts are aliases."""
    parts = table(spark, sf_dir, "part")
    return parts.groupBy(F.col("p_name").alias("canonical_name")).agg(
        F.min("p_partkey").alias("entry_ix"),
        F.min_by(F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey").cast("string")), F.col("p_partkey")).alias("code"),
        F.min_by("p_type", "p_partkey").alias("category"),
        F.min_by(tier(F.col("p_size")), F.col("p_partkey")).alias("cost_tier"),
        F.array_sort(F.collect_set(F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")))).alias("aliases"),
    )


VOCABULARY = f"""vocabulary AS (
  SELECT p_name AS canonical_name, min(p_partkey) AS entry_ix, (CASE WHEN min(p_partkey) % 3 <> 0 THEN min(p_partkey)::VARCHAR END) AS code,
    arg_min(p_type, p_partkey) AS category, arg_min({TIER}, p_partkey) AS cost_tier, list_sort(list_distinct(list(p_type || ' ' || p_name))) AS aliases
  FROM part GROUP BY p_name),
alias AS (SELECT alias, min(entry_ix) AS entry_ix FROM (
  SELECT lower(canonical_name) AS alias, entry_ix FROM vocabulary UNION ALL SELECT lower(unnest(aliases)), entry_ix FROM vocabulary) GROUP BY alias)"""


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as they may be written: upper case, with a mark, with more after them, within a phrase, or something else."""
    name, k = F.col("p_name"), F.col("p_partkey") % 6
    raw = (
        F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit("²"))).when(k == 2, F.concat(name, F.lit("5"))).when(k == 3, F.concat(name, F.lit(" (fasting)")))
        .when(k == 4, F.concat(F.lit("pre-dose "), name, F.lit(" panel"))).otherwise(F.concat(F.lit("unknown "), F.col("p_brand")))
    )
    return table(spark, sf_dir, "part").select(raw.alias("raw_name"))


RAW = """raw AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '²' WHEN 2 THEN p_name || '5' WHEN 3 THEN p_name || ' (fasting)'
  WHEN 4 THEN 'pre-dose ' || p_name || ' panel' ELSE 'unknown ' || p_brand END AS raw_name FROM part)"""

NORMALISED = f"""WITH {VOCABULARY}, {RAW},
plain AS (SELECT raw_name, regexp_replace(raw_name, '[²³⁴⁵⁶⁷⁸⁹¹⁰]+$', '') AS p FROM raw),
clean AS (SELECT raw_name, CASE WHEN regexp_replace(p, '([a-zA-Z])[0-9]$', '\\1') <> p AND lower(regexp_replace(p, '([a-zA-Z])[0-9]$', '\\1')) IN (SELECT alias FROM alias)
  THEN regexp_replace(p, '([a-zA-Z])[0-9]$', '\\1') ELSE p END AS cleaned FROM plain),
hits AS (
  SELECT raw_name, entry_ix, 1 AS step, 0 AS k FROM clean JOIN alias ON lower(cleaned) = alias
  UNION ALL SELECT raw_name, entry_ix, 2, -length(alias) FROM clean JOIN alias ON length(alias) >= 5 AND starts_with(lower(cleaned), alias)
  UNION ALL SELECT raw_name, entry_ix, 3, 0 FROM clean JOIN alias ON length(alias) >= 3 AND contains(' ' || regexp_replace(lower(cleaned), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(alias, '[^a-z0-9]+', ' ', 'g') || ' ')),
best AS (SELECT raw_name, step, entry_ix FROM (SELECT *, row_number() OVER (PARTITION BY raw_name ORDER BY step, k, entry_ix) AS rn FROM hits) WHERE rn = 1),
normalised AS (SELECT raw_name, cleaned, coalesce(canonical_name, cleaned) AS canonical_name, coalesce(category, 'Unknown') AS category, coalesce(cost_tier, 'LOW') AS cost_tier,
  CASE step WHEN 1 THEN 'exact' WHEN 2 THEN 'starts_with' WHEN 3 THEN 'word_match' ELSE 'unmatched' END AS method
  FROM clean LEFT JOIN best USING (raw_name) LEFT JOIN vocabulary USING (entry_ix))"""


@query(f"{NORMALISED} SELECT * FROM normalised")
def d7_d8_i2_normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocabulary.normalise(raw_names(spark, sf_dir), part_vocabulary(spark, sf_dir))
    return found.select("raw_name", "cleaned", "canonical_name", "category", "cost_tier", "method")


@query(f"{NORMALISED} SELECT category AS \"group\", count(*) AS n, count(*) FILTER (method = 'unmatched') AS n_unmatched, round(avg((method <> 'unmatched')::INT), 6) AS match_rate FROM normalised GROUP BY category")
def e14_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocabulary.normalise(raw_names(spark, sf_dir), part_vocabulary(spark, sf_dir))
    return vocabulary.match_report(found, F.col("category")).withColumn("match_rate", F.round("match_rate", 6))


@query(f"WITH {VOCABULARY} SELECT category, cost_tier, count(*) AS n_entries, sum(len(aliases))::BIGINT AS n_aliases, count(code) AS n_codes FROM vocabulary GROUP BY GROUPING SETS ((), (category), (cost_tier))")
def e13_vocabulary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.statistics(part_vocabulary(spark, sf_dir))


@query(f"""WITH {VOCABULARY}, {RAW}, w AS (SELECT DISTINCT r.raw_name, a.alias FROM (SELECT raw_name, unnest(regexp_split_to_array(lower(raw_name), '[^a-z0-9]+')) AS w FROM raw) r
  JOIN (SELECT alias, unnest(regexp_split_to_array(alias, '[^a-z0-9]+')) AS w FROM alias) a USING (w) WHERE length(w) > 1),
t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(raw_name), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS ta, list_distinct(list_filter(regexp_split_to_array(alias, '[^a-z0-9]+'), lambda x: length(x) > 1)) AS tb FROM w),
s AS (SELECT raw_name, alias, greatest(1 - levenshtein(lower(raw_name), alias) / greatest(length(raw_name), length(alias))::DOUBLE, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE) AS score FROM t)
SELECT raw_name, round(max(score), 6) AS score, alias FROM (SELECT *, row_number() OVER (PARTITION BY raw_name ORDER BY score DESC, alias) AS rn FROM s WHERE score >= 0.7) WHERE rn = 1 GROUP BY raw_name, alias""")
def d33_i3_i4_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = raw_names(spark, sf_dir).distinct()
    return vocabulary.similar(names, vocabulary.aliases_of(part_vocabulary(spark, sf_dir))).withColumn("score", F.round("score", 6))


def part_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_partkey % 10 = 0")
    k = (F.col("p_partkey") / 10).cast("long") % 3
    action = F.when(k == 0, "add").when(k == 1, "update_aliases").otherwise("update_code")
    name = F.when(k == 0, F.concat(F.lit("new "), F.col("p_brand"))).otherwise(F.upper("p_name"))
    return parts.select(name.alias("canonical_name"), action.alias("action"), F.col("p_brand").alias("code"), F.array(F.col("p_brand")).alias("aliases"), F.col("p_partkey").alias("pos"))


@query(f"""WITH {VOCABULARY}, c AS (SELECT CASE (p_partkey // 10) % 3 WHEN 0 THEN 'new ' || p_brand ELSE upper(p_name) END AS name, (p_partkey // 10) % 3 AS k, p_brand, p_partkey AS pos FROM part WHERE p_partkey % 10 = 0),
latest AS (SELECT lower(name) AS key, arg_max(p_brand, pos) FILTER (k = 2) AS new_code, list_sort(list_distinct(coalesce(list(p_brand) FILTER (k IN (0, 1)), []))) AS more, arg_max(name, pos) FILTER (k = 0) AS added FROM c GROUP BY 1)
SELECT coalesce(canonical_name, added) AS canonical_name, coalesce(new_code, code) AS code, len(list_distinct(list_concat(coalesce(aliases, []), coalesce(more, []))))::INT AS n_aliases, canonical_name IS NULL AS is_new
FROM vocabulary FULL JOIN latest ON lower(canonical_name) = key WHERE canonical_name IS NOT NULL OR added IS NOT NULL""")
def a18_b7_vocabulary_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocabulary.overlay(part_vocabulary(spark, sf_dir), part_corrections(spark, sf_dir))
    return found.select("canonical_name", "code", F.size("aliases").alias("n_aliases"), "is_new")


@query(f"WITH {VOCABULARY} SELECT canonical_name, category FROM vocabulary WHERE contains(lower(canonical_name), 'ring') OR len(list_filter(aliases, lambda a: contains(lower(a), 'ring'))) > 0 OR code = 'ring' ORDER BY canonical_name, entry_ix LIMIT 20")
def c19_library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of search results: the limit is the feature."""
    return vocabulary.search(part_vocabulary(spark, sf_dir), "ring", 20).select("canonical_name", "category")


@query("""WITH k AS (SELECT p_partkey, lower(trim(p_name)) AS key FROM part UNION ALL SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'ab' ELSE 'visit window' END FROM part)
SELECT p_partkey, key, length(key) < 3 OR key IN ('visit', 'month', 'week', 'day', 'year') OR contains(key, 'window') OR contains(key, 'bolt') AS excluded FROM k""")
def c1_not_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    other = F.when(k == 0, "day").when(k == 1, "ab").otherwise("visit window")
    rows = parts.select("p_partkey", F.lower(F.trim("p_name")).alias("key")).union(parts.select("p_partkey", other))
    return rows.withColumn("excluded", grid.is_not_procedure(F.col("key"), ["window", "bolt"]))


_ENTRIES = f"""entries AS (
  SELECT p_name AS procedure, p_type AS category, {TIER} AS cost_tier, 'V' || lpad(month(l_shipdate)::VARCHAR, 2, '0') AS visit, l_suppkey % 3 AS table_id, l_orderkey, 1 - l_discount AS confidence,
    CASE WHEN l_returnflag = 'R' THEN 'X' WHEN l_returnflag = 'A' THEN 'as needed' WHEN l_linestatus = 'O' THEN '--Weekly (Day 1 through Day ' || (l_linenumber * 10)::VARCHAR || ')--' ELSE '' END AS raw_value, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey),
marked AS (SELECT *, CASE WHEN raw_value = '' THEN 'empty' WHEN raw_value = 'X' THEN 'firm' WHEN raw_value = 'as needed' THEN 'conditional' ELSE 'span' END AS mark_type,
  CASE WHEN raw_value = '' THEN 0 WHEN raw_value LIKE '--%' THEN greatest(1, l_linenumber * 10 // 7) ELSE 1 END AS occ FROM entries)"""


def visit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of procedures (part names) by visit (month of shipping): X, conditional text, weekly spans, or empty."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    span = F.concat(F.lit("--Weekly (Day 1 through Day "), (F.col("l_linenumber") * 10).cast("string"), F.lit(")--"))
    raw = F.when(F.col("l_returnflag") == "R", "X").when(F.col("l_returnflag") == "A", "as needed").when(F.col("l_linestatus") == "O", span).otherwise("")
    return joined.select(
        F.col("p_name").alias("procedure"), F.col("p_type").alias("category"), tier(F.col("p_size")).alias("cost_tier"),
        F.concat(F.lit("V"), F.lpad(F.month("l_shipdate").cast("string"), 2, "0")).alias("visit"), (F.col("l_suppkey") % 3).alias("table_id"), (1 - F.col("l_discount")).alias("confidence"), raw.alias("raw_value"),
    )


@query(f"""WITH {_ENTRIES} SELECT table_id, procedure, count(*) FILTER (mark_type IN ('firm', 'span')) AS n_firm, count(*) FILTER (mark_type = 'conditional') AS n_conditional,
  sum(occ)::BIGINT AS total_occurrences, array_to_string(list_sort(list_distinct(list(visit) FILTER (mark_type IN ('firm', 'span')))), ',') AS firm_visits, round(avg(confidence), 9) AS avg_confidence
  FROM marked GROUP BY 1, 2 HAVING sum(occ) > 0""")
def e1_i7_c9_budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = budget.budget_lines(visit_cells(spark, sf_dir), ["table_id", "procedure"])
    return lines.select("table_id", "procedure", "n_firm", "n_conditional", "total_occurrences", F.array_join("firm_visits", ",").alias("firm_visits"), F.round("avg_confidence", 9).alias("avg_confidence"))


@query(f"""WITH {_ENTRIES}, lines AS (SELECT table_id, procedure, sum(occ)::BIGINT AS total, list_distinct(list(visit) FILTER (mark_type IN ('firm', 'span'))) AS visits FROM marked GROUP BY 1, 2 HAVING sum(occ) > 0)
SELECT procedure, max(total) AS total_occurrences, count(*) AS n_tables, len(list_distinct(flatten(list(visits))))::INT AS n_visits FROM lines GROUP BY 1""")
def e2_merge_budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = budget.budget_lines(visit_cells(spark, sf_dir), ["table_id", "procedure"])
    return budget.merge_lines(lines, ["procedure"]).select("procedure", "total_occurrences", "n_tables", F.size("firm_visits").alias("n_visits"))


@query(f"""WITH {_ENTRIES}, lines AS (SELECT category, cost_tier, procedure, count(*) FILTER (mark_type IN ('firm', 'span')) AS n_firm, sum(occ)::BIGINT AS total FROM marked GROUP BY 1, 2, 3 HAVING sum(occ) > 0)
SELECT category, count(*) AS n_lines, sum(n_firm * c)::BIGINT AS firm_total, sum(total * c)::BIGINT AS up_to_total, grouping(category)::INT AS is_total
FROM (SELECT *, CASE cost_tier WHEN 'LOW' THEN 75 WHEN 'MEDIUM' THEN 350 WHEN 'HIGH' THEN 1200 ELSE 3500 END AS c FROM lines) GROUP BY ROLLUP (category)""")
def e36_b3_f7_budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.totals(budget.budget_lines(visit_cells(spark, sf_dir), ["category", "cost_tier", "procedure"]))


def schedule_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visit_cells(spark, sf_dir).withColumn("m", grid.mark(F.col("raw_value")))
    return rows.select("procedure", "category", "visit", F.when(F.col("m.mark_type") == "empty", "excluded").otherwise(F.col("m.mark_type")).alias("mark_type"), F.coalesce("m.occurrences", F.lit(1)).alias("occurrences"))


@query(f"""WITH {_ENTRIES}, e AS (SELECT * FROM marked WHERE mark_type <> 'empty')
SELECT procedure, category, sum(CASE WHEN mark_type <> 'conditional' THEN occ ELSE 0 END)::BIGINT AS firm, sum(CASE WHEN mark_type = 'conditional' THEN occ ELSE 0 END)::BIGINT AS conditional, sum(occ)::BIGINT AS total,
  count(DISTINCT visit)::INT AS n_visits FROM e GROUP BY 1, 2""")
def e3_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = budget.schedule(schedule_entries(spark, sf_dir), ["procedure", "category"])
    return found.select("procedure", "category", "firm", "conditional", "total", F.size("visits").alias("n_visits"))


@query(f"""WITH {_ENTRIES} SELECT procedure, count(*) AS n_entries, sum(greatest(occ, 1))::BIGINT AS total, bool_or(mark_type = 'conditional') AS ever_conditional, count(DISTINCT visit) AS n_visits FROM marked GROUP BY 1""")
def e4_procedure_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.frequency(schedule_entries(spark, sf_dir), ["procedure"])


@query(f"""WITH {_ENTRIES}, v AS (SELECT 'V' || lpad(i::VARCHAR, 2, '0') AS visit, CASE WHEN i <= 12 THEN i * 30 END AS target_day FROM range(1, 15) t(i))
SELECT visit, target_day::DOUBLE AS target_day, count(DISTINCT procedure) FILTER (mark_type <> 'empty') AS n_procedures FROM v LEFT JOIN marked USING (visit) GROUP BY 1, 2""")
def e5_g1_visit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = spark.range(1, 15).select(F.concat(F.lit("V"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("visit"), F.when(F.col("id") <= 12, F.col("id") * 30).cast("double").alias("target_day"))
    return budget.timeline(visits, schedule_entries(spark, sf_dir))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ', ' || p_type || ', a' WHEN 1 THEN p_name || ', pain and ' || p_type WHEN 2 THEN p_name ELSE p_type || ',b' END AS name FROM part),
t AS (SELECT *, list_filter(list_transform(string_split(name, ','), lambda x: trim(x)), lambda x: length(x) >= 3) AS terms FROM r)
SELECT p_partkey, unnest(CASE WHEN len(terms) >= 2 AND len(list_filter(terms, lambda x: length(x) > 60)) = 0 AND len(list_filter(terms[2:], lambda x: regexp_matches(x, '(?i)leading to|relevant to|and |or '))) = 0 THEN terms ELSE [name] END) AS term FROM t""")
def i8_split_compound_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    raw = F.when(k == 0, F.concat(name, F.lit(", "), F.col("p_type"), F.lit(", a"))).when(k == 1, F.concat(name, F.lit(", pain and "), F.col("p_type"))).when(k == 2, name).otherwise(F.concat("p_type", F.lit(",b")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(grid.compound_terms(raw)).alias("term"))


@query(f"""WITH n AS (SELECT p_partkey, p_name, {TIER} AS tier, CASE p_type WHEN 'PROMO' THEN 'INFUSION' WHEN 'LARGE' THEN 'BIOPSY' WHEN 'SMALL' THEN 'LOW' END AS override FROM part),
c AS (SELECT *, CASE tier WHEN 'LOW' THEN 75 WHEN 'MEDIUM' THEN 350 WHEN 'HIGH' THEN 1200 ELSE 3500 END AS cur, CASE override WHEN 'INFUSION' THEN 2500 WHEN 'BIOPSY' THEN 4000 WHEN 'LOW' THEN 75 END AS ov FROM n)
SELECT p_partkey, coalesce(override, tier) AS cost_tier, CASE WHEN ov IS NOT NULL AND ov <> cur THEN round(ov / cur::DOUBLE, 2) END AS multiplier FROM c""")
def d16_n6_cost_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.operators.graph import cost_override

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("canonical"), tier(F.col("p_size")).alias("cost_tier"))
    overrides = spark.createDataFrame([("PROMO", "INFUSION"), ("LARGE", "BIOPSY"), ("SMALL", "LOW")], "canonical string, override string")
    return cost_override(rows, overrides).select("p_partkey", "cost_tier", "multiplier")


@query("""WITH d AS (SELECT DISTINCT c_custkey, lower(left(c_name, 20)) AS k FROM customer), s AS (SELECT s_suppkey, lower(left(replace(s_name, 'Supplier', 'Customer'), 20)) AS k FROM supplier)
SELECT s_suppkey, c_custkey FROM s JOIN d USING (k)""")
def d26_d30_approximate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.left("c_name", F.lit(20))).alias("k")).distinct()
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.left(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")), F.lit(20))).alias("k"))
    return suppliers.join(customers, "k").select("s_suppkey", "c_custkey")


@query("""SELECT l_orderkey, l_linenumber, coalesce(h.name, 'Visit ' || (l_suppkey % 8)::VARCHAR) AS visit FROM lineitem LEFT JOIN (SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 5) h ON l_suppkey % 8 = k""")
def d24_visit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 8).alias("k"))
    return rows.join(headers, "k", "left").select("l_orderkey", "l_linenumber", F.coalesce("name", F.concat(F.lit("Visit "), F.col("k").cast("string"))).alias("visit"))
