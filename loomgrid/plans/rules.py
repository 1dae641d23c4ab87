"""Queries on classifiers, stores, contexts and layout profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import classify, temporal
from loomgrid.functions.text import style_score
from loomgrid.plans.registry import registry
from loomgrid.plans.views import KEY, WITH_CELLS, cells, table

QUERIES, SQL, query = registry()


_TITLE = "CASE doc_id % 5 WHEN 0 THEN 'Schedule of Activities' WHEN 1 THEN 'Adverse events' WHEN 2 THEN NULL WHEN 3 THEN 'Table 2' ELSE 'Study procedures matrix' END"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: a title, marks, cells, visit columns, rows, columns."""
    k = F.col("doc_id") % 5
    title = F.when(k == 0, "Schedule of Activities").when(k == 1, "Adverse events").when(k == 2, F.lit(None)).when(k == 3, "Table 2").otherwise("Study procedures matrix")
    rows = cells(spark, sf_dir).groupBy("doc_id").agg(
        F.count_if(F.col("raw_value") != "").alias("markers"), F.count("*").alias("n"), F.countDistinct("col_ix").alias("visits"), F.max("row_ix").alias("rows"), F.max("col_ix").alias("cols")
    )
    return rows.withColumn("title", title).withColumn("in_section", F.col("doc_id") % 3 == 0)


_SIGNALS = f"""{WITH_CELLS}, s AS (SELECT doc_id, count(*) FILTER (raw_value <> '') AS markers, count(*) AS n, count(DISTINCT col_ix) AS visits, max(row_ix) AS rows_, max(col_ix) AS cols, {_TITLE} AS title, doc_id % 3 = 0 AS in_section FROM cells GROUP BY doc_id)"""


@query(f"""{_SIGNALS}, c AS (SELECT doc_id, CASE WHEN title = 'Adverse events' THEN 1 WHEN title IN ('Schedule of Activities', 'Study procedures matrix') THEN 2 WHEN in_section AND markers >= 3 THEN 3 WHEN in_section AND rows_ >= 5 AND cols >= 4 THEN 4
  WHEN markers / n > 0.3 AND visits >= 2 THEN 5 WHEN markers / n > 0.2 AND rows_ >= 8 THEN 6 ELSE 7 END AS k FROM s) SELECT doc_id, CASE WHEN k IN (1, 7) THEN 'OTHER' ELSE 'SOA' END AS kind, [0.8, 0.9, 0.85, 0.7, 0.75, 0.6, 0.5][k]::DOUBLE AS confidence FROM c""")
def c4_table_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return signals(spark, sf_dir).select("doc_id", classify.table_type(c("title"), c("in_section"), c("markers"), c("n"), c("visits"), c("rows"), c("cols")).alias("t")).select("doc_id", "t.*")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 'small bolt assay' WHEN 1 THEN 'X' WHEN 2 THEN 'of it' WHEN 3 THEN 'small unknown thing' ELSE 'nothing here matches' END AS val, lower(p_name) || ' assay' AS page FROM lineitem JOIN part ON p_partkey = l_partkey),
w AS (SELECT *, list_filter(regexp_extract_all(lower(val), '[a-z0-9_]{3,}'), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from')) AS ws FROM v), r AS (SELECT *, len(list_filter(ws, lambda x: contains(page, x))) / greatest(len(ws), 1)::DOUBLE AS ratio, val = 'X' OR len(ws) = 0 AS free FROM w)
SELECT l_partkey % 5 AS k, free OR ratio >= 0.3 AS grounded, CASE WHEN free OR ratio >= 0.6 THEN 1 WHEN ratio >= 0.3 THEN 0.85 ELSE 0.75 END::DOUBLE AS adjustment, count(*) AS n FROM r GROUP BY ALL""")
def c12_c13_grounding_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_partkey") % 5
    value = F.when(k == 0, "small bolt assay").when(k == 1, "X").when(k == 2, "of it").when(k == 3, "small unknown thing").otherwise("nothing here matches")
    rows = joined.select(k.alias("k"), classify.grounding(value, F.lit(1), F.concat(F.lower("p_name"), F.lit(" assay"))).alias("g"))
    return rows.groupBy("k", "g.grounded", "g.adjustment").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT page_id, len(regexp_extract_all(html, '<t[dh][^>]*>')) AS n_cells, len(regexp_extract_all(html, '<tr[^>]*>')) AS n_rows, regexp_matches(html, '(rowspan|colspan)=["''][2-9]') AS merged FROM pages)
SELECT page_id, n_cells::INT AS n_cells, n_rows::INT AS n_rows, merged, CASE WHEN n_cells > 200 THEN 'high' WHEN n_cells > 50 THEN 'medium' ELSE 'low' END AS density FROM a""")
def c24_table_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count("html", F.lit("<t[dh][^>]*>"))
    return table(spark, sf_dir, "pages").select("page_id", n.alias("n_cells"), F.regexp_count("html", F.lit("<tr[^>]*>")).alias("n_rows"), F.col("html").rlike("(rowspan|colspan)=[\"'][2-9]").alias("merged"), classify.line_density(n).alias("density"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text || ' SafetyAssessmentVitalSigns shortOne Placebo-ControlledTrialOfThings', ' ')) AS word FROM documents), c AS (SELECT *, regexp_replace(word, '[^A-Za-z0-9_]', '', 'g') AS clean FROM w), p AS (SELECT *, string_split(regexp_replace(clean, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ') AS parts FROM c)
SELECT doc_id, count(*) AS n FROM p WHERE NOT regexp_matches(word, '[-/.]') AND length(clean) > 20 AND len(parts) > 1 AND len(list_filter(parts, lambda x: length(x) < 3)) = 0 GROUP BY 1""")
def i19_run_on_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.concat("text", F.lit(" SafetyAssessmentVitalSigns shortOne Placebo-ControlledTrialOfThings"))
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(more, " ")).alias("word"))
    return words.where(F.length("word") > 20).where(classify.run_on(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'screening' WHEN 1 THEN 'run_in' WHEN 2 THEN 'treatment' ELSE 'follow_up' END AS epoch, CASE o_orderkey % 3 WHEN 0 THEN 'placebo' WHEN 1 THEN 'control' ELSE 'experimental' END AS arm, CASE o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'LOW' END AS tier FROM orders""")
def j7_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    epoch = F.when(k == 0, "Screening Epoch").when(k == 1, "Run-in").when(k == 2, "Treatment 1").otherwise("Follow up")
    arm = F.when(m == 0, "Placebo arm").when(m == 1, "Control").otherwise("Active")
    kind = F.when(k == 0, "MRI scan").when(k == 1, "Laboratory").when(k == 2, "Infusion").otherwise("Interview")
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.epoch_type(epoch).alias("epoch"), classify.arm_type(arm).alias("arm"), classify.cost_tier(kind).alias("tier"))


@query("""WITH p AS (SELECT p_partkey, 0.6 + (p_partkey % 5) * 0.1 AS conf, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey::VARCHAR END AS code, p_type, p_size, p_partkey % 30 AS total FROM part)
SELECT p_partkey, coalesce(nullif(concat_ws('; ', CASE WHEN conf < 0.75 THEN 'low confidence: verify the frequency' WHEN conf < 0.9 THEN 'some visit marks are uncertain' END, CASE WHEN code = '' THEN 'no code' END, CASE WHEN p_size > 45 THEN 'high cost: verify the frequency' END,
  CASE WHEN total > 20 THEN 'high frequency: ' || total END), ''), 'OK') AS hints FROM p""")
def i29_review_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    conf = F.lit(0.6) + (key % 5) * 0.1
    tier = F.when(F.col("p_size") > 45, "VERY_HIGH").otherwise("LOW")
    hints = classify.review_hints(conf, F.when(key % 3 == 0, "").otherwise(key.cast("string")), F.col("p_type"), tier, F.lit(""), key % 30)
    return table(spark, sf_dir, "part").select("p_partkey", hints.alias("hints"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber, l_quantity AS size, l_discount AS gap FROM lineitem), body AS (SELECT doc_id, sorted[len(sorted) // 2 + 1] AS body FROM (SELECT doc_id, list_sort(list(size)) AS sorted FROM s GROUP BY 1))
SELECT doc_id, body, count(*) AS n, count(*) FILTER ((CASE WHEN size >= body * 1.5 THEN 3 WHEN size >= body * 1.2 THEN 2 WHEN size > body * 1.05 THEN 1 ELSE 0 END) + 1.5 + 2.5 * (l_linenumber % 2) >= 5) AS n_headings FROM s JOIN body USING (doc_id) GROUP BY 1, 2""")
def c11_p19_heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs scored against their document's body size, the upper median of its sizes."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("size"), F.when(F.col("l_linenumber") % 2 == 1, "1. item").otherwise("item").alias("text"))
    body = rows.groupBy("doc_id").agg(F.element_at(F.array_sort(F.collect_list("size")), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("body"))
    score = style_score(F.col("size"), F.col("body"), F.lit(False), F.col("text"), F.lit(0))
    return rows.join(body, "doc_id").groupBy("doc_id", "body").agg(F.count("*").alias("n"), F.count_if(score >= 5).alias("n_headings"))


@query("""WITH t AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'Treatment for 24 weeks, then progression' WHEN 1 THEN 'A dose every 21 days for 6 cycles' ELSE 'None' END AS ctx FROM conversations)
SELECT conv_id, turn, try_cast(regexp_extract(ctx, '([0-9]+) weeks', 1) AS INT)::DOUBLE AS weeks, try_cast(regexp_extract(ctx, 'every ([0-9]+) days', 1) AS INT)::DOUBLE AS cycle_days, coalesce(try_cast(regexp_extract(ctx, '([0-9]+) cycles', 1) AS INT), CASE WHEN ctx LIKE '%progression%' THEN 9 END)::DOUBLE AS cycles, ctx LIKE '%progression%' AS treat_to_progression FROM t""")
def i30_n11_context_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pattern that matches gives each field of the treatment context."""
    k = F.col("turn") % 3
    ctx = F.when(k == 0, "Treatment for 24 weeks, then progression").when(k == 1, "A dose every 21 days for 6 cycles").otherwise("None")
    field = lambda p: F.regexp_extract(F.col("ctx"), p, 1).try_cast("double")
    to_progression = F.col("ctx").contains("progression")
    return table(spark, sf_dir, "conversations").withColumn("ctx", ctx).select(
        "conv_id", "turn", field("([0-9]+) weeks").alias("weeks"), field("every ([0-9]+) days").alias("cycle_days"), F.coalesce(field("([0-9]+) cycles"), F.when(to_progression, 9.0)).alias("cycles"), to_progression.alias("treat_to_progression")
    )


@query("""WITH f AS (SELECT family, child, site FROM (VALUES ('biopsy', 'liver biopsy', 'liver'), ('biopsy', 'skin biopsy', 'skin'), ('scan', 'chest scan', 'chest')) t(family, child, site)) SELECT p_partkey, family, child FROM part JOIN f ON family = CASE p_partkey % 3 WHEN 0 THEN 'biopsy' WHEN 1 THEN 'scan' ELSE 'other' END""")
def n12_hierarchy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame([("biopsy", "liver biopsy", "liver"), ("biopsy", "skin biopsy", "skin"), ("scan", "chest scan", "chest")], "family string, child string, site string")
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "biopsy").when(k == 1, "scan").otherwise("other").alias("family"))
    return rows.join(F.broadcast(families), "family").select("p_partkey", "family", "child")


@query("""WITH e AS (SELECT user_id, event_type, value, event_id FROM events) SELECT user_id % 10 AS bucket, count(*) AS n_jobs, count(*) FILTER (event_type = 'error') AS n_failed, count(*) FILTER (event_type = 'purchase') AS n_completed, round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE, 6) AS completed_rate FROM e GROUP BY 1""")
def e35_e37_job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    done = F.count_if(F.col("event_type") == "purchase")
    return rows.groupBy((F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n_jobs"), F.count_if(F.col("event_type") == "error").alias("n_failed"), done.alias("n_completed"), F.round(done / F.count("*"), 6).alias("completed_rate"))


@query(f"""{WITH_CELLS}, names AS (SELECT DISTINCT doc_id, 'P' || (part % 40) AS name FROM cells WHERE col_ix > 1 UNION SELECT DISTINCT doc_id, 'P' || (supp % 40) FROM cells WHERE col_ix = 1) SELECT name, count(*) AS n_docs FROM names GROUP BY 1""")
def h2_name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    p = lambda c: F.concat(F.lit("P"), (F.col(c) % 40).cast("string")).alias("name")
    names = rows.where("col_ix > 1").select("doc_id", p("part")).union(rows.where("col_ix = 1").select("doc_id", p("supp"))).distinct()
    return names.groupBy("name").agg(F.count("*").alias("n_docs"))


@query(f"""{WITH_CELLS}, a AS (SELECT doc_id, list_distinct(list(part % 9)) AS x, list_distinct(list(supp % 9)) AS y, max(row_ix) AS m, list_distinct(list(row_ix)) AS r FROM cells GROUP BY 1)
SELECT doc_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS jaccard, round(len(list_intersect(x, y)) / greatest(len(x), len(y))::DOUBLE, 6) AS overlap, (m - len(r))::INT AS n_gaps FROM a""")
def h3_h4_overlaps_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).groupBy("doc_id").agg(F.collect_set(F.col("part") % 9).alias("x"), F.collect_set(F.col("supp") % 9).alias("y"), F.max("row_ix").alias("m"), F.collect_set("row_ix").alias("r"))
    both = F.size(F.array_intersect("x", "y"))
    gaps = F.size(F.array_except(F.sequence(F.lit(1), "m"), "r"))
    return rows.select("doc_id", F.round(both / F.size(F.array_union("x", "y")), 6).alias("jaccard"), F.round(both / F.greatest(F.size("x"), F.size("y")), 6).alias("overlap"), gaps.alias("n_gaps"))


@query(f"""{WITH_CELLS}, h AS (SELECT doc_id, 'H' || (part % 20) AS header, min(col_ix * 1000 + row_ix) AS pos FROM cells WHERE col_ix > 1 GROUP BY 1, 2) SELECT doc_id, header, row_number() OVER (PARTITION BY doc_id ORDER BY pos, header)::INT AS visit_index FROM h""")
def a15_f13_synthesised_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct headers in the order in which they are first seen, numbered."""
    rows = cells(spark, sf_dir).where("col_ix > 1").groupBy("doc_id", F.concat(F.lit("H"), (F.col("part") % 20).cast("string")).alias("header")).agg(F.min(F.col("col_ix") * 1000 + F.col("row_ix")).alias("pos"))
    return rows.select("doc_id", "header", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "header")).alias("visit_index"))


@query("""WITH s AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations), r AS (SELECT *, CASE WHEN n > 200 THEN 'a' WHEN n > 80 THEN 'b' ELSE 'c' END AS strategy FROM s), g AS (SELECT conv_id, strategy, count(*) AS k, sum(n) AS score FROM r GROUP BY 1, 2)
SELECT conv_id, strategy, k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (k >= 3) DESC, CASE WHEN k >= 3 THEN strategy END, score + CASE strategy WHEN 'a' THEN 500 WHEN 'b' THEN 300 ELSE 0 END DESC, strategy) AS rn FROM g) WHERE rn = 1""")
def g3_p1_best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first strategy in fixed order that found three, else the one with the best score and bonus."""
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(n > 200, "a").when(n > 80, "b").otherwise("c").alias("strategy"), n.alias("n")).groupBy("conv_id", "strategy").agg(F.count("*").alias("k"), F.sum("n").alias("score"))
    bonus = F.when(F.col("strategy") == "a", 500).when(F.col("strategy") == "b", 300).otherwise(0)
    enough = F.col("k") >= 3
    best = F.min(F.struct((~enough).alias("x"), F.when(enough, F.col("strategy")).otherwise("").alias("y"), (-(F.col("score") + bonus)).alias("z"), "strategy", "k"))
    return rows.groupBy("conv_id").agg(best.alias("m")).select("conv_id", "m.strategy", "m.k")


@query("""WITH t AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN (i % 9 + 1) || '.' || (i % 3) || ' INTRODUCTION ........ ' || (i + 3) ELSE raw END AS line FROM (SELECT doc_id, unnest(range(len(ls)))::INT AS i, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
m AS (SELECT doc_id, regexp_extract(line, '([0-9]{1,2}(?:\\.[0-9]{1,3}){0,4})\\.?\\s+([A-Za-z][A-Za-z\\s,/&()-]+?)\\s*[.·_-]{3,}\\s*([0-9]{1,4})\\s*$', 1) AS number, try_cast(regexp_extract(line, '[.·_-]{3,}\\s*([0-9]{1,4})\\s*$', 1) AS INT) AS page FROM t WHERE line LIKE '%....%')
SELECT doc_id, number, page - 1 AS page FROM m WHERE number <> ''""")
def p3_toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.functions.text import TOC

    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "raw"))
    i = F.col("i")
    line = F.when(i % 4 == 0, F.concat((i % 9 + 1).cast("string"), F.lit("."), (i % 3).cast("string"), F.lit(" INTRODUCTION ........ "), (i + 3).cast("string"))).otherwise(F.col("raw"))
    found = rows.select("doc_id", line.alias("line")).where(F.col("line").contains("....")).select("doc_id", F.regexp_extract("line", TOC, 1).alias("number"), F.regexp_extract("line", TOC, 3).alias("page"))
    return found.where("number <> ''").select("doc_id", "number", (F.col("page").cast("int") - 1).alias("page"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND value > 50 AND user_id % 7 = 3")
def c18_model_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where((F.col("event_type") == "signup") & (F.col("value") > 50) & (F.col("user_id") % 7 == 3)).select("event_id", "user_id")


@query("""WITH v AS (SELECT event_id, value, event_type IN ('error', 'click') AS checked, event_id % 4 AS verdict FROM events) SELECT event_id, CASE WHEN checked AND verdict = 0 THEN value + 1 ELSE value END AS value, checked AND verdict = 0 AS corrected FROM v""")
def c14_verification_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is doubtful is verified; corrections replace values."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    fixes = rows.where(F.col("event_type").isin("error", "click") & (F.col("event_id") % 4 == 0)).select("event_id", (F.col("value") + 1).alias("fix"))
    return rows.join(fixes, "event_id", "left").select("event_id", F.coalesce("fix", "value").alias("value"), F.col("fix").isNotNull().alias("corrected"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, greatest(count(*) FILTER (l_returnflag <> 'N'), 1) AS n_marks FROM lineitem GROUP BY 1, 2")
def e11_e12_fallback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.greatest(F.count_if(F.col("l_returnflag") != "N"), F.lit(1)).alias("n_marks"))


@query("""WITH s AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn, role FROM conversations) SELECT conv_id, turn, next_turn::DOUBLE AS next_turn, role FROM s""")
def p15_next_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(w).cast("double").alias("next_turn"), "role")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_suppkey % 6 AS page, count(*) FILTER (l_returnflag = 'R') AS marks, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT * FROM p WHERE marks >= 1)
SELECT DISTINCT doc_id, unnest(range(greatest(page - 1, 0), least(page + 1, 5) + 1)) AS page FROM c""")
def e34_page_prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a mark, and their neighbours."""
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 6).alias("page")).agg(F.count_if(F.col("l_returnflag") == "R").alias("marks")).where("marks >= 1")
    near = F.explode(F.sequence(F.greatest(F.col("page") - 1, F.lit(0)), F.least(F.col("page") + 1, F.lit(5))))
    return pages.select("doc_id", near.alias("page")).distinct()


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'protocol' WHEN 1 THEN 'sponsor' ELSE '_defaults' END AS config FROM nation")
def a20_config_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first existing of a protocol's, its sponsor and area's, its area's and the default configuration."""
    from loomgrid.sources.vocabulary import resolve_config

    names = {0: "protocol", 1: "sponsor", 2: "_defaults"}
    exists = {0: {"protocol", "sponsor"}, 1: {"sponsor"}, 2: set()}
    rows = [(k, resolve_config(["protocol", "sponsor", "area"], exists[k])) for k in names]
    config = spark.createDataFrame(rows, "k int, config string")
    return table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey") % 3).join(F.broadcast(config), "k").select("n_nationkey", "config")


@query("SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first_ship, bool_or(regexp_matches('Week ' || l_linenumber, '(?i)week\\s*[0-9]')) AS has_visit FROM lineitem GROUP BY 1")
def p17_p24_group_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    visit = F.concat(F.lit("Week "), F.col("l_linenumber").cast("string")).rlike(classify.VISIT_HEADER)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"), F.bool_or(visit).alias("has_visit"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'WEEKS' WHEN p_size % 4 = 1 THEN 'MONTHS' ELSE 'DAYS' END AS unit, p_size * CASE WHEN p_size % 4 = 0 THEN 7 WHEN p_size % 4 = 1 THEN 30 ELSE 1 END AS days FROM part")
def j2_unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    unit = temporal.unit_of(F.when(k == 0, "weeks").when(k == 1, "Month").otherwise("day"))
    return table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), temporal.in_days(F.col("p_size"), unit).alias("days"))
