"""Queries on measures: coverage, stability, summaries, fidelity, upserts, fired rules and typed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.operators import measures
from loomgrid.plans.registry import registry
from loomgrid.plans.views import WITH_CELLS, WITH_PASSES, cells, pass_of, table

QUERIES, SQL, query = registry()


@query(f"""{WITH_CELLS}, g AS (SELECT DISTINCT doc_id, chr(97 + (part % 9)::INT) AS marker FROM cells WHERE qty > 10), e AS (SELECT DISTINCT doc_id, chr(97 + (part % 9)::INT) AS marker FROM cells WHERE disc > 0.03)
SELECT doc_id, count(*) AS n_markers, round(count(e.marker) / count(*)::DOUBLE, 6) AS coverage FROM g LEFT JOIN e USING (doc_id, marker) GROUP BY 1""")
def e15_marker_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.char((97 + F.col("part") % 9).cast("long")).alias("marker")
    rows = cells(spark, sf_dir)
    return measures.marker_coverage(rows.where("qty > 10").select("doc_id", marker), rows.where("disc > 0.03").select("doc_id", marker)).withColumn("coverage", F.round("coverage", 6))


@query(f"""{WITH_CELLS}, t AS (SELECT doc_id, doc_id % 3 AS source, count(DISTINCT row_ix) AS n_rows, count(DISTINCT col_ix) AS n_cols, bool_or(part % 50 = 0) AS merged, bool_or(raw_value LIKE '%a') AS footnotes, bool_or(disc > 0.09) AS conditional FROM cells GROUP BY 1)
SELECT source, count(*) AS num_tables, sum(n_rows * n_cols)::BIGINT AS total_cells, round(avg(n_rows), 6) AS avg_rows, round(avg(n_cols), 6) AS avg_cols, count(*) FILTER (merged) AS with_merged, count(*) FILTER (footnotes) AS with_footnotes, count(*) FILTER (conditional) AS with_conditional FROM t GROUP BY 1""")
def e17_export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = cells(spark, sf_dir).groupBy("doc_id").agg(
        F.countDistinct("row_ix").alias("n_rows"), F.countDistinct("col_ix").alias("n_cols"), F.bool_or(F.col("part") % 50 == 0).alias("merged"), F.bool_or(F.col("raw_value").endswith("a")).alias("footnotes"),
        F.bool_or(F.col("disc") > 0.09).alias("conditional"),
    )
    found = measures.export_summary(attributes.withColumn("source", F.col("doc_id") % 3), "source")
    return found.withColumns({c: F.round(c, 6) for c in ("avg_rows", "avg_cols")})


@query(f"""{WITH_PASSES}, r AS (SELECT 1 AS run, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3), k AS (SELECT DISTINCT doc_id, row_ix, col_ix FROM r),
v AS (SELECT k.*, n.run, coalesce(trim(r.raw_value), '') AS value FROM k CROSS JOIN (SELECT unnest([1, 2, 3]) AS run) n LEFT JOIN r ON r.doc_id = k.doc_id AND r.row_ix = k.row_ix AND r.col_ix = k.col_ix AND r.run = n.run),
m AS (SELECT doc_id, row_ix, col_ix, max(n) AS most FROM (SELECT doc_id, row_ix, col_ix, value, count(*) AS n FROM v GROUP BY ALL) GROUP BY ALL),
c AS (SELECT k.doc_id, stddev_samp(coalesce(n, 0)) AS s FROM (SELECT DISTINCT doc_id FROM k) k CROSS JOIN (SELECT unnest([1, 2, 3]) AS run) u LEFT JOIN (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2) x ON x.doc_id = k.doc_id AND x.run = u.run GROUP BY 1)
SELECT doc_id, count(*) AS n_cells, round(100.0 * count(*) FILTER (most = 3) / count(*), 6)::DOUBLE AS stable_pct, round(avg(most / 3.0), 6)::DOUBLE AS mean_stability, round(any_value(s), 6) AS cell_count_stddev FROM m JOIN c USING (doc_id) GROUP BY 1""")
def e19_run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document: cells that are the same in all three runs, the mean share of the commonest value, and how cell counts vary."""
    all_cells = cells(spark, sf_dir)
    runs = None
    for n in (1, 2, 3):
        one = pass_of(all_cells, n).select("doc_id", "row_ix", "col_ix", "raw_value", F.lit(n).alias("run"))
        runs = one if runs is None else runs.unionByName(one)
    found = measures.run_stability(runs, ["doc_id"], 3)
    return found.withColumns({c: F.round(c, 6) for c in ("stable_pct", "mean_stability", "cell_count_stddev")})


@query("""SELECT coalesce(d.user_id, v.user_id) AS user_id, coalesce(v.n, d.n) AS n, v.user_id IS NOT NULL AND d.user_id IS NOT NULL AS replaced FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1) d FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1) v ON v.user_id = d.user_id""")
def e21_upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace those of their id; others of either side stay."""
    counts = lambda cond: table(spark, sf_dir, "events").where(cond).groupBy("user_id").agg(F.count("*").alias("n"))
    return measures.upsert(counts("event_type = 'view' AND user_id % 3 <> 0"), counts("event_type = 'click' AND user_id % 2 = 0"), "user_id")


@query("""WITH l AS (SELECT p_partkey, 'n' || (p_partkey % 40) AS name, 'c' || (p_partkey % 11) AS code FROM part), v AS (SELECT DISTINCT 'n' || (p_size % 25) AS name, 'new' || (p_size % 25) AS code, CASE WHEN p_size % 25 % 4 = 0 THEN 'Unknown' ELSE 'Lab' END AS category FROM part)
SELECT p_partkey, l.name, CASE WHEN category <> 'Unknown' THEN v.code ELSE l.code END AS code, coalesce(category <> 'Unknown', false) AS renewed FROM l LEFT JOIN v USING (name)""")
def d25_renormalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lines take what the current vocabulary says of their name, and keep the old where it knows nothing."""
    parts = table(spark, sf_dir, "part")
    named = lambda c: F.concat(F.lit("n"), c.cast("string"))
    stored = parts.select("p_partkey", named(F.col("p_partkey") % 40).alias("name"), F.concat(F.lit("c"), (F.col("p_partkey") % 11).cast("string")).alias("code"))
    k = F.col("p_size") % 25
    current = parts.select(named(k).alias("name"), F.concat(F.lit("new"), k.cast("string")).alias("new_code"), F.when(k % 4 == 0, "Unknown").otherwise("Lab").alias("category")).distinct()
    return measures.renormalised(stored, current).select("p_partkey", "name", "code", "renewed")


@query(f"{WITH_CELLS}, h AS (SELECT doc_id, col_ix, 'H' || (min(part) % 6) AS header FROM cells GROUP BY 1, 2) SELECT doc_id, header, count(*) AS n FROM h GROUP BY 1, 2 HAVING count(*) > 1")
def e22_duplicate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = cells(spark, sf_dir).groupBy("doc_id", "col_ix").agg(F.concat(F.lit("H"), (F.min("part") % 6).cast("string")).alias("header"))
    return measures.duplicate_headers(heads)


@query(f"""{WITH_CELLS}, e AS (SELECT DISTINCT doc_id, 'Visit' AS kind, 'v' || col_ix AS name, NULL::VARCHAR AS mark FROM cells UNION SELECT DISTINCT doc_id, 'Procedure', 'p' || row_ix, NULL FROM cells UNION ALL SELECT doc_id, 'ScheduleEntry', 's' || row_ix || ':' || col_ix, CASE raw_value WHEN 'X' THEN 'firm' ELSE 'conditional' END FROM cells WHERE raw_value <> '')
SELECT doc_id, count(*) FILTER (kind = 'Visit') AS visits, count(*) FILTER (kind = 'Procedure') AS procedures, count(*) FILTER (kind = 'ScheduleEntry') AS schedule_entries, count(*) FILTER (mark = 'firm') AS firm_entries, count(*) FILTER (mark = 'conditional') AS conditional_entries, count(*) FILTER (kind = 'Footnote') AS footnotes FROM e GROUP BY 1""")
def e23_n9_model_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    named = lambda kind, sign, c: rows.select("doc_id", F.lit(kind).alias("kind"), F.concat(F.lit(sign), F.col(c).cast("string")).alias("name"), F.lit(None).cast("string").alias("mark")).distinct()
    place = F.concat(F.lit("s"), F.concat_ws(":", F.col("row_ix").cast("string"), F.col("col_ix").cast("string")))
    entries = rows.where("raw_value <> ''").select("doc_id", F.lit("ScheduleEntry").alias("kind"), place.alias("name"), F.when(F.col("raw_value") == "X", "firm").otherwise("conditional").alias("mark"))
    return measures.model_statistics(named("Visit", "v", "col_ix").unionByName(named("Procedure", "p", "row_ix")).unionByName(entries))


@query("""WITH d AS (SELECT doc_id, text FROM documents), l AS (SELECT doc_id, unnest(range(len(ls)))::INT AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text || chr(10) || 'End.Now  a  b  c  d  e  f  g', chr(10)) AS ls FROM d)),
s AS (SELECT doc_id, avg((line LIKE '%  %')::INT) > 0.3 AS convention, count(*) FILTER (len(regexp_extract_all(line, '  +')) > 5) AS doubled, sum(len(regexp_extract_all(line, '\\.[A-Z]')))::BIGINT AS unspaced, count(*) FILTER (i % 3 = 0 AND length(line) > 300) AS mixed FROM l GROUP BY 1)
SELECT doc_id, CASE WHEN convention THEN 0 ELSE doubled END AS n_low, mixed AS n_medium, unspaced AS n_high, greatest(0, 100 - 5 * unspaced - 2 * mixed - 0.5 * CASE WHEN convention THEN 0 ELSE doubled END)::DOUBLE AS fidelity FROM s""")
def e25_e26_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their spacing issues and mixed fonts: low 0.5, medium 2, high 5, critical 10 points off a hundred."""
    ended = F.concat("text", F.lit("\nEnd.Now  a  b  c  d  e  f  g"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(ended, "\n", -1)).alias("i", "line"))
    fonts = F.when((F.col("i") % 3 == 0) & (F.length("line") > 300), 3).otherwise(1)
    return measures.fidelity(measures.paragraph_issues(rows.withColumn("n_fonts", fonts), ["doc_id"]), ["doc_id"]).select("doc_id", "n_low", "n_medium", "n_high", "fidelity")


@query(f"""{WITH_CELLS}, f AS (SELECT doc_id, 'F' || (supp % 15) AS font, count(*) AS n, round(avg(disc), 6) AS conf FROM cells GROUP BY 1, 2) SELECT doc_id, font, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font)::INT AS rank FROM f) WHERE rank <= 10""")
def g2_top_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ten commonest fonts: the limit is the feature."""
    fonts = cells(spark, sf_dir).groupBy("doc_id", F.concat(F.lit("F"), (F.col("supp") % 15).cast("string")).alias("font")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "font"))
    return fonts.withColumn("rank", rank).where("rank <= 10")


@query("""WITH c AS (SELECT 'n' || (p_partkey % 60) AS name, 'c' || min(p_partkey) AS code, list_sort(list_distinct(list(lower(p_brand)))) AS aliases FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), i AS (SELECT 'N' || (p_partkey % 45) AS name, 'i' || max(p_partkey) AS code, list_sort(list_distinct(list(upper(p_type)))) AS aliases FROM part GROUP BY 1)
SELECT coalesce(c.name, i.name) AS name, coalesce(i.code, c.code) AS code, array_to_string(list_sort(list_distinct(list_transform(list_concat(coalesce(c.aliases, []), coalesce(i.aliases, [])), lambda x: lower(x)))), ',') AS aliases, c.name IS NULL AS inserted FROM c FULL JOIN i ON lower(c.name) = lower(i.name)""")
def b7_vocabulary_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An imported vocabulary over the current: known names are updated, their aliases added without regard to case, others inserted."""
    parts = table(spark, sf_dir, "part")
    k = lambda sign, n: F.concat(F.lit(sign), (F.col("p_partkey") % n).cast("string")).alias("name")
    current = parts.where("p_partkey % 2 = 0").groupBy(k("n", 60)).agg(F.concat(F.lit("c"), F.min("p_partkey").cast("string")).alias("code"), F.collect_set(F.lower("p_brand")).alias("aliases"))
    imported = parts.groupBy(k("N", 45)).agg(F.concat(F.lit("i"), F.max("p_partkey").cast("string")).alias("code"), F.collect_set(F.upper("p_type")).alias("aliases"))
    found = measures.imported(current, imported)
    return found.withColumn("aliases", F.array_join(F.array_sort(F.transform("aliases", F.lower)), ","))


@query("""WITH n AS (SELECT o_orderkey, o_totalprice AS v, o_orderstatus AS s FROM orders) SELECT rule, count(*) AS n_changed FROM (SELECT 'a: round' AS rule FROM n WHERE v > 200000 UNION ALL SELECT 'b: close' FROM n WHERE s = 'O' AND (CASE WHEN v > 200000 THEN 200000 ELSE v END) > 100000) GROUP BY 1""")
def n0_fired_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in order of priority over one table, and how many rows each has changed; one that changes none has not fired."""
    from loomgrid.operators.graph import fired

    v, s = F.col("v"), F.col("s")
    rules = [("b: close", 2, {"s": F.when((s == "O") & (v > 100000), "closed").otherwise(s)}), ("a: round", 1, {"v": F.when(v > 200000, 200000.0).otherwise(v)}), ("c: none", 3, {"s": F.when(s == "missing", "x").otherwise(s)})]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v"), F.col("o_orderstatus").alias("s"))
    return fired(rows, rules)[1]


@query(f"""{WITH_CELLS}, n AS (SELECT DISTINCT doc_id, 'Visit' AS kind, 'visit ' || col_ix AS key FROM cells UNION SELECT DISTINCT doc_id, 'Procedure', 'proc ' || (supp % 9) FROM cells UNION SELECT DISTINCT doc_id, 'Document', doc_id::VARCHAR FROM cells UNION SELECT DISTINCT doc_id, 'ScheduleEntry', row_ix || ':' || col_ix FROM cells WHERE raw_value <> ''),
e AS (SELECT doc_id, 'SCHEDULED_AT' AS kind FROM cells WHERE raw_value <> '' UNION ALL SELECT doc_id, 'OF_PROCEDURE' FROM cells WHERE raw_value <> '' UNION ALL SELECT DISTINCT doc_id, 'HAS_' || upper(kind) || key FROM n WHERE kind IN ('Visit', 'Procedure'))
SELECT doc_id, 'node' AS part, kind, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT doc_id, 'edge', CASE WHEN kind LIKE 'HAS_VISIT%' THEN 'HAS_VISIT' WHEN kind LIKE 'HAS_PROC%' THEN 'HAS_PROCEDURE' ELSE kind END, count(*) FROM e GROUP BY ALL""")
def n8_typed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, visits, procedures and entries as nodes, deduplicated by small letters across tables, and their edges."""
    from loomgrid.operators.graph import typed_graph

    visit = F.concat(F.when(F.col("row_ix") % 2 == 0, "Visit ").otherwise("visit "), F.col("col_ix").cast("string"))
    procedure = F.concat(F.when(F.col("col_ix") % 2 == 0, "PROC ").otherwise("Proc "), (F.col("supp") % 9).cast("string"))
    nodes, edges = typed_graph(cells(spark, sf_dir).select("doc_id", "row_ix", "col_ix", "raw_value", visit.alias("visit"), procedure.alias("procedure")))
    count = lambda df, part: df.groupBy("doc_id", "kind").agg(F.count("*").alias("n")).select("doc_id", F.lit(part).alias("part"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


@query("""WITH s AS (SELECT doc_id, (doc_id % 3 + k) AS page, k AS number, CASE WHEN k % 2 = 0 THEN doc_id % 3 + k + 2 END AS end_page FROM documents, (SELECT unnest(range(1, 5)) AS k)) SELECT doc_id, 'section ' || number AS section, unnest(range(page, coalesce(end_page, page) + 1)) AS page FROM s""")
def n10_section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every section; a section without an end has its own page."""
    k = F.col("number")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("number"))
    known = rows.withColumn("page", F.col("doc_id") % 3 + k).withColumn("end_page", F.when(k % 2 == 0, F.col("page") + 2))
    return known.select("doc_id", F.concat(F.lit("section "), k.cast("string")).alias("section"), F.explode(F.sequence("page", F.coalesce("end_page", "page"))).alias("page"))


@query("""WITH d AS (SELECT n_nationkey AS doc_id, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS k FROM nation), f AS (SELECT n_nationkey, n_name || CASE n_nationkey % 3 WHEN 0 THEN '_v2.pdf' WHEN 1 THEN ' (final).PDF' ELSE '' END AS file FROM nation)
SELECT n_nationkey, max(length(k)) AS n_letters, count(*) AS n FROM f JOIN d ON starts_with(lower(regexp_replace(regexp_replace(file, '(?i)[.]pdf$', ''), '[^A-Za-z0-9]', '', 'g')), k) GROUP BY 1""")
def d30_names_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the documents whose name, letters and digits only, theirs begins with."""
    nation = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    files = nation.select("n_nationkey", F.concat("n_name", F.when(k == 0, "_v2.pdf").when(k == 1, " (final).PDF").otherwise("")).alias("file"))
    found = measures.named_like(files, "file", nation.select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name")))
    return found.groupBy("n_nationkey").agg(F.max(F.length("key")).alias("n_letters"), F.count("*").alias("n"))


_RAW = "CASE WHEN raw_value = 'X' THEN 'X' WHEN raw_value = 'Xa' THEN 'as needed' WHEN part % 7 = 0 THEN '↔' WHEN part % 7 < 3 THEN 'X' ELSE '' END"


@query(f"""{WITH_CELLS}, c AS (SELECT doc_id, row_ix, col_ix, 'V' || col_ix AS visit, {_RAW} AS raw, 1 - disc AS confidence, CASE WHEN part % 5 = 0 THEN ['CONDITIONAL', 'FREQUENCY_MODIFIER', 'OTHER'][supp % 3 + 1] END AS note_kind, 'note ' || (supp % 4) AS note FROM cells),
k AS (SELECT *, CASE raw WHEN '↔' THEN 'endless' WHEN 'as needed' THEN 'conditional' WHEN 'X' THEN CASE note_kind WHEN 'CONDITIONAL' THEN 'conditional' WHEN 'FREQUENCY_MODIFIER' THEN 'modified' ELSE 'firm' END ELSE 'empty' END AS kind FROM c),
l AS (SELECT doc_id, row_ix, count(*) FILTER (kind = 'firm') + max((kind = 'endless')::INT) AS n_firm, count(*) FILTER (kind = 'conditional') AS n_conditional, count(*) FILTER (kind = 'modified') AS n_modified,
    array_to_string((list_sort(list_distinct(coalesce(list(note) FILTER (kind = 'modified'), []))))[1:2], '; ') AS modifier_notes, arg_min(visit, col_ix) FILTER (kind = 'endless') || '→' || arg_max(visit, col_ix) FILTER (kind = 'endless') || ' (continuous)' AS span, avg(confidence) AS avg_confidence FROM k GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN 2.0 WHEN doc_id % 3 = 2 THEN 1.5 ELSE 1.0 END AS f, CASE (doc_id + row_ix) % 4 WHEN 0 THEN ['ICF', 'demographics', 'vital signs'] WHEN 1 THEN ['ECG'] WHEN 3 THEN ['Blood draw'] ELSE [] END AS procedures FROM l WHERE n_firm + n_conditional + n_modified > 0)
SELECT doc_id, row_ix, unnest(procedures) AS procedure, n_firm::BIGINT AS n_firm, n_conditional, n_modified, (floor((n_firm + n_conditional) * f) + n_modified)::BIGINT AS total_occurrences, f::DOUBLE AS cycle_multiplier, modifier_notes, span, round(avg_confidence, 6)::DOUBLE AS avg_confidence FROM n""")
def e1_procedure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget lines of rows: firm, conditional and modified visits, cycles, spans without an end, and rows of several procedures."""
    from loomgrid.operators.budget import procedure_lines

    part, supp = F.col("part"), F.col("supp")
    raw = F.when(F.col("raw_value") == "X", "X").when(F.col("raw_value") == "Xa", "as needed").when(part % 7 == 0, "↔").when(part % 7 < 3, "X").otherwise("")
    rows = cells(spark, sf_dir).withColumns({"visit": F.concat(F.lit("V"), F.col("col_ix").cast("string")), "confidence": 1 - F.col("disc"), "raw_value": raw})
    kinds = F.element_at(F.array(F.lit("CONDITIONAL"), F.lit("FREQUENCY_MODIFIER"), F.lit("OTHER")), (supp % 3 + 1).cast("int"))
    notes = rows.where(part % 5 == 0).select("doc_id", "row_ix", "col_ix", kinds.alias("kind"), F.concat(F.lit("note "), (supp % 4).cast("string")).alias("text"), F.lit(1).alias("pos"))
    k = (F.col("doc_id") + F.col("row_ix")) % 4
    name = F.when(k == 0, "ICF, demographics, vital signs").when(k == 1, "ECG").when(k == 2, "visit").otherwise("Blood draw")
    names = rows.select("doc_id", "row_ix").distinct().withColumn("name", name)
    cycles = rows.select("doc_id").distinct().select("doc_id", F.lit(2).alias("shown"), F.when(F.col("doc_id") % 3 == 1, 4).when(F.col("doc_id") % 3 == 2, 3).otherwise(2).alias("expected"))
    return procedure_lines(rows, names, notes, cycles).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ECG, 12-lead' WHEN 1 THEN 'BP / CRP' WHEN 2 THEN 'MRI of BP' WHEN 3 THEN 'Becgx' ELSE p_name END AS name FROM part),
e AS (SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE w WHEN 'ecg' THEN 'electrocardiogram' WHEN 'bp' THEN 'blood pressure' WHEN 'mri' THEN 'magnetic resonance imaging' WHEN 'crp' THEN 'c-reactive protein' ELSE w END), ' ') AS x FROM n)
SELECT p_partkey, x AS expanded, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(x, '[^a-z0-9]+'), lambda w: length(w) > 1))), ' ') AS words FROM e""")
def i3_expanded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their abbreviations written out, and their distinct words of more than one letter."""
    from loomgrid.functions.text import expanded, word_set

    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "ECG, 12-lead").when(k == 1, "BP / CRP").when(k == 2, "MRI of BP").when(k == 3, "Becgx").otherwise(F.col("p_name"))
    whole = table(spark, sf_dir, "part").select("p_partkey", expanded(name).alias("expanded"))
    return whole.select("p_partkey", "expanded", F.array_join(word_set(F.col("expanded")), " ").alias("words"))


@query("""SELECT category, count(*) AS n, coalesce(category IN ('Administrative', 'Safety', 'PRO'), false) AS effort FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'Administrative' WHEN 1 THEN 'Safety' WHEN 2 THEN 'PRO' WHEN 3 THEN p_type WHEN 4 THEN 'safety' END AS category FROM part) GROUP BY 1""")
def c17_effort_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.functions.classify import is_effort

    k = F.col("p_partkey") % 6
    category = F.when(k == 0, "Administrative").when(k == 1, "Safety").when(k == 2, "PRO").when(k == 3, F.col("p_type")).when(k == 4, "safety")
    return table(spark, sf_dir, "part").groupBy(category.alias("category")).agg(F.count("*").alias("n")).withColumn("effort", is_effort(F.col("category")))
