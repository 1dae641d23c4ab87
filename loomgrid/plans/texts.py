"""Queries on documents, pages and events: sections, lines, markup, JSON, references, layout checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import grid, text
from loomgrid.operators import intervals
from loomgrid.plans.registry import registry
from loomgrid.plans.views import table

QUERIES, SQL, query = registry()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, line: the lines of all documents, some with numbers, bullets or marks before them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "raw"))
    k, n = F.col("i") % 7, (F.col("i") % 9 + 1).cast("string")
    line = F.when(k == 0, F.concat(n, F.lit("."), n, F.lit(" "), F.col("raw"))).when(k == 1, F.concat(F.lit("- "), "raw")).when(k == 2, F.concat(n, F.lit(") "), F.col("raw"))).when(k == 3, F.concat(n, F.lit(". "), F.col("raw"))).otherwise(F.col("raw"))
    return rows.select("doc_id", "i", line.alias("line"))


LINES = """lines AS (SELECT doc_id, i, CASE i % 7 WHEN 0 THEN n || '.' || n || ' ' || raw WHEN 1 THEN '- ' || raw WHEN 2 THEN n || ') ' || raw WHEN 3 THEN n || '. ' || raw ELSE raw END AS line
  FROM (SELECT doc_id, i, (i % 9 + 1)::VARCHAR AS n, raw FROM (SELECT doc_id, unnest(range(len(ls)))::INT AS i, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))"""
_HEADING = "'^([0-9]+(?:\\.[0-9]+)*)\\.?\\s+(.+)$'"
_STYLE = f"""CASE WHEN regexp_matches(line, {_HEADING}) THEN 'heading' || least(4, 1 + length(regexp_extract(line, {_HEADING}, 1)) - length(replace(regexp_extract(line, {_HEADING}, 1), '.', '')))
  WHEN regexp_matches(line, '^\\s*[-*]\\s+(.+)$') THEN 'list_bullet' WHEN regexp_matches(line, '^\\s*[0-9]{{1,3}}[.)]\\s+(.+)$') THEN 'list_number' ELSE 'body' END"""


@query(f"WITH {LINES} SELECT style, count(*) AS n, sum(length(CASE style WHEN 'list_bullet' THEN regexp_extract(line, '^\\s*[-*]\\s+(.+)$', 1) WHEN 'list_number' THEN regexp_extract(line, '^\\s*[0-9]{{1,3}}[.)]\\s+(.+)$', 1) ELSE line END))::BIGINT AS n_chars FROM (SELECT *, {_STYLE} AS style FROM lines) GROUP BY style")
def a8_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(text.line_style(F.col("line")).alias("style"), text.line_text(F.col("line")).alias("t"))
    return rows.groupBy("style").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("n_chars"))


@query(f"""WITH {LINES}, md AS (SELECT CASE i % 6 WHEN 0 THEN '## ' || line WHEN 1 THEN '| ' || left(line, 10) || ' |' WHEN 2 THEN '> ' || line WHEN 3 THEN '---' ELSE line END AS l FROM lines)
SELECT CASE WHEN trim(l) = '' THEN 'blank' WHEN l = '---' THEN 'rule' WHEN l LIKE '## %' THEN 'heading2' WHEN regexp_matches(l, '^\\s*\\|.*\\|\\s*$') THEN 'table' WHEN regexp_matches(l, '^\\s*>') THEN 'quote' WHEN regexp_matches(l, '^\\s*[-*+]\\s+') THEN 'list_bullet'
  WHEN regexp_matches(l, '^\\s*[0-9]+[.)]\\s+') THEN 'list_number' ELSE 'body' END AS block, count(*) AS n FROM md GROUP BY 1""")
def a7_markdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("i") % 6
    md = F.when(k == 0, F.concat(F.lit("## "), "line")).when(k == 1, F.concat(F.lit("| "), F.left("line", F.lit(10)), F.lit(" |"))).when(k == 2, F.concat(F.lit("> "), "line")).when(k == 3, "---").otherwise(F.col("line"))
    return lines(spark, sf_dir).groupBy(text.markdown_block(md).alias("block")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g') AS t, html FROM pages)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS text_sha256, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))::INT AS n_links, len(regexp_extract_all(html, '<p[ >]'))::INT AS n_paragraphs FROM v""")
def a6_i21_html_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.sha2(text.strip_html(html), 256).alias("text_sha256"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("n_links"), F.size(F.regexp_extract_all(html, F.lit("<p[ >]"), F.lit(0))).alias("n_paragraphs"),
    )


@query("SELECT event_type, (props::JSON ->> '$.k')::INT % 10 AS k, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1, 2")
def a11_j11_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").where("props IS NOT NULL").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'usdm' WHEN 1 THEN 'formatted_doc_ir' WHEN 2 THEN 'protocol_ir' ELSE 'unknown' END AS kind FROM events) GROUP BY 1""")
def a11_a14_json_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents routed by the keys they have, in the order of the detectors' priorities."""
    from loomgrid.sources.jsons import schema_of

    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"usdmVersion": "3.0", "study": {"studyTitle": "t"}}').when(k == 1, '{"pages": [], "font_inventory": {}}').when(k == 2, '{"protocol_id": "p", "sections": []}').otherwise('{"other": 1}')
    return table(spark, sf_dir, "events").groupBy(schema_of(body).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, 'Order ' || o_orderkey AS title, n AS n_activities, m AS n_pairs FROM (SELECT o_orderkey, (o_orderkey % 3 + 1)::INT AS n, ((o_orderkey % 3 + 1) * 2)::INT AS m FROM orders)""")
def a12_usdm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's JSON for each order, parsed with an explicit schema; its scheduled instances exploded and counted."""
    from loomgrid.sources.jsons import usdm_instances, usdm_study

    names = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("A"), i.cast("string")))
    instances = F.transform(F.array(F.lit("E1"), F.lit("E2")), lambda e: F.struct(e.alias("encounterId"), names.alias("activityIds")))
    study = F.struct(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("studyTitle"), F.array(F.struct(F.transform(names, lambda a: F.struct(a.alias("id"), a.alias("activityName"))).alias("activities"), instances.alias("instances"))).alias("studyDesigns"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.lit("3.0").alias("usdmVersion"), study.alias("study"))).alias("body"))
    parsed = usdm_study(rows, "body")
    pairs = usdm_instances(parsed, ["o_orderkey"]).groupBy("o_orderkey").agg(F.count("*").cast("int").alias("n_pairs"))
    return parsed.join(pairs, "o_orderkey").select("o_orderkey", F.col("study.studyTitle").alias("title"), F.size(F.col("study.studyDesigns")[0]["activities"]).alias("n_activities"), "n_pairs")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sections of all documents: number, page (40 lines each), title."""
    rows = lines(spark, sf_dir).withColumn("number", F.regexp_extract("line", r"^([0-9]{1,2}(?:\.[0-9]{1,3}){0,4})\.?\s+", 1)).where("number <> ''")
    title = F.regexp_replace("line", r"^[0-9.]+\s+", "")
    pages = Window.partitionBy("doc_id")
    return rows.select("doc_id", "number", (F.col("i") / 5).cast("int").alias("page"), "i", F.left(title, F.lit(20)).alias("title")).withColumn("n_pages", F.max("page").over(pages) + 1)


SECTIONS = f"""{LINES}, sections AS (SELECT *, max(page) OVER (PARTITION BY doc_id) + 1 AS n_pages FROM (SELECT doc_id, regexp_extract(line, '^([0-9]{{1,2}}(?:\\.[0-9]{{1,3}}){{0,4}})\\.?\\s+', 1) AS number, (i // 5)::INT AS page, i,
  left(regexp_replace(line, '^[0-9.]+\\s+', ''), 20) AS title FROM lines) WHERE number <> '')"""


@query(f"WITH {SECTIONS} SELECT doc_id, number, page, greatest(page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page, number, i), n_pages) - 1)::INT AS end_page FROM sections")
def f1_section_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir).withColumn("number", F.concat("number", F.lit("|"), F.lpad(F.col("i").cast("string"), 6, "0")))
    return intervals.section_ends(rows).select("doc_id", F.substring_index("number", "|", 1).alias("number"), "page", F.col("end_page").cast("int").alias("end_page"))


@query(f"""WITH {SECTIONS}, one AS (SELECT doc_id, number, min(i) AS i FROM sections GROUP BY 1, 2)
SELECT a.doc_id, a.number, b.number AS parent, CASE WHEN contains(a.number, '.') THEN regexp_extract(a.number, '^(.*)\\.[0-9]+$', 1) || '.' || (regexp_extract(a.number, '([0-9]+)$', 1)::INT + 1)::VARCHAR ELSE (a.number::INT + 1)::VARCHAR END AS next_number,
  length(a.number) - length(replace(a.number, '.', '')) + 1 AS level FROM one a LEFT JOIN one b ON a.doc_id = b.doc_id AND contains(a.number, '.') AND b.number = regexp_replace(a.number, '\\.[^.]+$', '')""")
def d32_p2_p7_section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = sections(spark, sf_dir).select("doc_id", "number").distinct()
    parents = one.select("doc_id", F.col("number").alias("parent"))
    rows = one.withColumn("wanted", text.parent_number(F.col("number")))
    joined = rows.join(parents, (rows["doc_id"] == parents["doc_id"]) & (F.col("wanted") == F.col("parent")), "left")
    return joined.select(rows["doc_id"], "number", "parent", text.next_sibling(F.col("number")).alias("next_number"), text.level_of(F.col("number")).cast("long").alias("level"))


@query(f"WITH {SECTIONS} SELECT doc_id, string_agg(repeat('  ', length(number) - length(replace(number, '.', ''))) || number, chr(10) ORDER BY i) AS outline, lead_n FROM (SELECT *, 0 AS lead_n FROM sections) GROUP BY doc_id, lead_n")
def i28_section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir).withColumn("row", F.concat(F.repeat(F.lit("  "), text.level_of(F.col("number")) - 1), F.col("number")))
    outline = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda s: s["row"]), "\n")
    return rows.groupBy("doc_id").agg(outline.alias("outline")).withColumn("lead_n", F.lit(0))


@query(f"WITH {SECTIONS} SELECT doc_id, count(*) + 10 * count(DISTINCT CASE WHEN number IN ('1', '2', '3', '4', '5') THEN number END) + 0.5 * count(*) FILTER (length(title) > 3) - 20 * count(*) FILTER (regexp_matches(title, '(January|May|March)')) - CASE WHEN count(DISTINCT page) = 1 THEN 50 ELSE 0 END AS score FROM sections GROUP BY 1")
def e33_section_list_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (
        F.count("*") + 10 * F.countDistinct(F.when(F.col("number").isin("1", "2", "3", "4", "5"), F.col("number"))) + 0.5 * F.count_if(F.length("title") > 3)
        - 20 * F.count_if(F.col("title").rlike("(January|May|March)")) - F.when(F.countDistinct("page") == 1, 50).otherwise(0)
    )
    return sections(spark, sf_dir).groupBy("doc_id").agg(score.alias("score"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, i, length(line) AS n, (contains(lower(line), 'the')::INT + contains(lower(line), 'and')::INT + contains(lower(line), 'der')::INT) AS score FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rn FROM s WHERE score > 0), c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY rn) AS so_far FROM r WHERE rn <= 5)
SELECT doc_id, i, score, rn::INT AS rank FROM c WHERE so_far <= 8000""")
def g2_best_sections_in_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five passages of each document by keyword score, while they fit 8,000 characters: the limits are the feature."""
    low = F.lower("line")
    score = sum((F.contains(low, F.lit(w)).cast("int") for w in ("the", "and", "der")), F.lit(0))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "i")
    ranked = lines(spark, sf_dir).select("doc_id", "i", F.length("line").alias("n"), score.alias("score")).where("score > 0").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    so_far = F.sum("n").over(Window.partitionBy("doc_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("so_far", so_far).where("so_far <= 8000").select("doc_id", "i", "score", "rank")


@query(f"""WITH {LINES}, p AS (SELECT doc_id, i // 5 AS page, i % 5 AS place, lower(trim(line)) AS f FROM lines), z AS (SELECT doc_id, page, regexp_replace(f, '[0-9]+$', '') AS f FROM p WHERE place IN (0, 4) AND f <> '')
SELECT doc_id, trim(f) AS fingerprint, count(DISTINCT page) AS n_pages FROM z GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3 AND trim(f) <> ''""")
def e29_i22_headers_and_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lines(spark, sf_dir).where((F.col("i") % 5).isin(0, 4)).select("doc_id", (F.col("i") / 5).cast("int").alias("page"), F.trim(F.regexp_replace(F.lower(F.trim("line")), "[0-9]+$", "")).alias("fingerprint"))
    return edge.where("fingerprint <> ''").groupBy("doc_id", "fingerprint").agg(F.countDistinct("page").alias("n_pages")).where("n_pages >= 3")


@query("""WITH t AS (SELECT doc_id, lang, regexp_split_to_array(text, ' +') AS w, text FROM documents), c AS (SELECT doc_id, lang, len(regexp_extract_all(text, '  +')) AS doubles, len(regexp_extract_all(text, '[.!?][A-Z]')) AS missing, len(regexp_extract_all(text, '[.!?] ')) AS ends FROM t)
SELECT doc_id, doubles::INT AS n_double_spaces, missing::INT AS n_missing_spaces, greatest(0, 100 - 10 * (missing > 5)::INT - 5 * (doubles > 5)::INT - 2 * least(ends, 1)::INT)::INT AS fidelity FROM c""")
def e25_e26_spacing_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p))
    rows = table(spark, sf_dir, "documents").select("doc_id", count("  +").alias("d"), count("[.!?][A-Z]").alias("m"), count("[.!?] ").alias("e"))
    score = F.greatest(F.lit(0), 100 - 10 * (F.col("m") > 5).cast("int") - 5 * (F.col("d") > 5).cast("int") - 2 * F.least("e", F.lit(1)))
    return rows.select("doc_id", F.col("d").alias("n_double_spaces"), F.col("m").alias("n_missing_spaces"), score.cast("int").alias("fidelity"))


@query("""WITH l AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), r AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND lang <> 'fr' GROUP BY 1)
SELECT lang, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right, (l.n IS NULL OR r.n IS NULL) AND greatest(coalesce(l.n, 0), coalesce(r.n, 0)) > 10 AS one_sided FROM l FULL JOIN r USING (lang)""")
def e27_e30_inventories_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = docs.where("doc_id % 2 = 0").groupBy("lang").agg(F.count("*").alias("l"))
    right = docs.where("doc_id % 2 = 1 AND lang <> 'fr'").groupBy("lang").agg(F.count("*").alias("r"))
    one = (F.col("l").isNull() | F.col("r").isNull()) & (F.greatest(F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))) > 10)
    return left.join(right, "lang", "full").select("lang", F.coalesce("l", F.lit(0)).alias("n_left"), F.coalesce("r", F.lit(0)).alias("n_right"), one.alias("one_sided"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 'See Section 5.1.2 and Table 3' WHEN 1 THEN 'as in Figure 2.1, appendix B' WHEN 2 THEN 'none' WHEN 3 THEN 'at https://a.org/x now' WHEN 4 THEN 'subsection 4' ELSE 'Appendix A: section 7' END AS t FROM lineitem),
a AS (SELECT *, regexp_replace(t, '(^|[^"\\w])([Ss]ection\\s+)([0-9]{1,2}(?:\\.[0-9]{1,3}){0,4})', '\\1<a href="#section-\\3" class="cross-ref" data-ref-type="section" data-ref="\\3">\\2\\3</a>', 'g') AS x FROM r),
b AS (SELECT *, regexp_replace(regexp_replace(x, '(^|[^"\\w])([Tt]able\\s+)([0-9]{1,3}(?:\\.[0-9]{1,2})?)', '\\1<a href="#table-\\3" class="cross-ref" data-ref-type="table" data-ref="\\3">\\2\\3</a>', 'g'), '(^|[^"\\w])([Ff]igure\\s+)([0-9]{1,3}(?:\\.[0-9]{1,2})?)', '\\1<a href="#figure-\\3" class="cross-ref" data-ref-type="figure" data-ref="\\3">\\2\\3</a>', 'g') AS y FROM a)
SELECT regexp_replace(regexp_replace(y, '(^|[^"\\w])([Aa]ppendix\\s+)([A-Z0-9]{1,3})', '\\1<a href="#appendix-\\3" class="cross-ref" data-ref-type="appendix" data-ref="\\3">\\2\\3</a>', 'g'), '(^|[^"\\w=])(https?://[^\\s<>"'')\\]]+)', '\\1<a href="\\2" target="_blank" rel="noopener" class="external-link">\\2</a>', 'g') AS linked, count(*) AS n FROM b GROUP BY 1""")
def p11_auto_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 6
    raw = F.when(k == 0, "See Section 5.1.2 and Table 3").when(k == 1, "as in Figure 2.1, appendix B").when(k == 2, "none").when(k == 3, "at https://a.org/x now").when(k == 4, "subsection 4").otherwise("Appendix A: section 7")
    return table(spark, sf_dir, "lineitem").groupBy(text.auto_link(raw).alias("linked")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'X<sup>a</sup>' WHEN 1 THEN 'CO<sub>2</sub> and H<sub>2</sub>O' WHEN 2 THEN 'HbA<sub>1c</sub>' WHEN 3 THEN '5 × 10<sup>6</sup> cells' ELSE '20 mg/m<sup>2</sup>' END AS html,
  CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'co2 and h2o' WHEN 2 THEN 'hba1c' WHEN 3 THEN '5 x 106 cells' ELSE '20 mg/m2' END AS vote, o_orderkey % 16777216 // 65536 AS r, o_orderkey % 65536 // 256 AS g, o_orderkey % 256 AS b FROM orders""")
def i1_i12_i24_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "X^{a}").when(k == 1, "CO2 and H2O").when(k == 2, "HbA1c").when(k == 3, "5 x 106 cells").otherwise("20 mg/m2")
    return table(spark, sf_dir, "orders").select("o_orderkey", grid.markup(raw).alias("html"), grid.vote_value(raw).alias("vote"), text.color_parts(F.col("o_orderkey")).alias("c")).select("o_orderkey", "html", "vote", "c.*")


@query("""SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, 'schedule of ' || lower(c_mktsegment) AS base_title, 'Dear ' || c_name || ' of ' || c_mktsegment AS filled,
  CASE c_custkey % 4 WHEN 3 THEN NULL ELSE (c_custkey % 7)::VARCHAR END AS a, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 256) * 65536 + 171 END::DOUBLE AS color FROM customer""")
def i23_i25_i26_i31_i32_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey") % 4, (F.col("c_custkey") % 7).cast("string")
    body = F.concat(F.lit('{"a": '), n, F.lit("}"))
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("It is "), body, F.lit(" I think"))).otherwise("no answer")
    title = F.concat(F.lit("Schedule of "), F.col("c_mktsegment"), F.when(k == 1, " (continued)").when(k == 2, " (cont.)").otherwise(""))
    style = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("font: x; color: #"), F.lpad(F.lower(F.hex(F.col("c_custkey") % 256)), 2, "0"), F.lit("00ab"))).otherwise("font: x")
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("group"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.slug(F.col("c_name")).alias("slug"), text.base_title(title).alias("base_title"), text.fill_placeholders(F.lit("Dear {{name}} of {{group}}"), values).alias("filled"),
        F.get_json_object(text.salvage_json(reply), "$.a").alias("a"), text.css_color(text.css_value(style, "color")).cast("double").alias("color"),
    )


@query("""SELECT l_partkey % 6 AS k, CASE l_partkey % 6 WHEN 0 THEN 'n = (Zα + Zβ)² × 2σ² / δ²' WHEN 1 THEN 'HR = exp(β)' WHEN 2 THEN 'n = 636 patients' WHEN 3 THEN 'a plain line' WHEN 4 THEN 'CI = p ± 1.96' ELSE 'x' END AS line, l_partkey % 6 IN (0, 1, 4) AS is_equation, count(*) AS n FROM lineitem GROUP BY ALL""")
def c15_equation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 6
    line = F.when(k == 0, "n = (Zα + Zβ)² × 2σ² / δ²").when(k == 1, "HR = exp(β)").when(k == 2, "n = 636 patients").when(k == 3, "a plain line").when(k == 4, "CI = p ± 1.96").otherwise("x")
    return table(spark, sf_dir, "lineitem").groupBy(k.alias("k"), line.alias("line")).agg(F.count("*").alias("n")).withColumn("is_equation", text.looks_like_equation(F.col("line")))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM lines WHERE i < 60)
SELECT doc_id, arg_min(regexp_extract(line, '([0-9]{{2,}})', 1), i) FILTER (regexp_matches(line, '[0-9]{{2,}}')) AS code, arg_min(following, i) FILTER (line LIKE '- %' AND following IS NOT NULL) AS title FROM n GROUP BY 1""")
def a26_cover_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of the cover pages' lines, and the line after the first bullet as the title."""
    rows = lines(spark, sf_dir).where("i < 60").withColumn("following", F.lead("line").over(Window.partitionBy("doc_id").orderBy("i")))
    number, bullet = F.col("line").rlike("[0-9]{2,}"), F.col("line").startswith("- ") & F.col("following").isNotNull()
    first = lambda value, cond: F.min_by(F.when(cond, value), F.when(cond, F.col("i")))
    return rows.groupBy("doc_id").agg(first(F.regexp_extract("line", "([0-9]{2,})", 1), number).alias("code"), first(F.col("following"), bullet).alias("title"))


@query("""WITH s AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type, value FROM s WHERE rn = 1""")
def f15_k1_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("s"))
    return last.select("user_id", "s.*")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def a24_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 records: the limit is the feature."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type").limit(50)


@query("SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20 OFFSET 40")
def c21_g4_paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty records of a status: paging is the feature."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "value").orderBy("event_id").offset(40).limit(20)


@query(f"WITH {LINES}, x AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, string_agg('<p>' || replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>', '' ORDER BY i) AS h FROM lines GROUP BY 1) SELECT doc_id, sha256(t) AS text_sha256, sha256(h) AS html_sha256 FROM x")
def b1_render_text_and_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.sources.render import to_html, to_text

    rows = lines(spark, sf_dir)
    return to_text(rows, ["doc_id"], "i", "line").join(to_html(rows, ["doc_id"], "i", "line"), "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.sha2("html", 256).alias("html_sha256"))


@query("""WITH d AS (SELECT doc_id, source, n_chars FROM documents), b AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars > 500) / count(*)::DOUBLE AS share FROM d GROUP BY 1) SELECT source, n, share > 0.5 AS text_layout FROM b""")
def c23_layout_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), (F.avg((F.col("n_chars") > 500).cast("int")) > 0.5).alias("text_layout"))


@query("""WITH a AS (SELECT doc_id, n_chars, lang, quality, toxic FROM documents JOIN labels USING (doc_id)), x AS (SELECT unnest(['lang=' || lang, 'size=' || CASE WHEN n_chars > 2000 THEN 'large' ELSE 'small' END, 'toxic=' || toxic]) AS stratum, quality FROM a)
SELECT stratum, count(*) AS n, round(avg(quality), 6) AS mean, min(quality) AS least, max(quality) AS most FROM x GROUP BY 1""")
def e16_stratified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    strata = F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("size="), F.when(F.col("n_chars") > 2000, "large").otherwise("small")), F.concat(F.lit("toxic="), F.col("toxic").cast("string")))
    rows = joined.select(F.explode(strata).alias("stratum"), "quality")
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean"), F.min("quality").alias("least"), F.max("quality").alias("most"))
