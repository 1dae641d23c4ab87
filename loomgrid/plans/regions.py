"""Queries on table regions: which are schedules, what is noise, what continues what, and how rows find their procedure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import classify
from loomgrid.operators import layout, vocabulary
from loomgrid.plans.ranges import regions
from loomgrid.plans.registry import registry
from loomgrid.plans.views import KEY, WITH_CELLS, cells, table

QUERIES, SQL, query = registry()

_TITLES = ["", "Schedule of Activities", "Synopsis", "Dosing schedule", "Table 3", "Time & Events", "Protocol amendment 2", "Assessment Plan", "Figure 1", "SoE", "Statistical analysis", "Visit schedule"]
_TITLE_SQL = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_MARKED = "CASE WHEN doc_id % 4 = 1 THEN text || chr(10) || 'X X' || chr(10) || 'X ✓ X' WHEN doc_id % 4 = 2 THEN left(text, 40) || chr(10) || 'a' || chr(10) || 'b' WHEN doc_id % 4 = 3 THEN 'one line' ELSE text || ' visit schedule' END"


def _title(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (i % len(_TITLES) + 1).cast("int"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a region of one page; some pages have marks, some are nearly empty, some name a schedule."""
    k, text = F.col("doc_id") % 4, F.col("text")
    page = F.when(k == 1, F.concat(text, F.lit("\nX X\nX ✓ X"))).when(k == 2, F.concat(F.left(text, F.lit(40)), F.lit("\na\nb"))).when(k == 3, "one line").otherwise(F.concat(text, F.lit(" visit schedule")))
    rows = table(spark, sf_dir, "documents").select("doc_id", _title(F.col("doc_id")).alias("title"), page.alias("page"))
    lines = F.filter(F.transform(F.split("page", "\n", -1), F.trim), lambda x: x != "")
    return rows.withColumns({"lines": F.size(lines), "single": F.size(F.filter(lines, lambda x: F.length(x) == 1)), "marks": classify.marks_in(F.col("page")), "on_page": F.col("page").rlike(classify.PAGE_TITLE)})


_PAGES = f"""pages_ AS (SELECT doc_id, {_TITLE_SQL} AS title, {_MARKED} AS page FROM documents),
signals AS (SELECT doc_id, title, len(ls) AS lines, len(list_filter(ls, lambda x: length(x) = 1)) AS single, regexp_matches(page, '{classify.PAGE_TITLE}') AS on_page,
    len(list_filter(regexp_split_to_array(page, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x = 'X')) + length(page) - length(translate(page, '✓✔', '')) AS marks
  FROM (SELECT *, list_filter(list_transform(string_split(page, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pages_)),
likely AS (SELECT *, CASE WHEN len(list_filter({_LIST(classify.REJECT_TITLES)}, lambda w: contains(lower(title), w))) > 0 THEN false
  WHEN len(list_filter({_LIST(classify.ACCEPT_TITLES)}, lambda w: contains(lower(title), w))) > 0 THEN true
  WHEN on_page OR marks >= 5 THEN true WHEN lines >= 10 AND single / greatest(lines, 1) > 0.5 THEN true WHEN marks = 0 AND lines < 20 THEN false ELSE true END AS is_schedule FROM signals)"""


@query(f"WITH {_PAGES} SELECT doc_id, marks::INT AS marks, is_schedule FROM likely")
def c2_schedule_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    likely = classify.is_schedule(c("title"), c("on_page"), c("marks"), c("lines"), c("single"), F.lit(1))
    return _pages(spark, sf_dir).select("doc_id", "marks", likely.alias("is_schedule"))


@query(f"""WITH {_PAGES}, x AS (SELECT *, doc_id % 7 = 0 AS in_range, (doc_id % 30)::INT AS n, CASE WHEN doc_id % 11 = 0 THEN 1.0 ELSE 0.5 END AS flagged, (doc_id % 6)::INT AS headers, (doc_id % 6 // 3)::INT AS visits FROM likely)
SELECT doc_id FROM x WHERE (in_range OR is_schedule) AND NOT (marks = 0 AND n > 5) AND NOT (flagged >= 0.98 AND marks = 0 AND n > 10) AND NOT (headers >= 3 AND visits = 0)""")
def c3_layered_schedule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that pass the page range, content, marks, flags and headers."""
    c, id_ = F.col, F.col("doc_id")
    likely = classify.is_schedule(c("title"), c("on_page"), c("marks"), c("lines"), c("single"), F.lit(1))
    kept = classify.passes_layers(id_ % 7 == 0, likely, c("marks"), id_ % 30, F.when(id_ % 11 == 0, 1.0).otherwise(0.5), id_ % 6, F.floor(id_ % 6 / 3))
    return _pages(spark, sf_dir).where(kept).select("doc_id")


_ROW = "CASE i % 9 WHEN 1 THEN 'Page ' || i WHEN 2 THEN 'Protocol A' || left(line, 20) WHEN 3 THEN i || '.2 ' || left(line, 30) WHEN 4 THEN 'ECG' WHEN 5 THEN 'Vital signs will be taken' WHEN 6 THEN left(line, 100) || '.' WHEN 7 THEN 'Note: see' ELSE line END"


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(ls)))::INT AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), r AS (SELECT doc_id, {_ROW} AS t FROM l), x AS (SELECT *, lower(trim(t)) AS low FROM r)
SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(low, '{classify.TABLE_CHROME}') OR length(t) > 200) AS n_table_noise,
  count(*) FILTER (regexp_matches(low, '{classify.PAGE_CHROME}') OR length(t) > 120 OR len(list_filter({_LIST(classify.BODY_SIGNALS)}, lambda w: contains(low, w))) > 0 OR (regexp_matches(low, '[.,]$') AND length(t) > 80)
    OR regexp_matches(low, '{classify.FRAGMENTS}') OR (regexp_matches(t, '^[a-z]') AND length(t) > 30)) AS n_page_noise FROM x GROUP BY 1""")
def c7_noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, line = F.col("i"), F.col("line")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    said = i.cast("string")
    text = (
        F.when(i % 9 == 1, F.concat(F.lit("Page "), said)).when(i % 9 == 2, F.concat(F.lit("Protocol A"), F.left(line, F.lit(20)))).when(i % 9 == 3, F.concat(said, F.lit(".2 "), F.left(line, F.lit(30)))).when(i % 9 == 4, "ECG")
        .when(i % 9 == 5, "Vital signs will be taken").when(i % 9 == 6, F.concat(F.left(line, F.lit(100)), F.lit("."))).when(i % 9 == 7, "Note: see").otherwise(line)
    )
    t = F.col("t")
    return rows.select("doc_id", text.alias("t")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(classify.table_noise(t)).alias("n_table_noise"), F.count_if(classify.page_noise(t)).alias("n_page_noise"))


_NAMES = ["Electrocardiogram at rest", "CT chest with contrast", "12-lead ecg", "Liver biopsy sample", "xray of hand", "collect urine", "Spirometry", "pre-dose MRI", "a petty thing", "MRI-guided echocardiogram"]


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 10 """ + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_NAMES)) + """ END AS name FROM part)
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'ECG' WHEN 1 THEN 'CT' WHEN 2 THEN 'ECG' WHEN 3 THEN 'Biopsy' WHEN 6 THEN 'Spirometry' ELSE name END AS canonical_name,
  CASE p_partkey % 10 WHEN 0 THEN 'key_term' WHEN 1 THEN 'key_term' WHEN 2 THEN 'word_match' WHEN 3 THEN 'word_match' WHEN 6 THEN 'exact' ELSE 'unmatched' END AS method FROM n""")
def d8_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's last step: terms that name a procedure by another of its names."""
    rows = [(1, "ECG", ["ecg"]), (2, "CT", ["ct scan"]), (3, "Biopsy", ["tumor biopsy"]), (4, "Spirometry", [])]
    known = spark.createDataFrame([(i, n, None, "x", "LOW", a) for i, n, a in rows], "entry_ix long, canonical_name string, code string, category string, cost_tier string, aliases array<string>")
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("p_partkey") % 10 + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", name.alias("raw_name"))
    return parts.join(vocabulary.normalise(parts.select("raw_name"), known), "raw_name").select("p_partkey", "canonical_name", "method")


@query(f"""{WITH_CELLS}, p AS (SELECT doc_id, 'procedure ' || (supp % 7) AS name, min(row_ix * 100 + col_ix) AS ix FROM cells WHERE col_ix > 3 GROUP BY 1, 2),
h AS (SELECT DISTINCT doc_id, row_ix, min('Procedure ' || (supp % 7) || CASE WHEN part % 3 = 0 THEN ' at rest' ELSE '' END) OVER (PARTITION BY doc_id, row_ix) AS header FROM cells),
m AS (SELECT h.doc_id, h.row_ix, p.name, row_number() OVER (PARTITION BY h.doc_id, h.row_ix ORDER BY lower(header) = name DESC, ix, name) AS rn FROM h JOIN p ON p.doc_id = h.doc_id AND (lower(header) = name OR (length(name) >= 5 AND starts_with(lower(header), name))))
SELECT doc_id, row_ix, name AS procedure, lower(header) = name AS exact FROM m JOIN h USING (doc_id, row_ix) WHERE rn = 1""")
def d13_row_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their procedure: of the same name, else the first whose name the row's begins with."""
    name = F.concat(F.lit("Procedure "), (F.col("supp") % 7).cast("string"))
    rows = cells(spark, sf_dir)
    known = rows.where("col_ix > 3").groupBy("doc_id", F.lower(name).alias("name")).agg(F.min(F.col("row_ix") * 100 + F.col("col_ix")).alias("ix"))
    header = F.min(F.concat(name, F.when(F.col("part") % 3 == 0, " at rest").otherwise(""))).alias("header")
    return vocabulary.row_procedures(rows.groupBy("doc_id", "row_ix").agg(header), known)


@query(f"""{WITH_CELLS}, v AS (SELECT doc_id, col_ix, max('H' || (part % 50)) AS header FROM cells WHERE row_ix <= 2 GROUP BY 1, 2), p AS (SELECT doc_id, row_ix, max('P' || (supp % 50)) AS name FROM cells WHERE col_ix <= 4 GROUP BY 1, 2)
SELECT c.doc_id, c.row_ix, c.col_ix, header AS visit, name AS procedure FROM cells c JOIN v USING (doc_id, col_ix) JOIN p USING (doc_id, row_ix)""")
def d13_visit_procedure_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their column's visit and their row's procedure; cells without either are left out."""
    rows = cells(spark, sf_dir)
    visits = rows.where("row_ix <= 2").groupBy("doc_id", "col_ix").agg(F.max(F.concat(F.lit("H"), (F.col("part") % 50).cast("string"))).alias("visit"))
    names = rows.where("col_ix <= 4").groupBy("doc_id", "row_ix").agg(F.max(F.concat(F.lit("P"), (F.col("supp") % 50).cast("string"))).alias("procedure"))
    return rows.select(*KEY).join(visits, ["doc_id", "col_ix"]).join(names, ["doc_id", "row_ix"]).select(*KEY, "visit", "procedure")


@query(f"""{WITH_CELLS}, a AS (SELECT DISTINCT doc_id, 'P' || (part % 30) AS name FROM cells WHERE col_ix % 2 = 0), b AS (SELECT DISTINCT doc_id, 'P' || (part % 30) AS name FROM cells WHERE col_ix % 3 = 0)
SELECT doc_id, name, 'found only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT doc_id, name, 'anchored only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def d21_anchor_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that were found but are not anchored in the page, and the other way round."""
    names = lambda cond: cells(spark, sf_dir).where(cond).select("doc_id", F.concat(F.lit("P"), (F.col("part") % 30).cast("string")).alias("name")).distinct()
    a, b = names("col_ix % 2 = 0"), names("col_ix % 3 = 0")
    side = lambda x, y, n: x.join(y, ["doc_id", "name"], "left_anti").withColumn("side", F.lit(n))
    return side(a, b, "found only").unionByName(side(b, a, "anchored only"))


def _named_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with headers and row names by their key."""
    k = F.col("region")
    headers = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.concat(F.lit("V"), (i + k % 2).cast("string"))))
    name = lambda i: F.when((i + k) % 3 == 0, "visit").otherwise(F.concat(F.lit("Procedure "), i.cast("string")))
    names = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), name))
    return regions(spark, sf_dir).withColumns({"headers": headers, "names": names})


_REGIONS = """r AS (SELECT o_custkey AS doc_id, o_orderkey AS region, o_orderkey AS k, o_orderkey % 200 AS p0, o_orderkey % 200 + 1 AS p1, lower('Schedule ' || o_orderstatus) AS base, o_orderkey % 3 = 0 AS marked,
    CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE list_transform(range(1, o_orderkey % 4 + 2), lambda i: 'v' || (i + o_orderkey % 2)) END AS headers,
    CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE list_transform(range(1, o_orderkey % 3 + 2), lambda i: CASE WHEN (i + o_orderkey) % 3 = 0 THEN 0 ELSE 1 END) END AS known FROM orders)"""


def _score_sql(a: str, b: str) -> str:
    return f"""greatest(0, least(1, 0.35 * CASE WHEN len({a}.headers) > 0 AND len({b}.headers) > 0 THEN 0.4 * (1 - abs(len({a}.headers) - len({b}.headers)) / greatest(len({a}.headers), len({b}.headers))) + 0.6 * len(list_intersect({a}.headers, {b}.headers)) / greatest(len({a}.headers), len({b}.headers)) ELSE 0.5 END
  + 0.25 * CASE WHEN len({a}.known) > 0 AND len({b}.known) > 0 THEN least(1, 1.2 * list_sum({b}.known) / len({b}.known)) ELSE 0.3 END + CASE WHEN {b}.marked THEN 0.25 ELSE 0 END + CASE WHEN {b}.base = {a}.base THEN 0.25 ELSE -0.15 END
  + CASE WHEN {b}.p0 - {a}.p1 <= 1 THEN 0.15 WHEN {b}.p0 - {a}.p1 <= 3 THEN 0.105 WHEN {b}.p0 - {a}.p1 <= 5 THEN 0.045 ELSE 0 END))"""


@query(f"""WITH {_REGIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p0, region) AS i FROM r) SELECT b.doc_id, b.region, round({_score_sql("a", "b")}, 6)::DOUBLE AS score FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i = a.i + 1""")
def j6_continuity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.continuity(_named_regions(spark, sf_dir)).select("doc_id", "region", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_REGIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p0, region) AS i FROM r),
f AS (SELECT doc_id, i, [{{'region': region, 'headers': headers, 'known': known, 'base': base, 'p1': p1}}] AS open, [{{'region': region, 'tab': region}}] AS out FROM n WHERE i = 1
  UNION ALL
  SELECT b.doc_id, b.i,
    CASE WHEN hit IS NULL THEN list_append(open, {{'region': b.region, 'headers': b.headers, 'known': b.known, 'base': b.base, 'p1': b.p1}})
      ELSE list_transform(open, lambda a, j: CASE WHEN j = hit THEN {{'region': a.region, 'headers': a.headers, 'known': a.known, 'base': a.base, 'p1': greatest(a.p1, b.p1)}} ELSE a END) END,
    list_append(out, {{'region': b.region, 'tab': CASE WHEN hit IS NULL THEN b.region ELSE open[hit].region END}})
  FROM (SELECT f.*, b, (SELECT max(j) FROM (SELECT unnest(range(1, len(f.open) + 1)) AS j, unnest(f.open) AS a) WHERE {_score_sql("a", "b")} >= 0.45) AS hit FROM f JOIN n b ON b.doc_id = f.doc_id AND b.i = f.i + 1))
SELECT doc_id, o.region AS region, o.tab AS table_id FROM (SELECT doc_id, unnest(out) AS o FROM (SELECT doc_id, arg_max(out, i) AS out FROM f GROUP BY 1))""")
def f11_stitch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions joined to earlier ones where they continue: a sequential pass for each document."""
    return layout.stitch(_named_regions(spark, sf_dir))
