"""Queries on page layout: paragraphs, spans, section texts, page offsets, tables, profiles, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import grid
from loomgrid.operators import paragraphs, reconcile
from loomgrid.plans.texts import LINES, lines
from loomgrid.plans.registry import registry
from loomgrid.plans.views import KEY, WITH_CELLS, WITH_PASSES, cells, pass_of, table

QUERIES, SQL, query = registry()


@query(f"""WITH {LINES}, g AS (SELECT doc_id, i, (length(line) % 30)::DOUBLE AS gap, (10 + i // 6 % 3)::DOUBLE AS size FROM lines), f AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL THEN 0 WHEN gap > 1.5 * size OR size <> lag(size) OVER w THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, paragraph, count(*) AS n FROM (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i)::INT AS paragraph FROM f) GROUP BY 1, 2""")
def f8_p10_paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "i", (F.length("line") % 30).cast("double").alias("gap"), (10 + F.floor(F.col("i") / 6) % 3).cast("double").alias("size"))
    return paragraphs.breaks(rows, ["doc_id"], "i", F.col("gap"), F.col("size")).groupBy("doc_id", "paragraph").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(range(len(x))) AS i, unnest(x) AS text FROM (SELECT conv_id, turn, string_split(text, ' ') AS x FROM conversations)), s AS (SELECT *, i * 10.0 AS x0, i * 10.0 + 6 + (length(text) % 5) AS x1, 8.0 AS size FROM w),
l AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER w, '[A-Za-z]$') AND regexp_matches(text, '^[A-Za-z]') AND x0 - lag(x1) OVER w > 0.25 * size THEN ' ' ELSE '' END || text AS piece FROM s WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))
SELECT conv_id, turn, sha256(string_agg(piece, '' ORDER BY i)) AS text_sha256 FROM l GROUP BY 1, 2""")
def p9_span_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "text"))
    spans = words.withColumns({"x0": F.col("i") * 10.0, "x1": F.col("i") * 10.0 + 6 + F.length("text") % 5, "size": F.lit(8.0)})
    return paragraphs.joined_spans(spans, ["conv_id", "turn"], "i").select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {LINES}, h AS (SELECT doc_id, regexp_extract(line, '^([0-9]+\\.[0-9]+)\\s', 1) AS number, i AS start, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, 1000000) AS stop FROM lines WHERE regexp_matches(line, '^[0-9]+\\.[0-9]+\\s'))
SELECT h.doc_id, h.number, sha256(string_agg(l.line, chr(10) ORDER BY l.i)) AS text_sha256 FROM h JOIN lines l ON l.doc_id = h.doc_id AND l.i BETWEEN h.start AND h.stop GROUP BY 1, 2""")
def p6_p8_section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    heads = rows.where(F.col("line").rlike(r"^[0-9]+\.[0-9]+\s")).select("doc_id", F.regexp_extract("line", r"^([0-9]+\.[0-9]+)\s", 1).alias("number"), F.col("i").alias("start"))
    last = rows.groupBy("doc_id").agg(F.max("i").alias("last"))
    ranges = heads.join(last, "doc_id").withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")) - 1, F.col("last"))).drop("last")
    return paragraphs.section_texts(rows, ranges, 32).select("doc_id", "number", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, i // 4 AS page, line FROM lines), t AS (SELECT doc_id, i AS number, left(line, 4) AS title, i // 9 AS page FROM lines WHERE i % 7 = 4), f AS (SELECT doc_id, min({{'page': page, 'title': title}}) AS f FROM t GROUP BY 1),
o AS (SELECT p.doc_id, min(p.page) - f.page AS off FROM p JOIN (SELECT doc_id, f.page AS page, f.title AS title FROM f) f ON p.doc_id = f.doc_id AND p.page >= f.page AND contains(lower(p.line), lower(f.title)) GROUP BY p.doc_id, f.page)
SELECT t.doc_id, t.number, (t.page + coalesce(off, 0))::BIGINT AS page FROM t LEFT JOIN o USING (doc_id)""")
def f14_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    toc = rows.where("i % 7 = 4").select("doc_id", F.col("i").alias("number"), F.left("line", F.lit(4)).alias("title"), F.floor(F.col("i") / 9).alias("page"))
    return paragraphs.calibrated(toc, rows.select("doc_id", F.floor(F.col("i") / 4).alias("page"), "line")).select("doc_id", "number", "page")


@query(f"""{WITH_CELLS}, s AS (SELECT doc_id, row_ix, col_ix, raw_value, CASE WHEN part % 6 = 0 THEN 2 ELSE 1 END AS rows_, CASE WHEN part % 5 = 0 THEN 2 ELSE 1 END AS cols FROM cells),
c AS (SELECT DISTINCT doc_id, r AS row_ix, k AS col_ix FROM (SELECT doc_id, row_ix, col_ix, r, unnest(range(col_ix, col_ix + cols)) AS k FROM (SELECT *, unnest(range(row_ix, row_ix + rows_)) AS r FROM s)) WHERE r <> row_ix OR k <> col_ix),
v AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = s.doc_id AND c.row_ix = s.row_ix AND c.col_ix = s.col_ix)),
t AS (SELECT doc_id, row_ix, '<tr>' || string_agg('<td' || CASE WHEN rows_ > 1 THEN ' rowspan="2"' ELSE '' END || CASE WHEN cols > 1 THEN ' colspan="2"' ELSE '' END || '>' || raw_value || '</td>', '' ORDER BY col_ix) || '</tr>' AS tr FROM v GROUP BY 1, 2)
SELECT doc_id, '<table>' || string_agg(tr, '' ORDER BY row_ix) || '</table>' AS html FROM t GROUP BY 1""")
def p22_i27_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumns({"rows": F.when(F.col("part") % 6 == 0, 2).otherwise(1), "cols": F.when(F.col("part") % 5 == 0, 2).otherwise(1)})
    return paragraphs.table_html(rows, ["doc_id"])


@query("""SELECT l_orderkey, count(*) AS n_headers, max(l_suppkey % 8) AS num_cols, CASE WHEN abs(count(*) - max(l_suppkey % 8)) > 2 THEN count(*) ELSE max(l_suppkey % 8) END AS used FROM lineitem GROUP BY 1""")
def p18_schema_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, cols = F.count("*"), F.max(F.col("l_suppkey") % 8)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n.alias("n_headers"), cols.alias("num_cols"), F.when(F.abs(n - cols) > 2, n).otherwise(cols).alias("used"))


@query("""WITH s AS (SELECT source, avg(n_chars) AS a, list_distinct(list(lang)) AS langs FROM documents GROUP BY 1), t AS (SELECT avg(n_chars) AS a, list_distinct(list(lang)) AS langs FROM documents WHERE source = 'src0') SELECT s.source, round(s.a / t.a, 6) AS ratio, NOT (s.a / t.a BETWEEN 0.7 AND 1.3) AS differs, round(len(list_intersect(s.langs, t.langs)) / len(t.langs)::DOUBLE, 6) AS font_match FROM s, t""")
def p20_template_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's mean length and set of values against those of a template source, which is one row."""
    profiles = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("a"), F.collect_set("lang").alias("langs"))
    one = profiles.where("source = 'src0'").select(F.col("a").alias("own"), F.col("langs").alias("own_langs"), F.lit(1).alias("k"))
    joined = profiles.withColumn("k", F.lit(1)).join(F.broadcast(one), "k", "left")  # one row
    ratio = F.col("a") / F.col("own")
    return joined.select("source", F.round(ratio, 6).alias("ratio"), (~ratio.between(0.7, 1.3)).alias("differs"), F.round(F.size(F.array_intersect("langs", "own_langs")) / F.size("own_langs"), 6).alias("font_match"))


@query(f"""{WITH_PASSES}, t AS (SELECT doc_id, string_agg(row_ix || ':' || col_ix || ':' || raw_value, ';' ORDER BY row_ix, col_ix) AS s FROM p1 GROUP BY 1), f AS (SELECT doc_id, string_agg(row_ix || ':' || col_ix || ':' || raw_value, ';' ORDER BY row_ix, col_ix) AS s FROM p2 GROUP BY 1)
SELECT doc_id, sha256(t.s) AS truth_sha256, sha256(f.s) AS found_sha256 FROM t JOIN f USING (doc_id)""")
def b12_pair_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction of every document that has both."""
    all_cells = cells(spark, sf_dir)

    def flat(rows: DataFrame, name: str) -> DataFrame:
        cell = F.struct("row_ix", "col_ix", F.concat_ws(":", F.col("row_ix").cast("string"), F.col("col_ix").cast("string"), "raw_value").alias("v"))
        return rows.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda s: s["v"]), ";"), 256).alias(name))

    return flat(pass_of(all_cells, 1), "truth_sha256").join(flat(pass_of(all_cells, 2), "found_sha256"), "doc_id")


@query("""SELECT l_orderkey AS doc_id, l_linenumber::INT AS row_ix, (l_suppkey % 8 + 1)::INT AS col_ix, min(l_partkey) AS first_part, max(l_partkey) AS last_part FROM lineitem GROUP BY 1, 2, 3""")
def f2_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of a cell, the first and the last in a total order."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row_ix"), (F.col("l_suppkey") % 8 + 1).cast("int").alias("col_ix"), F.col("l_partkey").alias("part"))
    first = reconcile.latest_cells(rows, ["part"], first=True).withColumnRenamed("part", "first_part")
    return first.join(reconcile.latest_cells(rows, ["part"]).withColumnRenamed("part", "last_part"), KEY)


@query(f"""{WITH_CELLS}, a AS (SELECT doc_id, count(*) AS total, count(*) FILTER (qty > 25) AS bold, count(*) FILTER (disc > 0.05) AS italic, count(*) FILTER (part % 9 = 0) AS dropped FROM cells GROUP BY 1)
SELECT doc_id, total, bold, italic, dropped, round(least((total - dropped) / total::DOUBLE, 1), 6) AS fidelity, CASE WHEN dropped = 0 THEN 'none' WHEN dropped > total / 2.0 THEN 'most' ELSE 'some' END AS cause FROM a""")
def e28_span_forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    dropped = rows.join(rows.where("part % 9 <> 0").select(*KEY), KEY, "left_anti").groupBy("doc_id").agg(F.count("*").alias("dropped"))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("qty") > 25).alias("bold"), F.count_if(F.col("disc") > 0.05).alias("italic"))
    joined = counts.join(dropped, "doc_id", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))
    cause = F.when(F.col("dropped") == 0, "none").when(F.col("dropped") > F.col("total") / 2, "most").otherwise("some")
    return joined.withColumns({"fidelity": F.round(F.least((F.col("total") - F.col("dropped")) / F.col("total"), F.lit(1.0)), 6), "cause": cause})


