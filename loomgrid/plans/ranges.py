"""Queries on ranges and sequences: sessions, merges, containment, overlaps, offsets, nearest, greedy passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import intervals, layout
from loomgrid.plans.registry import registry
from loomgrid.plans.views import WITH_CELLS, cells, table

QUERIES, SQL, query = registry()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id as the document, and its distinct pages: every seventh event number, modulo 400."""
    return table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 400).alias("page")).distinct()


PAGES = "pages_ AS (SELECT DISTINCT user_id, event_id % 400 AS page FROM events)"


@query(f"WITH {PAGES}, f AS (SELECT *, CASE WHEN page - lag(page) OVER w > 3 THEN 1 ELSE 0 END AS new FROM pages_ WINDOW w AS (PARTITION BY user_id ORDER BY page)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY page) AS session FROM f) SELECT user_id, session::INT AS session, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM s GROUP BY 1, 2")
def f3_page_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.sessions(pages(spark, sf_dir), ["user_id"], "page", 3)
    return rows.groupBy("user_id", "session").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("user_id", F.col("page").alias("start"), (F.col("page") + F.col("page") % 5).alias("stop"))


@query(f"""WITH {PAGES}, r AS (SELECT user_id, page AS start, page + page % 5 AS stop FROM pages_), m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop) AS k FROM m) SELECT user_id, min(start) AS start, max(stop) AS stop, count(*) AS n FROM g GROUP BY user_id, k""")
def f4_merge_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(page_ranges(spark, sf_dir), ["user_id"], "start", "stop")


@query(f"""WITH {PAGES}, n AS (SELECT *, lead(page) OVER (PARTITION BY user_id ORDER BY page) AS nxt FROM pages_), e AS (SELECT user_id, page, unnest(range(page, CASE WHEN nxt - page <= 3 THEN greatest(page + 1, nxt) ELSE page + 1 END)) AS p FROM n)
SELECT user_id, p AS page, p <> page AS filled FROM e""")
def f5_fill_page_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.fill_gaps(pages(spark, sf_dir), ["user_id"], "page")


@query(f"""WITH {PAGES}, s AS (SELECT user_id, (o_orderkey % 380) AS start, (o_orderkey % 380) + 12 AS stop FROM (SELECT DISTINCT user_id FROM events) u JOIN orders ON o_custkey % 150 = user_id)
SELECT user_id, page FROM pages_ p WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND p.page BETWEEN s.start AND s.stop)""")
def d11_p13_page_range_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    start = F.col("o_orderkey") % 380
    ranges = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("user_id"), start.alias("start"), (start + 12).alias("stop")).join(users, "user_id", "left_semi").distinct()
    return intervals.contained(pages(spark, sf_dir), ranges, ["user_id"], "page", "start", "stop", 16).select("user_id", "page").distinct()


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every conversation turn with running offsets."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "word"))
    return intervals.running_offsets(words, ["conv_id", "turn"], ["i"], F.length("word"))


SPANS = """words AS (SELECT conv_id, turn, unnest(range(len(w))) AS i, unnest(w) AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)),
spans AS (SELECT *, stop - length(word) AS start FROM (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS stop FROM words))"""


@query(f"WITH {SPANS} SELECT conv_id, turn, i::INT AS i, start::BIGINT AS start, stop::BIGINT AS stop FROM spans")
def f9_running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("conv_id", "turn", "i", "start", F.col("end").alias("stop"))


@query(f"""WITH {SPANS}, d AS (SELECT conv_id, turn, s AS r_start, s + 7 AS r_end, s // 20 AS det FROM (SELECT conv_id, turn, unnest(range(0, length(text), 20)) AS s FROM conversations)),
h AS (SELECT w.conv_id, w.turn, w.i, d.det, row_number() OVER (PARTITION BY w.conv_id, w.turn, w.i ORDER BY d.det) AS rn FROM spans w JOIN d ON w.conv_id = d.conv_id AND w.turn = d.turn AND w.start < d.r_end AND d.r_start < w.stop WHERE w.start < w.stop)
SELECT conv_id, turn, i::INT AS i, det::BIGINT AS det FROM h WHERE rn = 1""")
def d27_detections_over_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = spans(spark, sf_dir).select("conv_id", "turn", "i", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 20)))
    right = table(spark, sf_dir, "conversations").where("length(text) > 0").select("conv_id", "turn", at.alias("det")).withColumns({"r_start": F.col("det") * 20, "r_end": F.col("det") * 20 + 7})
    return intervals.overlapping(left, right, ["conv_id", "turn"], 32).groupBy("conv_id", "turn", "i").agg(F.min("det").alias("det"))


@query(f"""WITH RECURSIVE s AS (SELECT user_id, start, stop, row_number() OVER (PARTITION BY user_id ORDER BY start, stop DESC) AS rn FROM (SELECT DISTINCT user_id, event_id % 400 AS start, event_id % 400 + 2 + event_id % 7 AS stop FROM events)),
g AS (SELECT user_id, rn, start, stop, true AS kept, stop AS last FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, s.start, s.stop, s.start >= g.last, CASE WHEN s.start >= g.last THEN s.stop ELSE g.last END FROM g JOIN s ON s.user_id = g.user_id AND s.rn = g.rn + 1)
SELECT user_id, start, stop FROM g WHERE kept""")
def f10_greedy_non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("event_id") % 400
    rows = table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + 2 + F.col("event_id") % 7).alias("end")).distinct()
    return intervals.greedy_apart(rows, ["user_id"]).select("user_id", "start", F.col("end").alias("stop"))


@query(f"""WITH RECURSIVE s AS (SELECT user_id, y, row_number() OVER (PARTITION BY user_id ORDER BY y) AS rn FROM (SELECT DISTINCT user_id, (event_id % 997)::DOUBLE AS y FROM events)),
c AS (SELECT user_id, rn, y, y AS first, 0 AS cluster FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, s.y, CASE WHEN s.y - c.first > 4 THEN s.y ELSE c.first END, CASE WHEN s.y - c.first > 4 THEN c.cluster + 1 ELSE c.cluster END FROM c JOIN s ON s.user_id = c.user_id AND s.rn = c.rn + 1)
SELECT user_id, y AS at, cluster FROM c""")
def f6_y_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 997).cast("double").alias("y")).distinct()
    return intervals.clusters(rows, ["user_id"], "y", 4.0).select("user_id", F.col("at"), "cluster")


@query("""WITH p AS (SELECT o_orderkey, o_custkey % 25 AS g, (o_orderkey * 37 % 1000)::DOUBLE AS x FROM orders), c AS (SELECT DISTINCT s_nationkey AS g, (s_suppkey * 83 % 1000)::DOUBLE AS cx FROM supplier),
h AS (SELECT o_orderkey, cx, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(x - cx), cx) AS rn, abs(x - cx) AS d FROM p JOIN c USING (g)) SELECT o_orderkey, cx AS centre FROM h WHERE rn = 1 AND d <= 30""")
def d29_nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("g"), (F.col("o_orderkey") * 37 % 1000).cast("double").alias("x"))
    centres = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("g"), (F.col("s_suppkey") * 83 % 1000).cast("double").alias("cx"))
    return intervals.nearest(points, centres, ["g"], "x", "cx", 30.0).select("o_orderkey", "centre")


@query(f"""{WITH_CELLS}, h AS (SELECT DISTINCT doc_id, col_ix, (part % 3 + 1) AS span FROM cells WHERE row_ix = 1), k AS (SELECT doc_id, row_ix, col_ix FROM cells WHERE row_ix > 1)
SELECT k.doc_id, k.row_ix, k.col_ix, min(h.col_ix) AS parent_col FROM k JOIN h ON k.doc_id = h.doc_id AND k.col_ix BETWEEN h.col_ix AND h.col_ix + h.span - 1 GROUP BY 1, 2, 3""")
def d9_parent_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = cells(spark, sf_dir)
    heads = all_cells.where("row_ix = 1").select("doc_id", F.col("col_ix").alias("parent_col"), (F.col("col_ix") + F.col("part") % 3).alias("last")).distinct()
    rest = all_cells.where("row_ix > 1").select("doc_id", "row_ix", "col_ix")
    return intervals.contained(rest, heads, ["doc_id"], "col_ix", "parent_col", "last", 8).groupBy("doc_id", "row_ix", "col_ix").agg(F.min("parent_col").alias("parent_col"))


@query(f"""{WITH_CELLS}, par AS (SELECT doc_id, row_ix, col_ix, raw_value FROM cells WHERE col_ix IN (1, 5) AND raw_value <> ''), kids AS (SELECT doc_id, row_ix, raw_value, unnest(range(col_ix + 1, col_ix + 4))::INT AS col_ix, col_ix AS parent_col FROM par),
marked AS (SELECT DISTINCT k.doc_id, k.row_ix, k.parent_col FROM kids k JOIN cells c ON c.doc_id = k.doc_id AND c.row_ix = k.row_ix AND c.col_ix = k.col_ix AND c.raw_value <> '')
SELECT k.doc_id, k.row_ix, k.col_ix, k.raw_value FROM kids k WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.doc_id = k.doc_id AND m.row_ix = k.row_ix AND m.parent_col = k.parent_col) AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.doc_id = k.doc_id AND c.row_ix = k.row_ix AND c.col_ix = k.col_ix)""")
def d10_span_header_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.propagate_spans(cells(spark, sf_dir), [1, 5], 3).select("doc_id", "row_ix", "col_ix", "raw_value")


@query("""WITH a AS (SELECT l_orderkey AS doc, l_partkey AS id, l_quantity AS x0, l_quantity + 3 AS x1, l_linenumber * 10 AS y0, l_linenumber * 10 + 4 AS y1 FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS doc, l_quantity AS x0, l_quantity + 6 AS x1, l_linenumber * 10 AS y0, l_linenumber * 10 + 8 AS y1 FROM lineitem WHERE l_returnflag <> 'R')
SELECT doc, id, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.doc = b.doc AND a.x0 < b.x1 + 2 AND b.x0 < a.x1 + 2 AND a.y0 < b.y1 + 2 AND b.y0 < a.y1 + 2) GROUP BY 1, 2""")
def d28_lines_off_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    box = lambda df, w, h: df.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + w).alias("x1"), (F.col("l_linenumber") * 10).alias("y0"), (F.col("l_linenumber") * 10 + h).alias("y1"))
    return layout.outside(box(li.where("l_returnflag = 'R'"), 3, 4), box(li.where("l_returnflag <> 'R'"), 6, 8), "doc", 2.0).groupBy("doc", "id").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS doc_id, page, min(r) AS least, max(r) AS most FROM (SELECT l_orderkey, l_suppkey % 4 AS page, l_linenumber AS r FROM lineitem) GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS rn FROM p),
s AS (SELECT doc_id, rn, page, 0 AS shift, most + 1 AS off FROM n WHERE rn = 1 UNION ALL SELECT n.doc_id, n.rn, n.page, CASE WHEN n.least < s.off THEN s.off ELSE 0 END, n.most + (CASE WHEN n.least < s.off THEN s.off ELSE 0 END) + 1 FROM s JOIN n ON n.doc_id = s.doc_id AND n.rn = s.rn + 1)
SELECT doc_id, page, shift::BIGINT AS shift FROM s""")
def p16_p17_page_row_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 4).alias("page")).agg(F.min("l_linenumber").alias("least"), F.max("l_linenumber").alias("most"))
    return intervals.shift_pages(rows)


@query(f"""{WITH_CELLS}, t AS (SELECT doc_id, supp % 3 AS tab, max(row_ix) + 1 AS n FROM cells GROUP BY 1, 2) SELECT doc_id, tab, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY tab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_offset FROM t""")
def f12_table_row_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_offsets(cells(spark, sf_dir).withColumn("tab", F.col("supp") % 3))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table regions: an order is a region of its customer's document, paged by its key, titled by its status."""
    title = F.concat(F.lit("Schedule "), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, " (continued)").otherwise(""))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("region"), (F.col("o_orderkey") % 200).alias("first_page"), (F.col("o_orderkey") % 200 + 1).alias("last_page"), title.alias("title"), (F.col("o_orderkey") % 3 == 0).alias("marked"))


@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS doc_id, l_linenumber::INT AS row_ix, (l_suppkey % 8 + 1)::INT AS col_ix, max({'part': l_partkey, 'supp': l_suppkey, 'qty': l_quantity, 'price': l_extendedprice, 'disc': l_discount, 'tax': l_tax, 'flag': l_returnflag, 'status': l_linestatus}) AS m FROM lineitem GROUP BY 1, 2, 3),
x AS (SELECT DISTINCT doc_id, m.supp % 3 AS tab, m.part % 23 AS name FROM c), y AS (SELECT DISTINCT doc_id, m.supp % 3 + 10 AS truth, m.part % 23 AS name FROM c WHERE m.part % 4 <> 0),
p AS (SELECT doc_id, tab, truth, count(*) AS overlap FROM x JOIN y USING (doc_id, name) GROUP BY 1, 2, 3 HAVING count(*) >= 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, tab, truth) AS i FROM p),
f AS (SELECT doc_id, i, [{'tab': tab, 'truth': truth, 'overlap': overlap}] AS out FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN len(list_filter(out, lambda o: o.tab = n.tab OR o.truth = n.truth)) > 0 THEN out ELSE list_append(out, {'tab': n.tab, 'truth': n.truth, 'overlap': n.overlap}) END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT doc_id, o.tab AS tab, o.truth AS truth, o.overlap AS overlap FROM (SELECT doc_id, unnest(out) AS o FROM (SELECT doc_id, arg_max(out, i) AS out FROM f GROUP BY 1))""")
def d20_greedy_table_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.operators.evaluate import match_tables

    names = cells(spark, sf_dir).select("doc_id", (F.col("supp") % 3).alias("tab"), (F.col("part") % 23).cast("string").alias("name"))
    truth = cells(spark, sf_dir).where("part % 4 <> 0").select("doc_id", (F.col("supp") % 3 + 10).alias("tab"), (F.col("part") % 23).cast("string").alias("name"))
    return match_tables(names, truth)


@query()
def j12_j13_sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.operators.evaluate import grid_similarity
    from loomgrid.plans.views import pass_of

    all_cells = cells(spark, sf_dir)
    return grid_similarity(pass_of(all_cells, 1), pass_of(all_cells, 2))


@query()
def i5_sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.operators.evaluate import sequence_ratio

    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", sequence_ratio(F.col("p_name"), F.concat("p_type", F.lit(" "), F.col("p_name"))).alias("ratio"))


@query()
def i14_i16_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula spans with offsets in document lines, every document with one formula more."""
    from loomgrid.operators.formulas import detect

    extra = F.array(*[F.lit(x) for x in ("AUC0-inf = 12", "n! / (k!)", "sum(i=1..n) x_i", "dC/dt = -k C", "p < 0.05", "x^2 + 1", "lim x->0 f(x)", "C(5, 2) = 10")])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" "), F.element_at(extra, (F.col("doc_id") % 8 + 1).cast("int"))).alias("text"))
    return detect(rows, "text").select("doc_id", F.explode("formulas").alias("f")).select("doc_id", "f.*")


@query("""WITH e AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS w, value FROM events) SELECT event_type, w::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY 1, 2""")
def k2_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.streaming.logs import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "1 day").select("event_type", "window_start", "n", F.round("total", 2).alias("total"))
