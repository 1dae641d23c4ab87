"""Queries on visit headers, footnotes, the graph and its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import temporal
from loomgrid.operators import graph, validate
from loomgrid.plans.registry import registry
from loomgrid.plans.views import table

QUERIES, SQL, query = registry()


#: Headers that the part keys number: a pattern is formatted with the key's remainder.
HEADERS = [
    "Screening (-28 to -1 days)", "Day {n}", "Week {n}", "Month {n}", "Day {n} ±3 days", "Week {n} (-2/+5 days)", "C{n}D15", "Cycle {n} Day 8", "Follow-up (30 days post-dose)", "ET",
    "Early Termination Visit", "Visit {n}", "Screen", "Baseline", "Safety Follow-up {n} weeks", "End of Study", "Month {n} +/- 2 weeks", "Planet tour",
]

_H = f"CASE l_partkey % {len(HEADERS)} " + " ".join(f"WHEN {i} THEN replace('{h}', '{{n}}', l_linenumber::VARCHAR)" for i, h in enumerate(HEADERS)) + " END"
_UNITS = "CASE WHEN lower({u}) LIKE 'week%' THEN 'WEEKS' WHEN lower({u}) LIKE 'month%' THEN 'MONTHS' ELSE 'DAYS' END"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """header: every lineitem has a visit header by its part and line number."""
    k = F.col("l_partkey") % len(HEADERS)
    text = F.when(F.lit(False), "")
    for i, h in enumerate(HEADERS):
        text = text.when(k == i, F.replace(F.lit(h), F.lit("{n}"), F.col("l_linenumber").cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", text.alias("header"))


_VISITS = f"""h AS (SELECT l_orderkey, {_H} AS header FROM lineitem),
x AS (SELECT *, regexp_extract(header, '(?i)\\bC([0-9]+)\\s*D([0-9]+)\\b', 1) AS c1, regexp_extract(header, '(?i)\\bC([0-9]+)\\s*D([0-9]+)\\b', 2) AS c2, regexp_extract(header, '(?i)\\bcycle\\s+([0-9]+)\\s+day\\s+([0-9]+)\\b', 1) AS l1,
  regexp_extract(header, '(?i)\\bcycle\\s+([0-9]+)\\s+day\\s+([0-9]+)\\b', 2) AS l2, regexp_extract(header, '(?i)follow[-\\s]?up.*?([0-9]+)\\s*(days?|weeks?|months?)', 1) AS f1, regexp_extract(header, '(?i)follow[-\\s]?up.*?([0-9]+)\\s*(days?|weeks?|months?)', 2) AS f2,
  regexp_extract(header, '(?i)\\bday\\s+([0-9]+)\\b', 1) AS d, regexp_extract(header, '(?i)\\bweek\\s+([0-9]+)\\b', 1) AS w, regexp_extract(header, '(?i)\\bmonth\\s+([0-9]+)\\b', 1) AS m,
  regexp_extract(header, '(?i)\\(-?\\s*([0-9]+)\\s+to\\s+-?\\s*([0-9]+)', 1) AS s1, regexp_extract(header, '(?i)\\(-?\\s*([0-9]+)\\s*/\\s*\\+?\\s*([0-9]+)', 1) AS a1, regexp_extract(header, '(?i)\\(-?\\s*([0-9]+)\\s*/\\s*\\+?\\s*([0-9]+)', 2) AS a2,
  regexp_extract(header, '(?i)[±+/-]\\s*([0-9]+)\\s*(days?|weeks?|months?)', 1) AS y1, regexp_extract(header, '(?i)[±+/-]\\s*([0-9]+)\\s*(days?|weeks?|months?)', 2) AS y2,
  lower(header) IN ('et', 'end of study') AS exact, regexp_matches(lower(header), '\\b(early termination|et|end of study|eos|end of treatment|eot|unscheduled|discontinuation|withdrawal)\\b') AS within_ FROM h),
v AS (SELECT *, NOT exact AND (c1 <> '' OR l1 <> '') AS cycled FROM x),
u AS (SELECT *, NOT exact AND NOT cycled AND f1 <> '' AS followed, d <> '' OR w <> '' OR m <> '' AS timed FROM v),
visits AS (SELECT l_orderkey, header,
  CASE WHEN exact THEN NULL WHEN c2 <> '' THEN c2::INT WHEN l2 <> '' THEN l2::INT WHEN f1 <> '' THEN f1::INT * CASE WHEN f2 LIKE 'week%' THEN 7 WHEN f2 LIKE 'month%' THEN 30 ELSE 1 END WHEN d <> '' THEN d::INT WHEN w <> '' THEN w::INT * 7 WHEN m <> '' THEN m::INT * 30 END AS target_day,
  CASE WHEN exact OR cycled OR followed OR NOT (timed OR (NOT within_ AND lower(header) LIKE '%screen%')) THEN 0 WHEN a1 <> '' THEN a1::INT WHEN s1 <> '' THEN s1::INT WHEN y1 <> '' THEN y1::INT ELSE 0 END AS window_minus,
  CASE WHEN exact OR cycled OR followed OR NOT (timed OR (NOT within_ AND lower(header) LIKE '%screen%')) THEN 0 WHEN a1 <> '' THEN a2::INT WHEN s1 <> '' THEN 0 WHEN y1 <> '' THEN y1::INT ELSE 0 END AS window_plus,
  CASE WHEN followed THEN {_UNITS.format(u='f2')} WHEN exact OR cycled THEN 'DAYS' WHEN d = '' AND w = '' AND m <> '' THEN 'MONTHS' WHEN timed AND a1 = '' AND s1 = '' THEN {_UNITS.format(u='y2')} ELSE 'DAYS' END AS window_unit,
  exact OR (NOT cycled AND NOT followed AND NOT timed AND within_) AS is_unscheduled, CASE WHEN exact THEN NULL WHEN c1 <> '' THEN c1::INT WHEN l1 <> '' THEN l1::INT END AS cycle FROM u)"""


@query(f"WITH {_VISITS} SELECT header, target_day::DOUBLE AS target_day, window_minus, window_plus, window_unit, is_unscheduled, cycle::DOUBLE AS cycle, count(*) AS n FROM visits GROUP BY ALL")
def j1_j2_visit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headers(spark, sf_dir).groupBy("header").agg(F.count("*").alias("n")).withColumn("v", temporal.visit(F.col("header")))
    whole = rows.select("header", "v.*", "n")
    return whole.withColumns({c: F.col(c).cast("double") for c in ("target_day", "cycle")})


@query(f"WITH {_VISITS}, c AS (SELECT l_orderkey, count(DISTINCT cycle) AS k FROM visits GROUP BY 1) SELECT l_orderkey, k AS n_cycles, CASE WHEN k <= 1 THEN 1.0 WHEN k >= 12 THEN 1.0 ELSE 12.0 / k END::DOUBLE AS multiplier FROM c")
def j4_cycle_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headers(spark, sf_dir).withColumn("cycle", temporal.visit(F.col("header"))["cycle"])
    n = rows.groupBy("l_orderkey").agg(F.countDistinct("cycle").alias("n_cycles"))
    total = int(9 * 30 / 21)
    return n.withColumn("multiplier", F.when((F.col("n_cycles") <= 1) | (F.col("n_cycles") >= total), 1.0).otherwise(total / F.col("n_cycles")))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, ['Period ' || (l_suppkey % 3)::VARCHAR, 'Day ' || l_linenumber::VARCHAR] AS path FROM lineitem) SELECT l_orderkey, path[-1] AS leaf, array_to_string(path, ' > ') AS display, l_linenumber::INT AS target_day FROM p")
def j3_header_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array(F.concat(F.lit("Period "), (F.col("l_suppkey") % 3).cast("string")), F.concat(F.lit("Day "), F.col("l_linenumber").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", path.alias("path"))
    leaf = F.element_at("path", -1)
    return rows.select("l_orderkey", leaf.alias("leaf"), F.array_join("path", " > ").alias("display"), temporal.visit(leaf)["target_day"].alias("target_day"))


#: Footnote definitions: marker and text.
NOTES = {
    "a": "Only if QTc is prolonged", "b": "Every 2 weeks during treatment", "c": "See Section 8.1", "d": "Site staff will call participants at home", "e": "Except at Visit 3", "f": "30% of patients in the substudy",
    "g": "Cycles 1-2 only, then Day 1", "h": "Collected before dosing", "k": "3 times per cycle, every other visit", "m": "Half of the subjects", "n": "Twice weekly until Day 28",
}
_KINDS = {"f": "SUBSET", "m": "SUBSET", "b": "FREQUENCY_MODIFIER", "n": "FREQUENCY_MODIFIER"}
_NOTE_ROWS = ", ".join(f"('{m}', '{t}', '{_KINDS.get(m, '')}')" for m, t in NOTES.items())
NOTES_SQL = f"notes(marker, text, kind) AS (VALUES {_NOTE_ROWS})"
_MARKERS = list(NOTES) + ["z"]
_M1 = f"CASE l_partkey % {len(_MARKERS)} " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MARKERS)) + " END"
_M2 = _M1.replace("l_partkey", "l_suppkey")


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, t, _KINDS.get(m, "")) for m, t in NOTES.items()], "marker string, text string, kind string")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id (a number for each order, part and supplier), the greatest line number with its flag, and two footnote markers."""
    names = F.array(*[F.lit(m) for m in _MARKERS])

    def pick(column: str):
        return F.element_at(names, (F.col(column) % len(_MARKERS) + 1).cast("int"))

    key = F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    one = table(spark, sf_dir, "lineitem").groupBy(key.alias("entry_id"), "l_partkey", "l_suppkey").agg(F.max(F.struct("l_linenumber", "l_returnflag")).alias("m"))
    return one.select("entry_id", "m.*", F.array(pick("l_partkey"), pick("l_suppkey")).alias("markers"))


_MARKED = f"""marked AS (
  SELECT entry_id, m.l_linenumber AS l_linenumber, m.l_returnflag AS l_returnflag, [{_M1}, {_M2}] AS markers
  FROM (SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey AS entry_id, l_partkey, l_suppkey, max({{'l_linenumber': l_linenumber, 'l_returnflag': l_returnflag}}) AS m
        FROM lineitem GROUP BY 1, 2, 3))"""


@query(f"""WITH {NOTES_SQL}, {_MARKED}, x AS (SELECT entry_id, unnest(markers) AS marker, unnest([1, 2]) AS pos FROM marked)
SELECT entry_id, array_to_string(list(text ORDER BY pos), '; ') AS resolved, count(*) AS n FROM x JOIN notes USING (marker) GROUP BY 1""")
def d6_footnote_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = marked(spark, sf_dir).select("entry_id", F.posexplode("markers").alias("pos", "marker")).join(F.broadcast(notes(spark)), "marker")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    return hits.groupBy("entry_id").agg(F.array_join(texts, "; ").alias("resolved"), F.count("*").alias("n"))


@query(f"WITH {NOTES_SQL}, {_MARKED}, x AS (SELECT entry_id, unnest(markers) AS marker FROM marked) SELECT marker, count(*) AS n FROM x WHERE marker NOT IN (SELECT marker FROM notes) GROUP BY 1")
def d22_orphan_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = marked(spark, sf_dir).select("entry_id", F.explode("markers").alias("marker"))
    return validate.orphans(uses, notes(spark), ["marker"]).groupBy("marker").agg(F.count("*").alias("n"))


@query(f"""WITH {NOTES_SQL} SELECT marker, CASE WHEN regexp_matches(text, '(?i)\\bexcept\\b|\\bunless\\b') THEN 'EXCEPTION' WHEN regexp_matches(text, '(?i)\\bcycles?\\s+[0-9]+\\s*-\\s*[0-9]+\\s+only\\b|\\bevery\\s+other\\s+(visit|cycle)\\b') THEN 'FREQUENCY_MODIFIER'
  WHEN regexp_matches(text, '(?i)\\bonly\\s+if\\b|\\bif\\s+[a-z]+|\\bwhen\\b') THEN 'CONDITIONAL' WHEN regexp_matches(text, '(?i)\\bsee\\s+section\\b') THEN 'REFERENCE' ELSE 'CLARIFICATION' END AS footnote_type,
  CASE WHEN regexp_matches(text, '(?i)every\\s+[0-9]+\\s+week') THEN 0.5 WHEN regexp_matches(text, '(?i)3 times per') THEN 3 WHEN regexp_matches(text, '(?i)twice weekly') THEN 2 END::DOUBLE AS multiplier,
  CASE WHEN text LIKE '30%%%' ESCAPE '!' AND text LIKE '%patients%' THEN 0.3 WHEN lower(text) LIKE '%half%' THEN 0.5 END::DOUBLE AS fraction, regexp_matches(lower(text), 'call') AND regexp_matches(lower(text), '\\bwill\\s+call\\b') AS is_phone_call FROM notes""")
def i6_i9_i10_i11_footnote_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return notes(spark).select(
        "marker", temporal.footnote_type(text).alias("footnote_type"), temporal.frequency_multiplier(text).alias("multiplier"), temporal.fraction(text).alias("fraction"), temporal.is_phone_call(text).alias("is_phone_call")
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    span = F.concat(F.lit("--Weekly Day 1 through Day "), (F.col("l_linenumber") * 10).cast("string"), F.lit("--"))
    return marked(spark, sf_dir).select(
        "entry_id", F.when(flag == "R", "firm").when(flag == "A", "conditional").otherwise("span").alias("mark_type"), F.when(flag == "N", span).otherwise("X").alias("raw_mark"),
        (flag == "N").alias("is_span"), F.lit(2).alias("occurrences"), F.lit(2).alias("total"), "markers",
    )


@query(f"""WITH {NOTES_SQL}, {_MARKED},
e1 AS (SELECT entry_id, markers, l_returnflag, CASE l_returnflag WHEN 'N' THEN greatest(1, (l_linenumber * 10) // 7) ELSE 2 END AS occ, CASE l_returnflag WHEN 'N' THEN greatest(1, (l_linenumber * 10) // 7) ELSE trunc(2 * 12 / 3.0)::INT END AS total FROM marked),
e2 AS (SELECT *, CASE markers[1] WHEN 'b' THEN greatest(1, trunc(occ * 0.5)::INT) WHEN 'n' THEN occ * 2 ELSE occ END AS o1 FROM e1),
e3 AS (SELECT *, CASE markers[2] WHEN 'b' THEN greatest(1, trunc(o1 * 0.5)::INT) WHEN 'n' THEN o1 * 2 ELSE o1 END AS o2, markers[1] IN ('b', 'n') OR markers[2] IN ('b', 'n') AS hit FROM e2)
SELECT entry_id, o2::INT AS occurrences, CASE WHEN hit THEN o2 ELSE total END::INT AS total, CASE WHEN l_returnflag = 'A' THEN 0.6 END::DOUBLE AS probability,
  CASE WHEN markers[2] = 'f' THEN 0.3 WHEN markers[2] = 'm' THEN 0.5 WHEN markers[1] = 'f' THEN 0.3 WHEN markers[1] = 'm' THEN 0.5 END::DOUBLE AS subset_fraction, list_contains(markers, 'd') AS is_phone_call FROM e3""")
def n0_n7_inference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = notes(spark)
    rules = [graph.phone_rule(texts), graph.subset_rule(texts), graph.conditional_rule(), graph.frequency_rule(texts), graph.span_rule(), graph.cycle_rule(3, True)]
    found = graph.infer(entries(spark, sf_dir), rules)
    return found.select("entry_id", "occurrences", "total", "probability", "subset_fraction", "is_phone_call")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order, and nation to supplier, as one edge list."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    parts = [("nation", "region", "r", "n_regionkey", "nation", "n_nationkey"), ("customer", "nation", "c", "c_nationkey", "customer", "c_custkey"), ("supplier", "nation", "s", "s_nationkey", "supplier", "s_suppkey"), ("orders", "customer", "o", "o_custkey", "order", "o_orderkey")]
    out = None
    for source, a, kind, ka, b, kb in parts:
        one = table(spark, sf_dir, source).select(name(a, ka).alias("src"), name(b, kb).alias("dst"), F.lit(kind).alias("kind"))
        out = one if out is None else out.union(one)
    return out


EDGES = """edges AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'r' AS kind FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'c' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 's' FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'o' FROM orders)"""


@query(f"WITH {EDGES} SELECT a.src AS start, count(*) AS n_paths, count(DISTINCT c.dst) AS n_ends FROM edges a JOIN edges b ON a.dst = b.src AND b.kind = 'c' JOIN edges c ON b.dst = c.src AND c.kind = 'o' WHERE a.kind = 'r' GROUP BY 1")
def d14_graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hops(edges(spark, sf_dir), ["r", "c", "o"]).groupBy("start").agg(F.count("*").alias("n_paths"), F.countDistinct("end").alias("n_ends"))


@query(f"WITH {EDGES} SELECT kind, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM edges GROUP BY kind")
def n8_e24_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@query("SELECT c_custkey, left(sha256(c_nationkey || '|Customer|' || c_name), 16) AS entity_id FROM customer")
def m17_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", graph.entity_id(F.col("c_nationkey").cast("string"), F.lit("Customer"), F.col("c_name")).alias("entity_id"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def d23_n9_visits_without_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""WITH RECURSIVE tree AS (SELECT r_regionkey::VARCHAR AS path, 'region:' || r_regionkey AS node, 1 AS level FROM region
UNION ALL SELECT tree.path || '/' || c.child, c.child, tree.level + 1 FROM tree JOIN (SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier) c ON c.parent = tree.node)
SELECT path, node, level FROM tree""")
def j8_n10_header_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from the roots, one join a level; a header tree has a fixed number of levels."""
    e = edges(spark, sf_dir).where("kind IN ('r', 's')").select(F.col("src").alias("node"), F.col("dst").alias("child"))
    level = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("path"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(1).alias("level"))
    out = level
    for depth in (2, 3):
        level = level.join(e, "node").select(F.concat_ws("/", "path", "child").alias("path"), F.col("child").alias("node"), F.lit(depth).alias("level"))
        out = out.unionByName(level)
    return out


@query("""SELECT s.s_suppkey, n.n_nationkey, CASE WHEN (s.s_suppkey + n.n_nationkey) % 7 = 0 THEN 'X' ELSE '' END AS mark FROM supplier s JOIN nation n ON s.s_nationkey % 5 = n.n_regionkey""")
def d12_schedule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities by the encounters of their arm, with X where the activity takes place: an equi join by arm, then a left join of the instances."""
    activities = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("arm"))
    encounters = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("arm"))
    matrix = activities.join(encounters, "arm")
    instances = matrix.where((F.col("s_suppkey") + F.col("n_nationkey")) % 7 == 0).select("s_suppkey", "n_nationkey", F.lit("X").alias("x"))
    return matrix.join(instances, ["s_suppkey", "n_nationkey"], "left").select("s_suppkey", "n_nationkey", F.coalesce("x", F.lit("")).alias("mark"))
