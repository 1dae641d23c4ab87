"""The registered queries of this subpackage, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm._shared import fold_of, table
from loomgrid.llm.decontam import contamination
from loomgrid.llm.langid import identify, prototypes
from loomgrid.llm.licenses import scan_licenses
from loomgrid.llm.linededup import dedup_lines
from loomgrid.llm.neardup import near_duplicate_classes
from loomgrid.llm.packing import pack
from loomgrid.llm.pii import PATTERNS, joined, with_spans
from loomgrid.llm.quality import judge
from loomgrid.llm.topk import top_k
from loomgrid.llm.toxicity import fit as fit_toxicity
from loomgrid.llm.toxicity import score as score_toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"].isin(*PATTERNS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = (*PATTERNS, "secret", "term")
    private = F.exists("spans", lambda s: s["kind"] != "term").alias("private")
    return with_spans(docs).select("doc_id", *map(count, kinds), private, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    best = F.array_max(F.transform("licenses", lambda x: x["reduction"]))
    return found.select("doc_id", "n_candidates", F.size("licenses").cast("long").alias("n_found"), F.array_join(names, ",").alias("licenses"), best.alias("best_reduction"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "perplexity", "threshold", "keep")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    n, sha = (lambda c, name: F.size(c).cast("long").alias(name)), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", n("items", "n_items"), sha, "contaminated", n("near_items", "n_near_items"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (fold_of(F.col("doc_id")) == 0).alias("held_out")
    return identify(docs.select("doc_id", "text"), prototypes(docs)).select("doc_id", held, "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_pii, op3_license_scan, op4_line_dedup, op5_minhash_near_dedup, op6_quality, op7_toxicity, op8_decontamination, op9_best_fit_packing, op10_language_id)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""",
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT doc_id, i, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines),
owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN owners USING (key) GROUP BY doc_id""",
    "op8_decontamination": f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len, array_to_string(w[s + 1 : s + len], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 10) AS len, unnest(range(greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT len FROM windows),
grams AS (
  SELECT doc_id, len, s, array_to_string(w[s + 1 : s + len], ' ') AS phrase
  FROM (SELECT doc_id, w, len, unnest(range(len(w) - len + 1)) AS s FROM docs, sizes WHERE len(w) >= len)),
matches AS (SELECT doc_id, item_id, s, len FROM grams JOIN windows USING (len, phrase)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + len)) AS pos FROM matches) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM matches) GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM docs),
apart AS (
  SELECT DISTINCT item_id, s AS win, unnest(w[s + 1 : s + 10]) AS term
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0) WHERE s % 10 = 0 OR s = greatest(len(w) - 10, 0)),
ranked AS (
  SELECT item_id, win, term, row_number() OVER (PARTITION BY item_id, win ORDER BY coalesce(n, 0), term) AS k, least(3, count(*) OVER (PARTITION BY item_id, win)) AS n
  FROM apart LEFT JOIN (SELECT term, count(*) AS n FROM tokens GROUP BY 1) USING (term)),
rare AS (SELECT * FROM ranked WHERE k <= 3 AND n > 1),
placed AS (SELECT t.doc_id, t.pos, r.item_id, r.win, r.k, r.n FROM tokens t JOIN rare r USING (term)),
near AS (
  SELECT DISTINCT doc_id, item_id FROM (
    SELECT a.doc_id, a.item_id, a.win, a.pos FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.win = b.win AND b.pos BETWEEN a.pos AND a.pos + 14
    GROUP BY a.doc_id, a.item_id, a.win, a.pos, a.n HAVING count(DISTINCT b.k) = a.n)),
near_items AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_near_items FROM near GROUP BY 1)
SELECT doc_id, coalesce(n_near_items, 0)::BIGINT AS n_near_items, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near_items USING (doc_id)""",
}
