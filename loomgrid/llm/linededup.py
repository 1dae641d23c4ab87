"""Exact deduplication of lines across documents.

Every line has a key (stripped, A-Z lowered). The distinct keys of all documents are indexed by a sharded minimal perfect
hash over their 128-bit hashes; the arrays beside it hold, by index, a 32-bit fingerprint, the number of documents (255
at most) and the smallest doc_id. Documents send the hashes of their lines to the shards, probe the arrays there, and
lose the lines whose count is beyond one and whose first document is another. A line text never moves, and no two lines
are joined.

Skew. A shard is chosen by the key's hash, so a frequent key makes a large shard. Shards that more lines probe than
LINES_A_SHARD, or than an even share, are repeated: their lines are dealt by doc_id to as many copies of the shard's one
row as it takes. A shard has about KEYS_A_SHARD keys.

Defined results. Null and empty texts are one empty line. Keys shorter than `least` code points are never dropped.
Rows that share a doc_id are one document, so they do not make each other's lines repeated. Rows without a doc_id
hold nothing back from others and stay as they are. Ties go to the smallest doc_id. Columns other than text,
n_chars and the two counts pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm._shared import ascii_lower, small, staged
from loomgrid.llm.mphf import PerfectHash

#: What counts as white space at a line's ends (fixed values: space, and U+0009 to U+000D).
BLANKS = " \t\n\x0b\x0c\r"
#: Counts of documents are kept up to this.
MOST = 255
KEYS_A_SHARD = 1 << 17
LINES_A_SHARD = 1 << 19
LEAST_SHARDS = 64
SMALL_SHARDS = 1_000_000

_INDEX = "shard int, hash binary, fingerprints binary, counts binary, owners binary"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, h, f: two independent hashes of each line key that is long enough, once a row."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= least)
    hashes = F.array_distinct(F.transform(keys, lambda k: F.struct(_hash(k).alias("h"), F.xxhash64(F.lit("line"), k).alias("f"))))
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(hashes).alias("x")).select("doc_id", "x.h", "x.f")


def distinct_keys(lines: DataFrame) -> DataFrame:
    """h, f, owner (the smallest doc_id) and n (documents) of every key."""
    return lines.groupBy("h", "f").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    h, f = rows["h"].to_numpy(np.int64).view(np.uint64), rows["f"].to_numpy(np.int64).view(np.uint64)
    perfect = PerfectHash.build(h, f)
    at = perfect.index(h, f)
    prints, counts, owners = np.empty(len(rows), np.uint32), np.empty(len(rows), np.uint8), np.empty(len(rows), np.int64)
    prints[at], counts[at], owners[at] = _fingerprint(f), np.minimum(rows["n"].to_numpy(np.int64), MOST), rows["owner"].to_numpy(np.int64)
    return pd.DataFrame([[key[0], perfect.to_bytes(), prints.tobytes(), counts.tobytes(), owners.tobytes()]], columns=["shard", "hash", "fingerprints", "counts", "owners"])


def _fingerprint(f: np.ndarray) -> np.ndarray:
    return (f >> np.uint64(32)).astype(np.uint32)


def _shard(h: Column, shards: int) -> Column:
    return F.pmod(h, F.lit(shards)).cast("int").alias("shard")


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the perfect hash and its arrays of fingerprints, counts and owners."""
    return keys.withColumn("shard", _shard(F.col("h"), shards)).groupBy("shard").applyInPandas(_build_shard, _INDEX)


_DROPPED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64())])


def _probe(lines: pa.Table, index: pa.Table) -> pa.Table:
    """The lines of one shard that their documents lose."""
    doc, h, f = (lines.column(c).to_numpy() for c in ("doc_id", "h", "f"))
    drop = np.zeros(len(doc), bool)
    if index.num_rows and len(doc):
        row = index.slice(0, 1).to_pylist()[0]
        prints, counts, owners = np.frombuffer(row["fingerprints"], np.uint32), np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["owners"], np.int64)
        at = PerfectHash.from_bytes(row["hash"]).index(h.view(np.uint64), f.view(np.uint64))
        drop = (at >= 0) & (prints[at] == _fingerprint(f.view(np.uint64))) & (counts[at] > 1) & (owners[at] != doc)
    return pa.Table.from_arrays([pa.array(doc[drop]), pa.array(h[drop])], schema=_DROPPED)


def dropped_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id and drop, the hashes of the line keys that the document loses; documents that lose none are absent."""
    lines = staged(line_hashes(docs, least), "line-hashes")
    keys = staged(distinct_keys(lines), "line-keys")
    n_lines, n_keys = lines.count(), keys.count()
    shards = max(LEAST_SHARDS, math.ceil(n_keys / KEYS_A_SHARD), math.ceil(n_lines / LINES_A_SHARD))
    index = staged(build_index(keys, shards), "line-index")
    even = math.ceil(n_lines / shards) + 1
    probes = keys.groupBy(_shard(F.col("h"), shards)).agg(F.sum("n").alias("lines"))
    copies = staged(probes.select("shard", F.ceil(F.col("lines") / min(LINES_A_SHARD, even)).cast("int").alias("copies")), "line-shards")
    copies = small(copies, shards, SMALL_SHARDS)
    dealt = lines.withColumn("shard", _shard(F.col("h"), shards)).join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
    repeated = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    drops = dealt.select("doc_id", "h", "f", "shard", "copy").groupBy("shard", "copy").cogroup(repeated.groupBy("shard", "copy")).applyInArrow(_probe, "doc_id long, h long")
    return drops.groupBy("doc_id").agg(F.collect_set("h").alias("drop"))


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """docs with repeated lines dropped from text, and n_lines (before) and n_dropped; n_chars follows the new text."""
    drops = dropped_lines(docs, least).withColumnRenamed("drop", "__drop")
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda x: ~((F.length(line_key(x)) >= least) & F.array_contains(F.col("__drop"), _hash(line_key(x)))))
    out = (
        docs.join(drops.hint("shuffle_hash"), "doc_id", "left")
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept))
        .withColumn("n_dropped", F.coalesce(F.col("n_lines") - F.size("__kept"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("__drop").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text")))
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("__drop", "__kept")
