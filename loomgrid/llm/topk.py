"""Exact top-k search by inner product, over norm buckets.

1. Vectors are bucketed by length: quantiles of the norm make at most MOST_BINS bins, and a bin of more than BUCKET
   vectors (many of one length) is dealt by a hash of vec_id, so a bucket has about BUCKET vectors at most.
2. Each query gets a first threshold, its k-th best product among the SEEDS longest vectors (a broadcast of fixed size).
3. A query goes to the buckets that can still reach its threshold: |q| * longest >= threshold.
4. In a bucket, threshold / (|q| * longest) is the least cosine that a vector needs. Where the queries of a block need
   a high one, coordinates prune: a vector's largest query coordinates must lie in the band that this cosine allows.
   Where they need a low one, lengths prune. The vectors that are left are verified by exact products.
5. The best k of each bucket meet, and the best k of them stay.

Queries come in blocks of about BLOCK that need vectors of about the same length, so a task holds one bucket and one
block, and a bucket's vectors go only to the blocks that have a query for it. All bounds have slack for rounding, and
ties at the threshold are kept, so the result is exact.

Defined results. Vectors that are null or hold null or non-finite components take no part. Of rows that share a vec_id
the smallest vector counts; rows without one take no part. Shorter vectors count as padded with zeros. A zero vector has
the product 0 with all. Equal scores go by smaller vec_id. Other columns do not matter. Components so large that a product
could leave 64 bits raise a ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm._shared import small, staged

BUCKET = 8192
MOST_BINS = 4096
BLOCK = 1024
SEEDS = 2048
#: Queries that need at least this cosine prune by coordinates, others by lengths.
HIGH_COSINE = 0.5
COORDINATES = 4
BROADCAST_PAIRS = 1_000_000
_SLACK = 1e-9


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v (components floor(scale * x)) and norm, one row for each vec_id."""
    kept = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    whole = kept.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    one = whole.groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; shorter rows are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()] if len(column) else np.zeros(0, np.int64)
    width = max([int(sizes.max(initial=0)), width or 0])
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of a with rows of b: in floating point while that is exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if most < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2**62:
        raise ValueError("components are too large for products of 64 bits")
    return a @ b.T


@dataclass
class Layout:
    """Bins by norm, longest first. lows: the least norm of each bin but the last; longest and parts by bin."""

    lows: np.ndarray
    longest: np.ndarray
    parts: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, lows: np.ndarray, bins: dict[int, tuple[int, float]], size: int) -> Layout:
        n = len(lows) + 1
        parts = np.array([max(1, math.ceil(bins.get(b, (0, 0))[0] / size)) for b in range(n)])
        return cls(lows, np.array([bins.get(b, (0, -1.0))[1] for b in range(n)]), parts, np.concatenate([[0], np.cumsum(parts)[:-1]]))

    def bin_of(self, norm: np.ndarray) -> np.ndarray:
        return len(self.lows) - np.searchsorted(self.lows[::-1], norm, side="right")


def _bin_rows(shared, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout: Layout = shared.value
        for batch in batches:
            norm = batch.column(2).to_numpy()
            bins = layout.bin_of(norm)
            if not keep:
                found, at = np.unique(bins, return_inverse=True)
                most = np.zeros(len(found))
                np.maximum.at(most, at, norm)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.bincount(at, minlength=len(found)).astype(np.int64)), pa.array(most)], names=["bin", "n", "longest"])
            else:
                spread = (batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                bucket = layout.firsts[bins] + spread.astype(np.int64) % layout.parts[bins]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bucket)], names=["vec_id", "v", "norm", "bucket"])

    return run


def bucketed(vectors: DataFrame, n: int, size: int) -> tuple[DataFrame, Layout]:
    """vectors with their bucket of about size rows of like norm, and the layout of the bins."""
    sc = vectors.sparkSession.sparkContext
    bins = min(MOST_BINS, max(1, math.ceil(n / size)))
    probs = [i / bins for i in range(1, bins)]
    lows = np.array(sorted(set(vectors.approxQuantile("norm", probs, 0.1 / bins)), reverse=True)) if probs else np.zeros(0)
    layout = Layout.of(lows, {}, size)
    counted = vectors.mapInArrow(_bin_rows(sc.broadcast(layout), False), "bin long, n long, longest double").groupBy("bin").agg(F.sum("n"), F.max("longest"))
    layout = Layout.of(lows, {int(b): (int(c), float(m)) for b, c, m in counted.collect()}, size)
    return vectors.mapInArrow(_bin_rows(sc.broadcast(layout), True), "vec_id long, v array<long>, norm double, bucket long"), layout


def _floors(ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best product among the seeds."""
    if len(seed_ids) <= k:
        return np.full(len(ids), -np.inf)
    score = _products(q, seeds).astype(np.float64)
    score[ids[:, None] == seed_ids[None, :]] = -np.inf
    return np.partition(score, len(seed_ids) - k, axis=1)[:, len(seed_ids) - k]


def _needs(shared, k: int):
    """vec_id, v, and as norm the least length of a vector that can reach the query's first threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, seed_ids, seeds = shared.value
        for batch in batches:
            norm = batch.column(2).to_numpy()
            floor = _floors(batch.column(0).to_numpy(), _matrix(batch.column(1)), seed_ids, seeds, k)
            need = np.where(floor > 0, floor, 0) / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(need)], names=["vec_id", "v", "norm"])

    return run


def _route(shared, k: int):
    """A row for each query and each bucket that it has to see, with its first threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, seed_ids, seeds = shared.value
        buckets = np.concatenate([np.arange(f, f + p) for f, p in zip(layout.firsts, layout.parts, strict=True)])
        longest = np.repeat(layout.longest, layout.parts)
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1))
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
            floor = _floors(ids, q, seed_ids, seeds, k)
            reach = norm[:, None] * longest[None, :]
            row, col = np.nonzero((reach * (1 + _SLACK) + _SLACK >= floor[:, None]) & (longest >= 0)[None, :])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(norm[row]), pa.array(floor[row]), pa.array(buckets[col]), batch.column(3).take(pa.array(row))],
                names=["query_id", "q", "qnorm", "floor", "bucket", "block"],
            )

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


def search_bucket(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and score of each query's k best in one bucket that reach its floor."""
    norms, q_norms = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (vectors, queries))
    order = np.lexsort((ids, -norms))
    vectors, ids, norms = vectors[order], ids[order], norms[order]
    width = max(vectors.shape[1], queries.shape[1])
    vectors, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, queries))
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(floors > 0, floors / (q_norms * norms[0]), -1.0)
    by_coordinate = np.median(need) >= HIGH_COSINE
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(queries)):
        if need[i] > 1 + _SLACK:
            continue
        n = len(ids)
        if floors[i] > 0:  # shorter vectors cannot reach the floor
            n = int(np.searchsorted(-norms, -(floors[i] / q_norms[i]) * (1 - _SLACK), side="right"))
        left = np.arange(n)
        if by_coordinate and need[i] > 0:
            t = min(need[i], 1.0)
            q = queries[i] / q_norms[i]
            for f in np.argsort(-np.abs(q))[: min(COORDINATES, width)]:
                reach = math.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f])))
                # of unit vectors with a cosine of t or more, the f-th coordinate is at least q_f t - reach, or beyond q_f's own side
                low = q[f] * t - reach if q[f] > -t else -1.0
                high = q[f] * t + reach if q[f] < t else 1.0
                x = unit[left, f]
                left = left[(x >= low - 1e-7) & (x <= high + 1e-7)]
        left = left[ids[left] != query_ids[i]]
        if not len(left):
            continue
        score = _products(vectors[left], queries[i : i + 1])[:, 0]
        best = _best(score, ids[left], k)
        best = best[score[best] >= floors[i]]
        out.append((np.full(len(best), query_ids[i]), ids[left][best], score[best]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _cell(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if queries.num_rows and vectors.num_rows:
            q, v = _matrix(queries.column("q")), _matrix(vectors.column("v"))
            found = search_bucket(q, queries.column("query_id").to_numpy(), queries.column("floor").to_numpy(), v, vectors.column("vec_id").to_numpy(), k)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best among all other vectors."""
    spark = vectors.sparkSession
    whole = staged(scaled_vectors(vectors, scale), "vectors")
    n = whole.count()
    rows, layout = bucketed(whole, n, BUCKET)
    queries = whole.where(is_query)
    seeds = whole.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    shared = spark.sparkContext.broadcast((layout, seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v"))))
    needs = staged(queries.mapInArrow(_needs(shared, k), "vec_id long, v array<long>, norm double"), "query-needs")
    blocked, _ = bucketed(needs, needs.count(), BLOCK)
    routed = staged(blocked.mapInArrow(_route(shared, k), "query_id long, q array<long>, qnorm double, floor double, bucket long, block long"), "routed")
    pairs = staged(routed.select("bucket", "block").distinct(), "bucket-blocks")
    spread = rows.join(small(pairs, pairs.count(), BROADCAST_PAIRS), "bucket")
    found = routed.groupBy("bucket", "block").cogroup(spread.groupBy("bucket", "block")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
