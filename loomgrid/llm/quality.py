"""Document quality by an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

1. The trusted documents' ORDER-grams of UTF-8 bytes (digits as one) are counted in every task and summed by n-gram.
   Lower orders are continuation counts: how many different bytes stand before an n-gram.
2. Discounts come from the counts of counts of each order. Probabilities are built from the lowest order up by joins of
   the sharded count tables: p(w | h) = (c - D) / total + gamma(h) p(w | h'), with gamma(h) for what h was not seen with.
3. The model is dealt into shards by the two bytes before the last, which an n-gram has in common with its context and
   all its shorter forms; the orders below three go with every shard. A shard has about SHARD_ROWS rows, so what a
   scoring task gets at once is bounded however large the model is, and the number of shards grows with it.
4. Every shard scores its part of every whole text; a document's parts are summed.
5. A document is kept unless its perplexity is beyond its language's threshold: the quantile of the perplexities of
   trusted documents that the model has not seen (the held-out fold), times a margin. As short texts vary more, both
   sides are taken down by exp(ALLOWANCE / sqrt(n)) for a text of n n-grams.

Counts cover all trusted documents and scores all documents; nothing is sampled.

Defined results. Texts of fewer than ORDER bytes have no n-gram, a null perplexity and are kept; the first bytes of a
text are context only. Languages without held-out trusted documents, and null ones, use the threshold of all
languages together; without any, all is kept. Rows are told apart by doc_id and text. Labels of a doc_id count
together: it is trusted if one says so. Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm._shared import fold_of, small, staged
from loomgrid.llm.textcodes import bytes_of, slices

ORDER = 5
SHARD_ROWS = 4_000_000
QUANTILE = 0.99
MARGIN = 1.1
ALLOWANCE = 2.0
BROADCAST_IDS = 1_000_000
#: Distinct n-grams that a counting task holds before it merges them.
HELD = 1 << 23

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[ord("0") : ord("9") + 1] = ord("0")


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc and code of every ORDER-gram of bytes; the last byte is the lowest of the code."""
    data, bounds = bytes_of(texts)
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = _FOLD[data]
    gram = np.zeros(n, np.int64)
    for k in range(ORDER):
        gram = (gram << 8) | symbols[k : k + n]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = doc[:n] == doc[ORDER - 1 :]
    return doc[:n][whole], gram[whole]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, at = np.unique(gram, return_inverse=True)
    return found, np.bincount(at, count, minlength=len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for low, high in slices(batch.column(0)):
            _, gram = grams_of(batch.column(0).slice(low, high - low))
            if len(gram):
                parts.append(np.unique(gram, return_counts=True))
            if sum(len(x) for x, _ in parts) > HELD:
                parts = [_merge(parts)]
    if parts:
        gram, count = _merge(parts)
        for low in range(0, len(gram), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 18)]) for x in (gram, count)], names=["gram", "c"])


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1))


def count_tables(trusted: DataFrame) -> dict[int, DataFrame]:
    """By order, gram and c: counts at the highest order, continuation counts below."""
    counted = trusted.select("text").mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    tables = {ORDER: staged(counted, "grams-5")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = staged(tables[k + 1].groupBy(_suffix(k).alias("gram")).agg(F.count("*").alias("c")), f"grams-{k}")
    return tables


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """What counts of one, two, and three or more lose."""
    n = table.agg(*[F.count_if(F.col("c") == i) for i in range(1, 5)]).first()
    if not all(n[:2]):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else float(i) / 2 for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(found, 1))


def model_tables(tables: dict[int, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """order, gram, value (log p) of every n-gram seen, and order, gram, value (log gamma) of every context."""
    below, found, gammas = None, [], []
    for k in range(1, ORDER + 1):
        d = discounts(tables[k])
        c = F.col("c")
        lost = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        rows = tables[k].withColumn("h", F.shiftright("gram", 8)).withColumn("lost", lost)
        of_context = rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum("lost").alias("free")).select("h", "total", (F.col("free") / F.col("total")).alias("gamma"))
        own = rows.join(of_context, "h").withColumn("own", (c - F.col("lost")) / F.col("total"))
        if below is None:
            p = own.select("gram", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            p = own.withColumn("suffix", _suffix(k - 1)).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix").select("gram", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
        below = staged(p, f"kn-{k}")
        found.append(below.select(F.lit(k).alias("order"), "gram", F.log("p").cast("float").alias("value")))
        gammas.append(of_context.select(F.lit(k).alias("order"), F.col("h").alias("gram"), F.log("gamma").cast("float").alias("value")))
    union = lambda parts: staged(_union(parts), "kn-model")
    return union(found), union(gammas)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _shard_of_gram(order: Column, gram: Column, shards: int) -> Column:
    return F.when(order >= 3, F.pmod(F.shiftright(gram, 8).bitwiseAND(F.lit(0xFFFF)), F.lit(shards))).otherwise(-1)


def _shard_of_context(order: Column, gram: Column, shards: int) -> Column:
    return F.when(order >= 3, F.pmod(gram.bitwiseAND(F.lit(0xFFFF)), F.lit(shards))).otherwise(-1)


class Table:
    """Values of 64-bit keys: two hashed places for each key, and a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(2 * len(keys)).bit_length())
        self.sides = []
        for side in range(2):
            place = self._place(keys, side)
            own = np.full(1 << self.bits, -1, np.int64)
            held = np.zeros(1 << self.bits, np.float32)
            own[place] = keys
            in_ = own[place] == keys
            held[place[in_]] = values[in_]
            self.sides.append((own, held))
            keys, values = keys[~in_], values[~in_]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def _place(self, keys: np.ndarray, side: int) -> np.ndarray:
        seed = np.uint64(0x9E3779B97F4A7C15 if side == 0 else 0xC2B2AE3D27D4EB4F)
        return ((keys.view(np.uint64) * seed) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys there are."""
        place = self._place(keys, 0)
        found = self.sides[0][0][place] == keys
        values = self.sides[0][1][place]
        rest = np.flatnonzero(~found)
        if len(rest):
            other = keys[rest]
            place = self._place(other, 1)
            hit = self.sides[1][0][place] == other
            values[rest[hit]] = self.sides[1][1][place[hit]]
            found[rest[hit]] = True
            if len(self.keys):
                rest, other = rest[~hit], other[~hit]
                at = np.minimum(np.searchsorted(self.keys, other), len(self.keys) - 1)
                hit = self.keys[at] == other
                values[rest[hit]] = self.values[at[hit]]
                found[rest[hit]] = True
        return values, found


class Shard:
    """Part of the model, as it is sent; the tables are made where it is used."""

    def __init__(self, number: int, shards: int, grams: dict, contexts: dict):
        self.number, self.shards, self.grams, self.contexts, self.made = number, shards, grams, contexts, None

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        if self.made is None:
            self.made = [{k: Table(*x) for k, x in part.items()} for part in (self.grams, self.contexts)]
        grams, contexts = self.made
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(ORDER, 0, -1):
            own = gram & ((1 << (8 * k)) - 1)
            value, found = grams[k].get(own) if k in grams else (np.zeros(len(own), np.float32), np.zeros(len(own), bool))
            out[left[found]] += value[found]
            rest = ~found
            left, gram = left[rest], own[rest]
            if not len(left):
                return out
            if k in contexts:
                value, found = contexts[k].get(gram >> 8)
                out[left[found]] += value[found]
        out[left] -= math.log(256)
        return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard = shared.value
        for batch in batches:
            text = batch.column(2)
            for low, high in slices(text):
                doc, gram = grams_of(text.slice(low, high - low))
                if shard.shards > 1:
                    own = (gram >> 8) & 0xFFFF
                    doc, gram = doc[own % shard.shards == shard.number], gram[own % shard.shards == shard.number]
                total = np.bincount(doc, shard.log_p(gram), minlength=high - low)
                n = np.bincount(doc, minlength=high - low)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(total), pa.array(n.astype(np.int64))], names=["doc_id", "th", "total", "n"])

    return run


def shards_of(grams: DataFrame, contexts: DataFrame) -> Iterator[Shard]:
    n = grams.count() + contexts.count()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    order, gram = F.col("order"), F.col("gram")
    for number in range(shards):
        parts = []
        for rows, place in ((grams, _shard_of_gram), (contexts, _shard_of_context)):
            own = rows.where(place(order, gram, shards).isin(-1, number)).toArrow()  # about SHARD_ROWS rows at most
            orders, keys, values = (own.column(c).to_numpy() for c in ("order", "gram", "value"))
            parts.append({k: (keys[orders == k], values[orders == k]) for k in range(1, ORDER + 1) if (orders == k).any()})
        yield Shard(number, shards, *parts)


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, th, perplexity by byte and n (the n-grams), of all documents under the model of the trusted ones."""
    grams, contexts = model_tables(count_tables(trusted))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sc = docs.sparkSession.sparkContext
    parts = [keyed.mapInArrow(_score(sc.broadcast(s)), "doc_id long, th long, total double, n long") for s in shards_of(grams, contexts)]
    whole = _union(parts).groupBy("doc_id", "th").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return whole.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n"))).alias("perplexity"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """docs, perplexity, threshold (the text's own, by language and length), and keep. Trusted are the documents whose label quality is 1."""
    ids = staged(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct(), "trusted-ids")
    n_ids = ids.count()
    trusted = docs.where(fold_of(F.col("doc_id")) != 0).join(small(ids, n_ids, BROADCAST_IDS), "doc_id", "left_semi")
    scored = staged(perplexities(docs, trusted), "perplexities").withColumnsRenamed({"doc_id": "__doc", "th": "__th", "perplexity": "__ppl", "n": "__n"})
    rows = docs.withColumn("__key", F.xxhash64("text")).withColumn("__lang", F.coalesce("lang", F.lit("")))
    held = rows.where(fold_of(F.col("doc_id")) == 0).join(small(ids, n_ids, BROADCAST_IDS), "doc_id", "left_semi").select("doc_id", "__key", "__lang")
    seen = held.join(scored.where("__ppl IS NOT NULL"), [held["doc_id"] == scored["__doc"], held["__key"] == scored["__th"]])
    less = F.exp(-ALLOWANCE / F.sqrt(F.greatest("__n", F.lit(1))))
    limit = F.percentile_approx(F.col("__ppl") * less, quantile, 10_000) * margin
    by_lang = staged(seen.where("__lang <> ''").groupBy("__lang").agg(limit.alias("__limit")), "thresholds")
    overall = seen.agg(limit).first()[0]
    judged = rows.join(scored, [rows["doc_id"].eqNullSafe(scored["__doc"]), rows["__key"] == scored["__th"]], "left").join(small(by_lang, by_lang.count(), 10_000), "__lang", "left")
    threshold = F.coalesce("__limit", F.lit(overall).cast("double")) / less
    return (
        judged.withColumn("perplexity", F.col("__ppl"))
        .withColumn("threshold", threshold)
        .withColumn("keep", F.coalesce(F.col("__ppl") <= threshold, F.lit(True)))
        .drop("__doc", "__th", "__ppl", "__n", "__key", "__lang", "__limit")
    )
