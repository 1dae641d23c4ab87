"""Document toxicity by multiple-instance learning: labels of documents train scores of sentences.

A sentence has the probability sigmoid(bias + sum of its features' weights); a document is toxic unless none of its
sentences is: 1 - prod(1 - p). The likelihood of the document labels under this noisy-or trains the weights, so the
model finds the offending sentences itself. Features are the sentence's words and their first letters, hashed into FEATURES
weights of fixed size.

Training takes a bounded sample of labelled rows: at most SAMPLE a class, in the order of a hash of doc_id, whole texts
of any length, as many as fit SAMPLE_CHARS characters a class. The likelihood's slope is summed block by block of
documents, so beside the sample's features only a block's sums are held, and training stops when STILL rounds gain less
than GAIN of the likelihood. Scoring reads every whole text in one pass, without a shuffle.

Defined results. Null, empty and wordless texts have no sentence and the score 0. Labels other than 0 and 1, null
labels and labels without a document do not train. Without trained labels of both kinds no document is toxic. If doc_ids repeat, a document has each of its labels. Other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._shared import fold_of, lean, staged
from loomgrid.llm.textcodes import Words, slices, words_in

FEATURES = 1 << 18
HEADS = (3, 4, 5)
SAMPLE = 3000
SAMPLE_CHARS = 8_000_000
ROUNDS = 150
STILL, GAIN = 10, 0.003
#: Features of a block of documents that are summed at once.
BLOCK = 1 << 19
RATE = 0.1
#: The weights' absolute values cost PENALTY each; features in fewer sampled documents than LEAST have none.
PENALTY = 1e-4
LEAST = 3
OFFENDS = 0.5

#: What ends a sentence (fixed values).
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's sentence, numbered through the slice, and each sentence's text."""
    stops = np.cumsum(_ENDS[words.data])[words.starts] if len(words.starts) else np.zeros(0, np.int64)
    new = np.ones(len(words.doc), bool)
    new[1:] = (words.doc[1:] != words.doc[:-1]) | (stops[1:] != stops[:-1])
    return np.cumsum(new) - 1, words.doc[new]


def features(words: Words, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sentence and a feature for each word and each of its heads."""
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    found = [words.hashes >> shift] + [(words.heads(n) * np.uint64(2 * n + 1)) >> shift for n in HEADS]
    return np.tile(sentence, len(found)), np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def of_sentences(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(owner, self.weights[feature], minlength=n), -60, 60)))


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def _features_of(texts: pa.Array, column: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By slice of texts: each sentence's text, and pairs of a sentence and a feature (or, by sentence, the columns of those that have one)."""
    n_sentences = 0
    for low, high in slices(texts):
        words = words_in(texts.slice(low, high - low))
        sentence, doc = sentences(words)
        owner, feature = features(words, sentence)
        if column is not None:
            feature = column[feature]
            owner, feature = owner[feature >= 0], feature[feature >= 0]
            order = np.argsort(owner, kind="stable")
            owner, feature = owner[order], feature[order]
        yield (doc + low).astype(np.int32), (owner + n_sentences).astype(np.int32), feature.astype(np.int32)
        n_sentences += len(doc)


def _blocks(doc: np.ndarray, owner: np.ndarray, n: int) -> list[tuple[slice, slice, slice]]:
    """Ranges of documents, their sentences and their features, of about BLOCK features or one document."""
    sentence_ends = np.searchsorted(doc, np.arange(1, n + 1))
    pair_ends = np.searchsorted(owner, sentence_ends)
    out, low = [], 0
    while low < n:
        begin = pair_ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(pair_ends, begin + BLOCK, side="right")))
        first = (int(sentence_ends[low - 1]), int(begin)) if low else (0, 0)
        out.append((slice(low, high), slice(first[0], int(sentence_ends[high - 1])), slice(first[1], int(pair_ends[high - 1]))))
        low = high
    return out


def train(texts: pa.Array, labels: np.ndarray, shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Proximal Adam on the likelihood of the labels under the noisy-or, over the whole sample, block by block, in each round.

    shares: how many labelled documents a sampled one stands for, by label. The texts are read twice, first for the
    features' document counts, so only those of common features are held.
    """
    model = Model(np.zeros(FEATURES), -4.0)
    counts, n_sentences = np.zeros(FEATURES, np.int32), 0
    for doc, owner, feature in _features_of(texts):
        first = doc[0] if len(doc) else 0
        own = doc[owner - n_sentences].astype(np.int64) - first
        counts += np.bincount(np.unique(own * FEATURES + feature) % FEATURES, minlength=FEATURES).astype(np.int32)
        n_sentences += len(doc)
    if not n_sentences or len(set(labels.tolist())) < 2:
        model.bias = -60.0
        return model
    used = np.flatnonzero(counts >= LEAST)
    at = np.full(FEATURES, -1, np.int32)
    at[used] = np.arange(len(used))
    doc, owner, column = (np.concatenate(x) for x in zip(*_features_of(texts, at), strict=True))
    n = len(texts)
    y = labels.astype(float)
    weight = np.where(labels == 1, shares[1], shares[0])
    weight = weight / weight.sum()
    value, moment, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    value[-1] = model.bias
    blocks = _blocks(doc, owner, n)
    losses: list[float] = []
    for step in range(1, ROUNDS + 1):
        slope, loss = np.zeros(len(used) + 1), 0.0
        for docs_, sentences_, pairs in blocks:
            of, own, columns, n_own = doc[sentences_] - docs_.start, owner[pairs] - sentences_.start, column[pairs], docs_.stop - docs_.start
            z = value[-1] + np.bincount(own, value[columns], minlength=len(of))
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -60, 60))), 1e-12, 1 - 1e-9)
            log_none = np.bincount(of, np.log1p(-p), minlength=n_own)
            none, label, w = np.exp(log_none), y[docs_], weight[docs_]
            some = np.maximum(1 - none, 1e-9)
            loss -= float((w * np.where(label == 1, np.log(some), log_none)).sum())
            pull = (w * ((1 - label) - label * none / some))[of] * p
            slope[:-1] += np.bincount(columns, pull[own], minlength=len(used))
            slope[-1] += pull.sum()
        losses.append(loss)
        if step > STILL and losses[-STILL - 1] - loss < GAIN * losses[-STILL - 1]:
            break
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        pace = RATE / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        value -= pace * moment / (1 - 0.9**step)
        value[:-1] = np.sign(value[:-1]) * np.maximum(np.abs(value[:-1]) - np.minimum(PENALTY * pace[:-1], RATE), 0)
    model.weights[used], model.bias = value[:-1], float(value[-1])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    marked = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label")).where(fold_of(F.col("doc_id")) != 0)
    texts = docs.select("doc_id", "text").where(fold_of(F.col("doc_id")) != 0)
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    sized = texts.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    candidates = staged(sized.join(marked, "doc_id").distinct(), "labelled")
    chosen, shares = [], []
    for label in (0, 1):
        own, left = [], chars
        of_label = candidates.where(F.col("label") == label)
        for id_, n in of_label.orderBy(order, "doc_id").select("doc_id", "n").limit(sample).collect():
            if n <= left:
                own.append(id_)
                left -= n
        chosen.append(own)
        shares.append(of_label.count() / max(1, len(own)))
    wanted = docs.sparkSession.createDataFrame([(x, y) for y, ids in enumerate(chosen) for x in ids], "doc_id long, label int")
    rows = texts.join(F.broadcast(wanted), "doc_id").toArrow()  # at most 2 * sample rows and 2 * chars characters
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    return train(rows.column("text").combine_chunks(), rows.column("label").to_numpy(), tuple(shares))


def _score(shared, schema: pa.Schema, at: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for low, high in slices(batch.column(at)):
                part = batch.slice(low, high - low)
                words = words_in(part.column(at))
                sentence, doc = sentences(words)
                p = model.of_sentences(*features(words, sentence), len(doc))
                offends = p >= OFFENDS
                score = noisy_or(p, doc, words.texts)
                chars = np.zeros(len(words.data) + 1, np.int64)
                np.cumsum((words.data & 0xC0) != 0x80, out=chars[1:])
                first = np.searchsorted(sentence, np.flatnonzero(offends))
                last = np.searchsorted(sentence, np.flatnonzero(offends), side="right") - 1
                base = chars[words.bounds[doc[offends]]]
                spans = pa.StructArray.from_arrays([pa.array(chars[words.starts[first]] - base), pa.array(chars[words.ends[last]] - base), pa.array(p[offends])], names=["start", "end", "score"])
                ends = np.zeros(words.texts + 1, np.int32)
                np.cumsum(np.bincount(doc[offends], minlength=words.texts), out=ends[1:])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=[*schema.names, "score", "offending"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs, score, and offending: the sentences that are likelier toxic than not, from their first word to their last."""
    docs = docs.drop("score", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", span)])
    names = pa.schema([(f, pa.null()) for f in docs.columns])
    return docs.mapInArrow(_score(shared, names, docs.columns.index("text")), schema)
