"""Language identification by hyperdimensional profiles.

Each letter has a random vector of DIMENSIONS signs. A trigram's vector binds the vectors of its letters, permuted by
their place: rho^2(a) * rho(b) * c. A text's vector bundles (sums) those of its trigrams, and a language's prototype
bundles those of all its training texts; a text gets the language of the prototype with the largest cosine.

Letters are lower-cased; runs of other characters are one gap, and a text begins and ends with one. ASCII letters have a code each and the others share the
rest of CODES by a hash, so there are CODES ** 3 trigrams. Training counts trigrams by language over all training
texts, and bundles each language's counts in one task; a prototype for each language reaches the driver.

Defined results. A text that is null or has no letter gets `und` and the score 0, and so does every text if nothing was
there to learn from. Null languages do not train. Equal cosines go to the smaller language. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._shared import fold_of
from loomgrid.llm.textcodes import slices

DIMENSIONS = 512
CODES = 64
GRAMS = CODES**3
SEED = 11
UNKNOWN = "und"
#: Trigram vectors that a worker keeps.
KEPT = 1 << 15


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CODES, DIMENSIONS))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigram codes, one row each."""
    letters = letter_vectors()
    a, b, c = grams // (CODES * CODES), grams // CODES % CODES, grams % CODES
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


_codes: list[np.ndarray] = []


def _code_table() -> np.ndarray:
    """By code point: 0 for what is not a letter, 1 to 26 for a to z, and the rest of CODES for other letters."""
    if not _codes:
        points = np.arange(0x110000)
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        code = np.where(letter, 27 + (points * 0x9E3779B1 >> 7) % (CODES - 27), 0).astype(np.uint8)
        code[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _codes.append(code)
    return _codes[0]


def grams_in(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc and code of every trigram of the texts, and which texts have a letter."""
    lowered = [f" {(x or '').lower()} " for x in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    code = _code_table()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), lengths)
    has = np.bincount(doc, code > 0, minlength=len(texts)) > 0
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep].astype(np.int32), doc[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    gram = (code[:-2] * CODES + code[1:-1]) * CODES + code[2:]
    whole = doc[2:] == doc[:-2]
    return doc[2:][whole], gram[whole].astype(np.int64), has


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column(1).to_pylist(), object)
        for low, high in slices(batch.column(0)):
            doc, gram, _ = grams_in(batch.column(0).slice(low, high - low).to_pylist())
            own = lang[low:high]
            for name in set(own):
                is_own = (own == name)[doc]
                counts.setdefault(name, np.zeros(GRAMS, np.int64))
                counts[name] += np.bincount(gram[is_own], minlength=GRAMS)
    for name, n in counts.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen])], schema=_COUNTS)


def _bundle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(DIMENSIONS)
    for low in range(0, len(rows), 8192):
        part = rows.iloc[low : low + 8192]
        total += part["n"].to_numpy(float) @ gram_vectors(part["gram"].to_numpy(np.int64)).astype(float)
    return pd.DataFrame({"lang": [key[0]], "prototype": [total.tolist()]})


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and their prototypes as unit vectors, from the documents outside the held-out fold."""
    train = docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id")) != 0)).select("text", "lang")
    counts = train.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sorted(counts.groupBy("lang").applyInPandas(_bundle, "lang string, prototype array<double>").collect())
    vectors = np.array([r["prototype"] for r in found]).reshape(len(found), DIMENSIONS)
    return [r["lang"] for r in found], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


class GramCache:
    """Vectors of the trigrams met so far; it starts anew when it holds KEPT of them."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at = np.full(GRAMS, -1, np.int32)
        self.rows = np.zeros((0, DIMENSIONS), np.float32)

    def places(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.at[grams] < 0]
        if len(new):
            if len(self.rows) + len(new) > KEPT:
                self.clear()
                new = grams
            self.at[new] = len(self.rows) + np.arange(len(new))
            self.rows = np.concatenate([self.rows, gram_vectors(new).astype(np.float32)])
        return self.at[grams]


_cache: list[GramCache] = []


def cosines(texts: list[str | None], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' cosines with the prototypes, and which texts have a letter."""
    if not _cache:
        _cache.append(GramCache())
    doc, gram, has = grams_in(texts)
    pairs, n = np.unique(doc * GRAMS + gram, return_counts=True)
    doc, gram = pairs // GRAMS, pairs % GRAMS
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    vectors = np.zeros((len(texts), DIMENSIONS), np.float32)
    n = n.astype(np.float32)
    for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for at in range(low, high, KEPT // 2):
            to = min(high, at + KEPT // 2)
            place = _cache[0].places(gram[at:to])
            vectors[i] += n[at:to] @ _cache[0].rows[place]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(length, 1e-12)) @ model.T.astype(np.float32), has


def _predict(shared, names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        for batch in batches:
            for low, high in slices(batch.column(at)):
                part = batch.slice(low, high - low)
                if langs:
                    found, has = cosines(part.column(at).to_pylist(), model)
                    best = found.argmax(axis=1)
                    score = np.where(has, np.clip(found[np.arange(len(best)), best], 0, 1), 0).astype(float)
                    lang = [langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                else:
                    lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs, lang_pred and score, the cosine with that language's prototype."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(shared, docs.columns, docs.columns.index("text")), schema)
