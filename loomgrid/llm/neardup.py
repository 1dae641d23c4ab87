"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies. Every document adds its distinct shingles to a count-min sketch of fixed size. The sketch
   resolves the share of documents that hold a shingle to about (shingles a document) / WIDTH whatever the corpus'
   size, so idf is a function of that share: 2 up to the share RARE, falling to 1 for a shingle in every document.
2. Weights. The j-th occurrence of a shingle in a text is an element of weight idf. The sum of the elements' common
   weights is sum of min(tf, tf') idf, so similarity is the weighted Jaccard similarity of TF-IDF vectors.
3. Samples. Improved consistent weighted sampling (r and c from Gamma(2, 1), b uniform, drawn by the element) gives
   BANDS * ROWS samples a text; two texts share a sample with a probability of their similarity. idf takes LEVELS
   values, so the draws are tables: by sample, level and 14 bits of the element's hash. An element's weight is the
   same in all texts, so a sample's second part never tells two texts apart and is left out.
4. Bands. Texts that share all samples of a band meet. In each meeting, the smallest id leads; a member that agrees
   with a leader in half the samples or more is paired with it, and others become leaders. Equal texts of a task send
   one of them.
5. Pairs are verified by their exact weighted Jaccard similarity over whole texts, but for equal texts. As idf lowers
   what frequent passages count, copies within a large group can fall below the threshold by their edits alone; a pair
   whose unweighted similarity reaches the threshold is a link as well. `verified_links` reports both figures.
6. Classes are the connected components, by alternating large-star and small-star steps over staged tables.
7. A meeting whose members are in more than one class meets again, so no link is lost to a leader. First each two
   members of different classes compare sketches: the least element of each of BINS parts of the hash range, in a byte,
   and the number and weight of elements. Only members that may have a link there, with estimates up to CLOSE standard
   deviations below the threshold, bring their texts. These are joined exactly within the meeting: two texts can be a link only if they share one of
   their rarest elements (those beyond which a text has less than the threshold of its number or weight), so families of
   texts around one common passage meet at no element; what meets is counted in full unless it is one class already.
   The comparison of sketches grows with the square of a meeting's members that are alike, but no copies. A task holds one
   meeting's members: about 400 bytes each, and 16 bytes for each element of the few that bring their texts.
   The classes of all links are the result.

Defined results. Null, empty and wordless texts are alone. Texts of fewer words than a shingle are one shingle. Rows
that share a doc_id are one document; a row without a doc_id has no class. A class has its smallest doc_id as its id.
Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm._shared import lean, partitions_for, staged
from loomgrid.llm.mphf import mix
from loomgrid.llm.textcodes import numbered, shingles, slices, words_in

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
WIDTH, DEPTH = 1 << 16, 2
RARE = 0.002
LEVELS = 16
ENTRIES = 1 << 14
#: Texts whose bands a task holds before it lets them go.
HELD = 1 << 15
ALIKE = 0.5
BLOCK = 4096
#: Parts of a sketch, and by how many standard deviations an estimate may miss the threshold.
BINS = 256
CLOSE = 3.0
BROADCAST_IDS = 500_000

_SEEDS = mix(np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OCCURRENCE = np.uint64(0xD1342543DE82EF95)


class Weights:
    """idf of shingles from the sketch's counts and the number of documents."""

    def __init__(self, counts: np.ndarray, documents: int):
        noise = (counts.sum(axis=1, keepdims=True) - counts) / max(1, counts.shape[1] - 1)
        share = np.clip((counts - noise) / max(1, documents), RARE, 1)
        self.level = np.rint((LEVELS - 1) * np.log(share) / np.log(RARE)).astype(np.uint8)

    def levels(self, shingle: np.ndarray) -> np.ndarray:
        found = [row[place(shingle, k)] for k, row in enumerate(self.level)]
        return np.maximum.reduce(found).astype(np.int64)


def value_of(level: np.ndarray) -> np.ndarray:
    return 1 + level / (LEVELS - 1)


def place(shingle: np.ndarray, row: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((shingle * _SEEDS[row]) >> np.uint64(48)).astype(np.int64)


@lean
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((DEPTH, WIDTH), np.int64)
    documents = 0
    for batch in batches:
        texts = batch.column(0)
        documents += len(texts)
        for low, high in slices(texts):
            _, value, nth = numbered(*shingles(words_in(texts.slice(low, high - low)), SHINGLE))
            for row in range(DEPTH):
                counts[row] += np.bincount(place(value[nth == 0], row), minlength=WIDTH)
    kind = np.int32 if documents < 1 << 31 else np.int64
    parts = counts.reshape(-1, BLOCK).astype(kind).astype("<i8")
    rows = [(k, x.tobytes()) for k, x in enumerate(parts) if x.any()] + [(-1, np.array([documents], "<i8").tobytes())]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "counts"])


def _sum_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = None
    for x in rows["counts"]:
        own = np.frombuffer(x, "<i8")
        total = own.copy() if total is None else total + own
    return pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})


def shingle_weights(docs: DataFrame) -> Weights:
    """The sketch of all documents, summed in two steps; DEPTH * WIDTH numbers reach the driver."""
    parts = docs.select("text").mapInArrow(_sketch, "block int, counts binary").withColumn("salt", F.spark_partition_id() % 64)
    kind = "block int, counts binary"
    first = parts.groupBy("block", "salt").applyInPandas(_sum_blocks, kind)
    counts, documents = np.zeros((DEPTH * WIDTH // BLOCK, BLOCK), np.int64), 0
    for row in first.groupBy("block").applyInPandas(_sum_blocks, kind).collect():
        own = np.frombuffer(row["counts"], "<i8")
        if row["block"] < 0:
            documents = int(own[0])
        else:
            counts[row["block"]] = own
    return Weights(counts.reshape(DEPTH, WIDTH), documents)


def sample_tables(seed: int = 7) -> np.ndarray:
    """By sample, level and entry: the bits of ICWS's a, whose smallest names the sample. Positive floats order as their bits do."""
    rng = np.random.default_rng(seed)
    log_w = np.log(value_of(np.arange(LEVELS)))[:, None]
    out = np.empty((SAMPLES, LEVELS, ENTRIES), np.float32)
    for k in range(SAMPLES):
        r, c, b = rng.gamma(2, 1, ENTRIES), rng.gamma(2, 1, ENTRIES), rng.random(ENTRIES)
        t = np.floor(log_w / r + b)
        out[k] = c / np.exp(r * (t - b) + r)
    return out.view(np.uint32)


_tables: list[np.ndarray] = []


def _drawn() -> np.ndarray:
    if not _tables:
        _tables.append(sample_tables())
    return _tables[0]


def elements(texts: pa.Array, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, hash and level of every element of the texts, ordered by doc."""
    doc, value, nth = numbered(*shingles(words_in(texts), SHINGLE))
    with np.errstate(over="ignore"):
        return doc, mix(value + nth.astype(np.uint64) * _OCCURRENCE), weights.levels(value)


def samples(doc: np.ndarray, element: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The docs that have elements, and their samples: 32 bits of the element that was drawn."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    out = np.empty((len(first), SAMPLES), np.uint32)
    at = level * ENTRIES
    low = element & np.uint64(0xFFFFFFFF)
    for k, drawn in enumerate(_drawn()):
        with np.errstate(over="ignore"):
            entry = ((element * _SEEDS[100 + k]) >> np.uint64(50)).astype(np.int64)
        a = drawn.reshape(-1)[at + entry].astype(np.uint64)
        out[:, k] = (np.minimum.reduceat((a << np.uint64(32)) | low, first) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if len(first) else 0
    return doc[first], out


def sketches(doc: np.ndarray, element: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Of each doc that has elements: BINS bytes, the number of its elements and their weight (two 4-byte floats)."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    number = np.cumsum(new) - 1
    n = int(new.sum())
    place_ = number * BINS + (element >> np.uint64(56)).astype(np.int64)
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, place_, element << np.uint64(8))
    parts = np.where(least == np.iinfo(np.uint64).max, 0, 1 + ((least >> np.uint64(8)) % np.uint64(255)).astype(np.int64)).astype(np.uint8)
    sums = np.stack([np.bincount(number, minlength=n), np.bincount(number, value_of(level), minlength=n)], axis=1).astype("<f4")
    return np.concatenate([parts.reshape(n, BINS), sums.view(np.uint8).reshape(n, 8)], axis=1)


def agreement(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The estimated similarity of one text and others, by their sketches."""
    same = ((others == one) & (one > 0)).sum(axis=1)
    there = ((others > 0) | (one > 0)).sum(axis=1)
    return np.where(there >= 8, same / np.maximum(there, 1), 1.0)


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    keys = np.empty((len(drawn), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            value = np.full(len(drawn), b + 1, np.uint64)
            for k in range(ROWS):
                value = mix(value * _OCCURRENCE + drawn[:, b * ROWS + k])
            keys[:, b] = value
    return keys


class Meetings:
    """Members of one band's meeting, by id: each is paired with the leaders it is like, or leads."""

    def __init__(self):
        self.pairs: list[tuple[np.ndarray, int, np.ndarray]] = []

    def meet(self, ids: np.ndarray, prints: np.ndarray, short: np.ndarray, leaders: int = 0) -> np.ndarray:
        """The places of those that lead. The first `leaders` members lead already."""
        left, lead = np.arange(len(ids)), []
        old = 0
        while len(left):
            at = left[0]
            lead.append(at)
            others = left[1:]
            alike = (short[others] == short[at]).mean(axis=1) >= ALIKE
            if old < leaders:  # a leader of before is not taken up by another
                alike &= others >= leaders
                old += 1
            if alike.any():
                members = others[alike]
                self.pairs.append((ids[members], int(ids[at]), prints[members] == prints[at]))
            left = others[~alike]
        return np.array(lead, np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        a = np.concatenate([np.full(len(x), lead, np.int64) for x, lead, _ in self.pairs])
        b, same = np.concatenate([x for x, _, _ in self.pairs]), np.concatenate([x for _, _, x in self.pairs])
        self.pairs = []
        return a, b, same


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of two or more equal keys."""
    new = np.ones(len(keys) + 1, bool)
    new[1:-1] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    for i in np.flatnonzero(np.diff(at) > 1):
        yield int(at[i]), int(at[i + 1])


#: Members have a key, pairs have a lead, and sketches (in short) neither.
_SIGNED = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("print", pa.int64()), ("short", pa.binary()), ("lead", pa.int64()), ("same", pa.bool_())])
_SIGNED_DDL = "key long, id long, print long, short binary, lead long, same boolean"


def _pair_rows(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(a), pa.array(same)], schema=_SIGNED)


def _member_rows(key: np.ndarray | None, ids: np.ndarray, prints: np.ndarray, short: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    texts = pa.array([x.tobytes() for x in short], pa.binary())
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if key is None else pa.array(key), pa.array(ids), pa.array(prints), texts, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], schema=_SIGNED)


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _members(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    key, ids, prints = (batch.column(k).to_numpy() for k in range(3))
    return key, ids, prints, _bytes(batch.column(3), np.uint16)


def _sign(shared):
    """Members (key set) for the bands, pairs (lead set) of equal texts within the task, and a sketch of each other text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, prints, short, keys, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((ids, prints))
            ids, prints, short, keys, sketch = ids[order], prints[order], short[order], keys[order], sketch[order]
            new = np.ones(len(ids), bool)
            new[1:] = prints[1:] != prints[:-1]
            yield _pair_rows(ids[new][np.cumsum(new) - 1][~new], ids[~new], np.ones(len(ids) - new.sum(), bool))
            ids, prints, short, keys = ids[new], prints[new], short[new], keys[new]
            yield _member_rows(None, ids, prints, sketch[new])
            for b in range(BANDS):
                yield _member_rows(keys[:, b].view(np.int64), ids, prints, short)

        total = 0
        for batch in batches:
            id_, text, print_ = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            ids = id_.to_numpy()
            for low, high in slices(text):
                found = elements(text.slice(low, high - low), shared.value)
                doc, drawn = samples(*found)
                held.append((ids[low:high][doc], print_[low:high][doc], drawn.astype(np.uint16), band_keys(drawn), sketches(*found)))
                total += len(doc)
            if total >= HELD:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    return run


@lean
def _meet_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members ordered by key and id: pairs with leaders (lead set), and the members that met (key set). Only the leaders of a key that goes on are kept."""
    kept: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _members(batch)
        carried = 0
        if kept is not None and kept[0][0] == rows[0][0]:
            carried = len(kept[0])
            rows = tuple(np.concatenate(x) for x in zip(kept, rows, strict=True))
        key, ids, prints, short = rows
        fresh = np.ones(len(key), bool)  # members that no batch before has sent on
        fresh[:carried] = carried == 1 and alone
        meetings = Meetings()
        start = len(key) - 1
        while start and key[start - 1] == key[-1]:
            start -= 1
        kept, alone = tuple(x[start:] for x in rows), start == len(key) - 1
        met = np.zeros(len(key), bool)
        for low, high in _groups(key):
            lead = meetings.meet(ids[low:high], prints[low:high], short[low:high], carried if low == 0 else 0)
            met[low:high] = fresh[low:high]
            if low == start:
                kept = tuple(x[lead] for x in kept)
        yield _pair_rows(*meetings.take())
        yield _member_rows(*(x[met] for x in rows))


def _near_links(one: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...], threshold: float) -> np.ndarray:
    """Which others can be a link with one, by short (weighted samples), parts, numbers and weights of their elements."""
    (short, parts, count, weight), (shorts, part, counts, weights) = one, others
    drawn = (shorts == short).mean(axis=1)
    off = lambda p, n: CLOSE * math.sqrt(p * (1 - p) / n)
    fits = (np.minimum(counts, count) >= threshold * np.maximum(counts, count) * (1 - 1e-6)) | (np.minimum(weights, weight) >= threshold * np.maximum(weights, weight) * (1 - 1e-6))
    found = np.flatnonzero(fits & (drawn >= ALIKE))
    same = agreement(parts, part[found])
    plain = same >= threshold - off(threshold, BINS)
    common = np.minimum(same + off(0.5, BINS), 1)
    common = common / (1 + common) * (counts[found] + count)  # elements in common, at most
    both = weights[found] + weight
    weighted = (drawn[found] >= threshold - off(threshold, SAMPLES)) & (value_of(LEVELS - 1) * common >= threshold / (1 + threshold) * both)
    return found[plain | weighted]


def _meetings(batches: Iterator[pa.RecordBatch], columns) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows ordered by key, as arrays by the function columns (the key first): those of one key at a time, without the key."""
    kept: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        if kept is not None:
            rows = tuple(np.concatenate(x) for x in zip(kept, rows, strict=True))
        start = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
        for low, high in _groups(rows[0][:start]):
            yield tuple(x[low:high] for x in rows[1:])
        kept = tuple(x[start:] for x in rows)
    if kept is not None:
        yield kept[1:]


def _hopeful(threshold: float):
    """Members with class and sketch, ordered by key: key, id and class of those that may be a link with a member of another class. Of equal texts one stands for all."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = lambda b: (*_members(b), b.column(0).to_numpy(), b.column(4).to_numpy(), _bytes(b.column(5), np.uint8))
        for ids, prints, short, keys, classes, sketch in _meetings(batches, columns):
            first = np.unique(prints, return_index=True)[1]
            first = first[np.argsort(classes[first], kind="stable")]
            ids, short, classes, sketch = ids[first], short[first], classes[first], sketch[first]
            sums = np.ascontiguousarray(sketch[:, BINS:]).view("<f4")
            whole = (short, sketch[:, :BINS], sums[:, 0], sums[:, 1])
            hopeful = np.zeros(len(ids), bool)
            for i, low in enumerate(np.searchsorted(classes, classes, side="right").tolist()):
                found = _near_links(tuple(x[i] for x in whole), tuple(x[low:] for x in whole), threshold)
                hopeful[low + found] = True
                hopeful[i] |= len(found) > 0
            if hopeful.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hopeful.sum(), keys[0])), pa.array(ids[hopeful]), pa.array(classes[hopeful])], names=["key", "id", "class"])

    return run


class Classes:
    """Union and find over the members of a meeting."""

    def __init__(self, classes: np.ndarray):
        self.of = np.unique(classes, return_inverse=True)[1]

    def join(self, one: int, other: int) -> None:
        self.of[self.of == self.of[other]] = self.of[one]


def exact_links(classes: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, threshold: float) -> list[tuple[int, int, float, float]]:
    """Links (two places, weighted and unweighted similarity) that join the members of different classes, by their elements."""
    n = len(classes)
    _, element, often = np.unique(element, return_inverse=True, return_counts=True)
    order = np.lexsort((element, often[element], doc))  # rarest first
    doc, element, weight = doc[order], element[order], weight[order]
    count, total = np.bincount(doc, minlength=n), np.bincount(doc, weight, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])
    rest = count[doc] - (np.arange(len(doc)) - start[doc])  # this element and those after it
    before = np.cumsum(weight) - weight
    heavy = total[doc] - (before - before[start[doc]])
    early = ((rest >= threshold * count[doc] * (1 - 1e-9)) | (heavy >= threshold * total[doc] * (1 - 1e-9))) & (often[element] > 1)
    postings: dict[int, list[int]] = {}
    own = Classes(classes)
    seen = np.zeros(len(often), bool)
    found: list[tuple[int, int, float, float]] = []
    for i in range(n):
        mine = slice(start[i], start[i + 1])
        keys = element[mine][early[mine]].tolist()
        others = np.unique([j for k in keys for j in postings.get(k, ())]).astype(np.int64)
        for k in keys:
            postings.setdefault(k, []).append(i)
        seen[element[mine]] = True
        while len(others := others[own.of[others] != own.of[i]]):
            part, others = others[:BLOCK], others[BLOCK:]
            at = np.concatenate([np.arange(start[j], start[j + 1]) for j in part])
            owner = np.repeat(np.arange(len(part)), count[part])
            both = seen[element[at]]
            common, common_weight = np.bincount(owner[both], minlength=len(part)), np.bincount(owner[both], weight[at[both]], minlength=len(part))
            plain, weighted = common / (count[part] + count[i] - common), common_weight / (total[part] + total[i] - common_weight)
            for j in np.flatnonzero(np.maximum(plain, weighted) >= threshold).tolist():
                if own.of[part[j]] != own.of[i]:
                    own.join(i, int(part[j]))
                    found.append((i, int(part[j]), float(weighted[j]), float(plain[j])))
        seen[element[mine]] = False
    return found


def _join_meetings(shared, threshold: float):
    """key, id, class and text, ordered by key: a, b, weighted and unweighted similarity of links that join classes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            text, parts = batch.column(3), []
            for low, high in slices(text):
                doc, element, level = elements(text.slice(low, high - low), shared.value)
                cuts = np.searchsorted(doc, np.arange(high - low + 1))
                parts += [(element[a:b], level[a:b].astype(np.uint8)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            held = np.empty(len(parts), object)
            held[:] = parts
            return (*(batch.column(k).to_numpy() for k in range(3)), held)

        for ids, classes, held in _meetings(batches, columns):
            sizes = [len(e) for e, _ in held]
            element, level = (np.concatenate(x) for x in zip(*held, strict=True))
            links = exact_links(classes, np.repeat(np.arange(len(ids)), sizes), element, value_of(level), threshold)
            if links:
                a, b, weighted, plain = (np.array(x) for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(weighted), pa.array(plain)], names=["a", "b", "weighted", "unweighted"])

    return run


def _distinct_pairs(rows: DataFrame) -> DataFrame:
    """a < b, and same if the texts are equal."""
    return rows.where("id <> lead").groupBy(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).agg(F.max("same").alias("same"))


def candidate_pairs(docs: DataFrame, weights: Weights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of every text that shares a band with a leader that it is like, the members of the bands that are shared, and the sketches."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("print"))
    signed = staged(keyed.mapInArrow(_sign(shared), _SIGNED_DDL), "signed")
    members = signed.where(F.col("key").isNotNull()).select("key", "id", "print", "short")
    met = staged(members.repartition(partitions_for(docs), "key").sortWithinPartitions("key", "id").mapInArrow(_meet_by_key, _SIGNED_DDL), "met")
    of_rows = lambda df: df.where(F.col("lead").isNotNull()).select("id", "lead", "same")
    sketched = signed.where(F.col("key").isNull() & F.col("lead").isNull()).select("id", F.col("short").alias("sketch"))
    return _distinct_pairs(of_rows(signed).unionByName(of_rows(met))), met.where(F.col("key").isNotNull()).select("key", "id", "print", "short"), sketched


def links_across(docs: DataFrame, members: DataFrame, classes: DataFrame, sketched: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """a, b, weighted, unweighted: links that join the classes of the members of a band."""
    own = members.select("key", "id").join(classes.select(F.col("doc_id").alias("id"), "class_id"), "id", "left").select("key", "id", F.coalesce("class_id", "id").alias("class"))
    own = staged(own, "member-classes")
    mixed = own.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    rows = members.join(own, ["key", "id"]).join(mixed, "key").join(sketched.dropDuplicates(["id"]), "id").select("key", "id", "print", "short", "class", "sketch")
    by_key = lambda df: df.repartition(partitions_for(members), "key").sortWithinPartitions("key")
    hopeful = staged(by_key(rows).mapInArrow(_hopeful(threshold), "key long, id long, class long"), "hopeful")
    texts = texts_of(docs, hopeful.select(F.col("id").alias("doc_id")))
    brought = by_key(hopeful.join(texts.withColumnRenamed("doc_id", "id"), "id").select("key", "id", "class", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return brought.mapInArrow(_join_meetings(shared, threshold), "a long, b long, weighted double, unweighted double")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents of these ids; where the ids are few, the other texts do not move."""
    wanted = staged(ids.distinct(), "wanted")
    n = wanted.count()
    side = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    return staged(docs.select("doc_id", "text").join(side, "doc_id", "left_semi"), "wanted-texts")


def jaccard(left: pa.Array, right: pa.Array, weights: Weights) -> np.ndarray:
    """The weighted and the unweighted Jaccard similarity of each two texts, as two rows."""
    n = len(left)
    sides = [elements(x, weights) for x in (left, right)]
    doc, element, level = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((element, doc))
    doc, element, level = doc[order], element[order], level[order]
    both = (doc[1:] == doc[:-1]) & (element[1:] == element[:-1])
    found = np.zeros((2, n))
    for k, value in enumerate((value_of(level), np.ones(len(level)))):
        common = np.bincount(doc[1:][both], value[1:][both], minlength=n)
        union = np.bincount(doc, value, minlength=n) - common
        np.divide(common, union, out=found[k], where=union > 0)
    return found


def _verify(shared, threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2), 1 << 20):
                part = batch.slice(low, high - low)
                score = jaccard(part.column(2), part.column(3), shared.value)
                good = score.max(axis=0) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good)), *[pa.array(x[good]) for x in score]], names=["a", "b", "weighted", "unweighted"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """a, b, weighted, unweighted (similarities): those of the pairs of which one is at least the threshold; equal texts have 1."""
    open_ = pairs.where(~F.col("same"))
    texts = texts_of(docs, open_.select(F.col("a").alias("doc_id")).union(open_.select("b")))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    right = open_.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a").select("a", "b", "left", "right")
    found = both.mapInArrow(_verify(shared, threshold), "a long, b long, weighted double, unweighted double")
    return pairs.where("same").select("a", "b", F.lit(1.0).alias("weighted"), F.lit(1.0).alias("unweighted")).unionByName(found)


def verified_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, weighted, unweighted: links of documents. Any two similar ones that share a band are linked by a path."""
    weights = shingle_weights(docs)
    pairs, members, sketched = candidate_pairs(docs, weights)
    links = staged(verified(docs, staged(pairs, "pairs"), weights, threshold), "links")
    across = links_across(docs, members, components(links), sketched, weights, threshold)
    return links.unionByName(staged(across, "links-across"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())


def components(links: DataFrame) -> DataFrame:
    """doc_id, class_id of every document that has a link: the smallest doc_id that it reaches."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _digest(edges)
    while before[0] and (before[0] != before[2] or not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("class_id"))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs and class_id, the smallest doc_id of the document's class."""
    found = components(verified_links(docs, threshold)).withColumnRenamed("class_id", "__class")
    return docs.drop("class_id").join(found.hint("shuffle_hash"), "doc_id", "left").withColumn("class_id", F.coalesce("__class", "doc_id")).drop("__class")


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the members of classes but their first; the columns stay."""
    others = components(verified_links(docs, threshold)).select("doc_id")
    return docs.join(others.hint("shuffle_hash"), "doc_id", "left_anti")
