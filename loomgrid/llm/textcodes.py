"""Words of many texts as arrays: positions, 64-bit hashes and document numbers, found by whole-array operations.

A word is a run of ASCII digits, ASCII letters (A-Z lowered) and characters beyond ASCII, as in `decontam.WORD`.
Texts are taken in slices of about SLICE bytes, so memory follows the slice or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomgrid.llm.mphf import mix

SLICE = 1 << 20
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + (1 << 16))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words in text order. starts and ends are byte positions in data; doc numbers the texts of the slice."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    prefix: np.ndarray

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes; a shorter word's is that of the whole."""
        return hashed(self.prefix, self.starts, np.minimum(self.ends, self.starts + n))

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and where each begins; a null is an empty text."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about size bytes each, at least one text."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    low = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(lengths):
        yield low, len(lengths)


def prefix_of(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, from which `hashed` takes any part."""
    up, _ = _powers_to(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return prefix


def hashed(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each range."""
    _, down = _powers_to(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _LENGTH)


def words_in(texts: pa.Array) -> Words:
    raw, bounds = bytes_of(texts)
    data = _FOLD[raw]
    inside = _IS_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    prefix = prefix_of(data)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    return Words(data, bounds, starts, ends, hashed(prefix, starts, ends), doc, prefix)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """doc and hash of each run of width words; a text of fewer, but not none, has all its words as one shingle."""
    h, doc = words.hashes, words.doc
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    counts = np.bincount(doc, minlength=words.texts)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - width + 1)
        value = np.zeros(n, np.uint64)
        for k in range(width):
            value = value * step + h[k : k + n]
        whole = doc[:n] == doc[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
        docs, values = [doc[:n][whole]], [value[whole]]
        last = np.cumsum(counts)
        for size in range(1, width):
            short = np.flatnonzero(counts == size)
            value = np.full(len(short), size, np.uint64)
            for k in range(size):
                value = value * step + h[last[short] - size + k]
            docs.append(short)
            values.append(value)
        doc, value = np.concatenate(docs), mix(np.concatenate(values))
    order = np.argsort(doc, kind="stable")
    return doc[order], value[order]


def numbered(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs in order of (doc, value), and each one's number among its equals, from 0."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.arange(len(doc))
    return doc, value, at - np.maximum.accumulate(np.where(new, at, 0))
