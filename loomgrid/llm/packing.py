"""Packing tokenised documents into sequences of a fixed length: hierarchical residual packing.

Round 0: each partition tokenises its documents, cuts the longer ones and packs its pieces best-fit decreasing, block
by block of BLOCK pieces. Bins with a residue of at most `slack` tokens are final. The others become items of the next
round, whole: they are dealt to groups of about `group` items and packed best-fit decreasing again, and the bins that are
still underfull go on. As bins merge there are fewer groups in each round; one group holds all that are left only where
these are no more than `group`. The rounds end there, or when one has merged fewer than one bin in STILL: what is left
then does not fit together anywhere near it, and every bin stays a sequence of its own.

Every round's table is written to the shared folder, so a bin's number is fixed once it is given. A row of a round is
a bin, not a token, and a group has about `group` rows but for the chance of hashing.

Defined results. Null and empty texts have the end mark as their only token. Rows that share a doc_id are packed each
on their own. Other columns of documents do not matter.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm._shared import lean, staged
from loomgrid.llm.textcodes import slices
from loomgrid.llm.tokens import encoder

LENGTH = 2048
END = 0
SLACK = 4
BLOCK = 1 << 16
GROUP = 1 << 16
STILL = 200

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("at", pa.int64())])


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and its place there, and the bins' totals. Ties keep the items' order."""
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    totals: list[int] = []
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has the residue r
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = free >> size
        if fits:
            residue = size + ((fits & -fits).bit_length() - 1)
            own = open_by[residue]
            b = own.pop()
            if not own:
                free &= ~(1 << residue)
        else:
            b, residue = len(totals), capacity
            totals.append(0)
        bins[i], places[i] = b, totals[b]
        totals[b] += size
        if left := residue - size:
            open_by[left].append(b)
            free |= 1 << left
    return bins, places, totals


def _tokenise(path: str, capacity: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            doc, piece, start, length, crc = zip(*held, strict=True)
            bins, places, totals = best_fit(np.array(length, np.int64), capacity)
            columns = [doc, piece, start, length, crc, bins + number, places]
            number, held = number + len(totals), []
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

        tail = struct.pack("<I", END)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in slices(texts):
                ids, begins = encoder(path).encode(texts.slice(low, high - low))
                whole, begins = ids.astype("<u4").tobytes(), (4 * begins).tolist()
                for doc, first, last in zip(docs[low:high], begins[:-1], begins[1:], strict=True):
                    codes = whole[first:last] + tail
                    for k, at in enumerate(range(0, len(codes), 4 * capacity)):
                        cut = codes[at : at + 4 * capacity]
                        held.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                        if len(held) == BLOCK:
                            yield flush()
        if held:
            yield flush()
        encoder(path).clear()  # its texts' pieces go with the task; the tokenizer stays

    return run


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the bin of round 0 with the piece's place in it."""
    return docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer_path, capacity), PIECES)


def _merge(capacity: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["total", "bin"], ascending=[False, True])
        bins, places, totals = best_fit(items["total"].to_numpy(np.int64), capacity)
        first = np.full(len(totals), -1, np.int64)
        own = items["bin"].to_numpy(np.int64)
        first[bins[::-1]] = own[::-1]  # a merged bin takes the number of its first item
        return pd.DataFrame({"bin": own, "into": first[bins], "shift": places, "total": np.array(totals, np.int64)[bins]})

    return run


def merge_bins(bins: DataFrame, capacity: int, slack: int, group: int = GROUP) -> DataFrame | None:
    """bin, into, shift: the sequence that a bin of round 0 ends in, and where it begins there. Bins that stay alone may be absent."""
    left = staged(bins.where(F.col("total") < capacity - slack), "bins")
    n, moves, turn = left.count(), None, 0
    while n > 1:
        groups, turn = math.ceil(n / group), turn + 1
        deal = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups))
        step = staged(left.groupBy(deal.alias("deal")).applyInPandas(_merge(capacity), "bin long, into long, shift long, total long"), "bin-moves")
        moved = step.select("bin", "into", "shift")
        if moves is None:
            moves = moved
        else:
            later = moved.where("bin <> into").select(F.col("bin").alias("into"), F.col("into").alias("last"), F.col("shift").alias("more"))
            moves = staged(
                moves.join(later, "into", "left").select("bin", F.coalesce("last", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "bin-moves"
            )
        merged = step.where("bin <> into").count()
        if groups == 1 or merged * STILL < n:
            break
        left = step.where((F.col("bin") == F.col("into")) & (F.col("total") < capacity - slack)).select("bin", "total")
        n = left.count()
    return moves


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document stands."""
    pieces = staged(tokenised_pieces(docs, tokenizer_path, capacity), "pieces")
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("total"))
    moves = merge_bins(bins, capacity, slack)
    whole = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return pieces.select(*whole, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moved = pieces.join(moves, "bin", "left")
    return moved.select(*whole, F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
