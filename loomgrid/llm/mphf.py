"""A minimal perfect hash over 128-bit keys, built and probed with whole-array operations.

Level l has a bit array of about GAMMA bits a key. A key that is alone on its bit stays at that level; the others
go on to the next. A key's index is the number of set bits before its own, so n keys take the indices 0..n-1.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
MOST_LEVELS = 40
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _place(high: np.ndarray, low: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(high + np.uint64(level + 1) * _STEP) ^ (low * _TURN)) % np.uint64(bits)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for flags in levels:
            ranks = np.cumsum(flags, dtype=np.int64) - flags + total
            self.before.append(ranks)
            total += int(flags.sum())
        self.size = total

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        while len(high):
            if len(levels) == MOST_LEVELS:
                raise ValueError("keys repeat: a perfect hash needs distinct keys")
            bits = max(8, int(len(high) * GAMMA))
            place = _place(high, low, len(levels), bits).astype(np.int64)
            alone = np.bincount(place, minlength=bits) == 1
            levels.append(alone)
            rest = ~alone[place]
            high, low = high[rest], low[rest]
        return cls(levels)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The index of each key; -1 or any index for a key that is not a member, which a fingerprint has to tell."""
        out = np.full(len(high), -1, dtype=np.int64)
        left = np.arange(len(high))
        for level, (flags, before) in enumerate(zip(self.levels, self.before, strict=True)):
            if not len(left):
                break
            place = _place(high[left], low[left], level, len(flags)).astype(np.int64)
            found = flags[place]
            out[left[found]] = before[place[found]]
            left = left[~found]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<u8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", n, 8).astype(np.int64)
        at, levels = 8 + 8 * n, []
        for bits in sizes:
            width = (int(bits) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at))[: int(bits)].astype(bool))
            at += width
        return cls(levels)
