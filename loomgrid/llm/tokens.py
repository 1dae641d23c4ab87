"""Token ids of many texts, by remembering the ids of text pieces that no token crosses.

For tokenizers that drop white space, lower the case, split letters from other characters, and mark words' ends, as the
public 49k word BPE does. A text is cut at ASCII white space, and between letters and other characters where both are
plain: ASCII, and the Latin letters U+00C0 to U+027F but U+0130. A chunk with an apostrophe (contractions), with any other character
beyond ASCII, or with `<|` (special tokens) is one piece. A piece is tokenised when it is first met; a worker keeps up
to half as many pieces as there are slots and then starts anew. Whoever is done clears it, as it holds tens of MB. Pieces are looked up in parts of a quarter of the slots,
so a part always finds room, however many different pieces a text has. Positions, hashes and the ids' assembly are
whole-array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from loomgrid.llm.textcodes import bytes_of, hashed, prefix_of

SLOT_BITS = 22
_AT_ONCE = 2000

_SPACE, _LETTER, _OTHER, _BEYOND = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[128:] = _BEYOND
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def _not_letter(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The signs U+00D7 and U+00F7, and U+0130, whose lower case has a mark of its own."""
    return ((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((first == 0xC4) & (second == 0xB0))


class Places:
    """Numbers of 64-bit keys, in open addressing with linear probing."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)  # 0: empty
        self.numbers = np.zeros(1 << bits, np.int32)
        self.last = (1 << bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for what is not there."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.numbers[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.last
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.numbers[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], slot[on]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are not there yet, fewer than there are free slots."""
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            own = free & (self.keys[slot] == keys)
            self.numbers[slot[own]] = numbers[own]
            keys, numbers, slot = keys[~own], numbers[~own], (slot[~own] + 1) & self.last


class Encoder:
    def __init__(self, path: str, slot_bits: int = SLOT_BITS):
        from tokenizers import Tokenizer

        self.slot_bits = slot_bits

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.places, self.raw = Places(self.slot_bits), {}
        self.size = self.used = 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers of new entries with these ids, end to end."""
        while self.size + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        numbers = np.arange(self.size, self.size + len(lengths))
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.size, self.used = self.size + len(lengths), self.used + len(ids)
        return numbers

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _ids, of pieces of letters only: many at once, told apart by the tokens that end a word."""
        ids, lengths = [], []
        for low in range(0, len(words), _AT_ONCE):
            part = words[low : low + _AT_ONCE]
            own = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends_word[own])
            if len(last) == len(part) and len(own) == last[-1] + 1:
                n = np.diff(last, prepend=-1)
            else:
                own, n = self._ids(part)
            ids.append(own)
            lengths.append(n)
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin."""
        raw, bounds = bytes_of(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        kind = _CLASS[raw]
        before = np.empty_like(raw)
        before[0], before[1:] = 32, raw[:-1]
        inside = kind != _SPACE
        first = np.zeros(len(raw) + 1, bool)
        first[bounds] = True
        enters = inside & first[:-1]
        enters[1:] |= inside[1:] & ~inside[:-1]
        chunks = np.flatnonzero(enters)
        lead = (raw >= 0xC3) & (raw <= 0xC9)
        latin = np.zeros(len(raw), bool)
        latin[1:] = lead[:-1] & ((raw[1:] & 0xC0) == 0x80) & ~_not_letter(before[1:], raw[1:])
        latin[:-1] |= lead[:-1] & latin[1:]
        odd = np.flatnonzero(((kind == _BEYOND) & ~latin) | (raw == 0x27) | ((raw == 0x7C) & (before == 0x3C)))
        whole = np.zeros(len(chunks), bool)
        whole[np.searchsorted(chunks, odd, side="right") - 1] = True
        other = kind == _OTHER
        turns = np.flatnonzero((other[1:] != other[:-1]) & inside[1:] & inside[:-1] & ~first[1:-1]) + 1
        turns = turns[~whole[np.searchsorted(chunks, turns, side="right") - 1]]
        starts = np.sort(np.concatenate([chunks, turns]), kind="stable")
        leaves = inside & first[1:]
        leaves[:-1] |= inside[:-1] & ~inside[1:]
        ends = np.sort(np.concatenate([np.flatnonzero(leaves) + 1, turns]), kind="stable")
        is_whole = whole[np.searchsorted(chunks, starts, side="right") - 1] if whole.any() else np.zeros(len(starts), bool)
        folded = _FOLD[raw]
        keys = hashed(prefix_of(folded), starts, ends) | np.uint64(1)
        text, small = raw.tobytes(), folded.tobytes()
        ids, lengths, at_once = [], [], 1 << (self.slot_bits - 2)
        for low in range(0, len(starts), at_once):
            part = slice(low, low + at_once)
            number = self._numbers(text, small, kind, keys[part], starts[part], ends[part], is_whole[part])
            n = self.lengths[number]
            until = np.cumsum(n)
            ids.append(self.pool[np.repeat(self.starts[number] - (until - n), n) + np.arange(n.sum())])
            lengths.append(n)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        until = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return np.concatenate(ids), until[np.searchsorted(starts, bounds)]

    def _numbers(self, text: bytes, folded: bytes, kind: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_whole: np.ndarray) -> np.ndarray:
        """The entry of each piece; new ones are tokenised. Numbers hold until the next call."""
        if self.size > 1 << (self.slot_bits - 1):
            self.clear()
        number = self.places.find(keys).astype(np.int64)
        at = np.flatnonzero(is_whole)
        if len(at):
            pieces = [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            new = list(dict.fromkeys(x for x in pieces if x not in self.raw))
            if new:
                numbers = self._keep(*self._ids([x.decode() for x in new]))
                self.raw.update(zip(new, numbers.tolist(), strict=True))
            number[at] = [self.raw[x] for x in pieces]
        missing = np.flatnonzero((number < 0) & ~is_whole)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            a, b = starts[missing][first], ends[missing][first]
            pieces = [folded[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            words = kind[a] != _OTHER
            numbers = np.empty(len(new), np.int64)
            for of_words, ids in ((True, self._word_ids), (False, self._ids)):
                own = np.flatnonzero(words == of_words)
                numbers[own] = self._keep(*ids([pieces[i] for i in own.tolist()]))
            self.places.add(new, numbers.astype(np.int32))
            number[missing] = numbers[back]
        return number


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
