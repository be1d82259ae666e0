"""Token ids of whole texts by a public tokenizer, with each distinct part of a word encoded once per task.

The vocabulary's tokens never cross white space, so a text's ids are its words' ids in order, and a
word's are those of its parts: runs of letters, single digits, runs of other signs.  Plain words
(printable ASCII without an apostrophe, and Latin-1 letters) are lower-cased and cut into parts over whole
buffers at a time; parts are told apart by a 64-bit hash of their bytes, and only new ones go through the
vocabulary's merges.  Every other word is one part, which goes through the tokenizer as it is.

A task keeps the ids of the parts it has met, up to ``CACHED_PARTS``, then starts afresh; results
don't depend on that.  Buffers are read ``SLICE_BYTES`` at a time, cut at white space, so a long text takes no
more memory than its ids.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from pairlab.llm import words as W

CACHED_PARTS = 500_000

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes that plain words don't have, besides the second byte of a Latin-1 letter.
_STRANGE = np.ones(256, dtype=bool)
_STRANGE[[*range(0x21, 0x7F), 0xC3, 0x20, *range(0x09, 0x0E)]] = False
_STRANGE[ord("'")] = True
_ODD_SALT = np.uint64(0x5851F42D4C957F2D)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others come after 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


_LETTERS = _byte_letters()


class _Table:
    """64-bit keys to positions, by open addressing over arrays."""

    def __init__(self, most: int):
        self.bits = max(10, int(4 * most - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        self.size = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            value = self.values[slot]
            hit = (value >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = value[hit]
            on = (value >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Give unknown, distinct keys the next positions, in order."""
        number = np.arange(self.size, self.size + len(keys))
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = np.flatnonzero(self.values[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.values[slot[won]] = keys[todo[won]], number[todo[won]]
            on = np.ones(len(todo), dtype=bool)
            on[won] = False
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        self.size += len(keys)


class WordTokens:
    """Ids of parts of words, by position: ``starts`` and ``lengths`` point into ``pool``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self._clear()

    def _clear(self) -> None:
        self.table = _Table(CACHED_PARTS)
        self.pool, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)

    def _learn(self, parts: list[bytes], odd: list[bool]) -> None:
        """Ids of new parts; ``odd`` ones are whole words for the tokenizer."""
        words = [p.decode() for p, o in zip(parts, odd, strict=True) if o]
        others = iter(self.whole.encode_batch_fast(words, add_special_tokens=False))
        merge = self.model.tokenize
        ids: list[list[int]] = []
        for part, strange in zip(parts, odd, strict=True):
            if strange:
                ids.append(next(others).ids)
            else:
                text = part.decode("latin-1")
                ids.append([token.id for token in merge(text if part.isascii() else text.translate(_LETTERS))])
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for one in ids for i in one), dtype=np.uint32, count=int(lengths.sum()))
        first = self.table.size
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(ids) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.pool[self.used: self.used + len(flat)] = flat
        self.starts[first: first + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first: first + len(ids)] = lengths
        self.used += len(flat)

    def _block(self, buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of one block, and the place and number of ids of each part; ``edges`` are document bounds inside it."""
        latin = np.zeros(len(buf), dtype=bool)  # second bytes of Latin-1 letters
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        kind = _CLASS[buf]
        kind[latin] = _LETTER
        strange = _STRANGE[buf] & ~latin
        strange[:-1] |= (buf[:-1] == ord("<")) & (buf[1:] == ord("|"))
        lowered = _LOWER[buf]
        lowered[latin & (buf < 0x9F)] += 0x20
        starts, ends, _ = W.bounds(buf, edges)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), starts, starts
        begin = kind != _SPACE
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begin[starts] = True
        odd_words = np.unique(np.searchsorted(starts, np.flatnonzero(strange), side="right") - 1)
        if len(odd_words):
            size = ends[odd_words] - starts[odd_words]
            inside = np.arange(int(size.sum())) + np.repeat(starts[odd_words] - (np.cumsum(size) - size), size)
            begin[inside] = False
            begin[starts[odd_words]] = True
            lowered[inside] = buf[inside]
        first = np.flatnonzero(begin)
        word = np.searchsorted(starts, first, side="right") - 1
        last = np.minimum(np.append(first[1:], len(buf)), ends[word])
        odd = np.zeros(len(starts), dtype=bool)
        odd[odd_words] = True
        odd = odd[word]
        keys = W.span_hashes(lowered, first, last)
        keys[odd] ^= _ODD_SALT
        at = self.table.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, one = np.unique(keys[new], return_index=True)
            if self.table.size + len(fresh) > CACHED_PARTS and self.table.size:
                self._clear()
                return self._block(buf, edges)
            if self.table.size + len(fresh) > len(self.table.values) // 2:
                self.table = _Table(len(fresh))
            one = new[one]
            raw = lowered.tobytes()
            self._learn([raw[a:b] for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)], odd[one].tolist())
            self.table.add(fresh)
            at = self.table.find(keys)
        lengths = self.lengths[at]
        total = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.starts[at] - (total - lengths), lengths) + np.arange(int(total[-1]))]
        return ids, first, lengths

    def encode_buffer(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a buffer (n + 1 offsets) one after the other, and the number of each text's."""
        found, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
        at, stop = int(offsets[0]), int(offsets[-1])
        while at < stop:
            end = min(at + W.SLICE_BYTES, stop)
            if end < stop:
                end = _cut(buf, offsets, at, end, stop)
            edges = offsets[(offsets >= at) & (offsets <= end)] - at
            ids, first, lengths = self._block(buf[at:end], edges)
            doc = np.searchsorted(offsets, first + at, side="right") - 1
            counts += np.bincount(doc, weights=lengths, minlength=len(counts)).astype(np.int64)
            found.append(ids)
            at = end
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32), counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and the number of each text's."""
        return self.encode_buffer(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]))


def _cut(buf: np.ndarray, offsets: np.ndarray, at: int, end: int, stop: int) -> int:
    """The last white space or document bound in ``at..end``; the next one after it where there is none."""
    edge = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
    space = np.flatnonzero(_CLASS[buf[at:end]] == _SPACE)
    best = max(edge, at + int(space[-1]) if len(space) else at)
    while best <= at and end < stop:
        space = np.flatnonzero(_CLASS[buf[end: end + W.SLICE_BYTES]] == _SPACE)
        edge = int(offsets[np.searchsorted(offsets, end)])
        beyond = min(end + W.SLICE_BYTES, stop)
        best = min(edge, end + int(space[0]) if len(space) else beyond) if len(space) or edge <= beyond else at
        end = beyond
    return best if best > at else stop


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per Python worker."""
    return WordTokens(path)
