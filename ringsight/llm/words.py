"""Words, hashes and Arrow buffers shared by the operators that work on Arrow batches.

A word is a run of bytes that are not ASCII white space. Since white space is one byte in UTF-8, words can be
found on the raw bytes of an Arrow string column, without decoding a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_POSITIONS = 64
_TERMS = mix(np.arange(1, 256 * _POSITIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    data = column.buffers()
    offsets = np.frombuffer(data[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if data[2] is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, so that work space does not follow the batch; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of every text. No word crosses a text border."""
    solid = ~space[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < len(buf)]
    tails = offsets[1:][offsets[1:] > 0] - 1
    opens[heads] = solid[heads]
    closes[tails] = solid[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    at = np.searchsorted(start, offsets)
    return start, end, np.diff(at)


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a sum of one random term per (byte, place), finalised with the length.

    Each block of 64 bytes after the first is mixed with its number before it is added, so that blocks in another order give another hash.
    """
    out = np.empty(len(start), U64)
    for at in range(0, len(start), 32768):  # blocks that stay in the processor's cache
        a = start[at : at + 32768]
        length = end[at : at + 32768] - a
        head = np.cumsum(length) - length
        place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(head, length)
        letters = buf[place + np.repeat(a, length)].astype(np.int64)
        terms = _TERMS[(letters << 6) | (place & 63)]
        if length.max() > _POSITIONS:
            block = np.flatnonzero((place & 63) == 0)
            number = place[block] >> 6
            terms = np.add.reduceat(terms, block)
            terms = np.where(number > 0, mix(terms + mix(number.astype(U64))), terms)
            head = np.flatnonzero(number == 0)
        out[at : at + 32768] = mix(np.add.reduceat(terms, head) + length.astype(U64))
    return out


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes."""
    out = np.zeros(max(len(h) - n + 1, 0), U64)
    for i in range(n):
        out = out * U64(0xD1342543DE82EF95) + h[i : i + len(out)]
    return mix(out)


def texts_of(buf: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    data = buf.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


class Lexicon:
    """What a tokenizer makes of words, remembered by their 64-bit hashes in flat arrays.

    ``learn`` takes new words and gives their ids one after the other, the number of ids of each, and a flag of each. A worker
    keeps ``limit`` words at most (about 40 bytes each) and then starts anew. Among that many words two share a
    hash with a chance of one in ten million.
    """

    def __init__(self, learn, limit: int = 1_000_000):
        self.learn, self.limit = learn, limit
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, U64)  # sorted
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flag = np.zeros(0, bool)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return ~known

    def _add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray, flag: np.ndarray) -> None:
        """New words, by ascending key."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(count) - count
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)
        self.flag = np.insert(self.flag, at, flag)
        self.keys = np.insert(self.keys, at, keys)

    def encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words in order, the number of ids of each word, and its flag."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        keys, where, back = np.unique(hashes(buf, start, end), return_index=True, return_inverse=True)
        new = self._missing(keys)
        if new.any() and len(self.keys) + int(new.sum()) > self.limit:
            self.reset()
            new = np.ones(len(keys), bool)
        if new.any():
            data = buf.tobytes()
            at = where[new]
            self._add(keys[new], *self.learn([data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]))
        row = np.searchsorted(self.keys, keys)
        first, count = self.first[row][back], self.count[row][back].astype(np.int64)
        before = np.cumsum(count) - count
        at = np.arange(int(count.sum()), dtype=np.int64) + np.repeat(first - before, count)
        return self.ids[at], count, self.flag[row][back]
