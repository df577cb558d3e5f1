"""Vectorised word work on Arrow text buffers, shared by the operators that run in Arrow batches.

Texts are handled as UTF-8 bytes. A table of 256 entries maps each byte to what it counts as, with 0 for
bytes between words. All hashes are 64 bits, without structure that would make unlike inputs share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; one longer text is worked on alone. Fitting on the driver takes smaller pieces.
PIECE_BYTES = 1 << 20
FIT_BYTES = 1 << 18
#: Texts worked on at once.
PIECE_ROWS = 4096

#: Masks of the first 0 to 8 bytes of a lane of eight, and spans longer than this are hashed one by one.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG_SPAN = 64


def _word_table(lower: bool = True) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[48:58] = range(48, 58)
    t[97:123] = range(97, 123)
    t[65:91] = range(97, 123) if lower else range(65, 91)
    t[128:] = range(128, 256)
    return t


#: Digits, letters in lower case and every byte of characters beyond ASCII.
WORDS = _word_table()

#: Everything but the blank and bytes 9 to 13, A-Z as a-z.
TOKENS = np.arange(256, dtype=np.uint8)
TOKENS[[9, 10, 11, 12, 13, 32, 0]] = 0
TOKENS[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes and at most ``rows`` texts: first and last row, bytes and offsets."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1), row + rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Spans:
    """Hashes and comparison of byte spans of a buffer, eight bytes at a time.

    Each lane of eight bytes goes through a bijection that mixes all bits, so spans of up to eight bytes never share a hash
    with one of the same length, and longer ones only by chance: no input has a structure that makes hashes equal. Spans
    of more than ``LONG_SPAN`` bytes take a keyed BLAKE2b.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        held = np.zeros(len(data) + 16, np.uint8)
        held[: len(data)] = data
        self.view = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))

    def _lane(self, start: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self.view[start] & _MASK[np.minimum(left, 8)]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = mix(self._lane(start, size) ^ _SIZES[np.minimum(size, LONG_SPAN)])
        for at in range(8, LONG_SPAN, 8):
            more = np.flatnonzero(size > at)
            if not len(more):
                break
            h[more] = mix(h[more] ^ self._lane(start[more] + at, size[more] - at))
        for i in np.flatnonzero(size > LONG_SPAN).tolist():
            digest = hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8, key=b"span").digest()
            h[i] = int.from_bytes(digest, "little")
        return h

    def same(self, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
        """Whether spans hold the same bytes as those that begin at ``other``."""
        size = end - start
        out = size == other_end - other
        for at in range(0, LONG_SPAN, 8):
            more = np.flatnonzero(out & (size > at))
            if not len(more):
                break
            left = size[more] - at
            out[more] = self._lane(start[more] + at, left) == self._lane(other[more] + at, left)
        for i in np.flatnonzero(out & (size > LONG_SPAN) & (start != other)).tolist():
            out[i] = bool((self.data[start[i] + LONG_SPAN : end[i]] == self.data[other[i] + LONG_SPAN : other_end[i]]).all())
        return out


_SIZES = mix(np.arange(1, LONG_SPAN + 2, dtype=np.uint64))


class Words:
    """Words of a run of texts: byte starts and ends, hashes, and each text's first word (``at``, one more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORDS):
        n = len(data)
        self.b = b = table[data]
        inside = b > 0
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        firsts = offsets[:-1]
        before[firsts[firsts < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        lasts = offsets[1:] - 1
        after[lasts[lasts >= 0]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.spans = Spans(b)
        self.hash = self.span_hash(self.start, self.end)
        self.at = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, equal for equal bytes wherever they stand."""
        return self.spans.hash(start, end)

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Texts and hashes of all runs of ``k`` words; with ``short``, fewer words make one run."""
        last = np.repeat(self.at[1:], self.count)
        i = np.arange(len(self.hash))
        keep = i + k <= last
        if short:
            keep |= i == np.repeat(self.at[:-1], self.count)
        i, last = i[keep], last[keep]
        h = np.zeros(len(i), np.uint64)
        for j in range(k):
            at = i + j
            if short:
                ok = at < last
                part = np.zeros(len(i), np.uint64)
                part[ok] = self.hash[at[ok]]
            else:
                part = self.hash[at]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + part
        return self.doc[keep], mix(h)


def rows_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each text's run in a sorted ``doc``."""
    return np.searchsorted(doc, np.arange(n + 1))


def distinct_in_text(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes sorted and without repeats inside each text."""
    at = rows_of(doc, n)
    h = h.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sum_by_text(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)
