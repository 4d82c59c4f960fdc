"""Whole columns of texts cut into words and hashed with numpy, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text stands alone.
SLICE_BYTES = 2_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S33, _S29 = np.uint64(33), np.uint64(29)
#: Mask that keeps the first k of eight little-endian bytes.
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

#: Separators of white-space words, `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of item words, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(97, 123)]] = False
#: Byte map that lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; nothing stands behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S33
    return h


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first row, texts) of about ``limit`` bytes; nulls become empty texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, pc.fill_null(texts.slice(at, stop - at).cast(pa.large_string()), "")
        at = stop


class Words:
    """Words of the rows of one slice.

    ``start``/``length``: byte range in ``data``; ``row_end[r]``: number of words up to row r
    included; ``hash``: 64 bits of each word's bytes.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray, lower: bool):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        if lower:
            data = LOWER[data]
        self.data, self.offset = data, offsets - offsets[0]
        inside = ~separators[data]
        # a word ends where its row ends, whatever follows
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(data) else np.zeros(0, np.int64)
        cut = self.offset[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[inside[cut] & inside[cut - 1]]
        bounds = np.concatenate([[0] if len(data) and inside[0] else [], edge, cut, cut, [len(data)] if len(data) and inside[-1] else []]).astype(np.int64)
        if len(cut):
            bounds.sort(kind="stable")
        self.start, stop = bounds[0::2], bounds[1::2]
        self.length = stop - self.start
        self.row_end = np.searchsorted(self.start, self.offset[1:])
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        eight = eights(self.data)
        h = self.length.astype(np.uint64) * _SEED
        live, at, left = None, self.start, self.length
        while len(at):
            piece = eight[at] & KEEP[np.minimum(left, 8)]
            if live is None:
                h = mix(h ^ piece)
            else:
                h[live] = mix((h[live] + _STEP) ^ piece)
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            at, left = at[more] + 8, left[more] - 8
        return h

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.row_end)), np.diff(self.row_end, prepend=0))

    def counts(self) -> np.ndarray:
        return np.diff(self.row_end, prepend=0)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a row, and its row.

    A row of fewer words, but some, gives its whole sequence as one.
    """
    n = words.counts()
    first = words.row_end - n
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)
    have = np.minimum(n, size)[row]
    h = have.astype(np.uint64) * _STEP
    for k in range(size):
        more = have > k
        if more.all():
            h = mix(h ^ words.hash[at + k]) + _SEED
        else:
            h[more] = mix(h[more] ^ words.hash[at[more] + k]) + _SEED
    return h, row


class Table:
    """Open-addressing table from 64-bit hashes to places, probed for whole arrays at once."""

    def __init__(self, entries: int):
        self.bits = max(10, int(2 * entries).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.places = np.zeros(1 << self.bits, np.int32)
        self.used = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for unknown ones."""
        h = np.maximum(hashes, np.uint64(1))
        slot = self._slot(h)
        key = self.keys[slot]
        out = np.where(key == h, self.places[slot], -1).astype(np.int64)
        live = np.flatnonzero((key != h) & (key != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[live]]
            hit = key == h[live]
            out[live[hit]] = self.places[slot[live[hit]]]
            live = live[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Put in distinct hashes that are not there yet."""
        h = np.maximum(hashes, np.uint64(1))
        slot = self._slot(h)
        live = np.arange(len(h))
        while len(live):
            free = live[self.keys[slot[live]] == 0]
            self.keys[slot[free]] = h[free]  # of several for one slot the last one stays
            own = free[self.keys[slot[free]] == h[free]]
            self.places[slot[own]] = places[own]
            live = live[self.keys[slot[live]] != h[live]]
            slot[live] = (slot[live] + 1) & (len(self.keys) - 1)
        self.used += len(h)
