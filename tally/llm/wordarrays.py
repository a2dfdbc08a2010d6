"""Words of Arrow text columns as arrays: where they stand and a 64-bit hash of each, without a string per word.

A word's hash is a polynomial of its bytes, taken from running sums over a block of text: with
``s[i]`` the sum of ``value(byte j) * base**j`` for ``j < i``, the word from ``a`` to ``b`` is
``(s[b] - s[a]) / base**a`` modulo 2**64, which an odd base allows. Bytes are first given random
values, and the result is mixed with the length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tally.llm.common import mixed

_BLOCK = 1 << 17
_BASE = 0xD1342543DE82EF95 | 3
_RANDOM = np.random.default_rng(20240501)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True
# Space and the control characters 9 to 13 separate words; all are single bytes of UTF-8.
SPACES = (32, 9, 10, 11, 12, 13)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_BASE, -1, 1 << 64)
_POW, _INV = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


@dataclass
class WordArrays:
    """All words of a column: ``row`` they stand in, byte range, hash; ``first[k]`` is the first word of row ``k``."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "surrogatepass")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins and the last ends; null is empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def sequence_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _VALUES) -> np.ndarray:
    """Hashes of the stretches ``start`` to ``end`` (ascending, not crossing) of byte values."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _BLOCK - 1, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        power, inverse = (_POW, _INV) if b - a < _BLOCK else (_powers(_BASE, b - a + 1), _powers(_INVERSE, b - a + 1))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[values[a:b]] * power[: b - a], out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * inverse[s]
        lo = hi
    return mixed(out + (end - start).astype(np.uint64) * _MUL)


def word_arrays(column: pa.Array, lower: bool = True, spaces: tuple[int, ...] = SPACES, stops: bool = False) -> WordArrays:
    """The words of every row; bytes A-Z count as a-z for the hashes on request.

    With ``stops``, a last full stop or comma after an ASCII letter or digit is a word of its own.
    """
    data, at = text_bytes(column)
    separates = np.zeros(256, bool)
    separates[list(spaces)] = True
    n = len(data)
    gap = separates[data]
    opens, closes = ~gap, ~gap
    # A word begins after a gap or with its row, and ends before a gap or with its row.
    inner = at[(at > 0) & (at < n)]
    after_gap = np.ones(n, bool)
    after_gap[1:] = gap[:-1]
    after_gap[inner] = True
    before_gap = np.ones(n, bool)
    before_gap[:-1] = gap[1:]
    before_gap[inner - 1] = True
    start = np.flatnonzero(opens & after_gap)
    end = np.flatnonzero(closes & before_gap) + 1
    if stops:
        last = end - 1
        cut = (end - start > 1) & np.isin(data[last], (44, 46)) & _PLAIN[data[np.maximum(last - 1, 0)]]
        place = np.flatnonzero(cut) + 1
        start, end = np.insert(start, place, last[cut]), np.insert(np.where(cut, last, end), place, end[cut])
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    hashes = sequence_hashes(_LOWER[data] if lower else data, start, end)
    return WordArrays(data, row, start, end, hashes, first)


_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 48, 65, 97, 97


def shape_hashes(words: WordArrays) -> np.ndarray:
    """A hash of each word's shape: capitals, digits, other letters and each mark, with runs cut to one, of marks to two."""
    kind = _KIND[words.data]
    n = len(kind)
    marks = ~np.isin(kind, (48, 65, 97))
    keep = np.ones(n, bool)
    keep[1:] = kind[1:] != kind[:-1]
    again = np.zeros(n, bool)
    again[1:] = marks[1:] & ~keep[1:] & keep[:-1]
    keep |= again
    keep[words.start] = True
    rank = np.concatenate([[0], np.cumsum(keep)])
    return sequence_hashes(kind[keep], rank[words.start], rank[words.end])


def window_hashes(words: WordArrays, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word windows of every row, and where each row's begin and the last end.

    A row with fewer words has one window of all of them, one without words has none.
    """
    h, n = words.hashes, words.counts()
    whole = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        whole = mixed(whole * _MUL + h[i : i + len(whole)])
    size = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), np.uint64)
    long = np.flatnonzero(n >= width)
    # Of the windows that begin at a word, those that stay inside its row.
    inside = np.zeros(len(h), bool)
    if len(whole):
        inside[: len(whole)] = words.row[: len(whole)] == words.row[width - 1 :]
    target = np.ones(len(out), bool)
    for k in np.flatnonzero((n > 0) & (n < width)):
        value = np.zeros(1, np.uint64)
        for x in h[words.first[k] : words.first[k + 1]]:
            value = mixed(value * _MUL + x)
        out[at[k]] = value[0] ^ np.uint64(n[k])
        target[at[k]] = False
    if len(long):
        out[target] = whole[inside[: len(whole)]]
    return out, at


class HashTable:
    """Place of 64-bit keys in a list, by open addressing; ``find`` gives -1 for keys that are not in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.mask = (1 << max(4, int(2 * len(keys)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        at, wait = self._home(self.keys), np.arange(len(keys), dtype=np.int32)
        while len(wait):
            free = self.slots[at] < 0
            self.slots[at[free]] = wait[free]
            lost = self.slots[at] != wait
            wait, at = wait[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) & np.uint64(self.mask)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        at, open_ = self._home(wanted), np.arange(len(wanted))
        while len(open_):
            slot = self.slots[at]
            used = slot >= 0
            hit = used & (self.keys[np.maximum(slot, 0)] == wanted[open_])
            out[open_[hit]] = slot[hit]
            go = used & ~hit
            open_, at = open_[go], (at[go] + 1) & self.mask
        return out
