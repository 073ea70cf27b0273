"""Words, lines and windows of whole Arrow batches as NumPy arrays.

A text is taken as its UTF-8 bytes. White space is the six ASCII characters
0x20 and 0x09-0x0D, which never occur inside a longer UTF-8 sequence, so words
can be cut at byte level without decoding anything. A span of bytes gets a
64-bit hash: spans of at most LONG bytes, as nearly all words are, eight bytes
at a time for all spans of a batch at once, each step a bijection of the bytes
read; longer ones by a seeded XXH3 over their bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Spans of more bytes are hashed one by one.
LONG = 32
SEED = 20240229
#: The low i bytes of a 64-bit word.
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each data[starts[i]:ends[i]]."""
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = (sizes.astype(np.uint64) + U64(SEED)) * U64(0xD6E8FEB86659FD93)
    long = np.flatnonzero(sizes > LONG)
    live, at, left = (np.flatnonzero(sizes <= LONG), starts, sizes) if len(long) else (np.arange(len(sizes)), starts, sizes)
    if len(long):
        at, left = at[live], left[live]
    while len(live):
        h[live] = mix((h[live] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)])) * U64(0x9FB21C651E98DF25))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(view[a:b], SEED) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 bounds of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if bounds is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(bounds, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = 1 << 20):
    """Runs of rows of about `most` bytes; a longer row is a run of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """The words of some rows: hash and byte span of each; row i has words[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row."""
    blank = SPACE[data]
    begins, stops = ~blank, ~blank
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[1:] &= blank[:-1]
    stops[:-1] &= blank[1:]
    begins[inner] = ~blank[inner]
    stops[inner - 1] = ~blank[inner - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def find_words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(bounds), np.int64))
    starts, ends, first = word_spans(data, bounds)
    return Words(span_hashes(LOWER[data] if lower else data, starts, ends), starts, ends, first)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive words (k - 1 fewer than words)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += hashes[i : i + n]
    return mix(out)


class Known:
    """Lists of numbers by 64-bit hash. Beyond `most` of them all are forgotten, which bounds memory and changes no result."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: Ascending hashes with their slots: nearly all of them, and those that came since.
        self.levels = [none, none]
        self._flat, self._at, self.n = np.zeros(1 << 10, np.uint32), np.zeros(1 << 8, np.int64), 0

    @property
    def at(self) -> np.ndarray:
        """Where each slot's list begins, and where the last one ends."""
        return self._at[: self.n + 1]

    @property
    def flat(self) -> np.ndarray:
        return self._flat[: self._at[self.n]]

    def _append(self, numbers: list[int] | np.ndarray, sizes: list[int]) -> np.ndarray:
        """The slots of some new lists."""
        n, end = self.n + len(sizes), int(self._at[self.n])
        while n + 1 > len(self._at):
            self._at = np.concatenate([self._at, np.zeros_like(self._at)])
        while end + len(numbers) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[end : end + len(numbers)] = numbers
        self._at[self.n + 1 : n + 1] = end + np.cumsum(sizes, dtype=np.int64)
        slots, self.n = np.arange(self.n, n), n
        return slots

    def slots_of(self, hashes: np.ndarray, lists_of: Callable[[np.ndarray], tuple[list[int] | np.ndarray, list[int]]]) -> np.ndarray:
        """The slots of ascending distinct hashes; `lists_of` gives the numbers, one list after the other, and the lists' sizes at some positions."""
        out = np.full(len(hashes), -1, np.int64)
        for known, slots in self.levels:
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                out[hit] = slots[place[hit]]
        new = np.flatnonzero(out < 0)
        if len(new):
            if self.n + len(new) > self.most:
                self.forget()
                new = np.arange(len(hashes))
            out[new] = self._append(*lists_of(new))
            self.levels[1] = _merged(self.levels[1], hashes[new], out[new])
            if len(self.levels[1][0]) > max(1 << 16, len(self.levels[0][0]) // 8):
                self.levels = [_merged(self.levels[0], *self.levels[1]), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        return out


def _merged(level: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(level[0], hashes)
    return np.insert(level[0], at, hashes), np.insert(level[1], at, slots)


def tidy() -> None:
    """Give the memory of finished work back to the system, which the allocators else keep for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over the batches of a partition, followed by `tidy`."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole
