"""Packing by Karmarkar-Karp multiway differencing (operator 4).

Of each document's ids full windows stand alone; the rest, fewer ids than a
window, is one piece. The pieces of a block are put into k windows by multiway
differencing: partial partitions lie in a heap by the spread of their sums, the
two of the largest spread are merged with opposing order (the fullest window of
one with the emptiest of the other) until one partition is left. k starts at the
least number that could hold the block and rises whenever the capacity is
exceeded, until no window exceeds it. The windows are nearly equal then and all
have a little room, some 5 % of the ids together. Of windows beyond those that
SLACK allows, the ones of fewest pieces are taken apart, and their pieces fill
that room, cut where they don't fit whole. So all other documents stay whole, as
differencing put them, and a sequence has about one cut piece.

A block is a run of rows of one input partition, so nothing is shuffled and a
task holds one block at a time; sequence ids carry the partition's number.

Defined results: a null or empty text is the end id alone; rows with equal or
null doc_id are packed each on its own; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from meshwright.llm import tokens
from meshwright.llm import words as W

CAPACITY = 2048
#: Pieces that make a block.
BLOCK = 1024
#: Padding, as a part of the ids, up to which windows are left as they are; beyond it some are taken apart to fill the others.
SLACK = 0.005
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The members (positions in `sizes`) of k windows, by multiway differencing.

    A partial partition is the list of its non-empty windows, fullest first, as
    (sum, node); a node is a piece's position or, from len(sizes) on, a pair of nodes.
    """
    pairs: list[tuple[int, int]] = []
    n = len(sizes)
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    if k == 1:
        return [list(range(n))]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(b)
        shared = len(a) - free
        if shared > 0:  # the emptiest windows of both must share
            merged = a[:free] + b[: len(b) - shared]
            for (sa, na), (sb, nb) in zip(a[free:], reversed(b[len(b) - shared :]), strict=True):
                pairs.append((na, nb))
                merged.append((sa + sb, n + len(pairs) - 1))
        else:
            merged = a + b
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    out = []
    for _, node in heap[0][2] if heap else []:
        members, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                members.append(x)
            else:
                stack += pairs[x - n]
        out.append(sorted(members))
    return out


def fitting(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows by differencing, none over the capacity: their number rises whenever one is."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        over = [n - capacity for n in (sum(sizes[i] for i in x) for x in found) if n > capacity]
        if not over:
            return found
        # What the excess would fill, or a window for eight that exceed: few rounds even where hardly any two pieces fit together.
        k += max(-(-sum(over) // capacity), len(over) // 8, 1)


def windows(sizes: list[int], capacity: int, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Near-equal windows of at most `capacity`: (position in `sizes`, start, length) of each part in them; no size exceeds the capacity."""
    total = sum(sizes)
    most = max(1, -(-total // capacity), int(total * (1 + slack)) // capacity)
    found = sorted(fitting(sizes, capacity), key=lambda x: (-len(x), -sum(sizes[i] for i in x)))
    return fill(found[:most], [i for x in found[most:] for i in x], sizes, capacity)


def fill(found: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The windows with the pieces `loose`, longest first, put where there is most room, and cut there; all together fit."""
    out = [[(i, 0, sizes[i]) for i in x] for x in found]
    room = [(sum(sizes[i] for i in x) - capacity, k) for k, x in enumerate(found)]
    heapq.heapify(room)
    for n, i in sorted(((sizes[i], i) for i in loose), reverse=True):
        at = 0
        while at < n:
            free, k = heapq.heappop(room)
            part = min(n - at, -free)
            if part:
                out[k].append((i, at, part))
            at += part
            if free + part < 0:
                heapq.heappush(room, (free + part, k))
    return out


class Block:
    """Pieces whose windows are still to be found: (row's doc_id, start, ids, doc_tokens)."""

    def __init__(self, prefix: int, with_ids: bool = False):
        self.with_ids = with_ids
        self.pieces: list[tuple] = []
        self.next_sequence = prefix << 32
        self.out: list[tuple] = []

    def _emit(self, piece: tuple, at: int, n: int, offset: int) -> None:
        doc_id, start, ids, total = piece
        part = ids[at : at + n]
        self.out.append((doc_id, start + at, n, zlib.crc32(part.tobytes()), total, self.next_sequence, offset, *((part,) if self.with_ids else ())))

    def add(self, doc_id, ids: np.ndarray, capacity: int) -> None:
        whole = (doc_id, 0, ids, len(ids))
        full = len(ids) // capacity * capacity
        for at in range(0, full, capacity):
            self._emit(whole, at, capacity, 0)
            self.next_sequence += 1
        if full < len(ids):
            self.pieces.append((doc_id, full, ids[full:], len(ids)))

    def close(self, capacity: int) -> None:
        for parts in windows([len(x[2]) for x in self.pieces], capacity):
            offset = 0
            for i, at, n in parts:
                self._emit(self.pieces[i], at, n, offset)
                offset += n
            self.next_sequence += bool(parts)
        self.pieces = []


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """One row for each piece of the ids of `docs` (doc_id, text, ...): doc_id, COLUMNS and, `with_ids`, the ids themselves.

    A sequence is its pieces by offset.
    """

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches):
        path = public_tokenizers.path(vocabulary)
        own = Block(TaskContext.get().partitionId(), with_ids)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, ids, bounds in tokens.encoded(b.column(1), path):
                ids = ids.astype("<u4")
                for i in range(len(bounds) - 1):
                    own.add(doc_ids[first + i], ids[bounds[i] : bounds[i + 1]], capacity)
                    if len(own.pieces) >= block:
                        own.close(capacity)
                if own.out:
                    yield rows(own.out)
                    own.out = []
        own.close(capacity)
        if own.out:
            yield rows(own.out)

    id_type = docs.select("doc_id").schema[0]
    from pyspark.sql.pandas.types import to_arrow_type

    columns = COLUMNS + ", ids array<int>" * with_ids
    types = [to_arrow_type(id_type.dataType), *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["doc_id", *(x.split()[0] for x in columns.split(", "))]
    return docs.select("doc_id", "text").mapInArrow(W.tidied(run), f"doc_id {id_type.dataType.simpleString()}, {columns}")
