"""Benchmark decontamination by CGK embedding (operator 6).

The symbols are words: lower-case, without ASCII punctuation. The CGK embedding
walks through a sequence: at step j it writes the symbol under the pointer and
moves on by bit j of a random function of that symbol, so that sequences at a
small edit distance have, with good probability, embeddings at a small Hamming
distance. An item is embedded in short windows that cover it from its first word
to its last: of WINDOW words, or of LEAST_WORDS where the item is shorter than
that. Repeated bit sampling reads SAMPLES of the steps as a bucket key; the
document's windows of the same size are looked up among the items' keys, REPEATS
times with walks and steps of their own. Wherever the edits lie, some window has
at most its share of them, and a longer item has more windows to be found by, so
recall doesn't fall with length. Such a window's words are the items' own but for
those few, so windows with more foreign words than that aren't embedded at all;
and the key is built step by step, and a window is given up as soon as no item has
the key's first part, which changes nothing in what is found. Each place where a
window shares a bucket with an item's is verified: the item is aligned with the
text around it, and the edit distance in words must be at most MOST_EDITS of the
item's words. The test suite measures the recall on planted passages with that
many edits, by bands of item length from 8 to 500 words; the target is 0.9.

Items travel with the tasks in blocks of at most BLOCK_BYTES of text, one pass
over the documents for each block; the documents are neither shuffled nor kept.

Defined results: null or empty texts and items match nothing; items of fewer
than LEAST_WORDS words are found where all their words follow each other, without
edits (a very short item is thus found in every text that says it); rows with
equal or null doc_id are searched each on its own, equal items each match; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import words as W

REPEATS, SAMPLES = 32, 5
MOST_EDITS = 0.2
LEAST_WORDS = 8
#: Words of an item that are embedded at once.
WINDOW = 16
BLOCK_BYTES = 4 << 20
#: The first sampled step lies among the first so many, to keep the common walk short.
FIRST_STEPS = 6

KEEP = np.zeros(256, bool)
KEEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
KEEP[W.SPACE] = True


def normal_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of some rows, and the number of each row's first."""
    kept = KEEP[data]
    before = np.concatenate([[0], np.cumsum(kept)])
    data = W.LOWER[data[kept]]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = wide[(data[wide] < 0x9F) & (data[wide] != 0x97) & (data[wide] >= 0x80)]
    data[upper] += 0x20
    found = W.find_words(data, before[bounds], lower=False)
    return found.hashes, found.first


@dataclass
class Repeat:
    """One walk over windows of `size` words: its bits come from `salt`, `steps` are the sampled ones."""

    size: int
    salt: int
    steps: list[int]
    #: For each prefix of the sample, which low bits of a key items have.
    tables: list[np.ndarray] = field(default_factory=list)
    #: The items' keys, ascending, each with the windows (item, its first word) that have it.
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    places: list[list[tuple[int, int]]] = field(default_factory=list)


def moves(symbols: np.ndarray, salt: int, step: int) -> np.ndarray:
    """Whether the walk moves on from these words at a step."""
    x = (symbols ^ np.uint64(((salt + step) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9FB21C651E98DF25)
    return (x >> np.uint64(63)).astype(np.int64)


def slot(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of a key in a table of 2**n flags."""
    return (keys >> np.uint64(65 - len(table).bit_length())).astype(np.int64)


def extend(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return W.mix(key * np.uint64(0x9FB21C651E98DF25) + symbol)


def sample(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeat: Repeat, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of the windows at `starts`, and which windows are left.

    `ends`: where each window's text ends; beyond that, and beyond the window, lies the symbol 0.
    Windows whose key so far no item has are given up on the way where there are tables.
    """
    left, key, at, step = np.arange(len(starts)), np.zeros(len(starts), np.uint64), starts.copy(), 0
    stop, last = np.minimum(starts + repeat.size, ends), len(hashes) - 1
    for i, wanted in enumerate(repeat.steps[:upto]):
        while step < wanted:
            at += moves(hashes[np.minimum(at, last)], repeat.salt, step) * (at < stop)
            step += 1
        key = extend(key, np.where(at < stop, hashes[np.minimum(at, last)], np.uint64(0)))
        if i < len(repeat.tables):
            fits = np.flatnonzero(repeat.tables[i][slot(key, repeat.tables[i])])
            left, at, key, stop = left[fits], at[fits], key[fits], stop[fits]
    return key, left


def flags(keys: np.ndarray) -> np.ndarray:
    """A table that says of a key whether it may be among `keys`: one place in 16 or fewer is set."""
    table = np.zeros(1 << max(16, (16 * len(keys)).bit_length()), bool)
    table[slot(keys, table)] = True
    return table


class Items:
    """A block of items with their buckets."""

    def __init__(self, ids: list, texts: list[str | None], repeats: int = REPEATS, samples: int = SAMPLES, seed: int = 20):
        data, bounds = W.text_bytes(pa.array(texts, pa.string()))
        hashes, first = normal_words(data, bounds) if len(data) else (np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
        self.words = [hashes[first[i] : first[i + 1]] for i in range(len(ids))]
        self.ids = ids
        used = [i for i, x in enumerate(self.words) if len(x) >= LEAST_WORDS]
        #: Items of fewer words than are embedded, by their words' hash, for each number of words.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, x in enumerate(self.words):
            if 0 < len(x) < LEAST_WORDS:
                self.short.setdefault(len(x), {}).setdefault(int(W.windows(x, len(x))[0]), []).append(i)
        self.short_keys = {n: np.array(sorted(x), np.uint64) for n, x in self.short.items()}
        self.sizes = sorted({window_size(len(self.words[i])) for i in used})
        #: For each window size, whether a word may be one of an item that has such windows.
        self.own_words = {size: flags(np.unique(np.concatenate([self.words[i] for i in used if window_size(len(self.words[i])) == size]))) for size in self.sizes}
        rng = np.random.default_rng(seed)
        self.repeats: list[Repeat] = []
        for size in self.sizes:
            own = [i for i in used if window_size(len(self.words[i])) == size]
            flat = np.concatenate([self.words[i] for i in own])
            counts = np.array([len(self.words[i]) for i in own])
            stops = np.cumsum(counts)
            places = [(k, at) for k, n in enumerate(counts.tolist()) for at in window_places(n, size)]
            of, offset = np.array(places, np.int64).T
            starts, ends = (stops - counts)[of] + offset, stops[of]
            for _ in range(repeats):
                head = int(rng.integers(0, FIRST_STEPS))
                others = rng.choice(np.arange(head + 1, 2 * size - 2), samples - 1, replace=False)
                repeat = Repeat(size, int(rng.integers(1, 1 << 40)), [head, *sorted(int(x) for x in others)])
                keys = [sample(flat, starts, ends, repeat, n)[0] for n in range(1, samples + 1)]
                repeat.tables = [flags(np.unique(x)) for x in keys]
                buckets: dict[int, list[tuple[int, int]]] = {}
                for k, (i, at) in zip(keys[-1].tolist(), places, strict=True):
                    buckets.setdefault(k, []).append((own[i], at))
                repeat.keys = np.array(sorted(buckets), np.uint64)
                repeat.places = [buckets[k] for k in sorted(buckets)]
                self.repeats.append(repeat)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """Where the item would start, by (row, item), for each two windows that share a bucket."""
        found: dict[tuple[int, int], set[int]] = {}
        if not len(hashes):
            return {}
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ends = first[1:][row_of]
        for size in self.sizes:
            starts = likely(hashes, ends, size, self.own_words[size])
            for repeat in self.repeats:
                if repeat.size != size:
                    continue
                keys, left = sample(hashes, starts, ends[starts], repeat)
                at = np.minimum(np.searchsorted(repeat.keys, keys), len(repeat.keys) - 1)
                hit = np.flatnonzero(repeat.keys[at] == keys)
                for k, s in zip(at[hit].tolist(), starts[left[hit]].tolist(), strict=True):
                    for i, at_word in repeat.places[k]:
                        found.setdefault((int(row_of[s]), i), set()).add(s - at_word)
        for n, keys in self.short_keys.items():
            runs = W.windows(hashes, n)
            for s in np.flatnonzero(np.isin(runs, keys) & (np.arange(len(runs)) + n <= ends[: len(runs)])).tolist():
                for i in self.short[n][int(runs[s])]:
                    found.setdefault((int(row_of[s]), i), set()).add(s)
        return {k: sorted(v) for k, v in found.items()}

    def verify(self, item: int, text: np.ndarray, starts: list[int], most: float = MOST_EDITS) -> tuple[int, int, int] | None:
        """Fewest edits with which `text` (a row's words) holds the item near one of `starts`, where, and on how many words."""
        words = self.words[item]
        n = len(words)
        limit = int(n * most) if n >= LEAST_WORDS else 0
        for s in starts:
            if 0 <= s <= len(text) - n and np.array_equal(text[s : s + n], words):
                return 0, s, n
        if not limit:
            return None
        # Edits before a window, and the walk itself, put a start off its place.
        best, spread, k = None, limit + window_size(n), 0
        while k < len(starts):
            # Starts near each other are aligned at once.
            last = bisect.bisect_right(starts, starts[k] + spread) - 1
            low, high = max(0, starts[k] - spread), min(len(text), starts[last] + n + spread)
            k = last + 1
            around = text[low:high]
            if np.isin(around, words).sum() < n - limit:
                continue
            got = align(words, around, limit)
            if got and (best is None or got[0] < best[0]):
                best = (got[0], low + got[1], got[2])
        return best


def likely(hashes: np.ndarray, ends: np.ndarray, size: int, own: np.ndarray) -> np.ndarray:
    """Where windows start that have at most `spare(size)` words that no item has."""
    known = np.concatenate([[0], np.cumsum(own[slot(hashes, own)], dtype=np.int32)])
    stops = np.minimum(np.arange(len(hashes)) + size, ends)
    return np.flatnonzero(known[stops] - known[:-1] >= size - spare(size))


def spare(size: int) -> int:
    """The edits that the least edited of an item's windows may have: its share, and one for windows that overlap."""
    return int(size * MOST_EDITS) + 1


def window_size(words: int) -> int:
    """How long the windows are of an item of so many words."""
    return WINDOW if words >= WINDOW else LEAST_WORDS


def window_places(words: int, size: int) -> list[int]:
    """Where the windows start that cover an item."""
    return [*range(0, words - size, size), words - size]


def align(item, text, limit: int) -> tuple[int, int, int] | None:
    """Least edit distance of `item` to a run of `text`, with the run's start and length; None beyond `limit`.

    Of equally distant runs that end at the first such place, the one that starts first.
    """
    # Row by row over the item; each cell has the distance, above 32 bits with the start of its run.
    text, one = np.asarray(text), np.int64(1 << 32)
    steps = np.arange(len(text) + 1, dtype=np.int64) * one
    cells = np.arange(len(text) + 1, dtype=np.int64)
    for a in item:
        above, cells = cells, cells + one
        cells[1:] = np.minimum(cells[1:], above[:-1] + np.where(text == a, 0, one))
        # Words of the text that the item lacks: the least to the left, one more for each word.
        cells = np.minimum.accumulate(cells - steps) + steps
        if cells.min() >> 32 > limit:
            return None
    cost = cells >> 32
    end = int(cost.argmin())
    begin = int(cells[end] & 0xFFFFFFFF)
    return (int(cost[end]), begin, end - begin) if cost[end] <= limit else None


def matches(column: pa.Array, items: Items):
    """Row, item and (edits, start, words) of each match in a batch of texts."""
    data, bounds = W.text_bytes(column)
    for i, j in W.slices(bounds):
        hashes, first = normal_words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        for (row, item), starts in sorted(items.candidates(hashes, first).items()):
            base = int(first[row])
            hit = items.verify(item, hashes[base : first[row + 1]], [s - base for s in starts])
            if hit:
                yield i + row, item, hit


def search(docs: DataFrame, items: Items, item_type: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    doc_type = docs.select("doc_id").schema[0].dataType

    def run(batches):
        own = sent.value
        for b in batches:
            out = [(row, own.ids[item], *hit, len(own.words[item])) for row, item, hit in matches(b.column(1), own)]
            if out:
                rows, found, *numbers = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(found, kind), *(pa.array(x, pa.int64()) for x in numbers)], names=["doc_id", "item_id", "edits", "start_word", "matched_words", "item_words"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(item_type))
    return docs.select("doc_id", "text").mapInArrow(W.tidied(run), f"doc_id {doc_type.simpleString()}, item_id {item_type}, edits long, start_word long, matched_words long, item_words long")


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of at most `most` bytes of text (an item above that is a block of its own); the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for x in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        more = len(x["text"].encode())
        if texts and size + more > most:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(x["item_id"])
        texts.append(x["text"])
        size += more
    if texts:
        yield Items(ids, texts)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it holds: edits, and where.

    doc_id, item_id, edits, start_word, matched_words, item_words.
    """
    item_type = dict(benchmark.dtypes)["item_id"]
    found = [search(docs, x, item_type) for x in blocks(benchmark)]
    if not found:
        found = [search(docs, Items([], []), item_type)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def drop(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with their columns; no shuffle."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for b in batches:
                clean = [True] * b.num_rows
                for row, _, _ in matches(b.column(at), sent.value):
                    clean[row] = False
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(W.tidied(run), docs.schema)
    return docs
