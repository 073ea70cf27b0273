"""Token counts by dynamic programming over a trie (operator 10).

A text is cut into pre-tokens at white space (`[^\\x20\\x09-\\x0D]+`), each with
the word mark in front. A unigram model gives each piece a log-probability; a
pre-token's tokens are those of its likeliest segmentation. The distinct
pre-tokens of a batch make a trie, and each trie node holds the best forward score
of its prefix and where that segmentation's last piece begins: the dynamic program
runs once for each node, so once for each shared prefix, and a pre-token's pieces
are read from its terminal node back to the root. What ends in a node is found by
walking up only as far as some piece ends in what was passed, so the work per
character is bounded too. All nodes of a trie are walked at once, and all nodes of
one depth are scored at once, as NumPy arrays. A trie is made of pre-tokens of
MOST_NODES characters in all and gives way to the next one; a worker remembers the
pieces of the pre-tokens of documents and starts afresh beyond MOST_TERMINALS, which
bounds memory and changes no count. A pre-token of more than MOST_CHARS characters
is not put in a trie but gets arrays of its own.

The vocabulary is a public one of 32,000 pieces, read as it is; no piece is added
or taken away. The pieces' log-probabilities are fitted to the corpus: the distinct
pre-tokens of all documents are counted once, in Spark, and segmented as the public
model itself does it; the pieces are counted (a row for each piece and task, summed
in Spark) and the scores set to the pieces' smoothed shares. ROUNDS times more the
same is done with the likeliest segmentations by the scores so far, through the
trie, which is expectation-maximisation. Characters
that no piece covers cost one token for each UTF-8 byte, and all bytes share one
count. Ties go to the longer last piece.

Defined results: a null or empty text has 0 pre-tokens, 0 tokens and score 0.0;
rows with equal or null doc_id are counted each on its own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import words as W
from meshwright.llm.shared import written

MARK = "▁"
MOST_NODES = 500_000
MOST_TERMINALS = 3_000_000
MOST_CHARS = 256
#: Rounds of expectation-maximisation after the public model's own segmentation.
ROUNDS = 2
#: Bytes of text whose distinct pre-tokens are counted at once.
SLICE = 8 << 20
#: Added to each piece's count.
SMOOTHING = 0.1
COLUMNS = "n_words long, n_tokens long, score double"


class Endings:
    """What pieces end in, as a trie that is read from the end: a state for each ending, 0 for the empty one."""

    def __init__(self, endings: dict[str, int]):
        state = {"": 0} | {x: i for i, x in enumerate(sorted(endings, key=len), 1)}
        steps = np.array([state[x[1:]] << 21 | ord(x[0]) for x in endings], np.int64)
        #: The number of each state's piece, and -1 where only longer pieces end so.
        self.piece = np.full(len(state), -1, np.int64)
        self.piece[[state[x] for x in endings]] = list(endings.values())
        self.bits = max(4, (4 * len(steps)).bit_length())
        #: The state of each step (state << 21 | code point) in an open hash table.
        self.steps, self.after = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, after, place = steps, np.array([state[x] for x in endings], np.int32), self._place(steps)
        while len(left):
            free = self.steps[place] < 0
            self.steps[place[free]] = left[free]
            rest = self.steps[place] != left  # of those that meet in a free place one has got it
            self.after[place[~rest]] = after[~rest]
            left, after, place = left[rest], after[rest], (place[rest] + 1) & (len(self.steps) - 1)

    def _place(self, steps: np.ndarray) -> np.ndarray:
        return ((steps.view(np.uint64) * W.U64(0x9E3779B97F4A7C15)) >> W.U64(64 - self.bits)).view(np.int64)

    def follow(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some states go on with these characters before them, and the states they go to."""
        steps = state << 21 | char
        place = self._place(steps)
        there = self.steps[place]
        on = np.flatnonzero((there != steps) & (there >= 0))
        while len(on):
            place[on] = (place[on] + 1) & (len(self.steps) - 1)
            there[on] = at = self.steps[place[on]]
            on = on[(at != steps[on]) & (at >= 0)]
        hit = np.flatnonzero(there == steps)
        return hit, self.after[place[hit]].astype(np.int64)


class Vocabulary:
    """Pieces by number with their log-probabilities; the number after the last stands for one byte of an uncovered character."""

    def __init__(self, pieces: list[str], scores: list[float], byte: float, walk: Endings | None = None):
        self.ids = {x: i for i, x in enumerate(pieces)}
        self.pieces, self.scores, self.byte = pieces, [*scores, byte], len(pieces)
        self.table = np.array(self.scores)
        #: The number of each piece, and -1 for what only longer pieces end in.
        self.endings: dict[str, int] = {}
        for x in pieces:
            for i in range(1, len(x)):
                self.endings.setdefault(x[i:], -1)
        self.endings |= self.ids
        self.walk = walk or Endings(self.endings)

    def refit(self, counts: dict[int, int]) -> Vocabulary:
        """The same pieces with the scores of their counts; the bytes' count is that of 256 pieces."""
        n = [counts.get(i, 0) + SMOOTHING for i in range(self.byte)]
        byte = counts.get(self.byte, 0) / 256 + SMOOTHING
        total = math.log(sum(n) + 256 * byte)
        return Vocabulary(self.pieces, [math.log(x) - total for x in n], math.log(byte) - total, self.walk)

    def extend(self, text: str, i: int, path, score) -> tuple[float, int, int]:
        """Best score of text[: i + 1], where its last piece begins and that piece; text[:j] has score[path[j]]."""
        best, start, piece = -math.inf, i, self.byte
        endings, scores = self.endings, self.scores
        for j in range(i, -1, -1):
            k = endings.get(text[j : i + 1])
            if k is None:
                break
            if k >= 0:
                s = score[path[j]] + scores[k]
                if s >= best:  # of equals the longer last piece
                    best, start, piece = s, j, k
        if text[i] not in self.ids:
            byte = score[path[i]] + len(text[i].encode("utf-8", "surrogatepass")) * self.scores[self.byte]
            if byte > best:
                best, start, piece = byte, i, self.byte
        return best, start, piece

    def long_pieces(self, text: str) -> list[int]:
        """The pieces of a text's likeliest segmentation, last first, without a trie."""
        score, start, piece, path = array("d", [0.0]), array("l"), array("l"), range(len(text) + 1)
        for i in range(len(text)):
            best, j, k = self.extend(text, i, path, score)
            score.append(best)
            start.append(j)
            piece.append(k)
        out, at = [], len(text)
        while at:
            k = piece[at - 1]
            out += [k] * (len(text[at - 1].encode("utf-8", "surrogatepass")) if k == self.byte else 1)
            at = start[at - 1]
        return out


class Given:
    """The public model's own segmentation of pre-tokens."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.vocabulary = Vocabulary([self.model.id_to_piece(i) for i in plain], [-math.log(len(plain) + 256)] * len(plain), -math.log(len(plain) + 256))
        #: The model's number of a piece to ours; all others are bytes.
        self.number = np.full(n, self.vocabulary.byte, np.int64)
        self.number[plain] = np.arange(len(plain))

    def lists_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of some words, one list after the other, and the lists' sizes."""
        found = self.model.encode([x[len(MARK) :] for x in words], num_threads=1)
        return self.number[[k for x in found for k in x]], np.array([len(x) for x in found], np.int64)


class Trie:
    """Nodes by number: best score of the prefix that ends there, the node where its last piece begins, that piece and how often it counts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = W.Known(MOST_TERMINALS)
        self.clear()

    def clear(self) -> None:
        self.score, self.back, self.piece, self.times = np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def insert(self, ordered: list[str], sizes: np.ndarray) -> np.ndarray:
        """Make the trie of some words in ascending order; the terminal node of each."""
        v, first = self.vocabulary, np.cumsum(sizes) - sizes
        text = np.frombuffer("".join(ordered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        depth = np.arange(len(text)) - np.repeat(first, sizes)
        # A prefix is a node of its own where the word before has another one.
        above, sizes_above = np.concatenate([[0], first[:-1]]), np.concatenate([[0], sizes[:-1]])
        same = depth < np.repeat(sizes_above, sizes)
        same[same] = text[(np.repeat(above, sizes) + depth)[same]] == text[same]
        fresh = depth >= np.repeat(np.minimum.reduceat(np.where(same, MOST_CHARS, depth), first), sizes)
        order = np.argsort(depth.astype(np.uint16), kind="stable")
        node = np.empty(len(text), np.int64)
        node[order] = np.cumsum(fresh[order])
        at = order[fresh[order]]  # the characters of the nodes 1, 2, ..., by depth
        levels = np.searchsorted(depth[at], np.arange(depth.max() + 2)) + 1
        # What ends in each node: the node before it, its piece and that one's score; bytes first, then by length.
        here, position, state, found = np.arange(1, len(at) + 1), at, np.zeros(len(at), np.int64), []
        uncovered = np.ones(len(at) + 1, bool)
        uncovered[0] = False
        for n in range(1, len(text) + 1):
            hit, state = v.walk.follow(state, text[position - (n - 1)])
            here, position = here[hit], position[hit]
            piece = v.walk.piece[state]
            whole, more = np.flatnonzero(piece >= 0), depth[position] >= n
            found.append((here[whole], np.where(more[whole], node[position[whole] - n], 0), piece[whole]))
            if n == 1:
                uncovered[here[whole]] = False
            here, position, state = here[more], position[more], state[more]
            if not len(here):
                break
        odd = np.flatnonzero(uncovered)
        char = text[at[odd - 1]]
        times = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        found.insert(0, (odd, np.where(depth[at[odd - 1]] > 0, node[at[odd - 1] - 1], 0), np.full(len(odd), v.byte)))
        ends = np.cumsum(sum(np.bincount(x[0], minlength=len(at) + 1) for x in found))
        begins, filled = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], ends[:-1]])
        start, pieces, gain = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int64), np.empty(ends[-1])
        for k, (nodes, before, piece) in enumerate(found):
            place = filled[nodes]
            start[place], pieces[place], gain[place] = before, piece, v.table[piece] if k else times * v.table[piece]
            filled[nodes] += 1
        self.score, self.back, self.piece, self.times = np.zeros(len(at) + 1), np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64), np.ones(len(at) + 1, np.int64)
        for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            a, b, own = begins[lo], ends[hi - 1], slice(lo, hi)
            score = self.score[start[a:b]] + gain[a:b]
            best = np.maximum.reduceat(score, begins[own] - a)
            equal = score == np.repeat(best, ends[own] - begins[own])
            chosen = a + np.maximum.reduceat(np.where(equal, np.arange(b - a), -1), begins[own] - a)  # of equals the longer last piece
            self.score[own], self.back[own], self.piece[own] = best, start[chosen], pieces[chosen]
        self.times[odd] = np.where(self.piece[odd] == v.byte, times, 1)
        return node[first + sizes - 1]

    def pieces(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces from some terminal nodes back to the root, one list after the other, and the lists' sizes."""
        which, nodes, passed = np.arange(len(ends)), ends, []
        while len(nodes):
            passed.append((which, nodes))
            nodes = self.back[nodes]
            which, nodes = which[nodes > 0], nodes[nodes > 0]
        n = np.bincount(np.concatenate([x[0] for x in passed]), minlength=len(ends))
        first, path = np.cumsum(n) - n, np.empty(n.sum(), np.int64)
        for k, (which, nodes) in enumerate(passed):
            path[first[which] + k] = nodes
        return np.repeat(self.piece[path], self.times[path]), np.add.reduceat(self.times[path], first)

    def lists_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of some words, last first, one list after the other, and the lists' sizes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = sorted(np.flatnonzero(size <= MOST_CHARS).tolist(), key=words.__getitem__)
        long = np.flatnonzero(size > MOST_CHARS).tolist()
        found = [(np.array(x, np.int64), np.array([len(x)])) for x in (self.vocabulary.long_pieces(words[i]) for i in long)]
        bounds = np.concatenate([[0], np.cumsum(size[short])])
        for i, j in W.slices(bounds, MOST_NODES):
            found.append(self.pieces(self.insert([words[k] for k in short[i:j]], size[short[i:j]])))
        flat, sizes = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        at = np.empty(len(words), np.int64)
        at[np.array(long + short, np.int64)] = np.arange(len(words))
        return gathered(flat, (np.cumsum(sizes) - sizes)[at], sizes[at]), sizes[at]

    def slots_of(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Slots in `known` of distinct pre-tokens by ascending hash; `text_of` gives the texts at some positions."""
        return self.known.slots_of(hashes, lambda new: self.lists_of(text_of(new)))


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lists within `flat`, one after the other."""
    return flat[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]


def look_up(data: np.ndarray, bounds: np.ndarray, own: Trie) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """The pre-tokens of a batch, the slots of the distinct ones' pieces, and which of these each one is."""
    found = W.find_words(data, bounds, lower=False)
    if not len(found.hashes):
        return found, np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, first, index = np.unique(found.hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()

    def text_of(new: np.ndarray) -> list[str]:
        return [MARK + raw[s:e].decode("utf-8", "replace") for s, e in zip(found.starts[first[new]].tolist(), found.ends[first[new]].tolist(), strict=True)]

    return found, own.slots_of(distinct, text_of), index


def pieces_of(slots: np.ndarray, own: Trie) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of some slots, one list after the other, and the lists' sizes."""
    start, size = own.known.at[slots], own.known.at[slots + 1] - own.known.at[slots]
    return gathered(own.known.flat, start, size), size


def count_rows(data: np.ndarray, bounds: np.ndarray, own: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, tokens and scores of each row of a batch."""
    n = len(bounds) - 1
    found, slots, index = look_up(data, bounds, own)
    if not len(slots):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    pieces, size = pieces_of(slots, own)
    scores = own.vocabulary.table[pieces]
    best = np.add.reduceat(scores, np.cumsum(size) - size)
    return np.diff(found.first), np.bincount(found.rows, size[index], n).astype(np.int64), np.bincount(found.rows, best[index], n)


_made: dict[str, Trie | Given] = {}


def made(key: str, make) -> Trie | Given:
    """What the worker remembers for one model; what it has of other models is given up."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: the distinct pre-tokens of all texts (without the mark) and how often each occurs."""

    def run(batches):
        for b in batches:
            data, bounds = W.text_bytes(b.column(0))
            for i, j in W.slices(bounds, SLICE):
                part = data[bounds[i] : bounds[j]]
                found = W.find_words(part, bounds[i : j + 1] - bounds[i], lower=False)
                _, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
                raw = part.tobytes()
                words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(W.tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def weighted_counts(words: DataFrame, segment, pieces: int) -> dict[int, int]:
    """How often each piece occurs in the segmentations of some pre-tokens (word, n), each n times; the driver gets a row for each piece.

    `segment` makes what segments, on a worker.
    """
    key = uuid.uuid4().hex

    def run(batches):
        own, total = made(key, segment), np.zeros(pieces + 1)
        for b in batches:
            times = b.column(1).to_numpy()
            for i, j in W.slices(W.text_bytes(b.column(0))[1]):
                found, size = own.lists_of([MARK + x for x in b.column(0).slice(i, j - i).to_pylist()])
                total += np.bincount(found, np.repeat(times[i:j], size), len(total))  # whole numbers below 2**53
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64), pa.int64())], names=["piece", "n"])

    found = words.select("word", "n").mapInArrow(W.tidied(run), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return {x["piece"]: x["n"] for x in found.collect()}


def piece_counts(docs: DataFrame, segment, pieces: int) -> dict[int, int]:
    """How often each piece occurs in the segmentations of all texts."""
    return weighted_counts(word_counts(docs), segment, pieces)


def fit(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", rounds: int = ROUNDS) -> Vocabulary:
    """The vocabulary's pieces with scores fitted to `docs`: texts are read once, the rounds go over the distinct pre-tokens."""
    model, words = Given(vocabulary).vocabulary, written(word_counts(docs), "pretokens")
    model = model.refit(weighted_counts(words, lambda: Given(vocabulary), model.byte))
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)
        model = model.refit(weighted_counts(words, lambda sent=sent: Trie(sent.value), model.byte))
    return model


def count(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", rounds: int = ROUNDS) -> DataFrame:
    """doc_id and COLUMNS of every row of `docs` (doc_id, text, ...)."""
    sent, key = docs.sparkSession.sparkContext.broadcast(fit(docs, vocabulary, rounds)), uuid.uuid4().hex

    def run(batches):
        own = made(key, lambda: Trie(sent.value))
        for b in batches:
            data, bounds = W.text_bytes(b.column(1))
            for i, j in W.slices(bounds):
                words, tokens, score = count_rows(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], own)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_words", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(W.tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {COLUMNS}")
