"""Ids of whole texts by the tokenizers library, piece by piece with a cache.

The vocabulary's normalizer and pre-tokenizer treat the parts of a text between
white space apart from each other, so the ids of a text are the ids of its
parts in a row (a vocabulary file that says otherwise goes through the library
text by text). A part of printable ASCII (without apostrophes and special
tokens) and Latin-1 letters is cut into runs of letters, single digits and runs
of other characters, as the vocabulary's own pattern cuts it after lower-casing,
and each distinct piece goes through the library's BPE model once; any other
part goes through the library's whole pipeline. `encode_rows` gives what
encoding each whole text would give; a test holds the two against each other.
Pieces are found and told apart by 64-bit hashes, a batch of bytes at a time.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from meshwright.llm import words as W

END = 1
#: Pieces that a worker remembers; when there are more it starts afresh.
REMEMBERED = 1_000_000

LETTER, DIGIT, MARK, ODD = 1, 2, 3, 4
CLASS = np.full(256, ODD, np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = LETTER
CLASS[0x61:0x7B] = LETTER
CLASS[0x27] = ODD
CLASS[W.SPACE] = 0


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def find_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the pieces, and which are odd parts left as they are."""
    kind, low = CLASS[data], W.LOWER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3)
    second = data[wide + 1]
    letter = (second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)
    kind[wide[letter]] = LETTER
    kind[wide[letter] + 1] = LETTER
    upper = wide[letter & (second < 0x9F)] + 1
    low[upper] += 0x20
    kind[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = ODD  # special tokens begin with <|
    starts, ends, _ = W.word_spans(data, bounds)
    strange = np.concatenate([[0], np.cumsum(kind == ODD)])
    strange = strange[ends] > strange[starts]
    if strange.any():
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[strange]] += 1
        inside[ends[strange]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        kind[inside] = ODD
        low[inside] = data[inside]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begins[bounds] = True
    begins[-1] = True
    cuts = np.flatnonzero(begins)
    if cuts[0]:
        cuts = np.concatenate([[0], cuts])
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return low, starts, ends, kind[starts] == ODD


#: What a vocabulary file must say for its texts to be cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """One vocabulary file and the ids of the pieces seen so far."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        own = self.whole
        said = [None if x is None else json.loads(x.__getstate__()) for x in (own.normalizer, own.pre_tokenizer, own.post_processor)]
        #: Whether texts may be cut here; special tokens must begin as `find_pieces` takes them to.
        self.by_pieces = said == [NORMALIZER, PRE_TOKENIZER, None] and all(x.content.startswith("<|") for x in own.get_added_tokens_decoder().values())
        self.model = self.whole.model
        self.symbols = byte_symbols()
        self.known = W.Known(remembered)
        W.tidy()

    def _ids(self, piece: bytes, odd: bool) -> list[int]:
        if odd:
            return self.whole.encode(piece.decode(), add_special_tokens=False).ids
        return [x.id for x in self.model.tokenize("".join([self.symbols[b] for b in piece]))]

    def encode_bytes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all rows one after the other, and the n + 1 bounds of the rows."""
        if not self.by_pieces:
            raw = data.tobytes()
            found = [self.whole.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return np.array([x for ids in found for x in ids], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        low, starts, ends, odd = find_pieces(data, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        hashes = W.span_hashes(low, starts, ends)
        hashes[odd] ^= np.uint64(0xA0761D6478BD642F)
        distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)

        def lists_of(new: np.ndarray) -> tuple[list[int], list[int]]:
            at, raw = first[new], low.tobytes()
            found = [self._ids(raw[s:e], whole) for s, e, whole in zip(starts[at].tolist(), ends[at].tolist(), odd[at].tolist(), strict=True)]
            return [x for ids in found for x in ids], [len(x) for x in found]

        slot = self.known.slots_of(distinct, lists_of)[index]
        start, size = self.known.at[slot], self.known.at[slot + 1] - self.known.at[slot]
        stops = np.cumsum(size)
        ids = self.known.flat[np.arange(stops[-1]) + np.repeat(start - (stops - size), size)]
        return ids, np.concatenate([[0], stops])[np.searchsorted(starts, bounds)]

    def encode_rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_bytes(*W.text_bytes(pa.array(texts, pa.string())))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str):
    """Runs of rows of a text column (null: empty): first row, their ids each with END behind, and the bounds."""
    data, bounds = W.text_bytes(column)
    for i, j in W.slices(bounds):
        ids, at = encoder(path).encode_bytes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        yield i, np.insert(ids, at[1:], np.uint32(END)), at + np.arange(len(at))
