"""Quality rules: repetition counts and compression bands (operator 9).

Fixed rules count words, symbols, repeated lines and words in repeated 8-word
windows. The method's verdict comes from zstandard ratios (raw bytes by
compressed bytes) of the whole text and of fixed chunks of it: text that
compresses far better than prose repeats itself, text that hardly compresses is
noise. Short texts compress less, so each length class has its own band; the rest
after the last full chunk is judged by its length's. Each chunk counts by its bytes.

Defined results: a null or empty text has no words, all counts 0, ratio 1.0 and
is not kept; rows with equal or null doc_id are judged each on its own; other
columns of the input are passed through by `filter_documents` and ignored by
`measure`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from meshwright.llm import words as W

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Fixed columns of a result, after doc_id.
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_ratio_low double, chunk_ratio_high double"


@dataclass(frozen=True)
class Bands:
    """Accepted zstandard ratios. A row of `whole`: texts of fewer bytes than this; least and most ratio.

    The limits were set on invented prose in four languages and on random words of 3
    to 10 printable characters, or letters and digits. Measured at level 3, most for
    noise of so many bytes and least for prose labelled good of that class: 127 bytes
    1.01 and 1.14, 191 1.08 and 1.15, 255 1.15 and 1.21, 511 1.24 and 1.35, 1023 1.32
    and 1.47, 2047 1.36 and 1.73, 8191 1.39 and 1.92, above 1.39 and 2.22; in chunks of
    4096 bytes 1.38 and 2.07.
    Random letters of one case reach 1.71 and can't be told from prose of under 2 KB, so no
    limit aims at them. A text whose lines recur reaches 5 and more.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 1.04, 2.8),
        (192, 1.09, 2.8),
        (256, 1.16, 2.8),
        (512, 1.25, 3.5),
        (1024, 1.38, 3.5),
        (2048, 1.52, 4.0),
        (8192, 1.6, 4.0),
        (float("inf"), 1.6, 4.5),
    )
    chunk: tuple[float, float] = (1.6, 6.0)
    chunk_bytes: int = 4096
    #: The part of the text, in bytes of its chunks, that may lie outside the band.
    loose: float = 0.2
    level: int = 3


def word_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the fixed rules for each row of a batch."""
    n = len(bounds) - 1
    found = W.find_words(data, bounds, lower=False)
    rows = found.rows
    out = {"n_words": np.diff(found.first)}

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])

    out["word_chars"] = per_row(~W.SPACE[data] & ~W.CONTINUES[data])
    out["n_symbols"] = per_row(SYMBOLS[data])

    # Lines: cut at each \n and at the rows' bounds; a row of n newlines has n + 1 lines.
    newlines = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], newlines + 1]), kind="stable")
    ends = np.sort(np.concatenate([newlines, bounds[1:]]), kind="stable")
    line_row = np.repeat(np.arange(n), per_row(data == 10) + 1)
    filled = np.concatenate([[0], np.cumsum(~W.SPACE[data])])
    real = filled[ends] > filled[starts]
    starts, ends, line_row = starts[real], ends[real], line_row[real]
    keys = W.mix(W.span_hashes(data, starts, ends) ^ W.mix(line_row.astype(np.uint64) + np.uint64(1)))
    _, firsts = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[firsts] = False
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)

    # Windows of 8 words inside one row; those found twice mark their words.
    keys = W.windows(found.hashes, 8)
    inside = np.flatnonzero(rows[: len(keys)] == rows[7:]) if len(keys) else np.zeros(0, np.int64)
    keys = W.mix(keys[inside] ^ W.mix(rows[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = inside[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(keys) else inside
    marks = np.zeros(len(rows) + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + 8, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(marks)[:-1] > 0], minlength=n)
    return out


def ratios(text: memoryview, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, float, float, float]:
    """The ratio of the whole text, the least and greatest of its full chunks, and the part of it in chunks outside the band."""
    if not len(text):
        return 1.0, 1.0, 1.0, 0.0
    whole = len(text) / len(compressor.compress(text))
    if len(text) <= bands.chunk_bytes:
        return whole, whole, whole, 0.0
    parts = [text[i : i + bands.chunk_bytes] for i in range(0, len(text), bands.chunk_bytes)]
    each = [len(x) / len(compressor.compress(x)) for x in parts]
    low, high = bands.chunk
    outside = sum(len(x) for x, y in zip(parts, each, strict=True) if not (low if len(x) == bands.chunk_bytes else min(low, band(len(x), bands)[0])) <= y <= high)
    full = each[: len(text) // bands.chunk_bytes]
    return whole, min(full), max(full), outside / len(text)


def band(size: int, bands: Bands) -> tuple[float, float]:
    """Least and most ratio of a whole text of so many bytes."""
    return next((low, high) for most, low, high in bands.whole if size < most)


def accepted(size: int, found: tuple[float, float, float, float], bands: Bands) -> bool:
    whole, _, _, outside = found
    low, high = band(size, bands)
    return low <= whole <= high and outside <= bands.loose


def measure_batch(column: pa.Array, bands: Bands) -> list[pa.Array]:
    """The COLUMNS for a batch of texts."""
    data, bounds = W.text_bytes(column)
    compressor = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False)
    counts = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    found = []
    for i, j in W.slices(bounds):
        part, own = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        for k, v in word_counts(part, own).items():
            counts[k].append(v)
        view = memoryview(part)
        found += [ratios(view[own[k] : own[k + 1]], bands, compressor) for k in range(j - i)]
    counts = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in counts.items()}
    n, r = counts["n_words"], counts["n_repeat_words"]
    failed = (n < 20) | (100 * r > 30 * n)
    fine = np.array([accepted(s, x, bands) for s, x in zip(np.diff(bounds), found, strict=True)], bool)
    return [*(pa.array(v, pa.int64()) for v in counts.values()), pa.array(failed), pa.array(~failed & fine), *(pa.array([x[k] for x in found], pa.float64()) for k in range(3))]


def measure(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id and COLUMNS of every row of `docs` (doc_id, text, ...)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *measure_batch(b.column(1), bands)], names=names)

    names = ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))]
    return docs.select("doc_id", "text").mapInArrow(W.tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {COLUMNS}")


def filter_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns; one pass, no shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(measure_batch(b.column(at), bands)[6])

    return docs.mapInArrow(W.tidied(run), docs.schema)
