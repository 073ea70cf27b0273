"""Quality classifier by compression (operator 1).

Two zstandard dictionaries are built from bounded samples of labelled text, one
from good and one from bad documents. A text is cut into chunks and each chunk
is compressed with either dictionary; text like the good samples shrinks more
with theirs. The difference of the two compressed sizes, divided by the raw
size, is put through a logistic curve fitted on labelled rows that the
dictionaries have not seen, which calibrates the score.

The labelled sample is the only bounded part: `per_class` rows of either class,
those least by a hash of doc_id, half for the dictionaries and half for the
curve. Sampled texts are used whole; of the rows for a dictionary those count, in
the hash's order, whose texts come to `sample_bytes` in all, which bounds what the
driver holds. Differences for the curve are computed where the texts are. Every
text is scored whole.

Defined results: a null or empty text has the difference 0, so the score of the
curve at 0; rows with equal or null doc_id are scored each on its own; other
columns are ignored; an empty table gives an empty result; without labels of
both classes every score is the part of label 1 among those there are (0.5
without any). Labels that are null or neither 0 nor 1 are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm import words as W
from meshwright.llm.shared import written

COLUMNS = "held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Settings:
    per_class: int = 1500
    sample_bytes: int = 16 << 20
    dictionary_bytes: int = 112_640
    chunk_bytes: int = 1024
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    settings: Settings


def held_out(doc_id: Column) -> Column:
    """Rows whose label no model may see (a null doc_id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def dictionary(texts: list[bytes], settings: Settings) -> bytes:
    """A zstandard dictionary trained on the texts; raw content where there is too little to train on."""
    parts = [x[i : i + 1024] for x in texts for i in range(0, len(x), 1024)]
    parts = [x for x in parts if len(x) >= 8]
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, parts, level=settings.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-settings.dictionary_bytes :]


class Scorer:
    """A worker's compressors for one model."""

    def __init__(self, good: bytes, bad: bytes, settings: Settings):
        self.chunk = settings.chunk_bytes
        self.compressors = []
        for content in (good, bad):
            made = zstandard.ZstdCompressionDict(content) if content else None
            if made:
                made.precompute_compress(level=settings.level)
            self.compressors.append(zstandard.ZstdCompressor(level=settings.level, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: memoryview | bytes) -> float:
        """(size with the bad dictionary - size with the good one) / raw size."""
        if not len(text):
            return 0.0
        good, bad = (sum(len(c.compress(text[i : i + self.chunk])) for i in range(0, len(text), self.chunk)) for c in self.compressors)
        return (bad - good) / len(text)


def fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood, with smoothed targets; label 1 weighs `share` in all."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(y == 1, share / n1, (1 - share) / n0)
    scale = float(np.abs(x).max()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (t - p)) - 1e-4 * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return float(b[0] / scale), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows that are not held out; the driver gets the texts for two dictionaries, 2 * sample_bytes at most."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    counts = {x["quality"]: x["count"] for x in known.groupBy("quality").count().collect()}
    rank = F.xxhash64("doc_id", F.lit(7))
    picked = None
    for label in (0, 1):
        own = known.where(F.col("quality") == label).orderBy(rank, "doc_id").limit(settings.per_class)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") > 0)
    # At most 2 * per_class rows, so they can be broadcast.
    sample = written(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled")
    rows = sample.select("doc_id", "quality", F.octet_length("text").alias("size")).orderBy(rank, "doc_id").collect()
    by = {label: [x for x in rows if x["quality"] == label] for label in (0, 1)}
    if not by[0] or not by[1]:
        share = 0.5 if not by[0] and not by[1] else float(not by[0])
        return Model(b"", b"", 0.0, 30.0 * (2 * share - 1), settings)
    good, bad = (dictionary(_texts(sample, _within(by[label][::2], settings.sample_bytes)), settings) for label in (1, 0))
    scorer = Model(good, bad, 0.0, 0.0, settings)
    rest = [x["doc_id"] for label in (0, 1) for x in (by[label][1::2] or by[label])]
    found = differences(_only(sample, rest), scorer).collect()
    slope, shift = fit_curve(np.array([x["difference"] for x in found]), np.array([x["quality"] for x in found]), counts[1] / (counts[0] + counts[1]))
    return Model(good, bad, slope, shift, settings)


def _within(rows: list, most: int) -> list:
    """The ids of the first rows whose texts come to `most` bytes in all, one at least."""
    out, total = [], 0
    for x in rows:
        total += x["size"]
        if out and total > most:
            break
        out.append(x["doc_id"])
    return out


def _only(sample: DataFrame, ids: list) -> DataFrame:
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame([(x,) for x in ids], f"doc_id {dict(sample.dtypes)['doc_id']}")), "doc_id")


def _texts(sample: DataFrame, ids: list) -> list[bytes]:
    return [x["text"].encode() for x in _only(sample, ids).orderBy("doc_id").collect()]


def differences(sample: DataFrame, model: Model) -> DataFrame:
    """quality and difference of each row of `sample` (quality, text, ...)."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        scorer = Scorer(own.good, own.bad, own.settings)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.difference(x.as_py().encode()) for x in b.column(1)], pa.float64())], names=["quality", "difference"])

    return sample.select("quality", "text").mapInArrow(W.tidied(run), "quality int, difference double")


def score_batch(column: pa.Array, model: Model, scorer: Scorer) -> np.ndarray:
    data, bounds = W.text_bytes(column)
    view = memoryview(np.ascontiguousarray(data))
    x = np.array([scorer.difference(view[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)])
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and COLUMNS for every row of `docs`; the model's two dictionaries travel with the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        scorer = Scorer(own.good, own.bad, own.settings)
        for b in batches:
            p = score_batch(b.column(2), own, scorer)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    picked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return picked.mapInArrow(W.tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {COLUMNS}")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return score(docs, fit(docs, labels, settings))
