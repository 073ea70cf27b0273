"""Length-delimited binary records of token ids (operator 5).

A record file is a run of frames, all numbers little-endian:

    uint64 length of the payload | uint32 masked CRC of these 8 bytes
    payload | uint32 masked CRC of the payload | one line feed

A payload is int64 doc_id (null: -2**63), uint8 id width (2 or 4 bytes), then
the ids. Masking rotates a CRC-32 right by 15 bits and adds 0xA282EAD8, so that
a checksum stored in checksummed data doesn't look like data of its own. Files
are written through Spark's text sink with one frame a row, whose line end is
the frame's last byte: any store that Spark can write will do. Documents
are dealt to files by ranges of doc_id (and of a hash of the text, so that equal
ids can be dealt too) and lie in ascending order (null first). There are as many
files as the texts have FILE_BYTES, so a file's size doesn't grow with the input.

The index is a Parquet table with a row for each frame: file, position in the
file, byte offset and length, doc_id, ids, ids before it in the file, and the ids'
CRC-32. `read` reads all files in order, `fetch` the frames of any index rows at
their offsets, and `Seeker` single frames, seeking in the file; `shuffled` gives
the index rows in an order fixed by a seed. Every frame read is verified, both
checksums and against the index; the first fault raises an error.

Defined results: a null or empty text is the end id alone; rows with equal
doc_id are records of their own, in the order of their texts' hashes; other
columns are ignored; an empty table makes an empty index and an empty result; a
doc_id of another than an integer type raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm import tokens
from meshwright.llm import words as W
from meshwright.llm.shared import cut, scratch

NULL_ID = -(1 << 63)
HEAD, TAIL, INNER = struct.Struct("<QI"), struct.Struct("<IB"), struct.Struct("<qB")
LINE_FEED = 10
INDEX = "file string, position long, byte_offset long, byte_length long, doc_id long, n_tokens long, ids_before long, ids_crc32 long"
NAMES = [x.split()[0] for x in INDEX.split(", ")]
#: Bytes of text that go to one file.
FILE_BYTES = 32 << 20


class BadRecord(ValueError):
    """A frame that can't be read: cut short, or a checksum that doesn't hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = INNER.pack(NULL_ID if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + TAIL.pack(masked(payload), LINE_FEED)


def frames(data: bytes | memoryview, at: int = 0, most: int | None = None) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Byte offset and length, doc_id and ids of the frames from byte `at` on, verified."""
    data = memoryview(data)
    while at < len(data) and most != 0:
        if at + HEAD.size > len(data):
            raise BadRecord(f"byte {at}: cut short")
        length, crc = HEAD.unpack_from(data, at)
        if masked(bytes(data[at : at + 8])) != crc:
            raise BadRecord(f"byte {at}: the length's checksum doesn't hold")
        end = at + HEAD.size + length
        if length < INNER.size or end + TAIL.size > len(data):
            raise BadRecord(f"byte {at}: cut short")
        payload = bytes(data[at + HEAD.size : end])
        if TAIL.unpack_from(data, end) != (masked(payload), LINE_FEED):
            raise BadRecord(f"byte {at}: the payload's checksum doesn't hold")
        doc_id, width = INNER.unpack_from(payload)
        yield at, end + TAIL.size - at, None if doc_id == NULL_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=INNER.size).astype("<u4")
        at = end + TAIL.size
        most = None if most is None else most - 1


def write(docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", files: int | None = None) -> None:
    """Encode `docs` (doc_id, text, ...) and write their record files to `folder`/records and the index to `folder`/index."""
    spark = docs.sparkSession

    def run(batches):
        path = public_tokenizers.path(vocabulary)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, ids, bounds in tokens.encoded(b.column(1), path):
                # The sink adds a frame's last byte; Spark carries bytes in a string column as they are.
                yield pa.RecordBatch.from_arrays([pa.array([frame(doc_ids[first + i], ids[bounds[i] : bounds[i + 1]])[:-1] for i in range(len(bounds) - 1)], pa.binary())], names=["frame"])

    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id must be an integer")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    if files is None:
        size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(-(-size // FILE_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // (1 << 20))), 1)
    dealt = picked.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(W.tidied(run), "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{folder}/records")
    scan(spark, f"{folder}/records").write.parquet(f"{folder}/index")


def _rows(fields: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*fields, strict=True), kinds, strict=True)], names=NAMES)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """An INDEX row for each frame of the record files in `folder`, every checksum verified."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py().rpartition("/")[2]
                out, before = [], 0
                for i, (at, size, doc_id, ids) in enumerate(frames(b.column(1)[k].as_buffer())):
                    out.append((name, i, at, size, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                    before += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return _files(spark, folder).mapInArrow(W.tidied(run), INDEX)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the record files; each has about FILE_BYTES at most."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def _number(file: Column) -> Column:
    """A file's place among all: names sort by it only while they have as many digits."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def _totals(index: DataFrame) -> DataFrame:
    """A row for each file: its records, ids, and a digest of its index rows."""
    return index.groupBy("file").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("total"), F.bit_xor(F.xxhash64(*NAMES)).alias("digest"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record in `folder`, read back from its files in order.

    The files' frames must be those of the index. `start` counts the ids of all
    records before it: those of its file, plus the totals of the files before (a
    row for each file only). Neither contents nor index rows are shuffled.
    """
    found = cut(scan(spark, f"{folder}/records"))
    index = spark.read.parquet(f"{folder}/index")
    said = _totals(index).select("file", *(F.col(x).alias(f"said_{x}") for x in ("records", "total", "digest")))
    totals = _totals(found).join(said, "file", "full")
    same = F.col("records").eqNullSafe(F.col("said_records")) & F.col("total").eqNullSafe(F.col("said_total")) & F.col("digest").eqNullSafe(F.col("said_digest"))
    before = Window.orderBy(_number(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    checked = totals.withColumn("total", F.when(same, F.col("total")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": not what the index says"))).cast("long")))
    starts = cut(checked.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")))
    return found.join(starts, "file").select("doc_id", (F.col("before") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")


def shuffled(spark: SparkSession, folder: str, seed: int = 0) -> DataFrame:
    """The index rows in a random order that `seed` fixes, with `rank`, the number they are sorted by."""
    index = spark.read.parquet(f"{folder}/index")
    return index.withColumn("rank", F.xxhash64("file", "position", F.lit(seed))).orderBy("rank", "file", "position")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the records of some index rows, such as a part of `shuffled`: each is read at its offset.

    Of a file only the wanted frames are looked at. A file's entries travel to it
    (no more than it has frames).
    """
    entries = wanted.groupBy("file").agg(F.collect_list(F.struct("byte_offset", "byte_length", "doc_id", "n_tokens", "ids_crc32")).alias("entries"))
    files = _files(spark, f"{folder}/records").withColumn("file", F.element_at(F.split("path", "/"), -1))

    def run(batches):
        for b in batches:
            for content, rows in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                out = [_expected(next(frames(data, x["byte_offset"], 1), None), x) for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.join(entries, "file").select("content", "entries").mapInArrow(W.tidied(run), "doc_id long, ids array<long>")


def _expected(got: tuple | None, x) -> tuple[int | None, np.ndarray]:
    if got is None or (got[1], got[2], len(got[3]), zlib.crc32(got[3].tobytes())) != (x["byte_length"], x["doc_id"], x["n_tokens"], x["ids_crc32"]):
        raise BadRecord(f"byte {x['byte_offset']}: not what the index says")
    return got[2], got[3]


class Seeker:
    """Reads single records on the driver, seeking to the offsets of index rows in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.files = self.jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def get(self, row) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of the record of an index row."""
        stream = self.files.open(self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/records/{row['file']}"))
        try:
            stream.seek(row["byte_offset"])
            data = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, row["byte_length"]))
        finally:
            stream.close()
        return _expected(next(frames(data), None), row)


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `docs` to record files and read them back."""
    folder = folder or scratch(docs.sparkSession, "records")
    write(docs, folder)
    return read(docs.sparkSession, folder)
