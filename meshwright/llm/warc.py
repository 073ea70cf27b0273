"""Archives in the WARC format: writing, reading, and captures assembled from their records (operator 13).

Every page becomes a transaction of three records: a request, a response or
revisit, and a metadata record. The request and the metadata name the response or
revisit in WARC-Concurrent-To. Of pages with equal payloads of at least
LEAST_BYTES bytes the one with the largest page_id is a response; the others are
revisits, whose HTTP head says the full payload's length and whose block leaves
the payload out; they name the response in WARC-Refers-To.

Each record is a gzip member of its own, or several of MEMBER_BYTES where it is
longer. A member's last byte is the top byte of its length, which is zero below 16
MB, so Spark's text sink with a zero byte as its line end writes exactly such
files, to any store. Pages are dealt to files by page_id, as many as the pages
have FILE_BYTES, so a file doesn't grow with the input.

`read` takes any gzipped or plain archive: member by member, record by record,
checking lengths and payload digests; the first fault raises BadArchive.
`assemble` joins records through WARC-Concurrent-To, whichever of them carries it
and through one record in between, and gives a row for each response or revisit
with its request and metadata nested. A request or metadata record that reaches
no response is a capture without one.

Defined results: a null html is an empty payload, a null url an empty target. A
page with a null page_id is a revisit if a page with an id has its payload, else a
response of its own. Rows with equal page_id and equal payload are captures of
their own, all of the same type. Line breaks in a url are written as %0A and %0D.
Other columns are ignored; an empty table makes empty archives and no captures; a
page_id of another than an integer type raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import words as W
from meshwright.llm.shared import cut, scratch

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Bytes of pages, with PAGE_BYTES more a page, that go to one file.
FILE_BYTES, PAGE_BYTES = 32 << 20, 1 << 10
#: Bytes of a record that one gzip member holds: under 16 MB, so that its last byte is zero.
MEMBER_BYTES = 8 << 20
#: One payload in so many rows may be broadcast with its response: there are no more such payloads than this.
HOT = 1000

RECORD = "file string, byte_offset long, byte_length long, record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields map<string,string>"
PAYLOAD = "payload binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]


class BadArchive(ValueError):
    """An archive that can't be read: cut short, or a digest or a length that doesn't hold."""


# --- writing


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def urn(page_id: int | None, copy: str, what: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{copy}:{what}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join([VERSION, *(f"\r\n{k}: {v}".encode() for k, v in fields), f"\r\nContent-Length: {len(block)}\r\n\r\n".encode()])
    return head + block + b"\r\n\r\n"


def members(data: bytes) -> list[bytes]:
    """`data` as gzip members, which all end in a zero byte."""
    out = []
    for i in range(0, len(data), MEMBER_BYTES):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(pack.compress(data[i : i + MEMBER_BYTES]) + pack.flush())
    return out


def transaction(page_id: int | None, url: str, html: bytes, digest: str, original: int | None, copy: str) -> list[bytes]:
    """The request, the response (or the revisit of `original`) and the metadata of a page with the payload digest `digest`."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    host, _, path = url.partition("://")[2].partition("/")
    kind = "response" if original is None else "revisit"
    main = urn(page_id, copy, kind)

    def head(what: str, mime: str, *more: tuple[str, str]) -> list[tuple[str, str]]:
        own = main if what == kind else urn(page_id, copy, what)
        return [("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), *more, ("Content-Type", mime)]

    request = record(head("request", "application/http; msgtype=request", ("WARC-Concurrent-To", main)), f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    more = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if original is not None:
        more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(original, digest, "response"))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    reply = record(head(kind, "application/http; msgtype=response", *more), http + (html if original is None else b""))
    said = f"page_id: {'' if page_id is None else page_id}\r\npayload_bytes: {len(html)}\r\n".encode()
    return [request, reply, record(head("metadata", "application/warc-fields", ("WARC-Concurrent-To", main)), said)]


def _originals(narrow: DataFrame) -> DataFrame:
    """digest, original and hot of each payload that several pages have: the page_id of its response, and whether one in HOT of such pages has it."""
    found = cut(narrow.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("pages")).where("pages > 1 AND original IS NOT NULL"))
    total = found.agg(F.sum("pages")).first()[0] or 0
    return found.select("digest", "original", (F.col("pages") * HOT > total).alias("hot"))


def _revisits(narrow: DataFrame) -> DataFrame:
    """key, digest and original of the pages (key, page_id, digest) that revisit another."""
    originals = _originals(narrow)
    # Fewer than HOT payloads are hot; they are sent to all tasks, so no task gets all pages of one.
    hot = originals.where("hot").select("digest", F.col("original").alias("hot_original"))
    rest = originals.where("NOT hot").select(F.col("digest").alias("payload"), F.col("original").alias("cold_original"))
    known = narrow.join(F.broadcast(hot), "digest", "left")
    payload = F.when(F.col("hot_original").isNull(), F.col("digest")).otherwise(F.col("key").cast("string"))
    known = known.withColumn("payload", payload).join(rest, "payload", "left").withColumn("original", F.coalesce("hot_original", "cold_original"))
    return known.where("original IS NOT NULL AND (page_id IS NULL OR page_id < original)").select("key", "digest", "original")


def with_original(pages: DataFrame, files: int, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest (hexadecimal) and original of `pages` (page_id, url, html), dealt to `files` partitions: the page_id of the response that a page revisits, null where it is a response itself.

    Rows of one id and payload meet in a partition. Payloads travel once.
    """
    keyed = pages.select("page_id", "url", "html", F.sha1("html").alias("digest")).withColumn("key", F.coalesce("page_id", F.xxhash64("digest", "url")))
    narrow = keyed.where(F.octet_length("html") >= least_bytes).select("key", "page_id", "digest")
    # An id has several entries only where it has several payloads.
    entry = F.collect_set(F.struct("digest", "original"))
    revisits = _revisits(narrow).repartition(files, "key").groupBy("key").agg(F.map_from_entries(entry).alias("originals"))
    dealt = keyed.repartition(files, "key").join(revisits.hint("shuffle_hash"), "key", "left")
    return dealt.select("page_id", "url", "html", "digest", F.try_element_at("originals", "digest").alias("original"))


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, files: int | None = None) -> None:
    """Write the transactions of all `pages` (page_id, url, html, ...) as archives into `folder`."""
    if dict(pages.dtypes)["page_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("page_id must be an integer")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    if files is None:
        size = pages.agg(F.sum(F.octet_length("html") + PAGE_BYTES)).first()[0] or 0
        files = max(-(-size // FILE_BYTES), min(pages.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))), 1)

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        seen: set[tuple[int | None, str]] = set()
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, digest, original = (b.column(c)[i].as_py() for c in range(5))
                digest = copy = _digest(digest)
                # The first record of an id and payload is named after them; more of them after their place, as is all without an id.
                if page_id is None or (page_id, copy) in seen:
                    copy = f"{digest}-{part}-{at}"
                seen.add((page_id, copy))
                at += 1
                # The sink adds a member's last byte.
                frames = [m[:-1] for r in transaction(page_id, url, html, digest, original, copy) for m in members(r)]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    with_original(pages, files, least_bytes).mapInArrow(W.tidied(run), "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\x00").text(folder)


# --- reading


def inflated(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Byte offset, length and content of each gzip member; plain data is one member."""
    if bytes(data[:2]) != b"\x1f\x8b":
        if len(data):
            yield 0, len(data), bytes(data)
        return
    at = 0
    while at < len(data):
        unpack, out, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if end >= len(data):
                raise BadArchive(f"byte {at}: a member is cut short")
            step = data[end : end + (1 << 16)]
            try:
                out.append(unpack.decompress(step))
            except zlib.error as e:
                raise BadArchive(f"byte {at}: {e}") from None
            end += len(step)
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Names in lower case and values of header lines; a line that starts with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip().lower(), v.strip()))
    return out


def records(data: memoryview) -> Iterator[tuple[int, int, list[tuple[str, str]], bytes]]:
    """Byte offset and length (in the file), header fields and block of each record; a record may go over several members."""
    held, start, size = b"", 0, 0
    for at, length, content in inflated(data):
        if not held:
            start, size = at, 0
        held, size = held + content if held else content, size + length
        used = 0
        while used < len(held):
            end = held.find(b"\r\n\r\n", used)
            if end < 0:
                break
            line, _, rest = held[used:end].partition(b"\r\n")
            if not line.startswith(b"WARC/"):
                raise BadArchive(f"byte {start}: no record begins here")
            fields = _fields(rest)
            n = next((v for k, v in fields if k == "content-length"), "")
            if not n.isdecimal():
                raise BadArchive(f"byte {start}: no length")
            stop = end + 4 + int(n)
            if len(held) < stop + 4:
                break
            if held[stop : stop + 4] != b"\r\n\r\n":
                raise BadArchive(f"byte {start}: the length doesn't hold")
            yield start, size, fields, held[end + 4 : stop]
            used = stop + 4
        held = held[used:]
    if held:
        raise BadArchive(f"byte {start}: a record is cut short")


def parsed(file: str, at: int, size: int, fields: list[tuple[str, str]], block: bytes) -> tuple[tuple, bytes | None]:
    """RECORD's values and the payload: of a response what follows its HTTP head, of a revisit none."""
    first = dict(reversed(fields))
    kind, mime = first.get("warc-type", ""), first.get("content-type", "")
    payload, length, more = block, None, {}
    if kind in ("response", "revisit") and mime.replace(" ", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        said = dict(_fields(head.partition(b"\r\n")[2])).get("content-length", "")
        length = int(said) if kind == "revisit" and said.isdecimal() else None
    elif mime.startswith("application/warc-fields"):
        more = dict(_fields(block))
    digest = first.get("warc-payload-digest", "")
    algorithm, _, value = digest.rpartition(":")
    if kind == "revisit":
        payload = None
    else:
        length = len(payload)
        if algorithm in ("", "sha1") and len(value) == 32 and value != digest_of(payload):
            raise BadArchive(f"{file}, byte {at}: the payload's digest doesn't hold")
    links = [v for k, v in fields if k == "warc-concurrent-to"]
    return (file, at, size, first.get("warc-record-id"), kind, links, first.get("warc-refers-to"), first.get("warc-target-uri"), first.get("warc-date"), value or None, length, list(more.items())), payload


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A RECORD row for each record of the archives in `folder`, with its payload unless `payloads` is false."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.map_(pa.string(), pa.string())]

    def batch(rows: list[tuple], held: list[bytes | None]) -> pa.RecordBatch:
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.binary())] if payloads else [])], names=[*NAMES, *(["payload"] if payloads else [])])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py().rpartition("/")[2]
                rows, held, size = [], [], 0
                for x in records(memoryview(b.column(1)[k].as_buffer())):
                    row, payload = parsed(name, *x)
                    rows.append(row)
                    held.append(payload)
                    size += 200 + (len(payload or b"") if payloads else 0)
                    if size > 4 << 20:
                        yield batch(rows, held)
                        rows, held, size = [], [], 0
                if rows:
                    yield batch(rows, held)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(W.tidied(run), f"{RECORD}, {PAYLOAD}" if payloads else RECORD)


# --- assembly


def _reached(links: DataFrame, labelled: DataFrame, name: str) -> DataFrame:
    """record_id and `name`: the capture of a labelled record (record_id, capture) that it is linked with, of several the first by name."""
    near = links.join(labelled.select(F.col("record_id").alias("b"), "capture"), "b")
    return near.groupBy(F.col("a").alias("record_id")).agg(F.min("capture").alias(name))


def placed(found: DataFrame) -> DataFrame:
    """record_id and capture of each record that a response or revisit is linked with, itself included."""
    brief = cut(found.select("record_id", F.col("type").isin("response", "revisit").alias("main"), "concurrent_to"))
    said = brief.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("a <> b")
    links = said.unionByName(said.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    heads = brief.where("main").select("record_id", F.col("record_id").alias("capture")).distinct()
    direct = cut(_reached(links, heads, "capture").join(heads.select("record_id"), "record_id", "left_anti"))
    # Through one record that isn't a response itself.
    further = _reached(links, direct, "capture").join(heads.unionByName(direct).select("record_id"), "record_id", "left_anti")
    return heads.unionByName(direct).unionByName(further)


def assemble(found: DataFrame) -> DataFrame:
    """A row for each capture of some records (RECORD, and payload if read with it).

    capture_id is the response's or revisit's record id (of a capture without one,
    a record's own); then target_uri and date, response (of either type), request
    and metadata: structs of the records' columns, metadata an array, all in the
    order of record ids, request and response the first. Other types of records
    are no part of captures. A record without an id raises an error.
    """
    own = [c for c in ("type", "file", "byte_offset", "byte_length", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "fields", "payload") if c in found.columns]
    found = found.where(F.col("type").isin("response", "revisit", "request", "metadata"))
    found = found.withColumn("record_id", F.coalesce("record_id", F.raise_error(F.lit("a record without an id")).cast("string")))
    every = found.join(placed(found), "record_id", "left")
    # Maps have no order, so records are ordered by their ids and places.
    each = every.select(F.coalesce("capture", "record_id").alias("capture"), F.struct("record_id", "file", "byte_offset").alias("order"), F.struct(*own).alias("r"))
    kind = F.col("r.type")
    grouped = each.groupBy(F.col("capture").alias("capture_id")).agg(
        F.min_by("r", F.when(kind.isin("response", "revisit"), F.col("order"))).alias("response"),
        F.min_by("r", F.when(kind == "request", F.col("order"))).alias("request"),
        F.collect_list(F.when(kind == "metadata", F.struct("order", "r"))).alias("metadata"),
    )
    parts = grouped.withColumn("metadata", F.transform(F.array_sort("metadata", _by_order), lambda x: x["r"]))
    first = F.coalesce(F.col("response"), F.col("request"), F.get("metadata", F.lit(0)))
    return parts.select("capture_id", first["target_uri"].alias("target_uri"), first["date"].alias("date"), "response", "request", "metadata")


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)


def page_of(uri: Column) -> Column:
    """The page_id in a record id that `write` has made; null where the page had none."""
    return F.regexp_extract(uri, "^<urn:page:(-?[0-9]+|null):", 1).try_cast("long")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture in archives that `write` has made."""
    got = assemble(cut(read(spark, folder, payloads=False)))
    said = F.col("metadata")[0]["fields"]["page_id"].try_cast("long")
    return got.select(
        said.alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` as archives, read them back and assemble the captures."""
    folder = folder or scratch(pages.sparkSession, "warc")
    write(pages, folder)
    return captures(pages.sparkSession, folder)
