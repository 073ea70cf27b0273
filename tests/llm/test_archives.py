"""WARC files: writing, reading, assembling."""

import base64
import gzip
import hashlib
import random
import uuid

import pytest

from meshwright.llm import oracles, warc

SCHEMA = "page_id long, url string, html string, kind string, digest string, original long, hot boolean"


@pytest.fixture()
def pages(spark):
    """A table with columns that clash with the operator's own."""
    return lambda rows, kind="long": spark.createDataFrame([(*r, "k", "d", 7, True) for r in rows], SCHEMA.replace("page_id long", f"page_id {kind}"))


def plain(rows):
    """page_id, bytes, digest, type and original by brute force."""
    out = []
    for page_id, _, html in rows:
        h = (html or "").encode()
        same = [p for p, _, t in rows if (t or "").encode() == h and p is not None]
        original = max(same) if same and (page_id is None or page_id < max(same)) else None
        out.append((page_id, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if original is None else "revisit", original))
    return sorted(out, key=repr)


ODD = [
    (1, "http://a.b/c", ""), (2, "u", None), (3, None, "x"), (4, "u", "x"), (4, "u", "x"), (4, "u", "y"), (None, "u", "x"), (None, "u", "zz"), (None, "u", "zz"),
    (5, "a\r\nWARC-Type: b", "é👍\r\n\r\nWARC/1.1\r\n"), (6, "https://h", "\x00\n\x1f\x8b"), (-3, "http://a.b/?q=1", "long " * 60_000), (7, "http://a.b/c", "long " * 60_000),
]


def random_rows(n):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab<>é\n") for _ in range(rng.randint(0, 4))) for _ in range(n)]
    return [(i, f"http://h{i % 7}.example/{i}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [ODD, random_rows(400), []])
def test_round_trip_equals_brute_force(pages, rows):
    assert sorted(map(tuple, warc.round_trip(pages(rows)).collect()), key=repr) == plain(rows)


def test_round_trip_equals_the_sql(pages):
    duckdb = pytest.importorskip("duckdb")
    rows = random_rows(200) + ODD
    base = duckdb.connect()
    base.execute("create table pages (page_id bigint, url varchar, html varchar)")
    base.executemany("insert into pages values (?, ?, ?)", [(a, b, c) for a, b, c in rows if "\x00" not in (c or "")])
    got = warc.round_trip(pages([x for x in rows if "\x00" not in (x[2] or "")]))
    want = base.sql(oracles.OP13)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.select(", ".join(got.columns)).fetchall(), key=repr)


def test_hot_and_cold_payloads_have_the_same_results(pages, monkeypatch):
    rows = random_rows(300)
    for hot in (0, 1 << 40):  # none, all
        monkeypatch.setattr(warc, "HOT", hot)
        assert sorted(map(tuple, warc.round_trip(pages(rows)).collect()), key=repr) == plain(rows)


def test_least_bytes(pages, spark, tmp_path):
    warc.write(pages([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), f"file://{tmp_path}/w", least_bytes=3)
    assert {(r.page_id, r.record_type) for r in warc.captures(spark, f"file://{tmp_path}/w").collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_files_are_gzip_members_of_a_record_each(pages, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 16)
    folder = tmp_path / "w"
    warc.write(pages(ODD), f"file://{folder}", files=3)
    files = sorted(folder.glob("part-*"))
    assert 1 < len(files) <= 3
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC-Type: metadata\r\n") == len(ODD)
    found = warc.read(spark, f"file://{folder}").collect()
    assert len(found) == 3 * len(ODD)
    by_name = {f.name: f.read_bytes() for f in files}
    for r in found:
        part = gzip.decompress(by_name[r.file][r.byte_offset : r.byte_offset + r.byte_length])
        assert part.startswith(b"WARC/1.1\r\n") and part.endswith(b"\r\n\r\n") and r.record_id.encode() in part
    long = [r for r in found if r.payload_bytes == 300_000 and r.type == "response"]
    assert [bytes(r.payload) for r in long] == [b"long " * 60_000]


def test_faults_are_found(pages, spark, tmp_path):
    warc.write(pages([(1, "http://a.b/c", "some text here")]), f"file://{tmp_path}/w", files=1)
    (file,) = (tmp_path / "w").glob("part-*")
    plain_text = gzip.decompress(file.read_bytes())
    assert len(list(warc.records(memoryview(plain_text)))) == 3

    def parse(data):
        return [warc.parsed("f", *x) for x in warc.records(memoryview(data))]

    assert len(parse(plain_text)) == 3
    for bad in (plain_text[:-1], plain_text.replace(b"some text", b"same text"), plain_text[5:], plain_text.replace(b"Content-Length", b"Content-Size"), file.read_bytes()[:-9]):
        with pytest.raises(warc.BadArchive):
            parse(bad)


def made(kind, name, to=(), block=b"", mime="text/plain", more=()):
    return warc.record([("WARC-Type", kind), ("WARC-Record-ID", name), *(("WARC-Concurrent-To", x) for x in to), *more, ("WARC-Target-URI", f"http://x/{name}"), ("Content-Type", mime)], block)


def test_transactions_of_other_writers(spark, tmp_path):
    """Links in either direction, through another record, several metadata records, records without a response, other types."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    reply = {"block": http, "mime": "application/http; msgtype=response"}
    parts = [
        made("warcinfo", "i"),
        made("request", "q1"), made("response", "r1", ["q1"], **reply), made("metadata", "m1", ["q1"], b"a: 1\r\n b\r\nc: 2", "application/warc-fields"),
        made("response", "r2", **reply), made("metadata", "m3", ["r2"]), made("metadata", "m2", ["r2"]), made("request", "q2", ["r2", "m2"]),
        made("request", "q3", ["gone"]), made("metadata", "m4", ["m4"]),
        made("revisit", "r3", ["q5"], b"HTTP/1.1 304 Not Modified\r\nContent-Length: 9\r\n\r\n", "application/http", [("WARC-Refers-To", "r1"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)]), made("request", "q5"),
    ]
    random.Random(1).shuffle(parts)
    for i, some in enumerate((parts[:5], parts[5:])):  # one plain, one of gzip members; a transaction may lie in both
        data = b"".join(some) if i else b"".join(gzip.compress(p) for p in some)
        (tmp_path / f"{uuid.uuid4().hex}.warc").write_bytes(data)
    got = {r.capture_id: r for r in warc.assemble(warc.read(spark, f"file://{tmp_path}")).collect()}
    told = {k: (r.response and r.response.record_id, r.request and r.request.record_id, [m.record_id for m in r.metadata]) for k, r in got.items()}
    assert told == {"r1": ("r1", "q1", ["m1"]), "r2": ("r2", "q2", ["m2", "m3"]), "q3": (None, "q3", []), "m4": (None, None, ["m4"]), "r3": ("r3", "q5", [])}
    assert bytes(got["r1"].response.payload) == b"body" and got["r1"].metadata[0].fields == {"a": "1 b", "c": "2"}
    assert (got["r3"].response.payload_bytes, got["r3"].response.refers_to, got["r3"].response.payload) == (9, "r1", None)
    assert got["q3"].target_uri == "http://x/q3"


def test_ids_of_other_types(pages):
    with pytest.raises(ValueError):
        warc.round_trip(pages([("1", "u", "x")], "string"))
