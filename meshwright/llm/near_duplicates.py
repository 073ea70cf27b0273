"""Near-duplicate groups by MinHash with odd sketches (operator 2).

A text's set holds the 64-bit hashes of its distinct word shingles (words
`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with fewer words than a shingle has, the
whole sequence is one). Rows with equal sets are one class, told apart by a
128-bit digest of the set, and all work goes on between classes:

1. HASHES MinHash samples of a set are read in BANDS bands as bucket keys, and
   folded, with their positions, into an odd sketch: a bitmap of BITS bits in
   which each sample flips one. The population count of the XOR of two sketches
   estimates how many samples differ, precisely for high similarities.
2. In each bucket all classes are compared with its head, the class that meets
   most others: of near copies mostly what they were made from. The sketches
   reject pairs that are far apart (see `most_flips`); for the rest the full sets
   are intersected. What is linked forms components.
3. Only classes that are still in another component than their bucket's head are
   compared with the other classes of the bucket: pairs inside a component cannot
   change the result, so a copy costs one comparison in each of its buckets.
   Beyond SMALL classes this goes on in blocks of bounded size, first of sketches,
   then of the full sets of what the sketches leave; a block returns no pairs but
   the links that join components.
4. Components of all links give component_id.

With similarity 0.8 and 32 bands of 4, a pair at the limit shares no bucket with
probability 5e-8. The sets of classes that meet in a bucket are made again from
their texts; sets and links are neither collected nor kept on one machine.

Defined results: null, empty and blank texts have no set and are linked with
nothing; component_id is the least doc_id of the component, nulls aside (a row
with a null doc_id counts for links but can't name a component; kept is false
unless its component has no other id); rows with equal doc_id are judged each by
its own text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import words as W
from meshwright.llm.components import components
from meshwright.llm.shared import cut

HASHES, BANDS, BITS = 128, 32, 512
ROWS = HASHES // BANDS
_rng = np.random.default_rng(2014)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
#: Members (32 bytes each) that may be broadcast to find their texts.
MOST_SENT = 500_000
#: Rows, and items of sets, on either side of a block of a bucket; a set counts as LEAST_ITEMS at least, which bounds rows x rows.
BLOCK_ROWS, BLOCK_ITEMS, LEAST_ITEMS = 1024, 200_000, 200
#: Buckets of at most so many classes are compared pair by pair.
SMALL = 64
#: Shingles hashed at once for a text's samples.
STEP = 1024

SIGNATURE = "n_shingles long, d0 long, d1 long, bands array<long>, sketch array<long>"


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int):
    """The ascending distinct shingle hashes of each row."""
    found = W.find_words(data, bounds)
    runs = W.windows(found.hashes, size)
    for i in range(len(bounds) - 1):
        a, b = int(found.first[i]), int(found.first[i + 1])
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield W.windows(found.hashes[a:b], b - a) ^ np.uint64(b - a)  # no shingle of `size` words
        else:
            yield np.zeros(0, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), STEP):
        part = shingles[i : i + STEP, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketches(minhash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (n x BANDS) and odd sketches (n x BITS / 64) of n rows of samples."""
    n = len(minhash)
    places = W.mix(minhash + np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    bits = np.zeros((n, BITS), np.uint8)
    rows = np.repeat(np.arange(n), HASHES)
    np.bitwise_xor.at(bits, (rows, (places >> np.uint64(40)).astype(np.int64).ravel() % BITS), 1)
    odd = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    keys = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = W.mix(keys * np.uint64(0x9FB21C651E98DF25) + minhash[:, i::ROWS])
    return keys.view(np.int64), odd


def most_flips(similarity: float) -> int:
    """The greatest XOR count to expect of a pair of `similarity`, at six standard deviations.

    Of HASHES samples m differ, binomial with 1 - similarity; each differing one
    flips two bits of BITS, and x bits are left set.
    """
    p = 1 - similarity
    m, keep = HASHES * p, 1 - 2 / BITS
    x = BITS / 2 * (1 - keep ** (2 * m))
    slope = -BITS * math.log(keep) * keep ** (2 * m)
    variance = slope**2 * HASHES * p * (1 - p) + x * (1 - x / BITS)
    return min(BITS, math.ceil(x + 6 * math.sqrt(variance)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, place, h and SIGNATURE of each row of `docs` (doc_id, text, place, h)."""

    def run(batches):
        for b in batches:
            data, bounds = W.text_bytes(b.column(1))
            for i, j in W.slices(bounds):
                counts, digests, mins, filled = [], [], [], []
                for k, s in enumerate(shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], size)):
                    counts.append(len(s))
                    if len(s):
                        filled.append(k)
                        mins.append(samples(s))
                        digests.append(digest(s))
                n = j - i
                d, mask = np.zeros((n, 2), np.uint64), np.ones(n, bool)
                bands, odd = [None] * n, [None] * n
                if filled:
                    d[filled] = np.array(digests, np.uint64)
                    mask[filled] = False
                    keys, bits = sketches(np.array(mins))
                    for k, x, y in zip(filled, keys, bits, strict=True):
                        bands[k], odd[k] = x, y
                d = d.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), b.column(2).slice(i, n), b.column(3).slice(i, n), pa.array(counts, pa.int64()), pa.array(d[:, 0], mask=mask), pa.array(d[:, 1], mask=mask), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                    names=["doc_id", "place", "h", "n_shingles", "d0", "d1", "bands", "sketch"],
                )

    return docs.select("doc_id", "text", "place", "h").mapInArrow(W.tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, place long, h long, {SIGNATURE}")


def digest(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return np.bitwise_xor.reduce(W.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))), np.add.reduce(W.mix(shingles ^ np.uint64(0x14057B7EF767814F)))


def sets(texts: DataFrame, size: int) -> DataFrame:
    """node and full set of each row of `texts` (text, node, d0, d1) whose set has that digest."""

    def run(batches):
        for b in batches:
            data, bounds = W.text_bytes(b.column(0))
            for i, j in W.slices(bounds, 1 << 20):
                got = list(shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], size))
                same = [k for k, x in enumerate(got) if np.array(digest(x)).view(np.int64).tolist() == [b.column(2)[i + k].as_py(), b.column(3)[i + k].as_py()]]
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array([i + k for k in same], pa.int64())), pa.array([got[k].view(np.int64) for k in same], pa.list_(pa.int64()))], names=["node", "items"])

    return texts.mapInArrow(W.tidied(run), "node long, items array<long>")


def linked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough."""
    one = full.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = full.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("n"), F.size("y").alias("m"))
    return both.where(100 * F.col("common").cast("long") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def in_blocks(rows: DataFrame, brief: DataFrame, most: int, weight, schema: str, compare) -> DataFrame:
    """Compare the rows that are `away` with all rows of their bucket, in blocks of bounded size.

    Both sides of a bucket are dealt to chunks of about `most` in weight by a
    hash; each pair of chunks is a group of its own, whatever the bucket's size,
    and the groups of a bucket are dealt to tasks one by one. `brief` has the same
    rows with no more than key, n and away.
    `compare` gets its two sides and returns what it has found, never pairs that
    are no links.
    """
    # Written, so that the join with it can split a large bucket's rows.
    chunks = cut(brief.groupBy("key").agg(F.greatest(F.ceil(F.sum(F.when(F.col("away"), weight).otherwise(0)) / most), F.lit(1)).cast("int").alias("i_most"), F.ceil(F.sum(weight) / most).cast("int").alias("j_most")))
    dealt = rows.join(chunks, "key")
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    left = dealt.where("away").withColumn("i", (spread % F.col("i_most")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, j_most - 1)"))).withColumn("left", F.lit(True))
    right = dealt.withColumn("j", (spread % F.col("j_most")).cast("int")).withColumn("i", F.explode(F.expr("sequence(0, i_most - 1)"))).withColumn("left", F.lit(False))
    both = left.unionByName(right).drop("i_most", "j_most")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        side = table["left"].to_numpy()
        found = compare(table.filter(pa.array(side)), table.filter(pa.array(~side)))
        keys = [pa.array(np.full(len(found[0]), table["key"][0].as_py()), pa.int64())] if names == ["node"] else []
        out = pa.table([*keys, *(pa.array(x, pa.int64()) for x in found)], names=["key"] * len(keys) + names)
        if len(table) > SMALL:
            W.tidy()
        return out

    # Without this, Spark would find rows dealt by key good enough, and give all of a bucket to one task.
    return both.repartition("key", "i", "j").groupBy("key", "i", "j").applyInArrow(run, "key long, " * (names == ["node"]) + schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _close_ones(percent: int):
    """Nodes with a partner of another component that sizes and sketches do not rule out."""
    most = most_flips(percent / 100)

    def compare(a: pa.Table, b: pa.Table):
        x, y = (np.stack([_numbers(t, f"s{i}") for i in range(BITS // 64)], 1).view(np.uint64) if len(t) else np.zeros((0, BITS // 64), np.uint64) for t in (a, b))
        n, m, p, q = _numbers(a, "n"), _numbers(b, "n"), _numbers(a, "root"), _numbers(b, "root")
        hit_a, hit_b = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for k in range(len(x)):
            fits = (p[k] != q) & (100 * np.minimum(n[k], m) >= percent * np.maximum(n[k], m))
            at = np.flatnonzero(fits)
            at = at[np.bitwise_count(x[k] ^ y[at]).sum(axis=1) <= most]
            hit_a[k] = len(at) > 0
            hit_b[at] = True
        return [np.unique(np.concatenate([_numbers(a, "node")[hit_a], _numbers(b, "node")[hit_b]]))]

    return compare


def _linked_ones(percent: int):
    """Links between components, enough to join all that are linked: full sets against full sets."""

    def items(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = t["items"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        return lists.flatten().to_numpy(), np.repeat(np.arange(len(t)), sizes)

    def compare(a: pa.Table, b: pa.Table):
        n, m, p, q = _numbers(a, "n"), _numbers(b, "n"), _numbers(a, "root"), _numbers(b, "root")
        common = intersections(*items(a), len(a), *items(b), len(b))
        hit = (100 * common >= percent * (n[:, None] + m[None, :] - common)) & (p[:, None] != q[None, :])
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while up.get(v, v) != v:
                up[v] = v = up.get(up[v], up[v])
            return v

        found = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
            u, v = top(int(p[i])), top(int(q[j]))
            if u != v:
                up[max(u, v)] = min(u, v)
                found.append((int(p[i]), int(q[j])))
        return [np.array([x[k] for x in found], np.int64) for k in (0, 1)]

    return compare


def intersections(x: np.ndarray, row: np.ndarray, rows: int, y: np.ndarray, col: np.ndarray, cols: int, step: int = 4096) -> np.ndarray:
    """How many items each of `rows` sets has in common with each of `cols` sets; a set's items are distinct."""
    out = np.zeros((rows, cols), np.int64)
    shared = np.intersect1d(x, y)
    if not len(shared):
        return out
    x_at, y_at = np.searchsorted(shared, x), np.searchsorted(shared, y)
    x_in = shared[np.minimum(x_at, len(shared) - 1)] == x
    y_in = shared[np.minimum(y_at, len(shared) - 1)] == y
    x_at, row, y_at, col = x_at[x_in], row[x_in], y_at[y_in], col[y_in]
    by_x, by_y = np.argsort(x_at, kind="stable"), np.argsort(y_at, kind="stable")
    x_at, row, y_at, col = x_at[by_x], row[by_x], y_at[by_y], col[by_y]
    for k in range(0, len(shared), step):
        (i, j), (u, v) = np.searchsorted(x_at, [k, k + step]), np.searchsorted(y_at, [k, k + step])
        used, here = np.unique(row[i:j], return_inverse=True)
        other, there = np.unique(col[u:v], return_inverse=True)
        left, right = np.zeros((len(used), step), np.float32), np.zeros((len(other), step), np.float32)
        left[here, x_at[i:j] - k] = 1
        right[there, y_at[u:v] - k] = 1
        out[np.ix_(used, other)] += np.rint(left @ right.T).astype(np.int64)
    return out


def close(left: str, right: str, percent: int):
    """A pair that the sizes and the odd sketches do not rule out."""
    flips = sum((F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))) for i in range(BITS // 64)), F.lit(0))
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (flips <= most_flips(percent / 100))


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text, ...)."""
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The columns of `groups`, with h, the text's hash, and root, the component's number (null for rows without a set)."""
    # Texts are found again by this key; where ids are null it comes from the text, where they aren't whole numbers from a hash.
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    number = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    docs = docs.select("doc_id", "text", F.coalesce(number, F.xxhash64("text")).alias("place"), F.xxhash64("text").alias("h"))
    bits = [f"s{i}" for i in range(BITS // 64)]
    rows = cut(signatures(docs, size))
    classes = rows.where("n_shingles > 0").groupBy("d0", "d1").agg(F.min("place").alias("place"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select("d0", "d1", "place", "least", "n", "bands", *(F.element_at("sketch", i + 1).alias(x) for i, x in enumerate(bits))))
    # The numbers stay the same: they are dealt over what has been written.
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    light = classes.select("node", "n", *bits)
    buckets = classes.select(F.explode("bands").alias("key"), "node")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    crowded = cut(buckets.join(sizes, "key"))
    # A bucket's head is its member that meets most others in all its buckets: near copies meet what they were made from most.
    met = crowded.groupBy("node").agg(F.sum("size").alias("met"))
    heads = crowded.join(met, "node").groupBy("key").agg(F.max(F.struct(F.col("met"), (-F.col("node")).alias("head"))).alias("x")).select("key", (-F.col("x.head")).alias("head"))
    shared = cut(crowded.select("key", "node").join(heads, "key"))

    # Each member of a bucket with its head.
    stars = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    near = stars.join(light.alias("p"), F.col("p.node") == F.col("a")).join(light.alias("q"), F.col("q.node") == F.col("b"))
    near = cut(near.where(close("p", "q", percent)).select("a", "b"))
    members = cut(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    full = cut(_full(docs, classes, members, size))
    links = cut(linked(near, full, percent))
    roots = cut(components(links))

    # Members that are not in their head's component, with all others of the bucket.
    head_roots = roots.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    here = shared.join(roots, "node", "left").join(head_roots, "head", "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("head_root", "head").alias("head_root"))
    here = cut(here.withColumn("away", F.col("root") != F.col("head_root")).drop("head_root"))
    odd = cut(here.groupBy("key").agg(F.count("*").alias("size"), F.max("away").alias("any")).where("any").drop("any"))
    here = cut(here.join(odd, "key").join(light, "node"))
    if not here.isEmpty():
        few, many = here.where(F.col("size") <= SMALL).drop("size"), here.where(F.col("size") > SMALL).drop("size")
        # Small buckets: pairs, each once however many buckets it shares. Large ones: blocks.
        p, q = few.where("away").alias("p"), few.alias("q")
        fresh = (F.col("p.key") == F.col("q.key")) & (F.col("p.root") != F.col("q.root")) & (~F.col("q.away") | (F.col("p.node") < F.col("q.node")))
        crossed = cut(p.join(q, fresh & close("p", "q", percent)).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct())
        partners = cut(in_blocks(many, many, BLOCK_ROWS, F.lit(1), "node long", _close_ones(percent)).distinct())
        late = cut(crossed.select(F.explode(F.array("a", "b")).alias("node")).unionByName(partners.select("node")).distinct())
        full = full.join(late, "node", "left_semi").unionByName(_full(docs, classes, late.join(members, "node", "left_anti"), size))
        full = cut(full)
        brief = many.select("key", "node", "root", "away", "n").join(partners, ["key", "node"])
        # Written one after the other: both shuffle full sets, which so don't lie on the disks together.
        between = cut(in_blocks(brief.join(full, "node"), brief, BLOCK_ITEMS, F.greatest("n", F.lit(LEAST_ITEMS)), "a long, b long", _linked_ones(percent)))
        across = cut(linked(crossed, full, percent))
        known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = cut(components(known.unionByName(across).unionByName(between)))

    # From nodes back to rows: a component is named by its least doc_id.
    id_type = dict(docs.dtypes)["doc_id"]
    names = classes.select("node", "least").join(roots, "node").groupBy("root").agg(F.min("least").alias("name"))
    named = roots.join(names, "root").select("node", "root", "name")
    named = classes.select("d0", "d1", "node", "least").join(named, "node", "left").select("d0", "d1", F.coalesce("root", "node").alias("root"), F.coalesce("name", "least").cast(id_type).alias("component_id"))
    out = rows.select("doc_id", "h", "n_shingles", "d0", "d1").join(named, ["d0", "d1"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "h", "root", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _full(docs: DataFrame, classes: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """node and full set of `members`, made from the text of one row of each class."""
    wanted = cut(classes.join(members, "node").select("place", "node", "d0", "d1"))
    # Few enough members go to the texts; beyond that the texts are shuffled.
    texts = docs.select("place", "text").join(F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted, "place")
    # One row of a class is enough.
    texts = texts.groupBy("place", "node", "d0", "d1", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    return sets(texts.select("text", "node", "d0", "d1"), size)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of `docs`, with its columns: one whose doc_id names the group. Rows without a set all stay.

    Rows are told apart by doc_id and text; of repeated rows one stays.
    """
    found = cut(_grouped(docs, size, percent).where("n_shingles > 0").select("doc_id", "h", "root", "kept"))
    gone = found.where("NOT kept").select("doc_id", "h")
    # Where ids repeat or are null, several rows may bear their group's name.
    several = cut(found.where("kept").groupBy("root").agg(F.count("*").alias("rows"), F.min("h").alias("stays")).where("rows > 1"))
    if not several.isEmpty():
        named = cut(found.where("kept").join(several, "root").groupBy("doc_id", "h", "stays").count())
        gone = gone.unionByName(named.where("h <> stays").select("doc_id", "h"))
        again = named.where("h = stays AND count > 1")
        one = _rows_of(docs, again, "left_semi").dropDuplicates(["doc_id", "text"])
        docs = _rows_of(docs, again, "left_anti").unionByName(one)
    return _rows_of(docs, gone, "left_anti")


def _rows_of(docs: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """The rows of `docs` that are, or are not, among `some` (doc_id, h)."""
    some = some.select(F.col("doc_id").alias("some_id"), F.col("h").alias("some_h"))
    return docs.join(some, docs["doc_id"].eqNullSafe(some["some_id"]) & (F.xxhash64(docs["text"]) == some["some_h"]), how)
