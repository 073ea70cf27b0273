"""How far the sources of a language differ in their words (operator 11).

A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased. A
language keeps the terms that at least LEAST_DOCS of its documents have. A group
(a source in a language), and the language itself, gives a kept term the smoothed
share p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), N being its count
of all V kept terms. Part `pair` has the sum of |p - q| over all kept terms for each
two groups of a language, part `term` the terms that a group has more of than its
language, up to the MOST_TERMS greatest differences.

The pairs are computed by tiles. A language's terms are dealt by hash to chunks of
about CHUNK, its groups to blocks of about `_block`; a group's counts in a chunk
travel as one packed vector (places and counts of the terms it has). Each vector is
sent to the tasks of all pairs of blocks with its own block, and of its span of
SPAN chunks; a task goes over its chunks one after the other, holding two blocks'
counts of one chunk and the sums of its own pairs. Terms that neither group has in
a chunk nobody sent are added afterwards: they all have the same difference.

All counts are exact: terms are compared as text, shares by whole-number division.
Documents are counted in their partition before anything is shuffled, so a hot
group or term is a row for each task.

Defined results: null text, lang or source count as ''; a group without kept terms
has count 0 for all; a language without kept terms has pairs of value 0 and no
terms; repeated rows and equal doc_ids all count; equal values are ranked by the
item's UTF-8 bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm import words as W
from meshwright.llm.shared import written

LEAST_DOCS, SCALE, SMOOTH, MOST_TERMS = 30, 1_000_000_000, 5, 50
#: Terms of a chunk, and chunks of a task.
CHUNK, SPAN = 512, 8
#: Groups of a block: an eighth of the language's, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 16, 512
#: Bytes of text that are counted at once.
SLICE = 8 << 20

TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
COUNTS = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, a string, b string, value long, seen long, gap long"


# --- counting


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts in order, and the row of each."""
    data = W.LOWER[data]
    own = TERM[data]
    starts, ends, first = W.word_spans(np.where(own, data, 0x20).astype(np.uint8), bounds)
    places = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[own]))
    return terms.dictionary_encode(), np.repeat(np.arange(len(bounds) - 1), np.diff(first))


def _counted(groups: list[tuple[str, str]], group: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """COUNTS of some texts, `group` being each one's place in `groups`."""
    terms, row = _terms(data, bounds)
    m, codes = max(1, len(terms.dictionary)), terms.indices.to_numpy().astype(np.int64)
    keys, n = np.unique(group[row] * m + codes, return_counts=True)
    once = np.unique(row * m + codes)
    # The same keys, each once for every row that has it.
    docs = np.unique(group[once // m] * m + once % m, return_counts=True)[1]
    of = keys // m
    return _rows([groups[g] for g in of.tolist()], terms.dictionary.take(pa.array(keys % m)).cast(pa.string()), n, docs)


def _rows(groups: list[tuple[str, str]], terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    lang, source = zip(*groups, strict=True) if groups else ((), ())
    columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in COUNTS.split(", ")])


def count(docs: DataFrame) -> DataFrame:
    """COUNTS: of each lang, source and term in `docs` (lang, source, text, ...) the occurrences and the documents; each group also has a row without a term."""

    def run(batches):
        for b in batches:
            groups: dict[tuple[str, str], int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
            known = list(groups)
            none = np.zeros(len(known), np.int64)
            yield _rows(known, pa.nulls(len(known), pa.string()), none, none)
            data, bounds = W.text_bytes(b.column(2))
            for i, j in W.slices(bounds, SLICE):
                yield _counted(known, group[i:j], data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = plain.mapInArrow(W.tidied(run), COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- tiles


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + SMOOTH) / totals), digit by digit to the base of 1000, so that nothing overflows below 2**53."""
    out, rest = np.divmod(counts + SMOOTH, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return out + 1


class Tile:
    """One task's pairs: the groups of two blocks, and the sums over the chunks so far."""

    def __init__(self, rows: list[dict]):
        sides = [[x for x in rows if x["block"] == rows[0][side]] for side in ("lo", "hi")]
        self.same = rows[0]["lo"] == rows[0]["hi"]
        self.names = [[x["source"] for x in side] for side in sides]
        self.at = [{s: i for i, s in enumerate(names)} for names in self.names]
        # A language without kept terms has no shares at all; its totals of 0 are never divided by.
        self.empty = rows[0]["width"] == 0
        self.totals = [np.array([max(1, x["total"]) for x in side], np.int64).reshape(-1, 1) for side in sides]
        self.sums, self.seen = np.zeros((len(sides[0]), len(sides[1])), np.int64), 0

    def add(self, rows: list[dict]) -> None:
        """One chunk: the vectors that its groups sent."""
        width, parts = rows[0]["width"], []
        for at, totals in zip(self.at, self.totals, strict=True):
            counts = np.zeros((len(at), width), np.int64)
            for x in rows:
                if x["source"] in at:
                    counts[at[x["source"]], x["slots"]] = x["counts"]
            parts.append(shares(counts, totals))
        for i, own in enumerate(parts[0]):
            self.sums[i] += np.abs(parts[1] - own).sum(axis=1)
        self.seen += width

    def result(self) -> Iterator[tuple[str, str, int, int, int]]:
        """a, b, value, terms seen, and the difference for each term that wasn't; each pair once."""
        base = [shares(np.zeros_like(t), t)[:, 0] for t in self.totals]
        for i, a in enumerate(self.names[0]):
            for j, b in enumerate(self.names[1]):
                if not self.same or i < j:
                    yield a, b, int(self.sums[i, j]), self.seen, 0 if self.empty else int(abs(base[0][i] - base[1][j]))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARTIAL rows from rows sorted by task, then chunk; a task's first rows (chunk -1) are all its groups."""

    def chunks():
        key, held = None, []
        for b in batches:
            vectors = [(list_.values.to_numpy(), list_.offsets.to_numpy()) for list_ in (b.column("slots"), b.column("counts"))]
            for i, x in enumerate(b.drop_columns(["slots", "counts"]).to_pylist()):
                x["slots"], x["counts"] = (values[at[i] : at[i + 1]] for values, at in vectors)
                now = (x["lang"], x["lo"], x["hi"], x["span"], x["chunk"])
                if now != key and held:
                    yield key, held
                    held = []
                key = now
                held.append(x)
        if held:
            yield key, held

    def done(lang: str, tile: Tile):
        rows = list(tile.result())
        for i in range(0, len(rows), 50_000):
            a, b, *numbers = zip(*rows[i : i + 50_000], strict=True)
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names=[x.split()[0] for x in PARTIAL.split(", ")])

    lang, tile = None, None
    for key, rows in chunks():
        if key[4] < 0:
            if tile:
                yield from done(lang, tile)
            lang, tile = key[0], Tile(rows)
        else:
            tile.add(rows)
    if tile:
        yield from done(lang, tile)


def _block(groups: Column) -> Column:
    return F.least(F.greatest(groups / 8, F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))


def _tasks(df: DataFrame) -> DataFrame:
    """Each row for every pair of blocks with its own."""
    other = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})


# --- the audit


def _ranked(df: DataFrame, part: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))


def _share(n: str, total: str) -> Column:
    return F.expr(f"1 + (CAST({SCALE} AS decimal(10, 0)) * CAST({n} + {SMOOTH} AS decimal(20, 0))) DIV CAST({total} AS decimal(20, 0))")


class Audit:
    """The tables of an audit: what several parts of it read is written to the shared folder."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        self.counts = written(count(docs), "counts")
        kept = self.counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
        kept = written(kept, "kept")
        sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_kept"))
        sources = self.counts.where("term IS NULL").groupBy("lang").agg(F.count("*").alias("groups"))
        v = F.coalesce("v", F.lit(0))
        #: lang, its kept terms and their occurrences, its chunks, spans and blocks.
        langs = sources.join(sizes, "lang", "left").select(
            "lang", v.alias("v"), (F.coalesce("n_kept", F.lit(0)) + SMOOTH * v).alias("lang_total"), F.ceil(v / CHUNK).cast("int").alias("chunks"), F.greatest(F.ceil(v / (CHUNK * SPAN)), F.lit(1)).cast("int").alias("spans"),
            F.ceil(F.col("groups") / _block(F.col("groups"))).cast("int").alias("blocks"),
        )
        self.langs = written(langs, "langs")
        within = Window.partitionBy("lang", "chunk")
        chunked = kept.join(self.langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks").cast("int")).drop("chunks")
        slots = chunked.withColumns({"slot": F.row_number().over(within.orderBy("term")) - 1, "width": F.count("*").over(within).cast("int")})
        #: The counts of kept terms, each with its language's count and its place.
        self.entries = written(self.counts.where("term IS NOT NULL").drop("docs").join(slots, ["lang", "term"]), "entries")
        own = self.entries.groupBy("lang", "source").agg(F.sum("n").alias("own"))
        groups = self.counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(self.langs, "lang")
        #: lang, source, total (N + SMOOTH * V), and the group's block.
        self.groups = written(groups.withColumns({"total": F.coalesce("own", F.lit(0)) + SMOOTH * F.col("v"), "block": F.pmod(F.xxhash64("source"), "blocks").cast("int")}).drop("own", "chunks"), "groups")

    def pairs(self) -> DataFrame:
        """lang, a, b and value of each two groups of a language, each pair once."""
        vectors = self.entries.groupBy("lang", "source", "chunk").agg(F.first("width").alias("width"), F.collect_list(F.struct("slot", "n")).alias("cells"))
        placed = vectors.join(self.groups.select("lang", "source", "block", "blocks", "spans"), ["lang", "source"])
        sent = _tasks(placed.withColumn("span", F.pmod("chunk", "spans"))).select("lang", "lo", "hi", "span", "chunk", "source", "block", "width", F.lit(0).cast("long").alias("total"), F.col("cells.slot").alias("slots"), F.col("cells.n").alias("counts"))
        roster = _tasks(self.groups.withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))))
        roster = roster.select("lang", "lo", "hi", "span", F.lit(-1).alias("chunk"), "source", "block", F.least("v", F.lit(1)).cast("int").alias("width"), "total", F.array().cast("array<int>").alias("slots"), F.array().cast("array<long>").alias("counts"))
        task = ["lang", "lo", "hi", "span"]
        dealt = roster.unionByName(sent).repartition(*task).sortWithinPartitions(*task, "chunk", "source")
        partial = dealt.mapInArrow(W.tidied(_tiles), PARTIAL).groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("gap").alias("gap"))
        return partial.join(self.langs.select("lang", "v"), "lang").select("lang", "a", "b", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("gap")).alias("value"))

    def terms(self) -> DataFrame:
        """lang, source, item (a term) and value, for the terms that a group has more of than its language."""
        both = self.entries.join(self.groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
        return both.select("lang", "source", F.col("term").alias("item"), (_share("n", "total") - _share("n_lang", "lang_total")).alias("value")).where("value > 0")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: part `pair` for each other source, part `term` for the terms up to rank `most_terms`."""
    found = Audit(docs, least_docs)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pairs = found.pairs().select("lang", "value", sides).select("lang", "x.source", "x.item", "value")
    return _ranked(pairs, "pair").unionByName(_ranked(found.terms(), "term").where(F.col("rank") <= most_terms))
