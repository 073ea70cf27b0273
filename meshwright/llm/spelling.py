"""Words grouped by spelling, without pairs of words (operator 12).

A word is a run of letters (RUN) with A-Z lower-cased; where the CRC-32 of
`<doc_id>:<run>` is a multiple of MARK, one of its code points is deleted first.
The vocabulary has the words of at least LEAST_CHARS code points that occur
LEAST_N times or more. Two words are near if one code point is replaced, inserted
or deleted between them. A word's form is the near word that occurs most (the
first in code-point order of equals) if that is FACTOR times as often, and its
root what following the forms ends at.

Each word is dealt to a group for each of its places (what stands before, what
after: the word with a wildcard), to a group for each text that deleting one code
point leaves, and to the group of the word itself. A group of wildcards knows its
size and its two most frequent words: so each member has its number of
replacements and the best of them. A group of deletions knows the vocabulary's word
that has its text, if there is one: so each longer word has its deletion, and that
word its insertions, their number and the best. A word sums up what its groups say;
no two words are ever put side by side. A group has one word for each letter of the
alphabet, at each place for deletions, so it is small whatever the corpus.

Words of more than LONG code points would make keys of their length squared; their
keys are hashes instead, computed from the prefixes' hashes in one go (62 bits, and
the length and place). All else is exact.

Defined results: a null text has no words; a null doc_id counts as empty text;
repeated rows count again; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.ordering import position
from meshwright.llm.shared import cut, written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK, LEAST_CHARS, LEAST_N, FACTOR = 199, 6, 5, 5
#: Code points beyond which keys are hashes.
LONG = 64
#: Kinds of a group's members: the word itself, the word with a wildcard, the word without a code point.
OWN, WILD, SHORTER = 0, 1, 2
KEYS = "key string, id long, n long, kind int"
#: Two primes below 2**31 and a base for each.
PRIMES = ((2147483647, 1103515245), (2147483629, 1664525013))


def counted(docs: DataFrame) -> DataFrame:
    """word and n of the vocabulary of `docs` (doc_id, text, ...)."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    # Deleting makes runs shorter only, so short ones go first.
    marked = runs.where(F.char_length("run") >= LEAST_CHARS).select("run", F.crc32(F.concat("d", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % MARK == 0, _without("run", at + 1)).otherwise(F.col("run"))
    words = marked.select(word.alias("word")).where(F.char_length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def _without(text: str, i: Column, put: str = "") -> Column:
    """`text` with `put` in place of its code point number `i` (from 1)."""
    return F.concat(F.left(F.col(text), i - 1), F.lit(put), F.substring(F.col(text), i + 1, F.char_length(text)))


def _short_keys(words: DataFrame) -> DataFrame:
    size = F.char_length("word")
    own = words.where(size <= LONG).select(F.col("word").alias("key"), "id", "n", F.lit(OWN).alias("kind"))
    each = words.select("word", "id", "n", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    i = F.col("i")
    wild = each.where(size <= LONG).select(_without("word", i, "*").alias("key"), "id", "n", F.lit(WILD).alias("kind"))
    # Of equal code points in a row the first stands for all: what is left is the same.
    first = (i == 1) | (F.substring("word", i, F.lit(1)) != F.substring("word", i - 1, F.lit(1)))
    shorter = each.where(first & (size <= LONG + 1)).select(_without("word", i).alias("key"), "id", "n", F.lit(SHORTER).alias("kind"))
    return own.unionByName(wild).unionByName(shorter)


def _hashes(codes: np.ndarray, prime: int, base: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Hashes of a word, of it with a wildcard at each place, and of it without each place: sums of code times a power of the base."""
    powers = np.ones(len(codes) + 1, np.int64)
    done = 1
    while done < len(powers):  # twice as many in each step
        more = min(done, len(powers) - done)
        powers[done : done + more] = powers[:more] * int(powers[done - 1]) % prime * base % prime
        done += more
    terms = codes * powers[:-1] % prime
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(terms) % prime])
    after = (before[-1] - before[1:]) % prime
    return int(before[-1]), (before[:-1] + after) % prime, (before[:-1] + after * pow(base, -1, prime)) % prime


def _long_keys(words: DataFrame) -> DataFrame:
    """KEYS of words of more than LONG code points."""
    limit = LONG + 1

    def run(batches):
        for b in batches:
            for word, id_, n in zip(*(b.column(c).to_pylist() for c in ("word", "id", "n")), strict=True):
                codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
                size = len(codes)
                parts = [_hashes(codes, *p) for p in PRIMES]
                wild = [f"*:{size}:{i}:{x}:{y}" for i, (x, y) in enumerate(zip(*(p[1].tolist() for p in parts), strict=True))]
                first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if size > limit else []
                shorter = [f":{size - 1}:{x}:{y}" for x, y in zip(*(p[2][first].tolist() for p in parts), strict=True)] if len(first) else []
                keys = [f":{size}:{parts[0][0]}:{parts[1][0]}", *wild, *shorter]
                kinds = [OWN, *[WILD] * len(wild), *[SHORTER] * len(shorter)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([id_] * len(keys), pa.int64()), pa.array([n] * len(keys), pa.int64()), pa.array(kinds, pa.int32())], names=["key", "id", "n", "kind"])

    return words.select("word", "id", "n").mapInArrow(run, KEYS)


def near(words: DataFrame) -> DataFrame:
    """id, n_near, best_n and best (an id) of the `words` (id in their order, word, n) that have near ones."""
    long = F.char_length("word") > LONG
    keys = _short_keys(words.where(F.char_length("word") <= LONG + 1)).unionByName(_long_keys(words.where(long)))
    group = Window.partitionBy("key")
    me = F.struct((-F.col("n")).alias("less"), F.col("id").alias("id"))
    own = F.col("kind") == OWN
    known = keys.withColumns({"me": me, "others": F.count(F.when(~own, 1)).over(group), "top": F.min(F.when(~own, me)).over(group), "word": F.min(F.when(own, me)).over(group)})
    known = known.withColumn("second", F.min(F.when(~own & (F.col("me") != F.col("top")), F.col("me"))).over(group))
    said = known.select(
        "id",
        F.when(F.col("kind") == SHORTER, F.col("word").isNotNull().cast("long")).when(own, F.col("others")).otherwise(F.col("others") - 1).alias("near"),
        F.when(F.col("kind") == SHORTER, F.col("word")).when(own | (F.col("me") != F.col("top")), F.col("top")).otherwise(F.col("second")).alias("best"),
    )
    summed = said.where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return summed.select("id", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.id").alias("best"))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """id and root of the words in `forms` (id, form). A form is FACTOR times as frequent, so a path has few steps; their number is doubled until it is reached."""
    steps, n = 1, LEAST_N
    while n * FACTOR <= most:
        n, steps = n * FACTOR, steps + 1
    up = cut(forms.select("id", F.col("form").alias("root")))
    for _ in range(steps.bit_length()):
        further = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        up = cut(up.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
    return up


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the vocabulary of `docs` (doc_id, text, ...)."""
    words = written(position(counted(docs), ["word"], "id"), "words")
    most = words.agg(F.max("n")).first()[0] or 0
    found = cut(near(words))
    strong = found.join(words.select("id", "n"), "id").where(F.col("best_n") >= FACTOR * F.col("n")).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    forms = cut(strong)
    named = lambda name: words.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name))
    roots = _roots(forms, most).join(forms, "id").select("id", "form_n", F.col("form").alias("form_id"), F.col("root").alias("root_id"))
    roots = roots.join(named("form"), "form_id").join(named("root"), "root_id").select("id", "form", "root", "form_n")
    out = words.join(found.select("id", "n_near"), "id", "left").join(roots, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
