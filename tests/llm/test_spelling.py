"""Spelling variants against SQL and all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from meshwright.llm import oracles, spelling

SCHEMA = "doc_id {}, text string, word string, n int, id string, kind int, form string"


@pytest.fixture()
def table(spark):
    """A documents table with columns that clash with the operator's own."""
    return lambda rows, kind="long": spark.createDataFrame([(*r, "w", 1, "i", 2, None) for r in rows], SCHEMA.format(kind))


def near(a, b):
    """Whether one replaced, inserted or deleted code point makes a of b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    found, form = {}, {}
    for w in n:
        others = sorted((-n[x], x) for x in n if abs(len(x) - len(w)) < 2 and near(w, x))
        found[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], found[w], n.get(form[w])) for w in n)


def corpus(seed, longest):
    """Words of few letters and their variants, in chains of ever more frequent ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        word, n = "".join(rng.choice("abéÀz") for _ in range(rng.randint(6, longest))), 5
        for _ in range(rng.randint(1, 4)):
            texts += [word] * rng.randint(n, n + 3)
            i = rng.randrange(len(word))
            word = rng.choice([word[:i] + rng.choice("abéz") + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + rng.choice("abéz") + word[i:]])
            n = min(n * 5, 700)
    rng.shuffle(texts)
    rows = [(i if i % 17 else None, rng.choice(" ,.-1\n中ÿ"[:7]).join(texts[i * 40 : i * 40 + 40])) for i in range(len(texts) // 40 + 1)]
    return rows + [(1, None), (2, ""), (None, "ÄÖÜÄÖÜ äöüäöü"), (3, "aaaaaa " * 30), (3, "aaaaaa " * 30), (4, "aaaaaaa " * 6), (5, "×÷×÷×÷ ×÷×÷×÷÷ " * 7)]


@pytest.mark.parametrize(("seed", "longest", "limit"), [(1, 9, 64), (2, 12, 7), (3, 80, 64), (4, 8, 5)])
def test_groups_equal_all_pairs(table, monkeypatch, seed, longest, limit):
    monkeypatch.setattr(spelling, "LONG", limit)
    rows = corpus(seed, longest)
    want = plain(rows)
    assert sorted((tuple(r) for r in spelling.group(table(rows)).collect())) == want
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)


def test_groups_equal_the_sql(table):
    duckdb = pytest.importorskip("duckdb")
    rows = corpus(6, 10)
    base = duckdb.connect()
    base.execute("create table documents (doc_id bigint, text varchar)")
    base.executemany("insert into documents values (?, ?)", rows)
    got, want = spelling.group(table(rows)), base.sql(oracles.OP12)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_words_of_any_length(table):
    """A very long word costs a key for each place, not its length in each of them."""
    long = "abcdefgh" * 5000
    rows = [(1, f"{long} " * 50), (2, f"{long[:777]}z{long[778:]} " * 5), (3, f"{long[:9000]}{long[9001:]} " * 5), (4, f"{long}q " * 5)]
    assert sorted(tuple(r) for r in spelling.group(table(rows)).collect()) == plain(rows)


def test_ids_as_text_and_empty_tables(table):
    rows = [("a1", "misspelt " * 6), ("b", "mispelt " * 40)]
    assert sorted(tuple(r) for r in spelling.group(table(rows, "string")).collect()) == plain(rows)
    assert spelling.group(table([])).collect() == []


def test_no_python_for_words_of_common_length(spark, table):
    plan = spelling.counted(table([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
