"""Source divergence against SQL and plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshwright.llm import divergence, oracles


def table(spark, rows):
    """(lang, source, text) rows, with columns that clash with the operator's own."""
    return spark.createDataFrame([(i, *r, 1, "x", "y") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n int, term string, chunk string")


def corpus(seed=3, docs=300, sources=9):
    rng = random.Random(seed)
    words = [f"{rng.choice(['a', 'É', 'z', '中', 'ß'])}{'abcdefghij'[rng.randrange(10)]}{'klmno'[rng.randrange(5)]}" for _ in range(80)]
    rows = [(rng.choice(["en", "de"]), f"s{min(rng.randrange(sources), rng.randrange(sources))}", " ".join(rng.choice(words).upper() if rng.random() < 0.1 else words[int(80 * rng.random() ** 2)] for _ in range(rng.randint(0, 30)))) for _ in range(docs)]
    odd = [(None, "s1", "null lang"), ("", "s2", "null lang x1y"), ("en", None, "aak"), ("fr", "s0", None), ("fr", "s1", ""), ("fr", "s2", "rare"), ("en", "s0", "A" * 50_000), ("en", "empty", " \t 1 2 3"), ("en", "s0", "É[É@é`é{x\x7fy")]
    return rows + odd + [rows[0]] * 3


def plain(rows, least):
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        own = {s: Counter({t: counts[lang, s][t] for t in kept}) for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())
        share = {s: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in [*own.items(), (None, whole)]}
        for s in own:
            pairs = [(-sum(abs(share[s][t] - share[x][t]) for t in kept), x.encode()) for x in own if x != s]
            terms = [(share[None][t] - share[s][t], t.encode()) for t in kept if own[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least", [2, 30, 10_000])
def test_audit_equals_brute_force(spark, monkeypatch, least):
    for name, small in (("CHUNK", 4), ("SPAN", 3), ("LEAST_BLOCK", 2), ("MOST_BLOCK", 3)):
        monkeypatch.setattr(divergence, name, small)
    rows = corpus()
    got = sorted(tuple(r) for r in divergence.audit(table(spark, rows), least).collect())
    assert got == plain(rows, least)


def test_audit_equals_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = corpus(seed=8, docs=400, sources=5)
    base = duckdb.connect()
    base.execute("create table documents (lang varchar, source varchar, text varchar)")
    base.executemany("insert into documents values (?, ?, ?)", rows)
    got = divergence.audit(table(spark, rows))
    want = base.sql(oracles.OP11)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) == plain(rows, 30)


def test_empty_table(spark):
    assert divergence.audit(table(spark, [])).collect() == []


def test_shares_are_exact_for_large_counts():
    rng = random.Random(2)
    totals = [rng.randrange(10**10, 9 * 10**15) for _ in range(500)]
    counts = [rng.randrange(t - 5) for t in totals]
    got = divergence.shares(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 1_000_000_000 * (c + 5) // t for c, t in zip(counts, totals, strict=True)]


def test_terms_are_ranked_by_partial_limits(spark):
    """Only the leading terms of each partition are shuffled for the ranks."""
    found = divergence.Audit(table(spark, corpus()), 2)
    ranked = divergence._ranked(found.terms(), "term").where("rank <= 50")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
