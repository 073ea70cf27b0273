"""Quality rules, tokens, packing, records and token counts against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meshwright.llm import packing, quality_rules, records, token_counts, tokens
from meshwright.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODDITIES = "aAÉéßẞİıςΣσ é'sst'Tll   \x0b\x0c\x1c\x1d\x85á ññ<|endoftext|> ½²③٣5中文👍🏽\n\t.,!?$%×÷ªºµÿŸ"


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODDITIES) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# --- quality rules


def plain_rules(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    r = sum(hit)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, len(w) < 20 or 100 * r > 30 * len(w)


def test_rules_equal_plain_counts():
    rng = random.Random(2)
    texts = [*random_texts(200), None, "", " ", "a\n a\na\n\na"] + [" ".join(rng.choice("ab c# d\n") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    got = list(zip(*(x.to_pylist() for x in quality_rules.measure_batch(pa.array(texts, pa.string()), quality_rules.Bands())[:6]), strict=True))
    assert got == [plain_rules(t) for t in texts]


def test_bands_reject_repetition_and_noise():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    prose = " ".join("".join(rng.choice(["the", "on", "er", "ti", "re", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(900))
    noise = " ".join("".join(rng.choice(letters + letters.upper() + "0123456789-_") for _ in range(9)) for _ in range(900))
    same = "".join(f"row {i % 7} of the very same table with little news\n" for i in range(300))
    kept = quality_rules.measure_batch(pa.array([prose, noise, same]), quality_rules.Bands())[6].to_pylist()
    assert kept == [True, False, False]


def random_words(rng, alphabet, n):
    out = ""
    while len(out) < n:
        out += "".join(rng.choice(alphabet) for _ in range(rng.randint(3, 10))) + " "
    return out[:n]


@pytest.mark.parametrize("n", [200, 600, 2000, 8000])
def test_bands_reject_noise_of_any_length(n):
    rng = random.Random(n)
    figures = "".join(map(chr, range(33, 127)))
    letters = "".join(x for x in figures if x.isalnum())
    texts = [random_words(rng, x, n) for x in (figures, letters) for _ in range(10)]
    got = quality_rules.measure_batch(pa.array(texts), quality_rules.Bands())
    assert not any(got[6].to_pylist())
    assert any(x.as_py() >= 20 for x in got[0])


def test_bands_reject_documents_that_end_in_noise():
    rng = random.Random(5)
    parts = [a + b for a in ("the", "on", "er", "ti", "re", "an", "ol", "ke", "mi", "sa", "u", "pro") for b in ("n", "st", "me", "ver", "a", "cti", "ing", "ous", "be", "da")]
    prose = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))[:n]
    figures = "".join(map(chr, range(33, 127)))
    texts = [prose(32768), prose(6000), prose(18 << 10) + random_words(rng, figures, 14 << 10), prose(4096) + random_words(rng, figures, 1900)]
    kept = quality_rules.measure_batch(pa.array(texts), quality_rules.Bands())[6].to_pylist()
    assert kept == [True, True, False, False]


def test_rules_query_and_filter(odd, docs):
    rows = {(r.doc_id, r.n_words, r.kept) for r in quality_rules.measure(odd).collect()}
    assert (1, 0, False) in rows and (5, 40_000, False) in rows and len(rows) == 7
    out = quality_rules.filter_documents(odd)
    assert out.columns == odd.columns and out.count() == 0
    assert quality_rules.measure(docs([])).count() == 0


# --- tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_equal_whole_texts(library):
    texts = [*random_texts(1500), "don't DON'T we'll I'd 's '", "<|startoftext|> x", "a<|endoftext|>b", "a < | b", ""]
    ids, bounds = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode_rows(texts)
    whole = library.encode_batch(texts, add_special_tokens=False)
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in whole]


def test_a_small_memory_changes_nothing():
    texts = random_texts(300, 9)
    path = public_tokenizers.path("word_bpe_49k.json")
    big, small = tokens.Encoder(path), tokens.Encoder(path, 60)
    for t in texts:
        assert big.encode_rows([t])[0].tolist() == small.encode_rows([t])[0].tolist()


# --- packing


def test_differencing_partitions():
    rng = random.Random(4)
    for _ in range(60):
        sizes, k = [rng.randint(1, 100) for _ in range(rng.randint(0, 40))], rng.randint(1, 9)
        found = packing.differencing(sizes, k)
        assert sorted(i for x in found for i in x) == list(range(len(sizes))) and len(found) <= k
    # opposing imbalances cancel: the classic example comes out even but for 2
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in x) for x in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_window_count_rises():
    assert len(packing.windows([6, 6, 6], 10, 1.0)) == 3
    # Without room for a third window's padding one piece is cut.
    assert sorted(sum(n for _, _, n in x) for x in packing.windows([6, 6, 6], 10)) == [8, 10]
    assert packing.windows([], 10) in ([], [[]])


def test_windows_hold_all_parts_and_cut_few():
    rng = random.Random(6)
    for _ in range(40):
        sizes = [min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(rng.randint(1, 200))]
        found = packing.windows(sizes, 2048)
        assert all(sum(n for _, _, n in x) <= 2048 for x in found)
        for i, size in enumerate(sizes):
            parts = sorted((at, n) for x in found for j, at, n in x if j == i)
            assert [at for at, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == size
        assert sum(map(len, found)) <= len(sizes) + 2 * len(found)
        assert len(found) * 2048 - sum(sizes) <= 2048 + packing.SLACK * sum(sizes)


def test_differencing_makes_nearly_all_windows():
    rng = random.Random(8)
    sizes = [min(2048, int(rng.lognormvariate(6.3, 0.8)) + 1) for _ in range(3000)]
    fit = packing.fitting(sizes, 2048)
    assert all(sum(sizes[i] for i in x) <= 2048 for x in fit)
    found = packing.windows(sizes, 2048)
    # Windows taken apart, documents cut and padding are all few, and the other windows still hold what they held, and little else.
    assert len(fit) - len(found) <= 0.06 * len(fit) and len(found) * 2048 <= 1.01 * sum(sizes)
    assert sum(n > 1 for n in Counter(i for x in found for i, _, _ in x).values()) <= 0.05 * len(sizes)
    whole = {frozenset(i for i, at, n in x if n == sizes[i]) for x in found}
    assert sum(frozenset(x) in whole for x in fit) >= 0.94 * len(fit)


def test_hardly_any_two_pieces_fit_together():
    for size, n in ((1100, 500), (2048, 300), (700, 500)):
        found = packing.windows([size] * n, 2048)
        assert sum(m for x in found for _, _, m in x) == size * n and len(found) <= 1 + 1.005 * size * n / 2048


def test_pack_covers_every_id_once(docs, library):
    rng = random.Random(5)
    pairs = [(i, " ".join(rng.choice(["alpha", "Beta!", "x1"]) for _ in range(rng.choice([0, 1, 30, 700, 5000])))) for i in range(40)] + [(None, "no id"), (99, None), (7, "again")]
    got = packing.pack(docs(pairs), block=64).collect()
    want = Counter()
    for i, t in pairs:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    have, by = Counter(), {}
    for r in got:
        have[r.doc_id] += r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == want
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    one = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in pairs if d not in (7,)}
    for r in got:
        if r.doc_id in one:
            assert zlib.crc32(one[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(one[r.doc_id])
    full = sum(want.values())
    assert len(by) * 2048 < 1.02 * full + 4 * 2048
    # Documents that fit a window lie in few.
    spread = [len({r.sequence_id for r in got if r.doc_id == i}) for i, t in pairs if i in one and 1 < len(one[i]) <= 2048]
    assert sum(spread) <= 1.5 * len(spread)
    assert packing.pack(docs([])).count() == 0


# --- records


def test_frames_and_faults():
    a = records.frame(5, np.array([1, 70_000], np.uint32)) + records.frame(None, np.array([3], np.uint32)) + records.frame(6, np.zeros(0, np.uint32))
    assert [(d, x.tolist()) for _, _, d, x in records.frames(a)] == [(5, [1, 70_000]), (None, [3]), (6, [])]
    for at in (0, 9, 20, len(a) - 1):
        broken = bytearray(a)
        broken[at] ^= 1
        with pytest.raises(records.BadRecord):
            list(records.frames(bytes(broken)))
    with pytest.raises(records.BadRecord):
        list(records.frames(a[:-3]))


def test_round_trip_counts_all_ids_before(docs, library):
    pairs = [(9, "nine nine"), (3, "Three\nthree"), (7, None), (5, ""), (None, "no id")]
    got = {r.doc_id: tuple(r)[1:] for r in records.round_trip(docs(pairs)).collect()}
    at = 0
    for d, t in sorted(pairs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert records.round_trip(docs([])).count() == 0
    assert records.round_trip(docs([(4, "a"), (4, "a"), (4, "b")])).count() == 3
    with pytest.raises(ValueError):
        records.round_trip(docs([("x", "a")], "string"))


def test_shuffled_reads_seek_to_the_frames(spark, docs, library, tmp_path):
    rng = random.Random(43)
    pairs = [(rng.randrange(10**6), " ".join(rng.choice(["alpha", "Beta", "x1"]) for _ in range(rng.randint(0, 50)))) for _ in range(300)]
    folder = f"file://{tmp_path}"
    records.write(docs(pairs), folder, files=7)
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in pairs}
    index = records.shuffled(spark, folder, 5)
    order = [(r.file, r.position) for r in index.collect()]
    assert len(order) == 300 and len({f for f, _ in order}) > 3 and order != sorted(order) and order == [(r.file, r.position) for r in records.shuffled(spark, folder, 5).collect()]
    part = index.limit(40)
    assert sorted((r.doc_id, r.ids) for r in records.fetch(spark, folder, part).collect()) == sorted((r.doc_id, want[r.doc_id]) for r in part.collect())
    seeker = records.Seeker(spark, folder)
    for row in part.collect()[:5]:
        doc_id, ids = seeker.get(row)
        assert (doc_id, ids.tolist()) == (row.doc_id, want[row.doc_id])
    with pytest.raises(records.BadRecord):
        seeker.get(row.asDict() | {"ids_crc32": 1})
    at, got = 0, {r.doc_id: r for r in records.read(spark, folder).collect()}
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens) == (at, len(want[i]))
        at += len(want[i])
    # An index that says something else is noticed.
    wrong = spark.read.parquet(f"{folder}/index").withColumn("n_tokens", records.F.col("n_tokens") + 1).collect()
    spark.createDataFrame(wrong, records.INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    with pytest.raises(Exception, match="not what the index says"):
        records.read(spark, folder).collect()


def test_files_are_ordered_by_number(spark):
    names = spark.createDataFrame([(f"part-{i:05d}-x.txt",) for i in (99_999, 100_000, 7)], "file string")
    assert [r.n for r in names.select(records._number(records.F.col("file")).alias("n")).orderBy("n").collect()] == [7, 99_999, 100_000]


# --- token counts


def plain_best(word, v):
    """Score and pieces of the likeliest segmentation."""
    word, best = token_counts.MARK + word, [(0.0, [])]
    for i in range(1, len(word) + 1):
        c = (-math.inf, [])
        for j in range(i):
            k = v.ids.get(word[j:i])
            if k is not None and best[j][0] + v.scores[k] > c[0]:
                c = (best[j][0] + v.scores[k], [*best[j][1], k])
        if word[i - 1] not in v.ids:
            n = len(word[i - 1].encode())
            if best[i - 1][0] + n * v.scores[v.byte] > c[0]:
                c = (best[i - 1][0] + n * v.scores[v.byte], [*best[i - 1][1], *[v.byte] * n])
        best.append(c)
    return best[-1]


def some_scores():
    """The vocabulary with the scores of Zipf's law by rank."""
    v = token_counts.Given("piece_bpe_32k.model").vocabulary
    return v.refit({i: 10**7 // (i + 1) for i in range(len(v.pieces) + 1)})


def test_trie_equals_plain_dynamic_program(monkeypatch):
    own = token_counts.Trie(some_scores())
    monkeypatch.setattr(token_counts, "MOST_NODES", 500)
    monkeypatch.setattr(own.known, "most", 700)
    texts = [*random_texts(200, 6), "the the there then thermal", "x" * 300, "the中" * 100, "", None]
    for t in texts[:50]:  # some are stored, some forgotten again
        token_counts.count_rows(*W.text_bytes(pa.array([t], pa.string())), own)
    words, counts, score = token_counts.count_rows(*W.text_bytes(pa.array(texts, pa.string())), own)
    for i, t in enumerate(texts):
        each = [plain_best(w, own.vocabulary) for w in WORD.findall(t or "")]
        assert (words[i], counts[i]) == (len(each), sum(len(k) for _, k in each))
        assert score[i] == pytest.approx(sum(s for s, _ in each), abs=1e-6, rel=1e-9)


def odd_words(n, seed, alphabet="aAÉéßing中👍x▁.\x00"):
    rng = random.Random(seed)
    return [token_counts.MARK + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_nodes_of_a_trie_are_scored_at_once(monkeypatch):
    """Not one by one in Python, which took most of the operator's CPU seconds: a trie takes as many steps as a piece has letters, however many words it has."""
    own = token_counts.Trie(some_scores())
    monkeypatch.setattr(token_counts.Vocabulary, "extend", lambda *_: pytest.fail("a node on its own"))
    texts = pa.array([" ".join(x[1:] for x in odd_words(n, n)) for n in (300, 20_000)])
    assert token_counts.count_rows(*W.text_bytes(texts), own)[0].tolist() == [300, 20_000]
    steps, follow = [], token_counts.Endings.follow
    monkeypatch.setattr(token_counts.Endings, "follow", lambda *a: steps.append(1) or follow(*a))
    own.lists_of(odd_words(20_000, 7))
    assert 0 < len(steps) <= max(map(len, own.vocabulary.pieces)) + 1


@pytest.mark.parametrize("most", [1, 90, 500_000])
def test_tries_cut_as_single_words_do(monkeypatch, most):
    monkeypatch.setattr(token_counts, "MOST_NODES", most)
    words = [*odd_words(1500, 9), *odd_words(1500, 10, "thein"), *["▁" + "thein" * 60, "▁the", "▁", "▁the", "▁" + "é" * 255, "▁" + "é" * 256, "▁" + "中👍" * 120]]
    for v in (some_scores(), some_scores().refit({})):  # without counts ties are everywhere
        flat, sizes = token_counts.Trie(v).lists_of(words)
        assert flat.tolist() == [k for x in words for k in v.long_pieces(x)]
        assert sizes.tolist() == [len(v.long_pieces(x)) for x in words]
    assert [len(x) for x in token_counts.Trie(v).lists_of([])] == [0, 0]


def test_long_words_stay_out_of_the_trie():
    own = token_counts.Trie(some_scores())
    token_counts.count_rows(*W.text_bytes(pa.array(["ab" * 100_000])), own)
    assert len(own.score) == 1


def test_scores_are_fitted_to_the_corpus(docs):
    rng = random.Random(41)
    texts = [" ".join(rng.choice(["there", "then", "thermal", "x中y", "été"]) for _ in range(30)) for _ in range(40)] + [None, ""]
    df = docs(list(enumerate(texts)))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    v = token_counts.Given("piece_bpe_32k.model").vocabulary
    want = Counter(v.byte if model.is_byte(k) else v.ids[model.id_to_piece(k)] for t in texts for w in WORD.findall(t or "") for k in model.encode(w))
    assert token_counts.piece_counts(df, lambda: token_counts.Given("piece_bpe_32k.model"), v.byte) == want
    likeliest = Counter(k for t in texts for w in WORD.findall(t or "") for k in plain_best(w, v.refit(want))[1])
    assert token_counts.piece_counts(df, lambda: token_counts.Trie(v.refit(want)), v.byte) == likeliest
    fitted = token_counts.fit(df)
    total = math.log(sum(math.exp(x) for x in fitted.scores[:-1]) + 256 * math.exp(fitted.scores[-1]))
    assert total == pytest.approx(0, abs=1e-9) and fitted.pieces == v.pieces and fitted.scores == v.refit(want).scores
    by_rounds = [sum(r.score for r in token_counts.count(df, rounds=k).collect()) for k in (0, 1, 2)]
    assert by_rounds[0] <= by_rounds[1] + 1e-6 <= by_rounds[2] + 2e-6


def test_vocabularies_of_another_form_go_through_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*random_texts(100, 3), "Two  Spaces\n\n", "<|endoftext|>"]
    ids, bounds = tokens.Encoder(path).encode_rows(texts)
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in whole]
    assert tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).by_pieces


def test_counts_of_odd_rows(odd, docs):
    rows = token_counts.count(odd).collect()
    assert len(rows) == 8 and {(r.n_words, r.n_tokens, r.score) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 0, 0.0)}
    assert token_counts.count(docs([])).count() == 0
