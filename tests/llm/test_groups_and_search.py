"""Near duplicates, components, decontamination, classifier against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from meshwright.llm import components, decontamination, near_duplicates, oracles, quality_model
from meshwright.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(t, size):
    w = WORD.findall((t or "").translate(UPPER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_groups(pairs, size):
    sets = [plain_set(t, size) for _, t in pairs]
    up = list(range(len(pairs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and 100 * common >= 80 * (len(a) + len(b) - common):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True))), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for g in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy) if rng.random() < 0.8 else " \n ".join(copy).upper())
    ids = rng.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(docs, size):
    pairs = corpus(size, 50) + [(20_000, None), (20_001, ""), (20_002, " "), (None, "a b c d e f g"), (20_003, "a b c d e f g"), (20_003, "a b c d e f g"), (None, "only null id here")]
    got = near_duplicates.groups(docs(pairs), size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == plain_groups(pairs, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_equal_the_sql(docs):
    duckdb = pytest.importorskip("duckdb")
    pairs = corpus(7, 60) + [(20_000, None), (20_001, ""), (20_002, " "), (20_003, "a b c d e f g"), (20_004, "A b c d e f g"), (20_005, "one"), (20_006, "ONE")]
    base = duckdb.connect()
    base.execute("create table documents (doc_id bigint, text varchar)")
    base.executemany("insert into documents values (?, ?)", pairs)
    got = near_duplicates.groups(docs(pairs), 2).collect()
    assert sorted(map(tuple, got)) == sorted(base.sql(oracles.OP2).fetchall())


def test_a_large_group_of_near_copies(docs, monkeypatch):
    """Many copies at the limit, several blocks to a bucket."""
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near_duplicates, "BLOCK_ITEMS", 500)
    monkeypatch.setattr(near_duplicates, "LEAST_ITEMS", 1)
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    pairs = []
    for i in range(120):
        copy = base[:]
        for _ in range(rng.randint(2, 9)):
            copy[rng.randrange(60)] = f"v{rng.randrange(400)}"
        pairs.append((i, " ".join(copy)))
    got = near_duplicates.groups(docs(pairs), 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == plain_groups(pairs, 2)


def test_keep_one_and_empty_tables(docs):
    pairs = [(5, "a b c d e f g h"), (3, "A B C D E F G H"), (3, "a b c d e f g h"), (9, "x y z"), (1, None), (2, "")]
    out = near_duplicates.keep_one(docs(pairs))
    assert out.columns == docs([]).columns
    assert sorted(r.doc_id for r in out.collect())[:2] == [1, 2] and {r.doc_id for r in out.collect()} == {1, 2, 3, 9}
    assert near_duplicates.groups(docs([])).count() == 0


def test_keep_one_leaves_a_row_of_each_group_where_ids_repeat(docs):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    pairs = [(5, a), (9, a.upper()), (3, b), (5, b.upper())]
    assert sorted((r.doc_id, r.text) for r in near_duplicates.keep_one(docs(pairs)).collect()) == [(3, b), (5, a)]
    # One id on several texts of a group, and repeated rows, with and without a set.
    pairs = [(4, a), (4, a.upper()), (4, b), (4, b), (6, b), (7, ""), (7, ""), (8, None), (8, None)]
    got = [(r.doc_id, (r.text or "").lower()) for r in near_duplicates.keep_one(docs(pairs)).collect()]
    assert sorted(got) == [(4, a), (4, b), (7, ""), (7, ""), (8, ""), (8, "")]


def test_keep_one_of_rows_without_ids(docs):
    a, b, c = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z aa bb cc dd"
    pairs = [(1, a), (None, a), (None, b), (None, c), (None, c.upper()), (None, c), (None, None), (None, "")]
    got = [(r.doc_id, (r.text or "").lower()) for r in near_duplicates.keep_one(docs(pairs)).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (None, b), (None, c), (None, ""), (None, "")], key=repr)


def test_groups_and_keep_one_of_text_ids(docs):
    rows = [("b7", "one two three four five six seven"), ("a", "one two three four five six seven"), ("x-1", "quite another text of seven words here"), (None, "one two three four five six seven")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates.groups(docs(rows, "string"), size=2).collect()}
    assert got == {"b7": ("a", False), "a": ("a", True), "x-1": ("x-1", True), None: ("a", False)}
    assert {r.doc_id for r in near_duplicates.keep_one(docs(rows, "string"), size=2).collect()} == {"a", "x-1"}


def test_intersections():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 50, 20)) for _ in range(7)]
    b = [np.unique(rng.integers(0, 50, 30)) for _ in range(5)]
    flat = lambda x: (np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x]))
    got = near_duplicates.intersections(*flat(a), 7, *flat(b), 5, step=8)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for same in (0.8, 0.9, 0.99):
        flips = []
        for _ in range(40):
            x = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
            cut = int(1000 * 2 * same / (1 + same))
            y = np.concatenate([x[:cut], rng.integers(0, 1 << 62, 1000 - cut, dtype=np.uint64)])
            _, odd = near_duplicates.sketches(np.array([near_duplicates.samples(x), near_duplicates.samples(y)]))
            flips.append(int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum()))
        n = near_duplicates.BITS
        assert max(flips) <= near_duplicates.most_flips(0.8)
        estimate = 1 + n / (4 * near_duplicates.HASHES) * np.log(1 - 2 * np.mean(flips) / n)
        assert estimate == pytest.approx(same, abs=0.03)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (300, 250)] + [(400, 400 + i) for i in range(1, 30)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100 and got[300] == 250 and got[429] == 400
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination


def plain_words(t):
    return [w for w in (re.sub(r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]", "", x).lower() for x in re.split(r"[\x20\x09-\x0d]+", t or "")) if w]


def edited(rng, words, k):
    words = words[:]
    for _ in range(k):
        at, what = rng.randrange(len(words)), rng.random()
        if what < 0.4:
            words[at] = f"z{rng.randrange(1000)}"
        elif what < 0.7:
            words.insert(at, f"y{rng.randrange(1000)}")
        else:
            del words[at]
    return words


@pytest.fixture(scope="module")
def benchmark_items():
    rng = random.Random(11)
    return [(i, " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randint(15, 60)))) for i in range(60)]


def test_exact_passages_are_all_found(spark, docs, benchmark_items):
    rng = random.Random(12)
    noise = lambda n: [f"w{int(rng.expovariate(0.02))}" for _ in range(n)]
    pairs, want = [], set()
    for d in range(80):
        words = noise(rng.randint(0, 200))
        if d % 2:
            i, t = rng.choice(benchmark_items)
            words = words + t.upper().split() + noise(rng.randint(0, 50))
            words[-1] += "###"
            want.add((d, i))
        pairs.append((d, "\n".join(words)))
    items = spark.createDataFrame([*benchmark_items, (900, None), (901, ""), (902, "too short")], "item_id int, text string")
    got = decontamination.find(docs(pairs), items).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got} and {r.doc_id for r in got} == {d for d, _ in want}
    left = decontamination.drop(docs(pairs), items)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in pairs} - {d for d, _ in want} and left.columns == docs([]).columns


def test_recall_with_edits_is_at_least_the_target(benchmark_items):
    items = decontamination.Items(*map(list, zip(*benchmark_items, strict=True)))
    rng = random.Random(13)
    texts, want = [], []
    for k in range(400):
        i, t = benchmark_items[rng.randrange(len(benchmark_items))]
        words = t.split()
        words = edited(rng, words, int(decontamination.MOST_EDITS * len(words)))
        texts.append(" ".join([f"q{rng.randrange(99)}" for _ in range(30)] + words + ["end"] * 5))
        want.append((k, i))
    found = {(row, item) for row, item, _ in decontamination.matches(pa.array(texts), items)}
    assert sum(x in found for x in want) >= 0.9 * len(want)


@pytest.mark.parametrize("words", [50, 20_000])
@pytest.mark.parametrize("n", [8, 9, 12, 15, 16, 20, 31, 48, 64, 100, 127, 128, 200, 255, 400, 500, 1000])
def test_recall_is_at_least_the_target_at_any_length(n, words):
    """Items of a narrow and a wide vocabulary, with as many edits as allowed."""
    rng = random.Random(n)
    k = 100 if n <= 64 else 20
    draw = lambda: f"w{int(rng.expovariate(1 / words))}"
    pairs = [(i, " ".join(draw() for _ in range(n))) for i in range(k)]
    items = decontamination.Items(*map(list, zip(*pairs, strict=True)))
    texts = [" ".join([draw() for _ in range(30)] + edited(rng, t.split(), int(decontamination.MOST_EDITS * n)) + [draw() for _ in range(20)]) for _, t in pairs]
    found = {(row, item) for row, item, _ in decontamination.matches(pa.array(texts), items)}
    assert sum((i, i) in found for i in range(k)) >= 0.9 * k


def test_search_equals_brute_force():
    """Everything found is within the distance, and of all that is within it at least 0.9 is found."""
    rng = random.Random(31)
    items = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([5, 8, 10, 16, 25, 40]))) for _ in range(12)]
    texts = []
    for _ in range(80):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items).split()
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, item, rng.randint(0, int(0.3 * len(item))))
        texts.append(" ".join(words))
    block = decontamination.Items(list(range(12)), items)
    got = {(row, item): hit[0] for row, item, hit in decontamination.matches(pa.array(texts), block)}
    want = {}
    for row, t in enumerate(texts):
        for i, item in enumerate(items):
            a, least = item.split(), within(item.split(), t.split())
            if least <= (int(decontamination.MOST_EDITS * len(a)) if len(a) >= decontamination.LEAST_WORDS else 0):
                want[row, i] = least
    assert got.keys() <= want.keys() and all(n >= want[k] for k, n in got.items())
    assert len(got) >= 0.9 * len(want) > 40


def within(item, text):
    """Least edit distance of `item` to any run of `text`."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_crafted_words_do_not_collide():
    """Words that collide under polynomials modulo 2**64 of any base get hashes of their own."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    found = W.find_words(*W.text_bytes(pa.array([a + " " + b])))
    assert len(set(found.hashes.tolist())) == 2
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 70))) for _ in range(3000)})
    hashes = W.find_words(*W.text_bytes(pa.array([" ".join(words)]))).hashes
    assert len(set(hashes.tolist())) == len(words)
    # Wherever a word lies, its hash is the same.
    again = W.find_words(*W.text_bytes(pa.array([f"x{i % 7 * 'y'} {w}" for i, w in enumerate(words)])))
    assert again.hashes[again.first[:-1] + 1].tolist() == hashes.tolist()


def test_items_of_few_words_are_found_exactly():
    items = decontamination.Items([7, 8, 9], ["What is it?", "yes", "one two three four five six seven"])
    texts = ["so what is IT now", "what is", "it, yes", "one two three four five six", "one two three four five six seven", None, "what", "is it"]
    assert sorted((row, items.ids[i], hit) for row, i, hit in decontamination.matches(pa.array(texts), items)) == [(0, 7, (0, 1, 3)), (2, 8, (0, 1, 1)), (4, 9, (0, 0, 7))]


def test_alignment_equals_plain_edit_distance():
    rng = random.Random(14)
    for _ in range(60):
        item, text = [rng.randrange(4) for _ in range(6)], [rng.randrange(4) for _ in range(12)]
        best = min(distance(item, text[i:j]) for i in range(13) for j in range(i, 13))
        got = decontamination.align(item, text, 6)
        assert got[0] == best and distance(item, text[got[1] : got[1] + got[2]]) == best


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_words_equal_plain_words():
    texts = ["The, end### É$é x.y", "***", None, "a\x0bB c", "ÀÖ×Þ÷ÿ"]
    hashes, first = decontamination.normal_words(*W.text_bytes(pa.array(texts, pa.string())))
    assert np.diff(first).tolist() == [len(plain_words(t)) for t in texts]
    again, _ = decontamination.normal_words(*W.text_bytes(pa.array([" ".join(plain_words(t)) for t in texts])))
    assert hashes.tolist() == again.tolist()


def test_search_of_odd_rows(spark, odd, docs, benchmark_items):
    items = spark.createDataFrame(benchmark_items, "item_id int, text string")
    assert decontamination.find(odd, items).count() == 0
    assert decontamination.find(docs([]), items).count() == 0
    assert decontamination.find(odd, items.limit(0)).count() == 0
    assert decontamination.drop(odd, items.limit(0)).count() == odd.count()


# --- classifier


def labelled(n, seed):
    rng = random.Random(seed)
    good = ["the", "on", "er", "ti", "re", "an", "tion", "st", "hea"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(good) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        label = int(rng.random() < 0.8)
        rows.append((i, " ".join(words) if label else " | ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in words), label))
    return rows


def test_held_out_accuracy_and_calibration(spark, docs):
    rows = labelled(600, 15)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.classify(docs([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")]), labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 150 < len(held) < 250
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert abs(np.mean([r.score for r in held]) - np.mean([truth[r.doc_id] for r in held])) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and len(got) == 602
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_scores_without_labels_or_rows(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.classify(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.predicted for r in quality_model.classify(odd, one).collect()} == {1}
    assert quality_model.classify(docs([]), one).count() == 0
