"""Site templates, personal data and quotation linking."""

import hashlib
import random
import re
import time

import pytest

from meshwright.llm import oracles, personal_data, quotation, site_templates

# --- pages


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; <b>more", "just text & more"),
        ("<p>a<!-- x <p>b", "ab"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><p>x", "x"),
        ("<article><header><h1>T &lt; t</h1></header><p>a<b>b</b>  c<br>d<p>e<ul><li>1<li>2</ul><div class='comments'>z</div><form>f</form>tail</article><footer>f</footer>", "T < t\nab c d\ne\n1\n2\ntail"),
        ("<body><header>site</header><nav>m</nav><div id=cookie-notice>c</div><p>one</p><aside>s</aside><div class='adSlot ad'>x</div><p>two &copy &#228;&#x1F44D;</body>", "one\ntwo © ä👍"),
        ("<article><h1>h</h1><article class=comment>c</article><p hidden>no<p style='display: none'>no<p>yes</article>", "h\nyes"),
        ("<main><p>in</main><p>out", "in"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>1 < 2 and <3</p><p title='a>b'>q", "1 < 2 and <3\nq"),
        ("</p></div><p>x</b></i>", "x"),
        # Names within a marked article: containers that hold less than half of it, comments of any size, prose only as adverts.
        ("<article><p class=notice>one two three</p><div class='related-work'>four</div><div class=related>no</div><p>five</article>", "one two three\nfour\nfive"),
        ("<article><div class='share notice'>all of the text lies in here</div><p>end</article>", "all of the text lies in here\nend"),
        ("<article><p>one<div class=comments-list><p>z z z z z z z z</div><div id=user-comments>z</div><ul class='comment-thread x'><li>z</ul><p>end</article>", "one\nend"),
        ("<article><p>one two three four<div class='ad-slot ad-slot-2'>z</div><p class=advert>z<p class=comment>kept<p>end</article>", "one two three four\nkept\nend"),
        ("<article class=comment><p>An opinion.</article>", "An opinion."),
        ("<div id=story><p>Told.</div><article class=comment>z</article>", "Told."),
        # Names elsewhere: whole ones, or made of words of place and shape.
        ("<div class='social-history'><p>a</div><div id=share-prices>b</div><div class=relatedWork>c</div>", "a\nb\nc"),
        ("<div class=socialBar>z</div><div class=cookie-notice>z</div><div class=site-header>z</div><div class=article-header>t</div><div id=comments2>z</div><p>x", "t\nx"),
    ],
)
def test_main_text(html, text):
    assert site_templates.main_text(html) == (text, 0)


def test_deep_and_broken_pages_end():
    assert site_templates.main_text("<div>" * 20_000 + "x")[0] == "x"
    assert site_templates.main_text("<!--" * 20_000 + "x") is not None
    assert site_templates.main_text("<a b='" * 3_000) is not None


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, template int")


def test_recurring_subtrees_are_deleted_per_host(spark):
    box = "<section><p>Our site. Since 1999.</p></section>"
    rows = [(i, f"https://A.example/{i}?x", f"<body>{box}<p>Story number {i} is told here.</p></body>") for i in range(8)]
    rows += [(100 + i, f"https://b.example/{i}", f"<body>{box}<p>Other tale {i}.</p></body>") for i in range(2)]
    rows += [(200 + i, "https://c.example/", "<article><section><p>One article, copied.</p></section></article>") for i in range(8)]
    rows += [(None, None, None), (300, "odd url", ""), (0, *rows[0][1:])]
    got = site_templates.extract(pages(spark, rows)).collect()
    text = {}
    for r in got:
        text.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert len(got) == len(rows) and text[0] == ["Story number 0 is told here."] * 2
    assert text[101] == ["Our site. Since 1999.\nOther tale 1."]
    assert text[205] == ["One article, copied."] and text[None] == [""] and text[300] == [""]
    assert site_templates.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("page", ["<body><main>{}</main></body>", "<body>{}</body>", "<body><div class=story>{}</div></body>", "<article>{}</article>"])
def test_recurring_headings_and_paragraphs_are_content(spark, page):
    """Only recurring containers are template, not what pages happen to say alike."""
    own = "<h2>Introduction</h2><p>Tale {0} begins.</p><p>* * *</p><p>And ends, {0}.</p><h2>References</h2><p>Thanks for reading.</p>"
    rows = [(i, "http://x.example/", page.format(own.format(i))) for i in range(12)]
    got = {r.page_id: (r.text, r.n_template) for r in site_templates.extract(pages(spark, rows)).collect()}
    assert got == {i: (f"Introduction\nTale {i} begins.\n* * *\nAnd ends, {i}.\nReferences\nThanks for reading.", 0) for i in range(12)}


def test_a_template_recurs_in_one_place_and_on_many_of_a_large_host_s_pages(spark):
    """A box on five pages is template where the host has few pages or the box one place, but not on a host of many."""
    box = "<div><p>As seen before.</p></div>"
    page = lambda i, x: f"<body>{x}<p>Tale {i}.</p></body>"
    rows = [(i, "http://few.example/", page(i, box)) for i in range(5)]
    rows += [(100 + i, "http://many.example/", page(i, box if i < 5 else "")) for i in range(1300)]
    rows += [(2000 + i, "http://places.example/", page(i, "<section>" * i + box + "</section>" * i)) for i in range(6)]
    got = {r.page_id: r.text for r in site_templates.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"Tale {i}." for i in range(5))
    assert all(got[100 + i] == f"As seen before.\nTale {i}." for i in range(5)) and got[1000] == "Tale 900."
    assert all(got[2000 + i] == f"As seen before.\nTale {i}." for i in range(6))
    found = {(r.host, r.subtree) for r in site_templates.templates(pages(spark, rows)).collect()}
    assert found == {(h, x - (1 << 63)) for h, v in plain_templates(rows, 5).items() for x in v} and {h for h, _ in found} == {"few.example"}


def plain_templates(rows, least, rare=200):
    """Host -> hashes of the subtrees on `least` and one in `rare` of its pages of different content, by counting them one by one."""
    seen, all_pages = {}, {}
    for _, url, html in rows:
        about, found = site_templates.subtrees(html)
        all_pages.setdefault(site_templates.host_of(url), set()).add(about)
        for x in found:
            seen.setdefault((site_templates.host_of(url), x), set()).add(about)
    out = {}
    for (host, x), pages_of in seen.items():
        if len(pages_of) >= max(least, len(all_pages[host]) / rare):
            out.setdefault(host, set()).add(x)
    return out


@pytest.mark.parametrize("most_sent", [0, 1000])
def test_templates_equal_brute_force(spark, most_sent):
    """Menus and boxes without telling names or tags: only their recurrence gives them away."""
    rng = random.Random(29)
    tale = lambda: "".join(f"<p>{' '.join(rng.choice('abcdefgh') * 3 for _ in range(9))} {rng.random()}</p>" for _ in range(3))
    rows = []
    for host in range(4):
        menus = [f"<div><ul><li>Home {host}{k}</li><li>News</li></ul></div>" for k in range(3)]
        for i in range((30, 12, 5, 3)[host]):
            body = rng.choice(menus) + f"<div><div>{tale()}</div><div>All rights of {host}</div></div>"
            rows.append((len(rows), f"http://h{host}.example/{i}", f"<body>{body}</body>"))
    want, templates = {}, plain_templates(rows, 5)
    for i, url, html in rows:
        want[i] = site_templates.main_text(html, frozenset(templates.get(site_templates.host_of(url), ())))
    got = {r.page_id: (r.text, r.n_template) for r in site_templates.extract(pages(spark, rows), most_sent=most_sent).collect()}
    assert got == want
    assert all("Home" not in got[i][0] and "rights" not in got[i][0] and got[i][1] >= 2 for i in range(30))
    assert all("rights" in got[i][0] for i in range(47, 50)) and all(t.count("\n") >= 2 for t, _ in got.values())
    assert sum(n > 0 for _, n in got.values()) >= 42


def test_a_template_around_the_article_goes_before_the_article_is_chosen(spark):
    box = "<div><article><h2>Subscribe to us</h2><p>Every week.</p></article></div>"
    rows = [(i, "http://x.example/", f"<body><section><p>Plain boilerplate text.</p></section><article><p>Tale {i}.</p></article></body>") for i in range(6)]
    got = site_templates.extract(pages(spark, rows)).collect()
    assert {r.text for r in got} == {f"Tale {i}." for i in range(6)} and {r.n_template for r in got} == {1}
    assert site_templates.main_text(box)[0] == "Subscribe to us\nEvery week."


def test_host():
    assert [site_templates.host_of(u) for u in ("https://u:p@WWW.x.org:80/a", "//y.net?q", "mailto:x", None)] == ["www.x.org", "y.net", "", ""]


# --- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_equal_plain_patterns(docs):
    rng = random.Random(16)
    alphabet = "aZ9.@-+ ()%1234567890éß中👍_\n@."
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["4111 1111 1111 1111 x 4111-1111-1111-1112", "a@b.cd_x@e.fg a@b.cd.@x.y", "1.2.3.4.5.6.7.8 001.002.255.0000", "9" * 5000, "x@" * 2000, "1." * 2000, "1 " * 3000 + "a@b.co", "+" * 2000 + "1", "a@b.co " * 700, "é👍 +1 (743) 555-3824 😀 jo@x.org", None, ""]
    got = {r.doc_id: r for r in personal_data.find(docs(list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, x, _ in want) for k in range(4)), t
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r.spans.split(",")) or not want


def test_weak_supervision_adds_what_the_labelers_agree_on(docs):
    pairs = [(i, f"write to name{i}@mail.com or call +1 (212) 555-{1000 + i}, server 10.2.3.{i}") for i in range(60)]
    pairs += [(100 + i, f"order no {9000 + i} 99999999999999{i:02d}x and 999.888.777.{i}") for i in range(40)]
    pairs += [(200, "phone (212) 555-0199 today"), (201, "mail jo [at] mail [dot] com please")]
    got = {r.doc_id: r.spans for r in personal_data.find(docs(pairs)).collect()}
    assert got[200] == "phone:6:20" and got[201] == "email:5:27"
    assert all(got[100 + i] == joined(base_spans(pairs[60 + i][1])) for i in range(40))


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = random.Random(17)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple((1 if y else -1) * (1 if rng.random() < p else -1) for p in (0.95, 0.9, 0.5, 0.85))
        counts[(0, *votes)] = counts.get((0, *votes), 0) + 1
    prior, table, share = personal_data.em(counts)
    assert prior == pytest.approx(0.4, abs=0.05)
    assert table["check", 1, 1] == pytest.approx(0.95, abs=0.04) and table["cue", 1, 1] == pytest.approx(0.5, abs=0.08)
    bias, weights = personal_data.train(counts, share)
    assert weights["check", 1] - weights["check", -1] > weights["cue", 1] - weights["cue", -1] + 1


def test_redaction_and_odd_rows(docs, odd):
    out = personal_data.redact(docs([(1, "é👍 jo@x.org, 1.2.3.4 end"), (2, "clean"), (None, None), (4, "a@b.co")]))
    assert out.columns == docs([]).columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, "é👍 <EMAIL>, <IP> end"), (2, "clean"), (None, None), (4, "<EMAIL>")}
    assert personal_data.find(odd).count() == 8 and {r.spans for r in personal_data.find(odd).collect()} == {""}
    assert personal_data.find(docs([])).count() == 0


def test_redaction_leaves_clashing_columns_alone(spark):
    made = [n for name, *_ in personal_data.PATTERNS for n in (name, f"{name}_v", f"{name}_p")]
    names = ["t", "raw", "cands", "base", "added", "spans", "own1", "a.b", *made]
    rows = [(1, "mail jo@x.org or +1 212 555 0199", *names), (2, None, *[None] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = personal_data.redact(df)
    assert out.schema == df.schema
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got == {1: (1, "mail <EMAIL> or <PHONE>", *names), 2: rows[1]}


def test_redaction_of_long_texts_and_overlaps(docs, monkeypatch):
    rng = random.Random(23)
    texts = ["".join(rng.choice(["a@b.cd", " 1.2.3.4", "+1 (212) 555-0199", "x", "é👍 ", ". ", "4111 1111 1111 1111"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["jo@x.org " * 3000]

    def plain(t, spans):
        out, at = "", 0
        for kind, s, e in spans:
            if s >= at:
                out += t[at:s] + f"<{kind.upper()}>"
            at = max(at, e)
        return out + t[at:]

    found = {r.doc_id: [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in personal_data.find(docs(list(enumerate(texts)))).collect()}
    for chunk in (7, 4096):
        monkeypatch.setattr(personal_data, "CHUNK", chunk)
        got = {r.doc_id: r.text for r in personal_data.redact(docs(list(enumerate(texts)))).collect()}
        assert got == {i: plain(t, found[i]) for i, t in enumerate(texts)}


def test_time_is_linear_in_a_text(docs):
    took = []
    for n in (4_000, 16_000):
        started = time.perf_counter()
        (row,) = personal_data.find(docs([(1, "a@b.cd " * n)])).collect()
        took.append(time.perf_counter() - started)
        assert row.n_email == n
    assert took[1] < 8 * max(took[0], 0.5)


def test_main_path_is_native(docs):
    df = personal_data.with_candidates(docs([(1, "a@b.co")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_phone_with_a_long_run_inside(docs):
    number = "+1 234" + "." * 5000 + "567 8901"
    (row,) = personal_data.find(docs([(1, f"call {number} now")])).collect()
    assert (row.n_phone, row.base_sha256) == (1, hashlib.sha256(f"phone:5:{5 + len(number)}".encode()).hexdigest())
    many = "+1" + "23 " * 5000
    assert personal_data.find(docs([(1, many)])).collect()[0].n_phone == 0


# --- quotations


def test_replies_and_threads(spark):
    rows = [
        (1, 0, "user", "Hello there my good friend.\nHow are you doing today?"),
        (1, 1, "assistant", "On Monday, Bob wrote:\n> Hello there my good friend.\n> How are you doing today?\n\nI am doing very well thanks."),
        (1, 2, "user", "On Tue, Al wrote:\n>> Hello there my good friend.\n> I am doing very well thanks.\nGreat to hear that indeed."),
        (1, 3, "x", "> How are you   doing TODAY\nanother branch here now"),
        (1, 4, "u", None),
        (1, 1, "assistant", "dup row"),
        (None, 1, "u", "> Hello there my good friend."),
        (2, None, "u", "a"),
        (1, 5, "x", "> not found anywhere at all\nyes, he wrote:"),
        (3, 0, "u", "> Hello there my good friend.\nother conversation"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, depth int")
    out = quotation.build(df).collect()
    assert [(r.conv_id, r.turn, r.reply_to, r.depth, r.thread) for r in out if r.conv_id == 1] == [
        (1, 0, None, 0, 0),
        (1, 1, 0, 1, 0),
        (1, 1, 0, 1, 0),
        (1, 2, 1, 2, 0),
        (1, 3, 0, 1, 0),
        (1, 4, None, 0, 4),
        (1, 5, None, 0, 5),
    ]
    text = {(r.conv_id, r.turn, r.text) for r in out}
    assert (1, 2, "Great to hear that indeed.") in text and (1, 5, "yes, he wrote:") in text and len(out) == len(rows)
    assert all(r.reply_to is None for r in out if r.conv_id != 1)
    assert quotation.build(df.limit(0)).count() == 0


def test_short_quotes_link(spark):
    rows = [
        (1, 0, "Hi Bob,\nshall we meet on Friday at noon?\nThanks"),
        (1, 1, "Hi Bob,\nSounds good!"),
        (1, 2, "> Sounds good!\nsee you there then"),
        (1, 3, "> see you there then\n\nHi Bob,\n👍"),
        (1, 4, "> \U0001f44d\nok"),
        (1, 5, "> Hi Bob,\n> see you there then\n> Thanks\nfine by me as well"),
        (1, 6, "> ok\n>> shall we meet on Friday at noon?\nwhere is it?"),
        (1, 7, "> Hi Bob,\nno more"),
    ]
    got = quotation.build(spark.createDataFrame([(c, k, "u", t) for c, k, t in rows], "conv_id long, turn int, role string, text string")).collect()
    assert {r.turn: r.reply_to for r in got} == {0: None, 1: None, 2: 1, 3: 2, 4: 3, 5: 2, 6: 4, 7: 3}


def test_long_chains_and_hot_passages(spark):
    rows = [(7, i, "u", (f"> message number {i - 1} of the chain\n" if i else "") + f"message number {i} of the chain") for i in range(40)]
    rows += [(8, i, "u", "the very same words in every message" if i % 2 == 0 else "> the very same words in every message\nyes") for i in range(300)]
    got = quotation.build(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert {(r.thread, r.depth) for r in got if r.conv_id == 7 and r.turn == 39} == {(0, 39)}
    assert all(r.reply_to == (r.turn - 1 if r.turn % 2 else None) for r in got if r.conv_id == 8)


def conversations(seed, n):
    """Messages that quote each other at several levels, with changed case, blank lines, attributions and greetings."""
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        said = []
        for turn in range(rng.randint(1, 9)):
            own = [rng.choice(["Hi Bob,", "Thanks!", "ok", "👍", "see: 1 2", ""]) if rng.random() < 0.4 else " ".join(rng.choice(["alpha", "beta", "Gamma", "delta"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 4))]
            lines = []
            for _ in range(rng.randint(0, 2)):
                if said:
                    picked = rng.choice(said)
                    at = rng.randrange(len(picked) or 1)
                    mark = rng.choice(["> ", ">", "  > ", ">> ", "> > "])
                    if rng.random() < 0.4:
                        lines += ["On Monday, Al wrote:"] + [""] * rng.randint(0, 3)
                    lines += [mark + (x.upper() if rng.random() < 0.3 else x) for x in picked[at : at + rng.randint(1, 3)]]
                lines += own[:1]
                own = own[1:]
            lines += own
            said.append([x for x in lines if not x.lstrip().startswith(">")])
            rows.append((conv if rng.random() < 0.97 else None, turn if rng.random() < 0.97 else None, "u", rng.choice(["\n", "\n", "\r\n"]).join(lines) if rng.random() < 0.95 else None))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block", [2, 4096])
def test_links_equal_the_sql(spark, monkeypatch, block):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(quotation, "BLOCK", block)
    rows = conversations(17, 60)
    got = quotation.build(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    base = duckdb.connect()
    base.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    base.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = base.sql(oracles.OP3)
    assert [x.lower() for x in found.columns] == quotation.build(spark.createDataFrame(rows[:1], "conv_id long, turn int, role string, text string")).columns
    assert sorted(map(tuple, got), key=repr) == sorted(found.fetchall(), key=repr)
    assert sum(r.reply_to is not None for r in got) > 60


def test_very_long_message(spark):
    text = "\n".join(("> " if i % 3 else "") + f"line {i} of a long message" for i in range(30_000))
    df = spark.createDataFrame([(1, 0, "u", text), (1, 1, "u", text)], "conv_id long, turn int, role string, text string")
    assert {r.turn: r.n_quoted for r in quotation.build(df).collect()} == {0: 20_000, 1: 20_000}
