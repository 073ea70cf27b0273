"""Main text of web pages by site template removal (operator 8).

Every page is parsed into a tree and the subtrees of its container elements are
hashed, each with its place (the elements that it lies in). Spark counts, for each
host, on how many pages of different content a subtree occurs in that place; one
that recurs on LEAST_PAGES of them and on one in MOST_RARE of the host's pages is
part of the site's template. Template subtrees are deleted first; then the article
is chosen among what is left: the marked articles, or else the main elements, or
else the whole body. Pages with the same content count once, so that copies of an
article don't turn the article into template. Headings and paragraphs go only as
parts of a recurring container, however often they recur ("References"); a marked
article's lists and tables never do, and an element that holds a marked article
isn't template.

A site that shows too few pages for its template to recur is left to what the
markup itself says: elements and roles that HTML defines as something else than
the article go (menus, headers, footers, sidebars, adverts, forms, scripts), and
so do containers whose class or id names such a part. A name is a whole class or
id of such words and of words about place and shape only ("comments-list", not
"social-history"). Within a marked article a container that isn't named for
comments goes only if it holds less than half of the article's text, and prose
only if it is named an advert.

Hashes are counted with partial sums before the shuffle. Where the templates of
all hosts are few enough (MOST_SENT, looked at first) they go to the pages, and no
page is shuffled; beyond that, a page's own template hashes are joined back to it
by a key made of the whole row, so that a host with a third of all pages gives no
large group. Both ways give the same.

Defined results: null, empty or tagless html is taken as a body of its text (the
empty string where there is none); a null or odd url belongs to the host "";
equal rows are extracted each on its own; other columns are ignored; an empty
table gives an empty result. n_template counts the template subtrees deleted.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import words as W
from meshwright.llm.html_tree import BLOCK, Node, parse
from meshwright.llm.shared import cut

LEAST_PAGES = 5
#: A template recurs on one in so many of its host's pages, at least.
MOST_RARE = 200
#: Parts into which the subtrees of a host are dealt when they meet its number of pages.
SALTS = 64
#: Template subtrees of all hosts that may be broadcast.
MOST_SENT = 200_000
#: Elements whose subtrees are hashed and counted.
CONTAINERS = frozenset("aside center details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
#: Those that a marked article's own content is made of.
CONTENT = frozenset("dl fieldset figure ol section table ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas audio video map button select textarea input form nav footer aside dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words of class and id attributes that name parts other than the article.
COMMENTS = frozenset("comment comments commenting respond disqus replies".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promotions".split())
NAMES = COMMENTS | ADVERTS | frozenset(
    "banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets related recommended recommendations "
    "share sharing social breadcrumb breadcrumbs menu nav navbar navigation pager pagination footer masthead toolbar copyright disclaimer".split()
)
OUTSIDE_NAMES = NAMES | {"header"}
# Words that say where or in what shape a part is, not what it is.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons column container first global group holder inner item items js last layer left links list main mobile module outer page panel primary reader readers right row secondary "
    "section site slot sticky strip thread top tree unit user users view wrap wrapper zone".split()
)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


def named(node: Node, names: frozenset[str]) -> bool:
    """Whether a class or the id is made of `names` and neutral words or numbers only, one of `names` at least."""
    for key in ("class", "id"):
        for token in node.attrs.get(key, "").split():
            parts = {x.lower() for x in _WORD.findall(token)} - NEUTRAL
            if token.lower() in names or parts & names and all(x in names or x.isdigit() for x in parts):
                return True
    return False


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def unwanted(node: Node, article: Node | None) -> bool:
    """Whether the markup names this element as something else than the article; `article`: the marked one that it lies in."""
    if node.tag in DROPPED or node.tag == "header" and article is None:
        return True
    if not node.raw.strip():
        return False
    a = node.attrs
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if node.tag in ("html", "body"):
        return False
    if article is None:
        return named(node, OUTSIDE_NAMES)
    if node.tag in PROSE:
        return named(node, ADVERTS)
    return node.tag in BLOCK and (named(node, COMMENTS) or named(node, NAMES) and 2 * n_chars(node) < n_chars(article))


def n_chars(node: Node) -> int:
    """Characters of an element's text, white space aside."""
    total, stack = 0, [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            total += len("".join(x.split()))
        else:
            stack += x.children
    return total


def walk(root: Node):
    """(node, entering) of all elements below, in page order, without recursion."""
    stack = [(x, True) for x in reversed(root.children) if isinstance(x, Node)]
    while stack:
        node, entering = stack.pop()
        yield node, entering
        if entering:
            stack.append((node, False))
            stack += [(x, True) for x in reversed(node.children) if isinstance(x, Node)]


def hashes(root: Node) -> dict[int, int]:
    """The hash of each element's subtree by id(node): tags and text, white space aside."""
    out: dict[int, int] = {}
    for node, entering in walk(root):
        if not entering:
            h = xxhash.xxh64(node.tag.encode())
            for x in node.children:
                if isinstance(x, Node):
                    h.update(out[id(x)].to_bytes(8, "little"))
                elif x and not x.isspace():
                    h.update(" ".join(x.split()).encode("utf-8", "surrogatepass"))
                    h.update(b"\0")
            out[id(node)] = h.intdigest()
    return out


def candidates(root: Node, own: dict[int, int]) -> dict[int, int]:
    """The elements that may be template, by id(node), with a hash of subtree (from `own`) and place; none that holds a marked article."""
    out: dict[int, int] = {}
    holding: set[int] = set()
    inside, open_ones, places = 0, [], [0]
    for node, entering in walk(root):
        if node.tag == "article":
            if entering and not inside:
                holding.update(open_ones)
            inside += 1 if entering else -1
        if entering:
            open_ones.append(id(node))
            if node.tag in CONTAINERS and not (inside and node.tag in CONTENT):
                out[id(node)] = xxhash.xxh64_intdigest(own[id(node)].to_bytes(8, "little"), places[-1])
            places.append(xxhash.xxh64_intdigest(node.tag.encode("utf-8", "surrogatepass"), places[-1]))
        else:
            open_ones.pop()
            places.pop()
    return {k: x for k, x in out.items() if k not in holding}


def roots(root: Node, gone: set[int] = frozenset(), comments: bool = False) -> list[Node]:
    """The marked articles (or else main elements) that lie in nothing unwanted or deleted (`gone`), those named as comments only if `comments`; none: empty."""
    for wanted in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.attrs.get("role", "").lower() == "main"):
        found, shut = [], None
        for node, entering in walk(root):
            if shut is not None:
                shut = None if node is shut and not entering else shut
            elif entering and id(node) in gone:
                shut = node
            elif entering and wanted(node) and (not unwanted(node, node) or comments and named(node, COMMENTS)):
                found.append(node)
                shut = node
            elif entering and unwanted(node, None):
                shut = node
        if found:
            return found
    return []


def subtrees(text: str | None) -> tuple[int, list[int]]:
    """A hash of what the page is about, and the distinct hashes of the subtrees that may be template."""
    tree = parse(text or "")
    own = hashes(tree)
    about = xxhash.xxh64()
    for x in roots(tree) or [x for x in tree.children if isinstance(x, Node)]:
        about.update(own[id(x)].to_bytes(8, "little"))
    return about.intdigest(), sorted(set(candidates(tree, own).values()))


def main_text(text: str | None, template: frozenset[int] = frozenset()) -> tuple[str, int]:
    """The article's blocks, a line each, and how many template subtrees were deleted."""
    tree = parse(text or "")
    gone: set[int] = set()
    if template:
        own = hashes(tree)
        gone = {k for k, x in candidates(tree, own).items() if x in template}
    # A column of comments may be an article that is named so: where nothing else is there, it is taken.
    return "\n".join(blocks_of(tree, gone, False) or blocks_of(tree, gone, True)), len(gone)


def blocks_of(tree: Node, gone: set[int], comments: bool) -> list[str]:
    marked = roots(tree, gone, comments)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = " ".join("".join(line).split())
        if words:
            blocks.append(words)
        line.clear()

    for top in marked or [tree]:
        article = top if marked else None
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            else:
                if x is not top and (id(x) in gone or unwanted(x, article)):
                    if x.tag in BLOCK:
                        flush()
                    continue
                if x.tag == "br":
                    line.append(" ")
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.children)
        flush()
    return blocks


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, most_rare: int = MOST_RARE) -> DataFrame:
    """host and subtree (its hash) of what recurs on `least_pages`, and one in `most_rare`, of a host's pages of different content."""

    def count(batches):
        for b in batches:
            rows = []
            for url, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                about, found = subtrees(text)
                host = host_of(url)
                rows += [(host, about - (1 << 63), None if x is None else x - (1 << 63)) for x in (None, *found)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "about", "subtree"])

    found = pages.select("url", "html").mapInArrow(W.tidied(count), "host string, about long, subtree long").distinct()
    # The row without a subtree counts the host's pages.
    counts = cut(found.groupBy("host", "subtree").agg(F.count("*").alias("pages")).where(F.col("subtree").isNull() | (F.col("pages") >= least_pages)))
    salt = F.pmod(F.col("subtree"), F.lit(SALTS)).cast("int").alias("salt")
    often = counts.where("subtree is not null").select("host", "subtree", "pages", salt)
    # Only hosts of more pages than this ask for more than `least_pages`.
    large = counts.where(F.col("subtree").isNull() & (F.col("pages") > least_pages * most_rare)).select("host", F.col("pages").alias("all_pages"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return often.join(large, ["host", "salt"], "left").where(F.col("all_pages").isNull() | (F.col("pages") * most_rare >= F.col("all_pages"))).select("host", "subtree")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, most_sent: int = MOST_SENT) -> DataFrame:
    """page_id, url, text, n_chars and n_template of every row of `pages` (page_id, url, html, ...)."""
    common = cut(templates(pages, least_pages))
    types = dict(pages.dtypes)
    schema = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, n_template long"

    def texts(b: pa.RecordBatch, template_of) -> pa.RecordBatch:
        found = [main_text(x, template_of(k, u)) for k, (u, x) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([len(x) for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])

    if common.count() <= most_sent:
        by: dict[str, set[int]] = {}
        for host, subtree in common.toLocalIterator():
            by.setdefault(host, set()).add(subtree + (1 << 63))
        sent = pages.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in by.items()})

        def run(batches):
            for b in batches:
                yield texts(b, lambda _, url: sent.value.get(host_of(url), frozenset()))

        return pages.select("page_id", "url", "html").mapInArrow(W.tidied(run), schema)

    key = [F.xxhash64("page_id", "url", "html").alias("k0"), F.xxhash64("html", "url", "page_id", F.lit(1)).alias("k1")]
    picked = pages.select("page_id", "url", "html", *key)

    def marks(batches):
        for b in batches:
            rows = [(host_of(url), x - (1 << 63), k0, k1) for url, text, k0, k1 in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for x in subtrees(text)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), *[pa.int64()] * 3), strict=True)], names=["host", "subtree", "k0", "k1"])

    each = picked.select("url", "html", "k0", "k1").mapInArrow(W.tidied(marks), "host string, subtree long, k0 long, k1 long")
    own = each.join(common, ["host", "subtree"]).groupBy("k0", "k1").agg(F.collect_set("subtree").alias("template"))
    joined = picked.join(own, ["k0", "k1"], "left").select("page_id", "url", "html", "template")

    def run_joined(batches):
        for b in batches:
            marked = b.column(3).to_pylist()
            yield texts(b, lambda k, _, marked=marked: frozenset(x + (1 << 63) for x in marked[k] or ()))

    return joined.mapInArrow(W.tidied(run_joined), schema)
