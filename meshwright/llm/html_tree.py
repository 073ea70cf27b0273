"""A small HTML tree: tags, attributes, text; as forgiving as pages need."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: What an opening tag ends, and the elements beyond which it ends nothing.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_SCOPE = frozenset("html body table td th caption button object template article section div aside nav main header footer form li dd dt blockquote".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""")


class Node:
    """An element; children are nodes and decoded strings."""

    __slots__ = ("tag", "raw", "children", "parent", "_attrs")

    def __init__(self, tag: str, raw: str, parent: Node | None):
        self.tag, self.raw, self.parent, self.children, self._attrs = tag, raw, parent, [], None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            if self.raw.strip(" \t\r\n/"):
                for m in _ATTRIBUTE.finditer(self.raw):
                    self._attrs.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
        return self._attrs


def parse(text: str) -> Node:
    root = Node("", "", None)
    here, at, n = root, 0, len(text)
    no_comment_end = False

    def add(piece: str) -> None:
        if piece:
            here.children.append(html.unescape(piece) if "&" in piece else piece)

    def end(tags, stop) -> None:
        """Leave the nearest open element of `tags`, unless one of `stop` lies before it."""
        nonlocal here
        x = here
        while x is not root:
            if x.tag in tags:
                here = x.parent
                return
            if x.tag in stop:
                return
            x = x.parent

    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            add(text[at:])
            break
        add(text[at:lt])
        if text.startswith("<!--", lt):
            close = -1 if no_comment_end else text.find("-->", lt + 4)
            if close < 0:
                no_comment_end, close = True, text.find(">", lt)
                at = close + 1 if close >= 0 else n
            else:
                at = close + 3
            continue
        if text.startswith(("<!", "<?"), lt):
            close = text.find(">", lt)
            at = close + 1 if close >= 0 else n
            continue
        m = _TAG.match(text, lt)
        if not m:
            if lt + 1 < n and (text[lt + 1].isalpha() and text[lt + 1].isascii() or text.startswith("</", lt)):
                close = text.find(">", lt)  # a broken tag: nothing of it is text
                at = close + 1 if close >= 0 else n
            else:
                add("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[1].lower()
        if text[lt + 1] == "/":
            if tag == "p":
                end({"p"}, P_SCOPE)
            else:
                x = here
                while x is not root and x.tag != tag:
                    x = x.parent
                if x is not root:
                    here = x.parent
            continue
        if tag in CLOSES_P:
            end({"p"}, P_SCOPE)
        if tag in ENDS:
            tags, stop = ENDS[tag]
            end(tags, stop)
        node = Node(tag, m[2], here)
        here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(text, at)
            if close:
                node.children.append(text[at : close.start()])
                gt = text.find(">", close.start())
                at = gt + 1 if gt >= 0 else n
            else:
                at = n if tag != "title" else at
        elif tag not in VOID:
            here = node
    return root
