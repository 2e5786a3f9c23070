"""Main text of web pages by union-free wrappers inferred for each host.

A page is a stream of tokens: tags (with their classes, ids and roles) and text.  Two streams are
aligned; where they differ, text becomes a slot, an element that only one has becomes optional, and
elements of one kind, or of one sequence of kinds, that adjoin become one repeated group.  The result is
a union-free regular expression over tags and slots: a wrapper.  Wrappers align with each other as pages
do, so the wrapper of a host comes from a reduction.

As the nesting of tags is known, alignment works on trees, level by level, by a longest common
subsequence of kinds.  Pages of one shape are added up place by place, in whatever task they are; unlike
shapes are aligned in the order of their digests, in groups by the leading bits of these.  So a host's
wrapper does not depend on how its pages are spread over tasks.

The wrapper decides what a page's article is.  Its slots know on how many pages they are, how much prose
and how much linked text they hold, and whether that text varies:

* the article's region is found from the root down: as long as one slot has at least half of the varying
  prose that is left, it is entered (:meth:`Wrapper.region`);
* within the region, text that all pages of the host share is the template's and goes, as do groups of
  links, and, unless the region is an article element, containers with a small share of its prose.

What tags and class words say is a prior: an article or main element weighs ``TRUST`` times its prose, a
menu, footer, aside, advert and the like a ``TRUST``-th.  Only within the region do they decide alone.
Elements that hold no prose by the rules of HTML (scripts, styles, controls, hidden ones) are never read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, stored, tidied

#: Fixed values of the HTML syntax.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas object select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: Elements without prose, by the rules of HTML.
NEVER = frozenset("head script style noscript template textarea title iframe svg canvas object select option button input annotation annotation-xml".split())
#: Elements that are as a rule no part of an article.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog label fieldset".split())
#: Elements of running text; a region does not narrow down to one of them, and they are no containers.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary".split())
LISTS = frozenset("ul ol dl table".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILER_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ads?|adv|advert\w*|adbox|adslot|banner|breadcrumbs?|byline-share|comments?|commentlist|consent|cookies?\w*|disqus|footer|gdpr|header|masthead|menu|modal|nav\w*|navbar|newsletter|notices?|overlay|pagination|pager|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|sidenav|skip|social|sponsor\w*|subscribe|teaser|toc|toolbar|topbar|widget\w*)(?:$|[-_\s])",
    re.I,
)
#: Class words of a page's layout, which say that it has a part or lacks it.
MODIFIER = re.compile(r"(?:has|have|is|no|not|with|without)(?:[-_]|$)", re.I)
#: Words that may follow a word above in the name of a part: a "social-links" is one, "social-science" is not.
PARTS = frozenset("ad ads area bar block blocks body box btn button buttons col column container content count feed form group holder icon icons inner item items link links list main menu nav outer panel popup post posts row section slot text title toggle top unit widget wrap wrapper".split())
#: Words before "header" in the name of an article's heading.
ARTICLE_WORDS = frozenset("article content entry post story".split())
#: Words for readers' comments that may be something else; they count where containers repeat below.
DISCUSSION = re.compile(r"(?:^|[-_\s])(?:discussions?|feedback|talkback|threads?)(?:$|[-_\s])", re.I)
CONTENT_TAGS = frozenset(["article", "main"])

#: How many times over a tag's meaning counts against the share of prose.
TRUST = 32
#: The share of prose at which a region narrows down to a slot, and that of all prose held to be template at most.
NARROW, TEMPLATE_SHARE = 0.5, 2 / 3
#: Outside of article elements, containers of a smaller share of the region's prose are no part of it.
SMALL = 0.08
#: The share of linked text from which a list or container is a menu.
LINKED = 0.6
#: A group of at most so many kinds of elements is recognised when it repeats.
PERIOD = 6
#: Pages that fold into one wrapper in a task, as a rule, and wrappers that fold into one at the levels above.
FOLD_PAGES, FAN_BITS = 8192, 6
#: Wrappers of at most so many characters in all are broadcast.
BROADCAST_CHARS = 16 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SHOWN = frozenset(["class", "id", "role", "hidden", "aria-hidden"])
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

# Trees are as deep as pages nest; their functions call themselves for each level.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def kind_of(tag: str, attributes: str) -> str:
    """A tag with the attributes that tell parts of a page apart, digits left out."""
    if "=" not in attributes and "hidden" not in attributes:
        return tag
    # Elements that are not shown are of one kind with those that say so by an attribute.
    out = [tag]
    for name, *values in _ATTR.findall(attributes):
        name = name.lower()
        if name in _SHOWN:
            value = re.sub(r"\d+", "", entities.unescape(next((v for v in values if v), "")))
            out.append(f"{name}={' '.join(sorted(value.split()))}")
        elif name == "style" and "hidden=" not in out and _UNSEEN.search("".join(values)):
            out.append("hidden=")
    return "\n".join([out[0], *sorted(out[1:])])


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("open", kind), ("close", tag) and ("text", text) of a page; the content of script-like elements is left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:]
            return
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                yield "close", tag
            else:
                yield "open", kind_of(tag, m[3] or "")
                if tag in RAW and not (m[3] or "").rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    if end is None and tag in ("button", "select", "option", "object", "svg", "canvas"):
                        continue  # never closed: what follows is no part of it
                    at = end.end() if end else n
                    yield "close", tag
                elif tag in VOID:
                    yield "close", tag


def tag_of(kind: str) -> str:
    return kind.partition("\n")[0]


class Node:
    """An element of a page or of a wrapper."""

    __slots__ = ("chars", "kids", "kind", "linked", "loop", "mark", "n", "optional", "pages", "parts", "repeat", "text")

    def __init__(self, kind: str):
        self.kind, self.kids, self.parts = kind, [], []
        self.optional = self.repeat = False
        self.loop: list[str] = []  # of the first kid of a repeated group of several kinds: these
        self.text: str | None = None  # of a slot: its text on all pages, or its digest; empty if it varies
        self.pages = self.n = 1  # of a slot: pages that have it, and how often it is there in all
        self.chars = self.linked = 0  # of a slot: characters of its own prose and of its own linked text
        self.mark = ""  # of a root: the digest of its pages' text, empty if they differ


def parse(page: str) -> Node:
    """The tree of a page; text pieces and children are in ``parts`` in order.  Unclosed elements end with what holds them."""
    root = Node("#page")
    stack, names = [root], ["#page"]
    for what, value in tokens(page):
        if what == "text":
            stack[-1].parts.append(value)
        elif what == "open":
            tag = tag_of(value)
            while len(stack) > 1 and (tag in CLOSES.get(names[-1], ()) or (names[-1] in INLINE and _blocked(names, tag))):
                stack.pop()
                names.pop()
            node = Node(value)
            stack[-1].parts.append(node)
            stack[-1].kids.append(node)
            stack.append(node)
            names.append(tag)
        elif value in names:
            while names[-1] != value:
                stack.pop()
                names.pop()
            stack.pop()
            names.pop()
    return root


def _blocked(names: list[str], tag: str) -> bool:
    """Whether an unclosed inline element hides a paragraph or item that ``tag`` ends."""
    for name in reversed(names):
        if name in INLINE:
            continue
        return tag in CLOSES.get(name, ())
    return False


def own_text(node: Node) -> tuple[str, int, list[Node]]:
    """The text of an element itself and of the inline elements in it, how much of it is linked, and its other children."""
    words, links, kids = [], [], []
    todo = [(iter(node.parts), tag_of(node.kind) == "a")]
    while todo:
        parts, link = todo[-1]
        part = next(parts, None)
        if part is None:
            todo.pop()
        elif isinstance(part, str):
            words.append(part)
            if link:
                links.append(part)
        else:
            tag = tag_of(part.kind)
            if tag in INLINE and "\n" not in part.kind:
                todo.append((iter(part.parts), link or tag == "a"))
            elif tag not in VOID and tag not in NEVER:
                kids.append(part)
    linked = sum(len(x) for x in "".join(links).split()) if links else 0
    return " ".join(entities.unescape("".join(words)).split()) if words else "", linked, kids


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:32]


def _short(text: str) -> str:
    """A text, or its digest if it is long."""
    return text if len(text) <= 120 else f"{text[:80]} {_digest(text)}"


def generalized(node: Node) -> Node:
    """The wrapper of one page: inline elements melt into the text around them, and adjoining alike children become one repeated group."""
    out = Node(node.kind)
    text, linked, kids = own_text(node)
    if text:
        out.text, out.linked = _short(text), linked
        out.chars = max(0, len(text) - text.count(" ") - linked)
    out.kids = collapsed([generalized(kid) for kid in kids], True)
    return out


def wrapper_of(page: str) -> Node:
    """The wrapper of one page, marked with the digest of its text."""
    out, words = generalized(parse(page)), []
    todo = [out]
    while todo:
        node = todo.pop()
        words.append(node.text or "")
        todo += reversed(node.kids)
    out.mark = _digest("\n".join(words))
    return out


def collapsed(kids: list[Node], same_page: bool) -> list[Node]:
    """Children of which runs of one kind, and sequences of kinds that follow each other twice or more, are one group each."""
    out: list[Node] = []
    for kid in kids:
        if out and out[-1].kind == kid.kind:
            optional = out[-1].optional and kid.optional
            out[-1] = aligned(out[-1], kid, True)
            out[-1].repeat, out[-1].optional = True, optional
        else:
            out.append(kid)
            if same_page:
                _loops(out)
    return out


def _loops(kids: list[Node]) -> None:
    """Fold a sequence of kinds at the end of ``kids`` into the same one before it."""
    for period in range(2, PERIOD + 1):
        if len(kids) >= 2 * period and all(kids[-i].kind == kids[-i - period].kind for i in range(1, period + 1)):
            again = kids[-period:]
            del kids[-period:]
            for i, kid in enumerate(again, len(kids) - period):
                kids[i] = aligned(kids[i], kid, True)
                kids[i].repeat = True
            kids[-period].loop = [k.kind for k in again]
            return


def _joined(a: str | None, b: str | None, same_page: bool) -> str | None:
    """The text of two slots that become one."""
    if a == b and not same_page:
        return a
    if same_page:  # of one page: what the group says as a whole
        return a if b is None else b if a is None else _digest(f"{a}\n{b}") if a and b else ""
    return ""


def aligned(a: Node, b: Node, same_page: bool = False) -> Node:
    """The least wrapper that matches what both match: unequal text is a slot, lone children are optional, runs repeat.

    ``same_page``: both are of the same pages, or of pages that may be the same, so that these are not added up.
    """
    out = Node(a.kind)
    out.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    out.n, out.chars, out.linked = a.n + b.n, a.chars + b.chars, a.linked + b.linked
    out.mark = a.mark if a.mark == b.mark else ""
    out.optional, out.repeat, out.loop = a.optional or b.optional, a.repeat or b.repeat, a.loop or b.loop
    out.text = _joined(a.text, b.text, same_page)
    x, y = a.kids, b.kids
    if [k.kind for k in x] == [k.kind for k in y]:
        out.kids = [aligned(p, q, same_page) for p, q in zip(x, y, strict=True)]
        return out
    kids, i, j = [], 0, 0
    for i2, j2 in [*common([k.kind for k in x], [k.kind for k in y]), (len(x), len(y))]:
        for lone in (*x[i:i2], *y[j:j2]):
            lone.optional = True
            kids.append(lone)
        if i2 < len(x):
            kids.append(aligned(x[i2], y[j2], same_page))
        i, j = i2 + 1, j2 + 1
    out.kids = collapsed(kids, False)
    return out


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of two lists.

    Rows of the table of lengths are bit vectors in whole numbers, a bit for each place of ``x``.  Only
    every k-th row is kept, k being the root of their number; the rows between are made again on the way
    back, so memory grows as len(x) * sqrt(len(y)) bits.
    """
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    found = [(i, i) for i in range(head)]
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    if a and b:
        found += [(i + head, j + head) for i, j in _middle(a, b)]
    return found + [(len(x) - tail + i, len(y) - tail + i) for i in range(tail)]


def _middle(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    where: dict[str, int] = {}
    for i, kind in enumerate(a):
        where[kind] = where.get(kind, 0) | 1 << i
    ones = (1 << len(a)) - 1

    def rows(first: int, last: int, row: int) -> list[int]:
        """The rows after b[first], ..., b[last - 1], from the one before."""
        out = []
        for kind in b[first:last]:
            u = row & where.get(kind, 0)
            row = ((row + u) | (row - u)) & ones
            out.append(row)
        return out

    step = max(1, math.isqrt(len(b)))
    marks = [ones]
    for first in range(0, len(b), step):
        marks.append(rows(first, min(first + step, len(b)), marks[-1])[-1])
    found, i, j, block, held = [], len(a), len(b), -1, []
    while i and j:
        if (j - 1) // step != block:
            block = (j - 1) // step
            held = [marks[block], *rows(block * step, min((block + 1) * step, len(b)), marks[block])]
        at = j - block * step  # held[at] is the row after b[j - 1]
        if held[at] >> (i - 1) & 1:
            i -= 1
        elif not held[at - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def packed(node: Node) -> list[list]:
    """A wrapper as rows, each with its depth, in order."""
    out, todo = [], [(node, 0)]
    while todo:
        n, depth = todo.pop()
        out.append([depth, n.kind, n.text, n.pages, n.n, n.chars, n.linked, int(n.optional) + 2 * int(n.repeat), n.loop, n.mark])
        todo += [(k, depth + 1) for k in reversed(n.kids)]
    return out


def unpacked(rows: list[list]) -> Node:
    path: list[Node] = []
    for depth, kind, text, pages, n, chars, linked, flags, loop, mark in rows:
        node = Node(kind)
        node.text, node.pages, node.n, node.chars, node.linked = text, pages, n, chars, linked
        node.optional, node.repeat, node.loop, node.mark = bool(flags & 1), bool(flags & 2), loop, mark
        del path[depth:]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def shape(rows: list[list]) -> str:
    """A digest of the tags of a packed wrapper, without what its slots hold."""
    return _digest(json.dumps([[r[0], r[1], r[7], r[8]] for r in rows]))


def expression(node: Node) -> str:
    """A wrapper written as a union-free regular expression; ``#`` stands for a slot of text."""
    parts, i = [], 0
    while i < len(node.kids):
        group = len(node.kids[i].loop)
        if group and [k.kind for k in node.kids[i : i + group]] == node.kids[i].loop:
            parts.append("(" + " ".join(expression(k).rstrip("+*") for k in node.kids[i : i + group]) + ")+")
            i += group
        else:
            parts.append(expression(node.kids[i]))
            i += 1
    inner = ("" if node.text is None else json.dumps(node.text) if node.text and not node.repeat else "#") + " ".join(parts)
    name = node.kind.replace("\n", " ")
    return f"(<{name}>{inner}</{tag_of(node.kind)}>)" + ("*" if node.optional and node.repeat else "+" if node.repeat else "?" if node.optional else "")


def hinted(token: str, within_article: bool) -> bool:
    """Whether a word of a class or an id names a part of a page that holds no article text."""
    token = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token)
    if MODIFIER.match(token):
        return False
    words = [w.lower() for w in re.split(r"[-_]+", token) if w]
    for i, word in enumerate(words):
        # A name says in its last word what it is; parts and places may follow.
        if BOILER_WORDS.search(word) and not (word == "header" and (within_article or ARTICLE_WORDS.intersection(words[:i]))):
            if all(w in PARTS or BOILER_WORDS.search(w) or not w.isalpha() for w in words[i + 1 :]):
                return True
    return bool(re.search(r"(?:^|[-_])byline[-_]share(?:$|[-_])", token, re.I))


def unseen(kind: str) -> bool:
    """Whether elements of a kind are hidden or hold no prose."""
    tag, _, attributes = kind.partition("\n")
    return tag in NEVER or any(x.startswith("hidden=") or x == "aria-hidden=true" for x in attributes.split("\n"))


def boilerplate(kind: str, within_article: bool, repeats: bool = False) -> bool:
    """Whether the tag, role or class words of a kind say that it is no part of an article; ``repeats``: containers repeat below."""
    tag, _, attributes = kind.partition("\n")
    if tag in BOILER_TAGS:
        return not (tag == "header" and within_article)
    for line in attributes.split("\n") if attributes else ():
        name, _, value = line.partition("=")
        if name == "role" and value in BOILER_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if any(hinted(v, within_article) or (repeats and DISCUSSION.search(v)) for v in value.split()):
                return True
    return False


def is_article(kind: str) -> bool:
    return tag_of(kind) in CONTENT_TAGS or "role=main" in kind.split("\n")


def is_container(kind: str) -> bool:
    tag = tag_of(kind)
    return tag not in TEXTUAL and tag not in INLINE


class Wrapper:
    """A host's wrapper, ready to read pages."""

    def __init__(self, root: Node):
        self.root = root
        # Text that all pages of a host share is part of the template, unless they share all text.
        self.varies = root.mark == "" and root.pages > 1
        self.worth: dict[int, float] = {}  # of a slot: its prose on a page that has it, as much as tags trust it
        self.prose: dict[int, float] = {}  # the same without trust
        self.links: dict[int, float] = {}
        self.lead: set[int] = set()  # slots that are or hold a first heading that varies
        self.boiler: dict[tuple[int, bool], bool] = {}
        self._weigh()

    def _weigh(self) -> None:
        order, todo = [], [self.root]
        while todo:
            slot = todo.pop()
            order.append(slot)
            todo += slot.kids
        for slot in reversed(order):
            # What is on all pages says little about where their articles are.
            own = slot.chars * (0.1 if self.template(slot) else 1.0)
            worth = own + sum(self.trust(k) * self.worth[id(k)] * k.pages for k in slot.kids)
            self.worth[id(slot)] = worth / slot.pages
            self.prose[id(slot)] = (slot.chars + sum(self.prose[id(k)] * k.pages for k in slot.kids)) / slot.pages
            self.links[id(slot)] = (slot.linked + sum(self.links[id(k)] * k.pages for k in slot.kids)) / slot.pages
            if (tag_of(slot.kind) == "h1" and not self.template(slot)) or any(id(k) in self.lead for k in slot.kids):
                self.lead.add(id(slot))

    def template(self, slot: Node) -> bool:
        """Whether a slot has the same text on all pages of the host."""
        return self.varies and bool(slot.text) and slot.pages == self.root.pages

    def is_boilerplate(self, kind: str, slot: Node | None, within: bool) -> bool:
        key = (id(slot), within) if slot is not None else None
        if key is None or key not in self.boiler:
            below = [k for kid in slot.kids for k in (kid, *kid.kids)] if slot is not None else []
            said = boilerplate(kind, within, any(k.repeat and (is_container(k.kind) or tag_of(k.kind) == "li") for k in below))
            if key is None:
                return said
            self.boiler[key] = said
        return self.boiler[key]

    def trust(self, slot: Node) -> float:
        if unseen(slot.kind):
            return 0.0
        return TRUST if is_article(slot.kind) else 1 / TRUST if self.is_boilerplate(slot.kind, slot, False) else 1.0

    def menu(self, slot: Node) -> bool:
        """Whether a slot is a list or container of links."""
        links = self.links[id(slot)]
        return (tag_of(slot.kind) in LISTS or is_container(slot.kind)) and links > LINKED * (links + self.prose[id(slot)])

    @staticmethod
    def placed(node: Node, slot: Node | None) -> list[tuple[Node, Node | None]]:
        """The children of a page's element with their slots, read from left to right; groups start over."""
        kids = own_text(node)[2]
        if slot is None:
            return [(kid, None) for kid in kids]
        places: dict[str, list[int]] = {}
        for i, k in enumerate(slot.kids):
            places.setdefault(k.kind, []).append(i)
        out, at = [], 0
        for kid in kids:
            of = places.get(kid.kind)
            if not of:
                out.append((kid, None))
                continue
            at = next((i for i in of if i >= at), of[0])
            out.append((kid, slot.kids[at]))
        return out

    def region(self, tree: Node) -> tuple[list[tuple[Node, Node | None]], list[tuple[Node, Node | None]], bool]:
        """The elements that hold a page's article, headings before them, and whether they are article elements."""
        here: list[tuple[Node, Node | None]] = [(tree, self.root)]
        before: list[tuple[Node, Node | None]] = []
        while True:
            kids = [pair for node, slot in here for pair in self.placed(node, slot)]
            slots = {id(slot): slot for _, slot in kids if slot is not None}
            scores = {key: self.trust(slot) * self.worth[key] for key, slot in slots.items()}
            # The first of equal ones.
            best = max(scores, key=scores.get, default=None)
            own = sum(slot.chars / slot.pages for _, slot in {id(s): (n, s) for n, s in here if s is not None}.values())
            if best is None or scores[best] <= 0 or scores[best] < NARROW * (own + sum(scores.values())) or not is_container(slots[best].kind):
                return here, before, False
            here = [(node, slot) for node, slot in kids if slot is slots[best]]
            first = next(i for i, (_, slot) in enumerate(kids) if slot is slots[best])
            before += [(node, slot) for node, slot in kids[:first] if slot is not None and id(slot) in self.lead and not unseen(node.kind) and not self.is_boilerplate(node.kind, slot, False)]
            if is_article(slots[best].kind):
                return here, [], True

    def read(self, page: str) -> str:
        """The main text of a page, its blocks joined by a blank."""
        tree = parse(page)
        here, before, article = self.region(tree)
        for way in ("all", "kept", "bare"):
            pieces: list[tuple[str, bool]] = []
            if way == "bare":  # nothing is left of the region: all of the page but its boilerplate
                self._pieces([(tree, None)], pieces, False, False)
            else:
                self._pieces(before, pieces, True, False)
                self._pieces(here, pieces, article, way == "all")
            size = lambda some: sum(len(x) for x, _ in some)
            kept = [p for p in pieces if not p[1]]
            # Pages that share most of their text are copies of each other rather than fillings of a template.
            if not any(x.strip() for x, _ in kept) or size(pieces) - size(kept) > TEMPLATE_SHARE * size(pieces):
                kept = pieces
            text = "".join(x for x, _ in kept)
            if text.strip():
                return " ".join(entities.unescape(text).split())
        return ""

    def _pieces(self, region: list[tuple[Node, Node | None]], out: list[tuple[str, bool]], article: bool, choosing: bool) -> None:
        """Text of elements in order, each with whether it is the template's; ``choosing``: slots are left out for their links or small share."""
        total = sum(self.prose[key] for key in {id(slot) for _, slot in region if slot is not None})

        def left_out(node: Node, slot: Node | None, top: bool) -> bool:
            if unseen(node.kind) or self.is_boilerplate(node.kind, slot, article):
                return True
            if slot is None or not choosing:
                return False
            if self.menu(slot):
                return True
            return top and not article and is_container(slot.kind) and id(slot) not in self.lead and self.prose[id(slot)] < SMALL * total

        stack: list[tuple] = []

        def enter(node: Node, slot: Node | None, block: bool, top: bool) -> None:
            # The heading of an article is none of the template, even if all pages of a host have it.
            fixed = slot is not None and self.template(slot) and tag_of(node.kind) != "h1"
            stack.append((iter(node.parts), {id(k): s for k, s in self.placed(node, slot)}, fixed, block, top))

        for node, slot in region:
            out.append(("\n", False))
            enter(node, slot, True, True)
            while stack:
                parts, slots, fixed, block, top = stack[-1]
                part = next(parts, None)
                if part is None:
                    stack.pop()
                    if block:
                        out.append(("\n", False))
                elif isinstance(part, str):
                    out.append((part, fixed))
                elif tag_of(part.kind) in INLINE and "\n" not in part.kind:  # melted into the text around it
                    stack.append((iter(part.parts), slots, fixed, False, top))
                elif id(part) not in slots or left_out(part, slots[id(part)], top):
                    out.append(("\n", False))
                else:
                    inline = tag_of(part.kind) in INLINE
                    if not inline:
                        out.append(("\n", False))
                    enter(part, slots[id(part)], not inline, False)


def host() -> Column:
    """The host of ``url``; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _added_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add up the pages of a task that have one host and one shape."""
    held: dict[tuple[str, str], Node] = {}
    used = 0

    def out() -> pd.DataFrame:
        rows = [(host, shape, json.dumps(packed(node))) for (host, shape), node in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["host", "shape", "wrapper"])

    for batch in tidied(batches):
        for name, page in zip(batch["host"], batch["html"], strict=True):
            node = wrapper_of(page)
            rows = packed(node)
            key = (name, shape(rows))
            if key in held:
                held[key] = aligned(held[key], node)
            else:
                held[key] = node
                used += len(rows)
                if used > 200_000:
                    yield out()
                    used = 0
    if held:
        yield out()


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold rows in order of host, part and shape into a wrapper for each host and part."""
    held, at, first = None, None, ""
    for batch in tidied(batches):
        for name, part, shape_, value in zip(batch["host"], batch["part"], batch["shape"], batch["wrapper"], strict=True):
            node = unpacked(json.loads(value))
            if (name, part) == at:
                held = aligned(held, node)
            else:
                if held is not None:
                    yield pd.DataFrame({"host": [at[0]], "shape": [first], "wrapper": [json.dumps(packed(held))]})
                held, at, first = node, (name, part), shape_
    if held is not None:
        yield pd.DataFrame({"host": [at[0]], "shape": [first], "wrapper": [json.dumps(packed(held))]})


def infer_wrappers(pages: DataFrame, n_pages: int) -> DataFrame:
    """host and wrapper (JSON) of each host of ``pages`` (url, html), from all of its pages.

    A host's shapes are dealt to parts by the leading bits of their digests, so a host with a third of
    all pages is the work of many tasks, and the parts are merged level by level.
    """
    rows = pages.select(host().alias("host"), body("html").alias("html"))
    folds = rows.mapInPandas(_added_up, "host string, shape string, wrapper string")
    bits = max(3, math.ceil(math.log2(max(1, n_pages / FOLD_PAGES))))
    while True:
        # The shape of a fold is the least of its shapes, which has the same leading bits.
        part = F.conv(F.substring("shape", 1, 8), 16, 10).cast("long").bitwiseAND(0xFFFFFFFF)
        dealt = folds.withColumn("part", F.shiftright(part, 32 - bits) if bits else F.lit(0).cast("long"))
        folds = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "shape").select("host", "part", "shape", "wrapper").mapInPandas(_folded, "host string, shape string, wrapper string")
        if not bits:
            return folds.select("host", "wrapper")
        bits = max(0, bits - FAN_BITS)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of each row of ``pages`` (page_id, url, html).

    Null html counts as empty and gives an empty text; rows with a null url, or one without a host,
    share a wrapper.  Rows are read one by one with their host's wrapper, so repeated rows give equal
    texts; the wrapper itself depends on a host's rows alone, not on their order or partitioning.  Pages
    of any length and depth are read whole; lists of thousands of unlike children are aligned in memory
    that grows with their length times its root, in bits.  Columns besides page_id, url and html are
    ignored.  An empty table gives an empty result.
    """
    wrappers = stored(infer_wrappers(pages, pages.count()), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    rows = pages.select("page_id", "url", body("html").alias("html"), host().alias("host")).join(F.broadcast(wrappers) if size <= BROADCAST_CHARS else wrappers, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper] = {}
        for batch in tidied(batches):
            out = []
            for text, page in zip(batch["wrapper"], batch["html"], strict=True):
                if text not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[text] = Wrapper(unpacked(json.loads(text)))
                out.append(known[text].read(page))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out})

    texts = rows.select("page_id", "url", "html", "wrapper").mapInPandas(run, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
