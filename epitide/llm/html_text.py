"""Main text of web pages by tree scoring.

A page is read into a tree of elements. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out, by tag, role or a word of their class or id. Every paragraph then passes points to its
ancestors: one, one for each comma and one for each 100 characters (three at most), less the share of its text that
stands in links; the parent takes all, the grandparent half, the next a third, and so on, and whatever is NEAR or more
levels above takes the same small share, which is carried up once. The container with most points
is the article; siblings that look like text too (many points, or text with few links) are kept with it, and a heading
of the first level just before it. All blocks of what is kept are joined in page order.

A null page or one without text gives an empty text; broken markup is read as browsers do where it matters here: open
paragraphs end at the next block, end tags without a start are ignored, what is open at the end is closed. A tag is
split into names and values first, so a value never counts as a name. Work is linear in the page, however deep it is.
White space of any kind, also beyond ASCII, becomes one space.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
LEFT_OUT = frozenset(
    "head nav header footer aside form script style title noscript textarea iframe template svg canvas object embed button select "
    "option input dialog menu audio video map noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
# Whole words of a class or id that mark what surrounds an article, with their forms.
WORDS = frozenset(
    "ad ads adv adbox adslot sidebar side nav navbar navigation menu topbar header masthead footer banner breadcrumb breadcrumbs cookie "
    "cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay promo promotion share "
    "sharing social related recommended sponsor sponsored widget pagination pager disqus comment comments respond responses replies reply toolbar skip announcement "
    "advert adverts advertisement advertisements advertising advertorial sponsors sponsoring sponsorship commentlist commentform commentlisting commenting "
    "cookiebar cookiebanner cookieconsent newsletters sidebars promos promotions promotional".split()
)
KEEPERS = frozenset("article post entry main content story".split())
# A class such as "with-sidebar" tells of the layout, not of the element.
LAYOUT = frozenset("with no has without".split())
# These mark an article's own heading when they stand with a word of KEEPERS.
HEADINGS = frozenset(("header", "masthead"))

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)""", re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"?|'[^']*'?""")
JUDGED = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_PARAGRAPH = BLOCK - {"body", "html"}
# Elements that end open ones of their kind, up to the list or table around them.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FAMILY = {n: i for i, names in enumerate(("li ul ol menu dir", "dt dd dl", "tr td th table")) for n in names.split()}
#: Levels to which points go one by one.
NEAR = 64


class Node:
    __slots__ = ("name", "parent", "children", "out", "points", "far", "kin")

    def __init__(self, name: str, parent: Node | None, out: bool):
        self.name, self.parent, self.children, self.out, self.points, self.far = name, parent, [], out, 0.0, 0.0
        # The nearest element of each family, itself included.
        self.kin = parent.kin if parent else (None, None, None)
        if name in FAMILY:
            self.kin = tuple(self if i == FAMILY[name] else k for i, k in enumerate(self.kin))


def left_out(name: str, rest: str) -> bool:
    if name in LEFT_OUT:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    seen = set()
    for m in ATTRIBUTE.finditer(rest):
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key not in JUDGED or key in seen:  # the first of equal names counts
            continue
        seen.add(key)
        if key == "role":
            if value.strip().lower() in ROLES:
                return True
        elif key in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in SPLIT.split(one) if w}
                hit = words & WORDS
                if words & KEEPERS:
                    hit -= HEADINGS
                if hit and not words & LAYOUT:
                    return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def parse(page: str) -> list[Node]:
    """The elements in page order, the root first; children are nodes and texts. Text of raw elements is dropped."""
    root = at = Node("#root", None, False)
    order, opened = [root], Counter()
    pos, n = 0, len(page)

    def close(node: Node) -> Node:
        """Ends all open elements up to this one; its parent is open then."""
        here = at
        while here is not node.parent:
            opened[here.name] -= 1
            here = here.parent
        return here

    while pos < n:
        m = TAG.search(page, pos)
        text = page[pos : m.start() if m else n]
        if text:
            at.children.append(text if at.out or "&" not in text else html.unescape(text))
        if not m:
            break
        pos = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, rest = name.lower(), m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            if opened[name]:
                node = at
                while node.name != name:
                    node = node.parent
                at = close(node)
            continue
        if name in CLOSES_PARAGRAPH and opened["p"]:  # a block ends the paragraph, so an open one is the nearest block
            node = at
            while node.parent and node.name not in BLOCK:
                node = node.parent
            if node.name == "p":
                at = close(node)
        if name in SAME:
            while (node := at.kin[FAMILY[name]]) is not None and node.name in SAME[name]:
                at = close(node)
                if name != "tr" or node.name == "tr":
                    break
        node = Node(name, at, at.out or left_out(name, rest))
        order.append(node)
        at.children.append(node)
        if name in VOID or rest.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        at = node
        opened[name] += 1
    return order


def blocks(node: Node, into: list[list]) -> None:
    """Appends [block element, text parts, characters in links] in page order; the last entry may be open."""
    stack: list[tuple] = [(node, iter(node.children), False)]
    owner, fresh = [node], True
    while stack:
        here, rest, link = stack[-1]
        for child in rest:
            if isinstance(child, str):
                if fresh or not into:
                    into.append([owner[-1], [], 0])
                    fresh = False
                into[-1][1].append(child)
                if link:
                    into[-1][2] += len(child.strip())
            elif not child.out:
                if child.name == "br" or child.name in ("td", "th"):
                    if not fresh:
                        into[-1][1].append(" ")
                if child.name in BLOCK:
                    owner.append(child)
                    fresh = True
                stack.append((child, iter(child.children), link or child.name == "a"))
                break
        else:
            stack.pop()
            if here.name in BLOCK and len(owner) > 1:
                owner.pop()
                fresh = True


def flat(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def enclosing(node: Node) -> Node | None:
    """The nearest article or main element around a node."""
    node = node.parent
    while node is not None and node.name not in ("article", "main"):
        node = node.parent
    return node


def holds_left_out(node: Node) -> bool:
    """Whether text stands in what is left out, at or below a node."""
    stack = [node]
    while stack:
        here = stack.pop()
        for child in here.children:
            if not isinstance(child, str):
                stack.append(child)
            elif here.out and child.strip():
                return True
    return False


def main_text(page: str | None) -> str:
    if not page:
        return ""
    order = parse(page)
    found: list[list] = []
    blocks(order[0], found)
    whole = [(owner, text, links) for owner, parts, links in found if (text := flat(parts))]
    scored: dict[int, Node] = {}
    for owner, text, links in whole:
        if owner.name in HEADING:
            continue
        points = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - min(1.0, links / len(text)))
        node, share = (owner.parent if owner.name in ("p", "pre", "li", "td", "dd", "dt", "tr", "blockquote") and owner.parent else owner), 1.0
        step = 1
        while node is not None and step < NEAR:
            node.points += points / step
            scored[id(node)] = node
            node, step = node.parent, step + 1
        if node is not None:
            node.far += points
    for node in reversed(order):  # an element stands behind its parent
        if node.far:
            node.points += node.far / NEAR
            scored[id(node)] = node
            if node.parent is not None:
                node.parent.far += node.far
    for node in scored.values():
        node.points *= {"article": 1.5, "main": 1.3, "body": 0.9, "html": 0.5, "#root": 0.4}.get(node.name, 1.0)
    if not scored:
        return "\n".join(text for _, text, _ in whole)
    top = max(scored.values(), key=lambda x: x.points)
    keep, loose, at = {id(top)}, set(), top
    around = top if top.name in ("article", "main") else enclosing(top)
    inside = around is not top and around is not None
    while at.parent is not None:
        heading, clean = None, True
        for sibling in (c for c in at.parent.children if isinstance(c, Node)):
            if sibling is at:
                if heading is not None:
                    keep.add(id(heading))
                continue
            clean = clean and not holds_left_out(sibling)
            if sibling.out:
                continue
            if sibling.name == "h1":
                heading = sibling
            own: list[list] = []
            blocks(sibling, own)
            text = " ".join(flat(p) for _, p, _ in own)
            density = sum(x[2] for x in own) / max(1, len(text))
            if text and density < 0.25 or sibling.points >= max(10.0, 0.2 * top.points):
                keep.add(id(sibling))
            elif text:
                clean = False
        if not clean and not inside:
            break
        at = at.parent
        loose.add(id(at))
        inside = inside and at is not around
    kept = set()
    for node in order:
        if id(node) in keep or node.parent is not None and id(node.parent) in kept:
            kept.add(id(node))
    return "\n".join(text for owner, text, _ in whole if id(owner) in kept or id(owner) in loose)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The columns of `pages` but html, and text; a column named text is replaced."""
    @F.pandas_udf("string")
    def read(page: pd.Series) -> pd.Series:
        return page.map(main_text)

    return pages.withColumn("text", read(column)).drop(column)


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
