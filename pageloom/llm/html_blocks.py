"""Main text of web pages: flat text blocks kept or dropped by a decision tree.

A page becomes a flat list of text blocks. A tree decides on each from its
words and link density, those of its neighbours, and the elements it lies in.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, whole_text
from .html_samples import MARK, PAGES

# Elements of HTML by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title head iframe noembed noframes noscript template svg canvas object video audio".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LIKE = {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr", "option": "option"}
CLOSES = {name: frozenset(others.split()) for name, others in _LIKE.items()}
LISTS = frozenset("ul ol dl table select menu".split())
ITEMS = frozenset("li td th dt dd".split())
PARAGRAPH, NOT_PARAGRAPH, ANCHOR = frozenset(["p"]), BLOCKS - {"p"}, frozenset(["a"])
KEEPERS = frozenset("article main".split())
FRAMES = frozenset("nav footer aside form menu dialog button select textarea label search fieldset".split())

# Words in class, id and role that tell what a part of a page is for.
FRAME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot header masthead topbar toolbar sidebar side "
    "aside complementary contentinfo widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored promo "
    "promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog "
    "newsletter subscribe subscription signup signin login register search form comment comments commentlist discussion "
    "reply replies respond responses disqus share sharing social related recommended recommendation recommendations teaser "
    "teasers pagination pager copyright legal disclaimer imprint skip outbrain taboola paywall trending popular".split()
)
MAIN_WORDS = frozenset("article main content post entry story text body articlebody maincontent".split())
TITLE_WORDS = frozenset("article post entry story page section".split())
STATES = ("has-", "with-", "no-", "is-", "js-", "without-")

_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOPS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?(?=[\s/>\"']|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…][\"'”»)]*$")


class Block(NamedTuple):
    text: str
    words: int
    links: float  # share of words inside links
    framed: int  # inside a part that is no article: menus, adverts, comments
    main: int  # inside an article or a part named like one
    heading: int
    paragraph: int
    item: int
    sentence: int


def _tag_end(page: str, at: int) -> int:
    """Where the tag that opens at ``at`` ends; the page's end if it is never closed."""
    while hit := _STOPS.search(page, at):
        if hit.group() == ">":
            return hit.end()
        if page[max(0, hit.start() - 8) : hit.start()].rstrip().endswith("="):
            close = page.find(hit.group(), hit.end())
            if close < 0:
                break
            at = close + 1
        else:
            at = hit.end()
    return len(page)


def _plain_hints(name: str) -> tuple[int, int, int]:
    return int(name in FRAMES), int(name in KEEPERS), int(name in UNSEEN)


def _hints(name: str, tag: str) -> tuple[int, int, int]:
    """(framed, main, unseen) of one element by its name and attributes."""
    framed, main, unseen = _plain_hints(name)
    for key, *values in _ATTRIBUTE.findall(tag):
        value, key = next(filter(None, values), ""), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            unseen = 1
        elif key == "style":
            unseen |= int(re.search(r"display\s*:\s*none", value) is not None)
        elif name not in ("html", "body"):
            for token in value.split():
                if token.lower().startswith(STATES):
                    continue
                words = set(_WORD.findall(_CAMEL.sub("-", token).lower()))
                titled = words & TITLE_WORDS and words & {"header", "text"} and not words & (FRAME_WORDS - {"header"})
                framed |= int(bool(words & FRAME_WORDS) and not titled)
                main |= int(bool(words & MAIN_WORDS))
    return framed, main, unseen


class Part(NamedTuple):
    """What holds inside an open element: its own marks together with those of all around it."""

    name: str = ""
    unseen: int = 0
    framed: int = 0
    main: int = 0
    heading: int = 0
    paragraph: int = 0
    item: int = 0
    link: int = 0
    kept: int = 0  # inside article or main

    def inner(self, name: str, tag: str) -> Part:
        plain = len(tag) <= len(name) + 2
        framed, main, unseen = _plain_hints(name) if plain else _hints(name, tag)
        framed |= int(name == "header" and not self.kept)
        return Part(
            name,
            self.unseen | unseen,
            framed if name == "main" else self.framed | framed,
            self.main | main,
            self.heading | int(name in HEADINGS),
            self.paragraph | int(name == "p"),
            self.item | int(name in ITEMS),
            self.link | int(name == "a"),
            self.kept | int(name in KEEPERS),
        )


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space reduced to single spaces.

    Block elements begin a block, and so does their end. Text of elements
    that a browser does not show is left out.
    """
    found: list[Block] = []
    pieces: list[tuple[str, int]] = []
    stack = [Part()]
    opened: dict[str, int] = defaultdict(int)

    def flush() -> None:
        text = " ".join("".join([p for p, _ in pieces]).split()) if pieces else ""
        if text:
            words, part = text.count(" ") + 1, stack[-1]
            linked = sum(len(p.split()) for p, inside in pieces if inside)
            marks = (part.framed, part.main, part.heading, part.paragraph, part.item)
            found.append(Block(text, words, min(1.0, linked / words), *marks, int(bool(_SENTENCE.search(text[-9:])))))
        pieces.clear()

    def close(names: frozenset[str], until: frozenset[str] = frozenset()) -> None:
        """Take the innermost element of these names off the stack, with all inside it."""
        for name in names:
            if opened[name]:
                break
        else:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                for part in stack[i:]:
                    opened[part.name] -= 1
                del stack[i:]
                return
            if stack[i].name in until:
                return

    at = 0
    while at < len(page):
        opening = _MARKUP.search(page, at)
        start = opening.start() if opening else len(page)
        if start > at and not stack[-1].unseen:
            text = page[at:start]
            pieces.append((html.unescape(text) if "&" in text else text, stack[-1].link))
        if not opening:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        named = _NAME.match(page, start)
        if not named:
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            continue
        name, at = named.group(1).lower(), _tag_end(page, named.end())
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            pieces.append((" ", 0))
        if page[start + 1] == "/":
            close(frozenset((name,)))
            continue
        if block:
            close(PARAGRAPH, NOT_PARAGRAPH)
        if name in CLOSES:
            close(CLOSES[name], LISTS)
        if name == "a":
            close(ANCHOR, BLOCKS)
        if name in VOID or page[at - 2 : at] == "/>" and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        stack.append(stack[-1].inner(name, page[start:at]))
        opened[name] += 1
    flush()
    return found


FEATURES = (
    "words", "links", "framed", "main", "heading", "paragraph", "item", "sentence",
    "words_before", "links_before", "framed_before", "words_after", "links_after", "framed_after",
)


def features(found: list[Block]) -> np.ndarray:
    """A row per block: its own measures, then those of the block before and after (zero at the ends)."""
    own = np.array([[b.words, b.links, b.framed, b.main, b.heading, b.paragraph, b.item, b.sentence] for b in found])
    own = own.reshape(len(found), 8).astype(float)
    edge = np.zeros((1, 3))
    near = np.concatenate([edge, own[:, :3], edge])
    return np.concatenate([own, near[:-2], near[2:]], axis=1)


@dataclass
class Tree:
    """A node that asks whether feature ``at`` is at most ``cut``, or a leaf with a share of kept blocks."""

    share: float
    at: int = -1
    cut: float = 0.0
    sides: list[Tree] = field(default_factory=list)

    def keep(self, x: np.ndarray) -> np.ndarray:
        if not self.sides:
            return np.full(len(x), self.share >= 0.5)
        low = x[:, self.at] <= self.cut
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.sides[0].keep(x[low]), self.sides[1].keep(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 3) -> Tree:
    """A tree of Gini splits; of equally good ones the first feature's lowest cut is taken."""
    node = Tree(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or node.share in (0.0, 1.0) or len(y) < 2 * least:
        return node
    best = node.share * (1 - node.share) * len(y) - 1e-9
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, kept = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        for i in np.nonzero(v[:-1] < v[1:])[0]:
            left, right = n[i], len(y) - n[i]
            if min(left, right) < least:
                continue
            p, q = kept[i] / left, (kept[-1] - kept[i]) / right
            impurity = left * p * (1 - p) + right * q * (1 - q)
            if impurity < best - 1e-12:
                best, node.at, node.cut = impurity, j, (v[i] + v[i + 1]) / 2
    if node.at >= 0:
        low = x[:, node.at] <= node.cut
        node.sides = [grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)]
    return node


def train(pages: tuple[str, ...] = PAGES) -> Tree:
    """Fit the tree to pages whose article blocks begin with the mark; the table is small by definition."""
    rows, kept = [], []
    for page in pages:
        marked = [b.text.startswith(MARK) for b in blocks(page)]
        rows.append(features(blocks(page.replace(MARK, ""))))
        kept += marked
    return grow(np.concatenate(rows), np.array(kept, float))


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, tree.keep(features(found))) if keep)


def extract_text(pages: DataFrame, tree: Tree | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with the main text of each in column ``text`` and its length in
    code points in ``n_chars``, which replace columns of those names.

    Null, empty and text-free pages have an empty text. Every row is read from
    its own page alone: nothing is shuffled.
    """
    bound_batches(pages.sparkSession)
    fitted = tree or train()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, fitted) for p in batch], dtype=object)

    return pages.withColumn("text", run(whole_text(html_col))).withColumn("n_chars", F.length("text").cast("bigint"))
