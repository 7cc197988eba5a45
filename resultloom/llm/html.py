"""Main text of web pages: flat text blocks, classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from resultloom.llm.text import pieces

_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<hidden>script|style|title|noscript|template|textarea|select|svg|iframe|object|canvas|math)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=hidden)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>{_NAME})(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+>",
    re.S | re.I,
)
_HINTED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HINT = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|gdpr|"
    r"sidebar|menu|nav\w*|breadcrumbs?|footer|foot|masthead|topbar|toolbar|siteheader|pageheader|comments?|"
    r"replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|"
    r"widget|legal|copyright|contentinfo|complementary|navigation"
)
_PLACE = re.compile(
    r"main|site|page|top|bottom|left|right|global|primary|secondary|bar|box|block|wrap(?:per)?|container|list|links?|section|area|"
    r"content|body|form|text|inner|items?|units?|slots?|panel|buttons?|icons?|posts?|articles?|stories|count|thread|[a-z]?\d+"
)


def _hints(name: str) -> bool:
    """Whether a whole class name is a hint, alone or with words of place or shape; "share-price" is none."""
    for pair in ("side-bar", "site-header", "page-header"):
        name = name.replace(pair, pair.replace("-", ""))
    parts = [part for part in re.split(r"[-_.:]+", name) if part]
    hints = [bool(_HINT.fullmatch(part)) for part in parts]
    return any(hints) and all(hint or _PLACE.fullmatch(part) for hint, part in zip(hints, parts))


# Elements that are closed by their own end tag, and those that a like one closes.
_BOXES = frozenset(
    "div section article main nav header footer aside form menu ul ol dl table figure dialog body html head fieldset blockquote details center".split()
)
_LOOSE = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6 pre address figcaption caption summary button label legend thead tbody tfoot hr".split())
_NOT_MAIN = frozenset("nav footer aside form menu dialog button".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "hinted", "article", "heading")


@dataclass
class Block:
    """Text between two block tags, with what its place in the page says of it."""

    text: str
    words: int
    linked: int
    hinted: bool
    article: bool
    heading: bool

    @property
    def links(self) -> float:
        return self.linked / self.words if self.words else 0.0


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; what is never shown (scripts, styles, comments) is left out."""
    found: list[Block] = []
    # Open elements, each with what holds inside it: hinted, in the article, in a heading, in which form.
    stack: list[tuple[str, bool, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    forms, owners = 0, []
    parts: list[str] = []
    linked_parts: list[str] = []
    in_link, at = False, 0

    def flush():
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(html.unescape(" ".join(linked_parts)).split())
            _, hinted, article, heading, form = stack[-1] if stack else ("", False, False, False, 0)
            found.append(Block(text, len(text.split()), linked, hinted, article, heading))
            owners.append(form)
        parts.clear()
        linked_parts.clear()

    def take(text):
        if text:
            parts.append(text)
            if in_link:
                linked_parts.append(text)

    for token in _TOKEN.finditer(page):
        take(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if tag == "a":
            in_link = not token["close"]
        elif tag == "br":
            parts.append(" ")
        if tag not in _BOXES and tag not in _LOOSE:
            continue
        flush()
        if token["close"]:
            for depth in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    opened.subtract(entry[0] for entry in stack[depth:])
                    del stack[depth:]
                    break
                if tag in _LOOSE and stack[depth][0] in _BOXES:
                    break
            if tag in _BOXES:
                in_link = False
            continue
        while stack and stack[-1][0] in _LOOSE and (stack[-1][0] == tag or stack[-1][0] in ("p", "hr") or stack[-1][0][0] == "h" and tag != "a"):
            opened[stack.pop()[0]] -= 1
        if tag != "hr":
            _, hinted, inside, heading, form = stack[-1] if stack else ("", False, False, False, 0)
            hint = tag in _NOT_MAIN or (tag == "header" and not inside)
            for value in _HINTED.finditer(token["rest"]) if token["rest"] and tag not in ("body", "html", "article", "main") else ():
                hint = hint or any(_hints(name) for name in (value[1] or value[2] or value[3] or "").lower().split())
            if not token["rest"].endswith("/"):
                if tag == "form":
                    forms += 1
                    # A form within something hinted stays part of that.
                    form, hint = (0, True) if hinted else (forms, False)
                headed = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
                stack.append((tag, hinted or hint, inside or tag in ("article", "main"), heading or headed, form))
                opened[tag] += 1
    take(page[at:])
    flush()
    # A form that holds most words of a page is what the page is wrapped in; others are for filling in.
    held: Counter[int] = Counter()
    for block, form in zip(found, owners):
        held[form] += block.words - block.linked
    for block, form in zip(found, owners):
        block.hinted = block.hinted or bool(form) and 2 * held[form] <= held.total()
    return found


def features(found: list[Block]) -> np.ndarray:
    """One row per block: its own numbers and those of its neighbours."""
    own = np.array([[b.words, b.links] for b in found], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    place = np.array([[b.hinted, b.article, b.heading] for b in found], dtype=float).reshape(-1, 3)
    return np.hstack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:], place]) if found else np.zeros((0, 9))


# The labelled table: small pages of our own, whose main blocks carry "+".
_SAMPLES = (
    "<nav><ul><li><a>Home</a><li><a>World news</a><li><a>Sport</a></ul></nav><article><h1>+A bridge is built</h1>"
    "<p>+The city has opened a new bridge over the river after six years of work and many delays.<p>+It is open."
    "<p>+Walkers and trams share the deck, while cars keep to the old crossing further north, planners said on Monday.</article>"
    "<footer>Copyright 2020 The City Paper. All rights reserved.</footer>",
    "<header><div>The Daily Page</div><div>News you can trust, every morning since the year 1900</div></header><div class=ad>Buy two and get one free, "
    "only this week and only in our shops in town.</div><div><h2>+Short rain</h2><p>+Rain fell.</p><p>+Rain fell on the hills for most of "
    "the night and had stopped by the time the first trains ran.</p><p>+<a>The office</a> expects more of it on Friday.</p></div><aside><p>Most read</p>"
    "<p><a>Ten ways to cook a potato</a></p><p>Readers liked these pieces more than all the others we had this week.</p></aside>",
    "<div class=cookie-notice><p>We use cookies to make this site work and to count visits. By going on you agree to that.</p></div><main><p>+A short note."
    "</p><p>+One more paragraph that says what the note is about, with enough words to look like prose.</p><ul><li>+first item</li><li>+second one</li></ul>"
    "</main><div class=comments><p>I do not agree with a single word of this, and I have said so many times before.</p><p>Nice one!</p></div>",
    "<ul><li><a>Start</a></li><li><a>About us</a></li><li><a>Contact</a></li></ul><p>+Trees in the park were counted by hand, and there are more of them "
    "than the map shows.</p><p>+Most are limes.</p><p>+A few oaks by the pond are older than the park and than the town itself.</p><p><a>Next page</a> <a>Back</a></p>"
    "<form><p>Enter your address to get our letter once a week, free of charge.</p></form>",
    "<div><a>Log in</a> | <a>Register</a></div><h1>+On clocks</h1><div>+Clocks in towers were once wound by hand, a job that took strong arms and an hour.</div>"
    "<div>+Few remain.</div><div class=sidebar><h3>About the author</h3><p>A writer who lives by the sea with two cats and a large number of old clocks.</p></div>"
    "<div class=related><a>More on clocks</a></div><footer><p>Terms of use, privacy and all the other things that pages end with.</p></footer>",
    "<article><p>+Yes.</p><p>+No.</p><p>+<a>Maybe</a></p><h2>+Why</h2><p>+It was a long day.</p><div class=share>Share this with your friends</div></article>"
    "<nav><p>Choose one of the many sections that our pages are kept in</p></nav>",
)


@dataclass
class Node:
    """A split (feature at most limit: low, else high) or, without children, a class."""

    main: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: np.ndarray, main: np.ndarray, depth: int = 5, least: int = 1) -> Node:
    """CART: the split of least Gini impurity, first feature and limit on ties."""
    node = Node(bool(main.mean() >= 0.5))
    if not depth or main.all() or not main.any():
        return node
    best = (2 * main.mean() * (1 - main.mean()) * len(main) - 1e-9, -1, 0.0)
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= limit
            if min(low.sum(), (~low).sum()) >= least:
                cost = sum(2 * part.mean() * (1 - part.mean()) * len(part) for part in (main[low], main[~low]))
                if cost < best[0] - 1e-9:
                    best = (cost, feature, float(limit))
    if best[1] < 0:
        return node
    low = rows[:, best[1]] <= best[2]
    return Node(node.main, best[1], best[2], grow(rows[low], main[low], depth - 1, least), grow(rows[~low], main[~low], depth - 1, least))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rows, main = [], []
    for page in _SAMPLES:
        marks = [b.text.startswith("+") for b in blocks(page)]
        rows.append(features(blocks(page.replace("+", ""))))
        main += marks
    return np.vstack(rows), np.array(main)


def classify(node: Node, rows: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(rows), node.main)
    low = rows[:, node.feature] <= node.limit
    out = np.empty(len(rows), dtype=bool)
    out[low], out[~low] = classify(node.low, rows[low]), classify(node.high, rows[~low])
    return out


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, classify(tree, features(found))) if keep)


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of ``pages``.

    A page is cut into flat text blocks at its block tags; word counts and link densities
    of a block and its neighbours, and what the tags around it say, go through a decision
    tree (Kohlschuetter et al., 2010) grown on a small labelled table. Kept blocks are
    joined by a newline. Null, empty and markup-only pages give an empty text; every row
    stays, repeated ones too, and other columns are ignored.
    """
    tree = tree or grow(*labelled())

    def run(batches):
        for batch in pieces(batches, "html"):
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.select("page_id", "url").dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
