"""HTML extraction: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block is known by
its words and link density, those of the blocks before and after it, where it stands (inside
the page's article or main element, in one of the tags that HTML has for navigation, asides,
footers and forms, in a list), and how far the class and id names around it say that it is
something else. A decision tree, grown from the blocks of the small labelled pages below, tells
article text from the rest. Names are a feature among others: a name that is only partly such
("related-work", "social-history") leaves the verdict to words, links and neighbours.

Markup is read leniently, by a scanner that looks at each byte a bounded number of times:
unclosed tags end where HTML says they do, comments, scripts and styles vanish, character
references are decoded, white space inside a block becomes one space. Null or empty html, and
pages without article text, give an empty text. Repeated rows are read each. Nothing is cut
off, however long.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk
from quillspark.llm.shared import table

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")  # possessive: no step is taken twice
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What lies between these tags isn't markup, and isn't the page's text.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I | re.A) for t in ("script", "style", "textarea", "title", "iframe")}
#: Graphics, templates and choices: their text isn't the page's.
_HIDDEN = frozenset("template svg canvas object select datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_PARTS = frozenset("nav footer aside form header menu dialog head button label fieldset".split())
_MAIN = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class and id names that speak of something beside the article, words that say nothing, and readers' comments.
_ASIDE = frozenset("""ad ads adv advert advertisement advertising sponsor sponsored nav navbar navigation menu bar breadcrumb breadcrumbs sidebar notice
    notification notifications alert share sharing social footer masthead toolbar tools meta byline tags promo promotion promoted popup modal related
    recommended recommendations login signup search cookie cookies consent gdpr banner widget pager pagination paywall newsletter subscribe subscription
    disclaimer comment comments disqus reply replies""".split())  # fmt: skip
_NEUTRAL = frozenset("box list wrap wrapper container section block item items inner outer area widget links link buttons button form left right top bottom main col column row page site post posts entry content js the of to and for your thread".split())
_COMMENTS = frozenset("comment comments disqus reply replies".split())
_BARRIERS = frozenset(("article", "main", "body"))
_LISTS = frozenset("ul ol dl table select".split())
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "part", "hint", "item")


def scan(page: str):
    """(text, None, None, None) and (None, closing, tag, attributes) of a page, in order. What can't be markup is text."""
    start = at = unclosed = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            if at > start:
                yield page[start:at], None, None, None
            end = page.find("-->", at + 4)
            start = at = len(page) if end < 0 else end + 3
            continue
        m = _OPEN.match(page, at)
        declared = not m and page[at + 1 : at + 2] in ("!", "?")
        if not m and not declared:
            at += 1
            continue
        end = page.find(">", at)
        if end < 0:  # no tag can follow
            break
        if at > start:
            yield page[start:at], None, None, None
        if declared:
            start = at = end + 1
            continue
        # a quote that is never closed isn't one; after some of these, quotes aren't looked for any more
        rest = _REST.match(page, m.end()) if unclosed < 50 else None
        if rest:
            end = rest.end() - 1
        else:
            unclosed += 1
        tag, attrs = m[2].lower(), page[m.end() : end]
        start = at = end + 1
        if tag in _RAW and not m[1]:
            if not attrs.endswith("/"):
                close = _RAW[tag].search(page, at)
                start = at = close.end() if close else len(page)
            continue
        yield None, bool(m[1]), tag, attrs
    if start < len(page):
        yield page[start:], None, None, None


def says(attrs: str) -> tuple[bool, float, bool, bool]:
    """What an element's attributes say: that it is a part beside the text, how far its names do (0 to 1), readers' comments, a header."""
    part = comment = header = False
    hint = 0.0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).strip()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            part = True
        elif name == "role":
            part |= value.lower() in _ROLES
        elif name in ("class", "id"):
            for one in value.split():
                words = [t.lower() for t in _NAME.findall(one)]
                hits = sum(w in _ASIDE for w in words)
                share = hits / (hits + sum(w not in _ASIDE and w not in _NEUTRAL for w in words)) if hits else 0.0
                hint = max(hint, share)
                comment |= share > 0.75 and any(w in _COMMENTS for w in words)
                header |= "header" in words
    return part, hint, comment, header


class Elements:
    """The open elements: tag, part, inside main, comments, hint; with counts, so that no tag walks over what it can't close."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, bool, float]] = []
        self.total: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]  # from the last barrier on
        self.lists: list[dict[str, int]] = [{}]  # from the last list on
        self.headings = self.hidden = 0

    def _count(self, tag: str, by: int) -> None:
        for counts in (self.total, self.scopes[-1], self.lists[-1]):
            counts[tag] = counts.get(tag, 0) + by
        self.headings += by * (tag in _HEADINGS)
        self.hidden += by * (tag in _HIDDEN)

    def push(self, tag: str, *more) -> None:
        self._count(tag, 1)
        self.stack.append((tag, *more))
        if tag in _BARRIERS:
            self.scopes.append({})
        if tag in _LISTS:
            self.lists.append({})

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            if tag in _BARRIERS:
                self.scopes.pop()
            if tag in _LISTS:
                self.lists.pop()
            self._count(tag, -1)

    def close(self, tag: str) -> None:
        """An end tag: closes down to its element, but not past an article for a tag inside it."""
        counts = self.total if tag in ("html", "body", "article", "main", "div", "section") else self.scopes[-1]
        if counts.get(tag):
            self.pop(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))

    def make_room(self, tag: str) -> None:
        """What a start tag closes: a paragraph by a block, an item by the next."""
        if tag in _BLOCK and self.scopes[-1].get("p"):
            i = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] in _BLOCK)
            if self.stack[i][0] == "p":
                self.pop(i)
        ends = _CLOSES.get(tag, ())
        if any(self.lists[-1].get(x) for x in ends):
            self.pop(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] in ends))


def blocks(page: str) -> list[tuple[str, int, float, int, int, float, int]]:
    """(text, words, link density, inside an article, part, hint, list item) of a page's text blocks, in order."""
    out: list = []
    open_ = Elements()
    text: list[tuple[str, bool]] = []

    def end() -> None:
        joined = " ".join(html.unescape("".join(t for t, _ in text)).split()) if text else ""
        if joined:
            n = joined.count(" ") + 1
            links = sum(len(html.unescape(t).split()) for t, is_link in text if is_link)
            _, part, main, _, hint = open_.stack[-1] if open_.stack else ("", 0, 0, False, 0.0)
            if part == 2:  # a header inside the article: its headings are the article's
                part = 0 if open_.headings else 1
            out.append((joined, n, min(1.0, links / n), main, part, hint, int(open_.total.get("li", 0) > 0)))
        text.clear()

    for words, closing, tag, attrs in scan(page):
        if tag is None:
            if not open_.hidden:
                text.append((words, open_.total.get("a", 0) > 0))
            continue
        if tag == "br":
            text.append((" ", False))
            continue
        if tag in _BLOCK:
            end()
        if closing:
            open_.close(tag)
            continue
        if tag in _VOID or (attrs.endswith("/") and tag not in _BLOCK):
            continue
        open_.make_room(tag)
        _, part, main, comments, hint = open_.stack[-1] if open_.stack else ("", 0, 0, False, 0.0)
        said, names, comment, header = says(attrs) if attrs.strip() and tag not in ("html", "body") else (False, 0.0, False, False)
        comments, hint = comments or comment, max(hint, names)
        if tag in _MAIN and not comments:
            main, part, hint = 1, part if main else 0, hint if main else 0.0
        elif (tag == "header" or header) and main and not (part or said or comments):
            part = 2
        elif tag in _PARTS or said or comments or header:
            part = 1
        open_.push(tag, part, main, comments, hint)
    end()
    return out


def features(found: list) -> np.ndarray:
    """A row of NAMES for each of a page's blocks. place: 1 inside the article, 0 on a page without one, -1 outside it."""
    has_main = any(b[3] for b in found)
    bare = (0, 0.0)
    rows = [(n, links, *(found[i - 1][1:3] if i else bare), *(found[i + 1][1:3] if i + 1 < len(found) else bare), (1 if main else -1) if has_main else 0, part, hint, item) for i, (_, n, links, main, part, hint, item) in enumerate(found)]
    return np.array(rows, np.float64).reshape(-1, len(NAMES))


# Labelled pages, in short: (element, content...) where the content is elements and blocks; a block is
# (words, linked words, label), its label 1 for article text. The words themselves don't matter.
def _of(tag: str, *sizes: tuple, label: int = 1) -> tuple:
    return tuple((tag, (n, linked, label)) for n, linked in sizes)


def _menu(n: int, words: int = 2) -> tuple:
    return ("ul", *_of("li", *[(words, words)] * n, label=0))


_PROSE = _of("p", (45, 0), (120, 4), (2, 0), (30, 9), (12, 0), (80, 0), (1, 0), (300, 0), (6, 3), (60, 0))
_SOME = _of("p", (40, 0), (9, 0), (70, 5), (25, 0))
_HEAD, _FOOT = ("nav", _menu(5)), ("footer", *_of("p", (9, 2), label=0))
_AD = "div class='ad'", (14, 0, 0)
PAGES = (
    (_HEAD, _AD, ("article", ("h1", (7, 0, 1)), *_PROSE), _FOOT),
    (_HEAD, ("article", ("h1", (3, 0, 1)), *_SOME, ("div class='advert-box'", (18, 0, 0)), *_SOME, ("div class='share-buttons'", _menu(3, 1)), ("h2", (2, 0, 1)), *_PROSE), _FOOT),
    (_HEAD, ("main", ("h1", (12, 0, 1)), ("div class='post-meta'", (6, 2, 0)), *_PROSE, ("ul", *_of("li", (25, 4), (4, 0), (12, 6), (30, 0))), *_SOME, ("section class='comments'", *_of("p", (20, 0), (60, 0), (4, 0), (150, 0), label=0)))),
    (("article", *_SOME, ("aside", *_of("p", (30, 0), (4, 0), (100, 3), label=0)), ("p", (1, 1, 1)), *_SOME, ("p", (3, 3, 1)), *_SOME, ("form", *_of("p", (7, 0), (2, 0), label=0)), ("nav", _menu(4)))),
    (("article", ("h1", (5, 0, 1)), *_SOME, ("section class='related-work'", ("h2", (2, 0, 1)), *_SOME, *_PROSE), ("div id='social-history'", ("h2", (2, 0, 1)), *_of("p", (8, 0), (50, 2), (3, 0))), ("div class='related-stories-here'", _menu(4, 6)), *_of("p", (40, 0)))),
    (("article", *_PROSE, ("ul", *_of("li", *[(3, 3)] * 4, label=0)), ("h2", (3, 0, 1)), *_SOME), ("div", *_of("p", (40, 0), (7, 0), (15, 5), (90, 0), label=0)), _FOOT),
    (("div class='cookie-notice'", *_of("p", (25, 2), (60, 3), label=0)), ("article", ("blockquote", (22, 0, 1)), ("pre", (35, 0, 1)), ("table", *_of("td", (1, 0), (2, 0), (3, 0))), *_SOME), ("div class='sidebar'", *_of("p", (30, 0), label=0), _menu(6, 4))),
    # pages without an article element
    (("div", _menu(6)), ("div class='content'", ("h1", (6, 0, 1)), *_PROSE, *_SOME), ("div", _menu(5, 3)), ("div class='footer'", (10, 1, 0))),
    (("div class='menu'", _menu(4)), _AD, ("div", ("h1", (4, 0, 1)), *_of("p", (60, 0), (25, 1), (14, 0)), ("h2", (3, 0, 1)), *_of("p", (35, 7), (200, 8), (5, 0), (40, 0)), ("ul", *_of("li", (16, 0), (30, 2), (9, 0))), *_SOME), ("div", ("p", (3, 0, 0)), _menu(5, 4)), _FOOT),
    (("table", ("tr", ("td", _menu(5, 2), ("p", (4, 4, 0))), ("td", *_PROSE, ("div class='comment-list'", *_of("p", (40, 0), (5, 0), (18, 0), label=0)))))),
    (*_of("p", (11, 0)),),
    (*_of("p", (35, 7), (3, 0), (28, 0)), _menu(3)),
    (_HEAD, ("div class='sponsored'", *_of("p", (40, 0), (12, 0), label=0)), ("div id='related-projects'", ("h2", (2, 0, 1)), *_PROSE), ("div class='newsletter-signup'", *_of("p", (18, 0), (3, 0), label=0)), _FOOT),
)


def render(node: tuple, marks: list[int]) -> str:
    """A labelled page's HTML; the labels of its blocks, in order, go to marks."""
    if isinstance(node[0], int):
        words, linked, label = node
        marks.append(label)
        told = ["word"] * words
        if linked:
            told[-linked] = "<a href='x'>" + told[-linked]
            told[-1] += "</a>"
        return " ".join(told)
    return f"<{node[0]}>" + "".join(render(x, marks) for x in node[1:]) + f"</{node[0].split()[0]}>"


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10):
    """A decision tree by Gini impurity: (feature, limit, left, right), left where feature <= limit, or a label."""
    if not depth or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        left, right = ones[cut - 1], ones[-1] - ones[cut - 1]
        gini = left * (cut - left) / cut + right * (len(y) - cut - right) / (len(y) - cut)
        # of equal splits the one with the widest gap
        gap = (v[cut] - v[cut - 1]) / (abs(v[cut]) + abs(v[cut - 1]) + 1)
        at = min(range(len(cut)), key=lambda i: (round(gini[i], 9), -gap[i]))
        found = (round(gini[at], 9), -gap[at])
        if best is None or found < best[0]:
            best = found, f, (v[cut[at]] + v[cut[at] - 1]) / 2
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, limit = best
    low = x[:, f] <= limit
    return f, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def labelled(pages: tuple = PAGES) -> list[tuple]:
    """The table the tree is grown from: for each block of the labelled pages its features and its label."""
    out = []
    for page in pages:
        marks: list[int] = []
        rows = features(blocks("".join(render(x, marks) for x in (page if isinstance(page[0], tuple) else (page,)))))
        if len(rows) != len(marks):
            raise ValueError("a labelled page's blocks aren't those that were labelled")
        out += [(*x, label) for x, label in zip(rows.tolist(), marks)]
    return out


LABELLED = labelled()
TREE = grow(np.array(LABELLED)[:, :-1], np.array([r[-1] for r in LABELLED]))


def decide(x, tree=TREE) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree=TREE) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, x in zip(found, features(found).tolist()) if decide(x, tree))


def extract_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""

    def extract(batches):
        for b in tk.slices(batches, "html"):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
