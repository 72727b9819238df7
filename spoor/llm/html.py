"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  Each block has its word count and link
density, those of the blocks before and after it, and three marks of where it stands: inside
an article (or outside the page's article), inside an element of page furniture, inside a
container whose whole name is one of such.  A decision tree (Gini, grown in numpy) trained
on the small labelled table below decides which blocks are main text.

Defined cases: a null, empty or wordless page has the empty text; markup may be unclosed or
cut off anywhere; character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one space; comments, scripts, styles
and other raw elements never give text; repeated rows give equal texts; an empty table gives no rows; a
very long page is held and read once, in time linear in its length.  Columns other than id,
url and html are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import load, map_batches, texts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*+(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+(?:>|\Z)|</?[a-zA-Z][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|aria-label|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "svg", "textarea", "title", "iframe", "canvas", "select", "button", "xmp", "noframes", "audio", "video"}
#: Raw elements that hold elements: where one is never closed, what follows is read on.
_HOLDS = {"template", "svg", "canvas", "select", "button", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
#: Elements of page furniture.
_FURNITURE = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset", "head"}
_MAIN = {"article", "main"}
#: Names in a class, id or role that say what a container is, as whole words (fixed values).
_NAMED = frozenset(
    "ad ads advert advertisement adsense banner sponsor sponsored promo cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice popup modal "
    "newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc site-header masthead topbar toolbar footer site-footer copyright "
    "sidebar widget related related-posts recommended share sharing share-buttons social-share comment comments comment-list reader-comments disqus replies reply respond login "
    "search searchform search-form skip skip-link complementary contentinfo disclaimer teaser teasers outbrain taboola hidden".split()
)
#: Words that name furniture in a name of several parts too, and words of places and holders beside them: ``ad-slot``, ``user-comments`` (fixed values).
_PARTS = frozenset("ad ads advert advertisement sponsor sponsored promo cookie cookies gdpr consent newsletter comment comments disqus breadcrumb breadcrumbs navbar popup outbrain taboola".split())
_HOLDERS = frozenset(
    "slot box bar unit container wrapper wrap block area section list top bottom left right inner outer upper lower header footer side sticky fixed user reader visitor thread form item items "
    "notice policy message overlay modal banner panel strip frame zone holder row column group widget links google display native inline 1 2 3 4 5".split()
)
#: Parts of a name that say that a container holds the text, whatever its other names are (fixed values).
_TEXT_NAMES = frozenset("article content post entry story main body text page layout".split())


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    inside_main: bool
    element: bool
    named: bool


@dataclass
class _Open:
    name: str
    element: bool
    named: bool
    main: bool


@functools.lru_cache(maxsize=1 << 14)
def _by_parts(name: str) -> bool:
    """Whether each part of a name is a word of furniture or of a holder, and one of furniture."""
    parts = set(name.split("-"))
    return bool(parts & _PARTS) and parts <= _PARTS | _HOLDERS


def _opened(name: str, tag: str) -> _Open:
    """What an element is by its kind, its names and its state."""
    out = _Open(name, name in _FURNITURE, False, name in _MAIN)
    if name in ("body", "html") or " " not in tag and "\t" not in tag and "\n" not in tag:
        return out
    names: set[str] = set()
    for m in _ATTR.finditer(tag, len(name) + 1):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            out.element = True
        elif key in ("class", "id"):
            names.update(value.replace("_", "-").split())
        elif key == "role":
            out.main |= value == "main"
            out.named |= value in _NAMED
        elif key == "itemprop":
            out.main |= value == "articlebody"
            out.named |= value == "comment"
    if (names & _NAMED or any(map(_by_parts, names))) and not out.main and not any(_TEXT_NAMES.intersection(n.split("-")) for n in names):
        out.named = True
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack: list[_Open] = []
    held: list[str] = []
    linked: list[str] = []
    link_depth = 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            links = len(entities.unescape("".join(linked)).split())
            out.append(Block(text, text.count(" ") + 1, links, any(o.main for o in stack), any(o.element for o in stack), any(o.named for o in stack)))
        held.clear()
        linked.clear()

    at = 0
    lower = None
    while at <= len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            held.append(page[at:stop])
            if link_depth:
                linked.append(page[at:stop] + " ")
        if not m:
            break
        at = m.end() if m.end() > stop else stop + 1
        tag = m[0]
        if tag.startswith("<!") or tag.startswith("<?"):
            continue
        name = _NAME.match(tag)[1].lower()
        closing = tag[1] == "/"
        if not closing and name in _RAW and not tag.endswith("/>"):
            if name not in _INLINE:
                close()
            lower = lower or page.lower()
            end = lower.find("</" + name, at) if len(lower) == len(page) else (e.start() if (e := re.compile("</" + name, re.I).search(page, at)) else -1)
            if name in ("button", "select") and end >= 0 and re.compile("<" + name + r"[\s>]", re.I).search(page, at, end):
                end = -1  # these do not nest: the end tag belongs to a later one
            if end >= 0:
                at = page.find(">", end)
                at = at + 1 if at >= 0 else len(page) + 1
                continue
            if name not in _HOLDS:  # never closed: nothing after it is text
                break
            continue
        if name == "a":
            link_depth = max(0, link_depth + (-1 if closing else 1))
            if not closing and link_depth > 1:
                link_depth = 1
        opened = None if closing else _opened(name, tag)
        if name in _INLINE and not (opened and (opened.element or opened.named)):
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:  # an inline element that was opened as furniture
                        close()
                        del stack[k]
                        break
                    if stack[k].name not in _INLINE:
                        break
            continue
        close()
        if name in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            if name in ("div", "section", "article", "main", "body"):
                link_depth = 0
        elif not tag.endswith("/>"):
            if name in ("p", "li", "td", "tr", "dt", "dd", "option"):  # their end tags may be left out
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                    if stack[k].name not in _INLINE:
                        break
            stack.append(opened)
    close()
    return out


FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "element", "named", "place")


def features(words: np.ndarray, links: np.ndarray, inside: np.ndarray, element: np.ndarray, named: np.ndarray) -> np.ndarray:
    """A row of features for each block; place is 1 inside an article, -1 outside the page's article, 0 on a page without one."""
    density = links / np.maximum(words, 1)
    around = lambda v, d: np.concatenate([v[1:], [0]]) if d > 0 else np.concatenate([[0], v[:-1]])
    has_main = float((inside * (1 - element) * (1 - named) * words).sum() > 0)
    place = np.where(inside > 0, 1, -has_main)
    return np.stack([words, density, around(words, -1), around(density, -1), around(words, 1), around(density, 1), element, named, place], 1)


def table(found: list[Block]) -> np.ndarray:
    return features(*(np.array(c, float) for c in zip(*((b.words, b.link_words, b.inside_main, b.element, b.named) for b in found))))


class Tree:
    """A binary decision tree: Gini impurity, exact splits, leaves vote."""

    def __init__(self, depth: int = 12, least: int = 1):
        self.depth, self.least = depth, least
        self.nodes: list[tuple] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.nodes = []
        self._grow(x, y.astype(float), self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        here = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth and 0 < y.sum() < len(y):
            best = (y.mean() * (1 - y.mean()) - 1e-9, None, 0.0)
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, t = x[order, f], y[order]
                left = np.arange(1, len(y))
                ones = np.cumsum(t)[:-1]
                ok = (v[1:] > v[:-1]) & (left >= self.least) & (len(y) - left >= self.least)
                if not ok.any():
                    continue
                a, b = ones / left, (t.sum() - ones) / (len(y) - left)
                cost = np.where(ok, (left * a * (1 - a) + (len(y) - left) * b * (1 - b)) / len(y), np.inf)
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (cost[i], f, (v[i] + v[i + 1]) / 2)
            if best[1] is not None:
                side = x[:, best[1]] <= best[2]
                lo = self._grow(x[side], y[side], depth - 1)
                hi = self._grow(x[~side], y[~side], depth - 1)
                self.nodes[here] = (best[1], best[2], lo, hi, float(y.mean()))
        return here

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, lo, hi, vote = (np.array(c) for c in zip(*self.nodes))
        while (open_ := feature[at] >= 0).any():
            i = at[open_]
            at[open_] = np.where(x[open_, feature[i]] <= cut[i], lo[i], hi[i])
        return vote[at] >= 0.5


#: The labelled table, a line for each page: + marks a block of main text and - any other, then its words, / its linked words,
#: a if it is inside an article, e inside an element of page furniture, n inside a container with a name of such.
_LABELLED = """
-3e -1/1e -2/2e -1/1e +4a +60a +7a +2a -5e
-9/9e -10n +2a +3a +7a -12e
-40n +5a +35a +3a +36a -40ae +7a
+30a -1/1an +32a -3ae -35an -2an -9e
-36n +6 +40 +42 +38 -3/3 -4/4
-1/1 -3/3 +33 +34 +9 +41 -5/5 -2
-60n -6ae +33a +8a -5ae
+4a +32/2a +9/9a +10a -20 -45
+35 +38 -33n -9n
-9 +2a +1a +3/3a +1a +90a +1a -1 -40
-33 +1a +3a +70a +6/6a +5a +2a -9 -1/1
+8a -70 -35
+9a +36a
-1 -3/3 +35 +36 -1/1
-2/2 -3/3 -2/2 -4/4 +6 +50 +12 +3 +5 +44 +9 -6/6 -5/5 -4/4
-5/5 -4/4 +7 +28 +5 +8 +6 +9 +31 -4/4 -3
+5 +60 -60/60 -60/60 -60/60 -3/3
-60/60 -60/60 -60/60 -60/60 -60/60
-12/12 -14/13 -30/29 -25/25 -40/38 -9/8
+6a +50a -60/60a -58/58a -60/60a -61/61a
+6a +50a +60/60a +40a
+4a -60/60a -60/60a -60/60a -60/60a -60/60a
+3a -20/20a -22/22a -18/18a -25/25a
+3a +45a +20/20a +50a +6/6a +35a
+12a +9/5a +40/6a +8/3a +15a
+2a +1a +1a +2a +3a
-2/2 +5 +25/3 +3/1 +30/4 +40 -3/2 -4/4
-3 -2/2 -3/3 +9 +120 +4 +110 -2/2 -7
+120
+3
+14 +12 +9 +15 +11
+6 +8 +5 +70 +6 +4 +7
-3/3 -4/4 -3 -2/2 -5/5 -3 -4/4
-2/1 -3/2 -4/3 +40 -3/2 -4/3 -5/4
-1/1 -1/1 +30 +3 +28 -1/1 -1/1
-7/7 -8/8 -60/50 -9/9 +45 +50/5 +45 -8/8 -7/7
+100/20 +90/30 +80/10 -30/28
-8e -70e -9e +6 +80 +7
-15n -80n +6 +70 -60n
-4/4e -5/5e -25 -30/2 +9a +30a -30 -20/1 -40
-2/2 -80 +5a +4a -60 -3
+10a +60/58a +11a +60/60a +9a
+8a +5/5a +7a +60/55a -60/60a -55/55a
-10 +3a +60a
-2e +2a +5a +60a -4e
+60a +2a
+1a +4a
+20a
+64a +3a +9a
-3/3e +2a +30a +1a
+1a
+3a +12a -8
-5e +2a +50a -7 -3/3
+1a +1a
+2a +100a +2a +3a
+3/1a +9a
-1
-2
-1 -1
-1/1 -2/2 +2 +60 +2 +55 +1 +1 +58 -1/1
-2/2 -1/1 +3 +70 +3 +66
-4 -2/2 +70 +80 -2
+4a +2a +30a
+4a +1a
+5a +1a +9a
+4a
+6a +2a +2a
-1/1 +4 +60 +5 +40 -2/2 -3
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled table."""
    xs, ys = [], []
    for page in _LABELLED.split("\n"):
        found = re.findall(r"([+-])(\d+)(?:/(\d+))?([aen]*)", page)
        if found:
            marks = [np.array([m in kind for *_, kind in found], float) for m in "aen"]
            xs.append(features(np.array([float(w) for _, w, *_ in found]), np.array([float(n or 0) for _, _, n, _ in found]), *marks))
            ys += [sign == "+" for sign, *_ in found]
    return np.concatenate(xs), np.array(ys)


@functools.lru_cache(maxsize=1)
def trained() -> Tree:
    """The tree of this process: it is grown once."""
    return Tree().fit(*labelled())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = (tree or trained()).predict(table(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page: one narrow pass."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def columns(batch: pa.RecordBatch) -> dict:
        out = [main_text(t) for t in texts(batch, "html")]
        return {"id": batch.column(0), "url": batch.column(1), "text": out, "n_chars": [len(t) for t in out]}

    kind = own.schema
    schema = f"id {kind['id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string, n_chars bigint"
    return map_batches(own, schema, columns).withColumnsRenamed({"id": id_col, "url": url_col})


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
