"""Main text of web pages: gradient-boosted trees over DOM nodes, then a consistent choice over the whole tree.

``parse`` reads a page as browsers do in the main: quoted attribute values of any length, raw text elements,
comments, void elements, implied ends of paragraphs and list items, character references. Inline elements and
``br`` don't part a block; any other element's start or end does. Nodes are the block elements and, as leaves, the
blocks of text. What isn't shown (scripts, styles, frames, templates, comments), form controls and drawings
(``svg``) are left out; formulas, and what stands in for objects and scripts, are read like other text. Work is
linear in the page, however deep its elements.

A node's features are its tag, the kinds of tokens in its class, id and role (``KINDS``), the kinds of its
ancestors, its subtree's density (characters a tag, link share, punctuation, paragraphs), its depth, its
place among its siblings and their sizes, and its place in the page. Boosted trees, fitted here on pages
that ``gramloom.llm.html_pages`` makes up with known main text, give each node's log-odds of being main text.

Decoding is hierarchical: a subtree is kept or dropped as a whole at its root, or kept in part, so no kept
node has a dropped ancestor; of all such choices, the one with the greatest sum of log-odds is taken, a
text block's weighted by the logarithm of its length.

Defined results: null or empty html gives an empty text; a page without main text too; a tag that never ends
is text; if a quoted value never ends, its tag and those after it end at the next >; rows are independent, so repeated rows give repeated results and an empty table an empty one; extra
columns are ignored. Nothing is cut off, however long the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, utf8

# Element names of the HTML standard, by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split()
)
#: Read up to their end tag, or to the page's end, as text that isn't shown; xmp's is shown.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Left out up to their end tag; without one, only the tag is.
SKIPPED = frozenset("svg template select datalist button annotation annotation-xml".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "thead", "tr", "td", "th")}
LISTS = frozenset("ul ol menu dl table".split())

#: A comment, a declaration, an odd end tag, or a tag: values follow an equals sign and may be quoted.
TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s>/]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*+)>""", re.S)
#: The same where a quoted value never ended.
PLAIN_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s>/]*)([^>]*)>", re.S)
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

#: Kinds of tokens in attributes, and the elements that mean the same.
KINDS = {
    "main": (r"article|content|post|entry|story|body|main|text|prose", "article main"),
    "menu": (r"nav|menu|breadcrumb|toc|pagination|pager|tabs?\b|skip", "nav menu"),
    "side": (r"side|aside|widget|related|recommend|trending|popular|more-", "aside"),
    "foot": (r"foot|copyright|legal|colophon", "footer"),
    "head": (r"header|masthead|banner|topbar|logo|brand", "header"),
    "advert": (r"\bads?\b|\bads?[-_]|[-_]ads?\b|advert|sponsor|promo|commercial", "ins"),
    "notice": (r"cookie|consent|notice|gdpr|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall", "dialog noscript"),
    "comment": (r"comment|reply|replies|disqus|discussion|respond", ""),
    "share": (r"share|social|follow|tags?\b|byline|meta|categor|catlinks", ""),
    "form": (r"form|search|login|input", "form fieldset option optgroup"),
}
KIND_TEXT = [re.compile(p, re.I) for p, _ in KINDS.values()]
KIND_TAGS = {t: i for i, (_, tags) in enumerate(KINDS.values()) for t in tags.split()}
TAGS = ("article", "main", "p", "heading", "list", "li", "div", "section", "table", "cell", "body", "text", "quote", "figure")
TAG_OF = {"article": 0, "main": 1, "p": 2, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 3), **dict.fromkeys(("ul", "ol", "dl", "menu"), 4), "li": 5, "dd": 5, "dt": 5, "div": 6, "section": 7, "table": 8, "td": 9, "th": 9, "tr": 9, "body": 10, "#text": 11, "blockquote": 12, "pre": 12, "figure": 13, "figcaption": 13}
STATS = ("chars", "tags", "density", "links", "stops", "paragraphs", "share", "mean_block", "depth", "index", "siblings", "sibling_share", "before", "after", "place", "parent_density", "parent_links", "capitals")
FEATURES = [*TAGS, *KINDS, *(f"in_{k}" for k in KINDS), *STATS]
N_KINDS, N_TAGS = len(KINDS), len(TAGS)


class Page:
    """Nodes in page order, each after its parent; leaves hold text blocks."""

    __slots__ = ("tag", "parent", "kinds", "text", "link", "tags")

    def __init__(self) -> None:
        self.tag, self.parent, self.kinds, self.text, self.link, self.tags = ["body"], [-1], [0], [None], [0], [0]

    def add(self, tag: str, parent: int, kinds: int, text: str | None = None, link: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.kinds.append(kinds)
        self.text.append(text)
        self.link.append(link)
        self.tags.append(0)
        return len(self.tag) - 1


def _kinds(tag: str, attributes: str) -> int:
    return _few_kinds(tag, attributes) if len(attributes) <= 256 else _few_kinds.__wrapped__(tag, attributes)


@lru_cache(maxsize=1 << 14)
def _few_kinds(tag: str, attributes: str) -> int:
    own = " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
    bits = 1 << KIND_TAGS[tag] if tag in KIND_TAGS else 0
    return bits | sum(1 << i for i, p in enumerate(KIND_TEXT) if own and p.search(own))


class _Open:
    """The open elements: node and name of each, how many there are of a name, and where list parts and lists stand."""

    def __init__(self) -> None:
        self.nodes, self.names, self.count, self.marks = [0], ["body"], {"body": 1}, []

    def push(self, node: int, name: str) -> None:
        if name in ITEMS or name in LISTS:
            self.marks.append(len(self.names))
        self.nodes.append(node)
        self.names.append(name)
        self.count[name] = self.count.get(name, 0) + 1

    def cut(self, k: int) -> None:
        """Closes all but the first k, of which the body is one."""
        while len(self.names) > max(k, 1):
            self.nodes.pop()
            self.count[self.names.pop()] -= 1
        while self.marks and self.marks[-1] >= len(self.names):
            self.marks.pop()

    def close(self, name: str) -> None:
        """Closes the last element of a name, and what is open within."""
        k = len(self.names) - 1
        while self.names[k] != name:
            k -= 1
        self.cut(k)

    def item(self, name: str) -> None:
        """Closes what a part of a list or table ends: the outermost of such parts up to its list or table."""
        k = len(self.marks) - 1
        while k >= 0 and self.names[self.marks[k]] not in LISTS and self.names[self.marks[k]] not in ITEMS[name]:
            k -= 1
        if k >= 0 and self.names[self.marks[k]] in ITEMS[name]:
            at = self.marks[k]
            while at > 1 and self.names[at - 1] in ITEMS[name]:
                at -= 1
            self.cut(at)


def parse(source: str) -> Page:
    page, open_, tags = Page(), _Open(), TAG
    parts: list[str] = []
    linked, in_link, at, endless = 0, False, 0, set()

    def block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.add("#text", open_.nodes[-1], 0, text, min(linked, len(text)))
            parts.clear()
        linked = 0

    def end_of(tag: str) -> re.Match | None:
        """The next end tag of a name; a name without one is looked for once."""
        if tag in endless:
            return None
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
        if m is None:
            endless.add(tag)
        return m

    end = source.rfind(">") + 1
    while at < end:
        less = source.find("<", at, end)
        m = tags.match(source, less, end) if less >= 0 else None
        if m is None and less >= 0 and tags is TAG and source[less + 1 : less + 2] in "/abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
            tags = PLAIN_TAG
            m = tags.match(source, less, end)
        stop = (m.start() if m else less + 1) if less >= 0 else end
        if stop > at:
            parts.append(source[at:stop])
            linked += (stop - at) * in_link
        at = stop
        if m is None:
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if tag is None:  # a comment, a doctype or an instruction
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                in_link = False
            elif tag == "br":
                parts.append(" ")
            elif tag == "p" and not open_.count.get("p"):
                block()
            elif tag not in INLINE and open_.count.get(tag) and tag != "body":
                block()
                open_.close(tag)
            continue
        if tag in RAW:
            last = end_of(tag)
            block()
            if tag == "xmp":
                text = " ".join(source[at : last.start() if last else len(source)].split())
                if text:
                    page.add("#text", open_.nodes[-1], 0, text)
            at = last.end() if last else len(source)
            continue
        if tag in SKIPPED and not (tag == "svg" and SELF_CLOSED.search(attributes)):
            last = end_of(tag)
            if tag not in ("svg", "annotation", "annotation-xml"):
                block()
            at = last.end() if last else at
            continue
        page.tags[open_.nodes[-1]] += 1
        if tag == "a":
            in_link = True
        if tag == "br":
            parts.append(" ")
        if tag in INLINE or tag in ("html", "body", "head", "svg"):
            if tag == "body":
                page.kinds[0] |= _kinds(tag, attributes)
            continue
        block()
        if tag in VOID:
            continue
        if tag in ENDS_P and open_.count.get("p"):
            open_.close("p")
        if tag in ITEMS:
            open_.item(tag)
        node = page.add(tag, open_.nodes[-1], _kinds(tag, attributes))
        open_.push(node, tag)
    if at < len(source):
        parts.append(source[at:])
    block()
    return page


def node_features(page: Page) -> np.ndarray:
    """A row of ``FEATURES`` for each node."""
    n = len(page.tag)
    parent = page.parent
    chars, links, tags, blocks, stops, paragraphs, capitals = ([0.0] * n for _ in range(7))
    depth, above, index, children = [0] * n, [0] * n, [0] * n, [0] * n
    place, so_far = [0.0] * n, 0.0
    for i in range(n):
        p = parent[i]
        if p >= 0:
            depth[i], above[i] = depth[p] + 1, above[p] | page.kinds[p]
            index[i] = children[p]
            children[p] += 1
        place[i] = so_far
        text = page.text[i]
        if text is not None:
            so_far += len(text)
            chars[i], links[i], blocks[i] = len(text), page.link[i], 1
            stops[i] = text.count(".") + text.count(",") + text.count("!") + text.count("?")
            capitals[i] = sum(map(str.isupper, text[:200])) * max(1, len(text) / 200)
        tags[i] += page.tags[i]
        paragraphs[i] += page.tag[i] == "p"
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, links, tags, blocks, stops, paragraphs, capitals):
            a[p] += a[i]
        tags[p] += page.text[i] is None
    c, t, par = np.array(chars), np.array(tags), np.array(parent)
    up = np.maximum(par, 0)
    total = max(1.0, c[0])
    density, share_links = c / (t + 1), np.array(links) / np.maximum(c, 1)
    # neighbours: the sibling before and after
    last: dict[int, int] = {}
    before, after = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        if (b := last.get(parent[i])) is not None:
            before[i], after[b] = chars[b], chars[i]
        last[parent[i]] = i
    out = np.zeros((n, len(FEATURES)), np.float32)
    out[np.arange(n)[(own := np.array([TAG_OF.get(x, -1) for x in page.tag])) >= 0], own[own >= 0]] = 1
    bits = 1 << np.arange(N_KINDS)
    out[:, N_TAGS : N_TAGS + N_KINDS] = (np.array(page.kinds)[:, None] & bits) > 0
    out[:, N_TAGS + N_KINDS : N_TAGS + 2 * N_KINDS] = (np.array(above)[:, None] & bits) > 0
    stats = (np.log1p(c), np.log1p(t), np.log1p(density), share_links, np.array(stops) * 100 / np.maximum(c, 1), np.log1p(paragraphs), c / total, np.log1p(c / np.maximum(blocks, 1)), depth, np.minimum(index, 50), np.minimum(np.array(children)[up], 50), c / np.maximum(c[up], 1), np.log1p(before), np.log1p(after), np.array(place) / total, np.log1p(density[up]), share_links[up], np.array(capitals) / np.maximum(c, 1))
    out[:, N_TAGS + 2 * N_KINDS :] = np.stack(stats, 1)
    return out


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, of fixed depth, split at quantiles."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, least: float = 4.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], 1)
        n, width, inner = x.shape[1], self.bins + 1, (1 << self.depth) - 1
        self.start = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        score = np.full(len(y), self.start)
        self.feature, self.cut, self.value = [], [], []
        flat = binned + np.arange(n) * width
        for _ in range(self.trees):
            p = 0.5 * (1 + np.tanh(score / 2))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                where = (flat + (node - first)[:, None] * (n * width)).ravel()
                hist = lambda v: np.bincount(where, np.repeat(v, n), count * n * width).reshape(count, n, width).cumsum(2)  # noqa: B023, E731
                gl, hl = hist(g), hist(h)
                gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gl[:, :, -1:] ** 2 / (hl[:, :, -1:] + 1)
                gain[(hl < self.least) | (hr < self.least)] = 0
                best = gain.reshape(count, -1).argmax(1)
                for k in range(count):
                    f, b = divmod(int(best[k]), width)
                    if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                        feature[first + k], cut[first + k] = f, cuts[f][b]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
            score += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows, inner = np.full(len(x), self.start), np.arange(len(x)), (1 << self.depth) - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """The text blocks of the best choice in which every kept node's ancestors are kept."""
    n = len(page.tag)
    best = [float(o) * (np.log1p(len(t)) if t is not None else 1.0) for o, t in zip(odds, page.text)]
    best[0] = 0.0
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    kept = [True] + [False] * (n - 1)
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] > 0
    return [i for i in range(n) if kept[i] and page.text[i] is not None]


@lru_cache(maxsize=1)
def model() -> Boosted:
    """Fitted to made-up pages, whose number is fixed."""
    from .html_pages import pages

    xs, ys, ws = [], [], []
    for source, main in pages():
        page = parse(source)
        x = node_features(page)
        inside = [t is not None and any(m in t for m in main) for t in page.text]
        total, good = np.zeros(len(x)), np.zeros(len(x))
        for i in range(len(x) - 1, -1, -1):
            if page.text[i] is not None:
                total[i], good[i] = len(page.text[i]), len(page.text[i]) * inside[i]
            if i:
                total[page.parent[i]] += total[i]
                good[page.parent[i]] += good[i]
        some = total > 0
        xs.append(x[some])
        # an element that holds any main text must be kept for its sake
        ys.append((good[some] > 0).astype(float))
        ws.append(np.where([page.text[i] is not None for i in np.flatnonzero(some)], 2.0, 1.0))
    return Boosted().fit(np.vstack(xs), np.concatenate(ys), np.concatenate(ws))


def extract(sources: list[str], fitted: Boosted) -> list[str]:
    """The main text of each page."""
    pages_ = [parse(s) for s in sources]
    x = [node_features(p) for p in pages_]
    odds = fitted.odds(np.vstack(x)) if x else np.empty(0)
    out, at = [], 0
    for p, rows in zip(pages_, x):
        out.append("\n".join(p.text[i] for i in decode(p, odds[at : at + len(rows)])))
        at += len(rows)
    return out


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    shared = df.sparkSession.sparkContext.broadcast(model())  # a few hundred KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 128):
                part = batch.slice(k, 128)
                texts = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), utf8(F.col(html_col)).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return main_text(table(spark, sf_dir, "pages"))
