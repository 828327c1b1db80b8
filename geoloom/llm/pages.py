"""Main-text extraction from web pages by a tree-structured graphical model over the DOM.

Every element and every text block of a page is a binary variable, content or not.  A node's potential is a
linear score of its features (tag, class words, amount of text, links, punctuation); an edge's is a table
over the labels of parent and child, one for elements and one for text blocks.  Sum-product messages go up
from the leaves and down from the root, for all pages of a batch at once, one level of depth at a time; a
block belongs to the text when its content marginal is above one half.

The weights maximise the likelihood of labelled pages (the same messages give the gradient).  Labelled are
pages composed here from a list of layouts, and at most ``sample`` pages of the corpus that mark their
article themselves; half of the copies have their telling tags replaced by ``div`` and their classes taken
away, so that the rest of the features has to learn as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is no text of the page.
SKIP = frozenset("script style noscript template head title svg math iframe object select option button textarea canvas audio video datalist".split())
#: What an opening tag closes, when it stands in the same enclosing block.
CLOSES = {
    **{t: frozenset(["p"]) for t in BLOCK if t not in ("html", "body")},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
}
#: Elements that the search for what to close does not leave.
FENCE = frozenset("article aside body div details dialog fieldset figure footer form header html main nav section table ul ol dl td th li blockquote".split())
MOST_DEPTH = 512

TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "table", "td", "tr", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "figure", "body", "html", "dialog", "#text")
GROUPS = {
    "content": "article content post entry story main text body prose page paragraph",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap topbar toolbar tabs skip",
    "head": "header masthead banner logo branding brand",
    "foot": "footer foot copyright contentinfo colophon legal",
    "side": "sidebar aside widget widgets complementary rail secondary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense adslot commercial",
    "comment": "comment comments reply replies respond disqus discussion commentlist reader",
    "share": "share sharing social follow twitter facebook",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe signup paywall toast",
    "form": "form search login signin register input",
    "related": "related recommended recommendation more popular trending teaser tags",
    "hidden": "hidden",
}
GROUP_OF = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
#: Tags that name the part of the page that they hold.
NAMED = [_TAG_OF[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "dialog")]
N_FEATURES = 1 + len(TAGS) + 1 + len(GROUPS) + 6 + 4 + 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Forest:
    """The nodes of any number of pages; parents stand before their children."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)  # bits
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int] = field(default_factory=list)

    def add(self, page, parent, tag, group=0, text=None, linked=0, label=0) -> int:
        depth = self.depth[parent] + 1 if parent >= 0 else 0
        words = text.count(" ") + 1 if text else 0
        stops = sum(map(text.count, ".,;:!?")) if text else 0
        for column, value in zip((self.page, self.parent, self.depth, self.tag, self.group, self.words, self.linked, self.stops, self.text, self.label), (page, parent, depth, tag, group, words, min(linked, words), stops, text, label)):
            column.append(value)
        return len(self.page) - 1


def _groups(attributes: str, masked: bool = False) -> int:
    """The class-word groups of an element, as bits; without those of its class, id and role if ``masked``."""
    bits = 0
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for word in () if masked else _PART.findall(html.unescape(value)):
                at = GROUP_OF.get(word.lower())
                if at is not None:
                    bits |= 1 << at
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            bits |= 1 << GROUP_OF["hidden"]
    return bits


class _Open:
    """The open elements ``tag, node, label``, with what is needed to find one without looking at all of them."""

    def __init__(self, lowest: list[tuple[str, int, int]]):
        self.items, self.lowest = lowest, len(lowest)
        self.count: Counter[str] = Counter()
        #: Where the fences stand, and what is open above each of them.
        self.fences, self.above = [], [Counter()]

    def push(self, tag: str, node: int, label: int) -> None:
        self.items.append((tag, node, label))
        self.count[tag] += 1
        if tag in FENCE:
            self.fences.append(len(self.items) - 1)
            self.above.append(Counter())
        else:
            self.above[-1][tag] += 1

    def cut(self, at: int) -> list[str]:
        """Close everything from place ``at`` on; the closed tags."""
        gone = []
        while len(self.items) > at:
            tag = self.items.pop()[0]
            gone.append(tag)
            self.count[tag] -= 1
            if tag in FENCE:
                self.fences.pop()
                self.above.pop()
            else:
                self.above[-1][tag] -= 1
        return gone

    def last(self, tags) -> int:
        """The place of the last open one of ``tags``: all that is above it is about to be closed."""
        at = len(self.items) - 1
        while self.items[at][0] not in tags:
            at -= 1
        return at

    def to_close(self, tag: str) -> int | None:
        """What the opening of ``tag`` closes: above the innermost fence, or that fence itself."""
        closes = CLOSES.get(tag, ())
        if any(self.above[-1][t] > 0 for t in closes):
            return self.last(closes)
        if self.fences and self.items[self.fences[-1]][0] in closes:
            return self.fences[-1]
        return None


def parse(forest: Forest, page: int, source: str, truth: dict[int, int] | None = None, masked: bool = False) -> None:
    """Add the tree of one page; unclosed and stray tags are taken as browsers take them.

    ``truth`` labels elements by where they begin in the source; all within has the label too.  ``masked``
    takes telling tags for ``div`` and reads no classes.  An element nested deeper than ``MOST_DEPTH`` hangs,
    as in browsers, from its ancestor there.  Time grows with the length of the source alone.
    """
    root = forest.add(page, -1, _TAG_OF["html"])
    # a page has a body whether it says so or not
    open_ = _Open([("html", root, 0), ("body", forest.add(page, root, _TAG_OF["body"]), 0)])
    stack = open_.items
    ahead: dict[str, re.Match | None] = {}
    text: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            forest.add(page, stack[-1][1], _TAG_OF["#text"], 0, joined, linked, stack[-1][2])
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw)
            text.append(raw)
            if links:
                linked += len(raw.split())

    def close(at: int) -> None:
        nonlocal links
        if any(stack[i][0] in BLOCK for i in range(at, len(stack))):
            flush()
        links = max(0, links - open_.cut(at).count("a"))

    def following(pattern: str, at: int) -> re.Match | None:
        """The next match of a pattern; each part of the source is searched for it once."""
        m = ahead[pattern] if pattern in ahead else re.compile(pattern, re.I).search(source, at)
        while m is not None and m.start() < at:
            m = re.compile(pattern, re.I).search(source, at)
        ahead[pattern] = m
        return m

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.count[tag] > 0:
                close(open_.last((tag,)))
            elif tag == "p":
                flush()
            continue
        if tag in SKIP:
            stop = following(rf"</{re.escape(tag)}\b[^>]*>?", at) if not m[3].endswith("/") else None
            body = following(r"<body\b", at) if tag == "head" else None
            if body and (not stop or body.start() < stop.start()):
                at = body.start()
            elif stop:
                at = stop.end()
            elif tag in ("script", "style"):
                at = end
            text.append(" ")
            continue
        found = open_.to_close(tag)
        if found is not None:
            close(found)
        if tag in BLOCK:
            flush()
            if tag in ("html", "body"):
                continue
            if tag not in VOID:
                label = (truth or {}).get(m.start(), stack[-1][2])
                parent = stack[-1][1]
                while forest.depth[parent] >= MOST_DEPTH:
                    parent = forest.parent[parent]
                seen = "div" if masked and tag in TELLING else tag
                open_.push(tag, forest.add(page, parent, _TAG_OF.get(seen, len(TAGS)), _groups(m[3], masked), label=label), label)
        elif tag in VOID:
            text.append(" ")
        elif not m[3].endswith("/"):
            links += tag == "a"
            open_.push(tag, stack[-1][1], stack[-1][2])
    flush()


def arrays(f: Forest) -> dict[str, np.ndarray]:
    """The forest as arrays, with the text counts of whole subtrees, and its nodes by depth."""
    a = {k: np.array(getattr(f, k), np.int64) for k in ("page", "parent", "depth", "tag", "group", "words", "linked", "stops", "label")}
    by = np.argsort(a["depth"], kind="stable")
    cuts = np.searchsorted(a["depth"][by], np.arange(int(a["depth"].max(initial=0)) + 2))
    a["levels"] = [by[x:y] for x, y in zip(cuts, cuts[1:])]
    a["levels"] = [level[np.argsort(a["parent"][level], kind="stable")] for level in a["levels"]]
    runs = {}
    for level in a["levels"][1:]:
        p = a["parent"][level]
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        runs[len(runs) + 1] = (p[starts], starts)
    a["runs"] = runs
    for k in ("words", "linked", "stops"):
        for level in reversed(a["levels"][1:]):
            np.add.at(a[k], a["parent"][level], a[k][level])
    return a


def features(a: dict[str, np.ndarray]) -> np.ndarray:
    n = len(a["tag"])
    x, at = np.zeros((n, N_FEATURES), np.float32), 1
    x[:, 0] = 1
    x[np.arange(n), at + a["tag"]] = 1
    at += len(TAGS) + 1
    for i in range(len(GROUPS)):
        x[:, at + i] = a["group"] >> i & 1
    at += len(GROUPS)
    rows = np.arange(n)
    words = np.maximum(a["words"], 1)
    x[rows, at + np.searchsorted([1, 5, 15, 40, 150], a["words"])] = 1
    at += 6
    x[rows, at + np.searchsorted([0.01, 0.2, 0.6], a["linked"] / words)] = 1
    at += 4
    x[rows, at + np.searchsorted([0.005, 0.05, 0.12], a["stops"] / words)] = 1
    # how much text there is tells nothing about an element that says what it is
    x[np.isin(a["tag"], NAMED) | (a["group"] > 0), at - 10 :] = 0
    return x


@dataclass
class Model:
    unary: np.ndarray  # weight of each feature for the label content
    pair: np.ndarray  # [kind of child, label of parent, label of child]


def messages(a: dict, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of content for every node, and of (parent, child) labels for every node with a parent."""
    n = len(score)
    kind = (a["tag"] == _TAG_OF["#text"]).astype(np.int64)
    table = pair[kind]  # n x parent x child
    inner = np.stack([np.zeros(n), score], 1)
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    for d in range(len(a["levels"]) - 1, 0, -1):
        level = a["levels"][d]
        both = table[level] + inner[level][:, None, :]
        up[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        parents, starts = a["runs"][d]  # siblings stand together
        inner[parents] += np.add.reduceat(up[level], starts, axis=0)
    joint = np.zeros((n, 2, 2))
    for level in a["levels"][1:]:
        p = a["parent"][level]
        without = inner[p] + down[p] - up[level]
        both = table[level] + without[:, :, None]
        down[level] = np.logaddexp(both[:, 0], both[:, 1])
        both = both + inner[level][:, None, :]
        both -= both.max((1, 2), keepdims=True)
        both = np.exp(both)
        joint[level] = both / both.sum((1, 2), keepdims=True)
    belief = inner + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def train(a: dict, rounds: int = 160, rate: float = 0.5, shrink: float = 1e-5) -> Model:
    """Weights by gradient ascent on the likelihood of the labels in ``a``."""
    x, y = features(a), a["label"].astype(np.float64)
    has = a["parent"] >= 0
    kind = (a["tag"] == _TAG_OF["#text"]).astype(np.int64)[has]
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind, a["label"][a["parent"][has]], a["label"][has]), 1)
    weights = np.zeros(N_FEATURES + 8)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        marginal, joint = messages(a, (x @ weights[:N_FEATURES].astype(np.float32)).astype(np.float64), weights[N_FEATURES:].reshape(2, 2, 2))
        expected = np.stack([joint[has][kind == k].sum(0) for k in (0, 1)])
        g = np.concatenate([x.T @ (y - marginal).astype(np.float32), (seen - expected).ravel()]) / len(y) - shrink * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(weights[:N_FEATURES], weights[N_FEATURES:].reshape(2, 2, 2))


#: Layouts of composed pages: what stands around an article, as (tag, class, inside); 1 marks content.
AROUND = (
    ("nav", "menu", "links"), ("div", "navbar", "links"), ("ul", "breadcrumb", "items"), ("header", "site-header", "title"), ("div", "masthead", "title"),
    ("aside", "sidebar", "links"), ("div", "sidebar widget", "prose"), ("aside", "", "prose"), ("div", "ad", "line"), ("div", "advert", "line"), ("section", "sponsored promo", "prose"),
    ("div", "cookie-notice", "line"), ("div", "newsletter subscribe", "line"), ("div", "alert notice", "line"), ("dialog", "modal", "line"),
    ("form", "search-form", "line"), ("form", "", "line"), ("section", "comments", "prose"), ("div", "comment-list", "prose"), ("ol", "comments", "items"), ("div", "related", "links"), ("div", "share social", "links"),
    ("footer", "", "line"), ("footer", "site-footer", "links"), ("div", "footer copyright", "line"), ("div", "hidden", "line"),
)
INSIDE = (("article", ""), ("main", ""), ("div", "content"), ("div", "post entry"), ("section", "article-body"), ("div", ""), ("td", ""))


def composed(n: int, seed: int = 7) -> list[tuple[str, dict[int, int]]]:
    """``n`` pages and their labels by place: an article in one of the usual containers, among what usually surrounds it."""
    r = np.random.default_rng(seed)
    parts = "an be co de el fi gra ho in jo ka lu mo ne or pi qua re sti to un ve wi ya zo".split()

    def words(k):
        return " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(max(1, k)))

    def prose(k):
        return " ".join(words(int(r.integers(3, 15))).capitalize() + "." for _ in range(k))

    def inside(kind):
        if kind in ("links", "items"):
            return top() + "<ul>" + "".join(f"<li><a href='/x'>{words(int(r.integers(1, 4)))}</a></li>" if kind == "links" else f"<li>{prose(int(r.integers(1, 3)))}</li>" for _ in range(r.integers(1, 9))) + "</ul>"
        if kind == "title":
            return f"<h1>{words(2)}</h1>"
        return top() + (prose(1) if kind == "line" else "".join(f"<p>{prose(int(r.integers(1, 4)))}</p>" for _ in range(r.integers(1, 4))))

    def top():
        return "<{0}>{1}</{0}>".format(("h2", "h3")[int(r.integers(2))], words(int(r.integers(1, 4)))) if r.random() < 0.3 else ""

    out = []
    for _ in range(n):
        around = [AROUND[i] for i in r.permutation(len(AROUND))[: r.integers(3, 9)]]
        split = int(r.integers(0, len(around)))
        tag, css = INSIDE[int(r.integers(len(INSIDE)))]
        body = "".join(
            ("<{0}>{1}</{0}>".format(("h2", "h3")[int(r.integers(2))], words(int(r.integers(1, 6)))), f"<ul><li>{words(3)}</li><li>{words(4)}</li></ul>", f"<blockquote>{prose(1)}</blockquote>", f"<p>{words(1)}.</p>")[int(r.integers(4))] if r.random() < 0.3 else f"<p>{prose(int(r.integers(1, 6)))}</p>"
            for _ in range(1 if r.random() < 0.2 else r.integers(2, 14))
        )
        head = f"<h1>{words(4)}</h1>"
        head = f"<header>{head}</header>" if r.random() < 0.2 else head
        own = "" if r.random() < 0.7 else "\0<{0} class='{1}'>{2}</{0}>".format(*(lambda x: (x[0], x[1], inside(x[2])))(AROUND[int(r.integers(7, len(AROUND)))]))
        article = f"\1<{tag} class='{css}'>{head}{body}{own}</{tag}>"
        article = f"<table><tr>{article}</tr></table>" if tag == "td" else article
        bare = [c if t not in ("nav", "header", "footer", "aside", "form", "dialog") or r.random() < 0.5 else "" for t, c, _ in around]
        pieces = [f"\0<{t} class='{c}'>{inside(k)}</{t}>" for (t, _, k), c in zip(around, bare)]
        page = "".join(pieces[:split]) + article + "".join(pieces[split:])
        page = f"<html><body><div id='page'>{page}</div></body></html>" if r.random() < 0.5 else f"<html><body>{page}</body></html>"
        marks = [(m.start(), ord(m[0])) for m in re.finditer("[\0\1]", page)]
        out.append((re.sub("[\0\1]", "", page), {at - i: label for i, (at, label) in enumerate(marks)}))
    return out


_MARKED = re.compile(r"<(article|main)\b", re.I)
#: Tags that say what they hold.
TELLING = frozenset(("article", "main", "nav", "header", "footer", "aside"))


def self_labelled(source: str) -> tuple[str, dict[int, int]] | None:
    """A page with one article element, marked as content; None for others."""
    found = list(_MARKED.finditer(source))
    return (source, {found[0].start(): 1}) if len(found) == 1 else None


def fit(pages: list[str], n_composed: int = 160) -> Model:
    """The model of composed pages and of those among ``pages`` that mark their article."""
    marked = [m for m in map(self_labelled, pages) if m]
    made = composed(n_composed)
    f = Forest()
    for i, (source, truth) in enumerate([*made, *marked, *made[::8], *marked[::4]]):
        parse(f, i, source, truth, masked=i >= len(made) + len(marked))
    a = arrays(f)
    # an element is content when content stands in it, so that no content stands below what is not
    inside = (a["tag"] == _TAG_OF["#text"]) & (a["label"] == 1)
    for level in reversed(a["levels"][1:]):
        inside[a["parent"][level[inside[level]]]] = True
    a["label"] = inside.astype(np.int64)
    return train(a)


def extracted(sources: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    f = Forest()
    for i, source in enumerate(sources):
        parse(f, i, source)
    out: list[list[str]] = [[] for _ in sources]
    if f.page:
        a = arrays(f)
        marginal, _ = messages(a, features(a).astype(np.float64) @ model.unary, model.pair)
        for i in np.flatnonzero((marginal > 0.5) & (a["tag"] == _TAG_OF["#text"])).tolist():
            out[f.page[i]].append(f.text[i])
    return ["\n\n".join(x) for x in out]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html", model: Model | None = None, sample: int = 120) -> DataFrame:
    """``key, url, text, n_chars`` for every row of ``pages``.

    Without a ``model`` one is fitted on at most ``sample`` pages, those least by hash among the pages that
    mark their article, and on composed pages.  A null or empty page has an empty text; rows that repeat,
    null keys and null urls are kept; an empty table gives no rows; other columns are not read.
    """
    base = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html_column).cast("string").alias("t"))
    if model is None:
        # long pages teach no more than short ones: those of the sample are bounded as well
        marked = base.where(F.col("t").rlike("(?i)<(article|main)\\b") & (F.octet_length("t") < 1 << 16))
        marked = marked.withColumn("h", F.xxhash64("t"))
        # the hashes first, so that no task sends more than eight bytes a page; then one page for each
        least = [r.h for r in marked.select("h").distinct().orderBy("h").limit(sample).collect()]
        chosen = marked.where(F.col("h").isin(least)).groupBy("h").agg(F.min("t").alias("t")).collect()
        model = fit([r.t for r in sorted(chosen, key=lambda r: r.h)])
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def block(rows, texts):
        out = extracted([texts.raw(i).decode() for i in range(len(texts))], model)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["k", "u", "text", "n_chars"])

    out = K.arrow_map(base, block, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long", "t")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
