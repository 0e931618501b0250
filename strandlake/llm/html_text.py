"""Main text of web pages by boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements. Each node has features of its subtree (text, links, tags, punctuation, share of the
page), of its attribute tokens, its depth and its siblings. Gradient-boosted trees give the log-odds that a node is article; one
dynamic programme per page then chooses the best set of nodes in which nothing is kept under a dropped ancestor.

The trees are trained on TRAIN_PAGES generated pages: varied layouts of article and boilerplate, filled with words of a bounded
sample of the input's own pages. Features of a batch of pages are flat numpy arrays, summed up the trees one depth at a time.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages generated to train on; pages sampled for their words, words taken of them; pages handled at a time.
TRAIN_PAGES, WORD_PAGES, WORDS, PAGES_AT_ONCE = 600, 64, 20_000, 256
TREES, DEPTH, BINS, RATE = 120, 3, 32, 0.3
#: Share of a parent's positive log-odds that its children inherit.
INHERIT = 0.9

#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas select textarea title head button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
GROUPS = [
    "article main".split(), "p".split(), "h1 h2 h3 h4 h5 h6".split(), "ul ol dl".split(), "li dt dd".split(), "nav menu".split(), "header".split(), "footer".split(),
    "aside".split(), "form fieldset".split(), "section".split(), "div".split(), "table tbody thead tr td th".split(), "blockquote pre figure figcaption".split(), "body html".split(), "dialog details".split(),
]
#: Tokens of class, id and role that speak for article, and those that speak for boilerplate, by kind.
TOKENS = [
    "article content post entry story main text body prose page-content articlebody".split(),
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toolbar topnav".split(),
    "ad ads advert adverts advertisement sponsor sponsored promo banner promotion".split(),
    "sidebar aside widget related recommended trending rail side".split(),
    "comment comments reply replies disqus discussion responses reader".split(),
    "footer header masthead copyright legal colophon top bottom".split(),
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login banner".split(),
    "share social follow form search tags meta byline author".split(),
]
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
_TOKEN = {word: i for i, words in reversed(list(enumerate(TOKENS))) for word in words}
#: Quotes count only after "=", as in browsers; what looks like a tag and never ends goes to the end of the page.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</(?![A-Za-z])[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-hidden|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
FEATURES = len(GROUPS) * 2 + len(TOKENS) * 2 + 15


class Page:
    """The block tree of one page: flat lists by node, and text pieces in page order."""

    __slots__ = ("parent", "depth", "group", "tokens", "own", "links", "inline", "punct", "pieces", "place")

    def __init__(self, source: str):
        self.parent, self.depth, self.group, self.tokens = [-1], [0], [14], [0]
        self.own, self.links, self.inline, self.punct = [0], [0], [0], [0]
        self.pieces: list[list] = []  # of [node, text]; a new one at each block boundary
        stack = [("html", 0)]  # open elements: tag, node
        node, anchor, fresh, at, size = 0, 0, True, 0, len(source)
        while at < size:
            m = _TAG.search(source, at)
            end = m.start() if m else size
            if end > at:
                text = source[at:end]
                if not text.isspace():
                    text = html.unescape(text) if "&" in text else text
                    if fresh:
                        self.pieces.append([node, text])
                        fresh = False
                    else:
                        self.pieces[-1][1] += text
                    n = len(text)
                    self.own[node] += n
                    self.punct[node] += text.count(".") + text.count(",")
                    if anchor:
                        self.links[node] += n
                elif not fresh:
                    self.pieces[-1][1] += " "
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag, closing = tag.lower(), m[1]
            if tag in RAW:
                if not closing and not m[0].endswith("/>"):
                    stop = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(source, at) if tag != "head" else re.compile(r"</head\b[^>]*>|<body\b", re.IGNORECASE).search(source, at)
                    if stop is None and tag == "head":
                        continue
                    at = size if stop is None else stop.start() if stop[0].lower().startswith("<body") else stop.end()
                continue
            if tag in INLINE:
                self.inline[node] += 1
                if tag == "a":
                    anchor = 0 if closing else 1
                continue
            if tag == "br" or tag == "wbr":
                if not fresh and tag == "br":
                    self.pieces[-1][1] += " "
                continue
            fresh = True
            if tag in VOID:
                continue
            anchor = 0
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        node = stack[-1][1]
                        break
                continue
            if tag == "html":
                continue
            shut = ("p",) if tag not in ("li", "dt", "dd", "tr", "td", "th") else ("p", "li", "dt", "dd") if tag in ("li", "dt", "dd") else ("p", "td", "th") if tag != "tr" else ("p", "td", "th", "tr")
            while len(stack) > 1 and stack[-1][0] in shut:
                stack.pop()
            node = len(self.parent)
            self.parent.append(stack[-1][1])
            self.depth.append(self.depth[stack[-1][1]] + 1)
            self.group.append(_GROUP.get(tag, 11))
            bits = 0
            if m[3] and not m[3].isspace():
                for a in _ATTRIBUTE.finditer(m[3]):
                    name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if name in ("hidden", "aria-hidden", "style"):
                        if name == "hidden" or value == "true" or "none" in value:
                            bits |= 1 << 2
                    else:
                        for word in _SPLIT.split(value):
                            k = _TOKEN.get(word)
                            if k is not None:
                                bits |= 1 << k
            self.tokens.append(bits)
            self.own.append(0), self.links.append(0), self.inline.append(0), self.punct.append(0)
            stack.append((tag, node))


class Forest:
    """The trees of a batch of pages as one: node numbers run on from page to page."""

    def __init__(self, pages: list[Page]):
        counts = np.array([len(p.parent) for p in pages])
        base = np.concatenate([[0], np.cumsum(counts)])
        flat = lambda name: np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages])
        self.base, self.page = base, np.repeat(np.arange(len(pages)), counts)
        parent = flat("parent")
        self.parent = np.where(parent >= 0, parent + base[self.page], -1)
        self.depth, self.group, self.tokens = flat("depth"), flat("group"), flat("tokens")
        self.own = flat("own").astype(float)
        self.sums = np.stack([flat("own"), flat("links"), flat("inline"), flat("punct"), np.ones(len(parent), np.int64)], 1).astype(float)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max() + 2)) if len(order) else []
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]  # nodes of depth 1, 2, ...

    def up(self, values: np.ndarray) -> np.ndarray:
        out = values.copy()
        for nodes in reversed(self.levels):
            np.add.at(out, self.parent[nodes], out[nodes])
        return out

    def features(self) -> np.ndarray:
        total = self.up(self.sums)
        text, links, inline, punct, nodes = total.T
        whole = total[self.base[self.page], 0]
        parent = np.maximum(self.parent, 0)
        children = np.bincount(parent[self.parent >= 0], minlength=len(parent)).astype(float)
        # Paragraph text in the subtree; place among the siblings.
        prose = self.up(np.where((self.group == 1)[:, None], self.sums[:, :1], 0.0))[:, 0]
        by = np.lexsort((np.arange(len(parent)), self.parent))
        first = np.flatnonzero(np.append(True, self.parent[by][1:] != self.parent[by][:-1])) if len(by) else np.zeros(0, np.int64)
        place = np.empty(len(parent))
        place[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        bits = ((self.tokens[:, None] >> np.arange(len(TOKENS))) & 1).astype(float)
        above = np.zeros((len(parent), len(TOKENS) + len(GROUPS)))
        kinds = np.eye(len(GROUPS))[self.group]
        for level in self.levels:
            p = self.parent[level]
            above[level, : len(TOKENS)] = np.maximum(above[p, : len(TOKENS)], bits[p])
            above[level, len(TOKENS) :] = np.maximum(above[p, len(TOKENS) :], kinds[p])
        siblings = np.maximum(1, children[parent])
        numbers = [
            self.depth, np.log1p(text), np.log1p(self.own), links / np.maximum(1, text), inline / np.maximum(1, text) * 100, punct / np.maximum(1, text) * 100, np.log1p(nodes), text / np.maximum(1, nodes),
            text / np.maximum(1, whole), prose / np.maximum(1, text), children, siblings, place / siblings, text / np.maximum(1, total[parent, 0]), links[parent] / np.maximum(1, total[parent, 0]),
        ]
        return np.concatenate([kinds, bits, above, np.stack(numbers, 1)], 1).astype(np.float32)

    def decoded(self, odds: np.ndarray) -> np.ndarray:
        """Whether each node is kept: the choice of most summed log-odds in which no kept node has a dropped ancestor.

        A node inherits part of its parent's positive log-odds (not the page's), so a doubtful block of a clear article stays.
        """
        odds = np.clip(odds, -6, 6)
        for nodes in self.levels[1:]:
            p = self.parent[nodes]
            odds[nodes] += INHERIT * np.clip(odds[p], 0, 6) * (self.group[p] != 14)
        weight = np.log1p(self.own) + 0.2
        gain = odds * weight
        keep, drop = gain.copy(), self.up(-gain)
        for nodes in reversed(self.levels):
            np.add.at(keep, self.parent[nodes], np.maximum(keep[nodes], drop[nodes]))
        kept = np.zeros(len(odds), bool)
        kept[self.parent < 0] = True
        for nodes in self.levels:
            kept[nodes] = kept[self.parent[nodes]] & (keep[nodes] >= drop[nodes])
        return kept


@dataclass
class Boosted:
    """Trees of depth DEPTH as arrays by node: feature, cut (goes right if above), leaf values."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
    """Gradient boosting of log-loss with Newton leaves over binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = np.average(y, weights=w)
    bias = float(np.log(share / (1 - share)))
    score = np.full(len(y), bias)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, places, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p) + 1e-9
        at = np.zeros(len(y), np.int64)
        feature, place = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 1e-6
            for f in range(x.shape[1]) if len(own) > 1 else ():
                if not len(cuts[f]):
                    continue
                b = binned[own, f]
                gs, hs = (np.cumsum(np.bincount(b, v[own], len(cuts[f]) + 1)) for v in (g, h))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, feature[node], place[node] = gain[k], f, cuts[f][k]
            at[own] = 2 * node + 1 + (x[own, feature[node]] > place[node])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        score += value[leaf]
        features.append(feature), places.append(place), values.append(value)
    return Boosted(bias, np.stack(features), np.stack(places), np.stack(values))


def _generated(words: list[str], seed: int) -> str:
    """A page of random layout, with \\x01 before and \\x02 after each article text, and nothing like it elsewhere."""
    r = np.random.default_rng(seed)
    pick = lambda options: options[int(r.integers(len(options)))]
    some = lambda a, b: " ".join(words[int(i)] for i in r.integers(0, len(words), int(r.integers(a, b))))
    article = lambda text: f"\x01{text}\x02"
    link = lambda n: f'<a href="/{some(1, 2)}">{some(1, n)}</a>'
    listed = lambda n: "<ul>" + "".join(f"<li>{link(4)}</li>" for _ in range(int(r.integers(1, n)))) + "</ul>"

    def box(tag, tokens, inside):
        named = f' {pick(["class", "id"])}="{pick(tokens)}"' if tokens and r.random() < 0.9 else ""
        return f"<{tag}{named}>{inside}</{tag}>"

    def boilerplate():
        kind = int(r.integers(10))
        prose = lambda: pick([some(2, 14), f"<p>{some(2, 40)}.</p>", f"{some(2, 20)}, {some(2, 9)}."])
        if kind == 0:
            return box(pick(["nav", "div", "ul"]), TOKENS[1], listed(9))
        if kind == 1:
            return box(pick(["div", "aside", "section"]), TOKENS[2], prose())
        if kind == 2:
            return box(pick(["aside", "div"]), TOKENS[3], f"<h3>{some(1, 4)}</h3>" + pick([listed(8), prose(), f"<p>{some(4, 30)}.</p><p>{some(4, 30)}.</p>"]))
        if kind == 3:
            return box(pick(["div", "section"]), TOKENS[4], "".join(box(pick(["div", "p", "li", "article"]), TOKENS[4], prose()) for _ in range(int(r.integers(1, 6)))))
        if kind == 4:
            return box(pick(["footer", "div"]), TOKENS[5], pick([f"&copy; {some(2, 12)}", f"<p>&copy; {some(2, 20)}.</p>", listed(5)]))
        if kind == 5:
            return box(pick(["header", "div"]), TOKENS[5], pick([f"<h1>{some(1, 5)}</h1>", f"<p>{some(2, 10)}</p>", listed(5)]))
        if kind == 6:
            return box("div", TOKENS[6], prose() + pick(["", "<button>OK</button>"]))
        if kind == 7:
            return f"<form><label>{some(1, 4)}</label><input><p>{some(1, 12)}</p></form>"
        if kind == 8:
            return box("div", TOKENS[7], pick([listed(6), link(5) + link(5), some(1, 6)]))
        return pick([f"<footer>{prose()}</footer>", f"<nav>{listed(8)}</nav>", f"<aside>{prose()}</aside>", f"<header>{prose()}</header>"])

    def block():
        kind = r.random()
        if kind < 0.75:
            words_in = some(1, int(pick([3, 12, 60, 150])))
            return f"<p>{article(pick(['', '<b>', '<i>']) + words_in + pick(['.', '', '.<br>']))}</p>" if r.random() < 0.85 else f"<p><b>{article(words_in + '.')}<br>"
        if kind < 0.85:
            return f"<{(t := pick(['h2', 'h3', 'h4']))}>{article(some(1, 8))}</{t}>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{article(some(2, 20))}</li>" for _ in range(int(r.integers(1, 5)))) + "</ul>"
        return pick([f"<blockquote>{article(some(5, 40))}.</blockquote>", f"<div>{article(some(3, 60))}.</div>", f"<table><tr><td>{article(some(1, 6))}</td><td>{article(some(1, 6))}</td></tr></table>"])

    tiny = r.random() < 0.15  # little more than a sentence, often alone on its page
    blocks = [f"<h1>{article(some(1, 12))}</h1>"] * (r.random() < (0.3 if tiny else 0.8))
    for _ in range(1 if tiny else int(r.integers(1, int(pick([3, 8, 30]))))):
        blocks.append(f"<p>{article(some(1, 8))}.</p>" if tiny else block())
        if r.random() < 0.06:
            blocks.append(boilerplate())
    body = box(pick(["article", "article", "main", "div", "section"]), TOKENS[0], "".join(blocks))
    if r.random() < 0.4:
        body = box(pick(["main", "div"]), TOKENS[0], pick(["", boilerplate()]) + body + pick(["", boilerplate()]))
    before, after = ("".join(boilerplate() for _ in range(int(r.integers(0, 2 if tiny else 5)))) for _ in range(2))
    return f"<!DOCTYPE html><html><head><title>{some(1, 9)}</title></head><body>{before}{body}{after}" + pick(["", "</body></html>"])


def train(words: list[str], pages: int = TRAIN_PAGES) -> Boosted:
    words = [w for w in (re.sub(r"[<>&\x01\x02]", "", w) for w in words) if w] or ["text"]
    built = [Page(_generated(words, seed)) for seed in range(pages)]
    forest = Forest(built)
    marked = np.zeros(len(forest.parent))
    for p, b in zip(built, forest.base, strict=False):
        for node, text in p.pieces:
            if "\x01" in text:
                marked[b + node] += len(text)
    inside, text = forest.up(marked[:, None])[:, 0], forest.up(forest.sums[:, :1])[:, 0]
    target = (inside > 0.5 * text).astype(float)
    has = text > 0
    return boost(forest.features()[has], target[has], np.log1p(text[has]))


def extracted(source: list[str], model: Boosted) -> list[str]:
    """The main text of each page."""
    built = [Page(s) for s in source]
    forest = Forest(built)
    kept = forest.decoded(model.odds(forest.features()))
    out = []
    for p, b in zip(built, forest.base, strict=False):
        blocks = (" ".join(text.split()) for node, text in p.pieces if kept[b + node])
        out.append("\n\n".join(t for t in blocks if t))
    return out


def fit(pages: DataFrame) -> Boosted:
    """Trees trained on generated pages with at most WORDS distinct words of at most WORD_PAGES whole pages, both chosen by a hash."""
    sample = pages.where("html is not null").orderBy(F.xxhash64(F.lit(5), "page_id"), "page_id").limit(WORD_PAGES).select(F.regexp_replace("html", "<[^>]*>", " ").alias("t"))
    words = sample.select(F.explode(F.split("t", r"\s+")).alias("w")).where("w <> '' and length(w) <= 100").distinct().orderBy(F.xxhash64("w"), "w").limit(WORDS)
    return train([html.unescape(r.w) for r in words.collect()] or ["text"])


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text, n_chars (code points) for every row.

    Null and empty html and pages without article have an empty text. Broken markup is read as browsers mostly do: elements left open
    end with their parent, a new block ends an open paragraph. Whole pages are read, however long; repeated rows each get a row with the
    same text; an empty table gives an empty result. Other columns are ignored.
    """
    model = fit(pages) if model is None else model
    # Plain arrays: executors need no class of this package.
    sent = pages.sparkSession.sparkContext.broadcast((model.bias, model.feature, model.cut, model.leaf))

    def run(batches):
        trees = Boosted(*sent.value)
        for b in batches:
            texts = []
            for at in range(0, b.num_rows, PAGES_AT_ONCE):
                texts += extracted([s or "" for s in b.column("html").slice(at, PAGES_AT_ONCE).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
