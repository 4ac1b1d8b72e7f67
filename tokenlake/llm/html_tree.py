"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page becomes a tree of block-level nodes; inline markup belongs to the block
around it. Every node has a hidden label, content or not. Its own evidence
(tag, words in class, id and role, words, links and punctuation below it)
gives a node potential; a node and its parent share a 2 x 2 potential that
depends on the child's kind. Sum-product messages go from the leaves to the
root and back, which gives each node's exact marginal; text whose node is
content with probability of at least one half is kept. Weights are trained
by gradient ascent on the likelihood of labelled pages (train()).

Trees are parsed and scored page by page inside a pandas UDF. There is no
shuffle; memory is bounded by the longest page of a batch.

Edge cases: null or empty html gives an empty text; broken markup is read
leniently (unclosed and stray tags, cut off ends); text outside any tag
belongs to the root; white space is what Python's str.split() takes for it.
"""

from __future__ import annotations

import html as _html
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
# names and values in order, so that a name inside a value is none
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?|[\"'=]")
_HINTED = frozenset("class id role itemprop".split())
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

# How HTML names its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select audio video head option datalist noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img nobr math semantics mi mn mo ms mrow msup msub msubsup mfrac msqrt mroot mtext mstyle object canvas".split()
)
#: Dropped with what they hold, wherever they stand: a block goes on behind them.
NEUTRAL = frozenset("script style noscript template iframe svg audio video".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
TAG_KIND = {t: k for k, ts in enumerate((
    ("article",), ("main",), ("section",), ("div",), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"),
    ("table", "tbody", "thead", "tr"), ("td", "th"), ("nav",), ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset", "button", "dialog", "legend"),
    ("figure", "figcaption"), ("blockquote", "pre", "q"), ("body", "html", "#root"),
)) for t in ts}
N_KINDS = 20

# Words in class, id and role that tell what a part of a page is for.
HINTS = (
    ("article", "content", "contents", "post", "entry", "story", "main", "maintext", "articlebody", "blogpost", "text", "prose", "body", "news"),
    ("nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "paging", "toc", "tabs", "navi", "skip", "sitemap"),
    ("header", "masthead", "logo", "topbar", "toolbar", "branding", "site", "top", "head", "hero", "contentinfo", "banner"),
    ("footer", "foot", "copyright", "legal", "colophon", "bottom", "imprint", "disclaimer", "credits"),
    ("sidebar", "side", "aside", "widget", "related", "recommended", "recommendations", "trending", "popular", "complementary", "more", "teaser", "teasers", "rail", "promoted", "outbrain", "taboola", "also", "latest", "readmore", "archive", "tags", "tagcloud"),
    ("ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "affiliate", "adbox", "dfp", "commercial", "adslot", "adunit"),
    ("cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "paywall", "signup", "warning", "cmp", "privacy", "message", "announcement", "toast"),
    ("comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "commenter", "feedback", "reactions", "reviews"),
    ("share", "sharing", "social", "tweet", "follow", "facebook", "twitter", "sharebar", "like", "buttons", "actions"),
    ("form", "search", "login", "signin", "register", "searchbox", "contact", "poll", "survey", "captcha", "input", "field"),
)
HINT_OF = {w: k for k, ws in enumerate(HINTS) for w in ws}
BOILER = re.compile(r"©|\(c\) \d{4}|all rights reserved|cookie|privacy policy|terms of|sign up|subscribe|newsletter|log ?in\b|advertisement|sponsored|share (?:this|on)|read more|related|tous droits|alle rechte|derechos", re.I)

#: Weights by feature: kinds, hints of the node, link share, words, other signs.
LINK0, WORDS0, OTHER0 = N_KINDS + len(HINTS), N_KINDS + len(HINTS) + 4, N_KINDS + len(HINTS) + 10
N_FEATURES = OTHER0 + 5
#: Child kinds for the pair potentials.
PLAIN, SECTION, MARKED, LIST, FURNITURE = range(5)


class Page:
    """The tree of a page: parents before children, and text blocks in page order."""

    __slots__ = ("parent", "tag", "hints", "hidden", "blocks", "words", "linked", "stops", "boiler", "gold", "labelled")

    def __init__(self, source: str, labelled: bool = False):
        """labelled: elements may carry training marks, gold="1" or gold="0"; on other pages these mean nothing."""
        self.labelled = labelled
        self.parent, self.tag, self.hints, self.hidden = [-1], ["#root"], [()], [False]
        self.words, self.linked, self.stops, self.boiler, self.gold = [0], [0], [0], [0], [None]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, links = [0], 0, 0  # open nodes; position; depth of open links
        run: list[str] = []  # text of the block being read
        linked = 0

        def close_block() -> None:
            nonlocal linked
            if run:
                text = " ".join(_html.unescape("".join(run)).split())
                if text:
                    node, n = stack[-1], text.count(" ") + 1
                    if self.tag[node] in ("#root", "html", "body"):  # text of no element of its own is a paragraph
                        node = add(node, "p", (), False, None)
                    self.blocks.append((node, text))
                    self.words[node] += n
                    self.linked[node] += min(n, linked)
                    self.stops[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?", "。", "…"))
                    self.boiler[node] += 1 if BOILER.search(text) else 0
                run.clear()
            linked = 0

        def add(parent: int, tag: str, hints: tuple, hidden: bool, gold: bool | None) -> int:
            for x, v in ((self.parent, parent), (self.tag, tag), (self.hints, hints), (self.hidden, hidden), (self.gold, gold)):
                x.append(v)
            for x in (self.words, self.linked, self.stops, self.boiler):
                x.append(0)
            return len(self.parent) - 1

        low = None
        for m in _PIECE.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                bit = source[at : m.start()]
                run.append(bit)
                if links:
                    linked += len(bit.split())
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name, ending = name.lower(), m.group(1)
            if name in INLINE:
                if name == "a":
                    links = max(0, links - 1) if ending else 1
                continue
            if name == "br":
                close_block()
                continue
            if name in NEUTRAL and ending:
                continue
            if name in RAW and not ending:
                if name not in NEUTRAL:
                    close_block()
                if not m.group(0).endswith("/>"):
                    low = low if low is not None else source.lower()
                    if name == "head":
                        end = min((x for x in (low.find("</head", at), low.find("<body", at)) if x >= 0), default=-1)
                    else:
                        end = low.find("</" + name, at)
                    if name in ("head", "svg", "noscript") and end < 0:
                        continue
                    at = len(source) if end < 0 else end
                continue
            close_block()
            if ending:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        links = 0
                        break
                continue
            if name in RAW:
                continue
            links = 0
            if name in CLOSES_P and "p" in (self.tag[x] for x in stack[-3:]):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        del stack[k:]
                        break
            if name in CLOSED_BY_SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name or (name in ("dt", "dd") and self.tag[stack[k]] in ("dt", "dd")) or (name in ("td", "th") and self.tag[stack[k]] in ("td", "th")):
                        del stack[k:]
                        break
                    if self.tag[stack[k]] in CLOSED_BY_SAME[name]:
                        break
            if name in VOID:
                continue
            hints: list[int] = []
            hidden, gold = False, None
            attrs = m.group(3)
            if attrs:
                for a in _ATTR.finditer(attrs):
                    if a.group(1) is None:
                        continue
                    key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                    if key in _HINTED:
                        hints.extend(HINT_OF[t] for t in (x.lower() for x in _TOKEN.findall(value)) if t in HINT_OF)
                    elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
                        hidden = True
                    elif key == "gold" and self.labelled:
                        gold = value == "1"
            node = add(stack[-1], name, tuple(set(hints)), hidden, gold)
            if not m.group(0).endswith("/>") or name in CLOSES_P:
                stack.append(node)
        if at < len(source):
            run.append(source[at:])
        close_block()

    def features(self) -> tuple[list[list[int]], list[int]]:
        """Active features of each node, and each node's child kind."""
        n = len(self.parent)
        words, linked, stops, boiler = self.words[:], self.linked[:], self.stops[:], self.boiler[:]
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            words[p] += words[v]
            linked[p] += linked[v]
            stops[p] += stops[v]
            boiler[p] += boiler[v]
        active, kinds = [], []
        for v in range(n):
            tag = self.tag[v]
            kind = TAG_KIND.get(tag, N_KINDS - 1)
            f = [kind]
            f.extend(N_KINDS + h for h in self.hints[v])
            w = words[v]
            share = linked[v] / w if w else 0.0
            f.append(LINK0 + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3))
            f.append(WORDS0 + (0 if w == 0 else 1 if w < 4 else 2 if w < 12 else 3 if w < 40 else 4 if w < 200 else 5))
            if stops[v] * 12 >= w > 0:
                f.append(OTHER0)
            if boiler[v] and w < 60:
                f.append(OTHER0 + 1)
            if self.hidden[v]:
                f.append(OTHER0 + 2)
            if v and self.parent[v] == 0:
                f.append(OTHER0 + 3)
            f.append(OTHER0 + 4)
            active.append(f)
            bad = any(h for h in self.hints[v]) or self.hidden[v]
            kinds.append(FURNITURE if 11 <= kind <= 15 else MARKED if bad else SECTION if kind in (0, 1, 2, 3) or self.hints[v] else LIST if kind in (7, 8, 9, 10) else PLAIN)
        return active, kinds


def marginals(parent: list[int], unary: list[float], pairs: list) -> tuple[list[float], list]:
    """Sum-product on a tree, parents before children.

    unary[v]: log-odds of content; pairs[v]: potentials [parent label][own label].
    Gives P(content) of each node and the joint [parent][own] of each node and its parent.
    """
    n = len(parent)
    up = unary[:]  # log-odds of own evidence times messages from children
    e = pairs
    m0, m1 = [0.0] * n, [0.0] * n  # message to the parent, as probabilities
    ratio, exp, log = [0.0] * n, math.exp, math.log
    for v in range(n - 1, -1, -1):
        d = up[v]
        b1 = 1 / (1 + exp(-d)) if d > -700 else 0.0
        b0 = 1 - b1
        ratio[v] = b1
        if v:
            (a, b), (c, g) = e[v]
            x0, x1 = a * b0 + b * b1, c * b0 + g * b1
            m0[v], m1[v] = x0, x1
            up[parent[v]] += log((x1 + 1e-300) / (x0 + 1e-300))
    out, joint = [ratio[0]] * n, [((0.0, 0.0), (0.0, 0.0))] * n
    for v in range(1, n):
        q1 = out[parent[v]]
        # the parent's belief without this child
        o1, o0 = q1 / (m1[v] + 1e-300), (1 - q1) / (m0[v] + 1e-300)
        (a, b), (c, g) = e[v]
        b1 = ratio[v]
        b0 = 1 - b1
        j00, j01, j10, j11 = o0 * a * b0, o0 * b * b1, o1 * c * b0, o1 * g * b1
        z = j00 + j01 + j10 + j11 or 1.0
        joint[v] = ((j00 / z, j01 / z), (j10 / z, j11 / z))
        out[v] = (j01 + j11) / z
    return out, joint


class Model:
    """Weights and potentials; ``rest`` judges pages on which this model finds no element with content in it; it is trained on pages without an element around the article."""

    def __init__(self, weight: np.ndarray, pairs: np.ndarray, rest: Model | None = None):
        self.weight, self.pairs, self.rest = weight.tolist(), np.exp(pairs).tolist(), rest

    def content(self, page: Page) -> list[float]:
        active, kinds = page.features()
        w = self.weight
        return marginals(page.parent, [sum([w[f] for f in fs]) for fs in active], [self.pairs[k] for k in kinds])[0]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        if not page.blocks:
            return ""
        p = self.content(page)
        # an article's element is content with what is in it; without any, the page is of the other sort
        whole = any(x >= 0.5 and p[page.parent[v]] >= 0.5 for v, x in enumerate(p) if v)
        if self.rest and not whole:
            p = self.rest.content(page)
        return "\n".join(t for v, t in page.blocks if p[v] >= 0.5)


def train(pages: list[str], rounds: int = 50, rate: float = 0.5, decay: float = 0.002, bare: list[str] | None = None) -> Model:
    """Gradient ascent on the likelihood of labelled pages.

    Labelled pages mark elements with gold="1" (content) or gold="0"; other
    elements take their parent's mark, and the root is not content. bare: labelled pages for ``rest``.
    """
    data = []
    for source in pages:
        page = Page(source, labelled=True)
        gold: list[int] = []
        for v, g in enumerate(page.gold):
            gold.append(int(g) if g is not None else gold[page.parent[v]] if v else 0)
        active, kinds = page.features()
        x = np.zeros((len(active), N_FEATURES))
        for v, fs in enumerate(active):
            x[v, fs] = 1
        data.append((page.parent, x, np.array(kinds), np.array(gold)))
    weight, pairs = np.zeros(N_FEATURES), np.zeros((5, 2, 2))
    g2w, g2p = np.full(N_FEATURES, 1e-2), np.full((5, 2, 2), 1e-2)
    nodes = sum(len(d[0]) for d in data)
    for _ in range(rounds):
        potentials = np.exp(pairs)
        gw, gp = -decay * nodes * weight / len(data), -decay * nodes * pairs / len(data)
        for parent, x, kinds, gold in data:
            p, joint = (np.array(z) for z in marginals(parent, (x @ weight).tolist(), potentials[kinds].tolist()))
            gw += x.T @ (gold - p)
            want = np.zeros_like(joint)
            v = np.arange(1, len(parent))
            want[v, gold[np.array(parent)[1:]], gold[1:]] = 1
            np.add.at(gp, kinds[1:], (want - joint)[1:])
        g2w += gw**2
        g2p += gp**2
        weight += rate * gw / np.sqrt(g2w)
        pairs += rate * gp / np.sqrt(g2p)
    return Model(weight, pairs, train(bare, rounds, rate, decay) if bare else None)


def extract(html: Column, model: Model) -> Column:
    """The main text of each page, as a column."""

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([model.text(p) for p in pages], dtype=object)

    return F.pandas_udf(run, "string")(html)
