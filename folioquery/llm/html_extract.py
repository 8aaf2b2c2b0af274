"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into nodes. Every node gets features of its subtree (text density, link
density, counts), of its tag and attribute tokens and those of its ancestors, of its
depth, and of its place among its siblings. Gradient-boosted symmetric trees give each
node the log odds that it belongs to the article. The decoder then picks, over the whole
tree at once, the likeliest labels under one rule: a node inside a rejected node is
rejected. So no ancestor and descendant contradict each other.

The model is trained here on labelled pages formed by rule (``training_pages``).

Defined results: a null or empty page, or one without an article, gives an empty text and
0 characters. Tags left open end with their parent or with the next block that cannot lie
inside them; a line break element counts as white space. Head, scripts, styles and other
unseen elements hold no text. Marked sections of unknown kind, and comments and tags the page
breaks off, are markup and go. A page takes time in proportion to its length, however its
tags nest. Repeated rows give equal texts; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import slices
from folioquery.sources.html import TolerantParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title svg iframe object canvas".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split()
)
#: Start tags that end an open element of the named kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Elements that such an end does not reach beyond.
FENCES = frozenset("html body article main section div ul ol dl table nav aside header footer form blockquote".split())
#: Attribute that carries the label of a training page's nodes; elsewhere it is an attribute like any other.
MARK = "data-article"
TOKEN = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?,;:](?:\s|$)")


@dataclass
class Dom:
    """Nodes of a page in page order, and its runs of text."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    #: (node, block number, text): runs of one block number form one block
    runs: list[tuple[int, int, str]] = field(default_factory=list)


class _Builder(TolerantParser):
    def __init__(self, labelled: bool) -> None:
        super().__init__()
        self.dom = Dom()
        self.labelled = labelled
        self.stack: list[int] = []
        #: places of each open tag in the stack, and of the open fences
        self.places: dict[str, list[int]] = {}
        self.fences: list[int] = [0]
        self.unseen = 0
        self.block = 0
        self._open("#page", [])

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        d = self.dom
        up = self.stack[-1] if self.stack else -1
        label = d.label[up] if up >= 0 else 1
        tokens: list[str] = []
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                tokens += TOKEN.findall((value or "").lower())
            elif self.labelled and name == MARK:
                label = int(value or 0)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in FENCES:
            self.fences.append(len(self.stack))
        self.stack.append(len(d.tag))
        d.tag.append(tag)
        d.parent.append(up)
        d.tokens.append(tokens)
        d.label.append(label)
        self.unseen += tag in UNSEEN
        self.block += tag not in INLINE

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.dom.tag[self.stack.pop()]
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()
            self.unseen -= tag in UNSEEN
            self.block += tag not in INLINE

    def _end_open(self, kinds: set[str]) -> None:
        """Close the nearest of ``kinds`` that no fence encloses."""
        at = max((self.places[k][-1] for k in kinds if self.places.get(k)), default=0)
        if at and at >= self.fences[-1]:
            self._close_to(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            self._end_open(ENDS[tag])
        elif tag not in INLINE and tag not in VOID and tag not in UNSEEN:
            self._end_open({"p"})
        if tag == "br":
            self.handle_data(" ")
        elif tag in VOID:
            self.block += tag == "hr"
            self._open(tag, attrs) if tag in ("input", "img") else None
            self._close_to(len(self.stack) - (tag in ("input", "img")))
        else:
            self._open(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self.places[tag][-1] if self.places.get(tag) else 0
        if at and (tag not in INLINE or at >= self.fences[-1]):
            self._close_to(at)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.dom.runs.append((self.stack[-1], self.block, data))


def parse(html: str | None, labelled: bool = False) -> Dom:
    """The nodes and text runs of a page; labels are read from MARK only where they are meant, in training."""
    builder = _Builder(labelled)
    builder.feed(html or "")
    builder.close()
    return builder.dom


FEATURES = (
    "tag", "attribute", "tag_above", "attribute_above", "depth", "children", "siblings", "place_among_siblings",
    "log_text", "log_tags", "density", "link_share", "page_share", "log_paragraphs", "log_links", "fields",
    "punctuation", "words_per_run", "page_position", "density_before", "density_after", "density_of_parent",
    "link_share_of_parent", "is_inline",
)


@dataclass
class NodeModel:
    """Log odds of tags and attribute tokens, bin borders, and symmetric trees."""

    tag_odds: dict[str, float] = field(default_factory=dict)
    token_odds: dict[str, float] = field(default_factory=dict)
    cuts: list[np.ndarray] = field(default_factory=list)
    #: per tree: (features, bins, leaf values)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)
        z = np.full(len(x), self.intercept)
        for features, bins, values in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for f, t in zip(features, bins, strict=True):
                leaf = 2 * leaf + (b[:, f] > t)
            z += values[leaf]
        return z


def node_features(dom: Dom, model: NodeModel) -> np.ndarray:
    """FEATURES of every node of a page."""
    n = len(dom.tag)
    parent = np.array(dom.parent)
    text, words, runs, punct, links, link_text, paras, fields = (np.zeros(n) for _ in range(8))
    start = np.zeros(n)
    seen = 0
    for node, _, data in dom.runs:
        w = data.split()
        if not w:
            continue
        size = sum(map(len, w)) + len(w) - 1
        text[node] += size
        words[node] += len(w)
        runs[node] += 1
        punct[node] += len(SENTENCE.findall(data))
        seen += size
    in_link = np.zeros(n, bool)
    tag_odds, attribute = np.zeros(n), np.zeros(n)
    tag_above, attribute_above, depth = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        tag, up = dom.tag[k], dom.parent[k]
        tag_odds[k] = model.tag_odds.get(tag, 0.0)
        attribute[k] = sum(model.token_odds.get(t, 0.0) for t in dom.tokens[k])
        links[k], paras[k] = tag == "a", tag == "p"
        fields[k] = tag in ("input", "textarea", "select", "button", "option")
        in_link[k] = tag == "a"
        if up >= 0:
            in_link[k] |= in_link[up]
            depth[k] = depth[up] + 1
            tag_above[k] = min(tag_above[up], tag_odds[up])
            attribute_above[k] = min(attribute_above[up], attribute[up])
        if in_link[k]:
            link_text[k] = text[k]
    # page order puts parents first: text before a node, then sums from the last node up
    start[1:] = np.cumsum(text)[:-1]
    tags, children = np.ones(n), np.zeros(n)
    for k in range(n - 1, 0, -1):
        up = parent[k]
        children[up] += 1
        tags[up] += tags[k]
        for total in (text, words, runs, punct, links, link_text, paras, fields):
            total[up] += total[k]
    density = text / tags
    nth, latest = np.zeros(n), {}
    before, after = np.zeros(n), np.zeros(n)
    counted = np.zeros(n)
    for k in range(1, n):
        up = parent[k]
        nth[k] = counted[up]
        counted[up] += 1
        if (last := latest.get(up)) is not None:
            before[k], after[last] = density[last], density[k]
        latest[up] = k
    up = np.maximum(parent, 0)
    whole = max(1.0, text[0])
    share = link_text / np.maximum(1, text)
    return np.stack([
        tag_odds, attribute, tag_above, attribute_above, depth, children, children[up], (nth + 1) / np.maximum(1, children[up]),
        np.log1p(text), np.log1p(tags), np.log1p(density), share, text / whole, np.log1p(paras), np.log1p(links),
        np.minimum(fields, 5), punct / np.maximum(1, words), words / np.maximum(1, runs), start / whole,
        np.log1p(before), np.log1p(after), np.log1p(density[up]), share[up],
        np.array([t in INLINE for t in dom.tag], float),
    ], axis=1)


def decode(dom: Dom, log_odds: np.ndarray) -> np.ndarray:
    """Likeliest labels of all nodes under: inside a rejected node everything is rejected."""
    n = len(dom.tag)
    keep, reject = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    for k in range(n - 1, 0, -1):
        keep[dom.parent[k]] += max(keep[k], reject[k])
        reject[dom.parent[k]] += reject[k]
    out = np.zeros(n, bool)
    out[0] = keep[0] >= reject[0]
    for k in range(1, n):
        out[k] = out[dom.parent[k]] and keep[k] >= reject[k]
    return out


def main_text(dom: Dom, kept: np.ndarray) -> str:
    """Blocks of the kept nodes in page order."""
    blocks: list[list[str]] = []
    at = -1
    for node, block, data in dom.runs:
        if not kept[node]:
            continue
        if block != at:
            blocks.append([])
            at = block
        blocks[-1].append(data)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


# --- training -------------------------------------------------------------

BINS = 32
TREES = 120
DEPTH = 4
RATE = 0.2
L2 = 3.0
TRAINING_PAGES = 1500
SEED = 5

#: Attribute words of the kinds of boxes the training pages are formed of.
BOXES = {
    "menu": ("nav", "menu navigation navbar breadcrumb topbar tabs toc"),
    "header": ("header", "header masthead branding logo site top"),
    "footer": ("footer", "footer copyright legal bottom colophon"),
    "sidebar": ("aside", "sidebar widget related trending rail recommended popular"),
    "notice": ("div", "cookie consent notice gdpr alert popup modal banner"),
    "advert": ("div", "ad ads advert advertisement sponsor sponsored promo adsbox"),
    "form": ("form", "form newsletter subscribe login signup search contact"),
    "comments": ("section", "comments comment reply discussion disqus respond thread"),
    "share": ("div", "share social follow buttons tools"),
}
CONTENT_WORDS = "content article post entry main story body text page prose"
NEUTRAL_WORDS = "wrap container row col box inner outer block layout grid left right clear"


class _Writer:
    """Writes one labelled page; MARK tells where the label changes."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)]

    def prose(self, low: int, high: int) -> str:
        r = self.rng
        out = []
        for _ in range(r.randint(low, high)):
            out.append(r.choice(self.vocabulary) + r.choice(("", "", "", "", "", ",", ".", ".", " |", "!!")))
        return " ".join(out).capitalize()

    def names(self, words: str) -> str:
        r = self.rng
        if r.random() < 0.25:
            return ""
        chosen = " ".join(r.sample(words.split(), r.randint(1, 2)))
        return f' {r.choice(("class", "class", "id"))}="{chosen}"'

    def links(self, low: int, high: int) -> str:
        items = "".join(f'<li><a href="/x">{self.prose(1, 4)}</a></li>' for _ in range(self.rng.randint(low, high)))
        return f"<ul>{items}</ul>"

    def paragraphs(self, low: int, high: int) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(low, high)):
            text = self.prose(1, 8) if r.random() < 0.2 else self.prose(8, 90)
            kind = r.random()
            if kind < 0.1:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.2:
                out.append(f"<p>{self.prose(2, 20)} <a href='/y'>{self.prose(1, 3)}</a> <em>{text}</em></p>")
            elif kind < 0.25:
                out.append(f"<ul>{''.join(f'<li>{self.prose(3, 15)}</li>' for _ in range(3))}</ul>")
            elif kind < 0.3:
                out.append(f"<h2>{self.prose(2, 6)}</h2>")
            elif kind < 0.34:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            else:
                out.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
        return "".join(out)

    def box(self, kind: str) -> str:
        r = self.rng
        tag, words = BOXES[kind]
        named = self.names(words)
        if r.random() < 0.35 or not named:
            tag = tag if not named else "div"
        if tag == "div" and not named:
            named = f' class="{words.split()[0]}"'
        inside = {
            "menu": lambda: self.links(3, 9),
            "header": lambda: f"<div>{self.prose(1, 4)}</div>" + (self.links(2, 5) if r.random() < 0.5 else ""),
            "footer": lambda: r.choice(("", "<p>")) + "&copy; " + self.prose(2, 25) + (self.links(1, 5) if r.random() < 0.4 else ""),
            "sidebar": lambda: f"<h3>{self.prose(1, 4)}</h3>" + r.choice((self.links(2, 7), self.paragraphs(1, 2))),
            "notice": lambda: r.choice(("", "<p>")) + self.prose(5, 30) + r.choice(("", "<button>ok</button>")),
            "advert": lambda: r.choice(("", "<p>", "<span>")) + self.prose(3, 40),
            "form": lambda: f"<label>{self.prose(1, 3)}</label><input name='q'><button>{self.prose(1, 2)}</button>",
            "comments": lambda: "<h3>" + self.prose(1, 2) + "</h3>" + "".join(
                f"<div{self.names('comment reply author')}><span>{self.prose(1, 2)}</span><p>{self.prose(4, 40)}</p></div>"
                for _ in range(r.randint(1, 5))
            ),
            "share": lambda: "".join(f"<a href='/s'>{self.prose(1, 1)}</a>" for _ in range(r.randint(2, 5))),
        }[kind]()
        return f'<{tag}{named} {MARK}="0">{inside}</{tag}>'

    def some(self, kinds: tuple[str, ...], chance: float) -> str:
        return "".join(self.box(k) for k in kinds if self.rng.random() < chance)

    def page(self) -> str:
        r = self.rng
        inner = (f"<h1>{self.prose(3, 12)}</h1>" if r.random() < 0.8 else "") + self.paragraphs(1, 9)
        if r.random() < 0.3:
            inner += self.some(("advert", "share", "sidebar", "form"), 0.4) + self.paragraphs(1, 4)
        if r.random() < 0.3:
            inner += self.box("comments")
        tag = r.choice(("article", "article", "main", "div", "section"))
        named = self.names(CONTENT_WORDS)
        if tag in ("div", "section") and not named:
            named = ' class="content"'
        body = f'<{tag}{named} {MARK}="1">{inner}</{tag}>'
        for _ in range(r.randint(0, 2)):
            body = f"<div{self.names(NEUTRAL_WORDS)}>{self.some(('advert', 'sidebar', 'notice'), 0.2)}{body}{self.some(('sidebar', 'comments', 'advert'), 0.2)}</div>"
        head = self.some(("notice", "header", "menu", "advert", "form"), 0.5)
        tail = self.some(("share", "comments", "sidebar", "advert", "form", "footer", "notice"), 0.4)
        return f"<html><head><title>{self.prose(2, 5)}</title></head><body>{head}{body}{tail}</body></html>"


def training_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(count)]


def _odds(pairs: list[tuple[str, int]]) -> dict[str, float]:
    good: dict[str, float] = {}
    bad: dict[str, float] = {}
    for name, label in pairs:
        side = good if label else bad
        side[name] = side.get(name, 0) + 1
    return {k: float(np.log((good.get(k, 0) + 1) / (bad.get(k, 0) + 1))) for k in {*good, *bad}}


def train(pages: list[str]) -> NodeModel:
    """Fit tag and token odds, then symmetric trees, on labelled pages."""
    model = NodeModel()
    doms = [parse(p, labelled=True) for p in pages]
    model.tag_odds = _odds([(t, y) for d in doms for t, y in zip(d.tag, d.label, strict=True)])
    model.token_odds = _odds([(t, y) for d in doms for ts, y in zip(d.tokens, d.label, strict=True) for t in ts])
    x = np.concatenate([node_features(d, model) for d in doms])
    y = np.array([label for d in doms for label in d.label], float)
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)], axis=1)
    model.intercept = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), model.intercept)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        leaf = np.zeros(len(y), np.int64)
        features, bins = [], []
        for level in range(DEPTH):
            size = (1 << level) * BINS
            best = (-np.inf, 0, 0)
            for j in range(x.shape[1]):
                at = leaf * BINS + b[:, j]
                gs = np.bincount(at, g, size).reshape(-1, BINS).cumsum(axis=1)
                hs = np.bincount(at, h, size).reshape(-1, BINS).cumsum(axis=1)
                gain = (gs**2 / (hs + L2) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + L2)).sum(axis=0)[:-1]
                if gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            features.append(best[1])
            bins.append(best[2])
            leaf = 2 * leaf + (b[:, best[1]] > best[2])
        values = RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + L2)
        model.trees.append((np.array(features), np.array(bins), values))
        z += values[leaf]
    return model


def extract_texts(pages: list[str | None], model: NodeModel) -> list[str]:
    """Main texts of some pages; all their nodes are scored together."""
    doms = [parse(p) for p in pages]
    if not doms:
        return []
    z = model.log_odds(np.concatenate([node_features(d, model) for d in doms]))
    out, at = [], 0
    for d in doms:
        out.append(main_text(d, decode(d, z[at : at + len(d.tag)])))
        at += len(d.tag)
    return out


def extract(pages: DataFrame, model: NodeModel) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    @F.arrow_udf("string")
    def run(html: pa.Array) -> pa.Array:
        return pa.array([t for part in slices(html, 64) for t in extract_texts(part, model)], pa.string())

    return pages.select("page_id", "url", run("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
