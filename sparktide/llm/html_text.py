"""Main text of web pages: gradient-boosted trees judge DOM nodes, and a hierarchical decoding makes their choices agree."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, sliced

#: Generated pages that the trees are fitted on, trees, their depth and learning rate.
TAUGHT_PAGES, TREES, DEPTH, RATE = 1500, 48, 4, 0.3
#: Pages whose nodes are judged together.
PAGES_AT_ONCE = 32

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that never hold visible prose.
HIDDEN = frozenset("script style noscript template head title svg canvas iframe object select option textarea button datalist".split())
#: Elements that begin a new block of text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose start closes an open paragraph, and siblings that close each other.
CLOSES_P = BLOCK - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "legend", "summary", "figcaption"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}
#: Words of class, id, role and label attributes, and elements, that often tell content from its surroundings; the trees weigh them against the rest.
GOOD_TOKENS = frozenset("article articlebody body content entry main maincontent post story text".split())
BAD_TOKENS = frozenset("ad ads advert advertisement aside banner breadcrumb breadcrumbs byline colophon comment comments consent contentinfo cookie cookies discussion disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination paywall popup privacy promo promoted reactions recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget".split())
#: Beginnings and ends of class names that tell the state of a page or element and not what it is.
STATE_FIRST, STATE_LAST = frozenset("has no with without is js supports".split()), frozenset("open closed enabled disabled active loaded left right".split())
BAD_TAGS = frozenset("nav footer aside form header menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2".split())
#: Share of a page's text from which on an article or main element is the page's own, whatever it is named.
OWN_SHARE = 0.4
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
FEATURES = 28


class Node:
    __slots__ = ("tag", "bad", "good", "state", "items", "parent", "depth", "chars", "links", "words", "stops", "elements", "paragraphs", "headings", "goods", "index", "hidden", "kinds", "mark")

    def __init__(self, tag: str, attrs: list, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.bad = self.good = self.state = 0
        self.hidden, self.mark = tag in HIDDEN, None
        tokens: set[str] = set()
        for k, v in attrs:
            if k in ("class", "id", "role", "aria-label", "itemprop") and v:
                for name in v.lower().split():
                    parts = _WORDS.findall(name)
                    if len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
                        self.state += 1
                    else:
                        tokens.update(parts)
            elif k == "hidden" or k == "style" and v and "display:none" in v.replace(" ", "").lower() or k == "aria-hidden" and v == "true":
                self.hidden = True
            elif k == "data-taught":
                self.mark = v == "1"
        self.bad, self.good = len(tokens & BAD_TOKENS), len(tokens & GOOD_TOKENS)
        self.items: list = []  # strings and nodes, in page order
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.links = self.words = self.stops = self.elements = self.paragraphs = self.headings = self.goods = 0
        self.index = 0
        self.kinds: Counter | None = None


class _Tree(HTMLParser):
    """Elements as browsers nest them, roughly; ``open`` counts the open ones of each kind, so that an end without a beginning costs nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", [], None)
        self.open: Counter = Counter()

    def _close(self, node: Node) -> None:
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in SIBLINGS and any(self.open[t] > 0 for t in SIBLINGS[tag]):
            node = self.at
            while node.parent and node.tag not in FENCE[tag]:
                up = node.parent
                if node.tag in SIBLINGS[tag]:
                    self._close(node)
                    if tag != "tr" or node.tag == "tr":
                        break
                node = up
        if tag in CLOSES_P and self.open["p"] > 0:
            node = self.at
            while node.parent and node.tag not in BLOCK:
                node = node.parent
            if node.tag == "p":
                self._close(node)
        node = Node(tag, attrs, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do: the slash only counts for void elements

    def handle_endtag(self, tag):
        if self.open[tag] <= 0:
            return
        node = self.at
        while node.parent:
            if node.tag == tag:
                self._close(node)
                return
            if node.tag in BLOCK and tag not in BLOCK:
                return
            node = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _nodes(root: Node) -> list[Node]:
    """All elements in page order, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.index = len(out)
        out.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Sums over subtrees: characters, those in links, words, sentence ends, elements, paragraphs, headings and content marks."""
    for node in reversed(nodes):
        if not node.hidden:
            for x in node.items:
                if isinstance(x, str):
                    node.chars += len(x.strip())
                    node.words += x.count(" ")
                    node.stops += x.count(".") + x.count("!") + x.count("?")
        else:
            node.chars = node.links = node.words = node.stops = 0
        node.elements += 1
        node.paragraphs += node.tag == "p"
        node.headings += node.tag in HEADINGS
        if node.tag == "a":
            node.links = node.chars
        if node.parent:
            p = node.parent
            if not node.hidden:
                p.chars, p.links, p.words, p.stops = p.chars + node.chars, p.links + node.links, p.words + node.words, p.stops + node.stops
            p.elements, p.paragraphs, p.headings = p.elements + node.elements, p.paragraphs + node.paragraphs, p.headings + node.headings
            p.goods += node.goods + (node.tag in GOOD_TAGS or node.good > 0)


def features(nodes: list[Node]) -> np.ndarray:
    """Subtree density, attribute tokens, depth and sibling statistics of each node.

    Marks of furniture count from the nearest content mark down, with the least share of the page's text that a marked node
    holds: a wrapper that holds nearly all of a page isn't furniture whatever it is named.
    """
    page, framed = max(nodes[0].chars, 1), float(nodes[0].goods > 0)
    out = np.zeros((len(nodes), FEATURES))
    above: list[tuple[int, int, float]] = [(0, 0, 1.0)] * len(nodes)
    before, headed = np.zeros(len(nodes)), 0
    seen = 0
    for node in nodes:  # in page order
        before[node.index] = seen
        if not node.hidden:
            seen += sum(len(x) for x in node.items if isinstance(x, str))
        i, p = node.index, node.parent
        bad_tag, good_tag = node.tag in BAD_TAGS, node.tag in GOOD_TAGS
        share = node.chars / page
        within, marks, least = above[p.index] if p else (0, 0, 1.0)
        if (good_tag or node.good) and not (node.bad or bad_tag) or good_tag and share >= OWN_SHARE:
            within, marks, least = 1, 0, 1.0
        elif node.bad or bad_tag:
            marks, least = marks + 1, min(least, share)
        above[i] = within, marks, least
        if p and p.kinds is None:
            p.kinds = Counter(x.tag for x in p.items if isinstance(x, Node))
        out[i] = (
            share, np.log1p(node.chars), node.links / max(node.chars, 1), node.chars / node.elements, node.stops / max(node.words, 1), np.log1p(node.words),
            node.depth, node.bad, node.good, bad_tag, good_tag, within, marks, least, framed, np.log1p(p.kinds[node.tag]) if p else 0.0,
            node.chars / max(p.chars, 1) if p else 1.0, p.links / max(p.chars, 1) if p else 0.0, p.paragraphs if p else 0, node.paragraphs,
            node.tag in ("p", "blockquote", "pre"), node.tag in ("li", "a", "ul", "ol"), node.tag in ("h1", "h2", "h3", "h4"), node.headings, node.goods, 0.0, headed, node.state,
        )
        headed |= node.tag in HEADINGS
    out[:, 25] = before / max(seen, 1)
    return out


@dataclass(frozen=True)
class Forest:
    """Boosted regression trees of one depth, as arrays: a feature and a cut for each inner node, a value for each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Forest:
    """Gradient boosting with logistic loss and second-order leaf values; cuts between quantiles."""
    inner = 2**DEPTH - 1
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 33))) for k in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)]
    rate = min(max(np.average(y, weights=weight), 1e-3), 1 - 1e-3)
    score = np.full(len(y), np.log(rate / (1 - rate)))
    base, all_f, all_c, all_v = float(score[0]), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-4)
        f, c, v = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        members = {0: np.arange(len(y))}
        for node in range(inner):
            own = members.pop(node)
            best = (1e-6, 0, np.inf)
            if len(own) >= 8:
                own_g, own_h = g[own], h[own]
                total_g, total_h = own_g.sum(), own_h.sum()
                for k in range(x.shape[1]):
                    b = bins[k][own]
                    left_g = np.cumsum(np.bincount(b, own_g, len(cuts[k]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, own_h, len(cuts[k]) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), k, cuts[k][gain.argmax()])
            f[node], c[node] = best[1], best[2]
            right = x[own, f[node]] > c[node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
        for leaf in range(inner + 1):
            own = members[inner + leaf]
            v[leaf] = RATE * g[own].sum() / (h[own].sum() + 1)
            score[own] += v[leaf]
        all_f.append(f)
        all_c.append(c)
        all_v.append(v)
    return Forest(np.array(all_f), np.array(all_c), np.array(all_v), base)


class Teacher:
    """Generated pages of many layouts in which every part is known to be content or not (attribute ``data-taught``); names agree with the parts mostly, not always."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choices("aeinrstlou", k=self.rng.randint(2, 8))) for _ in range(2000)]

    def one(self, *options):
        return self.rng.choice(options)

    def few(self, least: int, most: int) -> int:
        return self.rng.randint(least, most)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        return self.rng.choice(self.words)

    def prose(self, least: int, most: int) -> str:
        words = self.rng.choices(self.words, k=self.few(least, most))
        for k in range(8, len(words), self.few(6, 14)):
            words[k] += self.one(".", ",", ".", "?")
        return " ".join(words).capitalize() + self.one(".", ".", ".", "!", "")

    def named(self, tokens: list[str], p: float = 0.8) -> str:
        """A class or id of one of the tokens, dressed up; or a name that says nothing, or none."""
        if not self.chance(p):
            return "" if self.chance(0.5) else f' class="{self.word()}"'
        t = self.one(*tokens)
        return f' {self.one("class", "class", "id")}="{self.one(t, t, f"site-{t}", f"{t}-wrapper", f"{t}__inner", f"{self.word()} {t}", f"{t}-{self.word()}")}"'

    def links(self, n: int) -> str:
        each = [f'<a href="/{self.word()}">{self.prose(1, 3)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if self.chance(0.6) else self.one(" ", " | ", "").join(each)

    def paragraphs(self, n: int, mark: str = "") -> str:
        tag = self.one("p", "p", "p", "div")
        return "".join(f"<{tag}{mark}>{self.prose(3, 60)}{'' if tag == 'p' and self.chance(0.3) else f'</{tag}>'}" for _ in range(n))

    def furniture(self, inside: bool) -> str:
        off = ' data-taught="0"'
        kind = self.one("ad", "share", "related", "newsletter", "notice", "comments", "form", "aside") if inside else self.one("nav", "header", "footer", "aside", "notice", "ad", "form", "comments", "related", "share", "crumbs", "name", "rights")
        tag = lambda own, p=0.5: own if self.chance(p) else "div"
        if kind in ("nav", "crumbs"):
            t = tag("nav", 0.7)
            return f"<{t}{off}{self.named(['nav', 'menu', 'navigation', 'navbar', 'breadcrumb', 'topbar'])}>{self.links(self.few(2, 9))}</{t}>"
        if kind == "header":
            t = tag("header", 0.7)
            return f"<{t}{off}{self.named(['header', 'masthead', 'banner'])}>{self.one('<div>{}</div>', '<p>{}</p>', '<h1>{}</h1>', '{}').format(self.prose(1, 6))}{self.links(4) if self.chance(0.4) else ''}</{t}>"
        if kind == "footer":
            t = tag("footer", 0.7)
            return f"<{t}{off}{self.named(['footer', 'colophon', 'contentinfo'])}>{self.one('', '<p>')}{self.prose(3, 30)}{self.links(3) if self.chance(0.5) else ''}</{t}>"
        if kind == "aside":
            t = tag("aside", 0.7)
            return f"<{t}{off}{self.named(['sidebar', 'widget', 'aside', 'promo'])}><h3>{self.prose(1, 3)}</h3>{self.paragraphs(self.few(1, 3))}{self.links(4)}</{t}>"
        if kind == "form":
            return f"<form{off}{self.named(['form', 'signup', 'login', 'newsletter'], 0.6)}><p>{self.prose(2, 14)}</p><label>{self.word()}</label><input></form>"
        if kind == "comments":
            t, each = tag("section", 0.4), []
            for _ in range(self.few(1, 8)):
                c = self.one("div", "li", "article", "div")
                each.append(f'<{c} class="{self.one("comment", "comment-body", "reply", "comment odd")}"><b>{self.word()}</b><p>{self.prose(2, 50)}</p></{c}>')
            body = "".join(each) if "<li" not in "".join(each) else "<ol>" + "".join(each) + "</ol>"
            return f'<{t}{off} {self.one("id", "class")}="{self.one("comments", "comment-list", "discussion", "respond", "reactions", "disqus_thread", "post-comments")}">{self.one("<h2>{}</h2>", "<h3>{}</h3>", "").format(self.prose(1, 3))}{body}</{t}>'
        if kind == "name":
            return f"<div{off}>{self.prose(1, 4).rstrip('.!')}</div>"
        if kind == "rights":
            return f"<{(t := self.one('p', 'div', 'small'))}{off}>&copy; {self.prose(2, 8)}</{t}>"
        tokens = {"ad": ["ad", "ads", "advert", "sponsored", "promo", "banner"], "share": ["share", "social", "sharing"], "related": ["related", "recommended", "teaser"], "newsletter": ["newsletter", "subscribe", "signup"], "notice": ["cookie", "consent", "notice", "gdpr", "privacy", "popup", "modal", "paywall"]}[kind]
        t = self.one("div", "div", "section", "aside", "p")
        body = self.links(self.few(2, 5)) if kind in ("share", "related") else self.prose(3, 40) if t == "p" or self.chance(0.5) else self.paragraphs(self.few(1, 2))
        t = "div" if t == "p" and "<" in body else t
        return f"<{t}{off}{self.named(tokens, 0.93)}>{body}</{t}>"

    def content(self) -> str:
        on, parts = ' data-taught="1"', []
        for _ in range(self.one(1, 1, 2, 3, 4, 6, 9, 14, 25)):
            kind = self.one("p", "p", "p", "p", "p", "div", "h2", "list", "quote", "br", "table", "pre", "figure", "section")
            if kind == "list":
                parts.append(f"<ul{on}>" + "".join(f"<li>{self.prose(2, 20)}</li>" for _ in range(self.few(2, 5))) + "</ul>")
            elif kind == "br":
                parts.append(f"<div{on}>" + "<br><br>".join(self.prose(5, 40) for _ in range(3)) + "</div>")
            elif kind == "table":
                parts.append(f"<table{on}>" + "".join(f"<tr><td>{self.prose(1, 3)}</td><td>{self.word()}</td></tr>" for _ in range(3)) + "</table>")
            elif kind == "figure":
                parts.append(f"<figure{on}><img src=x><figcaption>{self.prose(3, 12)}</figcaption></figure>")
            elif kind == "section":
                parts.append(f"<section{on}{self.named(['text', 'entry', 'intro'], 0.3)}><h2>{self.prose(1, 6)}</h2>{self.paragraphs(2)}</section>")
            else:
                t = {"quote": "blockquote"}.get(kind, kind)
                link = f' <a href="/x">{self.prose(1, 4)}</a> ' if self.chance(0.3) else ""
                parts.append(f"<{t}{on}>{self.prose(1, 8) if t == 'h2' else self.prose(1, self.one(6, 30, 80)) + link}</{t}>")
        for _ in range(self.one(0, 0, 1, 2)):
            parts.insert(self.few(0, len(parts)), self.furniture(True))
        title = f"<h1{on}>{self.prose(2, 12)}</h1>"
        title = f'<header{self.named(["header", "entry-header", "title"], 0.5)}>{title}</header>' if self.chance(0.35) else title
        return (title if self.chance(0.75) else "") + "".join(parts)

    def scrap(self) -> str:
        """A page of one part."""
        if self.chance(0.5):
            return f'<div data-taught="0" class="{self.one(*sorted(BAD_TOKENS))}">{self.prose(1, 30)}</div>'
        text = self.prose(3, 50)
        return self.one("<p{0}>{1}</p>", "<article{0}><p>{1}</p></article>", "<body><main{0}><p>{1}</p></main></body>", "<html><body><p{0}>{1}</p></body></html>", "<body><article{0}>{1}</article></body>").format(' data-taught="1"', text)

    def page(self) -> str:
        if self.chance(0.12):
            return self.scrap()
        topic = self.one("form-guide", "social-history", "share-prices", "menu-of-the-day", "cookie-recipes", "privacy-law", "nav-buoys", self.word())
        body = self.content() if self.chance(0.95) else ""
        frame = self.one("article", "article", "main", "named", "named", "plain", "both", "bare")
        if frame in ("article", "main"):
            odd = f' {self.one("id", "class")}="{topic}"' if self.chance(0.3) else self.named(["post", "entry", "article"], 0.5)
            body = f"<{frame}{odd}>{body}</{frame}>"
        elif frame == "both":
            body = f"<main{self.named(['content', 'main'], 0.5)}><article{self.named(['post', 'hentry'], 0.5)}>{body}</article>{self.furniture(False) if self.chance(0.5) else ''}</main>"
        elif frame == "named":
            body = f'<div {self.one("class", "id")}="{self.one("content", "post-body", "entry-content", "story", "main-content", "article-text", "articlebody")}">{body}</div>'
        elif frame == "plain":
            body = f"<div{self.named([topic], 0.4)}>{body}</div>"
        above, below = ("".join(self.furniture(False) for _ in range(self.one(0, 0, 1, 2, 3, 4))) for _ in range(2))
        out = above + body + below
        for _ in range(self.few(0, 2)):  # wrappers, of which names say little
            t = self.one("div", "div", "div", "section", "form" if self.chance(0.3) else "div")
            name = self.one("has-sidebar page", "no-sidebar", "with-menu wrap", "page", "container", "header-fixed site", "sidebar-layout", "nav-open", "footer-push", "content", self.word())
            out = f'<{t} {self.one("class", "id")}="{name}">{out}</{t}>'
        state = self.one("", "", ' class="single-post comments-open"', ' class="has-sidebar newsletter-signup"', ' class="cookie-banner-loaded"', ' class="menu-open"', ' id="sidebar-right"')
        return f"<html><head><title>{self.prose(2, 6)}</title><script>var x;</script></head><body{state}>{out}</body></html>"


def _examples(html: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a taught page's nodes; a node is content if any content is in it."""
    nodes = _nodes(parse(html))
    _measure(nodes)
    y, marks = np.zeros(len(nodes)), [False] * len(nodes)
    for node in nodes:
        marks[node.index] = node.mark if node.mark is not None else bool(node.parent and marks[node.parent.index])
    for node in reversed(nodes):
        if (marks[node.index] and node.chars) or y[node.index]:
            y[node.index] = 1.0
            if node.parent:
                y[node.parent.index] = 1.0
    own = np.array([_own_text(n) for n in nodes], float)
    use = [n.index for n in nodes if n.chars and _judged(n) and n.tag != "#"]
    return features(nodes)[use], y[use], 1.0 + np.log1p(own[use])


@lru_cache(maxsize=1)
def fit(pages: int = TAUGHT_PAGES, seed: int = 11) -> Forest:
    """The trees, fitted on generated pages alone: they need no labels of the given ones, and are the same for every table."""
    teacher = Teacher(seed)
    parts = [_examples(teacher.page()) for _ in range(pages)]
    return boost(*(np.concatenate([p[k] for p in parts]) for k in range(3)))


def _own_text(node: Node) -> int:
    return 0 if node.hidden else sum(len(x.strip()) for x in node.items if isinstance(x, str))


def _judged(node: Node) -> bool:
    """Whether the trees judge a node: blocks, and others that are named; the rest belongs to the text around it."""
    return node.tag in BLOCK or node.bad > 0 or node.good > 0 or node.parent is None


#: Elements of running text, which are decided together with their siblings.
RUNNING = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 ul ol dl table figure".split())
_KEPT = 0.1


def _in_content(nodes: list[Node]) -> list[bool]:
    """Whether a node stands below a content mark with no mark of furniture in between. Furniture stays furniture below itself, but for wrappers that hold much of the page."""
    page, states = max(nodes[0].chars, 1), [0] * len(nodes)
    for node in nodes:
        above = states[node.parent.index] if node.parent else 0
        if node.bad or node.tag in BAD_TAGS:
            above = above if above < 0 or node.chars >= OWN_SHARE * page else -1
        elif above >= 0 and (node.tag in GOOD_TAGS or node.good):
            above = 1
        states[node.index] = above
    return [x > 0 for x in states]


def _unmarked(node: Node) -> bool:
    return not (node.hidden or node.bad or node.tag in BAD_TAGS)


def smoothed(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """Scores in which unmarked siblings of running text stand together, so that no paragraph of an article is lost for its place, length or links.

    Below a content mark all of a parent's running text is kept if its scores, by the amount of text, sum up to more than
    nothing; elsewhere what stands between kept siblings of its tag is. A heading in an article's own header goes with the
    article. If nothing at all would be kept, the running text below the content mark of most text is.
    """
    out, inside = score.copy(), _in_content(nodes)

    def keep(node: Node) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if _unmarked(x):
                out[x.index] = max(out[x.index], _KEPT)
                stack += [y for y in x.items if isinstance(y, Node)]

    for parent in nodes:
        running = [x for x in parent.items if isinstance(x, Node) and x.tag in RUNNING and x.chars and _unmarked(x)]
        if not running:
            continue
        if inside[parent.index]:
            if sum(score[x.index] * (0.3 + np.log1p(x.chars)) for x in running) > 0:
                for x in running:
                    keep(x)
        else:
            for tag in {x.tag for x in running}:
                own = [x for x in running if x.tag == tag]
                good = [k for k, x in enumerate(own) if score[x.index] > 0]
                for x in own[good[0] : good[-1]] if good else ():
                    keep(x)
    for node in nodes:  # a heading in the header of a kept article
        if node.tag == "header" and node.parent and inside[node.parent.index] and node.headings and node.chars < OWN_SHARE * node.parent.chars:
            for x in node.items:
                if isinstance(x, Node) and x.tag in HEADINGS and _unmarked(x) and any(out[y.index] > 0 for y in node.parent.items if isinstance(y, Node) and y is not node):
                    keep(x)
                    out[node.index] = max(out[node.index], _KEPT)
    if not any(out[x.index] > 0 and _own_text(x) for x in nodes if x.parent):
        framed = [x for x in nodes if inside[x.index] and x.chars and (x.tag in GOOD_TAGS or x.good)]
        if framed:
            for x in max(framed, key=lambda x: (x.chars, -x.depth)).items:
                if isinstance(x, Node) and x.tag in RUNNING:
                    keep(x)
    return out


def decide(nodes: list[Node], score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are kept, and of which the own text is: the labelling of highest total score in which nothing inside a rejected node is kept.

    Scores are smoothed over siblings first. From the leaves up, each node is worth its own score, by how much text of its own
    it has, and what its children are worth
    where that is positive; from the root down, nodes of positive worth below kept ones are kept. So a wrapper that scores low
    survives by its prose, and no descendant contradicts its ancestors. A kept node that scores low, as wrappers do, keeps its
    children but not its own text.
    """
    score = smoothed(nodes, score)
    worth, judged = np.zeros(len(nodes)), np.array([_judged(n) for n in nodes])
    for node in reversed(nodes):
        i = node.index
        if node.hidden:
            worth[i] = -1.0
            continue
        own = np.log1p(_own_text(node))
        if judged[i]:
            worth[i] += score[i] * (0.3 + own)
            if node.parent and worth[i] > 0:
                worth[node.parent.index] += worth[i]
        elif node.parent:  # goes with what is around it
            worth[node.parent.index] += worth[i]
            if judged[node.parent.index]:
                worth[node.parent.index] += score[node.parent.index] * 0.3 * own
    keep, text = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for node in nodes:
        i, p = node.index, node.parent
        if p is None:
            keep[i], text[i] = True, score[i] > 0
        elif keep[p.index] and not node.hidden:
            keep[i] = not judged[i] or worth[i] > 0
            text[i] = keep[i] and (score[i] > 0 if judged[i] else text[p.index])
    return keep, text


def main_texts(pages: list[str | None], forest: Forest) -> list[str]:
    """The main text of each page; the trees judge the nodes of all pages together."""
    trees = []
    for html in pages:
        nodes = _nodes(parse(html)) if html else []
        if nodes:
            _measure(nodes)
        trees.append(nodes)
    sizes = [len(t) for t in trees]
    if not sum(sizes):
        return [""] * len(pages)
    scores = np.split(forest.score(np.concatenate([features(t) for t in trees if t])), np.cumsum([n for n in sizes if n])[:-1])
    each = iter(scores)
    return [_rendered(nodes, *decide(nodes, next(each))) if nodes else "" for nodes in trees]


def _rendered(nodes: list[Node], keep: np.ndarray, text: np.ndarray) -> str:
    """The blocks of kept nodes, in page order, joined by two line ends."""
    blocks: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        block = _SPACE.sub(" ", "".join(open_block)).strip()
        if block:
            blocks.append(block)
        open_block.clear()

    stack: list = [nodes[0]]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):  # the end of a block element
            close()
        elif isinstance(x, str):
            open_block.append(x)
        else:
            if x.tag == "br":
                open_block.append(" ")
                continue
            if not keep[x.index]:
                if x.tag in BLOCK:
                    close()
                continue
            if x.tag in BLOCK:
                close()
                stack.append(())
            own = text[x.index]
            stack += [y for y in reversed(x.items) if own or isinstance(y, Node)]
    close()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, forest: Forest | None = None, *, html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with ``text``, the main text of its html, and ``n_chars``, its code points.

    Null and empty html, and pages without content: empty text, 0. Pages are independent: copies are treated alike, an empty
    table gives an empty one, a page of any length is parsed whole. Columns of ``pages`` named text or n_chars are replaced
    (and html_col is kept). There is no shuffle.
    """
    forest = fit() if forest is None else forest
    kept = pages.select(*(column(pages, c) for c in pages.columns if c == html_col or c not in ("text", "n_chars")))
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, html_col):
            html = batch.column(batch.schema.get_field_index(html_col)).to_pylist()
            texts = [t for i in range(0, len(html), PAGES_AT_ONCE) for t in main_texts(html[i : i + PAGES_AT_ONCE], forest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return kept.mapInArrow(run, schema)
