"""Main text of web pages by a tree-structured graphical model of the DOM.

Every block element is a node with two states, content or not.  Its features (tag, words of
class and id, text length, share of link text) give its own potential; parent and child
share a potential.  Sum-product messages upward and downward give each node's probability
of content, exactly, as the graph is a tree.  Weights are learned by maximum likelihood, on
the driver and in numpy, from labelled pages of common layouts (``labelled_pages``), whose
words mean nothing.  A text block is kept if its element is more likely content than not.

Defined results: null, empty and textless pages give an empty text; unclosed and stray
tags, a missing body and pages cut off anywhere are parsed as far as they go; nesting of any
depth is handled without recursion; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plinth.llm.shared import bounded_batches, texts_of

# Fixed values of HTML: elements whose text is never shown, that stand inside a line, that have no end.
UNSEEN = set("script style noscript template title head svg iframe object canvas audio video map select datalist".split())
# What can stand in a head; any other tag ends it.  What ends with the block that holds it if it was not closed.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title html head".split())
HELD = set("select object canvas map".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# An open element of the key ends where one of its set begins, within the named containers.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
        "option": {"option"}}
SCOPES = set("ul ol dl table body html article section div aside nav main form td th blockquote".split())
MARKED = set("nav aside footer header form article main section dialog".split())

_SPACE = re.compile(r"\s+")
# What a line about the rights in a page says, in any layout.
_RIGHTS = re.compile(r"©|\(c\)|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_CUT_REFERENCE = re.compile(r"&#?\w*\Z")


@dataclass
class Node:
    parent: int
    tag: str
    words: tuple[str, ...]
    length: int = 0
    links: int = 0
    rights: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # element, text


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page([Node(-1, "root", ())])
        self.open = [0]  # nodes from the root to here
        self.counts = {"root": 1}  # of open elements by tag
        self.unseen: list[str] = []
        self.inner: list[str] = []  # blocks opened within unseen elements that a block may end
        self.pieces: list[str] = []
        self.links = 0

    def close_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.pieces)).strip()
        self.pieces = []
        if text:
            self.page.blocks.append((self.open[-1], text))
            node = self.page.nodes[self.open[-1]]
            node.length += len(text)
            node.rights = node.rights or len(text) < 250 and bool(_RIGHTS.search(text))

    def _pop(self) -> None:
        self.counts[self.page.nodes[self.open.pop()].tag] -= 1

    def _end_implied(self, tag: str) -> None:
        if tag in ENDS_P and self.counts.get("p"):
            while self.page.nodes[self.open[-1]].tag != "p":
                self._pop()
            self._pop()
        for depth in range(len(self.open) - 1, 0, -1):
            old = self.page.nodes[self.open[depth]].tag
            if tag in ENDS.get(old, ()):
                while len(self.open) > depth:
                    self._pop()
                if tag != "tr":
                    return
            elif old in SCOPES and not (tag == "tr" and old in ("td", "th")):
                return

    def _ends_held(self, tag: str) -> bool:
        """Whether the tag ends the block around an unclosed element that it cannot stand in."""
        block = self.page.nodes[self.open[-1]].tag
        ends = ENDS.get(block, ()) if block != "p" or self.unseen[0] != "select" else ENDS_P - {"div", "hr"}
        return self.unseen[0] in HELD and not self.inner and tag in ends

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen:
            if tag == "body" or self.unseen == ["head"] and tag not in IN_HEAD or self._ends_held(tag):
                self.unseen.clear()
            elif tag != "head" and (self.unseen == ["head"] and tag in UNSEEN or tag == self.unseen[-1] != "title"):
                self.unseen.append(tag)
            elif self.unseen[0] in HELD and tag not in INLINE | VOID | UNSEEN | {"option", "optgroup"}:
                self.inner.append(tag)
            if self.unseen:
                return
            self.inner.clear()
        if tag in UNSEEN:
            self.unseen.append(tag)
        elif tag in ("br", "wbr"):
            self.pieces.append(" " if tag == "br" else "")
        elif tag in INLINE:
            self.links += tag == "a"
        elif tag in VOID:
            if tag == "hr":
                self.close_block()
        else:
            self.close_block()
            self.links = 0  # an unclosed link ends with its block
            self._end_implied(tag)
            names = {k: v or k for k, v in attrs}
            words = re.findall("[a-z]+", " ".join(names.get(k, "") for k in ("class", "id", "role")).lower())
            hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
            self.page.nodes.append(Node(self.open[-1], tag, tuple(dict.fromkeys(words + ["hidden"] * hidden))))
            self.open.append(len(self.page.nodes) - 1)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag == "head" == self.unseen[0]:
                self.unseen.clear()
            elif tag == self.unseen[-1]:
                self.unseen.pop()
                if not self.unseen:
                    self.inner.clear()
            elif tag in self.inner:
                while self.inner.pop() != tag:
                    pass
            elif self.unseen[0] in HELD and tag not in INLINE and self.counts.get(tag):  # the block that holds it ends
                self.unseen.clear()
                self.inner.clear()
                self.handle_endtag(tag)
        elif tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
        elif self.counts.get(tag):
            self.close_block()
            self.links = 0
            while self.page.nodes[self.open[-1]].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if self.unseen == ["head"] and data.strip():  # text ends a head, too
            self.unseen.clear()
        if not self.unseen:
            self.pieces.append(data)
            if self.links:
                self.page.nodes[self.open[-1]].links += len(data.strip())


def read_page(html: str) -> Page:
    reader = _Reader()
    reader.feed(_CUT_TAG.sub("", html))  # a tag that the page's end cuts off is no text
    reader.close()
    reader.close_block()
    return reader.page


def features(page: Page) -> list[list[str]]:
    """Names of the features of each node; text counts with all that is below it."""
    nodes = page.nodes
    length, links = [n.length for n in nodes], [min(n.links, n.length) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        length[nodes[i].parent] += length[i]
        links[nodes[i].parent] += links[i]
    whole = max(1, length[0])
    out = []
    for n, size, linked in zip(nodes, length, links):
        share = linked / size if size else 0
        out.append([
            "any", f"tag {n.tag}", *(f"word {w}" for w in n.words),
            f"text {sum(size > x for x in (0, 25, 80, 250))}", f"own {sum(n.length > x for x in (0, 25, 80, 250))}",
            f"links {sum(share > x for x in (0, 0.3, 0.7, 0.95))}", f"part {sum(size / whole > x for x in (0.1, 0.5, 0.9))}",
            *(["rights"] if n.rights else []),
        ])
    return out


def _pair_kind(node: Node) -> int:
    """Elements that mark a region pass on less of their parent's state."""
    return int(node.tag in MARKED or bool(node.words))


@dataclass
class Model:
    weights: dict[str, float]
    pair: np.ndarray  # (kind of child, state of parent, state of child), log potentials

    def content(self, page: Page) -> list[float]:
        """The probability of content for each node."""
        weight = self.weights.get
        own = [sum(weight(f, 0.0) for f in fs) for fs in features(page)]
        tables = self.pair.reshape(2, 4).tolist()
        return sum_product([n.parent for n in page.nodes], own, [tables[_pair_kind(n)] for n in page.nodes])[0]

    def text(self, html: str) -> str:
        page = read_page(html)
        if not page.blocks:
            return ""
        content = self.content(page)
        return "\n".join(text for node, text in page.blocks if content[node] > 0.5)


def _log_add(x: float, y: float) -> float:
    high, gap = (x, y - x) if x > y else (y, x - y)
    return high + math.log1p(math.exp(gap)) if gap > -40 else high


def _chance(ratio: float) -> float:
    return 1 / (1 + math.exp(-ratio)) if ratio > -500 else 0.0


def sum_product(
    parents: list[int], own: list[float], pairs: list[list[float]]
) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Exact marginals of a tree whose parents stand before their children: of each node, and with its parent.

    ``own[i]`` is the log potential of state 1 against 0; messages are log ratios likewise.
    ``pairs[i]`` are the log potentials of (parent, child) in the order 00, 01, 10, 11.
    """
    n = len(parents)
    up, below = [0.0] * n, list(own)  # message to the parent; own potential and messages from below
    for i in range(n - 1, 0, -1):
        a, b, c, d = pairs[i]
        up[i] = _log_add(c, d + below[i]) - _log_add(a, b + below[i])
        below[parents[i]] += up[i]
    full, joint = list(below), [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(1, n):
        a, b, c, d = pairs[i]
        rest = full[parents[i]] - up[i]  # what the parent knows without this child
        full[i] = below[i] + _log_add(b, d + rest) - _log_add(a, c + rest)
        logs = (a, b + below[i], rest + c, rest + d + below[i])
        most = max(logs)
        parts = [math.exp(max(x - most, -700)) for x in logs]
        whole = sum(parts)
        joint[i] = tuple(x / whole for x in parts)
    return [_chance(x) for x in full], joint


def fit(pages: list[tuple[str, list[str]]], rounds: int = 120, rate: float = 0.5, ridge: float = 0.1) -> Model:
    """Maximum likelihood from (html, content blocks) pairs: observed less expected counts, by Adagrad."""
    numbers: dict[str, int] = {}
    data = []
    for html, content in pages:
        page, wanted = read_page(html), set(content)
        size = len(page.nodes)
        votes = np.zeros((size, 2), int)
        for node, text in page.blocks:
            votes[node, int(text in wanted)] += 1
        for i in range(size - 1, 0, -1):  # what holds more content than not is content
            state = int(votes[i, 1] > votes[i, 0])
            votes[page.nodes[i].parent, state] += 1
        state = (votes[:, 1] > votes[:, 0]).astype(int)
        names = features(page)
        ids = np.array([numbers.setdefault(f, len(numbers)) for fs in names for f in fs])
        owner = np.repeat(np.arange(size), [len(fs) for fs in names])
        parent = np.array([n.parent for n in page.nodes])
        kind = np.array([_pair_kind(n) for n in page.nodes])
        data.append((parent.tolist(), kind, state, ids, owner, 2 * state[parent] + state))
    weights, speed = np.zeros(len(numbers)), np.full(len(numbers), 1e-6)
    pair, pair_speed = np.zeros((2, 4)), np.full((2, 4), 1e-6)
    for _ in range(rounds):
        slope, pair_slope = -ridge * weights, -ridge * pair
        tables = pair.tolist()
        for parent, kind, state, ids, owner, together in data:
            own = np.bincount(owner, weights[ids], len(state)).tolist()
            content, joint = sum_product(parent, own, [tables[k] for k in kind])
            slope += np.bincount(ids, (state - np.array(content))[owner], len(weights))
            np.add.at(pair_slope, (kind[1:], together[1:]), 1)
            np.add.at(pair_slope, kind[1:], -np.array(joint[1:]).reshape(-1, 4))
        speed += slope**2
        weights = weights + rate * slope / speed**0.5
        pair_speed += pair_slope**2
        pair = pair + rate * pair_slope / pair_speed**0.5
    return Model({f: float(weights[i]) for f, i in numbers.items()}, pair)


def labelled_pages(count: int = 420, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pages of common layouts with their content blocks, made of meaningless words."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]

    def words(low: int, high: int) -> str:
        text = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))
        return text.capitalize() + rng.choice([".", ".", "!", "?", ""])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(n))

    def named(names: str, tags: str = "div div section aside") -> tuple[str, str]:
        tag, name = rng.choice(tags.split()), rng.choice(names.split())
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">', f"</{tag}>"

    def around(names: str, inner: str, tags: str = "div div section aside") -> str:
        start, end = named(names, tags)
        return start + inner + end

    def plain_links(between: str) -> str:
        return between.join(f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(rng.randint(2, 7)))

    def rights() -> str:
        sign = rng.choice(["&copy;", "Copyright", "(c)", "Copyright &copy;"])
        return f"{sign} {rng.randint(1995, 2030)} {words(1, 5)}" + rng.choice(["", " All rights reserved."])

    def noise(kind: str) -> str:
        if kind == "plain menu":  # nothing but its links tells it
            tag = rng.choice(["div", "div", "center"])
            return f"<{tag}>{plain_links(rng.choice([' ', ' | ', '<br>']))}</{tag}>"
        if kind == "plain foot":
            tag = rng.choice(["div", "div", "center", "address", "p"])
            return f"<{tag}>{rights()}</{tag}>"
        if kind == "menu":
            inner = f"<ul>{links(rng.randint(2, 9))}</ul>"
            return f"<nav>{inner}</nav>" if rng.random() < 0.6 else around("menu nav navbar navigation breadcrumb topnav", inner)
        if kind == "head":
            inner = f"<h1>{words(1, 4)}</h1><p>{words(2, 6)}</p>" if rng.random() < 0.5 else f"<div>{words(1, 4)}</div>"
            return f"<header>{inner}</header>" if rng.random() < 0.6 else around("header masthead site-header topbar banner", inner)
        if kind == "ad":
            inner = words(2, 12) if rng.random() < 0.6 else f"<p>{words(3, 15)}</p><a href='/x'>{words(2, 3)}</a>"
            return around("ad ads advert advertisement sponsored promo sponsor adbox banner-ad", inner)
        if kind == "notice":
            inner = f"<p>{words(6, 25)}</p><button>{words(1, 1)}</button>"
            return around("cookie cookie-banner consent notice alert cookie-notice gdpr popup modal", inner, "div div section dialog")
        if kind == "side":
            inner = f"<h3>{words(1, 3)}</h3>" + (f"<ul>{links(rng.randint(2, 6))}</ul>" if rng.random() < 0.6 else f"<p>{words(5, 30)}</p>")
            return f"<aside>{inner}</aside>" if rng.random() < 0.5 else around("sidebar widget related recommended rail trending", inner)
        if kind == "form":
            inner = f"<label>{words(1, 2)}</label><input name=a><p>{words(3, 9)}</p><button>{words(1, 2)}</button>"
            form = f"<form>{inner}</form>"
            return form if rng.random() < 0.5 else around("newsletter subscribe signup login search contact-form", form)
        if kind == "share":
            return around("share social sharing social-links tags", f"<ul>{links(rng.randint(2, 5))}</ul>", "div ul section")
        if kind == "comments":
            one = lambda: around("comment reply comment-body", f"<p>{words(4, 40)}</p>", "div li article")
            inner = f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5)))
            return around("comments comment-list discussion responses reader-comments", inner, "div section section ol")
        inner = f"&copy; {words(2, 5)}" if rng.random() < 0.5 else f"<p>{words(4, 20)}</p><ul>{links(3)}</ul>"
        return f"<footer>{inner}</footer>" if rng.random() < 0.7 else around("footer site-footer copyright colophon bottom", inner)

    def article(headed: float) -> tuple[str, list[str]]:
        parts, blocks = [], []

        def block(tag: str, text: str, marked: str | None = None) -> str:
            blocks.append(text)
            return f"<{tag}>{marked or text}</{tag}>"

        if rng.random() < headed:
            parts.append(block("h1", words(2, 9)))
        least = 0 if parts else 1
        for _ in range(rng.randint(least, 9) if rng.random() < 0.7 else rng.randint(least, 2)):
            kind = rng.random()
            if kind < 0.08:
                parts.append(block("h2", words(2, 6)))
            elif kind < 0.16:
                parts.append("<ul>" + "".join(block("li", words(3, 15)) for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.21:
                parts.append("<blockquote>" + block("p", words(5, 30)) + "</blockquote>")
            elif kind < 0.25:
                rows = ["<tr>" + block("td", words(1, 3)) + block("td", words(1, 3)) + "</tr>" for _ in range(3)]
                parts.append(f"<table>{''.join(rows)}</table>")
            elif kind < 0.29:
                parts.append("<figure><img src=a>" + block("figcaption", words(3, 12)) + "</figure>")
            elif kind < 0.32:
                parts.append(block("pre", words(4, 20)))
            else:
                text = words(1, 90)
                linked = text.split(" ")
                linked[0] = f'<a href="/y">{linked[0]}</a>'
                parts.append(block("p", text, " ".join(linked) if rng.random() < 0.2 else None))
            if rng.random() < 0.08:
                parts.append(noise(rng.choice(["ad", "share", "side", "form"])))
        if rng.random() < 0.15:  # verse, dialogue, broken lines
            parts += [block("p", words(1, 4)) for _ in range(rng.randint(12, 70))]
        return "".join(parts), blocks

    pages = []
    for _ in range(count):
        shell = rng.random()
        plain = shell >= 0.72  # nothing marks the article: bare, in unnamed elements, or in a cell of a layout table
        inner, blocks = article(0.35 if plain else 0.8)
        if shell < 0.32:
            inner = f"<article>{inner}</article>"
        elif shell < 0.5:
            inner = f"<main>{inner}</main>"
        elif shell >= 0.94:
            cell = rng.choice([plain_links("<br>"), plain_links(" "), f"<ul>{links(rng.randint(2, 6))}</ul>"])
            cells = [f"<td>{cell}</td>", f"<td>{inner}</td>"]
            inner = f"<table><tr>{''.join(cells if rng.random() < 0.7 else cells[::-1])}</tr></table>"
        elif shell >= 0.86:
            tag = rng.choice(["div", "div", "center", "section"])
            inner = f"<{tag}>{inner}</{tag}>"
        elif not plain:
            inner = around("content post entry article main-content post-body entry-content article-body story", inner, "div div section")
        if not plain and rng.random() < 0.25:
            inner = f"<main>{inner}</main>"
        if plain and rng.random() < 0.7:
            some = rng.random()
            page = (noise("plain menu") if some < 0.7 else "") + inner + (noise("plain foot") if some > 0.3 else "")
            pages.append((f"<html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>", blocks))
            continue
        kinds = ["menu", "head", "ad", "notice", "side", "form", "share"]
        before = "".join(noise(k) for k in rng.choices(kinds, k=rng.randint(0, 4)))
        after = "".join(noise(k) for k in rng.choices([*kinds[2:], "comments", "comments"], k=rng.randint(0, 4)))
        page = f"{before}{inner}{after}{noise('foot') if rng.random() < 0.85 else ''}"
        if rng.random() < 0.3:
            page = around("wrapper container page layout site", page, "div")
        pages.append((f"<html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>", blocks))
    return pages


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every page (all by default) with the main text as ``text``."""
    names = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))  # a few hundred weights
    own = html_col in names
    source = pages.select(*names, *([] if own else [pages[html_col].alias("_he_html")]))
    column = html_col if own else "_he_html"
    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.text(h) for h in texts_of(batch, column)]
            yield pa.record_batch({**{c: batch.column(c) for c in names}, "text": pa.array(texts, pa.string())})

    return source.mapInArrow(run, carried + "text string")
