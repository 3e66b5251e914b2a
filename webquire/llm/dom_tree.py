"""A page as DOM nodes and text runs, with the features of each block node."""

from __future__ import annotations

import html
import math
import re
import sys
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title datalist".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
BLOCKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BARRIERS = frozenset("ul ol dl table menu html body article section div aside main".split())
# Words in class, id and role that hint at content or at something else.
HINTS_CONTENT = frozenset("article articlebody body content entry hentry main page post prose story text".split())
HINTS_OTHER = {
    "navigation": "breadcrumb breadcrumbs dropdown links menu nav navbar navigation pager pagination skip tabs toolbar topbar topnav",
    "header": "branding head header logo masthead top",
    "footer": "bottom colophon contentinfo copyright fineprint foot footer legal privacy",
    "aside": "aside complementary extra more popular rail recommended related secondary side sidebar teaser trending widget widgets",
    "advert": "ad ads adsense advert advertisement advertorial banner outbrain promo promoted promotion shop skyscraper sponsor sponsored taboola",
    "notice": "alert consent cookie cookies dialog disclaimer gdpr hidden modal newsletter notice notification paywall popup signup subscribe subscription warning",
    "comments": "combx comment commentlist comments community discuss discussion disqus feedback reactions remark replies reply respond responses reviews shoutbox thread",
    "share": "author button byline email follow meta rating rss share sharing social tags tools",
    "form": "form login search",
}
_OTHER = {word: 1 << i for i, words in enumerate(HINTS_OTHER.values()) for word in words.split()}

# a quote delimits a value only behind "="; one anywhere else, or without its mate, is a character like others
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S
)
_HINT = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_KEEP = re.compile(r"\bdata-keep=([01])")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"[\s]+")
_MARKS = re.compile(r"[.,;:!?]")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    start: int  # text characters before it
    good: int = 0  # words that hint at content
    bad: int = 0  # groups of hints at something else, as bits
    hidden: bool = False
    keep: str | None = None
    children: list[int] = field(default_factory=list)
    own: int = 0
    runs: int = 0
    linked: int = 0
    tags: int = 0


@dataclass
class Page:
    """``nodes`` in page order (parents first); ``runs``: texts of blocks in page order, each with its node."""

    nodes: list[Node]
    runs: list[tuple[int, str]]


def _hints(attrs: str) -> tuple[int, int]:
    """How many words hint at content, and the groups of ``HINTS_OTHER`` that are named, as bits."""
    words = {p.lower() for m in _HINT.findall(attrs) for p in _PARTS.findall("".join(m))} if attrs else ()
    groups = 0
    for w in words:
        groups |= _OTHER.get(w, 0)
    return len(HINTS_CONTENT.intersection(words)), groups


def parse(text: str) -> Page:
    """Nodes and runs of a page. Markup cut off by the end of the page is dropped; omitted end tags are implied."""
    nodes = [Node("#", -1, 0, 0)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#", 0)]  # open elements with their block node
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack the elements of a tag are
    solid, fences = [0], [0]  # where those are that are not inline, and those that implied end tags do not cross
    pieces: list[str] = []
    links, silent, chars, linked = 0, 0, 0, 0

    def close_run() -> None:
        nonlocal chars, linked
        if pieces:
            run = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if run:
                node = nodes[stack[-1][1]]
                runs.append((stack[-1][1], run))
                node.own += len(run)
                node.runs += 1
                node.linked += min(linked, len(run))
                chars += len(run)
        linked = 0

    def pop(k: int) -> None:
        nonlocal links, silent
        if any(t not in INLINE for t, _ in stack[k:]):
            close_run()
        for t, _ in stack[k:]:
            links -= t == "a"
            silent -= t in SILENT
            places[t].pop()
        del stack[k:]
        for marks in (solid, fences):
            while marks[-1] >= k:
                marks.pop()

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            pieces.append(piece)
            if links:
                linked += len(piece)

    at = 0
    while m := _TOKEN.search(text, at):
        add(text[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if places[tag]:
                pop(places[tag][-1])
            continue
        if tag in BLOCKS_P and stack[solid[-1]][0] == "p":
            pop(solid[-1])
        if tag in CLOSES:
            within = [x[i] for x in (places[t] for t in CLOSES[tag]) if (i := bisect_right(x, fences[-1])) < len(x)]
            if within:
                pop(min(within))
        if tag == "br":
            add(" ")
        if tag in VOID:
            if tag == "hr":
                close_run()
            continue
        owner = stack[-1][1]
        if tag not in INLINE:
            close_run()
            if not silent and tag not in SILENT:
                attrs = m["attrs"]
                good, bad = _hints(attrs)
                keep = _KEEP.search(attrs)
                nodes.append(Node(tag, owner, nodes[owner].depth + 1, chars, good, bad, bool(attrs and _HIDDEN.search(attrs)), keep and keep[1]))
                nodes[owner].children.append(len(nodes) - 1)
                owner = len(nodes) - 1
        else:
            nodes[owner].tags += 1
        if m["attrs"].endswith("/") and tag not in INLINE and tag in SILENT:
            continue
        places[tag].append(len(stack))
        if tag not in INLINE:
            solid.append(len(stack))
        if tag in BARRIERS:
            fences.append(len(stack))
        stack.append((tag, owner))
        links += tag == "a"
        silent += tag in SILENT
        if tag in RAW:  # nothing but its end tag counts
            end = re.compile(rf"</{tag}(?![^\s/>])", re.I).search(text, at)
            at = end.start() if end else len(text)
    add(text[at:].removesuffix("<"))
    close_run()
    return Page(nodes, runs)


# Element groups as one feature each.
GROUPS = (
    ("article",), ("main",), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"),
    ("table", "thead", "tbody", "tfoot", "tr", "td", "th"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("blockquote", "pre", "figure", "figcaption"), ("#", "html", "body"),
)
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}
N_FEATURES = len(GROUPS) + 36 + 2 * len(HINTS_OTHER)


def features(page: Page) -> np.ndarray:
    """A row per node: element, depth, subtree density, attribute tokens of itself and its ancestors, siblings, position."""
    nodes = page.nodes
    n = len(nodes)
    size, linked, tags, runs, paras, bad_chars, marks = ([0] * n for _ in range(7))
    for i, x in enumerate(nodes):
        size[i], linked[i], tags[i], runs[i] = x.own, x.linked, x.tags + 1, x.runs
        paras[i] = x.tag == "p"
    for owner, run in page.runs:
        marks[owner] += len(_MARKS.findall(run))
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        x = nodes[i]
        if x.bad and not x.good or x.tag in ("nav", "aside", "footer", "form"):
            bad_chars[i] = size[i]
        size[p] += size[i]
        linked[p] += linked[i]
        tags[p] += tags[i]
        runs[p] += runs[i]
        paras[p] += paras[i]
        bad_chars[p] += bad_chars[i]
        marks[p] += marks[i]
    total = max(1, size[0])
    alike = Counter((x.parent, x.tag) for x in nodes)
    out = np.zeros((n, N_FEATURES))
    up = [(0, 0, 0, 0, 0, 0)] * n  # hints and elements of the ancestors; the nearest hint and how far up it is
    bits = range(len(HINTS_OTHER))
    k = len(GROUPS)
    rank = [0] * n
    for i, x in enumerate(nodes):
        row = out[i]
        if (g := _GROUP.get(x.tag)) is not None:
            row[g] = 1
        if i:
            good, bad, inside, framed, near, far = up[x.parent]
            p = nodes[x.parent]
            sib = p.children
            j = rank[i]
            before = size[sib[j - 1]] if j else 0
            after = size[sib[j + 1]] if j + 1 < len(sib) else 0
            same = alike[x.parent, x.tag]
        else:
            good = bad = inside = framed = near = far = before = after = same = j = 0
            p, sib = x, [0]
        own = (x.good > 0) - (x.bad > 0)
        if own or x.bad:
            near, far = own, 0
        else:
            far += 1
        up[i] = (good + x.good, bad | x.bad, inside or x.tag in ("article", "main"), framed or x.tag in ("nav", "aside", "footer", "form", "header"), near, far)
        for r, c in enumerate(x.children):
            rank[c] = r
        s = size[i]
        row[k:] = (
            x.depth, math.log1p(s), math.log1p(x.own), linked[i] / max(1, s), tags[i] / max(1.0, s / 100), s / max(1, runs[i]), marks[i] / max(1.0, s / 100),
            math.log1p(paras[i]), s / total, s / max(1, size[x.parent] if i else s), same, j / len(sib), len(sib), x.start / total, (x.start + s) / total,
            math.log1p(before), math.log1p(after), x.good, x.bad.bit_count(), good, bad.bit_count(), inside, framed, x.hidden, bad_chars[i] / max(1, s),
            p.bad.bit_count(), p.good, x.own / max(1, x.runs), p.tag in ("article", "main"), p.tag in ("div", "section"), math.log1p(size[x.parent] if i else s),
            linked[x.parent if i else 0] / max(1, size[x.parent if i else 0]), paras[x.parent if i else 0] / max(1, runs[x.parent if i else 0]), bad + good + x.bad + x.good == 0,
            near, far, *(bad >> b & 1 for b in bits), *(x.bad >> b & 1 for b in bits),
        )
    return out


def labels(page: Page) -> np.ndarray:
    """1 for nodes that hold kept text, from the marks ``data-keep`` of generated pages."""
    state = ["0"] * len(page.nodes)
    y = np.zeros(len(page.nodes), dtype=np.int64)
    for i, x in enumerate(page.nodes):
        state[i] = x.keep or (state[x.parent] if i else "0")
        y[i] = state[i] == "1" and x.own > 0
    for i in range(len(page.nodes) - 1, 0, -1):
        y[page.nodes[i].parent] |= y[i]
    return y


# Text elements without a hint or much link text: below a kept node they are kept by this advantage in log-odds.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption".split())
ADVANTAGE = 0.8


def decode(page: Page, probability: np.ndarray) -> list[bool]:
    """Kept or dropped for every node, so that nothing below a dropped node is kept: the best labelling under that rule.

    A node weighs by its own text; one without text has a small weight. Dropping a node drops its subtree. Since a node
    is kept only below a kept one, ``ADVANTAGE`` is the score of that edge.
    """
    nodes = page.nodes
    n = len(nodes)
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    weight = np.array([math.log1p(x.own) if x.own else 0.3 for x in nodes])
    edge = np.array([ADVANTAGE * (x.tag in TEXT and not x.bad and 2 * x.linked <= x.own) for x in nodes])
    keep, drop = (weight * (np.log(p) + edge)).tolist(), (weight * np.log(1 - p)).tolist()
    best = [False] * n
    for i in range(n - 1, -1, -1):  # children come after their parent
        best[i] = i == 0 or keep[i] > drop[i]
        if i:
            parent = nodes[i].parent
            keep[parent] += keep[i] if best[i] else drop[i]
            drop[parent] += drop[i]
    for i in range(1, n):
        best[i] = best[i] and best[nodes[i].parent]
    return best


def kept_text(page: Page, kept: list[bool]) -> str:
    """Runs of kept nodes, one per line."""
    return "\n".join(run for owner, run in page.runs if kept[owner])
