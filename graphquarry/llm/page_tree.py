"""Block trees of HTML pages: a forgiving reader, and numbers that describe each node of many pages at once."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of HTML: elements whose content is no text, elements without an end tag, elements within a line.
RAW = ("script", "style", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "title", "textarea", "svg", "math", "object", "select", "audio", "video", "canvas")
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img map area center-text".split()
)
#: What begins after an open paragraph has ended, as no paragraph can hold it.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
#: What an element ends when it begins, and where the search for it stops.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",)}
BARRIERS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)}
SCOPE = frozenset("table td th caption button".split())
#: Deeper elements stand beside one another at this depth.
MOST_DEPTH = 512

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^a-zA-Z>][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</>"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)(?:>|\Z)",
    re.S,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
ATTR = re.compile(r"""(?i)(?<![\w-])(class|id|role|data-main|aria-hidden|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Kinds of elements that a tree asks for, a number each.
KINDS = ("#text", "p", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "ul", "li", "dl", "table", "td", "heading", "quote", "pre", "figure", "button", "other")
KIND_OF = {"#text": 0, "p": 1, "div": 2, "section": 3, "article": 4, "main": 5, "nav": 6, "menu": 6, "aside": 7, "header": 8, "footer": 9, "form": 10, "fieldset": 10, "ul": 11, "ol": 11, "li": 12, "dl": 13, "dt": 13, "dd": 13, "table": 14, "tbody": 14, "thead": 14, "tr": 14, "td": 15, "th": 15, "caption": 15, **{f"h{k}": 16 for k in range(1, 7)}, "blockquote": 17, "pre": 18, "figure": 19, "figcaption": 19, "button": 20, "input": 20, "option": 20, "dialog": 20}
#: Groups of attribute tokens by how they begin (a trailing $: the whole token).
GROUPS = {
    "menu": "nav menu breadcrumb pagination pager toolbar topbar skip$ toc$ tabs$ crumb",
    "header": "header masthead banner logo brand hero$ top$ sitename",
    "footer": "footer foot$ copyright legal colophon imprint bottom$",
    "aside": "sidebar aside complementary widget rail$ column$ secondary extra$ teaser sticky",
    "notice": "cookie consent notice gdpr alert popup modal overlay dialog toast privacy disclaimer paywall banner",
    "advert": "ad$ ads$ advert adslot sponsor promo adsense dfp$ outbrain taboola commercial",
    "form": "form$ search newsletter subscribe signup login register contact input",
    "comment": "comment disqus respond reply replies discussion reader feedback thread$ review",
    "related": "related share social recommend more$ popular trending tags$ tag$ follow also$ next$ prev previous",
    "content": "content article post$ posts$ entry story body$ text$ main$ prose page$ blog document single",
    "title": "title headline heading byline author date$ lead$ summary caption intro$",
}
_EXACT = {t[:-1]: 1 << k for k, words in enumerate(GROUPS.values()) for t in words.split() if t.endswith("$")}
_STARTS = re.compile("|".join(f"(?P<{name}>{'|'.join(t for t in words.split() if not t.endswith('$'))})" for name, words in GROUPS.items() if any(not t.endswith("$") for t in words.split())))
_BIT = {name: 1 << k for k, name in enumerate(GROUPS)}


def token_groups(value: str) -> int:
    """A bit for each group that a token of an attribute's value belongs to."""
    bits = 0
    for token in TOKENS.findall(value):
        token = token.lower()
        found = _STARTS.match(token)
        bits |= _EXACT.get(token, 0) | (_BIT[found.lastgroup] if found else 0)
    return bits


@dataclass
class Nodes:
    """The nodes of one or more pages in page order; a node's subtree is what stands from it up to `end`."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)  # groups of the node's attributes
    above: list[int] = field(default_factory=list)  # and of its ancestors'
    kinds_above: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # code points of a text that are in links
    links: list[int] = field(default_factory=list)
    images: list[int] = field(default_factory=list)
    pages: list[int] = field(default_factory=list)  # where each page begins


def read_page(page: str, to: Nodes) -> None:
    """Add the nodes of a page. Texts are the runs between beginnings and ends of block elements, white space made one blank."""
    base = len(to.parent)
    to.pages.append(base)
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    state = {"linked": 0, "link": None, "links": 0, "images": 0}

    def add(kind: int, own: int, label: int | None, text: str | None = None) -> int:
        k = len(to.parent)
        up = stack[-1][1] if stack else -1
        to.parent.append(up)
        to.end.append(k + 1)
        to.depth.append(len(stack))
        to.kind.append(kind)
        to.own.append(own)
        to.above.append(to.above[up] | to.own[up] if up >= 0 else 0)
        to.kinds_above.append(to.kinds_above[up] | 1 << to.kind[up] if up >= 0 else 0)
        to.label.append((to.label[up] if up >= 0 else 0) if label is None else label)
        to.text.append(text)
        to.linked.append(state["linked"] if text is not None else 0)
        to.links.append(state["links"] if text is not None else 0)
        to.images.append(state["images"] if text is not None else 0)
        return k

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                add(0, 0, None, text)
                state["images"] = 0
        state["linked"], state["links"] = 0, 0

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            to.end[stack.pop()[1]] = len(to.parent)
        if state["link"] is not None and state["link"] > depth:
            state["link"] = None

    def close_to(names, barriers) -> None:
        """End the innermost open element of these names, if it is within the innermost barrier."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                close(k)
                return
            if stack[k][0] in barriers:
                return

    def say(text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if state["link"] is not None:
            state["linked"] += len(text)

    stack.append(("#root", add(KINDS.index("other"), 0, None)))
    at, n = 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        name = found["start"]
        if name is None:
            name = (found["end"] or "").lower()
            if name == "a":
                state["link"] = None
            elif name == "br":
                pieces.append("\n")
            elif name and name not in INLINE and name not in VOID:
                if name == "p" and not any(x[0] == "p" for x in stack):
                    flush()
                close_to((name,) if name not in ("h1", "h2", "h3", "h4", "h5", "h6") else ("h1", "h2", "h3", "h4", "h5", "h6"), SCOPE - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else ())
            continue
        name = name.lower()
        if name in RAW_END:
            attrs = found["attrs"]
            if not (attrs.endswith("/") and name in ("svg", "math")):
                ended = RAW_END[name].search(page, at)
                at = ended.end() if ended else n
            if name not in ("script", "style", "template", "noscript", "title"):
                pieces.append(" ")
            continue
        if name == "a":
            state["link"] = len(stack)
            state["links"] += 1
        elif name == "br":
            pieces.append("\n")
        elif name == "img":
            state["images"] += 1
        elif name not in INLINE and name != "wbr":
            flush()
            if name in ENDS_P:
                close_to(("p",), SCOPE)
            if name in ENDS:
                names = ENDS[name]
                for _ in names:
                    close_to(names, BARRIERS.get(name, ("table",)))
            own, label = 0, None
            if found["attrs"].strip():
                for key, a, b, c in ATTR.findall(found["attrs"]):
                    value = a or b or c
                    if key.lower() == "data-main":
                        label = int(value == "1")
                    else:
                        own |= token_groups(value)
            if len(stack) >= MOST_DEPTH:
                close(MOST_DEPTH - 1)
            k = add(KIND_OF.get(name, len(KINDS) - 1), own, label)
            if name not in VOID:
                stack.append((name, k))
    close(0)


def texts_of(nodes: Nodes, keep: np.ndarray) -> list[str]:
    """The kept texts of each page, joined by a blank."""
    edges = [*nodes.pages, len(nodes.parent)]
    return [" ".join(t for k in range(a, b) if (t := nodes.text[k]) is not None and keep[k]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def describe(nodes: Nodes) -> np.ndarray:
    """A row of numbers for each node: its kind and its ancestors', attribute tokens, sums and densities of its subtree,
    depth, and how it stands among its siblings and in the page."""
    n = len(nodes.parent)
    parent, end, depth, kind = (np.array(x, np.int64) for x in (nodes.parent, nodes.end, nodes.depth, nodes.kind))
    own, above, kinds_above = (np.array(x, np.int64) for x in (nodes.own, nodes.above, nodes.kinds_above))
    up = np.where(parent < 0, np.arange(n), parent)
    texts = [t or "" for t in nodes.text]
    chars = np.array([len(t) for t in texts], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], float)
    stops = np.array([sum(map(t.count, ".,;:!?")) for t in texts], float)
    ended = np.array([t[-1:] in (".", "!", "?", "…", ":", "”", '"') and len(t) > 0 for t in texts], float)
    digits = np.array([sum(map(t.count, "0123456789|©·")) for t in texts], float)
    leaf = (kind == 0).astype(float)
    is_kind = lambda *names: np.isin(kind, [KINDS.index(x) for x in names]).astype(float)
    base = np.stack([chars, words, np.minimum(np.array(nodes.linked, float), chars), np.array(nodes.links, float), np.array(nodes.images, float), stops, ended, digits, leaf, np.ones(n), is_kind("p"), is_kind("li"), is_kind("heading"), is_kind("button", "form"), chars * (chars >= 80)], axis=1)
    sums = np.concatenate([np.zeros((1, base.shape[1])), np.cumsum(base, axis=0)])
    total = sums[end] - sums[:-1]
    page = np.searchsorted(nodes.pages, np.arange(n), "right") - 1
    first = np.array(nodes.pages)[page] if n else np.zeros(0, np.int64)
    of_page, of_up = total[first], total[up]
    c, w = total[:, 0], np.maximum(total[:, 1], 1)
    # places among siblings: children of a node in order
    order = np.lexsort((np.arange(n), parent))
    begins = np.flatnonzero(np.diff(parent[order], prepend=-2)) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    place, count = np.empty(n), np.empty(n)
    place[order] = np.arange(n) - np.repeat(begins, sizes)
    count[order] = np.repeat(sizes, sizes)
    neighbour = lambda step: _beside(c, order, parent, step)
    mean = (of_up[:, 0] - chars[up]) / np.maximum(count, 1)
    same = np.zeros(n)
    if n:
        pairs, inverse = np.unique(parent * len(KINDS) + kind, return_inverse=True)
        same = np.bincount(inverse)[inverse].astype(float)
    columns = [
        *(kind == k for k in range(len(KINDS))), *((kinds_above >> k) & 1 for k in range(3, 18)), *(kind[up] == k for k in (1, 2, 3, 4, 11, 12)),
        *((own >> k) & 1 for k in range(len(GROUPS))), *((above >> k) & 1 for k in range(len(GROUPS))),
        c, w, total[:, 2] / np.maximum(c, 1), total[:, 3], total[:, 4], total[:, 5] / w, total[:, 6] / np.maximum(total[:, 8], 1), total[:, 7] / np.maximum(c, 1), total[:, 8], total[:, 9],
        c / total[:, 9], c / np.maximum(total[:, 8], 1), total[:, 10], total[:, 11], total[:, 12], total[:, 13], total[:, 14], total[:, 14] / np.maximum(c, 1),
        c / np.maximum(of_page[:, 0], 1), total[:, 14] / np.maximum(of_page[:, 14], 1), total[:, 10] / np.maximum(of_page[:, 10], 1), c / np.maximum(of_up[:, 0], 1), of_up[:, 0], of_up[:, 2] / np.maximum(of_up[:, 0], 1), of_up[:, 14], of_up[:, 10],
        depth, place, place / count, count, same, same / count, neighbour(-1), neighbour(1), mean, c / np.maximum(mean, 1),
        (sums[:-1, 0] - sums[first, 0]) / np.maximum(of_page[:, 0], 1), (sums[end, 0] - sums[first, 0]) / np.maximum(of_page[:, 0], 1), of_page[:, 0], of_page[:, 8],
    ]
    return np.stack([np.asarray(x, np.float32) for x in columns], axis=1) if n else np.zeros((0, len(columns)), np.float32)


def _beside(values: np.ndarray, order: np.ndarray, parent: np.ndarray, step: int) -> np.ndarray:
    """The value of the sibling before (-1) or after (1) each node; -1 where there is none."""
    out, n = np.full(len(values), -1.0), len(values)
    if n > 1:
        a, b = (order[1:], order[:-1]) if step < 0 else (order[:-1], order[1:])
        same = parent[a] == parent[b]
        out[a[same]] = values[b[same]]
    return out
