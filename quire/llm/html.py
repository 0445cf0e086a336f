"""Main text of web pages: boosted trees score the nodes of the document tree, decoded so that no kept node lies in a dropped one.

The trees are trained on pages that ``sample_pages`` makes from templates, where each region's part is known; no page
of the table that is extracted is looked at. A node's features are of its tag, its attributes' words, its ancestors,
the density of text and links below it, its depth, place and siblings. Decoding takes the set of nodes with the
highest sum of log-odds among those closed under parents.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.boosting import Trees, boost
from quire.llm.common import raw_texts, text_of

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
BORDER = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s=\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
HEAD_END = re.compile(r"</head\s*>|<body[\s>]", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
UNSEEN = frozenset("head script style template noscript svg math iframe object canvas audio video title noframes noembed".split())
RAW = frozenset("script style textarea title noframes noembed iframe xmp".split())
#: Elements that end an open one of their group.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table select body html article section div nav".split())

TAGS = "article main section div p h1 h2 h3 ul ol li nav header footer aside form table td blockquote pre figure figcaption button label body dl".split()
GROUPS = {
    "main": "article content main post entry body story text page prose read",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar tabs toc pagination pager links",
    "head": "header head masthead banner logo branding title hero",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside widget related recommended more popular trending teaser rail",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion dfp adsense banner",
    "note": "cookie cookies notice consent gdpr popup modal overlay newsletter subscribe alert warning message signup paywall",
    "talk": "comment comments disqus reply replies discussion respond thread feedback reviews",
    "share": "share social sharing follow author byline meta tags tagged",
    "form": "form login search input register contact",
}
_GROUP = {w: i for i, words in enumerate(GROUPS.values()) for w in words.split()}
_TAG = {t: i for i, t in enumerate(TAGS)}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SIGN = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "children", "groups", "label", "runs", "hidden")

    def __init__(self, tag: str, parent: int, attributes: str = ""):
        self.tag, self.parent, self.children, self.runs, self.label, self.hidden = tag, parent, [], [], None, False
        self.groups = [0] * len(GROUPS)
        if attributes and "=" in attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    for w in _WORDS.findall(value):
                        if (g := _GROUP.get(w.lower())) is not None:
                            self.groups[g] += 1
                elif name == "style" and "display:none" in value.replace(" ", "").lower():
                    self.hidden = True
                elif name == "data-part":
                    self.label = value == "main"
        if attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
            self.hidden = True


class Run:
    """Text between two borders of blocks: its node, its characters, and those of them in links."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: int, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


class Marks:
    """The comments and tags of a page, from left to right; what was read in vain is remembered, so all of them take time in proportion to the page."""

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag; one in a quoted value doesn't, as long as quotes lead to an end at all."""
        here = at
        while self.quoted:
            found = BORDER.search(self.page, here)
            if found is None:
                self.quoted = False  # quotes swallow the rest of the page: from here on they are signs like others
                break
            i = found.start()
            if self.page[i] == ">":
                return i
            before = i - 1
            while before > at and self.page[before].isspace():
                before -= 1
            closing = self.page.find(self.page[i], i + 1) if self.page[before] == "=" else i
            if closing < 0:
                self.quoted = False
                break
            here = closing + 1
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" of an end tag, name, attributes) of the first mark from a place on; the name of what is no tag is empty."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= len(page):
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if start > self.last:
                return None
            if found := NAME.match(page, start + 1):
                end = self.tag_end(found.end())
                return start, end + 1, found[1], found[2], page[found.end() : end]
            if page[start + 1] in "!?/":
                return start, page.find(">", start) + 1, "", "", ""
            at = start + 1


class Open:
    """The open elements: names with the numbers of their nodes (-1 for those that are none), and for each name the places where it stands, so nothing is sought among them."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]

    def push(self, tag: str, node: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, node))
        self.places.setdefault(tag, []).append(at)
        if node >= 0:
            self.blocks.append(at)
        if tag in SCOPE:
            self.scopes.append(at)

    def pop(self) -> tuple[str, int]:
        tag, node = self.stack.pop()
        at = len(self.stack)
        for places in (self.places.get(tag), self.blocks, self.scopes):
            if places and places[-1] == at:
                places.pop()
        return tag, node

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def forget(self, tag: str) -> None:
        """The last open one of a name no longer is one."""
        at = self.places[tag].pop()
        self.stack[at] = ("", self.stack[at][1])


def parse(page: str) -> tuple[list[Node], list[Run]]:
    """The block nodes of a page, parents first, and its runs of text in order, with references decoded and white space as single spaces. Time grows with the page alone, however broken."""
    nodes, runs = [Node("html", -1)], []
    opened, marks = Open(), Marks(page)
    pieces: list[str] = []
    linked, links, current, at, n, heads = 0, 0, 0, 0, len(page), True

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                runs.append(Run(current, text, min(linked, len(text))))
                nodes[current].runs.append(len(runs) - 1)
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal current, links
        while len(opened.stack) > to:
            tag, node = opened.pop()
            links -= tag == "a"
            if node >= 0:
                flush()
                current = nodes[node].parent
        current = max(current, 0)

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text.strip())

    while at < n:
        found = marks.next(at)
        if found is None:
            say(page[at:])
            break
        start, end, close, name, attributes = found
        if start > at:
            say(page[at:start])
        at = end
        if not name:
            continue
        tag = name.lower()
        if close:
            i = opened.last(tag)
            if i and not (tag in INLINE and i < opened.blocks[-1]):  # an inline end does not close blocks; its start stays open
                pop(i)
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag not in VOID and not attributes.endswith("/"):
                if tag == "a" and links:
                    opened.forget("a")
                    links -= 1
                opened.push(tag, -1)
                links += tag == "a"
            continue
        if tag in RAW or tag in UNSEEN:
            if tag != "head":
                ending = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                inner, at = page[at : ending.start() if ending else n], ending.end() if ending else n
                if tag not in UNSEEN:
                    say(inner)
                continue
            ending = HEAD_END.search(page, at) if heads else None
            if ending:
                at = ending.end() if ending.group().startswith("</") else ending.start()
            else:
                heads = False
            continue
        if tag in CLOSES_P:
            if opened.stack[opened.blocks[-1]][0] == "p":
                pop(opened.blocks[-1])
        elif tag in SAME:
            while (i := max(opened.last(t) for t in SAME[tag])) > opened.scopes[-1]:
                pop(i)
                if tag not in ("tr", "tbody"):
                    break
        flush()
        if tag in VOID or attributes.endswith("/"):
            continue
        nodes.append(Node(tag, current, attributes))
        nodes[current].children.append(len(nodes) - 1)
        current = len(nodes) - 1
        opened.push(tag, current)
    pop(1)
    flush()
    return nodes, runs


def features(nodes: list[Node], runs: list[Run]) -> np.ndarray:
    """A row for each node."""
    n = len(nodes)
    chars, linked, signs, below, own, first = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    depth, length = [0] * n, 0
    for r in runs:
        own[r.node] += len(r.text)
        linked[r.node] += r.linked
        signs[r.node] += len(_SIGN.findall(r.text))
    starts: dict[int, int] = {}
    for r in runs:
        starts.setdefault(r.node, length)
        length += len(r.text)
    for i in range(n):
        chars[i] = own[i]
        first[i] = starts.get(i, length)
    groups = [g.groups for g in nodes]
    above: list[list[int]] = [[0] * len(GROUPS) for _ in range(n)]
    kinds = [0] * n  # bits for ancestors: article, main, nav, header, footer, aside, form
    marks = {"article": 1, "main": 2, "nav": 4, "header": 8, "footer": 16, "aside": 32, "form": 64}
    for i in range(1, n):
        up = nodes[i].parent
        depth[i] = depth[up] + 1
        above[i] = [a + min(1, b) for a, b in zip(above[up], groups[up])]
        kinds[i] = kinds[up] | marks.get(nodes[up].tag, 0)
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        chars[up] += chars[i]
        linked[up] += linked[i]
        signs[up] += signs[i]
        below[up] += below[i]
        first[up] = min(first[up], first[i])
    rank, counts = [0] * n, [{} for _ in range(n)]  # place among the siblings; of each node, its children by tag
    for i in range(n):
        for k, j in enumerate(nodes[i].children):
            rank[j] = k
            counts[i][nodes[j].tag] = counts[i].get(nodes[j].tag, 0) + 1
    total, out = max(1, length), np.zeros((n, 16 + len(TAGS) + 2 * len(GROUPS) + len(marks)))
    for i, node in enumerate(nodes):
        c = max(1, chars[i])
        up = node.parent
        beside, alike, near = (len(nodes[up].children), counts[up][node.tag], chars[up] - own[up] - chars[i]) if up >= 0 else (1, 1, 0)
        row = [
            math.log1p(chars[i]), math.log1p(own[i]), linked[i] / c, signs[i] / c, math.log(c / below[i]), math.log(below[i]), depth[i],
            rank[i] / beside, math.log(beside), alike / beside, math.log1p(near / max(1, beside - 1)),
            chars[i] / total, first[i] / total, chars[i] / max(1, chars[up] if up >= 0 else c), len(node.children), node.hidden,
        ]
        tag = [0] * len(TAGS)
        if (t := _TAG.get(node.tag)) is not None:
            tag[t] = 1
        out[i] = row + tag + groups[i] + above[i] + [kinds[i] >> k & 1 for k in range(len(marks))]
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: the set, closed under parents, with the highest sum of log-odds; the root always is."""
    best = odds.astype(float).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and best[i] > 0 and not nodes[i].hidden
    return kept


def _prose(rng: random.Random, words: int) -> str:
    out, left = [], words
    while left > 0:
        k = min(left, rng.randint(3, 18))
        sentence = ["".join(rng.choice("the on er ra li mo ti sa ven dor ka pel un ist que men".split()) for _ in range(rng.randint(1, 3))) for _ in range(k)]
        out.append(" ".join(sentence).capitalize() + rng.choice(["...", ".", ".", ".", ",", "!", "?"])[:1])
        left -= k
    return " ".join(out)


def sample_pages(count: int = 900, seed: int = 7) -> Iterator[str]:
    """Pages from templates; data-part on a region says whether it is of the main text."""
    for number in range(count):
        rng = random.Random(f"{seed}-{number}")
        named = rng.random() < 0.75  # the page's authors give classes

        def box(part: str, names: list[str], tags: list[str], inner: str, rng=rng, named=named) -> str:
            tag = rng.choice(tags)
            if tag == "div" and not named and part == "rest":
                named = rng.random() < 0.7
            name = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"' if named or tag == "div" and part == "rest" and rng.random() < 0.5 else ""
            return f'<{tag}{name} data-part="{part}">{inner}</{tag}>'

        def links(k: int, rng=rng) -> str:
            items = [f'<a href="/{i}">{_prose(rng, rng.randint(1, 3))}</a>' for i in range(k)]
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

        def ad(rng=rng) -> str:
            return box("rest", ["ad", "ads", "advert", "ad-slot", "sponsored", "promo-box"], ["div", "div", "aside"], _prose(rng, rng.randint(2, 40)))

        def notice(rng=rng) -> str:
            return box("rest", ["cookie-notice", "notice", "newsletter", "consent-popup", "alert", "subscribe"], ["div", "section"], f"<p>{_prose(rng, rng.randint(4, 40))}</p><button>OK</button>")

        def talk(rng=rng) -> str:
            said = [f'<{t} class="{rng.choice(["comment", "reply", "c-item"])}"><p>{_prose(rng, rng.randint(3, 60))}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 6))]
            return box("rest", ["comments", "comment-list", "discussion", "disqus_thread", "respond"], ["div", "section"], f"<h2>{_prose(rng, 2)}</h2>" + "".join(said))

        def form(rng=rng) -> str:
            return f'<form data-part="rest"{rng.choice(["", " class=search", " id=login"])}><label>{_prose(rng, 2)}</label><input name="q"><p>{_prose(rng, rng.randint(0, 15))}</p><button>{_prose(rng, 1)}</button></form>'

        def side(rng=rng) -> str:
            return box("rest", ["sidebar", "related", "widget", "rail", "popular-posts"], ["aside", "aside", "div"], f"<h3>{_prose(rng, 2)}</h3>" + rng.choice([links(rng.randint(2, 8)), f"<p>{_prose(rng, rng.randint(5, 60))}</p>"]))

        def share(rng=rng) -> str:
            return box("rest", ["share", "social-links", "tags", "breadcrumb"], ["div", "ul", "nav"], links(rng.randint(2, 5)))

        body = [f"<h1>{_prose(rng, rng.randint(1, 12))}</h1>"] if rng.random() < 0.9 else []
        if body and rng.random() < 0.15:
            body = [f"<header>{body[0]}</header>"]
        for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8, 14])):
            kind, words = rng.random(), rng.choice([1, 2, 4, 8, 20, 40, 90, 160])
            if kind < 0.72:
                body.append(f"<p>{_prose(rng, words)}" + ("</p>" if rng.random() < 0.9 else ""))
            elif kind < 0.8:
                body.append(f"<p><b>{_prose(rng, words)}<br>")
            elif kind < 0.86:
                body.append(f"<h2>{_prose(rng, rng.randint(1, 6))}</h2>")
            elif kind < 0.91:
                body.append("<ul>" + "".join(f"<li>{_prose(rng, rng.randint(2, 20))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.94:
                body.append(f"<blockquote><p>{_prose(rng, 20)}</p></blockquote>")
            elif kind < 0.96:
                body.append(f"<pre>{_prose(rng, 12)}</pre>")
            elif kind < 0.98:
                body.append("<table>" + "".join(f"<tr><td>{_prose(rng, 2)}</td><td>{_prose(rng, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                body.append(f'<p>{_prose(rng, words)} <a href="/x">{_prose(rng, 2)}</a> {_prose(rng, words)}</p>')
        if rng.random() < 0.3:  # hardly more than a title
            words = _prose(rng, rng.choice([1, 2, 2, 3, 4, 6, 9]))
            body = [f"<h1>{words}</h1>", rng.choice([f"<p>{words}</p>", f"<p><b>{words}<br>", f"<p>{_prose(rng, rng.randint(1, 4))}"])]
        for extra in (ad, notice, share, side, form, talk):
            if rng.random() < 0.15:
                body.insert(rng.randint(1, len(body)), extra())
        tags = ["article", "article", "article", "main", "div", "section"]
        inner = box("main", ["article", "post", "entry-content", "content", "story-body", "main"], tags, "".join(body))
        if rng.random() < 0.3:
            inner = rng.choice(["<main>{}</main>", '<div class="container">{}</div>', '<div id="page">{}</div>', "<section>{}</section>"]).format(inner + (side() if rng.random() < 0.5 else ""))
        top = [box("rest", ["menu", "navbar", "nav", "topbar"], ["nav", "nav", "div", "header"], links(rng.randint(2, 9)))] if rng.random() < 0.85 else []
        if rng.random() < 0.5:
            top.insert(rng.randint(0, len(top)), box("rest", ["header", "masthead", "banner", "logo"], ["header", "header", "div"], rng.choice([f"<p>{_prose(rng, rng.randint(1, 14))}</p>", f"<h2>{_prose(rng, 3)}</h2>" + links(4), _prose(rng, 5)])))
        foot = [box("rest", ["footer", "site-footer", "copyright"], ["footer", "footer", "footer", "div"], rng.choice([f"&copy; {_prose(rng, rng.randint(2, 40))}", links(4), f"<p>{_prose(rng, rng.randint(3, 50))}</p>"]))] if rng.random() < 0.9 else []
        around = [f() for f in (ad, notice, side, form, share) if rng.random() < 0.35]
        after = [talk()] if rng.random() < 0.3 else []
        cut = rng.randint(0, len(around))
        yield "<html><body>" + "".join([*top, *around[:cut], inner, *after, *around[cut:], *foot]) + "</body></html>"


@functools.lru_cache(maxsize=1)
def train(count: int = 900, seed: int = 7) -> Trees:
    """Trees fitted on the nodes of made pages. A node counts as main text if any text in or below it is."""
    xs, ys = [], []
    for page in sample_pages(count, seed):
        nodes, runs = parse(page)
        state: list[bool] = []
        for node in nodes:
            state.append(node.label if node.label is not None else node.parent >= 0 and state[node.parent])
        main = [False] * len(nodes)
        full = [False] * len(nodes)
        for r in runs:
            full[r.node] = True
            main[r.node] |= state[r.node]
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent] |= main[i]
            full[nodes[i].parent] |= full[i]
        keep = np.array(full)
        xs.append(features(nodes, runs)[keep])
        ys.append(np.array(main)[keep])
    return boost(np.vstack(xs), np.concatenate(ys).astype(float))


def extract(pages: list[str], model: Trees) -> list[str]:
    """The main text of each page: kept runs in page order, one line each."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    odds = model.log_odds(np.vstack([features(*p) for p in parsed]))
    out, at = [], 0
    for nodes, runs in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(r.text for r in runs if kept[r.node]))
    return out


def main_text(column: Column, model: Trees | None = None, chunk: int = 4 << 20) -> Column:
    """The main text of a column of pages; a null page is an empty one and has an empty text. Pages are read whole, about chunk bytes at a time."""
    model = model or train()

    @F.arrow_udf("string")
    def made(pages: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for raw in raw_texts(pages):
            held.append(raw.decode("utf-8", "replace"))
            size += len(raw)
            if size >= chunk:
                out += extract(held, model)
                held, size = [], 0
        return pa.array(out + extract(held, model), pa.string())

    return made(text_of(column))


def extract_pages(pages: DataFrame, model: Trees | None = None, html_column: str = "html") -> DataFrame:
    """pages with text (the main text) and n_chars (its code points) in place of columns of those names.

    A null or empty page has an empty text; pages of any length are read whole, in time that grows with them alone;
    repeated rows are kept; an empty table gives none.
    """
    return pages.withColumn("text", main_text(F.col(html_column), model)).withColumn("n_chars", F.char_length("text").cast("long"))
