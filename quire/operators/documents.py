"""Regions, tables and pages as Markdown and HTML; tree distance of tables; words of recognised lines."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import edit_distance, escape_markdown

DROPPED = ("header", "footer")
#: Pairs of tables of one shape from which on they are compared together; numbers that their distances hold at once; longest cells compared together.
TOGETHER, HELD, CELL = 16, 4_000_000, 32
_PLAIN = re.compile(r"<html><body><table>((?:<tr>(?:<td>[^<&\0]*</td>)*</tr>)*)</table></body></html>")


def render_regions(regions: DataFrame, by: str, order: str, kind: str = "type", text: str = "text") -> DataFrame:
    """One Markdown text a page: titles, tables, formulas, figures and text, without headers and footers."""
    t, k = F.col(text), F.col(kind)
    shown = (
        F.when(k == "title", F.concat(F.lit("# "), t)).when(k == "table", t).when(k == "equation", F.concat(F.lit("$$"), t, F.lit("$$")))
        .when(k == "figure", F.concat(F.lit("![]("), t, F.lit(")"))).otherwise(escape_markdown(t))
    )
    kept = regions.filter(~k.isin(*DROPPED)).select(by, F.col(order).alias("o"), shown.alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda s: s["t"]), "\n\n")
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.regexp_replace(whole, r"\n{3,}", "\n\n").alias("markdown"))


def table_html(structure: list[str], cells: list[list[str]]) -> str:
    """Cell tokens put behind each opening of the structure; cells of style alone stay empty."""
    out, at = [], 0
    for token in structure:
        out.append(token)
        if token == "<td>" or token == ">" or token == "<td></td>":
            body = "".join(cells[at]) if at < len(cells) else ""
            if re.sub(r"</?(?:b|i|sup|sub)>", "", body).strip():
                out[-1:] = ["<td>", body, "</td>"] if token == "<td></td>" else [token, body]
            at += 1
    return "".join(out)


def table_grid(structure: list[str], boxes: int) -> list[tuple[int, int, int, int]]:
    """(row, column, rowspan, colspan) of each cell; places that spans cover are passed over; no more cells than boxes."""
    taken: set[tuple[int, int]] = set()
    out: list[tuple[int, int, int, int]] = []
    row, column, spans, is_open = -1, 0, [1, 1], False

    def place() -> None:
        nonlocal column
        if len(out) >= boxes:
            return
        while (row, column) in taken:
            column += 1
        out.append((row, column, *spans))
        taken.update((row + a, column + b) for a in range(spans[0]) for b in range(spans[1]))
        column += spans[1]

    for token in structure:
        found = re.search(r'(row|col)span="?(\d+)', token)
        if token.startswith("<tr"):
            row, column = row + 1, 0
        elif token.startswith("<td"):
            spans, is_open = [1, 1], not token.endswith(">")
            for kind, n in re.findall(r'(row|col)span="?(\d+)', token):
                spans[kind == "col"] = int(n)
            if not is_open:
                place()
        elif is_open and found:
            spans[found[1] == "col"] = int(found[2])
        if is_open and token == ">":
            place()
            is_open = False
    return out


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: list = ["root", "", []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        spans = f"{given.get('rowspan', '1')},{given.get('colspan', '1')}" if tag == "td" else ""
        if self.stack[-1][0] == "td":
            self.stack[-1][1] += f"<{tag}>"
            return
        node = [tag, spans + "|" if tag == "td" else "", []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        if self.stack[-1][0] == "td" and tag != "td":
            self.stack[-1][1] += f"</{tag}>"
        elif self.stack[-1][0] == tag and len(self.stack) > 1:
            self.stack.pop()

    def handle_data(self, data):
        if self.stack[-1][0] == "td":
            self.stack[-1][1] += data


def table_tree(page: str) -> list | None:
    """The first table below a body, as [tag, spans and content, children]."""
    if page and (plain := _PLAIN.fullmatch(page)):  # as the parser would have it
        return ["table", "", [["tr", "", [["td", f"1,1|{c[:-5]}", []] for c in row.split("<td>")[1:]]] for row in plain[1].split("</tr>")[:-1]]]
    parser = _Tree()
    parser.feed(re.sub(r"<!--.*?-->", "", page or "", flags=re.S))
    parser.close()

    def find(node, tag):
        if node[0] == tag:
            return node
        return next((x for c in node[2] if (x := find(c, tag))), None)

    body = find(parser.root, "body")
    return find(body, "table") if body else None


def _flat(tree) -> tuple[list, list[int], list[int]]:
    nodes, left, roots = [], [], {}

    def walk(node) -> int:
        first = None
        for child in node[2]:
            k = walk(child)
            first = k if first is None else first
        nodes.append(node)
        left.append(len(nodes) - 1 if first is None else first)
        return left[-1]

    walk(tree)
    for i, k in enumerate(left):
        roots[k] = i
    return nodes, left, sorted(roots.values())


def tree_distance(a, b, rename) -> float:
    """Least cost of inserting and removing (1 each) and renaming nodes of ordered trees."""
    (x, lx, kx), (y, ly, ky) = _flat(a), _flat(b)
    dist = [[0.0] * len(y) for _ in x]
    for i in kx:
        for j in ky:
            m, n, oi, oj = i - lx[i] + 2, j - ly[j] + 2, lx[i] - 1, ly[j] - 1
            fd = [[0.0] * n for _ in range(m)]
            for p in range(1, m):
                fd[p][0] = fd[p - 1][0] + 1
            for q in range(1, n):
                fd[0][q] = fd[0][q - 1] + 1
            for p in range(1, m):
                for q in range(1, n):
                    if lx[i] == lx[p + oi] and ly[j] == ly[q + oj]:
                        fd[p][q] = min(fd[p - 1][q] + 1, fd[p][q - 1] + 1, fd[p - 1][q - 1] + rename(x[p + oi], y[q + oj]))
                        dist[p + oi][q + oj] = fd[p][q]
                    else:
                        s, t = lx[p + oi] - 1 - oi, ly[q + oj] - 1 - oj
                        fd[p][q] = min(fd[p - 1][q] + 1, fd[p][q - 1] + 1, fd[s][t] + dist[p + oi][q + oj])
    return dist[-1][-1]


def _tokens(content: str) -> list[str] | str:
    return re.findall(r"<[^>]*>|.", content, re.S) if "<" in content else content


def _rename(p, q) -> float:
    if p[0] != q[0] or p[0] == "td" and p[1].split("|")[0] != q[1].split("|")[0]:
        return 1.0
    if p[0] != "td":
        return 0.0
    s, t = (_tokens(n[1].split("|", 1)[1]) for n in (p, q))
    return edit_distance(s, t) / max(len(s), len(t)) if s or t else 0.0


def _size(tree) -> int:
    return sum(1 + _size(c) for c in tree[2])


def table_similarity(found: str | None, truth: str | None) -> float:
    """1 - tree distance over the larger number of descendants; 0 if a side has no table."""
    return table_similarities([found], [truth])[0]


def _edit_distances(a: Sequence, b: Sequence) -> np.ndarray:
    """The edit distance of each two token sequences, the table's cells computed for all pairs at once."""
    codes: dict[str, int] = {}
    x, y = (np.full((len(side), max(map(len, side), default=0)), -1, np.int32) for side in (a, b))
    for out, side in ((x, a), (y, b)):
        for i, tokens in enumerate(side):
            out[i, : len(tokens)] = [codes.setdefault(t, len(codes)) for t in tokens]
    m, n = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
    far, row = np.zeros(len(a), np.int64), [np.full(len(a), j, np.int64) for j in range(y.shape[1] + 1)]
    for i in range(x.shape[1] + 1):
        if i:
            last, row = row, [np.full(len(a), i, np.int64)]
            for j in range(1, y.shape[1] + 1):
                row.append(np.minimum(np.minimum(last[j], row[j - 1]) + 1, last[j - 1] + (x[:, i - 1] != y[:, j - 1])))
        for j, cell in enumerate(row):
            far = np.where((m == i) & (n == j), cell, far)
    return far


def _renames(p: list[list], q: list[list]) -> np.ndarray:
    """The cost of renaming node i of a pair's first tree to node j of its second, as (i, j, pair), for trees of one shape each (p, q: their nodes)."""
    kinds: dict[tuple[str, str], int] = {}
    codes = [np.array([[kinds.setdefault((n[0], n[1]), len(kinds)) for n in nodes] for nodes in side]) for side in (p, q)]
    known = list(kinds)
    both, at = np.unique(codes[0].T[:, None] * len(known) + codes[1].T[None], return_inverse=True)
    pairs = [(known[c // len(known)], known[c % len(known)]) for c in both.tolist()]
    cost, held, a, b = np.zeros(len(pairs)), [], [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            continue
        if x[0] == y[0] == "td" and x[1].split("|")[0] == y[1].split("|")[0]:
            s, t = (_tokens(n[1].split("|", 1)[1]) for n in (x, y))
            if max(len(s), len(t)) <= CELL:
                held.append(i)
                a.append(s)
                b.append(t)
                continue
        cost[i] = _rename(x, y)
    if held:
        cost[held] = _edit_distances(a, b) / np.maximum([len(s) for s in a], [len(t) for t in b])
    return cost[at].reshape(codes[0].shape[1], codes[1].shape[1], len(p))


def _distances(a: tuple, b: tuple, costs: np.ndarray) -> np.ndarray:
    """``tree_distance`` of many pairs of one shape (left, roots: a, b), from the costs of renaming."""
    (lx, kx), (ly, ky) = a, b
    dist = np.zeros(costs.shape)
    for i in kx:
        for j in ky:
            m, n, oi, oj = i - lx[i] + 2, j - ly[j] + 2, lx[i] - 1, ly[j] - 1
            fd = np.zeros((m, n, costs.shape[2]))
            fd[:, 0], fd[0] = np.arange(m)[:, None], np.arange(n)[:, None]
            for p in range(1, m):
                for q in range(1, n):
                    least = np.minimum(fd[p - 1, q], fd[p, q - 1]) + 1
                    if lx[i] == lx[p + oi] and ly[j] == ly[q + oj]:
                        dist[p + oi, q + oj] = np.minimum(least, fd[p - 1, q - 1] + costs[p + oi, q + oj], out=fd[p, q])
                    else:
                        np.minimum(least, fd[lx[p + oi] - 1 - oi, ly[q + oj] - 1 - oj] + dist[p + oi, q + oj], out=fd[p, q])
    return dist[-1, -1]


def table_similarities(found: Sequence[str | None], truth: Sequence[str | None]) -> list[float]:
    """``table_similarity`` of each pair; pairs whose trees have the same two shapes are compared together."""
    out, shapes = [0.0] * len(found), {}
    for number, pages in enumerate(zip(found, truth)):
        trees = [table_tree(p or "") for p in pages]
        if trees[0] is None or trees[1] is None:
            continue
        flat = [_flat(t) for t in trees]
        key = tuple((tuple(left), tuple(roots)) for _, left, roots in flat)
        shapes.setdefault(key, []).append((number, trees, [nodes for nodes, _, _ in flat]))
    for (a, b), members in shapes.items():
        step = max(1, HELD // (len(a[0]) * len(b[0])))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            if len(part) < TOGETHER:
                far = [tree_distance(*trees, _rename) for _, trees, _ in part]
            else:
                far = _distances(a, b, _renames([n[0] for _, _, n in part], [n[1] for _, _, n in part])).tolist()
            for (number, trees, _), d in zip(part, far):
                out[number] = 1 - d / max(*map(_size, trees), 1)
    return out


def teds(column: Column, truth: Column) -> Column:
    @F.arrow_udf("double")
    def scored(found: pa.Array, truths: pa.Array) -> pa.Array:
        return pa.array([round(v, 6) for v in table_similarities(found.to_pylist(), truths.to_pylist())], pa.float64())

    return scored(column, truth)


def word_groups(text: str) -> list[tuple[str, str]]:
    """(word, kind) of a line: cn for ideographs, en&num for runs of letters and digits with ' and - inside and points between digits; other signs part words."""
    out: list[list[str]] = []
    for i, c in enumerate(text):
        after = text[i + 1] if i + 1 < len(text) else ""
        last = out[-1] if out else ["", ""]
        if "一" <= c <= "鿿":
            kind = "cn"
        elif c.isalnum() or c in "'-" and last[1] == "en&num" and after.isalnum() or c == "." and last[0][-1:].isdigit() and last[1] == "en&num" and after.isdigit():
            kind = "en&num"
        else:
            kind = ""
        if kind and kind == last[1]:
            last[0] += c
        else:
            out.append([c, kind])
    return [(w, k) for w, k in out if k]


def fill_cells(cells: int, lines: list[tuple[int, str]]) -> list[str]:
    """Escaped text of each cell: lines in order, joined by spaces."""
    out = [""] * cells
    for cell, text in lines:
        out[cell] = f"{out[cell]} {text}".strip()
    return [html.escape(t, quote=False) for t in out]
