"""Sequential algorithms within a page: matching, suppression, reading order, merging. Plain functions over rows, and one way to run them a page at a time.

Input order is fixed first (score down or the order named, then box_id), so ties always fall alike.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = list[dict]


def per_page(df: DataFrame, kernel: Callable[[Rows], Rows], schema: str, *page: str) -> DataFrame:
    """kernel on each page's rows (or those of each group by other columns); a page is gathered in one task, so a page bounds memory."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(rows: pa.Table) -> pa.Table:
        out = kernel(rows.to_pylist())
        return pa.Table.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in kind], schema=kind)

    return df.groupBy(*(page or ("page_id",))).applyInArrow(run, schema)


def iou(a: dict, b: dict, eps: float = 0.0, mode: str = "union") -> float:
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    shared = max(w, 0.0) * max(h, 0.0)
    one, two = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    below = min(one, two) if mode == "small" else one + two - shared
    return shared / (below + eps) if below + eps > 0 else 0.0


def best_first(rows: Rows) -> Rows:
    return sorted(rows, key=lambda r: (-r["score"], r["box_id"]))


def match_by_iou(pairs: Rows) -> Rows:
    """One-to-one, highest overlap first; ties in order of truth, then found."""
    out, truth, found = [], set(), set()
    for p in sorted(pairs, key=lambda p: (-p["iou"], p["gt_id"], p["det_id"])):
        if p["gt_id"] not in truth and p["det_id"] not in found:
            truth.add(p["gt_id"])
            found.add(p["det_id"])
            out.append(p)
    return out


def match_in_order(pairs: Rows, least: float = 0.5) -> Rows:
    """One-to-one, by truth and then found as they come, overlap over least; pairs that don't care are passed over."""
    out, truth, found = [], set(), set()
    for p in sorted(pairs, key=lambda p: (p["gt_id"], p["det_id"])):
        if p["iou"] > least and not p.get("ignored") and p["gt_id"] not in truth and p["det_id"] not in found:
            truth.add(p["gt_id"])
            found.add(p["det_id"])
            out.append(p)
    return out


def hard_nms(rows: Rows, most: float = 0.5, eps: float = 1e-5, by: str | None = "label") -> Rows:
    """The best box of a class goes with those of the class that it overlaps by more than most; by None, all are one class."""
    kept: Rows = []
    for r in best_first(rows):
        if all(iou(r, k, eps) <= most for k in kept if by is None or k[by] == r[by]):
            kept.append(r)
    return kept


def soft_nms(rows: Rows, least: float = 0.3, kind: str = "gaussian", sigma: float = 0.5, most: float = 0.3) -> Rows:
    """The best box weakens those that overlap it, again and again; boxes under least go."""
    left, out = [dict(r) for r in best_first(rows)], []
    while left:
        top = min(range(len(left)), key=lambda i: (-left[i]["score"], left[i]["box_id"]))
        best = left.pop(top)
        out.append(best)
        for r in left:
            o = iou(best, r)
            if kind == "gaussian":
                r["score"] *= 2.718281828459045 ** (-(o * o) / sigma)
            elif o > most:
                r["score"] *= (1 - o) if kind == "linear" else 0
        left = [r for r in left if r["score"] >= least]
    return out


def locality_nms(rows: Rows, most: float = 0.3) -> Rows:
    """Neighbours in order that overlap by more than most are averaged by score, their scores summed; then hard suppression."""
    merged: Rows = []
    for r in sorted(rows, key=lambda r: (r["y0"], r["x0"], r["box_id"])):
        if merged and iou(merged[-1], r) > most:
            a = merged[-1]
            total = a["score"] + r["score"]
            mine = a["score"] / total if total else 0.5
            for c in ("x0", "y0", "x1", "y1"):
                a[c] = a[c] * mine + r[c] * (1 - mine)
            a["score"] = total
        else:
            merged.append(dict(r))
    return hard_nms(merged, most, 0.0, None)


def label_dedup(rows: Rows, most: float = 0.5, first: str = "table") -> Rows:
    """Of two boxes that share more than most of the smaller, the one with label first wins, else the better."""
    kept: Rows = []
    for r in sorted(rows, key=lambda r: (r["label"] != first, -r["score"], r["box_id"])):
        if all(iou(r, k, mode="small") <= most for k in kept):
            kept.append(r)
    return kept


def reading_order(rows: Rows, near: float = 10, floor: int = 0) -> Rows:
    """By y, x; then each row moves back past neighbours that are nearly level and further right. floor: places that never move."""
    out = sorted(rows, key=lambda r: (r["y0"], r["x0"], r["box_id"]))
    for i in range(len(out) - 1):
        for j in range(i, floor - 1, -1):
            if abs(out[j + 1]["y0"] - out[j]["y0"]) < near and out[j + 1]["x0"] < out[j]["x0"]:
                out[j], out[j + 1] = out[j + 1], out[j]
            else:
                break
    return [r | {"place": i} for i, r in enumerate(out)]


def two_columns(rows: Rows, wide: float) -> Rows:
    """Left and right columns are collected until a block over both flushes them, left first."""
    out, left, right = [], [], []

    def flush() -> None:
        out.extend(left + right)
        left.clear()
        right.clear()

    for r in sorted(rows, key=lambda r: (r["y0"], r["x0"], r["box_id"])):
        if r["x0"] < wide / 4 and r["x1"] < 3 * wide / 4:
            left.append(r)
        elif r["x0"] > wide / 4 and r["x1"] > wide / 2:
            right.append(r)
        else:
            flush()
            out.append(r)
    flush()
    return [r | {"place": i} for i, r in enumerate(out)]


def level_rows(rows: Rows, share: float = 0.6, running: bool = False, rtl: bool = False) -> Rows:
    """Rows of boxes whose centres lie within share of the height, of the last box or (running) of the row's mean; each from the left, or the right edge down."""
    lines: list[Rows] = []
    mean = 0.0
    for r in sorted(rows, key=lambda r: ((r["y0"] + r["y1"]) / 2, r["x0"], r["box_id"])):
        mid = (r["y0"] + r["y1"]) / 2
        if lines and abs(mid - mean) <= share * (r["y1"] - r["y0"]):
            lines[-1].append(r)
            mean = sum((x["y0"] + x["y1"]) / 2 for x in lines[-1]) / len(lines[-1]) if running else mid
        else:
            lines.append([r])
            mean = mid
    return [r | {"line": i, "place": j} for i, line in enumerate(lines) for j, r in enumerate(sorted(line, key=lambda r: ((-r["x1"] if rtl else r["x0"]), r["box_id"])))]


def table_rows(rows: Rows, near: float = 3) -> Rows:
    """Each box joins the first row whose first box lies within near of its top; rows and boxes in order. Boxes with equal x are all kept."""
    lines: list[Rows] = []
    for r in sorted(rows, key=lambda r: (r["y0"], r["box_id"])):
        for line in lines:
            if abs(line[0]["y0"] - r["y0"]) < near:
                line.append(r)
                break
        else:
            lines.append([r])
    return [r | {"line": i, "place": j} for i, line in enumerate(lines) for j, r in enumerate(sorted(line, key=lambda r: (r["x0"], r["box_id"])))]


def merge_fragments(rows: Rows, across: float = 10, level: float = 10) -> Rows:
    """Boxes in order of box_id take later ones whose tops and bottoms are level and that begin near their right end; pass after pass until none is taken."""
    boxes = sorted((dict(r) for r in rows), key=lambda r: r["box_id"])
    while True:
        left, out = boxes, []
        while left:
            a, rest = dict(left[0]), []
            for b in left[1:]:
                if abs(a["y0"] - b["y0"]) <= level and abs(a["y1"] - b["y1"]) <= level and abs(a["x1"] - b["x0"]) <= across:
                    for side, pick in (("x0", min), ("y0", min), ("x1", max), ("y1", max)):
                        a[side] = pick(a[side], b[side])
                else:
                    rest.append(b)
            out.append(a)
            left = rest
        if len(out) == len(boxes):
            return out
        boxes = out


def merge_words(rows: Rows, low: float = -0.4, high: float = 1.2) -> Rows:
    """Words of a row become lines where the gap, in heights, lies between low and high: text joined, least score, bounds."""
    out: Rows = []
    for r in level_rows(rows):
        last = out[-1] if out else None
        tall = r["y1"] - r["y0"]
        if last and last["line"] == r["line"] and low <= (r["x0"] - last["x1"]) / max(tall, 1e-9) <= high:
            last |= {"x1": max(last["x1"], r["x1"]), "y0": min(last["y0"], r["y0"]), "y1": max(last["y1"], r["y1"]), "score": min(last["score"], r["score"]), "text": f"{last['text']} {r['text']}"}
        else:
            out.append(dict(r))
    return out


def components(edges: list[tuple[int, int, float]], least: float = 0.5) -> dict[int, int]:
    """The least member of each node's group, over edges whose mean score is at least least; lone nodes are left out."""
    sums: dict[tuple[int, int], list[float]] = {}
    for a, b, s in edges:
        sums.setdefault((min(a, b), max(a, b)), []).append(s)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (a, b), s in sums.items():
        if a != b and sum(s) / len(s) >= least:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in list(parent)}


def deteval(truth: Rows, found: Rows) -> dict:
    """Recall and precision sums of one page with one-to-one, one-to-many and many-to-one matches."""
    def shared(a: dict, b: dict) -> float:
        return max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))

    def size(a: dict) -> float:
        return max((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), 1e-9)

    ignored = [t for t in truth if t.get("ignored")]
    found = [f for f in sorted(found, key=lambda r: r["box_id"]) if all(shared(t, f) / size(f) <= 0.5 for t in ignored)]
    truth = [t for t in sorted(truth, key=lambda r: r["box_id"]) if not t.get("ignored")]
    sigma = [[round(shared(t, f) / size(t), 2) for f in found] for t in truth]
    tau = [[round(shared(t, f) / size(f), 2) for f in found] for t in truth]
    rows, cols, hit_t, hit_f = range(len(truth)), range(len(found)), set(), set()
    recall = precision = 0.0
    for i in rows:
        js = [j for j in cols if sigma[i][j] > 0.7 and tau[i][j] > 0.6]
        if len(js) == 1 and [k for k in rows if sigma[k][js[0]] > 0.7 and tau[k][js[0]] > 0.6] == [i]:
            hit_t.add(i)
            hit_f.add(js[0])
            recall, precision = recall + 1, precision + 1
    for i in rows:
        js = [j for j in cols if j not in hit_f and tau[i][j] >= 0.6]
        if i not in hit_t and sum(sigma[i][j] > 0 for j in cols) >= 2 and js and sum(sigma[i][j] for j in js) >= 0.7:
            recall, precision = (recall + 1, precision + 1) if len(js) == 1 else (recall + 0.8, precision + 0.8 * len(js))
            hit_t.add(i)
            hit_f.update(js)
    for j in cols:
        many = [i for i in rows if i not in hit_t and sigma[i][j] >= 0.6]
        if j not in hit_f and sum(tau[i][j] > 0 for i in rows) >= 2 and many and sum(tau[i][j] for i in many) >= 0.6:
            recall, precision = (recall + 1, precision + 1) if len(many) == 1 else (recall + 0.8 * len(many), precision + 0.8)
            hit_f.add(j)
            hit_t.update(many)
    return {"recall_sum": recall, "precision_sum": precision, "n_truth": len(truth), "n_found": len(found)}
