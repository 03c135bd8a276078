"""Similarity of two tables' cell grids, by common subsequences of rows and of columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .align import common_length, iou


#: Up to so many cells of a table plain numbers are faster than arrays.
FEW = 2048


def grid(cells: list[dict]) -> list[list[int]]:
    """Index of the cell that starts at each place, -1 under spans and where none is."""
    if not cells:
        return []
    rows = max(c["row"] + (c.get("row_span") or 1) for c in cells)
    cols = max(c["col"] + (c.get("col_span") or 1) for c in cells)
    out = [[-1] * cols for _ in range(rows)]
    for i, c in enumerate(cells):
        out[c["row"]][c["col"]] = i
    return out


def _best(hit: list[list[bool]], n: int, m: int) -> list:
    """Most matches of each two beginnings."""
    if n * m <= FEW:
        best = [[0] * (m + 1)]
        for row in hit:
            up, new = best[-1], [0]
            for j in range(m):
                new.append(max(up[j + 1], up[j] + row[j], new[j]))
            best.append(new)
        return best
    table = np.zeros((n + 1, m + 1), np.int64)
    for i, row in enumerate(hit):
        table[i + 1, 1:] = np.maximum(table[i, 1:], table[i, :-1] + np.array(row, bool))
        table[i + 1] = np.maximum.accumulate(table[i + 1])
    return table.tolist()


def _pairs(a: list, b: list, threshold: float) -> list[tuple[int, int]]:
    """Rows of a and b that match in order; rows match if twice the common subsequence of their occupancy, over both
    lengths, is above the threshold."""
    pa, pb = ["".join("x" if v >= 0 else "." for v in row) for row in a], ["".join("x" if v >= 0 else "." for v in row) for row in b]
    known = {(x, y): 2 * common_length(x, y) / (len(x) + len(y)) > threshold for x in set(pa) for y in set(pb)}
    hit = [[known[x, y] for y in pb] for x in pa]
    best = _best(hit, len(pa), len(pb))
    i, j, out = len(pa), len(pb), []
    while i and j:
        if hit[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def text_similarity(a: str, b: str) -> float:
    """1 - least edits / longer length; 1 for two empty texts."""
    longest = max(len(a), len(b))
    if a == b:
        return 1.0
    if len(a) * len(b) <= FEW:
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
            row = new
        return 1 - row[-1] / longest
    row = np.arange(len(b) + 1)
    other = np.array([ord(c) for c in b])
    j = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = np.minimum(row + 1, np.concatenate(([i], row[:-1] + (other != ord(c)))))
        row = np.minimum.accumulate(new - j) + j
    return 1 - int(row[-1]) / longest


def compare(pred: list[dict], truth: list[dict], threshold: float = 0.5, similarity: Callable[[str, str], float] = text_similarity) -> dict[str, float]:
    """top (structure), con (texts), loc (boxes), precision and recall of cells in matched rows and columns."""
    if not pred and not truth:
        return dict.fromkeys(("top", "con", "loc", "precision", "recall"), 1.0)
    a, b = grid(pred), grid(truth)
    if not (a and a[0] and b and b[0]):
        return dict.fromkeys(("top", "con", "loc", "precision", "recall"), 0.0)
    rows, cols = _pairs(a, b, threshold), _pairs(list(zip(*a, strict=True)), list(zip(*b, strict=True)), threshold)
    top = (2 * len(rows) / (len(a) + len(b)) + 2 * len(cols) / (len(a[0]) + len(b[0]))) / 2

    def mean(value: Callable[[dict, dict], float]) -> float:
        got = []
        for ra, rb in rows:
            for ca, cb in cols:
                x, y = a[ra][ca], b[rb][cb]
                got.append(value(pred[x], truth[y]) if x >= 0 and y >= 0 else float(x < 0 and y < 0))
        return sum(got) / len(got) if got else 0.0

    def share(m: list[list[int]], side: int) -> float:
        inside = sum(m[p[side]][q[side]] >= 0 for p in rows for q in cols)
        return inside / max(sum(v >= 0 for row in m for v in row), 1)

    return {"top": top, "con": mean(lambda x, y: similarity(x.get("text") or "", y.get("text") or "")), "loc": mean(lambda x, y: iou(x["bbox"], y["bbox"])), "precision": share(a, 0), "recall": share(b, 1)}


def page(pred: list[dict], truth: list[dict], least: float = 0.5, similarity: Callable[[str, str], float] = text_similarity) -> dict[str, float]:
    """All table metrics of a page: predicted tables take, in their order, the free true one of greatest overlap above `least`.
    Without tables on either side all are 1; without a matched pair the similarities are 1 and detection is 0."""
    free, met = set(range(len(truth))), []
    for p in pred:
        overlap = {j: iou(p["bbox"], truth[j]["bbox"]) for j in sorted(free)}
        j = max(overlap, key=overlap.get, default=None)
        if j is not None and overlap[j] > least:
            free.discard(j)
            met.append((p, truth[j]))
    got = [compare(p.get("cells") or [], t.get("cells") or [], similarity=similarity) for p, t in met]
    mean = {k: sum(g[k] for g in got) / len(got) if got else 1.0 for k in ("top", "con", "loc", "precision", "recall")}
    p, r = mean["precision"], mean["recall"]
    none = not pred and not truth
    return {
        "grits_top": mean["top"], "grits_con": mean["con"], "grits_loc": mean["loc"], "structure_precision": p, "structure_recall": r,
        "cell_accuracy": 2 * p * r / (p + r) if p + r else 0.0,
        "table_detection_precision": 1.0 if none else len(met) / len(pred) if pred else 0.0,
        "table_detection_recall": 1.0 if none else len(met) / len(truth) if truth else 0.0,
    }
