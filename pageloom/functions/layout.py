"""Lines, blocks, columns and reading order of a page's words. Words are dicts with text, bbox and confidence."""

from __future__ import annotations

from statistics import median

import numpy as np


#: Up to so many words plain numbers are faster than arrays.
FEW = 64


def _plain(words: list[dict]) -> bool:
    """Whether all boxes are of four finite numbers of a size that integers have."""
    return all(len(b) == 4 and -1e15 < b[0] < 1e15 and -1e15 < b[1] < 1e15 and -1e15 < b[2] < 1e15 and -1e15 < b[3] < 1e15 for b in (w["bbox"] for w in words))


def _union(words: list[dict]) -> list[float]:
    if len(words) <= FEW and _plain(words):
        x0, y0, x1, y1 = zip(*(w["bbox"] for w in words), strict=True)
        return [float(min(x0)), float(min(y0)), float(max(x1)), float(max(y1))]
    b = np.array([w["bbox"] for w in words], float)
    return [*b[:, :2].min(0).tolist(), *b[:, 2:].max(0).tolist()]


def lines_of(words: list[dict], overlap: float = 0.3) -> list[list[dict]]:
    """Words from top to bottom each join the first line with a word that shares enough of their height, else begin a new one."""
    if len(words) <= FEW and _plain(words):
        return _few_lines(words, overlap)
    lines: list[list[dict]] = []
    spans: list[np.ndarray] = []  # tops and bottoms of each line's words
    for w in sorted(words, key=lambda w: (w["bbox"][1], w["bbox"][0])):
        top, bottom = w["bbox"][1], w["bbox"][3]
        for i, s in enumerate(spans):
            inter = np.maximum(np.minimum(s[:, 1], bottom) - np.maximum(s[:, 0], top), 0)
            union = (s[:, 1] - s[:, 0]) + (bottom - top) - inter
            if ((union > 0) & (inter > overlap * union)).any():
                lines[i].append(w)
                spans[i] = np.concatenate((s, [[top, bottom]]))
                break
        else:
            lines.append([w])
            spans.append(np.array([[top, bottom]], float))
    return [sorted(line, key=lambda w: w["bbox"][0]) for line in lines]


def _few_lines(words: list[dict], overlap: float) -> list[list[dict]]:
    """The same without arrays."""

    def meets(line: list[dict], top: float, bottom: float) -> bool:
        for v in line:
            t, u = v["bbox"][1], v["bbox"][3]
            inter = max(min(u, bottom) - max(t, top), 0)
            union = (u - t) + (bottom - top) - inter
            if union > 0 and inter > overlap * union:
                return True
        return False

    lines: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (w["bbox"][1], w["bbox"][0])):
        top, bottom = w["bbox"][1], w["bbox"][3]
        line = next((line for line in lines if meets(line, top, bottom)), None)
        if line is None:
            lines.append([w])
        else:
            line.append(w)
    return [sorted(line, key=lambda w: w["bbox"][0]) for line in lines]


def block_of(lines: list[list[dict]]) -> dict:
    words = [w for line in lines for w in line]
    conf = [w["confidence"] for w in words]
    return {"bbox": _union(words), "words": words, "text": " ".join(w["text"] for w in words), "confidence": sum(conf) / len(conf), "order": 0, "column": 0}


def separators(words: list[dict], width: float, height: float | None = None) -> list[float]:
    """Middles of the empty vertical strips, at least a twentieth of the page wide, within the content. With a height, words
    on either side must each span half of it."""
    if not words:
        return []
    return _few_separators(words, width, height) if len(words) <= FEW and _plain(words) else _separators(words, width, height)


def _few_separators(words: list[dict], width: float, height: float | None) -> list[float]:
    """The same by a sweep over the words' extents."""
    bins, least = max(1, int(width)), max(1, int(width * 0.05))
    out, end = [], None
    for x0, x1 in sorted((x0, x1) for x0, x1 in ((max(int(w["bbox"][0]), 0), min(int(w["bbox"][2]), bins - 1)) for w in words) if x0 <= x1):
        if end is not None and x0 - end - 1 >= least:
            middle = (end + x0) / 2
            sides = [w["bbox"] for w in words if w["bbox"][2] < middle], [w["bbox"] for w in words if w["bbox"][0] > middle]
            if height is None or all(s and max(b[3] for b in s) - min(b[1] for b in s) >= height * 0.5 for s in sides):
                out.append(middle)
        end = x1 if end is None else max(end, x1)
    return out


def _separators(words: list[dict], width: float, height: float | None) -> list[float]:
    bins = max(1, int(width))
    box = np.array([w["bbox"] for w in words], float)
    edge = np.zeros(bins + 1, np.int64)
    x0, x1 = np.maximum(box[:, 0].astype(int), 0), np.minimum(box[:, 2].astype(int), bins - 1)
    ok = x0 <= x1
    np.add.at(edge, x0[ok], 1)
    np.add.at(edge, x1[ok] + 1, -1)
    full = np.flatnonzero(edge[:-1].cumsum() > 0)
    out = []
    for left, right in zip(full[:-1], full[1:], strict=True):
        if right - left - 1 >= max(1, int(width * 0.05)):
            middle = (left + right) / 2
            if height is not None:
                sides = box[box[:, 2] < middle], box[box[:, 0] > middle]
                if any(not len(s) or s[:, 3].max() - s[:, 1].min() < height * 0.5 for s in sides):
                    continue
            out.append(float(middle))
    return out


def columns(blocks: list[dict], width: float) -> list[int]:
    cuts = separators([w for b in blocks for w in b["words"]], width)
    return [sum((b["bbox"][0] + b["bbox"][2]) / 2 > c for c in cuts) for b in blocks]


def blocks_of(words: list[dict], width: float, height: float, overlap: float = 0.3, factor: float = 1.5) -> list[dict]:
    """Lines split into blocks where the gap exceeds `factor` times the median positive gap (a hundredth of the page without
    gaps); blocks that cross a column separator are cut there; then columns."""
    lines = lines_of(words, overlap)
    if not lines:
        return []
    box = [_union(line) for line in lines]
    gaps = [b[1] - a[3] for a, b in zip(box, box[1:], strict=False)]
    positive = [g for g in gaps if g > 0]
    most = median(positive) * factor if positive else height * 0.01
    groups, current = [], [lines[0]]
    for line, gap in zip(lines[1:], gaps, strict=True):
        if gap > most:
            groups.append(current)
            current = []
        current.append(line)
    groups.append(current)
    blocks = [block_of(g) for g in groups]
    cuts = separators(words, width, height)
    out = []
    for b in blocks:
        inside = [c for c in cuts if b["bbox"][0] < c < b["bbox"][2]]
        if not inside:
            out.append(b)
            continue
        for side in ([w for w in b["words"] if w["bbox"][2] < inside[0]], [w for w in b["words"] if w["bbox"][0] > inside[0]]):
            if side:
                out.append(block_of(lines_of(side)))
    for b, c in zip(out, columns(out, width), strict=True):
        b["column"] = c
    return out


def reading_order(blocks: list[dict], width: float) -> list[dict]:
    """By column, then top, then left; `order` is renumbered."""
    ranked = sorted(zip(columns(blocks, width), blocks, strict=True), key=lambda x: (x[0], x[1]["bbox"][1], x[1]["bbox"][0]))
    for i, (_, b) in enumerate(ranked):
        b["order"] = i
    return [b for _, b in ranked]


def tree_order(centers: list[tuple[float, float]]) -> list[int]:
    """Order in which a minimum spanning tree grows from the top left; ties by height, then left, then index."""
    if not centers:
        return []
    c = np.array(centers, float)
    far = np.full(len(c), np.inf)
    far[min(range(len(c)), key=lambda i: (c[i, 1], c[i, 0]))] = 0
    left, out = set(range(len(c))), []
    while left:
        u = min(left, key=lambda i: (far[i], c[i, 1], c[i, 0], i))
        left.discard(u)
        out.append(u)
        far = np.minimum(far, np.hypot(c[:, 0] - c[u, 0], c[:, 1] - c[u, 1]))
    return out
