"""Sequence alignment on numpy rows. No Spark here: operators call these within Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

DIAG, UP, LEFT, STOP = 1, 2, 3, 0
#: A table of directions of at most so many cells is kept whole; larger ones are halved until they fit.
CELLS = 25_000_000
#: Scores of pairs of items that are kept, at most.
HELD = 4_000_000

Path = list[tuple[int | None, int | None]]


def codes(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Equal items get equal numbers."""
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (a, b))
    known: dict = {}
    return tuple(np.array([known.setdefault(x, len(known)) for x in s], np.int64) for s in (a, b))


def _rows(scores: Callable[[int], np.ndarray], n: int, m: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions and last row of a global alignment. The dependency on the left neighbour is a running maximum, as gaps
    cost the same everywhere. Of equal ways the diagonal comes first, then up, then left."""
    j = np.arange(m + 1)
    row = j * gap
    way = np.full((n + 1, m + 1), LEFT, np.uint8)
    way[0, 0] = STOP
    for i in range(1, n + 1):
        up = row + gap
        diag = np.full(m + 1, -np.inf)
        diag[1:] = row[:-1] + scores(i - 1)
        new = np.maximum.accumulate(np.maximum(diag, up) - j * gap) + j * gap
        way[i] = np.where(_close(new, diag), DIAG, np.where(_close(new, up), UP, LEFT))
        way[i, 0] = UP
        row = new
    return way, row


def _last(scores: Callable[[int], np.ndarray], n: int, m: int, gap: float) -> np.ndarray:
    j = np.arange(m + 1)
    row = j * gap
    for i in range(n):
        best = row + gap
        best[1:] = np.maximum(best[1:], row[:-1] + scores(i))
        row = np.maximum.accumulate(best - j * gap) + j * gap
    return row


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.abs(a - b) <= 1e-9 * np.maximum(1.0, np.abs(a))


def _walk(way: np.ndarray) -> Path:
    i, j = way.shape[0] - 1, way.shape[1] - 1
    out: Path = []
    while i or j:
        d = way[i, j]
        if d == DIAG:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif d == UP:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


class Scores:
    """Substitution scores of two sequences: equal or not, or any function of two items."""

    def __init__(self, a: Sequence, b: Sequence, match: float, mismatch: float, score: Callable | None, near: Callable[[int], np.ndarray] | None = None):
        self.match, self.mismatch, self.near = match, mismatch, near
        self.bit = 0.5 / (min(len(a), len(b)) + 1)  # all of them together are less than a whole point
        if score is None:
            self.a, self.b, self.own = *codes(a, b), None
        else:
            # A row for each different item of a over the different items of b, made when it is needed; HELD numbers are kept.
            self.a, other = a, list(dict.fromkeys(b))
            place = {y: i for i, y in enumerate(other)}
            self.b = np.array([place[y] for y in b], np.int64)
            self.own = lru_cache(maxsize=max(1, HELD // max(1, len(other))))(lambda x: np.array([score(x, y) for y in other], float))

    def rows(self, i0: int, j0: int, j1: int, turned: tuple[int, int] | None = None) -> Callable[[int], np.ndarray]:
        if turned:  # from the end of a part backwards
            i1, _ = turned
            return lambda i: self.row(i1 - 1 - i, j0, j1)[::-1]
        return lambda i: self.row(i0 + i, j0, j1)

    def row(self, i: int, j0: int, j1: int) -> np.ndarray:
        plain = self.plain(i, j0, j1)
        return plain if self.near is None else plain + self.bit * self.near(i)[j0:j1]

    def plain(self, i: int, j0: int, j1: int) -> np.ndarray:
        if self.own is not None:
            return self.own(self.a[i])[self.b[j0:j1]]
        return np.where(self.b[j0:j1] == self.a[i], self.match, self.mismatch)


def align(a: Sequence, b: Sequence, match: float = 1.0, mismatch: float = -1.0, gap: float = -1.0, score: Callable | None = None, cells: int = CELLS, near: Callable[[int], np.ndarray] | None = None) -> tuple[Path, float]:
    """Global alignment: pairs of indices (None: a gap) and the score. Indices are right at any length: parts of long
    inputs are aligned on their own and their indices counted from the whole input's start.

    near: for an index of a, how near each item of b lies to it, 0 to 1. Of alignments that score the same (scores being whole
    numbers) it chooses the one whose pairs lie nearest; it isn't part of the score."""
    s = Scores(a, b, match, mismatch, score)
    total = float(_last(s.rows(0, 0, len(b)), len(a), len(b), gap)[-1])
    s.near = near

    def part(i0: int, i1: int, j0: int, j1: int) -> Path:
        n, m = i1 - i0, j1 - j0
        if (n + 1) * (m + 1) <= cells or n < 2:
            way, _ = _rows(s.rows(i0, j0, j1), n, m, gap)
            return [(None if x is None else x + i0, None if y is None else y + j0) for x, y in _walk(way)]
        mid = i0 + n // 2
        ahead = _last(s.rows(i0, j0, j1), mid - i0, m, gap)
        back = _last(s.rows(mid, j0, j1, (i1, j1)), i1 - mid, m, gap)[::-1]
        cut = j0 + int((ahead + back).argmax())
        return part(i0, mid, j0, cut) + part(mid, i1, cut, j1)

    return part(0, len(a), 0, len(b)), total


def local(a: Sequence, b: Sequence, match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0, score: Callable | None = None, cells: int = CELLS) -> tuple[Path, float]:
    """Best local alignment; it ends in the first of equal best cells, by row, then column. Beyond `cells` no table is kept:
    one pass finds the end, one from there backwards the start, and what lies between is aligned by halves."""
    s, n, m = Scores(a, b, match, mismatch, score), len(a), len(b)
    j = np.arange(m + 1)
    whole = (n + 1) * (m + 1) <= cells
    table = np.zeros((n + 1, m + 1)) if whole else None
    row, top, end = np.zeros(m + 1), 0.0, (0, 0)
    for i in range(1, n + 1):
        best = np.maximum(row + gap, 0.0)
        best[1:] = np.maximum(best[1:], row[:-1] + s.row(i - 1, 0, m))
        best[0] = 0.0
        row = np.maximum(np.maximum.accumulate(best - j * gap) + j * gap, 0.0)
        if whole:
            table[i] = row
        if row.max() > top:
            top, end = float(row.max()), (i, int(row.argmax()))
    if top <= 0:
        return [], 0.0
    i, k = end
    if not whole:
        i0, k0 = _start(s, i, k, gap, top)
        path, _ = align(a[i0:i], b[k0:k], match, mismatch, gap, score, cells)
        return [(None if x is None else x + i0, None if y is None else y + k0) for x, y in path], top
    out: Path = []
    while i and k and table[i, k] > 0:
        here = table[i, k]
        if _close(here, table[i - 1, k - 1] + s.row(i - 1, k - 1, k)[0]):
            i, k = i - 1, k - 1
            out.append((i, k))
        elif _close(here, table[i - 1, k] + gap):
            i -= 1
            out.append((i, None))
        else:
            k -= 1
            out.append((None, k))
    return out[::-1], top


def _start(s: Scores, n: int, m: int, gap: float, top: float) -> tuple[int, int]:
    """Where an alignment that ends before (n, m) with the score `top` begins: the nearest such row."""
    j = np.arange(m + 1)
    row = j * gap
    for i in range(1, n + 1):
        best = row + gap
        best[1:] = np.maximum(best[1:], row[:-1] + s.row(n - i, 0, m)[::-1])
        row = np.maximum.accumulate(best - j * gap) + j * gap
        if row.max() >= top or _close(row.max(), top):
            return n - i, m - int(row.argmax())
    return 0, 0


def aligned_counts(a: Sequence, b: Sequence) -> tuple[int, int, int, int]:
    """Matches, substitutions, insertions, deletions of the global alignment that scores +1 / -1 / -1, in rows of memory:
    the counts travel with the rows, so no table is kept."""
    return _counts(*codes(a, b), 1, -1, -1)


def edit_counts(a: Sequence, b: Sequence) -> tuple[int, int, int, int]:
    """The same of a least-edits alignment."""
    return _counts(*codes(a, b), 0, -1, -1)


def _counts(a: np.ndarray, b: np.ndarray, match: int, mismatch: int, gap: int) -> tuple[int, int, int, int]:
    if len(a) == len(b) and (a == b).all():
        return len(a), 0, 0, 0
    m = len(b)
    j = np.arange(m + 1)
    row = j * gap
    sub = np.zeros(m + 1, np.int64)
    dele = np.zeros(m + 1, np.int64)
    ins = j.copy()
    for x in a:
        equal = b == x
        diag = np.full(m + 1, -(1 << 40))
        diag[1:] = row[:-1] + np.where(equal, match, mismatch)
        up = row + gap
        new = np.maximum.accumulate(np.maximum(diag, up) - j * gap) + j * gap
        by_diag = diag == new
        by_up = ~by_diag & (up == new)
        s, d, i = sub.copy(), dele + 1, ins.copy()
        at = np.flatnonzero(by_diag)
        s[at], d[at], i[at] = sub[at - 1] + ~equal[at - 1], dele[at - 1], ins[at - 1]
        origin = np.maximum.accumulate(np.where(by_diag | by_up, j, 0))
        sub, dele, ins = s[origin], d[origin], i[origin] + (j - origin)
        row = new
    s, d, i = int(sub[-1]), int(dele[-1]), int(ins[-1])
    return len(a) - s - d, s, i, d


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; columns are the bits of one number."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    all_ = (1 << len(a)) - 1
    v = all_
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & all_
    return len(a) - v.bit_count()


def similarity(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def align_words(ref: Sequence[dict], hyp: Sequence[dict], gap: float = -1.0, similar: float = 0.6, low: float = 0.5, overlap: float = 0.7) -> tuple[list[dict], float]:
    """Words aligned by similarity. Each pair has ref_idx, hyp_idx, ref_text, hyp_text, op_text (by text alone: what
    counts are made of), op (after boxes may confirm a match), similarity, iou."""
    path, total = align([w["text"] for w in ref], [w["text"] for w in hyp], gap=gap, score=lambda x, y: 2 * similarity(x, y) - 1)
    out = []
    for i, j in path:
        r, h = (None if i is None else ref[i]), (None if j is None else hyp[j])
        pair = {"ref_idx": i, "hyp_idx": j, "ref_text": r and r["text"], "hyp_text": h and h["text"], "similarity": 1.0, "iou": None}
        if r is not None and h is not None:
            pair["similarity"] = similarity(r["text"], h["text"])
            pair["op_text"] = pair["op"] = "match" if pair["similarity"] >= similar else "substitution"
            sure = min(1.0 if w.get("confidence") is None else w["confidence"] for w in (r, h))
            if sure < low and r.get("bbox") and h.get("bbox"):
                pair["iou"] = iou(r["bbox"], h["bbox"])
                if pair["iou"] > overlap:
                    pair["op"] = "match"
        else:
            pair["op_text"] = pair["op"] = "deletion" if h is None else "insertion"
        out.append(pair)
    return out, total / max(len(ref), len(hyp), 1)


def overlaps(a: Sequence[dict], b: Sequence[dict]) -> Callable[[int], np.ndarray] | None:
    """For align(): how far the boxes of words overlap, 0 without a box; None where one side has no boxes at all."""
    has = lambda w: bool(w.get("bbox")) and len(w["bbox"]) == 4 and None not in w["bbox"]
    if not (any(map(has, a)) and any(map(has, b))):
        return None
    x, y = (np.array([w["bbox"] if has(w) else [0.0] * 4 for w in ws], float) for ws in (a, b))
    size = (y[:, 2] - y[:, 0]) * (y[:, 3] - y[:, 1])

    @lru_cache(maxsize=max(1, HELD // len(b)))
    def row(i: int) -> np.ndarray:
        x0, y0, x1, y1 = x[i]
        both = np.maximum(np.minimum(y[:, 2], x1) - np.maximum(y[:, 0], x0), 0) * np.maximum(np.minimum(y[:, 3], y1) - np.maximum(y[:, 1], y0), 0)
        union = size + (x1 - x0) * (y1 - y0) - both
        return np.divide(both, union, out=np.zeros(len(y)), where=(both > 0) & (union > 0))

    return row


def iou(a: Sequence[float], b: Sequence[float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / both if both > 0 else 0.0
