"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, remainder, text_of
from .learning import SAMPLE, labelled

HELD_OUT = (4, 2)
#: Binned facts of a line, each with BINS values; the line's, its predecessor's and its successor's are features.
FACTS, BINS = 9, 12
NONE = BINS - 1
SIZE = 3 * FACTS * BINS

_CLASS = np.zeros(256, np.int8)
_CLASS[[c for c in range(128) if chr(c).islower()]] = 1
_CLASS[128:] = 1
_CLASS[[c for c in range(128) if chr(c).isupper()]] = 2
_CLASS[[c for c in range(128) if chr(c).isdigit()]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = 5
_CLASS[0xC3] = 0  # the first byte of most accented letters; the second one counts


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(facts of each line, one row a line, as bins; lengths of the lines in bytes). Blank lines are left out."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, FACTS), np.int64), np.zeros(0)
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.array([len(x) for x in raw])
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    count = lambda k: np.add.reduceat((kinds == k).astype(np.int32), at)
    lower, upper, digit, mark, sign = (count(k) for k in range(1, 6))
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    repeats = np.array([sum(map(str.__eq__, w, w[1:])) for w in words])
    seen: set[str] = set()
    again = np.array([x in seen or seen.add(x) is not None for x in lines])
    ten = lambda a, b: np.minimum(10 * a // np.maximum(b, 1), 10)
    fine = lambda a, b: np.minimum(np.ceil(np.log2(1 + 200 * a / np.maximum(b, 1))), 8).astype(np.int64)
    facts = [
        np.minimum(np.log2(1 + n).astype(np.int64), 10),
        ten(upper, upper + lower),
        fine(sign, size),
        fine(digit, size),
        fine(mark, size),
        ten(distinct, n),
        fine(repeats, n),
        np.minimum((lower + upper + digit) // np.maximum(n, 1), 10),
        again.astype(np.int64),
    ]
    return np.stack(facts, 1), size.astype(float)


def features(facts: np.ndarray) -> np.ndarray:
    """Indices of the active features, 3 * FACTS for each line: own, before and after."""
    edge = np.full((1, FACTS), NONE)
    offset = np.arange(FACTS) * BINS
    before, after = np.concatenate((edge, facts[:-1])), np.concatenate((facts[1:], edge))
    return np.concatenate((facts + offset, before + offset + FACTS * BINS, after + offset + 2 * FACTS * BINS), 1)


class Field:
    """Labels 0 (bad) and 1 (good): weights of features for label 1, a 2 x 2 table of transitions, and the last
    step from a document's share of good lines to its score."""

    def __init__(self, w: np.ndarray, bias: float, pass_on: np.ndarray, slope: float, shift: float):
        self.w, self.bias, self.pass_on, self.slope, self.shift = w, bias, pass_on, slope, shift

    def marginals(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over the lines' scores z: chances of label 1, and expected counts of transitions."""
        n, t = len(z), np.exp(self.pass_on)
        t00, t01, t10, t11 = t.ravel().tolist()
        one = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e1, e0 = one.tolist(), (1 - one).tolist()
        a0, a1, b0, b1 = [0.0] * n, [0.0] * n, [1.0] * n, [1.0] * n
        x0, x1 = e0[0], e1[0]
        a0[0], a1[0] = x0, x1
        for i in range(1, n):
            y0, y1 = (x0 * t00 + x1 * t10) * e0[i], (x0 * t01 + x1 * t11) * e1[i]
            s = y0 + y1
            x0, x1 = y0 / s, y1 / s
            a0[i], a1[i] = x0, x1
        x0 = x1 = 1.0
        for i in range(n - 2, -1, -1):
            u0, u1 = x0 * e0[i + 1], x1 * e1[i + 1]
            y0, y1 = t00 * u0 + t01 * u1, t10 * u0 + t11 * u1
            s = y0 + y1
            x0, x1 = y0 / s, y1 / s
            b0[i], b1[i] = x0, x1
        a, b = np.array([a0, a1]), np.array([b0, b1])
        p = a * b
        p /= p.sum(0)
        pairs = np.zeros((2, 2))
        if n > 1:
            joint = a[:, None, :-1] * t[:, :, None] * (b * np.array([e0, e1]))[None, :, 1:]
            pairs = (joint / joint.sum((0, 1))).sum(2)
        return p[1], pairs

    def share(self, facts: np.ndarray, size: np.ndarray) -> float:
        """Length-weighted share of good lines; one half without lines."""
        if not len(size):
            return 0.5
        p, _ = self.marginals(self.bias + self.w[features(facts)].sum(1))
        return float((p * size).sum() / size.sum())

    def score(self, facts: np.ndarray, size: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.share(facts, size) + self.shift))))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, seed: int = 3) -> Field:
    """Learn from document labels alone: lines start with their document's label; after two epochs, lines of bad
    documents that look good keep that label (as bad documents hold good lines too), and learning goes on.

    Without both labels, every score is the share of ones, smoothed.
    """
    base = (labels.sum() + 0.5) / (len(labels) + 1)
    field = Field(np.zeros(SIZE), 0.0, np.zeros((2, 2)), 0.0, math.log(base / (1 - base)))
    if labels.sum() in (0, len(labels)):
        return field
    rng = np.random.default_rng(seed)
    feats = [features(f) for f, _ in docs]
    goal = [np.full(len(s), float(y)) for (_, s), y in zip(docs, labels, strict=True)]
    weight = np.where(labels == 1, 0.5 / base, 0.5 / (1 - base))
    g2, g2t = np.full(SIZE, 1e-6), np.full((2, 2), 1e-6)
    for epoch in range(epochs):
        for i in rng.permutation(len(docs)):
            f, n = feats[i], len(goal[i])
            if not n:
                continue
            p, pairs = field.marginals(field.bias + field.w[f].sum(1))
            y = goal[i]
            scale = weight[i] / math.sqrt(n)
            g = np.zeros(SIZE)
            np.add.at(g, f.ravel(), np.repeat((y - p) * scale, f.shape[1]))
            g -= 1e-4 * field.w
            g2 += g**2
            field.w = field.w + 0.2 * g / np.sqrt(g2)
            if n > 1:
                want = np.array([[((1 - y[:-1]) * (1 - y[1:])).sum(), ((1 - y[:-1]) * y[1:]).sum()], [(y[:-1] * (1 - y[1:])).sum(), (y[:-1] * y[1:]).sum()]])
                gt = (want - pairs) * scale
                g2t += gt**2
                field.pass_on = np.clip(field.pass_on + 0.1 * gt / np.sqrt(g2t), -4, 4)
        if epoch == 1:
            for i in np.flatnonzero(labels == 0):
                if len(goal[i]) > 1:
                    p, _ = field.marginals(field.bias + field.w[feats[i]].sum(1))
                    goal[i] = (p >= 0.9).astype(float)
                    goal[i][np.argmin(p)] = 0
    # From the share to the score: logistic regression on the same documents, by Newton steps.
    x = np.array([field.share(f, s) for f, s in docs])
    a = np.array([8.0, -6.0])
    d = np.stack((x, np.ones(len(x))), 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(d @ a, -30, 30)))
        h = (d * (q * (1 - q) * weight)[:, None]).T @ d + np.diag([1e-2, 1e-2])
        step = np.linalg.solve(h, d.T @ ((labels - q) * weight) - 1e-2 * a)
        a = a + np.clip(step, -2, 2)
    field.slope, field.shift = float(a[0]), float(a[1])
    return field


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = HELD_OUT, rows: int = SAMPLE) -> Field:
    """Fit on a bounded sample; texts become facts on the executors, and those alone are sent to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 256):
            got = [lines_of(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], pa.array([f.astype(np.uint8).tobytes() for f, _ in got], pa.binary()), pa.array([s.astype(np.int32).tobytes() for _, s in got], pa.binary())], ["doc_id", "label", "facts", "size"])

    got = labelled(documents, labels, label, held_out, rows).mapInArrow(run, "doc_id long, label int, facts binary, size binary").toArrow().to_pydict()
    keyed = sorted(zip(got["doc_id"], got["facts"], got["size"], got["label"], strict=True))
    docs = [(np.frombuffer(f, np.uint8).astype(np.int64).reshape(-1, FACTS), np.frombuffer(s, np.int32).astype(float)) for _, f, s, _ in keyed]
    return fit(docs, np.array([y for *_, y in keyed], float))


def scored(df: DataFrame, field: Field, columns: list[str]) -> DataFrame:
    """df's columns with `score`; `text` must be among them (null: empty)."""
    from pyspark.sql.types import DoubleType, StructType

    slim = df.select(*(F.col(f"`{c}`") for c in columns))
    schema = StructType([*slim.schema.fields]).add("score", DoubleType())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 512):
            s = pa.array([field.score(*lines_of(t or "")) for t in b["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, "score"])

    return slim.mapInArrow(run, schema)


def score(df: DataFrame, field: Field, held_out: tuple[int, int] = HELD_OUT, threshold: float = 0.7) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only the text is read. Texts without lines (null, empty, blank) count as half good. Repeated rows are scored
    each; a null doc_id is kept. Other columns are ignored. An empty table gives an empty one.
    """
    n, r = held_out
    out = scored(text_of(df), field, ["doc_id", "text"]).drop("text")
    return out.select("doc_id", (remainder(F.col("doc_id"), n) == r).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(df: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """The rows of df whose score is at least threshold, with df's columns. Same cases as score()."""
    names = [c for c in df.columns if c.lower() != "score"]
    return scored(df, field, names).where(F.col("score") >= threshold).select(*(F.col(f"`{c}`") for c in names))
