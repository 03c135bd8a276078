"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, remainder, text_of
from .learning import SAMPLE, labelled

BUCKETS = 1 << 18
FACTORS = 8
#: A weight is drawn to zero by so many standard errors of its own gradient, so that chance associations add little.
SHRINK = 1.0
#: Rows are learned from in at least so many parts, as their differences tell the errors.
PARTS = 23
HELD_OUT = (5, 0)
_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„‘’…¡¿–—"


def bucket(kind: str, text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest((kind + text).encode("utf-8", "surrogatepass")) % BUCKETS


class Prefixes(dict):
    """A word's first five letters to the buckets of its first four and five (word families and inflections)."""

    def __init__(self, slot: dict[int, int] | None):
        super().__init__()
        self.slot = slot

    def __missing__(self, start: str) -> tuple[int, ...]:
        out = tuple(bucket(f"{k}^", start[:k]) for k in (4, 5) if len(start) >= k)
        if self.slot is not None:
            out = tuple(self.slot[x] for x in out if x in self.slot)
        if len(self) >= 1 << 18:
            self.clear()
        self[start] = out
        return out


class Words(dict):
    """Word to the buckets of its terms: itself and its beginnings. With a table of slots, to their slots; most words have none."""

    def __init__(self, slots: np.ndarray | None = None):
        super().__init__()
        self.slot = None if slots is None else {int(k): int(slots[k]) for k in np.flatnonzero(slots >= 0)}
        self.prefixes = Prefixes(self.slot)

    def __missing__(self, word: str) -> tuple[int, ...]:
        w = word.strip(_STRIP)
        out: tuple[int, ...] = ()
        if w:
            own = bucket("=", w)
            out = self.prefixes[w[:5]]
            if self.slot is None:
                out = (own, *out)
            elif own in self.slot:
                out = (self.slot[own], *out)
        if len(self) >= 1 << 19:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: str) -> np.ndarray:
        found: set[int] = set()
        for x in map(self.__getitem__, set(text.lower().split())):
            if x:
                found.update(x)
        return np.array(sorted(found), np.int64)


class Machine:
    """bias + sum of weights + sum over pairs of <v_i, v_j> / number of terms, through a sigmoid; terms are present or not.

    Terms are those of the rows it was fitted on; others have no weight that could be known.
    """

    def __init__(self, slots: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.slots, self.bias, self.w, self.v = slots, bias, w, v

    def score(self, at: np.ndarray) -> float:
        v = self.v[at].astype(float)
        z = self.bias + self.w[at].sum(dtype=float) + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()) / max(1, len(at))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Part:
    """Some rows' slots, row by row for sums over a row, and by slot for sums over a slot's rows."""

    def __init__(self, rows: np.ndarray, at: list[np.ndarray]):
        size = np.array([len(x) for x in at])
        self.rows, self.at = rows, np.concatenate(at)
        self.terms = np.maximum(size, 1).astype(np.float32)
        self.some = np.flatnonzero(size)
        self.first = (np.cumsum(size) - size)[self.some]
        order = np.argsort(self.at, kind="stable")
        self.row = np.repeat(np.arange(len(at), dtype=np.int32), size)[order]
        self.slots, self.begins = np.unique(self.at[order], return_index=True)

    def by_row(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.rows), *x.shape[1:]), np.float32)
        if len(self.some):
            out[self.some] = np.add.reduceat(x[self.at], self.first)
        return out

    def by_slot(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.row], self.begins) if len(self.slots) else np.zeros((0, *x.shape[1:]), np.float32)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 40, seed: int = 5) -> Machine:
    """Logistic loss, Adam, ridge, shrunk weights. Every term of the rows enters, however it relates to the label alone.

    Without both labels, the machine is its bias: the share of ones, smoothed.
    """
    n, ones = len(rows), int(labels.sum())
    base = (ones + 0.5) / (n + 1)
    slots = np.full(BUCKETS, -1, np.int32)
    bias = float(np.log(base / (1 - base)))
    if ones in (0, n):
        return Machine(slots, bias, np.zeros(1), np.zeros((1, FACTORS)))
    seen = np.zeros(BUCKETS, bool)
    for at in rows:
        seen[at] = True
    terms = int(seen.sum())
    slots[seen] = np.arange(terms)
    rng = np.random.default_rng(seed)
    k = max(1, terms)
    p = [np.array([bias], np.float32), np.zeros(k, np.float32), rng.normal(0, 0.02, (k, FACTORS)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(labels == 1, 0.5 / base, 0.5 / (1 - base)).astype(np.float32)
    parts = [Part(part, [slots[np.unique(rows[i])] for i in part]) for part in np.array_split(rng.permutation(n), max(min(n, PARTS), n // 256))]
    shrink = np.float32(0.02 * SHRINK / np.sqrt(len(parts)))
    step = 0
    for _ in range(epochs):
        for j in rng.permutation(len(parts)):
            b = parts[j]
            t = b.by_row(p[2])
            z = p[0] + b.by_row(p[1]) + 0.5 * ((t**2).sum(1) - b.by_row((p[2] ** 2).sum(1))) / b.terms
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[b.rows]) * weight[b.rows] / len(b.rows)).astype(np.float32)
            pair = e / b.terms
            g = [np.array([e.sum()]), 1e-4 * p[1], 1e-2 * p[2]]
            g[1][b.slots] += b.by_slot(e)
            g[2][b.slots] += b.by_slot(pair[:, None] * t) - p[2][b.slots] * b.by_slot(pair)[:, None]
            step += 1
            for i in range(3):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                s[i] = 0.99 * s[i] + 0.01 * g[i] ** 2
                p[i] = (p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            p[1] = np.sign(p[1]) * np.maximum(np.abs(p[1]) - shrink, 0)
    return Machine(slots, float(p[0][0]), p[1], p[2])


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = HELD_OUT, rows: int = SAMPLE) -> Machine:
    """Fit on a bounded sample; texts become buckets on the executors, and those alone are sent to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches(it, 256):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], pa.array([words.of(t).astype(np.int32) for t in b["text"].to_pylist()], pa.list_(pa.int32()))], ["doc_id", "label", "at"])

    got = labelled(documents, labels, label, held_out, rows).mapInArrow(run, "doc_id long, label int, at array<int>").toArrow()
    order = np.lexsort(([len(x) for x in got["at"]], got["doc_id"].to_numpy()))
    at = got["at"].combine_chunks() if got.num_rows else []
    return fit([np.array(at[int(i)].values, np.int32) for i in order], got["label"].to_numpy()[order].astype(np.float32))


def score(df: DataFrame, machine: Machine, held_out: tuple[int, int] = HELD_OUT, threshold: float = 0.5) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only the text is read. Null and empty texts get the score of no terms. Repeated rows are scored each; a null
    doc_id is kept. Other columns are ignored. An empty table gives an empty one.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(machine.slots)
        for b in batches(it, 512):
            s = pa.array([machine.score(words.of(t)) for t in b["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], s], ["doc_id", "score"])

    n, r = held_out
    out = text_of(df).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), n) == r).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
