"""Vectors as classes of equal rows, and a bounded sample of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches


def kind_of(df: DataFrame, vector: str = "embedding") -> type:
    """What components are kept as: floats where the column holds floats, as that loses nothing and halves what is sent."""
    return np.float32 if dict(df.dtypes)[vector] == "array<float>" else np.float64


def usable(df: DataFrame, vector: str = "embedding", *more: str) -> DataFrame:
    """vec_id, vector (little-endian bytes of kind_of) and the named columns. A vector that is null, empty, zero, or holds
    a null or a component that isn't finite, is null here."""
    types = dict(df.dtypes)
    kind = kind_of(df, vector)
    slim = df.select(F.col("vec_id").cast("long").alias("vec_id"), *more, F.col(vector).cast("array<float>" if kind is np.float32 else "array<double>").alias("v"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4096):
            out = []
            for v in b["v"]:
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    out.append(None)
                    continue
                x = v.values.to_numpy()
                with np.errstate(over="ignore"):
                    ok = np.isfinite(x).all() and (x != 0).any()
                out.append((x + 0.0).tobytes() if ok else None)  # adding zero makes -0.0 and 0.0 one value
            yield pa.RecordBatch.from_arrays([b["vec_id"], *(b[c] for c in more), pa.array(out, pa.binary())], ["vec_id", *more, "vector"])

    return slim.mapInArrow(run, ", ".join(["vec_id long", *(f"`{c}` {types[c]}" for c in more), "vector binary"]))


def matrix(raw: list[bytes], kind: type) -> np.ndarray:
    """Rows of equal-length vectors, as doubles."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64) if raw else np.zeros((0, 0))


def forest(a: np.ndarray, b: np.ndarray, hit: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n members that each one reaches, where hit tells which of rows a and columns b are linked."""
    root = np.arange(n)
    while True:
        before = root.copy()
        root[a] = np.minimum(root[a], np.where(hit, root[b][None, :], n).min(1, initial=n))
        root[b] = np.minimum(root[b], np.where(hit, root[a][:, None], n).min(0, initial=n))
        if (root == before).all():
            return root


def sample(classes: DataFrame, rows: int, *columns: str) -> pa.Table:
    """At most `rows` rows, those with the least hashes of their vectors: the same ones each time."""
    return classes.select(*columns).orderBy(F.xxhash64("vector"), "vector").limit(rows).toArrow()
