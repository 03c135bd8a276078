"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep
from .components import components
from .vectors import forest, kind_of, matrix, sample, usable

#: A vector is described by its NEAREST pivots, in order; candidates share SHARED of them at least.
NEAREST, SHARED = 8, 3
#: Pivots are drawn from a sample of at most so many distinct vectors, and so many bytes of doubles.
SAMPLE, SAMPLE_BYTES = 4096, 64 << 20
APART = 0.8
#: Vectors of one block, which is compared as a whole with others. Lists beyond it are split by a further pivot first.
BLOCK = 1024
#: Similarities are worked out for so many rows of a block at a time.
STEP = 256


def pivots_for(vectors: int) -> int:
    """More pivots for more vectors, so that inverted lists stay short; at most SAMPLE, from where on lists are split further."""
    return int(min(SAMPLE, max(64, 4 * vectors**0.5)))


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """The first rows of x, at most `most`, no two with a cosine above APART: pivots within one group of near copies
    would order its members by chance."""
    chosen = np.zeros((0, x.shape[1]))
    for at in range(0, len(x), 64):
        for row in x[at : at + 64][(x[at : at + 64] @ chosen.T <= APART).all(1)] if len(chosen) else x[at : at + 64]:
            if len(chosen) < most and (not len(chosen) or (chosen @ row).max() <= APART):
                chosen = np.concatenate((chosen, row[None]))
    return chosen


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The `nearest` pivots of each row of unit vectors, as ascending numbers."""
    k = min(nearest, len(pivots))
    return np.sort(np.argpartition(-(x @ pivots.T), k - 1, 1)[:, :k], 1)


def rarest_first(pivots: np.ndarray, x: np.ndarray, nearest: int) -> np.ndarray:
    """Pivots ordered by how seldom they are among the nearest of the rows of x. A list is headed by the first pivots that its
    members share, so vectors meet in the shortest lists that they can."""
    seen = np.bincount(nearest_pivots(x, pivots, nearest).ravel(), minlength=len(pivots))
    return pivots[np.argsort(seen, kind="stable")]


def described(classes: DataFrame, pivots: dict[int, np.ndarray], kind: type, nearest: int) -> DataFrame:
    """Adds `near`: the numbers of a vector's nearest pivots of its own length, ascending. pivots: unit rows by bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = b["vector"].to_pylist()
            near: list = [None] * len(raw)
            for length in {len(x) for x in raw}:
                at = [i for i, x in enumerate(raw) if len(x) == length]
                x = _unit(matrix([raw[i] for i in at], kind))
                p = pivots.get(length)
                for i, row in zip(at, nearest_pivots(x, np.ones((1, x.shape[1])) if p is None else p, nearest).tolist(), strict=True):
                    near[i] = row
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["copies"], b["vector"], pa.array(near, pa.list_(pa.int32()))], ["id", "label", "copies", "vector", "near"])

    return classes.select("id", "label", "copies", "vector").mapInArrow(run, f"id long, label {dict(classes.dtypes)['label']}, copies long, vector binary, near array<int>")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def placed(described_: DataFrame, shared: int, block: int) -> DataFrame:
    """id, list (label, bytes, head), blocks: the inverted lists in which vectors meet.

    Two vectors that share `shared` pivots or more, in ascending order, share the first of them, and this one isn't among
    the last shared - 1 of either: so a vector goes into the lists of its other pivots alone. A list of more than `block`
    members is split by the next shared pivot in the same way, as far as `shared` pivots name a list. Lists of one are left out.
    """
    open_ = described_.select("id", "label", F.octet_length("vector").alias("bytes"), "near", F.array().cast("array<int>").alias("head"), F.lit(-1).alias("last"))
    out = None
    need = F.least(F.lit(shared), F.size("near"))  # a length of few pivots has no more to share
    for level in range(1, shared + 1):
        usable_ = F.filter(F.transform("near", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x, level=level: (x["i"] > F.col("last")) & (x["i"] < F.size("near") - need + level))
        rows = open_.select("id", "label", "bytes", "near", "head", F.explode(usable_).alias("_x")).select("id", "label", "bytes", "near", F.array_append("head", F.col("_x.p")).alias("head"), F.col("_x.i").alias("last"))
        rows = keep(rows, "lists")
        sizes = keep(rows.groupBy("label", "bytes", "head").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        met = rows.join(sizes, ["label", "bytes", "head"])
        end = met.where((F.col("n") <= block) | (need == level))
        end = end.select("id", "label", "bytes", "head", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        out = end if out is None else out.unionByName(end)
        open_ = met.where((F.col("n") > block) & (need > level)).drop("n")
        if level < shared and sizes.where(F.col("n") > block).isEmpty():
            break
    return out


def near_duplicates(df: DataFrame, cosine: float = 0.98, vector: str = "embedding", nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """Links vectors of one label whose cosine (double precision) is at least `cosine`.

    Returns a row for each row of df: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable), kept (vec_id = component_id). df has vec_id, label and the vector column; others are ignored.

    A null label, or a vector that is null, empty, zero or not finite throughout, links with nothing; vectors of
    different lengths don't either. Rows that repeat a vec_id count as that many vectors with one component. A null
    vec_id: such rows are counted as partners, and have a null component. An empty table gives an empty one. Pivots
    equally near are taken as numpy's partition leaves them, the same way for equal vectors.

    Equal vectors of a label are one class (by a digest of 32 bytes) with a count, so copies cost nothing. Classes are
    described by their nearest pivots; vectors meet in the inverted lists of pivots that they share (see placed), and
    lists that are long even so are cut into blocks that meet pairwise. Within a meeting, pairs are verified, and the
    pivots that they share are counted; a pair belongs to the list of the first pivots that both name, so it counts once.
    Nothing is emitted for a pair: a meeting yields sums of links by vector, and the edges of a spanning forest, of which no
    more than vectors exist. If a third of all distinct vectors lie within one another's reach, their links are as many as
    pairs, and counting them is that much arithmetic, spread over blocks.
    """
    kind = kind_of(df, vector)
    width = np.dtype(kind).itemsize
    digest = F.when(F.col("vector").isNotNull() & F.col("label").isNotNull(), F.unhex(F.sha2(F.concat(F.md5(F.col("label").cast("string").cast("binary")).cast("binary"), F.col("vector")), 256)))
    rows = keep(usable(df, vector, "label").withColumn("digest", digest), "vectors")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vector")), F.lit(width))).first()
    some = sample(classes, max(64, min(SAMPLE, SAMPLE_BYTES // (longest // width * 8))), "vector")["vector"].combine_chunks().to_pylist()
    pivots = {}
    for length in {len(x) for x in some}:
        own = _unit(matrix([x for x in some if len(x) == length], kind))
        pivots[length] = rarest_first(spread(own, pivots_for(n)), own, nearest)
    described_ = keep(described(classes, pivots, kind, nearest), "described")
    member = described_.select("id", "copies", "vector", "near").join(placed(described_, shared, block), "id")
    # Each block goes to its meetings: (own, own) and (own, any other); a list of B blocks has B (B + 1) / 2.
    member = member.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    sent = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("label", "bytes", "head", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "copies", "vector", "near")

    def meet(t: pa.Table) -> pa.Table:
        head, x, y = t["head"][0].as_py(), t["x"][0].as_py(), t["y"][0].as_py()
        t = t.sort_by("id")
        block_, ids, copies = t["block"].to_numpy(), t["id"].to_numpy(), t["copies"].to_numpy()
        u = _unit(matrix(t["vector"].to_pylist(), kind))
        near = np.array(t["near"].to_pylist())
        names, at = np.unique(near, return_inverse=True)
        has = np.zeros((len(ids), len(names)), np.float32)
        has[np.arange(len(ids))[:, None], at.reshape(near.shape)] = 1
        upto = names <= head[-1]
        a = np.flatnonzero(block_ == x)
        b = a if x == y else np.flatnonzero(block_ == y)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        if len(a) and len(b):
            hit = np.zeros((len(a), len(b)), bool)
            for s in range(0, len(a), STEP):
                i = a[s : s + STEP]
                near_ = u[i] @ u[b].T >= cosine
                if near_.any():
                    # The list's own pivots are the first that a pair shares.
                    near_ &= (has[i] @ has[b].T >= min(shared, near.shape[1])) & (has[i][:, upto] @ has[b][:, upto].T == len(head))
                hit[s : s + STEP] = near_
            if x == y:
                np.fill_diagonal(hit, False)
            links[a] += hit @ copies[b]
            if x != y:
                links[b] += copies[a] @ hit
            root = forest(a, b, hit, len(ids))
        joined, at = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate((ids[at], ids[joined])), pa.int64()),
            "b": pa.array([None] * len(at) + ids[root[joined]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate((links[at], np.zeros(len(joined), np.int64))), pa.int64()),
        })

    met = keep(sent.groupBy("label", "bytes", "head", "x", "y").applyInArrow(meet, "a long, b long, n long"), "met")
    drop(described_)
    counts = met.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    root = keep(components(met.where("b IS NOT NULL").select("a", "b")), "labels")
    named = classes.select("id", "digest", "low", "copies").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("low").alias("least"))
    done = named.join(least, "root").join(counts, "id", "left").select("digest", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("vec_id", "digest").join(done, "digest", "left")
    component = F.when(F.col("links").isNull() | F.col("vec_id").isNull(), F.col("vec_id")).otherwise(F.least("least", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
