"""Nearest neighbours by adaptive dimension scans within inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, keep
from .vectors import kind_of, matrix, sample, usable

#: The index is fitted on at most so many distinct vectors, and so many bytes of doubles.
SAMPLE, SAMPLE_BYTES = 16384, 32 << 20
#: Centroids of each of the two levels, at most. Lists grow with the square root of the table up to their product.
COARSE, FINE = 1024, 1024
#: The index probes as many lists as found this share of the neighbours in the sample, and more where a query needs them.
RECALL = 0.985
#: Lists that each query scans first; what it finds there sets the radius for the others.
FIRST = 2
#: A candidate is given up where chance would leave it inside the radius with a likelihood of about exp(-SURE^2 / 2).
SURE = 3.0
#: Dimensions of a column block; candidates between two updates of the radius; members, and queries, of one task.
BLOCK, CHUNK, MEMBERS, QUERIES = 16, 1024, 8192, 4096
#: Numbers in a table of distances that is worked out at a time.
CELLS = 1 << 23


def _sq(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _means(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Lloyd's iterations from the given centroids."""
    c = first.copy()
    for _ in range(8):
        home = _sq(x, c).argmin(1)
        for j in np.unique(home):
            c[j] = x[home == j].mean(0)
    return c


class Index:
    """Two levels of centroids, a rotation and the least number of lists to probe, for vectors of one length.

    A list belongs to a coarse centroid and a fine one of what is left after it, so that a bounded sample fits as many
    lists as the table needs.
    """

    def __init__(self, vectors: np.ndarray, lists: int, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n, dims = vectors.shape
        self.rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        self.sample, self.k = vectors, k
        lists = max(1, lists)
        coarse = min(COARSE, lists, n)
        fine = min(FINE, -(-lists // coarse)) if coarse == COARSE else 1
        self.coarse = _means(vectors, vectors[rng.permutation(n)[:coarse]])
        rest = vectors - self.coarse[_sq(vectors, self.coarse).argmin(1)]
        self.fine = np.zeros((1, dims)) if fine == 1 else _means(rest, rest[rng.permutation(n)[:fine]])
        self.lists = coarse * fine
        self.step = max(1, CELLS // max(self.lists, n))
        self.homes, _ = self.home(vectors)
        some = rng.permutation(n)[:256]
        near = np.argsort(_sq(vectors[some], vectors), 1, kind="stable")[:, 1 : k + 1]
        at = np.sort(np.concatenate([self.ranks(vectors[i : i + 1])[0][0][self.homes[m]] for i, m in zip(some, near, strict=True)])) if near.size else near.ravel()
        self.probes = int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))))]) + 1 if len(at) else self.lists
        self.extent = np.full(self.lists, np.inf)

    def centroids(self) -> np.ndarray:
        return (self.coarse[:, None] + self.fine[None]).reshape(-1, self.coarse.shape[1])

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row, and its distance from the list's centroid."""
        i = _sq(x, self.coarse).argmin(1)
        rest = x - self.coarse[i]
        j = _sq(rest, self.fine).argmin(1)
        return i * len(self.fine) + j, np.sqrt(((rest - self.fine[j]) ** 2).sum(1))

    def ranks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every list its place by distance of its centroid, the lists in that order, and the squared distances."""
        d = _sq(x, self.centroids())
        order = np.argsort(d, 1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(self.lists)[None], 1)
        return rank, order, d

    def first(self, x: np.ndarray) -> tuple[list[list[int]], list[float]]:
        """The nearest lists, and a squared radius within which k other vectors are sure to be: from the k + 2 nearest of the sample."""
        lists, radii = [], []
        for at in range(0, len(x), self.step):
            part = x[at : at + self.step]
            lists += self.ranks(part)[1][:, :FIRST].tolist()
            if len(self.sample) < self.k + 2:
                radii += [float("inf")] * len(part)
            else:
                radii += (np.partition(_sq(part, self.sample), self.k + 1, 1)[:, self.k + 1] * (1 + 1e-9) + 1e-12).tolist()
        return lists, radii

    def rest(self, x: np.ndarray, radii: np.ndarray) -> list[list[int]]:
        """Further lists by distance of their centroids: as many as the sample tells, and on to the last that holds one of the
        sample within the radius; without those whose members are all beyond it."""
        out = []
        for at in range(0, len(x), self.step):
            part, r = x[at : at + self.step], radii[at : at + self.step]
            rank, order, d = self.ranks(part)
            inside = _sq(part, self.sample) <= r[:, None]
            last = np.where(inside, rank[:, self.homes], -1).max(1, initial=-1)
            reach = np.sqrt(d) - self.extent[None] <= np.sqrt(r)[:, None] * (1 + 1e-6) + 1e-6
            for i in range(len(part)):
                far = order[i, FIRST : max(self.probes, last[i] + 1)]
                out.append(far[reach[i, far]].tolist())
        return out


def scan(q: np.ndarray, turned: np.ndarray, rotated: np.ndarray, whole: np.ndarray, radius: float, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, squared distances) of candidates within the squared radius of q, at most k and all that tie with the k-th.

    turned and rotated: q and the candidates after the rotation; their difference is summed block by block of columns.
    After d of D dimensions the partial sum times D / d estimates the distance, as the rotation is random. A candidate whose
    estimate is beyond radius * (1 + SURE / sqrt(d))^2 is given up. What is left is measured on the original vectors. After
    every CHUNK candidates the radius shrinks to the k-th distance so far. Rows in skip aren't candidates.
    """
    n, dims = rotated.shape
    rows, found = np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, n, CHUNK):
        alive = np.arange(start, min(start + CHUNK, n))
        if skip is not None:
            alive = alive[~skip[alive]]
        partial = np.zeros(len(alive))
        for at in range(0, dims, BLOCK):
            end = min(at + BLOCK, dims)
            part = rotated[alive, at:end] - turned[at:end]
            partial = partial + np.einsum("ij,ij->i", part, part)
            allowed = radius * (1 + SURE / np.sqrt(end)) ** 2 if end < dims else radius * (1 + 1e-9) + 1e-12
            near = partial * (dims / end) <= allowed
            alive, partial = alive[near], partial[near]
            if not len(alive):
                break
        if len(alive):
            diff = whole[alive] - q
            rows, found = np.concatenate((rows, alive)), np.concatenate((found, np.einsum("ij,ij->i", diff, diff)))
            if len(rows) > k:
                least = np.partition(found, k - 1)[k - 1]
                near = found <= least
                rows, found, radius = rows[near], found[near], min(radius, float(least) * (1 + 1e-9) + 1e-12)
    return rows, found


def nearest(df: DataFrame, queries: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """For rows for which `queries` holds (a condition on vec_id), their k nearest other rows by Euclidean distance.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller vec_id; all, if fewer than k.

    Vectors that are null, empty, zero or not finite take no part, and vectors of other lengths are no candidates.
    Rows that share the query's vec_id are its own and take no places, whatever their vectors. A repeated query row is
    answered once for each vec_id and vector; null ids are neither queries nor answers. An empty table gives an empty one.

    Equal vectors are one class that knows its k + 1 smallest ids (no answer needs more). Inverted lists are fitted on
    a bounded sample and hold every class; their number grows with the square root of the table. Each query scans its
    nearest lists first, which sets its radius; with that, it visits further lists as far as the sample or the radius tells
    (Index.rest), and the radius shrinks on within each list. A query that is left with too few answers is run again over
    all lists of its length, without a radius. A list of any size is cut into tasks of MEMBERS vectors by QUERIES queries.
    Recall is what probing and the tests lose; see the tests.
    """
    kind = kind_of(df, vector)
    width = np.dtype(kind).itemsize
    rows = keep(usable(df, vector).where("vector IS NOT NULL AND vec_id IS NOT NULL"), "vectors")
    order = W.partitionBy("vector").orderBy("vec_id")
    firsts = rows.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    classes = keep(firsts.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vector")), F.lit(width))).first()
    lists = int(max(1, n**0.5))
    some = sample(classes, max(64, min(SAMPLE, SAMPLE_BYTES // (longest // width * 8))), "vector")["vector"].combine_chunks().to_pylist()
    index = {length: Index(matrix([x for x in some if len(x) == length], kind), lists, k) for length in sorted({len(x) for x in some})}
    shared = df.sparkSession.sparkContext.broadcast(index)

    def by_length(raw: list[bytes], make) -> list:
        out = [None] * len(raw)
        for length in {len(x) for x in raw}:
            at = [i for i, x in enumerate(raw) if len(x) == length]
            for i, v in zip(at, make(shared.value.get(length), matrix([raw[i] for i in at], kind), np.array(at)), strict=True):
                out[i] = v
        return out

    def homes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                out = by_length(b["vector"].to_pylist(), lambda i, x, _: list(zip(*(y.tolist() for y in i.home(x)), strict=True)) if i else [(0, float("inf"))] * len(x))
                yield pa.RecordBatch.from_arrays([b["vector"], b["ids"], pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.float64())], ["vector", "ids", "list", "away"])

    def begin(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                got = by_length(b["vector"].to_pylist(), lambda i, x, _: list(zip(*i.first(x), strict=True)) if i else [([0], float("inf"))] * len(x))
                radius = [float("inf") if own is not None else g[1] for g, own in zip(got, b["own"].to_pylist(), strict=True)]  # the sample may be the query's own rows
                yield pa.RecordBatch.from_arrays([b["vector"], b["own"], pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array(radius, pa.float64())], ["vector", "own", "lists", "radius"])

    members = keep(classes.mapInArrow(homes, "vector binary, ids array<long>, list int, away double"), "members")
    length = F.octet_length("vector").alias("length")
    size = keep(members.groupBy(length, "list").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"), F.max("away").alias("extent")), "sizes")
    for at, which, extent in zip(*(c.to_numpy() for c in size.select("length", "list", "extent").toArrow()), strict=True):  # a row per list: COARSE * FINE at most for each length
        if at in index:
            index[at].extent[which] = extent
    spread = df.sparkSession.sparkContext.broadcast({x: i.extent for x, i in index.items()})

    def further(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, i in shared.value.items():
            i.extent = spread.value[x]
        for b in it:
            if b.num_rows:
                radius = b["radius"].to_numpy()
                got = by_length(b["vector"].to_pylist(), lambda i, x, at: i.rest(x, radius[at]) if i else [[]] * len(x))
                yield pa.RecordBatch.from_arrays([b["vector"], b["own"], pa.array(got, pa.list_(pa.int32())), b["radius"]], ["vector", "own", "lists", "radius"])

    # Equal vectors are one query, but for ids that stand on several vectors: these leave out their own rows as they search.
    asked = rows.where(queries).distinct()
    asked = keep(asked.join(asked.groupBy("vec_id").agg((F.count("*") > 1).alias("many")), "vec_id").select("vec_id", "vector", F.when(F.col("many"), F.col("vec_id")).alias("own")), "asked")
    visit = "vector binary, own long, lists array<int>, radius double"
    q = keep(asked.select("vector", "own").distinct().mapInArrow(begin, visit), "queries")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out_q, out_o, out_i, out_d = [], [], [], []
        if a.num_rows and b.num_rows:
            raw, own, radii = a["vector"].to_pylist(), a["own"].to_pylist(), a["radius"].to_numpy()
            qs, whole, ids = matrix(raw, kind), matrix(b["vector"].to_pylist(), kind), b["ids"].combine_chunks()
            i = shared.value.get(len(raw[0]))
            turn = i.rotation if i else np.eye(whole.shape[1])
            rotated, turned = whole @ turn, qs @ turn
            for i in range(len(qs)):
                skip = None if own[i] is None else np.array([x == [own[i]] for x in ids.to_pylist()])
                at, d = scan(qs[i], turned[i], rotated, whole, radii[i], k + 1, skip)
                out_q += [raw[i]] * len(at)
                out_o += [own[i]] * len(at)
                out_i.append(at)
                out_d.append(d)
            at = np.concatenate(out_i)
            return pa.table({"q": pa.array(out_q, pa.binary()), "own": pa.array(out_o, pa.int64()), "ids": ids.take(pa.array(at)), "score": np.sqrt(np.concatenate(out_d))})
        return pa.table({"q": pa.array([], pa.binary()), "own": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})

    keys = ["length", "list", "part", "share"]
    first_of = F.row_number().over(W.partitionBy("q", "own").orderBy("score", "vec_id"))

    def best(visits: DataFrame) -> DataFrame:
        """q, own, score, vec_id: the k + 1 nearest rows in the lists that are visited."""
        load = visits.groupBy("length", "list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
        cut = keep(size.drop("extent").join(load, ["length", "list"]), "cut")
        cut = broadcast_if_small(cut, cut.count())
        left = visits.join(cut, ["length", "list"]).select("length", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vector"), "shares").cast("int").alias("share"), "vector", "own", "radius")
        right = members.select("vector", "ids", length, "list").join(cut, ["length", "list"]).select("length", "list", F.pmod(F.xxhash64("vector", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "vector", "ids")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "q binary, own long, ids array<long>, score double")
        each = found.select("q", "own", "score", F.explode("ids").alias("vec_id")).where("own IS NULL OR vec_id <> own")
        return each.withColumn("r", first_of).where(F.col("r") <= k + 1).drop("r")

    visits = lambda df: df.select("vector", "own", "radius", length, F.explode("lists").alias("list"))
    found = keep(best(visits(q)), "found")
    known = found.groupBy("q", "own").agg(F.max(F.struct(F.col("score"))).alias("s"), F.count("*").alias("n")).where(F.col("n") > k)
    same = lambda x, y: (F.col(f"{x}.vector") == F.col(f"{y}.q")) & F.col(f"{x}.own").eqNullSafe(F.col(f"{y}.own"))
    shrunk = q.alias("a").join(known.alias("b"), same("a", "b"), "left").select("a.vector", "a.own", "a.lists", F.least("a.radius", F.coalesce(F.col("b.s.score") * F.col("b.s.score") * (1 + 1e-9) + 1e-12, F.col("a.radius"))).alias("radius"))
    more = keep(shrunk.mapInArrow(further, visit), "further")
    few = found.unionByName(best(visits(more))).withColumn("r", first_of).where(F.col("r") <= k + 1).drop("r")
    few = keep(few, "found")
    drop(found)
    full = few.groupBy("q", "own").agg(F.count("*").alias("n")).where(F.col("n") > k)
    short = keep(q.select("vector", "own").alias("a").join(full.alias("b"), same("a", "b"), "left_anti"), "short")
    if not short.isEmpty():
        wide = short.select("vector", "own", F.lit(float("inf")).alias("radius"), length).join(broadcast_if_small(size.select("length", "list"), size.count()), "length")
        rest = few.alias("b").join(short.alias("a"), same("a", "b"), "left_anti")
        few = rest.unionByName(best(wide))
    met = asked.alias("a").join(few.alias("b"), same("a", "b")).select(F.col("a.vec_id").alias("query_id"), "b.q", "b.score", "b.vec_id").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
