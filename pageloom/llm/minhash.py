"""MinHash near-dedup with SetSketch registers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, drop, keep, shingle_hashes, text_of, words_of
from .components import components
from .vectors import forest

BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Registers are spaced by this factor: 255 of them span minima from 1 / 10^9 to 30.
BASE = 1.1
#: Estimates this far (in standard errors) below the threshold aren't verified; three true pairs in 10^7 are that far off.
ERRORS = 5.0
#: Members of a bucket that are compared as pairs of rows of one batch; larger buckets are cut into blocks that meet.
FEW, BUCKET = 16, 1024
#: Sets that one block of a meeting holds: bytes, documents.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 2048

_rng = np.random.default_rng(0x5E75)
_ODD = (_rng.integers(0, 1 << 63, REGISTERS, np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes: floor(1 - log_b of the least exponential variate), cut to one byte.

    Minima merge by minimum, so registers merge by maximum.
    """
    low = np.full(REGISTERS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _ODD + _ADD
        part ^= part >> np.uint64(31)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, part.min(0), out=low)
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    with np.errstate(divide="ignore"):
        x = -np.log1p(-np.minimum(u, 1 - 2.0**-53))
        k = np.floor(1 - np.log(x) / math.log(BASE))
    return np.clip(k + 36, 0, 255).astype(np.uint8)


def _slope(j: np.ndarray, up: np.ndarray, down: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How the likelihood of similarity j changes with j, where `up` registers are greater in the first set and `down` less.

    With u = (na - nb j) / (na + nb), v likewise and p(x) = -log_b(1 - x (b - 1) / b), registers are greater with
    chance p(u), less with p(v) and else equal.
    """
    a, b = na / (na + nb), nb / (na + nb)
    c, log_b = (BASE - 1) / BASE, math.log(BASE)
    u, v = np.maximum(a - b * j, 1e-12), np.maximum(b - a * j, 1e-12)
    pu, pv = -np.log1p(-u * c) / log_b, -np.log1p(-v * c) / log_b
    du, dv = -b * c / (1 - u * c) / log_b, -a * c / (1 - v * c) / log_b
    return up * du / pu + down * dv / pv - (REGISTERS - up - down) * (du + dv) / np.maximum(1 - pu - pv, 1e-12)


def reaches(least: float, up: np.ndarray, down: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the estimate is `least` or more: the likelihood is concave, so it is enough that it still rises there."""
    return (np.minimum(na / nb, nb / na) >= least) & (_slope(least, up, down, na, nb) >= 0)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers by maximum likelihood, given the set sizes: halving steps within its bounds."""
    up, down = (ra > rb).sum(1).astype(float), (ra < rb).sum(1).astype(float)
    lo, hi = np.zeros(len(up)), np.minimum(na / nb, nb / na)
    for _ in range(30):
        mid = (lo + hi) / 2
        rising = _slope(mid, up, down, na, nb) > 0
        lo, hi = np.where(rising, mid, lo), np.where(rising, hi, mid)
    return (lo + hi) / 2


def sketches(df: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest (16 bytes of the set; null if empty), registers (null if empty) of every text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches(it, 512):
            n, digest, regs = [], [], []
            last: tuple[bytes | None, bytes | None] = (None, None)
            for text in b["text"].to_pylist():
                s = shingle_hashes(hashes.of(words_of(text)), size)
                n.append(len(s))
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                if d != last[0]:
                    last = (d, registers(s).tobytes() if d else None)
                digest.append(d)
                regs.append(last[1])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])

    return text_of(df).mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def _floor(num: int, den: int) -> float:
    """Estimates below this don't come from pairs at num / den."""
    t = num / den
    return t - ERRORS * math.sqrt(t * (1 - t) / REGISTERS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow a similarity of `least`, with the estimate."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("registers").alias(f"r{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(na, nb) >= {least}D * greatest(na, nb)")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            ra, rb = (_matrix(b[k]) for k in ("ra", "rb"))
            na, nb = b["na"].to_numpy().astype(float), b["nb"].to_numpy().astype(float)
            at = np.flatnonzero(reaches(least, (ra > rb).sum(1), (ra < rb).sum(1), na, nb))
            yield pa.RecordBatch.from_arrays([b["a"].take(pa.array(at)), b["b"].take(pa.array(at)), pa.array(estimate(ra[at], rb[at], na[at], nb[at]))], ["a", "b", "j"])

    return met.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, j double")


def _within(ids: np.ndarray, label: np.ndarray, n: np.ndarray, regs: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges (rows x, rows y, estimate) of a meeting of members a and b of one bucket: of each member the likeliest other
    of a different label, and (estimate 0) what connects all that are likely. No more than twice the members."""
    size = n.astype(float)
    hit = np.zeros((len(a), len(b)), bool)
    best, partner = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
    for k, i in enumerate(a):
        other = np.flatnonzero(label[b] != label[i])
        if not len(other):
            continue
        up, down = (regs[i] > regs[b[other]]).sum(1), (regs[i] < regs[b[other]]).sum(1)
        ok = reaches(least, up, down, size[i], size[b[other]])
        at, same = other[ok], REGISTERS - up[ok] - down[ok]
        hit[k, at] = True
        for x, y, s in ((np.full(len(at), i), b[at], same), (b[at], np.full(len(at), i), same)):
            # a partner has the smaller id, so that these edges form no circle
            ok = ids[y] < ids[x]
            x, y, s = x[ok], y[ok], s[ok]
            order = np.argsort(s, kind="stable")
            better = s[order] > best[x[order]]
            best[x[order][better]], partner[x[order][better]] = s[order][better], y[order][better]
    got = np.flatnonzero(best >= 0)
    if len(got):
        yield got, partner[got], estimate(regs[got], regs[partner[got]], size[got], size[partner[got]])
        root = forest(a, b, hit, len(ids))
        joined = np.flatnonzero(root != np.arange(len(ids)))
        yield joined, root[joined], np.zeros(len(joined))


def _across(rest: DataFrame, least: float) -> DataFrame:
    """Likely pairs (a, b, j) of members of one bucket that have different labels. rest: key, main, fewer, more, id, l, n, registers.

    A bucket's members stand together in one task, sorted; small buckets are compared row by row at every distance, at
    once for a whole batch. A bucket of many members is cut into blocks that meet pairwise: `fewer` blocks of members whose
    label isn't the bucket's commonest (main), which meet all, and `more` blocks of the others, which don't meet one
    another. A meeting yields no more edges than twice its members, so that pairs are never rows.
    """
    of = F.when((F.col("l") == F.col("main")) & (F.col("more") > 0), F.col("fewer") + F.pmod(F.xxhash64("id", F.lit(9)), F.col("more"))).otherwise(F.pmod(F.xxhash64("id", F.lit(9)), F.col("fewer")))
    others = F.sequence(F.lit(0), F.when(F.col("block") < F.col("fewer"), F.col("fewer") + F.col("more") - 1).otherwise(F.col("fewer") - 1).cast("int"))
    sent = rest.withColumn("block", of.cast("int")).select("key", "id", "l", "n", "registers", "block", F.explode(others).alias("other"))
    sent = sent.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "l", "n", "registers")

    def compare(t: pa.RecordBatch) -> pa.RecordBatch:
        key, x, y, block, ids, label, n = (t[c].to_numpy() for c in ("key", "x", "y", "block", "id", "l", "n"))
        regs, size = _matrix(t["registers"]), n.astype(float)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        count = np.diff(np.append(new, len(key)))
        group = np.repeat(np.arange(len(new)), count)
        few = (count <= FEW)[group]
        out = []
        for far in range(1, min(FEW, len(key))):
            i = np.flatnonzero(few[:-far] & (group[:-far] == group[far:]) & (label[:-far] != label[far:]))
            k = i + far
            ok = reaches(least, (regs[i] > regs[k]).sum(1), (regs[i] < regs[k]).sum(1), size[i], size[k])
            i, k = i[ok], k[ok]
            out.append((i, k, estimate(regs[i], regs[k], size[i], size[k])))
        for at, m in zip(new[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
            part = slice(at, at + m)
            a, b = np.flatnonzero(block[part] == x[at]), np.flatnonzero(block[part] == y[at])
            out += [(i + at, k + at, j) for i, k, j in _within(ids[part], label[part], n[part], regs[part], a, b, least)]
        i, k, j = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[k]), pa.int64()), pa.array(np.maximum(ids[i], ids[k]), pa.int64()), pa.array(j, pa.float64())], ["a", "b", "j"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last group, which may go on
        for b in it:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = t.slice(t.num_rows - 1)
            cut = t.num_rows
            names = [(c, t[c].to_numpy(), last[c][0].as_py()) for c in ("key", "x", "y")]
            same = np.logical_and.reduce([v == w for _, v, w in names])
            cut = int(np.argmax(same))
            held = t.slice(cut)
            if cut:
                yield compare(t.slice(0, cut).combine_chunks().to_batches()[0])
        if held is not None:
            yield compare(held.combine_chunks().to_batches()[0])

    return sent.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id").mapInArrow(run, "a long, b long, j double")


def _full_sets(ids: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """id and its whole set (64-bit hashes, sorted), made anew from the texts: they are shuffled once, here.

    texts: id, text, digest (that of the text that counts, or null where an id has one text only).
    """

    def to_sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches(it, 256):
            made = [shingle_hashes(hashes.of(words_of(t)), size).tobytes() for t in b["text"].to_pylist()]
            ok = pa.array([d is None or d == hashlib.blake2b(s, digest_size=16).digest() for d, s in zip(b["digest"].to_pylist(), made, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["id"].filter(ok), pa.array(made, pa.binary()).filter(ok)], ["id", "s"])

    return texts.join(ids.hint("merge"), "id").select("id", "text", "digest").mapInArrow(to_sets, "id long, s binary")


def _verified(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Links among pairs (a, b), confirmed on the full sets."""
    sides = pairs.select(F.col("a").alias("id"), F.struct("a", "b").alias("p")).unionByName(pairs.select(F.col("b").alias("id"), F.struct("a", "b").alias("p")))
    # A pair's two sets meet at the pair, not at a hub: no task holds all partners of one document.
    both = sides.join(full, "id").groupBy("p").agg(F.min_by("s", "id").alias("x"), F.max_by("s", "id").alias("y"))

    def test(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * inter >= num * (len(x) + len(y) - inter))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(ok), b["b"].filter(ok)], ["a", "b"])

    return both.select("p.a", "p.b", "x", "y").mapInArrow(test, "a long, b long")


def _meetings(placed: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Links among all documents of a group (placed: id, grp, blocks), as edges that connect what links connect.

    A group's documents are dealt to blocks of bounded size, and blocks meet pairwise. A meeting holds whole sets; common
    shingles are counted by products of 0/1 matrices, so pairs are never rows.
    """
    sets = full.join(placed, "id")
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    sent = sets.select("id", "grp", "s", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("grp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "s")

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, block = t["id"].to_numpy(), t["block"].to_numpy()
        raw = [np.frombuffer(x, np.uint64) for x in t["s"].to_pylist()]
        n = np.array([len(x) for x in raw])
        names, at, times = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(raw)), n)
        often = times > 1  # a shingle of one document alone is common to no pair
        slot = np.cumsum(often) - 1
        use = often[at]
        doc, col = doc[use], slot[at[use]]
        order = np.argsort(col, kind="stable")
        doc, col = doc[order], col[order]
        a, b = np.flatnonzero(block == t["x"][0].as_py()), np.flatnonzero(block == t["y"][0].as_py())
        inter = np.zeros((len(a), len(b)), np.int64)
        for first in range(0, int(often.sum()), 2048):
            lo, hi = np.searchsorted(col, (first, first + 2048))
            m = np.zeros((len(raw), 2048), np.float32)
            m[doc[lo:hi], col[lo:hi] - first] = 1
            inter += (m[a] @ m[b].T).astype(np.int64)
        hit = den * inter >= num * (n[a][:, None] + n[b][None] - inter)
        root = forest(a, b, hit, len(ids))
        joined = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[root[joined]], "b": ids[joined]})

    return sent.groupBy("grp", "x", "y").applyInArrow(meet, "a long, b long")


def near_duplicates(df: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Near copies by Jaccard similarity >= num / den of sets of `size`-word shingles.

    Returns one row per row of df: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself
    included), kept (doc_id = component_id). df has doc_id and text; other columns are ignored.

    Null and empty texts have no shingles and link with nothing. Texts shorter than a shingle have one, the whole.
    Rows that repeat a doc_id are one document, by the text whose set has the least digest; each row has its own
    n_shingles. A null doc_id gives a null component and false. An empty table gives an empty one.

    Sets are of 64-bit hashes of shingles; links are confirmed on these sets, whole. Documents with equal sets are one
    class from the start. Classes meet where a band of ROWS registers is equal; with 30 bands of 5, a pair at 0.8 is
    missed with chance 7e-6. In each bucket, members are first held against its smallest member by the registers'
    likelihood: a row for each member, not for each pair. Those whose estimate may belong to a pair at the threshold form
    groups, and members of one bucket in different groups are then held against one another (_across). So groups
    hold what is likely near, and no two documents that are merely alike, as by a template, are compared on sets. Of
    each member, the likeliest pair is verified on full sets; that settles most groups. In a group that these links don't
    connect, all documents are compared, block by block (_meetings). Groups, hubs and buckets are sums, minima or joins.
    """
    own = keep(sketches(df, size), "sketches")
    valid = own.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    texts = text_of(df).withColumnRenamed("doc_id", "id").where("id IS NOT NULL")
    repeated = keep(valid.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.count("*").alias("rows")).where("rows > 1"), "repeated")
    if repeated.isEmpty():
        texts = texts.withColumn("digest", F.lit(None).cast("binary"))
    else:
        valid = valid.join(repeated, "doc_id", "left").where("least IS NULL OR digest = least").select(own.columns).dropDuplicates(["doc_id"])
        texts = texts.join(repeated.select(F.col("doc_id").alias("id"), F.col("least").alias("digest")), "id", "left")
    classes = keep(valid.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "classes")
    same = valid.select("doc_id", "digest").join(classes.select("digest", "id"), "digest").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    sets = classes.select("id", "n", "registers")
    bands = sets.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("registers", i * ROWS + 1, ROWS))).alias("band", "value"))
    bands = bands.select("id", F.xxhash64("band", "value").alias("key"))
    # Buckets of one never link: counting first keeps the rest small. It is written, so that the join may split hot keys.
    firsts = keep(bands.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first"), "buckets")
    bands = keep(bands.join(firsts, "key").select("key", "id", "first"), "bands")
    drop(firsts)
    stars = bands.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    floor = _floor(num, den)
    stars = keep(_likely(stars, sets, floor), "stars")
    group = keep(components(stars.select("a", "b")).select("id", F.col("root").alias("grp")), "groups")
    named = bands.select("key", "id").join(group, "id", "left").select("key", "id", F.coalesce("grp", "id").alias("l"))
    labels = named.groupBy("key", "l").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("l", F.struct("k", "l")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"), F.count("*").alias("labels"))
    cut = lambda c, alone: F.when(F.col("all") <= BUCKET, alone).otherwise(F.ceil(c / BUCKET)).cast("int")
    mixed = labels.where("labels > 1").select("key", "main", cut(F.col("all") - F.col("most"), 1).alias("fewer"), cut(F.col("most"), 0).alias("more"))
    rest = named.join(keep(mixed, "mixed"), "key").join(sets, "id").select("key", "main", "fewer", "more", "id", "l", "n", "registers")
    across = keep(_across(rest, floor), "across")
    drop(bands)
    if not across.isEmpty():
        group = keep(components(stars.select("a", "b").unionByName(across.select("a", "b"))).select("id", F.col("root").alias("grp")), "groups")
    full = keep(_full_sets(group.select("id"), texts, size), "full")

    best = stars.unionByName(across).groupBy("b").agg(F.max_by("a", F.struct("j", -F.col("a"))).alias("a"), F.max("j").alias("j")).where(F.col("j") >= floor).select("a", "b")
    links = keep(_verified(best, full, num, den), "links")
    # Each member but the first has one likeliest pair, with a smaller id: if all of them are links, they connect the group.
    inside = links.join(group.withColumnRenamed("id", "b"), "b").groupBy("grp").agg(F.count("*").alias("k"))
    member = group.join(sets.select("id", "n"), "id")
    groups = member.groupBy("grp").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.sum("n") * 8 / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks"))
    # A group of two is settled by its pair.
    open_ = keep(groups.where("size > 2").join(inside, "grp", "left").where("coalesce(k, 0) < size - 1").select("grp", "blocks"), "open")
    placed = group.join(open_, "grp").select("id", "grp", "blocks")
    met = keep(_meetings(placed, full, num, den), "links")
    drop(full)
    final = components(links.unionByName(met).unionByName(same))
    out = own.select("doc_id", "n_shingles").join(final.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
    root = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(False)).alias("kept"))
