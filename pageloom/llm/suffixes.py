"""Exact removal of repeated byte strings: a sparse suffix order by a distributed merge sort that knows common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, drop, keep, mix64, tasks_for

#: Bytes of a gram; a text is worked through in stretches of so many bytes.
GRAM, STRETCH = 99, 1 << 20
#: Bytes of front-coded suffixes that one merge should hold.
MERGE_BYTES = 4 << 20
#: Contexts of one core that are compared as a table; beyond that, by classes.
TABLE = 512
#: Bytes of contexts, and rows of places, that a task holds before it sends them on.
HELD, PLACES = 32 << 20, 1 << 15
#: A core with more occurrences than this isn't merged in one task: its strings are grouped by digest instead.
HOT = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(0xB17E).integers(1, 1 << 63, 256, np.uint64)
_POS_BITS = np.uint64(30)
_POS = (np.uint64(1) << _POS_BITS) - np.uint64(1)


class Powers:
    """Powers of the hash's base and of its inverse modulo 2^64, made once for a worker."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.up, cls.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b)))) for b in (_BASE, inverse))
        return cls.up, cls.down


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Cut:
    """How strings of `size` bytes are keyed. A string's anchor is its gram with the least hash, the first of equals; with
    the anchor in its first half, the string belongs to the core that starts there, else to one `half` bytes earlier.
    So equal strings have equal cores at equal places, and differ from one another only around the core."""

    def __init__(self, size: int):
        self.size, self.gram = size, max(1, min(GRAM, size // 2) - (size - min(GRAM, size // 2) + 1) % 2)
        self.width = size - self.gram + 1  # grams in a string: an even number
        self.half = self.width // 2
        self.core, self.flank = size - self.half + 1, self.half - 1

    def cores(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of the cores of a text, by start."""
        hashes, starts = [], []
        for at in range(0, max(1, len(raw) - self.size + 1), STRETCH):
            x = np.frombuffer(raw, np.uint8)[at : at + STRETCH + self.size - 1]
            n = len(x)
            if n < self.size:
                break
            up, down = Powers.of(n + 1)
            c = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[x] * up[:n], out=c[1:])
            g = mix64((c[self.gram :] - c[: -self.gram]) * down[: n + 1 - self.gram])
            low = least((g & ~_POS) | np.arange(len(g), dtype=np.uint64), self.width)
            anchor = np.unique((low & _POS).astype(np.int64))
            start = np.concatenate((anchor, anchor - self.half))
            start = start[(start >= 0) & (start + self.core <= n)]
            hashes.append(mix64((c[start + self.core] - c[start]) * down[start] + np.uint64(1)).view(np.int64))
            starts.append(start + at)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, i = np.unique(np.concatenate(starts), return_index=True)
        return np.concatenate(hashes)[i], s


# Runs: sorted suffixes, each without the bytes that it shares with the one before.


def encode_run(records: list[tuple[bytes, bytes, bytes, int]]) -> bytes:
    """records: (suffix, left flank reversed, digest of 16 bytes, times), sorted by suffix. Numbers are varints."""
    out, last = bytearray(), b""
    for s, left, digest, times in records:
        k, most = 0, min(len(last), len(s))
        if s[:most] == last[:most]:
            k = most
        else:
            while last[k] == s[k]:
                k += 1
        rest = s[k:]
        for v in (k, len(rest), len(left), times):
            while v > 127:
                out.append(v & 127 | 128)
                v >>= 7
            out.append(v)
        out += digest
        out += rest
        out += left
        last = s
    return bytes(out)


class Run:
    """The head of a run while it is merged: its string, and how much of it is known to equal the last output."""

    __slots__ = ("at", "digest", "known", "left", "raw", "s", "times")

    def __init__(self, raw: bytes):
        self.raw, self.at, self.s = raw, 0, b""
        self.next()

    def next(self) -> None:
        raw, i = self.raw, self.at
        if i >= len(raw):
            self.s = None
            return
        got = []
        for _ in range(4):
            v = shift = 0
            while raw[i] > 127:
                v |= (raw[i] & 127) << shift
                shift += 7
                i += 1
            got.append(v | raw[i] << shift)
            i += 1
        k, n, m, self.times = got
        self.digest = raw[i : i + 16]
        i += 16
        self.s = self.s[:k] + raw[i : i + n]
        self.left = raw[i + n : i + n + m]
        self.at = i + n + m
        self.known = k


def loses(a: Run, b: Run) -> bool:
    """Whether a comes after b; both know their common prefix with the last output, and the loser learns that with the winner."""
    if b.s is None:
        return False
    if a.s is None:
        return True
    if a.known != b.known:
        return a.known < b.known  # the one that agrees longer with what was smaller is smaller
    x, y, k = a.s, b.s, a.known
    most = min(len(x), len(y))
    if x[k:most] == y[k:most]:
        k = most
        after = len(x) > len(y)
    else:
        while x[k] == y[k]:
            k += 1
        after = x[k] > y[k]
    (a if after else b).known = k
    return after


def merge(runs: list[bytes]) -> Iterator[tuple[bytes, int, bytes, bytes, int]]:
    """(suffix, bytes shared with the suffix before, left flank reversed, digest, times) of all runs in order: a loser tree
    whose nodes keep the loser with its known prefix, so that no byte known to be equal is compared again."""
    heads = [Run(r) for r in runs]
    for h in heads:
        h.known = 0
    size = 1
    while size < len(heads):
        size *= 2
    end = Run(b"")
    heads += [end] * (size - len(heads))
    tree: list[Run] = [end] * size

    def play(node: int) -> Run:
        if node >= size:
            return heads[node - size]
        a, b = play(2 * node), play(2 * node + 1)
        if loses(a, b):
            tree[node] = a
            return b
        tree[node] = b
        return a

    place = {id(h): i + size for i, h in enumerate(heads)}
    winner = play(1) if size > 1 else heads[0]
    while winner.s is not None:
        yield winner.s, winner.known, winner.left, winner.digest, winner.times
        winner.next()
        node = place[id(winner)] // 2
        while node:
            if loses(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2


def _shared(sorted_: list[bytes]) -> np.ndarray:
    """Bytes that each string shares with the one before."""
    out = np.zeros(len(sorted_), np.int64)
    for i in range(1, len(sorted_)):
        a, b = sorted_[i - 1], sorted_[i]
        most = min(len(a), len(b))
        k = most
        if a[:most] != b[:most]:
            lo = 0
            while lo < k:  # halving: slices are compared, not bytes
                mid = (lo + k) // 2
                if a[lo : mid + 1] == b[lo : mid + 1]:
                    lo = mid + 1
                else:
                    k = mid
        out[i] = k
    return out


def reach(right: list[bytes], right_shared: np.ndarray, left: list[bytes], copies: np.ndarray, flank: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts of one core, sorted by right flank: how many bytes left and right of the core are in strings
    that occur twice (-1, -1: none). A string takes a bytes on the left and flank - a on the right."""
    n = len(right)
    rl, ll = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    far_l, far_r = np.full(n, -1), np.full(n, -1)
    own = (copies > 1) & (rl + ll >= flank)
    far_l[own], far_r[own] = ll[own], rl[own]
    if n == 1:
        return far_l, far_r
    by_left = sorted(range(n), key=left.__getitem__)
    left_shared = _shared([left[i] for i in by_left])
    if n <= TABLE:

        def table(shared: np.ndarray) -> np.ndarray:
            m = np.zeros((n, n), np.int64)
            for i in range(1, n):
                m[i, :i] = np.minimum(shared[i], np.append(m[i - 1, : i - 1], 1 << 30))
            return m + m.T

        r = table(right_shared)
        lt = table(left_shared)
        rank = np.empty(n, np.int64)
        rank[by_left] = np.arange(n)
        lt = lt[rank][:, rank]
        ok = lt + r >= flank
        np.fill_diagonal(ok, False)
        far_l = np.maximum(far_l, np.where(ok, lt, -1).max(1))
        far_r = np.maximum(far_r, np.where(ok, r, -1).max(1))
        return far_l, far_r
    order = np.array(by_left)
    for a in range(flank + 1):
        rc = np.cumsum(right_shared < flank - a)
        lc = np.empty(n, np.int64)
        lc[order] = np.cumsum(left_shared < a)
        can = (ll >= a) & (rl >= flank - a)
        _, which, count = np.unique((lc * (n + 1) + rc)[can], return_inverse=True, return_counts=True)
        got = np.flatnonzero(can)[count[which] > 1]
        far_l[got] = np.maximum(far_l[got], a)
        far_r[got] = np.maximum(far_r[got], flank - a)
    return far_l, far_r


def covered(run_blobs: list[bytes], cut: Cut) -> Iterator[tuple[bytes, int, int]]:
    """(digest, bytes left, bytes right of the core) of every context of the merged runs that has a repeated string."""
    group: dict[tuple[bytes, bytes], list] = {}

    def flush() -> Iterator[tuple[bytes, int, int]]:
        if not group or len(group) == 1 and next(iter(group.values()))[3] < 2:
            return
        items = list(group.values())
        far_l, far_r = reach([x[0] for x in items], np.array([x[4] for x in items]), [x[1] for x in items], np.array([x[3] for x in items]), cut.flank)
        for (_, _, digest, _, _), a, b in zip(items, far_l.tolist(), far_r.tolist(), strict=True):
            if a >= 0:
                yield digest, a, b

    low = 1 << 30
    for s, known, left, digest, times in merge(run_blobs):
        if known < cut.core:  # another core begins
            yield from flush()
            group, low = {}, 1 << 30
        low = min(low, known - cut.core) if group else 0
        key = (s[cut.core :], left)
        item = group.get(key)
        if item is None:
            # Shared with the last new context: the least of what was shared since.
            group[key] = item = [*key, digest, 0, low]
            low = 1 << 30
        item[3] += times
    yield from flush()


def grouped(contexts: DataFrame, cut: Cut) -> DataFrame:
    """What covered() returns, for contexts (digest, core, left, right, times) of cores that very many texts hold: each context's
    strings are rows, and equal ones meet by their own digest, so no core's contexts meet in one task."""
    one = keep(contexts.groupBy("digest").agg(F.first("core").alias("core"), F.first("left").alias("left"), F.first("right").alias("right"), F.sum("times").alias("times")), "hot")
    ll, rl = F.octet_length("left"), F.octet_length("right")
    own = one.where("times > 1").select("digest", ll.alias("a"), rl.alias("b"))
    bytes_ = lambda c, n: F.substring(c, F.lit(1), n)
    a = F.col("a")
    string = F.concat("core", F.lpad(a.cast("string"), 6, "0").cast("binary"), bytes_(F.col("left"), a), bytes_(F.col("right"), F.lit(cut.flank) - a))
    each = one.where(ll + rl >= cut.flank).select("digest", "core", "left", "right", F.explode(F.sequence(F.greatest(F.lit(0), F.lit(cut.flank) - rl), F.least(F.lit(cut.flank), ll))).alias("a"))
    each = keep(each.select("digest", "a", F.unhex(F.md5(string)).alias("string")), "strings")
    many = each.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    met = each.join(keep(many, "many"), "string").groupBy("digest").agg(F.max("a").alias("a"), (F.lit(cut.flank) - F.min("a")).alias("b"))
    return own.unionByName(met).groupBy("digest").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def repeats(df: DataFrame, size: int = 400, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each text as UTF-8 bytes; every byte in a string of `size` bytes that starts anywhere else too (in any text, the same
    one included; overlaps count) is removed.

    Returns a row for each row of df: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Null and empty texts have no bytes. Texts shorter than `size` are never touched. A text that occurs twice (repeated
    rows, exact copies) is removed whole. A null doc_id is kept; other columns are ignored; an empty table gives an
    empty one.

    Texts are told apart by digest, so copies are sorted once. Only suffixes at sampled places (Cut) are sorted, about
    one in seventy-five bytes, and of these only those whose core occurs twice by its hash: no repeated string is without
    one. What is sorted is the suffix itself, from its core's first byte on; the bytes before it go along. Each task
    sorts its own, front-codes them, and sends a run to each merge; merges are loser trees over runs. Equal suffixes
    always meet in one merge, a task sends equal ones once, and where they stand isn't sent: places are joined to the outcome
    by a digest of 16 bytes. So a merge holds the distinct surroundings of its cores, one core's at a time; those of a
    core with more than HOT occurrences don't go to a merge at all (grouped).
    """
    cut = Cut(size)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    digest = F.sha2(F.col("raw"), 256)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), raw.alias("raw")).withColumn("sha", digest).withColumn("key", F.substring(F.unhex("sha"), 1, 16))

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 256):
            out, n = [], []
            for x in b["raw"].to_pylist():
                h, _ = cut.cores(x)
                h.sort()
                # A core that a text holds twice counts twice, and no more.
                out.append(h[np.concatenate((np.ones(min(2, len(h)), bool), h[2:] != h[:-2]))])
                n.append(len(x))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], b["sha"], pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "key", "sha", "n_bytes", "cores"])

    base = keep(docs.mapInArrow(find, "doc_id long, key binary, sha string, n_bytes long, cores array<long>"), "texts")
    single = base.groupBy("key").agg(F.count("*").alias("rows"), F.first("n_bytes").alias("n"))
    whole = keep(single.where(f"rows > 1 AND n >= {size}").select("key"), "copies")
    one = base.where(f"n_bytes >= {size}").groupBy("key").agg(F.first("cores").alias("cores"))
    cores = keep(one.select("key", F.explode("cores").alias("core")), "cores")
    twice = keep(cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core", (F.col("n") > HOT).alias("hot")), "twice")
    found = cores.join(twice, "core").groupBy("key").agg(F.collect_set("core").alias("cores"), F.collect_set(F.when(F.col("hot"), F.col("core"))).alias("hot"))
    met = keep(docs.select("key", "raw").dropDuplicates(["key"]).join(found, "key").withColumn("text", F.monotonically_increasing_id()), "met")
    drop(cores)
    total = met.agg(F.sum(F.size("cores"))).first()[0] or 0
    merges = int(max(1, -(-total * (2 * cut.flank + cut.core) // MERGE_BYTES)))
    columns = {"merge": pa.int32(), "run": pa.binary(), "digest": pa.binary(), "core": pa.binary(), "left": pa.binary(), "right": pa.binary(), "times": pa.int32(), "text": pa.int64(), "s": pa.int64(), "e": pa.int64()}

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of four sorts: sorted runs by merge (merge >= 0); places of contexts (-1); intervals that a text repeats
        within itself (-2); contexts of hot cores (-3)."""
        own: dict[tuple[bytes, bytes], list] = {}
        rows: list[tuple] = []
        held = 0

        def flush() -> None:
            parts: dict[int, list] = {}
            for (suffix, left), (digest, times, c, hot) in own.items():
                if hot:
                    core = hashlib.blake2b(suffix[: cut.core], digest_size=16).digest()
                    rows.append((-3, None, digest, core, left, suffix[cut.core :], times, None, None, None))
                else:
                    parts.setdefault(c % merges, []).append((suffix, left, digest, times))
            own.clear()
            for k in sorted(parts):
                rows.append((k, encode_run(sorted(parts.pop(k))), *[None] * 8))

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())], list(columns))
            rows.clear()
            return out

        for b in batches(it, 64):
            for text_id, x, wanted, hot_cores in zip(b["text"].to_pylist(), b["raw"].to_pylist(), b["cores"], b["hot"].to_pylist(), strict=True):
                h, at = cut.cores(x)
                here: dict[tuple[bytes, bytes], list[int]] = {}
                code: dict[tuple[bytes, bytes], int] = {}
                for i in np.flatnonzero(np.isin(h, wanted.values.to_numpy())).tolist():
                    s = int(at[i])
                    key = (x[s : s + cut.core + cut.flank], x[max(0, s - cut.flank) : s][::-1])
                    here.setdefault(key, []).append(s)
                    code[key] = int(h[i])
                for key, starts in here.items():
                    (suffix, left), c = key, code[key]
                    item = own.get(key)
                    if item is None:
                        d = hashlib.blake2b(left, digest_size=16, salt=len(left).to_bytes(4, "big"))
                        d.update(suffix)
                        own[key] = item = [d.digest(), 0, c, c in hot_cores]
                        held += len(suffix) + len(left) + 300
                    item[1] = min(2, item[1] + len(starts))
                    if len(starts) > 1:  # the same surroundings twice in one text: all of them repeat
                        rows.extend((-2, *[None] * 6, text_id, y - len(left), y + len(suffix)) for y in starts)
                    else:
                        rows.append((-1, None, item[0], *[None] * 4, text_id, starts[0], None))
                if held > HELD:
                    held = 0
                    flush()
                    yield send()
                elif len(rows) > PLACES:
                    yield send()
        flush()
        if rows:
            yield send()

    sent = keep(met.select("text", "raw", "cores", "hot").mapInArrow(runs, "merge int, run binary, digest binary, core binary, left binary, right binary, times int, text long, s long, e long"), "runs")

    def join_runs(t: pa.Table) -> pa.Table:
        out = list(covered(t["run"].to_pylist(), cut))
        return pa.table({"digest": pa.array([x[0] for x in out], pa.binary()), "a": pa.array([x[1] for x in out], pa.int32()), "b": pa.array([x[2] for x in out], pa.int32())})

    # Sixteen merges to a task, however many there are: the session's number of partitions doesn't grow with the input.
    outcome = sent.where("merge >= 0").select("merge", "run").repartition(max(tasks_for(df), -(-merges // 16)), "merge").groupBy("merge").applyInArrow(join_runs, "digest binary, a int, b int")
    hot = sent.where("merge = -3").select("digest", "core", "left", "right", "times")
    if not hot.isEmpty():
        outcome = outcome.unionByName(grouped(hot, cut))
    outcome = keep(outcome, "outcome")
    # Both sides stand in written tables, so that adaptive execution may split a context with very many places.
    placed = sent.where("merge = -1").select("digest", "text", "s").join(outcome, "digest").select("text", (F.col("s") - F.col("a")).alias("s"), (F.col("s") + cut.core + F.col("b")).alias("e"))
    merged = placed.unionByName(sent.where("merge = -2").select("text", "s", "e"))
    # A text's intervals are no more than its own cores.
    spans = keep(merged.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")

    def strike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 64):
            removed, n_spans, sha = [], [], []
            for x, spans_ in zip(b["raw"].to_pylist(), b["spans"].to_pylist(), strict=True):
                kept, last, gone, n = hashlib.sha256(), 0, 0, 0
                end = -1
                for sp in spans_:
                    s, e = sp["s"], sp["e"]
                    if s > end:
                        if end >= 0:
                            last = end
                        kept.update(x[last:s])
                        n += 1
                        gone += e - s
                        end = e
                    elif e > end:
                        gone += e - end
                        end = e
                kept.update(x[max(end, 0) :])
                removed.append(gone)
                n_spans.append(n)
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["key", "removed", "spans", "kept"])

    struck = met.select("text", "key", "raw").join(spans, "text").select("key", "raw", "spans").mapInArrow(strike, "key binary, removed long, spans long, kept string")
    out = base.select("doc_id", "key", "sha", "n_bytes").join(struck, "key", "left").join(whole.withColumn("all", F.lit(True)), "key", "left")
    full = F.coalesce("all", F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(full, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(full, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(full, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
