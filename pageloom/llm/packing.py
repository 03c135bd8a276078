"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, batches, keep, text_of

CAPACITY = 2048
END = np.uint32(0).tobytes()
#: Words whose ids a worker remembers; the table starts anew when full.
REMEMBERED = 1 << 19


#: Marks that may end a word, as one piece of its own.
MARKS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for a character's UTF-8 bytes in a byte-level vocabulary, for characters below U+0250."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return {c: "".join(letter[x] for x in chr(c).encode()) for c in range(0x250)}


class Ids(dict):
    """A run of non-blank characters to its ids, as bytes. The tokenizer drops white space and never matches across it.

    A word of letters below U+0250, marks at its end aside, goes straight to the vocabulary's merges: normalising it is
    lowering it, and it is one piece. Everything else takes the tokenizer's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.letters = self.tokenizer.model, byte_letters()

    def piece(self, text: str) -> bytes:
        return np.array([t.id for t in self.merges.tokenize(text.translate(self.letters))], np.uint32).tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
            low = core.lower()
            if low == word:
                ids = self.piece(word)
            else:
                ids = self[low]
                if len(core) < len(word):
                    tail = word[len(core) :]
                    ids += self.piece(tail) if len(tail) > 8 else self[tail]
        elif not core and len(word) <= 8:
            ids = self.piece(word)
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, SPACES.split(text)))


def cut(df: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its number among the task's pieces of that length.

    `task` and `nth` depend on how the input was split; keep() the result before using it twice.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, task = Ids(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches(it, 256):
            rows: list[tuple] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                whole = ids.of(text) + END
                for i, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, i, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return text_of(df).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths, largest first, that fill room as far as the counted lengths can: subset sums as the bits of one number."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (length, how many, sums reached before)
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0:
            take = min(chunk, left)
            new = (reach | reach << (take * length)) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left -= take
            chunk *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * take
            total -= take * length
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths of one sequence): minimum bin slack, each sequence begun by the longest piece left.

    A combination is used again for as long as its lengths last, which is what a search anew would find: what is
    feasible only shrinks. So the work depends on the number of lengths, not on the number of pieces.
    """
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        first = max(left)
        left[first] -= 1
        rest = {k: v for k, v in left.items() if v > 0}
        one = [first, *fullest(capacity - first, rest)]
        left[first] += 1
        need = {k: one.count(k) for k in set(one)}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((times, one))
    return out


def places(found: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: for runs of its pieces, the first rank, the first sequence, pieces of that length in each, offset of the first."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, one in found:
        offset = 0
        for k in dict.fromkeys(one):
            n = one.count(k)
            runs.setdefault(k, []).append((used.get(k, 0), sequence, n, offset))
            used[k] = used.get(k, 0) + times * n
            offset += n * k
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack the texts of df (doc_id, text; other columns are ignored) into few sequences of at most capacity tokens.

    Method: pieces are cut and counted by length; minimum bin slack runs on the driver over those counts (at most
    `capacity` numbers, whatever the input); ranks within a length, made of small per-task counts, place each piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty: one piece of the
    end id alone. Repeated rows (and null ids) are packed as often as they stand. An empty table gives an empty one.
    """
    pieces = keep(cut(df, tokenizer, capacity), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = places(plan(counts, capacity))
    from pyspark.sql import Window as W

    # One partition of the window holds a row per task at most.
    base = by_task.select("task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, seq, n, off = where[int(k)]
                i = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[i]
                sequence[at] = seq[i] + inside // n[i]
                offset[at] = off[i] + inside % n[i] * k
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["piece"], b["start"], b["length"], b["ids_crc32"], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
