"""What the operators of this subpackage share: tables in the shared folder, clean inputs, words."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows (of fixed-width columns) may be broadcast or sent to the driver.
SMALL_ROWS = 50_000

_own_dir: dict[str, str] = {}
_written: dict[str, weakref.ref] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where that is unset and the session local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = "file://" + tempfile.mkdtemp(prefix="pageloom-")
    return _own_dir["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: no lineage before it, so lost executors cost nothing.

    The table lives until drop() or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pageloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = weakref.ref(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._pageloom_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table that keep() wrote, once nothing reads it any more."""
    path = getattr(df, "_pageloom_path", None)
    if path and _written.pop(path, None):
        _delete(df.sparkSession, path)


@atexit.register
def _drop_all() -> None:
    for path, ref in list(_written.items()):
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already; the shared folder is then cleaned by its owner
            return


def broadcast_if_small(df: DataFrame, rows: int, limit: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint only if the counted rows are within limit; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def text_of(df: DataFrame, *more: str) -> DataFrame:
    """Exactly doc_id, text (null: empty) and the named columns; other columns can't clash with an operator's own."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def tasks_for(df: DataFrame) -> int:
    """Partitions for shuffled data: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_MASK = (1 << 64) - 1
SPACES = re.compile("[ \t-\r]+")
#: Makes A-Z lower case and nothing else.
LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str) -> list[str]:
    """Words are runs of anything but blank, tab, newline, vertical tab, form feed and carriage return."""
    if not text.isascii():
        return [w for w in SPACES.split(text.translate(LOWER)) if w]
    return [w for w in SPACES.split(text.lower()) if w]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit (multiply and shift, wraps around)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Word to a 64-bit hash. It keeps what it has seen, up to LIMIT words."""

    LIMIT = 1 << 19

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of size words, sorted; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out + np.uint64(k)))


def batches(it: Iterator, rows: int) -> Iterator:
    """Arrow batches of at most so many rows each, so that long texts don't add up."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
