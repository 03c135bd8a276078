"""Secrets: exact base patterns, and ownership frequency over the whole corpus."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, keep

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: A shorter run fails, and no match begins inside a run.
HEX = re.compile("[0-9a-f]{32,}")
#: Further formats that services issue; each begins with a fixed mark and ends with its run. A first part of eyJ that is no
#: token is passed over whole (its group is then empty), so that none is read again from each mark within it.
TOKENS = {
    "gh": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{20,}+"),
    "xox": re.compile(r"\bxox[abeprs]-[A-Za-z0-9-]{10,}+"),
    "eyJ": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}+(\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)?+"),
    "AIza": re.compile(r"\bAIza[A-Za-z0-9_-]{35}"),
    "sk_": re.compile(r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}+"),
    "glpat-": re.compile(r"\bglpat-[A-Za-z0-9_-]{20,}+"),
    "PRIVATE KEY": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?+"),
}
#: Found with so many owners, or in so many repositories, a value is a copied example; any other with at most OWN owners and ENTROPY bits a character it looks live.
EXAMPLE, OWN, ENTROPY = 3, 1, 3.0


def base_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def more_of(text: str) -> list[tuple[int, int, int, str]]:
    return [(m.start(), 3, m.end(), m[0]) for mark, p in TOKENS.items() if mark in text for m in p.finditer(text) if not p.groups or m[1]]


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(k / n * log2(k / n) for k in Counter(value).values())


def listed(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found)


def scan(df: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Counts and digest are of the base patterns. `spans` lists these, by start, and further tokens of ENTROPY bits a
    character that aren't copied examples. n_live and n_example count spans (base ones too) by that test: over the whole corpus, a value's distinct
    owners and repositories are counted by its hash; EXAMPLE owners or repositories or more make it a copied
    example; else OWN owners at most, with ENTROPY bits a character, make it live-looking. Owner and
    repository are expressions over df: by default `source`, and `source` with `lang`.

    Null and empty texts have none. A null owner or repository is one like any other. Rows come out one for one,
    repeated ones and null ids too (as copies of one owner). Other columns are ignored. An empty table gives an empty one.

    Values are made distinct by owner map-side before they are counted, and meet their documents by a join that may
    split; texts aren't shuffled, and no value leaves the executors but as a hash.
    """
    owner = owner if owner is not None else F.col("source")
    repository = repository if repository is not None else F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("")))
    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches(it, 512):
            rows, counts, sha, spans, cands = [], [[], [], []], [], [], []
            for text in b["text"].to_pylist():
                base = base_of(text)
                more = more_of(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                rows.append(row)
                row += 1
                s = listed(base)
                sha.append(hashlib.sha256(s.encode()).hexdigest())
                spans.append(s)
                cands.append([{"s": s_, "k": k, "e": e, "v": hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "h": entropy(v)} for s_, k, e, v in base + more] or None)
            kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("v", pa.binary()), ("h", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b["doc_id"], b["owner"], b["repository"], *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(spans), pa.array(cands, kind)], ["row", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])

    schema = "row long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, base string, found array<struct<s:int,k:int,e:int,v:binary,h:double>>"
    own = keep(slim.mapInArrow(run, schema), "secrets")
    each = own.where("found IS NOT NULL").select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    spread = each.groupBy("v").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    spread = keep(spread, "owners")
    example = (F.col("owners") >= EXAMPLE) | (F.col("repositories") >= EXAMPLE)
    rich = F.col("h") >= ENTROPY
    names = F.array(*(F.lit(k) for k in KINDS))
    judged = each.join(spread, "v").select("row", "s", "k", "e", (~example & rich & (F.col("owners") <= OWN)).alias("live"), example.alias("example"), (~example & rich).alias("kept"))
    # A row's spans are no more than its own text holds.
    by_row = judged.where("k < 3 OR kept").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("all"), F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example")
    )
    by_row = by_row.select("row", F.array_join(F.transform("all", lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",").alias("spans"), "n_live", "n_example")
    zero = F.lit(0).cast("long")
    return own.join(by_row, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", "base").alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))
