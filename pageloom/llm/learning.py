"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_of

#: At most so many labelled rows are learned from: those whose ids have the least hashes; none longer than so many characters.
SAMPLE, LONGEST = 6000, 1 << 18


def labelled(documents: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], rows: int = SAMPLE) -> DataFrame:
    """(text, label) of at most `rows` labelled documents that aren't held out, the same ones each time.

    Labels other than 0 and 1, null ids, ids labelled twice with different values and texts longer than LONGEST aren't
    learned from. Of documents that share an id, the one with the least text is. So what is sent on is bounded whatever the input.
    """
    n, r = held_out
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    known = known.where((F.col("label") == F.col("most")) & (remainder(F.col("doc_id"), n) != r))
    some = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    met = text_of(documents).where(F.length("text") <= LONGEST).join(F.broadcast(some), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").cast("int").alias("label"))
