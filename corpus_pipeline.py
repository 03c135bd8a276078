"""From documents to packed training sequences: quality, near copies, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import crf, minhash, mixing, packing, pii
from pageloom.llm.common import keep
from pageloom.llm.queries import EPOCHS, PART, SEED, WEIGHTS, table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.7; the model learns from the labelled ones among these documents."""
    return crf.good(docs, crf.learn(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Rows that repeat an id all stay or go; those without an id stay."""
    gone = minhash.near_duplicates(docs).where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are replaced by their kind."""
    return pii.redact(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by target weights; a document drawn in two epochs stands twice."""
    return mixing.mix(docs, WEIGHTS, PART, EPOCHS, SEED).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packing.pack(docs, tokenizer())


STAGES = [("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("packed", packed)]
#: The classifier, the trees and the packing have no SQL form; tests hold run() against a version by plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*(F.col(c) for c in COLUMNS))
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
