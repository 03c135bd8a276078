"""Readability, scripts, handwriting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import language
from ..functions.native import cosine_of_counts, grams, safe_div, script_of, words
from .scoring import pair_counts, with_metrics


def plausibility(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds fluency, grammaticality and plausibility (0.6 and 0.4 of them). Null texts count as empty: all 0."""
    keys = df.columns
    schema = "".join(f"`{n}` {t}, " for n, t in df.dtypes) + "fluency double, grammaticality double, plausibility double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [(language.fluency(t or ""), language.grammaticality(t or "")) for t in b[text].to_pylist()]
            f, g = [x[0] for x in got], [x[1] for x in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f, pa.float64()), pa.array(g, pa.float64()), pa.array([0.6 * x + 0.4 * y if x or y else 0.0 for x, y in got], pa.float64())], [*keys, "fluency", "grammaticality", "plausibility"])

    return df.mapInArrow(run, schema)


def native_grammaticality(text: Column, common: frozenset[str] = language.COMMON) -> Column:
    """The parts of grammaticality that need no marks' positions, as built-in expressions: (0.40 common + 0.25 length + 0.15 vowels) / 0.80."""
    tokens = words(text)
    known = F.array(*(F.lit(w) for w in sorted(common)))
    bare = lambda w: F.regexp_replace(F.lower(w), "^\\p{Punct}+|\\p{Punct}+$", "")
    share = safe_div(F.size(F.filter(tokens, lambda w: F.array_contains(known, bare(w)))), F.size(tokens))
    sized = F.filter(tokens, lambda w: w.rlike("\\p{L}"))
    mean = safe_div(F.aggregate(sized, F.lit(0), lambda a, w: a + F.length(w)), F.size(sized))
    length = F.when(F.size(sized) > 0, F.greatest(F.lit(0.0), 1 - F.abs(mean - 5) / 5)).otherwise(0.0)
    low = F.lower(text)
    letters = F.regexp_count(low, F.lit("[a-z]"))
    vowels = F.when(letters > 0, F.greatest(F.lit(0.0), 1 - F.abs(F.regexp_count(low, F.lit("[aeiou]")) / letters - 0.38) / 0.38)).otherwise(0.0)
    return (0.40 * share + 0.25 * length + 0.15 * vowels) / 0.80


def trigram_cosine(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Cosine of the counts of runs of three characters, by exploding and joining runs: any length of text, no array of pairs.

    Adds nothing else: returns keys and cosine. keys must identify rows. Two texts without a run in common, or an empty one: 0.
    """
    side = lambda c, n: df.select(*keys, F.explode(grams(F.lower(F.coalesce(F.col(c), F.lit(""))))).alias("g")).groupBy(*keys, "g").agg(F.count("*").cast("double").alias(n))
    met = side(a, "x").join(side(b, "y"), [*keys, "g"], "full")
    got = met.groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    made = got.select(*keys, safe_div(F.col("dot"), F.sqrt("xx") * F.sqrt("yy")).alias("cosine"))
    return df.select(*keys).join(made, list(keys), "left").select(*keys, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def short_trigram_cosine(a: Column, b: Column) -> Column:
    """The same for short texts, within the row."""
    return cosine_of_counts(grams(F.lower(a)), grams(F.lower(b)))


def with_script(df: DataFrame, text: str = "text", denominator: str = "non_latin") -> DataFrame:
    return df.withColumn("script", script_of(F.col(text), denominator))


def rtl_penalty(word_rows: DataFrame, *keys: str, order: str = "word_pos") -> DataFrame:
    """Share of neighbouring words that run from left to right: words has keys, order, bbox. Pairs with a null or short box don't count."""
    w = W.partitionBy(*keys).orderBy(order)
    box = F.when(F.size("bbox") >= 3, F.col("bbox"))
    rows = word_rows.select(*keys, box[0].alias("x"), F.lead(box[0]).over(w).alias("next"))
    return rows.groupBy(*keys).agg(safe_div(F.count_if(F.col("x") < F.col("next")), F.count(F.when(F.col("x").isNotNull() & F.col("next").isNotNull(), 1))).alias("rtl_penalty"))


def arabic_metrics(pairs: DataFrame, word_rows: DataFrame, *keys: str) -> DataFrame:
    """Character metrics of `ref` and `hyp` (arrays of words) and the right-to-left penalty of the read words' boxes (word_rows:
    keys, word_pos, bbox), in one call: keys, cer, char_precision, char_recall, char_f1, rtl_penalty (0 without boxes)."""
    scores = with_metrics(pair_counts(pairs.select(*keys, "ref", "hyp"))).select(*keys, "cer", "char_precision", "char_recall", "char_f1")
    return scores.join(rtl_penalty(word_rows, *keys), list(keys), "left").fillna(0.0, ["rtl_penalty"])


# Thresholds of confidence and of the ratio of widths, and the marks that engines leave.
SURE, MAYBE, RATIO, WIDTHS = 0.3, 0.5, 3.0, 3
MARKS = ("handwriting", "handwritten", "cursive")


def tag_handwriting(word_rows: DataFrame, *keys: str, meta: str | None = None) -> DataFrame:
    """Adds `handwriting`: all words where the engine says so (column `meta`); confidence below 0.3; or below 0.5 in a block of at
    least three widths whose greatest is over three times the least. words: keys, block_index (null: 0), bbox, confidence."""
    w = W.partitionBy(*keys, F.coalesce("block_index", F.lit(0)))
    width = F.when(F.size("bbox") >= 4, F.col("bbox")[2] - F.col("bbox")[0])
    rows = word_rows.withColumn("_w", width)
    odd = (F.count("_w").over(w) >= WIDTHS) & (F.min("_w").over(w) > 0) & (F.max("_w").over(w) / F.min("_w").over(w) > RATIO)
    all_ = F.lower(F.col(meta).cast("string")).isin(*MARKS, "true") if meta else F.lit(False)
    c = F.col("confidence")
    return rows.withColumn("_odd", odd).withColumn("handwriting", F.coalesce(all_, F.lit(False)) | F.coalesce((c < SURE) | ((c < MAYBE) & F.coalesce(F.col("_odd"), F.lit(False))), F.lit(False))).drop("_w", "_odd")


def split_words(blocks: Column, wanted) -> Column:
    """Blocks with the words for which wanted(word) holds; lines and blocks without any are left out."""
    lines = lambda b: F.filter(F.transform(b["lines"], lambda l: l.withField("words", F.filter(l["words"], wanted))), lambda l: F.size(l["words"]) > 0)
    return F.filter(F.transform(blocks, lambda b: b.withField("lines", lines(b))), lambda b: F.size(b["lines"]) > 0)
