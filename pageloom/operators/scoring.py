"""Character and word metrics of pages and runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import align
from ..functions.native import f1, precision, safe_div

COUNTS = ("matches", "substitutions", "insertions", "deletions")


def _lists(b: pa.RecordBatch, name: str) -> list[list[str]]:
    return [[w or "" for w in x] if x is not None else [] for x in b[name].to_pylist()]


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Adds edit counts to rows with `ref` and `hyp` (arrays of words; null: empty): char_* of the alignment of the texts
    (words joined by blanks), word_* of least edits, and ref_chars, hyp_chars, ref_words, hyp_words.

    Pages of equal text have known counts and never reach the kernel; the rest goes through Arrow once.
    """
    slim = pairs.withColumn("_r", F.coalesce("ref", F.array().cast("array<string>"))).withColumn("_h", F.coalesce("hyp", F.array().cast("array<string>")))
    slim = slim.withColumn("_rt", F.array_join("_r", " ")).withColumn("_ht", F.array_join("_h", " "))
    sizes = {"ref_chars": F.length("_rt"), "hyp_chars": F.length("_ht"), "ref_words": F.size("_r"), "hyp_words": F.size("_h")}
    for k, c in sizes.items():
        slim = slim.withColumn(k, c.cast("long"))
    keys = [c for c in pairs.columns if c not in ("ref", "hyp")]
    same, other = slim.where("_r = _h"), slim.where("NOT (_r = _h)")
    zero = F.lit(0).cast("long")
    known = {f"{k}_{c}": (F.col(f"ref_{k}s") if c == "matches" else zero) for k in ("char", "word") for c in COUNTS}
    done = same.select(*keys, *sizes, *(c.alias(n) for n, c in known.items()))

    names, counts = [*keys, *sizes], list(known)
    schema = ", ".join(f"`{n}` {t}" for n, t in other.select(*names).dtypes) + "".join(f", {n} long" for n in counts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for r, h in zip(_lists(b, "_r"), _lists(b, "_h"), strict=True):
                rows.append((*align.aligned_counts(" ".join(r), " ".join(h)), *align.edit_counts(r, h)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), *(pa.array(c, pa.int64()) for c in cols)], [*names, *counts])

    counted = other.select(*names, "_r", "_h").mapInArrow(run, schema)
    return done.unionByName(counted)


def with_metrics(counts: DataFrame) -> DataFrame:
    """Adds cer, wer and precision, recall, F1 of both levels to counts. Rates aren't clamped; an empty reference gives 0."""
    out = counts
    for k, rate in (("char", "cer"), ("word", "wer")):
        m, s, i, d = (F.col(f"{k}_{c}") for c in COUNTS)
        out = out.withColumn(rate, safe_div(s + i + d, F.col(f"ref_{k}s")))
        out = out.withColumn(f"{k}_precision", precision(m, s + i)).withColumn(f"{k}_recall", precision(m, s + d))
        out = out.withColumn(f"{k}_f1", f1(F.col(f"{k}_precision"), F.col(f"{k}_recall")))
    return out


def page_scores(pages: DataFrame, truth: DataFrame, by: str = "page_number") -> DataFrame:
    """Scores of run pages against ground truth.

    pages: run_id, doc_id, page_number, words (array of strings); truth: doc_id, page_number, words. by: `page_number`, or
    `position` (the n-th page of a run with the n-th of the truth, up to the shorter; one missing page shifts the rest).
    """
    p, t = pages, truth
    if by == "position":
        p = p.withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy("page_number")))
        t = t.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("page_number")))
    else:
        p, t = p.withColumn("_n", F.col("page_number")), t.withColumn("_n", F.col("page_number"))
    met = p.select("run_id", "doc_id", "page_number", "_n", F.col("words").alias("hyp")).join(t.select("doc_id", "_n", F.col("words").alias("ref")), ["doc_id", "_n"])
    return with_metrics(pair_counts(met.select("run_id", "doc_id", "page_number", "ref", "hyp")))


def run_scores(scores: DataFrame, *keys: str) -> DataFrame:
    """Means over pages: character metrics weighted by reference characters, word metrics by reference words; 0 without weight."""
    keys = keys or ("run_id",)

    def mean(metric: str, weight: str) -> Column:
        return safe_div(F.sum(F.col(metric) * F.col(weight)), F.sum(weight)).alias(metric)

    return scores.groupBy(*keys).agg(
        F.count("*").alias("pages"),
        *(mean(m, "ref_chars") for m in ("cer", "char_precision", "char_recall", "char_f1")),
        *(mean(m, "ref_words") for m in ("wer", "word_precision", "word_recall", "word_f1")),
        F.sum("ref_chars").alias("ref_chars"),
        F.sum("ref_words").alias("ref_words"),
    )


def char_pairs(pairs: DataFrame) -> DataFrame:
    """The character alignment of `ref` and `hyp` (strings) as rows: the other columns, position, ref_char, hyp_char, op."""
    keys = [c for c in pairs.columns if c not in ("ref", "hyp")]
    item = "array<struct<ref_char:string,hyp_char:string,op:string>>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("ref_char", pa.string()), ("hyp_char", pa.string()), ("op", pa.string())]))
        for b in it:
            out = []
            for r, h in zip(b["ref"].to_pylist(), b["hyp"].to_pylist(), strict=True):
                r, h = r or "", h or ""
                path, _ = align.align(r, h)
                out.append([{"ref_char": None if i is None else r[i], "hyp_char": None if j is None else h[j], "op": "insertion" if i is None else "deletion" if j is None else "match" if r[i] == h[j] else "substitution"} for i, j in path])
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(out, kind)], [*keys, "_p"])

    schema = "".join(f"`{n}` {t}, " for n, t in pairs.select(*keys).dtypes) + f"_p {item}"
    made = pairs.select(*keys, "ref", "hyp").mapInArrow(run, schema)
    return made.select(*keys, F.posexplode("_p").alias("position", "_q")).select(*keys, "position", "_q.*")


def confusion(char_rows: DataFrame, *keys: str) -> DataFrame:
    """How often each character was read as another: keys, ref_char, hyp_char, n."""
    return char_rows.where("op = 'substitution'").groupBy(*keys, "ref_char", "hyp_char").agg(F.count("*").alias("n"))


def top_confusions(confusions: DataFrame, n: int = 10) -> DataFrame:
    """The part of the matrix among the n labels most often confused, either way."""
    labels = confusions.select(F.col("ref_char").alias("label"), "n").unionByName(confusions.select(F.col("hyp_char").alias("label"), "n"))
    top = labels.groupBy("label").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "label").limit(n).select("label")
    return confusions.join(F.broadcast(top.withColumnRenamed("label", "ref_char")), "ref_char", "left_semi").join(F.broadcast(top.withColumnRenamed("label", "hyp_char")), "hyp_char", "left_semi")


def error_heatmap(words: DataFrame, rows: int = 10, cols: int = 10) -> DataFrame:
    """Share of wrong words by place on the page: words has bbox, width, height, wrong (boolean)."""
    cell = lambda a, b, size, n: F.least(F.greatest(F.floor((F.col("bbox")[a] + F.col("bbox")[b]) / 2 / F.col(size) * n), F.lit(0)), F.lit(n - 1)).cast("int")
    return words.select(cell(1, 3, "height", rows).alias("row"), cell(0, 2, "width", cols).alias("col"), F.col("wrong").cast("int").alias("wrong")).groupBy("row", "col").agg(F.avg("wrong").alias("error_rate"), F.count("*").alias("samples"))


WORD_IN = "array<struct<text:string,bbox:array<double>,confidence:double>>"


def word_pairs(pairs: DataFrame, gap: float = -1.0, similar: float = 0.6, low: float = 0.5) -> DataFrame:
    """Fuzzy word alignment of `ref` and `hyp` (arrays of text, bbox, confidence): the other columns, score, position, ref_idx,
    hyp_idx, ref_text, hyp_text, op_text, op, similarity, iou, confidence (of the read word)."""
    keys = [c for c in pairs.columns if c not in ("ref", "hyp")]
    fields = [("ref_idx", pa.int32()), ("hyp_idx", pa.int32()), ("ref_text", pa.string()), ("hyp_text", pa.string()), ("op_text", pa.string()), ("op", pa.string()), ("similarity", pa.float64()), ("iou", pa.float64()), ("confidence", pa.float64())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            scores, out = [], []
            for r, h in zip(b["ref"].to_pylist(), b["hyp"].to_pylist(), strict=True):
                got, score = align.align_words(r or [], h or [], gap, similar, low)
                for g in got:
                    g["confidence"] = None if g["hyp_idx"] is None else h[g["hyp_idx"]].get("confidence")
                scores.append(score)
                out.append(got)
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(scores, pa.float64()), pa.array(out, pa.list_(pa.struct(fields)))], [*keys, "score", "_p"])

    ddl = "struct<ref_idx:int,hyp_idx:int,ref_text:string,hyp_text:string,op_text:string,op:string,similarity:double,iou:double,confidence:double>"
    schema = "".join(f"`{n}` {t}, " for n, t in pairs.select(*keys).dtypes) + f"score double, _p array<{ddl}>"
    made = pairs.select(*keys, F.col("ref").cast(WORD_IN).alias("ref"), F.col("hyp").cast(WORD_IN).alias("hyp")).mapInArrow(run, schema)
    return made.select(*keys, "score", F.posexplode("_p").alias("position", "_q")).select(*keys, "score", "position", "_q.*")


def pair_stats(word_rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by operation (by text alone), the share of invented words, and the calibration error of confidences.

    imagination = insertions / read words; calibration = mean of (confidence - right)^2 over read words, where a word is
    right if its final operation is a match, and a missing confidence counts as 0.
    """
    read = F.col("hyp_idx").isNotNull()
    right = (F.col("op") == "match").cast("double")
    return word_rows.groupBy(*keys).agg(
        *(F.count_if(F.col("op_text") == op).alias(f"n_{op}") for op in ("match", "substitution", "insertion", "deletion")),
        safe_div(F.count_if(F.col("op_text") == "insertion"), F.count_if(read)).alias("imagination"),
        F.coalesce(F.avg(F.when(read, F.pow(F.coalesce("confidence", F.lit(0.0)) - right, F.lit(2)))), F.lit(0.0)).alias("calibration"),
    )


def combined(pairs: DataFrame, *keys: str, noise: DataFrame | None = None) -> DataFrame:
    """All metrics of word lists at once: keys, cer, wer, imagination, calibration, and noise (the slope of `noise`: keys, dpi,
    cer; null without). pairs: keys (one row for each), ref and hyp (arrays of text, bbox, confidence)."""
    texts = lambda c: F.transform(F.col(c), lambda w: w["text"])
    plain = with_metrics(pair_counts(pairs.select(*keys, texts("ref").alias("ref"), texts("hyp").alias("hyp")))).select(*keys, "cer", "wer")
    fuzzy = pair_stats(word_pairs(pairs.select(*keys, "ref", "hyp")), *keys).select(*keys, "imagination", "calibration")
    # Two empty lists have no pairs, and nothing wrong.
    out = plain.join(fuzzy, list(keys), "left").fillna(0.0, ["imagination", "calibration"])
    slope = noise_slope(noise, *keys).select(*keys, F.col("slope").alias("noise")) if noise is not None else None
    return out.withColumn("noise", F.lit(None).cast("double")) if slope is None else out.join(slope, list(keys), "left")


#: Read words with confidences against what stands on the page, for checks of combined(): name, read, truth.
SCENARIOS = (
    ("perfect", (("a", 0.95), ("plain", 0.95), ("line", 0.95)), ("a", "plain", "line")),
    ("invented", (("a", 0.95), ("plain", 0.95), ("line", 0.95), ("zzz", 0.8), ("qqqq", 0.7)), ("a", "plain", "line")),
    ("overconfident", (("a", 0.95), ("vvvvv", 0.9), ("line", 0.95)), ("a", "plain", "line")),
    ("cautious", (("a", 0.95), ("vvvvv", 0.2), ("line", 0.95)), ("a", "plain", "line")),
)


def scenario_checks(spark: SparkSession) -> DataFrame:
    """Whether the metrics tell known cases apart: check, passed. Invented words show in imagination and cer, misplaced
    confidence in calibration, a perfect reading in neither."""
    word = lambda t, c=1.0: (t, None, c)
    rows = [(n, [word(*w) for w in read], [word(t) for t in truth]) for n, read, truth in SCENARIOS]
    got = combined(spark.createDataFrame(rows, f"scenario string, hyp {WORD_IN}, ref {WORD_IN}"), "scenario")
    at = lambda s, m: F.max(F.when(F.col("scenario") == s, F.col(m)))
    checks = {
        "a perfect reading invents nothing": at("perfect", "imagination") == 0,
        "a perfect reading is calibrated": at("perfect", "calibration") < 0.01,
        "invented words raise imagination": at("invented", "imagination") > at("perfect", "imagination"),
        "invented words raise cer": at("invented", "cer") > at("perfect", "cer"),
        "overconfidence raises calibration error": at("overconfident", "calibration") > at("cautious", "calibration"),
    }
    return got.agg(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks.items())).alias("c")).select(F.inline("c"))


def word_status(pages: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """The n-th read word against the n-th true one: keys, position, status (correct, wrong, missing, extra), text (the true one,
    for extra the read one), engine_text (of wrong and extra ones), bbox, confidence (0 for missing ones).

    pages, truth: keys and words (arrays of text, bbox, confidence). A page on one side only: all its words are missing or extra.
    """
    side = lambda df, n: df.select(*keys, F.posexplode(F.col("words").cast(WORD_IN)).alias("position", n))
    met = side(pages, "o").join(side(truth, "t"), [*keys, "position"], "full")
    o, t = F.col("o"), F.col("t")
    status = F.when(o.isNull(), "missing").when(t.isNull(), "extra").when(o["text"].eqNullSafe(t["text"]), "correct").otherwise("wrong")
    out = met.withColumn("status", status)
    return out.select(
        *keys, "position", "status", F.when(t.isNull(), o["text"]).otherwise(t["text"]).alias("text"), F.when(F.col("status").isin("wrong", "extra"), o["text"]).alias("engine_text"),
        F.when(o.isNull(), t["bbox"]).otherwise(o["bbox"]).alias("bbox"), F.when(o.isNull(), 0.0).otherwise(o["confidence"]).alias("confidence"),
    )


def local_pairs(pairs: DataFrame, match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0) -> DataFrame:
    """The best local alignment of `ref` and `hyp` (arrays of words): the other columns, score, ref_start, ref_end, hyp_start,
    hyp_end (ends exclusive; null without a match), matches."""
    keys = [c for c in pairs.columns if c not in ("ref", "hyp")]
    names = ("ref_start", "ref_end", "hyp_start", "hyp_end", "matches")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for r, h in zip(_lists(b, "ref"), _lists(b, "hyp"), strict=True):
                path, score = align.local(r, h, match, mismatch, gap)
                i, j = [x for x, _ in path if x is not None], [y for _, y in path if y is not None]
                same = sum(x is not None and y is not None and r[x] == h[y] for x, y in path)
                rows.append((score, *((i[0], i[-1] + 1, j[0], j[-1] + 1) if path else [None] * 4), same))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(cols[0], pa.float64()), *(pa.array(c, pa.int32()) for c in cols[1:])], [*keys, "score", *names])

    schema = "".join(f"`{n}` {t}, " for n, t in pairs.select(*keys).dtypes) + "score double" + "".join(f", {n} int" for n in names)
    return pairs.select(*keys, "ref", "hyp").mapInArrow(run, schema)


def run_totals(pages: DataFrame, seconds: DataFrame | None = None, data: str = "data") -> DataFrame:
    """Of each run (pages: run_id and data): pages, characters of its text blocks, and with `seconds` (run_id, seconds) seconds a page."""
    blocks = F.filter(F.col(f"{data}.blocks"), lambda b: (b["type"] == "text") & b["lines"].isNotNull())
    # Sums within sums: lists of words would be copied, characters included.
    total = lambda items, each: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + each(x))
    n = total(blocks, lambda b: total(b["lines"], lambda l: total(l["words"], lambda w: F.coalesce(F.length(w["text"]), F.lit(0)))))
    out = pages.groupBy("run_id").agg(F.count("*").alias("pages"), F.sum(F.coalesce(n, F.lit(0).cast("long"))).alias("characters"))
    return out if seconds is None else out.join(seconds, "run_id", "left").withColumn("seconds_a_page", F.col("seconds") / F.greatest("pages", F.lit(1)))


def noise_slope(scores: DataFrame, *keys: str) -> DataFrame:
    """Least-squares slope of cer over dpi; 0 with fewer than two points. Worse reading at low resolution gives a negative slope."""
    return scores.groupBy(*keys).agg(F.coalesce(F.regr_slope("cer", "dpi"), F.lit(0.0)).alias("slope"), F.count("*").alias("points"))


def cjk_accuracy(counts: DataFrame) -> DataFrame:
    """Matches over the longer text, for scripts without blanks."""
    return counts.withColumn("cjk_char_accuracy", safe_div(F.col("char_matches"), F.greatest("ref_chars", "hyp_chars", F.lit(1))))


def by_script(scores: DataFrame, script: str = "script") -> DataFrame:
    """Weighted means by script and over all (script null) in one pass."""

    def mean(metric: str, weight: str) -> Column:
        return safe_div(F.sum(F.col(metric) * F.col(weight)), F.sum(weight)).alias(metric)

    return scores.rollup(script).agg(F.count("*").alias("pages"), mean("cer", "ref_chars"), mean("char_f1", "ref_chars"), mean("wer", "ref_words"), mean("word_f1", "ref_words"))
