"""Several engines' readings of one page: grid, votes, entropies, routing, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import align
from ..functions.native import safe_div

WORD = "struct<text:string,confidence:double,bbox:array<double>>"


def project(readings: DataFrame, *keys: str) -> DataFrame:
    """Every engine's words at the positions of the reference engine's words.

    readings: keys, engine, engine_rank (0: the reference; explicit, as the result depends on it), words (array of text,
    confidence, bbox: decides between alignments that are as good by text). Returns keys, engine, engine_rank, position (null: an insertion, which has no place), word (null: a gap).
    """
    slim = readings.select(*keys, "engine", "engine_rank", F.col("words").cast(f"array<{WORD}>").alias("words"))
    first = slim.where("engine_rank = 0").select(*keys, F.col("words").alias("ref"))
    met = slim.join(first, list(keys))
    names = [*keys, "engine", "engine_rank"]
    schema = "".join(f"`{n}` {t}, " for n, t in met.select(*names).dtypes) + f"_g array<struct<position:int,word:{WORD}>>"
    word = pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.float64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for rank, ref, own in zip(b["engine_rank"].to_pylist(), b["ref"].to_pylist(), b["words"].to_pylist(), strict=True):
                ref, own = ref or [], own or []
                if rank == 0:
                    out.append([{"position": i, "word": w} for i, w in enumerate(ref)])
                    continue
                # Of equal words in a row any can be the one that is missing: boxes tell which, where there are some.
                path, _ = align.align([w["text"] for w in ref], [w["text"] for w in own], near=align.overlaps(ref, own)) if ref else ([], 0.0)
                out.append([{"position": i, "word": None if j is None else own[j]} for i, j in path])
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(out, pa.list_(pa.struct([("position", pa.int32()), ("word", word)])))], [*names, "_g"])

    made = met.select(*names, "words", "ref").mapInArrow(run, schema)
    return made.select(*names, F.explode("_g").alias("_c")).select(*names, "_c.position", "_c.word")


def _at_positions(grid: DataFrame) -> DataFrame:
    return grid.where("position IS NOT NULL").withColumn("text", F.col("word.text")).withColumn("confidence", F.col("word.confidence"))


def votes(grid: DataFrame, *keys: str) -> DataFrame:
    """The winners at each position by three rules: keys, position, majority, majority_votes, weighted, weighted_confidence (mean),
    vote_count, total_votes, mean_tie, mean_tie_confidence, flag (weighted and majority differ).

    majority: most engines, ties to the greater sum of confidences (missing: 1); weighted: greatest sum; mean_tie: most
    engines, ties to the greater mean of known confidences (none: 0). Then the engine of lower rank. Gaps never win.
    """
    at = _at_positions(grid)
    each = at.where("text IS NOT NULL").groupBy(*keys, "position", "text").agg(
        F.count("*").alias("_n"), F.sum(F.coalesce("confidence", F.lit(1.0))).alias("_s"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("_m"), F.min("engine_rank").alias("_first")
    )
    best = lambda *by: F.max_by(F.struct("text", "_n", "_s", "_m"), F.struct(*by, -F.col("_first")))
    won = each.groupBy(*keys, "position").agg(best("_n", "_s").alias("_a"), best("_s").alias("_b"), best("_n", "_m").alias("_c"))
    total = at.groupBy(*keys, "position").agg(F.count("*").alias("total_votes"))
    out = total.join(won, [*keys, "position"], "left")
    return out.select(
        *keys, "position", F.col("_a.text").alias("majority"), F.col("_a._n").alias("majority_votes"), F.col("_b.text").alias("weighted"), (F.col("_b._s") / F.col("_b._n")).alias("weighted_confidence"),
        F.col("_b._n").alias("vote_count"), "total_votes", F.col("_c.text").alias("mean_tie"), F.col("_c._m").alias("mean_tie_confidence"), (~F.col("_a.text").eqNullSafe(F.col("_b.text"))).alias("flag"),
    )


def entropies(grid: DataFrame, *keys: str) -> DataFrame:
    """Disagreement at each position: entropy (a gap is a reading like any other; over log2 of the engines, 1 at most; one
    engine: 0) and entropy_no_gaps (gaps left out; over log2 of those that read something; fewer than two: 0)."""
    at = _at_positions(grid)
    each = at.groupBy(*keys, "position", "text").agg(F.count("*").alias("_n"))
    all_ = W.partitionBy(*keys, "position")
    each = each.withColumn("_t", F.sum("_n").over(all_)).withColumn("_k", F.sum(F.when(F.col("text").isNotNull(), F.col("_n")).otherwise(0)).over(all_))
    h = lambda n, t: -(n / t) * F.log2(n / t)
    out = each.groupBy(*keys, "position").agg(
        F.sum(h(F.col("_n"), F.col("_t"))).alias("_h"), F.first("_t").alias("_t"), F.sum(F.when(F.col("text").isNotNull(), h(F.col("_n"), F.col("_k")))).alias("_g"), F.first("_k").alias("_k")
    )
    return out.select(*keys, "position", F.when(F.col("_t") < 2, 0.0).otherwise(F.least(F.greatest(F.col("_h") / F.log2("_t"), F.lit(0.0)), F.lit(1.0))).alias("entropy"), F.when(F.col("_k") < 2, 0.0).otherwise(F.greatest(F.col("_g") / F.log2("_k"), F.lit(0.0))).alias("entropy_no_gaps"))


def page_entropy(positions: DataFrame, *keys: str) -> DataFrame:
    return positions.groupBy(*keys).agg(F.avg("entropy").alias("entropy"), F.avg("entropy_no_gaps").alias("entropy_no_gaps"), F.count("*").alias("positions"))


def route(pages: DataFrame, low: float = 0.3, high: float = 0.6) -> DataFrame:
    """What becomes of a page's consensus. pages: engines, entropy, flagged. Adds source (null: none), needs_review, decision, warnings.

    No engine: none. One: accepted for review. Entropy >= high: rejected; < low: accepted, reviewed if flagged; between: accepted for review.
    """
    n, ce, flagged = F.col("engines"), F.col("entropy"), F.coalesce(F.col("flagged"), F.lit(False))
    decision = F.when(n == 0, "none").when(n == 1, "single").when(ce >= high, "reject").when(ce < low, "accept").otherwise("review")
    out = pages.withColumn("decision", decision)
    accepted = F.col("decision").isin("single", "accept", "review")
    warn = F.array_compact(F.array(
        F.when(n == 1, "single engine"), F.when((n > 1) & flagged, "weighted and equal votes disagree"), F.when(F.col("decision") == "reject", "high entropy"), F.when(F.col("decision") == "review", "moderate entropy")
    ))
    return out.withColumn("source", F.when(accepted, "auto_consensus")).withColumn("needs_review", (n > 0) & ((F.col("decision") != "accept") | flagged) | (n == 0)).withColumn("warnings", warn)


def consensus_pages(votes_: DataFrame, *keys: str) -> DataFrame:
    """The page made of the weighted winners, as one block of one line; positions without a winner are left out."""
    word = F.struct(F.col("position").alias("position"), F.struct(F.col("weighted").alias("text"), F.col("weighted_confidence").alias("confidence"), F.col("position").cast("int").alias("order")).alias("w"))
    made = votes_.where("weighted IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(word)).alias("ws"))
    words = F.transform("ws", lambda x: x["w"])
    text = F.array_join(F.transform(words, lambda w: w["text"]), " ")
    line = F.struct(text.alias("text"), F.lit(0).alias("order"), words.alias("words"))
    return made.select(*keys, F.array(F.struct(F.lit("text").alias("type"), F.lit(0).alias("order"), F.array(line).alias("lines"))).alias("blocks"))


def ground_truth_pages(votes_: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """Pages of a ground-truth version made from consensus: keys, blocks, confidence (1 - the page's entropy), needs_review.
    pages: what route() returns for them. Rejected pages, and those without engines, are left out."""
    kept = pages.where(F.col("source").isNotNull()).select(*keys, (1 - F.col("entropy")).alias("confidence"), "needs_review")
    return consensus_pages(votes_, *keys).join(kept, list(keys))


def statuses(grid: DataFrame, votes_: DataFrame, *keys: str) -> DataFrame:
    """Each engine at each position against the mean_tie winner: match, wrong or missing; and `extra` for insertions."""
    won = votes_.select(*keys, "position", F.col("mean_tie").alias("consensus"), F.col("mean_tie_confidence").alias("consensus_confidence"))
    at = grid.where("position IS NOT NULL").join(won, [*keys, "position"], "left")
    status = F.when(F.col("word").isNull(), "missing").when(F.col("word.text") == F.col("consensus"), "match").otherwise("wrong")
    extra = grid.where("position IS NULL").withColumn("consensus", F.lit(None).cast("string")).withColumn("consensus_confidence", F.lit(None).cast("double")).withColumn("status", F.lit("extra"))
    return at.withColumn("status", status).unionByName(extra)


def engine_stats(status_rows: DataFrame, *keys: str) -> DataFrame:
    return status_rows.groupBy(*keys, "engine").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("match", "wrong", "missing", "extra")))


def comparison_grid(status_rows: DataFrame, *keys: str) -> DataFrame:
    """For display: a row per position with the engines' entries as a map."""
    entry = F.struct(F.col("word.text").alias("text"), F.col("word.confidence").alias("confidence"), F.col("word.bbox").alias("bbox"), "status")
    rows = status_rows.where("position IS NOT NULL").groupBy(*keys, "position").agg(F.first("consensus").alias("consensus"), F.first("consensus_confidence").alias("consensus_confidence"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", entry.alias("e"))))).alias("engines"))
    return rows


def valid_candidate(blocks: Column) -> Column:
    """Whether a candidate page holds at least one word and no empty one."""
    texts = F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(b["lines"], lambda l: F.transform(l["words"], lambda w: w["text"])))))
    return (F.size(texts) > 0) & F.forall(texts, lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))


def agreement(status_rows: DataFrame, *keys: str) -> DataFrame:
    """Share of engines that match, by position."""
    return status_rows.where("position IS NOT NULL").groupBy(*keys, "position").agg(safe_div(F.count_if(F.col("status") == "match"), F.count("*")).alias("agreement"))
