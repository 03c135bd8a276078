"""Summaries, rankings and exports."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import short_list


def run_metrics(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """runs with cer, wer, char_f1, word_f1 and f1 of their first summary (by created_at, then summary_id).

    summaries: run_id, summary_id, created_at, overall_score, breakdown (map of maps). f1 is the first of overall score,
    character F1 and word F1 that is neither missing nor 0.
    """
    at = lambda a, b: F.try_element_at(F.try_element_at(F.col("breakdown"), F.lit(a)), F.lit(b)).cast("double")
    f = lambda c: F.nullif(c, F.lit(0.0))
    values = {"cer": at("character", "cer"), "wer": at("word", "wer"), "char_f1": at("character", "f1"), "word_f1": at("word", "f1"), "_own": F.col("overall_score").cast("double")}
    # Dealt by run as plain numbers, without maps, and only then grouped, so that nothing is sorted before.
    slim = summaries.select("run_id", "created_at", "summary_id", *(c.alias(n) for n, c in values.items())).repartition("run_id")
    first = slim.groupBy("run_id").agg(F.min_by(F.struct(*values), F.struct("created_at", "summary_id")).alias("s"))
    return runs.join(first, "run_id", "left").select(
        *runs.columns, *(F.col(f"s.{n}").alias(n) for n in ("cer", "wer", "char_f1", "word_f1")), F.coalesce(f(F.col("s._own")), f(F.col("s.char_f1")), F.col("s.word_f1")).alias("f1")
    )


def summary(pdfs: DataFrame, metrics: DataFrame, pages: DataFrame, engines: DataFrame) -> DataFrame:
    """One row: total_pdfs (live), total_runs, completed_runs, total_pages (of completed runs), avg_cer, avg_wer, best_engine."""
    done = F.col("status") == "completed"
    # One pass: sums by engine, of which the rest is made.
    per = metrics.groupBy("engine_id").agg(
        F.count("*").alias("n"), F.count_if(done).alias("done"), *(f(c).alias(f"{n}_{c}") for c in ("cer", "wer") for n, f in (("sum", F.sum), ("count", F.count))), F.avg(F.when(done, F.col("cer"))).alias("own")
    )
    mean = lambda c: F.round(F.coalesce(F.try_divide(F.sum(f"sum_{c}"), F.sum(f"count_{c}")), F.lit(0.0)), 4)
    rank = F.when(F.col("own").isNotNull() & F.col("slug").isNotNull(), F.struct("own", "slug"))
    r = per.join(short_list(engines.select("engine_id", "slug")), "engine_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_runs"), F.coalesce(F.sum("done"), F.lit(0)).alias("completed_runs"), mean("cer").alias("avg_cer"), mean("wer").alias("avg_wer"), F.min(rank)["slug"].alias("best_engine")
    )
    p = pdfs.where("deleted_at IS NULL").agg(F.count("*").alias("total_pdfs"))
    g = pages.join(metrics.where("status = 'completed'").select("run_id"), "run_id", "left_semi").agg(F.count("*").alias("total_pages"))
    one = p
    for x in (r, g):
        one = one.join(F.broadcast(x), F.lit(True))  # each is a single row
    return one


def rankings(metrics: DataFrame, engines: DataFrame) -> DataFrame:
    """Engines with a completed run: avg_cer, avg_wer, avg_f1, runs, rank by cer (missing last), then slug."""
    per = metrics.where("status = 'completed'").groupBy("engine_id").agg(F.count("*").alias("runs"), *(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("cer", "wer", "f1")))
    named = per.join(short_list(engines.select("engine_id", "slug", "display_name")), "engine_id")
    return named.withColumn("rank", F.row_number().over(W.orderBy(F.col("avg_cer").asc_nulls_last(), "slug")))  # a row per engine


def recent(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The trend of error rates: the last n completed runs with one, oldest first."""
    return metrics.where("status = 'completed' AND cer IS NOT NULL").orderBy(F.desc("completed_at"), F.desc("run_id")).limit(n).orderBy("completed_at", "run_id")


def _cell(c: str) -> Column:
    return F.coalesce(F.format_string("%.4f", F.col(c)), F.lit(""))


def csv_rows(metrics: DataFrame, pages: DataFrame, page_scores: DataFrame | None = None) -> DataFrame:
    """A row per page: run_id, engine, pdf, page, cer, wer, char_f1, word_f1 with four decimals, blank where missing. The values
    are the run's, or the page's own if page_scores (run_id, page_number and those) are given."""
    names = ("cer", "wer", "char_f1", "word_f1")
    rows = pages.select("run_id", "page_number").join(metrics.where("status = 'completed'"), "run_id")
    if page_scores is not None:
        rows = rows.drop(*names).join(page_scores.select("run_id", "page_number", *names), ["run_id", "page_number"], "left")
    return rows.select("run_id", F.col("engine_id").alias("engine"), F.col("pdf_id").alias("pdf"), F.col("page_number").alias("page"), *(_cell(c).alias(c) for c in names))


def json_rows(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))


def html_page(summary_row: dict, ranking_rows: list[dict], title: str = "Evaluation report") -> str:
    """A self-contained page from the summary and the rankings, both small."""

    def cell(v) -> str:
        return html.escape("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))

    cards = "".join(f"<div class=card><b>{cell(v)}</b><span>{html.escape(k.replace('_', ' '))}</span></div>" for k, v in summary_row.items())
    head = list(ranking_rows[0]) if ranking_rows else []
    table = "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r[h])}</td>" for h in head) + "</tr>" for r in ranking_rows) + "</table>"
    style = "body{font:14px sans-serif;margin:2em}.card{display:inline-block;border:1px solid #ccc;padding:.6em 1em;margin:.3em}.card b{display:block;font-size:1.4em}td,th{padding:.3em .8em;border-bottom:1px solid #ddd;text-align:left}"
    return f"<!doctype html><html><head><meta charset=utf-8><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{cards}<h2>Engines</h2>{table}</body></html>"


def export(metrics: DataFrame, pages: DataFrame, engines: DataFrame, pdfs: DataFrame, path: str, form: str) -> str:
    """Writes the report to path as csv, json (both by the executors) or html (one file of small aggregates). LookupError without completed runs."""
    if metrics.where("status = 'completed'").isEmpty():
        raise LookupError("no completed runs")
    if form == "csv":
        csv_rows(metrics, pages).write.mode("overwrite").csv(path, header=True)
    elif form == "json":
        json_rows(metrics.where("status = 'completed'")).write.mode("overwrite").text(path)
    elif form == "html":
        page = html_page(summary(pdfs, metrics, pages, engines).first().asDict(), [r.asDict() for r in rankings(metrics, engines).drop("engine_id").collect()])
        metrics.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown form {form!r}; one of {json.dumps(['csv', 'json', 'html'])}")
    return path
