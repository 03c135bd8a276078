"""Queries over the standard tables, one or more for each operator, with equivalent SQL where SQL has a form for it.

The tables hold no recognised pages, so readings are made from texts in ways that SQL repeats: `misread` (o and l become 0
and 1), `lowered`, `merged` (rn becomes m). Benchmark passages are documents; orders stand for runs, customers for PDFs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..operators import bootstrap, catalog, consensus, layout, reports, scoring, text
from ..sources import engines, normalize
from ..sources.files import read_table
from ..streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def passages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("ref"))


PASSAGES = "p AS (SELECT item_id AS doc_id, text AS ref FROM benchmark)"
READ = f"{PASSAGES}, r AS (SELECT doc_id, ref, unnest(['exact', 'misread', 'lowered', 'merged']) AS engine, unnest([ref, translate(ref, 'ol', '01'), lower(ref), replace(ref, 'rn', 'm')]) AS hyp FROM p)"


def readings(spark: SparkSession, d: str) -> DataFrame:
    made = F.array(*(F.struct(F.lit(n).alias("engine"), f(F.col("ref")).alias("hyp")) for n, f in (("exact", lambda c: c), ("misread", engines.misread), ("lowered", engines.lowered), ("merged", engines.merged))))
    return passages(spark, d).select("doc_id", "ref", F.inline(made))


def r6(c) -> F.Column:
    return F.round(c, 6)


@query(f"""WITH {READ}, s AS (SELECT engine, doc_id, levenshtein(ref, hyp) AS e, length(ref) AS n FROM r),
a AS (SELECT engine, count(*) AS pages, round(sum(e)::DOUBLE / sum(n), 6) AS cer, round(avg(e::DOUBLE / n), 6) AS mean_cer FROM s GROUP BY engine)
SELECT engine, pages, cer, mean_cer, CAST(row_number() OVER (ORDER BY cer, engine) AS INTEGER) AS rank FROM a""")
def run_scores(spark, d):
    from pyspark.sql import Window as W

    s = readings(spark, d).select("engine", F.levenshtein("ref", "hyp").alias("e"), F.length("ref").alias("n"), native.cer_levenshtein(F.col("ref"), F.col("hyp")).alias("cer"))
    a = s.groupBy("engine").agg(F.count("*").alias("pages"), r6(F.sum("e") / F.sum("n")).alias("cer"), r6(F.avg("cer")).alias("mean_cer"))
    return a.withColumn("rank", F.row_number().over(W.orderBy("cer", "engine")))  # a row per engine


def _pairs(spark, d, engine="misread"):
    return readings(spark, d).where(F.col("engine") == engine).select("doc_id", F.split("ref", " ").alias("ref"), F.split("hyp", " ").alias("hyp"))


POSITIONS = f"{PASSAGES}, h AS (SELECT doc_id, ref, translate(ref, 'ol', '01') AS hyp FROM p), c AS (SELECT doc_id, ref, unnest(range(1, length(ref) + 1)) AS i, hyp FROM h), x AS (SELECT doc_id, ref[i] AS a, hyp[i] AS b FROM c)"


@query(f"""WITH {POSITIONS} SELECT doc_id, count(*) AS ref_chars, sum(CASE WHEN a = b THEN 1 ELSE 0 END)::BIGINT AS matches, sum(CASE WHEN a <> b THEN 1 ELSE 0 END)::BIGINT AS substitutions,
round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS cer, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM x GROUP BY doc_id""")
def page_char_scores(spark, d):
    got = scoring.with_metrics(scoring.pair_counts(_pairs(spark, d)))
    return got.select("doc_id", "ref_chars", F.col("char_matches").alias("matches"), F.col("char_substitutions").alias("substitutions"), r6("cer").alias("cer"), r6("char_f1").alias("f1"))


@query(f"""WITH {PASSAGES}, w AS (SELECT doc_id, string_split(ref, ' ') AS a, string_split(translate(ref, 'ol', '01'), ' ') AS b FROM p), x AS (SELECT doc_id, unnest(a) AS a, unnest(b) AS b FROM w)
SELECT doc_id, count(*) AS ref_words, sum(CASE WHEN a <> b THEN 1 ELSE 0 END)::BIGINT AS substitutions, round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS wer FROM x GROUP BY doc_id""")
def page_word_scores(spark, d):
    got = scoring.with_metrics(scoring.pair_counts(_pairs(spark, d)))
    return got.select("doc_id", "ref_words", F.col("word_substitutions").alias("substitutions"), r6("wer").alias("wer"))


@query(f"""WITH {POSITIONS}, w AS (SELECT doc_id, unnest(string_split(ref, ' ')) AS a, unnest(string_split(hyp, ' ')) AS b FROM h)
SELECT round((SELECT avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END) FROM x), 6) AS cer, round((SELECT avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END) FROM w), 6) AS wer, (SELECT count(*) FROM p) AS pages, (SELECT count(*) FROM x) AS ref_chars, (SELECT count(*) FROM w) AS ref_words""")
def weighted_run(spark, d):
    got = scoring.run_scores(scoring.with_metrics(scoring.pair_counts(_pairs(spark, d).withColumn("run_id", F.lit("r1")))))
    return got.select(r6("cer").alias("cer"), r6("wer").alias("wer"), "pages", "ref_chars", "ref_words")


@query(f"WITH {POSITIONS} SELECT a AS ref_char, b AS hyp_char, count(*) AS n FROM x WHERE a <> b GROUP BY a, b")
def confusion_matrix(spark, d):
    rows = readings(spark, d).where("engine = 'misread'").select("doc_id", "ref", "hyp")
    return scoring.confusion(scoring.char_pairs(rows))


@query(f"""WITH {POSITIONS}, m AS (SELECT a, b, count(*) AS n FROM x WHERE a <> b GROUP BY a, b), l AS (SELECT a AS label, n FROM m UNION ALL SELECT b, n FROM m),
t AS (SELECT label FROM l GROUP BY label ORDER BY sum(n) DESC, label LIMIT 3) SELECT a AS ref_char, b AS hyp_char, n FROM m WHERE a IN (SELECT label FROM t) AND b IN (SELECT label FROM t)""")
def top_confusions(spark, d):
    return scoring.top_confusions(confusion_matrix(spark, d), 3)


@query(f"""WITH {PASSAGES}, w AS (SELECT doc_id, unnest(string_split(ref, ' ')) AS a, unnest(string_split(replace(ref, 'rn', 'm'), ' ')) AS b FROM p),
s AS (SELECT doc_id, CASE WHEN length(a) + length(b) = 0 THEN 1 ELSE 2.0 * (length(a) - 2 * (length(a) - length(b))) / (length(a) + length(b)) END >= 0.6 AS same FROM w)
SELECT doc_id, count_if(same) AS n_match, count_if(NOT same) AS n_substitution, CAST(0 AS BIGINT) AS n_insertion, CAST(0 AS BIGINT) AS n_deletion, CAST(0 AS DOUBLE) AS imagination, round(avg(CASE WHEN same THEN 0.01 ELSE 0.81 END), 6) AS calibration FROM s GROUP BY doc_id""")
def fuzzy_word_pairs(spark, d):
    word = lambda c: F.transform(F.split(c, " "), lambda w: F.struct(w.alias("text")))
    rows = readings(spark, d).where("engine = 'merged'").select("doc_id", word(F.col("ref")).alias("ref"), word(F.col("hyp")).alias("hyp"))
    rows = rows.withColumn("ref", F.transform("ref", lambda w: F.struct(w["text"], F.lit(None).cast("array<double>").alias("bbox"), F.lit(0.9).alias("confidence"))))
    rows = rows.withColumn("hyp", F.transform("hyp", lambda w: F.struct(w["text"], F.lit(None).cast("array<double>").alias("bbox"), F.lit(0.9).alias("confidence"))))
    return scoring.pair_stats(scoring.word_pairs(rows), "doc_id").select("doc_id", "n_match", "n_substitution", "n_insertion", "n_deletion", r6("imagination").alias("imagination"), r6("calibration").alias("calibration"))


@query(f"""WITH {READ}, s AS (SELECT engine, doc_id, CASE WHEN length(ref) = 0 THEN 0 ELSE levenshtein(ref, hyp)::DOUBLE / length(ref) END AS c FROM r)
SELECT engine, CASE WHEN c < 0.05 THEN 'good' WHEN c < 0.15 THEN 'fair' ELSE 'poor' END AS band, count(*) AS pages FROM s GROUP BY ALL""")
def error_bands(spark, d):
    band = native.band(native.cer_levenshtein(F.col("ref"), F.col("hyp")), (0.05, 0.15), ("good", "fair", "poor"))
    return readings(spark, d).groupBy("engine", band.alias("band")).agg(F.count("*").alias("pages"))


# Five engines at one position. Words that are dropped leave gaps, repeated ones stand nowhere; boxes, the same for all engines,
# tell which of two equal words in a row is gone. Confidences are such that the three rules of voting differ from one another.


def _grid(spark, d):
    def word(w, c, i):
        return F.struct(w.alias("text"), c.cast("double").alias("confidence"), F.array(i * 10.0, F.lit(0.0), i * 10.0 + 9, F.lit(12.0)).alias("bbox"))

    def words(c, sure):
        return F.transform(F.split(c, " "), lambda w, i: word(w, sure(i), i))

    exact, other = F.col("ref"), engines.misread(F.col("ref"))
    made = [
        ("exact", words(exact, lambda i: F.lit(0.9))), ("misread", words(other, lambda i: F.lit(0.45))), ("again", words(other, lambda i: F.when(i % 2 == 1, 0.1))),
        ("dropped", engines.dropped(words(exact, lambda i: F.lit(0.5)))), ("repeated", engines.repeated(words(exact, lambda i: F.lit(0.01)))),
    ]
    rows = passages(spark, d).select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("engine"), F.lit(i).alias("engine_rank"), w.alias("words")) for i, (n, w) in enumerate(made)))))
    return consensus.project(rows, "doc_id")


# e, m: the words; gone: the word is dropped; low: one of its misreadings has no confidence, which counts as 1 in sums.
GRID = f"""{PASSAGES}, u AS (SELECT doc_id, unnest(string_split(ref, ' ')) AS e, unnest(string_split(translate(ref, 'ol', '01'), ' ')) AS m, unnest(range(len(string_split(ref, ' ')))) AS position FROM p),
g AS (SELECT *, CAST((position + 1) % 7 = 0 AS INTEGER) AS gone, position % 2 = 0 AS low, CAST((position + 1) % 9 = 0 AS INTEGER) AS twice FROM u)"""
MAJORITY = "CASE WHEN gone = 1 AND low THEN m ELSE e END"
WEIGHTED = "CASE WHEN low THEN m ELSE e END"


@query(f"""WITH {GRID} SELECT doc_id, CAST(position AS INTEGER) AS position, {MAJORITY} AS majority, {WEIGHTED} AS weighted, e AS mean_tie, CAST(5 AS BIGINT) AS total_votes,
CASE WHEN m = e THEN 5 - gone WHEN gone = 1 THEN 2 ELSE 3 END::BIGINT AS majority_votes, {MAJORITY} <> {WEIGHTED} AS flag FROM g""")
def votes(spark, d):
    return consensus.votes(_grid(spark, d), "doc_id").select("doc_id", "position", "majority", "weighted", "mean_tie", "total_votes", "majority_votes", "flag")


def _h(*counts: str) -> str:
    """The entropy of the given counts as a share of the greatest one, in SQL."""
    n = "(" + " + ".join(counts) + ")"
    return "((" + " + ".join(f"CASE WHEN {c} > 0 THEN -(({c})::DOUBLE / {n}) * log2(({c})::DOUBLE / {n}) ELSE 0 END" for c in counts) + f") / log2({n}))"


ENTROPY = f"CASE WHEN m = e THEN {_h('(5 - gone)', 'gone')} ELSE {_h('(3 - gone)', '2', 'gone')} END"
NO_GAPS = f"CASE WHEN m = e THEN 0 ELSE {_h('(3 - gone)', '2')} END"


@query(f"WITH {GRID} SELECT doc_id, round(avg({ENTROPY}), 6) AS entropy, round(avg({NO_GAPS}), 6) AS entropy_no_gaps, count(*) AS positions FROM g GROUP BY doc_id")
def consensus_entropy(spark, d):
    got = consensus.page_entropy(consensus.entropies(_grid(spark, d), "doc_id"), "doc_id")
    return got.select("doc_id", r6("entropy").alias("entropy"), r6("entropy_no_gaps").alias("entropy_no_gaps"), "positions")


@query(f"""WITH {GRID}, s AS (SELECT count(*) AS n, count_if(m <> e) AS wrong, sum(gone) AS gone, sum(twice) AS twice FROM g)
SELECT engine, match::BIGINT AS match, wrong::BIGINT AS wrong, missing::BIGINT AS missing, extra::BIGINT AS extra FROM (
SELECT unnest(['exact', 'misread', 'again', 'dropped', 'repeated']) AS engine, unnest([n, n - wrong, n - wrong, n - gone, n]) AS match, unnest([0, wrong, wrong, 0, 0]) AS wrong, unnest([0, 0, 0, gone, 0]) AS missing, unnest([0, 0, 0, 0, twice]) AS extra FROM s)""")
def engine_stats(spark, d):
    g = _grid(spark, d)
    return consensus.engine_stats(consensus.statuses(g, consensus.votes(g, "doc_id"), "doc_id"))


@query(f"""WITH {GRID}, x AS (SELECT doc_id, CAST(position AS INTEGER) AS position, e, unnest(['exact', 'misread', 'again', 'dropped', 'repeated']) AS engine, unnest([e, m, m, CASE WHEN gone = 0 THEN e END, e]) AS text FROM g)
SELECT doc_id, position, engine, text, CASE WHEN text IS NULL THEN 'missing' WHEN text = e THEN 'match' ELSE 'wrong' END AS status FROM x""")
def comparison_grid(spark, d):
    g = _grid(spark, d)
    grid = consensus.comparison_grid(consensus.statuses(g, consensus.votes(g, "doc_id"), "doc_id"), "doc_id")
    return grid.select("doc_id", "position", F.explode("engines").alias("engine", "x")).select("doc_id", "position", "engine", "x.text", "x.status")


@query(f"WITH {GRID} SELECT doc_id, CAST(position AS INTEGER) AS position, round(CASE WHEN m = e THEN (5 - gone) / 5.0 ELSE (3 - gone) / 5.0 END, 6) AS agreement FROM g")
def position_agreement(spark, d):
    g = _grid(spark, d)
    return consensus.agreement(consensus.statuses(g, consensus.votes(g, "doc_id"), "doc_id"), "doc_id").select("doc_id", "position", r6("agreement").alias("agreement"))


@query(f"""WITH {GRID}, x AS (SELECT doc_id, avg({ENTROPY}) AS ce, bool_or({MAJORITY} <> {WEIGHTED}) AS flagged FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN ce >= 0.6 THEN 'reject' WHEN ce < 0.3 THEN 'accept' ELSE 'review' END AS decision, ce >= 0.3 OR flagged AS needs_review,
concat_ws('; ', CASE WHEN flagged THEN 'weighted and equal votes disagree' END, CASE WHEN ce >= 0.6 THEN 'high entropy' WHEN ce >= 0.3 THEN 'moderate entropy' END) AS warnings FROM x""")
def ground_truth_routing(spark, d):
    g = _grid(spark, d)
    flags = consensus.votes(g, "doc_id").groupBy("doc_id").agg(F.bool_or("flag").alias("flagged"))
    pages = consensus.page_entropy(consensus.entropies(g, "doc_id"), "doc_id").join(flags, "doc_id").withColumn("engines", F.lit(5))
    return consensus.route(pages).select("doc_id", "decision", "needs_review", F.array_join("warnings", "; ").alias("warnings"))


@query(f"WITH {GRID} SELECT doc_id, string_agg({WEIGHTED}, ' ' ORDER BY position) AS text FROM g GROUP BY doc_id")
def consensus_page(spark, d):
    made = consensus.consensus_pages(consensus.votes(_grid(spark, d), "doc_id"), "doc_id")
    return made.select("doc_id", F.col("blocks")[0]["lines"][0]["text"].alias("text"))


# Runs, versions, batches.


def _runs(spark, d):
    o = read_table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("pdf_id"), F.col("o_orderpriority").alias("engine_id"), status.alias("status"), F.col("o_orderdate").alias("completed_at"), F.col("o_totalprice").alias("price"))


RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS pdf_id, o_orderpriority AS engine_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS completed_at, o_totalprice AS price FROM orders)"
LATEST = f"{RUNS}, latest AS (SELECT * FROM runs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY pdf_id, engine_id ORDER BY completed_at DESC, run_id DESC) = 1)"


@query(f"WITH {LATEST} SELECT pdf_id, engine_id, run_id FROM latest")
def latest_runs(spark, d):
    return catalog.latest_runs(_runs(spark, d)).select("pdf_id", "engine_id", "run_id")


@query(f"""WITH {LATEST}, e AS (SELECT DISTINCT engine_id FROM runs), g AS (SELECT c_custkey AS pdf_id, engine_id FROM customer CROSS JOIN e)
SELECT g.pdf_id, g.engine_id, run_id, run_id IS NOT NULL AS has_run FROM g LEFT JOIN latest USING (pdf_id, engine_id)""")
def engine_grid(spark, d):
    r = _runs(spark, d)
    pdfs = read_table(spark, d, "customer").select(F.col("c_custkey").alias("pdf_id"))
    return catalog.compare_runs(catalog.latest_runs(r).select("pdf_id", "engine_id", "run_id"), pdfs, r.select("engine_id").distinct()).select("pdf_id", "engine_id", "run_id", "has_run")


VERSIONS = "v AS (SELECT l_orderkey AS pdf_id, l_linenumber AS version_number, l_partkey AS version_id, l_returnflag = 'R' AS gone FROM lineitem)"


def _versions(spark, d):
    l = read_table(spark, d, "lineitem")
    return l.select(F.col("l_orderkey").alias("pdf_id"), F.col("l_linenumber").alias("version_number"), F.col("l_partkey").alias("version_id"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deleted_at"))


@query(f"WITH {VERSIONS} SELECT pdf_id, max(version_number) AS version_number FROM v WHERE NOT gone GROUP BY pdf_id")
def current_ground_truth(spark, d):
    return catalog.current_versions(_versions(spark, d)).select("pdf_id", "version_number")


@query(f"WITH {VERSIONS} SELECT pdf_id, CAST(max(version_number) + 1 AS INTEGER) AS next_version FROM v GROUP BY pdf_id")
def next_ground_truth(spark, d):
    return catalog.next_versions(_versions(spark, d)).select("pdf_id", F.col("next_version").cast("int").alias("next_version"))


@query(f"WITH {RUNS} SELECT pdf_id AS batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS pending, CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 'running' WHEN count(*) FILTER (status = 'failed') = 0 OR count(*) FILTER (status = 'completed') > 0 THEN 'completed' ELSE 'failed' END AS status FROM runs GROUP BY pdf_id")
def batch_progress(spark, d):
    return catalog.batch_progress(_runs(spark, d).withColumnRenamed("pdf_id", "batch_id")).select("batch_id", "total", "completed", "failed", "pending", "status")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 10 ORDER BY c_custkey LIMIT 20")
def keyset_page(spark, d):
    return catalog.page_after(read_table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 10, 20)


@query(f"WITH {RUNS} SELECT run_id, completed_at FROM runs WHERE status = 'completed' ORDER BY completed_at DESC, run_id OFFSET 40 LIMIT 20")
def offset_page(spark, d):
    return catalog.list_rows(_runs(spark, d).where("status = 'completed'").select("run_id", "completed_at"), F.desc("completed_at"), F.col("run_id"), offset=40, limit=20)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('AN'))")
def document_search(spark, d):
    return catalog.search(read_table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "AN")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_ids(spark, d):
    return catalog.missing(read_table(spark, d, "customer").select("c_custkey"), read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"""WITH {RUNS}, b AS (SELECT pdf_id, max(CASE status WHEN 'completed' THEN 2 WHEN 'running' THEN 1 ELSE 0 END) AS s FROM runs GROUP BY pdf_id)
SELECT c_custkey AS request_id, CASE s WHEN 2 THEN 'return' WHEN 1 THEN 'conflict' ELSE 'create' END AS action FROM customer LEFT JOIN b ON pdf_id = c_custkey""")
def run_requests(spark, d):
    runs = _runs(spark, d).select("run_id", "status", F.col("completed_at").alias("created_at"), F.col("pdf_id").alias("run_hash"))
    req = read_table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("run_hash"))
    return catalog.classify_requests(req, runs).select("request_id", "action")


@query("SELECT p_partkey, sha256(sha256(p_name) || '|' || p_brand || '|1|{\"size\":' || p_size || ',\"type\":\"' || p_type || '\"}|2024-01-02') AS run_hash FROM part")
def run_identity(spark, d):
    p = read_table(spark, d, "part")
    config = F.create_map(F.lit("type"), F.concat(F.lit('"'), "p_type", F.lit('"')), F.lit("size"), F.col("p_size").cast("string"))
    return p.select("p_partkey", native.run_hash(F.sha2(F.col("p_name").cast("binary"), 256), F.col("p_brand"), F.lit("1"), config, F.lit("2024-01-02").cast("date")).alias("run_hash"))


@query("SELECT doc_id, 'store/pdf/' || sha256(text)[1:2] || '/' || sha256(text)[3:4] || '/' || sha256(text) || '.pdf' AS path, md5(text) AS md5 FROM documents")
def content_paths(spark, d):
    t = read_table(spark, d, "documents")
    return t.select("doc_id", native.storage_path("store", "pdf", F.sha2(F.col("text").cast("binary"), 256), "pdf").alias("path"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("""WITH f AS (SELECT printf('%09d', doc_id) AS path, '%PDF' || text AS content, doc_id FROM documents WHERE doc_id % 5 <> 0), k AS (SELECT sha256('%PDF' || text) AS s FROM documents WHERE doc_id % 7 = 0 AND doc_id % 3 <> 0)
SELECT sha256(content) AS sha256, min(path) AS path, md5(any_value(content)) AS md5, CAST(strlen(any_value(content)) AS BIGINT) AS size FROM f WHERE sha256(content) NOT IN (SELECT s FROM k) GROUP BY sha256(content)""")
def ingest_dedup(spark, d):
    """Files that are PDFs (those divisible by 5 aren't) and new among live documents (those divisible by 7; by 3 too: deleted)."""
    t = read_table(spark, d, "documents")
    pdf = F.concat(F.lit(b"%PDF"), F.col("text").cast("binary"))
    files = t.select(F.format_string("%09d", "doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, F.col("text").cast("binary")).otherwise(pdf).alias("content"))
    known = t.where("doc_id % 7 = 0").select(F.sha2(pdf, 256).alias("sha256"), F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    return catalog.ingest(known, files)


# Reports: a run's metrics come from a breakdown made of line items.


def _metrics(spark, d):
    l = read_table(spark, d, "lineitem")
    b = F.create_map(F.lit("character"), F.create_map(F.lit("cer"), F.col("l_discount"), F.lit("f1"), F.col("l_tax")), F.lit("word"), F.create_map(F.lit("wer"), F.col("l_discount") * 2, F.lit("f1"), 1 - F.col("l_tax")))
    s = l.select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("summary_id"), F.col("l_shipdate").alias("created_at"), F.lit(0.0).alias("overall_score"), b.alias("breakdown"))
    return reports.run_metrics(_runs(spark, d), s)


METRICS = f"{RUNS}, m AS (SELECT runs.*, l_discount AS cer, l_discount * 2 AS wer, l_tax AS char_f1, 1 - l_tax AS word_f1, CASE WHEN l_tax <> 0 THEN l_tax ELSE 1 - l_tax END AS f1 FROM runs LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey) = 1) ON l_orderkey = run_id)"


def _engines(spark, d):
    return _runs(spark, d).select("engine_id").distinct().select("engine_id", F.lower("engine_id").alias("slug"), F.col("engine_id").alias("display_name"))


@query(f"""WITH {METRICS}, a AS (SELECT engine_id, count(*) AS runs, round(avg(cer), 4) AS avg_cer, round(avg(wer), 4) AS avg_wer, round(avg(f1), 4) AS avg_f1 FROM m WHERE status = 'completed' GROUP BY engine_id)
SELECT lower(engine_id) AS slug, runs, avg_cer, avg_wer, avg_f1, CAST(row_number() OVER (ORDER BY avg_cer NULLS LAST, lower(engine_id)) AS INTEGER) AS rank FROM a""")
def engine_rankings(spark, d):
    return reports.rankings(_metrics(spark, d), _engines(spark, d)).select("slug", "runs", "avg_cer", "avg_wer", "avg_f1", "rank")


@query(f"""WITH {METRICS}, e AS (SELECT lower(engine_id) AS slug, avg(cer) AS c FROM m WHERE status = 'completed' AND cer IS NOT NULL GROUP BY engine_id)
SELECT (SELECT count(*) FROM customer) AS total_pdfs, count(*) AS total_runs, count(*) FILTER (status = 'completed') AS completed_runs, round(avg(cer), 4) AS avg_cer, round(avg(wer), 4) AS avg_wer,
(SELECT count(*) FROM lineitem JOIN runs ON l_orderkey = run_id WHERE status = 'completed') AS total_pages, (SELECT slug FROM e ORDER BY c, slug LIMIT 1) AS best_engine FROM m""")
def summary_statistics(spark, d):
    pdfs = read_table(spark, d, "customer").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    pages = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return reports.summary(pdfs, _metrics(spark, d), pages, _engines(spark, d))


@query(f"WITH {METRICS} SELECT run_id, round(cer, 6) AS cer FROM m WHERE status = 'completed' AND cer IS NOT NULL ORDER BY completed_at DESC, run_id DESC LIMIT 10")
def error_trend(spark, d):
    return reports.recent(_metrics(spark, d)).select("run_id", r6("cer").alias("cer"))


@query(f"""WITH {METRICS} SELECT m.run_id, l_linenumber AS page, coalesce(printf('%.4f', cer), '') AS cer, coalesce(printf('%.4f', char_f1), '') AS char_f1 FROM m JOIN lineitem ON l_orderkey = m.run_id WHERE status = 'completed'""")
def csv_export(spark, d):
    pages = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("page_number"))
    return reports.csv_rows(_metrics(spark, d), pages).select("run_id", "page", "cer", "char_f1")


# Text, geometry, statistics.


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0400}-\\x{052F}]') THEN 'cyrillic' WHEN regexp_matches(text, '[\\x{0370}-\\x{03FF}]') THEN 'greek' ELSE 'latin' END AS script FROM documents")
def dominant_script(spark, d):
    return text.with_script(read_table(spark, d, "documents")).select("doc_id", "script")


@query(f"""WITH {PASSAGES}, t AS (SELECT doc_id, lower(ref) AS a, replace(lower(ref), 'rn', 'm') AS b FROM p),
x AS (SELECT doc_id, a[i:i+2] AS g, count(*)::DOUBLE AS n FROM (SELECT doc_id, a, unnest(range(1, length(a) - 1)) AS i FROM t) GROUP BY ALL),
y AS (SELECT doc_id, b[i:i+2] AS g, count(*)::DOUBLE AS n FROM (SELECT doc_id, b, unnest(range(1, length(b) - 1)) AS i FROM t) GROUP BY ALL)
SELECT doc_id, round((SELECT sum(x.n * y.n) FROM x JOIN y USING (doc_id, g) WHERE x.doc_id = t.doc_id) / sqrt((SELECT sum(n * n) FROM x WHERE x.doc_id = t.doc_id)) / sqrt((SELECT sum(n * n) FROM y WHERE y.doc_id = t.doc_id)), 6) AS cosine FROM t""")
def trigram_similarity(spark, d):
    rows = passages(spark, d).select("doc_id", "ref", engines.merged(F.lower("ref")).alias("hyp"))
    return text.trigram_cosine(rows, "ref", "hyp", "doc_id").select("doc_id", r6("cosine").alias("cosine"))


@query()
def readability(spark, d):
    return text.plausibility(passages(spark, d).withColumnRenamed("ref", "text")).select("doc_id", *(r6(c).alias(c) for c in ("fluency", "grammaticality", "plausibility")))


@query("SELECT doc_id, translate(lower(text), '0123456789', 'oizeasgtbg') AS text FROM documents")
def unread_digits(spark, d):
    return read_table(spark, d, "documents").select("doc_id", native.unread(F.col("text")).alias("text"))


BOXES = "b AS (SELECT l_orderkey AS page_id, l_linenumber AS n, l_quantity AS x0, l_discount * 700 AS y0, l_quantity + 20 + l_tax * 400 AS x1, l_discount * 700 + 12 AS y1, l_discount * 10 AS confidence, l_linenumber * 10000000000000 + l_partkey * 1000000 + l_suppkey AS k FROM lineitem)"


def _boxes(spark, d):
    l = read_table(spark, d, "lineitem")
    x0, y0 = F.col("l_quantity"), F.col("l_discount") * 700
    return l.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n"), F.array(x0, y0, x0 + 20 + F.col("l_tax") * 400, y0 + 12).alias("bbox"), (F.col("l_discount") * 10).alias("confidence"), F.lit(0).alias("block_index"), (F.col("l_linenumber") * F.lit(10000000000000) + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("k"))


@query(f"""WITH {BOXES}, i AS (SELECT a.page_id, a.n AS a, c.n AS b, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS sizes FROM b a JOIN b c ON a.page_id = c.page_id AND a.n + 1 = c.n)
SELECT page_id, a, b, round(CASE WHEN inter > 0 THEN inter / (sizes - inter) ELSE 0 END, 6) AS iou FROM i""")
def box_overlap(spark, d):
    b = _boxes(spark, d)
    x, y = b.select("page_id", F.col("n").alias("a"), (F.col("n") + 1).alias("b"), F.col("bbox").alias("p")), b.select("page_id", F.col("n").alias("b"), F.col("bbox").alias("q"))
    return x.join(y, ["page_id", "b"]).select("page_id", "a", "b", r6(native.iou(F.col("p"), F.col("q"))).alias("iou"))


@query(f"""WITH {BOXES}, w AS (SELECT *, count(*) OVER p AS k, max(x1 - x0) OVER p / min(x1 - x0) OVER p AS ratio FROM b WINDOW p AS (PARTITION BY page_id))
SELECT page_id, n, coalesce(confidence < 0.3 OR (confidence < 0.5 AND k >= 3 AND ratio > 3), false) AS handwriting FROM w""")
def handwriting(spark, d):
    return text.tag_handwriting(_boxes(spark, d), "page_id").select("page_id", "n", "handwriting")


@query(f"""WITH {BOXES}, w AS (SELECT page_id, x0, lead(x0) OVER (PARTITION BY page_id ORDER BY k) AS nxt FROM b)
SELECT page_id, round(coalesce(sum(CASE WHEN x0 < nxt THEN 1.0 ELSE 0.0 END) / nullif(count(nxt), 0), 0), 6) AS rtl_penalty FROM w GROUP BY page_id""")
def rtl_order(spark, d):
    return text.rtl_penalty(_boxes(spark, d), "page_id", order="k").select("page_id", r6("rtl_penalty").alias("rtl_penalty"))


@query(f"""WITH {BOXES}, w AS (SELECT *, coalesce(((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY page_id ORDER BY (y0 + y1) / 2, x0, n) > 15)::INT, 0) AS new FROM b),
l AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY (y0 + y1) / 2, x0, n ROWS UNBOUNDED PRECEDING) AS line FROM w)
SELECT page_id, line::BIGINT AS line, count(*) AS words, round(min(x0), 4) AS x0, round(max(x1), 4) AS x1 FROM l GROUP BY page_id, line""")
def text_lines(spark, d):
    got = layout.line_islands(_boxes(spark, d), "page_id")
    return got.groupBy("page_id", "line").agg(F.count("*").alias("words"), F.round(F.min(F.col("bbox")[0]), 4).alias("x0"), F.round(F.max(F.col("bbox")[2]), 4).alias("x1"))


@query(f"""WITH {BOXES}, w AS (SELECT page_id, floor(x0) AS a, max(floor(x1)) OVER (PARTITION BY page_id ORDER BY floor(x0), floor(x1), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM b)
SELECT page_id, (a + e) / 2 AS middle FROM w WHERE a - e - 1 >= greatest(1, floor(100 * 0.05))""")
def column_gaps(spark, d):
    return layout.empty_strips(_boxes(spark, d).withColumn("width", F.lit(100.0)), "page_id")


@query(f"""WITH {BOXES} SELECT CAST(least(greatest(floor((y0 + y1) / 2 / 792 * 10), 0), 9) AS INTEGER) AS row, CAST(least(greatest(floor((x0 + x1) / 2 / 612 * 10), 0), 9) AS INTEGER) AS col, round(avg(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS error_rate, count(*) AS samples FROM b GROUP BY ALL""")
def error_heatmap(spark, d):
    w = _boxes(spark, d).withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "wrong": F.col("confidence") < 0.5})
    return scoring.error_heatmap(w).select("row", "col", r6("error_rate").alias("error_rate"), "samples")


@query()
def page_blocks(spark, d):
    words = _boxes(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", "bbox", "confidence"))).alias("w"))
    pages = words.select("page_id", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.transform("w", lambda w: F.struct(F.concat(F.lit("w"), w["n"].cast("string")).alias("text"), w["bbox"].alias("bbox"), w["confidence"].alias("confidence"))).alias("words"))
    return layout.blocks(pages, "page_id").select("page_id", "order", "column", "text", F.size("words").alias("words"))


@query("""WITH c AS (SELECT l_orderkey AS page_id, l_linenumber AS r, max(CAST(l_quantity AS VARCHAR)) AS a, max(CAST(CAST(floor(l_quantity / 2) * 2 AS BIGINT) AS VARCHAR)) AS b FROM lineitem GROUP BY ALL),
t AS (SELECT page_id, max(r) AS n, count(*) AS k, sum(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) AS s FROM c GROUP BY page_id)
SELECT page_id, 1.0::DOUBLE AS grits_top, round((s + n - k) / n, 6) AS grits_con, 1.0::DOUBLE AS grits_loc, 1.0::DOUBLE AS structure_precision, 1.0::DOUBLE AS structure_recall, 1.0::DOUBLE AS cell_accuracy, 1.0::DOUBLE AS table_detection_precision, 1.0::DOUBLE AS table_detection_recall FROM t""")
def table_structure(spark, d):
    l = read_table(spark, d, "lineitem")
    cell = lambda t: F.struct(F.col("l_linenumber") - 1, F.lit(0), F.lit(1), F.lit(1), t.cast("string"), F.array(F.lit(0.0), F.col("l_linenumber") * 10.0, F.lit(50.0), F.col("l_linenumber") * 10.0 + 9))
    t = l.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(cell(F.col("l_quantity")))).alias("a"), F.array_sort(F.collect_list(cell(F.floor(F.col("l_quantity") / 2) * 2))).alias("b"))
    box = F.array(F.lit(0.0), F.lit(0.0), F.lit(60.0), F.lit(90.0))
    pages = t.select("page_id", F.array(F.struct(box.alias("bbox"), F.col("a").alias("cells"))).alias("pred_tables"), F.array(F.struct(box.alias("bbox"), F.col("b").alias("cells"))).alias("gt_tables"))
    return layout.table_metrics(pages, "page_id").select("page_id", *(r6(m).alias(m) for m in layout.METRICS))


WEIGHT = " + ".join(f"CAST(u >= {x} AS INTEGER)" for x in bootstrap.LIMITS)
DRAWS = f"""t AS (SELECT engine AS k, c AS v, b, CAST('0x' || md5('7:' || b || ':' || doc_id)[1:12] AS BIGINT) AS u FROM (SELECT *, unnest(range(1000)) AS b FROM s)),
u AS (SELECT k, b, sum(v * w) / sum(w) AS stat FROM (SELECT *, {WEIGHT} AS w FROM t) WHERE w > 0 GROUP BY k, b),
o AS (SELECT k, stat, row_number() OVER (PARTITION BY k ORDER BY stat) - 1 AS r FROM u)"""
SCORES = f"{READ}, s AS (SELECT engine, doc_id, levenshtein(ref, hyp)::DOUBLE / length(ref) AS c FROM r)"


def _scores(spark, d):
    return readings(spark, d).select("engine", "doc_id", native.cer_levenshtein(F.col("ref"), F.col("hyp")).alias("value"))


@query(f"""WITH {SCORES}, {DRAWS}, z AS (SELECT k, max(CASE WHEN r = 25 THEN stat END) AS lower, max(CASE WHEN r = 975 THEN stat END) AS upper FROM o GROUP BY k)
SELECT s.engine, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std, round(max(z.lower), 6) AS lower, round(max(z.upper), 6) AS upper FROM s JOIN z ON s.engine = z.k GROUP BY s.engine""")
def bootstrap_intervals(spark, d):
    got = bootstrap.confidence_interval(_scores(spark, d), "engine", order="doc_id")
    return got.select("engine", "n", *(r6(c).alias(c) for c in ("mean", "std", "lower", "upper")))


@query(f"""WITH {SCORES}, {DRAWS}, x AS (SELECT a.stat - c.stat AS stat FROM u a JOIN u c USING (b) WHERE a.k = 'misread' AND c.k = 'lowered'), y AS (SELECT stat, row_number() OVER (ORDER BY stat) - 1 AS r FROM x)
SELECT round(avg(stat), 6) AS difference, round(max(CASE WHEN r = 25 THEN stat END), 6) AS lower, round(max(CASE WHEN r = 975 THEN stat END), 6) AS upper, max(CASE WHEN r = 25 THEN stat END) > 0 OR max(CASE WHEN r = 975 THEN stat END) < 0 AS significant FROM y""")
def bootstrap_comparison(spark, d):
    got = bootstrap.compare(_scores(spark, d), "engine", "misread", "lowered", order="doc_id")
    return got.select(*(r6(c).alias(c) for c in ("difference", "lower", "upper")), "significant")


@query(f"""WITH {SCORES}, {DRAWS}, z AS (SELECT k, max(CASE WHEN r = 25 THEN stat END) AS lower, max(CASE WHEN r = 975 THEN stat END) AS upper FROM o GROUP BY k)
SELECT engine, round(sum(levenshtein(ref, hyp))::DOUBLE / sum(length(ref)), 6) AS cer, round(any_value(z.lower), 6) AS lower, round(any_value(z.upper), 6) AS upper FROM r JOIN z ON engine = k GROUP BY engine""")
def scores_with_intervals(spark, d):
    s = readings(spark, d).groupBy("engine").agg(r6(F.sum(F.levenshtein("ref", "hyp")) / F.sum(F.length("ref"))).alias("cer"))
    return bootstrap.with_intervals(s, _scores(spark, d), "engine", order="doc_id").select("engine", "cer", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query(f"""WITH {SCORES}, t AS (SELECT c AS cer, 100 + 50 * (row_number() OVER (PARTITION BY engine ORDER BY doc_id) % 5) AS dpi, engine FROM s) SELECT engine, round(coalesce(regr_slope(cer, dpi), 0), 9) AS slope, count(*) AS points FROM t GROUP BY engine""")
def noise_sensitivity(spark, d):
    from pyspark.sql import Window as W

    s = _scores(spark, d).withColumn("dpi", 100 + 50 * (F.row_number().over(W.partitionBy("engine").orderBy("doc_id")) % 5)).withColumnRenamed("value", "cer")
    return scoring.noise_slope(s, "engine").select("engine", F.round("slope", 9).alias("slope"), "points")


@query("SELECT round(avg(pow(coalesce(n_chars % 100 / 100.0, 0) - quality, 2)), 6) AS calibration, count(*) AS n FROM documents JOIN labels USING (doc_id)")
def confidence_calibration(spark, d):
    j = read_table(spark, d, "documents").select("doc_id", "n_chars").join(read_table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    rows = j.select(F.lit("match").alias("op_text"), F.when(F.col("quality") == 1, "match").otherwise("substitution").alias("op"), F.lit(0).alias("hyp_idx"), ((F.col("n_chars") % 100) / 100).alias("confidence"))
    return scoring.pair_stats(rows).select(r6("calibration").alias("calibration"), F.col("n_match").alias("n"))


@query(f"""WITH {READ}, s AS (SELECT engine, levenshtein(ref, hyp)::DOUBLE / length(ref) AS cer, length(ref) AS n FROM r)
SELECT engine AS script, count(*) AS pages, round(sum(cer * n) / sum(n), 6) AS cer FROM s GROUP BY ROLLUP (engine)""")
def metrics_by_script(spark, d):
    s = readings(spark, d).select(F.col("engine").alias("script"), native.cer_levenshtein(F.col("ref"), F.col("hyp")).alias("cer"), F.length("ref").alias("ref_chars"), F.lit(0.0).alias("char_f1"), F.lit(0.0).alias("wer"), F.lit(0.0).alias("word_f1"), F.lit(1).alias("ref_words"))
    return scoring.by_script(s).select("script", "pages", r6("cer").alias("cer"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
i AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l)
SELECT doc_id, count(*) AS blocks, sum(k)::BIGINT AS lines FROM (SELECT doc_id, g, count(*) AS k FROM i WHERE trim(line) <> '' GROUP BY ALL) GROUP BY doc_id""")
def markdown_blocks(spark, d):
    got = normalize.markdown_blocks(read_table(spark, d, "documents"), "doc_id", text="text")
    return got.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.size("lines")).alias("lines"))


# Run events.


def _events(df):
    return df.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("type"), F.col("event_type").alias("status"), (F.col("event_id") % 100).cast("int").alias("page_number"), F.lit(100).alias("total_pages"), F.lit(None).cast("string").alias("message"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, event_id) AS status, max(event_id % 100)::INTEGER AS page_number, max(event_id) AS seq FROM events GROUP BY user_id")
def run_progress(spark, d):
    return events.latest_state(_events(read_table(spark, d, "events"))).select("run_id", "status", "page_number", "seq")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The same windows as a stream would give, over the whole table."""
    return events.windowed(_events(read_table(spark, d, "events"))).select("start", "type", "n")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_properties(spark, d):
    return read_table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
