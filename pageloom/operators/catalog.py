"""Documents, runs, ground-truth versions and batches as immutable tables: each operation returns a new DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: A table that is to be broadcast as a short list may have so many rows.
SHORT = 10_000


def short_list(df: DataFrame) -> DataFrame:
    """df to be broadcast, once its rows are counted as few; a longer one is left to the optimizer."""
    return F.broadcast(df) if df.limit(SHORT + 1).count() <= SHORT else df


def active(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted).isNull())


def soft_delete(df: DataFrame, which: Column, at: Column, deleted: str = "deleted_at") -> DataFrame:
    """Marks live rows for which `which` holds; rows deleted before keep their time."""
    return df.withColumn(deleted, F.when(which & F.col(deleted).isNull(), at).otherwise(F.col(deleted)))


def ingest(known: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path, content) that are PDFs and whose content is new among live documents, once each: path, sha256, md5, size."""
    new = files.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("size"))
    one = new.groupBy("sha256").agg(F.min("path").alias("path"), F.first("md5").alias("md5"), F.first("size").alias("size"))
    return one.join(active(known).select("sha256"), "sha256", "left_anti").select("path", "sha256", "md5", "size")


def merge_config(defaults: Column, user: Column) -> Column:
    """Defaults overlaid by the user's settings."""
    own = F.coalesce(user, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)), own)


def classify_requests(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """What to do with requested runs (request_id, run_hash), by the newest run of the same hash: return a completed one,
    conflict with one in flight, else create. Failed and cancelled ones don't block. Adds action, run_id."""
    best = runs.groupBy("run_hash").agg(F.max_by(F.struct("run_id", "status"), F.struct((F.col("status") == "completed").alias("d"), F.col("status").isin("pending", "queued", "running").alias("f"), "created_at", "run_id")).alias("b"))
    met = requests.join(best, "run_hash", "left")
    status = F.col("b.status")
    action = F.when(status == "completed", "return").when(status.isin("pending", "queued", "running"), "conflict").otherwise("create")
    return met.select(*requests.columns, action.alias("action"), F.when(action != "create", F.col("b.run_id")).alias("run_id"))


# States that a run may pass to.
NEXT = {"pending": ("queued", "cancelled"), "queued": ("running", "cancelled"), "running": ("completed", "failed", "cancelled")}


def transition(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies changes (run_id, status; one per run), where the present state allows; others leave the run as it is."""
    allowed = F.lit(False)
    for now, to in NEXT.items():
        allowed = allowed | ((F.col("status") == now) & F.col("_to").isin(*to))
    met = runs.join(changes.select("run_id", F.col("status").alias("_to")), "run_id", "left")
    return met.withColumn("status", F.when(allowed, F.col("_to")).otherwise(F.col("status"))).select(*runs.columns)


def append_log(runs: DataFrame, which: Column, timestamp: Column, level: str, message: Column) -> DataFrame:
    entry = F.struct(timestamp.alias("timestamp"), F.lit(level).alias("level"), message.alias("message"))
    return runs.withColumn("logs", F.when(which, F.array_append(F.coalesce("logs", F.array().cast(dict(runs.dtypes)["logs"])), entry)).otherwise(F.col("logs")))


def logs(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.posexplode("logs").alias("position", "_l")).select("run_id", "position", "_l.*")


def latest_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """The completed run of each group that ended last; ties to the greater run_id."""
    keys = keys or ("pdf_id", "engine_id")
    w = W.partitionBy(*keys).orderBy(F.desc("completed_at"), F.desc("run_id"))
    return runs.where("status = 'completed'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def list_rows(df: DataFrame, *order: Column, offset: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, cursor=None, limit: int = 20) -> DataFrame:
    """The page after the last returned key; the next cursor is the greatest key of this page."""
    rows = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    return rows.orderBy(key).limit(limit)


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.contains(F.lower(F.col(column)), F.lower(F.lit(text))))


def missing(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return ids.join(known.select(key), key, "left_anti")


def remove_runs(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Hard delete, for runs and every table with a run_id."""
    return table.join(gone.select("run_id").distinct(), "run_id", "left_anti")


def current_versions(versions: DataFrame) -> DataFrame:
    """The newest live version of each document."""
    return active(versions).withColumn("_r", F.row_number().over(W.partitionBy("pdf_id").orderBy(F.desc("version_number")))).where("_r = 1").drop("_r")


def next_versions(versions: DataFrame) -> DataFrame:
    """The number that a document's next version gets: deleted ones count."""
    return versions.groupBy("pdf_id").agg((F.max("version_number") + 1).alias("next_version"))


def create_version(versions: DataFrame, pages: DataFrame, pdf_id: str, source: str, new_pages: DataFrame, version_id: str) -> tuple[DataFrame, DataFrame]:
    """Adds a version with its pages (page_number, data)."""
    number = versions.where(F.col("pdf_id") == pdf_id).agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).cast("int").alias("version_number"))
    row = number.select(F.lit(version_id).alias("version_id"), F.lit(pdf_id).alias("pdf_id"), "version_number", F.lit(source).alias("source"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return versions.unionByName(row.select(versions.columns)), pages.unionByName(new_pages.withColumn("version_id", F.lit(version_id)).select(pages.columns))


def replace_page(pages: DataFrame, old_version: str, new_version: str, page_number: int, data: Column) -> DataFrame:
    """Copy on write: the new version's pages are the old one's, with one replaced. Returns the new rows."""
    own = pages.where(F.col("version_id") == old_version)
    return own.withColumn("data", F.when(F.col("page_number") == page_number, data).otherwise(F.col("data"))).withColumn("version_id", F.lit(new_version))


def edit_word(data: Column, index: int, text: str) -> Column:
    """A page whose word at `index` of the first line of the first block reads otherwise; the line's text follows."""

    def line(l: Column) -> Column:
        ws = F.transform(l["words"], lambda w, i: F.when(i == index, w.withField("text", F.lit(text))).otherwise(w))
        return l.withField("words", ws).withField("text", F.array_join(F.transform(ws, lambda w: w["text"]), " "))

    def block(b: Column) -> Column:
        return b.withField("lines", F.transform(b["lines"], lambda l, i: F.when(i == 0, line(l)).otherwise(l)))

    return data.withField("blocks", F.transform(data["blocks"], lambda b, i: F.when(i == 0, block(b)).otherwise(b)))


def promote(versions: DataFrame, version_id: str) -> DataFrame:
    """Gives a live version the document's next number, so that it is current."""
    top = versions.groupBy("pdf_id").agg(F.max("version_number").alias("_top"))
    met = versions.join(top, "pdf_id")
    return met.withColumn("version_number", F.when((F.col("version_id") == version_id) & F.col("deleted_at").isNull(), F.col("_top") + 1).otherwise(F.col("version_number")).cast("int")).select(versions.columns)


def check_comparison(run_ids: Sequence[str], runs: DataFrame, pdf_id: str | None = None, least: int = 2, most: int = 5) -> list[str]:
    """The run ids of a comparison, once they are sound: UUIDs (blank ones are skipped), from `least` to `most` of them, of known,
    completed runs, and with pdf_id all of that document. ValueError, for unknown runs LookupError."""
    ids = []
    for x in run_ids:
        if x.strip():
            try:
                ids.append(str(uuid.UUID(x.strip())))
            except ValueError as e:
                raise ValueError(f"not a run's id: {x.strip()!r}") from e
    if not least <= len(ids) <= most:
        raise ValueError(f"a comparison takes {least} to {most} runs, not {len(ids)}")
    known = {r["run_id"]: r for r in runs.where(F.col("run_id").isin(ids)).select("run_id", "pdf_id", "status").collect()}  # `most` rows
    if unknown := [i for i in ids if i not in known]:
        raise LookupError(f"no such runs: {', '.join(unknown)}")
    if pdf_id is not None and (other := [i for i in ids if known[i]["pdf_id"] != pdf_id]):
        raise ValueError(f"not of document {pdf_id}: {', '.join(other)}")
    if unfinished := [i for i in ids if known[i]["status"] != "completed"]:
        raise ValueError(f"not completed: {', '.join(unfinished)}")
    return ids


def page_of_rows(df: DataFrame, *order: Column, page: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    """The page-th page of ordered rows, and how many rows there are in all."""
    return list_rows(df, *order, offset=(page - 1) * size, limit=size), df.count()


def batch_items(batch_id: str, pdfs: DataFrame, engines: DataFrame) -> DataFrame:
    """Every document by every engine. The engines are a short list that the caller names, so this grows with the documents."""
    return pdfs.select("pdf_id").join(short_list(engines.select("engine_id")), F.lit(True)).select(F.lit(batch_id).alias("batch_id"), "pdf_id", "engine_id", F.lit("pending").alias("status"))


def batch_progress(items: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    done = n("completed") + n("failed")
    out = items.groupBy("batch_id").agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), (F.count("*") - done).alias("pending"), F.round(done * 100 / F.count("*"), 1).alias("percent"))
    state = F.when(F.col("pending") > 0, "running").when((F.col("failed") == 0) | (F.col("completed") > 0), "completed").otherwise("failed")
    return out.withColumn("status", state)


def upsert(seed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows with seed's rows put in their place by key, and seed's new ones added."""
    return rows.join(seed.select(key), key, "left_anti").unionByName(seed.select(rows.columns))


def compare_runs(latest: DataFrame, pdfs: DataFrame, engines: DataFrame) -> DataFrame:
    """A row per document and engine with the latest run, or none: engines are a short list."""
    grid = pdfs.select("pdf_id").join(short_list(engines.select("engine_id")), F.lit(True))
    return grid.join(latest, ["pdf_id", "engine_id"], "left").withColumn("has_run", F.col("run_id").isNotNull())
