"""Run events as a stream: state of runs, progress, and pages scored as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "run_id string, seq long, ts timestamp, type string, status string, page_number int, total_pages int, message string"


def read(spark: SparkSession, folder: str, schema: str = SCHEMA, files: int = 100) -> DataFrame:
    """Parquet files as they arrive, at most so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once_each(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drops repeats of (run_id, seq) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def windowed(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of time; each window comes out once, when nothing more can fall into it."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "type").agg(F.count("*").alias("n"), F.approx_count_distinct("run_id").alias("runs")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "type", "n", "runs")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a run's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """The newest status and page of each run; works on a stream (complete or update mode) and on a table."""
    key = F.struct("seq", "ts")
    return events.groupBy("run_id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), key)).alias("status"), F.max("page_number").alias("page_number"), F.max("total_pages").alias("total_pages"), F.max("seq").alias("seq"))


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what there is and stops: into a folder, or through a function of (batch, number), which is called again
    with the same number after a failure."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").option("path", sink).start() if isinstance(sink, str) else writer.foreachBatch(sink).start()
    query.awaitTermination()
    return query


def score_pages(stream: DataFrame, truth: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Scores pages (run_id, doc_id, page_number, words) against ground truth as they arrive; each batch in a folder of its own
    number, so that one repeated after a failure replaces itself."""
    from ..operators.scoring import page_scores

    return run_to_end(stream, lambda batch, n: page_scores(batch, truth).write.mode("overwrite").parquet(f"{folder}/batch={n}"), checkpoint)
