"""Files in and out: PDFs, raw engine output, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.native import storage_path


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of matching files, folders below included."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def address_raw(raw: DataFrame, base: str, prefix: str = "raw") -> DataFrame:
    """Raw output (run_id, raw struct) as JSON with its own digest and path: run_id, sha256, path, value. Equal outputs share a path."""
    out = raw.select("run_id", F.to_json("raw").alias("value")).withColumn("sha256", F.sha2(F.col("value").cast("binary"), 256))
    return out.select("run_id", "sha256", storage_path(base, prefix, F.col("sha256"), "json").alias("path"), "value")


def write_raw(addressed: DataFrame, folder: str) -> None:
    """One row per digest, in folders by its first two letters; writing again changes nothing."""
    one = addressed.dropDuplicates(["sha256"]).select("sha256", "value", F.substring("sha256", 1, 2).alias("p"))
    known = _known(addressed.sparkSession, folder)
    one = one if known is None else one.join(known, "sha256", "left_anti")
    one.write.mode("append").partitionBy("p").json(folder)


def _known(spark: SparkSession, folder: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("sha256 string, value string, p string").json(folder).select("sha256")


def read_raw(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """sha256 and raw, parsed by schema; only that is read of what else there may be."""
    return spark.read.schema("sha256 string, value string, p string").json(folder).select("sha256", F.from_json("value", schema).alias("raw"))


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").partitionBy("run_id").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A relational table, read in ranges of a numeric column if one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()
