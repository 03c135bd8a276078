"""Page layout and tables: the order-dependent parts run per page within Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grids
from ..functions import layout as kernel
from ..functions.nested import plain

WORDS = "array<struct<text:string,bbox:array<double>,confidence:double>>"
_word = pa.struct([("text", pa.string()), ("bbox", pa.list_(pa.float64())), ("confidence", pa.float64())])
_block = pa.struct([("bbox", pa.list_(pa.float64())), ("text", pa.string()), ("confidence", pa.float64()), ("order", pa.int32()), ("column", pa.int32()), ("words", pa.list_(_word))])
BLOCKS = f"array<struct<bbox:array<double>,text:string,confidence:double,order:int,column:int,words:{WORDS}>>"


def blocks(pages: DataFrame, *keys: str, overlap: float = 0.3, factor: float = 1.5) -> DataFrame:
    """pages: keys, width, height, words (whole page in one row, so no shuffle). Returns keys and a row per block, in reading order."""
    schema = "".join(f"`{n}` {t}, " for n, t in pages.select(*keys).dtypes) + f"_b {BLOCKS}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for ws, width, height in zip(plain(b["words"]), b["width"].to_pylist(), b["height"].to_pylist(), strict=True):
                usable = [w | {"confidence": w["confidence"] if w["confidence"] is not None else 1.0, "text": w["text"] or ""} for w in ws or [] if w and w["bbox"] and len(w["bbox"]) == 4]
                out.append(kernel.reading_order(kernel.blocks_of(usable, width or 1.0, height or 1.0, overlap, factor), width or 1.0))
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(out, pa.list_(_block))], [*keys, "_b"])

    made = pages.select(*keys, "width", "height", F.col("words").cast(WORDS).alias("words")).mapInArrow(run, schema)
    return made.select(*keys, F.explode("_b").alias("_x")).select(*keys, "_x.*")


def line_islands(words: DataFrame, *keys: str, gap: float = 15.0) -> DataFrame:
    """Adds `line`: words from top to bottom begin a new line where their middle lies more than `gap` below the one before."""
    # Both windows go by columns, as only then one sort serves both: another could put words of one place in another order, and
    # a word of theirs before the one that begins the line.
    rows = words.withColumns({"_m": (F.col("bbox")[1] + F.col("bbox")[3]) / 2, "_x": F.col("bbox")[0]})
    w = W.partitionBy(*keys).orderBy("_m", "_x")
    new = F.coalesce((F.col("_m") - F.lag("_m").over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_n", new).withColumn("line", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_n", "_m", "_x")


def line_agreement(words: DataFrame, *keys: str) -> DataFrame:
    """Share of words marked `agrees` on each line, with a level, and the line's extent."""
    share = F.avg(F.col("agrees").cast("int"))
    box = F.col("bbox")
    return words.groupBy(*keys, "line").agg(share.alias("agreement"), F.when(share >= 1, "full").when(share >= 0.5, "partial").otherwise("none").alias("level"), F.min(box[0]).alias("x0"), F.min(box[1]).alias("y0"), F.max(box[2]).alias("x1"), F.max(box[3]).alias("y1"))


def empty_strips(words: DataFrame, *keys: str, share: float = 0.05) -> DataFrame:
    """Middles of the empty vertical strips between words, as gaps between islands of x-ranges: keys, width, bbox in; keys, middle out."""
    w = W.partitionBy(*keys).orderBy(F.floor(F.col("bbox")[0]), F.floor(F.col("bbox")[2]))
    x0, x1 = F.floor(F.col("bbox")[0]), F.floor(F.col("bbox")[2])
    before = F.max(x1).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = words.select(*keys, "width", x0.alias("x0"), before.alias("end"))
    return rows.where((F.col("x0") - F.col("end") - 1) >= F.greatest(F.lit(1), F.floor(F.col("width") * share))).select(*keys, ((F.col("x0") + F.col("end")) / 2).alias("middle"))


def reading_order(blocks_: DataFrame, *keys: str) -> DataFrame:
    """Renumbers blocks with known columns by column, top, left."""
    w = W.partitionBy(*keys).orderBy("column", F.col("bbox")[1], F.col("bbox")[0])
    return blocks_.withColumn("order", F.row_number().over(w) - 1)


def tree_order(pages: DataFrame, *keys: str) -> DataFrame:
    """pages: keys, words. Returns keys, order, word: words in the order in which a spanning tree over their middles grows from
    the top left; those without a box of four numbers are left out."""
    schema = "".join(f"`{n}` {t}, " for n, t in pages.select(*keys).dtypes) + f"_w {WORDS}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for ws in plain(b["words"]):
                usable = [w for w in ws or [] if w and w["bbox"] and len(w["bbox"]) == 4]
                order = kernel.tree_order([((w["bbox"][0] + w["bbox"][2]) / 2, (w["bbox"][1] + w["bbox"][3]) / 2) for w in usable])
                out.append([usable[i] for i in order])
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(out, pa.list_(_word))], [*keys, "_w"])

    made = pages.select(*keys, F.col("words").cast(WORDS).alias("words")).mapInArrow(run, schema)
    return made.select(*keys, F.posexplode("_w").alias("order", "word"))


CELL = "struct<row:int,col:int,row_span:int,col_span:int,text:string,bbox:array<double>>"
TABLES = f"array<struct<bbox:array<double>,cells:array<{CELL}>>>"
METRICS = ("grits_top", "grits_con", "grits_loc", "structure_precision", "structure_recall", "cell_accuracy", "table_detection_precision", "table_detection_recall")


def table_metrics(pages: DataFrame, *keys: str, similarity: Callable[[str, str], float] = grids.text_similarity) -> DataFrame:
    """pages: keys, pred_tables, gt_tables (arrays of bbox and cells). Returns keys and the eight table metrics. similarity: of two
    cells' texts, 0 to 1."""
    schema = "".join(f"`{n}` {t}, " for n, t in pages.select(*keys).dtypes) + ", ".join(f"{m} double" for m in METRICS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [grids.page(p or [], t or [], similarity=similarity) for p, t in zip(plain(b["pred_tables"]), plain(b["gt_tables"]), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), *(pa.array([g[m] for g in got], pa.float64()) for m in METRICS)], [*keys, *METRICS])

    return pages.select(*keys, F.col("pred_tables").cast(TABLES).alias("pred_tables"), F.col("gt_tables").cast(TABLES).alias("gt_tables")).mapInArrow(run, schema)
