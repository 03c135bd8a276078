"""The page hierarchy as nested columns, the values of enumerations, and checks of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAR = "struct<char:string,bbox:array<double>,confidence:double,order:int>"
WORD = f"struct<text:string,bbox:array<double>,confidence:double,order:int,chars:array<{CHAR}>>"
LINE = f"struct<text:string,bbox:array<double>,confidence:double,order:int,words:array<{WORD}>>"
BLOCK = f"struct<type:string,bbox:array<double>,confidence:double,order:int,lines:array<{LINE}>>"
CELL = "struct<row:int,col:int,row_span:int,col_span:int,text:string,bbox:array<double>,confidence:double>"
TABLE = f"struct<bbox:array<double>,num_rows:int,num_cols:int,caption:string,cells:array<{CELL}>>"
PAGE = f"struct<page_number:int,width:double,height:double,blocks:array<{BLOCK}>,tables:array<{TABLE}>>"
DOCUMENT = f"struct<pages:array<{PAGE}>,engine_id:string,engine_version:string,config_snapshot:map<string,string>>"

# The states and names that stored rows hold.
PDF_STATUS = ("uploaded", "processing", "completed", "failed")
RUN_STATUS = ("pending", "queued", "running", "completed", "failed", "cancelled")
GT_SOURCE = ("manual", "auto_consensus", "imported")
BLOCK_TYPES = ("text", "table", "figure", "math", "separator")
SCORE_LEVELS = ("character", "word", "line", "paragraph", "block", "table", "page", "document")
SCORE_METRICS = ("cer", "wer", "accuracy", "precision", "recall", "f1", "edit_distance", "confidence", "table_structure")


def type_of(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


def unfold(rows: DataFrame, keep: list[str], items: F.Column, *names: str) -> DataFrame:
    """A row for each item that isn't null: keep, then the item, or its position and itself, by name. `items` is worked out once for
    a row: of a plain explode() the optimizer makes a filter as well, and pushes that below with all that `items` is made of."""
    outer = F.explode_outer(items) if len(names) == 1 else F.posexplode_outer(items)
    return rows.select(*keep, outer.alias(*names)).where(F.col(names[-1]).isNotNull())


def page_words(pages: DataFrame, data: str = "data") -> DataFrame:
    """One row per word of each page, in reading order: the other columns, then word_pos, block_index, line_index, word."""
    keys = [c for c in pages.columns if c != data]
    blocks = unfold(pages, keys, F.col(f"{data}.blocks"), "block_index", "_b")
    lines = blocks.select(*keys, "block_index", F.posexplode("_b.lines").alias("line_index", "_l"))
    # The position within the page comes from the nesting, so no row is sorted or shuffled.
    words = lines.select(*keys, "block_index", "line_index", F.posexplode("_l.words").alias("word_in_line", "word"))
    return words


def page_chars(pages: DataFrame, data: str = "data") -> DataFrame:
    """One row per character of each page, for overlays: page_words without word, then char_pos, char, bbox, confidence."""
    rows = page_words(pages, data)
    rows = rows.select(*(c for c in rows.columns if c != "word"), F.posexplode("word.chars").alias("char_pos", "_c"))
    return rows.select(*(c for c in rows.columns if c != "_c"), "_c.char", "_c.bbox", "_c.confidence")


def page_word_list(data) -> F.Column:
    """All words of a page as one array, in order."""
    return F.flatten(F.transform(F.coalesce(data["blocks"], F.array().cast(f"array<{BLOCK}>")), lambda b: F.flatten(F.transform(F.coalesce(b["lines"], F.array().cast(f"array<{LINE}>")), lambda l: F.coalesce(l["words"], F.array().cast(f"array<{WORD}>"))))))


def page_text(data) -> F.Column:
    """A page's words joined by single blanks."""
    return F.array_join(F.transform(page_word_list(data), lambda w: w["text"]), " ")


def validate_pages(pages: DataFrame, data: str = "data") -> DataFrame:
    """Rows of `pages` that break a rule of the hierarchy, with the rules' names: (the other columns), violations.

    Rules: page number at least 1; positive width and height; block types known; boxes of four numbers, ordered;
    confidences from 0 to 1; orders not negative; cells with spans of at least 1 inside their table.
    """
    d = F.col(data)

    def bad_box(b):
        return b.isNotNull() & ((F.size(b) != 4) | (b[0] > b[2]) | (b[1] > b[3]))

    def bad(x):
        return bad_box(x["bbox"]) | ~F.coalesce(x["confidence"], F.lit(1.0)).between(0, 1) | (x["order"] < 0)

    lines = F.flatten(F.transform(F.filter(d["blocks"], lambda b: b["lines"].isNotNull()), lambda b: b["lines"]))
    cells = F.flatten(F.transform(d["tables"], lambda t: F.transform(t["cells"], lambda c: F.struct(c.alias("c"), t["num_rows"].alias("r"), t["num_cols"].alias("k")))))
    rules = {
        "page_number": d["page_number"] < 1,
        "page_size": (d["width"] <= 0) | (d["height"] <= 0),
        "block_type": F.exists(d["blocks"], lambda b: ~b["type"].isin(*BLOCK_TYPES)),
        "block": F.exists(d["blocks"], bad),
        "line": F.exists(lines, bad),
        "word": F.exists(page_word_list(d), bad),
        "cell": F.exists(cells, lambda x: (x["c"]["row_span"] < 1) | (x["c"]["col_span"] < 1) | (x["c"]["row"] < 0) | (x["c"]["col"] < 0) | (x["c"]["row"] >= x["r"]) | (x["c"]["col"] >= x["k"])),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    # Not by where(), which would be pushed below the pages and make them once more for each rule.
    some = F.transform(F.array(found), lambda v: F.when(F.size(v) > 0, v))
    return unfold(pages, [c for c in pages.columns if c != data], some, "violations")
