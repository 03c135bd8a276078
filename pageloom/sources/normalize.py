"""Raw engine output to the page hierarchy, with built-in array expressions: a page stays in its row, nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.native import words as split_words
from ..schema import BLOCK, CELL, CHAR, LINE, PAGE, TABLE, WORD, unfold

POINTS = 72.0


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _box(*xs: Column) -> Column:
    return F.array(*(x.cast("double") for x in xs))


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often make names it: as a lambda's variable, not as an expression.

    The lambda is the last step of an aggregate over nothing, as transform() would copy what it makes at every level."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, make)


def union_box(items: Column) -> Column:
    """The box around all items' boxes; zeros without any."""
    at = lambda i, f: f(F.transform(items, lambda x: x["bbox"][i]))
    return F.when(F.size(items) > 0, F.array(at(0, F.array_min), at(1, F.array_min), at(2, F.array_max), at(3, F.array_max))).otherwise(_box(*[F.lit(0.0)] * 4))


def mean_confidence(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(items)).otherwise(0.0)


def even_chars(text: Column, box: Column, confidence: Column) -> Column:
    """Characters spread evenly over a word's box."""

    def make(v: Column) -> Column:
        w, x, y, z, c = (v[k] for k in ("w", "x", "y", "z", "c"))
        one = lambda t, i: F.struct(t.alias("char"), _box(x + i * w, y, x + (i + 1) * w, z).alias("bbox"), c.alias("confidence"), i.alias("order"))
        return F.when(F.length(v["t"]) > 0, F.transform(F.split(v["t"], ""), one)).otherwise(_empty(CHAR))

    width = (box[2] - box[0]) / F.greatest(F.length(text), F.lit(1))
    return bind(F.struct(text.alias("t"), width.alias("w"), box[0].alias("x"), box[1].alias("y"), box[3].alias("z"), confidence.alias("c")), make)


def word_of(text: Column, box: Column, confidence: Column, order: Column, chars: Column | None = None) -> Column:
    if chars is not None:
        return F.struct(text.alias("text"), box.alias("bbox"), confidence.alias("confidence"), order.cast("int").alias("order"), chars.alias("chars")).cast(WORD)
    return bind(F.struct(text.alias("t"), box.alias("b"), confidence.alias("c")), lambda v: word_of(v["t"], v["b"], v["c"], order, even_chars(v["t"], v["b"], v["c"])))


def line_of(ws: Column, order: Column, text: Column | None = None) -> Column:
    return bind(ws, lambda v: F.struct((text if text is not None else F.array_join(F.transform(v, lambda w: w["text"]), " ")).alias("text"), union_box(v).alias("bbox"), mean_confidence(v).alias("confidence"), order.cast("int").alias("order"), v.alias("words"))).cast(LINE)


def block_of(ls: Column, order: Column) -> Column:
    return bind(ls, lambda v: F.struct(F.lit("text").alias("type"), union_box(v).alias("bbox"), mean_confidence(v).alias("confidence"), order.cast("int").alias("order"), v.alias("lines"))).cast(BLOCK)


def page_of(number: Column, width: Column, height: Column, blocks: Column, tables: Column | None = None) -> Column:
    return F.struct(number.cast("int").alias("page_number"), width.cast("double").alias("width"), height.cast("double").alias("height"), blocks.alias("blocks"), (tables if tables is not None else _empty(TABLE)).alias("tables")).cast(PAGE)


# Mock: boxes are structs, tables are marked by a block.

MOCK_WORD = "struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>"
MOCK = f"struct<page_number:int,width:double,height:double,blocks:array<struct<type:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double,lines:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double,words:array<{MOCK_WORD}>>>>>>"


def mock(raw: DataFrame, page: str = "raw") -> DataFrame:
    """Rows with a struct MOCK: adds data. Orders are positions; missing words get evenly spread characters; table blocks have no lines."""
    d = F.col(page).cast(MOCK)
    box = lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"])
    word = lambda w, i: word_of(w["text"], box(w["bbox"]), w["confidence"], i)
    line = lambda l, i: F.struct(l["text"].alias("text"), box(l["bbox"]).alias("bbox"), l["confidence"].alias("confidence"), i.alias("order"), F.transform(l["words"], word).alias("words")).cast(LINE)
    block = lambda b, i: F.struct(b["type"].alias("type"), box(b["bbox"]).alias("bbox"), b["confidence"].alias("confidence"), i.alias("order"), F.when(b["type"] != "table", F.transform(b["lines"], line)).alias("lines")).cast(BLOCK)
    return raw.withColumn("data", page_of(d["page_number"], d["width"], d["height"], F.transform(d["blocks"], block)))


# Tesseract: parallel lists of words, and a text of character boxes with the origin at the bottom left.

LISTS = ("level", "block_num", "par_num", "line_num", "left", "top", "width", "height", "conf", "text")


def parse_confidence(c: Column) -> Column:
    """Percent as text to 0..1; negative, missing and unreadable ones are 0."""
    return F.least(F.greatest(F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)) / 100, F.lit(0.0)), F.lit(1.0))


def char_boxes(boxes: Column, height: Column, scale: Column) -> Column:
    """`<char> left bottom right top page` lines as (char, bbox, order) in points from the top left."""
    rows = F.filter(F.transform(F.split(F.coalesce(boxes, F.lit("")), "\n"), lambda l: F.split(F.trim(l), " +")), lambda t: F.size(t) >= 6)
    num = lambda x: x.try_cast("double")
    return F.transform(rows, lambda t, i: F.struct(t[0].alias("char"), _box(num(t[1]) * scale, (height - num(t[4])) * scale, num(t[3]) * scale, (height - num(t[2])) * scale).alias("bbox"), i.alias("order")))


def tesseract(raw: DataFrame) -> DataFrame:
    """raw: page_number, width, height (pixels), dpi, image_to_data (struct of LISTS), image_to_boxes. Adds data.

    Words (level 5, not blank) form lines by (block, paragraph, line) and blocks by block, both in order of appearance; words
    of a line go by (top, left). A character belongs to the first word in that order whose box holds its centre; words
    without any get evenly spread ones.
    """
    scale = POINTS / F.coalesce(F.nullif(F.col("dpi").cast("double"), F.lit(0.0)), F.lit(300.0))
    d = F.col("image_to_data")
    zipped = F.arrays_zip(*(d[k].alias(k) for k in LISTS))
    usable = F.filter(zipped, lambda w: (w["level"].cast("int") == 5) & (F.trim(F.coalesce(w["text"], F.lit(""))) != ""))
    at = lambda w, k: w[k].cast("double") * scale
    own = F.transform(usable, lambda w, i: F.struct(
        w["block_num"].alias("b"), F.struct(w["block_num"], w["par_num"], w["line_num"]).alias("l"), F.struct(w["top"].cast("double"), w["left"].cast("double"), i).alias("o"),
        F.trim(w["text"]).alias("text"), _box(at(w, "left"), at(w, "top"), at(w, "left") + at(w, "width"), at(w, "top") + at(w, "height")).alias("bbox"), parse_confidence(w["conf"]).alias("confidence"),
    ))
    boxes = char_boxes(F.col("image_to_boxes"), F.col("height").cast("double"), scale)
    inside = lambda c, w: ((c["bbox"][0] + c["bbox"][2]) / 2).between(w["bbox"][0], w["bbox"][2]) & ((c["bbox"][1] + c["bbox"][3]) / 2).between(w["bbox"][1], w["bbox"][3])
    # Each step is bound, as a column of its own is put back into the lambdas that name it and worked out for each word again.
    ordered = lambda ws, k: F.transform(F.sort_array(F.transform(F.filter(ws, lambda w: w["l"] == k), lambda w: F.struct(w["o"].alias("o"), w.alias("w")))), lambda x: x["w"])
    by_line = lambda ws: bind(F.array_distinct(F.transform(ws, lambda w: w["l"])), lambda ks: F.transform(ks, lambda k: ordered(ws, k)))
    owned = lambda flat: F.transform(boxes, lambda c: F.struct(c.alias("c"), F.array_position(F.transform(flat, lambda w: F.coalesce(inside(c, w), F.lit(False))), True).alias("at")))

    def word(w: Column, i: Column, chars: Column, places: Column) -> Column:
        mine = bind(F.array_position(places, w["o"]), lambda at: F.filter(chars, lambda o: o["at"] == at))
        made = F.transform(mine, lambda o, k: F.struct(o["c"]["char"].alias("char"), o["c"]["bbox"].alias("bbox"), w["confidence"].alias("confidence"), k.alias("order")))
        some = F.when(F.size(chars) > 0, made.cast(f"array<{CHAR}>")).otherwise(_empty(CHAR))
        return word_of(w["text"], w["bbox"], w["confidence"], i, bind(some, lambda v: F.when(F.size(v) > 0, v).otherwise(even_chars(w["text"], w["bbox"], w["confidence"]))))

    def with_words(groups: Column) -> Column:
        def make(v: Column) -> Column:
            return F.transform(groups, lambda g: F.struct(g[0]["b"].alias("b"), F.transform(g, lambda w, i: word(w, i, v["chars"], v["places"])).alias("ws")))

        return bind(F.flatten(groups), lambda flat: bind(F.struct(owned(flat).alias("chars"), F.transform(flat, lambda x: x["o"]).alias("places")), make))

    def blocks_of(lines: Column) -> Column:
        kinds = F.array_distinct(F.transform(lines, lambda x: x["b"]))
        return F.transform(kinds, lambda b, i: block_of(F.transform(F.filter(lines, lambda x: x["b"] == b), lambda x, k: line_of(x["ws"], k)), i))

    blocks = bind(own, lambda ws: bind(by_line(ws), lambda groups: bind(with_words(groups), blocks_of)))
    return raw.withColumn("data", page_of(F.col("page_number"), F.col("width").cast("double") * scale, F.col("height").cast("double") * scale, blocks))


# Document AI: elements point into one text by character offsets; containment of ranges makes the hierarchy.

LAYOUT = "struct<text_anchor:struct<text_segments:array<struct<start_index:int,end_index:int>>>,bounding_poly:struct<normalized_vertices:array<struct<x:double,y:double>>,vertices:array<struct<x:double,y:double>>>,confidence:double>"
ELEMENT = f"array<struct<layout:{LAYOUT}>>"
AI_CELL = f"struct<layout:{LAYOUT},row_span:int,col_span:int,col_index:int>"
AI_PAGE = f"struct<page_number:int,dimensions:struct<width:double,height:double>,paragraphs:{ELEMENT},lines:{ELEMENT},tokens:{ELEMENT},symbols:{ELEMENT},tables:array<struct<layout:{LAYOUT},header_rows:array<struct<cells:array<{AI_CELL}>>>,body_rows:array<struct<cells:array<{AI_CELL}>>>>>>"
AI_DOCUMENT = f"struct<text:string,pages:array<{AI_PAGE}>>"


def anchor_text(text: Column, layout: Column) -> Column:
    """The segments' texts in a row; an end of 0 or none is the text's end; segments out of range are left out."""
    size = F.length(text)
    start = lambda s: F.coalesce(s["start_index"], F.lit(0))
    end = lambda s: F.coalesce(F.nullif(s["end_index"], F.lit(0)), size)
    segments = F.coalesce(layout["text_anchor"]["text_segments"], F.array().cast("array<struct<start_index:int,end_index:int>>"))
    ok = F.filter(segments, lambda s: (start(s) >= 0) & (end(s) <= size) & (start(s) < end(s)))
    return F.array_join(F.transform(ok, lambda s: F.substring(text, start(s) + 1, end(s) - start(s))), "")


def anchor_range(layout: Column) -> Column:
    s = layout["text_anchor"]["text_segments"]
    some = F.coalesce(F.size(s), F.lit(0)) > 0
    return F.struct(F.when(some, F.coalesce(s[0]["start_index"], F.lit(0))).otherwise(0).alias("s"), F.when(some, F.coalesce(F.element_at(s, -1)["end_index"], F.lit(0))).otherwise(0).alias("e"))


def layout_box(layout: Column, width: Column, height: Column) -> Column:
    """From normalised vertices times the page, else from plain ones, else zeros."""
    n, v = layout["bounding_poly"]["normalized_vertices"], layout["bounding_poly"]["vertices"]

    def around(a: Column, w: Column, h: Column) -> Column:
        ps = F.struct(F.transform(a, lambda p: F.coalesce(p["x"], F.lit(0.0))).alias("x"), F.transform(a, lambda p: F.coalesce(p["y"], F.lit(0.0))).alias("y"))
        return bind(ps, lambda v: _box(F.array_min(v["x"]) * w, F.array_min(v["y"]) * h, F.array_max(v["x"]) * w, F.array_max(v["y"]) * h))

    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    return F.when(some(n), around(n, width, height)).when(some(v), around(v, F.lit(1.0), F.lit(1.0))).otherwise(_box(*[F.lit(0.0)] * 4))


def document_ai(raw: DataFrame, document: str = "document") -> DataFrame:
    """Rows with a struct AI_DOCUMENT: a row per page with page_number and data. A document without pages gives one page of 1 x 1."""
    keys = [c for c in raw.columns if c != document]
    doc = raw.select(*keys, F.col(document).cast(AI_DOCUMENT).alias("_d"))
    pages = doc.select(*keys, F.coalesce(F.col("_d.text"), F.lit("")).alias("_t"), F.posexplode_outer("_d.pages").alias("_i", "_p"))
    p, text = F.col("_p"), F.col("_t")
    width, height = (F.coalesce(p["dimensions"][k], F.lit(0.0)) for k in ("width", "height"))

    def elements(kind: str) -> Column:
        e = F.coalesce(p[kind], F.array().cast(ELEMENT))
        one = lambda l: F.struct(anchor_range(l).alias("r"), anchor_text(text, l).alias("text"), layout_box(l, width, height).alias("bbox"), F.coalesce(l["confidence"], F.lit(0.0)).alias("confidence"))
        return F.transform(e, lambda x: bind(x["layout"], one))

    def within(children: Column, parent: Column) -> Column:
        r = parent["r"]
        return F.filter(children, lambda c: ((r["s"] == 0) & (r["e"] == 0)) | ((c["r"]["s"] >= r["s"]) & (c["r"]["e"] <= r["e"])))

    def word(t: Column, i: Column, symbols: Column) -> Column:
        own = F.transform(within(symbols, t), lambda s, k: F.struct(F.trim(s["text"]).alias("char"), s["bbox"].alias("bbox"), s["confidence"].alias("confidence"), k.alias("order")).cast(CHAR))
        plain = F.trim(t["text"])
        return word_of(plain, t["bbox"], t["confidence"], i, bind(own, lambda v: F.when(F.size(v) > 0, v).otherwise(even_chars(plain, t["bbox"], t["confidence"]))))

    block = lambda b, i, ls: F.struct(F.lit("text").alias("type"), b["bbox"].alias("bbox"), b["confidence"].alias("confidence"), i.alias("order"), ls.alias("lines")).cast(BLOCK)

    def blocks_of(v: Column) -> Column:
        line = lambda l, i: F.struct(F.trim(l["text"]).alias("text"), l["bbox"].alias("bbox"), l["confidence"].alias("confidence"), i.alias("order"), F.transform(within(v["tokens"], l), lambda t, k: word(t, k, v["symbols"])).alias("words")).cast(LINE)
        return F.when(F.size(v["paragraphs"]) > 0, F.transform(v["paragraphs"], lambda b, i: block(b, i, F.transform(within(v["lines"], b), line)))).otherwise(F.transform(v["lines"], lambda l, i: block(l, i, F.array(line(l, F.lit(0))))))

    # Bound, as columns of their own are put back into the lambdas that name them and worked out for each parent again.
    blocks = bind(F.struct(*(elements(k).alias(k) for k in ("paragraphs", "lines", "tokens", "symbols"))), blocks_of)

    def rows(t: Column) -> Column:
        kind = f"array<struct<cells:array<{AI_CELL}>>>"
        return F.concat(F.coalesce(t["header_rows"], F.array().cast(kind)), F.coalesce(t["body_rows"], F.array().cast(kind)))

    def cell(c: Column, r: Column) -> Column:
        one = lambda k: F.coalesce(F.nullif(c[k], F.lit(0)), F.lit(1))
        return F.struct(r.alias("row"), F.coalesce(c["col_index"], F.lit(0)).alias("col"), one("row_span").alias("row_span"), one("col_span").alias("col_span"), anchor_text(text, c["layout"]).alias("text"), layout_box(c["layout"], width, height).alias("bbox"), F.coalesce(c["layout"]["confidence"], F.lit(0.0)).alias("confidence")).cast(CELL)

    def table(t: Column) -> Column:
        cells = F.flatten(F.transform(rows(t), lambda r, i: F.transform(F.coalesce(r["cells"], F.array().cast(f"array<{AI_CELL}>")), lambda c: cell(c, i))))
        cols = F.coalesce(F.array_max(F.transform(cells, lambda c: c["col"] + c["col_span"])), F.lit(0))
        return F.struct(layout_box(t["layout"], width, height).alias("bbox"), F.size(rows(t)).alias("num_rows"), cols.alias("num_cols"), F.lit("").alias("caption"), cells.alias("cells")).cast(TABLE)

    tables = F.transform(F.coalesce(p["tables"], F.array().cast(f"array<struct<layout:{LAYOUT},header_rows:array<struct<cells:array<{AI_CELL}>>>,body_rows:array<struct<cells:array<{AI_CELL}>>>>>")), table)
    number = F.when(F.coalesce(p["page_number"], F.lit(0)) >= 1, p["page_number"]).otherwise(F.coalesce(F.col("_i"), F.lit(0)) + 1)
    none = page_of(F.lit(1), F.lit(1.0), F.lit(1.0), _empty(BLOCK))
    made = pages.withColumn("data", F.when(p.isNull(), none).otherwise(page_of(number, width, height, blocks, tables)))
    return made.select(*keys, number.alias("page_number"), "data")


# Textract: one flat list of blocks that point at one another by id.

TX = "struct<Id:string,BlockType:string,Text:string,Confidence:double,Page:int,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>,Polygon:array<struct<X:double,Y:double>>>,Relationships:array<struct<Type:string,Ids:array<string>>>,RowIndex:int,ColumnIndex:int,RowSpan:int,ColumnSpan:int,EntityTypes:array<string>,SelectionStatus:string,Width:double,Height:double>"


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["X"]), F.transform(points, lambda p: p["Y"])
    return _box(F.array_min(xs) * width, F.array_min(ys) * height, F.array_max(xs) * width, F.array_max(ys) * height)


def textract_pages(blocks: Column) -> Column:
    """How many pages an array of TX has: its PAGE blocks, 1 at least."""
    return F.greatest(F.size(F.filter(F.coalesce(blocks, F.array().cast(f"array<{TX}>")), lambda b: b["BlockType"] == "PAGE")), F.lit(1))


def by_id(blocks: Column, make: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """make(find): find(id) is the last of an array of TX with that id, or null. Ids lie in about as many lists, by their hash, as a
    list has ids, so that work grows with the power 1.5 of a document's blocks, not with their square."""
    lists = F.greatest(F.floor(F.sqrt(F.size(blocks))).cast("int"), F.lit(1))

    def with_lists(n: Column) -> Column:
        of = lambda i: F.pmod(F.hash(i), n)
        tagged = F.transform(blocks, lambda b, i: F.struct(b["Id"].alias("id"), of(b["Id"]).alias("h"), i.alias("at")))
        dealt = bind(tagged, lambda ts: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(ts, lambda t: t["h"] == k)))
        # Past either end get() is null, and so is that of a null.
        find = lambda ls: lambda i: F.get(blocks, F.try_element_at(F.filter(F.get(ls, of(i)), lambda t: t["id"] == i), F.lit(-1))["at"])
        return bind(dealt, lambda ls: make(find(ls)))

    return bind(lists, with_lists)


def textract(raw: DataFrame, blocks: str = "blocks", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with key and an array of TX: a row per page with key, the columns `keep`, page_number and data. A document stays in its row.

    A page's children in order: lines become one block of one line each, tables a marker block and a table; forms and
    selection marks are left out. Orders are the children's positions, skipped ones included. Cells count from 0; a cell's
    text is its own. Inches become points; a page without a size is Letter. Of blocks with one id the last counts.
    """
    ids = lambda b: F.coalesce(F.try_element_at(F.filter(b["Relationships"], lambda r: r["Type"] == "CHILD"), F.lit(1))["Ids"], F.array().cast("array<string>"))
    sure = lambda b: F.coalesce(b["Confidence"], F.lit(0.0)) / 100
    text = lambda b: F.coalesce(b["Text"], F.lit(""))
    less = lambda c, d: F.greatest(F.coalesce(c, F.lit(1)) - d, F.lit(1 - d))

    def page(ps: Column, number: Column, find: Callable[[Column], Column]) -> Column:
        w, h = F.coalesce(ps[0]["Width"], F.lit(8.5)) * POINTS, F.coalesce(ps[0]["Height"], F.lit(11.0)) * POINTS

        def box(b: Column) -> Column:
            g = b["Geometry"]["BoundingBox"]
            return _box(*(F.coalesce(x, F.lit(0.0)) for x in (g["Left"] * w, g["Top"] * h, (g["Left"] + g["Width"]) * w, (g["Top"] + g["Height"]) * h)))

        def children(b: Column, kind: str) -> Column:
            return F.filter(F.transform(ids(b), lambda i, k: F.struct(k.alias("k"), find(i).alias("x"))), lambda c: c["x"]["BlockType"] == kind)

        def line(b: Column) -> Column:
            ws = F.transform(children(b, "WORD"), lambda c: word_of(text(c["x"]), box(c["x"]), sure(c["x"]), c["k"]))
            return F.struct(text(b).alias("text"), box(b).alias("bbox"), sure(b).alias("confidence"), F.lit(0).alias("order"), ws.alias("words")).cast(LINE)

        def table(b: Column) -> Column:
            cell = lambda x: F.struct(less(x["RowIndex"], 1).alias("row"), less(x["ColumnIndex"], 1).alias("col"), less(x["RowSpan"], 0).alias("row_span"), less(x["ColumnSpan"], 0).alias("col_span"), text(x).alias("text"), box(x).alias("bbox"), sure(x).alias("confidence")).cast(CELL)
            most = lambda cs, a, n: F.coalesce(F.array_max(F.transform(cs, lambda c: c[a] + c[n])), F.lit(0))
            return bind(F.transform(children(b, "CELL"), lambda c: cell(c["x"])), lambda cs: F.struct(box(b).alias("bbox"), most(cs, "row", "row_span").alias("num_rows"), most(cs, "col", "col_span").alias("num_cols"), F.lit("").alias("caption"), cs.alias("cells")).cast(TABLE))

        is_table = lambda b: b["BlockType"] == "TABLE"
        block = lambda b, o: F.struct(F.when(is_table(b), "table").otherwise("text").alias("type"), box(b).alias("bbox"), sure(b).alias("confidence"), o.alias("order"), F.when(b["BlockType"] == "LINE", F.array(line(b))).alias("lines")).cast(BLOCK)
        found = F.flatten(F.transform(ps, lambda p: F.transform(ids(p), lambda i, o: F.struct(o.alias("o"), find(i).alias("x")))))
        # Blocks that share a page's number are one page; their children stand by their positions.
        top = bind(F.filter(found, lambda c: c["x"]["BlockType"].isin("LINE", "TABLE")), lambda cs: F.when(F.size(ps) > 1, F.array_sort(cs, lambda a, b: a["o"] - b["o"])).otherwise(cs))
        made = lambda cs: page_of(number, w, h, F.transform(cs, lambda c: block(c["x"], c["o"])), F.transform(F.filter(cs, lambda c: is_table(c["x"])), lambda c: table(c["x"])))
        return F.struct(number.alias("page_number"), bind(top, made).alias("data"))

    def pages(bs: Column) -> Column:
        no = lambda p: F.coalesce(p["Page"], F.lit(1))
        first = F.filter(bs, lambda b: b["BlockType"] == "PAGE")
        each = lambda ps, find: F.transform(F.array_distinct(F.transform(ps, no)), lambda n: bind(F.filter(ps, lambda p: no(p) == n), lambda own: page(own, n, find)))
        return bind(first, lambda ps: by_id(bs, lambda find: each(ps, find)))

    return unfold(raw, [key, *keep], bind(F.col(blocks).cast(f"array<{TX}>"), pages), "_p").select(key, *keep, "_p.page_number", "_p.data")


# Models that answer in markdown or JSON, without positions: boxes are laid out by rule.


def slice_box(i: Column, n: Column, width: Column, height: Column) -> Column:
    """The i-th of n slices of a page, with margins of a twentieth of the width and a tenth of the slice."""
    h = height / F.greatest(n, F.lit(1))
    return _box(width * 0.05, h * i + h * 0.1, width * 0.95, h * i + h * 0.9)


def even_words(text: Column, box: Column) -> Column:
    def make(v: Column) -> Column:
        b = v["b"]
        w = (b[2] - b[0]) / F.greatest(F.size(v["ws"]), F.lit(1))
        return F.transform(v["ws"], lambda t, i: word_of(t, _box(b[0] + i * w, b[1], b[0] + (i + 1) * w, b[3]), F.lit(1.0), i))

    return bind(F.struct(split_words(text).alias("ws"), box.alias("b")), make)


def even_lines(lines: Column, box: Column) -> Column:
    """Lines spread over the height of a box; blank ones keep their place and are left out."""

    def make(v: Column) -> Column:
        b = v["b"]
        h = (b[3] - b[1]) / F.greatest(F.size(v["ls"]), F.lit(1))
        at = lambda i: _box(b[0], b[1] + i * h, b[2], b[1] + (i + 1) * h)
        line = lambda t, i: bind(at(i), lambda x: F.struct(F.trim(t).alias("text"), x.alias("bbox"), F.lit(1.0).alias("confidence"), i.alias("order"), even_words(t, x).alias("words"))).cast(LINE)
        return F.transform(v["ls"], line)

    return F.filter(bind(F.struct(lines.alias("ls"), box.alias("b")), make), lambda l: l["text"] != "")


def split_markdown(text: Column) -> Column:
    """The blocks of a markdown text as an array of type, level, lines; see markdown_blocks."""
    # A fence is a line that begins with three backticks; what lies between two of them is code. Every part but the first begins with
    # the end of a fence's line, so that an empty one has no line at all.
    parts = F.split(F.coalesce(text, F.lit("")), "(?:^|\\n) *```[^\\n]*")
    made = lambda kind, level, lines: F.struct(F.lit(kind).alias("type"), level.cast("int").alias("level"), lines.alias("lines"))

    def prose(ls: Column) -> Column:
        n, head, cut = F.size(ls), lambda l: l["head"], lambda l: l["s"] == ""
        before = lambda i: F.get(ls, i - 1)
        begins = F.filter(F.transform(ls, lambda l, i: F.when(~cut(l) & (head(l) | (i == 0) | cut(before(i)) | head(before(i))), i)), lambda i: i.isNotNull())

        def block(a: Column, b: Column) -> Column:
            own = F.filter(F.slice(ls, a + 1, b - a), lambda l: ~cut(l))
            text_ = made("text", F.lit(None), F.transform(own, lambda l: l["line"]))
            return bind(F.get(ls, a), lambda l: F.when(head(l), made("heading", F.length(F.regexp_extract(l["s"], "^(#{1,6})", 1)), F.array(F.regexp_extract(l["s"], "^#{1,6}\\s+(.+)$", 1)))).otherwise(text_))

        return bind(begins, lambda bs: F.transform(bs, lambda a, i: block(a, F.coalesce(F.get(bs, i + 1), n))))

    def blocks(p: Column, i: Column) -> Column:
        lines = bind(F.when(i > 0, F.substr(p, F.lit(2))).otherwise(p), lambda x: F.split(x, "\n"))
        tagged = F.transform(lines, lambda l: bind(F.trim(l), lambda t: F.struct(l.alias("line"), t.alias("s"), t.rlike("^#{1,6}\\s+.+$").alias("head"))))
        none = F.array().cast("array<struct<type:string,level:int,lines:array<string>>>")
        return F.when((i > 0) & (p == ""), none).when(i % 2 == 1, F.array(made("code", F.lit(None), lines))).otherwise(bind(tagged, prose))

    return F.flatten(F.transform(parts, blocks))


def markdown_blocks(pages: DataFrame, *keys: str, text: str = "raw_text") -> DataFrame:
    """Blocks of markdown: keys, block (from 0), type (heading, text, code), level, lines. Headings stand alone; blank lines and
    fences end a block, except that blank lines within a fence belong to it. A page stays in its row."""
    return pages.select(*keys, F.posexplode_outer(split_markdown(F.col(text))).alias("block", "_b")).where(F.col("_b").isNotNull()).select(*keys, "block", "_b.*")


def _number(pages: DataFrame) -> Column:
    """The page's own number; 1 where rows have none or it is null."""
    return F.coalesce(F.col("page_number").cast("int"), F.lit(1)) if "page_number" in pages.columns else F.lit(1)


def _markdown_page(pages: DataFrame, text: str) -> Column:
    width, height = F.col("width"), F.col("height")
    spread = lambda bs: F.transform(bs, lambda b, i: even_lines(b["lines"], slice_box(i, F.size(bs), width, height)))
    blocks = bind(split_markdown(F.col(text)), lambda bs: F.transform(F.filter(spread(bs), lambda ls: F.size(ls) > 0), block_of))
    return page_of(_number(pages), width, height, blocks)


def vlm_markdown(pages: DataFrame, *keys: str, text: str = "raw_text") -> DataFrame:
    """pages: keys, width, height, text, and page_number if there is more than one page. Adds data (a page without blocks for an empty text)."""
    return pages.withColumn("data", _markdown_page(pages, text))


ITEM = "array<struct<text:string,content:string,confidence:double>>"


def vlm_json(pages: DataFrame, *keys: str, text: str = "raw_text") -> DataFrame:
    """pages: keys, width, height, text: a JSON list of items or texts, or an object with blocks, pages, text_blocks, or one item.
    What isn't JSON is read as markdown. Confidences that are missing or 0 are 1. Adds data."""
    width, height = F.col("width"), F.col("height")
    s = lambda x, p, t: F.try_variant_get(x, p, t)
    get = lambda v, p: s(v, p, "array<variant>")
    of = lambda x, i: F.struct(i.alias("i"), F.coalesce(s(x, "$.text", "string"), s(x, "$.content", "string"), F.when(F.schema_of_variant(x) == "STRING", s(x, "$", "string")), F.lit("")).alias("t"), F.least(F.coalesce(F.nullif(s(x, "$.confidence", "double"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0)).alias("c"))

    def blocks(items: Column) -> Column:
        lines = lambda t, b: even_lines(F.filter(F.split(t, "\n"), lambda l: F.trim(l) != ""), b)
        block = lambda x: bind(slice_box(x["i"], F.size(items), width, height), lambda b: F.struct(F.lit("text").alias("type"), b.alias("bbox"), x["c"].alias("confidence"), x["i"].alias("order"), lines(x["t"], b).alias("lines")).cast(BLOCK))
        return F.transform(F.filter(items, lambda x: F.trim(x["t"]) != ""), block)

    def page(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        good = v.isNotNull() & (kind.startswith("ARRAY") | kind.startswith("OBJECT"))
        items = F.transform(F.coalesce(get(v, "$"), get(v, "$.blocks"), get(v, "$.pages"), get(v, "$.text_blocks"), F.array(v)), of)
        return F.when(F.coalesce(good, F.lit(False)), page_of(_number(pages), width, height, bind(items, blocks))).otherwise(_markdown_page(pages, text))

    return pages.withColumn("data", bind(F.try_parse_json(F.col(text)), page))


def vlm(pages: DataFrame, *keys: str, form: str = "markdown", text: str = "raw_text") -> DataFrame:
    return (vlm_json if form == "json" else vlm_markdown)(pages, *keys, text=text)
