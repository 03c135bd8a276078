"""Queries over pages: normalisers, scores against truth, versions, states and exports, with equivalent SQL.

Raw engine output is made from line items: an order is a page, its items are words. Benchmark passages are pages of four to a
document, and their readings are made as in `queries`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import native
from ..operators import catalog, consensus, layout, reports, scoring, text
from ..schema import page_chars, page_word_list, unfold, validate_pages
from ..sources import engines, normalize
from ..sources.files import read_table
from ..streaming import events
from .queries import ENTROPY, GRID, LATEST, MAJORITY, METRICS, PASSAGES, RUNS, VERSIONS, WEIGHTED, _events, _grid, _metrics, _runs, _versions, passages, query, r6

# Items of an order as words, in a fixed order (i from 0).
ITEMS = "i AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, * FROM lineitem)"


def _items(spark, d):
    l = read_table(spark, d, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return l.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def each(make):
    return F.transform("items", make)


# Normalisers.


@query(f"""WITH {ITEMS}, w AS (SELECT page_id, i, l_linenumber % 2 AS b, CAST(l_quantity AS INTEGER) % 3 AS l, l_suppkey % 100 AS t, l_partkey % 1000 AS x, l_returnflag || l_linenumber AS text, l_discount FROM i WHERE l_suppkey % 11 <> 0),
f AS (SELECT *, min(i) OVER (PARTITION BY page_id, b) AS fb, min(i) OVER (PARTITION BY page_id, b, l) AS fl FROM w)
SELECT page_id, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY fb) - 1 AS INTEGER) AS block, CAST(dense_rank() OVER (PARTITION BY page_id, b ORDER BY fl) - 1 AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY page_id, b, l ORDER BY t, x, i) - 1 AS INTEGER) AS pos,
text, round(x * 0.24, 4) AS x0, round(t * 0.24, 4) AS y0, round((x + 40) * 0.24, 4) AS x1, round((t + 20) * 0.24, 4) AS y1, round(least(greatest(CASE WHEN l_discount = 0 THEN -1 ELSE l_discount * 1000 END / 100, 0), 1), 6) AS confidence, CAST(length(text) AS INTEGER) AS chars FROM f""")
def tesseract_words(spark, d):
    conf = lambda x: F.when(x["l_discount"] == 0, F.lit("-1")).otherwise((x["l_discount"] * 1000).cast("string"))
    lists = {
        "level": lambda x: F.lit(5), "block_num": lambda x: x["l_linenumber"] % 2, "par_num": lambda x: F.lit(1), "line_num": lambda x: x["l_quantity"].cast("int") % 3,
        "left": lambda x: x["l_partkey"] % 1000, "top": lambda x: x["l_suppkey"] % 100, "width": lambda x: F.lit(40), "height": lambda x: F.lit(20), "conf": conf,
        "text": lambda x: F.when(x["l_suppkey"] % 11 == 0, F.lit("  ")).otherwise(F.concat(x["l_returnflag"], x["l_linenumber"].cast("string"))),
    }
    raw = _items(spark, d).select("page_id", F.lit(1).alias("page_number"), F.lit(2550).alias("width"), F.lit(3300).alias("height"), F.lit(300).alias("dpi"), F.struct(*(each(f).alias(k) for k, f in lists.items())).alias("image_to_data"), F.lit(None).cast("string").alias("image_to_boxes"))
    data = unfold(normalize.tesseract(raw), ["page_id"], F.col("data.blocks"), "b")
    lines = data.select("page_id", F.col("b.order").alias("block"), F.explode("b.lines").alias("l"))
    w = lines.select("page_id", "block", F.col("l.order").alias("line"), F.explode("l.words").alias("w"))
    box = lambda k: F.round(F.col("w.bbox")[k], 4)
    return w.select("page_id", "block", "line", F.col("w.order").alias("pos"), "w.text", box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"), r6("w.confidence").alias("confidence"), F.size("w.chars").alias("chars"))


def _document_ai(spark, d):
    """Words of four digits at offsets of five, three to a line, one paragraph; places from discount and tax."""
    token = lambda x: F.lpad(F.col("page_id").cast("string").substr(-2, 2), 4, "0")  # noqa: E731, ARG005
    n = F.size("items")

    def layout_of(s, e, x=None):
        place = [F.lit(0.0)] * 4 if x is None else [x["l_discount"], x["l_tax"], x["l_discount"] + 0.1, x["l_tax"] + 0.02]
        corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
        poly = F.struct(F.array(corner(place[0], place[1]), corner(place[2], place[3])).alias("normalized_vertices"), F.array().cast("array<struct<x:double,y:double>>").alias("vertices"))
        anchor = F.struct(F.array(F.struct(s.cast("int").alias("start_index"), e.cast("int").alias("end_index"))).alias("text_segments"))
        return F.struct(F.struct(anchor.alias("text_anchor"), poly.alias("bounding_poly"), (F.lit(0.5) if x is None else x["l_discount"] * 10).cast("double").alias("confidence")).alias("layout"))

    tokens = F.transform("items", lambda x, i: layout_of(i * 5, i * 5 + 4, x))
    lines = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 3).cast("int")), lambda k: layout_of(k * 15, F.least(k * 15 + 14, n * 5 - 1)))
    page = F.struct(F.lit(1).alias("page_number"), F.struct(F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).alias("dimensions"), F.array(layout_of(F.lit(0), n * 5 - 1)).alias("paragraphs"), lines.alias("lines"), tokens.alias("tokens"), F.array().cast(normalize.ELEMENT).alias("symbols"), F.lit(None).cast("array<string>").alias("tables"))
    doc = F.struct(F.array_join(each(token), " ").alias("text"), F.array(page.withField("tables", F.array().cast(f"array<struct<layout:{normalize.LAYOUT},header_rows:array<struct<cells:array<{normalize.AI_CELL}>>>,body_rows:array<struct<cells:array<{normalize.AI_CELL}>>>>>"))).alias("pages"))
    return normalize.document_ai(_items(spark, d).select("page_id", doc.alias("document")))


AI = f"{ITEMS}, w AS (SELECT page_id, i, lpad(right(CAST(page_id AS VARCHAR), 2), 4, '0') AS text, l_discount, l_tax FROM i)"


@query(f"""WITH {AI} SELECT page_id, CAST(i // 3 AS INTEGER) AS line, CAST(i % 3 AS INTEGER) AS pos, text, round(l_discount * 612, 4) AS x0, round(l_tax * 792, 4) AS y0, round((l_discount + 0.1) * 612, 4) AS x1, round((l_tax + 0.02) * 792, 4) AS y1, round(l_discount * 10, 6) AS confidence FROM w""")
def document_ai_words(spark, d):
    lines = unfold(_document_ai(spark, d), ["page_id"], F.col("data.blocks")[0]["lines"], "l")
    w = lines.select("page_id", F.col("l.order").alias("line"), F.explode("l.words").alias("w"))
    box = lambda k: F.round(F.col("w.bbox")[k], 4)
    return w.select("page_id", "line", F.col("w.order").alias("pos"), "w.text", box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"), r6("w.confidence").alias("confidence"))


@query(f"""WITH {AI} SELECT page_id, CAST(i // 3 AS INTEGER) AS line_index, CAST(i % 3 AS INTEGER) AS word_in_line, CAST(c - 1 AS INTEGER) AS char_pos, text[c] AS char, round(l_discount * 612 + (c - 1) * 61.2 / 4, 4) AS x0, round(l_discount * 10, 6) AS confidence FROM (SELECT *, unnest(range(1, 5)) AS c FROM w)""")
def overlay_chars(spark, d):
    got = page_chars(_document_ai(spark, d).select("page_id", "data"))
    return got.select("page_id", "line_index", "word_in_line", "char_pos", "char", F.round(F.col("bbox")[0], 4).alias("x0"), r6("confidence").alias("confidence"))


@query(f"""WITH {AI}, o AS (SELECT DISTINCT page_id, page_id % 7 AS run_id FROM w) SELECT run_id, count(*) AS pages, (SELECT count(*) * 4 FROM w WHERE w.page_id % 7 = o.run_id)::BIGINT AS characters, round((run_id + 1)::DOUBLE / count(*), 9) AS seconds_a_page FROM o GROUP BY run_id""")
def run_totals(spark, d):
    pages = _document_ai(spark, d).select((F.col("page_id") % 7).alias("run_id"), "data")
    seconds = spark.range(7).select(F.col("id").alias("run_id"), (F.col("id") + 1).cast("double").alias("seconds"))
    return scoring.run_totals(pages, seconds).select("run_id", "pages", "characters", F.round("seconds_a_page", 9).alias("seconds_a_page"))


def _textract(spark, d):
    """A page of one line for each item (two words) and, for every third order, a table of one cell for each item."""
    s = lambda c: c.cast("string")

    def block(id_, kind, text_, conf, box, ids, row=None, col=None):
        geometry = F.struct(F.struct(*(b.cast("double").alias(n) for b, n in zip(box, ("Left", "Top", "Width", "Height"), strict=True))).alias("BoundingBox"), F.array().cast("array<struct<X:double,Y:double>>").alias("Polygon"))
        links = F.array(F.struct(F.lit("CHILD").alias("Type"), ids.alias("Ids"))) if ids is not None else F.array().cast("array<struct<Type:string,Ids:array<string>>>")
        num = lambda v: F.lit(None).cast("int") if v is None else v.cast("int")
        return F.struct(
            s(id_).alias("Id"), F.lit(kind).alias("BlockType"), text_.cast("string").alias("Text"), conf.cast("double").alias("Confidence"), F.lit(1).alias("Page"), geometry.alias("Geometry"), links.alias("Relationships"), num(row).alias("RowIndex"), num(col).alias("ColumnIndex"),
            F.lit(None).cast("int").alias("RowSpan"), F.lit(None).cast("int").alias("ColumnSpan"), F.array().cast("array<string>").alias("EntityTypes"), F.lit(None).cast("string").alias("SelectionStatus"), F.lit(None).cast("double").alias("Width"), F.lit(None).cast("double").alias("Height"),
        )

    none = F.lit(None)
    place = lambda x: (x["l_discount"], x["l_tax"], F.lit(0.1), F.lit(0.02))
    zero = [F.lit(0.0)] * 4
    at = lambda p, i: F.concat(F.lit(p), s(i))
    n = F.sequence(F.lit(0), F.size("items") - 1)
    lines = F.transform("items", lambda x, i: block(at("L", i), "LINE", at("line ", i), x["l_quantity"], place(x), F.array(at("A", i), at("B", i))))
    words = F.flatten(F.transform("items", lambda x, i: F.array(block(at("A", i), "WORD", at("a", i), x["l_quantity"], place(x), None), block(at("B", i), "WORD", at("b", i), x["l_quantity"], place(x), None))))
    cells = F.transform("items", lambda x, i: block(at("C", i), "CELL", at("c", i), x["l_quantity"], place(x), None, i + 1, F.lit(1)))
    has = F.col("page_id") % 3 == 0
    table = F.when(has, F.array(block(F.lit("T"), "TABLE", none, F.lit(90.0), zero, F.transform(n, lambda i: at("C", i))))).otherwise(F.array().cast(f"array<{normalize.TX}>"))
    top = F.concat(F.transform(n, lambda i: at("L", i)), F.when(has, F.array(F.lit("T"))).otherwise(F.array().cast("array<string>")))
    page = F.array(block(F.lit("P"), "PAGE", none, F.lit(100.0), zero, top))
    kind = f"array<{normalize.TX}>"
    blocks = F.concat(page.cast(kind), lines.cast(kind), words.cast(kind), F.when(has, cells.cast(kind)).otherwise(F.array().cast(kind)), table.cast(kind))
    return _items(spark, d).select(F.col("page_id").alias("doc_id"), blocks.alias("blocks"))


@query(f"""WITH {ITEMS}, b AS (SELECT page_id, i AS o, 'text' AS type, 'line ' || i AS text, 'a' || i || ' b' || i AS words, round(l_discount * 612, 4) AS x0, round(l_tax * 792, 4) AS y0, round(l_quantity / 100, 6) AS confidence FROM i
UNION ALL SELECT page_id, count(*), 'table', NULL, NULL, 0, 0, 0.9 FROM i WHERE page_id % 3 = 0 GROUP BY page_id) SELECT page_id AS doc_id, CAST(o AS INTEGER) AS block, type, text, words, x0, y0, confidence FROM b""")
def textract_blocks(spark, d):
    b = unfold(normalize.textract(_textract(spark, d)), ["doc_id"], F.col("data.blocks"), "b")
    line = F.col("b.lines")[0]
    return b.select("doc_id", F.col("b.order").alias("block"), "b.type", line["text"].alias("text"), F.array_join(F.transform(line["words"], lambda w: w["text"]), " ").alias("words"), F.round(F.col("b.bbox")[0], 4).alias("x0"), F.round(F.col("b.bbox")[1], 4).alias("y0"), r6("b.confidence").alias("confidence"))


@query(f"""WITH {ITEMS} SELECT page_id AS doc_id, CAST(1 AS INTEGER) AS pages, CAST(count(*) AS INTEGER) AS num_rows, CAST(1 AS INTEGER) AS num_cols, string_agg('c' || i, ' ' ORDER BY i) AS cells FROM i WHERE page_id % 3 = 0 GROUP BY page_id""")
def textract_tables(spark, d):
    raw = _textract(spark, d).withColumn("pages", normalize.textract_pages(F.col("blocks")))
    t = unfold(normalize.textract(raw, keep=("pages",)), ["doc_id", "pages"], F.col("data.tables"), "t")
    return t.select("doc_id", "pages", F.col("t.num_rows").alias("num_rows"), F.col("t.num_cols").alias("num_cols"), F.array_join(F.transform("t.cells", lambda c: c["text"]), " ").alias("cells"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
i AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l),
c AS (SELECT doc_id, count(DISTINCT g) AS blocks, count(*) AS lines FROM i WHERE trim(line) <> '' GROUP BY doc_id)
SELECT doc_id, CAST(doc_id % 5 + 1 AS INTEGER) AS page_number, CAST(coalesce(blocks, 0) AS INTEGER) AS blocks, coalesce(lines, 0)::BIGINT AS lines, round(79.2 / blocks, 6) AS y0 FROM documents LEFT JOIN c USING (doc_id)""")
def vlm_markdown_pages(spark, d):
    pages = read_table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5 + 1).alias("page_number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.col("text").alias("raw_text"))
    got = normalize.vlm(pages, "doc_id", "page_number")
    b = F.col("data.blocks")
    lines = F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + F.size(x["lines"]))
    return got.select("doc_id", "data.page_number", F.size(b).alias("blocks"), lines.alias("lines"), F.when(F.size(b) > 0, r6(b[0]["bbox"][1])).alias("y0"))


@query(f"""WITH {ITEMS} SELECT page_id, CAST(page_id % 4 + 1 AS INTEGER) AS page_number, CAST(CASE WHEN page_id % 6 = 0 THEN 1 ELSE count(*) END AS INTEGER) AS blocks, CASE WHEN page_id % 6 = 0 THEN 'plain ' || page_id ELSE string_agg('item ' || i, ' ' ORDER BY i) END AS text,
round(CASE WHEN page_id % 6 = 0 THEN 1 ELSE avg(CASE WHEN l_discount = 0 THEN 1 ELSE l_discount END) END, 6) AS confidence FROM i GROUP BY page_id""")
def vlm_json_pages(spark, d):
    """Lists of items; every sixth page isn't JSON and is read as markdown."""
    item = F.transform("items", lambda x, i: F.struct(F.concat(F.lit("item "), i.cast("string")).alias("text"), x["l_discount"].alias("confidence")))
    raw = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("plain "), F.col("page_id").cast("string"))).otherwise(F.to_json(item))
    pages = _items(spark, d).select("page_id", (F.col("page_id") % 4 + 1).alias("page_number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), raw.alias("raw_text"))
    got = normalize.vlm(pages, "page_id", "page_number", form="json")
    b = F.col("data.blocks")
    words = F.array_join(F.transform(page_word_list(F.col("data")), lambda w: w["text"]), " ")
    return got.select("page_id", "data.page_number", F.size(b).alias("blocks"), words.alias("text"), r6(normalize.mean_confidence(b)).alias("confidence"))


def _mock(spark, d):
    box = lambda x: F.struct(x["l_quantity"].alias("x0"), (x["l_discount"] * 700).alias("y0"), (x["l_quantity"] + 20 - F.when(x["l_tax"] > 0.06, 30).otherwise(0)).cast("double").alias("x1"), (x["l_discount"] * 700 + 12).alias("y1"))
    word = lambda x: F.struct(x["l_returnflag"].alias("text"), box(x).alias("bbox"), (x["l_discount"] * 10).alias("confidence"))
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(612.0).alias("x1"), F.lit(792.0).alias("y1"))
    line = F.struct(F.array_join(each(lambda x: x["l_returnflag"]), " ").alias("text"), whole.alias("bbox"), F.lit(0.9).alias("confidence"), each(word).alias("words"))
    block = F.struct(F.lit("text").alias("type"), whole.alias("bbox"), F.lit(0.9).alias("confidence"), F.array(line).alias("lines"))
    raw = F.struct((F.col("page_id") % 3).cast("int").alias("page_number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.array(block).alias("blocks"))
    return normalize.mock(_items(spark, d).select("page_id", raw.alias("raw"))).select("page_id", "data")


@query(f"""WITH {ITEMS} SELECT page_id, concat_ws(',', CASE WHEN page_id % 3 < 1 THEN 'page_number' END, CASE WHEN bool_or(l_tax > 0.06) THEN 'word' END) AS violations FROM i GROUP BY page_id HAVING page_id % 3 < 1 OR bool_or(l_tax > 0.06)""")
def page_violations(spark, d):
    return validate_pages(_mock(spark, d)).select("page_id", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {ITEMS} SELECT page_id, string_agg(l_returnflag, ' ' ORDER BY i) AS text, count(*) AS words FROM i WHERE l_discount * 10 >= 0.5 GROUP BY page_id""")
def confident_words(spark, d):
    """Words split from the page by a condition; lines and blocks that this empties go."""
    got = _mock(spark, d).select("page_id", text.split_words(F.col("data.blocks"), lambda w: w["confidence"] >= 0.5).alias("b")).where(F.size("b") > 0)
    words = F.flatten(F.transform("b", lambda b: F.flatten(F.transform(b["lines"], lambda l: l["words"]))))
    return got.select("page_id", F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.size(words).cast("long").alias("words"))


# Run pages against truth. A dropped or repeated word leaves one best alignment, so counts have a closed form.


def _run_pages(spark, d):
    p = passages(spark, d).select((F.col("doc_id") / 4).cast("long").alias("doc_id"), (F.col("doc_id") % 4 + 1).alias("page_number"), F.split("ref", " ").alias("words"))
    made = F.array(*(F.struct(F.lit(n).alias("run_id"), w.alias("words")) for n, w in (("dropped", engines.dropped(F.col("words"))), ("repeated", engines.repeated(F.col("words"))), ("misread", F.transform("words", engines.misread)))))
    # The run "dropped" lacks every document's second page.
    pages = p.select("doc_id", "page_number", F.inline(made)).where("NOT (run_id = 'dropped' AND page_number = 2)")
    return pages, p


PAGES = f"""{PASSAGES}, w AS (SELECT doc_id AS item, CAST(doc_id // 4 AS BIGINT) AS doc_id, CAST(doc_id % 4 + 1 AS BIGINT) AS page_number, ref, unnest(string_split(ref, ' ')) AS e, unnest(range(1, len(string_split(ref, ' ')) + 1)) AS i FROM p),
c AS (SELECT doc_id, page_number, any_value(ref) AS ref, count(*) AS n, length(any_value(ref)) AS chars, count_if(i % 7 = 0) AS gone, count_if(i % 9 = 0) AS twice, count_if(e <> translate(e, 'ol', '01')) AS wrong,
coalesce(sum(length(e) + 1) FILTER (i % 7 = 0), 0) - CASE WHEN count(*) = count_if(i % 7 = 0) THEN 1 ELSE 0 END AS less, coalesce(sum(length(e) + 1) FILTER (i % 9 = 0), 0) AS more, length(any_value(ref)) - length(replace(replace(any_value(ref), 'o', ''), 'l', '')) AS bad FROM w GROUP BY item, doc_id, page_number),
s AS (SELECT doc_id, page_number, unnest(['dropped', 'repeated', 'misread']) AS run_id, chars AS ref_chars, n AS ref_words, unnest([chars - less, chars, chars - bad]) AS char_matches, unnest([0, 0, bad]) AS char_substitutions, unnest([0, more, 0]) AS char_insertions, unnest([less, 0, 0]) AS char_deletions,
unnest([n - gone, n, n - wrong]) AS word_matches, unnest([0, 0, wrong]) AS word_substitutions, unnest([0, twice, 0]) AS word_insertions, unnest([gone, 0, 0]) AS word_deletions FROM c),
z AS (SELECT *, (char_substitutions + char_insertions + char_deletions) / ref_chars AS cer, (word_substitutions + word_insertions + word_deletions) / ref_words AS wer, char_matches / (char_matches + char_substitutions + char_insertions) AS cp, char_matches / (char_matches + char_substitutions + char_deletions) AS cr FROM s WHERE NOT (run_id = 'dropped' AND page_number = 2))"""
COUNTED = [f"{k}_{c}" for k in ("char", "word") for c in scoring.COUNTS]


@query(f"WITH {PAGES} SELECT run_id, doc_id, page_number, ref_chars, ref_words, {', '.join(f'{c}::BIGINT AS {c}' for c in COUNTED)}, round(cer, 6) AS cer, round(wer, 6) AS wer, round(2 * cp * cr / (cp + cr), 6) AS f1 FROM z")
def page_scores(spark, d):
    got = scoring.page_scores(*_run_pages(spark, d))
    return got.select("run_id", "doc_id", "page_number", "ref_chars", "ref_words", *COUNTED, r6("cer").alias("cer"), r6("wer").alias("wer"), r6("char_f1").alias("f1"))


@query(f"WITH {PAGES} SELECT run_id, count(*) AS pages, round(sum(cer * ref_chars) / sum(ref_chars), 6) AS cer, round(sum(wer * ref_words) / sum(ref_words), 6) AS wer, round(sum(cp * ref_chars) / sum(ref_chars), 6) AS char_precision, round(sum(cr * ref_chars) / sum(ref_chars), 6) AS char_recall, sum(ref_chars)::BIGINT AS ref_chars, sum(ref_words)::BIGINT AS ref_words FROM z GROUP BY run_id")
def run_page_scores(spark, d):
    got = scoring.run_scores(scoring.page_scores(*_run_pages(spark, d)))
    return got.select("run_id", "pages", *(r6(c).alias(c) for c in ("cer", "wer", "char_precision", "char_recall")), "ref_chars", "ref_words")


@query(f"""WITH {PAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id, doc_id ORDER BY page_number) AS k FROM z), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS k FROM c)
SELECT o.run_id, o.doc_id, o.page_number, t.chars AS ref_chars, t.n AS ref_words, (o.char_matches + o.char_substitutions + o.char_insertions)::BIGINT AS hyp_chars, (o.word_matches + o.word_substitutions + o.word_insertions)::BIGINT AS hyp_words FROM o JOIN t USING (doc_id, k)""")
def page_scores_by_position(spark, d):
    """The n-th page of a run's document against the n-th true one; a missing page shifts the rest."""
    pages, truth = _run_pages(spark, d)
    pages = pages.withColumn("run_id", F.concat_ws(":", "run_id", F.col("doc_id").cast("string")))
    got = scoring.page_scores(pages, truth, by="position")
    return got.select(F.split("run_id", ":")[0].alias("run_id"), "doc_id", "page_number", "ref_chars", "ref_words", "hyp_chars", "hyp_words")


@query(f"WITH {PAGES} SELECT run_id, doc_id, page_number, round(char_matches / greatest(ref_chars, char_matches + char_substitutions + char_insertions, 1), 6) AS accuracy FROM z")
def cjk_scores(spark, d):
    got = scoring.cjk_accuracy(scoring.page_scores(*_run_pages(spark, d)))
    return got.select("run_id", "doc_id", "page_number", r6("cjk_char_accuracy").alias("accuracy"))


@query(f"WITH {PAGES} SELECT doc_id, page_number, round(cer, 6) AS cer, round(cp, 6) AS char_precision, round(cr, 6) AS char_recall, CASE WHEN ref_words > 1 THEN CAST(page_number % 2 AS DOUBLE) ELSE 0 END AS rtl_penalty FROM z WHERE run_id = 'misread'")
def arabic_scores(spark, d):
    """Words of odd pages stand from left to right, those of even ones from right to left."""
    _, p = _run_pages(spark, d)
    pairs = p.select("doc_id", "page_number", F.col("words").alias("ref"), F.transform("words", engines.misread).alias("hyp"))
    boxes = p.select("doc_id", "page_number", F.posexplode("words").alias("word_pos", "w")).withColumn("x", F.col("word_pos") * F.when(F.col("page_number") % 2 == 1, 50.0).otherwise(-50.0))
    got = text.arabic_metrics(pairs, boxes.select("doc_id", "page_number", "word_pos", F.array("x", F.lit(0.0), F.col("x") + 40, F.lit(12.0)).alias("bbox")), "doc_id", "page_number")
    return got.select("doc_id", "page_number", *(r6(c).alias(c) for c in ("cer", "char_precision", "char_recall")), "rtl_penalty")


def _worded(c, confidence=0.9):
    return F.transform(c, lambda w: F.struct(w.alias("text"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(confidence).alias("confidence")))


@query(f"""WITH {PAGES} SELECT doc_id, page_number, round(cer, 6) AS cer, round(wer, 6) AS wer, round(word_insertions / (ref_words + word_insertions), 6) AS imagination, round((ref_words * 0.01 + word_insertions * 0.81) / (ref_words + word_insertions), 6) AS calibration, round(-0.001, 6)::DOUBLE AS noise FROM z WHERE run_id = 'repeated'""")
def combined_metrics(spark, d):
    _, p = _run_pages(spark, d)
    pairs = p.select("doc_id", "page_number", _worded(F.col("words")).alias("ref"), _worded(engines.repeated(F.col("words"))).alias("hyp"))
    noise = p.select("doc_id", "page_number", F.explode(F.array(F.lit(100.0), F.lit(200.0), F.lit(300.0))).alias("dpi")).withColumn("cer", 0.4 - F.col("dpi") / 1000)
    return scoring.combined(pairs, "doc_id", "page_number", noise=noise).select("doc_id", "page_number", *(r6(c).alias(c) for c in ("cer", "wer", "imagination", "calibration", "noise")))


@query("""SELECT unnest(['a perfect reading invents nothing', 'a perfect reading is calibrated', 'invented words raise imagination', 'invented words raise cer', 'overconfidence raises calibration error']) AS "check", true AS passed""")
def metric_scenarios(spark, d):
    return scoring.scenario_checks(spark)


@query(f"""WITH {PAGES}, t AS (SELECT doc_id, page_number, i - 1 AS position, e FROM w), o AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY i) - 1 AS position, e FROM w WHERE i % 7 <> 0 AND page_number <> 2 UNION ALL SELECT doc_id, page_number, i - 1, unnest([e, 'extra']) FROM w WHERE page_number = 2 AND i = 1)
SELECT doc_id, page_number, CAST(position AS INTEGER) AS position, CASE WHEN o.e IS NULL THEN 'missing' WHEN t.e IS NULL THEN 'extra' WHEN o.e = t.e THEN 'correct' ELSE 'wrong' END AS status, coalesce(t.e, o.e) AS text, CASE WHEN t.e IS NULL OR o.e <> t.e THEN o.e END AS engine_text, CASE WHEN o.e IS NULL THEN 0 ELSE 0.7 END::DOUBLE AS confidence
FROM t FULL JOIN (SELECT doc_id, page_number, CASE WHEN page_number = 2 THEN row_number() OVER (PARTITION BY doc_id, page_number) - 1 ELSE position END AS position, e FROM o WHERE page_number <> 2 UNION ALL SELECT doc_id, page_number, 0, e FROM w WHERE page_number = 2 AND i = 1 UNION ALL SELECT doc_id, page_number, 100000, 'extra' FROM w WHERE page_number = 2 AND i = 1 AND false) o USING (doc_id, page_number, position)""")
def word_status(spark, d):
    """Second pages were read as their first word alone; elsewhere every seventh word is dropped, so that the rest moves up."""
    _, p = _run_pages(spark, d)
    read = F.when(F.col("page_number") == 2, F.slice("words", 1, 1)).otherwise(engines.dropped(F.col("words")))
    got = scoring.word_status(p.select("doc_id", "page_number", _worded(read, 0.7).alias("words")), p.select("doc_id", "page_number", _worded(F.col("words")).alias("words")), "doc_id", "page_number")
    return got.select("doc_id", "page_number", "position", "status", "text", "engine_text", "confidence")


@query(f"""WITH {PAGES} SELECT doc_id, page_number, CAST(2 * (n - 5) AS DOUBLE) AS score, 3 AS ref_start, CAST(n - 2 AS INTEGER) AS ref_end, 1 AS hyp_start, CAST(n - 4 AS INTEGER) AS hyp_end, CAST(n - 5 AS INTEGER) AS matches FROM c WHERE n > 8""")
def local_matches(spark, d):
    """A passage without its first three and last two words, between foreign ones, is found in the whole."""
    _, p = _run_pages(spark, d)
    part = F.concat(F.array(F.lit("▁x")), F.slice("words", F.lit(4), F.size("words") - 5), F.array(F.lit("▁y"), F.lit("▁z")))
    return scoring.local_pairs(p.where(F.size("words") > 8).select("doc_id", "page_number", F.col("words").alias("ref"), part.alias("hyp"))).select("doc_id", "page_number", "score", "ref_start", "ref_end", "hyp_start", "hyp_end", "matches")


@query(f"""WITH {GRID}, x AS (SELECT doc_id, avg({ENTROPY}) AS ce, bool_or({MAJORITY} <> {WEIGHTED}) AS flagged, string_agg({WEIGHTED}, ' ' ORDER BY position) AS text FROM g GROUP BY doc_id)
SELECT doc_id, text, round(1 - ce, 6) AS confidence, ce >= 0.2 OR flagged AS needs_review FROM x WHERE ce < 0.4""")
def ground_truth_pages(spark, d):
    g = _grid(spark, d)
    v = consensus.votes(g, "doc_id")
    pages = consensus.page_entropy(consensus.entropies(g, "doc_id"), "doc_id").join(v.groupBy("doc_id").agg(F.bool_or("flag").alias("flagged")), "doc_id").withColumn("engines", F.lit(5))
    got = consensus.ground_truth_pages(v, consensus.route(pages, 0.2, 0.4), "doc_id")
    return got.select("doc_id", F.col("blocks")[0]["lines"][0]["text"].alias("text"), r6("confidence").alias("confidence"), "needs_review")


# States, versions, batches, exports.


@query(f"""WITH {RUNS}, c AS (SELECT *, ['queued', 'completed', 'cancelled', 'running', NULL][run_id % 5 + 1] AS wish FROM runs)
SELECT run_id, CASE WHEN status = 'running' AND wish IN ('completed', 'failed', 'cancelled') THEN wish ELSE status END AS status FROM c""")
def run_transitions(spark, d):
    r = _runs(spark, d).select("run_id", "status")
    wish = F.element_at(F.array(*(F.lit(x) for x in ("queued", "completed", "cancelled", "running", None))), (F.col("run_id") % 5 + 1).cast("int"))
    return catalog.transition(r, r.select("run_id", wish.alias("status")).where("status IS NOT NULL"))


@query(f"""WITH {VERSIONS} SELECT pdf_id, version_number, version_id, gone OR version_number = 2 AS deleted FROM v""")
def soft_deleted_versions(spark, d):
    got = catalog.soft_delete(_versions(spark, d), F.col("version_number") == 2, F.lit("2030-01-01").cast("timestamp"))
    return got.select("pdf_id", "version_number", "version_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query(f"WITH {RUNS} SELECT run_id, l_linenumber AS page_number FROM lineitem JOIN runs ON l_orderkey = run_id WHERE status <> 'failed'")
def remaining_pages(spark, d):
    """Pages left when failed runs are deleted for good."""
    r = _runs(spark, d)
    pages = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("page_number"))
    return catalog.remove_runs(pages, r.where("status = 'failed'"))


@query("SELECT p_partkey AS slug, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE 'old' END AS name FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 3 = 0")
def engine_upsert(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("slug"))
    return catalog.upsert(p.where("slug % 4 = 0").withColumn("name", F.lit("new")), p.where("slug % 3 = 0").withColumn("name", F.lit("old")), "slug")


@query("SELECT 'b1' AS batch_id, c_custkey AS pdf_id, o_orderpriority AS engine_id, 'pending' AS status FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)")
def batch_items(spark, d):
    return catalog.batch_items("b1", read_table(spark, d, "customer").select(F.col("c_custkey").alias("pdf_id")), _runs(spark, d).select("engine_id").distinct())


@query("""SELECT p_partkey, unnest(['dpi', 'lang', 'mode']) AS key, unnest([CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '300' END, 'eng', CASE WHEN p_size > 25 THEN p_brand ELSE 'fast' END]) AS value FROM part""")
def merged_configs(spark, d):
    defaults = F.create_map(F.lit("dpi"), F.lit("300"), F.lit("lang"), F.lit("eng"), F.lit("mode"), F.lit("fast"))
    user = F.when(F.col("p_size") > 25, F.create_map(F.lit("dpi"), F.col("p_size").cast("string"), F.lit("mode"), F.col("p_brand")))
    return read_table(spark, d, "part").select("p_partkey", F.explode(catalog.merge_config(defaults, user)))


@query(f"""WITH {RUNS} SELECT run_id, 0 AS position, 'INFO' AS level, 'created' AS message FROM runs UNION ALL SELECT run_id, 1, 'ERROR', 'failed ' || engine_id FROM runs WHERE status = 'failed'""")
def run_logs(spark, d):
    first = F.array(F.struct(F.col("completed_at").alias("timestamp"), F.lit("INFO").alias("level"), F.lit("created").alias("message")))
    r = _runs(spark, d).withColumn("logs", first)
    got = catalog.logs(catalog.append_log(r, F.col("status") == "failed", F.col("completed_at"), "ERROR", F.concat(F.lit("failed "), "engine_id")))
    return got.select("run_id", "position", "level", "message")


@query("""WITH v AS (SELECT DISTINCT l_partkey % 50 AS version_id, l_linenumber AS page_number FROM lineitem), n AS (SELECT 'next' AS version_id, page_number, CASE WHEN page_number = 2 THEN 'new' ELSE 'page ' || page_number END AS data FROM v WHERE version_id = 7)
SELECT * FROM n""")
def replaced_page(spark, d):
    """A version's pages once one was replaced: the others are copied."""
    v = read_table(spark, d, "lineitem").select((F.col("l_partkey") % 50).cast("string").alias("version_id"), F.col("l_linenumber").alias("page_number")).distinct()
    return catalog.replace_page(v.withColumn("data", F.concat(F.lit("page "), F.col("page_number").cast("string"))), "7", "next", 2, F.lit("new")).select("version_id", "page_number", "data")


@query(f"""WITH {VERSIONS}, t AS (SELECT DISTINCT pdf_id, version_number, gone FROM v WHERE pdf_id % 10 = 1) SELECT pdf_id, CAST(CASE WHEN pdf_id = (SELECT min(pdf_id) FROM t) AND version_number = 1 AND NOT gone THEN (SELECT max(version_number) + 1 FROM t x WHERE x.pdf_id = t.pdf_id) ELSE version_number END AS INTEGER) AS version_number, gone FROM t""")
def promoted_versions(spark, d):
    v = _versions(spark, d).where("pdf_id % 10 = 1").select("pdf_id", "version_number", F.concat_ws(":", "pdf_id", "version_number").alias("version_id"), F.col("deleted_at").isNotNull().alias("gone")).distinct()
    v = v.withColumn("deleted_at", F.when(F.col("gone"), F.lit("2024-01-01").cast("timestamp")))
    low = v.agg(F.min("pdf_id")).first()[0]
    return catalog.promote(v, f"{low}:1").select("pdf_id", "version_number", "gone")


@query(f"""WITH {GRID} SELECT doc_id, string_agg(CASE WHEN position = 1 THEN 'edited' ELSE {WEIGHTED} END, ' ' ORDER BY position) AS text FROM g GROUP BY doc_id""")
def edited_words(spark, d):
    made = consensus.consensus_pages(consensus.votes(_grid(spark, d), "doc_id"), "doc_id")
    data = catalog.edit_word(F.struct("blocks"), 1, "edited")
    return made.select("doc_id", data["blocks"][0]["lines"][0]["text"].alias("text"))


@query(f"WITH {METRICS} SELECT run_id, engine_id, round(cer, 6) AS cer, round(f1, 6) AS f1 FROM m WHERE status = 'completed'")
def json_export(spark, d):
    rows = reports.json_rows(_metrics(spark, d).where("status = 'completed'"))
    return rows.select(F.from_json("value", "run_id long, engine_id string, cer double, f1 double").alias("j")).select("j.run_id", "j.engine_id", r6("j.cer").alias("cer"), r6("j.f1").alias("f1"))


@query(f"""WITH {METRICS}, h AS (SELECT (SELECT count(*) FROM customer) AS pdfs, count(*) AS runs, count_if(status = 'completed') AS done, round(avg(cer), 4) AS cer FROM m) SELECT (SELECT count(DISTINCT engine_id) FROM m WHERE status = 'completed')::BIGINT AS engines, CAST(pdfs AS VARCHAR) AS pdfs, CAST(runs AS VARCHAR) AS runs, CAST(done AS VARCHAR) AS completed, printf('%.4f', cer) AS cer FROM h""")
def html_report(spark, d):
    """The report's cards and rows, read back from the page."""
    from .queries import _engines

    pdfs = read_table(spark, d, "customer").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    pages = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    m, e = _metrics(spark, d), _engines(spark, d)
    page = reports.html_page(reports.summary(pdfs, m, pages, e).first().asDict(), [r.asDict() for r in reports.rankings(m, e).drop("engine_id").collect()])
    p = spark.createDataFrame([(page,)], "p string")
    card = lambda n: F.regexp_extract("p", f"<b>([^<]*)</b><span>{n}</span>", 1)
    return p.select((F.regexp_count("p", F.lit("<tr>")) - 1).cast("long").alias("engines"), card("total pdfs").alias("pdfs"), card("total runs").alias("runs"), card("completed runs").alias("completed"), card("avg cer").alias("cer"))


@query(f"WITH {RUNS}, c AS (SELECT * FROM runs WHERE status = 'completed') SELECT run_id, (SELECT count(*) FROM c)::BIGINT AS total FROM c ORDER BY run_id OFFSET 20 LIMIT 10")
def page_with_total(spark, d):
    rows, total = catalog.page_of_rows(_runs(spark, d).where("status = 'completed'").select("run_id"), F.col("run_id"), page=3, size=10)
    return rows.withColumn("total", F.lit(total).cast("long"))


@query(f"""WITH {LATEST}, k AS (SELECT pdf_id, engine_id, row_number() OVER (PARTITION BY pdf_id ORDER BY run_id) AS n, run_id FROM latest) SELECT pdf_id, engine_id, CAST(run_id AS VARCHAR) AS run_id FROM k WHERE pdf_id = (SELECT min(pdf_id) FROM k WHERE n = 2) AND n <= 5""")
def comparable_runs(spark, d):
    """Completed runs of one document that pass the checks of a comparison."""
    import uuid

    latest = catalog.latest_runs(_runs(spark, d))
    first = latest.groupBy("pdf_id").count().where("count > 1").agg(F.min("pdf_id")).first()[0]
    name = lambda c: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(c.cast("string"), 12, "0"))
    runs = latest.withColumn("run_id", name(F.col("run_id"))).withColumn("pdf_id", F.col("pdf_id").cast("string"))
    ids = [r[0] for r in runs.where(F.col("pdf_id") == str(first)).orderBy("run_id").limit(5).select("run_id").collect()]
    ok = catalog.check_comparison(ids, runs, str(first))
    return runs.where(F.col("run_id").isin([str(uuid.UUID(x)) for x in ok])).select(F.col("pdf_id").cast("long").alias("pdf_id"), "engine_id", F.regexp_replace("run_id", "^[0-]*", "").alias("run_id"))


# Layout by columns, agreement by line, windows of time.


@query("""SELECT l_orderkey AS page_id, l_linenumber AS line, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS agreement, CASE WHEN bool_and(l_returnflag = 'N') THEN 'full' WHEN avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'partial' ELSE 'none' END AS level, round(min(l_quantity), 4) AS x0, round(max(l_quantity + 20), 4) AS x1 FROM lineitem GROUP BY ALL""")
def line_agreement(spark, d):
    l = read_table(spark, d, "lineitem")
    words = l.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "N").alias("agrees"), F.array("l_quantity", F.lit(0.0), F.col("l_quantity") + 20, F.lit(12.0)).alias("bbox"))
    return layout.line_agreement(words, "page_id").select("page_id", "line", r6("agreement").alias("agreement"), "level", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"))


@query(f"""WITH {ITEMS} SELECT page_id, CAST(i AS INTEGER) AS item, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_extendedprice, i) - 1 AS INTEGER) AS "order" FROM i""")
def column_reading_order(spark, d):
    b = _items(spark, d).select("page_id", F.posexplode("items").alias("item", "x"))
    blocks = b.select("page_id", "item", F.when(F.col("x.l_returnflag") == "N", 0).otherwise(1).alias("column"), F.array(F.col("item").cast("double"), F.col("x.l_extendedprice")).alias("bbox"))
    return layout.reading_order(blocks, "page_id").select("page_id", "item", "order")


@query("""WITH e AS (SELECT event_type AS type, user_id, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS start FROM events) SELECT start, type, count(*) AS n FROM e GROUP BY ALL""")
def sliding_windows(spark, d):
    return events.windowed(_events(read_table(spark, d, "events")), "10 minutes", "5 minutes").select("start", "type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT CAST(user_id AS VARCHAR) AS run_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return events.sessions(_events(read_table(spark, d, "events"))).select("run_id", "start", "n")


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def conversation_turns(spark, d):
    c = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join(F.transform("t", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT page_id, html LIKE '%<table%' AS tables, length(html) AS chars, CASE WHEN length(html) < 500 THEN 'short' WHEN length(html) < 3000 THEN 'middle' ELSE 'long' END AS band FROM pages")
def page_bands(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", F.contains("html", F.lit("<table")).alias("tables"), F.length("html").cast("long").alias("chars"), native.band(F.length("html"), (500, 3000), ("short", "middle", "long")).alias("band"))
