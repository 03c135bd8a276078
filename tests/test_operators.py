import datetime as dt

import pytest
from pyspark.sql import functions as F
from pytest import approx

from pageloom.functions import native
from pageloom.operators import bootstrap, catalog, consensus, layout, reports, scoring, text
from pageloom.schema import PAGE, page_text, validate_pages
from pageloom.sources import engines, files, normalize
from pageloom.streaming import events


def one(df):
    return df.first().asDict()


def test_page_and_run_scores(spark):
    p = spark.createDataFrame([("r", "d", 1, ["abc"]), ("r", "d", 3, ["same", "text"]), ("r", "d", 4, [])], "run_id string, doc_id string, page_number int, words array<string>")
    t = spark.createDataFrame([("d", 1, ["abd"]), ("d", 3, ["same", "text"]), ("d", 5, ["x"])], "doc_id string, page_number int, words array<string>")
    got = {r["page_number"]: r for r in scoring.page_scores(p, t).collect()}
    assert set(got) == {1, 3}
    assert got[1]["cer"] == approx(1 / 3) and got[1]["char_precision"] == approx(2 / 3) and got[1]["wer"] == 1
    assert got[3]["cer"] == 0 and got[3]["char_f1"] == 1
    run = one(scoring.run_scores(scoring.page_scores(p, t)))
    assert run["cer"] == approx(1 / 12) and run["wer"] == approx(1 / 3)
    by_place = {r["page_number"]: r["cer"] for r in scoring.page_scores(p, t, by="position").collect()}
    assert set(by_place) == {1, 3, 4} and by_place[4] == 1.0


def test_empty_references(spark):
    rows = spark.createDataFrame([(1, None, ["x"]), (2, [], []), (3, ["x"], None)], "k int, ref array<string>, hyp array<string>")
    got = {r["k"]: r for r in scoring.with_metrics(scoring.pair_counts(rows)).collect()}
    assert got[1]["cer"] == 0 and got[1]["char_insertions"] == 1
    assert got[2]["cer"] == 0 and got[3]["cer"] == 1
    c = one(spark.range(1).select(*(native.cer_levenshtein(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("a", "", ""), ("b", "", "hi"), ("c", "ab", "abcdef")))))
    assert (c["a"], c["b"], c["c"]) == (0, 1, 2)


def test_word_pairs(spark):
    w = "array<struct<text:string,bbox:array<double>,confidence:double>>"
    rows = spark.createDataFrame([(1, [("world", None, None)], [("w0rld", None, 0.9), ("extra", None, None)])], f"k int, ref {w}, hyp {w}")
    s = one(scoring.pair_stats(scoring.word_pairs(rows), "k"))
    assert (s["n_match"], s["n_insertion"]) == (1, 1) and s["imagination"] == 0.5
    assert s["calibration"] == approx(((0.9 - 1) ** 2 + 0) / 2)


def _readings(spark, *lists):
    w = "array<struct<text:string,confidence:double,bbox:array<double>>>"
    return spark.createDataFrame([("p", f"e{i}", i, [(t, c, None) for t, c in ws]) for i, ws in enumerate(lists)], f"k string, engine string, engine_rank int, words {w}")


def test_votes_and_entropies(spark):
    g = consensus.project(_readings(spark, [("hello", 0.9)], [("world", 0.3)], [("world", 0.95)]), "k")
    v = one(consensus.votes(g, "k"))
    assert (v["majority"], v["weighted"], v["flag"]) == ("world", "world", False) and v["weighted_confidence"] == approx(0.625)
    tie = one(consensus.votes(consensus.project(_readings(spark, [("hello", 0.3)], [("hello", 0.2)], [("world", 0.95)], [("world", 0.9)]), "k"), "k"))
    assert tie["majority"] == tie["weighted"] == tie["mean_tie"] == "world"
    same = consensus.project(_readings(spark, [("a", 1.0)], [("a", 1.0)], [("a", 1.0)]), "k")
    other = consensus.project(_readings(spark, [("a", 1.0)], [("b", 1.0)], [("c", 1.0)]), "k")
    alone = consensus.project(_readings(spark, [("a", 1.0)]), "k")
    assert [one(consensus.entropies(x, "k"))["entropy"] for x in (same, other, alone)] == [0, approx(1), 0]


def test_gaps_and_extras(spark):
    g = consensus.project(_readings(spark, [("a", 1.0), ("b", 1.0)], [("a", 1.0)], [("a", 1.0), ("b", 1.0), ("c", 1.0)]), "k")
    s = {r["engine"]: r.asDict() for r in consensus.engine_stats(consensus.statuses(g, consensus.votes(g, "k"), "k")).collect()}
    assert (s["e1"]["missing"], s["e2"]["extra"], s["e0"]["match"]) == (1, 1, 2)
    e = {r["position"]: r for r in consensus.entropies(g, "k").collect()}
    assert e[1]["entropy"] > 0 and e[1]["entropy_no_gaps"] == 0
    page = one(consensus.consensus_pages(consensus.votes(g, "k"), "k"))
    assert page["blocks"][0]["lines"][0]["text"] == "a b"


@pytest.mark.parametrize(("engines_", "ce", "flag", "decision", "review"), [(0, 0.0, False, "none", True), (1, 0.0, False, "single", True), (3, 0.0, False, "accept", False), (3, 0.0, True, "accept", True), (3, 0.29, False, "accept", False), (3, 0.4, False, "review", True), (3, 0.6, False, "reject", True)])
def test_routing(spark, engines_, ce, flag, decision, review):
    r = one(consensus.route(spark.createDataFrame([(engines_, ce, flag)], "engines int, entropy double, flagged boolean")))
    assert (r["decision"], r["needs_review"]) == (decision, review)


@pytest.mark.parametrize(("t", "script"), [("Hello", "latin"), ("", "latin"), ("!@#", "latin"), ("Привет мир", "cyrillic"), ("漢字", "cjk"), ("مرحبا", "arabic"), ("नमस्ते", "devanagari"), ("สวัสดี", "thai"), ("שלום", "hebrew"), ("αβγ", "greek"), ("ひらがな", "japanese"), ("한국어", "korean"), ("Latin page with one 漢", "cjk")])
def test_scripts(spark, t, script):
    assert one(text.with_script(spark.createDataFrame([(t,)], "text string")))["script"] == script


def test_script_share_of_visible(spark):
    assert one(text.with_script(spark.createDataFrame([("Latin page with one 漢",)], "text string"), denominator="non_whitespace"))["script"] == "latin"


def test_trigrams(spark):
    rows = spark.createDataFrame([(1, "hello world", "hello world"), (2, "abc", "xyz"), (3, "", "abc"), (4, None, None)], "k int, a string, b string")
    got = {r["k"]: r["cosine"] for r in text.trigram_cosine(rows, "a", "b", "k").collect()}
    assert got[1] == approx(1) and got[2] == got[3] == got[4] == 0
    assert one(rows.where("k = 1").select(text.short_trigram_cosine(F.col("a"), F.col("b")).alias("c")))["c"] == approx(1)


def test_handwriting_and_order(spark):
    rows = [(1, 0, 0, [0.0, 0.0, 10.0, 5.0], 0.4), (1, 1, 0, [10.0, 0.0, 20.0, 5.0], 0.9), (1, 2, 0, [20.0, 0.0, 60.0, 5.0], 0.9), (1, 3, 1, [0.0, 9.0, 10.0, 5.0], 0.4), (1, 4, 1, None, 0.2), (1, 5, 1, None, None)]
    df = spark.createDataFrame(rows, "p int, word_pos int, block_index int, bbox array<double>, confidence double")
    got = {r["word_pos"]: r["handwriting"] for r in text.tag_handwriting(df, "p").collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False}
    assert one(text.rtl_penalty(df.where("word_pos < 3"), "p"))["rtl_penalty"] == 1
    assert one(text.rtl_penalty(df.where("word_pos = 5"), "p"))["rtl_penalty"] == 0


def test_bootstrap(spark):
    same = spark.createDataFrame([(i, 0.25) for i in range(10)], "ord int, value double")
    r = one(bootstrap.confidence_interval(same, times=100))
    assert r["lower"] == r["upper"] == r["mean"] == 0.25 and r["std"] == 0
    two = spark.createDataFrame([("a", i, 1.0 + i / 100) for i in range(10)] + [("b", i, i / 100) for i in range(10)], "g string, ord int, value double")
    assert one(bootstrap.compare(two, "g", "a", "b", times=100))["significant"] is True
    alike = bootstrap.compare(two.withColumn("value", F.col("ord") * 0.01), "g", "a", "b", times=100)
    assert one(alike)["difference"] == 0 and one(alike)["significant"] is False


def test_noise_slope(spark):
    s = spark.createDataFrame([(100, 0.3), (200, 0.2), (300, 0.1)], "dpi int, cer double")
    assert one(scoring.noise_slope(s))["slope"] == approx(-0.001)
    assert one(scoring.noise_slope(s.where("dpi = 100")))["slope"] == 0


def test_catalog(spark):
    d = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, "h1", "completed", d), (2, "h1", "failed", d), (3, "h2", "running", d), (4, "h3", "failed", d)], "run_id int, run_hash string, status string, created_at timestamp")
    req = spark.createDataFrame([(i, f"h{i}") for i in range(1, 5)], "request_id int, run_hash string")
    got = {r["request_id"]: (r["action"], r["run_id"]) for r in catalog.classify_requests(req, runs).collect()}
    assert got == {1: ("return", 1), 2: ("conflict", 3), 3: ("create", None), 4: ("create", None)}
    changed = {r["run_id"]: r["status"] for r in catalog.transition(runs, spark.createDataFrame([(3, "completed"), (1, "running")], "run_id int, status string")).collect()}
    assert changed[3] == "completed" and changed[1] == "completed"
    ids = spark.range(5).withColumnRenamed("id", "k")
    first = [r["k"] for r in catalog.page_after(ids, "k", None, 2).collect()]
    assert [r["k"] for r in catalog.page_after(ids, "k", first[-1], 2).collect()] == [2, 3]


def test_versions(spark):
    v = spark.createDataFrame([("a", "p", 1, "manual", None), ("b", "p", 2, "manual", dt.datetime(2024, 1, 1))], "version_id string, pdf_id string, version_number int, source string, deleted_at timestamp")
    assert one(catalog.current_versions(v))["version_id"] == "a"
    assert one(catalog.next_versions(v))["next_version"] == 3
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "version_id string, page_number int, data string")
    v2, p2 = catalog.create_version(v, pages, "p", "manual", catalog.replace_page(pages, "a", "c", 2, F.lit("z")).drop("version_id"), "c")
    assert one(catalog.current_versions(v2))["version_number"] == 3
    assert {r["data"] for r in p2.where("version_id = 'c'").collect()} == {"x", "z"}
    assert one(catalog.current_versions(catalog.promote(v2, "a")))["version_id"] == "a"


def test_edit_word_and_text(spark):
    raw = spark.createDataFrame([(1,)], "doc_id int")
    pages = engines.synthetic_pages(raw)
    assert pages.exceptAll(engines.synthetic_pages(raw)).isEmpty()
    assert validate_pages(pages).isEmpty()
    edited = pages.withColumn("data", catalog.edit_word(F.col("data"), 1, "changed")).select(page_text(F.col("data")).alias("t")).first()["t"]
    assert edited.split(" ")[1] == "changed"
    bad = spark.createDataFrame([(1,)], "k int").select("k", F.from_json(F.lit('{"page_number":0,"width":1,"height":1,"blocks":[{"type":"odd","bbox":[1,1,0,0],"confidence":2,"order":0}]}'), PAGE).alias("data"))
    assert set(one(validate_pages(bad))["violations"]) == {"page_number", "block_type", "block"}


def test_ingest_and_raw(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1 x"), ("b.pdf", b"%PDF-1 x"), ("c.pdf", b"nothing"), ("d.pdf", b"%PDF-1 y")):
        (tmp_path / name).write_bytes(body)
    known = spark.createDataFrame([("0" * 64, None)], "sha256 string, deleted_at timestamp")
    assert catalog.ingest(known, files.read_binary(spark, str(tmp_path))).count() == 2
    raw = spark.createDataFrame([(1, ("x",)), (2, ("x",))], "run_id int, raw struct<t:string>")
    folder = str(tmp_path / "raw")
    for _ in range(2):
        files.write_raw(files.address_raw(raw, "base"), folder)
    assert [r["raw"]["t"] for r in files.read_raw(spark, folder, "struct<t:string>").collect()] == ["x"]


def test_reports(spark, tmp_path):
    runs = spark.createDataFrame([(1, "p", "e", "completed", dt.datetime(2024, 1, 1)), (2, "p", "f", "failed", None)], "run_id int, pdf_id string, engine_id string, status string, completed_at timestamp")
    s = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), 0.0, {"character": {"cer": 0.1, "f1": 0.0}, "word": {"wer": 0.2, "f1": 0.7}})], "run_id int, summary_id int, created_at timestamp, overall_score double, breakdown map<string,map<string,double>>")
    m = reports.run_metrics(runs, s)
    assert one(m.where("run_id = 1"))["f1"] == 0.7
    eng = spark.createDataFrame([("e", "slug-e", "E"), ("f", "slug-f", "F")], "engine_id string, slug string, display_name string")
    assert [r["slug"] for r in reports.rankings(m, eng).collect()] == ["slug-e"]
    pages = spark.createDataFrame([(1, 1), (1, 2)], "run_id int, page_number int")
    assert {r["wer"] for r in reports.csv_rows(m, pages).collect()} == {"0.2000"}
    pdfs = spark.createDataFrame([("p", None)], "pdf_id string, deleted_at timestamp")
    for form in ("csv", "json", "html"):
        reports.export(m, pages, eng, pdfs, str(tmp_path / form), form)
    assert "slug-e" in spark.read.text(str(tmp_path / "html")).first()[0]
    with pytest.raises(LookupError):
        reports.export(m.where("run_id = 2"), pages, eng, pdfs, str(tmp_path / "x"), "csv")


def test_tesseract(spark):
    data = ([1, 5, 5, 5], [0, 1, 1, 1], [0, 1, 1, 1], [0, 1, 1, 2], [0, 270, 100, 100], [0, 50, 50, 120], [0, 140, 150, 80], [0, 40, 40, 40], ["-1", "85", "92", "x"], ["", "World", "Hello", "odd"])
    lists = "struct<level:array<int>,block_num:array<int>,par_num:array<int>,line_num:array<int>,left:array<int>,top:array<int>,width:array<int>,height:array<int>,conf:array<string>,text:array<string>>"
    raw = spark.createDataFrame([(1, 2550, 3300, 300, data, "H 100 3230 125 3250 0\nbad line")], f"page_number int, width int, height int, dpi int, image_to_data {lists}, image_to_boxes string")
    page = one(normalize.tesseract(raw))["data"]
    lines = page["blocks"][0]["lines"]
    assert [[w["text"] for w in l["words"]] for l in lines] == [["Hello", "World"], ["odd"]]
    hello = lines[0]["words"][0]
    assert hello["bbox"] == approx([24, 12, 60, 21.6]) and hello["confidence"] == approx(0.92)
    assert [c["char"] for c in hello["chars"]] == ["H"] and len(lines[0]["words"][1]["chars"]) == 5
    assert lines[1]["words"][0]["confidence"] == 0 and page["width"] == approx(612)


def test_document_ai(spark):
    layout_ = {"text_anchor": {"text_segments": [{"start_index": 0, "end_index": 5}]}, "bounding_poly": {"normalized_vertices": [{"x": 0.1, "y": 0.2}, {"x": 0.5, "y": 0.8}]}, "confidence": 0.9}
    second = {**layout_, "text_anchor": {"text_segments": [{"start_index": 6, "end_index": 11}]}}
    whole = {**layout_, "text_anchor": {"text_segments": [{"start_index": 0, "end_index": 11}]}}
    import json

    doc = {"text": "Hello World", "pages": [{"page_number": 1, "dimensions": {"width": 612, "height": 792}, "paragraphs": [{"layout": whole}], "lines": [{"layout": whole}], "tokens": [{"layout": layout_}, {"layout": second}], "tables": [{"layout": whole, "header_rows": [{"cells": [{"layout": layout_, "col_index": 0}]}], "body_rows": [{"cells": [{"layout": second, "col_index": 1}]}]}]}]}
    raw = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"text":""}')], "doc_id int, j string").select("doc_id", F.from_json("j", normalize.AI_DOCUMENT).alias("document"))
    got = {r["doc_id"]: r["data"] for r in normalize.document_ai(raw).collect()}
    assert [w["text"] for w in got[1]["blocks"][0]["lines"][0]["words"]] == ["Hello", "World"]
    assert got[1]["blocks"][0]["bbox"] == approx([61.2, 158.4, 306, 633.6])
    t = got[1]["tables"][0]
    assert (t["num_rows"], t["num_cols"], t["cells"][1]["row"], t["cells"][1]["text"]) == (2, 2, 1, "World")
    assert got[2]["width"] == 1.0 and got[2]["blocks"] == []


def test_textract(spark):
    import json

    box = lambda l, t, w, h: {"BoundingBox": {"Left": l, "Top": t, "Width": w, "Height": h}}
    rel = lambda *ids: [{"Type": "CHILD", "Ids": list(ids)}]
    blocks = [
        {"Id": "p", "BlockType": "PAGE", "Page": 1, "Relationships": rel("l", "k", "t")},
        {"Id": "l", "BlockType": "LINE", "Text": "a b", "Confidence": 99, "Geometry": box(0, 0, 1, 0.1), "Relationships": rel("w1", "w2")},
        {"Id": "w1", "BlockType": "WORD", "Text": "a", "Confidence": 90, "Geometry": box(0, 0, 0.5, 0.1)},
        {"Id": "w2", "BlockType": "WORD", "Text": "b", "Confidence": 80, "Geometry": box(0.5, 0, 0.5, 0.1)},
        {"Id": "k", "BlockType": "KEY_VALUE_SET"},
        {"Id": "t", "BlockType": "TABLE", "Geometry": box(0, 0.5, 1, 0.2), "Relationships": rel("c1", "c2")},
        {"Id": "c1", "BlockType": "CELL", "Text": "A", "RowIndex": 1, "ColumnIndex": 1, "Geometry": box(0, 0.5, 0.5, 0.2)},
        {"Id": "c2", "BlockType": "CELL", "Text": "B", "RowIndex": 1, "ColumnIndex": 2, "Geometry": box(0.5, 0.5, 0.5, 0.2)},
    ]
    raw = spark.createDataFrame([(7, json.dumps(blocks))], "doc_id int, j string").select("doc_id", F.from_json("j", f"array<{normalize.TX}>").alias("blocks"))
    page = one(normalize.textract(raw))["data"]
    assert [(b["type"], b["order"]) for b in page["blocks"]] == [("text", 0), ("table", 2)]
    assert [w["text"] for w in page["blocks"][0]["lines"][0]["words"]] == ["a", "b"]
    assert page["width"] == approx(612) and page["blocks"][0]["lines"][0]["words"][1]["confidence"] == approx(0.8)
    t = page["tables"][0]
    assert (t["num_rows"], t["num_cols"], [c["text"] for c in t["cells"]]) == (1, 2, ["A", "B"])


def test_vlm(spark):
    md = "## One\nfirst line\nsecond line\n\n## Two\nthird\n```\ncode\n\nmore\n```\nend"
    js = '[{"text":"a b"},{"content":"c","confidence":0},"d",{"text":""}]'
    pages = spark.createDataFrame([(1, 612.0, 792.0, md), (2, 612.0, 792.0, js), (3, 612.0, 792.0, "")], "k int, width double, height double, raw_text string")
    kinds = [(r["type"], r["lines"]) for r in normalize.markdown_blocks(pages.where("k = 1"), "k").orderBy("block").collect()]
    assert kinds == [("heading", ["One"]), ("text", ["first line", "second line"]), ("heading", ["Two"]), ("text", ["third"]), ("code", ["code", "", "more"]), ("text", ["end"])]
    got = {r["k"]: r["data"] for r in normalize.vlm(pages, "k", form="json").collect()}
    assert [b["lines"][0]["text"] for b in got[2]["blocks"]] == ["a b", "c", "d"]
    assert [b["confidence"] for b in got[2]["blocks"]] == [1, 1, 1] and got[3]["blocks"] == []
    assert len(got[1]["blocks"]) == 6
    first = got[1]["blocks"][0]
    assert first["bbox"] == approx([30.6, 13.2, 581.4, 118.8])


def test_mock(spark):
    raw = spark.createDataFrame([((1, 612.0, 792.0, [("text", (0.0, 0.0, 1.0, 1.0), 0.9, [("ab", (0.0, 0.0, 1.0, 1.0), 0.9, [("ab", (0.0, 0.0, 1.0, 1.0), 0.8)])]), ("table", (0.0, 2.0, 1.0, 3.0), 0.9, None)]),)], f"raw {normalize.MOCK}")
    page = one(normalize.mock(raw))["data"]
    assert page["blocks"][0]["lines"][0]["words"][0]["chars"][1]["bbox"] == [0.5, 0, 1, 1] and page["blocks"][1]["lines"] is None


def test_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [("r", i, t + dt.timedelta(minutes=i), "progress", "running" if i < 3 else "completed", i, 3, "m") for i in range(1, 4)]
    df = spark.createDataFrame(rows + rows[:1], events.SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"))
    events.run_to_end(events.once_each(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 and one(events.latest_state(out))["status"] == "completed"
    assert events.windowed(out).agg(F.sum("n")).first()[0] == 3


def test_stream_scores(spark, tmp_path):
    spark.createDataFrame([("r", "d", 1, ["abc"])], "run_id string, doc_id string, page_number int, words array<string>").write.parquet(str(tmp_path / "in"))
    truth = spark.createDataFrame([("d", 1, ["abd"])], "doc_id string, page_number int, words array<string>")
    stream = events.read(spark, str(tmp_path / "in"), "run_id string, doc_id string, page_number int, words array<string>")
    events.score_pages(stream, truth, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert one(spark.read.parquet(str(tmp_path / "out")))["cer"] == approx(1 / 3)


def test_layout_operators(spark):
    words = [("a", [10.0, 0.0, 50.0, 10.0], 1.0), ("b", [60.0, 0.0, 90.0, 10.0], 1.0), ("c", [10.0, 90.0, 50.0, 100.0], None)]
    pages = spark.createDataFrame([(1, 612.0, 792.0, words), (2, 612.0, 792.0, None)], f"k int, width double, height double, words {layout.WORDS}")
    assert [(r["k"], r["text"]) for r in layout.blocks(pages, "k").orderBy("order").collect()] == [(1, "a b c")]
    rows = spark.createDataFrame([(1, w[1], True) for w in words], "k int, bbox array<double>, agrees boolean")
    lines = layout.line_agreement(layout.line_islands(rows, "k"), "k").orderBy("line").collect()
    assert [(r["level"], r["x1"]) for r in lines] == [("full", 90.0), ("full", 50.0)]


def test_own_statistic(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(40)], "ord int, value double")
    half = lambda c: F.percentile(c, F.lit(0.5))
    a = one(bootstrap.confidence_interval(rows, times=60, statistic=half))
    assert a == one(bootstrap.confidence_interval(rows, times=60, statistic="median"))
    assert 8 < a["lower"] < a["median"] < a["upper"] < 31


def test_model_pages_keep_their_numbers(spark):
    from pageloom.sources import normalize

    rows = spark.createDataFrame([("d", 1, 612.0, 792.0, "# A\n\nb c"), ("d", 2, 612.0, 792.0, "x"), ("d", 3, 612.0, 792.0, "")], "doc_id string, page_number int, width double, height double, raw_text string")
    for form in ("markdown", "json"):
        got = normalize.vlm(rows, "doc_id", "page_number", form=form)
        assert sorted(r[0] for r in got.select("data.page_number").collect()) == [1, 2, 3]
    assert normalize.vlm(rows.where("page_number = 1").drop("page_number"), "doc_id").first()["data"]["page_number"] == 1


def test_comparison_checks(spark):
    import uuid

    import pytest

    ids = [str(uuid.UUID(int=i)) for i in range(8)]
    runs = spark.createDataFrame([(x, "p" if i < 4 else "q", "failed" if i == 3 else "completed") for i, x in enumerate(ids[:6])], "run_id string, pdf_id string, status string")
    assert catalog.check_comparison([ids[0], " ", ids[1].upper()], runs, "p") == ids[:2]
    for bad, kind, pdf in (([ids[0]], ValueError, None), (ids[:6], ValueError, None), (["x", ids[0]], ValueError, None), ([ids[0], ids[7]], LookupError, None), ([ids[0], ids[4]], ValueError, "p"), ([ids[0], ids[3]], ValueError, "p")):
        with pytest.raises(kind):
            catalog.check_comparison(bad, runs, pdf)


def test_engine_settings():
    import pytest

    from pageloom.sources import engines

    engines.register("own-test", "Own", lambda df: df, settings={"dpi": (int, 300), "lang": (str, "eng"), "scale": (float, 1.0), "fast": (bool, False)})
    assert engines.configured("own-test", {"dpi": 200, "scale": 2}) == {"dpi": 200, "lang": "eng", "scale": 2, "fast": False}
    assert engines.config_schema("own-test")["properties"]["dpi"] == {"type": "integer", "default": 300}
    assert "own-test" in engines.discover()
    for bad in ({"x": 1}, {"dpi": "300"}, {"dpi": True}, {"fast": 1}):
        with pytest.raises(ValueError):
            engines.configured("own-test", bad)


def test_tree_order_and_own_similarity(spark):
    words = [("c", [200.0, 0.0, 210.0, 10.0], 1.0), ("a", [0.0, 0.0, 10.0, 10.0], 1.0), ("b", [40.0, 0.0, 50.0, 10.0], 1.0), ("none", None, 1.0)]
    got = layout.tree_order(spark.createDataFrame([(1, words)], f"k int, words {layout.WORDS}"), "k").orderBy("order").collect()
    assert [r["word"]["text"] for r in got] == ["a", "b", "c"]
    cell = lambda t: [(0, 0, 1, 1, t, [0.0, 0.0, 1.0, 1.0])]
    box = [0.0, 0.0, 9.0, 9.0]
    pages = spark.createDataFrame([(1, [(box, cell("a"))], [(box, cell("b"))])], f"k int, pred_tables {layout.TABLES}, gt_tables {layout.TABLES}")
    assert one(layout.table_metrics(pages, "k"))["grits_con"] == 0 and one(layout.table_metrics(pages, "k", similarity=lambda a, b: 0.5))["grits_con"] == 0.5
