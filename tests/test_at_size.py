"""What keeps queries within their limits on large tables, seen in plans and on small inputs."""

import os

import pytest

from pageloom.plans import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plans(spark, name):
    q = QUERIES[name](spark, DATA)._jdf.queryExecution()
    return q.optimizedPlan().toString(), q.executedPlan().toString()


def made_again(plan):
    """Filters in which what pages are made of is worked out once more."""
    return [l for l in plan.split("\n") if "Filter" in l[:60] and "transform(" in l]


@tables
def test_tesseract_pages_are_made_once(spark):
    plan, _ = plans(spark, "tesseract_words")
    assert not made_again(plan) and plan.count("arrays_zip(") == 1 and len(plan) < 30_000


@tables
@pytest.mark.parametrize("name", ["textract_blocks", "textract_tables"])
def test_textract_documents_stay_in_their_rows(spark, name):
    plan, run = plans(spark, name)
    assert run.count("Exchange ") == 1 and "Join" not in run and not made_again(plan)  # the one is that of the items


def test_textract_ids(spark):
    """Many blocks, ids that stand twice, unknown or missing ones."""
    import json

    from pyspark.sql import functions as F

    from pageloom.sources import normalize

    rel = lambda *ids: [{"Type": "CHILD", "Ids": list(ids)}]
    words = [{"Id": f"w{i}", "BlockType": "WORD", "Text": str(i)} for i in range(700)]
    blocks = [{"Id": "w5", "BlockType": "WORD", "Text": "first"}, {"BlockType": "WORD"}, *words, {"Id": "l", "BlockType": "LINE", "Relationships": rel(*(f"w{i}" for i in range(699, -1, -1)), "no")}, {"Id": "p", "BlockType": "PAGE", "Page": 2, "Relationships": rel("none", "l")}, {"Id": "q", "BlockType": "PAGE", "Page": 3}]
    raw = spark.createDataFrame([(7, "x", json.dumps(blocks))], "doc_id int, more string, j string").select("doc_id", "more", F.from_json("j", f"array<{normalize.TX}>").alias("blocks"))
    got = {r["page_number"]: r for r in normalize.textract(raw, keep=("more",)).collect()}
    block = got[2]["data"]["blocks"][0]
    assert [w["text"] for w in block["lines"][0]["words"]] == [str(i) for i in range(699, -1, -1)] and block["order"] == 1
    assert got[3]["data"]["blocks"] == [] and got[3]["more"] == "x"


@tables
@pytest.mark.parametrize(("name", "shuffles"), [("vlm_markdown_pages", 0), ("vlm_json_pages", 1), ("markdown_blocks", 1)])
def test_pages_of_models_stay_in_their_rows(spark, name, shuffles):
    plan, run = plans(spark, name)
    assert run.count("Exchange ") == shuffles and "Join" not in run and "Window" not in run and not made_again(plan)


def test_markdown_by_lines(spark):
    """Against a plain loop over lines."""
    import random
    import re

    from pageloom.sources import normalize

    def loop(text):
        out, code, new = [], False, True
        for line in (text or "").split("\n"):
            s = line.strip(" ")
            if s.startswith("```"):
                code, new = not code, True
            elif not code and s == "":
                new = True
            elif not code and (m := re.fullmatch(r"(#{1,6})\s+(.+)", s)):
                out.append(("heading", len(m[1]), [m[2]]))
                new = True
            else:
                if new:
                    out.append(("code" if code else "text", None, []))
                out[-1][2].append(line)
                new = False
        return out

    r = random.Random(3)
    atoms = ["", " ", "a b", "```", "  ```x", "# H", "## two", "#no", "####### n", " # pad ", "a ```", "c"]
    texts = ["\n".join(r.choice(atoms) for _ in range(r.randint(0, 9))) for _ in range(300)] + [None, "```\n\n```"]
    got = normalize.markdown_blocks(spark.createDataFrame(list(enumerate(texts)), "k int, raw_text string"), "k").orderBy("k", "block").collect()
    assert [(x["k"], x["type"], x["level"], x["lines"]) for x in got] == [(k, *b) for k, t in enumerate(texts) for b in loop(t)]


@tables
def test_broken_pages_are_made_once(spark):
    plan, _ = plans(spark, "page_violations")
    assert not made_again(plan) and len(plan) < 30_000


@tables
@pytest.mark.parametrize("name", ["overlay_chars", "document_ai_words", "run_totals"])
def test_document_ai_pages_are_made_once(spark, name):
    plan, _ = plans(spark, name)
    # Elements of a page are worked out before the lambdas over their parents, which name them.
    assert not made_again(plan) and plan.count("anchor") < 150 and "_tokens" not in plan and len(plan) < 60_000


def test_boxes_tell_which_of_equal_words_is_missing(spark):
    from pyspark.sql import functions as F

    from pageloom.operators import consensus

    words = "a the the the b the the".split()
    box = lambda i: [i * 10.0, 0.0, i * 10.0 + 9, 12.0]
    kind = f"array<{consensus.WORD}>"
    for gone in range(len(words)):
        for boxed in (True, False):
            all_ = [(w, 0.9, box(i) if boxed else None) for i, w in enumerate(words)]
            rows = spark.createDataFrame([(1, "x", 0, all_), (1, "y", 1, all_[:gone] + all_[gone + 1 :])], f"k int, engine string, engine_rank int, words {kind}")
            got = consensus.project(rows, "k").where("engine = 'y' AND word IS NULL").select("position").collect()
            want = gone if boxed else min(i for i in range(len(words)) if words[:i] + words[i + 1 :] == words[:gone] + words[gone + 1 :])
            assert [r[0] for r in got] == [want]


@tables
def test_lines_go_by_one_sort(spark):
    """A second sort may put words of one place in another order than the first, on which beginnings of lines rest."""
    _, run = plans(spark, "text_lines")
    assert run.count(" Sort [") == 1


def _both_ways(monkeypatch, kernel, run):
    """With plain numbers, and with arrays."""
    few = run()
    monkeypatch.setattr(kernel, "FEW", 0)
    return few, run()


def test_small_pages_without_arrays(monkeypatch):
    import random

    from pageloom.functions import layout

    r = random.Random(1)

    def page(n):
        corners = [(r.randrange(-20, 650), r.randrange(-5, 800)) for _ in range(n)]
        return [{"text": str(i), "bbox": [x, y, x + r.choice([0, 5, 20.5, -3]), y + r.choice([0, 12, 400, -1])], "confidence": 1.0} for i, (x, y) in enumerate(corners)]

    pages = [page(r.randint(0, 12)) for _ in range(200)]
    a, b = _both_ways(monkeypatch, layout, lambda: [(layout.reading_order(layout.blocks_of(p, 612.0, 792.0), 612.0), layout.separators(p, 100.0)) for p in pages])
    assert a == b


def test_small_tables_without_arrays(monkeypatch):
    import random

    from pageloom.functions import grids

    r = random.Random(2)
    cell = lambda: {"row": r.randint(0, 5), "col": r.randint(0, 4), "row_span": r.choice([None, 1, 2]), "col_span": 1, "text": r.choice([None, "", "ab", "abc", "xyz 12"]), "bbox": [0.0, 0.0, r.random(), 1.0]}
    tables_ = [([cell() for _ in range(r.randint(0, 9))], [cell() for _ in range(r.randint(0, 9))]) for _ in range(200)]
    a, b = _both_ways(monkeypatch, grids, lambda: [grids.compare(p, t) for p, t in tables_])
    assert a == b


def test_nested_arrays_as_objects():
    import pyarrow as pa

    from pageloom.functions.nested import plain

    kind = pa.list_(pa.struct([("t", pa.string()), ("b", pa.list_(pa.float64())), ("i", pa.int32())]))
    rows = [[{"t": "é", "b": [1.0, None], "i": 3}, None], None, [], [{"t": None, "b": None, "i": None}], [{"t": "x", "b": [], "i": 1}]]
    a = pa.array(rows, kind)
    assert plain(a) == rows and plain(a.slice(1, 3)) == rows[1:4]
    empty = pa.Array.from_buffers(pa.list_(pa.float64()), 0, [None, pa.py_buffer(b"")], children=[pa.array([], pa.float64())])
    assert plain(empty) == []


@tables
def test_run_metrics_are_dealt_without_maps(spark):
    _, run = plans(spark, "engine_rankings")
    # Nothing is sorted or grouped before the exchange by run.
    below = run[run.index("REPARTITION_BY_COL") :]
    assert "Aggregate" not in below.split("FileScan")[0] and "Sort [" not in below.split("FileScan")[0]
