from pytest import approx

from pageloom.functions import language
from pageloom.functions.layout import blocks_of, columns, lines_of, reading_order, separators, tree_order


def word(t, x0, y0, x1=None, y1=None, c=1.0):
    return {"text": t, "bbox": [x0, y0, x1 if x1 is not None else x0 + 40, y1 if y1 is not None else y0 + 10], "confidence": c}


def test_lines_by_overlap():
    got = lines_of([word("b", 60, 2), word("a", 0, 0), word("c", 0, 30)])
    assert [[w["text"] for w in line] for line in got] == [["a", "b"], ["c"]]
    assert lines_of([]) == []


def test_blocks_by_gaps():
    ws = [word(f"w{i}", 10, y) for i, y in enumerate((0, 12, 24, 80, 92))]
    got = blocks_of(ws, 612, 792)
    assert [b["text"] for b in got] == ["w0 w1 w2", "w3 w4"]


def test_columns_and_reading_order():
    left = [word(f"l{i}", 20, 20 * i, 200) for i in range(5)]
    right = [word(f"r{i}", 400, 20 * i, 580) for i in range(5)]
    assert len(separators(left + right, 612)) == 1
    assert separators(left, 612) == []
    assert separators(left + right, 612, 792) == []  # neither side spans half of the page
    blocks = [{"bbox": [400, 0, 580, 90], "words": right}, {"bbox": [20, 0, 200, 90], "words": left}]
    assert columns(blocks, 612) == [1, 0]
    assert [b["words"][0]["text"] for b in reading_order(blocks, 612)] == ["l0", "r0"]


def test_tree_order():
    assert tree_order([]) == []
    assert tree_order([(0, 0), (0, 10), (100, 0), (0, 20)]) == [0, 1, 3, 2]


def test_fluency_bands():
    clean, garbled = "the river was clear and the light was good", "xq zvk jjw qqz xkcd vvw zzq"
    assert language.fluency(clean) > 0.5 > language.fluency(garbled)
    assert language.fluency("the r1ver was clear and the l1ght was g00d") == approx(language.fluency("the river was clear and the light was good"), abs=0.2)
    assert language.fluency("") == language.fluency("   ") == 0


def test_grammar():
    assert language.grammaticality("This is a good day for the people.") > language.grammaticality("xzq,k wvv!!b qqq.z")
    assert language.punctuation("no marks here") == 0.5
    assert language.punctuation("Fine, and well.") == 1.0
    assert language.punctuation("he,llo") == approx(0.8)
    assert language.grammaticality("") == language.plausibility("") == 0
