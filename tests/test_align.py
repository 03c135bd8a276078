import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pytest import approx

from pageloom.functions import align
from pageloom.functions.grids import compare, page, text_similarity

short = st.text("abc", max_size=12)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def best(a, b):
    row = [-j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [-i]
        for j, y in enumerate(b, 1):
            new.append(max(row[j] - 1, new[-1] - 1, row[j - 1] + (1 if x == y else -1)))
        row = new
    return row[-1]


@given(short, short)
@settings(max_examples=200, deadline=None)
def test_path_covers_both_in_order_and_scores_best(a, b):
    path, score = align.align(a, b)
    assert [i for i, _ in path if i is not None] == list(range(len(a)))
    assert [j for _, j in path if j is not None] == list(range(len(b)))
    assert score == best(a, b) == sum(-1 if None in p else 1 if a[p[0]] == b[p[1]] else -1 for p in path)


@given(short, short)
@settings(max_examples=200, deadline=None)
def test_counts_agree_with_the_path_and_with_least_edits(a, b):
    path, _ = align.align(a, b)
    m = sum(None not in p and a[p[0]] == b[p[1]] for p in path)
    s = sum(None not in p for p in path) - m
    assert align.aligned_counts(a, b) == (m, s, sum(p[0] is None for p in path), sum(p[1] is None for p in path))
    m, s, i, d = align.edit_counts(a, b)
    assert s + i + d == edits(a, b) and m + s + d == len(a) and m + s + i == len(b)


@given(short, short)
@settings(max_examples=100, deadline=None)
def test_halving_gives_the_same_score(a, b):
    whole, score = align.align(a, b)
    parts, same = align.align(a, b, cells=8)
    assert same == score
    assert sum(-1 if None in p else 1 if a[p[0]] == b[p[1]] else -1 for p in parts) == score
    assert [j for _, j in parts if j is not None] == list(range(len(b)))


def test_long_inputs_keep_their_indices():
    a = [f"w{i}" for i in range(600)]
    b = list(a)
    b[450] = "other"
    path, _ = align.align(a, b, cells=20_000)
    assert path == [(i, i) for i in range(600)]
    assert [i for i, j in path if a[i] != b[j]] == [450]
    assert align.edit_counts(a, b) == (599, 1, 0, 0)


def test_alignment_is_not_least_edits():
    assert sum(align.aligned_counts("bccbba", "aaaacc")[1:]) == 7
    assert sum(align.edit_counts("bccbba", "aaaacc")[1:]) == 6


@given(st.text("abcd", max_size=15), st.text("abcd", max_size=15))
@settings(max_examples=200, deadline=None)
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    assert align.common_length(a, b) == row[-1]


def test_local():
    path, score = align.local(list("xxabcyy"), list("zabcz"))
    assert path == [(2, 1), (3, 2), (4, 3)] and score == 6
    assert align.local([], ["a"]) == ([], 0.0)


def test_fuzzy_words_and_boxes():
    ref = [{"text": "hello", "bbox": [0, 0, 10, 10]}, {"text": "world", "bbox": [20, 0, 30, 10]}]
    hyp = [{"text": "hel1o", "bbox": [0, 0, 10, 10], "confidence": 0.9}, {"text": "qqqqq", "bbox": [20, 0, 30, 10], "confidence": 0.1}]
    pairs, score = align.align_words(ref, hyp)
    assert [p["op_text"] for p in pairs] == ["match", "substitution"]
    assert [p["op"] for p in pairs] == ["match", "match"] and pairs[1]["iou"] == 1.0
    assert score == approx((0.6 - 1.0) / 2)


def test_iou():
    assert align.iou([0, 0, 10, 10], [5, 0, 15, 10]) == approx(1 / 3)
    assert align.iou([0, 0, 10, 10], [2, 2, 8, 8]) == approx(0.36)
    assert align.iou([0, 0, 1, 1], [1, 1, 2, 2]) == 0


def cell(r, c, t="", rs=1, cs=1, box=(0, 0, 1, 1)):
    return {"row": r, "col": c, "row_span": rs, "col_span": cs, "text": t, "bbox": list(box)}


GRID = [cell(0, 0, "A"), cell(0, 1, "B"), cell(1, 0, "C"), cell(1, 1, "D")]


def test_tables():
    assert compare(GRID, GRID)["top"] == 1
    assert compare([], [])["top"] == 1 and compare([], GRID)["top"] == 0
    assert compare(GRID, [cell(0, 0, "A", 2, 2)])["top"] == 0
    assert compare(GRID, [cell(0, 0, "A", 1, 2), cell(1, 0, "C"), cell(1, 1, "D")])["top"] == approx(0.5)
    half = [cell(0, 0, "A"), cell(0, 1, "B"), cell(1, 0, "x"), cell(1, 1, "y")]
    assert compare(half, GRID)["con"] == approx(0.5)
    assert text_similarity("kitten", "sitting") == approx(1 - 3 / 7)


def test_table_pages():
    t = {"bbox": [0, 0, 10, 10], "cells": GRID}
    far = {"bbox": [50, 50, 60, 60], "cells": GRID}
    assert set(page([], []).values()) == {1.0}
    assert page([t], [t])["table_detection_precision"] == 1
    lost = page([far], [t])
    assert lost["grits_top"] == 1.0 and lost["table_detection_recall"] == 0
    assert page([t, far], [t])["table_detection_precision"] == 0.5


def test_random_long_pairs_halve_correctly():
    r = random.Random(4)
    a = [r.choice("abcdefgh") for _ in range(300)]
    b = [x for x in a if r.random() > 0.1]
    assert align.align(a, b, cells=500)[1] == best(a, b)


def test_local_without_a_table_scores_the_same():
    r = random.Random(17)
    for _ in range(60):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(2))
        for score in (None, lambda x, y: 2.0 if x == y else -1.0):
            path, top = align.local(a, b, score=score)
            other, same = align.local(a, b, score=score, cells=8)
            value = lambda p: sum(-1 if i is None or j is None else 2 if a[i] == b[j] else -1 for i, j in p)  # noqa: B023, E731
            assert top == same == value(path) == value(other)


def test_scores_of_words_are_kept_within_bounds(monkeypatch):
    words = [f"w{i}" for i in range(40)]
    plain = align.align(words, words[5:] + ["x"], score=lambda x, y: 2 * align.similarity(x, y) - 1)
    monkeypatch.setattr(align, "HELD", 10)
    assert align.align(words, words[5:] + ["x"], score=lambda x, y: 2 * align.similarity(x, y) - 1) == plain
