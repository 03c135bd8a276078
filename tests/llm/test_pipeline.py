"""The pipeline's stages on a small table, against the operators' own results."""

import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages(spark, tmp_path):
    import corpus_pipeline as c
    from pageloom.llm import crf, minhash, mixing, pii
    from pageloom.llm.queries import EPOCHS, PART, SEED, WEIGHTS

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality", "near_copies", "personal_data", "mixture", "packed"]
    seen = {}
    for name, stage in c.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        if name != "packed":
            assert docs.columns == list(c.COLUMNS)

    before, after = seen["quality"]
    field = crf.learn(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r["doc_id"] for r in before.collect() if field.score(*crf.lines_of(r["text"] or "")) >= 0.7}
    assert {r["doc_id"] for r in after.collect()} == want and 0 < len(want) < before.count()

    before, after = seen["near_copies"]
    shingles = {}
    for r in before.collect():
        w = minhash.words_of(r["text"] or "")
        shingles[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in shingles}
    inverted = {}
    for i, s in shingles.items():
        for x in s:
            inverted.setdefault(x, []).append(i)
    for a, s in shingles.items():
        for b in {j for x in s for j in inverted[x] if j > a}:
            if 5 * len(s & shingles[b]) >= 4 * len(s | shingles[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, x in root.items() if i == x}

    before, after = seen["personal_data"]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(before).collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert (r["text"] == texts[r["doc_id"]]) == (spans[r["doc_id"]] == "")
        assert r["n_chars"] == len(r["text"])

    before, after = seen["mixture"]
    assert after.count() == mixing.mix(before, WEIGHTS, PART, EPOCHS, SEED).count() > 0

    before, after = seen["packed"]
    assert after.where("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
    assert c.run(spark, DATA).count() == after.count()
