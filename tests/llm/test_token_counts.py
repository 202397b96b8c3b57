from __future__ import annotations

import random

import pytest

from framewright.llm import token_counts as t


@pytest.fixture(scope="module")
def counter():
    with open(t.VOCABULARY, "rb") as f:
        return t.Counter(f.read())


PIECES = ["word", " ", "  ", "\n", "\n\n ", "it's", "'ll", "'", "12", " 7", "é", "ß", "😀", "!?", "...", " the", "\t", "don't", "x"]


@pytest.mark.parametrize("seed", range(6))
def test_edits_equal_full_encoding(counter, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(t, "LEAF", 3)
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(PIECES) for _ in range(n))
    for n in (0, 1, 5, 60, 700):
        doc = t.Document(make(n), counter)
        for _ in range(60):
            size = len(doc.text)
            start = rng.randint(0, size)
            stop = min(size, start + rng.choice((0, 0, 1, 2, 9, 80)))
            insert = make(rng.choice((0, 1, 2, 6, 90)))
            expected = doc.text[:start] + insert + doc.text[stop:]
            doc.edit(start, stop, insert)
            assert doc.text == expected
            assert doc.tokens == len(counter.encode(expected)), (start, stop, insert)
            assert "".join(doc.texts) == expected and [k for lengths in doc.lengths for k in lengths] == list(map(len, counter.pattern.findall(expected)))


def test_only_the_region_is_encoded(counter):
    doc = t.Document("some words here " * 5_000, counter)
    doc.edit(40_000, 40_003, "XYZ")
    assert doc.encoded < 12


def test_only_the_leaves_around_an_edit_are_read(counter):
    doc = t.Document("some words here " * 5_000, counter)
    before = list(doc.texts)
    doc.edit(40_000, 40_003, "XYZ")
    changed = [k for k, (a, b) in enumerate(zip(before, doc.texts, strict=True)) if a is not b]
    assert 1 <= len(changed) <= 2 and doc.tokens == len(counter.encode(doc.text))


def test_a_very_long_word(counter):
    word = "ab" * 500_000
    doc = t.Document("x " + word, counter)
    assert doc.tokens == len(counter.encode("x " + word))
    doc.edit(500_000, 500_000, " ")
    assert doc.tokens == len(counter.encode(doc.text)) and len(doc.text) == 1_000_003


def test_kept_trees(spark, counter):
    from framewright.llm._common import written
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(900, None), (901, ""), (5, "twice the id")], "doc_id long, text string"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    kept = written(t.trees(docs))
    assert sorted((r.doc_id, r.n_tokens) for r in kept.collect()) == sorted((i, len(counter.encode(x))) for i, x in texts)
    rng = random.Random(3)
    for _ in range(2):
        edits = [(rng.choice((3, 5, 17, 900, 901, 10**9)), k, a := rng.randint(0, 400), a + rng.choice((0, 3, 50)), rng.choice(("", " new words", "7"))) for k in range(25)]
        after = written(t.apply_edits(kept, spark.createDataFrame(edits[::-1] + [(None, 1, 0, 1, "x")], "doc_id long, seq int, start int, stop int, insert string")))
        expected = []
        for i, x in texts:
            for _, _, a, b, insert in (e for e in edits if e[0] == i):
                a = min(a, len(x))
                x = x[:a] + insert + x[min(max(a, b), len(x)) :]
            expected.append((i, x))
        texts = expected
        got = after.collect()
        assert sorted((r.doc_id, r.text or "", r.n_tokens) for r in got) == sorted((i, x, len(counter.encode(x))) for i, x in texts)
        assert all(r.n_encoded == 0 for r in got if r.doc_id not in {e[0] for e in edits})
        assert after.where("n_encoded > 0").agg(F.sum("n_encoded")).first()[0] < 900
        kept = after
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert t.trees(nothing).collect() == []


def test_counts_of_driver_table(spark, counter):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    with_edits = docs.withColumn("e", t.sample_edits(F.col("text")))
    rows = {r.doc_id: r for r in with_edits.collect()}
    for r in t.token_counts(with_edits, F.col("e")).collect():
        text = rows[r.doc_id].text
        assert r.n_tokens == len(counter.encode(text))
        for e in rows[r.doc_id].e:
            start, stop = min(e.start, len(text)), min(e.stop, len(text))
            text = text[:start] + e.insert + text[stop:]
        assert r.edited_tokens == len(counter.encode(text)) and r.n_edits == 3


def test_edges(edge, empty):
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in t.token_counts(edge).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[9].n_tokens > 20_000 and got[7].n_edits == 0
    far = F.array(F.struct(F.lit(-5).alias("start"), F.lit(10**6).alias("stop"), F.lit(None).cast("string").alias("insert")))
    assert {r.edited_tokens for r in t.token_counts(edge.where("doc_id < 9"), far).collect()} == {0}
    assert t.token_counts(empty).collect() == []
