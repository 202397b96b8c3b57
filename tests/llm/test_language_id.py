from __future__ import annotations

import collections
import math
import random

import pytest

from framewright.llm import language_id as g


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = g.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and got.score.between(0, 1).all()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_held_out_labels_teach_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    turned = docs.withColumn("lang", F.when(g.remainder(F.col("doc_id"), 3) == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    assert sorted(g.languages(docs).collect()) == sorted(g.languages(turned).collect())


def test_distance_rejects_what_resembles_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = g.fit(docs)
    foreign = "съешь ещё этих мягких французских булок да выпей чаю"
    some = spark.createDataFrame([(1, foreign), (2, docs.where("lang = 'en'").first().text)], "doc_id long, text string")
    got = {r.doc_id: r for r in g.predict(some, model).collect()}
    assert got[1].rejected and got[1].lang_pred in model.languages and got[1].distance > 0.5
    assert not got[2].rejected


def plain_counts(text, bits):
    """Counts by loops over single letters."""
    units = [0]
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        x = ord(low) if c.isalpha() else 0
        if x or units[-1]:
            units.append(x)
    units.append(0)
    grams = [x for x in units if x]
    grams += [a << 21 | b | 1 << 63 for a, b in zip(units, units[1:]) if a or b]
    grams += [a << 42 | b << 21 | c for a, b, c in zip(units, units[1:], units[2:]) if b]
    out = collections.Counter()
    for x in grams:
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        out[(x ^ x >> 31) >> (64 - bits)] += 1
    return out


def test_query_equals_plain_cosines(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    model = g.fit(docs)
    got = {r.doc_id: r for r in g.languages(docs).collect()}
    rows = [r for r in docs.collect() if len(r.text or "") < 4_000]
    assert len(rows) > 100
    for r in rows:
        v = {k: n**0.5 * float(model.idf[k]) for k, n in plain_counts(r.text or "", model.bits).items()} if any(map(str.isalpha, r.text or "")) else {}
        if not v:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        length = sum(x * x for x in v.values()) ** 0.5
        near = [sum(x * float(c[k]) for k, x in v.items()) / length for c in model.centroids]
        best = {lang: max(x for x, of in zip(near, model.of) if of == lang) for lang in model.languages}
        share = math.exp(20 * max(near)) / sum(math.exp(20 * x) for x in best.values())
        assert best[got[r.doc_id].lang_pred] == pytest.approx(max(near), abs=1e-5)
        assert got[r.doc_id].score == pytest.approx(share, abs=1e-3) and got[r.doc_id].distance == pytest.approx(1 - max(near), abs=1e-5)
    whole = sorted(g.languages(docs).collect())
    monkeypatch.setattr(g, "LANGUAGES_A_PASS", 1)
    for a, b in zip(whole, sorted(g.languages(docs).collect()), strict=True):
        assert (a.doc_id, a.lang_pred, a.rejected) == (b.doc_id, b.lang_pred, b.rejected) and a.score == pytest.approx(b.score, abs=1e-5)


@pytest.mark.parametrize("piece", range(1, 61))
def test_pieces_count_alike(monkeypatch, piece):
    rng = random.Random(piece)
    texts = ["Straße É x " * 30, "".join(rng.choices("abÉ  \U0001f600\U00010400,", k=257)), "a" * 2 * piece, " " * 2 * piece, "", "b"]
    whole = [g.gram_counts(x, 10) for x in texts]
    plain = [plain_counts(x, 10) for x in texts]
    monkeypatch.setattr(g, "PIECE", piece)
    for x, expected, by_loop in zip(texts, whole, plain, strict=True):
        got = g.gram_counts(x, 10)
        if expected is None:
            assert got is None
        else:
            assert got.tolist() == expected.tolist() == [by_loop[k] for k in range(1024)]


def test_letters_are_letters():
    assert g.gram_counts("\U0001f600 123 !?", 10) is None and g.gram_counts("\U00010400", 10) is not None
    assert g.letters("Ab1 \u00c9\U0001f600x").tolist() == [97, 98, 0, 0, 0xE9, 0, ord("x")]


def test_edges(spark, edge, empty):
    got = {r.doc_id: r for r in g.languages(edge).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 10}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert g.languages(empty).collect() == []
    unlabelled = edge.where("doc_id < 5").selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in g.languages(unlabelled).collect()} == {("und", 0.0)}
