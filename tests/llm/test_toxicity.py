from __future__ import annotations

import itertools
import random

import pytest

from framewright.llm import toxicity as t


def distance(a, b):
    """Damerau-Levenshtein (optimal string alignment)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_matcher_equals_edit_distance():
    entries = [("abcab", 0), ("cabbage", 0), ("abc", 0), ("bbbbbbbbbb", 0), ("cacao", 1)]
    matcher, rng = t.Matcher(entries), random.Random(2)
    for _ in range(4_000):
        word = "".join(rng.choice("abcgeo") for _ in range(rng.randint(1, 11)))
        if rng.random() < 0.7:
            word = list(rng.choice(entries)[0])
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(word))
                word[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
            word = "".join(word) or "a"
        expected = {}
        for k, (text, stem) in enumerate(entries):
            most = 0 if len(text) < 5 else 1 if len(text) < 10 else 2
            if stem:
                least = min(distance(word[:j], text) for j in range(len(word) + 1))
            else:
                least = distance(word, text)
            if least == 0:
                expected[k] = t.EXACT
            elif not stem and len(text) >= 5 and word.startswith(text):
                expected[k] = t.ENDING
            elif least <= most:
                expected[k] = t.EDITED
        assert matcher.hits(word) == expected, word


def test_quotation_counts_less():
    matcher = t.Matcher([("idiot", 0)])
    model = t.Model([("idiot", 0)], {(0, t.EXACT): 0.9, (0, t.EDITED): 0.8}, 0.01)
    score = lambda text: model.score(t.document_hits(text, matcher, set()))
    abuse, quoted = score("you are an idiot"), score('the paper wrote the word "idiot" again')
    assert abuse > 0.85 and quoted < 0.3 < score('he is an "ok" idiot')
    assert score('"you idiot"') > quoted and 0.7 < score("you idoit") < abuse and score("1di0t you") > 0.7
    assert score("") == score("nice") == pytest.approx(0.01)


def plain_score(text, entries, weights, rest):
    """A text's score by edit distances to every entry, without automata (no quotation marks in the text)."""
    seen = [{} for _ in entries]
    for word in set(t.WORD.findall(text.lower())):
        for k, (entry, stem) in enumerate(entries):
            most = 0 if len(entry) < 5 else 1 if len(entry) < 10 else 2
            least = min((distance(word[:j], entry) for j in range(len(word) + 1)), default=9) if stem else distance(word, entry)
            kind = t.EXACT if least == 0 else t.ENDING if not stem and len(entry) >= 5 and word.startswith(entry) else t.EDITED if least <= most else None
            if kind is not None:
                seen[k].setdefault(kind, set()).add(word)
    clean = 1 - rest
    for k, by_kind in enumerate(seen):
        if t.EXACT in by_kind and len(by_kind[t.EXACT]) < entries[k][1]:
            by_kind[t.ENDING] = by_kind.pop(t.EXACT)
        clean *= 1 - max((weights.get((k, kind), 0.0) for kind in by_kind), default=0.0)
    return 1 - clean


def test_query_scores_equal_plain_edit_distances(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = t.fit(docs, labels)
    letters = {r.doc_id: r.text for r in docs.where("length(text) < 1500").collect() if r.text and not t.QUOTES.search(r.text) and all(w.isalpha() or w.isdigit() for w in t.WORD.findall(r.text))}
    got = {r.doc_id: r.score for r in t.toxicity_scores(docs, labels).collect() if r.doc_id in letters}
    some = sorted(letters)[:60]
    assert len(some) > 20 and model.entries
    for i in some:
        assert got[i] == pytest.approx(plain_score(letters[i], model.entries, model.weights, model.rest)), i


def test_every_entry_that_passes_is_kept(spark, monkeypatch):
    """More entries than any former cap, and the same model when a task forgets what it remembers."""
    abuse = ["".join(w) for w in itertools.islice(itertools.product("bcdfghjk", "aeiou", "lmnprstvwxz", "qx"), 600)]
    rng = random.Random(1)
    texts = [(k, " ".join(rng.sample(abuse, len(abuse))) + f" t{k}", 1) for k in range(0, 400, 4)] + [(k, f"nice{k} words{k} here{k}", 0) for k in range(1, 400) if k % 4]
    docs = spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in texts], "doc_id long, quality int, toxic int")
    model = t.fit(docs, labels)
    assert sorted(w for w, n in model.entries if not n) == sorted(abuse)
    whole = sorted(t.toxicity_scores(docs, labels).collect())
    monkeypatch.setattr(t, "REMEMBERED", 5)
    again = t.fit(docs.repartition(5), labels)
    assert (again.entries, again.weights, again.rest) == (model.entries, model.weights, model.rest)
    matcher = t.Matcher(model.entries)
    assert [matcher.hits(w) for w in abuse] == [{k: t.EXACT for k, (e, _) in enumerate(model.entries) if e == w} | {k: v for k, v in matcher.hits(w).items() if model.entries[k][0] != w} for w in abuse]
    assert sorted(t.toxicity_scores(docs.repartition(3), labels).collect()) == whole


def test_quotedness_looks_at_one_line():
    long = "x" * 300 + ' "'
    for text, word in ((f'{long}bad" said', "bad"), ('a "\nbad" said', "bad"), ('wrote "bad\n" said', "bad"), ('he wrote "bad" ok', "bad")):
        at = text.index(word)
        line = text.rfind("\n", 0, at) + 1
        end = text.find("\n", at) if "\n" in text[at:] else len(text)
        cut = text[line:end]
        assert t.quotedness(text, at, at + 3) == t.quotedness(cut, at - line, at - line + 3)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = t.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.predicted == got.toxic).mean() > 0.9
    assert got[got.toxic == 0].predicted.mean() < 0.05


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(t.remainder(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(t.toxicity_scores(docs, labels).collect()) == sorted(t.toxicity_scores(docs, turned).collect())


def test_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = t.toxicity_scores(edge, none).collect()
    assert len(got) == 11 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, None, 1), (4, 1, 0), (4, 1, 1), (7, 0, 0), (None, 0, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in t.toxicity_scores(edge, labels).collect())
    assert t.toxicity_scores(empty, labels).collect() == []
    assert t.drop_toxic(edge, labels, threshold=2.0).columns == edge.columns
