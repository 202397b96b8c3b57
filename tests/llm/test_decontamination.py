from __future__ import annotations

import hashlib
import random
import re

from framewright.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_driver_table(spark, small_dir):
    docs, items = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(d.contamination(docs, items)) == expected
    gone = {r[0] for r in expected if r[5]}
    assert {r.doc_id for r in d.drop_contaminated(docs, items).collect()} == {r[0] for r in expected} - gone


def test_overlaps_short_items_and_repeats(spark):
    long = " ".join(f"t{k}" for k in range(20))
    items = [(1, long), (2, "Short one"), (3, " ".join(f"t{k}" for k in range(5, 25))), (3, "short ONE"), (4, None), (None, long), (5, "?!"), (11, "absent words here")]
    docs = [(1, f"x {long} y {long}"), (2, "a short, one. short one"), (3, None), (4, ""), (5, " ".join(f"t{k}" for k in range(3, 23))), (5, "t0 t1"), (6, "word " * 300 + "short one"), (7, "été short oneé")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(d.contamination(df, bench)) == brute(docs, items)


def brute_near(docs, items, window=13, near=80, stretch=16):
    """{(doc, item)}: some stretch of the document holds enough of a block's distinct words. Looks at every stretch."""
    blocks = {}
    for i, text in items:
        w = words(text)
        for at in {*range(0, max(len(w) - window, 0), window), max(len(w) - window, 0)} if w and i is not None else ():
            blocks.setdefault(i, []).append(set(w[at : at + window]))
    out = set()
    for d_id, text in docs:
        w = words(text)
        for k in range(len(w)):
            held = set(w[k : k + stretch])
            out |= {(d_id, i) for i, some in blocks.items() for x in some if 100 * len(held & x) >= near * len(x)}
    return out


def near_rows(df):
    return {r.doc_id: r.n_near_items for r in df.collect()}


def expected_near(docs, items):
    close = brute_near(docs, items)
    out = {}
    for x in docs:
        exact = {j for j, t in items if brute([x], [(j, t)])[0][3]}
        out[x[0]] = len({j for i, j in close if i == x[0]} - exact)
    return out


def test_proximity_equals_brute_force(spark):
    """Every word of a block changed in turn, the rarest and words that the corpus lacks among them; swaps, gaps, tails."""
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((1, 2, 5, 12, 13, 14, 20, 26, 31))]
    items += [(20, " ".join(f"rare{k}" for k in range(13))), (21, "absent one " + " ".join(vocabulary[:11]))]
    docs, at = [], 0
    for _, text in items:
        w = text.split()
        for changed in range(0, len(w), 2):
            for more in (0, 1, 2, 3):
                v = list(w)
                for place in [changed, *rng.sample(range(len(v)), min(more, len(v)))]:
                    v[place] = "other"
                if more == 1:
                    v[1:1] = ["gap"]
                if more == 2:
                    rng.shuffle(v)
                docs.append((at, " ".join(rng.choices(vocabulary, k=3) + v + rng.choices(vocabulary, k=2))))
                at += 1
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = d.contamination(df, bench)
    assert near_rows(found) == expected_near(docs, items)
    assert rows(found) == brute(docs, items)


def test_proximity(spark):
    item = " ".join(f"q{k}" for k in range(13))
    moved = " ".join(f"q{k}" for k in (1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 11))
    got = d.contamination(spark.createDataFrame([(1, moved), (2, item)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_items, r.n_near_items) for r in got.collect()) == [(1, 0, 1), (2, 1, 0)]


def test_index_has_every_posting(spark):
    docs = [(1, "A b, c a"), (2, None), (2, "c C x"), (3, "")]
    places, terms = d.item_words(spark.createDataFrame([(1, "a c z")], "item_id long, text string"))
    index = d.positional_index(spark.createDataFrame(docs, "doc_id long, text string"), terms).join(terms, "term", "left")
    got = sorted((r.doc_id, r.word or "", r.position) for r in index.collect())
    assert got == [(1, "", 4), (1, "a", 0), (1, "a", 3), (1, "c", 2), (2, "", 0), (2, "", 3), (2, "c", 0), (2, "c", 1), (3, "", 0)]


def test_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "gamma delta")], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in d.contamination(edge, items).collect()}
    assert got[7] == 2 and got[1] == 0
    assert d.contamination(edge, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0
    assert d.contamination(empty, items).count() == 0
    assert d.drop_contaminated(edge, items).columns == edge.columns
