from __future__ import annotations

import random
import re

import numpy as np
import pytest

from framewright.llm import ngram_join
from framewright.llm._text import byte_rows, shingles, word_hashes  # noqa: F401


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(docs, size=4, percent=85):
    sets = {}
    for i, text in docs:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def groups(seed=3):
    """Texts with near copies around the limit, chains, shared passages and sizes around powers of two."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=40)
    docs, i = [], 0
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 11, 20, 34, 35, 36, 66, 67, 68, 130, 131, 260):
        base = rng.choices(vocabulary, k=n)
        for copy in range(7):
            w = list(base)
            for _ in range(copy * n // 100 + (copy % 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if copy == 6 and n > 20:
                w = w[: n // 2] + passage + w[n // 2 :]
            docs.append((i, " ".join(w)))
            i += 1
            if copy == 3:
                base = w
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("block", [ngram_join.BLOCK_SHINGLES, 200])
def test_equals_brute_force(spark, block):
    docs = groups()
    got = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), block_shingles=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_copies_that_only_their_base_links(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(260)]
    docs = [(1_000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(0, 260, 5), 5):
            w[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    expected = brute(docs)
    assert {c for _, c in expected.values()} == {0}
    pairs = [(a, b) for a, b in ((docs[3], docs[4]), (docs[9], docs[20]))]
    assert any(len({c for _, c in brute(list(p)).values()}) == 2 for p in pairs)
    got = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), block_shingles=3_000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_equals_brute_force_at_other_limits(spark):
    docs = groups(5)
    got = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=2, percent=60).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 2, 60)


def test_driver_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()} == expected


def test_edges(edge, empty):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(edge).collect())
    assert [g for g in got if g[0] != 9] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 3, 7), (7, 3, 7), (8, 3, 7), (10, 1, 10)]
    assert ngram_join.ngram_components(empty).collect() == []


def test_keep_one(edge, empty):
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 9, 10]
    assert ngram_join.keep_one(empty).collect() == []


def test_long_merge_and_heap_agree():
    rng = random.Random(1)
    sets = [np.unique(np.array(rng.sample(range(60), 30), dtype=np.uint64)) for _ in range(80)]
    results = []
    for most in (0, 10**9):
        ngram_join.Lists.HEAP_MOST = most
        lists = ngram_join.Lists(sorted(sets, key=len))
        results.append([sorted(lists.partners(x, 0, len(sets), 40, lambda y: False)) for x in range(len(sets))])
    ngram_join.Lists.HEAP_MOST = 2_000
    by_size = sorted(sets, key=len)
    expected = [[y for y in range(len(sets)) if y != x and 100 * len(np.intersect1d(by_size[x], by_size[y])) >= 40 * len(np.union1d(by_size[x], by_size[y]))] for x in range(len(sets))]
    assert results[0] == results[1]
    # A search takes partners at least as large as the first of its range.
    assert results[0] == expected


def test_words_are_cut_alike_in_pieces(monkeypatch):
    from framewright.llm import _text

    text = np.frombuffer("été a b\tc  dd\n".encode() * 50, dtype=np.uint8)
    whole = word_hashes(text)
    monkeypatch.setattr(_text, "PIECE", 7)
    assert (word_hashes(text) == whole).all()
    assert len(whole) == 250


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_enough_parts_are_posted_at_every_size(percent):
    for a in range(1, 140):
        for b in range(a, 100 * a // percent + 1):
            # The most elements in which linked sets of these sizes differ, by the definition of a link.
            differ = max((a + b - 2 * k for k in range(1, a + 1) if 100 * k >= percent * (a + b - k)), default=None)
            if differ is None:
                continue
            level = b.bit_length() - 1
            assert ngram_join.parts_of(level, percent) > differ, (a, b)
            for n in (a, b):
                most = min(100 * n // percent, (2 << level) - 1)
                assert ngram_join.most_spoiled(n, most, percent) >= differ, (a, b)


def test_appended_and_removed_words_meet_at_every_size():
    rng = np.random.default_rng(4)
    for n in range(1, 131):
        for _ in range(30):
            base = rng.integers(0, 2**63, 100 * n // 85, dtype=np.uint64)
            short = set(ngram_join.part_hashes(np.sort(base[:n]), 85).tolist())
            for more in range(n, len(base) + 1):
                assert short & set(ngram_join.part_hashes(np.sort(base[:more]), 85).tolist()), (n, more)


def test_one_word_appended_to_a_short_text(spark):
    docs = [(1, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (3, "q b c d e f g h i j k")]
    got = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs) == {1: (6, 1), 2: (7, 1), 3: (8, 3)}


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 85, 90, 95])
def test_bounds_of_spoiled_parts_at_all_sizes_to_2000(percent):
    sizes = np.arange(1, 2_001)
    for at in range(0, 12):
        low, high = 1 << at, (2 << at) - 1
        worst = 0
        for n in sizes[(sizes >= -(-percent * low // 100)) & (sizes <= high)].tolist():
            b = np.arange(max(low, -(-percent * n // 100)), min(high, 100 * n // percent) + 1)
            if len(b):
                differ = n + b - 2 * -(-percent * (n + b) // (100 + percent))
                worst = max(worst, int(differ.max()))
                assert ngram_join.most_spoiled(n, int(b[-1]), percent) >= differ.max(), n
        assert ngram_join.parts_of(at, percent) > worst, at


def test_every_word_count_to_70(spark):
    rng = random.Random(11)
    docs, i = [], 0
    for n in range(1, 71):
        for kind in range(3):
            base = [f"n{n}k{kind}w{j}" for j in range(n)]
            docs.append((i, " ".join(base)))
            for change in range(1, max(2, n // 5) + 1):
                w = list(base)
                if kind == 0:
                    w += [f"more{n}.{j}" for j in range(change)]
                elif kind == 1:
                    w = w[: max(1, n - change)]
                else:
                    w[rng.randrange(n)] = f"other{n}.{change}"
                docs.append((i + change, " ".join(w)))
            i += 100
    got = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    expected = {}
    for start in range(0, i, 100):
        expected |= brute([d for d in docs if start <= d[0] < start + 100])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_null_and_text_ids(spark):
    a, b = "one two three four five six", "p q r s t u v w x y z"
    rows = [(None, a), (None, a), ("k2", b), ("k10", b), (None, b), ("z", None), (None, None), ("y", "lone words")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.class_id) for r in got))) == sorted(map(str, [(None, 3, None, None)] * 2 + [("k2", 8, "k10", "k10"), ("k10", 8, "k10", "k10"), (None, 8, "k10", "k10"), ("z", 0, "z", "z"), (None, 0, None, None), ("y", 1, "y", "y")]))
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, [(None, a), ("k10", b), ("z", None), (None, None), ("y", "lone words")]))
    rows = [(None, a), (5, a + " seven eight nine ten"), (3, a), (None, a), (None, "")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got if r.n_shingles) == [("3", 3), ("5", 5), ("None", 3), ("None", 3)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert sorted(str(tuple(r)) for r in kept) == sorted(str(r) for r in (rows[1], rows[2], rows[4]))


def test_words_built_to_collide_differ():
    turns = ["a"]
    for _ in range(11):
        turns = [turns[0] + turns[0].translate(str.maketrans("ab", "ba"))]
    word = turns[0]
    other = word.translate(str.maketrans("ab", "ba"))
    h = word_hashes(np.frombuffer(f"{word} {other} {word}".encode(), dtype=np.uint8))
    assert h[0] != h[1] and h[0] == h[2]
