from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from framewright.llm import _common


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("edges_a_task", [7, 1_000_000])
def test_components(spark, edges_a_task):
    rng = random.Random(edges_a_task)
    chain = [(k, k + 1) for k in range(1_000, 1_060)]
    star = [(5_000, 5_000 - k) for k in range(1, 40)]
    loose = [(rng.randrange(-80, 80), rng.randrange(-80, 80)) for _ in range(60)]
    edges = [*chain, *star, *loose, (7, 7), (-(2**62), 2**62)] * 2
    got = _common.components(spark.createDataFrame(edges, "a long, b long"), edges_a_task=edges_a_task).collect()
    assert {r.node: r.root for r in got} == brute(edges) and max(Counter(r.node for r in got).values()) == 1
    assert _common.components(spark.createDataFrame([], "a long, b long"), edges_a_task=edges_a_task).collect() == []


def test_slots(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50)) for _ in range(500)]
    got = _common.slots(spark.createDataFrame(rows, "g string, v long"), "g", ["v"], "slot", 16)
    for g in ("a", "b", None):
        assert sorted(r.slot for r in got.collect() if r.g == g) == list(range(sum(x == g for x, _ in rows)))


def test_written_tables_keep_their_columns(spark):
    df = spark.createDataFrame([(1, None, [2])], "a long, b string, c array<int>")
    back = _common.written(df)
    assert back.schema.simpleString() == df.schema.simpleString() and back.collect() == df.collect()


def test_removed_tables_are_gone(spark, small_dir):
    from pathlib import Path

    df = _common.written(spark.range(10))
    folders = {Path(f.removeprefix("file:")).parent for f in df.inputFiles()}
    assert all(f.exists() for f in folders)
    _common.removed(df)
    assert not any(f.exists() for f in folders)
    _common.removed(spark.read.parquet(f"{small_dir}/region.parquet"))
    assert spark.read.parquet(f"{small_dir}/region.parquet").count() == 5


def test_slots_in_order(spark):
    from pyspark.sql import functions as F

    rows = [(k % 3, k) for k in range(1_000)]
    got = _common.slots(spark.createDataFrame(rows, "g long, v long"), "g", [F.col("v")], "slot", bucket=F.floor(F.col("v") / 77)).collect()
    assert all(r.slot == r.v // 3 for r in got)


@pytest.mark.parametrize("bound", [1, 1_000_000])
def test_filter_by_packed_ids(spark, bound):
    rng = random.Random(5)
    ids = [0, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63), *(rng.randrange(-500, 500) for _ in range(300))]
    rows = [(x, str(n)) for n, x in enumerate([None, *ids, *ids, *range(-520, 520)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(x,) for x in [None, *ids[::2], *ids[::2]]], "k long")
    for how, inside in (("left_semi", True), ("left_anti", False)):
        got = _common.filtered(df, "doc_id", asked, how, bound)
        assert got.columns == df.columns
        assert sorted(map(repr, got.collect())) == sorted(repr(r) for r in df.collect() if (r.doc_id in set(ids[::2])) == inside)


def test_filter_of_a_million_ids_moves_no_text(spark):
    """1,000,001 neighbouring ids are 15,626 packed rows: a broadcast, and no exchange of the texts."""
    docs = spark.range(0, 1_500_000, 1, 8).selectExpr("id as doc_id", "concat('text ', id) as text")
    got = _common.filtered(docs, "doc_id", spark.range(1_000_001), "left_anti")
    assert got.count() == 499_999
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_components_contract_without_star_steps(spark, monkeypatch):
    """Many repeated edges over few nodes, as the lists of many buckets give, are contracted task by task."""
    monkeypatch.setattr(_common, "_starred", None)
    edges = [(k % 50, (k * 7 + 1) % 50 + 100 * (k % 2)) for k in range(4_000)]
    got = _common.components(spark.createDataFrame(edges, "a long, b long").repartition(64), edges_a_task=400).collect()
    assert {r.node: r.root for r in got} == brute(edges)


def test_what_is_forgotten_leaves_the_shared_folder(spark):
    held = _common.durable(spark.range(1_000))
    path = held._jdf.logicalPlan().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    _common.forgotten(held)
    assert not os.path.exists(path)
