from __future__ import annotations

import zlib
from collections import Counter
from fractions import Fraction
from math import ceil, floor, log

import pytest
import xxhash

from framewright.llm import mixing, sharding
from framewright.llm.sharding import Leaf


def test_shards_contract(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = sharding.shards(docs).collect()
    assert len(got) == len(texts)
    slots: dict[int, list[int]] = {}
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        assert (r.region, r.rack) == (r.shard // 8, r.shard // 4)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def placed(keys, leaves, into="", added=()):
    from pyspark.sql import functions as F

    return sharding.with_descent(keys, F.col("id"), leaves, (f"{into}region", f"{into}rack", f"{into}shard"), tuple(added))


def test_a_changed_weight_moves_rows_only_below_it(spark):
    before = [Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 2.0), Leaf(0, 1, 2, 1.0), Leaf(1, 2, 3, 4.0), Leaf(2, 3, 4, 1.0), Leaf(2, 4, 5, 1.0)]
    for weight in (4.0, 1.0):
        after = [*before[:1], Leaf(0, 0, 1, weight), *before[2:]]
        rows = placed(placed(spark.range(20_000), before), after, "b_").collect()
        for leaves, column in ((before, "shard"), (after, "b_shard")):
            share, total = Counter(r[column] for r in rows), sum(x.weight for x in leaves)
            assert [share[x.shard] / 20_000 for x in leaves] == pytest.approx([x.weight / total for x in leaves], abs=0.02)
        moved = [r for r in rows if r.shard != r.b_shard]
        assert moved
        for r in moved:
            into, out = (r.b_region, r.region) if weight > 2 else (r.region, r.b_region)
            assert into == 0
            if out == 0:
                into, out = ((r.b_rack, r.rack), (r.b_shard, r.shard)) if weight > 2 else ((r.rack, r.b_rack), (r.shard, r.b_shard))
                assert into[0] == 0 and (into[1] != 0 or out[0] == 1)


@pytest.mark.parametrize("count", [1, 3, 13, 16, 17])
def test_a_new_branch_takes_rows_only_into_itself(spark, count):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    rows = sharding.shards(docs, count).collect()
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {count} and len(moved) == pytest.approx(20_000 / (count + 1), rel=0.15)
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == count and all(n == pytest.approx(20_000 / count, rel=0.15) for n in sizes.values())


def plain_place(key, leaves, added=()):
    """A key's path by loops, with the hash of a public library."""
    key = "\x00null" if key is None else str(key)

    def least(level, names):
        out = []
        for name, weight in names.items():
            h = 42
            for part in (key.encode(), level.encode(), name.to_bytes(4, "little")):
                h = xxhash.xxh64(part, seed=h).intdigest()
            out.append((-log(((h >> 11) + 0.5) / 2**53) / weight, name))
        return min(out)

    def children(level, of):
        names = {}
        for x in of:
            names[getattr(x, level)] = names.get(getattr(x, level), 0) + x.weight
        return least(level, names)

    top, region = children("region", leaves)
    for k, x in enumerate(added):
        if least("branch", {k: x.weight})[0] < top:
            return x.shard
    leaves = [x for x in leaves if x.region == region]
    _, rack = children("rack", leaves)
    return children("shard", [x for x in leaves if x.rack == rack])[1]


def test_placement_equals_plain_descent(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    new = Leaf(9, 9, 16)
    for r in sharding.shards(docs).collect():
        assert (r.shard, r.grown_shard) == (plain_place(r.doc_id, sharding.tree(16)), plain_place(r.doc_id, sharding.tree(16), [new]))
    uneven = [Leaf(0, 0, 0, 0.5), Leaf(0, 1, 1, 2.0), Leaf(1, 2, 2, 1.5), Leaf(1, 2, 3, 0.0), Leaf(1, 2, 4, 3.0)]
    alive = [x for x in uneven if x.weight]
    for r in placed(spark.createDataFrame([(None,), *((k,) for k in range(500))], "id long"), uneven).collect():
        assert r.shard == plain_place(r.id, alive)


def test_sharding_edges(edge, empty):
    got = sharding.shards(edge).collect()
    assert {r.doc_id: r["size"] for r in got}[1] == 1 and len(got) == 11
    assert len({(r.shard, r.slot) for r in got}) == 11
    assert sharding.shards(empty).collect() == []
    assert sharding.with_shard(edge).columns == edge.columns
    with pytest.raises(ValueError):
        sharding.with_shard(edge, 0)


@pytest.mark.parametrize("parts", [{"a": 1}, {"a": 3, "b": 5, "c": 2}, {"a": 900, "b": 99, "c": 1}, {k: 1 for k in "abcdefg"}])
def test_period_is_pfair(parts):
    period, slots = sum(parts.values()), mixing.period_slots(parts)
    assert sorted(x for s in slots.values() for x in s) == list(range(period))
    for s, own in slots.items():
        w = parts[s] / period
        assert all(floor(i * period / parts[s]) <= x < ceil((i + 1) * period / parts[s]) for i, x in enumerate(own))
        for t in range(period + 1):
            assert abs(t * w - sum(x < t for x in own)) < 1


def test_mixture(spark):
    rows = [(k, "x" * 5, s) for k, s in enumerate(["a"] * 70 + ["b"] * 41 + [None] * 5 + ["c"] * 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 0.5, "b": 0.3, None: 0.15, "c": 0.05, "unknown": 9.0}
    got = mixing.mixture(docs, weights=weights, block_rows=4, period=20).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert {(r.doc_id, r.source) for r in got} == {(k, s) for k, _, s in rows}
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.block), set()).add(r.slot)
        assert r.release <= r.slot < r.deadline
    assert all(len(s) == 1 for s in blocks.values())
    assert sorted(min(s) for s in blocks.values()) == list(range(len(blocks)))
    # While all sources last, each is less than a block off its share.
    first = [r for r in got if r.phase == 0]
    end = max(r.slot for r in first) + 1
    parts = mixing.whole_weights({s: weights[s] for s in ("a", "b", None, "c")}, 20)
    for s, w in parts.items():
        own = {r.slot for r in first if r.source == s}
        assert all(abs(t * w / 20 - sum(x < t for x in own)) < 1 for t in range(end + 1))
    order = sorted(got, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in got)


@pytest.mark.parametrize("most", [1, 7, 60, 1_000])
def test_blocks_grow_with_the_table(spark, most):
    rows = {"a": 331, "b": 120, None: 49, "c": 3}
    docs = spark.createDataFrame([(k, s) for k, s in enumerate(s for s, n in rows.items() for _ in range(n))], "doc_id long, source string")
    got = mixing.mixture(docs, block_rows=2, max_blocks=most).collect()
    size = max(2, ceil(503 / most))
    assert len({r.slot for r in got}) == sum(ceil(n / size) for n in rows.values()) <= max(most, 252) + len(rows)
    assert sorted(r.position for r in got) == list(range(503))
    assert all(r.release <= r.slot < r.deadline for r in got)
    for s, n in rows.items():
        held = Counter(r.block for r in got if r.source == s)
        assert held == {k: min(size, n - k * size) for k in range(ceil(n / size))}


def test_mixing_edges(edge, empty):
    assert sorted(r.position for r in mixing.mixture(edge).collect()) == list(range(11))
    assert mixing.mixture(empty).collect() == []
    assert mixing.mixed(empty).collect() == []
    out = mixing.mixed(edge)
    assert out.columns == edge.columns and sorted(map(str, out.collect())) == sorted(map(str, edge.collect()))


def test_mixed_rows_stand_in_the_order_of_the_schedule(spark, small_dir):
    from framewright.llm._common import written

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    order = [r.doc_id for r in mixing.mixture(docs).orderBy("position").collect()]
    assert [r.doc_id for r in mixing.mixed(docs).collect()] == order
    parts = sorted(written(mixing.mixed(docs)).inputFiles())
    assert [r.doc_id for p in parts for r in spark.read.parquet(p).collect()] == order


def test_too_many_sources_are_told(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="3 sources"):
        mixing.mixture(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, source string"))


def lags(weights, blocks):
    """The most any source is off its share, over all slots until the first share is used up."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    names, plan = mixing.schedule(blocks, mixing.exact_weights(weights))
    done, worst = dict.fromkeys(names, 0), 0
    for t in range(floor(min(blocks[s] * total / exact[s] for s in names)) + 1):
        worst = max(worst, *(abs(t * exact[s] / total - done[s]) for s in names))
        if t < len(plan["source"]):
            done[names[plan["source"][t]]] += 1
    return worst


def test_sources_keep_to_the_target_weights_themselves():
    rows = {f"s{k:02}": 1_000 for k in range(19)} | {"big": 9_500}
    weights = {s: n**0.5 for s, n in rows.items()}
    assert lags(weights, dict.fromkeys(rows, 500)) < 1
    assert lags({"third": 100.0} | {f"s{k}": 1.0 for k in range(200)}, {"third": 1_500} | {f"s{k}": 15 for k in range(200)}) < 1


def test_windows_hold_through_all_phases():
    blocks = {"a": 40, "b": 7, "c": 13, "d": 1, None: 90}
    weights = mixing.exact_weights({"a": 0.3, "b": 0.1, "c": 2**0.5, "d": 3.0, None: 1.0})
    names, plan = mixing.schedule(blocks, weights)
    assert Counter(names[k] for k in plan["source"]) == blocks
    assert all(r <= slot < d for slot, (r, d) in enumerate(zip(plan["release"], plan["deadline"], strict=True)))
    # The shares, slot by slot from their definition: what is left of a slot goes to the sources that have blocks left.
    share, done = dict.fromkeys(blocks, Fraction(0)), Counter()
    for slot, k in enumerate(plan["source"]):
        room = Fraction(1)
        while room:
            alive = [s for s in blocks if share[s] < blocks[s]]
            total = sum(weights[s] for s in alive)
            step = min(room, *((blocks[s] - share[s]) * total / weights[s] for s in alive))
            for s in alive:
                share[s] += step * weights[s] / total
            room -= step
        done[names[k]] += 1
        assert all(abs(share[s] - done[s]) < 1 for s in blocks), slot


def test_any_number_of_sources(spark):
    rows = [(k, f"s{k % 2_500}") for k in range(2_500)] + [(k, "big") for k in range(2_500, 7_500)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string"), weights={f"s{k}": 1.0 for k in range(2_500)} | {"big": 625.0}).collect()
    assert sorted(r.position for r in got) == list(range(7_500))
    assert all(r.release <= r.slot < r.deadline for r in got)
    slots = sorted({r.slot for r in got if r.source == "big"})
    assert all(abs((t + 1) / 5 - sum(x <= t for x in slots)) < 1 for t in range(0, 3_125, 25))


def test_slots_follow_a_position(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    places = {r.row.doc_id: r.position for r in mixing.with_position(docs).collect()}
    got = sharding.shards(mixing.with_position(docs).select("row.*", "position"), position_col="position").collect()
    assert {r.doc_id: r.shard for r in got} == {r.doc_id: r.shard for r in sharding.shards(docs).collect()}
    by_shard = {}
    for r in sorted(got, key=lambda r: places[r.doc_id]):
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(s == list(range(len(s))) for s in by_shard.values())
    none = mixing.with_position(docs.limit(0)).select("row.*", "position")
    assert sharding.shards(none, position_col="position").collect() == []


def test_rows_of_one_id_keep_one_order(spark):
    rows = [(7, f"text {k}", "a") for k in range(40)]
    orders = [[r.text for r in mixing.mixed(spark.createDataFrame(rows[::step], "doc_id long, text string, source string").repartition(n)).collect()] for step, n in ((1, 3), (-1, 5))]
    assert orders[0] == orders[1]
