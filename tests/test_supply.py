from __future__ import annotations

import random

import numpy as np
import pytest

from framewright.operators import planning, supply, tiles


def test_sources_of_loads(spark):
    cold = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "c"), (1, 1, 3, "b"), (1, 1, 4, "a")], "stream long, frame long, ord long, key string")
    dictionary = spark.createDataFrame([("a", 7)], "key string, index int")
    budgets = spark.createDataFrame([(1, 0, 1)], "stream long, frame long, given int")
    got = supply.sourced(cold, dictionary, budgets).orderBy("ord").collect()
    assert [(r.source, r["index"]) for r in got] == [(2, 7), (1, -1), (0, -1), (0, -1), (2, 7)]


def test_replays_and_caps():
    loads, lengths, slots = [0, 3, 9, 1, 0, 8], [0, 900, 900, 3_000, 100, 100], [2, 4, 4, 4, 4, 4]
    route = planning.ring_schedule(loads, lengths, slots, ring=12, per_slot=4, unit=2_048)
    control, payload = zip(*route, strict=True)
    levels = supply.replay(loads, lengths, list(control), list(payload), 21, 4, 2_048)
    assert min(min(x) for x in levels) >= 0
    with pytest.raises(ValueError, match="frame 2: payload"):
        supply.replay([0, 3, 99], [0, 0, 0], [0, 0, 0], [2, 0, 1], 90, 4, 2_048)
    with pytest.raises(ValueError, match="overflows"):
        supply.replay([0], [0], [0], [9], 8, 4, 2_048)
    assert supply.largest_cap([4, 9, 2, 7], lambda x: sum(x) <= 15) == 4
    assert supply.largest_cap([], lambda x: True) == 0


def test_refills():
    rng = random.Random(5)
    for _ in range(40):
        spare = [rng.randint(0, 2) for _ in range(8)]
        runs = sorted((rng.randint(1, 7), rng.randint(1, 6)) for _ in range(12))
        sent, moved = supply.refilled(spare, runs, 8, 20, 4)
        for f in range(8):
            total = sum(runs[k][1] for k in range(12) if sent[k] == f)
            assert total % 8 == 0 and total <= 8 * spare[f]
        assert all(s < 0 or s < g <= s + 4 for s, (g, _) in zip(sent, runs, strict=True))
        level = 0
        for f in range(8):
            level += sum(n for k, (_, n) in enumerate(runs) if sent[k] == f)
            assert level <= 20
            level -= sum(n for k, (g, n) in enumerate(runs) if g == f and sent[k] >= 0)


def test_decisions(spark):
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 256, 64, dtype=np.uint8) for _ in range(4)]
    own = supply.Decider(slots=16, near=2.0)
    frame = {c: base[c % 4].tobytes() for c in range(6)}
    first = own.frame(frame, 3 * 34 + 2, 9, 0)
    assert sorted(first.values()) == ["loaded"] * 3 + ["missed"] * 2 + ["reused"]
    missed = {c for c, v in first.items() if v == "missed"}
    second = own.frame(frame, 34 + 2, 9, 1)
    assert {c for c, v in second.items() if v in ("loaded", "reused")} == missed
    assert set(own.frame(frame, 0, 9, 2).values()) == {"same"}
    close = dict(frame)
    close[0] = np.clip(base[0].astype(int) + 1, 0, 255).astype(np.uint8).tobytes()
    assert own.frame(close, 2, 9, 3)[0] == "near"
    rows = [(s, f, c, rng.integers(0, 256, 64, dtype=np.uint8).tobytes()) for s in range(2) for f in range(5) for c in range(6)]
    got = supply.decided(spark.createDataFrame(rows, "stream long, frame long, cell long, key binary"), 32, 2.0, 70, 1)
    counts = {(r.stream, r.frame): r["count"] for r in got.where("category = 'loaded'").groupBy("stream", "frame").count().collect()}
    assert got.count() == 60 and set(counts.values()) == {1}


def test_perceptual_and_global_palettes():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 200, (5, 64, 3))
    b = a.copy()
    b[1] += 3
    b[2, 0] += 40
    b[3, :, 0] += 30
    assert tiles.perceptual(a, b, 4, 10, 5).tolist() == [True, True, False, False, True]
    h = np.zeros((8, 512))
    h[:4, :10] = 5
    h[4:, 400:412] = 5
    found, group = tiles.global_palettes(h, 2)
    assert len(set(group[:4])) == 1 == len(set(group[4:])) and group[0] != group[4]
    assert {0, 9} <= set(tiles.keys_of(found[group[0]].astype(int)).tolist())


def test_stretch_points():
    from framewright.operators.stats import stretch_points

    levels = [10] * 256
    assert stretch_points(levels) == (0, 255)
    levels[7], levels[250] = 900, 900
    assert stretch_points(levels) == (7, 250)
    levels[17] = 2_000
    assert stretch_points(levels)[0] == 0
    assert stretch_points([0] * 256) == (0, 255)


def test_mapping_noise(spark):
    palettes = {0: np.zeros((15, 3), int), 1: np.full((15, 3), 7)}
    t = spark.createDataFrame([(0, 0, [0] * 64), (0, 1, [0] * 60 + [511] * 4)], "frame long, cell int, keys array<smallint>")
    lines = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "frame long, cell int, line int")
    got = tiles.mapping_noise(t, lines, tiles.nearest_lut(spark, palettes)).collect()
    assert [(r["key"], r.a, r.b, r.noise) for r in got] == [(0, 0, 1, 60 * 147)]
