from __future__ import annotations

import numpy as np
import pytest

from framewright.operators import palettes, planning, tiles


def hists(seed, n, colours=30):
    rng = np.random.default_rng(seed)
    out = np.zeros((n, 512))
    for row in out:
        row[rng.choice(512, colours, replace=False)] = rng.integers(1, 50, colours)
    return out


def test_score_by_definition():
    h = hists(1, 2)
    p = np.stack([tiles.learn_palette(x) for x in h])
    pixel, noise = palettes.score(h, p)
    shown = [[min(row.tolist(), key=lambda c: sum((a - b) ** 2 for a, b in zip(c, k, strict=True))) for k in tiles.LEVELS.tolist()] for row in p.astype(int)]
    assert pixel == sum(h[k, c] * sum((a - b) ** 2 for a, b in zip(tiles.LEVELS[c].tolist(), shown[k][c], strict=True)) for k in range(2) for c in range(512))
    assert noise == sum(min(h[0, c], h[1, c]) * sum(abs(a - b) for a, b in zip(shown[0][c], shown[1][c], strict=True)) for c in range(512))


def test_shared_cores():
    p = palettes.with_shared_core(hists(2, 3), 5)
    assert p.shape == (3, 15, 3) and (p[0, :5] == p[1, :5]).all() and (p[0, :5] == p[2, :5]).all()


def test_refining_and_growing_lower_the_error():
    h = hists(3, 1)[0]
    start = np.zeros((15, 3), np.uint8)
    error = lambda p: float(h @ tiles.nearest_table(p)[0])
    assert error(palettes.refined(start, h)) < error(start)
    t = np.concatenate([hists(4, 1, 14).repeat(20, 0), hists(5, 1, 14).repeat(20, 0)])
    found, line = palettes.grown(t)
    assert len(found) >= 2 and len(set(line[:20])) == 1 == len(set(line[20:])) and line[0] != line[20]
    assert len(palettes.grown(hists(6, 1, 10).repeat(9, 0))[0]) == 1


def test_segments_in_spark(spark):
    h = hists(7, 3, 15)
    rows = [(s, int(k), int(h[s, k])) for s in range(3) for k in np.flatnonzero(h[s])]
    got = palettes.segment_palettes(spark.createDataFrame(rows, "segment long, key int, n long")).collect()
    for s in range(3):
        assert {r.key for r in got if r.segment == s} == set(np.flatnonzero(h[s]).tolist())


def test_gains():
    h = hists(8, 1)[0]
    assert palettes.switch_gain(h, tiles.learn_palette(h)) == 0 < palettes.switch_gain(h, np.zeros((15, 3), np.uint8))
    world = np.random.default_rng(9).integers(0, 256, (48, 64, 3), dtype=np.uint8)
    a, b = world[:, :56], world[:, 2:58]
    fixed, scrolled, rmse = palettes.scroll_gain(a, b, -2, 0)
    assert fixed == 42 and scrolled == 2 and rmse == 0


def test_budgets_lists_and_feasible_plans(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 2, "a"), (1, 2, 3, "c"), (1, 2, 4, "d"), (1, 2, 5, "a")]
    cold = spark.createDataFrame(rows, "stream long, frame long, ord long, key string")
    chosen, budgets = planning.frame_budgets(cold, cold.select("stream", "frame").distinct(), 1, 2)
    assert [r["key"] for r in chosen.collect()] == ["a"]
    assert {(r.parity, r.frame): r.given for r in budgets.collect()} == {(0, 0): 1, (0, 2): 1, (1, 1): 0}
    assert planning.cheaper_lists([1, 90], [0, 0], 140, 2, 4) == [True, False]
    with pytest.raises(ValueError):
        planning.cheaper_lists([1, 200], [0, 0], 140, 2, 4, [False, True])
    rng = np.random.default_rng(10)
    for _ in range(20):
        patterns, control = rng.integers(0, 300, 20), rng.integers(0, 4_000, 20)
        plan = planning.feasible(patterns, control, 200, 5, 64, 2_048)
        total, c = np.cumsum(np.append(0, plan[1:])), np.cumsum(np.append(0, control[1:]))
        ahead = np.append(total[1:], total[-1:])
        need = np.ceil(np.maximum(ahead - 192, 0) / 64) + np.ceil(c / 2_048)
        assert (need <= np.arange(20) * 5).all() and (plan[1:] <= patterns[1:]).all()
