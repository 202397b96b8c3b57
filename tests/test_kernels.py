"""Numpy kernels against plain definitions, and their DataFrame forms."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.operators import motion, planning, signal, tiles


def image(seed, h=32, w=40):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_ordered_matrix_is_bayers():
    m = tiles.ordered_matrix()
    assert m[:2, :2].tolist() == [[0, 32], [48, 16]] and sorted(m.ravel()) == list(range(64))


def test_quantize_by_definition():
    rgb = image(1)
    assert np.abs(tiles.quantize(rgb) - rgb.astype(float) * 7 / 255).max() <= 0.5
    assert np.abs(tiles.quantize(rgb, "bayer") - rgb.astype(float) * 7 / 255).max() < 1
    flat = np.full((64, 64, 3), 100, np.uint8)
    assert abs(tiles.quantize(flat, "bayer").mean() - 100 * 7 / 255) < 0.02
    assert (tiles.quantize(flat, "edge") == tiles.quantize(flat, "bayer")).all()
    edge = flat.copy()
    edge[:, 32:] = 255
    assert (tiles.quantize(edge, "edge")[:, 30:34] == tiles.quantize(edge)[:, 30:34]).all()
    y = tiles.luma(rgb)
    assert tiles.luma_range(rgb)[5, 7] == y[4:7, 6:9].max() - y[4:7, 6:9].min()
    with pytest.raises(ValueError):
        tiles.quantize(rgb, "other")


def test_nearest_table_exhaustively():
    palette = np.random.default_rng(2).integers(0, 8, (15, 3))
    error, index = tiles.nearest_table(palette)
    for key in range(512):
        rgb = (key >> 6, key >> 3 & 7, key & 7)
        costs = [sum((a - b) ** 2 for a, b in zip(rgb, p, strict=True)) for p in palette.tolist()]
        assert error[key] == min(costs) and index[key] == costs.index(min(costs))


def test_learned_palette_serves_its_colours():
    hist = np.zeros(512)
    keys = np.random.default_rng(3).choice(512, 15, replace=False)
    hist[keys] = np.arange(1, 16) * 10
    palette = tiles.learn_palette(hist)
    assert set(tiles.keys_of(palette.astype(int)).tolist()) == set(keys.tolist())
    assert len(tiles.learn_palette(np.zeros(512))) == 15


def test_seams_only_lower_the_energy():
    rng = np.random.default_rng(4)
    palettes = rng.integers(0, 8, (3, 15, 3)).astype(np.uint8)
    keys = rng.integers(0, 512, (12, 64))

    def energy(line):
        shown = np.stack([palettes[k][tiles.nearest_table(palettes[k])[1][keys[c]]] for c, k in enumerate(line)]).astype(int)
        d = (shown - tiles.LEVELS[keys]).reshape(3, 4, 8, 8, 3)
        own = sum(tiles.nearest_table(palettes[k])[0][keys[c]].sum() for c, k in enumerate(line))
        return own + ((d[1:, :, 0] - d[:-1, :, 7]) ** 2).sum() + ((d[:, 1:, :, 0] - d[:, :-1, :, 7]) ** 2).sum()

    plain, _ = tiles.seam_coherent(keys, palettes, 3, 4, weight=0)
    smooth, index = tiles.seam_coherent(keys, palettes, 3, 4)
    assert energy(smooth) <= energy(plain) and index.min() >= 1


def test_canonical_order_shows_the_same():
    rng = np.random.default_rng(5)
    palettes = rng.integers(0, 8, (4, 15, 3)).astype(np.uint8)
    line, index = rng.integers(0, 4, 20), rng.integers(1, 16, (20, 64))
    p, li, ix = tiles.canonical_order(palettes, line, index)
    assert (p[li[:, None], ix - 1] == palettes[line[:, None], index - 1]).all()


def test_best_scale():
    palette = np.random.default_rng(6).integers(0, 8, (15, 3))
    shown = np.arange(15)
    step, error = tiles.best_scale(palette, shown, (palette * 40 + 32) // 64, preferred=40)
    assert error == 0 and ((palette * step + 32) // 64 == (palette * 40 + 32) // 64).all()


def test_tiles_in_spark(spark):
    rgb = [image(k, 16, 24) for k in range(3)]
    rgb[1][:8, :8] = rgb[0][:8, :8]
    df = spark.createDataFrame(pd.DataFrame({"frame": range(3), "height": 16, "width": 24, "pixels": [x.tobytes() for x in rgb]}))
    t = tiles.tiles(df)
    got = {(r["frame"], r["cell"]): r["keys"] for r in t.collect()}
    expected = tiles.cut(tiles.keys_of(tiles.quantize(rgb[2])))
    assert len(got) == 18 and got[2, 4] == expected[4].tolist()
    assert [r.changed for r in tiles.changed_cells(t).orderBy("frame").collect()] == [0, 5, 6]
    palettes = {k: np.random.default_rng(k).integers(0, 8, (15, 3)) for k in range(3)}
    lines = {r.cell: (r.line, r.error) for r in tiles.assign_lines(t, tiles.nearest_lut(spark, palettes)).where("frame = 2").collect()}
    for cell, keys in enumerate(expected):
        costs = [int(tiles.nearest_table(p)[0][keys].sum()) for p in palettes.values()]
        assert lines[cell] == (costs.index(min(costs)), min(costs))
    packed = spark.range(1).select(tiles.pack_nibbles(F.array(*[F.lit(x) for x in (1, 15, 0, 7)])).alias("b")).first().b
    assert bytes(packed) == b"\x1f\x07"


def plain_adpcm(pcm, p=0, i=0):
    codes = []
    for s in pcm:
        step, d, code = int(signal.STEPS[i]), s - p, 0
        if d < 0:
            code, d = 8, -d
        add = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            if d >= part:
                code, d, add = code | bit, d - part, add + part
        p = max(-32_768, min(32_767, p + (-add if code & 8 else add)))
        i = max(0, min(88, i + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
        codes.append((code, p))
    return codes


def test_adpcm_equals_its_definition(spark):
    rng = np.random.default_rng(7)
    pcm = np.concatenate([np.rint(np.sin(np.arange(300) / 7) * 20_000), rng.integers(-32_768, 32_768, 300)]).astype(np.int64)
    plain = plain_adpcm(pcm.tolist())
    packed, p, i = signal.adpcm_encode(pcm)
    assert [b & 15 for b in packed] == [c for c, _ in plain[::2]] and [b >> 4 for b in packed] == [c for c, _ in plain[1::2]]
    chunks = signal.adpcm_chunks(pcm, 60)
    df = spark.createDataFrame(pd.DataFrame({"stream": 1, "chunk": range(10), "data": chunks}))
    back = np.concatenate([r.pcm for r in signal.decode_chunks(df).orderBy("chunk").collect()])
    assert back.tolist() == [v for _, v in plain]
    with pytest.raises(ValueError):
        signal.adpcm_chunks(pcm, 7)


def test_spectrum_finds_a_tone():
    rate = 22_050
    tone = np.rint(np.sin(2 * np.pi * 1_000 * np.arange(4_096) / rate) * 16_000)
    levels = signal.spectrum(tone, rate, 2_048, 32_768)
    edges = np.geomspace(40, 11_025, 25)
    assert edges[levels.argmax()] <= 1_000 <= edges[levels.argmax() + 1] and levels.max() > 0.85
    assert (signal.spectrum(np.zeros(10), rate, 0, 32_768) == 0).all()


def test_retime_and_sign_magnitude():
    assert signal.retime(np.array([0, 10]), 5).tolist() == [0, 2, 5, 8, 10]
    assert signal.sign_magnitude(np.array([0, 32_767, -1, -32_768, 256])).tolist() == [0, 127, 129, 254, 1]


def test_huffman_round_trip(spark):
    rng = random.Random(8)
    rows = [(k, bytes(rng.choices(b"aaaaabbc\x00\xff", k=rng.randint(0, 50)))) for k in range(20)]
    packed, codes = signal.huffman(spark.createDataFrame(rows, "k long, data binary"), "k", "data")
    assert sum(2.0**-n for _, n in codes.values()) == 1
    assert {r.k: signal.huffman_decode(bytes(r.packed), r.bits, codes) for r in packed.collect()} == dict(rows)
    assert signal.code_lengths([0, 5] + [0] * 254) == {1: 1}


def test_motion_finds_shifts(spark):
    rng = np.random.default_rng(9)
    world = rng.integers(0, 256, (120, 160, 3)).astype(np.uint8)
    view = lambda dx, dy: np.ascontiguousarray(world[10 + dy : 106 + dy, 20 + dx : 132 + dx])
    limits = motion.Limits(shift=8, block=16, stride=4, blocks=4)
    still, right, down = motion.motion(view(0, 0), view(0, 0), limits), motion.motion(view(0, 0), view(5, 0), limits), motion.motion(view(0, 0), view(0, -3), limits)
    assert (still["axis"], still["accepted"]) == ("none", False)
    assert (right["axis"], right["delta"], right["accepted"]) == ("x", -5, True)
    assert (down["axis"], down["delta"], down["accepted"]) == ("y", 3, True)
    cut = motion.motion(view(0, 0), image(11, 96, 112), limits)
    assert not cut["accepted"] and cut["cut"]
    frames = [view(2 * k, 0) for k in range(7)]
    df = spark.createDataFrame(pd.DataFrame({"frame": range(7), "height": 96, "width": 112, "pixels": [f.tobytes() for f in frames]}))
    got = motion.transitions(df, limits, run_rows=3).orderBy("frame").collect()
    assert [(r.frame, r.delta, r.accepted) for r in got] == [(k, -2, True) for k in range(1, 7)]


def test_fades(spark):
    picture = image(12, 16, 16) // 2 + 100
    scales = [1, 1, 0.7, 0.4, 0.1, 0, 0, 0.25, 0.5, 0.75, 1, 1]
    frames = [(1, k, 16, 16, np.rint(picture * s).astype(np.uint8).tobytes()) for k, s in enumerate(scales)]
    df = spark.createDataFrame(frames, "stream long, frame long, height int, width int, pixels binary")
    got = sorted((r.kind, r.start, r.stop) for r in motion.fades(df).collect())
    assert ("in", 6, 11) in got and any(k == "out" and a <= 1 and b == 6 for k, a, b in got)


def test_residency():
    pool = planning.Residency(3)
    assert [x[2:] for x in pool.frame([(0, "a"), (1, "b"), (2, "a")], 0)] == [(0, True), (1, True), (0, False)]
    assert [x[2:] for x in pool.frame([(1, "c")], 1)] == [(2, True)]
    assert pool.prefetch("d", 1, 5) is None
    assert [x[2:] for x in pool.frame([(0, "c")], 2)] == [(2, False)]
    assert pool.prefetch("e", 3, 6) == (1, True) or pool.prefetch("e", 3, 6) == (1, False)
    assert pool.tearing == 0
    pool.frame([(3, "f")], 4)
    assert "e" not in pool.slot_of and pool.tearing == 0
    pool.frame([(4, "g"), (5, "h")], 5)
    assert pool.tearing > 0


def test_demand_dry_run(spark):
    def bytes_of(frames):
        rows = [(0, f, c, c, k) for f, keys in enumerate(frames) for c, k in enumerate(keys)]
        df = spark.createDataFrame(rows, "stream long, frame long, ord long, cell long, key string")
        return [r.bytes for r in planning.demand(df, 8).orderBy("frame").collect()]

    assert bytes_of([["a", "b"], ["a", "a"]]) == [0, 2]
    assert bytes_of([["a"], ["b"]]) == [0, 34]


def test_balanced_demand():
    rng = np.random.default_rng(13)
    for _ in range(40):
        demand, supply = rng.integers(0, 30, 25), rng.integers(0, 20, 25)
        floor = np.minimum(demand, supply // 2)
        planned = planning.balanced(demand, supply, 25, floor)
        assert (planned >= floor).all() and (planned <= demand).all()
        draw = 0
        for d, s in zip(planned, supply, strict=True):
            draw = max(0, draw + d - s)
            assert draw <= 25
    with pytest.raises(ValueError):
        planning.balanced(np.array([90]), np.array([0]), 10, np.array([90]))


def test_subsets_by_brute_force():
    rng = random.Random(14)
    for _ in range(60):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(0, 8))]
        scores = [(rng.randint(0, 5), rng.randint(0, 5)) for _ in sizes]
        amount = rng.randint(0, 20)
        fitting = [[k for k in range(len(sizes)) if m >> k & 1] for m in range(1 << len(sizes)) if sum(n for k, n in enumerate(sizes) if m >> k & 1) == amount]
        got, best = planning.exact_subset(sizes, amount), planning.best_subset(sizes, scores, amount)
        assert (got is not None) == bool(fitting) == (best is not None)
        if fitting:
            assert sum(sizes[k] for k in got) == amount == sum(sizes[k] for k in best)
            total = lambda s: tuple(map(sum, zip(*(scores[k] for k in s), strict=True))) or (0, 0)
            assert total(best) == max(map(total, fitting))
        horizon = planning.least_horizon(sizes, amount)
        expected = next((k for k in range(len(sizes) + 1) if planning.exact_subset(sizes[:k], amount) is not None), None)
        assert horizon == expected


def test_water_fill_queue_and_ledger():
    assert planning.water_fill(4, [9, 5, 1], [0, 3, 0], [5, 5, 5]) == [1, 3, 0]
    assert planning.water_fill(9, [3, 3], [0, 0], [2, 1]) == [2, 1]
    assert planning.queue_replay([5, 9, 0], [2, 2, 9], 8) == [(3, 0, 0), (6, 0, 4), (0, 3, 0)]
    ledger = planning.Ledger(10)
    assert ledger.begin() == 10 and ledger.spend(7) and not ledger.spend(4)
    ledger.commit()
    assert ledger.begin() == 13 and ledger.largest(lambda n: 3 * n, 100) == 4
    assert ledger.spend(12)
    ledger.roll_back()
    assert ledger.begin() == 13


def test_ratchet():
    late, margin = planning.ratchet([(k, 50.0, False) for k in range(5)], 100, 20, 2, 0, 0)
    assert late == set() and margin == 20
    late, _ = planning.ratchet([(0, 50.0, False), (1, 230.0, False), (2, 10.0, True)], 100, 20, 2, 0, 0)
    assert late == {1}


def test_ring_schedule_meets_deadlines():
    loads, lengths, slots = [0, 3, 9, 1, 0, 8], [0, 900, 900, 3_000, 100, 100], [2, 4, 4, 4, 4, 4]
    out = planning.ring_schedule(loads, lengths, slots, ring=12, per_slot=4, unit=2_048)
    have_c = have_p = 0
    for k, (c, p) in enumerate(out):
        have_c, have_p = have_c + c, have_p + p
        assert c + p <= slots[k] and have_c * 2_048 >= sum(lengths[1 : k + 1]) and have_p * 4 >= sum(loads[: k + 2])
        assert have_p * 4 - sum(loads[: k + 1]) <= 12
    with pytest.raises(ValueError):
        planning.ring_schedule([0, 99], [0, 0], [1, 1], 400, 4, 2_048)


def test_filter_change_by_loops(spark):
    rng = np.random.default_rng(8)
    smooth = np.repeat(np.linspace(0, 90, 24)[:, None, None], 20, axis=1).repeat(3, axis=2) + rng.integers(0, 4, (24, 20, 3))
    source = smooth.astype(np.uint8)
    source[:, 12:] = np.minimum(source[:, 12:].astype(int) + 120, 255)
    filtered = (source // 16 * 16).astype(np.uint8)

    def under(kernel, image, y, x):
        h, w = image.shape
        mirror = lambda k, n: abs(k) if k < n else 2 * (n - 1) - k
        return sum(kernel[0][i][j] * image[mirror(y + i - 1, h), mirror(x + j - 1, w)] for i in range(3) for j in range(3)) / kernel[1]

    def every(kernel, image):
        return np.array([[under(kernel, image, y, x) for x in range(image.shape[1])] for y in range(image.shape[0])])

    turned = tuple(zip(*tiles.SLOPE[0], strict=True)), tiles.SLOPE[1]
    grey = [x @ np.array(tiles.LUMA) for x in (source.astype(float), filtered.astype(float))]
    slope = [np.sqrt(every(tiles.SLOPE, s) ** 2 + every(turned, s) ** 2) for s in (every(tiles.SMOOTH, g) for g in grey)]
    edge, flat = slope[0] > tiles.EDGE_ABOVE, slope[0] < tiles.FLAT_BELOW
    assert edge.any() and flat.any() and not (edge | flat).all()
    expected = [np.abs(filtered.astype(int) - source).mean(), np.abs(every(tiles.CHECKER, grey[1]))[flat].mean(), slope[1][edge].mean() / slope[0][edge].mean(), np.corrcoef(slope[0][edge], slope[1][edge])[0, 1]]
    rows = [(0, 24, 20, source.tobytes(), filtered.tobytes()), (1, 4, 4, bytes(48), bytes(48))]
    got = {r.frame: r for r in tiles.filter_report(spark.createDataFrame(rows, "frame long, height int, width int, pixels binary, filtered binary")).collect()}
    assert list(got[0])[1:] == pytest.approx(expected)
    assert tuple(got[1])[1:] == (0.0, 0.0, None, None)


def test_projected_tiles(spark):
    picture = np.arange(16 * 8 * 3, dtype=np.uint8).reshape(8, 16, 3)
    base = np.full((3, 8, 8, 3), 247, np.uint8).tobytes()
    rows = [(0, 8, 16, picture.tobytes(), "horizontal", -5, -5, base), (1, 8, 16, picture.tobytes(), "horizontal", 5, 5, base), (2, 8, 16, picture.tobytes(), "horizontal", 0, 0, None)]
    df = spark.createDataFrame(rows, "frame long, height int, width int, pixels binary, axis string, position long, delta long, base binary")
    got = {(r.frame, r.place): r for r in motion.projected(df, 2, 1).collect()}
    tile = lambda f, k: np.frombuffer(got[f, k].pixels, np.uint8).reshape(8, 8, 3)
    # Five of the incoming strip's columns are in the picture; the others keep what was there.
    assert (tile(0, 2)[:, :5] == picture[:, 11:16]).all() and (tile(0, 2)[:, 5:] == 247).all()
    assert (got[0, 2].row, got[0, 2].column, got[0, 2].guard, got[0, 2].shown) == (0, 2, True, 40)
    # Moved the other way, the first tile begins left of the picture, and the strip before it is hidden.
    assert (tile(1, 0)[:, :3] == 247).all() and (tile(1, 0)[:, 3:] == picture[:, :5]).all()
    assert (tile(1, 2) == 247).all() and (got[1, 2].column, got[1, 2].shown) == (-2, 0)
    assert (tile(2, 1) == picture[:, 8:]).all() and (tile(2, 2) == 0).all()
    with pytest.raises(ValueError):
        motion.world_cells("diagonal", 0, 0, 2, 1)
    down = motion.world_cells("vertical", 9, 1, 2, 3)
    assert down.tolist() == [[-2, 0], [-2, 1], [-1, 0], [-1, 1], [0, 0], [0, 1], [-3, 0], [-3, 1]]


def test_lists_of_each_group(spark):
    """Groups across Arrow batches, single rows, null keys and null values; no table for each group."""
    rng = random.Random(16)
    rows = [(rng.choice([None, *range(40)]), n, rng.choice([None, n])) for n in range(900)]
    want = {}
    for key, n, v in rows:
        want.setdefault(key, []).append(v)
    rng.shuffle(rows)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in (1, 7, 10_000):
            spark.conf.set(name, str(size))
            of = planning.of_each(spark.createDataFrame(rows, "k long, n long, v long"), "k", ["n"], "v", str, "s", "string")
            got = of.collect()
            assert {r.k: r.s for r in got} == {k: str(v) for k, v in want.items()} and len(got) == len(want)
    finally:
        spark.conf.set(name, before)
    assert "FlatMapGroups" not in of._jdf.queryExecution().executedPlan().toString()
