from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import io
import random
import struct

import numpy as np
import pandas as pd
import pytest

from framewright.operators import loops, tiles
from framewright.sources import archives, control


def test_anchors_and_loops(spark):
    frames = [0, 1, 2, 3, 65_535, 0, 1, 2, 3]
    assert loops.anchor(frames, 4, 2) == (5, True)
    assert loops.anchor(frames[:4], 4, 2) == (0, False)
    with pytest.raises(ValueError):
        loops.anchor([0, 9, 9], 3, 2)
    seen = [7, 65_535, 0, 1, 2, 2, 50, 3, 4, 5, 6, 7, 8, 9, 0, 1, 2]
    rows = [(1, k, f, 5 + (k == 5), 0.5) for k, f in enumerate(seen)]
    df = spark.createDataFrame(rows, "stream long, place long, frame long, samples long, confidence double")
    got = loops.movie_groups(df, 3, 2).orderBy("place").collect()
    assert [(r.frame, r.loop) for r in got] == [*((f, 0) for f in range(10)), (0, 1), (1, 1), (2, 1)]
    assert 5 in [r.place for r in got] and 4 not in [r.place for r in got]


def test_scroll_segments(spark):
    rows = [(1, k, "x", d, ok) for k, (d, ok) in enumerate([(2, True), (2, True), (0, False), (3, True), (2, True), (9, True), (9, True), (1, True)])]
    df = spark.createDataFrame(rows, "stream long, frame long, axis string, delta int, accepted boolean")
    got = loops.scroll_segments(df, 2, 2, 1.0, 4).orderBy("start").collect()
    assert [(r.start, r.stop, r.transitions, r.moved) for r in got] == [(0, 5, 4, 9), (5, 7, 2, 18)]
    assert loops.movement_window([4, 4, 4, 4, 3], [2.0] * 5, {14}, 10, 8, 2, 1.0) == (10, 14)
    assert loops.movement_window([3, 3], [2.0] * 2, set(), 0, 8, 1, 1.0) is None


def test_control_blocks(spark):
    rng, cells = random.Random(1), 37
    blocks = []
    for f in range(40):
        kind = f % 5
        fade = kind in (control.FADE_IN, control.FADE_OUT)
        chosen = [] if fade else rng.sample(range(cells), rng.randint(0, 20))
        updates = [(c, rng.randrange(65_536)) for c in (chosen if kind in (control.LIST, control.SCROLL) else sorted(chosen))]
        blocks.append(control.Block(f, kind, updates, rng.randbytes(128) if fade else b"", (rng.randint(-90, 90), 5) if kind == control.SCROLL else (0, 0), rng.randbytes(11), [(rng.randrange(1_000), rng.randrange(200), 1) for _ in range(f % 4)]))
    coded = [control.encode(b, cells) for b in blocks]
    assert [control.decode(c, cells, 11) for c in coded] == blocks
    with pytest.raises(ValueError):
        control.decode(coded[0][:-1], cells, 11)
    df = spark.createDataFrame([(bytes(c),) for c in coded[::5]], "data binary")
    rows = control.parsed(df, cells, 11)
    assert {r.frame: [tuple(u) for u in r.updates] for r in rows.collect()} == {b.frame: b.updates for b in blocks[::5]}
    sounds = spark.createDataFrame([(b.frame, b.sound) for b in blocks], "frame long, sound binary")
    back = control.serialized(rows.join(sounds, "frame"), cells)
    assert {r.frame: bytes(r.data) for r in back.collect()} == {b.frame: c for b, c in zip(blocks[::5], coded[::5], strict=True)}


def test_archives(spark, tmp_path):
    with io.BytesIO() as out:
        np.savez(out, a=np.arange(3), b=np.ones(3))
        (tmp_path / "t.npz").write_bytes(out.getvalue())
    files = spark.read.format("binaryFile").load(str(tmp_path / "t.npz")).select("path", "content")
    assert [(r.frame, r.a, r.b) for r in archives.arrays(files, ["a", "b"]).orderBy("frame").collect()] == [(0, 0.0, 1.0), (1, 1.0, 1.0), (2, 2.0, 1.0)]
    log = spark.createDataFrame([("#format",), ("0,  0,  0,  1, 5184, abc",), ("",)], "value string")
    assert tuple(archives.frame_digests(log).first()) == (0, 0, 0, 1, 5184, "abc")
    nested = spark.createDataFrame([([(0, [(4, 1, bytes([1 + k % 15 for k in range(64)]))]), (1, [])], [0, 0])], archives.DECISIONS)
    assert [(r.frame, r.ord, r.cell) for r in archives.updates(nested).collect()] == [(0, 0, 4)]
    with pytest.raises(ValueError):
        archives.updates(spark.createDataFrame([([(0, [(4, 1, bytes(64))])], [0])], archives.DECISIONS))


def test_root_directory():
    def entry(name, sector, size):
        body = bytearray(33 + len(name) + (1 - len(name) % 2))
        body[0], body[32] = len(body), len(name)
        struct.pack_into("<I", body, 2, sector)
        struct.pack_into("<I", body, 10, size)
        body[33 : 33 + len(name)] = name
        return bytes(body)

    image = bytearray(20 * 2_048)
    image[16 * 2_048 + 1 : 16 * 2_048 + 6] = b"CD001"
    struct.pack_into("<I", image, 16 * 2_048 + 158, 18)
    struct.pack_into("<I", image, 16 * 2_048 + 166, 2_048)
    listing = entry(b"\0", 18, 2_048) + entry(b"\1", 18, 2_048) + entry(b"DATA.BIN;1", 19, 500)
    image[18 * 2_048 : 18 * 2_048 + len(listing)] = listing
    assert archives.root_directory(bytes(image)) == [("DATA.BIN", 19 * 2_048, 500)]
    with pytest.raises(ValueError):
        archives.root_directory(bytes(20 * 2_048))


def test_rendering_flicker_and_budgets(spark):
    rng = np.random.default_rng(2)
    palettes = {k: rng.integers(0, 8, (15, 3)) for k in range(2)}
    df = spark.createDataFrame([(0, 0, 1, [1, 15, 3])], "frame long, cell int, line int, indices array<smallint>")
    assert tiles.rendered(df, palettes).first()["keys"] == tiles.keys_of(palettes[1][[0, 14, 2]]).tolist()
    a, b = np.zeros((8, 8, 3), np.uint8), np.full((8, 8, 3), 9, np.uint8)
    c = a.copy()
    c[0] = 50
    frames = spark.createDataFrame(pd.DataFrame({"frame": range(3), "height": 8, "width": 8, "pixels": [x.tobytes() for x in (a, b, c)]}))
    assert [(r.frame, r.changed, r.back) for r in tiles.flicker(frames).orderBy("frame").collect()] == [(1, 64, 0), (2, 64, 56)]
    x = rng.normal(size=(8, 8))
    assert tiles.correlation(x, 3 * x + 1) == pytest.approx(1) and tiles.correlation(x, np.ones((8, 8))) == 0
    keys = [[[0] * 64, [511] * 64, [1] * 64], [[7] * 64, [511] * 64, [1] * 64]]
    t = spark.createDataFrame([(f, k, v) for f, cells in enumerate(keys) for k, v in enumerate(cells)], "frame long, cell int, keys array<smallint>")
    got = {(r.frame, r.cell) for r in tiles.most_changed(t, 2).where("sent").collect()}
    assert got == {(0, 1), (0, 2), (1, 0)}


def test_ratchet_sweep_reads_the_whole_trace(spark):
    import pyarrow.parquet as pq

    from framewright import catalog
    from framewright.operators import planning

    sf_dir = "/root/testdata/sf0.01"
    rows = sorted(pq.read_table(f"{sf_dir}/events.parquet").to_pylist(), key=lambda r: (r["ts"], r["event_id"]))
    assert len(rows) > 4_000
    steps = [(k, int(Decimal(str(r["value"] * 100)).quantize(Decimal(1), ROUND_HALF_UP)) / 4, r["event_type"] == "error") for k, r in enumerate(rows)]
    expected = set()
    for setup in (200, 400, 800, 1_600):
        for phase in (0, 250, 500):
            late, margin = planning.ratchet(steps, 1_668.3, 240.0, 2, float(setup), float(phase))
            expected.add((setup, phase, len(late), round(margin, 6)))
    got = catalog.queries()["o10_28_ratchet_sweep"](spark, sf_dir).collect()
    assert {(r.setup, r.phase, r.late, round(r.margin, 6)) for r in got} == expected
