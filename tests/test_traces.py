"""Golden traces, and random traces against plain folds; blocks of three rows make every hand-over between blocks happen."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewright.functions import scalars as fn
from framewright.operators import align, clamp, islands, ranking, scan, stats


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    for f in (scan.running, scan.neighbours, clamp.clamped):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 3))
    monkeypatch.setattr(scan.blocked, "__defaults__", (3,))


def trace(spark, **columns):
    names = list(columns)
    rows = [(k, *row) for k, row in enumerate(zip(*columns.values(), strict=True))]
    kinds = ["string" if isinstance(v[0], str) else "double" if isinstance(v[0], float) else "boolean" if isinstance(v[0], bool) else "long" for v in columns.values()]
    return spark.createDataFrame(rows, "frame long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def listed(df, *columns, order="frame"):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy(order).select(*columns).collect()]


def test_running_and_neighbours_equal_folds(spark):
    rng = random.Random(1)
    rows = [(s, f, rng.choice([None, *range(-5, 9)])) for s in ("a", "b", None) for f in range(rng.randint(1, 25)) if rng.random() < 0.8 or f == 0]
    df = spark.createDataFrame(rows, "s string, frame long, v long")
    for reverse in (False, True):
        got = scan.running(df, "frame", {"sum": ("sum", F.col("v")), "n": ("count", F.col("v")), "max": ("max", F.col("v")), "min": ("min", F.col("v")), "last": ("last", F.col("v"))}, ("s",), reverse, 3)
        for s in ("a", "b", None):
            seen = []
            own = sorted((r for r in got.collect() if r.s == s), key=lambda r: r.frame, reverse=reverse)
            for r in own:
                seen += [r.v] if r.v is not None else []
                expected = (sum(seen), len(seen), max(seen), min(seen), seen[-1]) if seen else (None, 0, None, None, None)
                assert (r["sum"], r.n, r["max"], r["min"], r["last"]) == expected
    for ahead in (False, True):
        got = scan.neighbours(df, "frame", {"near": "v", "at": "frame"}, ("s",), ahead, 3)
        for s in ("a", "b", None):
            own = sorted((r for r in got.collect() if r.s == s), key=lambda r: r.frame, reverse=ahead)
            before = None
            for r in own:
                assert (r.near, r["at"]) == ((before.v, before.frame) if before else (None, None))
                before = r


def test_numbering(spark):
    df = spark.createDataFrame([(k, (k * 7919) % 101) for k in range(101)], "k long, t long")
    got = scan.numbered(df, ["t"], F.floor(F.col("t") / 10)).orderBy("t").collect()
    assert [r.frame for r in got] == list(range(101))


def test_ranges_and_transitions(spark):
    df = spark.createDataFrame([(k + 1, v) for k, v in enumerate((300, 256, 1, 400, 200))], "frame long, v long")
    assert sorted((r["first"], r["last"]) for r in islands.ranges_where(df, "frame", F.col("v") <= 256).collect()) == [(2, 3), (5, 5)]
    slips = spark.createDataFrame([(k + 1, v) for k, v in enumerate((0, 0, 1, 1, 3))], "frame long, v long")
    assert listed(islands.transitions(slips, "frame", "v", rises_only=True), "frame") == [3, 5]
    assert listed(islands.transitions(trace(spark, v=[0, 0, 1, 1, 1, 2]), "frame", "v"), "frame") == [2, 5]


def test_segments_and_switches(spark):
    assert sorted(tuple(r) for r in islands.segments(trace(spark, v=[0, 0, 1, 1, 1, 2]), "frame", "v").select("start", "stop").collect()) == [(0, 2), (2, 5), (5, 6)]
    df = trace(spark, seg=[0, 0, 0, 1, 1, 1], kind=[0, 1, 2, 0, 0, 1])
    assert listed(islands.switch_rows(df, "frame", "seg", F.col("kind") > 0), "frame") == [1, 2, 3, 5]


def test_palette_ranges(spark):
    flat = [0.0, 0.1, 1.0, 0.2, 0.0]
    assert islands.palette_ranges(flat, flat, gap=0) == [(0, 3), (3, 5)]
    dark, uniform = [0.0] * 9, [0.0] * 9
    dark[2], uniform[6] = 1.0, 1.0
    assert islands.palette_ranges(dark, uniform, gap=0, near=2) == [(0, 3), (3, 7), (7, 9)]
    assert islands.palette_ranges(dark, uniform, gap=0, near=2, most=2) == [(0, 3), (3, 9)]
    assert [r.boundary for r in islands.clusters(trace(spark, m=flat), "frame", "m", 0.9, 0).collect()] == [3]


def test_runs(spark):
    slots = spark.createDataFrame([(v,) for v in (1, 2, 7, 8, 9, 10, 20)], "v long")
    assert sorted(tuple(r) for r in islands.consecutive_runs(slots, "v").collect()) == [(1, 2), (7, 4), (20, 1)]
    for first, runs in ((254, 2), (256, 1)):
        df = trace(spark, slot=[10, 11, 12, 13], source=[2] * 4, dic_index=list(range(first, first + 4)))
        assert islands.source_runs(df, "frame").count() == runs
    runs = spark.createDataFrame([(0, 100, 48, 1, 0), (1, 200, 4, 2, 17)], "frame long, slot long, count long, source int, dic_index long")
    got = islands.split_ring_runs(runs, "frame", 2_688, 2_643).orderBy("frame", "part").collect()
    assert [(r.slot, r["count"], r.source, r.dic_index) for r in got] == [(100, 45, 1, 0), (145, 3, 1, 0), (200, 4, 2, 17)]
    assert got[-1].cursor_after == 3


def test_sessions_equal_a_fold(spark):
    rng = random.Random(2)
    rows, position = [], 0
    for k in range(200):
        position += rng.choice((1, 1, 1, 4))
        rows.append((k, position, rng.choice("ab")))
    got = listed(islands.sessions(spark.createDataFrame(rows, "frame long, p long, v string"), "frame", "v", "p", 2), "session")
    expected, n = [], 0
    for k, (_, p, v) in enumerate(rows):
        n += k == 0 or v != rows[k - 1][2] or p - rows[k - 1][1] > 2
        expected.append(n)
    assert got == expected


def test_peaks_after_triggers(spark):
    df = trace(spark, t=[False, True, False, False, True, False, False], s=[0, 2, 9, 4, 3, 8, 5])
    assert listed(islands.peak_after_trigger(df, "frame", F.col("t"), "s", 3), "frame") == [2, 5]
    df = trace(spark, t=[True, False, True, False], s=[1, 9, 8, 2])
    assert listed(islands.peak_after_trigger(df, "frame", F.col("t"), "s", 4), "frame") == [1, 2]
    relief = trace(spark, r=[40, 50, 60, 70, 80], p=[False, True, True, False, False], by=[1, 20, 90, 40, 50])
    assert listed(relief.select("frame", fn.relaxed(F.col("r"), F.col("p"), F.col("by")).alias("x")), "x") == [40, 30, 0, 70, 80]


def test_reserves(spark):
    for demand, supply, capacity, expected in (([0, 20, 20, 140, 20], 50, 100, [30, 60, 90, 0, 0]), ([0, 120, 120], 50, 100, [100, 70, 0])):
        assert listed(clamp.reserve_curve(trace(spark, d=demand), "frame", F.col("d"), F.lit(supply), capacity), "reserve") == expected
    df = trace(spark, d=[0, 140, 20, 20, 20], r=[90, 0, 0, 0, 0])
    assert listed(clamp.terminal_drain(df, "frame", F.col("d"), F.lit(50), "r"), "credit", "start_frame") == [(90, 1), (90, 1), (60, 1), (30, 1), (0, 1)]
    df = trace(spark, d=[0, 4, 4, 4], s=[0, 2, 2, 2])
    assert clamp.first_depletion(df, "frame", F.col("d"), F.col("s"), 4).first().frame == 2
    assert clamp.first_depletion(df, "frame", F.col("d"), F.col("s"), 40).first().frame == 4


def test_clamps_equal_folds(spark):
    rng = random.Random(3)
    steps = [rng.randint(-9, 9) for _ in range(60)]
    df = trace(spark, a=steps)
    r, expected = 4, []
    for a in steps:
        r = min(11, max(0, r + a))
        expected.append(r)
    assert listed(clamp.clamped(df, "frame", F.col("a"), 0, 11, 4), "clamped") == expected
    r, expected = 0, []
    for a in steps:
        r = max(0, r + a)
        expected.append(r)
    assert listed(clamp.draw(df, "frame", F.col("a")), "draw") == expected
    balance, expected = 7, []
    for a in steps:
        balance = min(10, balance + 3) - max(0, a)
        expected.append(balance)
    assert listed(clamp.capped_balance(df, "frame", F.lit(3), F.greatest(F.lit(0), F.col("a")), 10, 7), "balance") == expected
    lead, sectors = 0, [0]
    rate = [abs(a) % 4 for a in steps]
    for k in range(1, 60):
        out = max(max(0, steps[k]), rate[k] - lead)
        lead += out - rate[k]
        sectors.append(out)
    df = trace(spark, a=[max(0, a) for a in steps], r=rate)
    assert listed(clamp.rate_matched(df, "frame", F.col("a"), F.col("r")), "sectors") == sectors


def test_carried_rates(spark):
    frames = spark.range(11).withColumnRenamed("id", "frame")
    assert listed(clamp.rate_deltas(frames, "frame", [25], 8), "rate")[1:] == [3, 3, 3, 3, 3, 3, 3, 4, 3, 3]
    assert sum(listed(clamp.rate_deltas(spark.range(200).withColumnRenamed("id", "frame"), "frame", [5], 1), "rate")) == 995


def test_fifo_even_flags_and_just_in_time(spark):
    assert listed(clamp.fifo(trace(spark, r=[0, 4, 3, 5]), "frame", F.col("r"), 9), "useful") == [0, 4, 3, 2]
    flags = listed(spark.range(10).select("id", clamp.even_flag(F.col("id"), 3, 10).alias("f")), "f", order="id")
    assert sum(flags) == 3 and not any(a and b for a, b in zip(flags, flags[1:], strict=False))
    lengths = [500, 100, 2_000, 0, 5_000]
    need = have = 0
    expected = [0]
    for n in lengths[1:]:
        need += n
        k = max(0, -(-(need - have) // 2_048))
        have += k * 2_048
        expected.append(k)
    assert listed(clamp.just_in_time(trace(spark, n=lengths), "frame", F.col("n"), 2_048), "sectors") == expected


def test_rates(spark):
    df = trace(spark, u=[0, 2_048, 1_024, 3_072], p=[0, 2_048, 2_048, 4_096])
    per_slot = F.coalesce(F.expr("try_divide(u * 153600, p)"), F.lit(0.0)).cast("long")
    assert listed(df.select("frame", per_slot.alias("x")), "x") == [0, 153_600, 76_800, 115_200]
    df = trace(spark, u=[2_048, 2_048], p=[2_048, 6_144])
    assert df.agg((stats.ratio_of_sums(F.col("u"), F.col("p")) * 153_600).alias("x")).first().x == 76_800.0


def test_class_split(spark):
    flags = scan.running(trace(spark, f=[False, True, False, True]), "frame", {"n": ("count", F.when(F.col("f"), 1))}).select("frame", "n")
    df = scan.running(trace(spark, c=[2, 2]), "frame", {"stop": ("sum", F.col("c"))})
    assert listed(fn.class_split(df, flags, "frame", "c", "stop"), "raw", "other") == [(1, 1), (1, 1)]


def test_bridging_chains_and_overlaps(spark):
    df = trace(spark, v=[5.0, 0.0, 0.0, 5.0, 0.0, 9.0])
    got = listed(islands.bridge_gaps(df, "frame", F.col("v") > 0, "v", 2, 1.0), "bridged")
    assert got == [False, True, True, False, False, False]
    spans = spark.createDataFrame([(0, 3), (3, 5), (6, 8), (8, 9)], "start long, stop long")
    assert [r.chain for r in islands.connected(spans).orderBy("start").collect()] == [1, 1, 2, 2]
    spans = spark.createDataFrame([(0, 3), (3, 5), (6, 8), (10, 20), (12, 13), (21, 22)], "a long, b long")
    assert sorted(r.a for r in islands.drop_overlapping(spans, "a", "b").collect()) == [6, 21]


def test_dictionary_and_ranking(spark):
    uses = spark.createDataFrame([("a", 0, False), ("b", 1, False), ("a", 2, False), ("a", 3, False)], "k string, o long, p boolean")
    assert [r.k for r in ranking.dictionary(uses, "k", F.col("p"), "o", 1).collect()] == ["a"]
    assert ranking.greedy_groups([(5, 0, {1, 2}), (9, 3, {3}), (9, 1, {4, 5})], {0}, 4) == [1, 2]
    df = spark.createDataFrame([("x", 3), ("y", 1), ("x", 0), ("z", 2)], "k string, o long")
    assert [r.k for r in ranking.first_requests(df, "k", ["o"], 2).orderBy("place").collect()] == ["y", "x"]


def test_comparison(spark):
    a, b = trace(spark, x=[1, 2, 3]), trace(spark, x=[1, 2, 4])
    assert align.first_mismatch(a, b, "frame", "x").first().first_mismatch == 2
    assert align.first_mismatch(a, a.where("frame < 2"), "frame", "x").first().first_mismatch == 2
    assert align.first_mismatch(a, a, "frame", "x").first().first_mismatch is None
    got = {(r.scope, r.statistic): (r.main_value, r.candidate_value, r.comparison) for r in align.compare(a, b, "frame", ["x"]).collect()}
    assert got["movie", "sum"] == (6, 7, "increase") and got["timed", "count"] == (2, 2, "equal") and got["timed", "last"] == (3, 4, "increase")
    with pytest.raises(ValueError):
        align.attach(a, b.where("frame < 2").withColumnRenamed("x", "y"), F.lit("PASS"))


def test_as_of_joins(spark):
    rng = random.Random(4)
    events = sorted(rng.sample(range(60), 12))
    df, ev = spark.range(60).withColumnRenamed("id", "frame"), spark.createDataFrame([(e,) for e in events], "frame long")
    before = [max((e for e in events if e <= f), default=None) for f in range(60)]
    after = [min((e for e in events if e >= f), default=None) for f in range(60)]
    assert listed(align.as_of_frames(df, ev, "frame", "e"), "e") == before
    assert listed(align.as_of_frames(df, ev, "frame", "e", forward=True), "e") == after
    renamed = ev.withColumnRenamed("frame", "at")
    assert listed(align.as_of(df, renamed, "frame", "at", "e"), "e") == before
    assert listed(align.as_of(df, renamed, "frame", "at", "e", forward=True), "e") == after


def test_consensus_and_gates(spark):
    rows = [(1, "f", 5, 0.2), (1, "f", 4, 0.9), (1, "f", 5, 0.2), (1, "f", 4, 0.1), (2, "f", 7, 0.5), (2, "f", 3, 0.5)]
    got = stats.consensus(spark.createDataFrame(rows, "g long, field string, value long, c double"), ["g"], "field", "value", "c")
    assert {r.g: r.value for r in got.collect()} == {1: 4, 2: 3}
    df = spark.createDataFrame([(1, 5), (2, 50), (3, 500), (4, None)], "k long, m long")
    got = {r.k: (r.alert, r.passed) for r in stats.verdict(df, {"m": (10, 100)}).collect()}
    assert got == {1: ("PASS", True), 2: ("WARN", True), 3: ("FAIL", False), 4: ("FAIL", False)}


def test_percentiles_and_extrema(spark):
    import numpy as np

    rng = random.Random(5)
    values = [rng.randint(0, 99) for _ in range(38)]
    df = trace(spark, v=values)
    assert stats.nearest_rank(df, "v", 0.95).first().percentile == np.percentile(values, 95, method="nearest")
    assert stats.nearest_rank(df.where("false"), "v", 0.95).first().percentile == 0
    wide = {k: [rng.uniform(-300_000, 300_000) for _ in range(1 + 7 * k)] for k in range(5)}
    rows = [(k, v) for k, vs in wide.items() for v in vs] + [(None, 2.5), (None, 2.5), (9, None)]
    got = {r.k: r.p for r in stats.nearest_rank(spark.createDataFrame(rows, "k long, v double"), "v", 0.6, ("k",), "p").collect()}
    assert got == {k: np.percentile(vs, 60, method="nearest") for k, vs in wide.items()} | {None: 2.5, 9: 0.0}
    edges = np.rint(np.linspace(2, 37, 10)).astype(int)
    got = sorted(tuple(r) for r in stats.extrema(df, "frame", "v", 2, 37, 9).collect())
    assert got == [(k, min(values[a:b]), max(values[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def test_scalars(spark):
    df = spark.createDataFrame([("0x1F", " 12.5 ", "30000/1001", 125, "Ab c--D!")], "h string, n string, r string, s long, t string")
    r = df.select(fn.number(F.col("h"), True).alias("h"), fn.number(F.col("n")).alias("n"), fn.number(F.lit("x")).alias("x"), fn.ratio(F.col("r")).alias("r"), fn.clock(F.col("s")).alias("c"), fn.slug(F.col("t")).alias("t"), fn.decimal_text(F.lit(2.50)).alias("d"), fn.decimal_text(F.lit(100)).alias("i"), fn.wrap_difference(F.lit(3), F.lit(5)).alias("w")).first()
    assert (r.h, r.n, r.x, r.c, r.t, r.d, r.i, r.w) == (31.0, 12.5, None, "02:05", "ab-c-d", "2.5", "100", 14)
    assert r.r == pytest.approx(29.97003)
    flat = fn.flattened(spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, 2]}, "d": "x"}')], "k long, j string"), "j", ["k"])
    assert {x.path: x.value for x in flat.collect()} == {"a.b": "1", "a.c": "[1,2]", "d": "x"}
    with pytest.raises(ValueError):
        fn.cyclic_cap(F.lit(1), [2, 3], "2:170")


def test_carried_usage_outside_the_segments(spark):
    """Updates before the first segment, across its edges, and behind the last one."""
    updates = [(c, f, (c + f) % 3) for c in range(3) for f in range(c, 40, 4 + c)]
    segments = [(k, 7 + 5 * k, 12 + 5 * k) for k in range(3)]
    want = {}
    for c, f, key in updates:
        until = min((g for d, g, _ in updates if d == c and g > f), default=40)
        for k, start, stop in segments:
            if (n := min(until, stop) - max(f, start)) > 0:
                want[k, key] = want.get((k, key), 0) + n
    got = stats.carried_usage(spark.createDataFrame(updates, "cell long, frame long, key long"), spark.createDataFrame(segments, "segment long, start long, stop long"), "cell", "frame", "key", 40)
    assert {(r.segment, r.key): r.frames for r in got.collect()} == want


@pytest.mark.parametrize("cells", [1, 7, 1_024])
def test_nearest_by_brute_force(spark, cells):
    """Negative values, ties on both sides, equal values, empty buckets, nulls."""
    rng = random.Random(15)
    points = [(k, v) for k, v in enumerate([None, *(rng.choice([-3, 1]) * rng.randrange(0, 400) / 4 for _ in range(60))])]
    rows = [(k, v) for k, v in enumerate([None, *(rng.randrange(-1_600, 1_600) / 4 for _ in range(300))])]
    want = {}
    for k, w in rows:
        near = [(abs(w - v), p) for p, v in points if w is not None and v is not None and abs(w // 24 - v // 24) <= 1]
        if near:
            want[k] = min(near)
    got = align.nearest(spark.createDataFrame(rows, "row long, w double"), "w", spark.createDataFrame(points, "id long, v double"), "v", "id", 24, cells)
    assert got.columns == ["row", "w", "id", "distance"] and {r.row: (r.distance, r.id) for r in got.collect()} == want and got.count() == len(want) < 300


def test_nearest_meets_two_points_a_row(spark):
    """3,000 rows and 3,000 points of one bucket: no join of rows with points, which would make 9,000,000 pairs."""
    side = lambda name: spark.range(3_000).selectExpr(f"id as {name}", f"id % 240 + 0.25 as {name}_at")
    got = align.nearest(side("row"), "row_at", side("id"), "id_at", "id", 240)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2 and all("_cell" in x for x in joins) and got.where("distance = 0").count() == 3_000
