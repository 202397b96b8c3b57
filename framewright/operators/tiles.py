"""Images as tiles: dithering, palettes, nearest-colour tables, line assignment. Kernels in numpy, one frame or group at a time.

A frame row is (frame, height, width, pixels): RGB bytes, row by row. A colour key is ``r * 64 + g * 8 + b`` of 3-bit channels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(512, 3)
MODES = ("nearest", "bayer", "edge")
EDGE_START, EDGE_FULL, EDGE_RADIUS = 32, 96, 1


def ordered_matrix(size: int = 8) -> np.ndarray:
    """The recursive ordered-dither matrix of a power of two."""
    m = np.zeros((1, 1), dtype=np.int64)
    while len(m) < size:
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    return m


def thresholds(height: int, width: int) -> np.ndarray:
    field = (ordered_matrix() + 0.5) / 64
    return field[np.arange(height)[:, None] % 8, np.arange(width)[None, :] % 8]


def _window(values: np.ndarray, radius: int, how) -> np.ndarray:
    views = np.lib.stride_tricks.sliding_window_view(np.pad(values, radius, mode="edge"), (2 * radius + 1,) * 2)
    return how(views, axis=(2, 3))


def luma(rgb: np.ndarray) -> np.ndarray:
    return (rgb.astype(np.int64) @ np.array([77, 150, 29]) + 128) >> 8


def luma_range(rgb: np.ndarray) -> np.ndarray:
    """Greatest minus least luma around each pixel (3 by 3, cut at the borders)."""
    y = luma(rgb)
    return _window(y, 1, np.max) - _window(y, 1, np.min)


def quantize(rgb: np.ndarray, mode: str = "nearest") -> np.ndarray:
    """RGB bytes to 3-bit levels: rounded, ordered dither, or ordered dither that fades out near strong edges."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}; one of {MODES}")
    if mode == "nearest":
        return ((rgb.astype(np.int64) * 7 + 127) // 255).astype(np.uint8)
    scaled = rgb.astype(np.float32) * np.float32(7 / 255)
    limit = thresholds(*rgb.shape[:2]).astype(np.float32)
    if mode == "edge":
        strongest = _window(luma_range(rgb), EDGE_RADIUS, np.max).astype(np.float32)
        amount = np.clip((EDGE_FULL - strongest) / np.float32(EDGE_FULL - EDGE_START), 0, 1)
        limit = 0.5 + (limit - 0.5) * amount
    base = np.floor(scaled)
    return np.clip(base + (scaled - base > limit[..., None]), 0, 7).astype(np.uint8)


def keys_of(levels: np.ndarray) -> np.ndarray:
    return levels.astype(np.int64) @ np.array([64, 8, 1])


def cut(image: np.ndarray, size: int = 8) -> np.ndarray:
    """(cells, size * size, ...) tiles, row-major; what does not fill a tile is left out."""
    rows, columns = image.shape[0] // size, image.shape[1] // size
    grid = image[: rows * size, : columns * size].reshape(rows, size, columns, size, *image.shape[2:])
    return grid.swapaxes(1, 2).reshape(rows * columns, size * size, *image.shape[2:])


def image_of(pixels: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 3)


def tiles(frames: DataFrame, mode: str = "nearest") -> DataFrame:
    """(frame, cell, keys): one row for each 8 by 8 tile of each frame, its 64 colour keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, h, w, px in pdf[["frame", "height", "width", "pixels"]].itertuples(index=False):
                own = cut(keys_of(quantize(image_of(px, h, w), mode)))
                yield pd.DataFrame({"frame": f, "cell": np.arange(len(own)), "keys": list(own.astype(np.int16))})

    return frames.mapInPandas(run, "frame long, cell int, keys array<smallint>")


def frame_features(frames: DataFrame, dark_below: int = 24, uniform_range: int = 8) -> DataFrame:
    """(frame, dark, uniform, detail): shares of dark pixels and of flat tiles, mean local luma range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, h, w, px in pdf[["frame", "height", "width", "pixels"]].itertuples(index=False):
                rgb = image_of(px, h, w)
                y = luma(rgb)
                flat = cut(y)
                rows.append((f, float((y < dark_below).mean()), float((np.ptp(flat, axis=1) <= uniform_range).mean()), float(luma_range(rgb).mean())))
            yield pd.DataFrame(rows, columns=["frame", "dark", "uniform", "detail"])

    return frames.mapInPandas(run, "frame long, dark double, uniform double, detail double")


def edge_steps(keys: str) -> Column:
    """For each of a tile's 64 keys the sum of channel differences to its neighbours (left, right, above, below) in the tile."""
    channel = lambda k, shift: F.shiftright(k.cast("int"), shift).bitwiseAND(7)
    apart = lambda a, b: sum((F.abs(channel(a, s) - channel(b, s)) for s in (3, 0)), F.abs(channel(a, 6) - channel(b, 6)))

    def step(k: Column, i: Column) -> Column:
        inside = ((i % 8 < 7, 1), (i % 8 > 0, -1), (i < 56, 8), (i >= 8, -8))
        return sum((F.when(is_in, apart(k, F.get(keys, i + by))).otherwise(0) for is_in, by in inside), F.lit(0))

    return F.transform(keys, step)


def edge_weight(step: Column, alpha: float) -> Column:
    """What a pixel counts in learning a palette: 1 on flat ground, more on edges (21 is the greatest step of a pixel pair)."""
    return 1 + alpha * step / F.lit(21.0)


def weighted_histogram(tiles_df: DataFrame, alpha: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, key, n): sums of edge weights instead of counts."""
    px = tiles_df.select(*keys, F.explode(F.arrays_zip(F.col("keys").alias("key"), edge_steps("keys").alias("step"))).alias("p"))
    return px.groupBy(*keys, F.col("p.key").cast("int").alias("key")).agg(F.sum(edge_weight(F.col("p.step"), alpha)).alias("n"))


def histogram(tiles_df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return tiles_df.select(*keys, F.explode("keys").alias("key")).groupBy(*keys, F.col("key").cast("int").alias("key")).agg(F.count("*").alias("n"))


def changed_cells(tiles_df: DataFrame) -> DataFrame:
    """(frame, changed, cells): how many cells differ from the frame before."""
    from pyspark.sql import Window as W

    before = F.lag("keys").over(W.partitionBy("cell").orderBy("frame"))
    return tiles_df.withColumn("_c", (before.isNotNull() & (before != F.col("keys"))).cast("int")).groupBy("frame").agg(F.sum("_c").alias("changed"), F.count("*").alias("cells"))


#: Weights of luma and of the two colour differences, and the limits of "near" and "fallback".
LUMA, BLUENESS, REDNESS = (0.299, 0.587, 0.114), (-0.169, -0.331, 0.5), (0.5, -0.419, -0.081)
NEAR, FALLBACK = (10.0, 28.0, 24.0), (120.0, 252.0, 200.0)


def perceptual(current: np.ndarray, candidate: np.ndarray, mean_luma: float = NEAR[0], max_luma: float = NEAR[1], mean_chroma: float = NEAR[2]) -> np.ndarray:
    """Which tiles (n, 64, 3) are near enough to stand for one another: by mean and greatest luma and mean chroma difference."""
    d = current.astype(np.float64) - candidate.astype(np.float64)
    y = np.abs(d @ np.array(LUMA))
    chroma = np.hypot(d @ np.array(BLUENESS), d @ np.array(REDNESS))
    return (y.mean(axis=1) <= mean_luma) & (y.max(axis=1) <= max_luma) & (chroma.mean(axis=1) <= mean_chroma)


def learn_palette(histogram_512: np.ndarray, colours: int = 15, rounds: int = 10) -> np.ndarray:
    """A palette of a weighted histogram: Lloyd rounds from the most frequent colours, snapped to levels; colours that fall
    together are replaced by the most frequent ones not yet taken (of equal ones the greater key first), then by black."""
    known = np.flatnonzero(histogram_512)
    ranked = known[np.argsort(histogram_512[known], kind="stable")[::-1]]
    points, weights = LEVELS[known].astype(np.float64), histogram_512[known].astype(np.float64)
    centres = np.zeros((colours, 3))
    centres[: min(colours, len(ranked))] = LEVELS[ranked[:colours]]
    for _ in range(rounds if len(known) else 0):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        mass = np.bincount(own, weights, colours)
        sums = np.stack([np.bincount(own, weights * points[:, c], colours) for c in range(3)], axis=1)
        moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
        done = np.allclose(moved, centres)
        centres = moved
        if done:
            break
    taken = dict.fromkeys(keys_of(np.clip(np.rint(centres), 0, 7).astype(np.int64)).tolist())
    for k in ranked.tolist():
        if len(taken) >= colours:
            break
        taken.setdefault(k)
    return LEVELS[(list(taken) + [0] * colours)[:colours]].astype(np.uint8)


def nearest_table(palette: np.ndarray, squared: bool = True, without_deep_black: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(error, index) of the nearest palette entry (the first of equal ones) for each of the 512 keys."""
    d = LEVELS[:, None].astype(np.int64) - palette[None].astype(np.int64)
    cost = (d * d if squared else np.abs(d)).sum(axis=2)
    black = palette.astype(np.int64).sum(axis=1) <= 2
    if without_deep_black and black.any() and not black.all():
        cost[:, black] = 1 << 20
    index = cost.argmin(axis=1)
    return cost[np.arange(512), index], index


def nearest_lut(spark, palettes: dict[int, np.ndarray], **options) -> DataFrame:
    """(line, key, error, index): 512 rows for each palette line, small enough to broadcast."""
    rows = []
    for line, palette in palettes.items():
        error, index = nearest_table(palette, **options)
        rows += [(line, k, int(error[k]), int(index[k])) for k in range(512)]
    return spark.createDataFrame(rows, "line int, key int, error long, index int")


def with_line(tiles_df: DataFrame, lut: DataFrame) -> DataFrame:
    """Add to each tile (with the column keys) the line of the least error, of equal ones the least, and that error. The table (line,
    key, error; keys from 0 on, each line all of them) is broadcast as one row, each tile sums its own keys: nothing is shuffled."""
    of_line = lut.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "error"))), lambda x: x["error"]).alias("errors"))
    costs = of_line.agg(F.collect_list(F.struct("line", "errors")).alias("_costs"))
    none = F.lit(0).cast(lut.schema["error"].dataType)
    cost = lambda errors: F.aggregate("keys", none, lambda total, k: total + F.get(errors, k.cast("int")))
    least = F.array_min(F.transform("_costs", lambda c: F.struct(cost(c["errors"]).alias("error"), c["line"].alias("line"))))
    names = [c for c in tiles_df.columns if c not in ("line", "error")]
    found = tiles_df.where(F.size("keys") > 0).select(*names).join(F.broadcast(costs), how="cross").select(*names, least.alias("_m"))
    return found.select(*names, F.col("_m.line").alias("line"), F.col("_m.error").alias("error"))


def assign_lines(tiles_df: DataFrame, lut: DataFrame) -> DataFrame:
    """(frame, cell, line, error): for each tile the line of the least error, of equal ones the least."""
    return with_line(tiles_df, lut).select("frame", "cell", "line", "error")


def learn_lines(tiles_df: DataFrame, lines: int = 4, rounds: int = 6, alpha: float = 0.0) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Palettes for lines of tiles, by turns of assigning tiles and learning from each line's histogram, which is all that
    reaches the driver (512 numbers a line). The first split is by brightness. With ``alpha``, pixels on edges weigh more."""
    spark = tiles_df.sparkSession
    bright = F.aggregate("keys", F.lit(0), lambda a, k: a + F.shiftright(k.cast("int"), 6) + F.shiftright(k.cast("int"), 3).bitwiseAND(7) + k.cast("int").bitwiseAND(7))
    cuts = tiles_df.select(F.percentile(bright, F.array(*[F.lit(k / lines) for k in range(1, lines)])).alias("c")).first()["c"] if lines > 1 else []
    first = sum([(bright > c).cast("int") for c in cuts or []], F.lit(0))
    assigned = tiles_df.withColumn("line", first).select("frame", "cell", "line", "keys")
    palettes: dict[int, np.ndarray] = {}
    before = None
    for _ in range(rounds):
        hist = np.zeros((lines, 512))
        for r in (weighted_histogram(assigned, alpha, ("line",)) if alpha > 0 else histogram(assigned, ("line",))).collect():
            hist[r["line"], r["key"]] = r["n"]
        palettes = {k: learn_palette(hist[k]) if hist[k].any() else palettes.get(k, learn_palette(hist.sum(axis=0))) for k in range(lines)}
        if before is not None and all((palettes[k] == before[k]).all() for k in range(lines)):
            break
        before = palettes
        assigned = with_line(tiles_df, nearest_lut(spark, palettes, squared=False)).drop("error")
    return palettes, assigned


def global_palettes(frame_histograms: np.ndarray, count: int = 4, rounds: int = 8) -> tuple[list[np.ndarray], np.ndarray]:
    """Palettes for groups of frames: the first split is along time; stops when the assignment stays."""
    n = len(frame_histograms)
    own = np.minimum(np.arange(n) * count // max(n, 1), count - 1)
    refit = lambda a: [learn_palette(frame_histograms[a == g].sum(axis=0) if (a == g).any() else frame_histograms.sum(axis=0)) for g in range(count)]
    for _ in range(rounds):
        errors = np.stack([frame_histograms @ nearest_table(p)[0] for p in refit(own)], axis=1)
        after = errors.argmin(axis=1)
        if (after == own).all():
            break
        own = after
    return refit(own), own


def seam_coherent(keys: np.ndarray, palettes: np.ndarray, rows: int, columns: int, weight: float = 1.0, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Lines for a frame's tiles (cells, 64): the error of a tile plus, along its four borders, the difference of residuals
    to the neighbours' chosen ones. Checkerboard halves are updated in turn, each as a whole."""
    tables = [nearest_table(p) for p in palettes]
    cost = np.stack([t[0][keys].sum(axis=1) for t in tables], axis=1).astype(np.float64)
    index = np.stack([t[1] for t in tables])
    shown = np.stack([palettes[k][index[k][keys]] for k in range(len(palettes))]).astype(np.int64)
    residual = (shown - LEVELS[keys][None]).reshape(len(palettes), rows, columns, 8, 8, 3)
    line = cost.argmin(axis=1).reshape(rows, columns)
    black = (np.add.outer(np.arange(rows), np.arange(columns)) & 1).astype(bool)
    y, x = np.indices((rows, columns))
    sides = ((-1, 0, (0, slice(None)), (7, slice(None))), (1, 0, (7, slice(None)), (0, slice(None))), (0, -1, (slice(None), 0), (slice(None), 7)), (0, 1, (slice(None), 7), (slice(None), 0)))
    for _ in range(rounds if weight > 0 and len(palettes) > 1 else 0):
        for half in (~black, black):
            energy = cost.reshape(rows, columns, -1).copy()
            for dy, dx, own, other in sides:
                ny, nx = y + dy, x + dx
                inside = (ny >= 0) & (ny < rows) & (nx >= 0) & (nx < columns)
                ny, nx = np.clip(ny, 0, rows - 1), np.clip(nx, 0, columns - 1)
                beside = residual[line[ny, nx], ny, nx][(slice(None), slice(None), *other)]
                d = residual[(slice(None), slice(None), slice(None), *own)] - beside[None]
                energy += weight * np.where(inside, (d * d).sum(axis=(3, 4)), 0).transpose(1, 2, 0)
            line = np.where(half, energy.argmin(axis=2), line)
    flat = line.reshape(-1)
    return flat, index[flat[:, None], keys] + 1


def seam_assigned(tiles_df: DataFrame, palettes: np.ndarray, columns: int, weight: float = 1.0) -> DataFrame:
    """(frame, cell, line, indices): ``seam_coherent`` for each frame, in a group of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        keys = np.stack(pdf["keys"].to_numpy()).astype(np.int64)
        line, index = seam_coherent(keys, palettes, len(pdf) // columns, columns, weight)
        return pd.DataFrame({"frame": pdf["frame"], "cell": pdf["cell"], "line": line.astype(np.int32), "indices": list(index.astype(np.int16))})

    return tiles_df.groupBy("frame").applyInPandas(run, "frame long, cell int, line int, indices array<smallint>")


def best_scale(palette: np.ndarray, shown: np.ndarray, target: np.ndarray, preferred: int, steps: int = 64) -> tuple[int, int]:
    """(step, error): of the palettes scaled by step / steps, the one of the least squared error against target colours; of
    equal ones the nearest to ``preferred``, then the least step. ``shown`` are palette indices."""
    step = np.arange(steps + 1)
    scaled = (palette[None].astype(np.int64) * step[:, None, None] + steps // 2) // steps
    error = ((scaled[:, shown] - target[None].astype(np.int64)) ** 2).sum(axis=(1, 2))
    best = min(range(steps + 1), key=lambda k: (error[k], abs(k - preferred), k))
    return best, int(error[best])


def canonical_order(palettes: np.ndarray, lines: np.ndarray, indices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Palettes with lines and entries in ascending order, and the lines and 1-based indices that show the same pixels."""
    keys = keys_of(palettes)
    entry = np.argsort(keys, axis=1, kind="stable")
    moved = np.argsort(entry, axis=1)
    row = np.array(sorted(range(len(keys)), key=lambda k: np.sort(keys[k]).tolist()))
    place = np.argsort(row)
    return np.take_along_axis(palettes, entry[..., None], axis=1)[row], place[lines], moved[lines[:, None], indices - 1] + 1


def pack_nibbles(indices: Column) -> Column:
    """4-bit indices, two a byte, as BINARY."""
    hex_digit = F.transform(indices, lambda v: F.lower(F.hex(v.cast("int").bitwiseAND(15))))
    return F.unhex(F.array_join(hex_digit, ""))


def mapping_noise(tiles_df: DataFrame, lines: DataFrame, lut: DataFrame) -> DataFrame:
    """(key, a, b, noise): for pairs of lines that show a colour, the lesser count times the distance of its two renderings."""
    px = tiles_df.join(lines.select("frame", "cell", "line"), ["frame", "cell"])
    counts = histogram(px, ("line",)).join(F.broadcast(lut), ["line", "key"])
    a, b = counts.alias("a"), counts.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.line") < F.col("b.line")))
    return pairs.select(F.col("a.key").alias("key"), F.col("a.line").alias("a"), F.col("b.line").alias("b"), (F.least("a.n", "b.n") * F.abs(F.col("a.error") - F.col("b.error"))).alias("noise"))


def rendered(assigned: DataFrame, palettes: dict[int, np.ndarray]) -> DataFrame:
    """(frame, cell, keys) of rows (frame, cell, line, indices): the colour keys that 1-based palette indices show."""
    lines = F.create_map(*[x for k, p in palettes.items() for x in (F.lit(k), F.array(*[F.lit(int(v)) for v in keys_of(p.astype(np.int64))]))])
    shown = F.transform("indices", lambda i: F.get(F.element_at(lines, F.col("line")), i.cast("int") - 1).cast("smallint"))
    return assigned.select("frame", "cell", shown.alias("keys"))


def flicker(frames: DataFrame) -> DataFrame:
    """(frame, changed, back, peak): against the two frames before, how many pixels change, how many of these change back, and
    the greatest luma step. Each row meets its two predecessors by a join on the frame."""
    own = frames.select("frame", "height", "width", "pixels")
    before = lambda k: own.select((F.col("frame") + k).alias("frame"), F.col("pixels").alias(f"p{k}"))
    both = own.join(before(1), "frame").join(before(2), "frame", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, h, w, px, p1, p2 in pdf[["frame", "height", "width", "pixels", "p1", "p2"]].itertuples(index=False):
                now, one = image_of(px, h, w), image_of(p1, h, w)
                moved = (now != one).any(axis=2)
                back = moved & (now == image_of(p2, h, w)).all(axis=2) if p2 is not None else np.zeros_like(moved)
                rows.append((f, int(moved.sum()), int(back.sum()), int(np.abs(luma(now) - luma(one)).max())))
            yield pd.DataFrame(rows, columns=["frame", "changed", "back", "peak"])

    return both.mapInPandas(run, "frame long, changed long, back long, peak long")


#: 3 by 3 kernels and their divisors; the slope below which an area is flat, and that above which it is an edge.
SMOOTH = ((1, 2, 1), (2, 4, 2), (1, 2, 1)), 16
SLOPE = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)), 8
CHECKER = ((1, -1, 0), (-1, 1, 0), (0, 0, 0)), 4
FLAT_BELOW, EDGE_ABOVE = 4.0, 12.0


def _under(kernel: tuple[tuple[tuple[int, ...], ...], int], image: np.ndarray, turned: bool = False) -> np.ndarray:
    """The weighted sum around each pixel; beyond the borders the picture is mirrored."""
    weights = np.array(kernel[0]) / kernel[1]
    around = np.lib.stride_tricks.sliding_window_view(np.pad(image, 1, mode="reflect"), (3, 3))
    return np.einsum("yxij,ij->yx", around, weights.T if turned else weights)


def filter_change(source: np.ndarray, filtered: np.ndarray) -> dict[str, float | None]:
    """What a filter does to a picture: mean change; the checkerboard left in flat areas; how much of the edges' slope remains, and how
    it correlates with the slope before. None where there is no such area."""
    before, after = (x.astype(np.float64) @ np.array(LUMA) for x in (source, filtered))
    slopes = [np.hypot(_under(SLOPE, smooth), _under(SLOPE, smooth, turned=True)) for smooth in (_under(SMOOTH, before), _under(SMOOTH, after))]
    flat, edge = slopes[0] < FLAT_BELOW, slopes[0] > EDGE_ABOVE
    was, now = slopes[0][edge], slopes[1][edge]
    return {
        "change": float(np.abs(filtered.astype(np.float64) - source).mean()),
        "checker": float(np.abs(_under(CHECKER, after))[flat].mean()) if flat.any() else None,
        "edge_ratio": float(now.mean() / was.mean()) if edge.any() else None,
        "edge_correlation": float(np.corrcoef(was, now)[0, 1]) if len(was) > 1 and was.std() and now.std() else None,
    }


def filter_report(pairs: DataFrame) -> DataFrame:
    """(frame, change, checker, edge_ratio, edge_correlation) of rows (frame, height, width, pixels, filtered); one row at a time."""
    names = ["change", "checker", "edge_ratio", "edge_correlation"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [filter_change(image_of(a, h, w), image_of(b, h, w)) for h, w, a, b in pdf[["height", "width", "pixels", "filtered"]].itertuples(index=False)]
            yield pd.DataFrame({"frame": pdf["frame"].to_numpy(), **{n: np.array([r[n] for r in found], dtype=object) for n in names}})

    return pairs.mapInPandas(run, "frame long, " + ", ".join(f"{n} double" for n in names))


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation of two patches; 0 for a flat one."""
    a, b = a - a.mean(), b - b.mean()
    scale = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum()) / scale if scale else 0.0


def most_changed(tiles_df: DataFrame, budget: int, stream: str | None = None) -> DataFrame:
    """(stream, frame, cell, sent): of each frame's cells that differ from what is shown, the ``budget`` that differ most are sent (of
    equal ones the greater cell); what is shown follows. One fold for each ``stream`` (a whole-number column); without one, the rows are one stream."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shown, out = None, []
        for f, part in pdf.sort_values(["frame", "cell"]).groupby("frame", sort=True):
            rgb = LEVELS[np.stack(part["keys"].to_numpy()).astype(np.int64)].astype(np.int64)
            shown = rgb.copy() * 0 - 1 if shown is None else shown
            d = np.abs(rgb - shown).sum(axis=(1, 2))
            order = np.lexsort((np.arange(len(d)), d))[::-1][:budget]
            sent = np.zeros(len(d), dtype=bool)
            sent[order[d[order] > 0]] = True
            shown[sent] = rgb[sent]
            out.append(pd.DataFrame({"frame": f, "cell": part["cell"].to_numpy(), "sent": sent}))
        return pd.concat(out)

    of = F.lit(0) if stream is None else F.col(stream)
    rows = tiles_df.select(of.cast("long").alias("stream"), "frame", "cell", "keys")
    return rows.groupBy("stream").applyInPandas(lambda pdf: run(pdf).assign(stream=pdf["stream"].iloc[0])[["stream", "frame", "cell", "sent"]], "stream long, frame long, cell int, sent boolean")
