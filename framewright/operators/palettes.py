"""Palettes over several lines: scores, shared cores, growing and refining, segments. All on histograms of 512 keys, which are
aggregated in the engine; only they reach the driver or a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .tiles import LEVELS, keys_of, learn_palette, nearest_table


def score(by_line: np.ndarray, palettes: np.ndarray, mapping_weight: float = 1.0) -> tuple[float, float]:
    """(pixel error, mapping noise) of histograms (lines, 512): squared distances to the nearest entries; and for colours
    that two lines show, the lesser count times the distance of the two renderings."""
    tables = [nearest_table(p) for p in palettes]
    pixel = float(sum(h @ t[0] for h, t in zip(by_line, tables, strict=True)))
    shown = np.stack([p[t[1]].astype(np.int64) for p, t in zip(palettes, tables, strict=True)])
    noise = 0.0
    for a in range(len(palettes)):
        for b in range(a + 1, len(palettes)):
            noise += float(np.minimum(by_line[a], by_line[b]) @ np.abs(shown[a] - shown[b]).sum(axis=1))
    return pixel, mapping_weight * noise


def with_shared_core(by_line: np.ndarray, core: int, colours: int = 15) -> np.ndarray:
    """Palettes whose first ``core`` entries are the same, learned from all lines; the rest serves what the core leaves over."""
    total = by_line.sum(axis=0)
    common = learn_palette(total, core) if core else np.zeros((0, 3), np.uint8)
    out = []
    for h in by_line:
        left = h.astype(np.float64).copy()
        left[keys_of(common.astype(np.int64))] = 0
        own = learn_palette(left if left.any() else total, colours - core)
        out.append(np.concatenate([common, own]))
    return np.stack(out)


def refined(palette: np.ndarray, histogram: np.ndarray, candidates: int = 32, rounds: int = 32) -> np.ndarray:
    """Swap one entry at a time for one of the most frequent colours not in the palette, while the squared error falls."""
    palette = palette.astype(np.int64).copy()
    used = np.flatnonzero(histogram)
    cost = lambda p: float(histogram[used] @ ((LEVELS[used][:, None] - p[None]) ** 2).sum(axis=2).min(axis=1))
    best = cost(palette)
    for _ in range(rounds):
        pool = [k for k in used[np.argsort(-histogram[used], kind="stable")] if k not in set(keys_of(palette).tolist())][:candidates]
        trial = min(((cost(np.concatenate([palette[:s], LEVELS[k][None], palette[s + 1 :]])), s, int(k)) for s in range(len(palette)) for k in pool), default=None)
        if trial is None or trial[0] >= best:
            break
        best = trial[0]
        palette[trial[1]] = LEVELS[trial[2]]
    return palette.astype(np.uint8)


def grown(tile_histograms: np.ndarray, most: int = 4, gain: float = 0.05, rounds: int = 6) -> tuple[list[np.ndarray], np.ndarray]:
    """Palettes for 1 to ``most`` lines of tiles (tiles, 512): a line is added, from the worst served tiles, as long as the
    error falls by at least the share ``gain``; (palettes, line of each tile)."""
    palettes, line = [learn_palette(tile_histograms.sum(axis=0))], np.zeros(len(tile_histograms), dtype=np.int64)
    error = float((tile_histograms @ nearest_table(palettes[0])[0]).sum())
    while len(palettes) < most and error > 0:
        costs = np.stack([tile_histograms @ nearest_table(p)[0] for p in palettes], axis=1)
        worst = costs.min(axis=1)
        trial = [*palettes, learn_palette(tile_histograms[worst >= np.quantile(worst, 0.75)].sum(axis=0))]
        for _ in range(rounds):
            own = np.stack([tile_histograms @ nearest_table(p)[0] for p in trial], axis=1).argmin(axis=1)
            trial = [learn_palette(tile_histograms[own == k].sum(axis=0)) if (own == k).any() else trial[k] for k in range(len(trial))]
        costs = np.stack([tile_histograms @ nearest_table(p)[0] for p in trial], axis=1)
        after = float(costs.min(axis=1).sum())
        if after > error * (1 - gain):
            break
        palettes, line, error = trial, costs.argmin(axis=1), after
    return palettes, line


def segment_palettes(histograms: DataFrame, colours: int = 15) -> DataFrame:
    """(segment, place, key): a palette for each segment of rows (segment, key, n); segments are learned in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = np.zeros(512)
        np.add.at(hist, pdf["key"].to_numpy(), pdf["n"].to_numpy())
        keys = keys_of(learn_palette(hist, colours).astype(np.int64))
        return pd.DataFrame({"segment": pdf["segment"].iloc[0], "place": np.arange(colours), "key": keys})

    return histograms.groupBy("segment").applyInPandas(run, "segment long, place int, key int")


def switch_gain(window: np.ndarray, current: np.ndarray) -> float:
    """How much of a window's squared error (histogram of 512) a palette of its own would save, from 0 to 1."""
    kept, own = float(window @ nearest_table(current)[0]), float(window @ nearest_table(learn_palette(window))[0])
    return (kept - min(own, kept)) / kept if kept else 0.0


def scroll_gain(before: np.ndarray, after: np.ndarray, dx: int, dy: int, tile: int = 8, changed_above: float = 4.0) -> tuple[int, int, float]:
    """(tiles that change on a fixed grid, tiles that change once the picture is scrolled, rmse of the overlap)."""

    def changed(a: np.ndarray, b: np.ndarray) -> int:
        d = ((a.astype(np.float64) - b.astype(np.float64)) ** 2).mean(axis=2)
        h, w = d.shape[0] // tile * tile, d.shape[1] // tile * tile
        mean = d[:h, :w].reshape(h // tile, tile, w // tile, tile).mean(axis=(1, 3))
        return int((np.sqrt(mean) > changed_above).sum())

    h, w = before.shape[:2]
    old = before[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    new = after[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    rmse = float(np.sqrt(((old.astype(np.float64) - new.astype(np.float64)) ** 2).mean()))
    exposed = (h * w - old.shape[0] * old.shape[1] + tile * tile - 1) // (tile * tile)
    return changed(before, after), changed(old, new) + exposed, rmse
