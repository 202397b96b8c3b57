"""Motion along an axis by textured-block votes, adoption of scrolling, and fades to or from black."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .tiles import image_of


@dataclass(frozen=True)
class Limits:
    shift: int = 24
    block: int = 16
    stride: int = 4
    texture: float = 10.0
    blocks: int = 20
    support: float = 0.32
    gain: float = 1.35
    margin: float = 0.06
    residual: float = 34.0
    cut_still: float = 58.0
    cut_best: float = 42.0


def shifts(limit: int) -> np.ndarray:
    """(dx, dy): none, then along x, then along y, by growing distance."""
    reach = [s * k for k in range(1, limit + 1) for s in (1, -1)]
    return np.array([(0, 0), *((d, 0) for d in reach), *((0, d) for d in reach)])


def motion(before: np.ndarray, after: np.ndarray, limits: Limits = Limits()) -> dict:  # noqa: B008
    """The shift whose median error over textured blocks is least, with the share of blocks that vote for it (or a shift one
    off), the gain over standing still and the margin over the best distant rival."""
    h, w = before.shape[:2]
    m, b, s = limits.shift, limits.block, limits.stride
    tops, lefts = np.arange(m, h - m - b + 1, b), np.arange(m, w - m - b + 1, b)
    inner = np.arange(0, b, s)
    y = (tops[:, None, None, None] + inner[None, None, :, None] + np.zeros_like(lefts)[None, :, None, None] + np.zeros_like(inner)[None, None, None, :]).reshape(len(tops) * len(lefts), -1)
    x = (lefts[None, :, None, None] + inner[None, None, None, :] + np.zeros_like(tops)[:, None, None, None] + np.zeros_like(inner)[None, None, :, None]).reshape(y.shape)
    old = before[y, x].astype(np.float32) if len(y) else np.zeros((0, 1, 3), np.float32)
    grey = old @ np.array([0.299, 0.587, 0.114], np.float32)
    level = grey.mean(axis=1)
    fit = (grey.std(axis=1) >= limits.texture) & (level >= 8) & (level <= 247)
    none = {"axis": "none", "delta": 0, "support": 0.0, "residual": float("inf"), "gain": 1.0, "margin": 0.0, "blocks": int(fit.sum()), "accepted": False, "cut": False}
    if fit.sum() < limits.blocks:
        return none
    moves = shifts(m)
    old, y, x = old[fit], y[fit], x[fit]
    error = np.stack([np.abs(old - after[y + dy, x + dx].astype(np.float32)).mean(axis=(1, 2)) for dx, dy in moves])
    score = np.median(error, axis=1)
    best = int(score.argmin())
    same_axis = (moves[best] != 0).any() & (np.abs(moves - moves[best]).sum(axis=1) <= 1) & (((moves != 0) == (moves[best] != 0)).all(axis=1) | (np.arange(len(moves)) == 0) & (np.abs(moves[best]).sum() == 1))
    close = same_axis if moves[best].any() else np.arange(len(moves)) == 0
    close[best] = True
    rival = score[~close].min() if (~close).any() else score[best]
    gain = float(score[0] / max(score[best], 1e-6))
    margin = float((rival - score[best]) / max(rival, 1e-6))
    support = float(close[error.argmin(axis=0)].mean())
    cut = bool(score[0] >= limits.cut_still and score[best] >= limits.cut_best)
    axis = "none" if not moves[best].any() else "x" if moves[best][0] else "y"
    good = axis != "none" and not cut and support >= limits.support and gain >= limits.gain and margin >= limits.margin and score[best] <= limits.residual
    return none | {"axis": axis, "delta": int(moves[best].sum()), "support": support, "residual": float(score[best]), "gain": gain, "margin": margin, "accepted": bool(good), "cut": cut}


_MOTION = "frame long, axis string, delta int, support double, residual double, gain double, margin double, blocks int, accepted boolean, cut boolean"


def transitions(frames: DataFrame, limits: Limits = Limits(), step: int = 1, run_rows: int = 32) -> DataFrame:  # noqa: B008
    """Motion from frame - step to frame. Runs of ``run_rows`` frames make a task's group, with the ``step`` frames before it."""
    from pyspark.sql import functions as F

    own = frames.select("frame", "height", "width", "pixels", F.floor(F.col("frame") / run_rows).alias("run"))
    lead = own.withColumn("run", F.col("run") + 1).where(F.col("frame") >= F.col("run") * run_rows - step)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        images = {f: image_of(px, h, w) for f, h, w, px in pdf[["frame", "height", "width", "pixels"]].itertuples(index=False)}
        first = int(pdf["run"].iloc[0]) * run_rows
        rows = [{"frame": f, **motion(images[f - step], images[f], limits)} for f in sorted(images) if f >= first and f - step in images]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _MOTION.split(", ")])

    return own.unionByName(lead).groupBy("run").applyInPandas(run, _MOTION)


def fade_scale(frame: np.ndarray, reference: np.ndarray) -> tuple[float, float]:
    """(scale, rmse): the least-squares factor of a reference that makes a frame, cut to 0 to 1."""
    f, r = frame.astype(np.float64).ravel(), reference.astype(np.float64).ravel()
    scale = float(np.clip((f @ r) / max(r @ r, 1e-12), 0, 1))
    return scale, float(np.sqrt(np.mean((f - scale * r) ** 2)))


def rising_side(levels: list[float], least: int, most: int, change: float, tolerance: float) -> int:
    """The length of the longest start of ``levels`` that rises (falls by no more than ``tolerance``), of at least ``least``
    and at most ``most`` values and by ``change`` in all; 0 if there is none."""
    n = 1
    while n < min(len(levels), most) and levels[n] >= levels[n - 1] - tolerance:
        n += 1
    while n >= least and levels[n - 1] - levels[0] < change:
        n -= 1
    return n if n >= least else 0


def fades(frames: DataFrame, black: float = 6.0, least: int = 3, most: int = 48, change: float = 0.5, tolerance: float = 0.02, most_rmse: float = 24.0) -> DataFrame:
    """(stream, kind, start, stop): runs of frames that are one picture scaled, out of black or into it; each stream is a group.

    The picture is the brightest frame of the run; a fade into black is a fade out of it, read backwards.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        images = [image_of(px, h, w).astype(np.float64) for h, w, px in pdf[["height", "width", "pixels"]].itertuples(index=False)]
        dark, names, found = [x.mean() <= black for x in images], pdf["frame"].to_numpy(), []
        for kind, order in (("in", list(range(len(images)))), ("out", list(range(len(images)))[::-1])):
            for k in range(len(order) - 1):
                if dark[order[k]] and not dark[order[k + 1]]:
                    side = order[k : k + 1 + most]
                    top = max(side, key=lambda j: images[j].mean())
                    side = side[: side.index(top) + 1]
                    fit = [fade_scale(images[j], images[top]) for j in side]
                    n = rising_side([s if e <= most_rmse else -1.0 for s, e in fit], least, most, change, tolerance)
                    if n:
                        a, b = sorted((side[0], side[n - 1]))
                        found.append((pdf["stream"].iloc[0], kind, int(names[a]), int(names[b]) + 1))
        return pd.DataFrame(found, columns=["stream", "kind", "start", "stop"])

    return frames.groupBy("stream").applyInPandas(run, "stream long, kind string, start long, stop long")


def world_cells(axis: str, position: int, delta: int, columns: int, rows: int, tile: int = 8) -> np.ndarray:
    """(cells, 2): rows and columns, on an endless plane, of the tiles that a view of ``rows`` by ``columns`` starts at, then of the
    strip that comes in next: behind the view if it moves down or stands, before it if it moves up."""
    if axis not in ("horizontal", "vertical") or min(columns, rows, tile) <= 0:
        raise ValueError("a view along either axis needs positive sizes")
    first, across = -position // tile, axis == "horizontal"
    down, right = (0, first) if across else (first, 0)
    y, x = np.indices((rows, columns)).reshape(2, -1)
    view = np.stack([y + down, x + right], axis=1)
    length = columns if across else rows
    strip = np.arange(rows if across else columns)
    edge = np.full_like(strip, first + length if delta <= 0 else first - 1)
    return np.concatenate([view, np.stack([strip, edge] if across else [edge, strip], axis=1)])


def projected(frames: DataFrame, columns: int, rows: int, tile: int = 8) -> DataFrame:
    """(frame, place, row, column, guard, shown, pixels): frames (frame, height, width, pixels, axis, position, delta, base) laid on the
    tiles of a plane that has moved by ``position``. Where a tile lies outside the picture it keeps the pixels of ``base`` (all
    tiles in order; null: black). ``guard`` marks the strip that comes in next, ``shown`` counts a tile's pixels from the picture."""
    kind = "frame long, place int, row long, column long, guard boolean, shown int, pixels binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inner = np.arange(tile)
        for pdf in batches:
            for f, h, w, px, axis, position, delta, base in pdf[["frame", "height", "width", "pixels", "axis", "position", "delta", "base"]].itertuples(index=False):
                cells = world_cells(axis, int(position), int(delta), columns, rows, tile)
                at = cells[:, :, None] * tile + inner + np.array([[position * (axis == "vertical")], [position * (axis == "horizontal")]])
                y, x = at[:, 0, :, None], at[:, 1, None, :]
                inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
                size = (len(cells), tile, tile, 3)
                under = np.zeros(size, np.uint8) if base is None else np.frombuffer(base, np.uint8).reshape(size)
                over = image_of(px, h, w)[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
                laid = np.where(inside[..., None], over, under)
                yield pd.DataFrame({"frame": f, "place": np.arange(len(cells), dtype=np.int32), "row": cells[:, 0], "column": cells[:, 1], "guard": np.arange(len(cells)) >= rows * columns, "shown": inside.sum(axis=(1, 2)).astype(np.int32), "pixels": [t.tobytes() for t in laid]})

    return frames.mapInPandas(run, kind)
