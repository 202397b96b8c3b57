"""Supplies of patterns: sources of cold loads, replays of frozen routes, refills of a ring, caps that fit, and the decisions
of a frame under a byte budget."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .planning import Residency, exact_subset, folded

MAIN, POOL, DICTIONARY = 0, 1, 2


def sourced(cold: DataFrame, dictionary: DataFrame, budgets: DataFrame) -> DataFrame:
    """(stream, frame, ord, key, source, index): each cold load (stream, frame, ord, key) from the dictionary (key, index) if it
    is there, else from the frame's pool while its credits (stream, frame, given) last, in order, else from the main supply."""
    found = cold.join(dictionary.select("key", "index"), "key", "left")
    rest = F.row_number().over(W.partitionBy("stream", "frame", F.col("index").isNull()).orderBy("ord"))
    ranked = found.withColumn("_r", rest).join(budgets.select("stream", "frame", "given"), ["stream", "frame"], "left").na.fill(0, ["given"])
    source = F.when(F.col("index").isNotNull(), DICTIONARY).when(F.col("_r") <= F.col("given"), POOL).otherwise(MAIN)
    return ranked.select("stream", "frame", "ord", "key", source.alias("source"), F.coalesce("index", F.lit(-1)).alias("index"))


def replay(loads: list[int], lengths: list[int], control: list[int], payload: list[int], ring: int, per_slot: int, unit: int, held: int = 0) -> list[tuple[int, int]]:
    """(ring level, control bytes in hand) behind each frame of a frozen route. A ring that overflows or runs dry, or control
    that comes late, is an error that names the frame. Frame 0 is untimed: it takes from what is held before the start."""
    level, hand, out = held, 0, []
    for k in range(len(loads)):
        level += payload[k] * per_slot
        hand += control[k] * unit - (lengths[k] if k else 0)
        if level > ring:
            raise ValueError(f"frame {k}: the ring overflows by {level - ring}")
        level -= loads[k]
        if level < 0 or hand < 0:
            raise ValueError(f"frame {k}: {'payload' if level < 0 else 'control'} comes late")
        out.append((level, hand))
    return out


def largest_cap(loads: list[int], fits) -> int:
    """The largest cap on a frame's loads for which ``fits(capped loads)`` holds, by halving; what fits must fit when less."""
    low, high = 0, max(loads, default=0)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits([min(x, middle) for x in loads]) else (low, middle - 1)
    return low


def refilled(spare: list[int], runs: list[tuple[int, int]], sector: int, ring: int, horizon: int) -> tuple[list[int], list[tuple[int, int]]]:
    """(frame of each run's delivery or -1, sectors sent): fill spare sectors early with whole runs (frame, size) of later
    frames. A sector takes runs of the next ``horizon`` frames that add up to it exactly; if the ring, replayed from there on,
    would overflow, the sector is taken back."""
    sent, moved = [-1] * len(runs), []

    def fits() -> bool:
        level = 0
        for f in range(len(spare)):
            level += sum(n for k, (_, n) in enumerate(runs) if sent[k] == f)
            if level > ring:
                return False
            level -= sum(n for k, (g, n) in enumerate(runs) if g == f and sent[k] >= 0)
        return True

    for f, free in enumerate(spare):
        for _ in range(free):
            waiting = [k for k, (g, _) in enumerate(runs) if sent[k] < 0 and f < g <= f + horizon]
            chosen = exact_subset([runs[k][1] for k in waiting], sector)
            if chosen is None:
                break
            for c in chosen:
                sent[waiting[c]] = f
            if not fits():
                for c in chosen:
                    sent[waiting[c]] = -1
                break
            moved.append((f, len(chosen)))
    return sent, moved


SAME, REUSED, NEAR, LOADED, MISSED = "same", "reused", "near", "loaded", "missed"


@dataclass
class Decider:
    """What becomes of each changed cell of a frame under a byte budget that carries over up to ``carry``.

    Cells are taken by their difference times their age. A key that is resident costs a name; so does one that is near
    enough (mean luma difference up to ``near``) to a resident one of its bucket or a neighbouring one; another costs a name and
    a pattern, if the budget and the cap of loads allow; else the cell is missed, and ages.
    """

    slots: int
    near: float
    name: int = 2
    pattern: int = 32
    bucket: int = 24
    carry: int = 0
    pool: Residency = field(init=False)
    shown: dict[int, bytes] = field(default_factory=dict)
    age: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    budget: int = 0

    def __post_init__(self):
        self.pool = Residency(self.slots)

    def _difference(self, a: bytes | None, b: bytes) -> float:
        x = np.frombuffer(b, dtype=np.uint8).astype(np.int64)
        return 255.0 if a is None else float(np.abs(np.frombuffer(a, dtype=np.uint8).astype(np.int64) - x).mean())

    def _nearest(self, key: bytes) -> bytes | None:
        own = int(np.frombuffer(key, dtype=np.uint8).mean()) // self.bucket
        held = [(self._difference(k, key), k) for k in self.pool.slot_of if abs(int(np.frombuffer(k, dtype=np.uint8).mean()) // self.bucket - own) <= 1]
        best = min(held, default=None)
        return best[1] if best and best[0] <= self.near else None

    def frame(self, cells: dict[int, bytes], supply: int, most_loads: int, number: int) -> dict[int, str]:
        self.budget = min(self.carry, self.budget) + supply
        loads, out, updates = 0, {}, []
        changed = [c for c, k in cells.items() if self.shown.get(c) != k]
        out.update({c: SAME for c in cells if c not in changed})
        urgency = {c: self._difference(self.shown.get(c), cells[c]) * (1 + 0.6 * min(self.age[c], 10)) for c in changed}
        resident = set(self.pool.slot_of)
        for c in sorted(changed, key=lambda c: (-urgency[c], c)):
            key = cells[c]
            if key in resident:
                what, cost = REUSED, self.name
            elif (close := self._nearest(key)) is not None:
                what, cost, key = NEAR, self.name, close
            else:
                what, cost = LOADED, self.name + self.pattern
            if cost > self.budget or what == LOADED and loads >= most_loads:
                out[c] = MISSED
                self.age[c] += 1
                continue
            self.budget -= cost
            if what == LOADED:
                loads += 1
                resident.add(key)
            self.age[c] = 0
            self.shown[c], out[c] = key, what
            updates.append((c, key))
        self.pool.frame(updates, number)
        return out


def decided(df: DataFrame, slots: int, near: float, supply: int, most_loads: int, carry: int = 0) -> DataFrame:
    """(stream, frame, cell, category) of rows (stream, frame, cell, key binary): one ``Decider`` for each stream."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own, rows = Decider(slots, near, carry=carry), []
        for f, part in pdf.groupby("frame", sort=True):
            found = own.frame({c: bytes(k) for c, k in zip(part["cell"], part["key"], strict=True)}, supply, most_loads, int(f))
            rows += [(pdf["stream"].iloc[0], f, c, what) for c, what in found.items()]
        return pd.DataFrame(rows, columns=["stream", "frame", "cell", "category"])

    return folded(df, ["stream"], ["frame", "cell"], fold, "stream long, frame long, cell long, category string")
