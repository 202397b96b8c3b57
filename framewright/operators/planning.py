"""Plans that depend on order: residency, balanced reserves, water-filling, subsets, ratchets and queues.

Each is a fold over one stream's rows (a group of its own); streams and points of a parameter grid run in parallel.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def folded(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a fold to each stream's rows, in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def of_each(df: DataFrame, key: str, order: list[str], value: str, of: Callable[[list], object], into: str, kind: str) -> DataFrame:
    """(key, into): ``of`` the list of each group's values, in order; for very many small groups.

    Rows are dealt and sorted by Spark, and a task goes through its groups in Arrow batches, so no group costs a table of its own.
    """
    own = T.StructType([df.schema[key], T.StructField(into, T._parse_datatype_string(kind))])
    names, types = own.names, to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            here = batch.column(0)
            keys, values = here if keys is None else pa.concat_arrays([keys, here]), values + batch.column(1).to_pylist()
            known, missing = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), False), pc.is_null(keys)
            other = pc.or_(known, pc.not_equal(missing[1:], missing[:-1]))
            edges = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist()]
            if len(edges) > 1:
                found = [of(values[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(edges[:-1])), pa.array(found, types.field(1).type)], names=names)
            # The last group may go on in the next batch.
            keys, values = pa.concat_arrays([keys[edges[-1] :]]), values[edges[-1] :]
        if values:
            yield pa.RecordBatch.from_arrays([keys[:1], pa.array([of(values)], types.field(1).type)], names=names)

    return df.repartition(key).sortWithinPartitions(key, *order).select(key, value).mapInArrow(run, own)


class Residency:
    """A pool of slots for keys that cells show.

    A key that is resident is reused. Otherwise a slot is taken: a free one (the lowest first), then a speculative pin,
    then what no cell shows now or showed in the frame before, then, counted as tearing, what no cell shows now, then the
    least recently used. The hand goes round the pool. A mandatory pin outlives all but an explicit release.
    """

    def __init__(self, slots: int):
        self.key_of: list = [None] * slots
        self.slot_of: dict = {}
        self.free = list(range(slots))
        self.shown = np.zeros(slots, dtype=np.int64)
        self.shown_before = np.zeros(slots, dtype=bool)
        self.used = np.full(slots, -1, dtype=np.int64)
        self.pinned = np.full(slots, -1, dtype=np.int64)
        self.mandatory = np.zeros(slots, dtype=bool)
        self.keep = np.zeros(slots, dtype=bool)
        self.hand, self.tearing = 0, 0
        self.cells: dict = {}
        self.before: dict = {}

    def _next(self, allowed: np.ndarray) -> int | None:
        at = np.flatnonzero(np.roll(allowed, -self.hand))
        if not len(at):
            return None
        slot = int((at[0] + self.hand) % len(allowed))
        self.hand = (slot + 1) % len(allowed)
        return slot

    def _take(self, frame: int, speculative: bool = False) -> int | None:
        if self.free:
            return heapq.heappop(self.free)
        live = self.pinned >= frame
        fixed = live & self.mandatory
        idle = (self.shown == 0) & ~self.keep
        calm = idle & ~self.shown_before
        for allowed in ((calm & live & ~fixed,) if not speculative else ()) + (calm & ~fixed & (~live if speculative else True),):
            if (slot := self._next(allowed)) is not None:
                return self._evicted(slot)
        if speculative:
            return None
        self.tearing += 1
        if (slot := self._next((self.shown == 0) & ~fixed)) is not None:
            return self._evicted(slot)
        rest = np.flatnonzero(~fixed)
        if not len(rest):
            raise RuntimeError("every slot is pinned")
        return self._evicted(int(rest[self.used[rest].argmin()]))

    def _evicted(self, slot: int) -> int:
        self.slot_of.pop(self.key_of[slot], None)
        self.key_of[slot], self.pinned[slot], self.mandatory[slot] = None, -1, False
        return slot

    def frame(self, updates: Iterable[tuple[int, object]], frame: int) -> list[tuple[int, object, int, bool]]:
        """Place a frame's (cell, key) updates; (cell, key, slot, cold) for each. Keys of the frame that are resident are kept
        while it is placed."""
        updates = list(updates)
        self.shown_before[:] = False
        self.shown_before[[s for s in self.cells.values()]] = True
        self.before = dict(self.cells)
        self.keep[:] = False
        self.keep[[self.slot_of[k] for _, k in updates if k in self.slot_of]] = True
        out = []
        for cell, key in updates:
            if cell in self.cells:
                self.shown[self.cells[cell]] -= 1
            cold = key not in self.slot_of
            slot = self._take(frame) if cold else self.slot_of[key]
            self._hold(key, slot, frame)
            self.cells[cell] = slot
            self.shown[slot] += 1
            out.append((cell, key, slot, cold))
        return out

    def _hold(self, key, slot: int, frame: int) -> None:
        self.slot_of[key], self.key_of[slot], self.used[slot] = slot, key, frame
        self.keep[slot] = True
        if self.pinned[slot] <= frame:
            self.pinned[slot], self.mandatory[slot] = -1, False

    def prefetch(self, key, frame: int, deadline: int, mandatory: bool = False) -> tuple[int, bool] | None:
        """Hold a key's slot up to a deadline; (slot, cold), or None if nothing may give way."""
        cold = key not in self.slot_of
        slot = self._take(frame, speculative=True) if cold else self.slot_of[key]
        if slot is None:
            return None
        self.slot_of[key], self.key_of[slot] = slot, key
        self.pinned[slot] = max(int(self.pinned[slot]), deadline)
        self.mandatory[slot] |= mandatory
        return slot, cold


def placed(df: DataFrame, slots: int) -> DataFrame:
    """(stream, frame, ord, cell, key, slot, cold) of updates (stream, frame, ord, cell, key)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pool, rows = Residency(slots), []
        for frame, part in pdf.groupby("frame", sort=True):
            rows += [(slot, cold) for _, _, slot, cold in pool.frame(zip(part["cell"], part["key"], strict=True), int(frame))]
        return pdf.assign(slot=[s for s, _ in rows], cold=[c for _, c in rows])[["stream", "frame", "ord", "cell", "key", "slot", "cold"]]

    return folded(df, ["stream"], ["frame", "ord"], fold, "stream long, frame long, ord long, cell long, key string, slot int, cold boolean")


def demand(df: DataFrame, slots: int, name_bytes: int = 2, pattern_bytes: int = 32, most_cold: int | None = None) -> DataFrame:
    """(stream, frame, changed, cold, bytes): a dry run. Only cells whose key changes count; frame 0 is free."""
    from pyspark.sql import Window as W

    before = F.lag("key").over(W.partitionBy("stream", "cell").orderBy("frame"))
    per = placed(df.withColumn("_b", before).where("_b is null or _b <> key").drop("_b"), slots)
    counted = per.groupBy("stream", "frame").agg(F.count("*").alias("changed"), F.count_if("cold").alias("cold"))
    paid = F.least(F.col("cold"), F.lit(most_cold)) if most_cold is not None else F.col("cold")
    return counted.withColumn("bytes", F.when(F.col("frame") == 0, 0).otherwise(F.col("changed") * name_bytes + paid * pattern_bytes))


def _draws(net: np.ndarray) -> np.ndarray:
    s = np.cumsum(net)
    return s - np.minimum(0, np.minimum.accumulate(s)) if len(s) else s


def balanced(demand_: np.ndarray, supply: np.ndarray, capacity: int, least: np.ndarray | None = None) -> np.ndarray:
    """Demand cut down until no draw exceeds the capacity: in each busy period that overflows, from its start to its peak, the
    same share of what lies above the floor is served, the largest that fits."""
    planned = demand_.astype(np.int64).copy()
    floor = np.zeros_like(planned) if least is None else least.astype(np.int64)
    if len(floor) and _draws(floor - supply).max() > capacity:
        raise ValueError("the floor alone exceeds the capacity")
    for _ in range(2 * len(planned) + 1):
        d = _draws(planned - supply)
        over = np.flatnonzero(d > capacity)
        if not len(over):
            return planned
        empty = np.flatnonzero(d[: over[0]] == 0)
        start = int(empty[-1]) + 1 if len(empty) else 0
        stop = np.flatnonzero(d[over[0] :] == 0)
        end = int(over[0] + stop[0]) if len(stop) else len(d)
        part = slice(start, int(over[0] + d[over[0] : end].argmax()) + 1)
        room, low, high = planned[part] - floor[part], 0.0, 1.0
        for _ in range(60):
            share = (low + high) / 2
            fits = _draws(floor[part] + np.floor(room * share).astype(np.int64) - supply[part]).max() <= capacity
            low, high = (share, high) if fits else (low, share)
        served = floor[part] + np.floor(room * low).astype(np.int64)
        if (served == planned[part]).all():
            served[np.flatnonzero(room > 0)[-1]] -= 1
        planned[part] = served
    raise RuntimeError("not balanced")


def balanced_plan(df: DataFrame, capacity: int) -> DataFrame:
    """(stream, frame, planned, shortfall) of rows (stream, frame, demand, supply)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        planned = balanced(pdf["demand"].to_numpy(), pdf["supply"].to_numpy(), capacity)
        return pdf[["stream", "frame"]].assign(planned=planned, shortfall=pdf["demand"] - planned)

    return folded(df, ["stream"], ["frame"], fold, "stream long, frame long, planned long, shortfall long")


def water_fill(capacity: int, wanted: list[int], urgent: list[int], available: list[int], unit: int = 1) -> list[int]:
    """Deal ``capacity`` units one by one to the frame that needs one most: urgent wants come first, the largest first, of
    equal ones the earlier frame. Wants shrink by ``unit`` with each."""
    given = [0] * len(wanted)

    def rank(f: int) -> tuple:
        rest, soon = max(0, wanted[f] - given[f] * unit), max(0, urgent[f] - given[f] * unit)
        return (-2, -soon, -rest, f) if soon else (-1, -rest, 0, f)

    heap = [rank(f) for f in range(len(wanted)) if available[f] > 0]
    heapq.heapify(heap)
    while capacity > 0 and heap:
        f = heapq.heappop(heap)[-1]
        given[f] += 1
        capacity -= 1
        if given[f] < available[f]:
            heapq.heappush(heap, rank(f))
    return given


def water_filled(df: DataFrame, capacity: int) -> DataFrame:
    """(stream, parity, frame, given) of rows (stream, frame, wanted, urgent, available): even and odd frames have a pool each."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["stream", "parity", "frame"]].assign(given=water_fill(capacity, pdf["wanted"].tolist(), pdf["urgent"].tolist(), pdf["available"].tolist()))

    return folded(df.withColumn("parity", (F.col("frame") % 2).cast("int")), ["stream", "parity"], ["frame"], fold, "stream long, parity int, frame long, given int")


def exact_subset(sizes: list[int], amount: int) -> list[int] | None:
    """Places of sizes that add up to ``amount``, by the first proof in order of preference; None if there are none."""
    proof: dict[int, tuple[int, ...]] = {0: ()}
    for k, n in enumerate(sizes):
        if amount in proof:
            break
        if 0 < n <= amount:
            for total, used in list(proof.items()):
                if total + n <= amount:
                    proof.setdefault(total + n, (*used, k))
    return sorted(proof[amount]) if amount in proof else None


def best_subset(sizes: list[int], scores: list[tuple[int, ...]], amount: int) -> list[int] | None:
    """Places of sizes that add up to ``amount`` with the greatest sum of scores (compared field by field)."""
    width = len(scores[0]) if scores else 0
    best: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {0: ((0,) * width, ())}
    for k, n in enumerate(sizes):
        if 0 < n <= amount:
            own = scores[k]
            for total, (score, used) in list(best.items()):
                if (after := total + n) <= amount:
                    better = tuple(map(add, score, own))
                    if after not in best or better > best[after][0]:
                        best[after] = better, (*used, k)
    return sorted(best[amount][1]) if amount in best else None


def least_horizon(sizes: list[int], amount: int) -> int | None:
    """How many of the first sizes are needed before some of them add up to ``amount``: reachable sums as bits of a number."""
    reach = 1
    for k, n in enumerate(sizes):
        if reach >> amount & 1:
            return k
        reach |= reach << n if n > 0 else 0
    return len(sizes) if reach >> amount & 1 else None


def ratchet(frames: list[tuple[int, float, bool]], period: float, window: float, hold: int, setup: float, phase: float) -> tuple[set[int], float]:
    """(late frames, least margin). Work of each (frame, work, at_start) begins when the one before was shown; it is shown in
    the first window, ``hold`` periods on or later, that it is ready for: anywhere in the window, or only at its start."""
    shown, late, least = phase, set(), float("inf")
    slot = 0
    for frame, work, at_start in frames:
        ready = shown + setup + work
        k = max(slot + hold, int(np.floor((ready - phase) / period)))
        inside = phase + k * period <= ready < phase + k * period + window
        if ready > phase + k * period and (at_start or not inside):
            k += 1
        shown = max(ready, phase + k * period)
        if k - slot > hold:
            late.add(frame)
        least = min(least, phase + k * period + window - shown)
        slot = k
    return late, least


def ratchet_sweep(df: DataFrame, grid: list[tuple[float, float]], period: float, window: float, hold: int) -> DataFrame:
    """(setup, phase, late, margin): the ratchet for each point of a grid of (setup, phase). The trace goes to one task once,
    which runs it through for every point; the state is one number a point."""
    points = [(float(a), float(b)) for a, b in grid]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["frame"], pdf["work"], pdf["at_start"], strict=True))
        found = [(a, b, *ratchet(rows, period, window, hold, a, b)) for a, b in points]
        return pd.DataFrame([(a, b, len(late), margin) for a, b, late, margin in found], columns=["setup", "phase", "late", "margin"])

    return folded(df.select(F.lit(0).alias("_all"), "frame", "work", "at_start"), ["_all"], ["frame"], fold, "setup double, phase double, late long, margin double")


def queue_replay(arrivals: list[int], needs: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(level, missing, refused) at each step of a bounded queue: what arrives first, then what is taken."""
    level, out = 0, []
    for a, n in zip(arrivals, needs, strict=True):
        refused = max(0, level + a - capacity)
        level += a - refused
        missing = max(0, n - level)
        level -= n - missing
        out.append((level, missing, refused))
    return out


def replayed(df: DataFrame, capacity: int) -> DataFrame:
    """(stream, frame, level, missing, refused) of rows (stream, frame, arrives, needs)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pdf[["stream", "frame"]], pd.DataFrame(queue_replay(pdf["arrives"].tolist(), pdf["needs"].tolist(), capacity), columns=["level", "missing", "refused"])], axis=1)

    return folded(df, ["stream"], ["frame"], fold, "stream long, frame long, level long, missing long, refused long")


class Ledger:
    """A frame at a time: begin, spend, and commit or roll back, against cumulative capacity."""

    def __init__(self, a_frame: int):
        self.a_frame, self.frames, self.spent, self.open = a_frame, 0, 0, None

    def begin(self) -> int:
        if self.open is not None:
            raise RuntimeError("a frame is open")
        self.open = 0
        return (self.frames + 1) * self.a_frame - self.spent

    def spend(self, n: int) -> bool:
        if self.open is None or self.spent + self.open + n > (self.frames + 1) * self.a_frame:
            return False
        self.open += n
        return True

    def commit(self) -> None:
        self.spent, self.frames, self.open = self.spent + (self.open or 0), self.frames + 1, None

    def roll_back(self) -> None:
        self.open = None

    def largest(self, cost: Callable[[int], int], most: int) -> int:
        """The largest n up to ``most`` whose cost (rising) still fits the open frame, by halving."""
        low, high, left = 0, most, (self.frames + 1) * self.a_frame - self.spent - (self.open or 0)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if cost(middle) <= left else (low, middle - 1)
        return low


def ring_schedule(loads: list[int], lengths: list[int], slots: list[int], ring: int, per_slot: int, unit: int) -> list[tuple[int, int]]:
    """(control, payload) units of each slot: what must be delivered by each frame is carried back over slots that cannot
    hold it, then delivered as early as the ring (``ring`` items) allows. Raises ValueError if a deadline cannot be met."""
    n = len(loads)
    need_control = np.ceil(np.cumsum([0, *lengths[1:]]) / unit).astype(np.int64) if n else np.zeros(0, np.int64)
    total = np.cumsum(loads)
    need_payload = np.ceil(np.append(total[1:], total[-1:]) / per_slot).astype(np.int64) if n else total
    # Backwards: what earlier slots must already have delivered, if later ones cannot.
    due = need_control + need_payload
    for k in range(n - 1, 0, -1):
        due[k - 1] = max(due[k - 1], due[k] - slots[k])
    if n and due[0] > slots[0]:
        raise ValueError("deadlines cannot be met")
    out, control, payload = [], 0, 0
    for k in range(n):
        c = int(max(0, need_control[k] - control))
        fits = max(0, (ring + int(total[k]) - payload * per_slot) // per_slot)
        p = min(slots[k] - c, fits, int(need_payload[-1]) - payload)
        if p < 0 or payload + p < need_payload[k]:
            raise ValueError(f"frame {k}: deadline missed")
        control, payload = control + c, payload + p
        out.append((c, p))
    return out


def frame_budgets(cold: DataFrame, frames: DataFrame, dictionary_size: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(dictionary, budgets): the keys that serve most of rows (stream, frame, ord, key) of the whole stream, and for the rest
    of each frame's demand the credits of its parity's pool: (stream, parity, frame, given). ``frames`` lists (stream, frame)."""
    from .ranking import dictionary

    chosen = dictionary(cold, "key", F.lit(False), "ord", dictionary_size)
    left = cold.join(chosen.select("key"), "key", "left_anti").groupBy("stream", "frame").agg(F.count("*").alias("wanted"))
    every = frames.join(left, ["stream", "frame"], "left").na.fill(0, ["wanted"])
    return chosen, water_filled(every.select("stream", "frame", "wanted", F.lit(0).cast("long").alias("urgent"), F.col("wanted").alias("available")), capacity)


def cheaper_lists(updates: list[int], margins: list[int], bitmap: int, entry: int, item: int, fixed: list[bool] | None = None) -> list[bool]:
    """Which frames code their updates as a list: where that is shorter than the bitmap form. ``margins`` are the bytes that
    each prefix has to spare in bitmap form; a list that is longer (where ``fixed`` demands it) must not overdraw any later
    one, else ValueError."""
    fixed = fixed or [False] * len(updates)
    cost = [n * item - bitmap - n * entry for n in updates]
    chosen = [f or c < 0 for f, c in zip(fixed, cost, strict=True)]
    saved = 0
    for k, use in enumerate(chosen):
        saved -= cost[k] if use else 0
        if margins[k] + saved < 0:
            raise ValueError(f"frame {k}: the lists overdraw the schedule")
    return chosen


def feasible(patterns: np.ndarray, control: np.ndarray, prebuffer: int, capacity: int, per_sector: int, unit: int, rounds: int = 64) -> np.ndarray:
    """Patterns cut until no prefix needs more sectors than ``capacity`` a frame: at the first that does, the loads since the
    last prefix that needed none in advance are served by the largest common share that fits."""
    plan = patterns.astype(np.int64).copy()
    need_control = np.ceil(np.cumsum(np.append(0, control[1:])) / unit)

    def margin(p: np.ndarray) -> np.ndarray:
        total = np.cumsum(np.append(0, p[1:]))
        ahead = np.append(total[1:], total[-1:])
        return np.arange(len(p)) * capacity - np.ceil(np.maximum(ahead - prebuffer // per_sector * per_sector, 0) / per_sector) - need_control

    for _ in range(max(1, 2 * len(plan))):
        short = np.flatnonzero(margin(plan) < 0)
        if not len(short):
            return plan
        stop = min(int(short[0]) + 2, len(plan))
        low, high = 0.0, 1.0
        for _ in range(rounds):
            share = (low + high) / 2
            trial = np.concatenate([plan[:1], np.floor(plan[1:stop] * share).astype(np.int64), plan[stop:]])
            low, high = (share, high) if (margin(trial)[: stop - 1] >= 0).all() else (low, share)
        served = np.floor(plan[1:stop] * low).astype(np.int64)
        if (served == plan[1:stop]).all():
            raise ValueError("control alone exceeds the capacity")
        plan[1:stop] = served
    raise RuntimeError("not feasible")
