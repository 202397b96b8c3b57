"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With a weight w (a share of all), its block i (from 0) may not run before slot
``floor(i / w)`` (release) and must have run by slot ``ceil((i + 1) / w)`` (deadline). At each slot the released block with
the earliest deadline runs. Weights are held as exact whole numbers of any length, so at every slot of the whole run each
source is less than one block off its share of the target weights.

When a source has no block left, a phase ends: the others go on with their weights scaled up. With n blocks a source and
weights in proportion to w, slot ``T(v) = sum(min(n, w * v))`` is when the shares have come to ``w * v`` blocks each, so
block i is released at ``floor(T(i / w))`` and due at ``ceil(T((i + 1) / w))``, through all phases. The driver schedules the
blocks (not the rows), in a heap of the sources; blocks grow with the table so that ``max_blocks`` (and one for each source)
suffice, and the bound of one block is then that part of all rows. No row is dropped or repeated. The rows' order within a source is that of a
hash of their ids; the numbering sees no source as a whole in any task.

Defined results: a null source is a source; weights of unknown sources are ignored and sources without a weight get the least
one; repeated rows keep places of their own, and rows of one id stand in the order of a hash of all their columns; an empty table gives no rows; other columns are kept; any number of sources is
scheduled unless ``MAX_SOURCES`` is set, beyond which there is an error.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from fractions import Fraction
from itertools import accumulate
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slots, small

BLOCK_ROWS, POWER = 8, 0.5
#: A block holds this part of all rows if that is more than its given size: the driver's plan does not grow with the table.
MAX_BLOCKS = 1 << 20
#: If set, more sources than this are an error.
MAX_SOURCES: int | None = None


def exact_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def whole_weights(weights: dict[str | None, float], period: int) -> dict[str | None, int]:
    """Weights as whole numbers of at least 1 that add up to ``period`` or, with more sources than that, to their number."""
    period = max(period, len(weights))
    total, rest = sum(weights.values()), period - len(weights)
    exact = {s: rest * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    missing = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[:missing]:
        out[s] += 1
    return out


def schedule(blocks: dict[str | None, int], weights: dict[str | None, int]) -> tuple[list[str | None], dict[str, array]]:
    """The sources, and one entry for each slot: the source (its place in the list), block, release, deadline and phase."""
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (s is None, str(s)))
    n, w = [blocks[s] for s in names], [weights[s] for s in names]
    order = sorted(range(len(names)), key=lambda k: Fraction(n[k], w[k]))
    ends = [n[k] / w[k] for k in order]
    # T(v) is the least of gone + rate * v over the numbers of sources that have ended.
    gone = list(accumulate((n[k] for k in order), initial=0))
    rate = list(accumulate((-w[k] for k in order), initial=sum(w)))

    def reached(k: int, i: int) -> int:
        """w[k] * T(i / w[k])"""
        at = bisect_right(ends, i / w[k])
        found = gone[at] * w[k] + rate[at] * i
        for step in (-1, 1):
            while 0 <= at + step < len(gone) and (other := gone[at + step] * w[k] + rate[at + step] * i) < found:
                at, found = at + step, other
        return found

    phase_ends = sorted({Fraction(reached(k, n[k]), w[k]) for k in range(len(names))})
    out = {c: array("q") for c in ("source", "block", "release", "deadline", "phase")}
    done, phase = [0] * len(names), 0
    until = [reached(k, 1) for k in range(len(names))]
    waiting = {0: [(0, k) for k in range(len(names))]}
    ready: list[tuple[int, int, int]] = []
    for slot in range(sum(n)):
        for release, k in waiting.pop(slot, ()):
            heapq.heappush(ready, (-(-until[k] // w[k]), k, release))
        deadline, k, release = heapq.heappop(ready)
        # A phase ends with the slot in which a share is used up.
        while phase_ends[phase] < slot + 1:
            phase += 1
        for c, v in zip(out, (k, done[k], release, deadline, phase), strict=True):
            out[c].append(v)
        done[k] += 1
        if done[k] < n[k]:
            release = until[k] // w[k]
            until[k] = reached(k, done[k] + 1)
            waiting.setdefault(max(release, slot + 1), []).append((release, k))
    return names, out


def period_slots(parts: dict[str | None, int]) -> dict[str | None, list[int]]:
    """For each source the slots of its blocks in one period, by earliest deadline among the released blocks."""
    names, plan = schedule(parts, parts)
    out: dict[str | None, list[int]] = {s: [] for s in names}
    for slot, k in enumerate(plan["source"]):
        out[names[k]].append(slot)
    return out


def scheduled(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, power: float = POWER, source_col: str = "source", id_col: str = "doc_id", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``docs`` (with no column that starts with an underscore but ``_row``) with _block, _phase, _release, _deadline, _slot and _position (a long, gapless from 0).

    ``weights`` are by source (null as None); without them a source weighs its number of rows to the ``power``. With a
    ``period`` they are first made whole numbers of that sum. Blocks hold ``block_rows`` rows, or a ``max_blocks``-th of all
    rows if that is more; the last block of a source may be short.
    """
    spark = docs.sparkSession
    rows = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n")).collect()}
    if MAX_SOURCES is not None and len(rows) > MAX_SOURCES:
        raise ValueError(f"{len(rows)} sources; at most {MAX_SOURCES} can be scheduled")
    block_rows = max(block_rows, -(-sum(rows.values()) // max_blocks))
    if weights is None:
        weights = {s: n**power for s, n in rows.items()}
    else:
        known = {s: w for s, w in weights.items() if s in rows and w > 0}
        weights = {s: known.get(s, min(known.values(), default=1.0)) for s in rows}
    names, plan = schedule({s: -(-n // block_rows) for s, n in rows.items()}, whole_weights(weights, period) if period and rows else exact_weights(weights))
    # A source's last block may be short; what stands behind it moves up.
    sizes = (min(block_rows, rows[names[k]] - i * block_rows) for k, i in zip(plan["source"], plan["block"], strict=True))
    starts = array("q", accumulate(sizes, initial=0))[:-1]
    whole = lambda c: pa.array(memoryview(plan[c]), pa.int64())
    n = len(starts)
    columns = {"_s": pa.array(names, pa.string()).take(whole("source")), "_b": whole("block"), "_phase": whole("phase").cast(pa.int32()), "_release": whole("release"), "_deadline": whole("deadline"), "_slot": pa.array(range(n), pa.int64()), "_start": pa.array(memoryview(starts), pa.int64())}
    plans = spark.createDataFrame(pa.table(columns), "_s string, _b long, _phase int, _release long, _deadline long, _slot long, _start long")
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    numbered = slots(docs.withColumn("_source", F.col(source_col).cast("string")), "_source", [F.xxhash64(id_col), F.col(id_col)], "_n", ties=(F.xxhash64(*hashed),))
    numbered = numbered.withColumn("_block", F.expr(f"_n div {int(block_rows)}"))
    out = numbered.join(small(plans, n), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
    position = F.col("_start") + F.col("_n") % F.lit(block_rows)
    return out.withColumn("_position", position.cast("long")).drop("_source", "_s", "_b", "_n", "_start")


def with_position(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """Rows (row, position): each row of ``docs`` as a struct, and its place in the schedule."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"))
    return scheduled(packed, **options).select(F.col("_row").alias("row"), F.col("_position").alias("position"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, source, block, phase, release, deadline, slot, position), one for each row of ``docs``."""
    found = scheduled(docs.select("doc_id", "source"), **options)
    whole = lambda c: F.col(f"_{c}").cast("long").alias(c)
    return found.select("doc_id", "source", whole("block"), F.col("_phase").cast("int").alias("phase"), whole("release"), whole("deadline"), whole("slot"), whole("position"))


def mixed(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows and columns of ``docs``, written in the order of the schedule: parts by range of position, sorted inside."""
    found = with_position(docs, source_col, id_col, **options)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(parts, "position").sortWithinPartitions("position").select("row.*")
