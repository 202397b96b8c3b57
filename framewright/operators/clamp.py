"""Running balances: sums that are clamped on one side or both, carried rates, and first-in-first-out allocation.

One-sided clamps have a closed form over running sums and extremes, two-sided ones compose as triples; so all of them run
block by block (see ``scan``), not row by row over a whole stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import BLOCK_ROWS, neighbours, running


def draw(df: DataFrame, order: str, change: Column, keys: tuple[str, ...] = (), into: str = "draw") -> DataFrame:
    """``max(0, draw + change)``, from 0: the running sum above its least value so far (0 included)."""
    df = running(df, order, {"_s": ("sum", change)}, keys)
    return running(df, order, {"_m": ("min", F.col("_s"))}, keys).withColumn(into, F.col("_s") - F.least(F.lit(0), F.col("_m"))).drop("_s", "_m")


def lead_trace(df: DataFrame, order: str, actual: Column, rate: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add the cumulative ``lead`` of actual over rated amounts, and its ``peak`` so far."""
    df = running(df, order, {"lead": ("sum", actual - rate)}, keys)
    return running(df, order, {"peak": ("max", F.col("lead"))}, keys)


def first_depletion(df: DataFrame, order: str, demand: Column, supply: Column, capacity: int) -> DataFrame:
    """One row: the first place at which ``min(capacity, balance + supply - demand)`` is 0 or less; the row count if none."""
    return draw(df, order, demand - supply).agg(F.coalesce(F.min(F.when(F.col("draw") >= capacity, F.col(order))), F.count("*")).cast("long").alias("frame"))


def capped_balance(df: DataFrame, order: str, income: Column, spend: Column, cap: Column | float, start: Column | float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``min(cap, balance + income) - spend`` from ``min(start, cap)``, as ``balance``."""
    df = df.withColumn("_in", income).withColumn("_out", spend)
    df = running(df, order, {"_si": ("sum", F.col("_in")), "_so": ("sum", F.col("_out"))}, keys)
    # The balance is the net sum plus the least of the start and of all rooms, cap - (income up to a row - spending before it).
    room = F.lit(cap) - (F.col("_si") - F.col("_so") + F.col("_out"))
    df = running(df, order, {"_m": ("min", room)}, keys)
    return df.withColumn("balance", F.col("_si") - F.col("_so") + F.least(F.least(F.lit(start), F.lit(cap)), F.col("_m"))).drop("_in", "_out", "_si", "_so", "_m")


def carried(steps: Column, modulus: int, order: str, df: DataFrame, keys: tuple[str, ...] = (), into: str = "carry") -> DataFrame:
    """Whole units that an accumulator of ``steps`` yields at each row: the difference of floors of the running sum."""
    df = running(df.withColumn("_step", steps), order, {"_s": ("sum", F.col("_step"))}, keys)
    floor = lambda c: F.floor(c / modulus)
    return df.withColumn(into, (floor(F.col("_s")) - floor(F.col("_s") - F.col("_step"))).cast("long")).drop("_step", "_s")


def rate_deltas(df: DataFrame, order: str, steps: list[int], modulus: int, keys: tuple[str, ...] = (), into: str = "rate") -> DataFrame:
    """The cyclic integer-carry allowance of rows 1, 2, ...; row 0 has none."""
    step = F.when(F.col(order) > 0, F.get(F.array(*[F.lit(x) for x in steps]), F.pmod(F.col(order) - 1, F.lit(len(steps))).cast("int"))).otherwise(F.lit(0))
    return carried(step.cast("long"), modulus, order, df, keys, into)


def rate_matched(df: DataFrame, order: str, actual: Column, rate: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``sectors`` (the actual amount, or what is due if that is more) and the non-negative ``lead`` they build up."""
    timed = lambda c: F.when(F.col(order) > 0, c).otherwise(F.lit(0))
    df = df.withColumn("_r", timed(rate)).withColumn("_a", timed(actual))
    df = draw(df, order, F.col("_a") - F.col("_r"), keys, "lead")
    df = neighbours(df, order, {"_p": "lead"}, keys)
    return df.withColumn("sectors", F.col("_r") + F.col("lead") - F.coalesce("_p", F.lit(0))).drop("_r", "_a", "_p")


def fifo(df: DataFrame, order: str, room: Column, total: int, keys: tuple[str, ...] = (), into: str = "useful") -> DataFrame:
    """Deal ``total`` to rows in order, each up to its room."""
    df = running(df.withColumn("_room", room), order, {"_s": ("sum", F.col("_room"))}, keys)
    return df.withColumn(into, F.greatest(F.lit(0), F.least(F.col("_room"), F.lit(total) - (F.col("_s") - F.col("_room"))))).drop("_room", "_s")


def even_flag(place: Column, chosen: Column | int, total: Column | int) -> Column:
    """Whether place p of ``total`` carries one of ``chosen`` flags that are spread evenly."""
    chosen, total = (x if isinstance(x, Column) else F.lit(x) for x in (chosen, total))
    return F.floor((place + 1) * chosen / total) != F.floor(place * chosen / total)


def just_in_time(df: DataFrame, order: str, length: Column, unit: int, keys: tuple[str, ...] = (), into: str = "sectors") -> DataFrame:
    """Whole units delivered at each row so that what is needed up to it is there, and no more; row 0 needs none."""
    timed = F.when(F.col(order) > 0, length).otherwise(F.lit(0))
    df = running(df.withColumn("_len", timed), order, {"_s": ("sum", F.col("_len"))}, keys)
    up = lambda c: F.ceil(c / unit)
    return df.withColumn(into, (up(F.col("_s")) - up(F.col("_s") - F.col("_len"))).cast("long")).drop("_len", "_s")


def prefix_margin(df: DataFrame, order: str, payload: Column, control: Column, prebuffer: int, capacity: int, per_sector: int, unit: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``payload_sectors``, ``control_sectors`` and ``margin``: whether deadlines fit the route's cumulative capacity.

    At row i the control stream must cover rows up to i, the payload those up to i + 1, less what is buffered before the start.
    """
    timed = lambda c: F.when(F.col(order) > 0, c).otherwise(F.lit(0))
    df = running(df, order, {"_p": ("sum", timed(payload)), "_c": ("sum", timed(control))}, keys)
    df = neighbours(df, order, {"_next": "_p"}, keys, ahead=True)
    needed = F.greatest(F.coalesce("_next", F.col("_p")) - prebuffer // per_sector * per_sector, F.lit(0))
    df = df.withColumn("payload_sectors", F.ceil(needed / per_sector)).withColumn("control_sectors", F.ceil(F.col("_c") / unit))
    return df.withColumn("margin", F.col(order) * capacity - F.col("payload_sectors") - F.col("control_sectors")).drop("_p", "_c", "_next")


def terminal_drain(df: DataFrame, order: str, demand: Column, supply: Column, reserve: str) -> DataFrame:
    """Add ``credit``: the surplus of later rows, from behind the last reserve on; before that, what it is there."""
    df = df.withColumn("_net", supply - demand)
    start = df.agg(F.coalesce(F.max(F.when(F.col(reserve) != 0, F.col(order))) + 1, F.lit(0)).alias("start_frame"))
    df = running(df, order, {"_sum": ("sum", F.col("_net"))}, reverse=True).crossJoin(F.broadcast(start))
    # The credit of a row is the sum behind it.
    df = df.withColumn("_after", F.col("_sum") - F.col("_net"))
    at_start = df.where(F.col(order) == F.col("start_frame")).agg(F.coalesce(F.max("_after"), F.lit(0)).alias("_first"))
    return df.crossJoin(F.broadcast(at_start)).withColumn("credit", F.when(F.col(order) < F.col("start_frame"), F.col("_first")).otherwise(F.col("_after"))).drop("_net", "_sum", "_after", "_first")


def _compose(steps: list[int], low: int, high: int) -> tuple[int, int, int]:
    """The clamp that a row of steps ``min(high, max(low, r + a))`` makes: r -> min(hi, max(lo, r + a))."""
    a, lo, hi = 0, -(1 << 62), 1 << 62
    for x in steps:
        a, lo, hi = a + x, min(high, max(low, lo + x)), min(high, max(low, hi + x))
    return a, lo, hi


def clamped(df: DataFrame, order: str, step: Column, low: int, high: int, start: int = 0, reverse: bool = False, keys: tuple[str, ...] = (), into: str = "clamped", rows: int = BLOCK_ROWS) -> DataFrame:
    """``r = min(high, max(low, r + step))`` along the order (backwards if ``reverse``): rows (keys, order, into).

    Each block's steps are composed to one triple; the triples of a stream (one for each block) are run through in order,
    and each block is then filled from its own start. Blocks run in parallel.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(order).cast("long").alias("_o"), step.cast("long").alias("_a")).withColumn("_block", F.floor(F.col("_o") / rows).cast("long"))
    kinds = [base.schema[n] for n in names]

    def triple(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o", ascending=not reverse)
        a, lo, hi = _compose(pdf["_a"].tolist(), low, high)
        return pdf[[*names, "_block"]].head(1).assign(a=a, lo=lo, hi=hi)

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", ascending=not reverse)
        r, out = start, []
        for a, lo, hi in zip(pdf["a"].tolist(), pdf["lo"].tolist(), pdf["hi"].tolist(), strict=True):
            out.append(r)
            r = min(hi, max(lo, r + a))
        return pdf[[*names, "_block"]].assign(_r=out)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o", ascending=not reverse)
        r, out = int(pdf["_r"].iloc[0]), []
        for a in pdf["_a"].tolist():
            r = min(high, max(low, r + a))
            out.append(r)
        return pdf[[*names, "_o"]].assign(_v=out)

    long = T.LongType()
    block = T.StructField("_block", long)
    triples = base.groupBy(*names, "_block").applyInPandas(triple, T.StructType([*kinds, block, *[T.StructField(x, long) for x in ("a", "lo", "hi")]]))
    begun = triples.groupBy(*names).applyInPandas(starts, T.StructType([*kinds, block, T.StructField("_r", long)]))
    joined = base.join(begun, [*names, "_block"])
    filled = joined.groupBy(*names, "_block").applyInPandas(fill, T.StructType([*kinds, T.StructField("_o", long), T.StructField("_v", long)]))
    return filled.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("_o").alias(order), F.col("_v").alias(into))


def reserve_curve(df: DataFrame, order: str, demand: Column, supply: Column, capacity: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """What must be kept after each row for later ones: backwards ``min(capacity, max(0, reserve + demand - supply))``, 0 at the end."""
    need = clamped(df, order, demand - supply, 0, capacity, reverse=True, keys=keys, into="_need")
    return neighbours(need, order, {"reserve": "_need"}, keys, ahead=True).withColumn("reserve", F.coalesce("reserve", F.lit(0))).drop("_need")
