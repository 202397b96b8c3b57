"""Running values over ordered rows, block by block.

A window over one long stream would put all its rows into one task. Here the order column (dense whole numbers) is cut into
blocks; windows run inside a block, and what a block hands on (its sum, extreme or last value) is scanned over the blocks, of
which there are few. So a single stream, or one that holds most rows, is still worked on by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def _same(names: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def _handed_on(df: DataFrame, keys: list[str], totals: dict[str, Column], step, reverse: bool) -> DataFrame:
    """Join each row with what the blocks before its own (after it, if reverse) hand on."""
    blocks = df.groupBy(*keys, "_block").agg(*[v.alias(k) for k, v in totals.items()])
    over = W.partitionBy(*keys).orderBy(F.desc("_block") if reverse else F.asc("_block")).rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select(*keys, "_block", *[step(k).over(over).alias(f"_from{k}") for k in totals])
    names = [*keys, "_block"]
    return df.alias("l").join(before.alias("r"), _same(names, "l", "r"), "left").select("l.*", *[f"r._from{k}" for k in totals])


def blocked(df: DataFrame, order: str, rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(rows)).cast("long"))


def numbered(df: DataFrame, order: list[str], bucket: Column, into: str = "frame", keys: tuple[str, ...] = ()) -> DataFrame:
    """Number rows from 0 by ``order``. ``bucket`` never falls as the order rises, and cuts the rows into many parts."""
    df, keys = df.withColumn("_bucket", bucket), list(keys)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    joined = df.withColumn("_rank", rank).alias("l").join(starts.alias("r"), _same([*keys, "_bucket"], "l", "r")).select("l.*", "r._start")
    return joined.withColumn(into, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_rank", "_start")


_RUN = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_JOIN = {
    "sum": lambda before, own: F.when(before.isNull() & own.isNull(), None).otherwise(F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "count": lambda before, own: F.coalesce(before, F.lit(0)) + own,
    "max": F.greatest,
    "min": F.least,
    "last": lambda before, own: F.coalesce(own, before),
}


def running(df: DataFrame, order: str, specs: dict[str, tuple[str, Column]], keys: tuple[str, ...] = (), reverse: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add running values up to and with each row: {name: (sum | count | max | min | last, column)}; last skips nulls."""
    keys = list(keys)
    df = blocked(df, order, rows)
    for name, (_, c) in specs.items():
        df = df.withColumn(f"_in_{name}", c)
    totals = {}
    for name, (kind, _) in specs.items():
        c = F.col(f"_in_{name}")
        edge = (F.min_by if reverse else F.max_by)(c, F.when(c.isNotNull(), F.col(order)))
        totals[f"_{name}"] = edge if kind == "last" else _RUN[kind](c)
    step = lambda k: _RUN["sum" if specs[k[1:]][0] == "count" else specs[k[1:]][0]](F.col(k))
    own = W.partitionBy(*keys, "_block").orderBy(F.desc(order) if reverse else F.asc(order)).rowsBetween(W.unboundedPreceding, 0)
    out = _handed_on(df, keys, totals, step, reverse)
    out = out.select("*", *[_RUN[kind](F.col(f"_in_{name}")).over(own).alias(f"_own_{name}") for name, (kind, _) in specs.items()])
    for name, (kind, _) in specs.items():
        out = out.withColumn(name, _JOIN[kind](F.col(f"_from_{name}"), F.col(f"_own_{name}")))
    return out.drop("_block", *[f"{p}_{n}" for n in specs for p in ("_in", "_from", "_own")])


def neighbours(df: DataFrame, order: str, specs: dict[str, str], keys: tuple[str, ...] = (), ahead: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the values of the row before (or ahead): {name: column}; null where there is none."""
    keys = list(keys)
    df = blocked(df, order, rows).withColumn("_in", F.struct(*[F.col(c).alias(n) for n, c in specs.items()]))
    totals = {"_edge": (F.min_by if ahead else F.max_by)("_in", order)}
    out = _handed_on(df, keys, totals, lambda k: F.last(k, ignorenulls=True), reverse=ahead)
    own = W.partitionBy(*keys, "_block").orderBy(F.desc(order) if ahead else F.asc(order))
    out = out.withColumn("_near", F.coalesce(F.lag("_in").over(own), F.col("_from_edge")))
    return out.select("*", *[F.col(f"_near.{n}").alias(n) for n in specs]).drop("_block", "_in", "_from_edge", "_near")
