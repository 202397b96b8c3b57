"""Joins along the frame axis, as-of look-ups, and exact comparison of two traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import running


def joined(a: DataFrame, b: DataFrame, frame: str = "frame", condition: str = "true") -> DataFrame:
    """Inner join of two traces on the frame, without the untimed frame 0."""
    return a.join(b, frame).where(f"{frame} <> 0 and ({condition})")


def axis(df: DataFrame, frame: str = "frame") -> DataFrame:
    """One row: n, first, last and ``contiguous`` (0 to n - 1, each once)."""
    return df.agg(F.count("*").alias("n"), F.min(frame).alias("first"), F.max(frame).alias("last"), F.count_distinct(frame).alias("_d")).select("n", "first", "last", ((F.col("n") == F.col("_d")) & (F.coalesce("first", F.lit(0)) == 0) & (F.coalesce("last", F.lit(-1)) == F.col("n") - 1)).alias("contiguous"))


def axis_difference(a: DataFrame, b: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, side): frames that only one trace has."""
    both = a.select(F.col(frame), F.lit(1).alias("in_a")).join(b.select(F.col(frame), F.lit(1).alias("in_b")), frame, "full_outer")
    return both.where("in_a is null or in_b is null").select(frame, F.when(F.col("in_a").isNull(), "missing").otherwise("extra").alias("side"))


def attach(rows: DataFrame, other: DataFrame, status: Column, frame: str = "frame") -> DataFrame:
    """Strict one-to-one join: each frame in both, once; an error otherwise. Adds ``status``."""
    if not axis_difference(rows, other, frame).isEmpty():
        raise ValueError("the traces' frames differ")
    return rows.join(other, frame).withColumn("status", status)


def mismatches(a: DataFrame, b: DataFrame, on: str, left: Column, right: Column) -> DataFrame:
    """Left join; (on, a_value, b_value) where both are known and differ."""
    return a.select(on, left.alias("a_value")).join(b.select(on, right.alias("b_value")), on, "left").where("b_value is not null and a_value <> b_value")


def as_of(df: DataFrame, events: DataFrame, at: str, event_at: str, into: str, forward: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add the last event at or before each row (the first at or after it, if forward): one sort of both sides' union."""
    keys = list(keys)
    sign = -1 if forward else 1
    rows = df.select(F.struct(*df.columns).alias("_row"), *keys, F.col(at).alias("_at"), F.lit(None).cast(events.schema[event_at].dataType).alias("_event"))
    union = rows.unionByName(events.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *keys, F.col(event_at).alias("_at"), F.col(event_at).alias("_event")))
    order = W.partitionBy(*keys).orderBy(F.desc("_at") if sign < 0 else F.asc("_at"), F.col("_event").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    return union.withColumn(into, F.last("_event", ignorenulls=True).over(order)).where("_row is not null").select("_row.*", into)


def as_of_frames(df: DataFrame, events: DataFrame, frame: str, into: str, forward: bool = False, keys: tuple[str, ...] = (), rows: int = 65_536) -> DataFrame:
    """``as_of`` for one long stream on whole frames: scanned block by block."""
    flag = events.select(*keys, F.col(frame), F.col(frame).alias("_event")).distinct()
    both = df.withColumn("_own", F.lit(True)).unionByName(flag.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    found = running(both, frame, {into: ("last", F.col("_event"))}, keys, reverse=forward, rows=rows)
    # Of rows on one frame the event may stand either side; its own frame is the answer there.
    at = W.partitionBy(*keys, frame)
    found = found.withColumn(into, F.coalesce(F.max("_event").over(at), F.col(into)))
    return found.where("_own").drop("_own", "_event")


def nearest(df: DataFrame, at: str, points: DataFrame, point_at: str, point: str, bucket: int, cells: int = 1_024) -> DataFrame:
    """Add the nearest point (of equally near ones the least) and its ``distance`` to each row that has one in its own bucket of
    values, ``bucket`` wide, or in either neighbouring one; other rows go.

    No row meets more than two points: the last value at or below its own and the first at or above it. Buckets are cut into
    ``cells``, whose edge values are handed on from cell to cell, so a full bucket is worked on by many tasks.
    """
    cell = lambda c: F.floor(F.col(c) * F.lit(cells / bucket))
    place = points.where(F.col(point_at).isNotNull()).groupBy(F.col(point_at).alias("_v")).agg(F.min(point).alias("_id")).withColumn("_cell", cell("_v"))
    rows = df.where(F.col(at).isNotNull()).withColumn("_w", F.col(at)).withColumn("_cell", cell(at))
    pair = F.struct("_v", "_id")
    edges = place.groupBy("_cell").agg(F.max(pair).alias("_top"), F.min(pair).alias("_bottom"))
    edges = rows.select("_cell").distinct().join(edges, "_cell", "full_outer")
    upward, downward = (W.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_cell"), F.desc("_cell")))
    edges = edges.select("_cell", F.last("_top", ignorenulls=True).over(upward).alias("_under"), F.last("_bottom", ignorenulls=True).over(downward).alias("_over"))
    both = rows.unionByName(place.select("_cell", F.col("_v").alias("_w"), pair.alias("_p")), allowMissingColumns=True)
    order = lambda o: W.partitionBy("_cell").orderBy(o, F.col("_p").isNull()).rowsBetween(W.unboundedPreceding, 0)
    seen = both.select("*", F.last("_p", ignorenulls=True).over(order(F.asc("_w"))).alias("_below"), F.last("_p", ignorenulls=True).over(order(F.desc("_w"))).alias("_above")).where("_p is null")
    number = lambda c: F.floor(c / bucket)
    choice = lambda p: F.when(F.abs(number(p["_v"]) - number(F.col(at))) <= 1, F.struct(F.abs(F.col(at) - p["_v"]).alias("d"), p["_id"].alias("id")))
    found = seen.join(edges, "_cell").withColumn("_m", F.least(choice(F.coalesce("_below", "_under")), choice(F.coalesce("_above", "_over"))))
    return found.where("_m is not null").select(*df.columns, F.col("_m.id").alias(point), F.col("_m.d").alias("distance"))


def interval_extra(df: DataFrame, intervals: DataFrame, frame: str, position: str, normal: int) -> DataFrame:
    """For inclusive intervals (start, stop): the sum of steps above ``normal`` from each frame to the frame numbered next."""
    following = df.select((F.col(frame) - 1).alias(frame), F.col(position).alias("_next"))
    extra = df.join(following, frame, "left").select(frame, F.greatest(F.lit(0), F.coalesce(F.col("_next") - F.col(position) - normal, F.lit(0))).alias("_e"))
    total = running(extra, frame, {"_sum": ("sum", F.col("_e"))})
    # Sums of ranges are differences of running sums; frames may be missing, so each end takes the last sum before it.
    ends = intervals.select("start", "stop", F.explode(F.array(F.struct((F.col("start") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("stop").alias("at"), F.lit(1).alias("sign")))).alias("e")).select("start", "stop", F.col("e.at").alias(frame), F.col("e.sign").alias("sign"))
    marks = total.select(frame, "_sum").unionByName(ends, allowMissingColumns=True)
    marks = marks.withColumn("_o", F.col(frame) * 2 + F.when(F.col("sign").isNull(), 0).otherwise(1))
    found = running(marks, "_o", {"_s": ("last", F.col("_sum"))}).where("sign is not null")
    return found.groupBy("start", "stop").agg(F.sum(F.col("sign") * F.coalesce("_s", F.lit(0))).cast("long").alias("extra"))


def best_neighbour(a: DataFrame, b: DataFrame, frame: str, error: Column, reach: int = 1) -> DataFrame:
    """(frame, match, error): of the other trace's frames within ``reach``, that of the least error; of equal ones the first."""
    near = a.withColumn("_at", F.explode(F.sequence(F.col(frame) - reach, F.col(frame) + reach)))
    pairs = near.alias("a").join(b.alias("b"), F.col("a._at") == F.col(f"b.{frame}"))
    return pairs.groupBy(F.col(f"a.{frame}").alias(frame)).agg(F.min(F.struct(error.alias("error"), F.col(f"b.{frame}").alias("match"))).alias("m")).select(frame, F.col("m.match").alias("match"), F.col("m.error").alias("error"))


def first_mismatch(a: DataFrame, b: DataFrame, at: str, value: str) -> DataFrame:
    """One row: the first place at which two sequences differ, a missing tail included; null if they are equal."""
    left, right = (x.select(F.col(at), F.struct(value).alias(n)) for x, n in ((a, "l"), (b, "r")))
    return left.join(right, at, "full_outer").agg(F.min(F.when(~F.col("l").eqNullSafe(F.col("r")), F.col(at))).alias("first_mismatch"))


STATISTICS = ("count", "sum", "mean", "median", "minimum", "maximum", "last", "nonzero_count")


def eight_statistics(value: Column, order: Column) -> list[Column]:
    """count, sum, mean, median, minimum, maximum, last and nonzero count of a value that may be null."""
    known = F.when(value.isNotNull(), order)
    found = (F.count(value), F.sum(value), F.avg(value), F.median(value), F.min(value), F.max(value), F.max_by(value, known), F.count_if(value != 0))
    return [c.cast("double").alias(n) for c, n in zip(found, STATISTICS, strict=True)]


def compare(a: DataFrame, b: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """(scope, metric, statistic, main_value, candidate_value, delta, delta_percent, comparison) for the whole traces and
    for their timed part (without the first row)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        long = df.unpivot([order], metrics, "metric", "value").withColumn("value", F.col("value").cast("double"))
        scoped = long.withColumn("scope", F.explode(F.when(F.col(order) > 0, F.array(F.lit("movie"), F.lit("timed"))).otherwise(F.array(F.lit("movie")))))
        found = scoped.groupBy("scope", "metric").agg(*eight_statistics(F.col("value"), F.col(order)))
        return found.unpivot(["scope", "metric"], list(STATISTICS), "statistic", name)

    on = ["scope", "metric", "statistic"]
    both = side(a, "main_value").join(side(b, "candidate_value"), on)
    delta = F.col("candidate_value") - F.col("main_value")
    percent = F.when(F.col("main_value") != 0, delta / F.abs("main_value") * 100)
    return both.withColumn("delta", delta).withColumn("delta_percent", percent).withColumn("comparison", F.when(delta == 0, "equal").when(delta > 0, "increase").otherwise("decrease"))


def compare_keyed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, main_value, candidate_value, comparison) over the keys of either side; ``<missing>`` where a side has none."""
    left, right = (x.select(key, F.col(value).cast("string").alias(n)) for x, n in ((a, "main_value"), (b, "candidate_value")))
    both = left.join(right, key, "full_outer").na.fill("<missing>", ["main_value", "candidate_value"])
    return both.withColumn("comparison", F.when(F.col("main_value") == F.col("candidate_value"), "equal").otherwise("changed"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side``; repeated rows count."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def sequence_digest(df: DataFrame, order: str, value: str, parts: int = 4_096) -> DataFrame:
    """One row: n and a SHA-256 digest of a sequence, over the digests of its runs of ``parts`` rows (each ends by a line feed)."""
    block = df.withColumn("_b", F.floor(F.col(order) / parts))
    line = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))), lambda x: x["v"]), "\n"), F.lit("\n"))
    parts_of = block.groupBy("_b").agg(F.sha2(line, 256).alias("d"), F.count("*").alias("n"))
    total = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "d"))), lambda x: x["d"]), "\n"), F.lit("\n"))
    return parts_of.agg(F.sum("n").alias("n"), F.sha2(total, 256).alias("digest"))
