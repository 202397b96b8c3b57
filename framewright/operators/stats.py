"""Aggregations: summaries, consensus of noisy samples, histograms, percentiles, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan
from .align import as_of_frames, eight_statistics  # noqa: F401


def timed_statistics(df: DataFrame, value: str, frame: str = "frame", keys: tuple[str, ...] = ()) -> DataFrame:
    """minimum, mean, median, maximum and n of the timed rows (frame above 0); zeros if there are none."""
    v = F.when(F.col(frame) > 0, F.col(value))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return df.groupBy(*keys).agg(zero(F.min(v)).alias("minimum"), zero(F.avg(v)).alias("mean"), zero(F.median(v)).alias("median"), zero(F.max(v)).alias("maximum"), F.count(v).alias("n"))


def consensus(samples: DataFrame, group: list[str], field: str, value: str, confidence: str) -> DataFrame:
    """(group, field, value, votes, trust): the most frequent value; of equal ones that of the most confidence, then the least."""
    votes = samples.groupBy(*group, field, value).agg(F.count("*").alias("votes"), F.sum(confidence).alias("trust"))
    best = F.max(F.struct("votes", "trust", (-F.col(value)).alias("_v")))
    return votes.groupBy(*group, field).agg(best.alias("_b")).select(*group, field, (-F.col("_b._v")).alias(value), F.col("_b.votes").alias("votes"), F.col("_b.trust").alias("trust"))


def group_confidence(samples: DataFrame, group: list[str], sample: str, confidence: str) -> DataFrame:
    """The median over samples of each sample's least confidence."""
    least = samples.groupBy(*group, sample).agg(F.min(confidence).alias("_c"))
    return least.groupBy(*group).agg(F.median("_c").alias("confidence"))


def modal(df: DataFrame, span: list[str], digest: str, order: str) -> DataFrame:
    """(span, digest, samples, unique, outliers): the most frequent digest of a span, the first seen of equal ones."""
    counts = df.groupBy(*span, digest).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("f"), F.col(digest).alias("d"))).alias("_b")
    return counts.groupBy(*span).agg(F.sum("n").alias("samples"), F.count("*").alias("unique"), best).select(*span, F.col("_b.d").alias(digest), "samples", "unique", (F.col("samples") - F.col("_b.n")).alias("outliers"))


def histogram(df: DataFrame, key: Column, bins: int, groups: list[str] | None = None, weight: Column | None = None, dense: bool = False) -> DataFrame:
    """(groups, key, n): counts or sums of weights; dense gives every key from 0 to bins - 1 of each group."""
    groups = groups or []
    found = df.groupBy(*groups, key.cast("int").alias("key")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    if not dense:
        return found
    spark = df.sparkSession
    keys = spark.range(bins).select(F.col("id").cast("int").alias("key"))
    every = found.select(*groups).distinct().crossJoin(F.broadcast(keys)) if groups else keys
    return every.join(found, [*groups, "key"], "left").na.fill(0, ["n"])


def carried_usage(updates: DataFrame, segments: DataFrame, cell: str, frame: str, key: str, last_frame: int) -> DataFrame:
    """(segment, key, frames): for how many frames of each segment a key was shown. An update holds until the cell's next.

    ``segments`` (segment, start, stop) follow one another without gaps. Updates are cut to the frames that segments have. The
    segments of an update's first and last frame are looked up by scans along the axis, so that it meets each segment between
    by an equality, not a range join.
    """
    until = F.coalesce(F.lead(frame).over(W.partitionBy(cell).orderBy(frame)), F.lit(last_frame))
    bounds = segments.agg(F.min("start").alias("_low"), F.max("stop").alias("_high"))
    alive = updates.select(F.col(frame).alias("_from"), F.col(key).alias(key), until.alias("_to")).crossJoin(F.broadcast(bounds))
    alive = alive.select(F.greatest("_from", "_low").alias("_from"), key, F.least("_to", "_high").alias("_to")).where("_to > _from")
    starts = segments.select(F.col("start").alias("_at"))
    first = as_of_frames(alive.withColumnRenamed("_from", "_at"), starts, "_at", "_first").withColumnRenamed("_at", "_from")
    both = as_of_frames(first.withColumn("_at", F.col("_to") - 1), starts, "_at", "_last").drop("_at")
    numbered = scan.numbered(segments, ["start"], F.floor(F.col("start") / scan.BLOCK_ROWS), "_n")
    place = lambda c: numbered.select(F.col("start").alias(c), F.col("_n").alias(f"{c}_n"))
    held = both.join(place("_first"), "_first").join(place("_last"), "_last").withColumn("_n", F.explode(F.sequence("_first_n", "_last_n")))
    span = F.least("_to", "stop") - F.greatest("_from", "start")
    return held.join(numbered, "_n").groupBy("segment", key).agg(F.sum(span).alias("frames"))


def colour_rollup(slots: DataFrame, usage: DataFrame) -> DataFrame:
    """(key, slots, pixels, segments, places): slots (segment, line, index, key) and usage (key, pixels) of either side."""
    places = slots.groupBy("key").agg(F.count("*").alias("slots"), F.sort_array(F.collect_set("segment")).alias("segments"), F.sort_array(F.collect_list(F.struct("segment", "line", "index"))).alias("places"))
    total = usage.groupBy("key").agg(F.sum("pixels").alias("pixels"))
    return places.join(total, "key", "full_outer").na.fill(0, ["slots", "pixels"])


def nearest_rank(df: DataFrame, value: str, quantile: float, keys: tuple[str, ...] = (), into: str = "percentile") -> DataFrame:
    """(keys, into): the percentile of the rank nearest to ``quantile * (n - 1)`` (halves to even); 0 if there are no values.

    Equal values are counted first, and the counts are summed along the values block by block: no group's values meet in one
    task. Nulls do not count; values are numbers but NaN.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    reached = scan.running(counts, "_v", {"_upto": ("sum", F.col("_c"))}, tuple(keys))
    total = df.groupBy(*keys).agg(F.count(value).alias("_all"))
    within = lambda side: F.col("_upto") > F.rint(F.lit(quantile) * (side - 1))
    found = lambda rows: rows.groupBy(*keys).agg(F.min("_v").alias("_v"))
    if not keys:
        return found(reached.crossJoin(F.broadcast(total)).where(within(F.col("_all")))).select(F.coalesce("_v", F.lit(0)).alias(into))
    names = scan._same(keys, "l", "r")
    hit = found(reached.alias("l").join(total.alias("r"), names).where(within(F.col("r._all"))).select("l.*"))
    return total.alias("l").join(hit.alias("r"), names, "left").select(*[f"l.{k}" for k in keys], F.coalesce("r._v", F.lit(0)).alias(into))


def change_profile(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, median, 90th percentile (linear) and maximum."""
    return df.agg(F.avg(value).alias("mean"), F.median(value).cast("double").alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"), F.max(value).cast("double").alias("maximum"))


def ratio_of_sums(part: Column, whole: Column) -> Column:
    return F.sum(part) / F.greatest(F.sum(whole), F.lit(1))


def window_gate(df: DataFrame, segment: str, gain: Column, cost: Column, error: Column, least_gain: float, least_share: float, most_error: float) -> DataFrame:
    """(segment, gain, share, p95, adopted): ratio of sums, share of rows that gain, 95th percentile of the error."""
    found = df.groupBy(segment).agg(ratio_of_sums(gain, cost).alias("gain"), F.avg((gain > cost).cast("int")).alias("share"), F.percentile(error, F.lit(0.95)).alias("p95"))
    return found.withColumn("adopted", (F.col("gain") >= least_gain) & (F.col("share") >= least_share) & (F.col("p95") <= most_error))


def infer_marker(events: DataFrame, site: list[str], order: str, least: int) -> DataFrame:
    """One row: the most frequent site that occurs ``least`` times or more (of these the one of the largest amount, if ``words``
    is among the site's columns), with its first and its ``least``-th place."""
    counts = events.groupBy(*site).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranked = counts.orderBy(*[F.desc(c) for c in (["words"] if "words" in site else [])], F.desc("n"), *site).limit(1)
    places = events.join(F.broadcast(ranked), site).withColumn("_r", F.row_number().over(W.partitionBy(*site).orderBy(order)))
    return places.where((F.col("_r") == 1) | (F.col("_r") == least)).groupBy(*site, "n").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def extrema(df: DataFrame, position: str, value: str, start: int, stop: int, columns: int) -> DataFrame:
    """(column, low, high): least and greatest sample of each of ``columns`` equal parts (edges rounded half to even)."""
    edge = lambda k: F.rint(F.lit(start) + k * F.lit((stop - start) / columns))
    inside = df.where((F.col(position) >= start) & (F.col(position) < stop))
    guess = F.floor((F.col(position) - start) * columns / (stop - start))
    column = F.when(F.col(position) >= edge(guess + 1), guess + 1).when(F.col(position) < edge(guess), guess - 1).otherwise(guess)
    return inside.groupBy(column.cast("int").alias("column")).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def parity_peaks(df: DataFrame, frame: str, load: str) -> DataFrame:
    """(parity, peak, frame): the greatest load of even and odd frames, the first of equal ones."""
    return df.groupBy((F.col(frame) % 2).cast("int").alias("parity")).agg(F.max(F.struct(F.col(load).alias("l"), (-F.col(frame)).alias("f"))).alias("_m")).select("parity", F.col("_m.l").alias("peak"), (-F.col("_m.f")).alias(frame))


def verdict(maxima: DataFrame, limits: dict[str, tuple[float, float]], complete: Column | None = None) -> DataFrame:
    """Add failures, warnings, passed and alert: limits are (warning above, failure above) of columns; missing values fail."""
    tell = lambda c, what: F.format_string(f"{c} {what} %s", F.col(c).cast("string"))
    fails = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")).when(F.col(c) > most, tell(c, "over limit")) for c, (_, most) in limits.items()]
    warns = [F.when((F.col(c) > warn) & (F.col(c) <= most), tell(c, "near limit")) for c, (warn, most) in limits.items()]
    if complete is not None:
        fails.append(F.when(~complete, F.lit("incomplete")))
    out = maxima.withColumn("failures", F.array_compact(F.array(*fails))).withColumn("warnings", F.array_compact(F.array(*warns)))
    return out.withColumn("passed", F.size("failures") == 0).withColumn("alert", F.when(F.size("failures") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("PASS"))


#: Where a displaced black or white may lie (first, last, the first level beyond), and how it must stand out.
BLACK, WHITE, SPIKE_SHARE, SPIKE_OVER_REST = (1, 16, 17), (239, 254, 238), 0.01, 3.0


def stretch_points(levels: list[int]) -> tuple[int, int]:
    """(black, white) of a histogram of 256 levels: the level of a spike near either end that holds enough of all samples, stands
    out from the others there and from the first level beyond; 0 and 255 where there is none."""

    def spike(first: int, last: int, beyond: int, none: int) -> int:
        peak = max(range(first, last + 1), key=lambda v: (levels[v], -v))
        rest = sum(levels[first : last + 1]) - levels[peak]
        stands_out = levels[peak] >= SPIKE_OVER_REST * max(rest / (last - first), 1.0) and levels[peak] > levels[beyond]
        return peak if levels[peak] and levels[peak] >= SPIKE_SHARE * sum(levels) and stands_out else none

    return spike(*BLACK, 0), spike(*WHITE, 255)
