"""Top-k, priority orders and set operations with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dictionary(uses: DataFrame, key: str, protected: Column, ordinal: str, capacity: int) -> DataFrame:
    """(key, uses, protected, first): the ``capacity`` keys of the most uses, then most protected ones, first seen, least key."""
    counts = uses.groupBy(key).agg(F.count("*").alias("uses"), F.sum(protected.cast("long")).alias("protected"), F.min(ordinal).alias("first"))
    return counts.orderBy(F.desc("uses"), F.desc("protected"), "first", key).limit(capacity)


def top_of_each(df: DataFrame, keys: list[str], order: list[Column], limit: Column | int, into: str = "rank") -> DataFrame:
    """The first rows of each group, up to a limit that may differ from group to group."""
    ranked = df.withColumn(into, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(into) <= limit)


def first_requests(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """(key, place): the first ``n`` distinct keys by their first request, numbered from the last on (place 0)."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_f")).orderBy("_f", key).limit(n)
    return first.select(key, (F.row_number().over(W.orderBy(F.desc("_f"), F.desc(key))) - 1).alias("place"))


def distinct_in_order(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, ordinal): each key at its first place."""
    return df.groupBy(key).agg(F.min(ordinal).alias(ordinal))


def greedy_groups(groups: list[tuple[int, int, set[int]]], existing: set[int], capacity: int) -> list[int]:
    """Of (benefit, start, boundaries) groups, a few on the driver: taken by (most benefit, first start) while all boundaries fit."""
    held, taken = set(existing), []
    for k in sorted(range(len(groups)), key=lambda k: (-groups[k][0], groups[k][1])):
        if len(held | groups[k][2]) <= capacity:
            held |= groups[k][2]
            taken.append(k)
    return sorted(taken)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).union(b.exceptAll(a))


def only_left(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")
