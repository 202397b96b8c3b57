"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions, racks and shards. A row descends it level by level: each child of the node that
it has come to draws an exponential variate of the child's weight (that of all leaves below), ``-ln(u) / weight`` with ``u``
from a hash of the row's key, the level and the child's name; the row goes to the child of the least draw. So a child wins
with its share of the node's weight, a row costs as many hashes as its path has siblings, and a draw depends on one child
alone: where a child's weight rises, the rows of that node move only into it, where it falls, only out of it, and below nodes
whose weights stay the same nothing moves.

Growth. A leaf that is added later stands beside the regions as a branch of its own until the tree is built anew: its draw
competes with the regions' draws, and rows that it does not win descend the old tree as before. So a new shard (or more
weight for an old one) takes rows only into itself.

DataFrame functions only. Defined results: a null key draws as a key of its own; rows with equal keys go to one shard;
a null text has size 1 and the checksum 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slots

SHARDS = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, racks_a_region: int = 2, shards_a_rack: int = 4) -> list[Leaf]:
    """A tree that is filled from the left: ``tree(n + 1)`` is ``tree(n)`` with one leaf more."""
    return [Leaf(k // prod((racks_a_region, shards_a_rack)), k // shards_a_rack, k) for k in range(shards)]


def draw(key: Column, level: str, name: int, weight: float) -> Column:
    """An exponential variate of rate ``weight``; 53 bits of the hash make a number in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(name)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _winner(key: Column, level: str, leaves: list[Leaf]) -> Column:
    """The struct (draw, name) of the child at ``level`` that wins, among the children that the leaves stand below."""
    weights: dict[int, float] = {}
    for x in leaves:
        name = getattr(x, level)
        weights[name] = weights.get(name, 0.0) + x.weight
    drawn = [F.struct(draw(key, level, name, w).alias("draw"), F.lit(name).alias("name")) for name, w in weights.items()]
    return drawn[0] if len(drawn) == 1 else F.least(*drawn)


def _below(key: Column, level: str, above: str, at: Column, leaves: list[Leaf]) -> Column:
    """The name of the winner at ``level`` below the node ``at`` of the level above; only that node's children draw."""
    out = F.lit(None).cast("int")
    for name in {getattr(x, above): None for x in leaves}:
        children = [x for x in leaves if getattr(x, above) == name]
        only = {getattr(x, level) for x in children}
        won = F.lit(only.pop()) if len(only) == 1 else _winner(key, level, children)["name"]
        out = F.when(at == name, won).otherwise(out)
    return out


def with_descent(df: DataFrame, key: Column, leaves: list[Leaf], into: tuple[str, str, str] = ("region", "rack", "shard"), added: tuple[Leaf, ...] = ()) -> DataFrame:
    """Add the region, rack and shard at which a key ends; leaves of no weight are left out. ``added`` are later branches."""
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves:
        raise ValueError("a tree needs a leaf of positive weight")
    region, rack, shard = into
    df = df.withColumn("_key", F.coalesce(key.cast("string"), F.lit("\x00null"))).withColumn("_top", _winner(F.col("_key"), "region", leaves))
    df = df.withColumn(region, F.col("_top.name")).withColumn(rack, _below(F.col("_key"), "rack", "region", F.col(region), leaves))
    df = df.withColumn(shard, _below(F.col("_key"), "shard", "rack", F.col(rack), leaves))
    for k, x in enumerate(added):
        won = F.struct(draw(F.col("_key"), "branch", k, x.weight).alias("draw"), F.lit(-1 - k).alias("name"))
        df = df.withColumn("_top", F.least("_top", won))
        for column, value in zip(into, (x.region, x.rack, x.shard), strict=True):
            df = df.withColumn(column, F.when(F.col("_top.name") == -1 - k, value).otherwise(F.col(column)))
    return df.drop("_key", "_top")


def shards(docs: DataFrame, count: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", position_col: str | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack), one for each row of ``docs``.

    ``slot`` numbers a shard's rows from 0 without gaps; with a ``position_col`` (whole numbers from 0, spread evenly) in the
    order of that. ``grown_shard`` is the shard under one leaf more.
    """
    return shards_of(measured(docs, id_col, text_col, [position_col] if position_col else []), count, position_col)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32 and the columns to keep): what sharding needs of a document, without its text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"), *(keep or []))


def shards_of(found: DataFrame, count: int = SHARDS, position_col: str | None = None, rows: int | None = None) -> DataFrame:
    """``shards`` of rows as ``measured`` gives them; ``rows`` is their number, counted if it is needed and not given."""
    leaves = tree(count)
    new = Leaf(1 + max(x.region for x in leaves), 1 + max(x.rack for x in leaves), count)
    placed = with_descent(found, F.col("doc_id"), leaves)
    placed = with_descent(placed, F.col("doc_id"), leaves, ("_region", "_rack", "grown_shard"), (new,)).drop("_region", "_rack").withColumn("law", F.lit("key"))
    if position_col:
        rows, buckets = found.count() if rows is None else rows, max(64, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        numbered = slots(placed, "shard", [F.col(position_col)], "slot", bucket=F.floor(F.col(position_col) / F.lit(1 + rows // buckets)))
    else:
        numbered = slots(placed, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "region", "rack")


def with_shard(docs: DataFrame, count: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``shard`` (in place of one of that name)."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"))
    placed = with_descent(row, F.col("_id"), tree(count), ("_region", "_rack", "_shard"))
    others = [F.col(f"_row.`{c}`") for c in docs.columns if c != "shard"]
    found = placed.select(*others, F.col("_shard").alias("shard"))
    return found.select(*docs.columns) if "shard" in docs.columns else found
