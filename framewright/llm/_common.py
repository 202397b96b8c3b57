"""Helpers that the corpus operators share: inputs, durable intermediates, bounded broadcasts, components, ranks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has been counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000
#: Edges of a graph that one task contracts (16 bytes each).
EDGES_A_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset on one machine (tests), a temporary folder is set; on a
    cluster, whose executors could not see it, that is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="framewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it from there, with its columns only."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the table that ``df`` reads, one that ``written`` made and nothing reads any more."""
    jvm, tables = df.sparkSession.sparkContext._jvm, f"{shared_folder(df.sparkSession)}/tables/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(tables).toUri().getPath()):
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def forgotten(df: DataFrame) -> None:
    """Delete the files of ``df``, one that ``durable`` made and nothing reads any more, and the shuffles that only it or others
    out of use had. Spark itself keeps the former, and the latter until the driver happens to collect garbage."""
    sc, at = df.sparkSession.sparkContext, df._jdf.logicalPlan().rdd().getCheckpointFile()
    if at.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    sc._jvm.System.gc()


def filtered(df: DataFrame, column: str, ids: DataFrame, how: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` whose whole-number ``column`` is among ``ids`` (one column; how: left_semi) or is not (left_anti).

    Ids are packed, 64 neighbours to a row, so that a broadcast holds up to 64 times ``bound`` of them and ``df``, with its
    texts, need not be shuffled. Ids so sparse that their packed rows pass the bound leave the join to a shuffle.
    """
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("_id")).where("_id is not null")
    packed = durable(ids.groupBy(F.shiftright("_id", 6).alias("_high")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_id & 63 as int))")).alias("_bits")))
    if (n := packed.count()) > bound:
        return df.join(ids.distinct(), F.col(column) == F.col("_id"), how)
    own = F.col(column).cast("long")
    held = df.join(small(packed, n, bound), F.shiftright(own, 6) == F.col("_high"), "left")
    found = F.coalesce(F.expr(f"(shiftright(_bits, cast(`{column}` & 63 as int)) & 1) = 1"), F.lit(False))
    return held.where(found if how == "left_semi" else ~found).drop("_high", "_bits")


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (counted unless ``rows`` is given) is within ``bound``; else leave the join to a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= bound else df


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python functions get Arrow batches of so many rows; for steps that end inside (see ``durable``)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remainder(id_column: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def slots(df: DataFrame, group: str, order: list[Column], into: str, buckets: int | None = None, bucket: Column | None = None, ties: tuple[Column, ...] = ()) -> DataFrame:
    """Number the rows of each group from 0 without gaps, with no task that must see a whole group.

    Rows are dealt into ``buckets`` by a hash of the order columns (1,024, or as many as the session has shuffle partitions); a
    bucket starts after the rows of the buckets before it. Only the counts, one row for each group and bucket, meet in one place.
    With a ``bucket`` that rises with the order columns, the numbers follow that order. ``ties`` order equal rows in a bucket.
    """
    from pyspark.sql import Window as W

    buckets = buckets or max(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_bucket", (F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket).cast("int"))
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order, *ties))
    numbered = dealt.withColumn("_rank", rank)
    joined = numbered.join(small(starts), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.withColumn(into, F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_rank", "_g", "_b", "_start")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of a graph's edges: each node that is not the least of its component, and that least node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column("a").to_numpy(zero_copy_only=False), x.column("b").to_numpy(zero_copy_only=False)) for x in batches]
    if parts:
        nodes, roots = forest(*(np.concatenate(p).astype(np.int64) for p in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = low.groupBy("a").agg(F.min("b").alias("m"))
    linked = low.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root being the smallest node that can be reached.

    First each task contracts up to ``edges_a_task`` edges to stars around least nodes, and again while that leaves fewer tasks.
    If one task has all, that is the answer. Else large-star and small-star steps follow by turns: each is an aggregation of the
    least neighbour and a join with it, so a hub's neighbours are never gathered in one row. Every second step is cut off by a
    checkpoint, and the one before is deleted. Nodes without an edge have no row; self-edges and repeated edges do no harm; no
    edges give no rows.
    """
    edges = durable(edges.where("a <> b").select("a", "b"))
    needed = lambda: max(1, -(-edges.count() // edges_a_task))
    tasks, fewer = None, needed()
    while tasks is None or 1 < tasks > fewer:
        tasks, before = fewer, edges
        edges = durable(edges.coalesce(tasks).mapInArrow(_contracted, "a long, b long"))
        forgotten(before)
        fewer = needed() if tasks > 1 else 1
    digest = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    now, stable = digest(edges) if tasks > 1 else None, tasks == 1
    while not stable:
        before, past = now, edges
        edges = durable(_starred(edges))
        now = digest(edges)
        stable = now == before
        forgotten(past)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
