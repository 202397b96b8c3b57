"""Tab-separated traces and text logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.align import axis


def _place() -> Column:
    """Where a row of a file source stands: file, split of the file, row in the split (a partition has its splits in any order)."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, needed: list[str] | None = None, place: str | None = None) -> DataFrame:
    """A table with a header; all text without a schema. Blank cells are null. Empty tables and missing columns are errors.
    ``place`` names a column to add that orders the rows as their files do (files by name)."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "").option("mode", "FAILFAST")
    df = reader.csv(path)
    if missing := [c for c in needed or [] if c not in df.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    added = [_place().alias(place)] if place else []
    if schema is not None:
        kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds], *added)
    elif added:
        df = df.select("*", *added)
    if df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return df


def read_trace(spark: SparkSession, path: str, schema: T.StructType | str, frame: str = "frame", last_frame: int | None = None) -> DataFrame:
    """A trace in frame order: rows behind ``last_frame`` are left out, of a repeated frame the last row of the file stays
    (of several files that of the last by name), and the frames must be 0 to n - 1."""
    from pyspark.sql import Window as W

    df = read_tsv(spark, path, schema, [frame], place="_place")
    if last_frame is not None:
        df = df.where(F.col(frame) <= last_frame)
    latest = F.row_number().over(W.partitionBy(frame).orderBy(F.desc("_place")))
    df = df.withColumn("_r", latest).where("_r = 1").drop("_r", "_place")
    if not axis(df, frame).first()["contiguous"]:
        raise ValueError(f"{path}: the frames are not 0 to n - 1")
    return df


def number_text(c: str, kind: str) -> F.Column:
    """Whole numbers without a point, others with all their digits."""
    if kind not in ("double", "float"):
        return F.col(c).cast("string")
    v = F.col(c).cast("double")
    return F.when((v == F.rint(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One table in the given order (a sort over all rows), nulls as blanks; put in place by Spark's commit."""
    rows = df.orderBy(*order) if order else df
    rows.select(*[number_text(c, k).alias(c) for c, k in df.dtypes]).write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str, version: int) -> None:
    """Versioned JSON lines."""
    df.select(F.lit(version).alias("schema_version"), *df.columns).write.mode("overwrite").json(path)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lines(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """(value) of text files, gz or plain by their suffix; with the column ``place``, their order, if it is named."""
    log = spark.read.text(path)
    return log.select("value", _place().alias(place)) if place else log


#: Fixed value: the form of a transfer line of the device log.
TRANSFER = r"\[(\d+)\(\d+\)\]\[(\d+)\(\d+\)\] DMA type (\d+) \((\d+) access/line\)\((\d+) cycles left\)-> (\d+) access \((\d+) remaining\) \(([0-9a-fA-F]+)\)"


def transfers(log: DataFrame) -> DataFrame:
    """(line, cycle, type, rate, left, words, remaining, pc) of a log's transfer lines; pc is cut to 16 bits."""
    names = ("line", "cycle", "type", "rate", "left", "words", "remaining")
    hit = log.where(F.col("value").rlike(TRANSFER))
    fields = [F.regexp_extract("value", TRANSFER, k + 1).cast("int").alias(n) for k, n in enumerate(names)]
    pc = F.conv(F.regexp_extract("value", TRANSFER, 8), 16, 10).cast("long").bitwiseAND(0xFFFF).cast("int")
    return hit.select(*fields, pc.alias("pc"))


def compacted(log: DataFrame, noise: str) -> tuple[DataFrame, DataFrame]:
    """(lines that are no noise, one row with the number dropped)."""
    noisy = F.col("value").rlike(noise)
    return log.where(~noisy), log.agg(F.count_if(noisy).alias("dropped"))


def summaries(log: DataFrame, prefixes: list[str], place: str | None = None) -> DataFrame:
    """(prefix, line): the last line of the log that starts with each prefix, in the order of ``place``; a log without that
    column must be one unsplit file (a compressed one, say), whose rows are in order."""
    from framewright.functions.scalars import last_by_prefix

    return last_by_prefix(log if place else log.withColumn("_o", F.monotonically_increasing_id()), "value", place or "_o", prefixes)
