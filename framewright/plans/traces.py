"""Traces made of the driver's tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.scan import numbered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace: frame (by time), event_id, user_id, state, x (hundredths), seconds, second (whole) and props."""
    df = read(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    df = df.select("event_id", "ts", "user_id", F.col("event_type").alias("state"), F.round(F.col("value") * 100).cast("long").alias("x"), F.floor(micros / 1_000_000).cast("long").alias("second"), "props")
    return numbered(df, ["ts", "event_id"], F.date_trunc("hour", "ts"))


EVENTS = """ev AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS frame, event_id, ts, user_id, event_type AS state,
    CAST(round(value * 100) AS BIGINT) AS x, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS second, props FROM events
)"""


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each user."""
    return numbered(events(spark, sf_dir).drop("frame"), ["ts", "event_id"], F.date_trunc("day", "ts"), keys=("user_id",))


USER_EVENTS = f"""{EVENTS}, uev AS (SELECT * EXCLUDE (frame), row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM ev)"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace of shipping days: frame, demand (pieces) and supply (pieces of another kind of line)."""
    df = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("demand"),
        F.sum(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).otherwise(0).cast("long") * 2).alias("supply"),
        F.count("*").alias("lines"),
    )
    return numbered(df, ["day"], F.year("day"))


DAYS = """dy AS (
  SELECT row_number() OVER (ORDER BY day) - 1 AS frame, * FROM (
    SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS demand,
      CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS BIGINT) ELSE 0 END * 2) AS BIGINT) AS supply, count(*) AS lines
    FROM lineitem GROUP BY 1))"""
