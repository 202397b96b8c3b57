"""Queries of kernels and folds. Most have no SQL; tests hold them against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import motion, planning, signal, tiles

from .queries import query
from .traces import DAYS, days, events, read


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as small pictures: 64 floats, each an 8 by 8 grey tile, put side by side four times in either direction."""
    level = lambda v: F.least(F.greatest(F.round((v + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int")
    grey = F.transform("embedding", lambda v: F.lpad(F.hex(level(v)), 2, "0"))
    row = lambda k: F.concat(*[F.array_join(F.transform(F.slice(grey, k * 8 + 1, 8), lambda h: F.concat(h, h, h)), "")] * 4)
    pixels = F.unhex(F.repeat(F.concat(*[row(k) for k in range(8)]), 4))
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(32).alias("height"), F.lit(32).alias("width"), pixels.alias("pixels"), "label")


def _palettes() -> dict[int, np.ndarray]:
    return {k: np.stack([np.clip(np.arange(15) // 2 + k, 0, 7)] * 3, axis=1).astype(np.uint8) for k in range(4)}


@query("o1_09_frame_features")
def features(spark, sf):
    return tiles.frame_features(_frames(spark, sf))


@query("o3_03_dithered_tiles")
def dithered(spark, sf):
    return tiles.tiles(_frames(spark, sf), "edge").select("frame", "cell", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


_LINES_SQL = """WITH px AS (SELECT vec_id AS frame, (CAST(least(greatest(round((unnest(embedding)::DOUBLE + 0.5) * 255), 0), 255) AS BIGINT) * 7 + 127) // 255 AS q FROM embeddings),
cost AS (SELECT k, q, min(3 * (q - least(i // 2 + k, 7)) * (q - least(i // 2 + k, 7))) AS err FROM range(4) a(k), range(8) b(q), range(15) c(i) GROUP BY k, q),
e AS (SELECT frame, k, CAST(sum(err) AS BIGINT) AS error FROM px JOIN cost USING (q) GROUP BY 1, 2)
SELECT frame, CAST(cell AS INTEGER) AS cell, CAST(arg_min(k, error * 4 + k) AS INTEGER) AS line, min(error) AS error FROM e, range(16) t(cell) GROUP BY 1, 2"""


@query("o9_04_line_assignment", _LINES_SQL)
def lines(spark, sf):
    return tiles.assign_lines(tiles.tiles(_frames(spark, sf)), tiles.nearest_lut(spark, _palettes()))


@query("o9_05_learned_lines")
def learned(spark, sf):
    palettes, assigned = tiles.learn_lines(tiles.tiles(_frames(spark, sf)), 4)
    return assigned.groupBy("line").agg(F.count("*").alias("cells")).withColumn("keys", F.element_at(F.create_map(*[F.lit(x) for k, p in palettes.items() for x in (k, ",".join(map(str, tiles.keys_of(p).tolist())))]), F.col("line")))


@query("o9_08_seam_assignment")
def seams(spark, sf):
    palettes = np.stack(list(_palettes().values()))
    return tiles.seam_assigned(tiles.tiles(_frames(spark, sf)), palettes, 4).select("frame", "cell", "line")


@query("o9_18_motion")
def motions(spark, sf):
    limits = motion.Limits(shift=3, block=8, stride=2, blocks=4)
    return motion.transitions(_frames(spark, sf), limits)


def _pcm(spark, sf) -> DataFrame:
    """A sound for each user: 64 samples an event."""
    sample = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.rint(F.sin(k * F.col("x") / 1_000) * (F.col("x") % 30_000)).cast("smallint"))
    return events(spark, sf).select(F.col("user_id").alias("stream"), F.col("frame").alias("part"), sample.alias("pcm"))


@query("o9_25_adpcm_round_trip")
def adpcm(spark, sf):
    coded = signal.encode_streams(_pcm(spark, sf), 64)
    back = signal.decode_chunks(coded)
    return coded.join(back, ["stream", "chunk"]).select("stream", "chunk", F.sha2("data", 256).alias("code"), F.aggregate("pcm", F.lit(0).cast("long"), lambda a, v: a + F.abs(v.cast("int"))).alias("level"))


@query("o9_24_spectra")
def spectra(spark, sf):
    df = _pcm(spark, sf).select("stream", F.col("part").alias("at"), "pcm")
    return signal.spectra(df, 44_100, 32_768, size=256).select("stream", "at", F.posexplode("levels").alias("band", "level"))


@query("o9_23_huffman")
def huffman(spark, sf):
    df = read(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    packed, _ = signal.huffman(df, "doc_id", "data")
    return packed.select("doc_id", F.sha2("packed", 256).alias("packed"), "bits")


def _updates(spark, sf) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").alias("stream"), F.floor(F.col("frame") / 40).alias("frame"), F.col("frame").alias("ord"), (F.col("event_id") % 24).alias("cell"), F.concat("state", F.lit("-"), (F.col("x") % 9).cast("string")).alias("key"))


@query("o10_02_residency")
def residency(spark, sf):
    return planning.placed(_updates(spark, sf), 20)


@query("o10_01_demand")
def demand(spark, sf):
    one = _updates(spark, sf).groupBy("stream", "frame", "cell").agg(F.max_by("key", "ord").alias("key"), F.max("ord").alias("ord"))
    return planning.demand(one, 20, most_cold=6)


def _by_stream(spark, sf) -> DataFrame:
    return days(spark, sf).withColumn("stream", F.floor(F.col("frame") / 250))


@query("o10_06_balanced_reserve")
def balanced(spark, sf):
    return planning.balanced_plan(_by_stream(spark, sf), 600)


@query("o10_09_water_fill")
def filled(spark, sf):
    df = _by_stream(spark, sf).select("stream", "frame", F.col("demand").alias("wanted"), (F.col("supply") / 4).cast("long").alias("urgent"), F.col("lines").alias("available"))
    return planning.water_filled(df, 500)


@query("o10_28_ratchet_sweep")
def sweep(spark, sf):
    df = events(spark, sf).select("frame", (F.col("x") / 4).alias("work"), (F.col("state") == "error").alias("at_start"))
    return planning.ratchet_sweep(df, [(a, p) for a in (200, 400, 800, 1_600) for p in (0, 250, 500)], 1_668.3, 240.0, 2)


_QUEUE_SQL = f"""WITH RECURSIVE {DAYS}, s AS (SELECT frame // 250 AS stream, frame, supply AS a, demand AS n FROM dy),
q(stream, frame, level, missing, refused) AS (
  SELECT stream, frame, greatest(0, least(2000, a) - n), greatest(0, n - least(2000, a)), greatest(0, a - 2000) FROM s WHERE frame % 250 = 0
  UNION ALL SELECT s.stream, s.frame, greatest(0, least(2000, q.level + a) - n), greatest(0, n - least(2000, q.level + a)), greatest(0, q.level + a - 2000)
  FROM q JOIN s ON s.stream = q.stream AND s.frame = q.frame + 1)
SELECT stream, frame, level, missing, refused FROM q"""


@query("o10_29_queue_replay", _QUEUE_SQL)
def replay(spark, sf):
    return planning.replayed(_by_stream(spark, sf).withColumnsRenamed({"supply": "arrives", "demand": "needs"}), 2_000)
