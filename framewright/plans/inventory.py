"""Queries of sources, reports, pictures, checks and verifiers that plain versions held before, beside their SQL."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalars as fn
from framewright.operators import align, clamp, islands, motion, palettes, ranking, signal, stats, tiles
from framewright.operators.scan import running
from framewright.sources import archives, binary, control, tables

from .folds import _frames, _palettes
from .queries import SQL, query
from .traces import DAYS, EVENTS, days, events, read


def _folder(spark: SparkSession) -> str:
    """A new path in the shared folder; on one machine without one, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="framewright-")
    return f"{shared}/files/{uuid.uuid4().hex}"


# --- sources and reports


@query("o1_01_text_table", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def text_table(spark, sf):
    path = _folder(spark)
    tables.write_tsv(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, ["n_nationkey"])
    return tables.read_tsv(spark, path, needed=["n_nationkey", "n_name"])


@query("o1_07_text_lines", "SELECT url AS value, count(*) AS n FROM pages GROUP BY 1")
def text_lines(spark, sf):
    path = _folder(spark)
    read(spark, sf, "pages").select("url").write.option("compression", "gzip").text(f"{path}/a")
    return tables.lines(spark, f"{path}/a").groupBy("value").agg(F.count("*").alias("n"))


_LEVEL = "CAST(least(greatest(round((e::DOUBLE + 0.5) * 255), 0), 255) AS BIGINT)"
_LV = f"lv AS (SELECT vec_id AS frame, list_transform(embedding, lambda e: {_LEVEL}) AS l FROM embeddings)"
_PX = f"{_LV}, px AS (SELECT frame, CAST(i AS BIGINT) AS i, l[i + 1] AS v, (l[i + 1] * 7 + 127) // 255 AS q FROM lv, range(64) t(i))"


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    level = F.transform("embedding", lambda v: F.least(F.greatest(F.round((v + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int"))
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), level.alias("l"))


SQL["o1_09_frame_features"] = f"""WITH {_LV}, w AS (
  SELECT frame, p, max(l[y % 8 * 8 + x % 8 + 1]) - min(l[y % 8 * 8 + x % 8 + 1]) AS r FROM (
    SELECT frame, l, p, least(greatest(p // 32 + k // 3 - 1, 0), 31) AS y, least(greatest(p % 32 + k % 3 - 1, 0), 31) AS x FROM lv, range(1024) t(p), range(9) d(k)) GROUP BY 1, 2)
SELECT frame, dark, uniform, detail FROM (SELECT frame, avg(r) AS detail FROM w GROUP BY 1)
JOIN (SELECT frame, len(list_filter(l, lambda v: v < 24)) / 64::DOUBLE AS dark, CASE WHEN list_max(l) - list_min(l) <= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS uniform FROM lv) USING (frame)"""


@query("o1_11_decision_log", f"WITH {_LV} SELECT frame, CAST(0 AS INTEGER) AS ord, CAST(frame % 900 AS INTEGER) AS cell, CAST(frame % 4 AS INTEGER) AS palette, array_to_string(list_transform(l, lambda v: '0' || substr('0123456789ABCDEF', CAST(v % 15 + 2 AS INTEGER), 1)), '') AS key FROM lv")
def decision_log(spark, sf):
    key = F.unhex(F.array_join(F.transform("l", lambda v: F.concat(F.lit("0"), F.hex((v % 15 + 1).cast("long")))), ""))
    update = F.struct((F.col("frame") % 900).cast("int").alias("cell"), (F.col("frame") % 4).cast("int").alias("palette"), key.alias("key"))
    log = _levels(spark, sf).select(F.array(F.struct(F.col("frame").cast("int").alias("frame"), F.array(update).alias("updates"))).alias("frames"))
    return archives.updates(log).select(F.col("frame").cast("long").alias("frame"), "ord", "cell", "palette", F.hex("key").alias("key"))


def _big_endian(v, digits: int):
    return F.lpad(F.hex(v.cast("long")), digits, "0")


@query("o1_15_chunk_records", "SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(k AS BIGINT) AS place, p_partkey * (k + 1) AS offset, CAST(p_size AS BIGINT) AS bytes, CAST(k AS BIGINT) AS bits FROM part, range(3) t(k)".replace("AS offset", 'AS "offset"'))
def chunk_records(spark, sf):
    one = lambda k: F.concat(_big_endian(F.col("p_partkey") * (k + 1), 8), _big_endian(F.col("p_size"), 4), _big_endian(F.lit(k), 4))
    files = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.unhex(F.concat(*[one(k) for k in range(3)])).alias("content"))
    return binary.records(files, binary.CHUNK).select("path", "place", "offset", F.col("bytes").cast("long").alias("bytes"), F.col("bits").cast("long").alias("bits"))


@query("o1_16_header_fields", "SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS number, CAST(p_size AS BIGINT) AS size FROM part")
def header_fields(spark, sf):
    content = F.unhex(F.concat(F.hex(F.lit("HDR0")), _big_endian(F.col("p_partkey"), 8), _big_endian(F.col("p_size"), 4)))
    files = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    return binary.header(files, {"number": (4, ">u4"), "size": (8, ">u2")}, b"HDR0")


@query("o1_18_frame_digest_log", f"WITH {EVENTS} SELECT CAST(0 AS INTEGER) AS stream, frame AS dts, frame + 2 AS pts, CAST(1 AS BIGINT) AS duration, x AS size, md5(CAST(x AS VARCHAR)) AS digest FROM ev")
def frame_digest_log(spark, sf):
    text = lambda c: c.cast("string")
    line = F.concat_ws(", ", F.lit("0"), F.lpad(text(F.col("frame")), 9, " "), text(F.col("frame") + 2), F.lit("1"), text(F.col("x")), F.md5(text(F.col("x"))))
    log = events(spark, sf).select(F.explode(F.array(F.concat(F.lit("#"), line), line)).alias("value"))
    return archives.frame_digests(log)


@query("o1_12_routed_sectors", "SELECT CAST(p_partkey AS VARCHAR) AS path, frame, kind, CAST(place AS INTEGER) AS place, upper(substr(md5(CAST(p_partkey AS VARCHAR)), CAST(nth * 8 + 1 AS INTEGER), 8)) AS data FROM part, (VALUES (0::BIGINT, 'control', 0, 0), (0, 'payload', 1, 1), (1, 'payload', 0, 2), (1, 'pad', 1, 3)) r(frame, kind, place, nth)")
def routed_sectors(spark, sf):
    files = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.unhex(F.md5(F.col("p_partkey").cast("string"))).alias("content"))
    routes = spark.createDataFrame([(0, 1, 1, 2), (1, 0, 1, 2)], "frame long, control int, payload int, total int")
    return binary.routed_sectors(files, routes, 4).select("path", "frame", "kind", "place", F.hex("data").alias("data"))


@query("o1_13_control_blocks", "SELECT p_partkey % 65536 AS frame, CAST(1 AS INTEGER) AS kind, CAST(p_partkey % 900 AS INTEGER) AS cell, CAST(p_size AS INTEGER) AS entry, CAST(p_partkey % 1000 AS INTEGER) AS slot, CAST(p_size AS INTEGER) AS count FROM part")
def control_blocks(spark, sf):
    """Written and read back."""
    update = F.struct((F.col("p_partkey") % 900).cast("int").alias("cell"), F.col("p_size").cast("int").alias("entry"))
    run = F.struct((F.col("p_partkey") % 1_000).cast("int").alias("slot"), F.col("p_size").cast("int").alias("count"), F.lit(1).alias("source"))
    rows = read(spark, sf, "part").select((F.col("p_partkey") % 65_536).alias("frame"), F.lit(control.LIST).alias("kind"), F.array(update).alias("updates"), F.array(run).alias("runs"), F.lit(b"").alias("sound"))
    back = control.parsed(control.serialized(rows, 900), 900, 0)
    return back.select("frame", "kind", F.col("updates")[0]["cell"].alias("cell"), F.col("updates")[0]["entry"].alias("entry"), F.col("runs")[0]["slot"].alias("slot"), F.col("runs")[0]["count"].alias("count"))


@query("o2_04_interval_report", f"WITH {EVENTS}, g AS (SELECT frame, x, frame - row_number() OVER (ORDER BY frame) AS g FROM ev WHERE x <= 256) SELECT CAST(min(frame) AS VARCHAR) AS first, CAST(max(frame) AS VARCHAR) AS last, CAST(count(*) AS VARCHAR) AS \"count\" FROM g GROUP BY g")
def interval_report(spark, sf):
    path = _folder(spark)
    tables.write_tsv(islands.ranges_where(events(spark, sf), "frame", F.col("x") <= 256), path, ["first"])
    return tables.read_tsv(spark, path)


@query("o2_05_event_report", f"WITH {EVENTS} SELECT CAST(frame AS VARCHAR) AS frame, state, CASE WHEN x % 4 = 0 THEN CAST(x // 4 AS VARCHAR) ELSE CAST(x / 4.0 AS VARCHAR) END AS quarter FROM ev WHERE state = 'error'")
def event_report(spark, sf):
    path = _folder(spark)
    tables.write_tsv(events(spark, sf).where("state = 'error'").select("frame", "state", (F.col("x") / 4).alias("quarter")), path)
    return tables.read_tsv(spark, path)


@query("o2_06_blank_cells", f"WITH {EVENTS} SELECT frame, CASE WHEN x % 3 <> 0 THEN x END AS x FROM ev")
def blank_cells(spark, sf):
    """Nulls are blanks in the file, and null again when it is read."""
    path = _folder(spark)
    tables.write_tsv(events(spark, sf).select("frame", F.when(F.col("x") % 3 != 0, F.col("x")).alias("x")), path)
    return tables.read_tsv(spark, path, "frame long, x long")


@query("o2_08_versioned_json", f"WITH {DAYS} SELECT CAST(3 AS BIGINT) AS schema_version, frame, demand, demand > supply AS short FROM dy")
def versioned_json(spark, sf):
    path = _folder(spark)
    tables.write_json(days(spark, sf).select("frame", "demand", (F.col("demand") > F.col("supply")).alias("short")), path, 3)
    return spark.read.json(path)


@query("o2_10_run_summary", "SELECT l_returnflag AS run, CAST(count(*) AS VARCHAR) AS lines, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS pieces FROM lineitem GROUP BY 1")
def run_summary(spark, sf):
    path = _folder(spark)
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("double").alias("pieces"))
    tables.write_tsv(rows, path, ["run"])
    return tables.read_tsv(spark, path)


# --- pictures


_BAYER = "(" + " + ".join(f"(2 * xor(({{x}} >> {k}) & 1, ({{y}} >> {k}) & 1) + (({{y}} >> {k}) & 1)) * {4 ** (2 - k)}" for k in range(3)) + " + 0.5) / 64"


@query("o3_05_ordered_thresholds", f"SELECT p_partkey, CAST({_BAYER.format(x='CAST(p_partkey % 8 AS BIGINT)', y='CAST(p_size % 8 AS BIGINT)')} AS DOUBLE) AS threshold FROM part")
def ordered_thresholds(spark, sf):
    field = F.array(*[F.lit(float(v)) for v in tiles.thresholds(8, 8).reshape(-1)])
    at = F.col("p_size") % 8 * 8 + F.col("p_partkey") % 8
    return read(spark, sf, "part").select("p_partkey", F.get(field, at.cast("int")).alias("threshold"))


_DITHERED = f"""{_PX}, dithered AS (SELECT frame, i, least(7, CAST(floor(v * 7 / 255::DOUBLE) AS BIGINT) + CASE WHEN v * 7 / 255::DOUBLE - floor(v * 7 / 255::DOUBLE) > {_BAYER.format(x='(i % 8)', y='(i // 8)')} THEN 1 ELSE 0 END) * 73 AS key FROM px)"""


@query("o3_05b_ordered_dither", f"WITH {_DITHERED} SELECT frame, CAST(cell AS INTEGER) AS cell, keys FROM (SELECT frame, string_agg(CAST(key AS VARCHAR), ',' ORDER BY i) AS keys FROM dithered GROUP BY 1), range(16) t(cell)")
def ordered_dither(spark, sf):
    return tiles.tiles(_frames(spark, sf), "bayer").select("frame", "cell", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query("o5_11_dithered_histogram", f"WITH {_DITHERED} SELECT CAST(key AS INTEGER) AS key, count(*) * 16 AS n FROM dithered GROUP BY 1")
def dithered_histogram(spark, sf):
    return tiles.histogram(tiles.tiles(_frames(spark, sf), "bayer"))


@query("o13_09_dither_modes", f"WITH {_DITHERED} SELECT 'bayer' AS mode, CAST(key AS INTEGER) AS key, count(*) * 16 AS n FROM dithered GROUP BY 2 UNION ALL SELECT 'nearest', CAST(q * 73 AS INTEGER), count(*) * 16 FROM px GROUP BY 2")
def dither_modes(spark, sf):
    of = lambda mode: tiles.histogram(tiles.tiles(_frames(spark, sf), mode)).select(F.lit(mode).alias("mode"), "key", "n")
    return of("bayer").union(of("nearest"))


@query("o3_01_near_tiles", f"WITH {_LV}, d AS (SELECT a.frame, list_transform(list_zip(a.l, b.l), lambda z: abs(z[1] - z[2])) AS d FROM lv a JOIN lv b ON b.frame = a.frame - 1) SELECT frame, list_avg(d) <= 60.01 AND list_max(d) <= 199.5 AS near FROM d")
def near_tiles(spark, sf):
    """Each picture's first tile against that of the picture before."""
    l = _levels(spark, sf)
    both = l.join(l.select((F.col("frame") + 1).alias("frame"), F.col("l").alias("before")), "frame")

    def run(batches):
        for pdf in batches:
            a, b = (np.repeat(np.stack(pdf[c].to_numpy())[:, :, None], 3, axis=2) if len(pdf) else np.zeros((0, 64, 3)) for c in ("l", "before"))
            yield pd.DataFrame({"frame": pdf["frame"], "near": tiles.perceptual(a, b, 60.01, 199.5, 24.0)})

    return both.mapInPandas(run, "frame long, near boolean")


@query("o3_09_stretched_levels", f"WITH {EVENTS} SELECT frame, CAST(least(255, greatest(0, round_even((abs(x) % 256 - 16) * 255 / 223::DOUBLE, 0))) AS INTEGER) AS level FROM ev")
def stretched_levels(spark, sf):
    table = F.array(*[F.lit(v) for v in fn.stretch(16, 239)])
    return events(spark, sf).select("frame", F.get(table, (F.abs("x") % 256).cast("int")).alias("level"))


@query("o3_13_distance_steps", "SELECT p_partkey, CAST(least(p_size * 200 / 192::DOUBLE / 24::DOUBLE, 2) AS DOUBLE) AS step FROM part")
def distance_steps(spark, sf):
    return read(spark, sf, "part").select("p_partkey", fn.distance_step(F.col("p_size") * 200).alias("step"))


@query("o3_15_rendered", f"WITH {_PX} SELECT frame, CAST(0 AS INTEGER) AS cell, string_agg(CAST(least(v % 15 // 2 + frame % 4, 7) * 73 AS VARCHAR), ',' ORDER BY i) AS keys FROM px GROUP BY 1")
def rendered(spark, sf):
    indices = F.transform("l", lambda v: (v % 15 + 1).cast("smallint"))
    assigned = _levels(spark, sf).select("frame", F.lit(0).alias("cell"), (F.col("frame") % 4).cast("int").alias("line"), indices.alias("indices"))
    return tiles.rendered(assigned, _palettes()).select("frame", "cell", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query("o3_18_packed_nibbles", f"WITH {_PX} SELECT frame, string_agg(substr('0123456789ABCDEF', CAST(v % 16 + 1 AS INTEGER), 1), '' ORDER BY i) AS packed FROM px GROUP BY 1")
def packed_nibbles(spark, sf):
    return _levels(spark, sf).select("frame", F.hex(tiles.pack_nibbles(F.transform("l", lambda v: v % 16))).alias("packed"))


@query("o3_24_bare_entries", "SELECT o_orderkey, (o_orderkey * 37) & 26623 AS bare FROM orders")
def bare_entries(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 37).bitwiseAND(0x67FF).alias("bare"))


@query("o5_29_flicker", f"WITH {_PX}, f AS (SELECT a.frame, a.v, b.v AS p1, c.v AS p2 FROM px a JOIN px b ON b.frame = a.frame - 1 AND b.i = a.i LEFT JOIN px c ON c.frame = a.frame - 2 AND c.i = a.i) SELECT frame, 16 * count(*) FILTER (v <> p1) AS changed, 16 * count(*) FILTER (v <> p1 AND v = p2) AS back, max(abs(v - p1)) AS peak FROM f GROUP BY 1")
def flicker(spark, sf):
    return tiles.flicker(_frames(spark, sf))


_BY_LINE = f"{_PX}, h AS (SELECT frame % 4 AS k, q, count(*) * 16 AS n, greatest(q, frame % 4) AS shown FROM px GROUP BY 1, 2, 4)"


@query("o5_31_palette_score", f"WITH {_BY_LINE} SELECT (SELECT sum(n * 3 * (shown - q) * (shown - q))::DOUBLE FROM h) AS pixel, (SELECT sum(least(a.n, b.n) * 3 * abs(a.shown - b.shown))::DOUBLE FROM h a JOIN h b ON a.q = b.q AND a.k < b.k) AS noise")
def palette_score(spark, sf):
    """Pictures dealt to four lines; their histograms of 512 keys are all that reaches the driver."""
    found = tiles.histogram(tiles.tiles(_frames(spark, sf)).withColumn("line", F.col("frame") % 4), ("line",))
    by_line = np.zeros((4, 512))
    for r in found.collect():
        by_line[r["line"], r["key"]] = r["n"]
    return spark.createDataFrame([palettes.score(by_line, np.stack(list(_palettes().values())))], "pixel double, noise double")


@query("o16_12_mapping_noise", f"WITH {_BY_LINE}, e AS (SELECT k, q, n, 3 * (shown - q) * (shown - q) AS error FROM h) SELECT CAST(a.q * 73 AS INTEGER) AS key, CAST(a.k AS INTEGER) AS a, CAST(b.k AS INTEGER) AS b, CAST(least(a.n, b.n) * abs(a.error - b.error) AS BIGINT) AS noise FROM e a JOIN e b ON a.q = b.q AND a.k < b.k")
def mapping_noise(spark, sf):
    cells = tiles.tiles(_frames(spark, sf))
    lines = cells.select("frame", "cell", (F.col("frame") % 4).cast("int").alias("line"))
    return tiles.mapping_noise(cells, lines, tiles.nearest_lut(spark, _palettes()))


@query("o9_07_line_without_black", f"WITH {_PX}, e AS (SELECT frame, CAST(k AS BIGINT) AS k, CAST(sum(3 * (greatest(q, k, 1) - q) * (greatest(q, k, 1) - q)) AS BIGINT) AS error FROM px, range(4) t(k) GROUP BY 1, 2) SELECT frame, CAST(cell AS INTEGER) AS cell, CAST(arg_min(k, error * 4 + k) AS INTEGER) AS line, min(error) AS error FROM e, range(16) t(cell) GROUP BY 1, 2")
def line_without_black(spark, sf):
    return tiles.assign_lines(tiles.tiles(_frames(spark, sf)), tiles.nearest_lut(spark, _palettes(), without_deep_black=True))


@query("o9_06_edge_weights", f"WITH {_LV}, g AS (SELECT frame, i, 3 * (CASE WHEN i % 8 < 7 THEN abs(q[i + 2] - q[i + 1]) ELSE 0 END + CASE WHEN i % 8 > 0 THEN abs(q[i] - q[i + 1]) ELSE 0 END + CASE WHEN i < 56 THEN abs(q[i + 9] - q[i + 1]) ELSE 0 END + CASE WHEN i >= 8 THEN abs(q[i - 7] - q[i + 1]) ELSE 0 END) AS step FROM (SELECT frame, list_transform(l, lambda v: (v * 7 + 127) // 255) AS q FROM lv), range(64) t(i)) SELECT frame, round(sum(1 + 2 * step / 21::DOUBLE), 6) AS weight, max(step) AS strongest FROM g GROUP BY 1")
def edge_weights(spark, sf):
    cells = tiles.tiles(_frames(spark, sf)).where("cell = 0").withColumn("steps", tiles.edge_steps("keys"))
    weight = F.aggregate("steps", F.lit(0.0), lambda a, s: a + tiles.edge_weight(s, 2.0))
    return cells.select("frame", F.round(weight, 6).alias("weight"), F.array_max("steps").cast("long").alias("strongest"))


@query("o9_32_neighbour_correlation", "WITH p AS (SELECT a.vec_id AS frame, unnest(a.embedding)::DOUBLE AS u, unnest(b.embedding)::DOUBLE AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1) SELECT frame, round(corr(u, v), 6) AS correlation FROM p GROUP BY 1")
def neighbour_correlation(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), "embedding")
    both = e.join(e.select((F.col("frame") + 1).alias("frame"), F.col("embedding").alias("before")), "frame")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"frame": pdf["frame"], "correlation": [tiles.correlation(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(pdf["embedding"], pdf["before"], strict=True)]})

    return both.mapInPandas(run, "frame long, correlation double").select("frame", F.round("correlation", 6).alias("correlation"))


_SPIKED = f"{EVENTS}, c AS (SELECT CASE WHEN x % 7 = 0 THEN 9 WHEN x % 11 = 0 THEN 250 ELSE abs(x) % 256 END AS v, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT sum(n) AS total FROM c)"
_SPIKE_SQL = "(SELECT CASE WHEN top >= 0.01 * (SELECT total FROM t) AND top >= 3 * greatest((held - top) / 15::DOUBLE, 1) AND top > coalesce((SELECT n FROM c WHERE v = {beyond}), 0) THEN best ELSE {none} END FROM (SELECT max(n) AS top, sum(n) AS held, arg_max(v, n * 256 - v) AS best FROM c WHERE v BETWEEN {first} AND {last}))"


@query("o9_17_spikes", f"WITH {_SPIKED} SELECT CAST({_SPIKE_SQL.format(first=1, last=16, beyond=17, none=0)} AS INTEGER) AS black, CAST({_SPIKE_SQL.format(first=239, last=254, beyond=238, none=255)} AS INTEGER) AS white")
def spikes(spark, sf):
    """A histogram of 256 levels is all that reaches the driver."""
    v = F.when(F.col("x") % 7 == 0, 9).when(F.col("x") % 11 == 0, 250).otherwise(F.abs("x") % 256)
    levels = [0] * 256
    for r in stats.histogram(events(spark, sf), v, 256).collect():
        levels[r["key"]] = r["n"]
    return spark.createDataFrame([stats.stretch_points(levels)], "black int, white int")


_STEP_LIST = "[" + ", ".join(map(str, signal.STEPS.tolist())) + "]"
SQL_DECODE = f"""WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS m FROM documents WHERE text IS NOT NULL),
r(doc_id, n, p, i, level) AS (
  SELECT doc_id, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM d
  UNION ALL SELECT doc_id, n + 1, to_p, least(88, greatest(0, i + [-1, -1, -1, -1, 2, 4, 6, 8][CAST((c & 7) + 1 AS INTEGER)])), level + abs(to_p) FROM (
    SELECT *, least(32767, greatest(-32768, p + CASE WHEN c & 8 <> 0 THEN -1 ELSE 1 END * ((s >> 3) + CASE WHEN c & 4 <> 0 THEN s ELSE 0 END + CASE WHEN c & 2 <> 0 THEN s >> 1 ELSE 0 END + CASE WHEN c & 1 <> 0 THEN s >> 2 ELSE 0 END))) AS to_p FROM (
      SELECT r.*, CAST({_STEP_LIST}[CAST(i + 1 AS INTEGER)] AS BIGINT) AS s, CAST(instr('0123456789abcdef', substr(m, CAST(n // 2 * 2 + CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS INTEGER), 1)) - 1 AS BIGINT) AS c FROM r JOIN d USING (doc_id) WHERE n < 32)))
SELECT doc_id AS stream, level, p AS last FROM r WHERE n = 32"""


@query("o9_26_chunk_decode", SQL_DECODE)
def chunk_decode(spark, sf):
    """The bytes of a text's MD5 as the codes of a chunk; each chunk has its own state, so they decode apart."""
    data = F.unhex(F.concat(F.lit("00000000"), F.md5("text")))
    chunks = read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("stream"), F.lit(0).alias("chunk"), data.alias("data"))
    back = signal.decode_chunks(chunks)
    return back.select("stream", F.aggregate("pcm", F.lit(0).cast("long"), lambda a, v: a + F.abs(v.cast("int"))).alias("level"), F.element_at("pcm", -1).cast("long").alias("last"))


# --- aggregations, ranking, checks


@query("o4_10_recording_report", f"WITH {EVENTS}, {DAYS}, b AS (SELECT frame, x FROM ev WHERE state <> 'error') SELECT (SELECT count(*) FROM ev) AS main_frames, (SELECT count(*) FROM b) AS candidate_frames, (SELECT min(coalesce(a.frame, b.frame)) FROM ev a FULL JOIN b ON a.frame = b.frame WHERE a.x IS DISTINCT FROM b.x) AS first_mismatch")
def recording_report(spark, sf):
    a = events(spark, sf).select("frame", "x", "state")
    b = a.where("state <> 'error'")
    counts = a.agg(F.count("*").alias("main_frames")).crossJoin(b.agg(F.count("*").alias("candidate_frames")))
    return counts.crossJoin(align.first_mismatch(a, b, "frame", "x"))


@query("o5_03_gap_statistics", f"WITH {DAYS}, g AS (SELECT frame, lead(demand) OVER (ORDER BY frame) - demand AS gap FROM dy) SELECT coalesce(min(gap), 0)::DOUBLE AS minimum, round(coalesce(avg(gap), 0), 6) AS mean, coalesce(median(gap), 0)::DOUBLE AS median, coalesce(max(gap), 0)::DOUBLE AS maximum, count(gap) AS n FROM g WHERE frame > 0")
def gap_statistics(spark, sf):
    gaps = islands.cadence(days(spark, sf), "frame", "demand").withColumnRenamed("delta", "gap")
    return stats.timed_statistics(gaps, "gap").withColumn("mean", F.round("mean", 6))


@query("o5_21_run_distribution", f"WITH {EVENTS}, g AS (SELECT count(*) AS n FROM (SELECT frame - row_number() OVER (ORDER BY frame) AS g FROM ev WHERE x < 3000) GROUP BY g) SELECT count(*) AS runs, round(avg(n), 6) AS mean, max(n) AS longest, quantile_cont(n, 0.95)::DOUBLE AS p95, count(*) FILTER (n = 1) AS single FROM g")
def run_distribution(spark, sf):
    runs = islands.ranges_where(events(spark, sf), "frame", F.col("x") < 3_000)
    return runs.agg(F.count("*").alias("runs"), F.round(F.avg("count"), 6).alias("mean"), F.max("count").alias("longest"), F.percentile("count", F.lit(0.95)).alias("p95"), F.count_if(F.col("count") == 1).alias("single"))


@query("o5_23_delivery_rate", "SELECT l_returnflag AS flag, round(sum(CAST(l_quantity AS BIGINT))::DOUBLE / sum(CAST(l_quantity AS BIGINT) + l_linenumber) * 153600, 6) AS rate FROM lineitem GROUP BY 1")
def delivery_rate(spark, sf):
    pieces = F.col("l_quantity").cast("long")
    rate = stats.ratio_of_sums(pieces, pieces + F.col("l_linenumber")) * 153_600
    return read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(rate, 6).alias("rate"))


@query("o5_25_adopted_segments", f"WITH {EVENTS}, g AS (SELECT user_id, sum(x)::DOUBLE / greatest(sum(second % 8000), 1) AS gain, avg(CASE WHEN x > second % 8000 THEN 1 ELSE 0 END) AS share, quantile_cont(x, 0.95) AS p95 FROM ev GROUP BY 1) SELECT user_id FROM g WHERE gain >= 0.9 AND share >= 0.35 AND p95 <= 9600")
def adopted_segments(spark, sf):
    return stats.window_gate(events(spark, sf), "user_id", F.col("x"), F.col("second") % 8_000, F.col("x"), 0.9, 0.35, 9_600).where("adopted").select("user_id")


@query("o7_07_top_of_each", f"WITH {EVENTS} SELECT user_id, frame, CAST(row_number() OVER (PARTITION BY user_id ORDER BY x DESC, frame) AS INTEGER) AS rank FROM ev WHERE x > 2000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x DESC, frame) <= 3")
def top_of_each(spark, sf):
    return ranking.top_of_each(events(spark, sf).where("x > 2000"), ["user_id"], [F.desc("x"), F.asc("frame")], 3).select("user_id", "frame", "rank")


@query("o7_09_best_place", f"WITH {EVENTS} SELECT user_id, arg_max(frame, x * 10000000 - frame) AS frame, max(x) AS x FROM ev GROUP BY 1")
def best_place(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("frame", F.struct("x", -F.col("frame"))).alias("frame"), F.max("x").alias("x"))


@query("o8_05_axis_sides", f"WITH {EVENTS}, a AS (SELECT frame FROM ev WHERE x < 5000), b AS (SELECT frame FROM ev WHERE state = 'view') SELECT coalesce(a.frame, b.frame) AS frame, CASE WHEN a.frame IS NULL THEN 'missing' ELSE 'extra' END AS side FROM a FULL JOIN b ON a.frame = b.frame WHERE a.frame IS NULL OR b.frame IS NULL")
def axis_sides(spark, sf):
    ev = events(spark, sf)
    return align.axis_difference(ev.where("x < 5000"), ev.where("state = 'view'"))


@query("o11_08_path_parts", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS part FROM supplier")
def path_parts(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", fn.slug(F.col("s_name")).alias("part"))


@query("o12_01_gate", f"WITH {EVENTS}, m AS (SELECT user_id, count(*) FILTER (state = 'error') AS errors, max(x) AS peak FROM ev GROUP BY 1) SELECT user_id, errors <= 20 AND peak <= 15000 AS passed, concat_ws(',', CASE WHEN errors > 20 THEN 'errors over limit ' || errors END, CASE WHEN peak > 15000 THEN 'peak over limit ' || peak END) AS failures FROM m")
def gate(spark, sf):
    m = events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("state") == "error").alias("errors"), F.max("x").alias("peak"))
    return stats.verdict(m, {"errors": (12, 20), "peak": (9_000, 15_000)}).select("user_id", "passed", F.array_join("failures", ",").alias("failures"))


@query("o12_06_rebuilt_schedule", f"WITH {DAYS}, c AS (SELECT frame, CASE WHEN frame > 0 THEN demand ELSE 0 END AS n, sum(CASE WHEN frame > 0 THEN demand ELSE 0 END) OVER (ORDER BY frame) AS t FROM dy) SELECT count(*) AS rows, CAST(sum(-(-t // 2048) + (-(t - n) // 2048)) AS BIGINT) AS sectors, 0::BIGINT AS differing FROM c".replace("-(-t // 2048) + (-(t - n) // 2048)", "(t + 2047) // 2048 - (t - n + 2047) // 2048").replace("AS rows", 'AS "rows"'))
def rebuilt_schedule(spark, sf):
    """A schedule as it was planned, against one that is built anew from the running total."""
    planned = clamp.just_in_time(days(spark, sf), "frame", F.col("demand"), 2_048).select("frame", "sectors")
    timed = F.when(F.col("frame") > 0, F.col("demand")).otherwise(F.lit(0))
    total = running(days(spark, sf), "frame", {"t": ("sum", timed)}).withColumn("d", timed)
    up = lambda c: F.floor((c + 2_047) / 2_048)
    rebuilt = total.select("frame", (up(F.col("t")) - up(F.col("t") - F.col("d"))).alias("again"))
    both = planned.join(rebuilt, "frame", "full_outer")
    return both.agg(F.count("*").alias("rows"), F.sum("sectors").alias("sectors"), F.count_if(~F.col("sectors").eqNullSafe(F.col("again"))).alias("differing"))


@query("o15_06_compacted_log", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT count(*) FILTER (NOT regexp_matches(line, '^$|[0-9]{4}')) AS kept, count(*) FILTER (regexp_matches(line, '^$|[0-9]{4}')) AS dropped FROM l")
def compacted_log(spark, sf):
    log = read(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    kept, dropped = tables.compacted(log, "^$|[0-9]{4}")
    return kept.agg(F.count("*").alias("kept")).crossJoin(F.broadcast(dropped))


@query("o16_20_boundary_frames", f"WITH {EVENTS} SELECT frame, x // 2000 AS segment FROM (SELECT frame, x, lag(x // 2000) OVER (ORDER BY frame) AS p FROM ev) WHERE p IS NOT NULL AND p <> x // 2000")
def boundary_frames(spark, sf):
    df = events(spark, sf).select("frame", F.floor(F.col("x") / 2_000).alias("segment"))
    return islands.transitions(df, "frame", "segment").select("frame", "segment")


@query("o16_21_routes_kept", "SELECT count(*) AS sectors, 0::BIGINT AS lost, 0::BIGINT AS gained FROM (SELECT unnest(range((p_partkey & 15) + ((p_partkey >> 4) & 15))) FROM part)")
def routes_kept(spark, sf):
    """A routing byte taken apart and put together again routes the same sectors."""
    old = read(spark, sf, "part").select(F.col("p_partkey").alias("frame"), F.col("p_partkey").alias("entry"))
    payload, ctl, _ = fn.route(F.col("entry"))
    new = old.select("frame", payload.bitwiseOR(F.shiftleft(ctl, 4)).alias("entry"))
    spread = lambda df: df.select("frame", F.posexplode(F.array_repeat(F.lit(1), fn.route(F.col("entry"))[2].cast("int"))).alias("sector", "_")).select("frame", "sector")
    a, b = spread(old), spread(new)
    sides = align.difference(a, b).agg(F.count_if(F.col("side") == "a").alias("lost"), F.count_if(F.col("side") == "b").alias("gained"))
    return a.agg(F.count("*").alias("sectors")).crossJoin(sides)


@query("o16_23_carried_state", f"WITH {EVENTS}, s AS (SELECT frame, last_value(CASE WHEN state = 'view' THEN x END IGNORE NULLS) OVER (ORDER BY frame) AS shown FROM ev) SELECT count(shown) AS known, CAST(sum(shown) AS BIGINT) AS total, max(frame) FILTER (shown IS NULL) AS unknown_to FROM s")
def carried_state(spark, sf):
    shown = running(events(spark, sf), "frame", {"shown": ("last", F.when(F.col("state") == "view", F.col("x")))})
    return shown.agg(F.count("shown").alias("known"), F.sum("shown").alias("total"), F.max(F.when(F.col("shown").isNull(), F.col("frame"))).alias("unknown_to"))


@query("o16_24_set_bits", "SELECT p_partkey, CAST(k AS INTEGER) AS bit FROM part, range(24) t(k) WHERE (p_partkey >> k) & 1 = 1")
def set_bits(spark, sf):
    bits = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda k: F.expr("p_partkey").cast("long").bitwiseAND(F.pow(F.lit(2), k).cast("long")) != 0)
    return read(spark, sf, "part").select("p_partkey", F.explode(bits).alias("bit"))


@query("o16_25_poll_places", f"WITH {EVENTS} SELECT user_id, frame FROM (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS n FROM ev) WHERE n % 16 = 0")
def poll_places(spark, sf):
    n = running(events(spark, sf), "frame", {"n": ("count", F.lit(1))}, ("user_id",))
    return n.where("n % 16 = 0").select("user_id", "frame")


@query("o16_27_range_statistics", f"WITH {EVENTS}, g AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM ev) GROUP BY user_id, g) SELECT user_id, count(*) AS ranges, max(n) AS longest, CAST(sum(n) AS BIGINT) AS covered FROM g GROUP BY 1")
def range_statistics(spark, sf):
    runs = islands.consecutive_runs(events(spark, sf), "frame", ("user_id",))
    return runs.groupBy("user_id").agg(F.count("*").alias("ranges"), F.max("count").alias("longest"), F.sum("count").alias("covered"))


@query("o16_43_size_contract", "SELECT doc_id, octet_length(encode(text)) AS bytes, octet_length(encode(text)) // 4 AS words, octet_length(encode(text)) % 4 = 0 AND octet_length(encode(text)) BETWEEN 1 AND 32768 AS fits FROM documents")
def size_contract(spark, sf):
    n = F.octet_length("text").cast("long")
    return read(spark, sf, "documents").select("doc_id", n.alias("bytes"), F.floor(n / 4).alias("words"), ((n % 4 == 0) & n.between(1, 32_768)).alias("fits"))


@query("o16_44_region_lookup", "SELECT n_nationkey, n_name, coalesce(r_name, 'none') AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def region_lookup(spark, sf):
    nations, regions = read(spark, sf, "nation"), read(spark, sf, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


def _tripled(level) -> F.Column:
    """Frames of 8 by 8 grey tiles side by side, four times in either direction, of a level function over their values."""
    grey = F.transform("l", lambda v: F.lpad(F.hex(level(v)), 2, "0"))
    row = lambda k: F.concat(*[F.array_join(F.transform(F.slice(grey, k * 8 + 1, 8), lambda h: F.concat(h, h, h)), "")] * 4)
    return F.unhex(F.repeat(F.concat(*[row(k) for k in range(8)]), 4))


@query("o16_37_filter_report")
def filter_report(spark, sf):
    """Pictures against a coarser form of themselves."""
    levels = _levels(spark, sf)
    sizes = [F.lit(32).alias("height"), F.lit(32).alias("width")]
    return tiles.filter_report(levels.select("frame", *sizes, _tripled(lambda v: v).alias("pixels"), _tripled(lambda v: F.floor(v / 16).cast("int") * 16).alias("filtered")))


@query("o16_37_filter_change", f"WITH {_LV} SELECT frame, list_avg(list_transform(l, lambda v: v % 16))::DOUBLE AS change FROM lv")
def filter_change(spark, sf):
    """The mean change alone, which SQL can express without ties at the limits of slopes."""
    return filter_report(spark, sf).select("frame", "change")


@query("o16_41_projected_tiles", f"""WITH {_LV}, st AS (SELECT frame, l, frame % 2 = 0 AS across, frame % 23 - 11 AS pos, frame % 3 - 1 AS delta, CAST(floor(-(frame % 23 - 11) / 8::DOUBLE) AS BIGINT) AS first FROM lv),
cells AS (SELECT st.*, p, p >= 12 AS guard,
    CASE WHEN across THEN CASE WHEN p < 12 THEN p // 4 ELSE p - 12 END ELSE CASE WHEN p < 12 THEN first + p // 4 WHEN delta <= 0 THEN first + 3 ELSE first - 1 END END AS r,
    CASE WHEN across THEN CASE WHEN p < 12 THEN first + p % 4 WHEN delta <= 0 THEN first + 4 ELSE first - 1 END ELSE CASE WHEN p < 12 THEN p % 4 ELSE p - 12 END END AS c
  FROM st, range(16) t(p) WHERE across AND p < 15 OR NOT across),
px2 AS (SELECT frame, p, guard, r, c, l, r * 8 + i // 8 + CASE WHEN across THEN 0 ELSE pos END AS y, c * 8 + i % 8 + CASE WHEN across THEN pos ELSE 0 END AS x FROM cells, range(64) u(i))
SELECT frame, CAST(p AS INTEGER) AS place, r AS "row", c AS "column", guard, CAST(count(*) FILTER (y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31) AS INTEGER) AS shown,
  CAST(coalesce(sum(l[y % 8 * 8 + x % 8 + 1]) FILTER (y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31), 0) AS BIGINT) AS total
FROM px2 GROUP BY frame, p, guard, r, c""")
def projected_tiles(spark, sf):
    """Pictures on a moving plane of three by four tiles and the strip that comes in; the sum of each tile's red bytes."""
    frame = F.col("frame")
    state = [F.when(frame % 2 == 0, "horizontal").otherwise("vertical").alias("axis"), (frame % 23 - 11).alias("position"), (frame % 3 - 1).alias("delta"), F.lit(None).cast("binary").alias("base")]
    found = motion.projected(_levels(spark, sf).select("frame", F.lit(32).alias("height"), F.lit(32).alias("width"), _tripled(lambda v: v).alias("pixels"), *state), 4, 3)
    level = lambda k: F.conv(F.substring(F.hex("pixels"), k * 6 + 1, 2), 16, 10).cast("long")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, k: a + level(k))
    return found.select("frame", "place", "row", "column", "guard", "shown", total.alias("total"))
