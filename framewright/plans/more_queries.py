"""Further queries beside their SQL: scans, scalar forms, histograms, look-up tables, checks and verifiers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import scalars as fn
from framewright.operators import align, clamp, islands, stats, tiles
from framewright.operators.scan import neighbours, running

from .queries import query
from .traces import DAYS, EVENTS, USER_EVENTS, days, events, read, user_events


@query("o1_06_two_columns", f"WITH {EVENTS} SELECT frame, x FROM ev WHERE frame <= 3000")
def two_columns(spark, sf):
    return events(spark, sf).where("frame <= 3000").select("frame", "x")


@query("o1_14_route_bits", "SELECT p_partkey, p_partkey & 15 AS payload, (p_partkey >> 4) & 15 AS control, (p_partkey & 15) + ((p_partkey >> 4) & 15) AS total FROM part")
def route_bits(spark, sf):
    payload, control, total = fn.route(F.col("p_partkey"))
    return read(spark, sf, "part").select("p_partkey", payload.alias("payload"), control.alias("control"), total.alias("total"))


@query("o2_03_number_text", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = round(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS t FROM lineitem")
def number_text(spark, sf):
    from framewright.sources.tables import number_text as text

    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text("l_quantity", "double").alias("t"))


@query("o2_09_receipts", "SELECT source, count(*) AS files, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS receipt FROM documents GROUP BY 1")
def receipts(spark, sf):
    each = read(spark, sf, "documents").select("source", F.struct("doc_id", F.sha2("text", 256).alias("d")).alias("r"))
    return each.groupBy("source").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["d"]), "\n"), 256).alias("receipt"))


@query("o3_11_border_weight", "SELECT p_partkey, CASE WHEN p_partkey % 36 < 2 OR p_partkey % 25 < 2 OR p_partkey % 36 >= 34 OR p_partkey % 25 >= 23 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM part")
def border_weight(spark, sf):
    return read(spark, sf, "part").select("p_partkey", fn.border_weight(F.col("p_partkey") % 36, F.col("p_partkey") % 25, 36, 25).alias("weight"))


@query("o3_14_deep_black", "SELECT p_partkey FROM part WHERE (p_partkey & 7) + ((p_partkey >> 3) & 7) + ((p_partkey >> 6) & 7) <= 2")
def deep_black(spark, sf):
    channel = lambda k: F.shiftright("p_partkey", k).bitwiseAND(7)
    return read(spark, sf, "part").where(fn.is_deep_black(channel(6), channel(3), channel(0))).select("p_partkey")


@query("o3_22_resampled_frames", f"WITH {EVENTS} SELECT frame, CAST(round_even(frame * 30 / 23.976, 0) AS BIGINT) AS output FROM ev")
def resampled(spark, sf):
    return events(spark, sf).select("frame", fn.resampled(F.col("frame"), 23.976, 30.0).alias("output"))


@query("o4_03_row_counts", f"WITH {EVENTS}, {DAYS} SELECT (SELECT count(*) FROM ev) AS a, (SELECT count(*) FROM dy) AS b, (SELECT count(*) FROM ev) = (SELECT count(*) FROM dy) AS aligned")
def row_counts(spark, sf):
    a, b = events(spark, sf).agg(F.count("*").alias("a")), days(spark, sf).agg(F.count("*").alias("b"))
    return a.crossJoin(F.broadcast(b)).withColumn("aligned", F.col("a") == F.col("b"))


@query("o5_09_global_histogram", "SELECT CAST(CAST(floor(v * 8 + 32) AS BIGINT) AS INTEGER) AS key, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def global_histogram(spark, sf):
    return stats.histogram(read(spark, sf, "embeddings").select(F.explode("embedding").alias("v")), F.floor(F.col("v").cast("double") * 8 + 32), 64)


@query("o5_10_level_histogram", "SELECT CAST(k AS INTEGER) AS key, count(v) AS n FROM range(256) t(k) LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) * 5 % 256 AS v FROM lineitem UNION ALL SELECT l_linenumber * 31 % 256 FROM lineitem UNION ALL SELECT l_suppkey % 256 FROM lineitem) ON v = k GROUP BY 1")
def level_histogram(spark, sf):
    channels = F.array(F.col("l_quantity").cast("long") * 5 % 256, F.col("l_linenumber").cast("long") * 31 % 256, F.col("l_suppkey") % 256)
    return stats.histogram(read(spark, sf, "lineitem").select(F.explode(channels).alias("v")), F.col("v"), 256, dense=True)


@query("o5_14_carried_classes", f"WITH {USER_EVENTS}, n AS (SELECT user_id, x % 65 AS dots, coalesce(lead(frame) OVER (PARTITION BY user_id ORDER BY frame), (SELECT max(frame) + 1 FROM uev)) - frame AS held FROM uev) SELECT dots, CAST(sum(held) AS BIGINT) AS frames FROM n GROUP BY 1")
def carried_classes(spark, sf):
    df = user_events(spark, sf).withColumn("dots", F.col("x") % 65)
    end = df.agg((F.max("frame") + 1).alias("end"))
    held = neighbours(df, "frame", {"to": "frame"}, ("user_id",), ahead=True).crossJoin(F.broadcast(end)).withColumn("held", F.coalesce("to", "end") - F.col("frame"))
    return held.groupBy("dots").agg(F.sum("held").alias("frames"))


@query("o5_17_column_maxima", f"WITH {DAYS} SELECT max(demand) AS demand, max(supply) AS supply, max(lines) AS lines FROM dy WHERE frame <> 0")
def column_maxima(spark, sf):
    return days(spark, sf).where("frame <> 0").agg(*[F.max(c).alias(c) for c in ("demand", "supply", "lines")])


@query("o5_19_saving_distribution", f"WITH {DAYS}, s AS (SELECT demand - supply AS v FROM dy) SELECT round(avg(v), 6) AS mean, median(v)::DOUBLE AS median, quantile_cont(v, 0.05)::DOUBLE AS p05, quantile_cont(v, 0.95)::DOUBLE AS p95, min(v) AS least, max(v) AS most, count(*) FILTER (v < 0) AS regressed FROM s".replace("AS least", 'AS "least"'))
def saving_distribution(spark, sf):
    s = days(spark, sf).select((F.col("demand") - F.col("supply")).alias("v"))
    return s.agg(F.round(F.avg("v"), 6).alias("mean"), F.median("v").cast("double").alias("median"), F.percentile("v", F.lit(0.05)).alias("p05"), F.percentile("v", F.lit(0.95)).alias("p95"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v") < 0).alias("regressed"))


@query("o5_27_byte_frequency", "SELECT CAST(ord(c) AS BIGINT) AS byte, count(*) AS n FROM (SELECT unnest(string_split(url, '')) AS c FROM pages) WHERE c <> '' GROUP BY 1")
def byte_frequency(spark, sf):
    return read(spark, sf, "pages").select(F.explode(F.split("url", "")).alias("c")).where("c <> ''").groupBy(F.ascii("c").cast("long").alias("byte")).agg(F.count("*").alias("n"))


@query("o6_03_run_count", f"WITH {EVENTS} SELECT count(*) FILTER (p IS NULL OR state <> p) AS runs FROM (SELECT state, lag(state) OVER (ORDER BY frame) AS p FROM ev)")
def run_count(spark, sf):
    near = neighbours(events(spark, sf), "frame", {"p": "state"})
    return near.agg(F.count_if(F.col("p").isNull() | (F.col("state") != F.col("p"))).alias("runs"))


@query("o6_06_black_runs", f'WITH {USER_EVENTS} SELECT user_id, min(frame) AS first, max(frame) AS last, count(*) AS "count" FROM (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM uev WHERE x < 800) GROUP BY user_id, g')
def black_runs(spark, sf):
    return islands.ranges_where(user_events(spark, sf), "frame", F.col("x") < 800, ("user_id",))


@query("o6_07_segment_starts", f"WITH {EVENTS} SELECT frame FROM (SELECT frame, x // 2000 AS v, lag(x // 2000) OVER (ORDER BY frame) AS p FROM ev) WHERE v IS DISTINCT FROM p")
def segment_starts(spark, sf):
    return islands.segments(events(spark, sf).select("frame", F.floor(F.col("x") / 2_000).alias("v")), "frame", "v").select(F.col("start").alias("frame"))


@query("o7_05_priority_order", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, abs(l_linenumber - 3), l_linenumber) AS INTEGER) AS place FROM lineitem")
def priority_order(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), F.abs(F.col("l_linenumber") - 3), "l_linenumber")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("o7_08_transfer_order", "SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_suppkey, l_linenumber), ',') AS places FROM lineitem GROUP BY 1")
def transfer_order(spark, sf):
    each = F.sort_array(F.collect_list(F.struct("l_suppkey", "l_linenumber")))
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(each, lambda r: r["l_linenumber"].cast("string")), ",").alias("places"))


@query("o8_02_break_set", f"WITH {EVENTS} SELECT frame FROM ev WHERE state = 'error' AND frame <> (SELECT max(frame) FROM ev)")
def break_set(spark, sf):
    ev = events(spark, sf)
    return ev.join(F.broadcast(ev.agg(F.max("frame").alias("last"))), (F.col("state") == "error") & (F.col("frame") != F.col("last"))).select("frame")


_PALETTE = tiles.LEVELS[(np.arange(15) * 37 + 11) % 512]
_PALETTE_SQL = "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(_PALETTE.tolist())) + ") p(i, r, g, b)"
_LUT = f"lut AS (SELECT k AS key, CAST(min(d * 16 + i) // 16 AS BIGINT) AS error, CAST(min(d * 16 + i) % 16 AS INTEGER) AS index FROM (SELECT k, i, (k // 64 - r) * (k // 64 - r) + (k // 8 % 8 - g) * (k // 8 % 8 - g) + (k % 8 - b) * (k % 8 - b) AS d FROM range(512) t(k), {_PALETTE_SQL}) GROUP BY k)"


@query("o9_03_nearest_lut", f"WITH {_LUT} SELECT CAST(0 AS INTEGER) AS line, CAST(key AS INTEGER) AS key, error, index FROM lut")
def nearest_lut(spark, sf):
    return tiles.nearest_lut(spark, {0: _PALETTE})


@query("o9_02_nearest_index", f"WITH {_LUT} SELECT p_partkey, index FROM part JOIN lut ON key = p_partkey % 512")
def nearest_index(spark, sf):
    lut = tiles.nearest_lut(spark, {0: _PALETTE}).select("key", "index")
    return read(spark, sf, "part").join(F.broadcast(lut), F.col("p_partkey") % 512 == F.col("key")).select("p_partkey", "index")


@query("o9_04b_group_error", f"WITH {_LUT} SELECT l_orderkey, CAST(sum(error) AS BIGINT) AS error FROM lineitem JOIN lut ON key = l_partkey % 512 GROUP BY 1")
def group_error(spark, sf):
    lut = tiles.nearest_lut(spark, {0: _PALETTE}).select("key", "error")
    return read(spark, sf, "lineitem").join(F.broadcast(lut), F.col("l_partkey") % 512 == F.col("key")).groupBy("l_orderkey").agg(F.sum("error").alias("error"))


@query("o9_28_sign_magnitude", f"WITH {EVENTS} SELECT frame, CASE WHEN v >= 0 THEN least(v, 127) ELSE 128 | least(-v, 126) END AS byte FROM (SELECT frame, ((x - 3000) * 5) >> 8 AS v FROM ev)")
def sign_magnitude(spark, sf):
    v = F.shiftright((F.col("x") - 3_000) * 5, 8)
    return events(spark, sf).select("frame", F.when(v >= 0, F.least(v, F.lit(127))).otherwise(F.least(-v, F.lit(126)).bitwiseOR(128)).alias("byte"))


@query("o9_30_cell_mean_error", "SELECT l_orderkey, round(avg(abs(l_quantity - l_discount * 100)), 6) AS mean_error, avg(abs(l_quantity - l_discount * 100)) > 20 AS bad FROM lineitem GROUP BY 1")
def cell_mean_error(spark, sf):
    e = F.abs(F.col("l_quantity") - F.col("l_discount") * 100)
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(e), 6).alias("mean_error"), (F.avg(e) > 20).alias("bad"))


@query("o9_31_best_candidate", "SELECT o_orderkey, arg_min(k, abs(o_totalprice - k * 50000) * 10 + k) AS best FROM orders, (VALUES (0), (1), (2), (3)) c(k) GROUP BY 1")
def best_candidate(spark, sf):
    costs = F.array_min(F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.struct((F.abs(F.col("o_totalprice") - k * 50_000) * 10 + k).alias("c"), k.alias("k"))))
    return read(spark, sf, "orders").select("o_orderkey", costs["k"].alias("best"))


@query("o11_05_decimal_text", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) WHEN p_size % 4 = 2 THEN (p_size // 4) || '.5' ELSE (p_size // 4) || '.' || (p_size % 4 * 25) END AS b FROM part")
def decimal_text(spark, sf):
    return read(spark, sf, "part").select("p_partkey", fn.decimal_text(F.col("p_size")).alias("a"), fn.decimal_text(F.col("p_size") / 4).alias("b"))


@query("o11_06_low_word", "SELECT o_orderkey, CAST((o_orderkey * 77777) & 65535 AS BIGINT) AS pc FROM orders")
def low_word(spark, sf):
    text = F.hex(F.col("o_orderkey") * 77_777)
    return read(spark, sf, "orders").select("o_orderkey", F.conv(text, 16, 10).cast("long").bitwiseAND(0xFFFF).alias("pc"))


@query("o11_09_ratio", "SELECT p_partkey, CAST(p_partkey + 1 AS DOUBLE) / (p_size + 1) AS ratio FROM part")
def ratio(spark, sf):
    return read(spark, sf, "part").select("p_partkey", fn.ratio(F.concat((F.col("p_partkey") + 1).cast("string"), F.lit("/"), (F.col("p_size") + 1).cast("string"))).alias("ratio"))


@query("o11_10_cap_spec", "SELECT frame, CASE WHEN frame = 0 THEN 250 ELSE [170, 250][CAST((frame - 1) % 2 + 1 AS INTEGER)] END AS cap FROM range(1000) t(frame)")
def cap_spec(spark, sf):
    return spark.range(1_000).select(F.col("id").alias("frame"), fn.cyclic_cap(F.col("id"), [2, 3], "2:170,3:250").alias("cap"))


@query("o12_03_alert", f"WITH {USER_EVENTS}, m AS (SELECT user_id, count(*) FILTER (state = 'error') AS errors, count(*) FILTER (x > 9000) AS high FROM uev GROUP BY 1) SELECT user_id, CASE WHEN errors > 20 OR high > 6 THEN 'FAIL' WHEN errors > 12 OR high > 3 THEN 'WARN' ELSE 'PASS' END AS alert FROM m")
def alert(spark, sf):
    m = user_events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("state") == "error").alias("errors"), F.count_if(F.col("x") > 9_000).alias("high"))
    return stats.verdict(m, {"errors": (12, 20), "high": (3, 6)}).select("user_id", "alert")


@query("o12_05_frozen_equality", "SELECT l_orderkey FROM (SELECT l_orderkey, count(*) AS a, count(DISTINCT l_linenumber) AS b FROM lineitem GROUP BY 1) WHERE a <> b")
def frozen_equality(spark, sf):
    li = read(spark, sf, "lineitem")
    frozen = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rebuilt = li.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("n"))
    return align.difference(frozen, rebuilt).select("l_orderkey").distinct()


@query("o13_02_gap_sessions", "WITH f AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM f) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start FROM s GROUP BY user_id, g")
def gap_sessions(spark, sf):
    df = read(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return df.groupBy("user_id", F.session_window("t", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", "n", F.unix_micros("w.start").alias("start"))


@query("o13_05_per_frame_map", f"WITH {EVENTS} SELECT frame, md5(state || '-' || CAST(x AS VARCHAR)) AS identity FROM ev")
def per_frame_map(spark, sf):
    """A Python function of each frame, over Arrow batches; rows carry their frame, so no order is needed."""

    def run(batches):
        for pdf in batches:
            text = pdf["state"] + "-" + pdf["x"].astype(str)
            yield pd.DataFrame({"frame": pdf["frame"], "identity": [hashlib.md5(t.encode()).hexdigest() for t in text]})

    return events(spark, sf).select("frame", "state", "x").mapInPandas(run, "frame long, identity string")


@query("o16_02_best_three", "WITH q AS (SELECT vec_id, embedding FROM embeddings), d AS (SELECT q.vec_id, e.vec_id AS other, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS err FROM q JOIN embeddings e ON e.vec_id BETWEEN q.vec_id - 20 AND q.vec_id + 20 AND e.vec_id <> q.vec_id) SELECT vec_id, other, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY err, other) AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY err, other) <= 3")
def best_three(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    # Each vector goes to its block of ids and the blocks beside it, three copies instead of one for each neighbour.
    block = F.floor(F.col("vec_id") / 64)
    near = e.select(F.col("vec_id").alias("other"), "embedding", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    both = e.select("vec_id", F.col("embedding").alias("v"), block.alias("block")).join(near, "block").where("abs(vec_id - other) between 1 and 20")
    error = F.aggregate(F.zip_with("v", "embedding", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(error, "other")))
    return ranked.where("rank <= 3").select("vec_id", "other", "rank")


@query("o16_03_first_occurrence", "SELECT l_partkey, min(l_orderkey * 8 + l_linenumber) AS first, count(*) AS n FROM lineitem GROUP BY 1")
def first_occurrence(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first"), F.count("*").alias("n"))


@query("o16_04_confident_mismatches", f"WITH {EVENTS}, {DAYS} SELECT count(*) FILTER (x > 1000) AS compared, count(*) FILTER (x <= 1000 OR x IS NULL) AS skipped, count(*) FILTER (x > 1000 AND x % 2 <> lines % 2) AS mismatched FROM dy LEFT JOIN ev USING (frame)")
def confident_mismatches(spark, sf):
    both = days(spark, sf).join(events(spark, sf).select("frame", "x"), "frame", "left")
    sure = F.coalesce(F.col("x") > 1_000, F.lit(False))
    return both.agg(F.count_if(sure).alias("compared"), F.count_if(~sure).alias("skipped"), F.count_if(sure & (F.col("x") % 2 != F.col("lines") % 2)).alias("mismatched"))


@query("o16_05_flagged_runs", f"WITH {EVENTS} SELECT count(*) FILTER (c AND NOT coalesce(p, false)) AS runs FROM (SELECT x > 3000 AS c, lag(x > 3000) OVER (ORDER BY frame) AS p FROM ev)")
def flagged_runs(spark, sf):
    return islands.ranges_where(events(spark, sf), "frame", F.col("x") > 3_000).agg(F.count("*").alias("runs"))


@query("o16_13_neighbour_borders", "WITH c AS (SELECT p_partkey AS cell, p_partkey % 40 AS col, p_size AS v FROM part) SELECT CAST(sum(abs(a.v - b.v)) AS BIGINT) AS seam FROM c a JOIN c b ON b.cell = a.cell + 1 AND a.col < 39")
def neighbour_borders(spark, sf):
    c = read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), (F.col("p_partkey") % 40).alias("col"), F.col("p_size").alias("v"))
    near = neighbours(c, "cell", {"next": "cell", "w": "v"}, ahead=True)
    return near.where((F.col("col") < 39) & (F.col("next") == F.col("cell") + 1)).agg(F.sum(F.abs(F.col("v") - F.col("w"))).cast("long").alias("seam"))


@query("o16_16_two_paths", f"WITH {_LUT}, d AS (SELECT l_partkey % 512 AS key, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT key, min((key // 64 - r) * (key // 64 - r) + (key // 8 % 8 - g) * (key // 8 % 8 - g) + (key % 8 - b) * (key % 8 - b)) AS direct FROM d, {_PALETTE_SQL} GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS compared, CAST(coalesce(sum(n) FILTER (error <> direct), 0) AS BIGINT) AS differing, CAST(sum(n * error) AS BIGINT) AS total FROM d JOIN lut USING (key) JOIN b USING (key)")
def two_paths(spark, sf):
    """One row: how many lines were compared by the table's path and by direct distances, how many differ, and their error."""
    keyed = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 512).alias("key"))
    by_table = keyed.join(F.broadcast(tiles.nearest_lut(spark, {0: _PALETTE}).select("key", "error")), "key")
    channel = lambda k: F.shiftright(F.col("key").cast("int"), k).bitwiseAND(7)
    direct = F.least(*[(channel(6) - r) * (channel(6) - r) + (channel(3) - g) * (channel(3) - g) + (channel(0) - b) * (channel(0) - b) for r, g, b in _PALETTE.tolist()])
    both = by_table.withColumn("direct", direct.cast("long"))
    return both.agg(F.count("*").alias("compared"), F.count_if(~F.col("error").eqNullSafe(F.col("direct"))).alias("differing"), F.sum("error").alias("total"))


@query("o16_22_saved_bytes", f"WITH {EVENTS} SELECT CAST(sum(greatest(0, 140 + u * 2 - u * 4)) AS BIGINT) AS saved, count(*) FILTER (u * 4 < 140 + u * 2) AS lists FROM (SELECT x % 120 AS u FROM ev)")
def saved_bytes(spark, sf):
    u = F.col("x") % 120
    return events(spark, sf).agg(F.sum(F.greatest(F.lit(0), 140 + u * 2 - u * 4)).alias("saved"), F.count_if(u * 4 < 140 + u * 2).alias("lists"))


@query("o16_32_strobe_distances", f"WITH {DAYS}, c AS (SELECT frame, lines, sum(demand) OVER (ORDER BY frame) AS t FROM dy) SELECT frame, CAST(t - lag(t) OVER (ORDER BY frame) AS BIGINT) AS distance FROM c WHERE lines % 5 = 0")
def strobe_distances(spark, sf):
    t = running(days(spark, sf), "frame", {"t": ("sum", F.col("demand"))}).where("lines % 5 = 0")
    return neighbours(t, "frame", {"p": "t"}).select("frame", (F.col("t") - F.col("p")).alias("distance"))


@query("o16_42_meters", "SELECT p_partkey, CAST(CASE WHEN p_size = 0 THEN 0 ELSE greatest(1, p_size * 24 // 50) END AS BIGINT) AS height FROM part")
def meters(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("p_size") * 24 / 50))).cast("long").alias("height"))


@query("o10_29b_two_sided_queue", f"WITH RECURSIVE {DAYS}, q(frame, level) AS (SELECT frame, least(2000, greatest(0, supply - demand)) FROM dy WHERE frame = 0 UNION ALL SELECT dy.frame, least(2000, greatest(0, q.level + dy.supply - dy.demand)) FROM q JOIN dy ON dy.frame = q.frame + 1) SELECT frame, level FROM q")
def two_sided_queue(spark, sf):
    return clamp.clamped(days(spark, sf), "frame", F.col("supply") - F.col("demand"), 0, 2_000, into="level")
