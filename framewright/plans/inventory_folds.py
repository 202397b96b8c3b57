"""Queries of folds, subset sums, round trips and proofs, beside their SQL (recursive where the fold is)."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators import align, clamp, islands, planning, ranking, signal, tiles
from framewright.operators.scan import neighbours
from framewright.sources import archives, binary, tables

from .inventory import _LV, _PX, _folder, _levels
from .more_queries import _LUT, _PALETTE
from .queries import query
from .traces import DAYS, EVENTS, days, events, read

# --- sources


@query("o1_17_media_metadata", f"WITH {EVENTS} SELECT frame AS pts, state AS codec, CAST(x AS DOUBLE) / 100 AS rate FROM ev")
def media_metadata(spark, sf):
    """Packet properties as JSON lines, read with a schema."""
    path = _folder(spark)
    rows = events(spark, sf).select(F.struct(F.struct(F.col("frame").alias("pts")).alias("packet"), F.struct(F.col("state").alias("codec_name"), (F.col("x").cast("double") / 100).alias("rate")).alias("stream")).alias("r"))
    rows.select(F.to_json("r").alias("value")).write.text(path)
    back = spark.read.schema("packet struct<pts:long>, stream struct<codec_name:string, rate:double>").json(path)
    return back.select("packet.pts", F.col("stream.codec_name").alias("codec"), "stream.rate")


@query("o1_20_wave_files", "WITH d AS (SELECT doc_id, md5(text) AS m FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, k, instr('0123456789abcdef', substr(m, CAST(k * 4 + 1 AS INTEGER), 1)) * 16 + instr('0123456789abcdef', substr(m, CAST(k * 4 + 2 AS INTEGER), 1)) - 17 AS lo, instr('0123456789abcdef', substr(m, CAST(k * 4 + 3 AS INTEGER), 1)) * 16 + instr('0123456789abcdef', substr(m, CAST(k * 4 + 4 AS INTEGER), 1)) - 17 AS hi FROM d, range(8) t(k)) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(8000 AS INTEGER) AS rate, CAST(sum(lo + hi * 256 - CASE WHEN hi >= 128 THEN 65536 ELSE 0 END) AS BIGINT) AS total FROM s GROUP BY doc_id")
def wave_files(spark, sf):
    """The 16 bytes of a text's MD5 as eight samples of a wave file."""
    head = "52494646" + "34000000" + "57415645" + "666D7420" + "10000000" + "01000100" + "401F0000" + "803E0000" + "02001000" + "64617461" + "10000000"
    files = read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.unhex(F.concat(F.lit(head), F.md5("text"))).alias("content"))
    found = binary.sound(files)
    return found.select("path", "rate", F.aggregate("pcm", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("o1_23_array_archives", f"WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS frame, CAST(x AS DOUBLE) AS a, CAST(second % 1000 AS DOUBLE) AS b FROM ev")
def array_archives(spark, sf):
    """One archive of two arrays for each user, written and read back."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("frame"), io.BytesIO()
        np.savez(out, a=pdf["x"].to_numpy(), b=pdf["second"].to_numpy() % 1_000)
        return pd.DataFrame({"path": [str(pdf["user_id"].iloc[0])], "content": [out.getvalue()]})

    files = events(spark, sf).select("user_id", "frame", "x", "second").groupBy("user_id").applyInPandas(pack, "path string, content binary")
    return archives.arrays(files, ["a", "b"])


@query("o2_01_group_report", f"WITH {EVENTS}, g AS (SELECT min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT frame, x, frame - row_number() OVER (ORDER BY frame) AS g FROM ev WHERE x > 3000) GROUP BY g), w AS (SELECT *, lag(last) OVER (ORDER BY first) AS before FROM g) SELECT CAST(first AS VARCHAR) AS first, CAST(n * 40 AS VARCHAR) AS duration_ms, CAST((first - before - 1) * 40 AS VARCHAR) AS gap_ms FROM w")
def group_report(spark, sf):
    """Groups with durations and the gap to the group before, as a table of text."""
    groups = neighbours(islands.ranges_where(events(spark, sf), "frame", F.col("x") > 3_000), "first", {"before": "last"})
    path = _folder(spark)
    tables.write_tsv(groups.select("first", (F.col("count") * 40).alias("duration_ms"), ((F.col("first") - F.col("before") - 1) * 40).alias("gap_ms")), path, ["first"])
    return tables.read_tsv(spark, path)


@query("o2_02_wide_report", f"WITH {DAYS} SELECT CAST(frame AS VARCHAR) AS frame, CAST(demand AS VARCHAR) AS demand, CAST(supply AS VARCHAR) AS supply, CAST(lines AS VARCHAR) AS lines, " + ", ".join(f"CAST(demand * {k} - supply AS VARCHAR) AS stat_{k:02}" for k in range(1, 13)) + " FROM dy")
def wide_report(spark, sf):
    path = _folder(spark)
    derived = [(F.col("demand") * k - F.col("supply")).alias(f"stat_{k:02}") for k in range(1, 13)]
    tables.write_tsv(days(spark, sf).select("frame", "demand", "supply", "lines", *derived), path, ["frame"])
    return tables.read_tsv(spark, path, needed=["frame", "stat_12"])


@query("o2_14_parts_by_kind", f"WITH {EVENTS} SELECT state, frame, x FROM ev")
def parts_by_kind(spark, sf):
    """A folder for each kind, so writers never share a file."""
    path = _folder(spark)
    events(spark, sf).select("state", "frame", "x").write.partitionBy("state").parquet(path)
    return spark.read.parquet(path).select("state", "frame", "x")


@query("o2_12_sector_bodies", "SELECT p_partkey AS frame, CAST(16 * ((p_size + 15) // 16) + 16 AS INTEGER) AS bytes, md5(rpad('c', 16, chr(0)) || CASE WHEN p_size > 0 THEN rpad(repeat('p', CAST(p_size AS INTEGER)), CAST(16 * ((p_size + 15) // 16) AS INTEGER), chr(0)) ELSE '' END) AS digest FROM part")
def sector_bodies(spark, sf):
    """Control and payload blocks of a frame, filled up to whole sectors."""
    part = read(spark, sf, "part")
    block = lambda kind, data: part.select(F.col("p_partkey").alias("frame"), F.lit(kind).alias("kind"), F.lit(0).alias("place"), data.cast("binary").alias("data"))
    body = binary.write_sectors(block("control", F.lit("c")).union(block("payload", F.repeat(F.lit("p"), F.col("p_size").cast("int")))), 16)
    return body.select("frame", F.octet_length("data").alias("bytes"), F.md5("data").alias("digest"))


# --- pictures and sound


@query("o3_02_near_by_fixed_limits", "SELECT vec_id AS frame, 2 * (vec_id % 20) + 1 <= 10 AS near FROM embeddings")
def near_by_fixed_limits(spark, sf):
    """Each picture's first tile against itself made lighter by an odd number of levels."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                a = np.repeat(np.stack(pdf["l"].to_numpy())[:, :, None], 3, axis=2).astype(np.float64)
                yield pd.DataFrame({"frame": pdf["frame"], "near": tiles.perceptual(a, a + (2 * (pdf["frame"].to_numpy() % 20) + 1)[:, None, None])})

    return _levels(spark, sf).mapInPandas(run, "frame long, near boolean")


@query("o9_15_best_fade_scale", f"WITH {_PX}, e AS (SELECT frame, k, sum((((v % 15) * 17 * k + 32) // 64 - v) * (((v % 15) * 17 * k + 32) // 64 - v)) * 3 AS error FROM px, range(65) t(k) GROUP BY 1, 2) SELECT frame, CAST(k AS INTEGER) AS step, CAST(error AS BIGINT) AS error FROM e QUALIFY row_number() OVER (PARTITION BY frame ORDER BY error, abs(k - 40), k) = 1")
def best_fade_scale(spark, sf):
    palette = np.repeat((np.arange(15) * 17)[:, None], 3, axis=1)

    def run(batches):
        for pdf in batches:
            out = []
            for frame, l in zip(pdf["frame"], pdf["l"], strict=True):
                level = np.asarray(l, dtype=np.int64)
                out.append((frame, *tiles.best_scale(palette, level % 15, np.repeat(level[:, None], 3, axis=1), 40)))
            yield pd.DataFrame(out, columns=["frame", "step", "error"])

    return _levels(spark, sf).mapInPandas(run, "frame long, step int, error long")


@query("o9_16_canonical_palettes", f"WITH {_PX} SELECT frame, sum((v % 15 * 5 + frame) % 8)::BIGINT AS shown, true AS same FROM px GROUP BY 1")
def canonical_palettes(spark, sf):
    """Palettes and entries put in order show the same pixels."""

    def run(batches):
        for pdf in batches:
            out = []
            for frame, l in zip(pdf["frame"], pdf["l"], strict=True):
                grey = (np.arange(15) * 5 + frame) % 8
                given = np.stack([np.repeat(grey[:, None], 3, axis=1), np.repeat(grey[::-1, None], 3, axis=1)]).astype(np.uint8)
                lines, indices = np.array([0, 1]), np.stack([np.asarray(l) % 15 + 1, 15 - np.asarray(l) % 15])
                ordered, line, index = tiles.canonical_order(given, lines, indices)
                before = np.stack([given[lines[k]][indices[k] - 1, 0] for k in range(2)])
                after = np.stack([ordered[line[k]][index[k] - 1, 0] for k in range(2)])
                out.append((frame, int(after[0].sum()), bool((before == after).all())))
            yield pd.DataFrame(out, columns=["frame", "shown", "same"])

    return _levels(spark, sf).mapInPandas(run, "frame long, shown long, same boolean")


@query("o9_27_retimed", f"WITH {_LV}, r AS (SELECT frame, j, round_even((l[j // 2 + 1] + l[(j + 1) // 2 + 1]) * 50 / 2::DOUBLE, 0) AS v FROM lv, range(127) t(j)) SELECT frame, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (j % 7)) AS BIGINT) AS weighted FROM r GROUP BY 1")
def retimed(spark, sf):
    """64 levels as samples, brought to 127."""

    def run(batches):
        for pdf in batches:
            out = []
            for frame, l in zip(pdf["frame"], pdf["l"], strict=True):
                v = signal.retime(np.asarray(l, dtype=np.int64) * 50, 127).astype(np.int64)
                out.append((frame, len(v), int(v.sum()), int((v * (np.arange(127) % 7)).sum())))
            yield pd.DataFrame(out, columns=["frame", "samples", "total", "weighted"])

    return _levels(spark, sf).mapInPandas(run, "frame long, samples long, total long, weighted long")


@query("o13_06_shared_palette", f"WITH {_LUT} SELECT p_partkey, CAST(index AS BIGINT) AS index FROM part JOIN lut ON key = p_partkey % 512")
def shared_palette(spark, sf):
    """A palette that is broadcast once; each Python worker makes its table when it starts."""
    palette = spark.sparkContext.broadcast(_PALETTE)

    def run(batches):
        index = tiles.nearest_table(palette.value)[1]
        for pdf in batches:
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "index": index[pdf["p_partkey"].to_numpy() % 512]})

    return read(spark, sf, "part").select("p_partkey").mapInPandas(run, "p_partkey long, index long")


# --- planning


_SIZES = "o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k, CAST(l_quantity AS BIGINT) AS n FROM lineitem), g AS (SELECT l_orderkey, list(n ORDER BY k) AS sizes FROM o GROUP BY 1)"
_MASKS = f"{_SIZES}, m AS (SELECT l_orderkey, sizes, unnest(range(1 << len(sizes))) AS mask FROM g), s AS (SELECT l_orderkey, mask, list_sum(list_transform(range(len(sizes)), lambda k: CASE WHEN (mask >> k) & 1 = 1 THEN sizes[k + 1] ELSE 0 END)) AS total FROM m)"


def _each_order(spark, sf, name: str, kind: str, of):
    """Of each order's quantities; one that is not known counts as nothing."""
    lines = read(spark, sf, "lineitem").withColumn("n", F.coalesce(F.col("l_quantity").cast("long"), F.lit(0)))
    return planning.of_each(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "n", of, name, kind)


@query("o10_22_exact_subsets", f"WITH {_MASKS} SELECT l_orderkey, bool_or(total = 50) AS exact FROM s GROUP BY 1")
def exact_subsets(spark, sf):
    """Whether some of an order's quantities add up to 50; what is found is added up again."""

    def of(sizes):
        found = planning.exact_subset(sizes, 50)
        return found is not None and sum(sizes[k] for k in found) == 50 and len(set(found)) == len(found)

    return _each_order(spark, sf, "exact", "boolean", of)


@query("o10_23_best_subsets", f"WITH {_MASKS} SELECT l_orderkey, max(list_sum(list_transform(range(len(sizes)), lambda k: CASE WHEN (mask >> k) & 1 = 1 THEN sizes[k + 1] * 7 % 10 ELSE 0 END))) FILTER (total = 50) AS score FROM s JOIN g USING (l_orderkey) GROUP BY 1")
def best_subsets(spark, sf):
    """The greatest score of quantities that add up to 50."""

    def of(sizes):
        found = planning.best_subset(sizes, [(n * 7 % 10,) for n in sizes], 50)
        return None if found is None else sum(sizes[k] * 7 % 10 for k in found)

    return _each_order(spark, sf, "score", "long", of)


@query("o10_24_least_horizons", f"WITH {_MASKS} SELECT l_orderkey, min(CASE WHEN mask = 0 THEN 0 ELSE length(bin(mask)) END) FILTER (total = 50) AS horizon FROM s GROUP BY 1")
def least_horizons(spark, sf):
    """How many of an order's first quantities are needed until some add up to 50."""
    return _each_order(spark, sf, "horizon", "long", lambda sizes: planning.least_horizon(sizes, 50))


@query("o13_03_ledger", f"WITH RECURSIVE {DAYS}, q(frame, demand, held, granted) AS (SELECT frame, demand, greatest(0, 1200 - demand), least(1200, demand) FROM dy WHERE frame = 0 UNION ALL SELECT dy.frame, dy.demand, greatest(0, q.held + 1200 - dy.demand), least(q.held + 1200, dy.demand) FROM q JOIN dy ON dy.frame = q.frame + 1) SELECT frame, CAST(held AS BIGINT) AS held, CAST(granted AS BIGINT) AS granted FROM q")
def ledger(spark, sf):
    """1,200 units a frame are earned; requests are granted up to what is held, and the rest carries over."""
    held = clamp.clamped(days(spark, sf), "frame", 1_200 - F.col("demand"), 0, 1 << 60, into="held")
    before = neighbours(held, "frame", {"before": "held"})
    both = before.join(days(spark, sf).select("frame", "demand"), "frame")
    return both.select("frame", "held", (F.coalesce("before", F.lit(0)) + 1_200 - F.col("held")).alias("granted"))


_CAPS = (500, 2_000, 8_000)


@query("o16_07_capacity_sweep", f"WITH RECURSIVE {DAYS}, q(cap, frame, level) AS (SELECT cap, frame, least(cap, greatest(0, supply - demand)) FROM dy, (VALUES {', '.join(f'({c}::BIGINT)' for c in _CAPS)}) c(cap) WHERE frame = 0 UNION ALL SELECT cap, dy.frame, least(cap, greatest(0, q.level + dy.supply - dy.demand)) FROM q JOIN dy ON dy.frame = q.frame + 1), g AS (SELECT cap, frame, frame - row_number() OVER (PARTITION BY cap ORDER BY frame) AS g FROM q WHERE level > 0), r AS (SELECT cap, count(*) AS n FROM g GROUP BY cap, g) SELECT cap AS capacity, count(*) AS runs, max(n) AS longest FROM r GROUP BY 1")
def capacity_sweep(spark, sf):
    """The longest time a bounded queue is not empty, for several capacities."""
    out = None
    for cap in _CAPS:
        level = clamp.clamped(days(spark, sf), "frame", F.col("supply") - F.col("demand"), 0, cap, into="level")
        found = islands.ranges_where(level, "frame", F.col("level") > 0).agg(F.lit(cap).cast("long").alias("capacity"), F.count("*").alias("runs"), F.max("count").alias("longest"))
        out = found if out is None else out.union(found)
    return out.where("runs > 0")


# --- verifiers


@query("o12_07_exact_bytes", f"WITH {EVENTS} SELECT count(*) AS n, true AS equal FROM ev")
def exact_bytes(spark, sf):
    """A sequence of records as the model gives it, against the bytes that a file of it has."""
    ev = events(spark, sf)
    model = ev.select("frame", F.lower(F.concat(F.lpad(F.hex("frame"), 8, "0"), F.lpad(F.hex("x"), 8, "0"))).alias("v"))
    path = _folder(spark)
    ev.select("frame", F.unhex(F.concat(F.lpad(F.hex("frame"), 8, "0"), F.lpad(F.hex("x"), 8, "0"))).alias("bytes")).write.parquet(path)
    stored = spark.read.parquet(path).select("frame", F.lower(F.hex("bytes")).alias("v"))
    a, b = (align.sequence_digest(df, "frame", "v").withColumnRenamed("digest", d) for df, d in ((model, "a"), (stored, "b")))
    return a.join(b, "n").select("n", (F.col("a") == F.col("b")).alias("equal"))


@query("o12_08_decoded_replay", f"WITH {EVENTS} SELECT count(*) AS samples, true AS within FROM ev")
def decoded_replay(spark, sf):
    """Sound that was coded in chunks and decoded chunk by chunk, against a decoder that keeps its state through the stream."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        head = np.frombuffer(pdf["data"].iloc[0][:4], dtype=np.uint8)
        codes = np.frombuffer(b"".join(d[4:] for d in pdf["data"]), dtype=np.uint8)
        pcm = signal.adpcm_decode(codes[None], head[:2].copy().view(">i2"), head[2:3])[0]
        apart = np.concatenate([np.asarray(x) for x in pdf["pcm"]])
        return pd.DataFrame({"samples": [len(pcm) // 2], "within": [bool((pcm == apart).all())]})

    ev = events(spark, sf).select(F.col("user_id").alias("stream"), F.col("frame").alias("part"), F.array(F.col("x") % 30_000, -(F.col("x") % 20_000)).cast("array<smallint>").alias("pcm"))
    coded = signal.encode_streams(ev, 2)
    both = coded.join(signal.decode_chunks(coded), ["stream", "chunk"])
    return both.groupBy("stream").applyInPandas(whole, "samples long, within boolean").agg(F.sum("samples").alias("samples"), F.bool_and("within").alias("within"))


@query("o12_10_cache_completeness", f"WITH {EVENTS}, w AS (SELECT unnest(range((SELECT max(second) - min(second) FROM ev) // 60 + 1)) AS minute), h AS (SELECT DISTINCT (second - (SELECT min(second) FROM ev)) // 60 AS minute FROM ev) SELECT minute FROM w WHERE minute NOT IN (SELECT minute FROM h)")
def cache_completeness(spark, sf):
    """The minutes from the first event to the last of which nothing is held."""
    ev = events(spark, sf)
    span = ev.agg(F.min("second").alias("first"), F.max("second").alias("last"))
    wanted = span.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / 60))).alias("minute"))
    held = ev.crossJoin(F.broadcast(span)).select(F.floor((F.col("second") - F.col("first")) / 60).alias("minute"))
    return ranking.only_left(wanted, held, "minute").select(F.col("minute").cast(T.LongType()).alias("minute"))


@query("o12_12_first_not_rising", f"WITH {EVENTS} SELECT min(frame) AS first FROM (SELECT frame, x, lag(x) OVER (ORDER BY frame) AS p FROM ev) WHERE x <= p")
def first_not_rising(spark, sf):
    near = neighbours(events(spark, sf).select("frame", "x"), "frame", {"p": "x"})
    return near.agg(F.min(F.when(F.col("x") <= F.col("p"), F.col("frame"))).alias("first"))


@query("o16_18_lossless_order", f"WITH {_PX} SELECT count(DISTINCT frame) AS pictures, 0::BIGINT AS differing FROM px")
def lossless_order(spark, sf):
    found = canonical_palettes(spark, sf)
    return found.agg(F.count("*").alias("pictures"), F.count_if(~F.col("same")).alias("differing"))


@query("o16_26_entry_walk", "SELECT p_partkey, CAST(sum(CASE WHEN (p_partkey >> k) & 1 = 1 THEN k + 1 ELSE 0 END) AS BIGINT) AS total, true AS same FROM part, range(24) t(k) GROUP BY 1")
def entry_walk(spark, sf):
    """Set bits by a mask for each place, against a walk that clears the lowest one at each step."""
    masks = F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.lit(0).cast("long"), lambda a, k: a + F.when(F.expr("p_partkey").bitwiseAND(F.pow(F.lit(2), k).cast("long")) != 0, k + 1).otherwise(0))
    start = F.struct(F.col("p_partkey").alias("left"), F.lit(0).cast("long").alias("total"))

    def step(acc, _):
        low = acc["left"].bitwiseAND(-acc["left"])
        place = F.when(acc["left"] != 0, F.round(F.log2(low)).cast("long") + 1).otherwise(0)
        return F.struct(acc["left"].bitwiseAND(acc["left"] - 1).alias("left"), (acc["total"] + place).alias("total"))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step)["total"]
    return read(spark, sf, "part").select("p_partkey", masks.alias("total"), (masks == walk).alias("same"))
