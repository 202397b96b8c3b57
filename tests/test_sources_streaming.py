from __future__ import annotations

import gzip
import io
import os
import struct
import wave
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.sources import binary, profile, tables
from framewright.streaming import online


def test_tsv_round_trip(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.5, "x")], "frame long, v double, s string")
    tables.write_tsv(df, path, ["frame"])
    back = tables.read_trace(spark, path, "frame long, v double, s string, missing int")
    assert [tuple(r) for r in back.orderBy("frame").collect()] == [(0, 1.0, None, None), (1, 2.5, "x", None)]
    assert [r.v for r in tables.read_tsv(spark, path).orderBy("frame").collect()] == ["1", "2.5"]
    with pytest.raises(ValueError):
        tables.read_tsv(spark, path, needed=["other"])


def test_trace_rules(spark, tmp_path):
    one = tmp_path / "a.tsv"
    one.write_text("frame\tv\n0\t5\n1\t6\n1\t7\n2\t8\n")
    assert [tuple(r) for r in tables.read_trace(spark, str(one), "frame long, v long", last_frame=1).orderBy("frame").collect()] == [(0, 5), (1, 7)]
    # The later file is the longer one, which Spark deals out first.
    two = tmp_path / "two"
    two.mkdir()
    (two / "a.tsv").write_text("frame\tv\n0\t1\n1\t2\n")
    (two / "b.tsv").write_text("frame\tv\n" + "".join(f"{k}\t{k * 10}\n" for k in range(400)))
    assert tables.read_trace(spark, str(two), "frame long, v long").where("v <> frame * 10").count() == 0
    (two / "c.tsv").write_text("frame\tv\n1\t7\n")
    assert [tuple(r) for r in tables.read_trace(spark, str(two), "frame long, v long").where("v <> frame * 10").collect()] == [(1, 7)]
    one.write_text("frame\tv\n0\t5\n2\t8\n")
    with pytest.raises(ValueError):
        tables.read_trace(spark, str(one), "frame long, v long")
    one.write_text("frame\tv\n")
    with pytest.raises(ValueError):
        tables.read_tsv(spark, str(one))


def test_logs(spark, tmp_path):
    line = "[core ERROR] [224(224)][100(100)] DMA type 1 (102 access/line)(100 cycles left)-> 47 access (47 remaining) (1d7e)"
    path = tmp_path / "log.txt.gz"
    path.write_bytes(gzip.compress(f"{line}\nnoise 1\nMode=3 first\nnoise 2\nMode=4 last\n".encode()))
    log = tables.lines(spark, str(path))
    assert tuple(tables.transfers(log).first()) == (224, 100, 1, 102, 100, 47, 47, 0x1D7E)
    kept, dropped = tables.compacted(log, "^noise")
    assert kept.count() == 3 and dropped.first().dropped == 2
    assert tables.summaries(log, ["Mode="]).first().line == "Mode=4 last"
    assert tables.summaries(tables.lines(spark, str(path), "at"), ["Mode="], "at").first().line == "Mode=4 last"
    assert tables.receipts(spark, str(tmp_path)).first().bytes == path.stat().st_size


def test_json(spark, tmp_path):
    tables.write_json(spark.createDataFrame([(1, [2])], "a long, b array<long>"), f"{tmp_path}/j", 3)
    assert spark.read.json(f"{tmp_path}/j").first().asDict() == {"a": 1, "b": [2], "schema_version": 3}


def test_binary_records(spark, tmp_path):
    rows = [(k * 100, k, 8 * k) for k in range(50)]
    path = tmp_path / "chunks.bin"
    path.write_bytes(b"".join(struct.pack(">IHH", *r) for r in rows))
    got = binary.records(binary.files(spark, str(path)), binary.CHUNK).orderBy("place").collect()
    assert [(r.offset, r.bytes, r.bits) for r in got] == rows
    spark.dataSource.register(binary.RecordSource)
    own = spark.read.format("framewright_records").option("path", str(path)).option("record", "offset:>u4,bytes:>u2,bits:>u2").option("rows", 7).load()
    assert own.rdd.getNumPartitions() == 8 and [(r.offset, r.bytes, r.bits) for r in own.orderBy("place").collect()] == rows
    head = binary.header(binary.files(spark, str(path)), {"first": (0, ">u4"), "third": (8, ">u4")}).first()
    assert (head.first, head.third) == (0, 100)
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="do not make records"):
        binary.records(binary.files(spark, str(tmp_path / "bad.bin")), binary.CHUNK).collect()


def test_sectors_round_trip(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "control", 0, b"ab"), (1, "control", 1, b"c"), (1, "payload", 0, b"x" * 9), (2, "payload", 0, b"y" * 8)], "frame long, kind string, place int, data binary")
    whole = binary.write_sectors(blocks, 8).orderBy("frame").collect()
    path = tmp_path / "body.dat"
    path.write_bytes(b"".join(bytes(r.data) for r in whole))
    routes = spark.createDataFrame([(1, 1, 2, 3), (2, 0, 1, 1)], "frame long, control int, payload int, total int")
    got = binary.routed_sectors(binary.files(spark, str(path)), routes, 8).collect()
    assert [(r.frame, r.kind, bytes(r.data).rstrip(b"\0")) for r in got] == [(1, "control", b"abc"), (1, "payload", b"x" * 8), (1, "payload", b"x"), (2, "payload", b"y" * 8)]


def test_sound(spark, tmp_path):
    pcm = np.arange(-500, 500, dtype="<i2")
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(8_000)
            w.writeframes(pcm.tobytes())
        (tmp_path / "a.wav").write_bytes(out.getvalue())
    rows = binary.sound(binary.files(spark, str(tmp_path / "a.wav")), 300).orderBy("part").collect()
    assert [len(r.pcm) for r in rows] == [300, 300, 300, 100] and sum((r.pcm for r in rows), []) == pcm.tolist()


def test_profiles():
    good = 'schema_version = 5\n[video]\nwidth = 256\n[source]\nfps = "30000/1001"\n'
    assert profile.load(good)["video"] == {"width": 256}
    for bad in (good.replace("5", "4", 1), good + "[other]\n", good.replace("width", "wide"), good.replace("256", '"256"')):
        with pytest.raises(ValueError):
            profile.load(bad)


def ran(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_online_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 0, "a"), (1, "2024-01-01 00:00:01", 1, "a"), (1, "2024-01-01 00:00:02", 2, "b"), (1, "2024-01-01 00:00:09", 9, "b"), (2, "2024-01-01 00:00:01", 5, "a"), (3, "2024-01-03 00:00:00", 0, "z")]
    df = spark.createDataFrame(rows, "stream long, ts string, position long, value string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(2):
        df.where(f"stream = 3 = {'true' if k else 'false'}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ran(online.online_sessions(stream, 3), "sessions")
    got = {(r.stream, r["first"], r["last"], r.samples, r.value) for r in spark.table("sessions").collect()}
    assert {(1, 0, 1, 2, "a"), (1, 2, 2, 1, "b")} <= got <= {(1, 0, 1, 2, "a"), (1, 2, 2, 1, "b"), (1, 9, 9, 1, "b"), (2, 5, 5, 1, "a")}


def test_online_consensus_and_ledger(spark, tmp_path):
    rows = [(k, "2024-01-01 00:00:00", "f", k % 3) for k in range(9)]
    df = spark.createDataFrame(rows, "k long, ts string, field string, value long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/c")
    ran(online.online_consensus(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/c"), "1 minute", "1 minute"), "votes", "complete")
    assert {(r.value, r.votes) for r in spark.table("votes").collect()} == {(0, 3), (1, 3), (2, 3)}


def test_online_ledger_does_not_depend_on_batches(spark, tmp_path):
    """Frame 1 of stream 1 comes in two batches; a last frame waits for a later one."""
    batches = [[(1, 0, 3), (1, 1, 12), (2, 0, 99)], [(1, 1, 8), (1, 2, 4)], [(1, 3, 0), (2, 1, 0)]]
    schema = "stream long, frame long, amount long"
    granted = {(1, 0): (3, 3), (1, 1): (20, 17), (1, 2): (4, 4), (2, 0): (99, 10)}
    for name, parts in (("three", batches), ("one", [sum(batches, [])])):
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            os.utime(next(p for p in Path(f"{tmp_path}/{name}").glob("*.parquet") if p.stat().st_mtime > 1e9), (1e9 + k, 1e9 + k))
        df = spark.readStream.schema("stream long, frame long, amount long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        ran(online.online_ledger(df, 10), f"grants_{name}")
        assert {(r.stream, r.frame): (r.asked, r.granted) for r in spark.table(f"grants_{name}").collect()} == granted


@pytest.mark.parametrize("most", [1, 40, 1 << 22])
def test_small_files_together(spark, most):
    """Files of different lengths, empty ones among them, give the records of each, in order."""
    files = [(f"f{k}", b"".join(struct.pack(">IHH", 1_000 * k + n, n, k) for n in range(k % 4))) for k in range(40)]
    df = spark.createDataFrame(files, "path string, content binary").coalesce(1)
    got = binary.records(df, binary.CHUNK, most=most).collect()
    assert [tuple(r) for r in got] == [(f"f{k}", n, 1_000 * k + n, n, k) for k in range(40) for n in range(k % 4)]
    routes = spark.createDataFrame([(5, 1, 1, 3), (9, 0, 1, 1)], "frame long, control int, payload int, total int")
    bodies = spark.createDataFrame([(f"b{k}", bytes(range(k, k + 8))) for k in range(30)], "path string, content binary").coalesce(1)
    got = binary.routed_sectors(bodies, routes, 2, most).collect()
    sectors = [(5, "control", 0), (5, "payload", 1), (5, "pad", 2), (9, "payload", 0)]
    assert [(r.path, r.frame, r.kind, r.place, bytes(r.data)) for r in got] == [(f"b{k}", *at, bytes((k + 2 * n, k + 2 * n + 1))) for k in range(30) for n, at in enumerate(sectors)]


def test_tables_of_small_files():
    """A batch of 10,000 files is put together, where each made a table of its own."""
    batch = pd.DataFrame({"path": [f"f{k}" for k in range(10_000)], "content": [b"12345678"] * 10_000})
    assert [len(p) for p, _ in binary._together(iter([batch]), binary.BATCH_BYTES)] == [10_000]
    assert [len(p) for p, _ in binary._together(iter([batch]), 40_000)] == [5_000, 5_000]
