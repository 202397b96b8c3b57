"""Fixed-width binary records, routed sectors, sound files; as functions over ``binaryFile`` and as a data source."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The sector size, and the big-endian chunk table's fields (offset, bytes, bits).
SECTOR = 2_048
CHUNK = np.dtype([("offset", ">u4"), ("bytes", ">u2"), ("bits", ">u2")])
_SPARK = {"u": {1: "smallint", 2: "int", 4: "bigint", 8: "decimal(20,0)"}, "i": {1: "tinyint", 2: "smallint", 4: "int", 8: "bigint"}, "f": {4: "float", 8: "double"}}


def schema_of(record: np.dtype) -> str:
    return ", ".join(f"{n} {_SPARK[record[n].kind][record[n].itemsize]}" for n in record.names)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Files are put together until they have so many bytes; what they hold goes on as one batch.
BATCH_BYTES = 1 << 22


def _together(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """Paths and contents of a batch's files, some at a time: up to ``most`` bytes, or one file."""
    for pdf in batches:
        paths, contents = pdf["path"].tolist(), pdf["content"].tolist()
        first = held = 0
        for k, content in enumerate(contents):
            if k > first and held + len(content) > most:
                yield paths[first:k], contents[first:k]
                first, held = k, 0
            held += len(content)
        if contents:
            yield paths[first:], contents[first:]


def records(df: DataFrame, record: np.dtype, skip: int = 0, most: int = BATCH_BYTES) -> DataFrame:
    """(path, place, fields): the records of each file behind ``skip`` bytes; a file that ends inside one is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for paths, contents in _together(batches, most):
            bodies = [content[skip:] for content in contents]
            for path, body in zip(paths, bodies, strict=True):
                if len(body) % record.itemsize:
                    raise ValueError(f"{path}: {len(body)} bytes do not make records of {record.itemsize}")
            found = np.frombuffer(b"".join(bodies), dtype=record)
            n = np.array([len(body) // record.itemsize for body in bodies])
            columns = {name: found[name].astype(found[name].dtype.newbyteorder("=")) for name in record.names}
            yield pd.DataFrame({"path": np.repeat(np.array(paths, dtype=object), n), "place": np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n), **columns})

    return df.mapInPandas(run, f"path string, place long, {schema_of(record)}")


def header(df: DataFrame, fields: dict[str, tuple[int, str]], magic: bytes = b"") -> DataFrame:
    """(path, fields): named values at fixed offsets, {name: (offset, numpy type)}; another magic at the start is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                if not content.startswith(magic):
                    raise ValueError(f"{path}: not of this format")
                rows.append((path, *(int(np.frombuffer(content, dtype=kind, count=1, offset=at)[0]) for at, kind in fields.values())))
            yield pd.DataFrame(rows, columns=["path", *fields])

    return df.mapInPandas(run, "path string, " + ", ".join(f"{n} long" for n in fields))


def routed_sectors(df: DataFrame, routes: DataFrame, sector: int = SECTOR, most: int = BATCH_BYTES) -> DataFrame:
    """(path, frame, kind, place, data): a body's sectors, frame by frame: control, then payload, then pad, as the routes
    (frame, control, payload, total) say. A body of another length is an error."""
    table = [(r["frame"], r["control"], r["payload"], r["total"]) for r in routes.orderBy("frame").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = [["control"] * control + ["payload"] * payload + ["pad"] * (total - control - payload) for _, control, payload, total in table]
        n = sum(map(len, kinds))
        frame = np.repeat(np.array([f for f, *_ in table], dtype=np.int64), [len(x) for x in kinds])
        place = np.array([k for x in kinds for k in range(len(x))], dtype=np.int32)
        kind = np.array([k for x in kinds for k in x], dtype=object)
        starts = range(0, n * sector, sector)
        for paths, contents in _together(batches, most):
            for path, content in zip(paths, contents, strict=True):
                if len(content) != sector * sum(t for *_, t in table):
                    raise ValueError(f"{path}: the routes do not cover the body")
            data = [content[at : at + sector] for content in contents for at in starts]
            yield pd.DataFrame({"path": np.repeat(np.array(paths, dtype=object), n), "frame": np.tile(frame, len(paths)), "kind": np.tile(kind, len(paths)), "place": np.tile(place, len(paths)), "data": data})

    return df.mapInPandas(run, "path string, frame long, kind string, place int, data binary")


def write_sectors(blocks: DataFrame, sector: int = SECTOR) -> DataFrame:
    """(frame, data): each frame's blocks (frame, kind, place, data) in order, each kind filled up to whole sectors."""
    joined = blocks.groupBy("frame", "kind").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("b"))
    body = F.aggregate("b", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    padded = joined.select("frame", "kind", body.alias("d")).withColumn("n", F.octet_length("d"))
    fill = F.unhex(F.repeat(F.lit("00"), F.pmod(-F.col("n"), F.lit(sector)).cast("int")))
    whole = padded.select("frame", "kind", F.concat("d", fill).alias("d"))
    control = F.max(F.when(F.col("kind") == "control", F.col("d")))
    payload = F.max(F.when(F.col("kind") == "payload", F.col("d")))
    nothing = F.lit(b"").cast("binary")
    return whole.groupBy("frame").agg(F.concat(F.coalesce(control, nothing), F.coalesce(payload, nothing)).alias("data"))


def sound(df: DataFrame, chunk: int = 65_536) -> DataFrame:
    """(path, rate, part, pcm): 16-bit mono samples of wave files, in chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                with wave.open(io.BytesIO(content)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError(f"{path}: 16-bit samples are needed")
                    pcm = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())
                    mono = np.rint(pcm.mean(axis=1)).astype(np.int16)
                    rate = w.getframerate()
                parts = [mono[k : k + chunk] for k in range(0, len(mono), chunk)]
                yield pd.DataFrame({"path": path, "rate": rate, "part": range(len(parts)), "pcm": parts})

    return df.mapInPandas(run, "path string, rate int, part int, pcm array<smallint>")


class RecordSource(DataSource):
    """``spark.read.format("framewright_records").option("path", ...).option("record", "a:>u4,b:>u2").load()``: one file of
    fixed-width records, read in ranges by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "framewright_records"

    def _record(self) -> np.dtype:
        return np.dtype([tuple(x.strip().split(":")) for x in self.options["record"].split(",")])

    def schema(self) -> str:
        return f"place bigint, {schema_of(self._record())}"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options["path"], self._record(), int(self.options.get("rows", 1_000_000)))


class _RecordReader(DataSourceReader):
    def __init__(self, path: str, record: np.dtype, rows: int):
        self.path, self.record, self.rows = path, record, rows

    def partitions(self) -> list[InputPartition]:
        import os

        n = os.path.getsize(self.path) // self.record.itemsize
        return [InputPartition((k, min(k + self.rows, n))) for k in range(0, n, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, stop = partition.value
        found = np.fromfile(self.path, dtype=self.record, count=stop - first, offset=first * self.record.itemsize)
        for k, row in enumerate(found.tolist()):
            yield (first + k, *row)
