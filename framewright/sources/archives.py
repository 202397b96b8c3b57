"""Array archives, frame-digest logs, disc directories and nested decision logs."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrays(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, frame, values) of numpy archives: the named one-dimensional arrays, row by row; they must be equally long. Objects
    are never unpickled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    found = {n: np.asarray(z[n]) for n in names}
                if len({v.shape for v in found.values()}) != 1:
                    raise ValueError(f"{path}: the arrays differ in shape")
                yield pd.DataFrame({"path": path, "frame": np.arange(len(next(iter(found.values())))), **{n: v.astype(float) for n, v in found.items()}})

    return files.mapInPandas(run, "path string, frame long, " + ", ".join(f"{n} double" for n in names))


def frame_digests(log: DataFrame) -> DataFrame:
    """(stream, dts, pts, duration, size, digest) of a frame-digest log; lines that start with # are comments."""
    parts = F.split("value", r"\s*,\s*")
    kinds = ("stream int", "dts long", "pts long", "duration long", "size long", "digest string")
    columns = [F.trim(F.get(parts, F.lit(k))).cast(x.split()[1]).alias(x.split()[0]) for k, x in enumerate(kinds)]
    return log.where("value not like '#%' and value <> ''").select(*columns)


def root_directory(image: bytes) -> list[tuple[str, int, int]]:
    """(name, start, bytes) of the root directory of a disc image (2,048-byte sectors, volume descriptor at sector 16)."""
    at = 16 * 2_048
    if image[at + 1 : at + 6] != b"CD001":
        raise ValueError("no volume descriptor")
    start, size = struct.unpack_from("<I", image, at + 158)[0] * 2_048, struct.unpack_from("<I", image, at + 166)[0]
    out, k = [], start
    while k < start + size:
        length = image[k]
        if not length:
            k = (k // 2_048 + 1) * 2_048
            continue
        where, n, name_length = struct.unpack_from("<I", image, k + 2)[0], struct.unpack_from("<I", image, k + 10)[0], image[k + 32]
        name = image[k + 33 : k + 33 + name_length]
        if name not in (b"\0", b"\1"):
            out.append((name.decode("ascii").split(";")[0], where * 2_048, n))
        k += length
    return out


#: The nested decision log, as Parquet.
DECISIONS = "frames array<struct<frame:int,updates:array<struct<cell:int,palette:int,key:binary>>>>, frame_seg array<int>"


def updates(log: DataFrame) -> DataFrame:
    """(frame, ord, cell, palette, key) of a nested decision log; keys of 64 bytes from 1 to 15, frames in order."""
    frames = log.select(F.inline("frames"))
    rows = frames.select("frame", F.posexplode("updates").alias("ord", "u")).select("frame", "ord", "u.cell", "u.palette", "u.key")
    bad = rows.where("not coalesce(hex(key) rlike '^(0[1-9A-F]){64}$', false)")
    if not bad.isEmpty():
        raise ValueError("a key is not 64 indices from 1 to 15")
    return rows
