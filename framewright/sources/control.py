"""Control blocks: one for each frame, with its updates (as a bitmap or a list), sound and transfer runs; big-endian.

Layout: length (2), frame (2), kind and update count (2: kind in the top 3 bits), then a bitmap of the cells and an entry (2) for
each, or for list frames (cell, entry) pairs; for fades the colours instead; for scroll frames a position (4) before the pairs;
then the sound, a pad byte if the length so far is odd, the number of runs (2) and (slot and count, source and index) of each (4).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

NORMAL, LIST, FADE_IN, FADE_OUT, SCROLL = range(5)
COLOUR_BYTES = 128


@dataclass
class Block:
    frame: int
    kind: int = NORMAL
    updates: list[tuple[int, int]] = field(default_factory=list)
    colours: bytes = b""
    scroll: tuple[int, int] = (0, 0)
    sound: bytes = b""
    runs: list[tuple[int, int, int]] = field(default_factory=list)


def encode(block: Block, cells: int) -> bytes:
    """Runs are (slot, count, source and index)."""
    fade, listed = block.kind in (FADE_IN, FADE_OUT), block.kind in (LIST, SCROLL)
    if fade and (block.updates or len(block.colours) != COLOUR_BYTES):
        raise ValueError("a fade has colours and no updates")
    ordered = block.updates if listed else sorted(block.updates)
    if any(not 0 <= c < cells for c, _ in ordered) or len({c for c, _ in ordered}) != len(ordered):
        raise ValueError("cells must differ and lie in the grid")
    body = struct.pack(">HH", block.frame, block.kind << 13 | len(ordered))
    if fade:
        body += block.colours
    elif listed:
        body += (struct.pack(">hh", *block.scroll) if block.kind == SCROLL else b"") + b"".join(struct.pack(">HH", c, e) for c, e in ordered)
    else:
        bits = sum(1 << (cells + (-cells) % 16 - 1 - c) for c, _ in ordered)
        body += bits.to_bytes((cells + 15) // 16 * 2, "big") + b"".join(struct.pack(">H", e) for _, e in ordered)
    body += block.sound
    body += b"\0" * (len(body) % 2)
    body += struct.pack(">H", len(block.runs)) + b"".join(struct.pack(">HBB", s, n, x) for s, n, x in block.runs)
    return struct.pack(">H", len(body) + 2) + body


def decode(data: bytes, cells: int, sound_bytes: int) -> Block:
    length, frame, head = struct.unpack_from(">HHH", data)
    if length != len(data):
        raise ValueError(f"a block of {length} bytes has {len(data)}")
    kind, n, at = head >> 13, head & 0x1FFF, 6
    block = Block(frame, kind)
    if kind in (FADE_IN, FADE_OUT):
        block.colours, at = data[at : at + COLOUR_BYTES], at + COLOUR_BYTES
    elif kind in (LIST, SCROLL):
        if kind == SCROLL:
            block.scroll, at = struct.unpack_from(">hh", data, at), at + 4
        block.updates = list(struct.iter_unpack(">HH", data[at : at + 4 * n]))
        at += 4 * n
    elif kind == NORMAL:
        width = (cells + 15) // 16 * 2
        bits = int.from_bytes(data[at : at + width], "big")
        found = [c for c in range(cells) if bits >> (8 * width - 1 - c) & 1]
        if len(found) != n:
            raise ValueError("the bitmap and the count differ")
        at += width
        block.updates = list(zip(found, struct.unpack_from(f">{n}H", data, at), strict=True))
        at += 2 * n
    else:
        raise ValueError(f"kind {kind}")
    block.sound = data[at : at + sound_bytes]
    at += sound_bytes
    at += at % 2
    (runs,) = struct.unpack_from(">H", data, at)
    block.runs = list(struct.iter_unpack(">HBB", data[at + 2 : at + 2 + 4 * runs]))
    if at + 2 + 4 * runs != len(data):
        raise ValueError("bytes are left over")
    return block


_ROWS = "frame long, kind int, updates array<struct<cell:int,entry:int>>, runs array<struct<slot:int,count:int,source:int>>, bytes int"


def parsed(blocks: DataFrame, cells: int, sound_bytes: int) -> DataFrame:
    """(frame, kind, updates, runs, bytes) of rows with a block in ``data``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf["data"]:
                b = decode(bytes(data), cells, sound_bytes)
                rows.append((b.frame, b.kind, [{"cell": c, "entry": e} for c, e in b.updates], [{"slot": s, "count": n, "source": x} for s, n, x in b.runs], len(data)))
            yield pd.DataFrame(rows, columns=["frame", "kind", "updates", "runs", "bytes"])

    return blocks.select("data").mapInPandas(run, _ROWS)


def serialized(rows: DataFrame, cells: int) -> DataFrame:
    """(frame, data) of rows as ``parsed`` gives them, with ``sound`` (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                block = Block(r.frame, r.kind, [(u["cell"], u["entry"]) for u in r.updates], sound=bytes(r.sound or b""), runs=[(x["slot"], x["count"], x["source"]) for x in r.runs])
                out.append((r.frame, encode(block, cells)))
            yield pd.DataFrame(out, columns=["frame", "data"])

    return rows.select("frame", "kind", "updates", "runs", "sound").mapInPandas(run, "frame long, data binary")
