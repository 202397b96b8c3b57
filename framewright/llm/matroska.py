"""Media columns in Matroska: a writer of 8-bit PCM tracks, and a parser of EBML files into packet tables.

The parser reads variable-length element ids and sizes (unknown sizes of Segment and Cluster too), track entries, clusters,
SimpleBlocks and BlockGroups with no, Xiph, fixed-size or EBML lacing, and cues. A packet is (track, timestamp in
timescale units, byte range in the file, keyframe, cluster).

The writer stores a payload losslessly: one A_PCM/INT/LIT track of 8-bit samples; frames of ``frame`` bytes (the last may be
shorter), up to ``laced`` of them in a block, ``blocks`` blocks in a cluster, a cue for each cluster. Blocks of equal frames
use fixed-size lacing, others EBML or Xiph lacing by turns. Nothing in a file depends on anything but the payload.

Defined results: a null text is an empty one; a payload is padded by bytes 0 to a positive multiple of 64; equal texts give
equal rows; other columns are ignored; a damaged file raises ``ValueError`` from the parser, and is one row with an ``error``
in a packet table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element ids of the format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold elements.
MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS})

UNIT, RATE, FRAME, LACED, BLOCKS = 64, 8_000, 512, 8, 16
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the least width, or of ``width`` bytes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, marked: bool = False) -> tuple[int, int]:
    """(value, position after it); an id keeps its marker bit. A size of all ones is -1: unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if marked:
        return value, at + width
    value ^= 1 << 7 * width
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def element(number: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def lace(frames: list[bytes], kind: int) -> bytes:
    """The bytes after a block's flags: number of frames, their sizes, the frames."""
    if kind == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACE:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """The byte ranges (start, stop) of a block's frames."""
    if kind == NO_LACE:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError(f"{end - at} bytes do not make {count} equal frames")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if kind == XIPH:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            elif k == 0:
                n, at = read_vint(data, at)
            else:
                width = 9 - data[at].bit_length()
                n, at = read_vint(data, at)
                n = sizes[-1] + (n if n >= 0 else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError("frame sizes do not fit the block")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


@dataclass
class Media:
    """What a file holds. Packets: (track, timestamp, start, stop, keyframe, cluster); cues: (time, track, cluster position)."""

    timescale: int = 1_000_000
    duration: float | None = None
    tracks: list[dict] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    doc_type: str = ""


#: Elements of the top level, at which a cluster of unknown size ends.
_TOP = frozenset({CLUSTER, CUES, TRACKS, INFO})
_TRACK_FIELDS = {TRACK_NUMBER: "number", TRACK_TYPE: "type", CODEC_ID: "codec", SAMPLING_FREQUENCY: "rate", CHANNELS: "channels", BIT_DEPTH: "bits"}


def parse(data: bytes) -> Media:
    """Read a whole file into tables; ``ValueError`` if it is damaged."""
    try:
        return _parse(data)
    except (IndexError, struct.error, OverflowError) as e:
        raise ValueError(f"damaged: {e}") from e


def _parse(data: bytes) -> Media:
    media, base = Media(), 0
    cue: list[int] = [0, 0, 0]
    now, keyframe, held = 0, True, 0

    def block(at: int, end: int, simple: bool) -> list[tuple[int, int, int, int, bool, int]]:
        track, at = read_vint(data, at)
        offset, flags = struct.unpack_from(">hB", data, at)
        key = bool(flags & 0x80) if simple else True
        return [(track, now + offset, s, e, key, len(media.clusters) - 1) for s, e in unlace(data, at + 3, end, flags >> 1 & 3)]

    stack: list[tuple[int, int]] = [(0, len(data))]
    at = 0
    while stack:
        if at >= stack[-1][1]:
            number, at = stack.pop()[0], max(at, 0)
            if number == CUE_TRACK_POSITIONS:
                media.cues.append((cue[0], cue[1], cue[2]))
            elif number == BLOCK_GROUP and not keyframe and held:
                media.packets[-held:] = [(*p[:4], False, p[5]) for p in media.packets[-held:]]
            continue
        start = at
        number, at = read_vint(data, at, marked=True)
        n, at = read_vint(data, at)
        if n == -1 and number not in (SEGMENT, CLUSTER):
            raise ValueError(f"element {number:x} of unknown size")
        if stack[-1][0] == CLUSTER and number in _TOP and len(stack) > 1:
            stack.pop()
        end = stack[-1][1] if n == -1 else at + n
        if end > stack[-1][1]:
            raise ValueError(f"element {number:x} at {start} is cut off")
        if number in MASTERS:
            stack.append((number, end))
            if number == SEGMENT:
                base = at
            elif number == TRACK_ENTRY:
                media.tracks.append({})
            elif number == CLUSTER:
                media.clusters.append((start - base, 0))
            elif number == BLOCK_GROUP:
                keyframe, held = True, 0
            continue
        if number == SIMPLE_BLOCK:
            media.packets += block(at, end, True)
        elif number == BLOCK:
            found = block(at, end, False)
            held = len(found)
            media.packets += found
        elif number == REFERENCE_BLOCK:
            keyframe = False
        elif number in (DOC_TYPE, CODEC_ID):
            value = data[at:end].rstrip(b"\0").decode()
            if number == DOC_TYPE:
                media.doc_type = value
            else:
                media.tracks[-1]["codec"] = value
        elif number in (DURATION, SAMPLING_FREQUENCY):
            value = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0]
            if number == DURATION:
                media.duration = value
            else:
                media.tracks[-1]["rate"] = value
        else:
            value = int.from_bytes(data[at:end], "big")
            if number == TIMESTAMP_SCALE:
                media.timescale = value
            elif number == TIMESTAMP:
                now = value
                media.clusters[-1] = (media.clusters[-1][0], value)
            elif number == CUE_TIME:
                cue[0] = value
            elif number == CUE_TRACK:
                cue[1] = value
            elif number == CUE_CLUSTER_POSITION:
                cue[2] = value
            elif number in _TRACK_FIELDS:
                media.tracks[-1][_TRACK_FIELDS[number]] = value
        at = end
    return media


def padded(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def build(payload: bytes, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS, rate: int = RATE) -> bytes:
    """A Matroska file of one track of 8-bit samples. Timestamps count samples: the timescale is a sample's nanoseconds."""
    scale = 1_000_000_000 // rate
    head = element(EBML, element(EBML_VERSION, 1) + element(EBML_READ_VERSION, 1) + element(EBML_MAX_ID, 4) + element(EBML_MAX_SIZE, 8) + element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
    info = element(INFO, element(TIMESTAMP_SCALE, scale) + element(DURATION, float(len(payload))) + element(MUXING_APP, "framewright") + element(WRITING_APP, "framewright"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, float(rate)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(CODEC_ID, "A_PCM/INT/LIT") + audio))
    body, cues, at, of_block = [info, tracks], [], len(info) + len(tracks), frame * laced
    span = min(of_block * blocks, 32_767 // of_block * of_block or of_block)
    for k, first in enumerate(range(0, len(payload), span)):
        inner = [element(TIMESTAMP, first)]
        for j, start in enumerate(range(first, min(first + span, len(payload)), of_block)):
            part = payload[start : start + of_block]
            frames = [part[x : x + frame] for x in range(0, len(part), frame)]
            kind = NO_LACE if len(frames) == 1 else FIXED if len(frames[-1]) == frame else (EBML_LACE, XIPH)[(k + j) % 2]
            inner.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", start - first, 0x80 | kind << 1) + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(inner))
        cues.append(element(CUE_POINT, element(CUE_TIME, first) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's bytes, packet after packet in the order of time."""
    return b"".join(data[s:e] for t, _, s, e, _, _ in sorted(media.packets, key=lambda p: (p[1], p[2])) if t == track)


def feature(payload: bytes, media: Media) -> str:
    """Whole numbers of the track: packets, clusters, cues, samples, sum, energy, level changes and distinct levels."""
    v = np.frombuffer(payload, dtype=np.uint8)
    total, energy = int(v.sum(dtype=np.int64)), int(np.square(v, dtype=np.int64).sum()) if len(v) < 1 << 20 else sum(int(np.square(v[k : k + (1 << 20)], dtype=np.int64).sum()) for k in range(0, len(v), 1 << 20))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};samples={len(v)};sum={total};energy={energy};changes={int(np.count_nonzero(v[1:] != v[:-1]))};levels={int(np.count_nonzero(np.bincount(v, minlength=256)))}"


_STORED = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]


def media_columns(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): each text is
    stored as a file, which is parsed; the payload's figures are those of the bytes read back."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                data = build(padded(text))
                media = parse(data)
                back = samples(data, media)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(back, media)))
            columns = zip(*rows, strict=True) if rows else [()] * len(_STORED)
            kinds = [pa.int64() if isinstance(t, T.LongType) else pa.string() for _, t in _STORED]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *(n for n, _ in _STORED)])

    return texts.mapInArrow(run, T.StructType([texts.schema["doc_id"], *(T.StructField(n, t) for n, t in _STORED)]))


_PACKETS = "doc_id {}, track int, timestamp long, start long, stop long, keyframe boolean, cluster int, cluster_position long, error string"


def packet_table(files: DataFrame, id_col: str = "doc_id", data_col: str = "media") -> DataFrame:
    """Rows (doc_id, track, timestamp, start, stop, keyframe, cluster, cluster_position, error) of files held in a binary column:
    one for each packet, and for each damaged file one with an error and nothing else."""
    names = ["doc_id", "track", "timestamp", "start", "stop", "keyframe", "cluster", "cluster_position", "error"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
    files = files.select(F.col(id_col).alias("doc_id"), F.col(data_col).alias("media")).where("media is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column("doc_id"), batch.column("media"), strict=True):
                try:
                    media = parse(data.as_py())
                    packets = [(*p, media.clusters[p[5]][0] if p[5] >= 0 else None, None) for p in media.packets]
                except ValueError as e:
                    packets = [(None,) * 7 + (str(e),)]
                if packets:
                    *columns, errors = zip(*packets, strict=True)
                    ids = pa.array([row.as_py()] * len(packets), batch.schema.field("doc_id").type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(errors, pa.string())], names=names)

    return files.mapInArrow(run, _PACKETS.format(files.schema["doc_id"].dataType.simpleString()))


def media_files(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, media): each text as a Matroska file."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([build(padded(t.as_py())) for t in batch.column("text")], pa.binary())], names=["doc_id", "media"])

    return texts.mapInArrow(run, T.StructType([texts.schema["doc_id"], T.StructField("media", T.BinaryType())]))
