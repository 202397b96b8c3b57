from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest

from framewright.llm import matroska as m


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 4_096, 28_672, 28_673, 100_001])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    stored = m.build(m.padded(payload))
    media = m.parse(stored)
    assert m.samples(stored, media) == m.padded(payload) and len(m.padded(payload)) % 64 == 0
    assert media.tracks == [{"number": 1, "type": 2, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "bits": 8}]
    assert media.doc_type == "matroska" and media.duration == len(m.padded(payload))
    assert len(media.cues) == len(media.clusters) and [c[0] for c in media.cues] == [t for _, t in media.clusters]
    segment = stored.index(b"\x18\x53\x80\x67")
    base = m.read_vint(stored, segment + 4)[1]
    for _, _, place in media.cues:
        assert stored[base + place : base + place + 4] == b"\x1f\x43\xb6\x75"


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACE, m.FIXED])
def test_lacing(kind):
    rng = random.Random(5)
    for sizes in ([1, 1], [300, 254, 255, 256, 510, 7], [5] * 9, [70_000, 3, 70_000, 1], [64, 127, 0, 9]):
        frames = [rng.randbytes(n if kind != m.FIXED else 12) for n in sizes]
        body = m.lace(frames, kind)
        assert [body[s:e] for s, e in m.unlace(body, 0, len(body), kind)] == frames


def test_sizes_of_all_widths():
    for n in (0, 1, 126, 127, 128, 16_382, 16_383, 2**21, 2**28 + 5, 2**40, 2**56 - 2):
        assert m.read_vint(m.vint(n), 0) == (n, len(m.vint(n)))
    assert m.read_vint(b"\xff", 0)[0] == m.read_vint(b"\x01" + b"\xff" * 7, 0)[0] == -1


def test_unknown_sizes_block_groups_and_two_tracks():
    block = lambda track, t, data: m.vint(track) + struct.pack(">hB", t, 0) + data
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(2, 5, b"abc")) + m.element(m.REFERENCE_BLOCK, b"\xff"))
    cluster = b"\x1f\x43\xb6\x75\xff" + m.element(m.TIMESTAMP, 1_000) + m.element(0xEC, b"void") + m.element(m.SIMPLE_BLOCK, block(1, -3, b"x")) + group
    data = m.element(m.EBML, m.element(m.DOC_TYPE, "webm")) + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + cluster + cluster
    media = m.parse(data)
    assert [(p[0], p[1], data[p[2] : p[3]], p[4], p[5]) for p in media.packets] == [(1, 997, b"x", False, 0), (2, 1_005, b"abc", False, 0), (1, 997, b"x", False, 1), (2, 1_005, b"abc", False, 1)]


def test_damaged_files_are_told():
    stored = m.build(b"a" * 5_000)
    for data in (stored[:-1], stored[:60], b"\x00" * 9):
        with pytest.raises(ValueError):
            m.parse(data)


def test_mutated_files_parse_or_are_told(spark):
    rng = random.Random(1)
    stored = m.build(rng.randbytes(9_000), frame=300, laced=3, blocks=2)
    files = []
    for _ in range(3_000):
        data = bytearray(stored)
        for _ in range(rng.randint(1, 3)):
            data[rng.randrange(len(data) if rng.random() < 0.5 else 200)] = rng.randrange(256)
        files.append(bytes(data[: rng.randint(1, len(data))] if rng.random() < 0.3 else data))
    damaged = set()
    for k, data in enumerate(files):
        try:
            m.parse(data)
        except ValueError:
            damaged.add(k)
    assert 100 < len(damaged) < 3_000
    rows = m.packet_table(spark.createDataFrame(list(enumerate(files)), "doc_id int, media binary")).where("error is not null").collect()
    assert {r.doc_id for r in rows} == damaged and len(rows) == len(damaged) and all(r.start is None for r in rows)


def test_columns_and_packets(spark, edge, empty):
    texts = {r.doc_id: (r.text or "").encode() for r in edge.collect()}
    for r in m.media_columns(edge).collect():
        payload = m.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes
    rows = m.media_columns(edge.where("doc_id in (4, 5)")).drop("doc_id").collect()
    assert rows[0] == rows[1]
    assert m.media_columns(empty).collect() == []
    files = m.media_files(edge)
    stored = {r.doc_id: bytes(r.media) for r in files.where("doc_id <> 7").collect()}
    read: dict[int, bytes] = {}
    for r in m.packet_table(files.where("doc_id <> 7")).orderBy("doc_id", "timestamp", "start").collect():
        read[r.doc_id] = read.get(r.doc_id, b"") + stored[r.doc_id][r.start : r.stop]
    assert read == {k: m.padded(texts[k]) for k in stored}
