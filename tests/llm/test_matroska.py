import hashlib
import random
import zlib

import pytest

from tessera.llm import matroska as m


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 256, 257, 2047, 2049, 40_000, 300_001])
def test_round_trip(n):
    text = "".join(random.Random(n).choice("ab \né") for _ in range(n))
    raw = text.encode()
    payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
    got = m.digest(text)
    assert got[:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = m.write(payload)
    media = m.parse(stored)
    assert m.read_samples(stored, media) == payload
    assert got[4:6] == (len(stored), hashlib.sha256(stored).hexdigest())
    times = [p.timestamp_ns for p in media.packets]
    assert times == [k * m.FRAME_MS * 1_000_000 for k in range(len(times))]
    assert len(media.cues) == media.clusters
    assert all(stored[at : at + 4] == m.id_bytes(m.CLUSTER) for _, _, at in media.cues)


@pytest.mark.parametrize("kind", [1, 3])
def test_lacing_of_unequal_frames(kind):
    frames = [bytes([k]) * n for k, n in enumerate([3, 700, 255, 0, 254, 9000, 1])]
    block = m.simple_block(frames, -5, kind)
    cluster = m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 7) + block)
    # Segment and cluster of unknown size, and an element to skip.
    stored = m.HEADER + m.id_bytes(m.SEGMENT) + b"\xff" + m.HEAD + m.element(0xEC, b"xx") + m.id_bytes(m.CLUSTER) + b"\xff" + cluster[len(m.id_bytes(m.CLUSTER)) + 2 :]
    media = m.parse(stored)
    assert [stored[p.offset : p.offset + p.size] for p in media.packets] == frames
    assert media.packets[0].timestamp_ns == 2_000_000


def test_block_groups_cuts_and_damage():
    body = b"\x81" + (0).to_bytes(2, "big") + b"\x00" + b"data"
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body) + m.element(0xFB, b"\x01"))
    stored = m.HEADER + m.element(m.SEGMENT, m.HEAD + m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 1) + group))
    packet = m.parse(stored).packets[0]
    assert stored[packet.offset : packet.offset + packet.size] == b"data" and not packet.keyframe
    whole = m.write(b"x" * 5000)
    for cut in range(0, len(whole), 97):
        if cut >= 4:
            assert all(p.offset + p.size <= cut for p in m.parse(whole[:cut]).packets)
    with pytest.raises(ValueError):
        m.parse(b"RIFF")


def test_packet_table(spark):
    d = spark.createDataFrame([(1, bytearray(m.write(b"a" * 600))), (2, None)], "k int, content binary")
    rows = sorted(m.packet_table(d, "k", "content").collect())
    assert [(r.k, r.packet, r.byte_size) for r in rows] == [(1, 0, 256), (1, 1, 256), (1, 2, 88)]
    assert m.packet_table(d.limit(0), "k", "content").collect() == []
