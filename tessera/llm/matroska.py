"""Media columns: Matroska files written and parsed into packet tables.

``write`` stores 8-bit samples as PCM frames in SimpleBlocks, laced by fixed size, EBML or Xiph sizes in turn, in clusters
with cues.  ``parse`` reads any Matroska bytes: variable-length element ids and sizes, unknown sizes, clusters,
simple blocks and block groups, all lacings, and cues, and gives one packet for each frame with its track, timestamp and
byte range.

Defined cases: bytes that don't begin with an EBML header raise ValueError; of a file that is cut off, the packets whose
bytes are all there are given; null content has no packets; a null text is stored as 64 zero bytes; equal texts are
stored as equal bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Element ids, fixed by the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, CODEC_ID, AUDIO = 0x2AD7B1, 0xAE, 0xD7, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}

FRAME = 256
#: Payloads are padded to a positive multiple of this.
UNIT = 64
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 16
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE


def id_bytes(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def vint(n: int, length: int = 0) -> bytes:
    """A size as a variable-length integer; all ones, which mean an unknown size, are left out."""
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(i: int, body: bytes) -> bytes:
    return id_bytes(i) + vint(len(body)) + body


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


HEADER = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
HEAD = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"tessera") + element(0x5741, b"tessera")) + element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(0x73C5, 1) + uint(0x83, 2) + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def lace(frames: list[bytes], kind: int) -> bytes:
    """What stands between a block's header and its frames: 1 Xiph, 2 fixed size, 3 EBML."""
    out = bytearray([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            out += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        out += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d = len(b) - len(a)
            k = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1))
            out += vint(d + (1 << 7 * k - 1) - 1, k)
    return bytes(out)


def simple_block(frames: list[bytes], relative: int, kind: int) -> bytes:
    kind = kind if len(frames) > 1 else 0
    if kind == 2 and len(set(map(len, frames))) > 1:
        kind = 3
    head = b"\x81" + struct.pack(">hB", relative, 0x80 | {0: 0, 1: 2, 2: 4, 3: 6}[kind])
    return element(SIMPLE_BLOCK, head + (lace(frames, kind) if kind else b"") + b"".join(frames))


def write(samples: bytes) -> bytes:
    per_block, per_cluster = FRAME * FRAMES_PER_BLOCK, FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    clusters, cues, at, number = [], [], len(HEAD), 0
    for start in range(0, len(samples), per_cluster):
        time = start // FRAME * FRAME_MS
        body = [uint(TIMESTAMP, time)]
        relative = len(body[0])
        for b in range(start, min(len(samples), start + per_cluster), per_block):
            frames = [samples[i : i + FRAME] for i in range(b, min(len(samples), b + per_block), FRAME)]
            body.append(simple_block(frames, b // FRAME * FRAME_MS - time, (2, 3, 1)[number % 3]))
            number += 1
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at) + uint(CUE_RELATIVE, relative))))
        at += len(clusters[-1])
    body = HEAD + b"".join(clusters) + element(CUES, b"".join(cues))
    return HEADER + id_bytes(SEGMENT) + vint(len(body), 8) + body


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    lacing: int
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]
    clusters: int


def read_id(b: bytes, p: int) -> tuple[int, int]:
    n = 9 - b[p].bit_length()
    return int.from_bytes(b[p : p + n], "big"), p + n


def read_vint(b: bytes, p: int) -> tuple[int | None, int]:
    """A size and what follows it; None if it is unknown."""
    n = 9 - b[p].bit_length()
    if n > 8 or p + n > len(b):
        raise IndexError("damaged size")
    v = int.from_bytes(b[p : p + n], "big") & (1 << 7 * n) - 1
    return (None if v == (1 << 7 * n) - 1 else v), p + n


def children(b: bytes, p: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements of b[p:end]; one of unknown size goes up to the next element of the top level."""
    while p < end:
        try:
            i, q = read_id(b, p)
            size, q = read_vint(b, q)
        except IndexError:
            return
        stop = q + size if size is not None else unknown_end(b, q, end, i)
        yield i, q, min(stop, end)
        p = stop


def unknown_end(b: bytes, p: int, end: int, parent: int) -> int:
    if parent == SEGMENT:
        return end
    while p < end:
        try:
            i, q = read_id(b, p)
            size, q = read_vint(b, q)
        except IndexError:
            return end
        if i in TOP_LEVEL or size is None:
            return p
        p = q + size
    return end


def number(b: bytes, s: int, e: int) -> int:
    return int.from_bytes(b[s:e], "big")


def frames_of(b: bytes, p: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block's body."""
    if not kind:
        return [(p, end - p)]
    n, p = b[p] + 1, p + 1
    sizes: list[int] = []
    if kind == 2:
        sizes = [(end - p) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            s = 0
            while b[p] == 255:
                s, p = s + 255, p + 1
            sizes.append(s + b[p])
            p += 1
    else:
        for k in range(n - 1):
            start = p
            v, p = read_vint(b, p)
            sizes.append(v if not k else sizes[-1] + v - ((1 << 7 * (p - start) - 1) - 1))
    if kind != 2:
        sizes.append(end - p - sum(sizes))
    out = []
    for s in sizes:
        out.append((p, s))
        p += s
    return out


def parse(b: bytes) -> Media:
    """The packets of a Matroska file, in the order of the file."""
    if b[:4] != id_bytes(EBML):
        raise ValueError("no EBML header")
    packets: list[Packet] = []
    tracks: dict[int, dict] = {}
    cues: list[tuple[int, int, int]] = []
    clusters, scale = 0, 1_000_000

    def block(s: int, e: int, time: int, key: bool | None) -> None:
        track, p = read_vint(b, s)
        relative, flags = struct.unpack_from(">hB", b, p)
        kind = (0, 1, 2, 3)[flags >> 1 & 3]
        step = tracks.get(track, {}).get("default_duration", 0)
        for k, (at, size) in enumerate(frames_of(b, p + 3, e, kind)):
            if size >= 0 and at + size <= len(b):
                packets.append(Packet(track, (time + relative) * scale + k * step, at, size, bool(flags & 0x80) if key is None else key, kind, clusters))

    for top, s, e in children(b, 0, len(b)):
        if top != SEGMENT:
            continue
        for i, s1, e1 in children(b, s, e):
            if i == INFO:
                scale = next((number(b, x, y) for k, x, y in children(b, s1, e1) if k == TIMESTAMP_SCALE), scale)
            elif i == TRACKS:
                for k, x, y in children(b, s1, e1):
                    if k == TRACK_ENTRY:
                        entry = {j: (u, v) for j, u, v in children(b, x, y)}
                        audio = {j: (u, v) for j, u, v in children(b, *entry[AUDIO])} if AUDIO in entry else {}
                        get = lambda d, j, default=0: number(b, *d[j]) if j in d else default
                        rate = b[slice(*audio[SAMPLING_FREQUENCY])] if SAMPLING_FREQUENCY in audio else b""
                        tracks[get(entry, TRACK_NUMBER)] = {
                            "codec": b[slice(*entry[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in entry else "",
                            "default_duration": get(entry, DEFAULT_DURATION),
                            "rate": struct.unpack(">d" if len(rate) == 8 else ">f", rate)[0] if len(rate) in (4, 8) else 8000.0,
                            "channels": get(audio, CHANNELS, 1),
                            "bits": get(audio, BIT_DEPTH),
                        }
            elif i == CLUSTER:
                time = 0
                for k, x, y in children(b, s1, e1):
                    try:
                        if k == TIMESTAMP:
                            time = number(b, x, y)
                        elif k == SIMPLE_BLOCK:
                            block(x, y, time, None)
                        elif k == BLOCK_GROUP:
                            inner = list(children(b, x, y))
                            for j, u, v in inner:
                                if j == BLOCK:
                                    block(u, v, time, all(z[0] != 0xFB for z in inner))
                    except (IndexError, struct.error):
                        break
                clusters += 1
            elif i == CUES:
                for k, x, y in children(b, s1, e1):
                    if k == CUE_POINT:
                        point = {j: (u, v) for j, u, v in children(b, x, y)}
                        if CUE_TIME in point and CUE_POSITIONS in point:
                            where = {j: number(b, u, v) for j, u, v in children(b, *point[CUE_POSITIONS])}
                            cues.append((number(b, *point[CUE_TIME]), where.get(CUE_TRACK, 0), s + where.get(CUE_CLUSTER, 0)))
    return Media(packets, tracks, cues, clusters)


PACKETS = "track long, timestamp_ns long, byte_start long, byte_size long, keyframe boolean, lacing int, cluster int"


def packet_table(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each packet of each file: the key, the packet's number and PACKETS."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, p in enumerate(parse(b).packets if b else ()):
                    rows.append((k, n, *p))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "packet", *(x.split()[0] for x in PACKETS.split(", "))])

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, packet int, {PACKETS}")


def read_samples(b: bytes, media: Media) -> bytes:
    return b"".join([b[p.offset : p.offset + p.size] for p in media.packets])


def digest(text: str | None) -> tuple:
    """Store a text, read it back, and describe what was read."""
    raw = (text or "").encode("utf-8")
    stored = write(raw + b"\0" * ((-len(raw)) % UNIT if raw else UNIT))
    media = parse(stored)
    back = read_samples(stored, media)
    x = np.frombuffer(back, np.uint8).astype(np.float64) - 128.0
    track = media.tracks[1]
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    feature = (
        f"{track['codec']};{track['rate']:.0f};{track['channels']};{track['bits']};clusters={media.clusters};packets={len(media.packets)};cues={len(media.cues)};"
        f"ms={media.packets[-1].timestamp_ns // 1_000_000 + FRAME_MS};mean={x.mean():.4f};rms={math.sqrt((x * x).mean()):.4f};crossings={crossings}"
    )
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*[digest(t.as_py()) for t in batch.column(1)], strict=True)) or [[]] * 7
            types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(x.split()[0] for x in DIGEST.split(", "))])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, f"doc_id long, {DIGEST}")
