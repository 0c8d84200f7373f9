"""Documents in chunks of bounded size, and arrays that go from chunks to buckets and back as compressed rows.

A chunk holds whole documents by a hash of doc_id, a bucket a range of hash values.  Chunks send each bucket they have
something for a piece of bytes with sorted arrays in place of a row for each value; buckets answer each chunk likewise.
Both numbers grow with the input, so that neither side grows beyond what a task holds.  Pieces travel in frames by way
of a butterfly: a frame goes to one of at most RADIX nodes, which fixes a digit of the number of the receiver, and is
dealt out anew there.  So each of n chunks writes at most RADIX rows a hop, log n hops in all, and a node takes in what
RADIX others send it, about as much as a chunk.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
#: To how many nodes at most a task deals out.
RADIX = 128
FRAME = "node long, blob binary"
#: Long documents and chunks are worked on in pieces of this many bytes.
PIECE = 1 << 20


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers, by the bytes of their differences."""
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return pack(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(blob: bytes) -> np.ndarray:
    (planes,) = unpack(blob)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """chunk, doc_id (null: the largest number), body (UTF-8; null: empty) and the number of chunks."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    n = max(1, -(-max(size["n"] or 0, 64 * size["rows"]) // CHUNK_BYTES))
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("long")
    return docs.select(chunk.alias("chunk"), key.alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), body.alias("body")), n


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value starts (one more than values)."""
    parts = [c for c in column.chunks if len(c)]
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    datas, sizes = [], []
    for c in parts:
        c = c.cast(pa.large_binary())
        offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data = c.buffers()[2]
        datas.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8))
        sizes.append(np.diff(offsets))
    return np.concatenate(datas), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def split_at(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each of n buckets starts in ascending keys of so many bits (one more than buckets)."""
    edges = [(b << bits) // n for b in range(n)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


class Route:
    """How pieces get from n senders to n receivers."""

    def __init__(self, n: int, radix: int | None = None) -> None:
        radix = radix or RADIX
        self.hops = 1
        while radix**self.hops < n:
            self.hops += 1
        self.digit = 1
        while self.digit**self.hops < n:
            self.digit += 1

    def frames(self, pieces: list[tuple[int, int, bytes]], hop: int = 1) -> pa.Table:
        """FRAME for pieces of (receiver, sender, bytes): where each is after so many hops."""
        low = self.digit ** (self.hops - hop)
        nodes: dict[int, list[tuple[int, int, bytes]]] = {}
        for p in pieces:
            nodes.setdefault(p[0] // low * low + p[1] % low, []).append(p)
        return pa.table({"node": pa.array(list(nodes), pa.int64()), "blob": pa.array([pickle.dumps(v, protocol=5) for v in nodes.values()], pa.binary())})

    def forward(self, sent: DataFrame) -> DataFrame:
        """FRAME with a receiver's number as node, from what senders made by ``frames``."""

        def deal(hop: int):
            return lambda group: self.frames(pieces_of(group), hop)

        for hop in range(2, self.hops + 1):
            sent = sent.groupBy("node").applyInArrow(deal(hop), FRAME)
        return sent


def pieces_of(group: pa.Table) -> list[tuple[int, int, bytes]]:
    """The pieces of a node's frames, by receiver and sender."""
    return sorted(p for blob in group.column("blob").to_pylist() for p in pickle.loads(blob))
