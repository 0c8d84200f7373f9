"""N-gram Jaccard join: universe-partition pigeonhole with exact verification.

A document's set holds its distinct N-word shingles.  Sets link at a Jaccard similarity of THRESHOLD % or more.

1. Chunks send the hashes of their shingles to buckets, which answer in how many sets each stands (its class by powers of
   two).  A set links only if THRESHOLD % of its shingles stand in others; the rest take no further part.  Equal sets
   collapse.
2. Shingles are hashed to n1 segments by the size band of the larger set of a pair.  Every set indexes each segment by
   itself and by its one-deletion neighbourhood, for its own band and the next.  A set of s shingles differs from a linked
   one that isn't larger in at most k = 2 s (100 - THRESHOLD) / (100 + THRESHOLD) of them.  It looks a segment up at a
   difference of none (counting one) or of at most one shingle (counting two); once the counts reach k + 1, by the
   pigeonhole principle a lookup finds every linked set.  The allocation takes the k + 1 cheapest counts, by the number of
   sets that a segment's rarest shingles stand in, so empty and common segments are passed over and no link is lost.
3. Buckets group sets by key.  The least set of a group is paired with the others.  Pairs that sizes or sketches (parities
   of two bits a shingle) don't rule out are verified exactly.  Components of the links are found, and sets meet those of
   other components in their groups that are nearest by sketch; then every pair of a group that still lies in two components is held
   against sketches where its group is, and verified if they allow it.  So no link between two components is lost, and no group is expanded into all its pairs unless its sets turn
   out not to belong together.

Shingles are told apart by 48 bits, sets by 128.

Defined cases: a text with fewer than N words is one shingle, its words; a null text or one without words is empty and
links with nothing; rows with equal text belong together; a missing doc_id is no candidate for component_id (null if a
component has no other); an empty table gives an empty result; ``joined`` ignores other columns, ``representatives`` passes
all of them through, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table
from .exchange import FRAME, PIECE, Route, bytes_of, chunks_of, mix, pack, pack_sorted, pieces_of, split_at, unpack, unpack_sorted
from .graph import components

N = 5
THRESHOLD = 75
BITS = 48
#: Nearest members of a group's other components that a set meets first.
FEW = 4
#: Shingles whose keys are made at once, and keys that a bucket holds.
SLICE, BUCKET_KEYS = 400_000, 4_000_000
#: Members of a group that are compared with each other at once, and of groups that a task takes together.
BLOCK, TOGETHER = 4096, 100_000
#: Keys of a bucket that are grouped at once.
TOGETHER_KEYS = 400_000
#: Segments are tried at mean sizes from the first of these to the second.
SEGMENT = (7, 2)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: A random number for each byte of a word.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
STEP = np.uint64(0x5851F42D4C957F2D)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some documents, letters A-Z as a-z, and the document of each."""
    solid = ~BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = starts[:-1][np.diff(starts) > 0]
    first[edge] = solid[edge]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.flatnonzero(first)
    word = np.cumsum(first[at]) - 1
    place = at - begin[word]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, STEP, np.uint64), dtype=np.uint64)
        h = np.add.reduceat(BYTE[LOWER[data[at]]] * powers[place], np.flatnonzero(first[at]))
    return mix(h), np.searchsorted(starts, begin, side="right") - 1


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each document as ascending 48-bit numbers."""
    out: list[np.ndarray] = []
    n, i = len(starts) - 1, 0
    while i < n:
        # Whole documents of about a piece at a time.
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE, side="right")) - 1)
        own = starts[i : j + 1] - starts[i]
        h, doc = word_hashes(data[starts[i] : starts[j]], own)
        ends = np.searchsorted(doc, np.arange(j - i + 1))
        long = folded(h, N)
        for a, b in zip(ends, ends[1:], strict=False):
            x = np.sort(long[a : b - N + 1] if b - a >= N else folded(h[a:b], max(1, b - a)))
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
        i = j
    return out


def folded(h: np.ndarray, n: int) -> np.ndarray:
    """48-bit hashes of every n words in a row."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = (s ^ h[k : k + len(s)]) * np.uint64(0xD6E8FEB86659FD93)
            s ^= s >> np.uint64(32)
        return mix(s) >> np.uint64(64 - BITS)


def set_ids(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits for each set, as two columns; from the sums of its mixed members and its size."""
    out = []
    with np.errstate(over="ignore"):
        end = np.cumsum(sizes)
        for seed in (0x51ED27, 0xA1B2C3D4E5):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat + np.uint64(seed)), dtype=np.uint64)])
            out.append((mix(total[end] - total[end - sizes] + np.uint64(seed)) ^ mix(sizes.astype(np.uint64))).view(np.int64))
    return np.stack(out, axis=1)


class Sets:
    def __init__(self, group: pa.Table) -> None:
        self.ids = [None if n else i for i, n in zip(group.column("doc_id").to_pylist(), group.column("no_id").to_pylist(), strict=True)]
        self.sets = shingle_sets(*bytes_of(group.column("body")))
        self.bodies = group.column("body")
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate(self.sets)
        self.names = set_ids(flat, self.sizes)
        _, first = np.unique(self.names, axis=0, return_index=True)
        self.hashes, self.of = np.unique(flat, return_inverse=True)
        distinct = np.zeros(len(self.sets), bool)
        distinct[first] = True
        self.counts = np.bincount(self.of[np.repeat(distinct, self.sizes)], minlength=len(self.hashes))

    def text_hashes(self) -> np.ndarray:
        """What text_hash() makes of the texts."""
        return np.array([xxhash.xxh64_intdigest(b.as_buffer(), 42) for b in self.bodies], np.uint64).view(np.int64)


def text_hash():
    """64 bits that tell the texts of rows with one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


DOCS = "doc_id long, n_shingles long, s1 long, s2 long, text_hash long, live binary, often binary, sketch binary"


def send_shingles(n: int, route: Route):
    def run(group: pa.Table) -> pa.Table:
        s, chunk = Sets(group), group.column("chunk")[0].as_py()
        cut = split_at(s.hashes, n, BITS)
        few = np.minimum(s.counts, 255).astype(np.uint8)
        return route.frames([(b, chunk, pack(np.frombuffer(pack_sorted(s.hashes[x:y]), np.uint8), few[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x])

    return run


def answer_often(route: Route):
    """For each shingle of each chunk, the number of bits of the number of sets beside the first that hold it: 0 for one set."""

    def run(group: pa.Table) -> pa.Table:
        pieces = pieces_of(group)
        parts = [unpack(blob) for _, _, blob in pieces]
        h = np.concatenate([unpack_sorted(p[0].tobytes()) for p in parts])
        n = np.concatenate([p[1] for p in parts])
        _, of = np.unique(h, return_inverse=True)
        often = np.ceil(np.log2(np.maximum(1, np.bincount(of, n)))).astype(np.uint8)[of]
        stop = np.cumsum([0] + [len(p[1]) for p in parts])
        return route.frames([(c, b, pack(often[x:y])) for (b, c, _), x, y in zip(pieces, stop, stop[1:], strict=False)])

    return run


def describe(group: pa.Table, answers: pa.Table) -> pa.Table:
    """DOCS; live: the shared shingles of a set that may link, often: how many sets each stands in (its bits)."""
    names = [c.split()[0] for c in DOCS.split(", ")]
    if not len(group):
        return pa.table({c: pa.array([], pa.int64() if i < 5 else pa.binary()) for i, c in enumerate(names)})
    s = Sets(group)
    often = [unpack(blob)[0] for _, _, blob in pieces_of(answers)]
    often = (np.concatenate(often) if often else np.zeros(0, np.uint8))[s.of] if len(s.of) else np.zeros(0, np.uint8)
    live: list[tuple] = []
    for x, e in zip(s.sets, np.cumsum(s.sizes), strict=True):
        own = often[e - len(x) : e]
        c = np.count_nonzero(own)
        if c and 100 * c >= THRESHOLD * len(x):
            live.append((pack_sorted(x[own > 0]), pack(own[own > 0]), sketch(x)))
        else:
            live.append((None, None, None))
    cols = [pa.array(s.ids, pa.int64()), pa.array(s.sizes), pa.array(s.names[:, 0]), pa.array(s.names[:, 1]), pa.array(s.text_hashes()), *(pa.array(c, pa.binary()) for c in zip(*live, strict=True))]
    return pa.table(dict(zip(names, cols, strict=True)))


def sketch(x: np.ndarray) -> bytes:
    """The parities of parts of a set, two bits a shingle or more, a power of two of them; two sketches differ in no more bits than their sets in shingles."""
    bits = max(64, 1 << int(2 * len(x) - 1).bit_length())
    at = (mix(x ^ np.uint64(0xA5A5A5)) >> np.uint64(32)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, size_a: int, b: bytes, size_b: int) -> bool:
    """False only for pairs that are too far apart by size or sketch; the longer sketch is folded."""
    if 100 * min(size_a, size_b) < THRESHOLD * max(size_a, size_b):
        return False
    if len(a) > len(b):
        a, b = b, a
    short, long = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    apart = int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)).sum(dtype=np.int64))
    return (100 + THRESHOLD) * apart <= (100 - THRESHOLD) * (size_a + size_b)


def band_edges(largest: int) -> list[int]:
    """Starts of size bands; sets that link lie in one band or in two that follow each other."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(100 * edges[-1] // THRESHOLD + 1)
    return edges


def most_apart(size: int) -> int:
    """In how many shingles a set of this size differs at most from a linked one that isn't larger."""
    return 2 * size * (100 - THRESHOLD) // (100 + THRESHOLD)


def plan(edges: list[int]) -> list[int]:
    """Segments of each band: the fewest, so the largest, at which k + 1 counts are there with few empty ones; 0 if only equal sets link."""
    out = []
    for low in edges:
        high = 100 * low // THRESHOLD
        need = most_apart(high) + 1
        if need == 1:
            out.append(0)
            continue
        for tenth in range(SEGMENT[0] * 10, SEGMENT[1] * 10 - 1, -5):
            n = max(-(-need // 2), round(low * 10 / tenth))
            each = low / n
            # Two counts from segments of two shingles or more, one from those of one.
            if n * (2 - exp(-each) * (2 + each)) >= need + 3 * sqrt(n):
                break
        out.append(n)
    return out


def keys_of(tokens: list[np.ndarray], often: list[np.ndarray], sizes: np.ndarray, n: int, seed: int, looks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of some sets, the set of each, and its kind: 1 for a deletion, 2 for what is looked up; with n segments."""
    count = len(tokens)
    length = np.array([len(t) for t in tokens])
    owner = np.repeat(np.arange(count), length)
    with np.errstate(over="ignore"):
        h = mix(np.concatenate(tokens) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15))
        cell = owner * n + ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
        value = mix(h)
        whole = np.zeros(count * n, np.uint64)
        np.add.at(whole, cell, value)
        place = mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 20))
        exact = mix(whole + np.tile(place, count))
        less = mix(whole[cell] - value + place[cell % n])
    kind_exact, kind_less = np.zeros(count * n, np.uint8), np.ones(len(h), np.uint8)
    if looks:
        # What a lookup may find at most: the sets that hold the rarest shingle of what is looked up; empty ones come last.
        f = np.ldexp(1.0, np.concatenate(often).astype(np.int64))
        order = np.lexsort((f, cell))
        m = np.bincount(cell, minlength=count * n)
        start = np.cumsum(m) - m
        low = np.full(count * n, 1e12)
        low[m > 0] = f[order][start[m > 0]]
        second = np.full(count * n, 1e13)
        second[m > 1] = f[order][start[m > 1] + 1]
        cost = np.concatenate([low, np.where(m > 0, np.maximum(0, m - 1) * low + second, 1e14)])
        by = np.tile(np.repeat(np.arange(count), n), 2)
        ranked = np.lexsort((np.repeat([0, 1], count * n), cost, by))
        place_in = np.arange(len(ranked)) - np.repeat(np.arange(count) * 2 * n, 2 * n)
        need = np.array([most_apart(int(x)) + 1 for x in sizes])
        taken = ranked[place_in < need[by[ranked]]]
        kind_exact[taken[taken < count * n]] |= 2
        both = np.zeros(count * n, bool)
        both[taken[taken >= count * n] - count * n] = True
        kind_less[both[cell]] |= 2
    keys, owners = np.concatenate([exact, less]), np.concatenate([np.repeat(np.arange(count), n), owner])
    return keys >> np.uint64(64 - BITS), owners, np.concatenate([kind_exact, kind_less])


def send_keys(n: int, edges: list[int], segments: list[int], route: Route):
    """FRAME: keys with sets and kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Sets up to SLICE shingles at a time bound what their keys take.
            cut = np.cumsum(batch.column(1).to_numpy()) // SLICE
            for start in np.flatnonzero(np.diff(cut, prepend=-1)):
                part = batch.slice(start, int(np.searchsorted(cut, cut[start], side="right")) - start)
                nodes, sizes = part.column(0).to_numpy(), part.column(1).to_numpy()
                tokens = [unpack_sorted(b) for b in part.column(2).to_pylist()]
                often = [unpack(b)[0] for b in part.column(3).to_pylist()]
                band = np.searchsorted(edges, sizes, side="right") - 1
                found: list[tuple] = []
                for b in np.unique(band):
                    rows = np.flatnonzero(band == b)
                    for scheme in (b, b + 1):
                        if scheme < len(segments) and segments[scheme]:
                            k, o, kind = keys_of([tokens[i] for i in rows], [often[i] for i in rows], sizes[rows], segments[scheme], int(scheme), scheme == b)
                            found.append((k, rows[o], kind))
                if not found:
                    continue
                k, o, kind = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(k, kind="stable")
                k, o, kind = k[order], o[order], kind[order]
                ends = split_at(k, n, BITS)
                pieces = []
                sender = int(nodes[0]) & 0x7FFFFFFF
                for b, (x, y) in enumerate(zip(ends, ends[1:], strict=False)):
                    if y > x:
                        used, number = np.unique(o[x:y], return_inverse=True)
                        number = number.astype(np.uint8 if len(used) <= 1 << 8 else np.uint16 if len(used) <= 1 << 16 else np.uint32)
                        pieces.append((b, sender, pack(np.frombuffer(pack_sorted(k[x:y]), np.uint8), number, nodes[used], kind[x:y])))
                yield from route.frames(pieces).to_batches()

    return run


def groups_of(group: pa.Table) -> pa.Table:
    """name, members: the distinct groups of two or more sets with one key that is looked up, ascending.

    Pieces stand ascending by key, so the bucket is worked on in ranges of about TOGETHER_KEYS keys: what is at hand beside the
    pieces doesn't grow with the bucket.
    """
    pieces, nodes, start = [], [], 0
    for blob in group.column("blob"):
        for _, _, piece in pickle.loads(blob.as_buffer()):
            packed, number, own, kind = unpack(piece)
            # Numbers are those of the piece's own sets until a range is taken.
            pieces.append((unpack_sorted(packed.tobytes()), number, start, kind))
            nodes.append(own)
            start += len(own)
    ids, of = np.unique(np.concatenate(nodes), return_inverse=True)
    low, high = min(int(p[0][0]) for p in pieces), max(int(p[0][-1]) for p in pieces) + 1
    parts = max(1, -(-sum(len(p[0]) for p in pieces) // TOGETHER_KEYS))
    at = [np.zeros(len(pieces), np.int64)]
    for k in range(1, parts):
        edge = np.uint64(low + (high - low) * k // parts)
        at.append(np.array([np.searchsorted(p[0], edge) for p in pieces]))
    at.append(np.array([len(p[0]) for p in pieces]))
    found = [NO_GROUPS]
    for x, y in zip(at, at[1:], strict=False):
        some = [(keys[i:j], of[number[i:j].astype(np.int64) + first], kind[i:j]) for (keys, number, first, kind), i, j in zip(pieces, x, y, strict=True) if j > i]
        if some:
            found.append(groups_in(ids, *(np.concatenate(c) for c in zip(*some, strict=True))))
    out = pa.concat_tables(found)
    return out.take(pa.array(np.unique(out.column("name").to_numpy(), return_index=True)[1])) if len(found) > 2 else found[-1]


NO_GROUPS = pa.table({"name": pa.array([], pa.int64()), "members": pa.array([], pa.list_(pa.int64()))})


def groups_in(ids: np.ndarray, s: np.ndarray, i: np.ndarray, kind: np.ndarray) -> pa.Table:
    """The groups of some whole keys s with the places of their sets in ids, and kinds."""
    # Only keys of several rows can matter; most have one.
    order = np.argsort(s, kind="stable")
    s = s[order]
    same = s[1:] == s[:-1]
    several = np.zeros(len(s), bool)
    several[1:] |= same
    several[:-1] |= same
    order, s = order[several], s[several]
    i, kind = i[order], kind[order]
    order = np.lexsort((i, s))
    s, i, kind = s[order], i[order], kind[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    if not len(starts):
        return NO_GROUPS
    # A whole segment that is looked up finds all; a deletion that is looked up finds whole segments.
    any_of = lambda x: np.logical_or.reduceat(x, starts)
    asked = any_of(kind == 2) | (any_of(kind == 3) & any_of((kind & 1) == 0))
    keep = np.repeat(asked, np.diff(np.append(starts, len(s))))
    s, i = s[keep], i[keep]
    keep = np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])[: len(s)]
    s, i = s[keep], i[keep]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
    counts = np.diff(np.append(starts, len(s)))
    starts, counts = starts[counts > 1], counts[counts > 1]
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(ids[i].astype(np.uint64) + np.uint64(0x77)), dtype=np.uint64)])
        names, one = np.unique((total[starts + counts] - total[starts]).view(np.int64), return_index=True)
    starts, counts = starts[one], counts[one]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    flat = ids[i[np.repeat(starts - offsets[:-1], counts) + np.arange(offsets[-1])]]
    return pa.table({"name": pa.array(names), "members": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that neither sizes nor sketches rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(2, 6)]
            keep = pa.array([may_link(x, p, y, q) for p, x, q, y in zip(*cols, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    fits = F.lit(100) * F.least("size_a", "size_b") >= F.lit(THRESHOLD) * F.greatest("size_a", "size_b")
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    near = pairs.join(left.select("a", "size_a"), "a").join(right.select("b", "size_b"), "b").where(fits).select("a", "b")
    near = near.join(left, "a").join(right, "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    return near.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link."""
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("live").alias("live_a"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("live").alias("live_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, y = [], None, None
            for sa, la, sb, lb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if lb is not last and lb != last:
                    last, y = lb, unpack_sorted(lb)
                both = len(np.intersect1d(unpack_sorted(la), y, assume_unique=True))
                keep.append(100 * both >= THRESHOLD * (sa + sb - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = possible(pairs, sets).join(left, "a").join(right, "b")
    return near.select("a", "b", "size_a", "live_a", "size_b", "live_b").mapInArrow(run, "a long, b long")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash of every row, and r1, r2, which name its component."""
    spark = docs.sparkSession
    d, n = chunks_of(docs.select("doc_id", "text"))
    route = Route(n)
    sent = route.forward(d.groupBy("chunk").applyInArrow(send_shingles(n, route), FRAME))
    often = route.forward(sent.groupBy("node").applyInArrow(answer_often(route), FRAME))
    described = materialise(d.groupBy("chunk").cogroup(often.groupBy("node")).applyInArrow(describe, DOCS))
    sets = described.where("live IS NOT NULL").groupBy("s1", "s2").agg(F.first("n_shingles").alias("size"), *[F.first(c).alias(c) for c in ("live", "often", "sketch")])
    # Numbered once and written, so that the numbers stay.
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()))
    span = sets.agg(F.max("size"), F.sum("size")).first()
    roots = linked(sets, *span) if span[0] else spark.createDataFrame([], "node long, root long")
    root = sets.select("s1", "s2", "node").join(roots, "node").join(sets.select(F.col("node").alias("root"), F.col("s1").alias("r1"), F.col("s2").alias("r2")), "root")
    named = described.select("doc_id", "n_shingles", "text_hash", "s1", "s2").join(root.select("s1", "s2", "r1", "r2"), ["s1", "s2"], "left")
    named = named.select("doc_id", "n_shingles", "text_hash", F.coalesce("r1", "s1").alias("r1"), F.coalesce("r2", "s2").alias("r2"))
    least = named.where("n_shingles > 0").groupBy("r1", "r2").agg(F.min("doc_id").alias("least")).toDF("l1", "l2", "least")
    out = named.join(least, (F.col("r1") == F.col("l1")) & (F.col("r2") == F.col("l2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "r1", "r2")


def linked(sets: DataFrame, largest: int, shingles: int) -> DataFrame:
    """node, root of the sets that link with another."""
    edges = band_edges(largest)
    n = max(1, -(-5 * shingles // (2 * BUCKET_KEYS)))
    route = Route(n)
    sent = sets.select("node", "size", "live", "often").mapInArrow(send_keys(n, edges, plan(edges), route), FRAME)
    groups = route.forward(sent).groupBy("node").applyInArrow(groups_of, "name long, members array<bigint>")
    groups = materialise(groups.dropDuplicates(["name"]))
    stars = groups.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, 1 << 30)).alias("b")).distinct()
    found = materialise(verified(stars, sets))
    roots = components(found)

    # Each set first meets those of other components that are nearest by sketch; most that link do so here.
    more = materialise(apart(groups, roots, sets, FEW).join(stars, ["a", "b"], "left_anti"))
    tried = stars.union(more)
    found = found.union(materialise(verified(more, sets)))
    roots = components(found)

    second = materialise(verified(apart(groups, roots, sets).join(tried, ["a", "b"], "left_anti"), sets))
    if not second.take(1):
        return roots
    return components(found.union(second))


def apart(groups: DataFrame, roots: DataFrame, sets: DataFrame, few: int | None = None) -> DataFrame:
    """The distinct pairs (a, b) of a group's members in different components that sizes and sketches don't rule out; with few, only the nearest of a member.

    Sketches go to the groups, a pair of blocks of BLOCK members at a time, and pairs are made there; only those left leave.
    Groups with the same least component, which have pairs in common, meet in tasks of about TOGETHER members.
    """
    d = groups.select("name", F.ceil(F.size("members") / BLOCK).cast("int").alias("blocks"), F.explode("members").alias("node"))
    d = d.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = d.groupBy("name").agg(F.min("root").alias("least"), F.max("root").alias("y"), F.count("*").alias("n")).where("least <> y").drop("y")
    tasks = several.groupBy("least").agg(F.ceil(F.sum("n") / TOGETHER).alias("tasks"))
    several = several.join(tasks, "least").select("name", "least", F.pmod(F.xxhash64("name"), F.col("tasks")).alias("task"))
    d = d.join(several, "name").join(sets.select("node", "size", "sketch"), "node")
    d = d.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("least", "task", "name", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root", "size", "sketch")
    return d.groupBy("least", "task").applyInArrow(members_apart(few), "a long, b long").distinct()


def members_apart(few: int | None):
    """The distinct pairs of some groups' members.  Pairs within a block come up in each of its rows, which costs little beside those between blocks."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("name", "ascending"), ("low", "ascending"), ("high", "ascending"), ("node", "ascending")])
        name, low, high = (group.column(c).to_numpy() for c in ("name", "low", "high"))
        starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        found = np.zeros((0, 2), np.int64)
        held: list[np.ndarray] = []
        for s, e in zip(starts, np.append(starts[1:], len(name)), strict=True):
            held += pairs_apart(group.slice(s, e - s), few)
            if sum(map(len, held)) > 1 << 20:
                found, held = np.unique(np.concatenate([found, *held]), axis=0), []
        found = np.unique(np.concatenate([found, *held]), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def pairs_apart(rows: pa.Table, few: int | None) -> list[np.ndarray]:
    """The pairs of one group's members, a row each."""
    node, root, size = (rows.column(c).to_numpy() for c in ("node", "root", "size"))
    sketches = rows.column("sketch").to_pylist()
    out = []
    # All at the length of the shortest, which is at most a few times shorter where sizes fit.
    for low in sorted({len(x) for x in sketches}):
        at = np.array([i for i, x in enumerate(sketches) if low <= len(x) <= 4 * low])
        first = np.array([len(sketches[i]) == low for i in at])
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, low // 8), axis=0) for i in at])
        # Pairs of the shortest length once, and all with longer ones; some rows of the matrix of pairs at a time.
        mine = np.flatnonzero(first)
        step = max(1, (1 << 19) // max(1, bits.size))
        for start in range(0, len(mine), step):
            i = mine[start : start + step, None]
            x = at[i]
            near = (~first | (np.arange(len(at)) > i)) & (root[at] != root[x])
            near &= 100 * np.minimum(size[at], size[x]) >= THRESHOLD * np.maximum(size[at], size[x])
            if not near.any():
                continue
            differ = np.bitwise_count(bits ^ bits[i]).sum(axis=2, dtype=np.int64)
            near &= (100 + THRESHOLD) * differ <= (100 - THRESHOLD) * (size[at] + size[x])
            if few and near.shape[1] > few:
                ranked = np.argpartition(np.where(near, differ, 1 << 40), few, axis=1)[:, :few]
                which, cols = np.repeat(np.arange(len(near)), few), ranked.ravel()
                some = near[which, cols]
                which, cols = which[some], cols[some]
            else:
                which, cols = np.nonzero(near)
            if len(which):
                p, q = node[x[which, 0]], node[at[cols]]
                out.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one of each component: the row with its least doc_id; of several such rows all with one text stay that
    is least by hash, so that rows with a doc_id that differ in text are told apart; rows that are equal in all columns stay once.

    Documents without words and rows without a doc_id link with nothing that has one, and stay, equal rows once.
    """
    gone_id, gone_text = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    out = classes(docs).where("n_shingles > 0")
    first = out.where("doc_id = component_id").select("doc_id", "text_hash", "r1", "r2").distinct()
    lead = first.groupBy("r1", "r2").agg(F.min("text_hash").alias("lead"))
    tied = first.join(lead, ["r1", "r2"]).where("text_hash <> lead").select("doc_id", "text_hash")
    gone = out.where("doc_id <> component_id").select("doc_id", "text_hash")
    gone = materialise(gone.union(tied).distinct().toDF(gone_id, gone_text))
    return docs.join(gone, (F.col("doc_id") == F.col(gone_id)) & (text_hash() == F.col(gone_text)), "left_anti").distinct()


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
