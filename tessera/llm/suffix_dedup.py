"""Suffix-array dedup: removes what a document shares with one of a smaller number, to the byte.

Every window of LENGTH bytes has an anchor, the least K-byte string in it by a hash, so that equal windows have equal
anchors.  Consecutive windows with one anchor make a context.  First, chunks send the hashes of their anchors to
buckets, which answer which stand in two documents, and which in HOT or more.  Then they send the contexts of those, each
distinct one once with its least document (of a hot anchor window by window, to the buckets of the windows' hashes); a
bucket collapses equal contexts, and sorts the suffixes that remain, those of anchors with several contexts, in blocks of
bounded size with a difference cover, long ties by ranks of cover samples.  Suffixes that agree on LENGTH bytes are then
neighbours, and their least document is known.  The chunks get a bit for each window of each context: whether a smaller
document than their own least one has it.

So the sort works on the contexts of shared anchors, of at most LENGTH + SPAN - 1 bytes each, not on whole texts: what an
anchor rules out or equal contexts settle is never sorted, and ties end within LENGTH bytes.

Only hashes of anchors can collide, which costs time, never a result; windows are compared by their bytes.

Defined cases: a null or empty text loses nothing; a text shorter than LENGTH loses nothing; a missing doc_id counts as
the largest number and comes back as null; rows with one doc_id don't remove from each other; windows never cross
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exchange import FRAME, PIECE, Route, bytes_of, chunks_of, mix, pack, pack_sorted, pieces_of, split_at, unpack, unpack_sorted
from .suffix_sort import SuffixSorter

LENGTH = 50
K = 24
SPAN = LENGTH - K + 1
BITS = 48
#: Documents from which on an anchor is hot.
HOT = 20_000
#: Contexts of one block of a bucket's sort.
BLOCK = 50_000
WIDTH = LENGTH + SPAN - 1


def order_hash(b: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the K bytes from each position, for as many positions as have them; K is 24."""
    with np.errstate(over="ignore"):
        h = b.astype(np.uint32) + np.uint32(1)
        for step, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F), (8, 0x165667B1)):
            h8 = h
            h = h[:-step] * np.uint32(factor) + h[step:]
            h = h ^ (h >> np.uint32(15))
        h = h[: len(b) - K + 1] * np.uint32(0x9E3779B1) + h8[16 : 16 + len(b) - K + 1]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        return h


def piece_runs(b: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of each run of windows with one anchor.  ok: windows inside one document."""
    h = order_hash(b)
    m = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < SPAN:
        step = min(have, SPAN - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(ok[: len(anchor)])
    if not len(at):
        return at, at, at
    a = anchor[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return a[first], at[first], at[last]


class Chunk:
    """The runs of a chunk's documents, their hashes and documents, in one order for the same rows."""

    def __init__(self, rows: pa.Table) -> None:
        ids = rows.column("doc_id").to_numpy()
        data, starts = bytes_of(rows.column("body"))
        order = np.lexsort((np.diff(starts), ids))
        if not (order == np.arange(len(ids))).all():
            rows = rows.take(pa.array(order))
            ids = rows.column("doc_id").to_numpy()
            data, starts = bytes_of(rows.column("body"))
        self.rows, self.ids, self.data, self.starts = rows, ids, data, starts
        n = len(data)
        inside = np.zeros(n + 1, np.int32)
        fits = np.diff(starts) >= LENGTH
        np.add.at(inside, starts[:-1][fits], 1)
        np.add.at(inside, starts[1:][fits] - LENGTH + 1, -1)
        ok = np.cumsum(inside)[:n] > 0
        parts = [], [], []
        for s in range(0, max(0, n - LENGTH + 1), PIECE):
            e = min(n, s + PIECE + LENGTH - 1)
            for out, x in zip(parts, piece_runs(data[s:e], ok[s : min(s + PIECE, n - LENGTH + 1)]), strict=True):
                out.append(x + s)
        empty = np.zeros(0, np.int64)
        self.anchor, self.first, self.last = (np.concatenate(p) if p else empty for p in parts)
        self.doc = np.searchsorted(starts, self.first, side="right") - 1
        self.hash = np.concatenate([self._hash(self.anchor[i : i + PIECE]) for i in range(0, len(self.anchor), PIECE)]) if len(self.anchor) else np.zeros(0, np.uint64)
        self.hashes, self.where = np.unique(self.hash, return_inverse=True)

    def _hash(self, at: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, K)[at]).view("<u8")
        h = np.full(len(at), 7, np.uint64)
        for k in range(K // 8):
            h = mix(h * np.uint64(3) + rows[:, k])
        return h >> np.uint64(64 - BITS)

    def documents(self) -> np.ndarray:
        """In how many documents of the chunk each of the hashes stands."""
        pair = np.unique(self.where * len(self.ids) + self.doc)
        return np.bincount(pair // max(1, len(self.ids)), minlength=len(self.hashes))

    def contexts(self, spread: np.ndarray) -> Contexts:
        return Contexts(self, np.flatnonzero(spread[self.where]), spread[self.where] > 1)


class Contexts:
    """The distinct contexts of a chunk's shared anchors, in order of hash, place of the anchor, number of windows and bytes.

    A hot anchor's context is a context for each of its windows, whose hash is that of the window's bytes, so that no
    bucket takes all that stands around one string.
    """

    def __init__(self, c: Chunk, runs: np.ndarray, hot: np.ndarray) -> None:
        split = hot[runs]
        some = runs[split]
        windows = c.last[some] - c.first[some] + 1
        single = ragged(c.first[some], windows)
        runs = runs[~split]
        self.start = np.concatenate([c.first[runs], single])
        self.doc = np.concatenate([c.doc[runs], np.repeat(c.doc[some], windows)])
        anchor = np.concatenate([c.anchor[runs], np.repeat(c.anchor[some], windows)])
        last = np.concatenate([c.last[runs], single])
        lead, windows = anchor - self.start, last - self.start + 1
        size = windows + LENGTH - 1
        n = len(self.start)
        h1 = np.zeros(n, np.uint64)
        h2 = np.zeros(n, np.uint64)
        padded = np.concatenate([c.data, np.zeros(80, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, 80)
        for s in range(0, n, 1 << 16):
            part = slice(s, s + (1 << 16))
            rows = view[self.start[part]] * (np.arange(80) < size[part, None])
            w = np.ascontiguousarray(rows.astype(np.uint8)).view("<u8")
            a = np.full(len(w), 11, np.uint64)
            b = np.full(len(w), 13, np.uint64)
            for k in range(10):
                a = mix(a * np.uint64(3) + w[:, k])
                b = mix(b * np.uint64(5) ^ w[:, k])
            h1[part], h2[part] = a, b
        key_hash = np.concatenate([c.hash[runs], h1[len(runs) :] >> np.uint64(64 - BITS)])
        shape = (lead * 64 + windows).astype(np.int64)
        order = np.lexsort((self.doc, h2, h1, shape, key_hash))
        key = [x[order] for x in (key_hash, shape, h1, h2)]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        head = order[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.hash, self.lead, self.windows, self.size = key_hash[head], lead[head], windows[head], size[head]
        self.first = self.start[head]
        self.least = c.ids[self.doc[head]]


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .. and so on."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - size), size)


def send_hashes(n: int, route: Route):
    def run(group: pa.Table) -> pa.Table:
        c = Chunk(group)
        chunk = group.column("chunk")[0].as_py()
        cut, found = split_at(c.hashes, n, BITS), np.minimum(c.documents(), 255).astype(np.uint8)
        return route.frames([(b, chunk, pack(np.frombuffer(pack_sorted(c.hashes[s:e]), np.uint8), found[s:e])) for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s])

    return run


def answer_spread(route: Route):
    """For each hash of each chunk 0 if it stands in one document, 1 in several, 2 in HOT or more."""

    def run(group: pa.Table) -> pa.Table:
        sent = pieces_of(group)
        parts = [unpack(blob) for _, _, blob in sent]
        h = np.concatenate([unpack_sorted(p[0].tobytes()) for p in parts])
        _, of = np.unique(h, return_inverse=True)
        total = np.bincount(of, np.concatenate([p[1] for p in parts]))
        spread = ((total > 1).astype(np.uint8) + (total >= HOT))[of].astype(np.uint8)
        stop = np.cumsum([0] + [len(p[1]) for p in parts])
        return route.frames([(c, b, pack(spread[x:y])) for (b, c, _), x, y in zip(sent, stop, stop[1:], strict=False)])

    return run


def spread_of(answers: pa.Table) -> np.ndarray:
    out = [unpack(blob)[0] for _, _, blob in pieces_of(answers)]
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def bits_of(answers: pa.Table) -> np.ndarray:
    out = [np.unpackbits(bits, count=int(n[0])).astype(bool) for bits, n in (unpack(blob) for _, _, blob in pieces_of(answers))]
    return np.concatenate(out) if out else np.zeros(0, bool)


def send_contexts(n: int, route: Route):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return route.frames([])
        c = Chunk(group)
        chunk = group.column("chunk")[0].as_py()
        x = c.contexts(spread_of(answers))
        cut, out = split_at(x.hash, n, BITS), []
        for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
            if e > s:
                body = c.data[ragged(x.first[s:e], x.size[s:e])]
                out.append((b, chunk, pack(x.hash[s:e], x.lead[s:e].astype(np.uint8), x.windows[s:e].astype(np.uint8), x.least[s:e], body)))
        return route.frames(out)

    return run


def least_documents(text: np.ndarray, first: np.ndarray, lead: np.ndarray, windows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of contexts that share anchors, the least document with the same LENGTH bytes; contexts by start."""
    v = 32
    # Contexts are laid out so that anchors fall on multiples of the cover's period: equal windows then have one residue.
    room = -(-(WIDTH + v) // v) * v
    n = len(first)
    laid = np.zeros(n * room + 1, np.uint8)
    begin = np.arange(n) * room + (v - lead)
    size = windows + LENGTH - 1
    laid[ragged(begin, size)] = text[ragged(first, size)]
    position = ragged(begin, windows)
    owner = np.repeat(least, windows)
    at = np.full(len(laid), -1, np.int64)
    at[position] = np.arange(len(position))
    order = at[SuffixSorter(laid).sort(position)]
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([laid, np.zeros(LENGTH, np.uint8)]), LENGTH)
    group = np.zeros(len(order), np.int64)
    for s in range(1, len(order), 1 << 16):
        e = min(len(order), s + (1 << 16))
        group[s:e] = (view[position[order[s:e]]] != view[position[order[s - 1 : e - 1]]]).any(axis=1)
    group = np.cumsum(group)
    low = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, group, owner[order])
    out = np.empty(len(order), np.int64)
    out[order] = low[group]
    return out


def answer_contexts(sent: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Pieces back to the chunks: a bit for each window of each of their contexts."""
    parts = [unpack(blob) for _, _, blob in sent]
    h, lead, windows, least, body = (np.concatenate([p[k] for p in parts]) for k in range(5))
    lead, windows = lead.astype(np.int64), windows.astype(np.int64)
    size = windows + LENGTH - 1
    first = np.cumsum(size) - size
    # Equal contexts collapse; their bytes are compared by way of their place in the order of all bytes.
    padded = np.concatenate([body, np.zeros(80, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 80)
    w = np.empty((len(h), 10), np.uint64)
    for s in range(0, len(h), 1 << 16):
        part = slice(s, s + (1 << 16))
        w[part] = np.ascontiguousarray((view[first[part]] * (np.arange(80) < size[part, None])).astype(np.uint8)).view("<u8")
    shape = lead * 64 + windows
    order = np.lexsort((least, *(w[:, k] for k in range(9, -1, -1)), shape, h))
    new = np.ones(len(order), bool)
    same_hash = h[order][1:] == h[order][:-1]
    new[1:] = ~same_hash | (shape[order][1:] != shape[order][:-1]) | (w[order[1:]] != w[order[:-1]]).any(axis=1)
    del w
    head = order[new]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    # For each distinct context and window the least document.
    count = windows[head]
    base = np.cumsum(count) - count
    low = np.repeat(least[head], count)
    hh = h[head]
    alike = hh[1:] == hh[:-1]
    many = np.zeros(len(head), bool)
    many[1:] |= alike
    many[:-1] |= alike
    todo = np.flatnonzero(many)
    s = 0
    while s < len(todo):
        e = min(len(todo), s + BLOCK)
        while e < len(todo) and hh[todo[e]] == hh[todo[e - 1]]:
            e += 1
        some = todo[s:e]
        pick = head[some]
        low[ragged(base[some], count[some])] = least_documents(body, first[pick], lead[pick], windows[pick], least[pick])
        s = e
    bit = low[ragged(base[of], windows)] < np.repeat(least, windows)
    stop = np.cumsum([0] + [len(p[0]) for p in parts])
    ends = np.concatenate([[0], np.cumsum(windows)])
    return [(c, b, pack(np.packbits(bit[ends[x] : ends[y]]), np.array([ends[y] - ends[x]]))) for (b, c, _), x, y in zip(sent, stop, stop[1:], strict=False)]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(c: Chunk, x: Contexts, bits: np.ndarray) -> np.ndarray:
    """Whether each byte of the chunk goes."""
    base = np.cumsum(x.windows) - x.windows
    of = x.of
    windows = x.windows[of]
    at = ragged(x.start, windows)
    later = np.repeat(c.ids[x.doc] > x.least[of], windows)
    gone = at[later | bits[ragged(base[of], windows)]]
    edge = np.zeros(len(c.data) + 1, np.int32)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + LENGTH, -1)
    return np.cumsum(edge)[: len(c.data)] > 0


def finish(keep_text: bool):
    def run(group: pa.Table, shared: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(group)
        x = c.contexts(spread_of(shared))
        mask = covered(c, x, bits_of(answers))
        n = np.diff(c.starts)
        total = np.concatenate([[0], np.cumsum(mask)])
        removed = total[c.starts[1:]] - total[c.starts[:-1]]
        rise = mask.copy()
        rise[1:] &= ~mask[:-1]
        inner = c.starts[:-1][n > 0]
        rise[inner] = mask[inner]
        rises = np.concatenate([[0], np.cumsum(rise)])
        spans = rises[c.starts[1:]] - rises[c.starts[:-1]]
        kept = [c.data[s:e].tobytes() if not r else c.data[s:e][~mask[s:e]].tobytes() for s, e, r in zip(c.starts, c.starts[1:], removed, strict=False)]
        ids = pa.array(c.ids, mask=c.rows.column("no_id").to_numpy(zero_copy_only=False).astype(bool))
        out = {"doc_id": ids, "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return run


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """RESULT of every row; with keep_text also the remaining bytes (kept)."""
    d, n = chunks_of(docs)
    route = Route(n)
    hashes = route.forward(d.groupBy("chunk").applyInArrow(send_hashes(n, route), FRAME))
    shared = route.forward(hashes.groupBy("node").applyInArrow(answer_spread(route), FRAME))
    contexts = route.forward(d.groupBy("chunk").cogroup(shared.groupBy("node")).applyInArrow(send_contexts(n, route), FRAME))
    low = route.forward(contexts.groupBy("node").applyInArrow(lambda group: route.frames(answer_contexts(pieces_of(group))), FRAME))
    both = shared.withColumn("second", F.lit(False)).unionByName(low.withColumn("second", F.lit(True)))

    def last(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *((("kept", pa.binary()),) if keep_text else ()))})
        second = answers.column("second")
        return finish(keep_text)(group, answers.filter(pc.invert(second)), answers.filter(second))

    return d.groupBy("chunk").cogroup(both.groupBy("node")).applyInArrow(last, RESULT + (", kept binary" if keep_text else ""))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
