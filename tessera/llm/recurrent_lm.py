"""LM scoring: a gated recurrent language model in numpy.

Texts are read once: rows of numbered words, a chunk of documents each.  Words are counted exactly over all training
documents: chunks send hashed words with counts to buckets, which answer the totals.  The HEAD most frequent words have
vectors of their own; others (the tail) fall into TAIL classes by their last two bytes.  The output is factored: first a
class, of HEAD_CLASSES frequency bands of head words or a tail class, then a head word by softmax within its band, or a
tail word by its count within its class (one unknown word in each).

Weights start from the unigram shares.  ROUNDS rounds make one pass over all training documents, each taking those of one
residue of a hash, if there are several.  In a round every task trains on its own documents by truncated backpropagation over windows of STEPS
tokens (more where few streams are left); STREAMS documents run beside each other, and each one's state is carried from window to window through the whole
document.  Adagrad sets the steps; the tasks' weights are averaged by tokens in a tree, so they depend on how the input is
split into tasks, and reruns agree for the same split.  Scoring runs over every whole document with state carried throughout.

Defined cases: a null text counts as empty, which is one end; a missing doc_id counts as held out; without training
documents all words are unknown; rows repeat as given; words are told apart by 64 bits, of which 5 are the tail class; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .exchange import CHUNK_BYTES, FRAME, Route, pack, pack_sorted, pieces_of, split_at, unpack, unpack_sorted

HEAD, HEAD_CLASSES, TAIL, HIDDEN = 2048, 32, 32, 16
CLASSES = HEAD_CLASSES + TAIL
STREAMS, STEPS, RATE, ROUNDS = 96, 16, 0.1, 2
#: A task starts with so many streams, and takes another one each so many tokens: few tokens still make many steps.
FIRST, GROW = 8, 2048
#: The largest norm of a step's gradient of the mean loss.
CLIP = 0.3
#: Of the documents that a round doesn't train on, one in so many, but at least so many (all where there are fewer), say how far to go
#: from the old weights to the averaged ones.
JUDGES, FEWEST, REACH = 16, 200, (0.0, 1.0, 2.0, 4.0)
#: How many times STEPS a window may have.
LONGER = 16
#: Tokens from which on a document trains before the others, and tokens of which a task knows the lengths ahead.
LONG, HELD = 1024, 1 << 24
#: Tokens from which on documents of several chunks are scored beside each other: steps over few documents cost as much as over many.
BESIDE = 1 << 22
#: First groups of the tree in which weights are averaged.
LEAVES = 4096
#: Logits up to which exp needs no shift.
LARGE = 80
#: A product with ones adds up rows faster than sum() does.
ONES = np.ones(HEAD, np.float32)
FOLDS = 10
SMOOTH = 0.1
END = b" end"
SHIFT = 5


def key_of(word: bytes) -> int:
    """A hash whose low bits are the word's tail class."""
    return xxhash.xxh64_intdigest(word) >> SHIFT << SHIFT | xxhash.xxh32_intdigest(word[-2:]) % TAIL


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def split(body: bytes) -> list[bytes]:
    words = body.lower().split()
    words.append(END)
    return words


class Vocabulary:
    """The head words by falling count, their bands, and what tail words share."""

    def __init__(self, total: int, distinct: int, keys: np.ndarray, counts: np.ndarray, tail_n: np.ndarray, tail_v: np.ndarray) -> None:
        self.total, self.distinct = total, distinct
        self.keys, self.counts = keys.astype(np.uint64), counts.astype(np.float64)
        n = len(keys)
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]
        # Bands of about equal mass, of at most HEAD / HEAD_CLASSES * 2 words.
        mass = np.cumsum(self.counts) / max(1.0, self.counts.sum())
        band = np.minimum((mass * HEAD_CLASSES * 0.5).astype(np.int64), HEAD_CLASSES // 2 - 1)
        by_rank = HEAD_CLASSES // 2 + np.arange(n) * (HEAD_CLASSES // 2) // max(1, n)
        self.band = np.where(band < HEAD_CLASSES // 2 - 1, band, by_rank)
        self.first = np.searchsorted(self.band, np.arange(HEAD_CLASSES + 1))
        inside = np.bincount((self.keys % np.uint64(TAIL)).astype(np.int64), self.counts, TAIL)
        self.tail_n = tail_n - inside
        self.tail_v = tail_v - np.bincount((self.keys % np.uint64(TAIL)).astype(np.int64), minlength=TAIL)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Head words by rank; HEAD and on: tail classes."""
        out = HEAD + (keys % np.uint64(TAIL)).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            hit = self.sorted[at] == keys
            out[hit] = self.order[at[hit]]
        return out

    def classes(self, index: np.ndarray) -> np.ndarray:
        out = HEAD_CLASSES + index - HEAD
        head = index < HEAD
        out[head] = self.band[index[head]]
        return out

    def tail_log(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        """ln of a tail word's share of its class."""
        g = index - HEAD
        return np.log((count + SMOOTH) / (self.tail_n[g] + SMOOTH * (self.tail_v[g] + 1)))

    def start_weights(self) -> list[np.ndarray]:
        rng = np.random.default_rng(5)
        small = lambda *shape: (rng.standard_normal(shape) * 0.08).astype(np.float32)
        # Smoothed as the base is, so that untrained weights score as it does.
        head = np.bincount(self.band, self.counts + SMOOTH, HEAD_CLASSES) if len(self.band) else np.zeros(HEAD_CLASSES)
        mass = np.append(head, np.maximum(self.tail_n, 0) + SMOOTH * (np.maximum(self.tail_v, 0) + 1)) + 1e-9
        share = np.log(mass / mass.sum())
        # A band without words gets no part of the probability.
        share[:HEAD_CLASSES][np.diff(self.first) == 0] = -40.0
        bias = np.zeros(HEAD, np.float32)
        if len(self.counts):
            bias[: len(self.counts)] = np.log((self.counts + SMOOTH) / np.bincount(self.band, self.counts + SMOOTH, HEAD_CLASSES)[self.band])
        return [
            small(HEAD + TAIL + 1, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32), small(HIDDEN, CLASSES) * 0,
            share.astype(np.float32), small(HEAD, HIDDEN) * 0, bias,
        ]


def shares(x: np.ndarray, scale: np.float32, shift: bool) -> None:
    """Each row's softmax times scale, in place; shift: logits may be too large for exp."""
    if shift:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x *= (scale / (x @ ONES[: x.shape[1]]))[:, None]


def log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The chosen column of each row's log softmax, and x is used up; logits are shifted only where they are too large for exp."""
    if x.max(initial=0) > LARGE or x.min(initial=0) < -LARGE:
        x -= x.max(axis=1, keepdims=True)
    chosen = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return chosen - np.log(x @ ONES[: x.shape[1]])


def with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([w, b[:, None]], axis=1)


class Network:
    def __init__(self, weights: list[np.ndarray], vocabulary: Vocabulary) -> None:
        self.w, self.v = weights, vocabulary

    def back(self) -> np.ndarray:
        """The transposed recurrent weights, those of the gates negative, as ``advance`` takes them."""
        u = self.w[1]
        return np.concatenate([-u[:, : 2 * HIDDEN].T, u[:, 2 * HIDDEN :].T])

    @staticmethod
    def advance(a: np.ndarray, h: np.ndarray, back: np.ndarray, q: np.ndarray | None = None, c: np.ndarray | None = None) -> np.ndarray:
        """The states after h from inputs a, a column for each stream, so that gates are contiguous; q gets the gates and what they are applied to, c the candidates."""
        q = np.dot(back, h, out=q)
        zr = q[: 2 * HIDDEN]
        zr -= a[: 2 * HIDDEN]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c = np.multiply(zr[HIDDEN:], q[2 * HIDDEN :], out=c)
        c += a[2 * HIDDEN :]
        np.tanh(c, out=c)
        d = h - c
        d *= zr[:HIDDEN]
        d += c
        return d

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.advance((self.w[0][x] + self.w[2]).T, h.T, self.back()).T

    def train(self, docs: Iterator[np.ndarray]) -> int:
        """One pass over documents of word indexes; the number of tokens.  A stream takes one document after the other, and ends when there is none."""
        start, sums = HEAD + TAIL, [np.full_like(w, 1e-3) for w in self.w]
        streams: list[np.ndarray] = []
        at: list[int] = []
        ended_at_all = False
        for d in docs:
            streams.append(d)
            at.append(0)
            if len(streams) == FIRST:
                break
        h, tokens = np.zeros((len(streams), HIDDEN), np.float32), 0
        while streams:
            wanted = min(STREAMS, FIRST + tokens // GROW)
            while not ended_at_all and len(streams) < wanted and (d := next(docs, None)) is not None:
                streams.append(d)
                at.append(0)
            h = np.concatenate([h, np.zeros((len(streams) - len(h), HIDDEN), np.float32)])
            n = len(streams)
            # Windows grow where few streams are left, so that long documents don't take a step of the optimiser for a few tokens.
            steps = STEPS * min(LONGER, max(1, wanted // n))
            x = np.full((steps, n), start)
            y = np.full((steps, n), -1)
            fresh = np.zeros((steps, n), bool)
            ended = []
            for s in range(n):
                t = 0
                while t < steps:
                    d = streams[s]
                    if at[s] >= len(d):
                        d = next(docs, None)
                        if d is None:
                            break
                        streams[s], at[s] = d, 0
                    k = min(steps - t, len(d) - at[s])
                    y[t : t + k, s] = d[at[s] : at[s] + k]
                    if at[s]:
                        x[t : t + k, s] = d[at[s] - 1 : at[s] + k - 1]
                    else:
                        x[t + 1 : t + k, s] = d[: k - 1]
                        fresh[t, s] = True
                    at[s] += k
                    t += k
                if t < steps:
                    ended.append(s)
            tokens += int((y >= 0).sum())
            h = self.window(x, y, fresh, h, sums)
            if ended:
                ended_at_all = True
                h = np.delete(h, ended, axis=0)
                for s in reversed(ended):
                    del streams[s], at[s]
        return tokens

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
        """Trains on a window (steps, streams) from the streams' states h, and returns their new states."""
        grads, used, h = self.gradients(x, y, fresh, h, np.float32(1 / max(1, np.count_nonzero(y >= 0))))
        norm = float(np.sqrt(sum(np.vdot(g, g) for g in grads)))
        if norm > CLIP:
            for g in grads:
                g *= np.float32(CLIP / norm)
        for k, g in enumerate(grads):
            at = used if k == 0 else slice(None)
            squares = g * g
            squares += sums[k][at]
            sums[k][at] = squares
            np.sqrt(squares, out=squares)
            g *= np.float32(RATE)
            g /= squares
            self.w[k][at] -= g
        return h

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, scale: np.float32) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of scale times the summed loss: of each weight (of the first for the words used only), the words used, and the last states."""
        wx, u, b = self.w[:3]
        steps, n = x.shape
        back = self.back()
        # Steps hold a column for each stream.
        inputs = np.ascontiguousarray(wx[x.ravel()].reshape(steps, n, 3 * HIDDEN).transpose(0, 2, 1))
        inputs += b[:, None]
        states, cand = np.empty((steps + 1, HIDDEN, n), np.float32), np.empty((steps, HIDDEN, n), np.float32)
        gated = np.empty((steps, 3 * HIDDEN, n), np.float32)
        states[0] = h.T
        restart = fresh.any(axis=1)
        with np.errstate(over="ignore"):
            for t in range(steps):
                now = np.where(fresh[t], np.float32(0), states[t]) if restart[t] else states[t]
                states[t + 1] = self.advance(inputs[t], now, back, gated[t], cand[t])
        before = states[:-1].copy()
        for t in np.flatnonzero(restart):
            before[t][:, fresh[t]] = 0
        flat, target = states[1:].transpose(0, 2, 1).reshape(-1, HIDDEN), y.ravel()
        rows = np.flatnonzero(target >= 0)
        whole = len(rows) == len(target)
        s, index = (flat, target) if whole else (flat[rows], target[rows])
        ds, out = self.output_gradients(s, index, scale)
        dh_all = ds
        if not whole:
            dh_all = np.zeros_like(flat)
            dh_all[rows] = ds
        dh_all = np.ascontiguousarray(dh_all.reshape(steps, n, HIDDEN).transpose(0, 2, 1))
        z, r, qn = gated[:, :HIDDEN], gated[:, HIDDEN : 2 * HIDDEN], gated[:, 2 * HIDDEN :]
        # What doesn't depend on the gradient that flows back, for all steps at once.
        by_cand, by_z, by_r = (1 - z) * (1 - cand * cand), (before - cand) * z * (1 - z), qn * r * (1 - r)
        dns, dus = np.empty((steps, HIDDEN, n), np.float32), np.empty((steps, 3 * HIDDEN, n), np.float32)
        dh = np.zeros((HIDDEN, n), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += dh_all[t]
            dn, du = dns[t], dus[t]
            np.multiply(dh, by_z[t], out=du[:HIDDEN])
            np.multiply(dh, by_cand[t], out=dn)
            np.multiply(dn, by_r[t], out=du[HIDDEN : 2 * HIDDEN])
            np.multiply(dn, r[t], out=du[2 * HIDDEN :])
            dh *= z[t]
            dh += u @ du
            if restart[t]:
                dh[:, fresh[t]] = 0
        g_u = np.matmul(before, dus.transpose(0, 2, 1)).sum(axis=0)
        dus[:, 2 * HIDDEN :] = dns
        words = x.ravel()
        order = np.argsort(words, kind="stable")
        words = words[order]
        das = dus.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order]
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        first = np.add.reduceat(das, starts, axis=0)
        return [first, g_u, first.sum(axis=0), *out], words[starts], np.ascontiguousarray(states[-1].T)

    def output_gradients(self, s: np.ndarray, index: np.ndarray, scale: np.float32) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradients of the states s for the words index, and of the output weights."""
        _, _, _, wc, bc, wo, bo = self.w
        c = self.v.classes(index)
        order = np.argsort(c, kind="stable")
        c, index = c[order], index[order]
        # With a column of ones, biases are weights; rows of a class are beside each other.
        own = np.ones((len(s), HIDDEN + 1), np.float32)
        own[:, :HIDDEN] = s[order]
        ww = with_bias(wo, bo)
        largest = max(1.0, float(s.max(initial=0)), -float(s.min(initial=0)))
        shift = largest * max(float((np.abs(w) @ ONES[: HIDDEN + 1]).max()) for w in (ww, with_bias(wc.T, bc))) > LARGE
        d = own @ np.concatenate([wc, bc[None]])
        shares(d, scale, shift)
        d[np.arange(len(index)), c] -= scale
        ds = d @ wc.T
        g_c, g_w = (d.T @ own).T, np.zeros_like(ww)
        cut = np.searchsorted(c, np.arange(HEAD_CLASSES + 1)).tolist()
        first = self.v.first.tolist()
        for k in range(HEAD_CLASSES):
            a, b, lo, hi = cut[k], cut[k + 1], first[k], first[k + 1]
            # A band of one word has nothing to learn.
            if b > a and hi - lo > 1:
                part = own[a:b]
                e = part @ ww[lo:hi].T
                shares(e, scale, shift)
                e[np.arange(b - a), index[a:b] - lo] -= scale
                ds[a:b] += e @ wo[lo:hi]
                np.dot(e.T, part, out=g_w[lo:hi])
        out = np.empty_like(ds)
        out[order] = ds
        return out, [g_c[:HIDDEN], g_c[HIDDEN], g_w[:, :HIDDEN], g_w[:, HIDDEN]]

    def log10(self, docs: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of whole documents (word indexes, and counts for the tail's words)."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        h = np.zeros((HIDDEN, len(docs)), np.float32)
        x = np.full(len(docs), HEAD + TAIL)
        table, back = self.w[0] + self.w[2], self.back()
        ys: list[np.ndarray] = []
        hs: list[np.ndarray] = []
        who: list[np.ndarray] = []
        held = 0
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate([docs[i] for i in order])
        tail = np.concatenate([counts[i] for i in order])
        live = len(docs)

        def flush() -> None:
            nonlocal held
            at = np.concatenate(ys)
            p = self.outputs(np.ascontiguousarray(np.concatenate(hs, axis=1).T), flat[at], tail[at])
            out[order] += np.bincount(np.concatenate(who), p, len(out))
            ys.clear(), hs.clear(), who.clear()
            held = 0

        for t in range(int(sizes[0])):
            while sizes[live - 1] <= t:
                live -= 1
            with np.errstate(over="ignore"):
                h = self.advance(table[x[:live]].T, h[:, :live], back)
            at = starts[:live] + t
            ys.append(at)
            hs.append(h)
            who.append(np.arange(live))
            x = flat[at]
            held += live
            if held >= 1 << 14:
                flush()
        if held:
            flush()
        return out / np.log(10)

    def outputs(self, s: np.ndarray, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        _, _, _, wc, bc, wo, bo = self.w
        c = self.v.classes(index)
        p = log_softmax_at(s @ wc + bc, c).astype(np.float64)
        tail = np.flatnonzero(index >= HEAD)
        p[tail] += self.v.tail_log(index[tail], count[tail])
        head = np.flatnonzero(index < HEAD)
        order = head[np.argsort(c[head], kind="stable")]
        cut = np.searchsorted(c[order], np.arange(HEAD_CLASSES + 1))
        own, word, found = s[order], index[order], np.zeros(len(order), np.float32)
        for k in range(HEAD_CLASSES):
            a, b, lo, hi = cut[k], cut[k + 1], self.v.first[k], self.v.first[k + 1]
            if b > a:
                found[a:b] = log_softmax_at(own[a:b] @ wo[lo:hi].T + bo[lo:hi], word[a:b] - lo)
        p[order] += found
        return p


CHUNK = "chunk long, doc_id array<bigint>, size array<int>, words binary, word_keys binary, n binary"


def counter() -> defaultdict[bytes, int]:
    """Numbers words in the order in which they are asked for."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHUNK but for its number, for each CHUNK_BYTES of texts: word numbers, and the words' ascending keys and counts in training."""
    ids: list[int | None] = []
    docs: list[np.ndarray] = []
    numbers = counter()
    held = 0

    def row() -> pa.RecordBatch:
        keys, of = np.unique(np.array([key_of(w) for w in numbers], np.uint64), return_inverse=True)
        flat_, sizes = of[np.concatenate(docs)], [len(d) for d in docs]
        training = np.repeat([fold(i) != 0 for i in ids], sizes)
        n = np.bincount(flat_[training], minlength=len(keys))
        small = np.uint16 if len(keys) <= 1 << 16 else np.uint32
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (pack(flat_.astype(small)), pack_sorted(keys), pack(n.astype(np.uint32))))],
            names=["doc_id", "size", "words", "word_keys", "n"],
        )

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            body = (text or "").encode("utf-8", "replace")
            words = split(body)
            ids.append(i)
            docs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            held += len(body) + 64
            if held >= CHUNK_BYTES:
                yield row()
                ids, docs, numbers, held = [], [], counter(), 0
    if ids:
        yield row()


def send(n: int, route: Route):
    """FRAME: the words' keys and counts, a row of a chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed, counts in zip(*(batch.column(k).to_pylist() for k in ("chunk", "word_keys", "n")), strict=True):
                keys, (c,) = unpack_sorted(packed), unpack(counts)
                cut = split_at(keys, n, 64)
                pieces = [(b, chunk, pack(np.frombuffer(pack_sorted(keys[s:e]), np.uint8), c[s:e])) for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
                yield from route.frames(pieces).to_batches()

    return run


COUNTED = "kind int, node long, blob binary, word_key long, n long, v long"


def total(route: Route):
    """kind 0: FRAME with the counts for the chunks' words; 1: one of the bucket's most frequent words; 2: sums of a tail class."""

    def run(group: pa.Table) -> pa.Table:
        sent = pieces_of(group)
        parts = [unpack(blob) for _, _, blob in sent]
        keys = [unpack_sorted(p[0].tobytes()) for p in parts]
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(of, np.concatenate([p[1] for p in parts]).astype(np.float64), len(distinct)).astype(np.int64)
        kind = np.uint32 if n.max() < 1 << 32 else np.uint64
        stop = np.cumsum([0] + [len(k) for k in keys])
        back = route.frames([(c, b, pack(n[of[x:y]].astype(kind))) for (b, c, _), x, y in zip(sent, stop, stop[1:], strict=False)])
        rows: list[tuple] = [(0, k, blob, 0, 0, 0) for k, blob in zip(back.column("node").to_pylist(), back.column("blob").to_pylist(), strict=True)]
        top = np.lexsort((distinct, -n))[:HEAD]
        rows += [(1, 0, None, int(distinct[i].view(np.int64)), int(n[i]), 0) for i in top if n[i]]
        g = (distinct % np.uint64(TAIL)).astype(np.int64)
        by_n, by_v = np.bincount(g, n.astype(np.float64), TAIL), np.bincount(g, n > 0, TAIL)
        rows += [(2, 0, None, k, int(by_n[k]), int(by_v[k])) for k in range(TAIL)]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({k.split()[0]: pa.array(c, t) for k, c, t in zip(COUNTED.split(", "), zip(*rows, strict=True), types, strict=True)})

    return run


READY = "doc_id array<bigint>, size array<int>, words binary, word_index binary, n binary"


def ready(v: Vocabulary) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """READY: the chunk with each word's index and count."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        out = {k.split()[0]: [] for k in READY.split(", ")}
        answered = pieces_of(answers)
        for r in group.to_pylist():
            index = v.index(unpack_sorted(r["word_keys"])).astype(np.uint16)
            counts = np.concatenate([unpack(blob)[0] for _, _, blob in answered])
            for k, x in zip(out, (r["doc_id"], r["size"], r["words"], pack(index), pack(counts)), strict=True):
                out[k].append(x)
        types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array(x, t) for (k, x), t in zip(out.items(), types, strict=True)})

    return run


def vocabulary(counted: DataFrame) -> Vocabulary:
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for r in counted.where("kind = 2").groupBy("word_key").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tail_n[r["word_key"]], tail_v[r["word_key"]] = r["n"], r["v"]
    top = counted.where("kind = 1").orderBy(F.desc("n"), "word_key").limit(HEAD).select("word_key", "n").collect()
    keys = np.array([r["word_key"] for r in top], np.int64).view(np.uint64)
    return Vocabulary(int(tail_n.sum()), int(tail_v.sum()), keys, np.array([r["n"] for r in top]), tail_n, tail_v)


def flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def shaped(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for w in like:
        out.append(values[at : at + w.size].reshape(w.shape).astype(np.float32))
        at += w.size
    return out


def averaged(sent: DataFrame) -> DataFrame:
    """One row with the mean of weights (n, blob) by tokens, through LEAVES and then 64 groups, so that no task holds more than a few hundred."""

    def mean(key: str):
        def run(group: pa.Table) -> pa.Table:
            total_, n = None, 0
            for blob, k in zip(group.column("blob").to_pylist(), group.column("n").to_pylist(), strict=True):
                x = np.frombuffer(blob, np.float32).astype(np.float64) * k
                total_, n = x if total_ is None else total_ + x, n + k
            return pa.table({key: pa.array([group.column(key)[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "blob": pa.array([(total_ / n).astype(np.float32).tobytes()], pa.binary())})

        return run

    for key, parent in (("leaf", F.col("leaf") % 64), ("leaf", F.lit(0)), ("leaf", None)):
        sent = sent.groupBy(key).applyInArrow(mean(key), f"{key} int, n long, blob binary")
        if parent is not None:
            sent = sent.withColumn(key, parent.cast("int"))
    return sent


def turn_of(doc_id: int) -> int:
    return xxhash.xxh32_intdigest(str(doc_id).encode()) % ROUNDS


def long_first(docs: list[np.ndarray]) -> list[np.ndarray]:
    """So that streams end together."""
    return sorted(docs, key=lambda d: -len(d) if len(d) >= LONG else 0)


def judges(doc_id: int, turn: int, docs: int) -> bool:
    share = max(1 / JUDGES, min(1.0, FEWEST / max(1, docs)))
    return turn_of(doc_id) != turn and xxhash.xxh32_intdigest(str(doc_id).encode(), 9) < share * (1 << 32)


def indexed(r: dict, wanted: Callable[[int], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word indexes, and numbers of words in the chunk, of the training documents of a row of READY that are wanted."""
    words, index = unpack(r["words"])[0], unpack(r["word_index"])[0]
    stop = np.cumsum(r["size"])
    for i, k, e in zip(r["doc_id"], r["size"], stop, strict=True):
        if fold(i) and wanted(i):
            yield index[words[e - k : e]], words[e - k : e]


def trained(chunks: DataFrame, v: Vocabulary) -> list[np.ndarray]:
    """chunks: READY.

    Every round, tasks train on their documents of the round's turn, and weights are averaged.  Documents of other turns judge how far
    to go towards the average: not at all where it makes them less likely, further than it where many tasks with few documents
    each made small steps.  So a split into more tasks doesn't make the model worse than untrained.
    """
    sc = chunks.sparkSession.sparkContext
    weights = v.start_weights()
    docs = chunks.agg(F.sum(F.size("doc_id"))).first()[0] or 0
    for turn in range(ROUNDS):
        shared = sc.broadcast((flat(weights), v))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            values, v = shared.value
            net = Network([w.copy() for w in shaped(values, v.start_weights())], v)

            def read() -> Iterator[np.ndarray]:
                held: list[np.ndarray] = []
                n = 0
                for batch in batches:
                    for r in batch.to_pylist():
                        held += [d for d, _ in indexed(r, lambda i: turn_of(i) == turn)]
                        n += sum(r["size"])
                        if n >= HELD:
                            yield from long_first(held)
                            held, n = [], 0
                yield from long_first(held)

            n = net.train(read())
            if n:
                leaf = xxhash.xxh32_intdigest(net.w[1].tobytes()) % LEAVES
                yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([n], pa.int64()), pa.array([flat(net.w).astype(np.float32).tobytes()], pa.binary())], names=["leaf", "n", "blob"])

        found = averaged(chunks.mapInArrow(run, "leaf int, n long, blob binary")).collect()
        if found:
            mean = np.frombuffer(found[0]["blob"], np.float32)
            weights = shaped(reached(flat(weights), mean, judged(chunks, v, flat(weights), mean, turn, docs)), weights)
        shared.unpersist()
    return weights


def reached(old: np.ndarray, mean: np.ndarray, reach: float) -> np.ndarray:
    return old + np.float32(reach) * (mean - old)


def row_of(doc_id: pa.Scalar, size: pa.Scalar, words: pa.Scalar, word_index: pa.Scalar, n: pa.Scalar) -> dict:
    return {"doc_id": doc_id.as_py(), "size": size.as_py(), "words": words.as_py(), "word_index": word_index.as_py(), "n": n.as_py()}


def judged(chunks: DataFrame, v: Vocabulary, old: np.ndarray, mean: np.ndarray, turn: int, docs: int) -> float:
    """The REACH at which judging documents are likeliest, the smallest of equals: one row a task, and sums of those, to the driver."""
    shared = chunks.sparkSession.sparkContext.broadcast((old, mean, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, mean, v = shared.value
        nets = [Network(shaped(reached(old, mean, x), v.start_weights()), v) for x in REACH]
        sums = np.zeros(len(REACH))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def judge() -> np.ndarray:
            return np.array([net.log10([d for d, _ in held], [n for _, n in held]).sum() for net in nets])

        size = 0
        for batch in batches:
            for r in map(row_of, *batch.columns):
                n = unpack(r["n"])[0].astype(np.float64)
                for d, w in indexed(r, lambda i: judges(i, turn, docs)):
                    held.append((d.astype(np.int64), n[w]))
                    size += len(d)
                if size >= BESIDE:
                    sums += judge()
                    held, size = [], 0
        if held:
            sums += judge()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in sums], names=[f"r{k}" for k in range(len(REACH))])

    total_ = chunks.select("doc_id", "size", "words", "word_index", "n").mapInArrow(run, ", ".join(f"r{k} double" for k in range(len(REACH))))
    row = total_.agg(*[F.sum(f"r{k}") for k in range(len(REACH))]).first()
    return max(zip(REACH, row, strict=True), key=lambda x: (-np.inf if x[1] is None or not np.isfinite(x[1]) else x[1], -x[0]))[0]


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def results(net: Network, v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT of the documents of rows of READY, those of BESIDE tokens or more at a time."""
    held: list[tuple] = []
    size = 0

    def rows() -> pa.RecordBatch:
        ids = [i for h in held for i in h[0]]
        sizes, known, base = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        scores = net.log10([d for h in held for d in h[4]], [c for h in held for c in h[5]])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([not fold(i) if i is not None else True for i in ids]), pa.array(sizes, pa.int64()), pa.array(known),
                pa.array(np.full(len(ids), v.total, np.int64)), pa.array(base), pa.array(scores),
            ],
            names=[k.split()[0] for k in RESULT.split(", ")],
        )

    for batch in batches:
        for r in map(row_of, *batch.columns):
            words = unpack(r["words"])[0]
            index, n = unpack(r["word_index"])[0].astype(np.int64), unpack(r["n"])[0].astype(np.float64)
            stop = np.cumsum(r["size"])
            first = stop - r["size"]
            sums = lambda x: np.add.reduceat(x[words], first)  # noqa: E731, B023
            flat_, counts = index[words], n[words]
            cut = list(zip(first, stop, strict=True))
            held.append((r["doc_id"], r["size"], sums((n > 0).astype(np.int64)), sums(np.log10((n + SMOOTH) / (v.total + SMOOTH * (v.distinct + 1)))), [flat_[x:y] for x, y in cut], [counts[x:y] for x, y in cut]))
            size += len(words)
            if size >= BESIDE:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def score(docs: DataFrame) -> DataFrame:
    """RESULT of every row; columns doc_id and text are read."""
    spark = docs.sparkSession
    unnumbered = CHUNK.split(", ", 1)[1]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(numbered, unnumbered)
    # Numbered once and written, so that the numbers stay.
    chunks = materialise(rows.select(F.monotonically_increasing_id().alias("chunk"), "*"))
    n = max(1, chunks.count())
    route = Route(n)
    counted = materialise(route.forward(chunks.select("chunk", "word_keys", "n").mapInArrow(send(n, route), FRAME)).groupBy("node").applyInArrow(total(route), COUNTED))
    v = vocabulary(counted)
    answers = route.forward(counted.where("kind = 0").select("node", "blob"))
    chunks = materialise(chunks.groupBy("chunk").cogroup(answers.groupBy("node")).applyInArrow(ready(v), READY))
    shared = spark.sparkContext.broadcast((flat(trained(chunks, v)), v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, v = shared.value
        net = Network(shaped(values, v.start_weights()), v)
        yield from results(net, v, batches)

    return chunks.select("doc_id", "size", "words", "word_index", "n").mapInArrow(run, RESULT)


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
