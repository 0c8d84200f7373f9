"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a SentencePiece model file span a lattice over the text.  Their scores are log probabilities: those of the
file if it is a unigram model; the file of a BPE model has merge ranks instead, from which Zipf's law gives a piece of rank
r the probability 1 / (r H), H the sum of all 1 / r.  So nothing is trained, ids are those of the file, and a segmentation
is the likeliest under these probabilities, not the one that merges in order of rank would make.  A forward Viterbi pass gives every
position the best score of a path to it; a backward A-star search from the end takes those scores as its heuristic,
which is exact, so hypotheses come out in order of their full score.  As no piece crosses the start of a word, a text's
lattice falls into segments, each solved once for all its occurrences (up to CACHE at a time); the text's N best
segmentations are merged from those of the segments whose second path costs least.

Characters that no piece covers fall back to byte pieces, each at UNKNOWN below the lowest score.

Defined cases: a null text counts as empty; an empty text has no pieces and scores 0; text is never normalised, so that
decoding gives back the text; lone surrogates become "?"; equal texts get equal values; paths of equal score are taken
in order of their last piece, the longer first; rows repeat as given; an empty table gives an empty result; ``encoded``
passes all columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
CACHE = 50_000
N_BEST = 3
#: Characters of the piece table; segments with others are solved one by one.
DENSE = 192
#: Texts and characters that are solved together.
GROUP, GROUP_CHARS = 256, 1 << 19
SPACE = "▁"
#: Piece types, fixed by the format.
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


#: Model types, fixed by the format.
UNIGRAM, BPE = 1, 2


def zipf(scores: list[float], types: list[int]) -> list[float]:
    """ln(1 / (r H)) for the usable pieces, r their rank by falling score, then by id."""
    ranked = sorted((i for i, t in enumerate(types) if t in (NORMAL, USER)), key=lambda i: (-scores[i], i))
    whole = math.log(math.fsum(1 / r for r in range(1, len(ranked) + 1)) or 1.0)
    out = list(scores)
    for r, i in enumerate(ranked, 1):
        out[i] = -math.log(r) - whole
    return out


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    p = 0

    def varint() -> int:
        nonlocal p
        v = s = 0
        while True:
            c = b[p]
            p += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while p < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, b[p : p + n]
            p += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, b[p : p + n]
            p += n


class Pieces:
    def __init__(self, data: bytes) -> None:
        """data: a model file's bytes."""
        self.names: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        kind = UNIGRAM
        for k, v in fields(data):
            if k == 1:
                d = dict(fields(v))
                self.names.append(d.get(1, b"").decode())
                scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.types.append(d.get(3, NORMAL))
            elif k == 2:
                kind = dict(fields(v)).get(3, UNIGRAM)
        if kind != UNIGRAM:
            scores = zipf(scores, self.types)
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        self.ids = {self.names[i]: (i, scores[i]) for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {int(self.names[i][3:5], 16): i for i, t in enumerate(self.types) if t == BYTE}
        self.byte_score = min((scores[i] for i in usable), default=0.0) - UNKNOWN
        self.raw = [
            bytes([int(n[3:5], 16)]) if t == BYTE else (n.replace(SPACE, " ").encode() if t in (NORMAL, USER) else b"")
            for n, t in zip(self.names, self.types, strict=True)
        ]
        #: A piece with a word's start inside would cross segments; then texts are one segment each.
        crosses = any(re.search(f"[^{SPACE}]{SPACE}", n) for n in self.ids)
        joined = {c for n in self.ids if len(n) > 1 for c in n}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        one = f"[{re.escape(alone)}]|" if alone else ""
        self.segments = re.compile("[\\s\\S]+") if crosses else re.compile(f"{one}{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+")

        self._trie()

    def _trie(self) -> None:
        """The pieces as a table of states over the DENSE characters that most of them use; 0 is dead, 1 the root."""
        uses = Counter(c for n in self.ids for c in n)
        dense = [c for c, _ in sorted(uses.items(), key=lambda x: (-x[1], x[0])) if c in self.ids][:DENSE]
        self.code = np.zeros(0x110000, np.int32)
        for i, c in enumerate(dense):
            self.code[ord(c)] = i + 1
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, str] = {}
        for name in self.ids:
            at = 1
            for c in name:
                k = int(self.code[ord(c)])
                if not k:
                    break
                at = steps.setdefault((at, k), len(steps) + 2)
            else:
                ends[at] = name
        n = len(steps) + 2
        self.steps = np.zeros((n, len(dense) + 1), np.int32)
        for (a, k), b in steps.items():
            self.steps[a, k] = b
        self.end_score, self.end_id = np.full(n, -np.inf), np.zeros(n, np.int32)
        for at, name in ends.items():
            self.end_id[at], self.end_score[at] = self.ids[name]

    def viterbi_many(self, segments: list[str]) -> Iterator[tuple[str, bytes, float, float]]:
        """(segment, ids, score, gap) of each: the forward pass over all segments of a length at once."""
        by_size: dict[int, list[str]] = defaultdict(list)
        for s in segments:
            by_size[len(s)].append(s)
        for n, some in by_size.items():
            if n > 32:
                yield from map(self._alone, some)
                continue
            codes = self.code[np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)].reshape(-1, n)
            known = codes.all(axis=1)
            if not known.all():
                yield from map(self._alone, (s for s, k in zip(some, known, strict=True) if not k))
                some, codes = [s for s, k in zip(some, known, strict=True) if k], codes[known]
            if some:
                yield from self._together(some, np.ascontiguousarray(codes.T), n)

    def _alone(self, s: str) -> tuple[str, bytes, float, float]:
        forward, ids, gap = self.viterbi(s)
        return s, array("i", ids).tobytes(), forward[-1], gap

    def _together(self, some: list[str], codes: np.ndarray, n: int) -> Iterator[tuple[str, bytes, float, float]]:
        rows = len(some)
        best, second = np.full((n + 1, rows), -np.inf), np.full((n + 1, rows), -np.inf)
        start, piece = np.zeros((n + 1, rows), np.int32), np.zeros((n + 1, rows), np.int32)
        best[0] = 0.0
        for a in range(n):
            state = np.ones(rows, np.int32)
            for e in range(a, min(n, a + self.longest)):
                state = self.steps[state, codes[e]]
                if not state.any():
                    break
                w = self.end_score[state]
                x, b = best[a] + w, best[e + 1]
                better = x > b
                second[e + 1] = np.maximum(np.maximum(second[e + 1], np.minimum(x, b)), second[a] + w)
                best[e + 1] = np.maximum(x, b)
                start[e + 1][better] = a
                piece[e + 1][better] = self.end_id[state[better]]
        path = np.full((n, rows), -1, np.int32)
        at, every = np.full(rows, n), np.arange(rows)
        for k in range(n - 1, -1, -1):
            live = every[at > 0]
            if not len(live):
                break
            path[k, live] = piece[at[live], live]
            at[live] = start[at[live], live]
        path = path.T
        stops = np.cumsum((path >= 0).sum(axis=1)) * 4
        flat = path[path >= 0].tobytes()
        with np.errstate(invalid="ignore"):
            gaps = (best[n] - second[n]).tolist()
        at = 0
        for s, stop, score, gap in zip(some, stops.tolist(), best[n].tolist(), gaps, strict=True):
            yield s, flat[at:stop], score, gap
            at = stop

    def edges(self, s: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of what ends at a position, the longest first."""
        get, out = self.ids.get, []
        for a in range(max(0, end - self.longest), end):
            e = get(s[a:end])
            if e is not None:
                out.append((a, e[1], (e[0],)))
        if s[end - 1] not in self.ids:
            raw = s[end - 1].encode("utf-8", "replace")
            out.append((end - 1, self.byte_score * len(raw), tuple(self.byte_ids.get(x, 0) for x in raw)))
        return out

    def viterbi(self, s: str) -> tuple[list[float], list[int], float]:
        """Best score at each position, the ids of the best path, and what the second-best path costs more."""
        get, longest = self.ids.get, self.longest
        low = float("-inf")
        n = len(s)
        best, second, back = [0.0] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        for end in range(1, n + 1):
            b = c = low
            how = None
            for a in range(end - longest if end > longest else 0, end):
                e = get(s[a:end])
                if e is not None:
                    w = e[1]
                    x = best[a] + w
                    if x > b:
                        y, b, how = b, x, (a, e[0])
                        if y > c:
                            c = y
                    elif x > c:
                        c = x
                    x = second[a] + w
                    if x > c:
                        c = x
            if how is None or s[end - 1] not in self.ids:
                raw = s[end - 1].encode("utf-8", "replace")
                w = self.byte_score * len(raw)
                x = best[end - 1] + w
                if x > b:
                    y, b, how = b, x, (end - 1, -1)
                    c = max(c, y)
                else:
                    c = max(c, x)
                c = max(c, second[end - 1] + w)
            best[end], second[end], back[end] = b, c, how
        ids: list[int] = []
        at = n
        while at:
            a, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.byte_ids.get(x, 0) for x in reversed(s[at - 1].encode("utf-8", "replace")))
            at = a
        ids.reverse()
        return best, ids, best[n] - second[n]

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n segmentations of a segment by A-star from its end: (score, ids), the best first."""
        if not s:
            return [(0.0, ())]
        forward = self.viterbi(s)[0]
        known: dict[int, list] = {}
        agenda: list = [(-forward[len(s)], 0, len(s), 0.0, None)]
        made, out = 1, []
        while agenda and len(out) < n:
            f, _, at, suffix, tail = heapq.heappop(agenda)
            if not at:
                ids: list[int] = []
                while tail is not None:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((-f, tuple(ids)))
                continue
            if at not in known:
                known[at] = self.edges(s, at)
            for a, score, ids in known[at]:
                heapq.heappush(agenda, (-(forward[a] + score + suffix), made, a, score + suffix, (ids, tail)))
                made += 1
        return out


class Encoder:
    def __init__(self, data: bytes) -> None:
        self.pieces = Pieces(data)
        self.cache: dict[str | None, tuple[bytes, float, float]] = {}
        self.ranked: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def segments(self, text: str) -> list[str | None]:
        """A segment None stands for the space mark itself in the text."""
        if not text:
            return []
        find, parts = self.pieces.segments.findall, text.split(SPACE)
        out: list[str | None] = find(SPACE + parts[0].replace(" ", SPACE))
        for p in parts[1:]:
            out.append(None)
            out += find(p.replace(" ", SPACE))
        return out

    def solved(self, s: str | None) -> tuple[bytes, float, float]:
        if s is None:
            raw = SPACE.encode()
            return array("i", [self.pieces.byte_ids.get(x, 0) for x in raw]).tobytes(), self.pieces.byte_score * len(raw), math.inf
        return self.pieces._alone(s)[1:]

    def options(self, s: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a segment: what each costs more than the first, none or less, and its ids."""
        if (s, n) not in self.ranked:
            if len(self.ranked) >= CACHE // 4:
                self.ranked.clear()
            found = self.pieces.n_best(s, n)
            self.ranked[s, n] = [(score - found[0][0], array("i", ids).tobytes()) for score, ids in found]
        return self.ranked[s, n]

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """Scores and ids (32-bit) of the n best segmentations, the best first."""
        return self.encode_many([text], n)[0]

    def encode_many(self, texts: list[str], n: int = N_BEST) -> list[list[tuple[float, bytes]]]:
        cache, out = self.cache, []
        if len(cache) > CACHE:
            cache.clear()
        split = [self.segments(t) for t in texts]
        new = {s for some in split for s in some if s not in cache}
        if None in new:
            new.discard(None)
            cache[None] = self.solved(None)
        for s, ids, score, gap in self.pieces.viterbi_many(list(new)):
            cache[s] = (ids, score, gap)
        for segments in split:
            parts = [cache[s] for s in segments]
            if not parts:
                out.append([(0.0, b"")])
                continue
            ids, scores, gaps = zip(*parts, strict=True)
            total, whole = math.fsum(scores), b"".join(ids)
            #: (what it costs more, ((segment, its path), ..)) of the best so far; segments not named take their first path.
            sums: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]
            if n > 1:
                # No path of the n best uses a segment whose second path costs more than n - 1 others' do.
                limit = heapq.nsmallest(n - 1, gaps)[-1]
                near = [i for i, g in enumerate(gaps) if g <= limit and g < math.inf]
                if len(near) >= n:
                    near = heapq.nsmallest(n - 1, near, key=gaps.__getitem__)
                for i in near:
                    options = self.options(segments[i], n)
                    sums = heapq.nlargest(n, ((a + b, (*way, (i, path)) if k else way) for a, way in sums for k, (b, path) in enumerate(options)), key=lambda x: x[0])
            starts = [0, *accumulate(map(len, ids))] if len(sums) > 1 else []
            found = []
            for cost, way in sums:
                pieces, at = [], 0
                for i, path in sorted(way):
                    pieces += (whole[at : starts[i]], path)
                    at = starts[i + 1]
                found.append((total + cost, b"".join([*pieces, whole[at:]]) if way else whole))
            out.append(found)
        return out

    def decode(self, ids: bytes) -> str:
        raw = self.pieces.raw
        text = b"".join([raw[i] for i in memoryview(ids).cast("i")]).decode("utf-8", "replace")
        return text[1:]


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The worker's encoder of a model file."""
    key = hashlib.sha256(data).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def model_file(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The one file at path, wherever Spark reads it, for all executors."""
    return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def clean(text: str | None) -> str:
    return (text or "").encode("utf-8", "replace").decode("utf-8")


def encoded(docs: DataFrame, path: str = MODEL, n: int = N_BEST) -> DataFrame:
    """The documents, all columns, with pieces (ids of the best segmentation), n_best (ids of the others, up to n - 1, by falling score) and scores (of all).

    Columns of these names in the input stay, and the new ones get underscores.
    """
    names = [fresh(docs, c) for c in ("pieces", "n_best", "scores")]
    ids_type = T.ArrayType(T.IntegerType())
    types = [ids_type, T.ArrayType(ids_type), T.ArrayType(T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, types)])
    at = docs.columns.index("text")
    model = model_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for part, texts in parts_of(batches, at):
            found = e.encode_many(texts, n)
            best, others = (ids_array([x[1] for f in found for x in f[a:b]]) for a, b in ((0, 1), (1, n)))
            ends = np.cumsum([0] + [len(f) - 1 for f in found]).astype(np.int32)
            scores = pa.array([[x[0] for x in f] for f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, best, pa.ListArray.from_arrays(pa.array(ends), others), scores], names=schema.names)

    return docs.mapInArrow(run, schema)


def parts_of(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of up to GROUP rows and about GROUP_CHARS characters, and their texts, so that what a task holds doesn't follow the batch."""
    for batch in batches:
        start = held = 0
        texts: list[str] = []
        for k in range(len(batch)):
            texts.append(clean(batch.column(at)[k].as_py()))
            held += len(texts[-1])
            if len(texts) >= GROUP or held >= GROUP_CHARS:
                yield batch.slice(start, len(texts)), texts
                start, held, texts = k + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def ids_array(rows: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit ids from their bytes."""
    ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


RESULT = "n_chars long, n_pieces long, pieces_sha256 string, scores array<double>, n_best_sha256 array<string>, decoded_sha256 string, round_trip boolean"


def digests(e: Encoder, clear: list[str]) -> list[tuple]:
    """RESULT of each text; round_trip: every segmentation of the n best decodes to the text."""
    out = []
    for s, found in zip(clear, e.encode_many(clear), strict=True):
        back = [e.decode(ids) for _, ids in found]
        names = [hashlib.sha256(ids).hexdigest() for _, ids in found]
        out.append((len(s), len(found[0][1]) // 4, names[0], [round(x, 4) for x, _ in found], names, hashlib.sha256(back[0].encode()).hexdigest(), all(b == s for b in back)))
    return out


def op4_sentencepiece(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = model_file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string(), pa.bool_()]
        names = ["doc_id", *(x.split()[0] for x in RESULT.split(", "))]
        for part, texts in parts_of(batches, 1):
            cols = zip(*digests(e, texts), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, {RESULT}")
