import hashlib
import random

import numpy as np
import pytest

from tessera.llm.suffix_dedup import LENGTH, dedup
from tessera.llm.suffix_sort import COVER, PERIOD, SuffixSorter, covers


def brute(docs):
    first = {}
    for key, _, b in sorted(((i if i is not None else 1 << 62, n, b) for n, (i, b) in enumerate(docs)), key=lambda x: x[0]):
        for i in range(len(b) - LENGTH + 1):
            first.setdefault(b[i : i + LENGTH], key)
    out = []
    for i, b in docs:
        key = i if i is not None else 1 << 62
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - LENGTH + 1):
            if first[b[k : k + LENGTH]] < key:
                gone[k : k + LENGTH] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(seed, alphabet="abcdefgh ", n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [text(rng.choice((30, 49, 50, 51, 75, 200))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randint(0, 120)) for _ in range(rng.randint(0, 5))]
        docs.append((i * 3 % 101, "".join(parts)))
    docs += [(5, docs[7][1]), (200, docs[3][1]), (None, docs[4][1]), (None, None), (7, ""), (300, "x" * 500), (301, "x" * 500), (302, "é" * 60), (303, "ü" + "é" * 60)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs = make(seed, "ab" if seed == 1 else "abcdefgh ")
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, bucket string").repartition(3)
    got = [tuple(r) for r in dedup(d).collect()]
    want = brute([(i, (t or "").encode()) for i, t in docs])
    assert sorted(got, key=str) == want


def test_many_chunks_and_pieces(spark, monkeypatch):
    from tessera.llm import exchange, suffix_dedup

    monkeypatch.setattr(exchange, "CHUNK_BYTES", 1500)
    docs = make(9)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in dedup(d).collect()]
    assert sorted(got, key=str) == brute([(i, (t or "").encode()) for i, t in docs])
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4)
    for hot in (2, 5, 1000):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert sorted(map(tuple, run_local(docs)), key=str) == brute([(i, (t or "").encode()) for i, t in docs])
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    assert sorted(map(tuple, run_local(docs)), key=str) == brute([(i, (t or "").encode()) for i, t in docs])


def run_local(docs):
    """The stages in this process, so that settings hold."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from tessera.llm import suffix_dedup as s

    groups = {}
    for k, (i, t) in enumerate(docs):
        groups.setdefault(k % 3, []).append((i, t))
    tables = {
        c: pa.table({"chunk": pa.array([c] * len(g), pa.int64()), "doc_id": pa.array([(1 << 63) - 1 if i is None else i for i, _ in g], pa.int64()), "no_id": [i is None for i, _ in g], "body": pa.array([(t or "").encode() for _, t in g], pa.binary())})
        for c, g in groups.items()
    }
    n, route = 2, s.Route(3)

    def regroup(results):
        whole = pa.concat_tables(results)
        return {k: whole.filter(pc.equal(whole.column("node"), k)) for k in set(whole.column("node").to_pylist())}

    shared = regroup([s.answer_spread(route)(g) for g in regroup([s.send_hashes(n, route)(t) for t in tables.values()]).values()])
    none = route.frames([])
    low = regroup([route.frames(s.answer_contexts(s.pieces_of(g))) for g in regroup([s.send_contexts(n, route)(t, shared.get(c, none)) for c, t in tables.items()]).values()])
    return [tuple(r.values()) for c, t in tables.items() for r in s.finish(False)(t, shared.get(c, none), low.get(c, none)).to_pylist()]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert dedup(d).collect() == []


@pytest.mark.parametrize("text", [b"", b"a", b"a" * 300, b"ab" * 150, bytes(np.random.default_rng(1).integers(0, 3, 2000, np.uint8)), b"mississippi" * 30])
def test_suffix_order(text):
    assert covers(COVER, PERIOD)
    sorter = SuffixSorter(np.frombuffer(text, np.uint8))
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert sorter.sort(np.arange(len(text))).tolist() == want
    bucket = [i for i in range(len(text)) if text[i : i + 1] == text[:1]]
    assert sorter.sort(np.array(bucket, np.int64)).tolist() == sorted(bucket, key=lambda i: text[i:])
