import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.exchange import Route, chunks_of, pack, pack_sorted
from tessera.llm.jaccard_join import band_edges, groups_of, joined, keys_of, may_link, plan, representatives, sketch


def brute(docs):
    sets = []
    for _, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def make(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    base = [text(rng.choice((3, 5, 6, 7, 9, 12, 20, 40, 120))) for _ in range(14)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25) + 1)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [rng.choice(words)] if rng.random() < 0.7 else []
        docs.append((i * 7 % 1009, rng.choice((" ", "\n", "\t ")).join(w)))
    docs += [(2000, None), (2001, ""), (2002, " \n"), (None, docs[0][1]), (3, docs[1][1].upper()), (5000, "solo"), (5001, "solo"), (5002, "other")]
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    docs = make(seed)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, set_id int").repartition(3)
    assert sorted(map(tuple, joined(d).collect()), key=str) == brute(docs)


def test_empty(spark):
    assert joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_linked_sets_meet():
    """Whatever the larger of two linked sets looks up finds the other, also where shingles are common."""
    rng = np.random.default_rng(4)
    edges = band_edges(2000)
    segments = plan(edges)
    for size in (4, 5, 7, 8, 12, 20, 33, 80, 300, 1500):
        for _ in range(6):
            a = np.unique(rng.integers(1, 1 << 48, size, dtype=np.uint64))
            out = rng.integers(0, len(a) // 4 + 1)
            both = len(a) - out
            extra = max(0, int(both / 0.75) - len(a))
            b = np.unique(np.concatenate([a[out:], rng.integers(1, 1 << 48, extra, dtype=np.uint64)]))
            if 100 * both < 75 * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue
            assert may_link(sketch(a), len(a), sketch(b), len(b))
            a, b = sorted((a, b), key=len)
            bands = [int(np.searchsorted(edges, len(x), side="right")) - 1 for x in (a, b)]
            found = []
            for x, band in zip((a, b), bands):
                often = rng.integers(1, 9, len(x)).astype(np.uint8)
                found.append(keys_of([x], [often], np.array([len(x)]), segments[bands[1]], bands[1], band == bands[1]))
            (ka, _, ta), (kb, _, tb) = found
            exact = np.isin(kb[tb == 2], ka).any()
            deleted = np.isin(kb[tb == 3], ka[(ta & 1) == 0]).any()
            assert exact or deleted
            table = pa.table({"node": pa.array([0, 0], pa.int64()), "blob": pa.array([frame(k, t, i) for i, (k, _, t) in enumerate(found)], pa.binary())})
            assert groups_of(table).column("members").to_pylist()[:1] == [[0, 1]]


def frame(keys, kinds, node):
    order = np.argsort(keys, kind="stable")
    blob = pack(np.frombuffer(pack_sorted(keys[order]), np.uint8), np.zeros(len(keys), np.uint8), np.array([node]), kinds[order])
    return Route(1).frames([(0, node, blob)]).column("blob")[0].as_py()


def test_sets_far_apart_are_ruled_out():
    rng = np.random.default_rng(1)
    for size in (50, 400, 5000):
        a, b = (np.unique(rng.integers(1, 1 << 48, size, dtype=np.uint64)) for _ in range(2))
        assert not may_link(sketch(a), len(a), sketch(b), len(b))
        assert not may_link(sketch(a), len(a), sketch(a[: size // 2]), size // 2)


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_groups_in_blocks(spark, block, monkeypatch):
    """Every pair of a group that may link and lies in two components comes up, once."""
    from tessera.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(1, 1 << 48, 90, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(1, 1 << 48, int(rng.choice([0, 3, 9, 200])), dtype=np.uint64)])) for _ in range(14)]
    root = [i // 2 * 2 for i in range(14)]
    table = spark.createDataFrame([(i, len(x), bytearray(sketch(x))) for i, x in enumerate(sets)], "node long, size long, sketch binary")
    groups = spark.createDataFrame([(1, list(range(9))), (2, [0, 1]), (3, [5, 9, 13])], "name long, members array<long>")
    roots = spark.createDataFrame(list(enumerate(root)), "node long, root long")
    got = sorted(map(tuple, jaccard_join.apart(groups, roots, table).collect()))
    ask = lambda a, b: root[a] != root[b] and may_link(sketch(sets[a]), len(sets[a]), sketch(sets[b]), len(sets[b]))
    want = {(a, b) for g in (range(9), (0, 1), (5, 9, 13)) for a in g for b in g if a < b and ask(a, b)}
    assert want and got == sorted(want)


def test_representatives_pass_clashing_columns(spark):
    names = ["doc_id", "text", "set_id", "gone_id", "node", "root", "least"]
    docs = [(i, t, 1, i, 2, 3, 4) for i, t in make(0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, set_id int, gone_id long, node int, root int, least int")
    out = representatives(d)
    assert out.columns == names
    rows = out.collect()
    want = {i for i, _, c in brute([x[:2] for x in docs]) if i == c}
    assert {r.doc_id for r in rows if r.doc_id is not None} == want and all(r.gone_id == r.doc_id for r in rows)
    assert representatives(d.limit(0)).collect() == []


@pytest.mark.parametrize("radix", [2, 3])
def test_pieces_find_their_way(spark, radix, monkeypatch):
    """Also over several hops, where no task deals out to more than radix nodes."""
    from tessera.llm import exchange, jaccard_join

    monkeypatch.setattr(exchange, "RADIX", radix)
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 900)
    monkeypatch.setattr(jaccard_join, "BUCKET_KEYS", 300)
    assert Route(100).digit <= radix and Route(100).hops > 2
    docs = make(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert chunks_of(d)[1] > radix
    assert sorted(map(tuple, joined(d).collect()), key=str) == brute(docs)


def test_representatives_tell_rows_of_one_doc_id_apart(spark):
    one, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(3, one, "x"), (5, one, "x"), (5, other, "x"), (5, other, "y"), (5, other, "y"), (6, third, "x"), (6, third + " more", "x"), (7, None, "x"), (7, None, "x"), (None, one, "x")]
    out = sorted(map(tuple, representatives(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()), key=str)
    assert [r for r in out if r[0] in (3, 5, 7)] == [(3, one, "x"), (5, other, "x"), (5, other, "y"), (7, None, "x")]
    assert len([r for r in out if r[0] == 6]) == 1 and (None, one, "x") in out


def bucket(seed, senders=6, each=40_000):
    from tessera.llm.exchange import pack, pack_sorted

    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 1 << 48, each, dtype=np.uint64)
    rows = []
    for sender in range(senders):
        keys = np.sort(np.concatenate([shared[rng.random(each) < 0.1], rng.integers(0, 1 << 48, each, dtype=np.uint64)]))
        used, number = np.unique(rng.integers(0, 900, len(keys)), return_inverse=True)
        piece = pack(np.frombuffer(pack_sorted(keys), np.uint8), number.astype(np.uint16), used + 1000 * sender, rng.integers(0, 4, len(keys)).astype(np.uint8))
        rows += Route(1).frames([(0, sender, piece)]).to_batches()
    return pa.Table.from_batches(rows)


def test_groups_take_a_range_of_keys_at_a_time(monkeypatch):
    """The same groups in many ranges, and memory beside the pieces that doesn't grow with the bucket."""
    import tracemalloc

    from tessera.llm import jaccard_join

    some = bucket(1)
    whole = groups_of(some)
    monkeypatch.setattr(jaccard_join, "TOGETHER_KEYS", 5000)
    assert len(whole) > 2000 and groups_of(some).equals(whole.combine_chunks()) and len(np.unique(whole.column("name"))) == len(whole)
    tracemalloc.start()
    try:
        groups_of(some)
        assert tracemalloc.get_traced_memory()[1] < 30 * 6 * 44_000
    finally:
        tracemalloc.stop()
