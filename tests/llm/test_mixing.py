import numpy as np
import pytest

from tessera.llm import mixing
from tessera.llm.mixing import BLOCK, draws, mix, packed, permute, repeated, targets


def test_targets():
    assert targets([10, 1000, 5], [5, 2, 1], 1015) == [30.0, pytest.approx(970.0), 15.0]
    assert targets([0, 0], [5, 2], 0) == [0.0, 0.0]
    assert targets([], [], 0) == []
    got = targets([100, 100, 100, 100], [5, 2, 1, 5], 400)
    assert sum(got) == pytest.approx(400) and got[0] == got[3]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4096])
def test_permutation(n):
    keys = [permute(np.arange(n), np.full(n, n), np.full(n, k)).tolist() for k in (1, 2)]
    assert sorted(keys[0]) == sorted(keys[1]) == list(range(n))
    assert n < 7 or keys[0] != keys[1]


def make(spark, parts):
    docs = [(i, ("a", "b", "c", None)[i % 4], "w " * (i * 37 % 400), "x") for i in range(900)] + [(5, "a", None, "x"), (6, "a", "w w", "x"), (None, "b", "w " * 50, "x")]
    return spark.createDataFrame(docs, "doc_id long, source string, text string, size string").repartition(parts)


def test_mix(spark):
    rows = mix(make(spark, 3)).collect()
    assert len(rows) == 903 and sorted(map(str, rows)) == sorted(map(str, mix(make(spark, 5)).collect()))
    for source in {r.source_size for r in rows}:
        some = [r for r in rows if r.source_size == source]
        assert abs(sum(r.taken for r in some) - some[0].target) <= BLOCK
        assert sum(r.size for r in some) == source
    assert all(r.taken <= 3 * r.size for r in rows)
    total = sum({r.source_size: r.target for r in rows}.values())
    assert total == pytest.approx(sum(r.size for r in rows))


def test_whole_documents(spark):
    d = make(spark, 3)
    out = repeated(d)
    assert out.columns == d.columns
    want = {r.source_size: r.target for r in mix(d).collect()}
    assert out.count() > 0 and abs(sum(len((r.text or "").split()) for r in out.collect()) / sum(want.values()) - 1) < 0.1


def test_nothing_to_mix(spark):
    d = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.taken, r.target) for r in mix(d).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
    assert mix(d.limit(0)).collect() == []


def test_draws_are_multinomial_within_the_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 100)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 4)
    quota = [500, 300, 0, 217]
    rows = [r.asDict() for r in draws(spark, quota).collect()]
    by = {}
    for r in rows:
        by.setdefault(r["shard"], {})[r["source_id"]] = r["n"]
    assert [sum(x.get(i, 0) for x in by.values()) for i in range(4)] == quota
    sizes = [sum(x.values()) for x in by.values()]
    assert max(sizes) == 100 and len(sizes) >= 11
    shares = [x.get(0, 0) / sum(x.values()) for x in by.values() if sum(x.values()) == 100]
    assert len(set(shares)) > 2 and abs(np.mean(shares) - 500 / 1017) < 0.1
    for i in range(4):
        slots = sorted(k for r in rows if r["source_id"] == i for k in range(r["first"], r["first"] + r["n"]))
        assert slots == list(range(quota[i]))


def brute(docs):
    """taken by doc, from the blocks that the shards hold."""
    from collections import Counter

    held = Counter()
    for r in packed(docs).collect():
        held.update((r.source, w) for w in r.words)
    return held


def test_shards_hold_what_is_taken(spark, monkeypatch):
    """Every word of the mix, counted in the shards' blocks, against the documents' takes."""
    monkeypatch.setattr(mixing, "SHARD", 64)
    docs = [(i, "abc"[i % 3], " ".join(f"d{i}" for _ in range(i * 37 % 200)), 1) for i in range(150)] + [(None, "a", "null null", 1), (900, None, "none " * 40, 2)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, shard int")
    held = brute(d)
    rows = mix(d).collect()
    names = {None: "null", 900: "none"}
    for r in rows:
        if r.size:
            assert held[r.source, names.get(r.doc_id, f"d{r.doc_id}")] == r.taken
    out = packed(d).collect()
    assert len({(r.shard, r.place) for r in out}) == len(out) and len({r.shard for r in out}) > 3
    assert max(len(r.words) for r in out) == BLOCK
    per_shard = {s: sum(r.shard == s for r in out) for s in {r.shard for r in out}}
    assert max(per_shard.values()) == 64 and sorted(per_shard.values())[1] == 64
    assert packed(d.limit(0)).collect() == []


def test_rows_without_a_number_and_repeats_stay(spark):
    docs = [(None, "a", "x " * 30, 1, 2, "t"), (None, "a", "y " * 30, 1, 2, "t"), (7, "a", "z " * 20, 3, 4, "t"), (7, "a", "q " * 20, 3, 4, "t"), (8, "b", "w " * 900, 5, 6, "t")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, turn int, times int, m_id string")
    out = repeated(d)
    assert out.columns == d.columns
    rows = out.collect()
    # Source a is to get three times its size.
    assert sorted(r.text[0] for r in rows if r.source == "a") == sorted("xyzq" * 3)
    assert all((r.turn, r.times, r.m_id) == next(x[3:] for x in docs if x[2] == r.text) for r in rows)


def broadcasts(df):
    """The broadcasts of a plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_blocks_of_documents_are_not_broadcast(spark):
    """A small file may hold few documents of very many blocks; the only small side is the table of sources."""
    docs = spark.createDataFrame([(i, "a", "w " * 3000) for i in range(50)], "doc_id long, source string, text string")
    assert broadcasts(mix(docs)) == 1
    assert broadcasts(packed(docs)) == 2
