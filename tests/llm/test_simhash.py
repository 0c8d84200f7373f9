"""SimHash near-duplicates against brute force."""

import pytest
import xxhash

from tessera.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root long"
BASE = " ".join(f"word{i % 61}x{i}" for i in range(300))


def plain(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", -1) for r in rows], SCHEMA)


def found(spark, rows):
    out = simhash.near(table(spark, rows)).collect()
    return sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in out), key=str)


def test_defined_cases(spark):
    words = BASE.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(5, 300, 9)]
    rows = [(7, BASE), (3, BASE.upper()), (3, BASE), (None, BASE), (None, "alone here"), (9, None), (8, ""), (12, " \t\n"), (20, "one"), (21, "ONE"), (22, "two words"), (23, "a b c"), (24, "é\x00ß 中文 x"), (25, "\x1fa\x85b\xa0c d e f")]
    rows += [(100 + k, t) for k, t in enumerate(near)]
    assert found(spark, rows) == brute(rows)


def test_all_documents_of_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(spark, rows) == brute(rows)


def test_every_pair_within_the_radius_meets(spark):
    base = 0x0123456789ABCDEF
    fps = {base, base ^ 1, base ^ 3, base ^ 7, base ^ (1 << 63), 0, 5, 1 << 40 | 1 << 41 | 1 << 42}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    roots = {f: f for f in signed}
    for _ in fps:
        for r in links:
            low = min(roots[r["a"]], roots[r["b"]])
            roots = {k: low if v in (roots[r["a"]], roots[r["b"]]) else v for k, v in roots.items()}
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert all(apart(r["a"], r["b"]) <= 2 and r["a"] < r["b"] for r in links)
    assert all(roots[a] == roots[b] for a in signed for b in signed if apart(a, b) <= 2)
    assert len({*roots.values()}) == 3


def test_links_stay_in_proportion(spark):
    # All fingerprints within one bit of zero share it as a variant; in each of its 65 variants one links with the next only.
    signed = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(64)]
    assert simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).count() <= 65 * len(signed)


def test_pieces_don_t_change_a_fingerprint(monkeypatch):
    text = (BASE + " ÄÖ\t" + BASE[::-1]).encode()
    whole = simhash.fingerprint(text)
    assert whole & (1 << 64) - 1 == plain(text.decode())
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == whole
        assert simhash.fingerprint(b"  two  words ") & (1 << 64) - 1 == plain("two words")


def test_empty_table(spark):
    assert simhash.near(table(spark, [])).collect() == []


@pytest.mark.parametrize("rows", [[(1, "a b c d")], [(2, None)], [(None, None)]])
def test_single_rows(spark, rows):
    assert found(spark, rows) == brute(rows)
