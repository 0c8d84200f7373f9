"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from tessera.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    # All that differ by an edit: those with a deletion in common are candidates.
    cut = {}
    for w in n:
        for d in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            cut.setdefault(d, set()).add(w)
    others = {w: set() for w in n}
    for group in cut.values():
        for a in group:
            others[a] |= {b for b in group if near(a, b)}
    form = {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(others[w]), n.get(form[w])) for w in n)


def found(docs):
    out = spelling.variants(docs)
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", -1) for r in rows], SCHEMA)


def test_all_documents_of_small_tables(spark):
    for sf in ("0.001", "0.01"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert found(docs) == want and sum(w[1] is not None for w in want) > 10


def test_words_of_few_letters(spark):
    """Repeated bigrams, many near words and long chains of forms."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 8))) for _ in range(80)]
        rows.append((i, " ".join(words)))
    rows += [(1000 + k, " ".join([w] * (3 * 2**k))) for k, w in enumerate(("xanana", "xanann", "xanbnn", "xacbnn", "xacbnnq"))]
    assert found(table(spark, rows)) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, "Café café CAFÉ ÀBCDE àbcde ×÷ýþÿ×÷ýþÿ"), (1, "Café café CAFÉ ÀBCDE àbcde ×÷ýþÿ×÷ýþÿ"), (None, "hello hello-hello, HELLO"), (None, None), (2, ""), (3, "中hello中hellp中hellp\x00hellp"), (4, "abcd " * 9)]
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, [])) == []
    assert found(table(spark, [(1, None)])) == []


def test_pieces_don_t_change_counts(monkeypatch):
    text = "Über straße, naïve " * 40 + "x" * 300
    whole = spelling.runs(text)
    monkeypatch.setattr(spelling, "PIECE", 3)
    assert spelling.runs(text) == whole


def test_held_words_are_flushed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = sorted(spelling.vocabulary(docs).collect())
    spelling.HELD, old = 10, spelling.HELD
    try:
        assert sorted(spelling.vocabulary(docs).collect()) == whole
    finally:
        spelling.HELD = old


def test_pieces_are_not_broadcast(spark):
    """Each word gives up to twelve rows of the join, which the size of the words' file doesn't tell."""
    docs = table(spark, [(i, "hello hellp hello hello " * 3) for i in range(9)])
    words = spelling.materialise(spelling.vocabulary(docs))
    for d in (spelling.near_pairs(words), spelling.variants(docs)):
        assert "BroadcastExchange" not in d._jdf.queryExecution().executedPlan().toString()
