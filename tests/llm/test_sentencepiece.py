import random

import pytest

from tessera.llm import sentencepiece_lattice
from tessera.llm.sentencepiece_lattice import MODEL, SPACE, digests, encoded


def encoder():
    with open(MODEL, "rb") as f:
        return sentencepiece_lattice.encoder(f.read())


def every(pieces, s):
    out = []

    def go(i, ids, score):
        if i == len(s):
            out.append((score, tuple(ids)))
            return
        for j in range(i + 1, min(len(s), i + pieces.longest) + 1):
            hit = pieces.ids.get(s[i:j])
            if hit:
                go(j, [*ids, hit[0]], score + hit[1])
        if s[i] not in pieces.ids:
            raw = s[i].encode()
            go(i + 1, [*ids, *(pieces.byte_ids[x] for x in raw)], score + pieces.byte_score * len(raw))

    go(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("word", ["▁hello", "▁thereé", "▁a\n", "日本▁x", "▁▁the", "abc🎉d", "x"])
def test_n_best_is_exact(word):
    p = encoder().pieces
    want = every(p, word)
    assert [round(x[0], 3) for x in p.n_best(word, 6)] == [round(x[0], 3) for x in want[:6]]
    forward, ids, gap = p.viterbi(word)
    assert forward[-1] == pytest.approx(want[0][0])
    if len(want) > 1:
        assert gap == pytest.approx(want[0][0] - want[1][0])


def test_batches_agree_with_single_words():
    p, rng = encoder().pieces, random.Random(3)
    words = ["▁" + "".join(rng.choice("aeéthnrößx🎉") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for w, ids, score, gap in p.viterbi_many(words):
        alone = p._alone(w)
        assert alone[1] == ids and alone[2] == pytest.approx(score) and (alone[3] == gap or alone[3] == pytest.approx(gap))


@pytest.mark.parametrize("text", ["ab c", "a  b", "x é", "the cat"])
def test_texts_merge_their_segments(text):
    e = encoder()
    want = every(e.pieces, SPACE + text.replace(" ", SPACE))
    found = e.encode(text, 4)
    assert [round(x, 3) for x, _ in found] == [round(x[0], 3) for x in want[:4]]
    # Ties may come in either order.
    scores = {ids: round(x, 3) for x, ids in want}
    paths = [tuple(memoryview(ids).cast("i")) for _, ids in found]
    assert len(set(paths)) == len(paths) and [scores[p] for p in paths] == [round(x, 3) for x, _ in found]


def test_whole_words_are_likelier_than_their_parts():
    e = encoder()
    names = lambda text: [e.pieces.names[i] for i in memoryview(e.encode(text)[0][1]).cast("i")]
    assert names("The organizations of the world") == ["▁The", "▁organizations", "▁of", "▁the", "▁world"]
    total = sum(2.718281828459045**s for _, s in e.pieces.ids.values())
    assert total == pytest.approx(1)


def test_decoding_gives_back_the_text():
    e, rng = encoder(), random.Random(5)
    texts = ["", " ", "  a ", "\n\n", "a\tb", "▁x ▁", "é🎉", "\x00\x7f", "word " * 3000]
    texts += ["".join(rng.choice("ab é▁\n日🎉.") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for t, found in zip(texts, e.encode_many(texts), strict=True):
        assert all(e.decode(ids) == t for _, ids in found)
        assert [x for x, _ in found] == sorted((x for x, _ in found), reverse=True)
    assert all(r[-1] for r in digests(e, texts))


def test_columns_pass_through(spark, monkeypatch):
    docs = [(1, None, "a"), (1, "hi there", "b"), (1, "hi there", "b")] + [(k, f"text {k} é " * k, None) for k in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string, pieces string")
    out = encoded(d)
    assert out.columns == ["doc_id", "text", "pieces", "pieces_", "n_best", "scores"]
    rows = out.collect()
    assert sorted((r.doc_id, r.text or "", r.pieces or "") for r in rows) == sorted((i, t or "", p or "") for i, t, p in docs)
    e = encoder()
    import array

    for r in rows:
        found = [r.pieces_, *r.n_best]
        assert len(found) == len(r.scores)
        assert all(e.decode(array.array("i", x).tobytes()) == (r.text or "") for x in found)
    assert encoded(d.limit(0)).collect() == []


def test_slices_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sentencepiece_lattice, "GROUP", 3)
    monkeypatch.setattr(sentencepiece_lattice, "GROUP_CHARS", 10)
    texts = ["a", "b", "c", "d", "x" * 50, None, "", "e" * 10, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(sentencepiece_lattice.parts_of(iter([batch]), 1))
    assert [t for _, some in parts for t in some] == [t or "" for t in texts]
    assert [len(p) for p, _ in parts] == [3, 2, 3, 1] and all(len(p) == len(t) for p, t in parts)
