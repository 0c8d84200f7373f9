import random

import corpus_pipeline
from tessera.llm.sentencepiece_lattice import MODEL, encoder


def make(spark, folder):
    rng = random.Random(12)
    common = "the of and to in that was for on with as by at from".split()
    word = lambda: rng.choice(common) if rng.random() < 0.6 else "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 7)))
    docs = [(i, " ".join(word() for _ in range(120)), "en", f"s{i % 4}", 0) for i in range(80)]
    docs += [(100 + i, docs[i][1] if i % 2 else docs[i][1] + " added", "en", "s0", 0) for i in range(10)]
    docs += [(200 + i, " ".join(f"{rng.random():.5f}!!" for _ in range(120)), "en", "s1", 0) for i in range(5)]
    docs += [(300, docs[30][1][::-1] + " mail a.b@c.org now", "en", "s0", 0), (301, "", "en", "s0", 0), (302, None, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return d


def test_stages(spark, tmp_path, monkeypatch):
    from tessera.llm import kneser_ney

    monkeypatch.setattr(kneser_ney, "TRAIN_DOCS", 40)
    folder = str(tmp_path)
    docs = make(spark, folder)
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        kept[k] = docs.collect()
    ids = [[r.doc_id for r in kept[k]] for k in range(5)]
    assert not {200, 201, 202, 203, 204} & set(ids[0]) and set(range(80)) <= set(ids[0])
    assert not set(range(100, 110)) & set(ids[1]) and set(range(80)) <= set(ids[1]) and len(ids[1]) == len(set(ids[1]))
    assert sorted(ids[2]) == sorted(ids[1])
    for r in kept[2]:
        if r.doc_id == 300:
            assert r.text.endswith("mail [EMAIL] now") and r.n_chars == len(r.text)
    texts = {r.doc_id: r.text for r in kept[2]}
    sizes = {s: sum(len((t or "").split()) for i, t in texts.items() if i < 300 and i % 4 == k) for k, s in enumerate(("s0", "s1", "s2", "s3"))}
    taken = {s: sum(len(r.text.split()) for r in kept[3] if r.source == s) for s in sizes}
    assert taken["s0"] > sizes["s0"] > taken["s2"] and taken["s0"] > taken["s1"]
    with open(MODEL, "rb") as f:
        e = encoder(f.read())
    import array

    assert len(kept[4]) == len(kept[3])
    for r in kept[4]:
        assert e.decode(array.array("i", r.pieces).tobytes()) == texts[r.doc_id]


def test_run(spark, tmp_path):
    make(spark, str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
