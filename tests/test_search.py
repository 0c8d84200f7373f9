"""Hybrid search on stated questions and hits: neighbours over gaps, fallbacks."""

from tessera.operators import search as s

FILLER = " ".join(f"слово{i}" for i in range(30))
CHUNKS = [
    ("a", 0, "Срок подачи заявок на участие"), ("a", 1, "в аукционе не менее 15 дней"), ("a", 3, "дней рабочих с даты размещения извещения"), ("b", 0, FILLER), ("b", 1, "Виды служебной информации: открытая"), ("c", 0, "premium"), ("c", 1, FILLER + " конец"),
]


def test_questions_find_their_passages(spark):
    chunks = spark.createDataFrame(CHUNKS, "file_id string, chunk_index int, text string")
    asked = [(1, "Какой срок подачи заявок при аукционе"), (2, "Виды служебной информации"), (3, "premium"), (4, ""), (5, None), (6, "чего тут нет")]
    out = s.search(spark.createDataFrame(asked, "query_id int, question string"), chunks).collect()
    first = {r.query_id: (r.file_id, r.chunk_index) for r in out if r.position == 1}
    assert first == {1: ("a", 0), 2: ("b", 1), 3: ("c", 0)}


def test_phrases_run_over_a_chunk_s_end_but_not_over_a_gap(spark):
    chunks = s.prepared_chunks(spark.createDataFrame(CHUNKS, "file_id string, chunk_index int, text string"))
    q = s.prepared_questions(spark.createDataFrame([(1, "участие в аукционе"), (2, "не менее 15 дней дней рабочих с даты размещения извещения")], "query_id int, question string"))
    got = {(r.query_id, r.file_id, r.chunk_index): r.phrase for r in s.hits(q, chunks).collect()}
    assert got[1, "a", 0] == 50.0 + len("участие в аукционе")
    # Chunk 2 is missing: what stands in 1 and 3 doesn't make a phrase.
    assert got[2, "a", 1] < 90.0


HIT = dict(file_id="f", core_matches=0, n_core=3, semantic=0.0, keyword=0.0, phrase=0.0, stem=0.0, stem_matches=0, score=0.0)


def made(spark, rows):
    rows = [{**HIT, "chunk_index": i, "id": f"f_{i}", **r} for i, r in enumerate(rows)]
    names = [*HIT, "chunk_index", "id", "query_id"]
    schema = "file_id string, core_matches int, n_core int, semantic double, keyword double, phrase double, stem double, stem_matches int, score double, chunk_index int, id string, query_id int"
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def test_fallbacks(spark):
    rows = [dict(query_id=1, semantic=0.5), dict(query_id=1, keyword=2.5)]
    rows += [dict(query_id=2, keyword=2.5, score=0.01)] + [dict(query_id=2) for _ in range(3)]
    rows += [dict(query_id=3, score=0.01 * k) for k in range(40)]
    pool = s.pooled(s.ranked(made(spark, rows)), files=1).collect()
    size = {k: sum(r.query_id == k for r in pool) for k in (1, 2, 3)}
    assert size == {1: 1, 2: 1, 3: 8}
    out = s.selected(s.pooled(s.ranked(made(spark, rows)), files=1)).collect()
    assert {k: sum(r.query_id == k for r in out) for k in (1, 2, 3)} == {1: 1, 2: 1, 3: 3}
