"""Hybrid search of benchmark texts over the chunks of all documents, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import lexicon as lx
from tessera.functions import scoring
from tessera.operators import search as s
from tessera.plans.common import table
from tessera.plans.text_queries import CHUNK_SQL, MATCH, document_chunks

listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in sorted(xs)) + "]"
STEM = "CASE WHEN length(w) >= 10 THEN left(w, 9) WHEN length(w) >= 7 THEN left(w, 7) WHEN length(w) >= 5 THEN left(w, 5) ELSE w END"
FOUND = "(contains(doc, w) OR (length(w) > 2 AND (contains(compact, w) OR contains(compact, left(w, 3)))) OR (length(w) > 3 AND contains(doc, left(w, 4))))"


def proximity_sql(doc: str) -> str:
    at = f"list_filter([CASE WHEN contains({doc}, {STEM}) THEN instr({doc}, {STEM}) WHEN length(w) > 3 THEN instr({doc}, w) ELSE 0 END FOR w IN core IF length(w) > 2], lambda p: p > 0)"
    n, used = f"len({at})", "len([w FOR w IN core IF length(w) > 2])"
    span = f"(list_max({at}) - list_min({at}))"
    return f"(CASE WHEN {used} = 0 OR {n} < least(2, {used}) THEN 0.0 WHEN {span} <= {lx.SPAN} THEN 40.0 + 12.0 * {n} WHEN {span} <= {3 * lx.SPAN} THEN 22.0 ELSE 0.0 END)"


def phrase_sql(doc: str) -> str:
    longest = f"coalesce(list_max([length(x) FOR x IN wordings IF contains({doc}, x)]), -50)"
    kind = f"len([w FOR w IN core IF w NOT IN ('виды', 'вид') AND contains({doc}, {STEM})]) > 0 AND (contains({doc}, 'виды') OR contains({doc}, 'вид ')) AND len(core) > 1"
    return (
        f"greatest(0.0, 50.0 + least({longest}, 40), CASE WHEN len(core) > 1 AND regexp_matches({doc}, '(?s)' || array_to_string(core, '.*?')) THEN 45.0 ELSE 0.0 END,"
        f" CASE WHEN len(spoken) > 1 AND regexp_matches({doc}, '(?s)' || array_to_string(list_concat([CASE WHEN length(x) = 2 THEN x || '.' ELSE x END FOR x IN spoken[:-2]], [spoken[-1]]), '.*?')) THEN 55.0 ELSE 0.0 END, {proximity_sql(doc)}, CASE WHEN {kind} THEN 52.0 ELSE 0.0 END)"
    )


SEARCH_SQL = CHUNK_SQL + f""", docs AS (SELECT file_id, chunk_index, {MATCH.format('text')} AS doc, list_distinct([w FOR w IN regexp_extract_all(lower(text), '{s.TOKENS}') IF length(w) > 1]) AS held FROM chunks),
q0 AS (SELECT item_id AS query_id, coalesce(text, '') AS question, regexp_extract_all(lower(coalesce(text, '')), '{s.TOKENS}') AS words FROM benchmark),
q1 AS (SELECT *, [w FOR w IN words IF length(w) > 1 AND NOT list_contains({listed(lx.STOP | lx.ASKING)}, w)] AS known FROM q0),
q2 AS (SELECT *, CASE WHEN len([w FOR w IN known IF length(w) > 2]) > 0 THEN [w FOR w IN known IF length(w) > 2] ELSE known END AS core, list_distinct([w FOR w IN words IF length(w) > 1]) AS asked, {MATCH.format('question')} AS wording FROM q1),
q AS (SELECT query_id, wording, words, asked, core, [{STEM} FOR w IN words IF length(w) > 1 AND NOT list_contains({listed(lx.STOP)}, w)] AS spoken,
 [x FOR x IN list_distinct(list_concat([wording], flatten([[CASE WHEN i + n <= len(words) THEN array_to_string(words[i + 1:i + n], ' ') END FOR n IN range(2, 10)] FOR i IN range(0, len(words) + 1)]),
  CASE WHEN len(core) > 1 THEN [array_to_string(core, ' '), array_to_string(core[greatest(1, len(core) - 1):], ' '), array_to_string(core[greatest(1, len(core) - 2):], ' ')] ELSE [] END)) IF x IS NOT NULL AND length(x) > 7] AS wordings FROM q2),
held AS (SELECT file_id, chunk_index, unnest(held) AS word FROM docs), often AS (SELECT word, count(*) AS often FROM held GROUP BY word),
rare AS (SELECT query_id, word FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY often, word) AS n FROM (SELECT query_id, unnest(asked) AS word FROM q) JOIN often USING (word)) WHERE n <= {s.RARE}),
pairs AS (SELECT DISTINCT query_id, file_id, chunk_index FROM held JOIN rare USING (word)),
meant AS (SELECT query_id, file_id, chunk_index, round(len(list_intersect(asked, held)) / sqrt(CAST(len(asked) * len(held) AS DOUBLE)), 9) AS semantic FROM pairs JOIN docs USING (file_id, chunk_index) JOIN q USING (query_id)),
most AS (SELECT least(count(*), greatest({s.RETRIEVED}, least({s.MOST}, count(*) // 6))) AS most FROM docs),
near AS (SELECT query_id, file_id, chunk_index, semantic FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, file_id, chunk_index) AS n FROM meant) WHERE n <= (SELECT most FROM most)),
exact AS (SELECT query_id, file_id, chunk_index, CAST({s.AS_IS} AS DOUBLE) AS semantic FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY chunk_index) AS n FROM pairs JOIN docs USING (file_id, chunk_index) JOIN q USING (query_id) WHERE length(wording) > 7 AND contains(doc, wording)) WHERE n <= {s.WORDINGS}),
cand AS (SELECT query_id, file_id, chunk_index, max(semantic) AS semantic FROM (SELECT * FROM near UNION ALL SELECT * FROM exact) GROUP BY ALL),
worded AS (SELECT query_id, file_id, chunk_index, semantic, doc, coalesce(list_sum([CASE WHEN length(w) > 2 AND list_contains(core, w) THEN 5.0 ELSE 3.0 END FOR w IN asked IF {FOUND}]), 0.0) AS words_score
 FROM (SELECT *, replace(doc, ' ', '') AS compact FROM cand JOIN docs USING (file_id, chunk_index) JOIN q USING (query_id))),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words_score DESC, file_id, chunk_index) AS n FROM worded) WHERE n <= {s.SEEDS}),
beside AS (SELECT DISTINCT query_id, file_id, chunk_index + unnest([-1, 1]) AS chunk_index FROM seeds),
every AS (SELECT * FROM worded UNION ALL SELECT query_id, file_id, chunk_index, CAST({s.BESIDE} AS DOUBLE), doc, 0.0 FROM beside b JOIN docs USING (file_id, chunk_index) WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id = b.query_id AND c.file_id = b.file_id AND c.chunk_index = b.chunk_index)),
beyond AS (SELECT e.*, replace(e.doc, ' ', '') AS compact, {MATCH.format("concat_ws(' ', e.doc, nullif(a.doc, ''), nullif(b.doc, ''))")} AS merged, q.core, q.spoken, q.wordings FROM every e JOIN q USING (query_id)
 LEFT JOIN every a ON a.query_id = e.query_id AND a.file_id = e.file_id AND a.chunk_index = e.chunk_index - 1 LEFT JOIN every b ON b.query_id = e.query_id AND b.file_id = e.file_id AND b.chunk_index = e.chunk_index + 1),
f1 AS (SELECT query_id, file_id, chunk_index, semantic, words_score, CAST(len(core) AS INT) AS n_core, CAST(len([w FOR w IN core IF {FOUND}]) AS INT) AS core_matches, len([w FOR w IN core IF length(w) > 2 AND contains(doc, {STEM})]) AS stem_matches,
 CAST({proximity_sql('merged')} AS DOUBLE) AS stem, CAST(greatest({phrase_sql('doc')}, {phrase_sql('merged')}) AS DOUBLE) AS phrase FROM beyond),
f2 AS (SELECT *, CAST(5.0 * core_matches + {scoring.PHRASE_BONUS} + least(words_score, 12.0) AS DOUBLE) AS keyword FROM f1),
f3 AS (SELECT * REPLACE (greatest(phrase, stem) AS phrase), round({scoring.combined()}, 9) AS score FROM f2),
hits AS (SELECT *, file_id || '_' || chunk_index AS id FROM f3),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, file_id, chunk_index) AS by_meaning, row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, file_id, chunk_index) AS by_words, phrase >= 20 OR stem >= 28 AS strong, n_core > 0 AND core_matches >= n_core AS whole FROM hits),
r2 AS (SELECT *, round(1.0 / (60 + by_meaning) + 1.0 / (60 + by_words), 12) AS rrf, bool_or(strong) OVER (PARTITION BY query_id) AS any_strong FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, phrase DESC, stem DESC, stem_matches DESC, whole DESC, core_matches DESC, score DESC, rrf DESC, file_id, chunk_index) AS base,
 CASE WHEN by_meaning <= {max(s.FRONT, s.SHOWN)} THEN 0 WHEN CASE WHEN any_strong THEN strong ELSE n_core >= 2 AND whole END THEN 1 ELSE 2 END AS tier FROM r2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 0 THEN by_meaning END, CASE WHEN tier = 1 AND NOT any_strong THEN phrase END DESC, CASE WHEN tier = 1 AND NOT any_strong THEN score END DESC, base) AS place FROM r3),
p1 AS (SELECT *, {scoring.POOLED} AS ok, place <= {max(3 * s.SHOWN, 12)} AND (core_matches >= 1 OR keyword >= 2 OR semantic >= {scoring.SEMANTIC_FLOOR}) AS weak, (SELECT count(DISTINCT file_id) FROM docs) AS files FROM ranked),
p2 AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY query_id) AS n_ok, count(*) FILTER (WHERE weak) OVER (PARTITION BY query_id) AS n_weak FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM p2 WHERE CASE WHEN n_ok > 0 THEN ok WHEN n_weak > 0 THEN weak ELSE place <= greatest({2 * s.SHOWN}, 3 * files) END),
p4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, phrase DESC, stem DESC, core_matches DESC, keyword DESC, score DESC, rrf DESC, place) AS position FROM p3 WHERE n <= greatest({5 * s.SHOWN}, 8 * files, {s.MOST // 3})),
pooled AS (SELECT * FROM p4 WHERE position <= {s.SHOWN}),
s1 AS (SELECT *, greatest(0.1, max(CASE WHEN position = 1 THEN score END) OVER (PARTITION BY query_id) * {s.CITED}) AS least_score FROM pooled),
s2 AS (SELECT *, {s.RELEVANT} AS good, {s.WEAK} AS soft FROM s1),
s3 AS (SELECT *, count(*) FILTER (WHERE good) OVER (PARTITION BY query_id) AS n_good, count(*) FILTER (WHERE soft) OVER (PARTITION BY query_id) AS n_soft FROM s2),
selected AS (SELECT * FROM s3 WHERE CASE WHEN n_good > 0 THEN good WHEN n_soft > 0 THEN soft ELSE position <= 3 END)
"""


def asked(spark, sf_dir):
    return s.prepared_questions(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))


def passages(spark, sf_dir):
    return s.prepared_chunks(document_chunks(spark, sf_dir))


SCORES = "query_id, file_id, chunk_index, round(semantic, 6) AS semantic, round(phrase, 6) AS phrase, round(stem, 6) AS stem, CAST(stem_matches AS INT) AS stem_matches, core_matches, round(keyword, 6) AS keyword, round(score, 6) AS score"


@query("search_features", SEARCH_SQL + f" SELECT {SCORES} FROM hits")
def search_features(spark, sf_dir):
    """All scores of every candidate of every benchmark text, phrases with their neighbours among candidates."""
    return s.hits(asked(spark, sf_dir), passages(spark, sf_dir)).selectExpr("query_id", "file_id", "chunk_index", "round(semantic, 6) AS semantic", "round(phrase, 6) AS phrase", "round(stem, 6) AS stem", "stem_matches", "core_matches", "round(keyword, 6) AS keyword", "round(score, 6) AS score")


@query("hybrid_search", SEARCH_SQL + " SELECT query_id, file_id, chunk_index, CAST(position AS INT) AS position, round(score, 6) AS score FROM selected")
def hybrid_search(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return s.search(questions, document_chunks(spark, sf_dir)).select("query_id", "file_id", "chunk_index", "position", F.round("score", 6).alias("score"))
