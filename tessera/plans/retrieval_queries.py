"""Queries over hits: nearest neighbours, fusion, ranking, selection, context, citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import scoring
from tessera.operators import index
from tessera.operators import retrieval as r
from tessera.plans.common import scratch, table

EVERY = 20
SIM_SQL = f"""q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % {EVERY} = 0),
sim AS (SELECT query_id, v.vec_id AS id, label AS file_id, round(greatest(0.0, list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[]))), 9) AS semantic FROM q, embeddings v)"""
#: Stand-ins for word evidence, from the ids.
FEATURES = {
    "keyword": "CAST((id * 7 + query_id) % 20 AS DOUBLE)", "core_matches": "CAST((id + query_id) % 4 AS INT)", "n_core": "CAST(3 AS INT)",
    "phrase": "CAST((id * 13) % 24 AS DOUBLE)", "stem": "CAST((id * 11) % 31 AS DOUBLE)",
}
HITS_SQL = "WITH " + SIM_SQL + ", hits AS (SELECT query_id, id, file_id, semantic, " + ", ".join(f"{v} AS {k}" for k, v in FEATURES.items()) + " FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, id) AS rank FROM sim) WHERE rank <= 40)"
SCORED_SQL = HITS_SQL + f", scored AS (SELECT *, {scoring.combined()} AS score FROM hits)"
FUSED_SQL = SCORED_SQL + """, ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, id) AS rank_semantic, row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, id) AS rank_keyword FROM scored),
fused AS (SELECT *, 1.0 / (60 + rank_semantic) + 1.0 / (60 + rank_keyword) AS rrf FROM ranks)"""
RANKED_SQL = FUSED_SQL + f""", base AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {scoring.RANK_ORDER}) AS base_rank, phrase >= 20 OR stem >= 28 AS strong,
 max(CASE WHEN phrase >= 20 OR stem >= 28 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_strong FROM fused),
tiers AS (SELECT *, CASE WHEN rank_semantic <= 8 THEN 0 WHEN CASE WHEN any_strong = 1 THEN strong ELSE n_core >= 2 AND core_matches >= n_core END THEN 1 ELSE 2 END AS tier FROM base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 0 THEN CAST(rank_semantic AS DOUBLE) WHEN tier = 1 AND any_strong = 0 THEN -phrase * 1000 - score ELSE CAST(base_rank AS DOUBLE) END, base_rank) AS place FROM tiers)"""


def stated(spark, sf_dir):
    """The rows whose number is divisible by EVERY, against all rows."""
    return table(spark, sf_dir, "embeddings").where(f"vec_id % {EVERY} = 0").selectExpr("vec_id AS query_id", "embedding")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "label AS file_id", "embedding")


def hits(spark, sf_dir):
    d = r.nearest(vectors(spark, sf_dir), stated(spark, sf_dir), 40)
    return d.select("query_id", "id", "file_id", "semantic", *[F.expr(v).alias(k) for k, v in FEATURES.items()])


@query("knn_topk", "WITH " + SIM_SQL + " SELECT query_id, id, semantic, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, id) AS rank FROM sim) WHERE rank <= 10")
def knn_topk(spark, sf_dir):
    return r.nearest(vectors(spark, sf_dir), stated(spark, sf_dir), 10).select("query_id", "id", "semantic", "rank")


@query("knn_index")
def knn_index(spark, sf_dir):
    """The ten nearest by inverted lists of all vectors."""
    path = scratch(spark, "lists")
    c = index.build(vectors(spark, sf_dir), path)
    return index.probed(stated(spark, sf_dir), path, c, 10)


@query("knn_index_recall", f"SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % {EVERY} = 0")
def knn_index_recall(spark, sf_dir):
    """Whether the lists find nine of ten exact neighbours or more."""
    return index.recall(knn_index(spark, sf_dir), r.nearest(vectors(spark, sf_dir), stated(spark, sf_dir), 10)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("knn_per_group", "WITH " + SIM_SQL + " SELECT query_id, file_id, id, semantic, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY semantic DESC, id) AS rank FROM sim) WHERE rank <= 3")
def knn_per_group(spark, sf_dir):
    return r.nearest(vectors(spark, sf_dir), stated(spark, sf_dir), 3, per_file=True).select("query_id", "file_id", "id", "semantic", "rank")


@query("semantic_max_merge", "WITH " + SIM_SQL + " SELECT id, max(semantic) AS best, min(query_id) FILTER (WHERE semantic >= 0.42) AS first_query FROM sim GROUP BY id")
def semantic_max_merge(spark, sf_dir):
    return r.best_of_queries(vectors(spark, sf_dir), stated(spark, sf_dir), 0.42)


@query("combined_score_grid", "SELECT l_orderkey, l_linenumber, round(" + scoring.combined() + ", 6) AS score FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS semantic, l_quantity / 2.5 AS keyword, CAST(l_linenumber AS INT) AS core_matches, CAST(5 AS INT) AS n_core, l_tax * 1000 AS phrase FROM lineitem)")
def combined_score_grid(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount * 10 AS semantic", "l_quantity / 2.5 AS keyword", "CAST(l_linenumber AS INT) AS core_matches", "5 AS n_core", "l_tax * 1000 AS phrase")
    return d.select("l_orderkey", "l_linenumber", F.round(F.expr(scoring.combined()), 6).alias("score"))


@query("phrase_bonus", HITS_SQL + f" SELECT query_id, id, CAST({scoring.PHRASE_BONUS} AS DOUBLE) AS bonus FROM hits")
def phrase_bonus(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "id", F.expr(scoring.PHRASE_BONUS).cast("double").alias("bonus"))


@query("rrf_fusion", FUSED_SQL + " SELECT query_id, id, round(rrf, 9) AS rrf, CAST(rank_semantic AS INT) AS rank_semantic, CAST(rank_keyword AS INT) AS rank_keyword FROM fused")
def rrf_fusion(spark, sf_dir):
    return r.fused(hits(spark, sf_dir)).select("query_id", "id", F.round("rrf", 9).alias("rrf"), "rank_semantic", "rank_keyword")


@query("ranked_hits", RANKED_SQL + " SELECT query_id, id, CAST(tier AS INT) AS tier, CAST(place AS INT) AS place, round(score, 6) AS score FROM ranked")
def ranked_hits(spark, sf_dir):
    return r.ranked(hits(spark, sf_dir)).select("query_id", "id", "tier", "place", F.round("score", 6).alias("score"))


@query("pool_filter", RANKED_SQL + f" SELECT query_id, id, CAST(place AS INT) AS place FROM ranked WHERE {scoring.POOLED} AND place <= 40")
def pool_filter(spark, sf_dir):
    return r.ranked(hits(spark, sf_dir)).where(F.expr(scoring.POOLED) & (F.col("place") <= 40)).select("query_id", "id", "place")


@query("relevance_select", RANKED_SQL + f" SELECT query_id, id FROM ranked WHERE {scoring.RELEVANT}")
def relevance_select(spark, sf_dir):
    return r.ranked(hits(spark, sf_dir)).where(F.expr(scoring.RELEVANT)).select("query_id", "id")


@query(
    "balanced_topk",
    RANKED_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY phrase DESC, core_matches DESC, score DESC, place) AS in_file FROM ranked),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN in_file <= 2 THEN 0 ELSE 1 END, CASE WHEN in_file <= 2 THEN file_id END NULLS FIRST, CASE WHEN in_file <= 2 THEN in_file END NULLS FIRST, place) AS pick FROM f)
SELECT query_id, id, file_id, CAST(pick AS INT) AS pick FROM p WHERE pick <= 12""",
)
def balanced_topk(spark, sf_dir):
    return r.balanced(r.ranked(hits(spark, sf_dir)), 12, 10).select("query_id", "id", "file_id", "pick")


@query("best_per_file", RANKED_SQL + " SELECT query_id, file_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY phrase DESC, stem DESC, score DESC, id) AS n FROM ranked) WHERE n = 1")
def best_per_file(spark, sf_dir):
    w = Window.partitionBy("query_id", "file_id").orderBy(F.desc("phrase"), F.desc("stem"), F.desc("score"), "id")
    return r.ranked(hits(spark, sf_dir)).withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "file_id", "id")


@query("adaptive_k", "SELECT source, CAST(count(*) AS INT) AS total, CAST(CASE WHEN count(*) <= 80 THEN count(*) ELSE least(count(*), greatest(80, least(180, count(*) // 6))) END AS INT) AS k FROM documents GROUP BY source")
def adaptive_k(spark, sf_dir):
    n = F.col("total")
    k = F.when(n <= 80, n).otherwise(F.least(n, F.greatest(F.lit(80), F.least(F.lit(180), F.floor(n / 6)))))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("int").alias("total")).select("source", "total", k.cast("int").alias("k"))


@query(
    "substring_candidates",
    "SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM benchmark b, documents d WHERE length(b.text) > 0 AND contains(d.text, b.text)) WHERE n <= 15",
)
def substring_candidates(spark, sf_dir):
    """Whole benchmark texts against all documents, 15 hits for each."""
    phrases = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    d = r.containing(table(spark, sf_dir, "documents"), phrases)
    return d.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))).where("n <= 15").select("item_id", "doc_id")


@query(
    "candidate_merge",
    "WITH " + SIM_SQL + " SELECT query_id, id, max(semantic) AS semantic, max(keyword) AS keyword FROM (SELECT query_id, id, semantic, 0.0 AS keyword FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, id) AS n FROM sim) WHERE n <= 20"
    " UNION ALL SELECT query_id, id, 0.0, CAST(id % 9 AS DOUBLE) FROM (SELECT query_id FROM q) a, (SELECT vec_id AS id FROM embeddings) b WHERE (id * 31 + query_id) % 17 = 0) GROUP BY query_id, id",
)
def candidate_merge(spark, sf_dir):
    """Two candidate lists in one grouping in place of a full outer join."""
    queries = stated(spark, sf_dir)
    near = r.nearest(vectors(spark, sf_dir), queries, 20).select("query_id", "id", "semantic", F.lit(0.0).alias("keyword"))
    ids = F.array(*[F.lit(x["query_id"]) for x in queries.select("query_id").orderBy("query_id").collect()])
    words = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.explode(ids).alias("query_id")).where("(id * 31 + query_id) % 17 = 0")
    words = words.select("query_id", "id", F.lit(0.0).alias("semantic"), F.expr("CAST(id % 9 AS DOUBLE)").alias("keyword"))
    return near.unionByName(words).groupBy("query_id", "id").agg(F.max("semantic").alias("semantic"), F.max("keyword").alias("keyword"))


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS file_id", "turn AS chunk_index", "text", "role")


@query(
    "neighbor_attach",
    "WITH h AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0) SELECT c.conv_id AS file_id, c.turn AS chunk_index, c.text FROM conversations c WHERE (c.conv_id, c.turn) IN (SELECT (conv_id, turn - 1) FROM h UNION SELECT (conv_id, turn + 1) FROM h) AND (c.conv_id, c.turn) NOT IN (SELECT (conv_id, turn) FROM h)",
)
def neighbor_attach(spark, sf_dir):
    c = turns(spark, sf_dir)
    return r.neighbours(c.where("chunk_index % 3 = 0"), c).select("file_id", "chunk_index", "text")


@query(
    "neighbor_context",
    "SELECT a.conv_id AS file_id, a.turn AS chunk_index, (SELECT string_agg(t, chr(10) || chr(10) ORDER BY first) FROM (SELECT b.text AS t, min(b.turn) AS first FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY b.text)) AS context FROM conversations a",
)
def neighbor_context(spark, sf_dir):
    return r.context(turns(spark, sf_dir)).select("file_id", "chunk_index", "context")


@query(
    "context_pack",
    """WITH p AS (SELECT conv_id AS group_id, turn AS position, text, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations),
o AS (SELECT *, 900 - (upto - n) AS room, CASE WHEN upto > 900 THEN 1 ELSE 0 END AS ov, sum(CASE WHEN upto > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY position) AS n_over FROM p)
SELECT group_id, position, CASE WHEN ov = 0 THEN text ELSE left(text, CAST(room AS INT) - 1) || '…' END AS text, ov = 0 AS cited FROM o WHERE n_over = 0 OR (ov = 1 AND n_over = 1 AND room > 200)""",
)
def context_pack(spark, sf_dir):
    return r.packed(table(spark, sf_dir, "conversations").selectExpr("conv_id AS group_id", "turn AS position", "text"), 900)


@query(
    "citation_select",
    """WITH a AS (SELECT conv_id AS answer_id, 'see [' || (conv_id % 4) || '] and [' || (conv_id % 7) || ']' AS answer FROM conversations WHERE turn = 0),
c AS (SELECT conv_id AS answer_id, CAST(turn + 1 AS INT) AS number FROM conversations),
m AS (SELECT DISTINCT answer_id, CAST(x AS INT) AS number FROM (SELECT answer_id, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)) AS x FROM a)),
h AS (SELECT c.* FROM c SEMI JOIN m USING (answer_id, number))
SELECT * FROM h UNION ALL SELECT * FROM c WHERE number <= 5 AND answer_id NOT IN (SELECT answer_id FROM h)""",
)
def citation_select(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = c.where("turn = 0").selectExpr("conv_id AS answer_id", "concat('see [', conv_id % 4, '] and [', conv_id % 7, ']') AS answer")
    return r.cited(answers, c.selectExpr("conv_id AS answer_id", "CAST(turn + 1 AS INT) AS number"))


@query(
    "priority_tiers",
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE WHEN contains(text, '@') THEN 0 WHEN contains(lower(text), 'copyright') THEN 1 ELSE 2 END, doc_id) AS INT) AS place FROM documents",
)
def priority_tiers(spark, sf_dir):
    tier = F.when(F.contains("text", F.lit("@")), 0).when(F.contains(F.lower("text"), F.lit("copyright")), 1).otherwise(2)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", tier.alias("tier"))
    return d.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("tier", "doc_id")).alias("place"))


@query(
    "citation_numbers",
    "SELECT conv_id AS question_id, place, part, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS INT) AS id FROM (SELECT conv_id, turn AS place, CAST(role <> 'user' AS INT) AS part FROM conversations WHERE role IS NOT NULL)",
)
def citation_numbers(spark, sf_dir):
    """The turns of users stand for citations of the documentation, the others for those of the policy."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("place"), "role")
    return r.numbered_citations(said.where("role = 'user'").drop("role"), said.where("role <> 'user'").drop("role"))
