"""Hybrid search for a table of questions over chunks, from words to the passages that are shown.

Candidates come by the rarest words of a question, by an index join; only they are scored.  Word vectors stand in for an
embedding: the meaning of a pair is the cosine of its sets of words.  Neighbours count only where they are candidates themselves.
Fallbacks are guarded by counts over a question's hits, so that all questions go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as lx
from tessera.functions import scoring
from tessera.functions import text as t

#: Limits, fixed values: hits shown, hits that come first by meaning, nearest and most candidates, seeds of neighbours, hits of a wording and file, room of soft choices.
SHOWN, FRONT, RETRIEVED, MOST, SEEDS, WORDINGS, SOFT = 8, 6, 80, 180, 10, 15, 8
#: What a wording found as it is, and a neighbour, count by meaning; and what a shown hit's score is to the best; fixed values.
AS_IS, BESIDE, CITED = 0.88, 0.35, 0.4
#: Words of a question that bring candidates.
RARE = 4
TOKENS = "[\\p{L}\\p{N}_]+"


def by_question():
    return Window.partitionBy("query_id")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKENS), F.lit(0))


def stem(w: Column) -> Column:
    n = F.length(w)
    return F.when(n >= 10, F.left(w, F.lit(9))).when(n >= 7, F.left(w, F.lit(7))).when(n >= 5, F.left(w, F.lit(5))).otherwise(w)


def prepared_questions(questions: DataFrame) -> DataFrame:
    """query_id, question -> its words, core words, wordings of two to nine words or of core words, and spoken stems."""
    d = questions.select("query_id", t.text("question").alias("question")).withColumn("words", tokens(F.col("question")))
    stop, asking = (F.array(*map(F.lit, sorted(x))) for x in (lx.STOP, lx.STOP | lx.ASKING))
    known = F.filter("words", lambda w: (F.length(w) > 1) & ~F.array_contains(asking, w))
    d = d.withColumn("core", t.bind(known, lambda k: t.bind(F.filter(k, lambda w: F.length(w) > 2), lambda c: F.when(F.size(c) > 0, c).otherwise(k))))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words")), lambda i: F.transform(F.sequence(F.lit(2), F.lit(9)), lambda n: F.when(i + n <= F.size("words"), F.array_join(F.slice("words", i + 1, n), " ")))))
    last = lambda n: F.when(F.size("core") > 1, F.array_join(F.slice("core", F.greatest(F.lit(1), F.size("core") - n + 1), F.lit(n)), " "))
    wordings = F.array_compact(F.concat(F.array(t.matchable(F.col("question"))), runs, F.array(F.when(F.size("core") > 1, F.array_join("core", " ")), last(2), last(3))))
    spoken = F.transform(F.filter("words", lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)), stem)
    return d.select("query_id", "question", "words", "core", F.array_distinct(F.filter(wordings, lambda s: F.length(s) > 7)).alias("wordings"), spoken.alias("spoken"))


def prepared_chunks(chunks: DataFrame) -> DataFrame:
    """file_id, chunk_index, text -> with doc (matchable) and the distinct words of two characters or more."""
    held = F.array_distinct(F.filter(tokens(F.col("text")), lambda w: F.length(w) > 1))
    return chunks.select("file_id", "chunk_index", t.matchable(F.col("text")).alias("doc"), held.alias("held"))


def candidates(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, file_id, chunk_index, semantic: the nearest of the chunks that hold one of a question's rarest words."""
    own = questions.select("query_id", F.array_distinct(F.filter("words", lambda w: F.length(w) > 1)).alias("asked"))
    held = chunks.select("file_id", "chunk_index", F.explode("held").alias("word"))
    often = held.groupBy("word").agg(F.count("*").alias("often"))
    rare = own.select("query_id", F.explode("asked").alias("word")).join(often, "word")
    rare = rare.withColumn("n", F.row_number().over(by_question().orderBy("often", "word"))).where(F.col("n") <= RARE).select("query_id", "word")
    pairs = held.join(rare, "word").select("query_id", "file_id", "chunk_index").distinct()
    common = F.size(F.array_intersect("asked", "held"))
    d = pairs.join(chunks.select("file_id", "chunk_index", "held"), ["file_id", "chunk_index"]).join(own, "query_id")
    d = d.select("query_id", "file_id", "chunk_index", F.round(common / F.sqrt((F.size("asked") * F.size("held")).cast("double")), 9).alias("semantic"))
    total = chunks.agg(F.count("*").alias("total")).select(F.least("total", F.greatest(F.lit(RETRIEVED), F.least(F.lit(MOST), F.floor(F.col("total") / 6)))).alias("most")).first()["most"]
    near = d.withColumn("n", F.row_number().over(by_question().orderBy(F.desc("semantic"), "file_id", "chunk_index"))).where(F.col("n") <= total).drop("n")
    # Wordings found as they are stand in chunks that hold all their words, so among the pairs.
    exact = pairs.join(questions.select("query_id", t.matchable(F.col("question")).alias("wording")), "query_id").join(chunks.select("file_id", "chunk_index", "doc"), ["file_id", "chunk_index"])
    exact = exact.where((F.length("wording") > 7) & F.contains("doc", F.col("wording"))).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy("chunk_index"))).where(F.col("n") <= WORDINGS)
    both = near.unionByName(exact.select("query_id", "file_id", "chunk_index", F.lit(AS_IS).alias("semantic")))
    return both.groupBy("query_id", "file_id", "chunk_index").agg(F.max("semantic").alias("semantic"))


def found(doc: Column, compact: Column, w: Column) -> Column:
    """Whether a word is found as it is, without dashes or by its beginning."""
    n = F.length(w)
    return F.contains(doc, w) | ((n > 2) & (F.contains(compact, w) | F.contains(compact, F.left(w, F.lit(3))))) | ((n > 3) & F.contains(doc, F.left(w, F.lit(4))))


def in_order(doc: Column, parts: Column, least: int) -> Column:
    place = lambda acc, s: F.call_function("locate", s, doc, acc)
    step = lambda acc, s: F.when(acc == 0, 0).otherwise(t.bind(place(acc, s), lambda p: F.when(p == 0, 0).otherwise(p + F.greatest(F.lit(least), F.length(s)))))
    return F.aggregate(parts, F.lit(1), step) > 0


def proximity(doc: Column, core: Column) -> Column:
    used = F.filter(core, lambda w: F.length(w) > 2)
    place = lambda w: F.when(F.contains(doc, stem(w)), F.instr(doc, stem(w))).otherwise(F.when(F.length(w) > 3, F.instr(doc, w)).otherwise(0))

    def score(x: Column) -> Column:
        n, span = F.size(x["at"]), F.array_max(x["at"]) - F.array_min(x["at"])
        near = F.when(span <= lx.SPAN, 40.0 + 12.0 * n).when(span <= 3 * lx.SPAN, 22.0).otherwise(0.0)
        return F.when((x["n"] == 0) | (n < F.least(F.lit(2), x["n"])), 0.0).otherwise(near)

    return t.bind(F.struct(F.size(used).alias("n"), F.filter(F.transform(used, place), lambda p: p > 0).alias("at")), score)


def phrase(doc: Column) -> Column:
    """The best of: a wording as it is, core words in order, stems in order, nearness, kinds."""
    longest = F.coalesce(F.array_max(F.transform(F.filter("wordings", lambda s: F.contains(doc, s)), lambda s: F.length(s))), F.lit(-50))
    core, kinds = F.col("core"), ["виды", "вид"]
    kind = F.exists(core, lambda w: ~w.isin(kinds) & F.contains(doc, stem(w))) & (F.contains(doc, F.lit("виды")) | F.contains(doc, F.lit("вид "))) & (F.size(core) > 1)
    return F.greatest(
        F.lit(0.0), 50.0 + F.least(longest, F.lit(40)), F.when((F.size(core) > 1) & in_order(doc, core, 1), 45.0).otherwise(0.0),
        F.when((F.size("spoken") > 1) & in_order(doc, F.col("spoken"), 3), 55.0).otherwise(0.0), proximity(doc, core), F.when(kind, 52.0).otherwise(0.0),
    )


def word_score(doc: Column, compact: Column) -> Column:
    return F.aggregate(F.filter("asked", lambda w: found(doc, compact, w)), F.lit(0.0), lambda acc, w: acc + F.when((F.length(w) > 2) & F.array_contains("core", w), 5.0).otherwise(3.0))


def hits(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, file_id, chunk_index, id and all scores of every candidate and of the neighbours of the best ones."""
    q = questions.withColumn("asked", F.array_distinct(F.filter("words", lambda w: F.length(w) > 1)))
    texts, compact = chunks.select("file_id", "chunk_index", "doc"), F.replace(F.col("doc"), F.lit(" "), F.lit(""))
    c = candidates(questions, chunks).join(texts, ["file_id", "chunk_index"]).join(q, "query_id").withColumn("words_score", word_score(F.col("doc"), compact))
    seeds = c.withColumn("n", F.row_number().over(by_question().orderBy(F.desc("words_score"), "file_id", "chunk_index"))).where(F.col("n") <= SEEDS)
    key = ["query_id", "file_id", "chunk_index"]
    beside = seeds.select("query_id", "file_id", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")).distinct().join(c.select(*key), key, "left_anti")
    beside = beside.join(texts, ["file_id", "chunk_index"]).join(q, "query_id").withColumn("semantic", F.lit(BESIDE)).withColumn("words_score", F.lit(0.0))
    d = c.unionByName(beside)
    # Only candidates count as neighbours: ids one apart, not the next row.
    near = Window.partitionBy("query_id", "file_id").orderBy("chunk_index")
    texts_of = lambda a, b: F.coalesce(F.max("doc").over(near.rangeBetween(a, b)), F.lit(""))
    d = d.withColumn("before", texts_of(-1, -1)).withColumn("after", texts_of(1, 1))
    d = d.withColumn("merged", t.matchable(F.concat_ws(" ", "doc", F.nullif(F.col("before"), F.lit("")), F.nullif(F.col("after"), F.lit("")))))
    d = d.withColumn("n_core", F.size("core")).withColumn("core_matches", F.size(F.filter("core", lambda w: found(F.col("doc"), compact, w))))
    d = d.withColumn("stem_matches", F.size(F.filter("core", lambda w: (F.length(w) > 2) & F.contains("doc", stem(w)))))
    d = d.withColumn("stem", proximity(F.col("merged"), F.col("core"))).withColumn("phrase", F.greatest(phrase(F.col("doc")), phrase(F.col("merged"))))
    d = d.withColumn("keyword", 5.0 * F.col("core_matches") + F.expr(scoring.PHRASE_BONUS) + F.least("words_score", F.lit(12.0)))
    d = d.withColumn("score", F.round(F.expr(scoring.combined()), 9)).withColumn("phrase", F.greatest("phrase", "stem"))
    names = ["semantic", "keyword", "core_matches", "n_core", "phrase", "stem", "stem_matches", "score"]
    return d.select(*key, F.concat_ws("_", "file_id", "chunk_index").alias("id"), *names)


def ranked(d: DataFrame, shown: int = SHOWN) -> DataFrame:
    """rrf and place: by meaning the first, then strong phrases (without any, hits with all core words), then the rest by eight keys."""
    at = lambda *keys: F.row_number().over(by_question().orderBy(*keys, "file_id", "chunk_index"))
    d = d.withColumn("by_meaning", at(F.desc("semantic"))).withColumn("by_words", at(F.desc("keyword")))
    d = d.withColumn("rrf", F.round(F.lit(1.0) / (scoring.RRF_K + F.col("by_meaning")) + F.lit(1.0) / (scoring.RRF_K + F.col("by_words")), 12))
    whole = (F.col("n_core") > 0) & (F.col("core_matches") >= F.col("n_core"))
    d = d.withColumn("base", at(*map(F.desc, ("semantic", "phrase", "stem", "stem_matches")), whole.desc(), *map(F.desc, ("core_matches", "score", "rrf"))))
    strong = (F.col("phrase") >= 20) | (F.col("stem") >= 28)
    d = d.withColumn("any_strong", F.max(strong).over(by_question()))
    promoted = F.when(F.col("any_strong"), strong).otherwise((F.col("n_core") >= 2) & whole)
    d = d.withColumn("tier", F.when(F.col("by_meaning") <= max(FRONT, shown), 0).when(promoted, 1).otherwise(2))
    again = (F.col("tier") == 1) & ~F.col("any_strong")
    return d.withColumn("place", F.row_number().over(by_question().orderBy("tier", F.when(F.col("tier") == 0, F.col("by_meaning")), F.when(again, F.col("phrase")).desc(), F.when(again, F.col("score")).desc(), "base")))


def pooled(d: DataFrame, files: int, shown: int = SHOWN) -> DataFrame:
    """position: the hits of each question that pass, or, where none does, those that pass a weaker test, or the first."""
    d = d.withColumn("ok", F.expr(scoring.POOLED)).withColumn("n_ok", F.count_if("ok").over(by_question()))
    weak = (F.col("place") <= max(3 * shown, 12)) & ((F.col("core_matches") >= 1) | (F.col("keyword") >= 2) | (F.col("semantic") >= scoring.SEMANTIC_FLOOR))
    d = d.withColumn("weak", weak).withColumn("n_weak", F.count_if("weak").over(by_question()))
    d = d.where(F.when(F.col("n_ok") > 0, F.col("ok")).when(F.col("n_weak") > 0, F.col("weak")).otherwise(F.col("place") <= max(2 * shown, 3 * files)))
    d = d.withColumn("n", F.row_number().over(by_question().orderBy("place"))).where(F.col("n") <= max(5 * shown, 8 * files, MOST // 3))
    keys = [F.desc(c) for c in ("semantic", "phrase", "stem", "core_matches", "keyword", "score", "rrf")]
    return d.withColumn("position", F.row_number().over(by_question().orderBy(*keys, "place"))).where(F.col("position") <= shown)


RELEVANT = (
    f"(semantic >= {scoring.SEMANTIC_MIN} OR (semantic >= 0.38 AND score >= least_score * 0.45) OR stem >= 28 OR phrase >= 20 OR (n_core > 0 AND core_matches >= n_core AND stem >= 15)"
    f" OR (core_matches >= {scoring.NEED_CORE} AND (score >= least_score OR keyword >= 4.0)) OR (n_core >= 2 AND core_matches >= 2 AND keyword >= 3.0) OR (core_matches >= 1 AND keyword >= 6.0)"
    f" OR (n_core = 0 AND (score >= 0.28 OR semantic >= 0.52)) OR (score >= least_score AND semantic >= 0.42 AND core_matches >= 1))"
)
WEAK = f"(position <= {SOFT} AND (core_matches >= 1 OR keyword >= 2.0 OR semantic >= {scoring.SEMANTIC_FLOOR}))"


def selected(d: DataFrame) -> DataFrame:
    """The relevant hits of each question; where none is, the weakly relevant of the first, or else the first three."""
    best = F.max(F.when(F.col("position") == 1, F.col("score"))).over(by_question())
    d = d.withColumn("least_score", F.greatest(F.lit(0.1), best * CITED)).withColumn("good", F.expr(RELEVANT)).withColumn("soft", F.expr(WEAK))
    d = d.withColumn("n_good", F.count_if("good").over(by_question())).withColumn("n_soft", F.count_if("soft").over(by_question()))
    return d.where(F.when(F.col("n_good") > 0, F.col("good")).when(F.col("n_soft") > 0, F.col("soft")).otherwise(F.col("position") <= 3))


def search(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, question; file_id, chunk_index, text -> the hits that are shown, by position."""
    q, c = prepared_questions(questions), prepared_chunks(chunks)
    files = c.select("file_id").distinct().count()
    return selected(pooled(ranked(hits(q, c)), files))
