"""Queries over questions and word evidence, report formatting and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import lexicon as lx
from tessera.functions import text as t
from tessera.functions.lexicon import Question
from tessera.operators import lexical, records
from tessera.plans.common import table
from tessera.plans.text_queries import MATCH

QUESTIONS = ["Какой Срок подачи заявок при аукционе", "Виды служебной информации", "Какие виды премий существуют", "бизне план", "что и как", ""]
#: Questions that the documents here can answer.
WORDED = ["the oneand thereat", "der und eine", "la que los mente"]


def compiled(name: str, of) -> None:
    def run(spark, sf_dir):
        rows = [(i, n, x) for i, q in enumerate(QUESTIONS) for n, x in enumerate(of(Question.of(q)))]
        return spark.createDataFrame(rows, "question int, place int, term string")

    query(name)(run)


compiled("core_tokens", lambda q: q.core)
compiled("expand_tokens", lambda q: q.tokens())
compiled("expand_phrases", lambda q: q.phrases())
compiled("query_substrings", lambda q: q.substrings())
compiled("query_stem_terms", lambda q: q.stems())
compiled("enrich_query", lambda q: [q.enriched])


def per_question(spark, sf_dir, column):
    """Every document's text is made matchable once, for all questions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", t.matchable(t.text("text")).alias("doc"))
    rows = [F.struct(F.lit(i).alias("question"), column(F.col("doc"), Question.of(q)).alias("score")) for i, q in enumerate(WORDED)]
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")


def worded_sql(expression) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS INT) AS question, {expression(Question.of(q))} AS score FROM (SELECT doc_id, {MATCH.format('text')} AS doc FROM documents)" for i, q in enumerate(WORDED))


@query("stem_match_count", worded_sql(lambda q: "CAST(" + " + ".join([f"CAST(contains(doc, '{lx.stem(w)}') AS INT)" for w in q.core if len(w) > 2]) + " AS INT)"))
def stem_match_count(spark, sf_dir):
    return per_question(spark, sf_dir, lexical.stem_matches)


@query(
    "stems_in_order",
    worded_sql(lambda q: "regexp_matches(doc, '(?s)" + ".*?".join(lx.stem(w) for w in q.words) + "')"),
)
def stems_in_order(spark, sf_dir):
    return per_question(spark, sf_dir, lambda doc, q: lexical.in_order(doc, [(lx.stem(w), len(lx.stem(w))) for w in q.words]))


def proximity_sql(q: Question) -> str:
    used = [w for w in q.content if len(w) > 2]
    places = ", ".join(f"CASE WHEN contains(doc, '{lx.stem(w)}') THEN instr(doc, '{lx.stem(w)}')" + (f" WHEN contains(doc, '{w}') THEN instr(doc, '{w}')" if len(w) > 3 else "") + " END" for w in used)
    at = f"list_filter([{places}], lambda x: x IS NOT NULL)"
    span = f"(list_aggregate({at}, 'max') - list_aggregate({at}, 'min'))"
    return f"CAST(CASE WHEN len({at}) < {min(2, len(used))} THEN 0 WHEN {span} <= 180 THEN 40 + 12 * len({at}) WHEN {span} <= 540 THEN 22 ELSE 0 END AS DOUBLE)"


@query("stem_proximity", worded_sql(proximity_sql))
def stem_proximity(spark, sf_dir):
    return per_question(spark, sf_dir, lexical.proximity)


@query("phrase_score")
def phrase_score(spark, sf_dir):
    return per_question(spark, sf_dir, lexical.phrase_score)


def keyword(spark, sf_dir, fuzzy):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = [(i, q, list(q.words)) for i, q in enumerate(map(Question.of, WORDED))]
    return lexical.keyword_scored(docs, asked, fuzzy)


def keyword_sql() -> str:
    parts = []
    for i, text in enumerate(WORDED):
        q = Question.of(text)
        found = {w: " OR ".join([f"contains(doc, '{w}')", *([f"contains(c, '{w}')", f"contains(c, '{w[:3]}')"] if len(w) > 2 else []), *([f"contains(doc, '{w[:4]}')"] if len(w) > 3 else [])]) for w in q.words}
        core = [w for w in q.words if len(w) > 2]
        score = " + ".join(f"CASE WHEN {found[w]} THEN {5.0 if w in core else 3.0} ELSE 0.0 END" for w in q.words)
        phrase = " ".join(core[:5])
        score += f" + CASE WHEN contains(doc, '{phrase}') THEN 8.0 ELSE 0.0 END + CASE WHEN contains(c, '{phrase.replace(' ', '')}') THEN 6.0 ELSE 0.0 END"
        matched = " + ".join(f"CASE WHEN {found[w]} THEN 1 ELSE 0 END" for w in q.core)
        parts.append(f"SELECT doc_id, CAST({i} AS INT) AS question, CAST({score} AS DOUBLE) AS score, CAST({matched} AS INT) AS core_matches FROM (SELECT doc_id, doc, replace(doc, ' ', '') AS c FROM (SELECT doc_id, {MATCH.format('text')} AS doc FROM documents))")
    return " UNION ALL ".join(parts)


@query("keyword_score_native", keyword_sql())
def keyword_score_native(spark, sf_dir):
    return keyword(spark, sf_dir, False)


@query("keyword_score_fuzzy")
def keyword_score_fuzzy(spark, sf_dir):
    return keyword(spark, sf_dir, True)


@query("number_format", "SELECT o_orderkey, replace(format('{:,.2f}', o_totalprice), ',', chr(160)) AS shown FROM orders")
def number_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", records.grouped_number(F.col("o_totalprice")).alias("shown"))


@query("history_time", "SELECT event_id, strftime(ts + INTERVAL 3 HOURS, '%d.%m.%Y %H:%M') AS shown FROM events")
def history_time(spark, sf_dir):
    """In the zone of Moscow."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 3 HOURS"), "dd.MM.yyyy HH:mm").alias("shown"))


@query(
    "error_messages",
    "SELECT doc_id, CASE WHEN contains(lower(text), 'context length') OR contains(lower(text), 'too many tokens') THEN 'long' WHEN contains(lower(text), 'rate limit') OR contains(lower(text), '429') THEN 'busy'"
    " WHEN contains(lower(text), 'timeout') THEN 'slow' WHEN regexp_matches(lower(text), 'api key|authentication|401|403') THEN 'access' WHEN regexp_matches(lower(text), 'connect|network') THEN 'connection' ELSE 'other' END AS kind FROM documents",
)
def error_messages(spark, sf_dir):
    low = F.lower("text")
    kind = F.when(low.rlike("context length|too many tokens"), "long").when(low.rlike("rate limit|429"), "busy").when(F.contains(low, F.lit("timeout")), "slow")
    return table(spark, sf_dir, "documents").select("doc_id", kind.when(low.rlike("api key|authentication|401|403"), "access").when(low.rlike("connect|network"), "connection").otherwise("other").alias("kind"))


@query("edit_url", "SELECT page_id, regexp_replace(string_split(string_split(url, '#')[1], '?')[1], '/+$', '') || CASE WHEN contains(url, '#') THEN '#' || string_split(url, '#')[2] ELSE '' END AS url FROM pages")
def edit_url(spark, sf_dir):
    base = F.regexp_replace(F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), "/+$", "")
    mark = F.when(F.contains("url", F.lit("#")), F.concat(F.lit("#"), F.split_part("url", F.lit("#"), F.lit(2)))).otherwise("")
    base = F.when(F.contains(base, F.lit("/view")), F.regexp_replace(base, "/view", "/edit")).otherwise(base)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(base, mark).alias("url"))


DECIMALS = [(-1, "26.\n07.\n2006"), (-2, "статьей\n17.1 и 3.\n текст"), (-3, "1.\n2.\n3.\n4")]
#: Lookarounds spelt out: a number may end one pair and begin the next.
PAIR_SQL = "regexp_replace({}, '(\\d)\\.\\s*\\n\\s*(\\d)', '\\1.\\2', 'g')"


@query(
    "broken_decimals",
    "SELECT doc_id, regexp_replace(" + PAIR_SQL.format(PAIR_SQL.format("text")) + ", '(\\p{L})\\s*\\n\\s*(\\d+\\.\\d+)', '\\1 \\2', 'g') AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{x}')" for i, x in DECIMALS) + ") v(doc_id, text))",
)
def broken_decimals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(DECIMALS, "doc_id long, text string"))
    joined = F.regexp_replace("text", "(?<=\\d)\\.\\s*\\n\\s*(?=\\d)", ".")
    return d.select("doc_id", F.regexp_replace(joined, "(\\p{L})\\s*\\n\\s*(\\d+\\.\\d+)", "$1 $2").alias("text"))
