"""Queries over intents, priorities, sections, field bundles, checks of registers and approvals, answers and display text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import display
from tessera.functions import fields as f
from tessera.functions import text as t
from tessera.functions.scoring import combined
from tessera.operators import policy, rules
from tessera.plans import record_queries as records
from tessera.plans import retrieval_queries as retrieval
from tessera.plans.common import table
from tessera.plans.record_queries import ADDRESS_SQL, AREAS_SQL, AS_OF, CADASTRAL_SQL, DATES_SQL, MONEY_SQL, OWNER_SQL, PAPERS, values
from tessera.plans.text_queries import STRIP

NOTES = [
    (-101, "Какой срок подачи заявок при аукционе"), (-102, "Проверь документацию на соответствие; ошибки?"), (-103, "  Аукцион: проверка срока извещения  "), (-104, "аукцион"),
    (-105, "Таблица 1. Извещение о проведении аукциона: не менее 15 календарных дней"), (-106, "не менее 15 календарных дней"),
    (-107, "список: - один • два; * три **жирный** - четыре"), (-108, "1. Пункт Где: раздел 2 Суть: нет срока\nОбоснование: п. 3 📄 Предмет: услуги"),
    (-109, "Текст. Вывод: всё хорошо. Итого: 5 Итоговый срок: завтра"), (-110, "１．２） ４ **а** b ** c **д**"), (-111, "пишите на a.b@mail.ru или https://site.ru/x?y=1 , спасибо"), (-112, None), (-113, "**x**y**"),
]
#: All documents, the papers and notes of our own, with numbers below zero.
TEXTS_SQL = f"texts AS (SELECT doc_id, coalesce(text, '') AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -case_id, text FROM {values(PAPERS, 'case_id, text')} UNION ALL SELECT * FROM {values(NOTES, 'doc_id, text')}))"


def texts(spark, sf_dir):
    own = spark.createDataFrame([(-i, x) for i, x in PAPERS] + NOTES, "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own).select("doc_id", t.text("text").alias("text"))


def per_text(name: str, sql: str, make, column: str) -> None:
    query(name, f"WITH {TEXTS_SQL} SELECT doc_id, {sql} AS {column} FROM texts")(lambda spark, sf_dir: texts(spark, sf_dir).select("doc_id", make(F.col("text")).alias(column)))


def any_sql(parts: list[str], low: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({low}, '{p}')" for p in parts) + ")"


CHECK_SQL, DEADLINE_SQL = any_sql(policy.CHECK), f"(contains(lower(text), '{policy.AUCTION}') AND {any_sql(policy.DEADLINE)})"
listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
per_text("full_check_intent", CHECK_SQL, policy.full_check, "full_check")
per_text("auction_deadline_intent", DEADLINE_SQL, policy.auction_deadline, "deadline")
per_text("deadline_table_row", f"contains(lower(text), '{policy.ROW}') AND contains(lower(text), '{policy.DAYS}')", policy.table_row, "table_row")
Q_SQL = STRIP.format("text")
per_text(
    "policy_enriched",
    f"array_to_string(list_concat([{Q_SQL}], list_filter(list_concat(CASE WHEN {CHECK_SQL} THEN {listed(policy.CHECK_TERMS)} ELSE [] END, CASE WHEN {DEADLINE_SQL} THEN {listed(policy.DEADLINE_TERMS)} ELSE [] END), lambda x: lower(x) <> lower({Q_SQL}))), ' ')",
    policy.enriched, "enriched",
)
BULLETS_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '([:;—–])\\s*([-*•]\\s+\\S)', '\\1' || chr(10) || '\\2', 'g'), '(\\*\\*[^*]+\\*\\*)\\s*([-*•]\\s+\\S)', '\\1' || chr(10) || '\\2', 'g'), '([^\\n])\\s+([-*•]\\s+\\S)', '\\1' || chr(10) || '\\2', 'g')"
per_text("list_line_breaks", BULLETS_SQL, display.bullets, "shown")
per_text("narrow_list_digits", f"translate(text, '{display.WIDE}', '{display.NARROW}')", display.narrow_digits, "shown")
MAIL_SQL = "regexp_extract_all(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+|https?://[^\\s<>]+')"
per_text("masked_links", f"len({MAIL_SQL})", lambda c: F.size(display.masked(c)["kept"]).cast("long"), "n_kept")
PAIRED_SQL = "regexp_replace(text, '\\*\\*(.+?)\\*\\*', chr(57600) || '\\1' || chr(57601), 'g')"
per_text("paired_bold", f"replace(replace(replace({PAIRED_SQL}, '**', ''), chr(57600), '**'), chr(57601), '**')", display.paired_bold, "shown")


@query("remark_breaks")
def remark_breaks(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", display.conclusions(display.remarks(F.col("text"))).alias("shown"))


@query(
    "chunk_pages_est",
    "SELECT conv_id AS file_id, turn AS chunk_index, CAST(CASE WHEN conv_id % 2 = 0 THEN greatest(1, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2400 + 1) ELSE greatest(1, turn + 1) END AS BIGINT) AS page FROM conversations",
)
def chunk_pages_est(spark, sf_dir):
    """The page of a chunk: of running text (even files) by characters before it, else its own page."""
    before = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    page = F.when(F.col("conv_id") % 2 == 0, F.floor(F.coalesce(before, F.lit(0)) / t.PAGE_CHARS) + 1).otherwise(F.col("turn") + 1)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk_index"), F.greatest(F.lit(1), page).cast("long").alias("page"))


@query(
    "policy_priority",
    f"""WITH {TEXTS_SQL}, asked AS (SELECT doc_id AS query_id, text AS question FROM texts WHERE doc_id BETWEEN -104 AND -101),
pool AS (SELECT query_id, question, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place, text FROM asked, texts t WHERE doc_id % 5 = 0),
extra AS (SELECT query_id, question, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place, text FROM asked, texts t WHERE contains(lower(text), '15 календар')),
d AS (SELECT *, 0 AS second FROM pool UNION ALL SELECT *, 1 FROM extra WHERE {DEADLINE_SQL.replace('text', 'question')}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY second, place) AS n FROM d),
r AS (SELECT *, CASE WHEN NOT {DEADLINE_SQL.replace('text', 'question')} THEN 2 WHEN contains(lower(text), '{policy.ROW}') AND contains(lower(text), '{policy.DAYS}') THEN 0 WHEN {any_sql(policy.MARKS)} THEN 1 ELSE 2 END AS tier FROM o WHERE n = 1)
SELECT query_id, id, CAST(tier AS INT) AS tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, second, place) AS INT) AS position FROM r""",
)
def policy_priority(spark, sf_dir):
    """Four stated questions; the texts are read once for all of them."""
    asked = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(q).alias("question")) for i, q in NOTES[:4]])
    d = texts(spark, sf_dir).select(F.explode(asked).alias("q"), F.col("doc_id").alias("id"), "text").select("q.*", "id", "text")
    d = d.withColumn("place", F.lit(0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    pool, extra = d.where("id % 5 = 0"), d.where(F.contains(F.lower("text"), F.lit(policy.DAYS)))
    return policy.prioritised(pool.withColumn("place", place), extra.withColumn("place", place))


@query(
    "section_topk",
    """WITH s AS (SELECT conv_id AS case_id, turn AS number, conv_id % 3 = 0 AS full_check, CAST((turn * 7 + conv_id) % 11 AS DOUBLE) AS score, text FROM conversations),
a AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS available, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, number) AS rank FROM s WHERE trim(coalesce(text, '')) <> '')
SELECT case_id, number, score FROM a WHERE full_check OR available <= 4 OR rank <= 4""",
)
def section_topk(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").selectExpr("conv_id AS case_id", "turn AS number", "conv_id % 3 = 0 AS full_check", "CAST((turn * 7 + conv_id) % 11 AS DOUBLE) AS score", "text")
    return policy.picked_sections(d, 4).select("case_id", "number", "score")


@query(
    "file_diversification",
    retrieval.RANKED_SQL + """, pool AS (SELECT query_id, file_id, id, place FROM ranked WHERE place <= 6),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY phrase DESC, stem DESC, core_matches DESC, score DESC, id) AS n FROM ranked) WHERE n = 1 AND (query_id, id) NOT IN (SELECT (query_id, id) FROM pool) AND (phrase > 0 OR stem >= 20 OR core_matches >= 2 OR semantic >= 0.42 * 0.85)),
f AS (SELECT query_id, count(DISTINCT file_id) AS files FROM ranked GROUP BY query_id),
u AS (SELECT query_id, file_id, id, 0 AS part, CAST(file_id AS BIGINT) AS by_ FROM b UNION ALL SELECT query_id, file_id, id, 1, CAST(place AS BIGINT) FROM pool),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, by_) AS position FROM u JOIN f USING (query_id))
SELECT query_id, file_id, id, CAST(part AS INT) AS part, CAST(position AS INT) AS position FROM p WHERE (files > 1 OR part = 1) AND position <= greatest(12, files * 4)""",
)
def file_diversification(spark, sf_dir):
    ranked = retrieval.r.ranked(retrieval.hits(spark, sf_dir))
    return policy.with_best_of_files(ranked.where("place <= 6").select("query_id", "file_id", "id", "place"), ranked, 4, 0.42)


@query(
    "file_pool_seed",
    retrieval.SCORED_SQL + " SELECT query_id, file_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, id) AS n FROM scored) WHERE n <= 4",
)
def file_pool_seed(spark, sf_dir):
    """The four best hits of each file, which start the pool."""
    w = Window.partitionBy("query_id", "file_id").orderBy(F.desc("score"), "id")
    d = retrieval.hits(spark, sf_dir).withColumn("score", F.expr(combined()))
    return d.withColumn("n", F.row_number().over(w)).where("n <= 4").select("query_id", "file_id", "id")


@query("semantic_front", retrieval.RANKED_SQL + " SELECT query_id, id, CAST(rank_semantic AS INT) AS rank FROM ranked WHERE rank_semantic <= greatest(6, 8)")
def semantic_front(spark, sf_dir):
    return retrieval.r.ranked(retrieval.hits(spark, sf_dir)).where("rank_semantic <= greatest(6, 8)").select("query_id", "id", F.col("rank_semantic").alias("rank"))


@query("strong_promotion", retrieval.RANKED_SQL + " SELECT query_id, id, CAST(any_strong AS INT) AS any_strong, strong FROM ranked WHERE tier = 1")
def strong_promotion(spark, sf_dir):
    strong = (F.col("phrase") >= 20) | (F.col("stem") >= 28)
    return retrieval.r.ranked(retrieval.hits(spark, sf_dir)).where("tier = 1").select("query_id", "id", "any_strong", strong.alias("strong"))


DATED_SQL = f"""dated AS (SELECT doc_id, max(d) AS latest FROM (SELECT doc_id, TRY_CAST((CASE WHEN CAST(p[3] AS INT) < 100 THEN CAST(p[3] AS INT) + 2000 ELSE CAST(p[3] AS INT) END) || '-' || p[2] || '-' || p[1] AS DATE) AS d
FROM (SELECT doc_id, string_split(replace(x, '/', '.'), '.') AS p FROM (SELECT doc_id, unnest({DATES_SQL}) AS x FROM texts))) GROUP BY doc_id)"""
FIELDS_SQL = f"""WITH {TEXTS_SQL}, {DATED_SQL}, fielded AS (SELECT doc_id, text, {CADASTRAL_SQL} AS keys, {AREAS_SQL} AS areas, {MONEY_SQL} AS prices, len(regexp_extract_all(text, '{records.TERM_PATTERN}')) AS n_terms,
{ADDRESS_SQL} AS address, {OWNER_SQL} AS owner, latest, {any_sql(rules.SIGNED, "replace(lower(text), 'ё', 'е')")} AS signed FROM texts LEFT JOIN dated USING (doc_id))"""


@query(
    "field_bundles",
    FIELDS_SQL + """ SELECT doc_id, coalesce(keys[1], '') AS cadastral, CAST(len(keys) AS INT) AS n_cadastral, address, owner, areas[1] AS area, CAST(len(areas) AS INT) AS n_areas, CAST(len(prices) AS INT) AS n_prices,
CAST(n_terms AS INT) AS n_terms, CAST(latest AS TIMESTAMP) AS latest, signed FROM fielded""",
)
def field_bundles(spark, sf_dir):
    """The fields of auction papers, registers and approvals in one pass over the texts."""
    c = F.col("text")
    lists = F.struct(f.cadastral(c).alias("keys"), f.areas(c).alias("areas"), F.size(f.money(c)).alias("n_prices"), F.size(f.terms(c)).alias("n_terms"), F.array_max(f.dates(c)).alias("latest"))
    d = texts(spark, sf_dir).select("doc_id", "text", t.bind(lists, lambda x: x).alias("x"))
    return d.select(
        "doc_id", F.coalesce(F.get("x.keys", F.lit(0)), F.lit("")).alias("cadastral"), F.size("x.keys").alias("n_cadastral"), f.address(c).alias("address"), f.owner(c).alias("owner"), F.get("x.areas", F.lit(0)).alias("area"),
        F.size("x.areas").alias("n_areas"), "x.n_prices", "x.n_terms", F.col("x.latest").cast("timestamp_ntz").alias("latest"), f.has_any(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), rules.SIGNED).alias("signed"),
    )


def issues_sql(checks: list[tuple[str, str, str, str]]) -> str:
    """Rows of the checks (test, level, field, severity), or one for a text that is blank."""
    every = " UNION ALL ".join(f"SELECT doc_id AS case_id, '{level}' AS level, '{field}' AS field, '{severity}' AS severity, {test} AS bad, text FROM fielded" for test, level, field, severity in checks)
    blank = f"{STRIP.format('text')} = ''"
    return f"{FIELDS_SQL} SELECT case_id, level, field, severity FROM ({every}) WHERE bad AND NOT {blank} UNION ALL SELECT doc_id, 'error', 'text', 'critical' FROM fielded WHERE {blank}"


REGISTER_SQL = issues_sql([
    ("len(keys) = 0", "error", "cadastral", "critical"), ("address = ''", "warning", "address", "minor"), (f"(owner = '' OR NOT {any_sql(rules.PUBLIC, 'lower(owner)')})", "warning", "owner", "minor"),
    (any_sql(rules.BURDENS), "warning", "encumbrances", "minor"), (f"coalesce(latest < DATE '{AS_OF[:10]}' - 30, false)", "error", "extract_date", "critical"), ("latest IS NULL", "warning", "extract_date", "minor"),
])
APPROVAL_SQL = issues_sql([("latest IS NULL", "warning", "date", "minor"), ("(len(keys) = 0 AND address = '')", "error", "object", "critical"), ("NOT signed", "warning", "signature", "minor")])


@query("register_issues", REGISTER_SQL)
def register_issues(spark, sf_dir):
    return rules.register_issues(texts(spark, sf_dir).withColumnRenamed("doc_id", "case_id"), AS_OF[:10], 30)


@query("approval_issues", APPROVAL_SQL)
def approval_issues(spark, sf_dir):
    return rules.approval_issues(texts(spark, sf_dir).withColumnRenamed("doc_id", "case_id"))


CAPS_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in policy.CAPS.items())


@query(
    "issue_caps",
    f"WITH {records.CASES_SQL}, i AS ({records.ISSUES_SQL}) SELECT case_id, level, field FROM (SELECT *, row_number() OVER (PARTITION BY case_id, level ORDER BY field) AS n FROM i) WHERE n <= CASE level {CAPS_SQL} END",
)
def issue_caps(spark, sf_dir):
    """The issues that the report of each case shows."""
    d = rules.auction_issues(records.papers(spark, sf_dir)).withColumn("position", F.col("field"))
    return policy.capped(d).select("case_id", "level", "field")
