"""Queries over nested JSON: articles, reports on objects, answers.  Payloads wrap the events in the ways that services do."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import jsonwalk as j
from tessera.operators import records
from tessera.plans.common import table

FORMS = 10


def article(n: int) -> str:
    return (
        f"""'{{"Код статьи": "' || event_id || '-{n}", "Приоритет": "' || user_id || '", "Наименование статьи": "' || event_type || '", """
        f""""Годовой лимит": ' || (10 * event_id) || ', "Текущий лимит": ' || (event_id + {n}) || ', "Факт": ' || user_id || ', "доп": ' || props || '}}'"""
    )


def wrapped() -> list[str]:
    """SQL texts of payloads, by event_id modulo FORMS."""
    one, two = article(1), article(2)
    quoted = f"replace('[' || {one} || ']', chr(34), chr(92) || chr(34))"
    report = (
        f"""'{{"output": {{" Объект ": "' || event_type || '", "Статьи доходов и расходов": {{"Доход": {{"items": [' || {one} || ', ' || {two} || '], "Всего доходов": {{"Годовой лимит": ' || event_id || ', "Факт": 1}}}}, """
        f""""Расход": {{"items": [' || {one} || ']}}, "Финансовый результат": {{"Годовой лимит": 7, "Факт": ' || user_id || '}}}}}}}}'"""
    )
    deep = "repeat('{\"output\": [', 12) || '\"' || event_type || '\"' || repeat(']}', 12)"
    return [
        f"""'[{{"output": ' || {one} || '}}]'""",
        f"""'[{{"output": [' || {one} || ', ' || {two} || ', ' || {one} || ']}}]'""",
        f"""'{{"data": "' || {quoted} || '"}}'""",
        f"""'{{"x": {{"y": ' || {one} || '}}, "z": ' || {two} || '}}'""",
        f"""'[{{"output": ' || {one} || '}}, {{"q": ' || {two} || '}}]'""",
        report,
        """'{"answer": {"x": 1}, "output": [], "text": " ' || event_type || ' "}'""",
        "props",
        """'{"choices": [{"message": {"content": "' || event_type || '"}}]}'""",
        deep,
    ]


PAYLOAD = f"CASE event_id % {FORMS} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(wrapped())) + " END"
#: Which articles a payload holds, 0 and -1 being the total and the result of a report, which have no code.
HELD = f"CASE event_id % {FORMS} WHEN 0 THEN [1] WHEN 1 THEN [1, 2, 1] WHEN 2 THEN [1] WHEN 3 THEN [1, 2] WHEN 4 THEN [1] WHEN 5 THEN [1, 2, 0, -1] ELSE [] END"
ARTICLES_SQL = f"""articles AS (SELECT event_id AS id, CAST(place - 1 AS INT) AS place, CASE WHEN n > 0 THEN user_id::VARCHAR END AS priority, CASE WHEN n > 0 THEN event_id || '-' || n END AS code, CASE WHEN n > 0 THEN event_type END AS name,
CAST(CASE WHEN n > 0 THEN 10 * event_id WHEN n = 0 THEN event_id ELSE 7 END AS DOUBLE) AS annual_limit, CAST(CASE WHEN n > 0 THEN event_id + n END AS DOUBLE) AS current_limit, CAST(CASE WHEN n = 0 THEN 1 ELSE user_id END AS DOUBLE) AS fact
FROM (SELECT *, held[place] AS n FROM (SELECT *, unnest(range(1, len(held) + 1)) AS place FROM (SELECT *, {HELD} AS held FROM events))))"""


def payloads(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(PAYLOAD).alias("payload"))


@query("json_articles", f"WITH {ARTICLES_SQL} SELECT * FROM articles")
def json_articles(spark, sf_dir):
    return records.articles(payloads(spark, sf_dir))


@query(
    "article_dedupe",
    f"WITH {ARTICLES_SQL} SELECT * EXCLUDE (n), CASE WHEN bool_or(current_limit IS NOT NULL AND fact IS NOT NULL) OVER (PARTITION BY id) THEN current_limit - fact END AS remainder FROM (SELECT *, row_number() OVER (PARTITION BY id, coalesce(code, ''), coalesce(priority, '') ORDER BY place) AS n FROM articles) WHERE n = 1",
)
def article_dedupe(spark, sf_dir):
    return records.with_remainder(records.first_of_each(json_articles(spark, sf_dir)))


@query(
    "object_report_rows",
    f"""SELECT event_id AS id, event_type AS object, section, CAST(CASE section WHEN 'Всего доходов' THEN event_id WHEN 'Финансовый результат' THEN 7 ELSE 10 * event_id END AS DOUBLE) AS annual_limit, CASE WHEN section IN ('Доход', 'Расход') THEN event_id || '-' || n END AS code, CAST(place - 1 AS INT) AS place
FROM (SELECT *, unnest(['Доход', 'Доход', 'Всего доходов', 'Расход', 'Финансовый результат']) AS section, unnest([1, 2, 0, 1, 0]) AS n, unnest([1, 2, 3, 4, 5]) AS place FROM events WHERE event_id % {FORMS} = 5)""",
)
def object_report_rows(spark, sf_dir):
    d = j.walked(payloads(spark, sf_dir)).select("id", "object", F.posexplode("rows").alias("place", "r"))
    get = lambda k: F.try_element_at("r.fields", F.lit(k))
    return d.select("id", "object", "r.section", get("Годовой лимит").try_cast("double").alias("annual_limit"), get("Код статьи").alias("code"), "place")


@query(
    "response_classes",
    f"""SELECT event_id AS id, CASE WHEN k = 5 THEN 'report' WHEN k < 5 THEN 'records' WHEN k = 7 THEN 'unknown' ELSE 'text' END AS kind, CAST(CASE WHEN k = 5 THEN 5 WHEN k < 5 THEN len(held) ELSE 0 END AS INT) AS n_records,
CASE WHEN k IN (6, 8, 9) THEN event_type END AS answer FROM (SELECT *, event_id % {FORMS} AS k, {HELD} AS held FROM events)""",
)
def response_classes(spark, sf_dir):
    return j.classified(payloads(spark, sf_dir))


@query(
    "answer_extraction",
    """SELECT conv_id * 1000 + turn AS id, nullif(CASE WHEN regexp_matches(text, '^\\s*(\\[\\s*\\]|\\{\\s*\\}|null|"")\\s*$') THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, '') AS answer FROM conversations""",
)
def answer_extraction(spark, sf_dir):
    """The text of every turn, wrapped by its number in one of four ways."""
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    text = F.substring(text, F.lit(6), F.length(text) - 6)
    shapes = [("[", "]"), ('{"answer": [], "output": {"text": ', "}}"), ('{"choices": [{"message": {"content": ', '}}], "data": 1}'), ('{"json": {"json": {"reply": {"body": [', ', 1]}}}, "data": "no"}')]
    wrapped = F.lit(None).cast("string")
    for k, (a, b) in enumerate(shapes):
        wrapped = F.when(F.col("turn") % len(shapes) == k, F.concat(F.lit(a), text, F.lit(b))).otherwise(wrapped)
    return j.walked(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), wrapped.alias("payload"))).select("id", "answer")


@query(
    "record_text",
    f"""WITH {ARTICLES_SQL} SELECT id, place, array_to_string(list_filter(['Приоритет: ' || priority, 'Код статьи: ' || code, 'Наименование статьи: ' || name,
'Годовой лимит: ' || replace(format('{{:,}}', CAST(annual_limit AS BIGINT)), ',', chr(160)), 'Текущий лимит: ' || replace(format('{{:,}}', CAST(current_limit AS BIGINT)), ',', chr(160)),
'Факт: ' || replace(format('{{:,}}', CAST(fact AS BIGINT)), ',', chr(160)), 'Остаток: ' || replace(format('{{:,}}', CAST(current_limit - fact AS BIGINT)), ',', chr(160))], lambda x: x IS NOT NULL), chr(10)) AS shown FROM articles""",
)
def record_text(spark, sf_dir):
    """Every article as lines of text, with what is left of its limit."""
    d = json_articles(spark, sf_dir)
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    number = records.shown_number
    rest = F.col("current_limit") - F.col("fact")
    parts = [line("Приоритет", F.col("priority")), line("Код статьи", F.col("code")), line("Наименование статьи", F.col("name")), line("Годовой лимит", number(F.col("annual_limit"))), line("Текущий лимит", number(F.col("current_limit"))), line("Факт", number(F.col("fact"))), line("Остаток", number(rest))]
    return d.select("id", "place", F.array_join(F.array_compact(F.array(*parts)), "\n").alias("shown"))
