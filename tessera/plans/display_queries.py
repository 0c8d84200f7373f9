"""Queries over answers made ready to be shown; the answers are the documents, whose lines get numbers, bullets and headings by their place."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import display
from tessera.functions import text as t
from tessera.plans.common import table

#: What stands before a line, by its place.
STARTS = ["7. ", "  3) ", "", "**12.** ", "- ", "Вывод: ", "\n4. ", "\n", "17.1 ", "пункты: 2) ", "📄 Документация по делу: ", "Где: ", "## ", "**Ответ:** "]
SQL_STARTS = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in STARTS) + "]"
ANSWERS_SQL = (
    f"answers AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {SQL_STARTS}[(doc_id + 5 * (i - 1)) % {len(STARTS)} + 1] || x), '{{}}') AS text FROM documents)"
)


def answers(spark, sf_dir, between: str = "\n"):
    starts = F.array(*map(F.lit, STARTS))
    lines = F.transform(F.split(t.text("text"), "\n", -1), lambda x, i: F.concat(F.get(starts, ((F.col("doc_id") + i * 5) % len(STARTS)).cast("int")), x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, between).alias("text"))


ITEM_SQL = "^(\\s*)(?:\\*\\*)?\\d{1,2}[.)](?:\\*\\*)?\\s+([^\\d\\s].*?)\\s*$"
ENDS_SQL = "(?i)^\\s*(?:[-*•]\\s|#{1,6}\\s+\\S|🔴|🟡|(?:📄|📋)\\s|(?:\\*\\*)?(?:Итоговый|Вывод|Заключение|Общий вывод|Документация|Вердикт)(?:[^\\p{L}\\p{N}_]|$))"
LINES_SQL = f"WITH {ANSWERS_SQL.format(chr(10))}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM answers)"


@query(
    "list_renumbering",
    f"""{LINES_SQL}, kinds AS (SELECT *, regexp_matches(line, '{ITEM_SQL}') AS item, lag(trim(line) = '', 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM lines),
lists AS (SELECT *, sum(CAST(NOT item AND (gap OR regexp_matches(line, '{ENDS_SQL}')) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM kinds WHERE trim(line) <> ''),
counted AS (SELECT *, sum(CAST(item AS INT)) OVER (PARTITION BY doc_id, part ORDER BY i) AS n FROM lists),
joined AS (SELECT doc_id, string_agg(CASE WHEN item THEN regexp_replace(line, '{ITEM_SQL}', '\\1' || n || '. \\2') ELSE line END, chr(10) ORDER BY i) AS shown FROM counted GROUP BY doc_id)
SELECT doc_id, coalesce(shown, '') AS shown FROM answers LEFT JOIN joined USING (doc_id)""",
)
def list_renumbering(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", display.renumbered(F.col("text")).alias("shown"))


LEADS_SQL = display.LEADS.replace("(?![а-яё])", "")
CONCLUSION_SQL = f"(?i)^(\\s*)((?:📄|📋)\\s*)?({LEADS_SQL}[^:]*?)\\s*:(.*)$"


@query(
    "bold_headings",
    f"""{LINES_SQL} SELECT doc_id, string_agg(CASE WHEN regexp_matches(line, '^\\s*\\*\\*.*\\*\\*') THEN line WHEN regexp_matches(line, '(?i)^\\s*(?:(?:📄|📋)\\s*)?{LEADS_SQL}[^:]{{0,100}}:') THEN regexp_replace(line, '{CONCLUSION_SQL}', '\\1\\2**\\3:**\\4')
ELSE regexp_replace(line, '(?i)^(\\s*)({display.LABELS}):(.*)$', '\\1**\\2:**\\3') END, chr(10) ORDER BY i) AS shown FROM lines GROUP BY doc_id""",
)
def bold_headings(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", display.bold_headings(F.col("text")).alias("shown"))


MARKER_SQL = "((?:\\*\\*)?\\d{1,2}[.)](?:\\*\\*)?\\s+[^\\d\\s])"


@query(
    "numbered_breaks",
    f"WITH {ANSWERS_SQL.format(' ')} SELECT doc_id, regexp_replace(regexp_replace(text, '([:;—–])\\s+{MARKER_SQL}', '\\1' || chr(10) || '\\2', 'g'), '(^|[^\\d])([.!?…»])\\s+{MARKER_SQL}', '\\1\\2' || chr(10) || '\\3', 'g') AS shown FROM answers",
)
def numbered_breaks(spark, sf_dir):
    return answers(spark, sf_dir, " ").select("doc_id", display.numbered(F.col("text")).alias("shown"))


@query("display_text")
def display_text(spark, sf_dir):
    """The whole chain; a test holds it against a plain version."""
    return answers(spark, sf_dir).select("doc_id", display.shown(F.col("text")).alias("shown"))
