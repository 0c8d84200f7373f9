"""Queries over fields, rules, sections, reports and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import charsets
from tessera.functions import fields as f
from tessera.functions import text as t
from tessera.operators import rules, sections, state
from tessera.plans.common import table
from tessera.plans.text_queries import STRIP

AS_OF = "2024-01-20 00:00:00"

PAPERS = [
    (1, "Адрес: г. Москва, ул. Ленина, д. 5\nКадастровый номер 77:01:0003022:1013, площадь 45,6 м², цена 1\u00a0234,50 руб. на 5 лет с 01.02.2024 по 31.02.2024"),
    (2, "Объект недвижимости 77:01:000302:7 и 77:01:0003020:2330; 45 кв.м, 12.5 кв. м; 1.234.567 руб; 300 рублей; 11 месяцев; 01/02/24"),
    (3, "Собственник: ФГУП «Вода»\nплощадь 100 м2 100 м2х\n5 000 ₽ и 10 ₽, 2 года, 3 мес. 7.8.99 12.12.2023"),
    (4, ""),
    (5, "Информация об объекте. Начальная цена договора. Срок аренды 5 лет. Требования к участникам. Порядок подачи заявок. Критерии оценки. Проект договора: предмет договора, срок действия, арендная плата, платежи, обязанности сторон, ответственность сторон, расторжение, заключительные положения. Место проведения, дата проведения. 77:01:0003022:1013"),
]
BOOKS = [
    (1, "РАЗДЕЛ № 1 Карта;\nРАЗДЕЛ № 2 Общее;\nтекст\nРАЗДЕЛ № 1. Информационная карта\nпервая строка\nвторая\nРаздел 2 — Общие сведения\nтело"),
    (2, "см. (РАЗДЕЛ № 3)\nраздел 3: ТЗ\nописание\r\nраздел 4 Проект\nдоговор\nраздел 5 Формы\nраздел 6 НМЦ\nраздел 1\nраздел 2"),
    (3, "без разделов"),
]
def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else (str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'")
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


def papers(spark, sf_dir):
    """All documents, and the papers of our own."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("case_id"), t.text("text").alias("text"))
    return docs.unionByName(spark.createDataFrame(PAPERS, "case_id long, text string"))


PAPERS_SQL = f"(SELECT doc_id + 1000 AS case_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM {values(PAPERS, 'case_id, text')})"
EDGE = "(?:$|[^\\p{L}\\p{N}_])"
BEFORE = "(?:^|[^\\p{L}\\p{N}_])"
DOUBLES = "list_filter(list_transform(regexp_extract_all(text, '{}', 1), lambda x: TRY_CAST(replace(replace(replace(x, ' ', ''), chr(160), ''), ',', '.') AS DOUBLE)), lambda x: x IS NOT NULL)"
CADASTRAL_SQL = f"regexp_extract_all(text, '{BEFORE}(\\d{{2}}:\\d{{2}}:\\d{{6,7}}:\\d+)', 1)"
AREAS_SQL = DOUBLES.format(f"(?i)(\\d+(?:[.,]\\d+)?)\\s*(?:кв\\.?\\s*м|м²|м2){EDGE}")
MONEY_SQL = DOUBLES.format("(?i)(\\d+(?:[ \u00a0.,]\\d+)*)\\s*(?:руб\\.?|рублей|₽)")


@query("extract_cadastral", f"SELECT case_id, {CADASTRAL_SQL} AS found, {CADASTRAL_SQL}[1] AS first FROM {PAPERS_SQL}")
def extract_cadastral(spark, sf_dir):
    found = f.cadastral(F.col("text"))
    return papers(spark, sf_dir).select("case_id", found.alias("found"), F.try_element_at(found, F.lit(1)).alias("first"))


@query("extract_areas", f"SELECT case_id, {AREAS_SQL} AS found FROM {PAPERS_SQL}")
def extract_areas(spark, sf_dir):
    return papers(spark, sf_dir).select("case_id", f.areas(F.col("text")).alias("found"))


@query("extract_money", f"SELECT case_id, {MONEY_SQL} AS found FROM {PAPERS_SQL}")
def extract_money(spark, sf_dir):
    return papers(spark, sf_dir).select("case_id", f.money(F.col("text")).alias("found"))


#: A unit's point counts only where a letter follows it; what ends a unit is read with it.
TERM_PATTERN = f"(?i)\\d+\\s*(?:мес\\.[\\p{{L}}\\p{{N}}_]|(?:лет|года|год|мес|месяц(?:ев|а)?){EDGE})"
UNIT_SQL = "CASE WHEN regexp_matches(x, '(?i)мес\\.[\\p{L}\\p{N}_]$') THEN 'мес.' ELSE lower(regexp_extract(x, '(?i)(лет|года|год|месяц(?:ев|а)?|мес)', 1)) END"


@query(
    "extract_terms",
    f"SELECT case_id, regexp_extract(x, '^\\d+') AS n, {UNIT_SQL} AS unit FROM (SELECT case_id, unnest(regexp_extract_all(text, '{TERM_PATTERN}')) AS x FROM {PAPERS_SQL})",
)
def extract_terms(spark, sf_dir):
    return papers(spark, sf_dir).select("case_id", F.explode(f.terms(F.col("text"))).alias("x")).select("case_id", F.col("x.n").cast("string").alias("n"), "x.unit")


#: All letters as x, so that the ends of words are those of ASCII.
DATES_SQL = "regexp_extract_all(regexp_replace(text, '[\\p{L}\\p{Nl}\\p{No}]', 'x', 'g'), '\\b\\d{1,2}[./]\\d{1,2}[./]\\d{2,4}\\b')"


@query(
    "extract_dates",
    f"""SELECT case_id, CAST(max(d) AS TIMESTAMP) AS latest, count(d) AS n FROM (SELECT case_id, TRY_CAST((CASE WHEN CAST(p[3] AS INT) < 100 THEN CAST(p[3] AS INT) + 2000 ELSE CAST(p[3] AS INT) END) || '-' || p[2] || '-' || p[1] AS DATE) AS d
FROM (SELECT case_id, string_split(replace(x, '/', '.'), '.') AS p FROM (SELECT case_id, unnest({DATES_SQL}) AS x FROM {PAPERS_SQL}))) WHERE d IS NOT NULL GROUP BY case_id""",
)
def extract_dates(spark, sf_dir):
    d = papers(spark, sf_dir).select("case_id", f.dates(F.col("text")).alias("d")).where(F.size("d") > 0)
    return d.select("case_id", F.array_max("d").cast("timestamp_ntz").alias("latest"), F.size("d").cast("long").alias("n"))


LINES_SQL = "string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"
LINE_SQL = lambda test: STRIP.format(f"list_filter({LINES_SQL}, lambda x: {test})[1]")
ADDRESS_SQL = "coalesce({}, {}, '')".format(
    LINE_SQL(f"regexp_matches(x, '(?i)адрес|местоположен|расположен') AND length({STRIP.format('x')}) > 15"),
    LINE_SQL(f"regexp_matches(x, '(?i){BEFORE}(?:(?:ул|пр|пер|г|обл)\\.[\\p{{L}}\\p{{N}}_]|район{EDGE})')"),
)
OWNER_SQL = f"coalesce({LINE_SQL("regexp_matches(x, '(?i)собственник|правообладатель') OR (regexp_matches(x, '(?i)росимущество|фгуп|муницип|российск') AND length(x) > 20)")}, '')"


@query("extract_hints", f"SELECT case_id, {ADDRESS_SQL} AS address, {OWNER_SQL} AS owner FROM {PAPERS_SQL}")
def extract_hints(spark, sf_dir):
    return papers(spark, sf_dir).select("case_id", f.address(F.col("text")).alias("address"), f.owner(F.col("text")).alias("owner"))


ISSUES_SQL = "SELECT case_id, level, field, severity FROM (" + " UNION ALL ".join(
    [f"SELECT case_id, 'error' AS level, '{n}' AS field, 'major' AS severity, NOT ({' OR '.join(f"contains(low, '{w}')" for w in ws)}) AS bad FROM p" for n, ws in rules.SECTIONS.items()]
    + [f"SELECT case_id, 'warning', '{n}', 'minor', NOT ({' OR '.join(f"contains(contract, '{w}')" for w in ws)}) FROM p" for n, ws in rules.CLAUSES.items()]
    + [
        f"SELECT case_id, 'error', 'cadastral', 'critical', len({CADASTRAL_SQL}) = 0 FROM p",
        f"SELECT case_id, 'warning', 'address', 'minor', {ADDRESS_SQL} = '' FROM p",
        f"SELECT case_id, 'warning', 'area', 'minor', len({AREAS_SQL}) = 0 FROM p",
        f"SELECT case_id, 'warning', 'price', 'minor', len({MONEY_SQL}) = 0 FROM p",
        f"SELECT case_id, 'warning', 'lease_term', 'minor', NOT regexp_matches(text, '{TERM_PATTERN}') FROM p",
    ]
) + ") WHERE bad"
LOW_SQL = "trim(regexp_replace(replace(lower({}), 'ё', 'е'), '\\s+', ' ', 'g'))"
CASES_SQL = f"p AS (SELECT case_id, text, {LOW_SQL.format('text')} AS low, {LOW_SQL.format("CASE WHEN contains(lower(text), 'проект договора') THEN substr(text, instr(lower(text), 'проект договора')) ELSE text END")} AS contract FROM {PAPERS_SQL})"


@query("keyword_rules", f"WITH {CASES_SQL} {ISSUES_SQL}")
def keyword_rules(spark, sf_dir):
    return rules.auction_issues(papers(spark, sf_dir))


VERDICT_SQL = """SELECT c.case_id, CAST(greatest(0, least(100, 100 - coalesce(cost, 0))) AS INT) AS score, CASE WHEN coalesce(e, 0) > 0 THEN 'failed' WHEN coalesce(w, 0) > 0 THEN 'warnings' ELSE 'passed' END AS status,
CAST(coalesce(e, 0) AS BIGINT) AS n_errors, CAST(coalesce(w, 0) AS BIGINT) AS n_warnings FROM cases c LEFT JOIN (SELECT case_id, sum(CASE WHEN level = 'error' AND severity = 'critical' THEN 12 WHEN level = 'error' THEN 8 ELSE 3 END) AS cost,
count(*) FILTER (WHERE level = 'error') AS e, count(*) FILTER (WHERE level <> 'error') AS w FROM issues GROUP BY case_id) i USING (case_id)"""


@query("validation_score", f"WITH {CASES_SQL}, issues AS ({ISSUES_SQL}), cases AS (SELECT case_id FROM p) {VERDICT_SQL}")
def validation_score(spark, sf_dir):
    return rules.scored(papers(spark, sf_dir), rules.auction_checks(F.col("text")))


@query(
    "status_rollup",
    f"""WITH cases AS (SELECT DISTINCT source AS case_id FROM documents), issues AS (SELECT d.source AS case_id, CASE WHEN l.quality = 0 THEN 'error' ELSE 'warning' END AS level,
CASE WHEN l.toxic = 1 THEN 'critical' ELSE 'major' END AS severity FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0 OR l.toxic = 1) {VERDICT_SQL}""",
)
def status_rollup(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    issues = docs.join(labels, "doc_id").where("quality = 0 OR toxic = 1").selectExpr("source AS case_id", "CASE WHEN quality = 0 THEN 'error' ELSE 'warning' END AS level", "CASE WHEN toxic = 1 THEN 'critical' ELSE 'major' END AS severity")
    return rules.verdict(docs.selectExpr("source AS case_id").distinct(), issues)


@query(
    "cross_validate_3way",
    """SELECT o_orderkey AS case_id, 'error' AS level, field, 'critical' AS severity FROM (SELECT o_orderkey, unnest(['cadastral', 'area']) AS field, unnest([len(list_distinct([n1, n2, n3])) > 1, a <> 0 AND b <> 0 AND abs(a - b) / greatest(a, b) > 0.05]) AS bad
FROM (SELECT o_orderkey, CAST(c_nationkey AS VARCHAR) AS n1, CAST(s_nationkey AS VARCHAR) AS n2, CAST(o_orderkey % 25 AS VARCHAR) AS n3, abs(c_acctbal) AS a, abs(s_acctbal) AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = o_custkey % 100)) WHERE bad""",
)
def cross_validate_3way(spark, sf_dir):
    o, c, s = (table(spark, sf_dir, x) for x in ("orders", "customer", "supplier"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("s_suppkey") == F.col("o_custkey") % 100)
    keys = F.array(F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string"), (F.col("o_orderkey") % 25).cast("string"))
    return rules.cross_issues(d.select(F.col("o_orderkey").alias("case_id"), keys.alias("keys"), F.abs("c_acctbal").alias("area_a"), F.abs("s_acctbal").alias("area_b")))


def books(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    return docs.unionByName(spark.createDataFrame(BOOKS, "doc_id long, text string"))


HEAD_SQL = sections.HEADER.replace("(?iu)", "(?i)")
NAMES_SQL = "CASE number " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in sections.KEYS.items()) + " END"
SECTIONS_SQL = f"""books AS (SELECT doc_id + 1000 AS doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM {values(BOOKS, "doc_id, text")}),
l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS body FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM books)),
h AS (SELECT *, CASE WHEN NOT ends_with(rtrim(body), ';') AND regexp_matches(body, '{HEAD_SQL}') THEN CAST(regexp_extract(body, '{HEAD_SQL}', 1) AS INT) END AS found FROM l),
m AS (SELECT *, CASE WHEN found IS NOT NULL AND line = max(CASE WHEN found IS NOT NULL THEN line END) OVER (PARTITION BY doc_id, found) THEN found END AS head FROM h),
o AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS number FROM m),
g AS (SELECT doc_id, number, {STRIP.format("max(CASE WHEN head IS NOT NULL THEN regexp_extract(body, '" + HEAD_SQL + "', 2) END)")} AS title, {STRIP.format("string_agg(body, chr(10) ORDER BY line)")} AS text FROM o WHERE number IS NOT NULL GROUP BY doc_id, number),
s AS (SELECT doc_id, number, {NAMES_SQL} AS section, title, CAST(length(text) AS INT) AS chars, text FROM g)"""


@query("split_sections", f"WITH {SECTIONS_SQL} SELECT * FROM s")
def split_sections(spark, sf_dir):
    return sections.split(books(spark, sf_dir))


@query(
    "required_minus_found",
    f"""WITH {SECTIONS_SQL}, d AS (SELECT books.doc_id, coalesce(list_sort(list_distinct(list(section) FILTER (WHERE section IS NOT NULL))), []) AS detected FROM books LEFT JOIN s USING (doc_id) GROUP BY books.doc_id),
r AS (SELECT *, list_filter({list(sections.KEYS.values())}, lambda k: NOT list_contains(detected, k)) AS missing FROM d)
SELECT doc_id, array_to_string(detected, ',') AS detected, array_to_string(missing, ',') AS missing, len(missing) = 0 AS structure_ok FROM r""",
)
def required_minus_found(spark, sf_dir):
    d = sections.missing(books(spark, sf_dir), sections.split(books(spark, sf_dir)))
    return d.select("doc_id", F.array_join("detected", ",").alias("detected"), F.array_join("missing", ",").alias("missing"), "structure_ok")


@query("json_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k IS NOT NULL")


@query(
    "budget_remainder",
    "SELECT l_suppkey, l_returnflag, round(sum(l_extendedprice), 2) AS annual_limit, round(sum(l_extendedprice * (1 - l_discount)), 2) AS fact, round(sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount)), 2) AS remainder FROM lineitem GROUP BY ALL",
)
def budget_remainder(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag")
    full, net = F.sum("l_extendedprice"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return d.agg(F.round(full, 2).alias("annual_limit"), F.round(net, 2).alias("fact"), F.round(full - net, 2).alias("remainder"))


@query(
    "object_report",
    "SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def object_report(spark, sf_dir):
    o, c, n, g = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query(
    "financial_result",
    "SELECT o_orderstatus, round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END), 2) AS income, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS expense, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS result FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def financial_result(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    back, price = F.col("l_returnflag") == "R", F.col("l_extendedprice")
    total = lambda a, b: F.round(F.sum(F.when(back, a).otherwise(b)), 2)
    return d.groupBy("o_orderstatus").agg(total(F.lit(0.0), price).alias("income"), total(price, F.lit(0.0)).alias("expense"), total(-price, price).alias("result"))


@query("session_history_ring", "SELECT user_id, event_id, CAST(place AS INT) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def session_history_ring(spark, sf_dir):
    return state.ring(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id", "place")


@query("latest_pointer", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def latest_pointer(spark, sf_dir):
    return state.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "event_id")


CACHE_SQL = "(SELECT event_id, user_id, ts AS parsed_at, CAST(event_id % 3 AS INT) AS version FROM events)"


def cache(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    return d.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("parsed_at"), (F.col("event_id") % 3).cast("int").alias("version"))


@query("ttl_cache_valid", f"SELECT event_id FROM {CACHE_SQL} WHERE version = 2 AND parsed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS")
def ttl_cache_valid(spark, sf_dir):
    return state.valid(cache(spark, sf_dir), AS_OF, 24, 2).select("event_id")


@query("dangling_index", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def dangling_index(spark, sf_dir):
    return state.dangling(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id")


@query("cache_lookup", f"SELECT u.user_id, max(v.event_id) AS event_id FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM {CACHE_SQL} WHERE version = 2 AND parsed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS) v USING (user_id) GROUP BY u.user_id")
def cache_lookup(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.join(state.valid(cache(spark, sf_dir), AS_OF, 24, 2), "user_id", "left").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("first_match", "SELECT doc_id, nullif(regexp_extract(text, '[0-9]+', 0), '') AS found FROM documents")
def first_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")).alias("found"))


@query("text_similarity_ratio")
def text_similarity_ratio(spark, sf_dir):
    d = spark.createDataFrame([(1, "закупка", "закупок"), (2, "г. Москва, ул. Ленина", "Москва, улица Ленина"), (3, "", "")], "id int, a string, b string")
    return d.select("id", F.round(charsets.similarity(t.normal(F.col("a")), t.normal(F.col("b"))), 6).alias("ratio"))


@query("decode_bytes")
def decode_bytes(spark, sf_dir):
    s = "Положение о закупке товаров, работ и услуг"
    rows = [(i, s.encode(c)) for i, c in enumerate(["utf-8", "utf-8-sig", "cp1251", "cp866", "koi8-r", "mac_cyrillic"])]
    d = spark.createDataFrame(rows, "id int, content binary")
    return d.select("id", charsets.decoded("content").alias("text"))


@query("mojibake_fix")
def mojibake_fix(spark, sf_dir):
    s = "Положение о закупке"
    d = spark.createDataFrame([(1, s.encode().decode("cp1251", "replace")), (2, s.encode().decode("latin-1")), (3, s)], "id int, text string")
    return d.select("id", charsets.repaired("text").alias("text"))


@query("homoglyph_fix")
def homoglyph_fix(spark, sf_dir):
    d = spark.createDataFrame([(1, "Cрок пoдачи зaявок a@mail.ru COM")], "id int, text string")
    return d.select("id", charsets.unmixed("text").alias("text"))
