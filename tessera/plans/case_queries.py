"""Queries over cases of three documents; their texts are written from orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import cases
from tessera.plans.common import table

TAKEN = "orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = o_custkey % 100"
KEY, SITE = "'Кадастровый номер 77:01:0003022:' || ", "'Адрес объекта: г. Москва, ' || c_mktsegment || ', дом ' || c_custkey"
#: The texts by kind: what stands in an order's number says in which of their fields they differ.
TEXTS = {
    "auction": f"concat_ws('\\n', {KEY} (o_custkey + 1), {SITE}, 'площадь ' || abs(c_acctbal) || ' кв.м', 'Извещение о торгах на право заключения договора аренды', CASE WHEN o_orderkey % 3 = 0 THEN 'от имени ' || s_name END)",
    "register": f"concat_ws('\\n', CASE WHEN o_orderkey % 7 <> 0 THEN {KEY} (o_custkey + 1 + CAST(o_orderkey % 5 = 0 AS INT)) END, CASE WHEN o_orderkey % 4 = 1 THEN 'Адрес: ' || repeat('иной корпус ', 20) ELSE {SITE} END, 'площадь ' || abs(s_acctbal) || ' м2', 'Собственник: ' || s_name, '10.01.2024')",
    "approval": f"concat_ws('\\n', CASE WHEN o_orderkey % 2 = 0 THEN {KEY} (o_custkey + 1) END, CASE WHEN o_orderkey % 4 <> 2 THEN {SITE} END, 'Согласовано 12.01.2024')",
}


def three(spark, sf_dir):
    o, c, s = (table(spark, sf_dir, x) for x in ("orders", "customer", "supplier"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("s_suppkey") == F.col("o_custkey") % 100)
    papers = [F.struct(F.lit(kind).alias("kind"), F.expr(text).alias("text")) for kind, text in TEXTS.items()]
    return cases.of_three(d.select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(*papers)).alias("d")).select("case_id", "d.*"))


#: Addresses are equal or of lengths too far apart, owners far shorter than the papers, so that SQL can tell; tests measure what lies between.
CROSS_SQL = f"""SELECT o_orderkey AS case_id, level, field, severity FROM (SELECT o_orderkey, unnest(['error', 'warning', 'error', 'error', 'warning']) AS level, unnest(['cadastral', 'cadastral', 'address', 'area', 'landlord']) AS field,
unnest(['critical', 'minor', 'critical', 'critical', 'minor']) AS severity, unnest([o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0, o_orderkey % 7 = 0 AND o_orderkey % 2 = 1, o_orderkey % 4 = 1,
a <> 0 AND b <> 0 AND abs(a - b) / greatest(a, b) > 0.05, o_orderkey % 3 <> 0]) AS bad FROM (SELECT *, abs(c_acctbal) AS a, abs(s_acctbal) AS b FROM {TAKEN})) WHERE bad"""


@query("cross_validate_texts", CROSS_SQL)
def cross_validate_texts(spark, sf_dir):
    return cases.cross_issues(three(spark, sf_dir))


@query(
    "validate_case",
    f"WITH n AS (SELECT case_id, count(*) AS n FROM ({CROSS_SQL}) GROUP BY case_id) SELECT o_orderkey AS case_id, 'failed' AS status, CAST(0 AS INT) AS score, CAST(coalesce(n, 0) AS INT) AS n_cross FROM {TAKEN} LEFT JOIN n ON case_id = o_orderkey",
)
def validate_case(spark, sf_dir):
    """The auctions' papers lack what rules ask for, so that all cases fail."""
    return cases.validated(three(spark, sf_dir), "2024-01-20", 30).select("case_id", "status", "score", "n_cross")
