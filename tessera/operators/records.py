"""Semi-structured reports to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import jsonwalk

EMPTY = ["", "[]", "{}", "null", '""', "[object Object]"]


def is_empty(payload: Column) -> Column:
    return payload.isNull() | F.trim(payload).isin(EMPTY)


def articles(payloads: DataFrame) -> DataFrame:
    """id, payload (JSON) -> id, place and the fields of every article, wherever the payload wraps it."""
    d = jsonwalk.walked(payloads).select("id", F.posexplode("records").alias("place", "m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return d.select(
        "id", "place", get("Приоритет").alias("priority"), get("Код статьи").alias("code"), get("Наименование статьи").alias("name"),
        get("Годовой лимит").try_cast("double").alias("annual_limit"), get("Текущий лимит").try_cast("double").alias("current_limit"), get("Факт").try_cast("double").alias("fact"),
    )


def first_of_each(rows: DataFrame) -> DataFrame:
    """Of rows with one code and priority the first; rows with neither are one."""
    w = Window.partitionBy("id", F.concat_ws("|", F.coalesce("code", F.lit("")), F.coalesce("priority", F.lit("")))).orderBy("place")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def with_remainder(rows: DataFrame) -> DataFrame:
    """What is left of the current limit, where some row of a payload has both a limit and a fact."""
    shown = F.bool_or(F.col("current_limit").isNotNull() & F.col("fact").isNotNull()).over(Window.partitionBy("id"))
    return rows.withColumn("remainder", F.when(shown, F.col("current_limit") - F.col("fact")))


def filled_columns(rows: DataFrame) -> list[str]:
    """The columns that aren't empty in all rows: one row to the driver."""
    r = rows.agg(*[F.bool_or(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")).alias(c) for c in rows.columns]).first()
    return [c for c in rows.columns if r[c]]


def grouped_number(c: Column, digits: int = 2) -> Column:
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit("\u00a0"))


def shown_number(c: Column) -> Column:
    """Whole numbers without decimals, others with two; thousands apart."""
    return F.when(c == F.floor(c), grouped_number(c, 0)).otherwise(grouped_number(c, 2))
