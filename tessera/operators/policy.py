"""Intents of questions, enriched questions, and which passages come first for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t

#: Word beginnings that show an intent, and terms that are added for it; fixed values.
CHECK = ["провер", "аудит", "соответств", "замечан", "ошиб", "оцен"]
AUCTION = "аукцион"
DEADLINE = ["срок", "заяв", "подач", "прием", "приём", "окончан", "календар", "извещ"]
CHECK_TERMS = ["требования положение о закупке 223-ФЗ", "информационная карта техническое задание договор НМЦД"]
DEADLINE_TERMS = [
    "пункт 2.13", "таблица 1", "Не менее 15 календарных дней до даты окончания срока подачи заявок", "Извещение/документация о проведении аукциона",
    "срок подачи заявок на участие в аукционе", "аукцион в электронной форме",
]
#: Needles of the table's row on auctions, and marks of a passage on the deadline; fixed values.
ROW, DAYS = "проведении аукциона", "15 календар"
MARKS = ["15 календар", "не менее 15", "таблица 1", "пункт 2.13", "п. 2.13"]


def any_of(low: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def full_check(question: Column) -> Column:
    return any_of(F.lower(question), CHECK)


def auction_deadline(question: Column) -> Column:
    low = F.lower(question)
    return F.contains(low, F.lit(AUCTION)) & any_of(low, DEADLINE)


def enriched(question: Column) -> Column:
    """The question with the terms of its intents, each once."""
    q = t.strip(question)
    terms = lambda test, xs: F.when(test, F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>"))
    extra = F.concat(terms(full_check(q), CHECK_TERMS), terms(auction_deadline(q), DEADLINE_TERMS))
    return F.concat_ws(" ", F.array(q), F.filter(extra, lambda x: F.lower(x) != F.lower(q)))


def table_row(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit(ROW)) & F.contains(low, F.lit(DAYS))


def prioritised(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Hits (query_id, question, id, place, text) and what a second search adds, place by place: for questions on an auction's
    deadline the table's row first, then passages that bear its marks, then the rest; other questions keep their hits as they are.
    """
    asked = auction_deadline(F.col("question"))
    d = hits.withColumn("second", F.lit(0)).unionByName(extra.where(asked).withColumn("second", F.lit(1)))
    once = Window.partitionBy("query_id", "id").orderBy("second", "place")
    d = d.withColumn("n", F.row_number().over(once)).where("n = 1")
    tier = F.when(~asked, 2).when(table_row(F.col("text")), 0).when(any_of(F.lower("text"), MARKS), 1).otherwise(2)
    by = Window.partitionBy("query_id").orderBy("tier", "second", "place")
    return d.withColumn("tier", tier).withColumn("position", F.row_number().over(by)).select("query_id", "id", "tier", "position")


def picked_sections(sections: DataFrame, k: int) -> DataFrame:
    """Sections (case_id, number, full_check, score, text) with text: all of a case if it asks for a full check or has at most k, else the k of the best score."""
    by = Window.partitionBy("case_id")
    d = sections.where(t.strip(t.text("text")) != "").withColumn("available", F.count("*").over(by))
    d = d.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "number")))
    return d.where(F.col("full_check") | (F.col("available") <= k) | (F.col("rank") <= k)).drop("available", "rank")


def with_best_of_files(pool: DataFrame, candidates: DataFrame, limit: int, floor: float) -> DataFrame:
    """The pool (query_id, file_id, id, place) after the best candidate of each file that it lacks, if phrase, stems, words or meaning allow it; cut at max(3 limit, 4 files)."""
    best = Window.partitionBy("query_id", "file_id").orderBy(F.desc("phrase"), F.desc("stem"), F.desc("core_matches"), F.desc("score"), "id")
    first = candidates.withColumn("n", F.row_number().over(best)).where("n = 1").join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = first.where((F.col("phrase") > 0) | (F.col("stem") >= 20) | (F.col("core_matches") >= 2) | (F.col("semantic") >= floor * 0.85))
    files = candidates.groupBy("query_id").agg(F.count_distinct("file_id").alias("files"))
    d = first.selectExpr("query_id", "file_id", "id", "CAST(0 AS INT) AS part", "CAST(file_id AS BIGINT) AS by").unionByName(pool.selectExpr("query_id", "file_id", "id", "CAST(1 AS INT) AS part", "CAST(place AS BIGINT) AS by"))
    d = d.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "by"))).join(files, "query_id")
    return d.where((F.col("files") > 1) | (F.col("part") == 1)).where(F.col("position") <= F.greatest(F.lit(limit * 3), F.col("files") * 4)).select("query_id", "file_id", "id", "part", "position")


#: How many issues of a level a report shows, fixed values.
CAPS = {"error": 20, "warning": 15}


def capped(issues: DataFrame) -> DataFrame:
    """The first issues of each case and level (case_id, level, position), in order; tasks cut their own rows before they meet."""
    w = Window.partitionBy("case_id", "level").orderBy("position")
    d = issues.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(CAPS.values()))
    return d.where(F.col("n") <= F.when(F.col("level") == "error", CAPS["error"]).otherwise(CAPS["warning"])).drop("n")
