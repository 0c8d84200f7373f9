"""Numbered sections of a document: headers, spans, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t

#: Keys by number, fixed values.
KEYS = {1: "info_card", 2: "general", 3: "tz", 4: "contract", 5: "forms", 6: "nmcd"}
HEADER = "(?iu)^\\s*раздел\\s*[№#]?\\s*([1-6])\\s*(?:[—–\\-.:]\\s*)?([^;]{0,120})"


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, number, section, title, chars, text: the last header of each number up to the next.

    Lines that end in a semicolon are a table of contents and don't count.
    """
    lines = F.split(F.regexp_replace(t.text("text"), "\\r\\n?", "\n"), "\n", -1)
    d = docs.select("doc_id", F.posexplode(lines).alias("line", "body"))
    real = ~F.rtrim("body").endswith(";") & F.col("body").rlike(HEADER)
    d = d.withColumn("number", F.when(real, F.regexp_extract("body", HEADER, 1).cast("int")))
    last = F.max(F.when(F.col("number").isNotNull(), F.col("line"))).over(Window.partitionBy("doc_id", "number"))
    d = d.withColumn("head", F.when(F.col("number").isNotNull() & (F.col("line") == last), F.col("number")))
    upto = Window.partitionBy("doc_id").orderBy("line")
    d = d.withColumn("of", F.last("head", ignorenulls=True).over(upto)).where("of IS NOT NULL")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    title = F.max(F.when(F.col("head").isNotNull(), F.regexp_extract("body", HEADER, 2)))
    names = F.create_map(*[F.lit(x) for kv in KEYS.items() for x in kv])
    d = d.groupBy("doc_id", F.col("of").alias("number")).agg(t.strip(body).alias("text"), t.strip(title).alias("title"))
    return d.select("doc_id", "number", names[F.col("number")].alias("section"), "title", F.length("text").alias("chars"), "text")


def missing(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, detected, missing, structure_ok of every document."""
    by = sections.groupBy("doc_id").agg(F.sort_array(F.collect_set("section")).alias("detected"))
    every = F.array(*[F.lit(k) for k in KEYS.values()])
    d = docs.select("doc_id").join(by, "doc_id", "left").withColumn("detected", F.coalesce("detected", F.array().cast("array<string>")))
    return d.withColumn("missing", F.array_except(every, F.col("detected"))).withColumn("structure_ok", F.size("missing") == 0)
