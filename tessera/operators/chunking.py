"""Pages to overlapping chunks: starts are a fixed stride, ends follow the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t


def chunk(pages: DataFrame, size: int = t.CHUNK_SIZE, overlap: int = t.CHUNK_OVERLAP) -> DataFrame:
    """file_id, page, text -> file_id, chunk_index, page, start, text.  Blank chunks are dropped before numbering."""
    stride = size - overlap
    ahead = Window.partitionBy("file_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    d = pages.withColumn("text", t.text("text")).withColumn("n", F.length("text"))
    d = d.withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where("n > 0")

    def piece(start: Column) -> Column:
        body = lambda w: t.strip(F.left(w, t.chunk_length(w, F.col("n") - start, size)))
        return F.struct(start.alias("start"), t.bind(F.substring(F.col("text"), start + 1, F.lit(size)), body).alias("body"))

    # Made before the explode, and an outer one: Spark would move the test below what makes the chunks, with the window cut anew at each mention of it.
    pieces = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(stride)), piece)
    d = d.select("file_id", "page", "offset", F.explode_outer(pieces).alias("p")).select("file_id", "page", "offset", "p.*").where("body <> ''")
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("page", "start")) - 1
    return d.select("file_id", number.alias("chunk_index"), "page", (F.col("offset") + F.col("start")).alias("start"), F.col("body").alias("text"))
