"""Files that arrive in a folder, taken into a collection once: a stream of files, parsed, chunked and stored batch by batch.

A file is known by the hash of its bytes.  A batch parses the files that the collection hasn't got, the least path of those with equal bytes, so a batch that runs
again after a lost driver, a lost checkpoint or a second copy adds nothing.  Files that can't be read are rows with their error beside the collection; empty files too.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import chunk
from tessera.sources import collections, files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def process(found: DataFrame) -> DataFrame:
    """PAGES -> file_id, filename, chunk_index, page, start, text; pages with an error have no chunks."""
    good = found.where("error IS NULL")
    names = good.groupBy("file_id").agg(F.min("filename").alias("filename"))
    return chunk(good.select("file_id", "page", "text")).join(names, "file_id").select("file_id", "filename", "chunk_index", "page", "start", "text")


def unknown(batch: DataFrame, store: str, collection: str) -> DataFrame:
    """Of the files of a batch, those whose bytes the collection hasn't got, each once; contents aren't shuffled.

    Only the batch's own files are looked up in the collection, which isn't listed, so a batch takes no longer as it grows.  The driver holds their paths.
    """
    hashed = batch.select("path", F.left(F.sha2("content", 256), F.lit(12)).alias("file_id"))
    first = hashed.groupBy("file_id").agg(F.min("path").alias("path")).collect()
    had = collections.stored(batch.sparkSession, store, collection, [r["file_id"] for r in first])
    new = batch.sparkSession.createDataFrame(pa.table({"path": pa.array([r["path"] for r in first if r["file_id"] not in had], pa.string())}))
    return batch.join(F.broadcast(new), "path", "left_semi")


def ingest(spark: SparkSession, path: str, store: str, collection: str, work: str, files_per_batch: int = 1000) -> None:
    """Takes in what stands under ``path`` now and wasn't taken before; ``work`` holds the checkpoint and each batch's pages."""

    def take(batch: DataFrame, number: int) -> None:
        # Parsed once: chunks and errors are read from what was written, which a repeated batch writes anew.
        pages = f"{work}/pages/batch={number}"
        files.pages(unknown(batch, store, collection)).write.mode("overwrite").parquet(pages)
        collections.append(process(batch.sparkSession.read.schema(files.PAGES).parquet(pages)), store, collection)

    stream = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    stream.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()


def errors(spark: SparkSession, work: str) -> DataFrame:
    """file_id, filename, error of the files that gave no page."""
    return spark.read.schema(files.PAGES).parquet(f"{work}/pages").where("error IS NOT NULL").select("file_id", "filename", "error").distinct()
