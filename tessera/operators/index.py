"""Nearest neighbours by inverted lists: vectors are stored by the nearest of trained centroids, and queries probe a few lists.

Centroids are fitted on at most SAMPLE vectors that a hash of the id picks; every vector is indexed.  Their number grows with the
root of the vectors', up to a share of the sample.  A list is stored in parts of about PART vectors, so that a task of a probe holds one part
however long the list.  Probing finds candidates; among them similarities are exact.  ``retrieval.nearest`` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import matrix

SAMPLE, ROUNDS, PART = 20_000, 8, 50_000
#: The share of lists that a query probes, and how many at least.  Vectors without clusters, as those of the given tables, take this
#: many for a recall above 0.9 (0.94 and 0.95 there; a quarter of the lists gave 0.75); where vectors cluster a small share does.
PROBED, FEWEST = 0.6, 8


def centroids(vectors: DataFrame, rows: int) -> np.ndarray:
    """Unit rows, from a few rounds of spherical k-means over the sample."""
    share = min(1.0, SAMPLE / max(1, rows))
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("id", "embedding").orderBy("id").limit(2 * SAMPLE).toArrow()
    if not len(picked):
        return np.zeros((0, 0))
    x = matrix(picked.column("embedding"), len(picked))
    lists = max(1, min(round(2 * rows**0.5), len(x) // 8))
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=lists) > 0
        c[held] = sums[held] / np.maximum(np.linalg.norm(sums[held], axis=1, keepdims=True), 1e-300)
    return c


def build(vectors: DataFrame, path: str) -> np.ndarray:
    """Writes list, part, id, embedding of all vectors (id, embedding) under a path, and returns the centroids."""
    spark = vectors.sparkSession
    c = centroids(vectors, vectors.count())
    shared = spark.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = (matrix(batch.column(1), len(batch)) @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], names=["list", "id", "embedding"])

    placed = vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(run, f"list int, id long, embedding {vectors.schema['embedding'].dataType.simpleString()}")
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("parts"))
    sizes.write.parquet(f"{path}/sizes")
    parted = placed.join(spark.read.parquet(f"{path}/sizes"), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "embedding")
    parted.repartition("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/lists")
    return c


def probed(queries: DataFrame, path: str, c: np.ndarray, k: int, share: float = PROBED) -> DataFrame:
    """query_id, id, semantic, rank: the k nearest that the probed lists hold; queries (query_id, embedding) stay on the executors."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(c)
    vector = queries.schema["embedding"].dataType.simpleString()

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n = min(len(c), max(FEWEST, -int(-len(c) * share // 1)))
        for batch in batches:
            if len(batch) and n:
                s = matrix(batch.column(1), len(batch)) @ c.T
                lists = np.argpartition(-s, n - 1, axis=1)[:, :n]
                own = batch.take(pa.array(np.repeat(np.arange(len(batch)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), *own.columns], names=["list", "query_id", "embedding"])

    def best(stored: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "id", "semantic"]
        if not len(stored) or not len(asked):
            return pa.table({n: pa.array([], pa.float64() if n == "semantic" else pa.int64()) for n in names})
        s = np.round(np.maximum(0.0, matrix(asked.column("embedding"), len(asked)) @ matrix(stored.column("embedding"), len(stored)).T), 9)
        ids, of = stored.column("id").to_numpy(), asked.column("query_id").to_numpy()
        top = [np.lexsort((ids, -row))[:k] for row in s]
        at = np.concatenate(top)
        who = np.repeat(np.arange(len(of)), [len(x) for x in top])
        return pa.table({"query_id": of[who], "id": ids[at], "semantic": s[who, at]})

    aimed = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(aim, f"list int, query_id long, embedding {vector}")
    aimed = aimed.join(spark.read.parquet(f"{path}/sizes"), "list").select("list", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), "query_id", "embedding")
    stored = spark.read.parquet(f"{path}/lists")
    found = stored.groupBy("list", "part").cogroup(aimed.groupBy("list", "part")).applyInArrow(best, "query_id long, id long, semantic double")
    order = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, hits, recall: how many of the exact neighbours (query_id, id) were found, over all queries."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
