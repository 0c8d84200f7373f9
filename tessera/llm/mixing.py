"""Mixing sources to target weights.

The words of a source's documents, one document after the other, make its token stream, which is packed into blocks of
BLOCK tokens (the last may be shorter).  Targets share the corpus's size by weight, up to MAX_EPOCHS times a source.
Output shards of SHARD slots each (the last has what is left) draw their source counts: multinomial counts given that all
shards together take each source's quota, so totals are exact to half a block.  They are drawn down a tree, each half
from what its parent has, in groups of GROUP_SHARDS shards that share the quotas evenly.  Slot j of a source takes block
perm(j mod B) of epoch j div B, where perm is a keyed Feistel permutation of the source's B block numbers.  So the draws say
which blocks stand in which shard; ``packed`` returns the shards, and ``mix`` what they take of each document.

Only one row per source reaches the driver.  Order in a stream: chunk of the document's number, then doc_id, then size.

Defined cases: a null text has size 0; a source of null comes last; documents without words take nothing; without any
words all targets are 0; repeated rows are documents of their own; an empty table gives an empty result; other columns
are ignored by ``mix`` and ``packed``, and passed through by ``repeated``, whatever their names; there, rows of one doc_id,
source and size share evenly what the mix takes of them, also where doc_id is null.  Reruns agree, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, fresh, materialise, table, words

BLOCK = 32
SHARD = 1 << 16
MAX_EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20240
DOCS_PER_CHUNK = 4096
#: Shards whose draws make a tree, and slots that a task makes.
GROUP_SHARDS, SLOTS_PER_TASK = 4096, 1 << 19


def targets(sizes: list[int], weights: list[float], total: float) -> list[float]:
    """Share ``total`` by weight; what is above MAX_EPOCHS times a size is reshared until none is above."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > MAX_EPOCHS * sizes[i]}
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(MAX_EPOCHS * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key, at index: four Feistel rounds, walking until below n."""
    with np.errstate(over="ignore"):
        n = n.astype(np.uint64)
        half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1) / 2)).astype(np.uint64)
        mask = (np.uint64(1) << half) - np.uint64(1)
        out, todo = index.astype(np.uint64), np.arange(len(index))
        key = key.astype(np.uint64)
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(4):
                left, right = right, left ^ (mix64(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def block_of(slot: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    j, b = slot.to_numpy(), n.to_numpy()
    return pd.Series(permute(j % b, b, key.to_numpy() * np.int64(1000003) + j // b))


def shares_of(quota: np.ndarray, group: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The first slot of each source in a group of shards, and how many it has there."""
    edge = lambda k: np.array([int(q) * k // groups for q in quota], dtype=np.int64)
    return edge(group), edge(group + 1) - edge(group)


def drawn(have: np.ndarray, group: int, first: int, last: int, shard: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard of the group, counts by source) for shards first to last of so many slots, which together take have."""
    if last - first == 1:
        yield first, have
        return
    middle = (first + last + 1) // 2
    rng = np.random.Generator(np.random.Philox(key=[SEED, (group << 32) | (first << 16) | last]))
    left = rng.multivariate_hypergeometric(have, (middle - first) * shard, method="marginals")
    yield from drawn(left, group, first, middle, shard)
    yield from drawn(have - left, group, middle, last, shard)


def draws(spark: SparkSession, quota: list[int]) -> DataFrame:
    """source_id, shard, first (slot of the source), n: a row for each source of each shard."""
    q = np.array(quota, dtype=np.int64)
    size, in_group = SHARD, GROUP_SHARDS
    groups = max(1, -(-int(q.sum()) // (size * in_group)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group in pdf["id"]:
                first, have = shares_of(q, int(group), groups)
                for shard, n in drawn(have, int(group), 0, max(1, -(-int(have.sum()) // size)), size):
                    yield pd.DataFrame({"source_id": np.arange(len(q), dtype=np.int64), "shard": np.int64(group * (in_group + 1) + shard), "first": first, "n": n})
                    first = first + n

    return spark.range(0, groups, 1, min(groups, 1000)).mapInPandas(draw, "source_id long, shard long, first long, n long").where("n > 0")


def slots(spark: SparkSession, sources: DataFrame, quota: list[int]) -> DataFrame:
    """source_id, block, shard: a row for each slot of the mix."""
    d = draws(spark, quota).join(F.broadcast(sources.select("source_id", "n_blocks")), "source_id")
    d = d.repartition(max(1, -(-sum(quota) // SLOTS_PER_TASK)), "source_id", "shard")
    d = d.select("source_id", "n_blocks", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    return d.select("source_id", block_of("slot", "n_blocks", "source_id").alias("block"), "shard", "slot")


def laid_out(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The rows of docs with source_id, size, source_size, target and start (in the source's stream); the sources; their quotas."""
    spark = docs.sparkSession
    sizes = materialise(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    found = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).orderBy(F.asc_nulls_last("source")).collect()
    n = [r["n"] for r in found]
    goal = targets(n, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(n))], sum(n))
    blocks = [-(-x // BLOCK) for x in n]
    quota = [min(MAX_EPOCHS * b, round(t * b / x)) if x else 0 for x, b, t in zip(n, blocks, goal, strict=True)]
    chunks = max(1, sum(r["docs"] for r in found) // DOCS_PER_CHUNK)

    schema = "s_source string, source_id long, source_size long, target double, n_blocks long, quota long"
    rows = [(r["source"], i, n[i], goal[i], blocks[i], quota[i]) for i, r in enumerate(found)]
    sources = spark.createDataFrame(rows, schema)
    d = sizes.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s_source")))
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)))

    per_chunk = d.groupBy("source_id", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.select("source_id", "chunk", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_id", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(per_chunk, ["source_id", "chunk"]).withColumn("start", F.col("offset") + F.col("ahead"))
    return materialise(d.select("doc_id", "source", "source_id", "size", "source_size", "target", "start")), sources, quota


def size_of(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def pieces(d: DataFrame) -> DataFrame:
    """source_id, block, start, doc_id, skip, overlap: which words of a document (after skip) stand in which block."""
    end = F.col("start") + F.col("size")
    d = d.where("size > 0").select("doc_id", "source_id", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    low, high = F.greatest("start", F.col("block") * BLOCK), F.least("end", (F.col("block") + 1) * BLOCK)
    return d.select("source_id", "block", "start", "doc_id", (low - F.col("start")).alias("skip"), (high - low).alias("overlap"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    d, sources, quota = laid_out(docs)
    if not sum(quota):
        return d.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    times = slots(docs.sparkSession, sources, quota).groupBy("source_id", "block").agg(F.count("*").alias("times"))
    taken = dealt(pieces(d)).join(times, ["source_id", "block"]).groupBy("source_id", "start").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    taken = taken.toDF("t_id", "t_start", "taken")
    d = dealt(d).join(taken, (F.col("source_id") == F.col("t_id")) & (F.col("start") == F.col("t_start")) & (F.col("size") > 0), "left")
    return d.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def packed(docs: DataFrame) -> DataFrame:
    """shard, place, source, words: the mix itself, a row for each block of each shard, in a pseudorandom order of places.

    Of rows that share doc_id, source and size, which have equal places in the stream, each stands where the one of its rank by text does.
    """
    d, sources, quota = laid_out(docs)
    if not sum(quota):
        return docs.sparkSession.createDataFrame([], "shard long, place long, source string, words array<string>")
    same = Window.partitionBy("doc_id", "source", "size")
    d = d.withColumn("rank", F.row_number().over(same.orderBy("start")))
    full = docs.select("doc_id", "source", "text", size_of(F.col("text")).alias("size")).withColumn("rank", F.row_number().over(same.orderBy("text")))
    full = full.where("size > 0").toDF("f_id", "f_source", "text", "f_size", "f_rank")
    match = F.col("doc_id").eqNullSafe(F.col("f_id")) & F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size")) & (F.col("rank") == F.col("f_rank"))
    own = dealt(d).join(full, match).select(F.col("source_id").alias("o_id"), F.col("start").alias("o_start"), words(F.col("text")).alias("w"))
    parts = dealt(pieces(d)).join(own, (F.col("start") == F.col("o_start")) & (F.col("source_id") == F.col("o_id")))
    parts = parts.select("source_id", "block", "start", F.slice("w", (F.col("skip") + 1).cast("int"), F.col("overlap").cast("int")).alias("part"))
    blocks = parts.groupBy("source_id", "block").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))
    blocks = blocks.select("source_id", "block", F.flatten(F.transform("parts", lambda p: p["part"])).alias("words"))
    out = dealt(slots(docs.sparkSession, sources, quota)).join(blocks, ["source_id", "block"]).join(F.broadcast(sources.select("source_id", F.col("s_source").alias("source"))), "source_id")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "source_id", "slot"), "source_id", "slot")).cast("long")
    return out.select("shard", place.alias("place"), "source", "words")


def repeated(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whole: each as often as the mix takes its words, taken / size rounded up or down by a hash of doc_id.

    So the words of a source come near its target, and no document is there more than MAX_EPOCHS times.
    """
    m_id, m_source, m_size, size, times, turn = (fresh(docs, c) for c in ("m_id", "m_source", "m_size", "size", "times", "turn"))
    m = mix(docs).where("size > 0").groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.count("*") / F.col("size")).alias(times)).where(F.col(times) > 0)
    m = m.toDF(m_id, m_source, m_size, times)
    d = docs.withColumn(size, size_of(F.col("text")))
    d = d.join(m, F.col("doc_id").eqNullSafe(F.col(m_id)) & F.col("source").eqNullSafe(F.col(m_source)) & (F.col(size) == F.col(m_size)))
    dither = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    d = d.withColumn(times, F.floor(F.col(times) + dither).cast("int")).where(F.col(times) > 0)
    return d.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")
