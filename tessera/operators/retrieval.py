"""Retrieval: exact nearest neighbours, rank fusion, selection, neighbour context, packing and citations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring

#: Queries scored in one block; more are taken block by block, each with its own scan.
QUERY_BLOCK = 4096
#: Characters of the phrases that one scan looks for.
PHRASE_CHARS = 16_000_000


def stated_queries(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a stated query set (query_id, embedding), by id; it goes to the driver as Arrow, so it is to be a bounded one."""
    t = queries.select("query_id", "embedding").orderBy("query_id").toArrow()
    return t.column(0).to_numpy(), matrix(t.column(1), len(t))


def matrix(column: pa.ChunkedArray | pa.ListArray, rows: int) -> np.ndarray:
    """A list column as rows of length 1, from the values' buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def similarities(q: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    return np.round(np.maximum(0.0, q @ matrix(batch.column("embedding"), len(batch)).T), 9)


def blocks(queries: DataFrame, one) -> DataFrame:
    """What ``one`` makes of (ids, vectors) of each block of the stated queries, together."""
    ids, q = stated_queries(queries)
    parts = [one(ids[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK]) for i in range(0, max(1, len(ids)), QUERY_BLOCK)]
    return reduce(DataFrame.unionByName, parts)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, per_file: bool = False) -> DataFrame:
    """query_id, id, file_id, semantic: the k chunks (id, file_id, embedding) most similar to each stated query, by cosine.

    Every task keeps its own k best per query (and file), so that only those are shuffled; ties go to the least id.
    """
    keys = ["query_id", "file_id"] if per_file else ["query_id"]
    best = Window.partitionBy(*keys).orderBy(F.desc("semantic"), "id")
    out = blocks(queries, lambda ids, q: _block(chunks, ids, q, k, per_file))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block(chunks: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, per_file: bool) -> DataFrame:
    def best(s: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The k best columns of one row of similarities; ties at the edge by id."""
        if len(s) > k:
            some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        else:
            some = np.arange(len(s))
        return some[np.lexsort((key[some], -s[some]))[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            s = similarities(q, batch)
            key, file = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            groups = [np.flatnonzero(file == f) for f in np.unique(file)] if per_file else [np.arange(len(batch))]
            found = [(i, g[best(s[i, g], key[g])]) for g in groups for i in range(len(q))]
            r, c = np.concatenate([np.full(len(top), i) for i, top in found]), np.concatenate([top for _, top in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(key[c]), pa.array(file[c].astype(np.int32)), pa.array(s[r, c])], names=["query_id", "id", "file_id", "semantic"])

    return chunks.select("id", "file_id", "embedding").mapInArrow(run, "query_id long, id long, file_id int, semantic double")


def best_of_queries(chunks: DataFrame, queries: DataFrame, floor: float) -> DataFrame:
    """id, best, first_query: of each chunk the greatest similarity to a stated query, and the least query that reaches the floor; made where the chunk is."""

    def one(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch) and len(ids):
                    s = similarities(q, batch)
                    first = np.where(s >= floor, ids[:, None], np.iinfo(np.int64).max).min(axis=0)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.max(axis=0)), pa.array(first, mask=first == np.iinfo(np.int64).max)], names=["id", "best", "first_query"])

        return chunks.select("id", "embedding").mapInArrow(run, "id long, best double, first_query long")

    return blocks(queries, one).groupBy("id").agg(F.max("best").alias("best"), F.min("first_query").alias("first_query"))


def containing(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """item_id, doc_id: which documents (doc_id, text) hold which stated phrases (item_id, phrase) as they are.

    An automaton of at most PHRASE_CHARS characters of phrases goes to the tasks; more phrases take more scans.
    """
    import ahocorasick

    stated = [(r["item_id"], r["phrase"]) for r in phrases.where(F.length("phrase") > 0).orderBy("item_id").toLocalIterator()]
    parts, held = [[]], 0
    for i, p in stated:
        if held + len(p) > PHRASE_CHARS and parts[-1]:
            parts.append([])
            held = 0
        parts[-1].append((i, p))
        held += len(p)

    def one(some: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, list[int]] = {}
            for i, p in shared.value:
                found.setdefault(p, []).append(i)
            machine = ahocorasick.Automaton()
            for p, items in found.items():
                machine.add_word(p, items)
            machine.make_automaton()
            for batch in batches:
                rows = [(i, d) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text and found for i in {i for _, items in machine.iter(text) for i in items}]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["item_id", "doc_id"])

        return docs.select("doc_id", "text").mapInArrow(run, "item_id long, doc_id long")

    return reduce(DataFrame.unionByName, map(one, parts))


def fused(hits: DataFrame) -> DataFrame:
    """rrf: the sum over the semantic and the keyword ranking of 1 / (60 + rank)."""
    by = Window.partitionBy("query_id")
    d = hits.withColumn("rank_semantic", F.row_number().over(by.orderBy(F.desc("semantic"), "id")))
    d = d.withColumn("rank_keyword", F.row_number().over(by.orderBy(F.desc("keyword"), "id")))
    return d.withColumn("rrf", F.lit(1.0) / (scoring.RRF_K + F.col("rank_semantic")) + F.lit(1.0) / (scoring.RRF_K + F.col("rank_keyword")))


def scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.expr(scoring.combined()))


def ordered(*keys: str):
    return [F.expr(k.removesuffix(" DESC")).desc() if k.endswith(" DESC") else F.expr(k).asc() for k in keys]


def rank_keys():
    return ordered(*[k.strip() for k in scoring.RANK_ORDER.split(", ")])


def ranked(hits: DataFrame) -> DataFrame:
    """place: strong phrases first (or, without any, hits with all core words), then by the eight keys; the best semantic ones before all."""
    by = Window.partitionBy("query_id")
    d = fused(scored(hits)).withColumn("base_rank", F.row_number().over(by.orderBy(*rank_keys())))
    strong = (F.col("phrase") >= 20) | (F.col("stem") >= 28)
    d = d.withColumn("any_strong", F.max(strong.cast("int")).over(by))
    full = (F.col("n_core") >= 2) & (F.col("core_matches") >= F.col("n_core"))
    first = F.when(F.col("any_strong") == 1, strong).otherwise(full)
    d = d.withColumn("tier", F.when(F.col("rank_semantic") <= 8, 0).when(first, 1).otherwise(2))
    inside = F.when(F.col("tier") == 0, F.col("rank_semantic").cast("double"))
    inside = inside.when((F.col("tier") == 1) & (F.col("any_strong") == 0), -F.col("phrase") * 1000 - F.col("score"))
    d = d.withColumn("inside", inside.otherwise(F.col("base_rank").cast("double")))
    return d.withColumn("place", F.row_number().over(by.orderBy("tier", "inside", "base_rank")))


def balanced(hits: DataFrame, k: int, files: int) -> DataFrame:
    """The first k of each query after at least so many of every file: file by file, then by place."""
    least = max(2 if k >= 4 and files >= 2 else 1, k // max(1, files))
    per = Window.partitionBy("query_id", "file_id").orderBy(F.desc("phrase"), F.desc("core_matches"), F.desc("score"), "place")
    d = hits.withColumn("in_file", F.row_number().over(per))
    seed = F.col("in_file") <= least
    by = Window.partitionBy("query_id").orderBy(F.when(seed, 0).otherwise(1), F.when(seed, F.col("file_id")), F.when(seed, F.col("in_file")), "place")
    return d.withColumn("pick", F.row_number().over(by)).where(F.col("pick") <= k)


def neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks next to hits that aren't hits themselves."""
    around = hits.select("file_id", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")).distinct()
    return around.join(hits.select("file_id", "chunk_index"), ["file_id", "chunk_index"], "left_anti").join(chunks, ["file_id", "chunk_index"])


def context(chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Each chunk's text with its neighbours', in order, equal texts once."""
    w = Window.partitionBy("file_id").orderBy("chunk_index").rangeBetween(-radius, radius)
    return chunks.withColumn("context", F.array_join(F.array_distinct(F.collect_list("text").over(w)), "\n\n"))


def packed(parts: DataFrame, limit: int, least: int = 200) -> DataFrame:
    """Parts (group_id, position, text) of each group up to ``limit`` characters; the first that doesn't fit is cut if enough room is left."""
    w = Window.partitionBy("group_id").orderBy("position")
    d = parts.withColumn("n", F.length("text")).withColumn("upto", F.sum("n").over(w)).withColumn("room", F.lit(limit) - (F.col("upto") - F.col("n")))
    d = d.withColumn("over", (F.col("upto") > limit).cast("int")).withColumn("n_over", F.sum("over").over(w))
    fits, cut = F.col("n_over") == 0, (F.col("over") == 1) & (F.col("n_over") == 1) & (F.col("room") > least)
    d = d.where(fits | cut)
    return d.select("group_id", "position", F.when(F.col("over") == 0, F.col("text")).otherwise(F.concat(F.left("text", F.col("room").cast("int") - 1), F.lit("…"))).alias("text"), (F.col("over") == 0).alias("cited"))


def cited(answers: DataFrame, citations: DataFrame, fallback: int = 5) -> DataFrame:
    """The citations whose number an answer names in brackets; if it names none, the first few."""
    named = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit("\\[(\\d+)\\]"), F.lit(1)))).alias("number")).select("answer_id", F.col("number").cast("int").alias("number"))
    hit = citations.join(named, ["answer_id", "number"], "left_semi")
    none = citations.where(F.col("number") <= fallback).join(hit.select("answer_id").distinct(), "answer_id", "left_anti")
    return hit.unionByName(none)


def numbered_citations(*parts: DataFrame) -> DataFrame:
    """question_id, place, and what is cited, in tables of the same columns -> all of them, with the id that answers cite.

    Ids count from 1 in each question: the first table's citations by place, then the next one's, which so start behind them.
    """
    rows = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    d = rows[0]
    for more in rows[1:]:
        d = d.unionByName(more)
    return d.withColumn("id", F.row_number().over(Window.partitionBy("question_id").orderBy("part", "place")))
