"""SimHash near-duplicates: meet-in-the-middle ball hashing.

1. A text's fingerprint: bit b is set if it is set in over half the XXH64 values (seed 42) of its N-word shingles, repeats
   included.  Tasks hash shingles of whole texts, PIECE bytes of words at a time.
2. Equal fingerprints collapse, with the least doc_id of each, before anything is compared.
3. Every distinct fingerprint emits all variants within half of RADIUS, so 65 at a radius of 2.  Two fingerprints that
   differ in at most RADIUS bits have a variant in common, and two with a variant in common differ in no more: fingerprints
   meet by a shuffle on variants.  A variant lies within half the radius of at most 65 fingerprints, so no group is larger,
   whatever the input.  Within a group each is linked with the next, which is verified by its bits; repeats go.
4. Components of the links; every row takes the least doc_id of its component.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; rows with
equal text have equal fingerprints; a missing doc_id is no candidate for component_id (null if a component has no other);
an empty table gives an empty result; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .graph import components

N = 3
SEED = 42
BITS = 64
RADIUS = 2
PIECE = 1 << 20

BLANK = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, some at a time.  What bytes.split takes for blanks is x20 and x09 to x0D."""
    start, held, sent = 0, [], False
    while start < len(text):
        cut = BLANK.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        words = held + text[start:end].lower().split()
        start = end
        if len(words) < N:
            held = words
            continue
        held = words[1 - N :]
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(begins[: len(words) - N + 1].tolist(), ends[N - 1 :].tolist(), strict=True)
        yield np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], np.uint64)
        sent = True
    if held and not sent:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """As a signed number."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text):
        for i in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint32)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in batch.column(1).cast(pa.binary())]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def ball(fp: Column) -> Column:
    """A fingerprint and all that differ from it in half of RADIUS bits."""
    found = F.array(fp)
    for _ in range(RADIUS // 2):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, lambda x: F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))))))
    return found


def links(fps: DataFrame) -> DataFrame:
    """The distinct links (a, b), a < b, that join what of the distinct fingerprints fp differs in at most RADIUS bits.

    Of the members of one variant's group each links with the next, so that components are whole and no group is expanded.
    """
    variants = fps.select("fp", F.explode(ball(F.col("fp"))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = variants.select(before.alias("a"), F.col("fp").alias("b")).where("a IS NOT NULL")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    marked = materialise(fingerprints(docs))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that adaptive execution can split what a frequent fingerprint has on the other side.
    classes = materialise(named.join(first, "root").select("fp", "component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), BITS // 4, "0").alias("fingerprint"), "component_id")
