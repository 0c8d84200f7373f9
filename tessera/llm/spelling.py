"""Spelling variant grouping: rare-first bigram prefix filter with exact verification.

1. Tasks count the words of whole texts, and send each word once with its number.
2. Bigrams are ordered by how many words of the vocabulary hold them (ties by code points), rarest first.  One edit takes at most two bigrams of a
   word away, and moves the others by one place at most.  So of the PREFIX = 3 first bigrams of each of two near words (in that
   order, equal ones by place) one stands in both and is untouched by the edit.
3. The limit on places: the edit lies on one side of the bigram, so either all up to it is equal, at equal places from the
   start, or all from it on, at equal places from the end.  Words join only on the piece up to a rare bigram or from
   it on and on their length; parities of letters, which an edit changes in two places at most, and then the words are
   compared in the join, so that only near pairs leave it.
4. A word's form is the near word of largest n; roots are found by doubling the steps along forms.

The number of bigrams is bounded by the alphabet (90 letters, so 8,100), which is what the driver and tasks hold.

Defined cases: a null text has no words; a missing doc_id gives an empty string where words are marked for change; repeated rows
count each; an empty table gives an empty result; very long texts are read in pieces cut between runs; columns besides
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, materialise, table

RUN = re.compile(rb"[a-z\xC0-\xFF]+")
OTHER = re.compile(rb"[^A-Za-z\xC0-\xFF]")
EVERY = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
PREFIX = 3
#: Words a task holds before it sends their numbers, and bytes of a text that are read at once.
HELD, PIECE = 1 << 19, 1 << 20


def runs(text: str) -> Counter:
    """The runs of a text and how often each stands there, in Latin-1, where all letters of runs have one byte."""
    raw, found, start = text.encode("latin-1", "replace"), Counter(), 0
    while start < len(raw):
        cut = OTHER.search(raw, start + PIECE)
        end = cut.start() if cut else len(raw)
        found.update(RUN.findall(raw[start:end].lower()))
        start = end
    return found


def changed(doc_id: int | None, found: Counter) -> Iterator[tuple[bytes, int]]:
    """The runs of a document, one letter deleted where the checksum says so."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= MIN_LENGTH:
            yield run, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of all words."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    for word, n in changed(doc_id, runs(text.as_py())):
                        counts[word] += n
                if len(counts) >= HELD:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return sent.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The rank of each bigram, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                counts.update({w[k : k + 2] for k in range(len(w) - 1)})
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], names=["bigram", "n"])

    counts = words.select("word").mapInArrow(run, "bigram string, n long").groupBy("bigram").agg(F.sum("n").alias("n")).collect()
    return {r["bigram"]: k for k, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["bigram"])))}


def parities(word: str) -> int:
    """Which letters stand in a word an odd number of times; an edit changes at most two of them."""
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) & 63)
    return bits - (bits >> 63 << 64)


def rare_pieces(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """piece, size, parity, word, n: what stands up to each of a word's rarest bigrams, and from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pieces, own_words = [], [], batch.column(0).to_pylist()
            for i, w in enumerate(own_words):
                first = sorted((order[w[k : k + 2]], k) for k in range(len(w) - 1))[:PREFIX]
                own = {p for _, k in first for p in ("<" + w[: k + 2], w[k:] + ">")}
                pieces += own
                at += [i] * len(own)
            cols = [pa.array([len(w) for w in own_words], pa.int32()), pa.array(map(parities, own_words), pa.int64()), batch.column(0), batch.column(1)]
            named = pa.record_batch(cols, names=["size", "parity", "word", "n"]).take(pa.array(at, pa.int64()))
            yield pa.record_batch([pa.array(pieces, pa.string()), *named.columns], names=["piece", *named.schema.names])

    return words.select("word", "n").mapInArrow(run, "piece string, size int, parity long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: the distinct pairs of near words, each once."""
    pieces = rare_pieces(words, bigram_order(words))
    left = pieces.toDF("piece", "size", "parity_a", "a", "n_a")
    # Words of one length meet once, those of two as the shorter and the longer.
    right = pieces.select(F.col("piece").alias("p"), F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("s"), F.col("size").alias("size_b"), F.col("parity").alias("parity_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    fits = F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= 2
    fits &= (F.col("size_b") > F.col("size")) | (F.col("a") < F.col("b"))
    fits &= F.levenshtein("a", "b", 1) == 1
    both = dealt(left).join(dealt(right), (F.col("piece") == F.col("p")) & (F.col("size") == F.col("s")) & fits)
    return both.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form.  Every step at least doubles n, so that a few doublings reach the end."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        step = materialise(now.select(F.col("word").alias("root"), F.col("root").alias("next")))
        new = materialise(dealt(now).join(dealt(step), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if not new.where("moved").take(1):
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = materialise(vocabulary(docs))
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    d = dealt(words).join(best, "word", "left")
    form_n = -F.col("best.less")
    is_form = form_n >= RATIO * F.col("n")
    d = d.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, form_n).alias("form_n"))
    d = materialise(d)
    return dealt(d).join(dealt(roots(d.where("form IS NOT NULL"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
