"""Quality rules: repetition counts and distribution divergence, in DataFrame operations only.

Each document's character-class histogram and common-word histogram are held against the reference of its language
(the sums over all documents of that language, null being a language of its own) by Jensen-Shannon distance: base 2,
square root, 0 to 1.  Both have a minimum length, below which they do not vote.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rule; repeated rows and
equal texts get equal values; an empty table gives an empty result; columns besides doc_id, text and lang are ignored;
equally frequent common words are taken in code-point order.  The common words of all languages are broadcast while they
are at most MAX_BROADCAST rows, else joined by word.
"""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialise, table, words

SYMBOLS = "[#*$%&|<>]"
#: What is deleted to leave each class of characters; symbols and white space are counted anyway, the rest are other letters.
CLASSES = {"upper": "[^\\p{Lu}]+", "digit": "[^0-9]+", "point": "[^.,;:!?'\"()-]+"}
N_COMMON = 32
LETTERS = ascii_letters[:N_COMMON]
MAX_BROADCAST = 200_000
MIN_WORDS = 50
MIN_CHARS = 200
MAX_CHAR_DISTANCE = 0.30


def max_word_distance(n_words: Column) -> Column:
    """Short texts scatter more: 0.30 and a term that falls with the root of the length."""
    return F.lit(0.30) + F.lit(1.2) / F.sqrt(n_words)


def repeated_words(w: Column) -> Column:
    """Number of words that lie in 3-word windows found twice or more in the array."""

    def by_order(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda e, i: (e["h"] == F.get(s, i + 1)["h"]) | (e["h"] == F.get(s, i - 1)["h"]))
        return let(ordered, lambda s: F.transform(same(s), lambda e: e["i"]))

    def by_list(h: Column, twice: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i).otherwise(F.lit(-1)))
        return F.array_remove(at, -1)

    def covered(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
        starts = let(twice, lambda t: F.when(F.size(t) <= 24, by_list(h, t)).otherwise(by_order(h)))
        return let(starts, lambda a: F.size(F.array_distinct(F.concat(a, F.transform(a, lambda i: i + 1), F.transform(a, lambda i: i + 2)))))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def divergence(p: Column, q: Column) -> Column:
    """The terms of twice the Jensen-Shannon divergence for one bin."""
    m = (p + q) / 2
    side = lambda a: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    return side(p) + side(q)


def distance(doubled: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), doubled / 2))


def features(docs: DataFrame) -> DataFrame:
    """docs: doc_id, lang, text and common, the common words of the language; p: how often each stands in the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "common", text.alias("text"))
    d = d.select("*", words(F.col("text")).alias("w"))
    count = lambda drop: F.length(F.regexp_replace("text", drop, "")).cast("long")
    d = d.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("n_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        let(F.col("w"), repeated_words).cast("long").alias("n_repeat_words"),
        *[count(drop).alias(f"c_{k}") for k, drop in CLASSES.items()],
        let(marks(F.col("w"), F.col("common")), occurrences_of).alias("p"),
    )
    return d.withColumn("c_space", F.col("n_chars") - F.col("word_chars")).withColumn(
        "c_lower", F.col("word_chars") - F.col("n_symbols") - sum((F.col(f"c_{k}") for k in CLASSES), F.lit(0))
    )


BINS = ["c_lower", "c_space", "n_symbols", *[f"c_{k}" for k in CLASSES]]


def marks(w: Column, common: Column) -> Column:
    """A letter for each word: which of the common ones it is, or a dot."""
    mark = lambda x: F.substring(F.lit("." + LETTERS), F.array_position(common, x).cast("int") + 1, 1)
    # Words longer than any common one needn't be looked up.
    longest = F.coalesce(F.array_max(F.transform(common, F.octet_length)), F.lit(0))
    return let(longest, lambda n: F.array_join(F.transform(F.transform(w, F.lower), lambda x: F.when(F.octet_length(x) <= n, mark(x)).otherwise(".")), ""))


def occurrences_of(found: Column) -> Column:
    """How often each letter stands in marks."""
    return F.array(*[F.length(found) - F.length(F.replace(found, F.lit(c), F.lit(""))) for c in LETTERS])


def common_words(docs: DataFrame, n: int = N_COMMON) -> DataFrame:
    """lang, word, k, n: the n most frequent words of each language, lower-cased."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    each = docs.select("lang", F.explode(words(F.lower(F.coalesce(F.col("text"), F.lit(""))))).alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(by)).where(F.col("k") <= n)


def histogram_distance(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares."""
    return distance(F.aggregate(F.zip_with(p, q, divergence), F.lit(0.0), lambda acc, x: acc + x))


def assess(docs: DataFrame) -> DataFrame:
    """The documents' counts, distances and verdict; see the module's text."""
    same_lang = lambda a, b: a["lang"].eqNullSafe(b["lang"])
    ranks = range(1, N_COMMON + 1)
    common = materialise(common_words(docs))
    by_lang = common.groupBy("lang").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("common"),
        F.array(*[F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)) for i in ranks]).alias("q"),
    )
    hint = F.broadcast if by_lang.count() <= MAX_BROADCAST // N_COMMON else lambda d: d
    spread = hint(by_lang)
    d = docs.select("doc_id", "lang", "text")
    d = d.join(spread.select("lang", "common"), same_lang(d, spread), "left").drop(spread["lang"])
    f = materialise(features(d.withColumn("common", F.coalesce("common", F.array().cast("array<string>")))))
    sums = f.groupBy("lang").agg(
        F.sum("n_words").alias("lang_words"), F.sum("n_chars").alias("lang_chars"), F.array(*[F.sum(c) for c in BINS]).alias("r")
    )
    spread = by_lang.select("lang", "q")
    reference = hint(sums.join(spread, same_lang(sums, spread), "left").drop(spread["lang"]))
    d = f.join(reference, same_lang(f, reference), "left").drop(reference["lang"])

    zeros = F.array(*[F.lit(0.0) for _ in ranks])
    with_rest = lambda a: let(
        a, lambda x: F.concat(x, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(x, F.lit(0.0), lambda s, v: s + v))))
    )
    d = d.select(
        "*",
        F.when(
            F.col("n_chars") > 0,
            histogram_distance(
                F.transform(F.array(*BINS), lambda x: x / F.col("n_chars")), F.transform("r", lambda x: x / F.col("lang_chars"))
            ),
        ).alias("js_chars"),
        F.when(
            F.col("n_words") > 0,
            histogram_distance(
                with_rest(F.coalesce(F.transform("p", lambda x: x / F.col("n_words")), zeros)),
                with_rest(F.coalesce(F.transform("q", lambda x: x / F.col("lang_words")), zeros)),
            ),
        ).alias("js_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = ((F.col("n_chars") >= MIN_CHARS) & (F.col("js_chars") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("js_words") > max_word_distance(F.col("n_words")))
    )
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"),
        F.round("js_chars", 6).alias("js_chars"),
        F.round("js_words", 6).alias("js_words"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
