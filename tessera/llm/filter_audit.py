"""Filter interaction audit: what each of five filters removes, in every order, and its Shapley value.

1. Each document gets a mask of the filters it fails.  Equal texts fail alike but for E, which all of them fail but those with
   the least doc_id; so texts are counted by hash with their least doc_id, and never held against each other.
2. Of each part at most 32 mask counts are left.  They give the multilinear extension of "documents removed by a set of
   filters": f(x) = sum over masks m of c(m) * (1 - product over i in m of (1 - x_i)), kept as the whole coefficients
   of its monomials, for all documents, for good and for toxic ones.
3. A filter's Shapley value is the integral of its partial derivative along the diagonal: a monomial of d variables that
   holds the filter counts 1/d.  120/d is whole for d up to 5, so the sum over all 120 orders is exact.  The polynomial at the
   corner of a set of filters says what the set removes, hence what survives after every step of every order.

All is in DataFrame operations.

Defined cases: a null text counts as empty, a null lang as the empty string; a missing doc_id is smaller than none and no
other is smaller: such rows never fail E and make no other fail it, and have no labels; repeated rows count each, and those
with the least doc_id of their text don't fail E; of several labels of a doc_id one with 1 is enough, a null label is no 1; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import content_key, let, table, words

FILTERS = "ABCDE"
#: Sets of filters as numbers, and orders of all filters.
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
SYMBOLS = "[#$%&*|]"
COUNTS = ("n", "good", "toxic")
#: Over so many tasks rows without a doc_id are dealt.
SPREAD = 4096


def own_failures(text: Column) -> Column:
    """The mask of A to D for a text that isn't null."""
    by_words = let(
        words(text),
        lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w), 2).otherwise(0),
    )
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return by_words + F.when(100 * upper > MAX_UPPER_PERCENT * F.length(text), 4).otherwise(0) + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of a part by the filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"), *content_key(text))
    d = d.withColumn("spread", F.when(F.col("doc_id").isNull(), 1 + F.pmod("h1", F.lit(SPREAD))).otherwise(F.lit(0)))
    named = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    d = d.join(named.withColumn("none", F.lit(0).cast("long")), (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("none")), "left")
    kind = ["h1", "h2", "part", "own", "good", "toxic"]
    # By row, then by text: a text of many copies comes to the shuffle as a few rows a task.
    d = d.groupBy("doc_id", "spread", *kind).count()
    d = d.groupBy(*kind).agg(
        F.sum("count").alias("n"), F.min("doc_id").alias("least"), F.min_by("count", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("count")).otherwise(0)).alias("nameless")
    )
    first = F.min("least").over(Window.partitionBy("h1", "h2"))
    kept = F.col("nameless") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    d = d.withColumn("first", kept)
    by_mask = F.array(F.struct(F.col("own").alias("mask"), F.col("first").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    d = d.select("part", "good", "toxic", F.explode(by_mask).alias("m")).select("part", "m.mask", "m.n", "good", "toxic")
    only = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return d.groupBy("part", "mask").agg(F.sum("n").alias("n"), only("good"), only("toxic"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _sets() -> Column:
    return F.sequence(F.lit(0), F.lit(SETS - 1))


def _within(inner: Column, outer: Column) -> Column:
    return inner.bitwiseAND(outer) == inner


def polynomial(cells: Column, count: str) -> Column:
    """The coefficients of the monomials by set of variables, from the mask counts."""

    def coefficient(s: Column) -> Column:
        held = _total(F.transform(F.filter(cells, lambda c: _within(s, c["mask"])), lambda c: c[count]))
        return F.when(s == 0, F.lit(0).cast("long")).when(F.bit_count(s) % 2 == 1, held).otherwise(-held)

    return F.transform(_sets(), coefficient)


def corners(coefficients: Column) -> Column:
    """The polynomial where the variables of a set are 1 and the others 0, for every set."""
    return F.transform(_sets(), lambda s: _total(F.transform(F.filter(_sets(), lambda t: _within(t, s)), lambda t: F.get(coefficients, t))))


def shapley(coefficients: Column, bit: Column) -> Column:
    """The integral of the partial derivative by one variable along the diagonal, as a whole number of 120ths."""
    n = len(ORDERS)
    share = lambda t: F.get(coefficients, t) * (F.lit(n) / F.bit_count(t)).cast("long")
    return _total(F.transform(F.filter(_sets(), lambda t: t.bitwiseAND(bit) != 0), share))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step."""
    cells = F.collect_list(F.struct("mask", *COUNTS))
    parts = mask_counts(docs, labels).groupBy("part").agg(F.sum("n").alias("all"), cells.alias("cells"))
    parts = parts.select("part", "all", *[polynomial(F.col("cells"), c).alias(f"p_{c}") for c in COUNTS])
    values = F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda i: shapley(F.col("p_n"), F.call_function("shiftleft", F.lit(1), i)))
    parts = parts.select("part", "all", values.alias("values"), *[corners(F.col(f"p_{c}")).alias(c) for c in COUNTS])
    rows = parts.select("*", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = lambda k: F.ascii(F.substring("filter_order", k, F.lit(1))) - ord(FILTERS[0])
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: F.call_function("shiftleft", F.lit(1), letter(k)))
    rows = rows.withColumn("bits", bits)
    total = lambda k: F.aggregate(F.slice("bits", F.lit(1), k), F.lit(0), lambda acc, x: acc + x)
    rows = rows.select("*", total(F.col("step") - 1).alias("before"), total(F.col("step")).alias("after"), F.get("bits", F.col("step") - 1).alias("bit"))
    at = lambda c, s: F.get(F.col(c), s)
    lost = lambda c: at(c, F.col("after")) - at(c, F.col("before"))
    every = F.lit(SETS - 1)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("all") - at("n", F.col("after"))).alias("kept"),
        lost("n").alias("removed"),
        (at("n", F.col("bit")) - lost("n")).alias("redundant"),
        (at("n", every) - at("n", every - F.col("bit"))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("values", letter(F.col("step"))).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
named AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
     100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
  FROM w LEFT JOIN named ON named.doc_id = w.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
runs AS (
  SELECT f.part, filter_order, good, toxic, fails,
    coalesce(list_position([fails[ascii(filter_order[k]) - 64] FOR k IN [1, 2, 3, 4, 5]], true), 6) AS gone
  FROM f, orders),
steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM runs),
marked AS (SELECT *, ascii(filter_order[step]) - 64 AS own FROM steps),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (fails[own] AND gone < step) AS redundant,
    count(*) FILTER (fails[own] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    count(*) FILTER (gone = step AND good = 1) AS good_lost, count(*) FILTER (gone = step AND toxic = 1) AS toxic_lost
  FROM marked GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
