"""Connected components of a table of links, for graphs of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    """What stays the same only if the edges do: their number and two sums over hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each node of the links (a, b) reaches; alternating large and small stars.

    Nodes in the links of no other node don't come up.  A node with many neighbours is one key of both joins.  The side with
    one row a node is a written table, so that both sides of the joins come straight from shuffles and adaptive execution
    splits the other side's rows of such a node over many tasks.  Minima are combined before they are shuffled.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges)
    state = _state(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large)
        own = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(own, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(small.where("u <> v").distinct())
        before, state = state, _state(edges)
        if before == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
