"""Cases of three documents (auction, register, approval), whose fields must agree."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fields as f
from tessera.functions import text as t
from tessera.operators import rules

KINDS = ("auction", "register", "approval")
#: Least likeness of addresses, and of an owner to the auction's papers; fixed values.
ADDRESS, LANDLORD = 0.80, 0.70


def of_three(docs: DataFrame) -> DataFrame:
    """case_id, kind, text -> case_id and a column of text a kind, of the cases that have all three; a kind that stands twice gives its greatest text."""
    texts = [F.max(F.when(F.col("kind") == k, t.text("text"))).alias(k) for k in KINDS]
    return docs.groupBy("case_id").agg(*texts).dropna(subset=list(KINDS))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        return None if x is None or y is None else SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def undecided(a: Column, b: Column, least: float) -> Column:
    """Whether the likeness of two normal texts must be measured: neither is empty, they differ, and their lengths allow the least likeness."""
    n, m = F.length(a), F.length(b)
    return (a != "") & (b != "") & (a != b) & (2.0 * F.least(n, m) / (n + m) >= least)


def unlike(a: Column, b: Column, least: float) -> Column:
    """Whether two normal texts are less alike than ``least``; Python sees those pairs alone that equality and lengths leave open."""
    open_pair = undecided(a, b, least)
    measured = _ratio(F.when(open_pair, a), F.when(open_pair, b))
    return F.when(a == b, a == "").otherwise(F.coalesce(measured < least, F.lit(True)))


def crossed(cases: DataFrame) -> DataFrame:
    """case_id, auction, register, approval (texts), and cross: an array of level, field, severity of what the documents disagree in.

    Identifiers: more than one, or known to one document only.  Addresses: any unlike that of the first document that has one.  Areas: apart by more than 5 %.
    Owner: neither like the auction's papers nor with a word of five letters in them.
    """
    first = lambda c: F.get(c, F.lit(0))
    d = cases.select(
        "case_id", *KINDS,
        F.array_compact(F.array(*[first(f.cadastral(F.col(k))) for k in KINDS])).alias("keys"),
        F.filter(F.array(*[t.normal(f.address(F.col(k))) for k in KINDS]), lambda x: x != "").alias("places"),
        first(f.areas(F.col("auction"))).alias("a"),
        first(f.areas(F.col("register"))).alias("b"),
        t.normal(f.owner(F.col("register"))).alias("owner"),
        t.normal(F.col("auction")).alias("papers"),
        (F.col("auction") != "").alias("written"),
    )
    place = lambda i: F.coalesce(F.get("places", F.lit(i)), F.get("places", F.lit(0)), F.lit(""))
    d = d.select("*", place(0).alias("p0"), place(1).alias("p1"), place(2).alias("p2"))
    c = {n: F.col(n) for n in ("keys", "places", "a", "b", "owner", "papers", "p0", "p1", "p2")}
    apart = (c["a"] != 0) & (c["b"] != 0) & (F.abs(c["a"] - c["b"]) / F.greatest("a", "b") > rules.AREA_TOLERANCE)
    named = F.exists(F.split("owner", " "), lambda w: (F.length(w) > 4) & F.contains(F.col("papers"), w))
    d = d.select(
        "case_id", *KINDS, "keys",
        ((F.size("places") > 1) & (unlike(c["p0"], c["p1"], ADDRESS) | unlike(c["p0"], c["p2"], ADDRESS))).alias("moved"),
        F.coalesce(apart, F.lit(False)).alias("apart"),
        ((c["owner"] != "") & F.col("written") & ~named & unlike(c["owner"], c["papers"], LANDLORD)).alias("stranger"),
    )
    found = [
        rules.issue(F.size(F.array_distinct("keys")) > 1, "error", "cadastral", "critical"), rules.issue(F.size("keys") == 1, "warning", "cadastral", "minor"), rules.issue(F.col("moved"), "error", "address", "critical"),
        rules.issue(F.col("apart"), "error", "area", "critical"), rules.issue(F.col("stranger"), "warning", "landlord", "minor"),
    ]
    return d.select("case_id", *KINDS, rules.as_array(found).alias("cross"))


def cross_issues(cases: DataFrame) -> DataFrame:
    """What ``crossed`` finds as rows: case_id, level, field, severity."""
    return rules.rows(crossed(cases), F.col("cross"))


def validated(cases: DataFrame, as_of: str, max_days: int) -> DataFrame:
    """The verdict of every case of three documents, in one pass: each one's own checks and those between them; and the number of the latter."""
    checks = [rules.auction_checks(F.col("auction")), rules.register_checks(F.col("register"), as_of, max_days), rules.approval_checks(F.col("approval"))]
    return rules.scored(crossed(cases).withColumn("n_cross", F.size("cross")), F.concat(*checks, F.col("cross")), "n_cross")
