"""The audit against filters that are really applied, in every order."""

import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb

from tessera.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "doc_id long, text string, lang string, part string, quality int"


def fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        yield (
            i,
            lang or "",
            {
                "A": len(w) < 200,
                "B": 100 * len(set(w)) < 50 * len(w),
                "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                "D": bool(re.search("[#$%&*|]", t)),
                "E": i is not None and i > least[t],
            },
        )


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    docs = list(fails(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in docs if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(removed),
                    sum(d[1][x] for d in gone),
                    sum(f[x] and sum(f.values()) == 1 for _, p, f in docs if p == part),
                    sum(d[0] in good for d in removed),
                    sum(d[0] in toxic for d in removed),
                ]
                shapley[part, x] += len(removed)
                gone += removed
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    named = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, lang string")
    return sorted(tuple(r[c] for c in COLUMNS) for r in filter_audit.audit(docs, named).collect())


LONG = " ".join(f"w{i}" for i in range(250))


def test_defined_cases(spark):
    rows = [
        (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "en"), (None, LONG, "en"), (None, LONG, None), (5, None, ""), (4, "", None), (6, None, None),
        (7, "A#" + LONG, "en"), (8, "x " * 400, "fr"), (9, LONG.upper(), "fr"), (9, LONG.upper(), "fr"), (10, LONG.upper() + "|", "fr"), (11, "x\x0by\x1cz " * 90, "fr"), (12, LONG, "fr"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1), (10, 0, 0)]
    assert found(spark, rows, labels) == brute(rows, labels)
    assert found(spark, rows, []) == brute(rows, [])
    assert found(spark, [], labels) == []


def test_small_table_by_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = brute([(r["doc_id"], r["text"], r["lang"]) for r in docs], labels)
    out = sorted(tuple(r[c] for c in COLUMNS) for r in filter_audit.op13_filter_audit(spark, d).collect())
    assert out == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert sorted(con.sql(filter_audit.SQL).select(*COLUMNS).fetchall()) == want


def test_shares_are_exact():
    """What a monomial gives each of its variables is a whole number of 120ths."""
    assert all((Fraction(1, d) * len(filter_audit.ORDERS)).denominator == 1 for d in range(1, 6))
