"""Checks between three documents, against a plain version."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessera.operators import cases


def test_unlike_is_what_the_ratio_says(spark):
    draw = random.Random(5)
    words = ["ул. ленина", "д. 5", "москва", "г.", "корпус", "", "область", "тверская"]
    pairs = [("", ""), ("a", ""), ("", "a"), ("abcd", "abcd"), ("x" * 250, "x" * 249 + "y"), ("abcde", "abcdf"), ("ab", "ba")]
    for _ in range(300):
        a = [draw.choice(words) for _ in range(draw.randint(0, 6))]
        b = [w if draw.random() < 0.85 else draw.choice(words) for w in a]
        pairs.append((" ".join(a).strip(), " ".join(b).strip()))
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for least in (0.7, 0.8):
        got = d.select("i", cases.unlike(F.col("a"), F.col("b"), least).alias("u"), cases.undecided(F.col("a"), F.col("b"), least).alias("open")).orderBy("i").collect()
        assert [r.u for r in got] == [(SequenceMatcher(None, a, b).ratio() if a and b else 0.0) < least for a, b in pairs]
        assert 0 < sum(r.open for r in got) < len(pairs)


def found(spark, *three):
    rows = [(i, k, x) for i, case in enumerate(three) for k, x in zip(cases.KINDS, case, strict=True) if x is not False]
    d = cases.of_three(spark.createDataFrame(rows, "case_id int, kind string, text string"))
    by = {i: [] for i in range(len(three))}
    for r in cases.cross_issues(d).collect():
        by[r.case_id].append((r.level, r.field))
    return d.count(), [sorted(by[i]) for i in by]


def test_documents_that_disagree(spark):
    n, got = found(
        spark,
        ("Адрес: г. Москва, ул. Ленина, д. 5\n77:01:0003022:1013 площадь 100 м2", "Адрес: г. Москва, ул. Ленина, д. 7\n77:01:0003022:1013 104 кв.м\nСобственник: Российская Федерация", "77:01:0003022:1013"),
        ("Адрес: г. Москва, ул. Ленина, д. 5\n77:01:0003022:1 100 м2 федерация", "Адрес: г. Тверь, пл. Мира, стр. 70\n77:01:0003022:2 106 м2\nСобственник: Российская Федерация", ""),
        ("77:01:0003022:1 и что сдаёт имущество города в аренду на торгах", "", None),
        ("x", "y", False),
        ("", "Собственник: ООО Ромашка", ""),
    )
    assert n == 4
    assert got == [[("warning", "landlord")], [("error", "address"), ("error", "area"), ("error", "cadastral")], [("warning", "cadastral")], [], []]


def test_the_third_address_counts(spark):
    same = "Адрес: г. Москва, ул. Ленина, д. 5"
    assert found(spark, (same, same, "Адрес: Калуга, проезд Южный, 110"), (same, "", same), ("", same, "Адрес: Калуга, проезд Южный, 110"))[1] == [[("error", "address")], [], [("error", "address")]]


def test_no_cases(spark):
    none = cases.of_three(spark.createDataFrame([], "case_id int, kind string, text string"))
    assert cases.cross_issues(none).count() == 0 and cases.validated(none, "2024-01-20", 30).count() == 0


def test_verdicts_count_all_checks(spark):
    rows = [(1, "auction", "текст"), (1, "register", ""), (1, "approval", "Согласовано. Директор 12.12.2023, 77:01:0003022:1013"), (2, "auction", "x"), (2, "register", "y")]
    d = cases.of_three(spark.createDataFrame(rows, "case_id int, kind string, text string"))
    (r,) = cases.validated(d, "2024-01-20", 30).collect()
    # One document alone has an identifier; the register is empty.
    assert (r.case_id, r.status, r.n_cross) == (1, "failed", 1) and r.score == 0 and r.n_errors > 1 and r.n_warnings > 1


def test_checks_are_made_once(spark):
    """Spark moves a test for arrays that aren't empty below what makes them, whose expressions then run twice."""
    d = cases.of_three(spark.createDataFrame([(1, "auction", "x")], "case_id int, kind string, text string"))
    plan = cases.cross_issues(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
