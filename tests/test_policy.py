"""Operators without SQL against plain versions, and stated cases."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessera.functions import display
from tessera.functions import lexicon as lx
from tessera.functions import text as t
from tessera.operators import lexical, policy, rules
from tessera.plans.policy_queries import NOTES


def test_registers_and_approvals(spark):
    texts = [
        (1, "Адрес объекта: г. Москва, ул. Ленина\nСобственник: Российская Федерация\n77:01:0003022:1013\n10.01.2024"), (2, "Правообладатель: Иванов\nарест 01.01.2020"), (3, " \n"), (4, None),
        (5, "Согласовано. Директор 12.12.2023, 77:01:0003022:1013"), (6, "без всего"),
    ]
    d = spark.createDataFrame(texts, "case_id long, text string")
    by = lambda rows: {k: sorted((r.level, r.field) for r in rows if r.case_id == k) for k in range(1, 7)}
    register = by(rules.register_issues(d, "2024-01-20", 30).collect())
    assert register[1] == [] and register[3] == register[4] == [("error", "text")]
    assert register[2] == [("error", "cadastral"), ("error", "extract_date"), ("warning", "address"), ("warning", "encumbrances"), ("warning", "owner")]
    # 31 days old is too old, 30 is not.
    edge = spark.createDataFrame([(1, "21.12.2023"), (2, "20.12.2023")], "case_id long, text string")
    assert {r.case_id for r in rules.register_issues(edge, "2024-01-20", 30).collect() if r.field == "extract_date"} == {2}
    # What a severity defaults to.
    assert {r.severity for r in rules.register_issues(d, "2024-01-20", 30).collect() if r.level == "error"} == {"critical"}
    approval = by(rules.approval_issues(d).collect())
    assert approval[5] == [] and approval[6] == [("error", "object"), ("warning", "date"), ("warning", "signature")]


def test_display(spark):
    d = spark.createDataFrame(NOTES, "doc_id long, text string")
    c = F.col("text")
    rows = {r.doc_id: r for r in d.select("doc_id", display.conclusions(display.remarks(c)).alias("a"), display.masked(c).alias("m"), display.bullets(c).alias("b"), display.paired_bold(c).alias("p")).collect()}
    assert rows[-108].a == "1. Пункт\nГде: раздел 2\nСуть: нет срока\nОбоснование: п. 3\n📄 Предмет: услуги"
    assert rows[-109].a == "Текст.\nВывод:\nвсё хорошо.\nИтого:\n5\nИтоговый срок:\nзавтра"
    assert rows[-111].m.kept == ["a.b@mail.ru", "https://site.ru/x?y=1"] and "@" not in rows[-111].m.masked
    assert rows[-107].b.count("\n") == 4 and rows[-113].p == "**x**y" and rows[-112].a is None


def test_fuzzy_words_by_brute_force(spark):
    docs = [(1, "Закупка закупки заявка, бизнес-план"), (2, "абвгд еёжзи"), (3, None), (4, "premium премия ПРЕМИЙ x1y2 x1y3"), (4, "premium")]
    wanted = ["закупка", "заявок", "премии", "x1y2", "ab"]
    got = {}
    for r in lexical.likenesses(spark.createDataFrame(docs[:4], "doc_id long, text string"), wanted).collect():
        got[r.l_id] = set(r.alike)
    for i, text in docs[:4]:
        want = {w for w in wanted if len(w) > 2 and any(SequenceMatcher(None, w, x).ratio() >= lx.FUZZY for x in lx.words(text or "") if len(x) > 2)}
        assert got.get(i, set()) == want


def test_issues_of_every_case_within_the_caps(spark):
    from tessera import catalog

    sf = "/root/testdata/sf0.001"
    shown, found = (catalog.queries()[q](spark, sf).select("case_id", "level", "field") for q in ("issue_caps", "keyword_rules"))
    # An auction's papers have at most 10 errors and 12 warnings, so all of them are shown, of every case that has some.
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, found.collect()))
    cases = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert shown.select("case_id").distinct().count() >= cases
    many = spark.createDataFrame([(c, level, k) for c in (1, 2) for level in ("error", "warning") for k in range(30)], "case_id long, level string, position int")
    kept = policy.capped(many).collect()
    assert sorted((r.case_id, r.level, r.position) for r in kept) == [(c, level, k) for c in (1, 2) for level, n in (("error", 20), ("warning", 15)) for k in range(n)]
