"""Text ready to be shown, against a plain reading line by line and stated cases."""

import re

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import display

SF = "/root/testdata/sf0.001"
NUMBER = re.compile(r"(\s*)(?:\*\*)?\d{1,2}[.)](?:\*\*)?\s+([^\d\s].*)")
STOPS = re.compile(r"#{1,6}\s|🔴|🟡|[📄📋]\s|(\*\*)?(Итоговый|Вывод|Заключение|Общий вывод|Документация|Вердикт)\b|[-*•]\s", re.I)
LEADS = display.LEADS


def one(spark, make, *texts):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r.y for r in d.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def renumbered(text):
    out, n, gap = [], 0, False
    for line in text.split("\n"):
        if not line.strip():
            gap = True
            continue
        m = NUMBER.fullmatch(line)
        if m:
            n += 1
            line = f"{m[1]}{n}. {m[2]}".rstrip()
        elif gap or STOPS.match(line.strip()):
            n = 0
        gap = False
        out.append(line)
    return "\n".join(out)


def bold(line):
    m = re.match(rf"(?i)(\s*)([📄📋]\s*)?((?:\*\*)?{LEADS}[^:]{{0,100}}?):(.*)$", line) or re.match(rf"(?i)(\s*)()((?:\*\*)?{display.LABELS}):(.*)$", line)
    colon = ":"
    if not m:
        m, colon = re.match(rf"(?i)(\s*)([📄📋]\s*)?((?:\*\*)?{LEADS})\s*()$", line), ""
    if not m or (m[3].startswith("**") and (m[2] or "**" in line.strip()[2:])):
        return line
    return f"{m[1]}{m[2] or ''}**{m[3].removeprefix('**').removesuffix('**').strip()}{colon}**{m[4]}"


def shown(text):
    s = text
    s = re.sub(r"(?m)^\s*#{1,6}\s*$", "", re.sub(r"(?m)^\s*[-*_]{3,}\s+", "", re.sub(r"(?m)^\s*[-*_]{3,}\s*$", "", s)))
    s = re.sub(r"[-*_]{3,}\s*#{1,6}\s+", "", s)
    s = re.sub(r"(?<=\d)\.\s*\n\s*(?=\d)", ".", s)
    s = re.sub(r"([A-Za-zА-Яа-яЁё])\s*\n\s*(\d+\.\d+)", r"\1 \2", s)
    for before in (r"([:;—–])\s*", r"(\*\*[^*]+\*\*)\s*", r"([^\n])\s+"):
        s = re.sub(before + r"([-*•]\s+\S)", r"\1\n\2", s)
    mark = r"((?:\*\*)?\d{1,2}[.)](?:\*\*)?\s+(?=[^\d\s]))"
    s = re.sub(r"(?<!\d)([.!?…»])\s+" + mark, r"\1\n\2", re.sub(r"([:;—–])\s+" + mark, r"\1\n\2", s))
    s = re.sub(rf"(?i)([^\n])[ \t]+({display.BREAKS})", r"\1\n\2", s)
    s = re.sub(rf"(?i)({display.BREAKS}[^\n]{{0,120}}?:)\s+(?=\S)", r"\1\n", s)
    s = re.sub(rf"(?i)(?<!\n)(?<![📄📋])[ \t]+((?:📄|📋)\s*)?({display.FIELDS}):", r"\n\1\2:", s)
    s = "\n".join(map(bold, renumbered(s).split("\n")))
    parts = re.split(r"(\*\*.+?\*\*)", s)
    s = "".join(x if i % 2 else x.replace("**", "") for i, x in enumerate(parts))
    return re.sub(r"\n{2,}", "\n", re.sub(r"[^\S\n]+", " ", s)).strip()


def test_lists_count_from_one(spark):
    cases = [
        "3. а\n7) б\nсвободный текст\n9. в", "1. а\n\n\n5. б\n\nтекст\n2. в", "1. а\n- б\n4. в", "1. а\n## г\n2. б", "26. 07 дата\n17.1 пункт\n5. пункт", "**4.** а **б**  \n  6) в", "", "\n \n", "Вывод\n3. x",
        "2. x\nВывод: y\n8. z", "2. x\nВыводы: y\n8. z", "1. $1 \\n1 и \r\n2. b", "\n1. a", "текст\n\n1. a", "5. \n6. x", "100. a\n7.b", "1. а\n** б\n2. в", "1. a\n📄 b\n1. c",
    ]
    assert one(spark, display.renumbered, *cases, None) == [*map(renumbered, cases), None]
    assert renumbered(cases[0]) == "1. а\n2. б\nсвободный текст\n3. в" and renumbered(cases[1]) == "1. а\n2. б\nтекст\n1. в"


def test_headings_are_bold(spark):
    cases = [
        "Вывод: да", " 📄 Документация по делу : x: y", "**Вывод** да", "**Вывод да: нет", "Вывод**: x", "Где: в п. 2", "где:", "Итого: 5", "Итоговая: 5", "Кратко  ", "📋 **Вердикт:** x", "слово Вывод: x", "Ответ" + "x" * 101 + ":",
        "Ответ" + "x" * 100 + ":", "", "Замечания\nСуть : x\nСуть: x", "**Суть: x",
    ]
    want = ["\n".join(map(bold, x.split("\n"))) for x in cases]
    assert one(spark, display.bold_headings, *cases, None) == [*want, None]
    assert want[0] == "**Вывод:** да" and want[2] == cases[2] and want[3] == "**Вывод да:** нет" and want[11] == cases[11]


def test_numbers_start_lines(spark):
    got = one(spark, display.numbered, "Итак: 1. один; 2) два. 3. три", "от 26. 07", "п. 17.1 и 5. 3. х", "см.: 12. 5", "конец! **4.** жир")
    assert got == ["Итак:\n1. один;\n2) два.\n3. три", "от 26. 07", "п. 17.1 и 5. 3. х", "см.: 12. 5", "конец!\n**4.** жир"]


def test_items_of_one_letter_start_lines(spark):
    """What ends an item's text may be looked at by the next item, too: matches don't consume it."""
    mark = r"((?:\*\*)?\d{1,2}[.)](?:\*\*)?\s+(?=[^\d\s]))"
    cases = ["x onatnd. 3) A. \n4. Retion", "a: 1. ; 2) b", "1. a. 2. b. 3. c"]
    want = [re.sub(r"(?<!\d)([.!?…»])\s+" + mark, r"\1\n\2", re.sub(r"([:;—–])\s+" + mark, r"\1\n\2", x)) for x in cases]
    assert one(spark, display.numbered, *cases) == want
    assert want[0] == "x onatnd.\n3) A.\n4. Retion"


def test_the_whole_chain(spark):
    d = catalog.queries()["display_text"](spark, SF)
    got = {r.doc_id: r.shown for r in d.collect()}
    from tessera.functions.text import without_urls
    from tessera.plans.display_queries import answers

    source = {r.doc_id: r.s for r in answers(spark, SF).select("doc_id", display.narrow_digits(without_urls(F.col("text"))).alias("s")).collect()}
    assert got.keys() == source.keys()
    assert [k for k in got if got[k] != shown(source[k])] == []
    assert one(spark, display.shown, None, "", "---\n# \nа １．５ б") == [None, "", "а 1.5 б"]


@pytest.mark.parametrize("n", [20_000])
def test_long_lists_stay_linear(spark, n):
    (got,) = one(spark, display.renumbered, "\n".join(f"{i % 90 + 1}. x" for i in range(n)))
    assert got.endswith(f"\n{n}. x")
