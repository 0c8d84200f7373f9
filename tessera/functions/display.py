"""Text made ready to be shown: list items, remarks and conclusions on lines of their own, lists renumbered, headings in bold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bind, strip, without_urls

#: Labels of remarks, leads of conclusions and what ends a list, fixed values.
FIELDS = "Где|Суть|Обоснование|Предмет|НМЦД|Начальная цена|Документация|Вердикт"
BREAKS = "(?:\\*\\*)?(?:Итоговый|Итого(?![а-яё])|Вывод|Заключение|Резюме|Таким образом|Следовательно|Общий вывод|Минимальный срок|Суммарно|В итоге)"
LEADS = "(?:Итоговый|Итого(?![а-яё])|Вывод|Заключение|Резюме|Таким образом|Следовательно|Общий вывод|Замечания|Минимальный срок|Суммарно|В итоге|Важно|Обратите внимание|Ответ|Кратко|Документация|Вердикт)"
LABELS = "(?:Где|Суть|Обоснование|Предмет|НМЦД|Начальная цена)"
SIGN = "(?:📄|📋)"
LIST_ENDS = f"(?iuU)^(?:#{{1,6}}\\s|🔴|🟡|{SIGN}\\s|(?:\\*\\*)?(?:Итоговый|Вывод|Заключение|Общий вывод|Документация|Вердикт)\\b)"
#: A number of one or two digits before text that starts with no digit: neither a date nor a clause such as 17.1.
MARKER = "(?:\\*\\*)?\\d{1,2}[.)](?:\\*\\*)?\\s+(?=[^\\d\\s])"
ITEM = "(?Us)^(\\s*)(?:\\*\\*)?\\d{1,2}[.)](?:\\*\\*)?\\s+([^\\d\\s].*?)\\s*\\z"
WIDE, NARROW = "１２３４５６７８９０．）", "1234567890.)"


def bullets(c: Column) -> Column:
    """Bulleted items start lines."""
    c = F.regexp_replace(c, "([:;—–])\\s*([-*•]\\s+\\S)", "$1\n$2")
    c = F.regexp_replace(c, "(\\*\\*[^*]+\\*\\*)\\s*([-*•]\\s+\\S)", "$1\n$2")
    return F.regexp_replace(c, "([^\\n])\\s+([-*•]\\s+\\S)", "$1\n$2")


def numbered(c: Column) -> Column:
    """Numbered items start lines after a colon, a dash, a semicolon or the end of a sentence; dates and clauses don't."""
    c = F.regexp_replace(c, f"(?U)([:;—–])\\s+({MARKER})", "$1\n$2")
    return F.regexp_replace(c, f"(?U)(?<!\\d)([.!?…»])\\s+({MARKER})", "$1\n$2")


def whole_decimals(c: Column) -> Column:
    """Dates and clauses that a line break parted are one again."""
    c = F.regexp_replace(c, "(?U)(?<=\\d)\\.\\s*\\n\\s*(?=\\d)", ".")
    return F.regexp_replace(c, "(?U)([A-Za-zА-Яа-яЁё])\\s*\\n\\s*(\\d+\\.\\d+)", "$1 $2")


def renumbered(c: Column) -> Column:
    """Numbered items count from 1 in each list; blank lines go.

    A list ends at a bullet, a heading, or text behind a blank line.  Lines between items belong to the list.  Lists are islands between
    such lines: every kept line gets a code of a line break and a digit, which no line can hold (2 before a line, 3 before a line that ends a list, 1 where
    a number goes), so that splitting at the codes yields the lists and, in each, the places of its numbers.
    """

    def coded(lines: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            bare = strip(x)
            after_blank = (i > 0) & ~F.get(lines, i - 1).rlike("(?U)\\S")
            ends = after_blank | bare.rlike("(?U)^[-*•]\\s+") | bare.rlike(LIST_ENDS)
            item = F.concat(F.lit("\n2"), F.regexp_replace(x, ITEM, "$1\n1. $2"))
            return F.when(bare == "", "").when(x.rlike(ITEM), item).otherwise(F.concat(F.when(ends, "\n3").otherwise("\n2"), x))

        return F.array_join(F.transform(lines, line), "")

    def counted(island: Column) -> Column:
        return F.array_join(F.transform(F.split(island, "\n1", -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(i.cast("string"), x))), "")

    islands = F.transform(F.split(bind(F.split(c, "\n", -1), coded), "\n3", -1), counted)
    return F.substring(F.replace(F.array_join(islands, "\n2"), F.lit("\n2"), F.lit("\n")), 2, 2147483647)


def bold_headings(c: Column) -> Column:
    """Leads of conclusions and labels of remarks stand in bold with their colon, unless they do already."""
    lead, label = f"(?:\\*\\*)?{LEADS}", f"(?:\\*\\*)?{LABELS}"
    open_bold = "(?:\\*\\*)?"
    conclusion = f"(?iuUs)^(\\s*)({SIGN}\\s*)?(?={lead}[^:]{{0,100}}:){open_bold}([^:]*?)\\s*(?:\\*\\*)?(:)(.*)\\z"
    remark = f"(?iuUs)^(\\s*)(?={label}:){open_bold}([^:]*)(:)(.*)\\z"
    alone = f"(?iuUs)^(\\s*)({SIGN}\\s*)?{open_bold}({LEADS})\\s*\\z"

    def line(x: Column) -> Column:
        done = x.rlike(f"(?U)^\\s*(?:\\*\\*.*\\*\\*|{SIGN}\\s*\\*\\*)")
        of_conclusion, of_remark = F.regexp_replace(x, conclusion, "$1$2**$3$4**$5"), F.regexp_replace(x, remark, "$1**$2$3**$4")
        return F.when(done, x).when(x.rlike(conclusion), of_conclusion).when(x.rlike(remark), of_remark).otherwise(F.regexp_replace(x, alone, "$1$2**$3**"))

    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


def collapsed(c: Column) -> Column:
    """One space for runs of white space in a line, one break for runs of breaks."""
    return strip(F.regexp_replace(F.regexp_replace(c, "(?U)[^\\S\n]+", " "), "\\n{2,}", "\n"))


def shown(c: Column) -> Column:
    """An answer ready to be shown: all steps in their fixed order; null stays null."""
    c = narrow_digits(without_urls(c))
    c = F.regexp_replace(c, "(?mdU)^\\s*[-*_]{3,}\\s*$", "")
    c = F.regexp_replace(c, "(?mdU)^\\s*[-*_]{3,}\\s+", "")
    c = F.regexp_replace(c, "(?mdU)^\\s*#{1,6}\\s*$", "")
    c = F.regexp_replace(c, "(?U)[-*_]{3,}\\s*#{1,6}\\s+", "")
    c = renumbered(remarks(conclusions(numbered(bullets(whole_decimals(c))))))
    return collapsed(paired_bold(bold_headings(c)))


def remarks(c: Column) -> Column:
    """Each field of a remark starts a line."""
    return F.regexp_replace(c, f"(?iu)(?<!\\n)(?<![📄📋])[ \\t]+((?:📄|📋)\\s*)?({FIELDS}):", "\n$1$2:")


def conclusions(c: Column) -> Column:
    """Conclusions start lines, and what they say follows on the next."""
    c = F.regexp_replace(c, f"(?iu)([^\\n])[ \\t]+({BREAKS})", "$1\n$2")
    return F.regexp_replace(c, f"(?iu)({BREAKS}[^\\n]{{0,120}}?:)\\s+(?=\\S)", "$1\n")


def narrow_digits(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def paired_bold(c: Column) -> Column:
    """Without ** that have no partner on their line."""
    parts = F.regexp_extract_all(c, F.lit("\\*\\*(.+?)\\*\\*"), F.lit(0))
    rest = F.transform(F.split(c, "\\*\\*.+?\\*\\*", -1), lambda x: F.replace(x, F.lit("**"), F.lit("")))
    return F.array_join(F.flatten(F.zip_with(rest, F.concat(parts, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def masked(c: Column) -> Column:
    """(masked, kept): mail addresses and links as numbered marks, and what they stand for, in order."""
    pattern = "[\\w.+-]+@[\\w-]+\\.[\\w.-]+|https?://[^\\s<>]+"
    kept = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    rest = F.split(c, pattern, -1)
    marks = F.transform(kept, lambda x, i: F.concat(F.lit(""), i.cast("string"), F.lit("")))
    text = F.array_join(F.flatten(F.zip_with(rest, F.concat(marks, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return F.struct(text.alias("masked"), kept.alias("kept"))
