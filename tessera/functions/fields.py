"""Fields of contracts and registers in Russian text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bind, strip

#: Patterns, fixed values.  A word ends where no letter, digit or underscore follows.
END = "(?![\\p{L}\\p{N}_])"
START = "(?<![\\p{L}\\p{N}_])"
CADASTRAL = START + "\\d{2}:\\d{2}:\\d{6,7}:\\d+" + END
AREA = "(?iu)(\\d+(?:[.,]\\d+)?)\\s*(?:кв\\.?\\s*м|м²|м2)" + END
MONEY = "(?iu)(\\d+(?:[ \u00a0.,]\\d+)*)\\s*(?:руб\\.?|рублей|₽)"
TERM = "(?iu)(\\d+)\\s*(лет|года|год|мес\\.?|месяц(?:ев|а)?)(?U:\\b)"
DATE = START + "(\\d{1,2})[./](\\d{1,2})[./](\\d{2,4})" + END


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def numbers(found: Column) -> Column:
    """As doubles: spaces of either kind and a decimal comma are allowed, what isn't a number is left out."""
    return F.array_compact(F.transform(found, lambda x: F.replace(F.translate(x, " \u00a0", ""), F.lit(","), F.lit(".")).try_cast("double")))


def cadastral(c: Column) -> Column:
    return matches(c, CADASTRAL)


def areas(c: Column) -> Column:
    return numbers(matches(c, AREA, 1))


def money(c: Column) -> Column:
    return numbers(matches(c, MONEY, 1))


def terms(c: Column) -> Column:
    one = lambda x: F.struct(F.regexp_extract(x, "^\\d+", 0).cast("int").alias("n"), F.lower(F.regexp_extract(x, "^\\d+\\s*(.*)$", 1)).alias("unit"))
    return F.transform(matches(c, TERM), one)


def dates(c: Column) -> Column:
    """Day, month, year; years of two digits are of this century; days that don't exist are left out."""

    def day(parts: Column) -> Column:
        y = F.get(parts, F.lit(2)).cast("int")
        y = F.when(y < 100, y + 2000).otherwise(y)
        two = lambda k: F.lpad(F.get(parts, F.lit(k)), 2, "0")
        return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), two(0), two(1)), "yyyy-dd-MM")

    return F.array_compact(F.transform(matches(c, DATE), lambda x: bind(F.split(x, "[./]"), day)))


#: What ends a line, and what shows a line with an address or an owner; fixed values.
LINE = "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
PLACE = "(?iu)адрес|местоположен|расположен"
PART = "(?iu)" + START + "(?:(?:ул|пр|пер|г|обл)\\.(?=[\\p{L}\\p{N}_])|район" + END + ")"
OWNER = "(?iu)собственник|правообладатель"
BODY = "(?iu)росимущество|фгуп|муницип|российск"


def first_line(c: Column, *tests) -> Column:
    """The first line that passes, stripped, of the first test that a line passes; empty without one."""

    def found(lines: Column) -> Column:
        return F.coalesce(*[strip(F.get(F.filter(lines, test), F.lit(0))) for test in tests], F.lit(""))

    return bind(F.split(c, LINE, -1), found)


def address(c: Column) -> Column:
    found = first_line(c, lambda x: x.rlike(PLACE) & (F.length(strip(x)) > 15), lambda x: x.rlike(PART))
    return F.when(c.rlike(PLACE) | c.rlike(PART), found).otherwise(F.lit(""))


def owner(c: Column) -> Column:
    found = first_line(c, lambda x: x.rlike(OWNER) | (x.rlike(BODY) & (F.length(x) > 20)))
    return F.when(c.rlike(OWNER + "|" + BODY[5:]), found).otherwise(F.lit(""))


def has_any(low: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(low, F.lit(k))
    return out
