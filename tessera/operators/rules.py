"""Declarative checks: issues as rows, scores and verdicts as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fields as f
from tessera.functions import text as t

#: Required parts of an auction's papers, and clauses of its contract, with what shows them; fixed values.
SECTIONS = {
    "информация об объекте": ["информация об объекте", "объект аренды", "объект недвижим"],
    "начальная цена": ["начальная цена", "начальная (минимальная) цена", "цена договора"],
    "срок аренды": ["срок аренды", "срок действия договора", "срок аренды объекта"],
    "требования к участникам": ["требования к участникам", "требования к претендентам"],
    "порядок подачи заявок": ["порядок подачи заявок", "порядок подачи заявки"],
    "критерии оценки": ["критерии оценки", "критерии определения победителя"],
    "проект договора": ["проект договора", "договор аренды"],
    "место проведения аукциона": ["место проведения", "место аукциона"],
    "дата проведения аукциона": ["дата проведения", "дата аукциона", "время проведения"],
}
CLAUSES = {
    "предмет договора": ["предмет договора", "предмет настоящего договора"],
    "срок действия": ["срок действия", "срок аренды"],
    "размер арендной платы": ["арендная плата", "размер арендной платы", "арендных платеж"],
    "порядок расчетов": ["порядок расчет", "порядок внесения", "платеж"],
    "права и обязанности": ["права и обязанности", "обязанности сторон"],
    "ответственность сторон": ["ответственность сторон", "ответственность за нарушение"],
    "изменение и расторжение": ["изменение договора", "расторжен", "прекращен"],
    "заключительные положения": ["заключительные положения", "заключительн"],
}
#: What shows a public owner, burdens on the right, and a signature; fixed values.
PUBLIC = ["россий", "фгуп", "муницип", "росимущ", "государ"]
BURDENS = ["арест", "запрет", "ограничение права", "обременен"]
SIGNED = ["подпис", "директор", "руководител", "утвержда", "согласован"]
AREA_TOLERANCE = 0.05
PENALTY = {"critical": 12, "error": 8, "warning": 3}


def issue(test: Column, level: str, field: str, severity: str) -> Column:
    return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))


def as_array(found: list[Column]) -> Column:
    return F.array_compact(F.array(*found))


def auction_checks(raw: Column) -> Column:
    """The issues of an auction's papers as an array; the text is made ready once for all of them."""
    at = F.instr(F.lower(raw), "проект договора")

    def found(x: Column) -> Column:
        out = [issue(~f.has_any(x["low"], words), "error", name, "major") for name, words in SECTIONS.items()]
        out += [issue(~f.has_any(x["contract"], words), "warning", name, "minor") for name, words in CLAUSES.items()]
        out += [issue(F.size(f.cadastral(x["raw"])) == 0, "error", "cadastral", "critical"), issue(f.address(x["raw"]) == "", "warning", "address", "minor")]
        return as_array(out + [issue(F.size(of(x["raw"])) == 0, "warning", name, "minor") for name, of in (("area", f.areas), ("price", f.money), ("lease_term", f.terms))])

    def prepared(low: Column) -> Column:
        contract = F.when(at > 0, t.normal(F.substring(raw, at, F.length(raw)))).otherwise(low)
        return t.bind(F.struct(raw.alias("raw"), low.alias("low"), contract.alias("contract")), found)

    return t.bind(t.normal(raw), prepared)


def register_checks(raw: Column, as_of: str, max_days: int) -> Column:
    """The issues of an extract from the register as an array; it may be max_days old on the day as_of."""

    def found(x: Column) -> Column:
        old = F.coalesce(x["latest"] < F.date_sub(F.to_date(F.lit(as_of)), max_days), F.lit(False))
        return as_array([
            issue(F.size(f.cadastral(x["raw"])) == 0, "error", "cadastral", "critical"),
            issue(f.address(x["raw"]) == "", "warning", "address", "minor"),
            issue((x["owner"] == "") | ~f.has_any(F.lower(x["owner"]), PUBLIC), "warning", "owner", "minor"),
            issue(f.has_any(F.lower(x["raw"]), BURDENS), "warning", "encumbrances", "minor"),
            issue(old, "error", "extract_date", "critical"),
            issue(x["latest"].isNull(), "warning", "extract_date", "minor"),
        ])

    return unless_blank(raw, t.bind(F.struct(raw.alias("raw"), F.array_max(f.dates(raw)).alias("latest"), f.owner(raw).alias("owner")), found))


def approval_checks(raw: Column) -> Column:
    """The issues of an approval as an array."""
    found = [
        issue(F.size(f.dates(raw)) == 0, "warning", "date", "minor"),
        issue((F.size(f.cadastral(raw)) == 0) & (f.address(raw) == ""), "error", "object", "critical"),
        issue(~f.has_any(t.normal(raw), SIGNED), "warning", "signature", "minor"),
    ]
    return unless_blank(raw, as_array(found))


def unless_blank(raw: Column, found: Column) -> Column:
    """A document without text has that one issue."""
    return F.when(~raw.rlike("(?U)\\S"), F.array(issue(F.lit(True), "error", "text", "critical"))).otherwise(found)


def rows(docs: DataFrame, checks: Column) -> DataFrame:
    """The issues of an array, each a row.  Spark would move the test for arrays that aren't empty below the checks, and so make all of them twice; not so with an outer explode."""
    return docs.select("case_id", F.explode_outer(checks).alias("i")).where("i IS NOT NULL").select("case_id", "i.*")


def auction_issues(docs: DataFrame) -> DataFrame:
    """case_id, text -> case_id, level, field, severity."""
    return rows(docs, auction_checks(t.text("text")))


def register_issues(docs: DataFrame, as_of: str, max_days: int) -> DataFrame:
    """case_id, text of extracts from the register -> issues; an extract may be max_days old on the day as_of."""
    return rows(docs, register_checks(t.text("text"), as_of, max_days))


def approval_issues(docs: DataFrame) -> DataFrame:
    """case_id, text of approvals -> issues."""
    return rows(docs, approval_checks(t.text("text")))


def cost(level: Column, severity: Column) -> Column:
    error = level == "error"
    return F.when(error & (severity == "critical"), PENALTY["critical"]).when(error, PENALTY["error"]).otherwise(PENALTY["warning"])


def verdict_of(by: DataFrame, *kept: str) -> DataFrame:
    """case_id, cost, n_errors, n_warnings -> case_id, score, status, n_errors, n_warnings, and columns that are kept."""
    status = F.when(F.col("n_errors") > 0, "failed").when(F.col("n_warnings") > 0, "warnings").otherwise("passed")
    return by.select("case_id", F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("cost"))).cast("int").alias("score"), status.alias("status"), "n_errors", "n_warnings", *kept)


def verdict(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """The verdict of every case from rows of issues."""
    error = F.col("level") == "error"
    by = issues.groupBy("case_id").agg(F.sum(cost(F.col("level"), F.col("severity"))).alias("cost"), F.count_if(error).alias("n_errors"), F.count_if(~error).alias("n_warnings"))
    return verdict_of(cases.select("case_id").join(by, "case_id", "left").na.fill(0))


def scored(docs: DataFrame, checks: Column, *kept: str) -> DataFrame:
    """The verdict of every document (case_id) with its issues as an array: one pass, no rows of issues."""
    d = docs.select("case_id", checks.alias("i"), *kept)
    errors = F.size(F.filter("i", lambda x: x["level"] == "error"))
    total = F.aggregate("i", F.lit(0), lambda acc, x: acc + cost(x["level"], x["severity"]))
    return verdict_of(d.select("case_id", total.alias("cost"), errors.cast("long").alias("n_errors"), (F.size("i") - errors).cast("long").alias("n_warnings"), *kept), *kept)


def cross_issues(cases: DataFrame) -> DataFrame:
    """case_id, keys (array of the documents' identifiers), area_a, area_b -> issues between documents."""
    keys = F.array_distinct(F.filter("keys", lambda k: k.isNotNull() & (k != "")))
    a, b = F.col("area_a"), F.col("area_b")
    apart = (a != 0) & (b != 0) & (F.abs(a - b) / F.greatest(a, b) > AREA_TOLERANCE)
    found = [issue(F.size(keys) > 1, "error", "cadastral", "critical"), issue(F.coalesce(apart, F.lit(False)), "error", "area", "critical")]
    return cases.select("case_id", F.explode(F.array_compact(F.array(*found))).alias("i")).select("case_id", "i.*")
