"""PII: spans of personal data, and information-theoretic sanitisation around them, in DataFrame operations only.

Base kinds (email, ip, card, phone) are found by pattern.  A secret is a run of SECRET_CHARS or more letters and digits
whose characters carry at least SECRET_BITS bits each (their Shannon entropy).  Every distinct value found is a protected
entity, and so is every kind as such.  Corpus co-occurrence then says how strongly a term (a run of letters, lower-cased)
reveals an entity: with D distinct texts, IC(e) = log2(D / df(e)) and PMI(e; t) = log2(D df(e, t) / (df(e) df(t))).  All four
count distinct texts, so that copies count once.  With a value a term may stand anywhere in its text; with a kind it is one
of the NEAR terms before a value of that kind, as labels are.  A term that shares at least MIN_CONTEXTS texts with an
entity and whose PMI reaches DISCLOSURE of the entity's IC discloses it: wherever it stands in a document that holds the
entity it is a span of kind ``term``.

In the sanitised text, values give way to their kind, and a term to the most special word of the hierarchy above its entity
(kind, group of kinds, private data) whose own IC is below DISCLOSURE of the entity's; if there is none, it is removed.

Defined cases: a null text counts as empty and has no spans; equal texts get equal values; rows repeat as given; an
empty table gives an empty result; other columns are ignored by the query, and passed through by ``with_spans`` and
``sanitise``, whatever their names (new columns get underscores); spans that start together are ordered by kind as listed,
then by end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, fresh, let, materialise, prefix_sums, table

KINDS = ["email", "ip", "card", "phone", "secret", "term"]
#: What stands above the kinds but terms; above all of these is private data.
GROUPS = ["contact", "network", "payment", "contact", "credential"]
#: The patterns.  Possessive where nothing that follows could use what was taken; the look-behinds only skip starts inside a
#: run of the same class, from which a match would have begun earlier, so that long runs take linear time.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
SECRET = "(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"
SECRET_CHARS, SECRET_BITS = 20, 3.0
NEAR, NEAR_CHARS = 3, 80
MIN_CONTEXTS = 3
DISCLOSURE = 0.75
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string,general:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def step(acc: Column, i: Column) -> Column:
        d = number.substr(n - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: let(F.ltrim(x, F.lit("0")), lambda y: (F.length(y) <= 3) & (F.concat(F.lit("0"), F.left(y, F.lit(3))).cast("int") <= 255))
        return F.forall(F.split(value, "\\.", -1), part)
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that don't overlap as (start, kind, end, value), in code points, end exclusive."""

    def place(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        steps = F.zip_with(gaps, m, lambda g, x: (F.length(g) + F.length(x)).cast("long"))
        return F.zip_with(
            m,
            prefix_sums(steps),
            lambda x, end: F.struct((end - F.length(x)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("value"), F.lit(general(KINDS[kind])).alias("general")),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(place(m).cast(SPAN)),
    )


def base_spans(text: Column) -> Column:
    """All valid spans of the base kinds, by start, kind and end."""
    guard = {"email": text.contains("@"), "ip": text.contains("."), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    found = [
        F.when(guard[k], F.filter(located(text, p, i), lambda s: valid(k, s["value"]))).otherwise(F.array().cast(SPAN))
        for i, (k, p) in enumerate(PATTERNS.items())
    ]
    return F.sort_array(F.concat(*found))


def general(name: str) -> str:
    return f"[{name.upper()}]"


def bits_a_character(value: Column) -> Column:
    """The Shannon entropy of a value's characters."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(value, "", -1)), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(let(share(c), lambda p: p * F.log2(p))))


def secret_spans(text: Column) -> Column:
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (bits_a_character(v) >= SECRET_BITS)
    found = F.filter(located(text, SECRET, KINDS.index("secret")), lambda s: mixed(s["value"]))
    return F.when(text.rlike(f"[A-Za-z0-9_]{{{SECRET_CHARS}}}"), found).otherwise(F.array().cast(SPAN))


def entity(span: Column) -> Column:
    """The protected value, apart from how it is written."""
    written = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"].isin(1, 4), span["value"]).otherwise(digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), written)


def kind_of(span: Column) -> Column:
    """The protected kind; no value is written so."""
    return F.concat(F.lit("kind:"), span["kind"].cast("string"))


def letters_of(text: Column) -> Column:
    """The distinct terms of a text, apart from words with digits or @."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+", -1), lambda w: ~w.rlike("[0-9@]")))
    runs = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("\\p{L}+"), F.lit(0))))
    return F.array_distinct(F.filter(runs, lambda t: F.length(t) > 1))


def labels_of(text: Column, spans: Column) -> Column:
    """(entity, term) for the kinds of a text's spans and the last NEAR terms before each."""

    def before(s: Column) -> Column:
        low = F.greatest(F.lit(0).cast("bigint"), s["start"] - NEAR_CHARS)
        runs = F.filter(F.split(F.lower(text.substr((low + 1).cast("int"), (s["start"] - low).cast("int"))), "\\P{L}+", -1), lambda t: F.length(t) > 1)
        return F.transform(F.slice(F.reverse(runs), 1, NEAR), lambda t: F.struct(kind_of(s).alias("entity"), t.alias("term")))

    return F.array_distinct(F.flatten(F.transform(spans, before)))


def risky_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """entity, term, general: what discloses which entity, and what takes its place.  spans: h1, h2, text, spans of the distinct texts that have any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_texts = float(max(1, docs.select(*content_key(text)).distinct().count()))
    letters = F.array_distinct(F.split(F.lower(text), "\\P{L}+", -1))
    once = docs.select(*content_key(text), letters.alias("terms")).groupBy("h1", "h2").agg(F.first("terms").alias("terms"))
    df_term = once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))

    held = spans.select("h1", "h2", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    # An entity of fewer texts can't share MIN_CONTEXTS with any term.
    df_value = materialise(held.groupBy("entity").agg(F.count("*").alias("df_entity")).where(F.col("df_entity") >= MIN_CONTEXTS))
    near = held.join(df_value, "entity").groupBy("h1", "h2").agg(F.collect_list("entity").alias("entities"))
    near = spans.join(near, ["h1", "h2"]).select("entities", F.explode(letters_of(F.col("text"))).alias("term"))
    pairs = near.select(F.explode("entities").alias("entity"), "term")
    pairs = pairs.unionByName(spans.select(F.explode(labels_of(F.col("text"), F.col("spans"))).alias("p")).select("p.entity", "p.term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("df_both")).where(F.col("df_both") >= MIN_CONTEXTS)

    kinds = range(len(GROUPS))

    def texts_with(some: list[int]) -> Column:
        return F.count(F.when(F.exists("spans", lambda s: s["kind"].isin(some)), 1))

    counts = spans.agg(
        *[texts_with([k]).alias(f"k{k}") for k in kinds],
        *[texts_with([k for k in kinds if GROUPS[k] == g]).alias(f"g_{g}") for g in dict.fromkeys(GROUPS)],
        F.count("*").alias("any"),
    ).first()
    information = lambda n: F.log2(F.lit(n_texts / n)) if n else F.lit(float("inf"))
    df_kind = docs.sparkSession.createDataFrame([(f"kind:{k}", counts[f"k{k}"]) for k in kinds if counts[f"k{k}"]], "entity string, df_entity long")
    d = pairs.join(df_term, "term").join(df_value.unionByName(df_kind), "entity")
    ic = F.log2(F.lit(n_texts) / F.col("df_entity"))
    pmi = F.log2(F.lit(n_texts) * F.col("df_both") / (F.col("df_entity") * F.col("df_term")))
    word: Column = F.lit("")
    for k in kinds:
        above = [(general(KINDS[k]), counts[f"k{k}"]), (general(GROUPS[k]), counts[f"g_{GROUPS[k]}"]), (general("private"), counts["any"])]
        own: Column = F.lit("")
        for name, n in reversed(above):
            own = F.when(information(n) < DISCLOSURE * ic, F.lit(name)).otherwise(own)
        word = F.when(F.col("entity").startswith(f"{k}:") | (F.col("entity") == f"kind:{k}"), own).otherwise(word)
    return d.where((ic > 0) & (pmi >= DISCLOSURE * ic)).select("entity", "term", word.alias("general"))


def term_spans(text: Column, terms: Column) -> Column:
    """terms: term and general."""
    runs = located(text, "\\p{L}+", KINDS.index("term"))
    known = F.map_from_entries(terms)
    return let(
        known,
        lambda m: F.transform(
            F.filter(runs, lambda s: F.map_contains_key(m, F.lower(s["value"]))),
            lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.element_at(m, F.lower(s["value"])).alias("general")),
        ),
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """The documents with spans (of the base kinds) and all_spans: see SPAN."""
    spans, every, extra, h1, h2, x1, x2 = (fresh(docs, c) for c in ("spans", "all_spans", "extra", "h1", "h2", "x1", "x2"))
    text = F.coalesce(F.col("text"), F.lit(""))
    a, b = content_key(text)
    both = let(base_spans(text), lambda base: F.struct(base.alias("base"), F.sort_array(F.concat(base, secret_spans(text))).alias("every")))
    own = docs.select("*", a.alias(h1), b.alias(h2), both.alias(spans)).select(*[F.col(c) for c in docs.columns], h1, h2, F.col(spans)["every"].alias(every), F.col(spans)["base"].alias(spans))
    # An outer explode, as Spark would move a test of the spans below what finds them, and find them twice.
    found = docs.select(F.explode_outer(F.array(F.struct(a.alias("h1"), b.alias("h2"), F.col("text"), both["every"].alias("spans")))).alias("o")).select("o.*")
    held = found.where(F.size("spans") > 0).groupBy("h1", "h2").agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
    held = materialise(held)
    risky = risky_terms(docs, held)
    mine = held.select("h1", "h2", F.explode(F.array_distinct(F.concat(F.transform("spans", entity), F.transform("spans", kind_of)))).alias("entity"))
    lists = mine.join(risky, "entity").groupBy("h1", "h2", "term").agg(F.min("general").alias("general"))
    lists = lists.groupBy("h1", "h2").agg(F.collect_list(F.struct("term", "general")).alias("terms"))
    more = held.join(lists, ["h1", "h2"]).select(F.col("h1").alias(x1), F.col("h2").alias(x2), term_spans(F.col("text"), F.col("terms")).alias(extra))
    d = own.join(more, (F.col(h1) == F.col(x1)) & (F.col(h2) == F.col(x2)), "left")
    return d.withColumn(every, F.when(F.col(extra).isNull(), F.col(every)).otherwise(F.sort_array(F.concat(every, extra)))).select(*docs.columns, spans, every)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the general word of its first."""
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["parts"], F.array(gap, s["general"])).alias("parts"), s["end"].alias("at"))).otherwise(
            F.struct(acc["parts"].alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))
        )

    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with personal data in text replaced; a null text stays null."""
    text = F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col(fresh(docs, "all_spans"))))
    return with_spans(docs).withColumn("text", text).select(*docs.columns)


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("all_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return d.select(
        "doc_id", *[number(k) for k in PATTERNS], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"),
        number("secret"), number("term"), F.size("all_spans").cast("long").alias("n_private"),
    )
