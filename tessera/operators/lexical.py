"""Word evidence of documents for stated questions, as columns; Python only for the fuzzy rest."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import lexicon as lx
from tessera.functions import text as t
from tessera.functions.lexicon import Question


def has(doc: Column, s: str) -> Column:
    return F.contains(doc, F.lit(s))


def in_order(doc: Column, parts: list[tuple[str, int]]) -> Column:
    """Whether the parts follow each other, each looked for from where the last began plus its step."""
    at, ok = F.lit(1), F.lit(True)
    for s, step in parts:
        place = F.locate(s, doc) if at is None else F.call_function("locate", F.lit(s), doc, at)
        ok = ok & (place > 0)
        at = place + step
    return ok


def proximity(doc: Column, q: Question) -> Column:
    """By how near to each other the stems of the content words first occur."""
    used = [w for w in q.content if len(w) > 2]
    if not used:
        return F.lit(0.0)
    places = F.filter(F.array(*[F.greatest(F.instr(doc, lx.stem(w)), F.when(F.instr(doc, lx.stem(w)) == 0, F.instr(doc, w) if len(w) > 3 else F.lit(0)).otherwise(0)) for w in used]), lambda p: p > 0)
    n, span = F.size(places), F.array_max(places) - F.array_min(places)
    near = F.when(span <= lx.SPAN, 40.0 + 12.0 * n).when(span <= 3 * lx.SPAN, 22.0).otherwise(0.0)
    return F.when(n < min(2, len(used)), 0.0).otherwise(near)


def phrase_score(doc: Column, q: Question) -> Column:
    """doc: matchable text.  The best of: a wording as it is, core words in order, stems in order, nearness, kinds."""
    scores = [F.when(has(doc, s), 50.0 + min(len(s), 40)) for s in q.substrings()]
    if len(q.core) > 1:
        scores.append(F.when(in_order(doc, [(w, len(w)) for w in q.core]), 45.0))
    spoken = [lx.stem(w) for w in q.words if len(w) > 1 and w not in lx.STOP]
    if len(spoken) > 1:
        scores.append(F.when(in_order(doc, [(s, max(3, len(s))) for s in spoken]), 55.0))
    scores.append(proximity(doc, q))
    if len(q.content) > 1:
        asked = F.lit(True) if "виды" in q.content else has(doc, "вид")
        for w in q.content:
            if w not in ("виды", "вид"):
                scores.append(F.when(asked & has(doc, lx.stem(w)) & (has(doc, "виды") | has(doc, "вид ")), 52.0))
    return F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(s, F.lit(0.0)) for s in scores])


def stem_matches(doc: Column, q: Question) -> Column:
    return sum((has(doc, lx.stem(w)).cast("int") for w in q.core if len(w) > 2), F.lit(0))


def plainly(doc: Column, compact: Column, w: str) -> Column:
    """Whether a word is found without measuring likeness: as it is, without dashes, or by its beginning."""
    found = has(doc, w)
    if len(w) > 2:
        found = found | has(compact, w.replace("-", "")) | has(compact, w[:3])
    return found | has(doc, w[:4]) if len(w) > 3 else found


@F.pandas_udf(T.BooleanType())
def alike(token: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, w, x).ratio() >= lx.FUZZY for x, w in zip(token, wanted, strict=True)], dtype=bool)


def likenesses(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """l_id, alike: for each document (doc_id, text) the wanted words that some word of it is like.

    Likeness is measured once for each distinct word, and only where the lengths allow it: it is at most twice the
    shorter length over the sum of both.
    """
    tokens = docs.select(F.col("doc_id").alias("l_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(t.text("text")), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))).alias("token")).where(F.length("token") > 2)
    asked = sorted({w for w in wanted if len(w) > 2})
    pairs = tokens.select("token").distinct().select("token", F.explode(F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")).alias("w"))
    pairs = pairs.where(2 * F.least(F.length("token"), F.length("w")) >= lx.FUZZY * (F.length("token") + F.length("w")))
    return tokens.join(pairs.where(alike("token", "w")), "token").groupBy("l_id").agg(F.collect_set("w").alias("alike"))


def keyword_scored(docs: DataFrame, questions: list[tuple[int, Question, list[str]]], fuzzy: bool = True) -> DataFrame:
    """doc_id, question, score, core_matches of every document (doc_id, text) for each (number, question, terms); texts are read once."""
    d = docs.select("doc_id", "text", t.matchable(t.text("text")).alias("_doc")).withColumn("_compact", F.replace(F.col("_doc"), F.lit(" "), F.lit("")))
    used = {k: list(dict.fromkeys(w for w in [*terms, *q.core] if len(w) > 1)) for k, q, terms in questions}
    if fuzzy:
        near = likenesses(docs, [w for ws in used.values() for w in ws])
        d = d.join(near, F.col("doc_id") == F.col("l_id"), "left").withColumn("alike", F.coalesce("alike", F.array().cast("array<string>")))
    rows = []
    for k, q, terms in questions:
        found = {w: plainly(F.col("_doc"), F.col("_compact"), w) | (F.array_contains("alike", w) if fuzzy else F.lit(False)) for w in used[k]}
        core = {w for w in terms if len(w) > 2 and w not in lx.STOP}
        score = sum((F.when(found[w], 5.0 if w in core else 3.0).otherwise(0.0) for w in terms if len(w) > 1), F.lit(0.0))
        ordered = [w for w in terms if w in core]
        if len(ordered) > 1:
            phrase = " ".join(ordered[:5])
            score = score + F.when(has(F.col("_doc"), phrase), 8.0).otherwise(0.0) + F.when(has(F.col("_compact"), phrase.replace(" ", "")), 6.0).otherwise(0.0)
        matched = sum((F.when(found[w], 1).otherwise(0) for w in q.core), F.lit(0))
        rows.append(F.struct(F.lit(k).alias("question"), score.alias("score"), matched.alias("core_matches")))
    return d.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")
