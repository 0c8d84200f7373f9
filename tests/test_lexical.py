"""Word evidence against a plain reading of the rules."""

from difflib import SequenceMatcher

from tessera.functions import lexicon as lx
from tessera.functions.lexicon import Question
from tessera.operators import lexical
from tessera.functions import text as t
from pyspark.sql import functions as F

DOCS = [
    "Срок подачи заявок при проведении аукциона — 20 дней", "Перечень служебной информации и её виды", "Премирование: вид премии и прочее", "заявка подана в срок на аукцион", "", "срокподачизаявок",
    "аукцион " + "х " * 300 + "срок подачи", "служебная информация ограниченного распространения",
]
ASKED = ["Какой Срок подачи заявок при аукционе", "Виды служебной информации", "Какие виды премий существуют"]


def test_questions():
    q = Question.of(ASKED[0])
    assert q.core == ("срок", "подачи", "заявок", "аукционе") and q.need == 3
    assert {"сроки", "заявки", "аукц", "подач"} <= set(q.tokens()) and "какой срок подачи заявок при аукционе" in q.substrings()
    assert q.stems() == ["аукцион", "заявок аукцион"] or "аукцион" in q.stems()
    assert Question.of("").tokens() == [] and Question.of("что и как").core == ()
    assert Question.of("Виды премий").phrases()[-1].startswith("виды прем")
    assert Question.of("x").enriched == "x. Ключевые термины: x. x" or Question.of("x").core == ()


def find_in_order(parts, doc):
    at = 0
    for s, step in parts:
        i = doc.find(s, at)
        if i < 0:
            return False
        at = i + step
    return True


def phrase(q, doc):
    scores = [0.0] + [50.0 + min(len(s), 40) for s in q.substrings() if s in doc]
    if len(q.core) > 1 and find_in_order([(w, len(w)) for w in q.core], doc):
        scores.append(45.0)
    spoken = [lx.stem(w) for w in q.words if len(w) > 1 and w not in lx.STOP]
    if len(spoken) > 1 and find_in_order([(s, max(3, len(s))) for s in spoken], doc):
        scores.append(55.0)
    places = [p for w in q.content if len(w) > 2 for p in [doc.find(lx.stem(w)) if lx.stem(w) in doc else (doc.find(w) if len(w) > 3 else -1)] if p >= 0]
    if places and len(places) >= min(2, len(q.content)):
        span = max(places) - min(places)
        scores.append(40.0 + 12 * len(places) if span <= 180 else 22.0 if span <= 540 else 0.0)
    if len(q.content) > 1 and ("виды" in q.content or "вид" in doc) and ("виды" in doc or "вид " in doc):
        scores += [52.0 for w in q.content if w not in ("виды", "вид") and lx.stem(w) in doc]
    return max(scores)


def word_found(w, doc):
    compact = doc.replace(" ", "")
    if w in doc or (len(w) > 2 and (w.replace("-", "") in compact or w[:3] in compact)) or (len(w) > 3 and w[:4] in doc):
        return True
    return len(w) > 2 and any(SequenceMatcher(None, w, x).ratio() >= 0.78 for x in lx.words(doc) if len(x) > 2)


def test_scores(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate([*DOCS, None])], "doc_id int, text string")
    for text in ASKED:
        q = Question.of(text)
        doc = F.col("doc")
        rows = d.select("doc_id", t.matchable(t.text("text")).alias("doc")).select("doc_id", "doc", lexical.phrase_score(doc, q).alias("p"), lexical.stem_matches(doc, q).alias("s")).collect()
        assert len(rows) == len(DOCS) + 1
        for r in rows:
            assert r.doc == lx.matchable(DOCS[r.doc_id] if r.doc_id < len(DOCS) else "")
            assert r.p == phrase(q, r.doc), (text, r.doc)
            assert r.s == sum(lx.stem(w) in r.doc for w in q.core if len(w) > 2)
        for r in lexical.keyword_scored(d, [(0, q, list(q.words))]).collect():
            doc = lx.matchable(DOCS[r.doc_id] if r.doc_id < len(DOCS) else "")
            want = sum(5.0 if len(w) > 2 and w not in lx.STOP else 3.0 for w in dict.fromkeys(q.words) if len(w) > 1 and word_found(w, doc))
            ordered = [w for w in q.words if len(w) > 2 and w not in lx.STOP][:5]
            want += 8.0 * (" ".join(ordered) in doc) + 6.0 * ("".join(ordered) in doc.replace(" ", ""))
            assert r.score == want, (text, doc)
            assert r.core_matches == sum(word_found(w, doc) for w in q.core)
