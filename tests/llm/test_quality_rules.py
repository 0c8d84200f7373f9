import random
import re

from tessera.llm.quality_rules import assess


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {k + d for v in grams.values() if len(v) > 1 for k in v for d in range(3)}
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep), failed


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["the", "of", "and", "rain", "fell", "on", "a", "house", "é🎉x", "#1", "<b>", "to"]
    texts = [None, "", " \n", "a b", "a a a", "a a a a", "x " * 3000, "same line\nsame line\n\n\n same line"]
    texts += ["".join(rng.choice(words) + rng.choice((" ", "\n", "\t ", "\x0b")) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += ["\n".join(rng.choice(("l1 a b", "l2", "")) for _ in range(30))]
    d = spark.createDataFrame([(i, t, rng.choice(("en", None)), "z") for i, t in enumerate(texts)] + [(3, texts[3], "en", "z")], "doc_id long, text string, lang string, n_words string")
    rows = assess(d).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_what_is_unlike_its_language_goes(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(("the", "of", "and", "in", "to")) if rng.random() < 0.5 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    docs = [(i, " ".join(word() for _ in range(200)), "en") for i in range(60)]
    docs += [(100, " ".join(word().upper() + "!!" for _ in range(200)), "en"), (101, " | ".join("".join(rng.choice("0123456789") for _ in range(6)) for _ in range(200)), "en")]
    kept = {r.doc_id: r.kept for r in assess(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(60)) and not kept[100] and not kept[101]


def test_empty(spark):
    assert assess(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_common_words_are_counted(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from tessera.llm.quality_rules import LETTERS, marks, occurrences_of, words

    rng = random.Random(8)
    common = [f"w{i}" for i in range(len(LETTERS))]
    texts = [" ".join(rng.choice([*common, "W3", "other", "."]) for _ in range(rng.randint(0, 300))) for _ in range(20)] + [""]
    d = spark.createDataFrame([(t, common[: 5 + k % 28]) for k, t in enumerate(texts)], "text string, common array<string>")
    for r in d.select("text", "common", occurrences_of(marks(words(F.col("text")), F.col("common"))).alias("p")).collect():
        c = Counter(r.text.lower().split())
        assert r.p == [c[x] for x in r.common] + [0] * (len(LETTERS) - len(r.common))
