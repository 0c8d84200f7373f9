import hashlib
import math
import os
import random
import re

import pytest

from pyspark.sql import functions as F

from tessera.llm.private_data import KINDS, MIN_CONTEXTS, bits_a_character, joined, op3_private_data, sanitise, secret_spans, with_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, s[::-1]))) % 10 == 0


def brute(text):
    out = []
    for i, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if k == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, m.end(), k))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f x@y a@b.c.d@e.f", "é a.b%c@d-e.co.uk, 1.2.3.4.5.6.7.8 and 300.1.1.1 001.02.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "+1 (386) 555-3733 +12 +123456789012345678 +1-2", "1" * 4000, "1 " * 9000, "a" * 5000 + "@" + "b" * 50 + ".c", "x@y.z" * 300, "+1 (386) 555-3733" * 40, "🎉 4111111111111111 🎉 a@b.cc",
]


def test_base_spans(spark):
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(0, TEXTS[3], "s")], "doc_id long, text string, h1 string")
    rows = with_spans(d).select("text", joined("spans").alias("base"), joined("all_spans").alias("all")).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r.base == brute(r.text or "")
        assert set(filter(None, r.base.split(","))) <= set(r.all.split(","))


def test_terms_that_disclose(spark):
    fill = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = [(i, f"{fill[i % 6]} {fill[(i + 1) % 6]} ask Zorblax at z@corp.com {fill[(i + 2) % 6]} n{i}x Zorblax") for i in range(MIN_CONTEXTS + 2)]
    docs += [(100 + i, f"{fill[i % 6]} words ask at {fill[(i * 5) % 6]} here") for i in range(60)] + [(500, "Zorblax alone")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.all for r in with_spans(d).select("doc_id", joined("all_spans").alias("all")).collect()}
    start = docs[0][1].index("Zorblax")
    assert f"term:{start}:{start + 7}" in found[0] and found[0].count("term:") == 2
    assert "term" not in found[500] and found[100] == ""
    clean = {r.doc_id: r.text for r in sanitise(d).collect()}
    # All private data is that one address, so no general word tells less than the term.
    assert clean[0] == docs[0][1].replace("Zorblax", "").replace("z@corp.com", "[EMAIL]")
    assert clean[500] == "Zorblax alone"


def test_digest_and_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert with_spans(d).collect() == [] and sanitise(d).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def found_terms(spark, docs):
    rows = with_spans(spark.createDataFrame(docs, "doc_id long, text string")).select("text", "all_spans").collect()
    return {s.value for r in rows for s in r.all_spans if s.kind == KINDS.index("term")}


def test_terms_on_copies_in_boilerplate_and_far_away(spark):
    fill = [(i, f"some w{chr(97 + i % 26)}{chr(97 + i // 26)} words") for i in range(300)]
    plain = lambda k: " ".join(fill[k][1].split()[:2])
    copies = [(1000 + i, f"{plain(0)} Zorblax z@corp.com here") for i in range(30)] + [(1100 + i, f"{plain(i)} Zorblax z@corp.com {plain(i + 9)}") for i in (1, 2)]
    assert found_terms(spark, fill + copies) == {"Zorblax"}
    footers = [(2000 + i, " ".join(f"{plain(i)} words some words." for _ in range(3)) + " some words some words Zorblax z@corp.com") for i in range(4)]
    assert found_terms(spark, fill + footers) == {"Zorblax"}
    far = [(3000 + i, f"Zorblax {'some words ' * 40} z@corp.com {plain(i)}") for i in range(4)]
    assert found_terms(spark, fill + far) == {"Zorblax"}


def test_secrets_and_their_labels(spark):
    """Labels disclose the kind of what follows them, though no value comes twice."""
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    fill = lambda i: " ".join(f"w{chr(97 + (i * 7 + k) % 26)}" for k in range(8))
    docs = [(i, f'{fill(i)} passcode = "{key()}" {fill(i + 3)}') for i in range(6)] + [(100 + i, fill(i)) for i in range(200)]
    docs += [(400 + i, f"{fill(i)} u{i}@x{i}.org") for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in with_spans(d).collect()}
    for i in range(6):
        assert [(KINDS[s.kind], s.value) for s in rows[i].all_spans if KINDS[s.kind] in ("secret", "term")] == [("term", "passcode"), ("secret", docs[i][1].split('"')[1])]
        assert rows[i].spans == []
    assert all(not rows[100 + i].all_spans for i in range(200))
    assert all([KINDS[s.kind] for s in rows[400 + i].all_spans] == ["email"] for i in range(12))
    clean = {r.doc_id: r.text for r in sanitise(d).collect()}
    # The kind tells as much as its label; private data of any kind, of which there is more, tells less.
    assert clean[0] == docs[0][1].replace("passcode", "[PRIVATE]").replace(docs[0][1].split('"')[1], "[SECRET]")


def test_characters_of_secrets(spark):
    values = ["a" * 40, "0123456789abcdef" * 3, "deadbeef" * 5, "wordsonlywithoutanydigits", "12345678901234567890", "Zx9Q81kLmP02vRt7YbN3s"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", bits_a_character(F.col("v")).alias("bits"), F.size(secret_spans(F.col("v"))).alias("n")).collect()
    for r in rows:
        want = -sum(r.v.count(c) / len(r.v) * math.log2(r.v.count(c) / len(r.v)) for c in set(r.v))
        assert abs(r.bits - want) < 1e-9
    assert [r.n for r in rows] == [0, 1, 0, 0, 0, 1]


def test_clashing_columns_pass_through(spark):
    names = ["doc_id", "text", "spans", "all_spans", "extra", "h1", "h2", "x1"]
    d = spark.createDataFrame([(1, "to a@b.cc", *"abcdef"), (1, None, *"abcdef"), (2, "", *"ghijkl")], ", ".join(f"{n} string" if n != "doc_id" else "doc_id long" for n in names))
    out = sanitise(d)
    assert out.columns == names
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "to [EMAIL]", *"abcdef"), (1, None, *"abcdef"), (2, "", *"ghijkl")]))
    assert with_spans(d).columns == [*names, "spans_", "all_spans_"]


def test_terms_are_found_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    r = op3_private_data(spark, folder).agg(F.sum("n_term").alias("terms"), F.sum("n_secret").alias("secrets"), F.count("*").alias("rows")).first()
    assert r.rows == 1000 and r.secrets > 0 and r.terms > 0


def test_spans_are_found_once(spark, monkeypatch):
    """Spark moves a test of the spans below what finds them, whose patterns then run twice."""
    from tessera.llm import private_data

    plans, real = [], private_data.materialise
    monkeypatch.setattr(private_data, "materialise", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d))
    docs = spark.createDataFrame([(1, "a@b.cc and 1.2.3.4")], "doc_id long, text string")
    out = private_data.with_spans(docs)
    for plan in (plans[0], out._jdf.queryExecution().optimizedPlan().toString()):
        assert plan.count(private_data.PATTERNS["phone"]) <= 2  # split and extract
