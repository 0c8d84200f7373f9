import random

import numpy as np

from tessera.llm.boosting import Boosted
from tessera.llm.dom import parse
from tessera.llm.html_extraction import decode, extract, extracted, made_plain, marked, template, text_of, train


def test_tree_and_blocks():
    p = parse('<div><p>One <b>two<br>three<p>four &amp; &lt;x&gt;<ul><li>a<li>b</ul><script>var t="</p>";</script>tail<foot')
    text = text_of(p, [True] * len(p.tag))
    assert text == "One two three\nfour & <x>\na\nb\ntail"
    assert p.tag[:4] == ["#root", "div", "p", "b"]


def test_training_finds_the_article():
    model, rng = train([]), random.Random(99)
    good = bad = missed = 0
    for _ in range(150):
        page = parse(template(rng))
        y = marked(page)
        from tessera.llm.html_extraction import features

        chosen = decode(page, model.log_odds(features(page)))
        assert all(chosen[page.parent[i]] for i in range(1, len(chosen)) if chosen[i])
        sizes = np.zeros(len(page.tag))
        for e, _, t in page.texts:
            sizes[e] += len(t.strip())
        good += sizes[(y > 0) & chosen].sum()
        bad += sizes[(y == 0) & chosen].sum()
        missed += sizes[(y > 0) & ~np.array(chosen)].sum()
    assert good / (good + bad) > 0.97 and good / (good + missed) > 0.97


def test_plain_tags_keep_the_tree():
    page = parse(template(random.Random(1)))
    assert made_plain(page, random.Random(2)).parent == page.parent


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    assert ((Boosted().fit(x, y).log_odds(x) > 0) == (y > 0)).mean() > 0.98


def test_odd_pages(spark):
    texts = extract(train([]), [None, "", "plain", "<", "</p></div>", "<article><p>only &am", "<article>" + "<div>" * 3000 + "deep"])
    assert texts[0] == texts[1] == "" and len(texts) == 7
    d = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<article><p>Hello there, friends.</p></article>", "t")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in extracted(d).collect()}
    assert rows[1].text == "" and rows[1].n_chars == 0 and rows[2].n_chars == len(rows[2].text)
    assert extracted(d.limit(0)).collect() == []


def whole(html):
    page = parse(html)
    return text_of(page, [True] * len(page.tag))


def test_quotes_count_only_where_values_begin():
    assert whole("<p title=it's>Hello one.</p><p>second don't stop > here</p>") == "Hello one.\nsecond don't stop > here"
    assert whole("""<p a='x>y' b="p'q>" c = z>one</p><p d=">">two</p>""") == "one\ntwo"
    assert whole('<p>a < b, 1<2 and x<=y</p><!-- <p>no</p> --><!doctype x><?php y ?>end') == "a < b, 1<2 and x<=y\nend"
    assert whole("<p>kept<b cut") == "kept" and whole('<p>kept<a href="open') == "kept"
    assert whole("<br/>a<br />b<p/>c") == "a b\nc"
    page = parse("""<div class="Post main" ID=x-y role='nav'>t</div>""")
    assert page.tokens[1] == ("post", "main", "x", "y", "nav")


def test_damaged_pages_take_linear_time():
    import time

    for piece in ('<a "', "<div><b>x", "<p><button><b><div>", "<script>", "</script ", "<td><tr>x", "</x>", "<b>", "<!--", "<a b='", "&amp", "<ul><li><ul>", "<title>a"):
        times = []
        for n in (20_000, 80_000):
            began = time.process_time()
            parse(piece * n)
            times.append(time.process_time() - began)
        assert times[1] < 4 * 3 * max(times[0], 0.05), (piece, times)


def test_tokens_are_told_apart_without_lists():
    """A model sees the tokens themselves: pages whose article bears a word of no list."""
    from tessera.llm.html_extraction import features

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(12))
    page = lambda: parse("".join(f'<div class="{c}"><p>{line()}</p></div>' for c in rng.sample(["zorb", "quax", "quax"], 3)))
    train_, test = [page() for _ in range(60)], [page() for _ in range(30)]
    label = lambda p: np.array([float(t == ("zorb",)) for t in p.tokens])
    model = Boosted().fit(np.concatenate([features(p) for p in train_]), np.concatenate([label(p) for p in train_]))
    for p in test:
        assert ((model.log_odds(features(p)) > 0) == (label(p) > 0)).all()
