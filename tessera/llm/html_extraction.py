"""HTML extraction: boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

Every element has features: depth, tag, attribute tokens (hashed, and by two lists of telling ones), length, links, punctuation and tags of its subtree, and how it
stands among its siblings.  The trees are trained here, on at most TRAIN_PAGES pages (the least by a hash of their html,
of at most TRAIN_CHARS characters) that mark their article by its tag, on the same pages with their tell-tale tags made
plain, and on pages made up from templates.  Decoding takes the best set of elements that holds the parent of each
of its members; its text is the result.

Defined cases: null or empty html has an empty text, as a page without any text; damaged and cut html is read as far as
it goes, an unfinished tag at the end is dropped; equal pages get equal texts; an empty table gives an empty result;
columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import table
from .dom import Page, parse

TRAIN_PAGES = 256
TRAIN_CHARS = 200_000
TAGS = "html head body article main section div nav header footer aside form ul ol li table tr td h1 h2 h3 p a b span br script style title button blockquote pre".split()
TAG_INDEX = {t: i for i, t in enumerate(TAGS)}
GOOD = frozenset("article content main post entry story body text".split())
BAD = frozenset(
    "ad ads advert advertisement banner breadcrumb comment comments cookie cookies consent disqus footer header menu nav navbar navigation newsletter notice"
    " pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget reply replies".split()
)
NEVER = frozenset(("script", "style", "noscript", "template", "iframe", "head", "title", "button", "select", "textarea", "input"))
MARKED = frozenset(("nav", "header", "footer", "aside", "form", "dialog")) | NEVER
N_FEATURES = 22
#: Features for the attribute tokens by their hashes.
HASHED = 48
SPACES = re.compile(r"\s+")


@lru_cache(1 << 16)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % HASHED


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    tag, parent = page.tag, page.parent
    size, links, marks, tags, words = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
    for e, _, t in page.texts:
        size[e] += len(t)
        words[e] += t.count(" ")
        marks[e] += t.count(".") + t.count(",")
    own = size[:]
    inside_bad, inside_good, depth = [0] * n, [0] * n, [0] * n
    order, count = [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        t = page.tokens[i]
        bad = tag[i] in MARKED or (bool(t) and not BAD.isdisjoint(t))
        good = tag[i] in ("article", "main") or (bool(t) and not GOOD.isdisjoint(t))
        inside_bad[i] = inside_bad[p] + bad
        inside_good[i] = inside_good[p] + good
        order[i] = count[p]
        count[p] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if tag[i] == "a":
            links[i] = size[i]
        size[p] += size[i]
        links[p] += links[i]
        marks[p] += marks[i]
        tags[p] += tags[i]
        words[p] += words[i]
    out = np.zeros((n, N_FEATURES + HASHED))
    total = max(1, size[0])
    before = 0
    for i in range(n):
        p = parent[i]
        s, k = size[i], max(1, count[p] if i else 1)
        t = page.tokens[i]
        up = p if p > 0 else 0
        out[i, :N_FEATURES] = (
            depth[i], TAG_INDEX.get(tag[i], len(TAGS)), TAG_INDEX.get(tag[up], len(TAGS)), tag[i] in ("article", "main"), tag[i] in MARKED,
            bool(t) and not GOOD.isdisjoint(t), bool(t) and not BAD.isdisjoint(t), inside_good[i], inside_bad[i], s, own[i], links[i] / (s + 1), marks[i] / (s + 1),
            tags[i] / (s + 1), words[i], s / total, order[i] / k, k, s / (size[up] + 1), (size[up] - s) / k, before / total, links[up] / (size[up] + 1),
        )
        for x in t:
            out[i, N_FEATURES + bucket(x)] = 1
        before += own[i]
    return out


def marked(page: Page) -> np.ndarray | None:
    """1 for elements that hold or are in the marked article; None if the page marks none."""
    n = len(page.tag)
    inside, dropped, y = [False] * n, [False] * n, np.zeros(n)
    for i in range(1, n):
        p = page.parent[i]
        dropped[i] = dropped[p] or page.tag[i] in MARKED or not BAD.isdisjoint(page.tokens[i])
        inside[i] = inside[p] or page.tag[i] in ("article", "main")
        y[i] = inside[i] and not dropped[i]
    if not y.any():
        return None
    for i in range(n - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = 1
    return y


def made_plain(page: Page, rng: random.Random) -> Page:
    """The page with the tags and tokens that tell its parts made plain, each with probability 0.7."""
    out = Page()
    out.parent, out.texts = page.parent, page.texts
    plain = lambda t: t in ("article", "main", "nav", "header", "footer", "aside")
    hide = [rng.random() < 0.7 for _ in page.tag]
    out.tag = ["div" if h and plain(t) else t for t, h in zip(page.tag, hide, strict=True)]
    out.tokens = [() if h else t for t, h in zip(page.tokens, hide, strict=True)]
    return out


def template(rng: random.Random) -> str:
    """A made-up page with the parts that articles are mixed with."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda: " ".join(line(5, 18).capitalize() + "." for _ in range(rng.randint(1, 7)))
    part = lambda name, tag, body: f"<{tag}>{body}</{tag}>" if rng.random() < 0.5 and tag != "div" else f'<div class="{name}">{body}</div>'
    menu = "<ul>" + "".join(f'<li><a href="/{word()}">{line(1, 2)}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"
    before = [part("nav", "nav", menu), part("header", "header", f"<a href='/'>{line(1, 3)}</a>"), part("cookie-notice", "div", f"<p>{line(6, 14)}</p><button>ok</button>")]
    before += [part("ad", "div", line(3, 12)), part("search", "form", f"<input><label>{word()}</label>")]
    after = [part("footer", "footer", f"&copy; {line(2, 9)}"), part("sidebar", "aside", f"<h3>{line(1, 3)}</h3>{menu}"), part("related", "div", menu)]
    after += [part("comments", "div", "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4)))), part("ad", "div", line(3, 12))]
    body = "".join(rng.choice((f"<p>{prose()}</p>",) * 5 + (f"<h2>{line(2, 6)}</h2>", f"<ul><li>{prose()}</li><li>{prose()}</li></ul>", part("ad", "div", line(3, 12)), part("share", "div", menu))) for _ in range(rng.randint(2, 9)))
    pick = lambda xs: "".join(x for x in xs if rng.random() < 0.6)
    return f"<html><head><title>{line(2, 6)}</title></head><body>{pick(before)}<article><h1>{line(3, 9)}</h1>{body}</article>{pick(after)}</body></html>"


def train(pages: list[str]) -> Boosted:
    rng = random.Random(11)
    xs, ys = [], []
    for html in pages + [template(rng) for _ in range(120)]:
        page = parse(html)
        y = marked(page)
        if y is None:
            continue
        for v in (page, made_plain(page, rng)):
            xs.append(features(v))
            ys.append(y)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The set of elements of the greatest likelihood among those that hold the parent of each member."""
    n = len(page.tag)
    keep = [0.0] * n
    gain = odds.tolist()
    for i in range(n):
        if page.tag[i] in NEVER:
            gain[i] = -1e9
    for i in range(n - 1, -1, -1):
        total = gain[i] + keep[i]
        gain[i] = total
        if i and total > 0:
            keep[page.parent[i]] += total
    chosen = [False] * n
    for i in range(n):
        chosen[i] = gain[i] > 0 and (i == 0 or chosen[page.parent[i]])
    return chosen


def text_of(page: Page, chosen: list[bool]) -> str:
    blocks: list[str] = []
    parts: list[str] = []
    now = -1
    for e, b, t in page.texts:
        if b != now:
            if parts:
                blocks.append("".join(parts))
            parts, now = [], b
        if chosen[e]:
            parts.append(t)
    if parts:
        blocks.append("".join(parts))
    clean = (SPACES.sub(" ", x).strip() for x in blocks)
    return "\n".join(x for x in clean if x)


def extract(model: Boosted, htmls: list[str | None]) -> list[str]:
    pages = [parse(h or "") for h in htmls]
    if not pages:
        return []
    out = []
    for start in range(0, len(pages), 256):
        some = pages[start : start + 256]
        odds = model.log_odds(np.concatenate([features(p) for p in some]))
        at = 0
        for p in some:
            out.append(text_of(p, decode(p, odds[at : at + len(p.tag)])))
            at += len(p.tag)
    return out


def sample(pages: DataFrame) -> list[str]:
    """The distinct pages with the least hashes; hashes go to the driver first, then only the pages that have them."""
    d = pages.select("html", F.xxhash64("html").alias("h")).where(F.length("html").between(1, TRAIN_CHARS))
    least = [r["h"] for r in d.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).collect()]
    return sorted(r["html"] for r in d.where(F.col("h").isin(least)).select("html").distinct().collect()) if least else []


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = train(sample(pages))
    key = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract(model, batch.column(2).to_pylist())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
