"""Text cleaning, matching and chunk boundaries as column expressions; Unicode-aware, in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP, PAGE_CHARS = 1200, 200, 2400


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and hand it to ``body``, however often that uses it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def clean(c: Column) -> Column:
    c = F.replace(c, F.lit("\0"), F.lit(""))
    c = F.regexp_replace(c, "[ \\t]+\\n", "\n")
    return strip(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def matchable(c: Column) -> Column:
    """Lower case, no soft hyphens, one space for runs of spaces and dashes."""
    c = F.replace(F.replace(F.lower(c), F.lit("\u00ad"), F.lit("")), F.lit("\u2010"), F.lit("-"))
    return strip(F.regexp_replace(c, "(?U)[\\s\\-–—]+", " "))


def normal(c: Column) -> Column:
    return strip(F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), "(?U)\\s+", " "))


def without_urls(c: Column) -> Column:
    c = F.regexp_replace(c, "\\[([^\\]]+)\\]\\(https?://[^)]+\\)", "$1")
    c = F.regexp_replace(c, "(?i)(https?://|www\\.)[^\\s<>]+|localhost(:[0-9]+)?[^\\s<>]*", "")
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(c, "[\\t\\f\\x0b ]{2,}", " "), "\\n{3,}", "\n\n"))


def truncated(c: Column, limit: int) -> Column:
    short = F.regexp_replace(F.left(c, F.lit(limit - 1)), "(?U)\\s+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(short, F.lit("…")))


def one_line_breaks(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "[\\t\\r\\f\\x0b ]+", " "), "\\n{2,}", "\n"))


def unescaped(c: Column) -> Column:
    """The named references that web pages here use; the ampersand last."""
    for name, value in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def plain(html: Column) -> Column:
    c = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, "(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "(?i)<br\\s*/?>", "\n"), "(?i)</p>", "\n")
    return clean(unescaped(F.regexp_replace(c, "<[^>]+>", " ")))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("(?U)\\w+"), F.lit(0))


def stem(w: Column) -> Column:
    n = F.length(w)
    return F.when(n >= 10, F.left(w, F.lit(9))).when(n >= 7, F.left(w, F.lit(7))).when(n >= 5, F.left(w, F.lit(5))).otherwise(w)


def last_at(w: Column, mark: str) -> Column:
    """0-based place of the last occurrence, -1 if there is none."""
    n = F.length(w) - F.instr(F.reverse(w), mark[::-1]) + 1 - len(mark)
    return F.when(F.instr(w, mark) > 0, n).otherwise(-1)


def chunk_length(w: Column, rest: Column, size: int = CHUNK_SIZE) -> Column:
    """Length of the chunk at the start of a window of up to ``size`` characters; rest: characters from there to the end.

    The window is cut after its last paragraph or bullet, else before its last numbered item, else after its last
    line, if that is in its second half; else it is taken whole.
    """
    half = size // 2
    cut = F.when(rest <= size, F.length(w))
    for mark in ("\n\n", "\n•", "\n- ", "\n— "):
        cut = cut.when(last_at(w, mark) >= half, last_at(w, mark) + len(mark))
    head = F.regexp_extract(w, "(?s)^(.*)\\n\\d+[.)]\\s", 1)
    numbered = F.when(w.rlike("\\n\\d+[.)]\\s"), F.length(head)).otherwise(-1)
    cut = cut.when(numbered >= half, numbered)
    return cut.when(last_at(w, "\n") >= half, last_at(w, "\n") + 1).otherwise(F.length(w))


def embed_text(title: Column, page: Column, body: Column, limit: int) -> Column:
    """Header and body; a body over the limit keeps its head and tail."""
    head = F.when(title != "", F.concat(F.lit("["), title, F.lit("] стр. "), page.cast("string"), F.lit("\n"))).otherwise("")
    room = F.greatest(F.lit(220), F.lit(limit) - F.length(head) - 8)
    front = F.greatest(F.lit(140), F.floor(room * 2 / 3).cast("int"))
    back = F.greatest(F.lit(80), room - front - 5)
    back = F.when(front + back + 5 > room, F.greatest(F.lit(60), room - front - 5)).otherwise(back)
    cut = F.concat(F.left(body, front), F.lit("\n...\n"), F.right(body, back))
    fits = (F.length(head) + F.length(body) <= limit) | (F.length(body) <= room)
    return F.when(body == "", F.when(head == "", ".").otherwise(F.rtrim(F.replace(head, F.lit("\n"), F.lit(""))))).otherwise(F.concat(head, F.when(fits, body).otherwise(cut)))


def safe_name(c: Column) -> Column:
    return F.left(F.regexp_replace(c, "(?U)[^\\w.\\-]", "_"), F.lit(80))
