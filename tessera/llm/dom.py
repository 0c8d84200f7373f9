"""A small HTML reader: elements with parents, and the text between tags in page order."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape

#: What may come after "<" in a tag: "/" for an end, and the name.
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Up to the value of an attribute: its name, and "=" with what stands around it.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
NAMED = frozenset(("class", "id", "role", "itemprop"))
TOKEN = re.compile(r"[a-z]+", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li"
    " main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What an opening tag closes, if that is open inside the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
P_SCOPE = frozenset(("button", "table", "td", "th", "caption", "html", "object"))
CLOSES_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "select", "title", "head", "html", "body"}


class Page:
    """Elements by number, in page order; 0 is the root.  texts: (element, block, text) in page order."""

    __slots__ = ("tag", "parent", "tokens", "texts")

    def __init__(self) -> None:
        self.tag = ["#root"]
        self.parent = [-1]
        self.tokens: list[tuple[str, ...]] = [()]
        self.texts: list[tuple[int, int, str]] = []


def attributes(html: str, at: int) -> tuple[int, list[str], bool]:
    """From after a tag's name: where the tag ends (-1: it doesn't), the values of NAMED attributes, and whether it closes itself.

    A quote counts only where a value begins; each character is passed once.
    """
    values: list[str] = []
    n = len(html)
    while True:
        m = ATTRIBUTE.match(html, at)
        if m is None:
            end = html.find(">", at)
            return (end + 1 if end >= 0 else -1), values, end > at and html[end - 1] == "/"
        at, value = m.end(), ""
        if m[2]:
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return -1, values, False
                value, at = html[at + 1 : end], end + 1
            else:
                u = UNQUOTED.match(html, at)
                value, at = u[0], u.end()
        if m[1].lower() in NAMED:
            values.append(value)
        if at >= n:
            return -1, values, False


class Stack:
    """The open elements.  Counts of their tags, and for each level the outermost open p above the nearest scope, spare searches."""

    def __init__(self, tag: list[str]) -> None:
        self.tag, self.items, self.open, self.p = tag, [0], Counter(), [0]

    def push(self, i: int) -> None:
        t = self.tag[i]
        self.p.append(0 if t in P_SCOPE else self.p[-1] or (len(self.items) if t == "p" else 0))
        self.items.append(i)
        self.open[t] += 1

    def cut(self, k: int) -> None:
        self.open.subtract(self.tag[i] for i in self.items[k:])
        del self.items[k:], self.p[k:]

    def end(self, name: str) -> None:
        if self.open[name] > 0:
            k = len(self.items) - 1
            while self.tag[self.items[k]] != name:
                k -= 1
            self.cut(k)

    def begin(self, name: str) -> None:
        """Close what an opening tag closes: the outermost such element above the nearest one of the scope."""
        if name in CLOSES_P and self.p[-1]:
            self.cut(self.p[-1])
        if name not in CLOSES:
            return
        names, scope = CLOSES[name]
        if not any(self.open[x] > 0 for x in names):
            return
        found = 0
        for k in range(len(self.items) - 1, 0, -1):
            t = self.tag[self.items[k]]
            if t in names:
                found = k
            elif t in scope:
                break
        if found:
            self.cut(found)


def parse(html: str) -> Page:
    page = Page()
    tag, parent, tokens, texts = page.tag, page.parent, page.tokens, page.texts
    stack, block, at, n = Stack(tag), 0, 0, len(html)
    begun = 0

    def say(text: str) -> None:
        if text:
            texts.append((stack.items[-1], block, unescape(text) if "&" in text else text))

    while at < n:
        start = html.find("<", at)
        if start < 0:
            break
        follows = html[start + 1 : start + 2]
        m = NAME.match(html, start + 1)
        if m is None and follows not in ("!", "?", "/"):
            at = start + 1
            continue
        say(html[begun:start])
        begun = n
        if m is None:
            if html.startswith("<!--", start):
                end, size = html.find("-->", start + 4), 3
            else:
                end, size = html.find(">", start + 1), 1
            at = begun = end + size if end >= 0 else n
            continue
        end, values, closed = attributes(html, m.end())
        if end < 0:
            break
        at = begun = end
        name = m[2].lower()
        if m[1]:
            if name == "br":
                texts.append((stack.items[-1], block, " "))
            stack.end(name)
            if name in BLOCKS:
                block += 1
            continue
        stack.begin(name)
        if name in BLOCKS:
            block += 1
        if name == "br":
            texts.append((stack.items[-1], block, " "))
        i = len(tag)
        tag.append(name)
        parent.append(stack.items[-1])
        tokens.append(tuple(t.lower() for v in values for t in TOKEN.findall(v)))
        if name in VOID or closed:
            continue
        if name in RAW:
            over = raw_end(name).search(html, at)
            stop = over.start() if over else n
            if name == "title" and stop > at:
                texts.append((i, block, unescape(html[at:stop])))
            end = html.find(">", over.end()) if over else -1
            at = begun = end + 1 if end >= 0 else n
            continue
        stack.push(i)
    say(html[begun:])
    return page


@cache
def raw_end(name: str) -> re.Pattern[str]:
    return re.compile(f"</{name}(?=[\\s/>])", re.I)
