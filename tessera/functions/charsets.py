"""Character sets: decoding bytes, undoing double decoding, look-alike letters, and string similarity, by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tried in this order when bytes aren't UTF-8, fixed values.
CODECS = ["cp1251", "cp866", "koi8-r", "mac_cyrillic"]
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
FREQUENT = "оеаинтсрвл"
#: Latin letters and the Cyrillic ones they look like.
LOOK_ALIKE = str.maketrans("ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху")


def plausibility(text: str) -> tuple[int, int, int]:
    """Frequent lower-case letters, all Cyrillic letters, minus what text doesn't hold: higher is likelier."""
    common = sum(c in FREQUENT for c in text)
    letters = sum("а" <= c <= "я" or c in "ё" for c in text)
    odd = sum("─" <= c <= "▟" or (ord(c) < 32 and c not in "\t\n\r\f") or c == "�" or "Ђ" <= c <= "Џ" or "ђ" <= c <= "џ" for c in text)
    shouting = sum(a.islower() and b.isupper() for a, b in zip(text, text[1:], strict=False))
    return common + letters - 8 * odd - 4 * shouting, letters, -odd


def decode(data: bytes | None) -> str | None:
    if data is None:
        return None
    for mark, codec in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    found = []
    for n, codec in enumerate(CODECS):
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            continue
        found.append((plausibility(text), -n, text))
    return max(found)[2] if found else data.decode("utf-8", "replace")


def undo_double_decoding(text: str | None) -> str | None:
    """What was UTF-8 read as a one-byte set, if the inverse is clearly likelier; else the text."""
    if not text:
        return text
    best, gain = text, plausibility(text)[0] + 5
    for codec in ("cp1251", "latin-1", "cp1252"):
        try:
            other = text.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
        if plausibility(other)[0] > gain:
            best, gain = other, plausibility(other)[0]
    return best


def one_script(text: str | None) -> str | None:
    """Latin look-alikes inside words that have Cyrillic letters become Cyrillic; addresses stay."""
    if not text:
        return text
    out = []
    for word in text.split(" "):
        mixed = any("Ѐ" <= c <= "ӿ" for c in word) and any(c.isascii() and c.isalpha() for c in word)
        out.append(word.translate(LOOK_ALIKE) if mixed and "@" not in word and "://" not in word else word)
    return " ".join(out)


def mapped(function, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(function, na_action=None)

    return run


decoded = mapped(lambda b: decode(None if b is None else bytes(b)), T.StringType())
repaired = mapped(undo_double_decoding, T.StringType())
unmixed = mapped(one_script, T.StringType())


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
