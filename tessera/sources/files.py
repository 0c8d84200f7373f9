"""Files to pages: one row per page, errors as a column, readers by suffix or first bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.charsets import decode
from tessera.functions.text import safe_name

MAX_BYTES = 50 << 20
MAX_PAGES = 200
PAGES = "file_id string, filename string, sha256 string, page int, text string, error string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Reader = Callable[[bytes], list[str]]
#: Readers by kind; more (PDF, OCR, speech) are added by ``register``.
READERS: dict[str, Reader] = {}


def register(kind: str, reader: Reader) -> None:
    READERS[kind] = reader


def read_text(data: bytes) -> list[str]:
    return [p for p in (decode(data) or "").split("\f") if p.strip()]


def read_docx(data: bytes) -> list[str]:
    """Paragraphs and tables in the order of the body; a row's cells are joined, empty ones left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    said = lambda e: "".join(x.text or "" for x in e.iter(f"{W}t")).strip()
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            out.append(said(e))
        elif e.tag == f"{W}tbl":
            for row in e.iter(f"{W}tr"):
                out.append(" | ".join(c for c in map(said, row.iter(f"{W}tc")) if c))
    return ["\n".join(x for x in out if x)]


register("txt", read_text)
register("md", read_text)
register("docx", read_docx)


def kind_of(name: str, data: bytes) -> str:
    tail = name.rsplit("/", 1)[-1]
    kind = tail.rsplit(".", 1)[-1].lower() if "." in tail else ""
    return kind or ("pdf" if data[:5] == b"%PDF-" else "")


def pages_of(name: str, data: bytes, readers: dict[str, Reader]) -> tuple[list[str], str | None]:
    kind = kind_of(name, data)
    if not data:
        return [], "empty file"
    if len(data) > MAX_BYTES:
        return [], "file too large"
    if kind == "pdf" and data[:5] != b"%PDF-":
        return [], "not a PDF file"
    if kind not in readers:
        return [], f"no reader for {kind or 'files without a suffix'}"
    try:
        pages = readers[kind](data)
    except Exception as e:  # a damaged file is a row with its error, not a lost job
        return [], f"{type(e).__name__}: {e}"
    return (pages, None) if len(pages) <= MAX_PAGES else ([], "too many pages")


def pages(files: DataFrame) -> DataFrame:
    """PAGES of files (path, content); a file without pages is one row with its error, one without bytes has no row."""
    readers = dict(READERS)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(F.left(F.sha2("content", 256), F.lit(12)).alias("file_id"), safe_name(name).alias("filename"), F.sha2("content", 256).alias("sha256"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples():
                found, error = pages_of(r.filename, bytes(r.content), readers)
                rows += [(r.file_id, r.filename, r.sha256, n + 1, p, None) for n, p in enumerate(found)] or [(r.file_id, r.filename, r.sha256, 0, "", error or "no text")]
            yield pd.DataFrame(rows, columns=["file_id", "filename", "sha256", "page", "text", "error"])

    return files.mapInPandas(run, PAGES)


def load(spark: SparkSession, path: str) -> DataFrame:
    return pages(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def export_text(rows: DataFrame, path: str) -> None:
    """Plain lines: text of the rows, in files of the partitions they are in."""
    rows.select("text").write.mode("overwrite").text(path)


def needs_ocr(pages: DataFrame) -> DataFrame:
    """file_id, needs_ocr: whether the first three pages hold 40 characters at most each."""
    first = F.array_sort(F.collect_list(F.struct("page", F.length("text").alias("n"))))
    return pages.groupBy("file_id").agg(F.forall(F.slice(first, 1, 3), lambda x: x["n"] <= 40).alias("needs_ocr"))
