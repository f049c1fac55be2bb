"""Texts of document files: plain text, PDF pages, DOCX paragraphs, HTML pages; by Arrow batches over binary files.

PDF text is read from uncompressed and Flate-compressed content streams with literal or hexadecimal strings, which
is what plain generators write; for other encodings a decoder of one's own is passed. Defined results: unknown
suffixes, encrypted and broken files give empty texts, never an error; empty pages are left out; folders without any file
give an empty table.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Decoder = Callable[[bytes], list[str]]

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_STRING = re.compile(rb"\((?:[^()\\]|\\.|\([^()]*\))*\)|<[0-9A-Fa-f\s]+>|\bT[dDmJj*]\b|\bET\b|'", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    if raw[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode()).decode("latin-1")
    return _ESCAPE.sub(lambda m: _PLAIN.get(m[1], bytes([int(m[1], 8) % 256]) if m[1].isdigit() else m[1]), raw[1:-1]).decode("latin-1")


def pdf_pages(content: bytes) -> list[str]:
    """The text of every page that has any, white space collapsed."""
    objects = {int(n): body for n, body in _OBJECT.findall(content)}
    pages = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        text = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", found[1]) if found else []:
            holder = objects.get(int(ref), b"")
            stream = _STREAM.search(holder)
            if not stream:
                continue
            data = stream[1]
            if b"/FlateDecode" in holder:
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    continue
            for piece in _STRING.findall(data):
                # Text operators that move on part the strings before them from those after.
                text.append(_literal(piece) if piece[:1] in b"(<" else " " if piece in (b"Td", b"TD", b"Tm", b"T*", b"ET", b"'") else "")
        flat = re.sub(r"\s+", " ", "".join(text)).strip()
        if flat:
            pages.append(flat)
    return pages


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    from html import unescape

    paragraphs = ["".join(re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", p, re.S)) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)]
    return "\n".join(unescape(p) for p in paragraphs if p.strip())


def decoded(path: str, content: bytes, pdf: Decoder = pdf_pages) -> list[str]:
    """The pages of a file by its suffix; files other than PDF are one page."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        if suffix in ("txt", "md"):
            return [content.decode("utf-8", "replace")]
        if suffix == "pdf":
            return pdf(content)
        if suffix == "docx":
            return [docx_text(content)]
        if suffix in ("htm", "html"):
            bare = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]+>", " ", content.decode("utf-8", "replace"))
            return [re.sub(r"\s+", " ", bare).strip()]
    except Exception:  # a broken file of any kind has no text
        return []
    return []


def read_documents(spark: SparkSession, folder: str, pdf: Decoder = pdf_pages, suffixes: tuple[str, ...] = ("txt", "md", "pdf", "docx", "html")) -> DataFrame:
    """(path, page, text): every page with text of the files of a folder tree, pages from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, t) for p, c in zip(b["path"], b["content"]) for i, t in enumerate(decoded(p, bytes(c), pdf), 1) if t.strip()]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, page bigint, text string")


def first_folder(spark: SparkSession, *folders: str, suffix: str = "pdf") -> str | None:
    """The first of some folders that holds a file of the suffix."""
    for folder in folders:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(folder)
            if not files.select("path").limit(1).isEmpty():
                return folder
        except Exception:  # a folder that is not there
            continue
    return None


def ascii_only(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts without characters beyond ASCII; what is left empty is dropped."""
    plain = F.trim(F.regexp_replace(text, r"[^\x00-\x7f]", ""))
    return df.withColumn(text, plain).where(F.col(text) != "")
