"""Chunkers whose steps depend on one another: recursive splitting, paragraph packing, greedy batches.

They run over Arrow batches, one text at a time; texts are independent, so nothing is shuffled.
Defined results: null and blank texts give no chunk; a piece longer than the limit is split further, and
what cannot be split is kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Separators, size and overlap by type of document.
LADDERS = {
    "installation": (["\n\n", "\n", "1.", "2.", "3.", ".", " "], 1000, 200),
    "datasheet": (["\nTechnical Specifications\n", "\nSpecifications\n", "\nFeatures and Benefits\n", "\nFeatures\n", "\nElectrical\n", "\nMechanical\n", "\nEnvironmental\n", "\nDescription\n", "\nGeneral\n", "\n\n", "\n"], 700, 120),
    "other": (["\n\n", "\n", ".", " "], 800, 150),
}


def recursive_split(text: str, ladder: list[str], size: int, overlap: int) -> list[str]:
    """Pieces of at most size characters, cut at the first separator of the ladder that occurs, with overlap."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in ladder if s in text), None)
    if sep is None:
        return [text[i : i + size] for i in range(0, len(text), size - overlap) if text[i : i + size].strip()]
    rest = ladder[ladder.index(sep) + 1 :]
    out: list[str] = []
    cur: list[str] = []
    length = 0
    for piece in text.split(sep):
        if len(piece) > size:
            if cur:
                out.append(sep.join(cur))
                cur, length = [], 0
            out += recursive_split(piece, rest, size, overlap)
            continue
        if cur and length + len(sep) + len(piece) > size:
            out.append(sep.join(cur))
            while cur and (length > overlap or length + len(sep) + len(piece) > size):
                length -= len(cur.pop(0)) + len(sep)
            length = max(length, 0)
        cur.append(piece)
        length = len(sep.join(cur))
    if cur:
        out.append(sep.join(cur))
    return [p for p in out if p.strip()]


def pack(parts: list[str], limit: int) -> list[list[str]]:
    """Next-fit: parts in order, a new batch when the limit of characters / 4 is passed; an oversize part is alone."""
    out: list[list[str]] = []
    used = 0
    for p in parts:
        n = max(1, len(p) // 4)
        if not out or used + n > limit:
            out.append([])
            used = 0
        out[-1].append(p)
        used += n
    return out


def split_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk) by recursive splitting with the separators, size and overlap of the document's type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, t, kind in zip(b["doc_id"], b["text"], b["doc_type"]) if t for k, c in enumerate(recursive_split(t, *LADDERS.get(kind, LADDERS["other"])))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "chunk"])

    return docs.select("doc_id", "text", "doc_type").mapInPandas(run, "doc_id bigint, pos bigint, chunk string")


def pack_paragraphs(docs: DataFrame, limit: int = 120) -> DataFrame:
    """(doc_id, pos, chunk): paragraphs packed up to a token limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"]):
                paragraphs = [p.strip() for p in (t or "").split("\n\n") if p.strip()]
                rows += [(i, k, "\n\n".join(c)) for k, c in enumerate(pack(paragraphs, limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, pos bigint, chunk string")


def batch_sentences(docs: DataFrame, limit: int = 60) -> DataFrame:
    """(doc_id, batch, n, tokens): the lines of each document in batches of at most limit estimated tokens, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"]):
                parts = [p for p in (t or "").split("\n") if p.strip()]
                rows += [(i, k, len(c), sum(max(1, len(p) // 4) for p in c)) for k, c in enumerate(pack(parts, limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "batch", "n", "tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, batch bigint, n bigint, tokens bigint")
