"""Encoding a corpus with a public byte-level BPE tokenizer, and decoding it.

The tokenizers library runs over Arrow batches; every task loads the file once. Texts are encoded
whole, without special tokens; strings that look like special tokens are ordinary text.

Defined results: null and empty texts have empty lists; any other text, however long or odd, has the
ids of its UTF-8 bytes; rows are neither merged nor dropped; extra columns are ignored by `encode`.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public tokenizers' files lie on every executor.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, one per Python worker; the tasks are the only parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def byte_table() -> dict[str, int]:
    """The byte of each character that byte-level BPE writes for it: printable ones stand for themselves, the rest follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def id_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id of a vocabulary."""
    table = byte_table()
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    out = {i: bytes(table[c] for c in piece) for piece, i in said["model"]["vocab"].items() if all(c in table for c in piece)}
    return out | {t["id"]: t["content"].encode() for t in said.get("added_tokens", []) if t["id"] not in out}


def byte_spans(text: str, ids: list[int], known: dict[int, bytes]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the ids in bytes of the text; they tile it without gaps, also where an id is part of a character."""
    starts, ends, at = [], [], 0
    for i in ids:
        starts.append(at)
        at += len(known[i])
        ends.append(at)
    return starts, ends


def char_index(text: str) -> np.ndarray:
    """For each byte of the text the index of its character, and the number of characters at the end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    # All bytes but those that continue a character begin one.
    return np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))


def encode(docs: DataFrame, name: str = BYTE_BPE, folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text", batch: int = 256) -> DataFrame:
    """(key, ids): the ids of every row's text."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for whole in batches:
            for b in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                texts = [x or "" for x in b.column(1).to_pylist()]
                ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def encode_with_offsets(docs: DataFrame, name: str = BYTE_BPE, folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, byte_starts, char_starts, char_ends): ids with the bytes and the characters they cover.

    An id that covers part of a character has that character's index as start and the next one's as end."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = load(path), id_bytes(path)
        ints = pa.list_(pa.int32())
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for x in b.column(1).to_pylist():
                x = x or ""
                ids = t.encode(x, add_special_tokens=False).ids
                starts, ends = byte_spans(x, ids, known)
                chars = char_index(x)
                for r, v in zip(rows, (ids, starts, chars[np.array(starts, int)], chars[np.array(ends, int) - 1] + 1)):
                    r.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(r, ints) for r in rows]], [key, "ids", "byte_starts", "char_starts", "char_ends"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, byte_starts array<int>, char_starts array<int>, char_ends array<int>")


def decode(encoded: DataFrame, name: str = BYTE_BPE, folder: str = TOKENIZERS, key: str = "doc_id") -> DataFrame:
    """(key, text): the texts of id lists; bytes that form no character (a list cut inside one) become the replacement character."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = id_bytes(path)
        for b in batches:
            texts = [b"".join([known[i] for i in ids or ()]).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def token_counts(docs: DataFrame, name: str = BYTE_BPE, folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, n_tokens); only the numbers leave the Python workers."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                n = [len(e.ids) for e in t.encode_batch_fast([x or "" for x in b.column(1).to_pylist()], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(2 + i) for i in range(len(carry))], pa.array(n, pa.int64())], [key, *carry, "n_tokens"])

    kinds = dict(docs.dtypes)
    return docs.select(key, text, *carry).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in (key, *carry)]) + ", n_tokens bigint")


def round_trip(docs: DataFrame, name: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens, same): whether decoding the ids gives the text again; each text is tokenized once and never shuffled."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = load(path), id_bytes(path)
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                texts = [x or "" for x in b.column(1).to_pylist()]
                ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                same = [b"".join([known[i] for i in x]).decode("utf-8", "replace") == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, same boolean")
