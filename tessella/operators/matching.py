"""Substring matches between names and texts: one automaton of a block of names runs over every text.

Defined results: null and empty names and texts match nothing; a name counts once for a text; upper and lower case are
alike; empty tables give an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.blocks import against


def contained(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name_key, text_key) of all names (key, name) that stand somewhere in a text (key, text)."""

    def prepare(pdf: pd.DataFrame):
        import ahocorasick

        by: dict[str, list] = {}
        for k, n in zip(pdf["key"], pdf["name"]):
            by.setdefault(n, []).append(k)
        a = ahocorasick.Automaton()
        for n, keys in by.items():
            a.add_word(n, keys)
        a.make_automaton()
        return a

    def reduce(a, part: pd.DataFrame) -> pd.DataFrame:
        rows = {(n, k) for k, t in zip(part["key"], part["text"]) for _, keys in a.iter(t) for n in keys}
        return pd.DataFrame(list(rows), columns=["name_key", "text_key"])

    left = names.select(F.col("key").cast("string").alias("key"), F.lower("name").alias("name")).where("key is not null and name <> ''").distinct()
    right = texts.select(F.col("key").cast("string").alias("key"), F.lower("text").alias("text")).where("key is not null and text <> ''").distinct()
    return against(left, right, prepare, reduce, "name_key string, text_key string", "key", "key", (50_000, 50_000, 100_000)).distinct()
