"""Providers of model-backed columns: one interface, deterministic local defaults, retries, results cached by input digest.

A provider is a function from string columns to a column. A remote model is a provider whose function is an Arrow UDF made
by `remote`, which retries with growing pauses; nothing else in the engine depends on which one is set. Defaults:

embed: hashed word counts. rerank: keyword score. answer: best answer line, else the sentences of greatest overlap.
entities and relations: the rules of e1 and l2. judge: the composite score. questions: the template. paraphrase: none.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[..., Column]
DIMENSIONS = 64
ATTEMPTS, PAUSE = 6, 5.0  # calls at most, seconds between two at most


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector of word counts by hash bucket; null and empty texts have the zero vector."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))

    @F.pandas_udf("array<float>")
    def counted(column: pd.Series) -> pd.Series:
        # All texts of a batch at once: a pass over the words, not one for each bucket.
        row = np.repeat(np.arange(len(column)), [len(b) for b in column])
        at = np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64)
        return pd.Series(list(np.bincount(row * dimensions + at, minlength=len(column) * dimensions).reshape(-1, dimensions).astype(np.float32)))

    return counted(buckets)


def overlap_score(question: Column, text: Column) -> Column:
    """How many of the question's words stand in a text."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(question, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    return F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))).cast("double")


def extractive_answer(question: Column, text: Column) -> Column:
    """The best answer line of a text, else its sentence of the greatest overlap; empty where there is none."""

    @F.pandas_udf("string")
    def answer(q: pd.Series, t: pd.Series) -> pd.Series:
        from tessella.operators.answers import best_line

        def one(question: str | None, body: str | None) -> str:
            if not question or not body:
                return ""
            line = best_line(question, body)[0]
            if line:
                return line
            words = {w for w in question.lower().split() if len(w) > 2}
            sentences = [s.strip() for s in body.replace("\n", ". ").split(". ") if s.strip()]
            return max(sentences, key=lambda s: sum(w in s.lower() for w in words), default="")

        return pd.Series([one(a, b) for a, b in zip(q, t)])

    return answer(question, text)


def template_question(product: Column, name: Column) -> Column:
    return F.concat(F.lit("What is the "), F.replace(name, F.lit("_"), F.lit(" ")), F.lit(" of the "), product, F.lit("?"))


@dataclass(frozen=True)
class Providers:
    """The providers of a run."""

    embed: Provider = hashed_embedding
    rerank: Provider = overlap_score
    answer: Provider = extractive_answer
    question: Provider = template_question
    paraphrase: Provider | None = None
    extra: dict[str, Provider] = field(default_factory=dict)


def call_with_retry(call: Callable[[], object], attempts: int = ATTEMPTS, pause: float = PAUSE, retries: tuple[str, ...] = ("rate limit", "429", "timeout"), sleep: Callable[[float], None] = time.sleep):
    """The result of a call; errors that name a limit are tried again after pauses of 1, 2, 4 and at most `pause` seconds, others are raised at once."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not any(r in str(e).lower() for r in retries):
                raise
            sleep(min(pause, 2.0**n))


def remote(call: Callable[[str], str], returns: str = "string") -> Provider:
    """A provider that calls a service for each text of an Arrow batch, with retries; null texts are not sent."""

    def provider(text: Column) -> Column:
        @F.pandas_udf(returns)
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else call_with_retry(lambda: call(t)))

        return run(text)

    return provider


def with_provider(df: DataFrame, text: str, out: str, provider: Provider = hashed_embedding, cache: DataFrame | None = None) -> DataFrame:
    """`df` with the provider's column; rows whose text is in the cache (digest, value) take the cached value, and only the others are computed."""
    keyed = df.withColumn("_digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    if cache is None:
        return keyed.withColumn(out, provider(F.col(text))).drop("_digest")
    once = cache.select(F.col("digest").alias("_digest"), F.col("value").alias(out)).dropDuplicates(["_digest"])
    known = keyed.join(once, "_digest")
    fresh = keyed.join(once.select("_digest"), "_digest", "left_anti").withColumn(out, provider(F.col(text)))
    return known.unionByName(fresh).drop("_digest")


def cache_of(df: DataFrame, text: str, value: str) -> DataFrame:
    """(digest, value): what a run leaves for the next, each text once."""
    return df.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), F.col(value).alias("value")).dropDuplicates(["digest"])
