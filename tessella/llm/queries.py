"""Queries of the problems on training text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.mixing import mix
from tessella.llm.neardup import alike_pairs
from tessella.llm.pairs import find_defects
from tessella.llm.stuffing import score_pages
from tessella.llm.tokens import encode, encode_with_offsets, round_trip
from tessella.session import spread, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with a defect, and its kind."""
    return find_defects(spread(spark, d, "autoq_questions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of ids whose word sets are alike to at least 0.7."""
    return alike_pairs(table(spark, d, "autoq_questions"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode(spread(spark, d, "documents"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The ids with the bytes and characters they cover."""
    return encode_with_offsets(spread(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's ids decode to its text."""
    return round_trip(spread(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the mix with the source it counts for and how often it is used."""
    return mix(spread(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mix(spread(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity and abnormal share of every document with text."""
    return score_pages(spread(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The flagged pages."""
    return p8_scores(spark, d).where(F.col("flagged")).select("doc_id")


QUERIES = {
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p6_offsets": p6_offsets,
    "p6_round_trip": p6_round_trip,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}
ORACLES: dict[str, str] = {}
