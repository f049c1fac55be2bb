"""Queries of the general data-preparation problems: units, wide tables, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.packed import packed_texts, split_packed
from tessella.operators.units import normalise_units
from tessella.operators.wide import unpivot, widen
from tessella.session import spread, table


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity record in the common unit, stated or inferred, with posterior and flag."""
    return normalise_units(spread(spark, d, "product_records"), table(spark, d, "field_catalog"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The records whose unit is stated."""
    return p1_units(spark, d).where(F.col("unit_source") != "inferred").select("record_id", "bound", "common_milli")


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per product with typed columns; the maps of failed casts as text so that they can be compared."""
    wide = widen(spread(spark, d, "product_records"), table(spark, d, "products"), table(spark, d, "field_catalog"))
    return wide.withColumns({c: F.to_json(c) for c in ("cast_failures", "all_cast_failures")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells of the wide table."""
    return unpivot(widen(spread(spark, d, "product_records"), table(spark, d, "products"), table(spark, d, "field_catalog"), False))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of all fields that hold at least two."""
    texts = packed_texts(spread(spark, d, "autoq_questions"), spread(spark, d, "product_records"), table(spark, d, "field_catalog"))
    return split_packed(texts, table(spark, d, "products"))


QUERIES = {"p1_found": p1_found, "p1_units": p1_units, "p2_found": p2_found, "p2_wide": p2_wide, "p4_found": p4_found}
ORACLES: dict[str, str] = {}
