"""A stated query set against all rows, in blocks.

Up to ONE_BLOCK queries, counted first, are prepared once and sent to the tasks that scan the rows, which are not shuffled.
Beyond that both sides are cut into blocks by hash and every pair of blocks is one task, so that neither the driver nor a
task ever holds more than a block of queries. Only what `reduce` leaves of a pair of blocks is shuffled on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ONE_BLOCK = 4096
QUERIES_A_BLOCK = 4096
ROWS_A_BLOCK = 200_000
#: Keys of a block of `ordered_pairs`.
KEYS_A_BLOCK = 1024


def against(queries: DataFrame, rows: DataFrame, prepare: Callable[[pd.DataFrame], Any], reduce: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str, query_key: str, row_key: str, limits: tuple[int, int, int] | None = None) -> DataFrame:
    """The union of reduce(prepare(queries), rows) over all pairs of blocks. limits: queries sent at once, queries and rows of a block.

    What `prepare` makes may have a method `stream`, which takes all rows of a task, part by part, so that it reduces them over the whole task."""
    one, q_size, r_size = limits or (ONE_BLOCK, QUERIES_A_BLOCK, ROWS_A_BLOCK)
    n = queries.count()
    if n <= one:
        held = queries.toPandas()
        if not len(held):
            return rows.sparkSession.createDataFrame([], schema)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ready = prepare(held)
            if hasattr(ready, "stream"):
                yield from ready.stream(part for part in batches if len(part))
                return
            for part in batches:
                if len(part):
                    yield reduce(ready, part)

        return rows.mapInPandas(scan, schema)

    blocks, parts = -(-n // q_size), max(1, -(-rows.count() // r_size))
    number = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Own names on either side: both may come from one table.
    left = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], number(query_key, blocks).alias("q__x"), every(parts).alias("q__y"))
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns], every(blocks).alias("r__x"), number(row_key, parts).alias("r__y"))
    names = [f.split()[0] for f in schema.split(", ")]

    def both(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        plain = lambda d: d.rename(columns=lambda c: c[2:])
        return reduce(prepare(plain(p)), plain(q))

    return left.groupBy("q__x", "q__y").cogroup(right.groupBy("r__x", "r__y")).applyInPandas(both, schema)


def ordered_pairs(rows: DataFrame, group: str, key: str) -> DataFrame:
    """All pairs a < b of the keys of each group, as often as a join of the rows with themselves gives them; rows without group or key have none.

    A group's sorted keys are cut into blocks, and its pairs of blocks are dealt out evenly, so that neither the number of
    groups nor a crowded one decides how many tasks work. A join would give a group's pairs to one task."""
    known = rows.select(F.col(group).alias("g"), F.col(key).alias("k")).dropna()
    at = F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1
    blocks = known.withColumn("block", F.floor(at / KEYS_A_BLOCK)).groupBy("g", "block").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    low, high = blocks.select("g", F.col("block").alias("i"), F.col("ks").alias("us")), blocks.select("g", F.col("block").alias("j"), F.col("ks").alias("vs"))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    dealt = low.join(high, "g").where("i <= j").select("us", "vs").repartition(tasks)
    # Generated code keeps all it makes of one row before it passes it on. coalesce ends it between the two explodes without
    # moving a row: a block's rows are kept, never the square of a block.
    return dealt.select(F.explode("us").alias("a"), "vs").coalesce(tasks).select("a", F.explode("vs").alias("b")).where("a < b")
