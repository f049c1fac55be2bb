"""Positions, ranks and quantiles of whole tables without gathering them in one task.

Defined results: nulls of an order come first; rows equal in the whole order have positions in any order among
themselves; an empty table gives an empty result; quantiles skip nulls, and a group of nulls only has null quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import cut

BINS = 4096  # of a quantile's histogram


def _ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows sorted over all partitions and written, with their partition and their index in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number's upper bits are the partition, its lower 33 bits count the partition's rows.
    return cut(rows.withColumn("_at", F.monotonically_increasing_id())).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def with_position(df: DataFrame, order: list[str | Column], name: str = "position", start: int = 0) -> DataFrame:
    """`df` with each row's position in an order over the whole table.

    Sorted by ranges; only one row per partition is gathered, to add up how many rows stand before it."""
    rows = _ranged(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return rows.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_row") + start).drop("_part", "_row", "_ahead")


def with_group_index(df: DataFrame, group: str, order: list[str | Column], name: str = "k", start: int = 0) -> DataFrame:
    """`df` with each row's index in its group. A hot group is sorted by many tasks, since the ranges run over group and order."""
    rows = _ranged(df, [group, *order])
    pieces = rows.groupBy("_part", group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    joined = rows.join(pieces, (rows["_part"] == pieces["_p"]) & rows[group].eqNullSafe(pieces["_g"]))
    return joined.withColumn(name, F.col("_ahead") + F.col("_row") - F.col("_first") + start).drop("_part", "_row", "_p", "_g", "_first", "_ahead")


def _cumulated(counts: DataFrame, keys: list[str], by: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column per name of shares): exact quantiles, interpolated between neighbours.

    Three aggregates: range and size of each group, a histogram of BINS bins, and the counts of the distinct values of
    those bins that hold a wanted rank. No task ever holds a group's values."""
    rows = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    known = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    spans = known.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_size"))
    spans = cut(spans)
    width = (F.col("_high") - F.col("_low")) / F.lit(BINS)
    binned = known.join(spans.select(F.col("_g").alias("_h"), "_low", "_high"), F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_bin", F.least(F.lit(BINS - 1), F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_low"), width)), F.lit(0))))
    hist = _cumulated(binned.groupBy("_g", "_bin").agg(F.count("*").alias("_n")), ["_g"], "_bin")
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("at")) for n, p in shares.items()])
    wanted = spans.select("_g", F.explode(ranks).alias("r")).select("_g", "r.name", "r.at", F.explode(F.array(F.floor("r.at"), F.ceil("r.at"))).alias("_rank")).distinct()
    inside = lambda c: (F.col("_rank") >= F.col(f"{c}._before")) & (F.col("_rank") < F.col(f"{c}._before") + F.col(f"{c}._n"))
    w, h = wanted.alias("w"), hist.alias("h")
    held = w.join(h, F.col("w._g").eqNullSafe(F.col("h._g")) & inside("h")).select("w._g", "name", "at", "_rank", F.col("h._bin").alias("_bin"), F.col("h._before").alias("_ahead"))
    bins = held.select("_g", "_bin", "_ahead").distinct().select(F.col("_g").alias("_h"), F.col("_bin").alias("_b"), "_ahead")
    few = binned.select("_g", "_bin", "_v").join(bins, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_bin") == F.col("_b")))
    values = _cumulated(few.groupBy("_g", "_bin", "_ahead", "_v").agg(F.count("*").alias("_n")), ["_g", "_bin", "_ahead"], "_v").withColumn("_before", F.col("_before") + F.col("_ahead"))
    a, v = held.alias("a"), values.alias("v")
    found = a.join(v, F.col("a._g").eqNullSafe(F.col("v._g")) & (F.col("a._bin") == F.col("v._bin")) & inside("v")).select("a._g", "name", "at", "_rank", "_v")
    part = F.col("at") - F.floor("at")
    mixed = found.groupBy("_g", "name", "at").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")).withColumn("q", F.col("_a") + (F.col("_b") - F.col("_a")) * part)
    wide = mixed.groupBy("_g").agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in shares])
    every = rows.select("_g").distinct().alias("e")
    out = every.join(wide.alias("q"), F.col("e._g").eqNullSafe(F.col("q._g")), "left")
    return out.select(F.col("e._g").alias(group), *[F.col(f"q.{n}").alias(n) for n in shares])
