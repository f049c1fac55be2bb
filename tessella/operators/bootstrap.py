"""Percentile intervals by resampling with replacement.

A resample of n rows only matters by how often it draws each value, and these counts are multinomial. So the rows are
reduced to the frequencies of their values before anything is drawn: no row is copied, and a class costs as many rows as
it has distinct values (metrics are whole ten-thousandths, 10,001 values at most).

Defined results: null values are left out; a class with fewer than `least` values is reported as insufficient_n_for_ci
with null bounds; the draws depend on the seed and the class only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESAMPLES = 1000
LEAST = 5


def interval(values: np.ndarray, counts: np.ndarray, seed: str, resamples: int = RESAMPLES) -> tuple[float, float, float]:
    """(mean, 2.5 and 97.5 per cent of the resampled means)."""
    n = int(counts.sum())
    rng = np.random.default_rng(int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16))
    means = rng.multinomial(n, counts / n, resamples) @ values / n
    low, high = np.percentile(means, [2.5, 97.5])
    return float(values @ counts / n), float(low), float(high)


def bootstrap(df: DataFrame, group: str, metrics: list[str], least: int = LEAST, resamples: int = RESAMPLES, seed: str = "42") -> DataFrame:
    """(group, metric, n_rows, status, mean, low, high) of every class and metric."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        g, m, n = pdf[group].iloc[0], pdf["metric"].iloc[0], int(pdf["n"].sum())
        if n < least:
            return pd.DataFrame({group: [g], "metric": [m], "n_rows": [n], "status": ["insufficient_n_for_ci"], "mean": [None], "low": [None], "high": [None]})
        pdf = pdf.sort_values("value")
        mean, low, high = interval(pdf["value"].to_numpy(float), pdf["n"].to_numpy(float), f"{seed}:{g}:{m}", resamples)
        return pd.DataFrame({group: [g], "metric": [m], "n_rows": [n], "status": ["ok"], "mean": [mean], "low": [low], "high": [high]})

    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    hist = df.select(group, cells.alias("c")).select(group, "c.metric", "c.value").where("value is not null").groupBy(group, "metric", "value").agg(F.count("*").alias("n"))
    return hist.groupBy(group, "metric").applyInPandas(draw, f"`{group}` string, metric string, n_rows bigint, status string, mean double, low double, high double")
