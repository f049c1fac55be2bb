"""Nearest vectors and similarity edges, in blocks: dot products by matrix, never row against row in a join.

Every pair of blocks (see `blocks`) is one matrix product, and only its best (or its edges) leave the task.

Vectors have the columns vec_id and embedding. Defined results: a vector of norm 0 and a null vector have similarity 0 to
all; a vector is no neighbour of its own id; ties go to the smaller vec_id; empty tables give an empty result;
vectors of unequal length raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.blocks import against
from tessella.session import keep

BLOCK = 4096
ONE_BLOCK = 4096


def matrix(column: pd.Series) -> np.ndarray:
    """Unit vectors as rows; null vectors and those of norm 0 are zero."""
    size = max((len(v) for v in column if v is not None), default=0)
    m = np.array([v if v is not None else np.zeros(size) for v in column], np.float64).reshape(len(column), size)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows; a block of null vectors only has no width and no similarity."""
    return a @ b.T if a.shape[1] and b.shape[1] else np.zeros((len(a), len(b)))


def _best(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int, digits: int) -> pd.DataFrame:
    """The k best of each row: greatest similarity, then smallest id."""
    sims = np.where(ids[:, None] == others[None, :], -np.inf, np.round(sims, digits))
    k = min(k, len(others))
    # Rounded first, so that ties are exact; all candidates at the k-th value are kept for the order by id.
    floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
    q, v = np.nonzero((sims >= floor) & (sims > -np.inf))
    rows = pd.DataFrame({"query_id": ids[q], "vec_id": others[v], "sim": sims[q, v]})
    return rows.sort_values(["query_id", "sim", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _edges(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, least: float, digits: int) -> pd.DataFrame:
    sims = np.where(ids[:, None] == others[None, :], -np.inf, np.round(sims, digits))
    q, v = np.nonzero(sims >= least)
    return pd.DataFrame({"query_id": ids[q], "vec_id": others[v], "sim": sims[q, v]})


def _pairs(queries: DataFrame, vectors: DataFrame, reduce) -> DataFrame:
    """reduce(query ids, vector ids, similarities) of every pair of blocks."""
    prepare = lambda p: (p["vec_id"].to_numpy(), matrix(p["embedding"]))
    meet = lambda q, p: reduce(q[0], p["vec_id"].to_numpy(), _dots(q[1], matrix(p["embedding"])))
    columns = ["vec_id", "embedding"]
    return against(queries.select(*columns), vectors.select(*columns), prepare, meet, SCHEMA, "vec_id", "vec_id", (ONE_BLOCK, BLOCK, BLOCK))


SCHEMA = "query_id bigint, vec_id bigint, sim double"


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, sim, rank): the k most similar vectors of every query; only k rows per query and block are shuffled."""
    found = _pairs(queries, vectors, lambda i, j, s: _best(i, j, s, k, digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def similar(left: DataFrame, right: DataFrame, least: float, digits: int = 4) -> DataFrame:
    """(src, dst, weight): all pairs of the two tables whose cosine, rounded, is at least `least`."""
    found = _pairs(left, right, lambda i, j, s: _edges(i, j, s, least, digits))
    return found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("sim").alias("weight"))


def mmr(queries: DataFrame, vectors: DataFrame, k: int = 5, fetch: int = 20, trade: float = 0.7) -> DataFrame:
    """(query_id, pos, vec_id): maximal marginal relevance among the fetch nearest, by trade * similarity - (1 - trade) * greatest similarity to those chosen."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        v = matrix(pdf["embedding"])
        sim, near, left, out = pdf["sim"].to_numpy(), np.zeros(len(v)), list(range(len(v))), []
        while left and len(out) < k:
            best = max(left, key=lambda i: (trade * sim[i] - (1 - trade) * (near[i] if out else 0.0), -i))
            left.remove(best)
            out.append(best)
            near = np.maximum(near, v @ v[best]) if len(out) > 1 else v @ v[best]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "pos": range(len(out)), "vec_id": pdf["vec_id"].to_numpy()[out]})

    found = keep(nearest(queries, vectors, fetch)).join(vectors.select("vec_id", "embedding"), "vec_id")
    return found.groupBy("query_id").applyInPandas(choose, "query_id bigint, pos bigint, vec_id bigint")
