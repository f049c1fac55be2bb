"""Plans that must hold at any size, and the operators behind them against brute force."""

import re

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import tessella.operators.vectors as vectors
from tessella.operators.bootstrap import interval
from tessella.operators.graph import hops_to
from tessella.operators.ordinal import quantiles, with_group_index, with_position

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["k1_knn", "f12_sim_join", "g17_normalise", "l10_weights", "g10_median", "h1_index", "n1_pairs", "l9_expand"])
def test_no_nested_loops_and_no_window_in_one_task(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert not re.search(r"Exchange SinglePartition[^\n]*\n[^\n]*\n?[^\n]*Sort", text) and "windowspecdefinition()" not in text


def test_positions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(a), int(b), "x") for a, b in zip(rng.integers(0, 3, 500), rng.permutation(500))], "g int, o int, position string").repartition(5)
    got = with_position(df, ["o"], "p").toPandas()
    assert (got.o == got.p).all() and set(got.position) == {"x"}
    own = with_group_index(df, "g", ["o"], "k").toPandas().sort_values(["g", "o"])
    assert (own.k == own.groupby("g").cumcount()).all()
    assert with_position(df.limit(0), ["o"]).count() == 0 and with_group_index(df.limit(0), "g", ["o"]).count() == 0


def test_group_index_with_nulls(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g string, o int")
    assert {(r.g, r.o, r.k) for r in with_group_index(df, "g", ["o"]).collect()} == {(None, 1, 0), (None, 2, 1), ("a", 3, 0)}


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"g": rng.choice(["a", "b", None], 700), "v": np.round(rng.normal(0, 50, 700), 1)})
    data.loc[:80, "v"] = 7.0
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(data.g, data.v)] + [("none", None), ("one", 3.0), ("a", None)], "g string, v double")
    got = {r.g: (r.low, r.mid) for r in quantiles(df, "g", "v", {"low": 0.025, "mid": 0.5}).collect()}
    for g in ("a", "b", None):
        own = data.v[data.g.isna() if g is None else data.g == g]
        assert got[g] == pytest.approx(tuple(np.percentile(own, [2.5, 50])))
    assert got["none"] == (None, None) and got["one"] == (3.0, 3.0)
    assert quantiles(df.limit(0), "g", "v", {"mid": 0.5}).count() == 0


def test_nearest_in_one_block_and_in_many(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(m)] + [(60, [0.0] * 5, 1), (61, None, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, sim int")
    u = np.vstack([m / np.linalg.norm(m, axis=1, keepdims=True), np.zeros((2, 5))])
    sims = np.round(u @ u.T, 6)
    want = {(q, v, r + 1) for q in range(62) for r, v in enumerate(sorted((v for v in range(62) if v != q), key=lambda v: (-sims[q, v], v))[:4])}
    edges = {(a, b) for a in range(62) for b in range(62) if a != b and sims[a, b] >= 0.5}
    for block in (4096, 7):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "ONE_BLOCK", block)
        assert {(r.query_id, r.vec_id, r.rank) for r in vectors.nearest(df, df, 4).collect()} == want
        assert {(r.src, r.dst) for r in vectors.similar(df, df, 0.5, 6).collect()} == edges
    assert vectors.nearest(df.limit(0), df, 4).count() == 0


def test_hops_to_goals(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "d"), (None, "a")], "src string, dst string")
    goals = spark.createDataFrame([("a",), ("d",)], "node string")
    assert {r.node: r.hops for r in hops_to(edges, goals).collect()} == {"a": 0, "d": 0, "b": 1, "c": 1}


def test_interval_is_that_of_resampled_rows():
    rng = np.random.default_rng(4)
    x = rng.choice([0.0, 0.25, 1.0], 80)
    values, counts = np.unique(x, return_counts=True)
    mean, low, high = interval(values, counts.astype(float), "s", 4000)
    rows = np.percentile([rng.choice(x, 80).mean() for _ in range(4000)], [2.5, 97.5])
    assert mean == pytest.approx(x.mean()) and (low, high) == pytest.approx(tuple(rows), abs=0.02)


def test_small_classes_are_reported(spark):
    got = {(r.query_class, r.status) for r in entry.queries()["stat1_bootstrap"](spark, DATA).collect()}
    assert {s for _, s in got} <= {"ok", "insufficient_n_for_ci"}


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tessella.session import shared_dir

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda k, v: None), sparkContext=SimpleNamespace(master="yarn", applicationId="x", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(away)
