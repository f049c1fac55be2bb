"""Every query with SQL against DuckDB on the smallest data, and the iterative operators on toy graphs."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from tessella.operators.chunking import pack, recursive_split
from tessella.operators.graph import bfs, components

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(entry.queries()[name](spark, DATA), duck, SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_components_of_a_chain_and_an_island(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "src int, dst int")
    got = {r.node: r.component for r in components(edges).collect()}
    assert set(got[i] for i in range(41)) == {0}
    assert got[100] == got[101] == 100


def test_bfs_is_monotone(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "node string")
    near = {r.node: r.hops for r in bfs(edges, starts, 1).collect()}
    far = {r.node: r.hops for r in bfs(edges, starts, 5).collect()}
    assert near == {"a": 0, "b": 1, "c": 1}
    assert far == near | {"d": 2}


def test_splitters():
    text = "one two three. four five six. seven eight nine"
    assert all(len(p) <= 20 for p in recursive_split(text, [". ", " "], 20, 5))
    assert recursive_split("   ", [" "], 20, 5) == []
    assert pack(["a" * 40, "b" * 40, "c" * 400], 20) == [["a" * 40, "b" * 40], ["c" * 400]]
