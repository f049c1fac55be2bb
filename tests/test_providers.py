"""Provider columns: defaults, nulls and the cache."""

from pyspark.sql import functions as F

from tessella.operators.providers import hashed_embedding, with_provider


def test_embedding_counts_words(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    sums = [sum(r.v) for r in df.select(hashed_embedding(df.text).alias("v")).collect()]
    assert sums == [3.0, 0.0, 0.0]


def test_cached_values_are_kept(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    cache = df.where("id = 1").select(F.sha2("text", 256).alias("digest"), F.lit(9).alias("value"))
    got = {r.id: r.n for r in with_provider(df, "text", "n", F.length, cache).collect()}
    assert got == {1: 9, 2: 1}
