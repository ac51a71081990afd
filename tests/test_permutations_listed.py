"""Permutations from the list and from the digits of their numbers."""

import itertools

from pyspark.sql import functions as F

from quire.operators import series as S


def test_listed_permutations_ranks_and_compositions(spark):
    ranks = spark.createDataFrame([(r,) for r in [*range(130), -1, -7, None]], "r long")
    for k in (1, 3, 5):
        got = ranks.select("r", S.unrank(F.col("r"), k).alias("a"), S._unrank_by_digits(F.col("r"), k).alias("b"))
        got = got.select("*", S.rank_of(F.col("a"), k).alias("x"), S._rank_by_parts(F.col("b"), k).alias("y")).collect()
        every = list(itertools.permutations(range(k)))
        assert all(r["a"] == r["b"] and r["x"] == r["y"] for r in got)
        assert all(tuple(r["a"]) == every[r["r"] % len(every)] for r in got if r["r"] is not None and r["r"] >= 0)
    idx = spark.range(0, 14400, 37).select("id")
    a, b, c = S.permutation_example(F.col("id"), 5)
    assert all(r["c"] == [r["a"][i] for i in r["b"]] for r in idx.select(a.alias("a"), b.alias("b"), c.alias("c")).collect())
    assert "lambda" not in idx.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().split("CASE WHEN")[0]
