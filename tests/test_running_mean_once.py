"""The running mean asks for hot keys once."""

from quire.operators import series as S
from quire.plans import ordering


def test_running_mean_counts_hot_keys_once(spark, monkeypatch):
    asked = []
    real = ordering.has_hot
    monkeypatch.setattr(ordering, "has_hot", lambda df, keys: asked.append(keys) or real(df, keys))
    rows = [(k, i, float(i), 2, i % 3) for k in (1, 2, None) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, o int, loss double, n int, c int")
    got = {(r["k"], r["batch_idx"]): (r["loss"], r["acc"]) for r in S.running_mean(df, ["k"], "o", "loss", "n", "c").collect()}
    assert asked == [["k"]]
    assert got == {(k, i): (sum(range(i + 1)) / (i + 1), 100.0 * sum(x % 3 for x in range(i + 1)) / (2 * i + 2)) for k in (1, 2, None) for i in range(10)}
