"""Exact nearest vectors: block pairs meet without a shuffle, in shares of bounded size."""

import numpy as np
import pytest

from quire.operators import vectors as V


def _plain(left, right, k, metric, self_pairs):
    """k nearest per left id (rows of one id together), ties by right id."""
    out = {}
    for lid, a in left:
        d = np.array([np.abs(a - b).max() if metric == "chebyshev" else np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) for _, b in right])
        out.setdefault(lid, []).extend((x, rid) for x, (rid, _) in zip(d, right) if self_pairs or rid != lid)
    return {(lid, n + 1): pair for lid, found in out.items() for n, pair in enumerate(sorted(found)[:k])}


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_block_pairs_meet_in_shares_without_a_shuffle(spark, monkeypatch, metric):
    monkeypatch.setattr(V, "PIVOT_BLOCK", 20)
    rng = np.random.default_rng(7)
    x = np.round(rng.standard_normal((260, 12)), 1)  # many equal distances
    x[100:130] = x[100]
    rows = [(f"v{i % 250:03d}", x[i]) for i in range(260)]  # ten ids come twice
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in rows], "id string, v array<double>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        for share in (260 * 12 * 8, 2000):
            monkeypatch.setattr(V, "HELD_BYTES", share, raising=False)
            out = V.knn_vectors(df, df, "id", "id", "v", 3, metric, exclude_self=True)
            got = {(r["left_id"], r["rank"]): (r["dist"], r["right_id"]) for r in out.collect()}
            plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count(" Exchange ") == 1 and "Exchange hashpartitioning(left_id" in plan  # the results only
            want = _plain(rows, rows, 3, metric, False)
            assert got.keys() == want.keys()
            assert all(got[at][1] == want[at][1] and abs(got[at][0] - want[at][0]) < 1e-12 for at in want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
@pytest.mark.parametrize("scale, away", [(1.0, 0.0), (1e-3, 1e6), (1e-25, 0.0), (1e20, 0.0), (1.0, 1e12)])
def test_no_pair_within_the_limit_is_left_out(monkeypatch, metric, scale, away):
    monkeypatch.setattr(V, "NEAR_PAIRS", 50)
    rng = np.random.default_rng(3)
    a, b = (away + scale * rng.standard_normal((n, 20)) * np.array([1.0, 30.0] * 10) for n in (90, 70))
    b[60:] = a[:10]
    d = np.array([V._pair_dist(np.repeat(r[None], len(b), 0), b, metric) for r in a])
    for limit in (np.sort(d, axis=1)[:, 5], np.zeros(90), np.full(90, np.inf), d.max(axis=1), d[:, 3]):
        pairs = [*zip(*V._within(a, b, limit, metric))]
        want = {(i, j): d[i, j] for i, j in zip(*np.nonzero(d <= limit[:, None]))}
        assert len(pairs) == len(want) and {(i, j): x for i, j, x in pairs} == want


def test_kl_of_samples_in_shares_shuffles_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "PIVOT_BLOCK", 20)
    monkeypatch.setattr(V, "HELD_BYTES", 4000, raising=False)
    rng = np.random.default_rng(11)
    p, q = rng.standard_normal((150, 10)), rng.standard_normal((170, 10)) * 1.3
    frames = [spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>") for x in (p, q)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        out = V.kl_knn_vectors(*frames, "id", "id", "v", 10, k=4)
        got = out.collect()[0]["kl"]
        plan = out._jdf.queryExecution().executedPlan().toString()  # the final and the initial one
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("CartesianProduct") == 4
    assert not [line for line in plan.splitlines() if "Exchange" in line and "pivot" in line]
    apart = lambda a, b: np.sort(np.abs(a[:, None] - b[None]).max(-1), axis=1)
    rho, nu = apart(p, p)[:, 4], apart(p, q)[:, 3]
    assert abs(got - (np.log(170 / 149) + 10 * (np.log(nu).mean() - np.log(rho).mean())) / np.log(2)) < 1e-9


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_few_pairs_are_left_without_structure(metric):
    rng = np.random.default_rng(13)
    a, b = rng.standard_normal((300, 64)), rng.standard_normal((400, 64))
    d = V._dist(a, b, metric)
    limit = np.sort(d, axis=1)[:, 4]
    left = sum(len(i) for i, _ in V._near(a, b, limit, metric))
    assert (d <= limit[:, None]).sum() == 1500 <= left < 4500  # of 120,000
