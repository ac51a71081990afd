"""Operators with a method of their own against plain versions."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import geometry as G
from quire.operators import replies as RP
from quire.operators import retrieval as RT
from quire.operators import series as S
from quire.operators import vectors as V
from quire.plans import ordering


@pytest.mark.parametrize("hot_rows", [20, 1 << 20])
def test_cdf_samples_match_numpy(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(ordering, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(3)
    series = {"a": rng.random(7), "b": np.zeros(3), "hot": rng.random(90) * (rng.random(90) < 0.5), None: rng.random(2)}
    us = [0.0, 1.0, 0.5, -0.2, 1.7, *rng.random(40)]
    weights = [(k, i, float(w)) for k, ws in series.items() for i, w in enumerate(ws)]
    bins = [(k, i, float(i * i) - 3) for k, ws in series.items() for i in range(len(ws) + 1)]
    draws = [(k, s, float(u)) for k in ["a", "b", "hot", "missing"] for s, u in enumerate(us)] + [("a", 99, None), ("a", 100, 0.5), ("a", 100, 0.5)]
    got = G.sample_cdf(spark.createDataFrame(weights, "k string, idx long, w double"), spark.createDataFrame(bins, "k string, idx long, b double"),
                       spark.createDataFrame(draws, "k string, s long, u double"), ["k"]).collect()
    assert Counter((r["k"], r["s"]) for r in got) == Counter((k, s) for k, s, _ in draws if k != "missing")
    for r in got:
        if r["u"] is None:
            assert r["sample"] is None
            continue
        w = series[r["k"]] + 1e-5
        cdf = np.round(np.concatenate(([0], np.cumsum(w / w.sum()))), 12)
        at = int(np.searchsorted(cdf, r["u"], side="right"))
        lo, hi = max(0, at - 1), min(len(w), at)
        width = cdf[hi] - cdf[lo] if cdf[hi] - cdf[lo] >= 1e-5 else 1.0
        b = np.arange(len(w) + 1) ** 2.0 - 3
        want = b[lo] + (r["u"] - cdf[lo]) / width * (b[hi] - b[lo])
        assert abs(r["sample"] - want) < 1e-6
    none = spark.createDataFrame([], "k string, s long, u double")
    assert G.sample_cdf(spark.createDataFrame(weights, "k string, idx long, w double"),
                        spark.createDataFrame(bins, "k string, idx long, b double"), none, ["k"]).count() == 0


def test_cdf_samples_by_rule_equal_tables(spark, monkeypatch):
    rng = np.random.default_rng(5)
    series = {"a": rng.random(7), "z": np.zeros(3), "hot": rng.random(60) * (rng.random(60) < 0.5), None: rng.random(2)}
    rows = [(k, 10 * i + 3, i, float(w)) for k, ws in series.items() for i, w in enumerate(ws)] + [("n", 1, 0, 0.5), ("n", 2, 1, None)]
    weights = spark.createDataFrame(rows, "k string, at long, idx long, w double")
    bins = spark.createDataFrame([(k, i, i * 0.5) for k, n in [*((k, len(x)) for k, x in series.items()), ("n", 2)] for i in range(n + 1)], "k string, idx long, b double")
    draws = spark.createDataFrame([(k, s, float(u)) for k in ["a", "z", "hot", "n", "missing", None] for s, u in enumerate([0.0, 1.0, -0.2, 1.7, *rng.random(20)])]
                                  + [("a", 99, None)], "k string, s long, u double")
    rule = lambda i: i * 0.5
    same = lambda a, b: Counter(map(tuple, a.select("k", "s", F.round("sample", 9)).collect())) == Counter(map(tuple, b.select("k", "s", F.round("sample", 9)).collect()))
    assert same(G.sample_cdf(weights.drop("idx"), rule, draws, ["k"], order=["at"]), G.sample_cdf(weights.drop("at"), bins, draws, ["k"]))
    assert same(G.sample_cdf(weights.drop("idx"), rule, 5, ["k"], order=["at"]), G.sample_cdf(weights.drop("at"), bins, G.even_draws(weights, ["k"], 5), ["k"]))
    usual = G.sample_cdf(weights.drop("idx"), rule, draws, ["k"], order=["at"])
    monkeypatch.setattr(ordering, "HOT_ROWS", 20)  # now "hot" is split
    assert same(usual, G.sample_cdf(weights.drop("idx"), rule, draws, ["k"], order=["at"]))


def test_cdf_samples_move_rows_once(spark):
    weights = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25)], "k string, at long, w double")
    draws = spark.createDataFrame([("a", 0, 0.1)], "k string, s long, u double")
    for d in (5, draws):
        out = G.sample_cdf(weights, lambda i: i * 0.5, d, ["k"], order=["at"])
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_permutations_by_number(spark):
    for k in (1, 3, 5):
        want = list(itertools.permutations(range(k)))
        rows = spark.range(len(want)).select("id", S.unrank(F.col("id"), k).alias("p"))
        rows = rows.withColumn("r", S.rank_of(F.col("p"), k)).orderBy("id").collect()
        assert [tuple(r["p"]) for r in rows] == want and [r["r"] for r in rows] == list(range(len(want)))


def test_pair_table_of_two_sets(spark):
    first = S.ordered_set(spark.createDataFrame([(7,), (3,), (7,), (None,)], "x long"), "x")
    second = S.ordered_set(spark.createDataFrame([(0,), (5,), (2,)], "x long"), "x")
    got = S.pair_table(first, second, lambda a, b: a * 10 + b, allowed=lambda x: x != 0).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(0, 3, 2, 32), (1, 3, 5, 35), (2, 7, 2, 72), (3, 7, 5, 75)]
    assert S.pair_table(first, second.limit(0), lambda a, b: a).count() == 0
    big = (1 << 60) + 3
    i, j = S.pair_from_index(F.lit(big), 1000)
    assert tuple(spark.range(1).select(i, j).first()) == divmod(big, 1000)


def test_histories_of_samples(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 5, "assistant", "yes"), (1, 9, "user", None), (2, 0, "user", "alone")],
                                 "conv_id long, turn long, role string, text string")
    samples = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (3, 0, "no history")], "conv_id long, sample long, text string")
    got = {(r["conv_id"], r["sample"]): [tuple(m) for m in r["messages"]] for r in RP.sampled_histories(conv, samples).collect()}
    base = [("user", "hi"), ("assistant", "yes"), ("user", "")]
    assert got == {(1, 0): [*base, ("assistant", "a")], (1, 1): [*base, ("assistant", "b")], (3, 0): [("assistant", "no history")]}
    deep = spark.range(40).selectExpr("1L conv_id", "id turn", "'user' role", "cast(id as string) text")
    one = RP.sampled_histories(deep, samples.where("conv_id = 1 and sample = 0")).first()["messages"]
    assert [m["content"] for m in one] == [*map(str, range(40)), "a"]


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_documents_equal_plain_scores(spark, monkeypatch, n):
    monkeypatch.setattr(RT, "BLOCK_DOCS", 4)
    monkeypatch.setattr(RT, "HOT_BLOCKS", 3)   # common terms get salts
    monkeypatch.setattr(RT, "SEED_BLOCKS", 2)
    rng = np.random.default_rng(n)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    text = lambda size: " ".join(rng.choice(words, size, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 120)))) for i in range(150)] + [(900, None), (901, ""), (902, "W0 w0, w0!")]
    queries = [(i, text(6)) for i in range(8)] + [(70, ""), (71, None), (72, "unheard of")]
    got = RT.top_documents(spark.createDataFrame(queries, "q long, t string"), "q", "t", spark.createDataFrame(docs, "d long, t string"), "d", "t",
                           n=n, rounding=9).collect()
    tf = {d: Counter((t or "").lower().replace(",", "").replace("!", "").split()) for d, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    want = set()
    for q, t in queries:
        qt = Counter((t or "").split())
        sc = [(-round(sum(m * c[w] * math.log(len(docs) / df[w]) for w, m in qt.items() if c[w]), 9), d) for d, c in tf.items() if qt.keys() & c.keys()]
        want |= {(q, d, r + 1) for r, (_, d) in enumerate(sorted(sc)[:n])}
    assert {(r["q"], r["d"], r["rank"]) for r in got} == want


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_nearest_vectors_equal_plain_search(spark, monkeypatch, metric):
    monkeypatch.setattr(V, "PIVOT_BLOCK", 40)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((9, 16))[rng.integers(0, 9, 700)] * 5 + 0.1 * rng.standard_normal((700, 16))
    x[300:460] = x[300]  # one point holds many rows
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    extra = [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 16), (9004, [None] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows + extra, "id long, v array<double>")
    pairs = []
    got = V.knn_vectors(df, df, "id", "id", "v", 4, metric, exclude_self=True, skipped=pairs).collect()
    d = np.abs(x[:, None, :] - x[None, :, :])
    d = d.max(-1) if metric == "chebyshev" else np.sqrt((d ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = {(r["left_id"], r["rank"]): (r["right_id"], r["dist"]) for r in got}
    assert len(near) == len(got) == 700 * 4
    for i in range(700):
        order = np.lexsort((np.arange(700), np.round(d[i], 9)))[:4]
        for k, j in enumerate(order):
            rid, dist = near[i, k + 1]
            assert abs(dist - d[i, j]) < 1e-9 and abs(d[i, rid] - d[i, j]) < 1e-9
    assert [near[310, k][0] for k in (1, 2, 3, 4)] == [300, 301, 302, 303]
    assert pairs[0][0] < 0.8 * pairs[0][1]  # whole block pairs are left out
    few = V.knn_vectors(df.where("id < 2"), df.where("id between 5 and 6"), "id", "id", "v", 4, metric)
    assert few.count() == 4
    assert V.knn_vectors(df, df.limit(0), "id", "id", "v", 4, metric).count() == 0
    assert V.knn_vectors(df.limit(0), df, "id", "id", "v", 4, metric).count() == 0


def test_occupancy_3d_equals_plain_maximum(spark):
    rng = np.random.default_rng(5)
    shape = (6, 5, 4)
    grid = np.where(rng.random((3, *shape)) < 0.06, rng.random((3, *shape)) * 1.6 - 0.2, 0.0)
    rows = [(s, *map(int, c), float(grid[(s, *c)])) for s in range(3) for c in np.ndindex(*shape) if grid[(s, *c)] != 0]
    rows += [(0, -1, 0, 0, 9.0), (0, 6, 0, 0, 9.0), (1, 0, 0, 0, None), (7, 0, 0, 0, 0.1)]
    df = spark.createDataFrame(rows, "s long, i int, j int, k int, v double")
    got = {r["s"]: r for r in G.occupancy_3d(df, ["s"], ["i", "j", "k"], "v", 0.5, shape, (0, 0, 0), (5, 4, 3)).collect()}
    padded = np.pad(np.clip(grid, 0, 1), ((0, 0), (1, 1), (1, 1), (1, 1)))
    pooled = np.max([padded[:, a:a + 6, b:b + 5, c:c + 4] for a in range(3) for b in range(3) for c in range(3)], axis=0)
    for s in range(3):
        cells = np.argwhere(pooled[s] >= 0.5)
        r = got[s]
        assert r["n_occupied"] == len(cells) and r["occupied_share"] == len(cells) / 120
        assert [r["x_min"], r["y_min"], r["z_min"], r["x_max"], r["y_max"], r["z_max"]] == [*cells.min(0), *cells.max(0)]
    assert set(got) == {0, 1, 2}


def test_centred_and_upright_poses(spark):
    rng = np.random.default_rng(6)
    rows = []
    for f in range(12):
        q = np.linalg.qr(np.eye(3) + 0.3 * rng.standard_normal((3, 3)))[0]
        q = q * np.sign(np.diag(q))
        rows.append((f, f % 2, *map(float, q.ravel()), *map(float, rng.standard_normal(3))))
    rot, shift = [[f"r{i}{j}" for j in range(3)] for i in range(3)], ["t0", "t1", "t2"]
    df = spark.createDataFrame(rows, "f long, g long, " + ", ".join(f"{c} double" for r in rot for c in r) + ", t0 double, t1 double, t2 double")
    names = [f"m{i}{j}" for i in range(3) for j in range(4)]
    centred = {r["f"]: [r[c] for c in names] for r in G.center_poses(df, ["g"], rot, shift).collect()}
    up = {r["f"]: [r[c] for c in names] for r in G.stand_up(df, ["g"], rot, shift).collect()}
    for g in (0, 1):
        p = {r[0]: np.vstack((np.column_stack((np.reshape(r[2:11], (3, 3)), r[11:])), [0, 0, 0, 1])) for r in rows if r[1] == g}
        turned = {f: m @ np.diag([1, -1, -1, 1]) for f, m in p.items()}
        mean = np.mean(list(turned.values()), axis=0)
        z = mean[:3, 2] / np.linalg.norm(mean[:3, 2])
        x = np.cross(z, mean[:3, 1])
        x /= np.linalg.norm(x)
        middle = np.eye(4)
        middle[:3] = np.column_stack((x, np.cross(x, z) * 1.0, z, mean[:3, 3]))
        for f, m in turned.items():
            assert np.allclose((np.linalg.inv(middle) @ m)[:3].ravel(), centred[f], atol=1e-9)
        u = np.sum([m[:3, 1] for m in p.values()], axis=0)
        u /= np.linalg.norm(u)
        new = {f: np.reshape(up[f], (3, 4)) for f in p}
        total = np.sum([m[:, 1] for m in new.values()], axis=0)
        assert np.allclose(total / np.linalg.norm(total), [0, 0, 1], atol=1e-8)
        for a, b in itertools.combinations(p, 2):  # a rotation of all: angles and distances stay
            assert np.allclose(p[a][:3, :3].T @ p[b][:3, :3], new[a][:, :3].T @ new[b][:, :3], atol=1e-8)
            assert np.isclose(np.linalg.norm(p[a][:3, 3] - p[b][:3, 3]), np.linalg.norm(new[a][:, 3] - new[b][:, 3]))


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_ema_equals_plain_recurrence(spark, monkeypatch, block):
    monkeypatch.setattr(S, "EMA_BLOCK", block)
    rng = np.random.default_rng(8)
    series = {1: rng.random(3000), 2: rng.random(7), 3: rng.random(8), None: rng.random(20), 5: np.array([2.0])}
    rows = [(k, i * 3, float(x) if rng.random() < 0.95 or i == 0 else None) for k, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k long, t long, v double").repartition(7)
    got = {(r["k"], r["step"]): r["ema"] for r in S.ema(df, "k", "t", "v", beta=0.9, update_after=10, update_every=3, inv_gamma=2.0).collect()}
    assert len(got) == len(rows)
    for k in series:
        xs, e = [x for kk, _, x in rows if kk == k], None
        for i, x in enumerate(xs):
            past = max(i - 10, 0)
            decay = min(max(1 - (1 + past / 2.0) ** (-2 / 3), 0.0), 0.9)
            if i == 0:
                e = x
            elif i % 3 == 0 and x is not None:
                e = x if i <= 10 or i < 13 else decay * e + (1 - decay) * x
            assert abs(got[k, i] - e) < 1e-9


def test_ols_equals_least_squares(spark):
    from quire.operators import evalmetrics as EM

    rng = np.random.default_rng(12)
    rows = []
    for g in range(3):
        a, x = rng.normal(size=60) * 5 + 100, rng.normal(size=60)
        rows += [(g, float(2 * u - 3 * v + rng.normal() + 7), float(u), float(v)) for u, v in zip(x, a)]
    rows += [(0, None, 1.0, 1.0), (7, 1.0, 2.0, 3.0), (8, 1.0, 2.0, 4.0), (8, 2.0, 3.0, 6.0), (8, 3.0, 5.0, 10.0), (8, 4.0, 4.0, 8.0)]
    df = spark.createDataFrame(rows, "g int, y double, x double, a double")
    got = {r["g"]: r for r in EM.ols_effect(df, "y", "x", ["a"], by=["g"]).collect()}
    for g in range(3):
        d = np.array([r[1:] for r in rows if r[0] == g and r[1] is not None])
        m = np.column_stack((np.ones(len(d)), d[:, 1], d[:, 2]))
        beta, rss = np.linalg.lstsq(m, d[:, 0], rcond=None)[:2]
        err = np.sqrt(rss[0] / (len(d) - 3) * np.linalg.inv(m.T @ m)[1, 1])
        assert np.allclose([got[g]["coef"], got[g]["std_err"], got[g]["intercept"]], [beta[1], err, beta[0]], rtol=1e-7)
    assert got[7]["coef"] is None and got[8]["coef"] is None and got[8]["n"] == 4
    alone = EM.ols_effect(df.where("g < 3"), "y", "x").first()
    assert alone["n"] == 180 and alone["std_err"] > 0


def test_names_that_begin_alike_meet_their_folders_only(spark):
    from quire.operators import archive as AR
    from quire.plans.joins import contains_join

    names = [f"idea_{i}" for i in range(300)] * 2 + ["", None, "a" * 40]
    texts = [f"2024_idea_{i}" for i in range(0, 400, 7)] + ["idea", None, "x" + "a" * 41]
    left, right = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    got = contains_join(left, "t", right, "name")
    want = Counter((t, s) for t in texts if t is not None for s, n in enumerate(names) if n is not None and n in t)
    assert Counter((r["t"], r["seq"]) for r in got.collect()) == want
    many = spark.createDataFrame([(i, "b" * i) for i in range(1, 60)], "seq long, name string")  # more lengths than HEADS
    assert contains_join(spark.createDataFrame([("b" * 30,)], "t string"), "t", many, "name").count() == 30
    first = AR.match_by_name(left.where("t is not null"), "t", right, "name", "seq")
    assert {r["t"]: r["seq"] for r in first.collect()} == {t: min(s for s, n in enumerate(names) if n is not None and n in t) for t in texts if t is not None}
    plain = AR.match_by_name(left, "t", right.where("name <> ''"), "name", "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(seq" in plain  # one idea a name goes into the join


def test_gram_blocks_equal_plain_sums(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 90, i % 3 if i % 4 else None, rng.normal(size=5).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>")
    got = {r["g"]: r["gram_offdiag"] for r in V.gram_offdiag(df, ["g"], "id", "v", block_size=16).collect()}
    for g in (0, 1, 2):
        mine = [(i, np.array(v)) for i, x, v in rows if x == g]
        assert abs(got[g] - np.mean([abs(a @ b) for i, a in mine for j, b in mine if i != j])) < 1e-9
    assert set(got) == {0, 1, 2}


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_pairs_within_a_limit_equal_all_distances(metric):
    rng = np.random.default_rng(4)
    q, b = rng.normal(size=(40, 24)), rng.normal(size=(70, 24))
    b[3] = q[5]
    all_d = V._dist(q, b, metric)
    limit = np.sort(all_d, axis=1)[:, 4]
    limit[7] = np.inf
    i, j, d = V._within(q, b, limit, metric)
    want = np.nonzero(all_d <= limit[:, None])
    assert sorted(zip(i, j)) == sorted(zip(*want)) and np.array_equal(d, all_d[i, j])
