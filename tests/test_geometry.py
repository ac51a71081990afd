"""Geometry operators against small numpy statements of the same rules."""

import numpy as np

from quire.operators import geometry as GE


def np_sample_pdf(bins, weights, n):
    weights = weights + 1e-5
    pdf = weights / weights.sum()
    cdf = np.concatenate([[0.0], np.cumsum(pdf)])
    u = np.linspace(0.0, 1.0, n)
    inds = np.searchsorted(cdf, u, side="right")
    below = np.maximum(inds - 1, 0)
    above = np.minimum(len(cdf) - 1, inds)
    denom = cdf[above] - cdf[below]
    denom = np.where(denom < 1e-5, 1.0, denom)
    t = (u - cdf[below]) / denom
    return bins[below] + t * (bins[above] - bins[below])


def test_sample_cdf_matches_numpy(spark):
    rng = np.random.default_rng(11)
    w_rows, b_rows, exp = [], [], {}
    for key in range(5):
        n = int(rng.integers(2, 7))
        w = rng.integers(0, 9, size=n).astype(float)
        b = np.sort(rng.random(n + 1)) * 10
        w_rows += [(key, i, float(x)) for i, x in enumerate(w)]
        b_rows += [(key, i, float(x)) for i, x in enumerate(b)]
        exp[key] = np_sample_pdf(b, w, 6)
    wdf = spark.createDataFrame(w_rows, "k int, i int, w double")
    bdf = spark.createDataFrame(b_rows, "k int, i int, b double")
    got = GE.sample_cdf(wdf, bdf, GE.even_draws(wdf, ["k"], 6), ["k"], "i").collect()
    for r in got:
        assert abs(r["sample"] - exp[r["k"]][r["s"]]) < 1e-9
    assert len(got) == 5 * 6


def test_total_variation_and_occupancy_match_numpy(spark):
    rng = np.random.default_rng(2)
    imgs = rng.integers(0, 50, size=(3, 6, 5)).astype(float)
    imgs[imgs < 10] = 0.0  # absent cells
    rows = [(b, r, c, float(imgs[b, r, c])) for b in range(3) for r in range(6) for c in range(5) if imgs[b, r, c] != 0]
    df = spark.createDataFrame(rows, "img int, r int, c int, v double")
    tv = GE.total_variation(df, "img", "r", "c", "v", 6, 5).collect()[0]["tv"]
    h_tv = ((imgs[:, 1:, :] - imgs[:, :-1, :]) ** 2).sum()
    w_tv = ((imgs[:, :, 1:] - imgs[:, :, :-1]) ** 2).sum()
    exp = 2 * (h_tv / ((6 - 1) * 5) + w_tv / (6 * (5 - 1))) / 3
    assert abs(tv - exp) < 1e-9
    occ = {r["img"]: r for r in GE.occupancy(df, "img", "r", "c", "v", 40.0, 6, 5).collect()}
    for b in range(3):
        pad = np.pad(imgs[b], 1, constant_values=-np.inf)
        pooled = np.max([pad[1 + dr:7 + dr, 1 + dc:6 + dc] for dr in (-1, 0, 1) for dc in (-1, 0, 1)], axis=0)
        mask = pooled >= 40
        rr, cc = np.nonzero(mask)
        assert occ[b]["r_min"] == rr.min() and occ[b]["c_max"] == cc.max()
        assert abs(occ[b]["occupied_share"] - mask.mean()) < 1e-12


def test_mean_pose_matches_numpy(spark):
    rng = np.random.default_rng(4)
    poses = []
    for _ in range(7):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        poses.append(np.concatenate([q, rng.normal(size=(3, 1))], 1))
    poses = np.array(poses)
    center = poses[:, :, 3].mean(0)
    z = poses[:, :, 2].mean(0)
    z = z / np.linalg.norm(z)
    y_ = poses[:, :, 1].mean(0)
    x = np.cross(z, y_)
    x = x / np.linalg.norm(x)
    y = np.cross(x, z)
    rot = [[f"m{r}{c}" for c in range(3)] for r in range(3)]
    rows = [(1, *[float(p[r, c]) for r in range(3) for c in range(3)], *map(float, p[:, 3])) for p in poses]
    cols = "g int, " + ", ".join(f"m{r}{c} double" for r in range(3) for c in range(3)) + ", tx double, ty double, tz double"
    out = GE.mean_pose(spark.createDataFrame(rows, cols), ["g"], rot, ["tx", "ty", "tz"]).collect()[0]
    assert np.allclose([out["cx"], out["cy"], out["cz"]], center)
    assert np.allclose([out[f"x{i}"] for i in range(3)], x)
    assert np.allclose([out[f"y{i}"] for i in range(3)], y)
    assert np.allclose([out[f"z{i}"] for i in range(3)], z)


def test_mean_pose_of_a_single_identity(spark):
    rot = [[f"m{r}{c}" for c in range(3)] for r in range(3)]
    row = (1, *[float(r == c) for r in range(3) for c in range(3)], 1.0, 2.0, 3.0)
    cols = "g int, " + ", ".join(f"m{r}{c} double" for r in range(3) for c in range(3)) + ", tx double, ty double, tz double"
    out = GE.mean_pose(spark.createDataFrame([row], cols), ["g"], rot, ["tx", "ty", "tz"]).collect()[0]
    assert [out[f"x{i}"] for i in range(3)] == [-1.0, 0.0, 0.0]  # the x axis points to z x y'
    assert [out[f"y{i}"] for i in range(3)] == [0.0, 1.0, 0.0]
    assert [out[f"z{i}"] for i in range(3)] == [0.0, 0.0, 1.0]


def test_rays_in_box_matches_numpy(spark):
    rng = np.random.default_rng(9)
    o = rng.normal(scale=2, size=(200, 3))
    d = rng.normal(size=(200, 3))
    d[::17, 1] = 0.0
    rows = [(i, *map(float, o[i]), *map(float, d[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "ray int, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r["ray"] for r in GE.rays_in_box(df, (-1, -1, -1), (1, 1, 1)).collect()}
    vec = np.where(d == 0, 1e-6, d)
    ra, rb = (1 - o) / vec, (-1 - o) / vec
    keep = np.maximum(ra, rb).min(-1) > np.minimum(ra, rb).max(-1)
    assert got == set(np.nonzero(keep)[0].tolist())
