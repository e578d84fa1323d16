"""Substructured least squares against dense algebra."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

EDGE = "site_id string, i long, j long, rel double, sigma double"


def pairs_of(n, reach, share, rng):
    rows = [(i, j) if rng.random() < 0.5 else (j, i) for i in range(n) for j in range(i + 1, min(n, i + reach + 1)) if rng.random() < share]
    return [(i, j, float(rng.normal()), float(rng.uniform(0.5, 2))) for i, j in rows]


def dense(rows):
    """pinv solution of one component or several: values, covariance, weighted residual."""
    ids = sorted({a for r in rows for a in r[:2]})
    at = {a: k for k, a in enumerate(ids)}
    g = np.zeros((len(rows), len(ids)))
    for k, (i, j, *_) in enumerate(rows):
        g[k, at[i]], g[k, at[j]] = 1.0, -1.0
    d, w = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]) ** -2.0
    cov = np.linalg.pinv(g.T @ (w[:, None] * g), rcond=1e-11)
    x = cov @ (g.T @ (w * d))
    return ids, x, cov, np.sqrt(np.mean(w * (g @ x - d) ** 2))


@pytest.mark.parametrize("n, reach, share", [(300, 5, 1.0), (200, 3, 0.4), (150, 2, 0.15), (3, 2, 1.0), (90, 30, 0.5)])
def test_reference_free_series_and_covariance(spark, n, reach, share):
    from tremorlake.operators.uncertainty import all_to_all_covariance, all_to_all_reference

    rng = np.random.default_rng(n)
    made = {s: pairs_of(n, reach, share, rng) for s in ("a", "b")}
    made["a"] += made["a"][:5]  # parallel pairs
    df = spark.createDataFrame([(s, *r) for s, rows in made.items() for r in rows], EDGE).repartition(5)
    got = all_to_all_reference(df, ["site_id"]).toPandas()
    cov = all_to_all_covariance(df, ["site_id"], reach=reach).toPandas()
    for s, rows in made.items():
        ids, x, c, rms = dense(rows)
        mine = got[got.site_id == s].sort_values("i")
        assert mine.i.tolist() == ids and np.abs(mine.dvv - x).max() < 1e-9
        assert np.abs(mine.sigma - np.sqrt(np.diag(c))).max() < 1e-9
        assert np.abs(mine.residual_rms - rms).max() < 1e-9 and set(mine.n_pairs) == {len(rows)}
        at, comp = {a: k for k, a in enumerate(ids)}, dict(zip(mine.i, mine.component))
        part = cov[cov.site_id == s]
        want = {(a, b) for a in ids for b in ids if a <= b <= a + reach and comp[a] == comp[b]}
        assert set(zip(part.i, part.j)) == want and len(part) == len(want)
        assert max(abs(v - c[at[i], at[j]]) for i, j, v in zip(part.i, part.j, part["cov"])) < 1e-9


def test_pairs_that_say_nothing(spark):
    from tremorlake.operators.uncertainty import all_to_all_reference

    rows = [("a", 0, 1, 1.0, 1.0), ("a", 1, 1, 5.0, 1.0), ("a", 1, 2, None, 1.0), ("a", 2, 3, 1.0, 0.0), (None, 7, 8, 2.0, 1.0)]
    got = {(r["site_id"], r["i"]): round(r["dvv"], 12) for r in all_to_all_reference(spark.createDataFrame(rows, EDGE), ["site_id"]).collect()}
    assert got == {("a", 0): 0.5, ("a", 1): -0.5, (None, 7): 1.0, (None, 8): -1.0}
    assert all_to_all_reference(spark.createDataFrame([], EDGE), ["site_id"]).count() == 0


@pytest.mark.parametrize("n", [2, 3, 40, 700])
def test_smoothed_chain_equals_least_squares(spark, n):
    from tremorlake.operators.chain import chain_nodes

    rng = np.random.default_rng(n)
    rows = [(i, j, float(rng.random() * (rng.random() < 0.8)), float(rng.normal())) for j in range(n) for i in range(j + 1, min(n, j + 11))]
    if n == 40:
        rows = [(i, j, 0.0 if 18 <= i <= 29 else w, m) for i, j, w, m in rows]  # a stretch without coherence
    a = np.zeros((len(rows) + max(n - 2, 0) + 1, n))
    b = np.zeros(len(a))
    for k, (i, j, w, m) in enumerate(rows):
        a[k, i], a[k, j], b[k] = np.sqrt(w), -np.sqrt(w), np.sqrt(w) * m
    for k in range(n - 2):
        a[len(rows) + k, k : k + 3] = (5.0, -10.0, 5.0)
    a[-1] = 1.0
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    e = spark.createDataFrame([("p", *r) for r in rows], "pair_id string, i long, j long, w double, m double")
    e = e.select("pair_id", "i", "j", "w", (F.col("w") * F.col("m")).alias("wd"), (F.col("w") * F.col("m") ** 2).alias("wdd"), F.lit(1).cast("long").alias("m"))
    got = chain_nodes(e, ["pair_id"], reach=10, smooth=5.0).toPandas().sort_values("i")
    assert got.i.tolist() == list(range(n))
    assert np.abs((got.x - got.x.mean()) - (x - x.mean())).max() < 1e-9


def test_blocks_stay_small(spark):
    """The separators are a share of the epochs, whatever the length."""
    from tremorlake.operators import chain

    e = pd.DataFrame({"i": np.arange(128), "j": np.arange(1, 129), "w": 1.0, "wd": 0.0, "wdd": 0.0, "m": 1})
    part = chain._Block(e, 0, 128, 2, 0.0).schur(4)
    assert part["s"].size == 16 and np.abs(part["s"].reshape(4, 4).sum(1)).max() < 1e-9


def test_depth_factor_reproduces_the_dense_covariance(spark):
    from tremorlake.operators.uncertainty import depth_covariance, gain_matrix

    rng = np.random.default_rng(4)
    z, bands = np.round(np.linspace(0.02, 0.6, 25), 3), ["b0", "b1", "b2"]
    g = {p: rng.normal(size=(3, 25)) for p in ("p", "q")}
    a = rng.normal(size=(3, 3))
    cd = 1e-6 * (a @ a.T + np.eye(3))
    kernel = spark.createDataFrame([(p, b, float(d), float(g[p][i, k])) for p in g for i, b in enumerate(bands) for k, d in enumerate(z)], "profile string, band string, depth_km double, g double")
    cov = spark.createDataFrame([(bands[i], bands[j], float(cd[i, j])) for i in range(3) for j in range(3)], "band_i string, band_j string, cov double")
    gain = gain_matrix(kernel, cov)
    got = depth_covariance(gain).toPandas()
    prior = 25e-6 * np.exp(-0.5 * ((z[:, None] - z) / 0.1) ** 2)
    for p in g:
        post = prior - prior @ g[p].T @ np.linalg.solve(g[p] @ prior @ g[p].T + cd, g[p] @ prior)
        mine = got[got.profile == p]
        assert len(mine) == 25 * 26 // 2
        at = {float(d): k for k, d in enumerate(z)}
        assert max(abs(v - post[at[i], at[j]]) for i, j, v in zip(mine.depth_i, mine.depth_j, mine["cov"])) < 1e-14
        std = gain.where(F.col("profile") == p).select("depth_km", "std").distinct().toPandas()
        assert max(abs(s**2 - post[at[d], at[d]]) for d, s in zip(std.depth_km, std["std"])) < 1e-14
