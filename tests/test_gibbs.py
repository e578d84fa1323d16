"""The batched sampler against dense algebra and a plain sampler."""

import numpy as np
import pandas as pd
import pytest


def dense_precision(n, w, lam):
    d = np.zeros((n - 2, n))
    for k in range(n - 2):
        d[k, k : k + 3] = 1, -2, 1
    return np.diag(w) + lam * d.T @ d


@pytest.mark.parametrize("n", [4, 5, 6, 7, 9, 64, 257])
def test_cyclic_reduction_solves_the_pentadiagonal_system(n):
    from tremorlake.operators.gibbs import penta_solve

    rng = np.random.default_rng(n)
    q = [dense_precision(n, rng.uniform(0.1, 2, n), lam) for lam in (0.01, 3.0, 1e4)]
    r = rng.normal(size=(3, n))
    got = penta_solve(*(np.stack([np.append(np.diag(m, k), np.zeros(k)) for m in q]) for k in range(3)), r)
    assert np.abs(got - np.stack([np.linalg.solve(m, b) for m, b in zip(q, r)])).max() < 1e-8


def made(n=60, members=3, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    mu = np.sin(np.arange(n) / 9)
    rows = []
    for k in range(members):
        shift = rng.normal() * 0.3
        for t in range(n):
            if rng.random() >= missing or (t % members) == k:
                rows.append((f"m{k}", 2 * t, float(mu[t] + shift + rng.normal() * 0.1), 0.08 + 0.02 * (k + t % 2)))
    return pd.DataFrame(rows, columns=["component", "t", "dvv", "sigma"])


def plain(m, v, n_iter, burn, seed):
    """One key, all members at all epochs, dense."""
    rng = np.random.default_rng(seed)
    k, n = m.shape
    mu, beta, tau2, s2 = m.mean(0), np.zeros(k), np.var(m.mean(1)) + 1e-12, 1.0
    lam, kept = 1.0 / (np.var(np.diff(mu, 2)) + 1e-12), []
    for it in range(n_iter):
        cov = np.linalg.inv(dense_precision(n, (1 / (s2 * v)).sum(0), lam))
        mu = rng.multivariate_normal(cov @ ((m - beta[:, None]) / (s2 * v)).sum(0), (cov + cov.T) / 2)
        prec = 1 / tau2 + (1 / (s2 * v)).sum(1)
        beta = ((m - mu) / (s2 * v)).sum(1) / prec + rng.normal(size=k) / np.sqrt(prec)
        tau2 = 1 / rng.gamma(2 + k / 2, 1 / (1e-8 + (beta**2).sum() / 2))
        s2 = 1 / rng.gamma(2 + k * n / 2, 1 / (1e-8 + (((m - mu - beta[:, None]) ** 2) / v).sum() / 2))
        lam = rng.gamma(2 + (n - 2) / 2, 1 / (1e-10 + (np.diff(mu, 2) ** 2).sum() / 2))
        if it >= burn:
            kept.append((mu, tau2, s2))
    return [np.array([k[i] for k in kept]) for i in range(3)]


def test_posterior_agrees_with_a_plain_sampler(spark):
    from tremorlake.operators.gibbs import hierarchical_dvv

    pdf = made()
    got = hierarchical_dvv(spark.createDataFrame(pdf.assign(pair_id="a")), ["pair_id"], member="component", n_iter=3000, burn=1000, chains=2).toPandas().sort_values("t")
    m = pdf.pivot(index="component", columns="t", values="dvv").to_numpy()
    v = pdf.pivot(index="component", columns="t", values="sigma").to_numpy() ** 2
    mu, tau2, s2 = plain(m, v, 2500, 500, 1)
    # the common level mixes slowly, so compare shapes, widths and scales
    shape = lambda x: x - x.mean()
    assert np.abs(shape(got.mu_mean.to_numpy()) - shape(mu.mean(0))).max() < 0.02
    assert abs(got.s.iloc[0] / np.sqrt(s2.mean()) - 1) < 0.03
    assert abs(np.log(np.median(got.tau) / np.sqrt(tau2.mean()))) < 1.0
    assert np.allclose(got.method_std, m.std(0, ddof=1)) and np.allclose(got.within_std, got.s * np.sqrt(v.mean(0)))
    assert np.allclose(got.total_std, np.hypot(got.within_std, got.method_std))
    assert (got.mu_lo < got.mu_mean).all() and (got.mu_mean < got.mu_hi).all() and got.t.tolist() == sorted(pdf.t.unique())


def test_effective_number_and_covariance_are_those_of_the_matrix(spark):
    from tremorlake.operators.gibbs import hierarchical_dvv, measurement_covariance

    pdf = made(40, missing=0.3)
    post = hierarchical_dvv(spark.createDataFrame(pdf.assign(pair_id="a")), ["pair_id"], member="component", n_iter=200, burn=100).cache()
    p = post.toPandas().sort_values("t")
    t, sd, length, tau = p.t.to_numpy(), p.total_std.to_numpy(), p.corr_length_days.iloc[0], p.tau.iloc[0]
    c = np.outer(sd, sd) * np.exp(-np.abs(t[:, None] - t) / length) + tau**2
    full = np.ones(len(t)) @ np.linalg.solve(c, np.ones(len(t)))
    assert p.n_eff.iloc[0] == pytest.approx(len(t) * full / (1 / sd**2).sum(), rel=1e-6)
    got = measurement_covariance(post, ["pair_id"], tolerance=1e-9).toPandas()
    at = {v: k for k, v in enumerate(t)}
    assert len(got) == len(set(zip(got.i, got.j)))
    assert max(abs(v - c[at[i], at[j]]) for i, j, v in zip(got.i, got.j, got["cov"])) < 1e-12
    listed = set(zip(got.i, got.j))
    assert all(abs(c[a, b] - tau**2) < 1e-8 for a in range(len(t)) for b in range(a, len(t)) if (t[a], t[b]) not in listed)


def test_correlation_length_of_full_data():
    from tremorlake.operators.gibbs import corr_length

    rng = np.random.default_rng(3)
    x = np.zeros((4, 5000))
    for i in range(1, 5000):
        x[:, i] = np.exp(-1 / 6) * x[:, i - 1] + rng.normal(size=4)
    assert corr_length(x, np.arange(5000.0)) == pytest.approx(6, rel=0.25)
    r = x - x.mean(1, keepdims=True)
    rho = [np.mean((r[:, : 5000 - g] * r[:, g:]).mean(1) / (r**2).mean(1)) for g in range(41)]
    rho = np.clip(rho, 1e-3, 1)
    a = np.stack([np.arange(41.0), np.ones(41)], 1)
    slope = np.linalg.lstsq(a * rho[:, None], np.log(rho) * rho, rcond=None)[0][0]
    assert corr_length(x, np.arange(5000.0)) == pytest.approx(-1 / slope, rel=1e-6)


def test_batching_does_not_change_a_key(spark):
    from tremorlake.operators.gibbs import hierarchical_dvv

    parts = [made(n, k, s).assign(pair_id=f"p{s}") for s, (n, k) in enumerate([(20, 2), (33, 3), (5, 1), (50, 2)])]
    parts.append(made(3, 2, 9).assign(pair_id="short"))
    run = lambda df, b: hierarchical_dvv(spark.createDataFrame(df), ["pair_id"], member="component", n_iter=60, burn=20, buckets=b).toPandas().sort_values(["pair_id", "t"]).reset_index(drop=True)
    whole = run(pd.concat(parts), 1)
    assert set(whole.pair_id) == {"p0", "p1", "p2", "p3"} and not whole.isna().any().any()
    alone = pd.concat([run(p, 3) for p in parts[:4]]).sort_values(["pair_id", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, alone, rtol=1e-6)
