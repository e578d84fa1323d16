"""Closed forms and small brute-force checks of the numeric kernels."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import kernels
from tremorlake.functions.special import erf_udf, exp1_array
from tremorlake.operators import forcing, regress, uncertainty, waveform

KEY = ["site_id"]


def test_exp1():
    np.testing.assert_allclose(exp1_array(np.array([0.1, 0.5, 1.0, 2.0, 10.0])), [1.8229239584, 0.5597735948, 0.2193839344, 0.0489005107, 4.156968930e-6], rtol=1e-9)


def test_erf(spark):
    out = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.3, 2.0)], "x double").select("x", erf_udf()("x").alias("e")).toPandas()
    np.testing.assert_allclose(out["e"], [math.erf(x) for x in out["x"]])


def daily(spark, n, fn):
    t = np.arange(n)
    return spark.createDataFrame(pd.DataFrame({"site_id": "s", "day_no": t + 10_000, "value": fn(t)}))


def test_pressure_convolution_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.exponential(0.01, 200)
    out = forcing.pressure_convolve(daily(spark, 200, lambda t: p), KEY).toPandas().sort_values("day_no")["pressure"].to_numpy()
    load = 9810.0 * (p - p.mean())
    ku = 0.6 * 1.3 / (3 * 0.7)
    kern = [ku * math.erf(a) + math.erfc(a) for a in (100.0 / math.sqrt(0.04 * 86400 * max(k, 1)) for k in range(200))]
    want = [0.0] + [sum(load[i] * kern[n - i] for i in range(n + 1)) for n in range(1, 200)]
    np.testing.assert_allclose(out, want, atol=1e-8)


def test_diffusion_damps_and_delays(spark):
    n, period = 3650, 365.0
    grid = daily(spark, n, lambda t: np.sin(2 * np.pi * t / period))
    out = forcing.thermo_diffuse(grid, KEY, depth_m=3.0, diffusivity_m2_s=1e-6).toPandas().sort_values("day_no")["t_depth"].to_numpy()
    delta = math.sqrt(1e-6 * period * 86400 / math.pi)
    want = math.exp(-3 / delta) * np.sin(2 * np.pi * np.arange(n) / period - 3 / delta)
    np.testing.assert_allclose(out, want, atol=1e-6)


def test_healing_signs(spark):
    ts = pd.to_datetime(["2001-01-01", "2001-01-05", "2001-01-06", "2002-01-05"])
    ep = spark.createDataFrame(pd.DataFrame({"site_id": "s", "ts": ts}))
    ev = spark.createDataFrame(pd.DataFrame({"site_id": ["s"], "event_id": [1], "ts": [ts[1]]}))
    h = forcing.healing(ep, ev, KEY).toPandas().sort_values("ts")["healing"].to_numpy()
    assert h[0] == 0 and h[1] == 1 and h[2] < h[3] < 0


def test_reservoir_delta_decays_to_inverse_e(spark):
    pdf = pd.DataFrame({"site_id": "s", "ts": pd.date_range("2000-01-01", periods=400), "precipitation": [1.0] + [0.0] * 399})
    r = forcing.reservoir(spark.createDataFrame(pdf), KEY, porosity=1.0).toPandas().sort_values("ts")["reservoir"].to_numpy()
    assert abs(r[180] - math.exp(-1)) < 1e-12


def test_box_solution_matches_scan():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.normal(size=(20, 3))
        n, b = a.T @ a, a.T @ rng.normal(size=20)
        lo, hi = np.array([-np.inf, -np.inf, -0.1]), np.array([np.inf, 0.0, 0.1])
        x, _ = regress._box_solution(n, b, lo, hi)
        assert (x <= hi + 1e-9).all() and (x >= lo - 1e-9).all()
        g = n @ x - b
        free = (x > lo + 1e-9) & (x < hi - 1e-9)
        assert np.abs(g[free]).max(initial=0) < 1e-8 and (g[x >= hi - 1e-9] <= 1e-8).all() and (g[x <= lo + 1e-9] >= -1e-8).all()


def parkfield(spark, seed=17, noise=1.5e-4):
    rng = np.random.default_rng(seed)
    n = 3650
    doy = np.arange(n) % 365
    p = np.where(doy > 300, rng.lognormal(-3, 1.5, n) * 0.01, 0.0)
    temp = 15 + 8 * np.sin(2 * np.pi * np.arange(n) / 365.25 - 0.5) + rng.normal(0, 0.3, n)
    level = np.zeros(n)
    for i in range(n):
        level[i] = (level[i - 1] * math.exp(-1 / 180) if i else 0) + p[i] / 0.05
    lagged = np.concatenate([np.zeros(50), temp[:-50] - temp.mean()])
    dvv = -3e-3 * (level - level.mean()) + 8e-5 * lagged + rng.normal(0, noise, n)
    return spark.createDataFrame(pd.DataFrame({"site_id": "s", "ts": pd.date_range("2005-01-01", periods=n), "dvv": dvv, "dvv_err": 1.5e-4, "precipitation": p, "temperature": temp}))


def test_truth_recovery_and_lag_scan(spark):
    rows = parkfield(spark)
    x, names, units = regress.build_design(rows, KEY)
    fit = regress.wls_fit(x, KEY, "dvv", names, sigma="dvv_err", bounds=regress.PHYSICAL_BOUNDS)
    coef = regress.coef_summary(fit, KEY, names, units)
    truth = spark.createDataFrame([("s", "p1_dGWL", -3e-3), ("s", "p2_T", 8e-5)], "site_id string, param string, truth double")
    assert regress.truth_recovery_check(coef, truth, KEY).where("not ok").count() == 0
    stats = regress.fit_stats(regress.with_residuals(x, fit, KEY, "dvv", names, "dvv_err"), KEY, 3, "dvv_err").first()
    assert 0.7 < stats["chi2_red"] < 1.4
    best, _ = regress.shift_scan(rows, KEY, shifts_days=range(0, 101, 5))
    assert best.first()["shift_days"] == 50.0


def test_a_sigma_of_zero_gives_no_fit(spark):
    rows = spark.createDataFrame([("s", 1.0, 0.0), ("s", 2.0, 1.0)], "site_id string, d double, e double")
    (row,) = regress.wls_fit(rows, KEY, "d", ["a0"], sigma="e").collect()
    assert row["coef"] is None and row["cov"] is None and row["rank"] is None


def test_effective_n_against_dense(spark):
    rng = np.random.default_rng(4)
    day = np.cumsum(rng.integers(1, 5, 60))
    s = rng.uniform(0.5, 2, 60)
    pdf = pd.DataFrame({"site_id": "s", "ts": pd.Timestamp("2000-01-01") + pd.to_timedelta(day, unit="D"), "e": s})
    got = uncertainty.effective_n(spark.createDataFrame(pdf), KEY, sigma="e", corr_length_days=6.0, common_mode=0.3).first()["n_eff"]
    c = np.outer(s, s) * np.exp(-np.abs(day[:, None] - day) / 6.0) + 0.09
    # the diagonal comparison uses the marginal variances of the independent part
    want = 60 * np.linalg.solve(c, np.ones(60)).sum() / (1 / s**2).sum()
    assert abs(got - want) < 1e-8


def test_all_to_all_against_pinv(spark):
    rng = np.random.default_rng(6)
    n = 40
    e = [(i, j, rng.normal(), 0.1 + rng.random()) for i in range(n) for j in range(i + 1, min(n, i + 6)) if not (i < 20 <= j)]
    pdf = pd.DataFrame(e, columns=["i", "j", "rel", "sigma"]).assign(site_id="s")
    out = uncertainty.all_to_all_reference(spark.createDataFrame(pdf), KEY).toPandas().sort_values("i")["dvv"].to_numpy()
    g = np.zeros((len(e), n))
    g[np.arange(len(e)), pdf["i"]], g[np.arange(len(e)), pdf["j"]] = 1, -1
    w = 1 / pdf["sigma"].to_numpy() ** 2
    m = np.linalg.pinv(g.T @ (w[:, None] * g)) @ (g.T @ (w * pdf["rel"]))
    np.testing.assert_allclose(out, m - m.mean(), atol=1e-8)


def test_gibbs_recovers_truth(spark):
    rng = np.random.default_rng(8)
    t = np.arange(60)
    truth = 1e-3 * np.sin(t / 9)
    pdf = pd.concat([pd.DataFrame({"pair_id": "p", "m": k, "t": t, "dvv": truth + b + rng.normal(0, 1e-4, 60), "sigma": 1e-4}) for k, b in enumerate((-2e-4, 0.0, 2e-4, 1e-4))])
    out = uncertainty.hierarchical_dvv(spark.createDataFrame(pdf), ["pair_id"], member="m", n_iter=400, burn=150).toPandas().sort_values("t")
    err = out["mu_mean"].to_numpy() - truth
    assert np.std(err) < 1e-4 and (out["mu_lo"] <= out["mu_mean"]).all() and (out["total_std"] > 0).all()


def test_depth_profile_against_formula(spark):
    rng = np.random.default_rng(9)
    z, nb = np.arange(1, 21) * 0.02, 3
    g = rng.random((nb, 20)) * 0.02
    k = spark.createDataFrame(pd.DataFrame([("p", f"b{i}", z[j], g[i, j]) for i in range(nb) for j in range(20)], columns=["profile", "band", "depth_km", "g"]))
    cov = spark.createDataFrame(pd.DataFrame([(f"b{i}", f"b{i}", 1e-8) for i in range(nb)], columns=["band_i", "band_j", "cov"]))
    d = np.array([1e-3, -5e-4, 2e-4])
    obs = spark.createDataFrame(pd.DataFrame({"epoch": 1, "profile": "p", "band": [f"b{i}" for i in range(nb)], "dvv": d}))
    out = uncertainty.depth_profile(uncertainty.gain_matrix(k, cov), obs, ["epoch"]).toPandas().sort_values("depth_km")["mean"].to_numpy()
    cm = 25e-6 * np.exp(-0.5 * ((z[:, None] - z) / 0.1) ** 2)
    want = cm @ g.T @ np.linalg.solve(g @ cm @ g.T + 1e-8 * np.eye(nb), d)
    np.testing.assert_allclose(out, want, rtol=1e-6, atol=1e-12)


# --- waveforms -----------------------------------------------------------------------------

FS, T0, N = 20.0, -50.0, 2001
BAND, WIN = (0.4, 1.0), (8.0, 35.0)


def coda(seed=1):
    rng = np.random.default_rng(seed)
    t = T0 + np.arange(N) / FS
    return t, kernels.bandpass(rng.normal(size=N), FS, (0.1, 3.0)) * np.exp(-np.abs(t) / 25)


def shifted(t, x, dvv):
    """Arrivals of the current waveform move to t / (1 + dv/v)."""
    return np.interp(t * (1 + dvv), t, x)


@pytest.mark.parametrize("name,tol", [("stretching (TS)", 0.05), ("WTS", 0.1), ("DTW", 0.35), ("MWCS", 0.35), ("WCC", 0.5), ("WCS", 0.35), ("WTDTW", 0.4)])
@pytest.mark.parametrize("dvv", [4e-3, -4e-3])
def test_sign_convention(name, tol, dvv):
    t, ref = coda()
    got, _ = kernels.ESTIMATORS[name](shifted(t, ref, dvv)[None], ref, t, FS, {"band": BAND, "window": WIN, "eps_max": 0.02})
    assert np.sign(got[0]) == np.sign(dvv) and abs(got[0] - dvv) < tol * abs(dvv) + 5e-4


def test_jobs_equal_the_loop(spark):
    """Chunked stacks, references and dv/v equal a plain loop over the days."""
    t, ref = coda()
    rng = np.random.default_rng(3)
    n, k, r = 150, 4, 20
    truth = 5e-3 * np.sin(np.arange(n) / 20)
    x = np.stack([shifted(t, ref, v) + 0.02 * rng.normal(size=N) for v in truth])
    df = spark.createDataFrame(pd.DataFrame({"pair_id": "p", "component": "ZZ", "day": np.arange(n), "ccf": x.tolist()}))
    cfg = lambda i, reference: {"config_index": i, "estimator": "stretching (TS)", "band": BAND, "window": WIN, "stack": k, "reference": reference, "gate": True, "eps_max": 0.02}
    out = waveform.measure_dvv(df, [cfg(0, "fixed"), cfg(1, "moving"), cfg(2, "inversion")], fs=FS, t0=T0, ref_days=r).toPandas()
    stacked = np.stack([x[max(0, i - k + 1) : i + 1].mean(0) for i in range(n)])
    loop = lambda i, rf: kernels.stretching(stacked[i][None], rf, t, FS, cfg(0, "fixed"))[0][0]
    fixed = out[out.config_index == 0].sort_values("day")["dvv"].to_numpy()
    moving = out[out.config_index == 1].sort_values("day")["dvv"].to_numpy()
    joint = out[out.config_index == 2].sort_values("day")["dvv"].to_numpy()
    for i in (0, 2, 63, 64, 65, 149):
        assert abs(fixed[i] - loop(i, x[: int(0.6 * n)].mean(0))) < 1e-10
        if i >= r:
            assert abs(moving[i] - loop(i, stacked[i - r : i].mean(0))) < 1e-10
    assert np.isnan(moving[:r]).all() and len(joint) == n
    assert np.corrcoef(fixed, truth)[0, 1] > 0.95 and np.corrcoef(joint, truth)[0, 1] > 0.9


def test_cc_image_equals_kernel(spark):
    t, ref = coda()
    x = np.stack([shifted(t, ref, v) for v in (0.0, 0.01)])
    df = spark.createDataFrame(pd.DataFrame({"pair_id": "p", "component": "ZZ", "day": [0, 1], "ccf": x.tolist()}))
    rdf = spark.createDataFrame(pd.DataFrame({"pair_id": ["p"], "component": ["ZZ"], "ccf": [ref.tolist()]}))
    got = waveform.cc_image(df, rdf, fs=FS, t0=T0, window=WIN, eps_max=0.02, n_eps=11).toPandas().sort_values("day")
    want = kernels.cc_image(x, ref, t, WIN, np.linspace(-0.02, 0.02, 11))
    np.testing.assert_allclose(np.stack(got["cc"].to_numpy()), want, atol=1e-9)
