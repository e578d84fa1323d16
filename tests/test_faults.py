"""Inputs that once lost rows or gave wrong numbers without a word."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake import session
from tremorlake.functions.special import erf_array
from tremorlake.operators import forcing, literature, regress, sweep, uncertainty

KEY = ["site_id"]


def hourly(spark, n):
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h")
    return spark.createDataFrame(pd.DataFrame({"site_id": "s", "ts": ts, "sigma": 1.0 + np.arange(n) % 3}))


def test_covariance_reach_is_a_time(spark):
    got = uncertainty.error_covariance(hourly(spark, 200), KEY, sigma="sigma", corr_length_days=3.0, common_mode=0.5).toPandas()
    assert len(got) == 200 * 201 // 2
    s = 1.0 + np.arange(200) % 3
    want = s[got.i] * s[got.j] * np.exp(-(got.j - got.i) / 72.0) + 0.25
    np.testing.assert_allclose(got["cov"], want)
    assert set(got.beyond) == {0.25}


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("rate_days", [1.0, 40.0, 900.0])
def test_decay_keeps_its_range(spark, hot, rate_days):
    days = np.arange(0, 4000, 20)
    df = spark.createDataFrame(pd.DataFrame({"site_id": "s", "ts": pd.Timestamp("2001-01-01") + pd.to_timedelta(days, unit="D"), "x": 1.0 + days % 3}))
    got = forcing.decay_sum(df, KEY, F.col("x"), 1 / (rate_days * 86400.0), "y", hot=hot).toPandas().sort_values("ts")["y"].to_numpy()
    want = [sum((1.0 + d % 3) * math.exp(-(t - d) / rate_days) for d in days[: i + 1]) for i, t in enumerate(days)]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_unknown_use_case_is_kept(spark):
    name = next(iter(sweep.USE_CASES))
    cases = spark.createDataFrame([(1, name, False), (2, "no such thing", False), (3, None, True)], "case_id long, use_case string, two_layer boolean")
    rec = {r["case_id"]: r for r in sweep.recommend_config(cases).collect()}
    assert set(rec) == {1, 2, 3} and rec[2]["use_case"] is None and rec[2]["estimator"] is None and rec[1]["use_case"] == name
    grid = sweep.build_grid(cases, "compact").groupBy("case_id").count().collect()
    counts = {r["case_id"]: r["count"] for r in grid}
    assert counts[2] == counts[3] == 1 and counts[1] > 1


def test_gibbs_keeps_epochs_with_a_missing_member(spark):
    rng = np.random.default_rng(0)
    t = np.arange(60)
    truth = 1e-3 * np.sin(t / 9)
    rows = [("s", m, int(i), float(truth[i] + rng.normal(0, 1e-4)), 1e-4) for m in "abc" for i in t if not (m == "c" and i % 2)]
    got = uncertainty.hierarchical_dvv(spark.createDataFrame(rows, "site_id string, member string, t long, dvv double, sigma double"), KEY, member="member", n_iter=300, burn=100).toPandas()
    assert sorted(got.t) == list(t)
    got = got.sort_values("t")
    assert np.sqrt(np.mean((got.mu_mean - got.mu_mean.mean() - truth + truth.mean()) ** 2)) < 2e-4
    assert np.isfinite(got[["within_std", "method_std", "total_std"]]).all().all()


def test_depth_profile_of_a_missing_band_is_null(spark):
    gain = spark.createDataFrame([("p", b, z, 0.5) for b in (1, 2) for z in (0.0, 1.0)], "profile string, band int, depth_km double, gain double")
    rows = spark.createDataFrame([("p", 1, 1, 2.0), ("p", 2, 1, 4.0), ("p", 1, 2, 2.0), ("p", 1, 3, 2.0), ("p", 2, 3, None)], "profile string, band int, epoch int, dvv double")
    got = {(r["epoch"], r["depth_km"]): r["mean"] for r in uncertainty.depth_profile(gain, rows, ["epoch"]).collect()}
    assert got == {(1, 0.0): 3.0, (1, 1.0): 3.0, (2, 0.0): None, (2, 1.0): None, (3, 0.0): None, (3, 1.0): None}


def test_factor_gives_the_full_covariance(spark):
    rng = np.random.default_rng(3)
    rows = [("s", m, (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(rng.normal())) for m in "abcd" for i in range(6)]
    df = spark.createDataFrame(rows, "site_id string, member string, ts timestamp, dvv double")
    f = uncertainty.methodological_factor(df, KEY, member="member").toPandas().pivot(index="ts", columns="member", values="factor").to_numpy()
    full = uncertainty.methodological_cov(df, KEY, member="member").toPandas()
    assert len(full) == 21
    np.testing.assert_allclose((f @ f.T)[full.i, full.j], full["cov"], atol=1e-12)


def test_cite_keys_pass_z(spark):
    rows = [("k", f"d{i:02d}", i) for i in range(30)] + [(None, "x", 99)]
    got = {r["doi"]: r["cite_key"] for r in literature.disambiguate_keys(spark.createDataFrame(rows, "base string, doi string, n int"), base="base", doi="doi", order="n").collect()}
    assert got["d00"] == "k" and got["d01"] == "kb" and got["d25"] == "kz" and got["d26"] == "kaa" and got["d27"] == "kab"
    assert len(got) == 31 and got["x"] is None


def test_draws_follow_the_covariance(spark):
    cov = [[4.0, 1.8, 0.0], [1.8, 1.0, 0.0], [0.0, 0.0, 0.0]]
    fit = spark.createDataFrame([("s", [1.0, 2.0, 3.0], sum(cov, [])), ("t", None, None)], "site_id string, coef array<double>, cov array<double>")
    got = regress.posterior_draws(fit, KEY, ["a", "b", "c"], n_draws=20_000).toPandas().pivot(index="draw", columns="param", values="value")
    np.testing.assert_allclose(got.mean(), [1.0, 2.0, 3.0], atol=0.05)
    np.testing.assert_allclose(np.cov(got.to_numpy().T), cov, atol=0.1)


def test_one_bad_site_does_not_stop_the_others(spark):
    rows = [(k, float(i), float(2 * i + 1), 0.0 if k == "bad" and i == 3 else 1.0) for k in ("good", "bad") for i in range(8)]
    df = spark.createDataFrame(rows, "site_id string, x double, d double, s double").withColumn("one", F.lit(1.0))
    got = {r["site_id"]: r for r in regress.wls_fit(df, KEY, "d", ["one", "x"], sigma="s").collect()}
    assert got["bad"]["coef"] is None and got["bad"]["rank"] is None
    np.testing.assert_allclose(got["good"]["coef"], [1.0, 2.0])
    short = spark.createDataFrame([("a", i, 1.0 * i) for i in range(9)] + [("b", 0, 1.0)], "site_id string, day_no long, value double")
    out = forcing.thermo_diffuse(short, KEY, depth_m=1.0, diffusivity_m2_s=1e-6).toPandas()
    assert out[out.site_id == "b"].t_depth.isna().all() and out[out.site_id == "a"].t_depth.notna().all()


def test_erf_array():
    x = np.concatenate([np.linspace(-6, 6, 1001), [1e-9, 40.0, -40.0]])
    np.testing.assert_allclose(erf_array(x), [math.erf(v) for v in x], rtol=1e-12, atol=1e-15)
    assert np.isnan(erf_array(np.array([np.nan]))).all()


def test_zero_series_scores_nothing(spark):
    days = range(40)
    truth = spark.createDataFrame([(1, d, 0.002 * math.sin(d / 4)) for d in days], "case_id long, day int, truth double")
    case = spark.createDataFrame([(1, 1e-4, 0.35, None, 40)], "case_id long, rms_target double, rel_tol double, rms_wrong_layer double, n_days int")
    sub = truth.select(F.lit("zero").alias("submission_id"), "case_id", "day", F.lit(0.0).alias("dvv")).union(truth.select(F.lit("true"), "case_id", "day", "truth"))
    got = {r["submission_id"]: r["score"] for r in sweep.score_submissions(sub, truth, case).collect()}
    assert got == {"zero": 0.0, "true": 1.0}


def test_shared_folder(spark, monkeypatch):
    assert session.shared_folder(spark)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_shared_band_pass_changes_nothing():
    from tremorlake.functions import kernels
    from tremorlake.operators import waveform

    rng = np.random.default_rng(4)
    x, day = rng.normal(size=(40, 128)), np.arange(40)
    pdf = pd.DataFrame({"pair_id": "p", "day": [*day, -1], "ccf": [*x, x.mean(0)], "_chunk": 0})
    cells = [(e, b, r) for e in kernels.ESTIMATORS for b in ((0.1, 0.3), (0.15, 0.4)) for r in ("fixed", "moving")]
    cfgs = [{"config_index": i, "estimator": e, "band": b, "window": (6.0, 50.0), "stack": 3, "reference": r, "gate": False, "eps_max": 0.06} for i, (e, b, r) in enumerate(cells)]
    run = lambda: waveform._measure_chunk(pdf, ["pair_id"], 1.0, -64.0, 10, cfgs)
    shared, names = run(), kernels.BAND_LIMITED
    kernels.BAND_LIMITED = ()
    try:
        alone = run()
    finally:
        kernels.BAND_LIMITED = names
    assert shared["error"].isna().all()
    np.testing.assert_allclose(shared["dvv"], alone["dvv"], rtol=1e-9, atol=1e-12)
    assert not {"WCS", "WTS", "WTDTW"} & set(names)
