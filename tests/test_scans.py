"""Lag profiles, split windows and healing in one pass, against plain loops."""

import numpy as np
import pandas as pd
import pytest

KEY = ["site_id"]
DAY = 86400.0


def irregular(n=700, seed=0, gaps=True):
    rng = np.random.default_rng(seed)
    day = np.sort(rng.choice(np.arange(2 * n), n, replace=False)).astype(float)
    if gaps:
        day[day > n] += 500.0  # longer than any lag
    out = []
    for site in ("a", "b"):
        t = 10 + 8 * np.sin(day / 58) + rng.normal(size=n)
        rain = np.where(rng.random(n) < 0.7, 0.0, rng.exponential(0.02, n))
        sec = day * DAY + rng.integers(0, 40_000, n)
        out.append(pd.DataFrame({
            "site_id": site, "ts": pd.Timestamp("2001-01-01") + pd.to_timedelta(sec, unit="s"), "sec": sec,
            "dvv": rng.normal(size=n) + 0.1 * t, "dvv_err": rng.uniform(0.5, 2, n), "precipitation": rain, "temperature": t,
        }))
    return pd.concat(out, ignore_index=True)


def reservoir(sec, rain, rate, porosity=0.05):
    h, out, last = 0.0, [], None
    for s, v in zip(sec, rain):
        h = (h * np.exp(-rate * (s - last)) if last is not None else 0.0) + v / porosity
        out.append(h)
        last = s
    return np.array(out)


def wls(x, y, s):
    w = 1 / s**2
    cov = np.linalg.inv(x.T @ (w[:, None] * x))
    b = cov @ (x.T @ (w * y))
    return b, np.sqrt(np.diag(cov)), float((w * (y - x @ b) ** 2).sum())


def test_lag_profile_equals_one_fit_per_lag(spark):
    from tremorlake.operators import forcing, regress

    pdf = irregular()
    pdf.loc[5, "dvv"] = None  # takes no part in the fit, but in the temperature
    shifts = [0, 1, 7.5, 40, 133, 200]
    best, curve = regress.shift_scan(spark.createDataFrame(pdf.drop(columns="sec")), KEY, shifts_days=shifts, bounds=None)
    got = curve.toPandas()
    assert len(got) == 2 * len(shifts)
    for site, g in pdf.groupby("site_id"):
        h = reservoir(g.sec.to_numpy(), g.precipitation.to_numpy(), forcing.BASEFLOW_RATE)
        t = g.temperature.to_numpy() - g.temperature.mean()
        ok = g.dvv.notna().to_numpy()
        for s in shifts:
            at = g.sec.to_numpy() - s * DAY
            lag = np.where(at < g.sec.iloc[0], 0.0, np.interp(at, g.sec, t))
            x = np.stack([np.ones(len(g)), h - h.mean(), lag], 1)[ok]
            b, _, chi2 = wls(x, g.dvv[ok].to_numpy(), g.dvv_err[ok].to_numpy())
            row = got[(got.site_id == site) & (got.shift_days == s)].iloc[0]
            assert row.n_obs == ok.sum() and row.chi2_red == pytest.approx(chi2 / (ok.sum() - 3), rel=1e-10)
            assert np.allclose(row.coef, b, rtol=1e-7, atol=1e-12)
    mine = best.toPandas().set_index("site_id")
    want = got.sort_values("chi2_red").groupby("site_id").first()
    assert (mine.shift_days == want.shift_days).all()


def test_split_windows_equal_two_fits_per_split(spark):
    from tremorlake.operators import diagnose, forcing

    pdf = irregular(seed=3)
    pdf.loc[11, "dvv_err"] = None
    times = pd.to_datetime(pdf.ts.sample(30, random_state=1)).tolist() + [pdf.ts.min(), pdf.ts.max() + pd.Timedelta("1D"), pdf.ts.min() + pd.Timedelta("300D 1h")]
    splits = pd.DataFrame([(s, t) for s in ("a", "b") for t in set(times)], columns=["site_id", "split_ts"])
    got = diagnose.tier2_split_window(spark.createDataFrame(pdf.drop(columns="sec")), KEY, splits=spark.createDataFrame(splits), min_samples=40).toPandas()
    n = 0
    for (site, split) in splits.itertuples(index=False):
        g = pdf[pdf.site_id == site]
        sides = {"pre": g[g.ts < split], "post": g[g.ts >= split], "all": g}
        fit = {}
        for name, side in sides.items():
            if not len(side):
                continue
            h = reservoir(side.sec.to_numpy(), side.precipitation.to_numpy(), forcing.BASEFLOW_RATE)
            h = h - h.mean()
            ok = side.dvv_err.notna().to_numpy()
            if ok.sum() >= 40:
                b, sd, _ = wls(np.stack([np.ones(len(side)), h], 1)[ok], side.dvv[ok].to_numpy(), side.dvv_err[ok].to_numpy())
                fit[name] = (b[1], sd[1], int(ok.sum()))
        row = got[(got.site_id == site) & (got.split_ts == split)]
        assert len(row) == (1 if {"pre", "post"} <= set(fit) else 0)
        if len(row):
            n += 1
            r, (p, ps, pn), (q, qs, qn) = row.iloc[0], fit["pre"], fit["post"]
            assert (r.n_pre, r.n_post) == (pn, qn)
            assert r.p1_pre == pytest.approx(p, rel=1e-7, abs=1e-10) and r.p1_post == pytest.approx(q, rel=1e-6, abs=1e-9)
            assert r.delta_relative == pytest.approx(abs(q - p) / abs(fit["all"][0]), rel=1e-5)
            assert r.non_overlap_2sigma == (p + 2 * ps < q - 2 * qs or q + 2 * qs < p - 2 * ps)
    assert n > 40


def test_exponentials_meet_the_kernel_within_the_bound():
    from tremorlake.functions.special import exp1_array
    from tremorlake.operators.forcing import healing_nodes

    for lo, hi, tol in ((86400.0, 30 * 365.25 * 86400, 1e-10), (3600.0, 86400.0, 1e-12), (1.0, 1e9, 1e-6)):
        tau, w = healing_nodes(lo, hi, tol)
        t = np.random.default_rng(1).uniform(np.log(lo / 50), np.log(hi * 100), 5000)
        exact = exp1_array(np.exp(t) / hi) - exp1_array(np.exp(t) / lo)
        assert np.abs(np.exp(-np.exp(t)[:, None] / tau) @ w - exact).max() < 3 * tol * np.log(hi / lo)
        assert len(tau) < 150


def test_total_healing_equals_the_sum_over_events(spark):
    from pyspark.sql import functions as F

    from tremorlake.operators import forcing

    rng = np.random.default_rng(2)
    t0 = pd.Timestamp("2001-01-01")
    epochs = pd.DataFrame([(s, t0 + pd.Timedelta(int(d), "D"), 1) for s in ("a", "b", "c") for d in rng.choice(3000, 400, replace=False)], columns=["site_id", "ts", "other"])
    ev = [(s, i, t0 + pd.Timedelta(int(rng.integers(-400, 3100)) * 24 + int(rng.choice([0, 5])), "h"), float(rng.uniform(0, 2))) for s in ("a", "b", None) for i in range(200)]
    events = spark.createDataFrame(pd.DataFrame(ev, columns=["site_id", "event_id", "ts", "m"]))
    rows = spark.createDataFrame(epochs)
    long = forcing.healing(rows, events.drop("m"), KEY).groupBy("site_id", "ts").agg(F.sum("healing").alias("want")).toPandas()
    got = forcing.healing_total(rows, events, KEY).toPandas().merge(long, on=["site_id", "ts"], how="left").fillna({"want": 0.0})
    assert len(got) == len(epochs) and np.abs(got.healing - got.want).max() < 1e-8
    assert (got[got.site_id == "c"].n_events == 0).all() and got.other.eq(1).all()
    counts = [sum(1 for e in ev if e[0] == r.site_id and e[2] <= r.ts) for r in got.itertuples()]
    assert got.n_events.tolist() == counts
    heavy = forcing.healing(rows, events, KEY).join(events.select("site_id", "event_id", "m"), ["site_id", "event_id"])
    want = heavy.groupBy("site_id", "ts").agg(F.sum(F.col("healing") * F.col("m")).alias("want")).toPandas()
    got = forcing.healing_total(rows, events, KEY, amplitude="m").toPandas().merge(want, on=["site_id", "ts"])
    assert np.abs(got.healing - got.want).max() < 1e-8
    assert forcing.healing_total(rows, events.limit(0), KEY).agg(F.max("healing")).first()[0] == 0.0
    short = forcing.healing_total(rows, events, KEY, tau_min_s=600.0, tau_max_s=5e6).toPandas()
    assert np.isfinite(short.healing).all()
