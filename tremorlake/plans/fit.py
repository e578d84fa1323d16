"""Queries: forcing responses, regression and staged selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions.exprs import day, rnd
from tremorlake.operators import forcing as f
from tremorlake.operators import regress as r
from tremorlake.plans import bindings as b
from tremorlake.plans.bindings import DESIGN, solve3_sql, with_ctes
from tremorlake.session import cut

KEY = ["site_id"]
SHIFTS = list(range(0, 201))


def _col(fn, out, digits=8):
    def run(spark, sf):
        return fn(b.aligned(spark, sf)).select("site_id", day(), rnd(out, digits).alias(out))

    return run


def _cdm_warm(spark, sf):
    rows = b.aligned(spark, sf)
    old = F.col("ts") < F.lit("1996-01-01").cast("timestamp")
    return f.cdm(rows.where(~old), KEY, window_rows=365, warmup=rows.where(old)).select(
        "site_id", day(), rnd("cdm", 8).alias("cdm")
    )


def _diffuse(spark, sf):
    t = b.forcing_long(spark, sf).where(F.col("channel") == "temperature")
    grid = f.daily_grid(t, KEY, "value")
    return f.thermo_diffuse(grid, KEY, depth_m=2.0, diffusivity_m2_s=1e-6)


def _convolve(spark, sf):
    p = b.forcing_long(spark, sf).where(F.col("channel") == "precipitation")
    return f.pressure_convolve(f.daily_grid(p, KEY, "value"), KEY)


def _pressure_step(spark, sf):
    li = b.table(spark, sf, "lineitem")
    p = f.pressure_step(
        F.col("l_extendedprice"), F.col("l_quantity") * 10.0, (F.col("l_linenumber") * 86400.0),
        diffusivity=F.lit(0.1),
    )
    return li.groupBy("l_returnflag", "l_linestatus").agg(rnd(F.avg(p), 4).alias("pressure"), F.count("*").alias("n_rows"))


def _healing(spark, sf):
    ev = b.quakes(spark, sf).where(F.col("magnitude") >= 6.9).groupBy("site_id", "ts").agg(
        F.min("event_id").alias("event_id")
    )
    out = f.healing(b.dvv_daily(spark, sf).select("site_id", "ts"), ev, KEY)
    return out.groupBy("site_id", day()).agg(F.sum("healing").alias("healing"), F.count("*").alias("n_events"))


def _healing_total(spark, sf):
    """Every event of the catalog, weighed by its magnitude."""
    ev = b.quakes(spark, sf).withColumn("gain", F.pow(10.0, F.col("magnitude") - 5.0))
    out = f.healing_total(b.dvv_daily(spark, sf).select("site_id", "ts"), ev, KEY, amplitude="gain")
    return out.select("site_id", day(), "n_events", "healing")


def _load(spark, sf):
    out = b.forcing_long(spark, sf).where(F.col("channel") == "precipitation")
    x = f.surface_load(F.col("value"), beta=250.0, bulk_modulus_gpa=5.0)
    return out.select("site_id", day(), rnd(x, 12).alias("dvv_load"))


def _retention(spark, sf):
    li = b.table(spark, sf, "lineitem")
    sw = f.water_retention(F.col("l_extendedprice"))
    return li.groupBy("l_returnflag").agg(rnd(F.avg(sw), 9).alias("saturation"), rnd(F.min(sw), 9).alias("driest"))


def _skin(spark, sf):
    s = b.sites(spark, sf)
    return s.select("site_id", rnd(f.skin_depth(F.pow(F.lit(10.0), F.col("log10_diffusivity")), F.lit(f.YEAR_S)), 6).alias("skin_depth_m"))


def _fourier(spark, sf):
    return r.fourier_decompose(b.aligned(spark, sf), KEY, "temperature").drop("_span")


def _two(spark, sf):
    rows = f.reservoir(b.aligned(spark, sf), KEY, out="h")
    return f.centre_column(rows, KEY, "h", "p1_dGWL")


def _sensitivity(spark, sf):
    rows = _two(spark, sf)
    cols = [r.INTERCEPT, "p1_dGWL"]
    fit = r.wls_fit(rows, KEY, "dvv", cols, sigma="dvv_err", bounds=r.PHYSICAL_BOUNDS)
    stats = r.fit_stats(r.with_residuals(rows, fit, KEY, "dvv", cols, "dvv_err"), KEY, 2, "dvv_err")
    return fit.select(
        "site_id", "n_obs", rnd(F.col("coef")[0], 10).alias("a0"), rnd(F.col("coef")[1], 10).alias("p1"),
        rnd(F.sqrt(F.col("cov")[3]), 10).alias("p1_std"),
    ).join(stats.select("site_id", rnd("chi2_red", 6).alias("chi2_red")), "site_id")


def _design(spark, sf):
    rows, names, _ = r.build_design(b.aligned(spark, sf), KEY)
    return rows, names


def _build_design(spark, sf):
    rows, _ = _design(spark, sf)
    return rows.select("site_id", day(), rnd("dvv", 12).alias("dvv"), rnd("p1_dGWL", 8).alias("p1_dGWL"), rnd("p2_T", 9).alias("p2_T"))


def _design_full(spark, sf):
    """Every optional column: CDM, lag, two event columns and a snowpack load."""
    a = b.aligned(spark, sf).withColumn("snow", F.col("precipitation"))
    ev = b.quakes(spark, sf).where(F.col("magnitude") >= 6.9).groupBy("site_id").agg(
        F.min_by("ts", F.struct("ts", "event_id")).alias("first"), F.max_by("ts", F.struct("ts", "event_id")).alias("last")
    ).unpivot(["site_id"], ["first", "last"], "event_id", "ts")
    rows, names, units = r.build_design(
        a, KEY, hydro_model="cdm", window_rows=365, loading="snow", loading_model="snowpack",
        events=ev, event_names=["first", "last"],
    )
    fit = r.wls_fit(rows, KEY, "dvv", names, sigma="dvv_err")
    return r.coef_summary(fit, KEY, names, units)


def _pressure_design(spark, sf):
    """Hydrology as diffused pressure, in Pa."""
    rows, names, units = r.build_design(b.aligned(spark, sf), KEY, hydro_model="talwani")
    fit = r.wls_fit(rows, KEY, "dvv", names, sigma="dvv_err")
    return r.coef_summary(fit, KEY, names, units)


def _normal(spark, sf):
    rows, names = _design(spark, sf)
    ne = r.normal_equations(rows, KEY, "dvv", names, "dvv_err")
    return ne.select(
        "site_id", "n_obs", *[rnd(F.col("xtwx")[i] / 1e6, 6).alias(n) for i, n in enumerate(("s00", "s01", "s02", "s11", "s12", "s22"))],
        *[rnd(F.col("xtwd")[i] / 1e6, 6).alias(f"b{i}") for i in range(3)],
    )


def _wls(bounds):
    def run(spark, sf):
        rows, names = _design(spark, sf)
        fit = r.wls_fit(rows, KEY, "dvv", names, sigma="dvv_err", bounds=bounds)
        c, v = F.col("coef"), F.col("cov")
        return fit.select(
            "site_id", "n_obs", "rank", *[rnd(c[i], 9).alias(n) for i, n in enumerate(("a0", "p1", "p2"))],
            *[rnd(F.sqrt(v[i * 4]), 9).alias(f"{n}_std") for i, n in enumerate(("a0", "p1", "p2"))],
        )

    return run


def _unweighted(spark, sf):
    rows, names = _design(spark, sf)
    fit = r.wls_fit(rows, KEY, "dvv", names)
    return fit.select("site_id", "n_obs", "rank", *[rnd(F.col("coef")[i], 9).alias(n) for i, n in enumerate(("a0", "p1", "p2"))],
                      rnd(F.sqrt(F.col("cov")[4]), 9).alias("p1_std"))


def _resid(spark, sf):
    rows, names = _design(spark, sf)
    rows = cut(rows)
    fit = r.wls_fit(rows, KEY, "dvv", names, sigma="dvv_err", bounds=r.PHYSICAL_BOUNDS)
    return fit, names, r.with_residuals(rows, fit, KEY, "dvv", names, "dvv_err")


def _fit_stats(spark, sf):
    _, names, resid = _resid(spark, sf)
    out = r.fit_stats(resid, KEY, len(names), "dvv_err")
    return out.select("site_id", "n_obs", "rank", rnd("chi2_red", 6).alias("chi2_red"), rnd("rss", 8).alias("rss"), rnd("aic", 4).alias("aic"))


UNITS = {"p1_dGWL": "fraction / m water head", "p2_T": "fraction / degC"}


def _coef(spark, sf):
    fit, names, _ = _resid(spark, sf)
    return r.coef_summary(fit, KEY, names, UNITS)


def _coef_summary(spark, sf):
    return _coef(spark, sf).select("site_id", "param", *[rnd(c, 8).alias(c) for c in ("mean", "std", "ci95_low", "ci95_high")], "units")


def _bootstrap(spark, sf):
    """Stored samples: the orders of a customer segment's priority; more draws than samples, so means agree closely."""
    smp = b.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("site_id"), F.col("o_orderkey").alias("sample"), (F.col("o_totalprice") / 1e5).alias("value"))
    return r.propagate(r.bootstrap_draws(smp, KEY, n_draws=20_000), KEY, value=F.col("value"), square=F.col("value") * F.col("value"))


def _draws(spark, sf):
    fit, names, _ = _resid(spark, sf)
    d = r.posterior_draws(fit, KEY, names, n_draws=500)
    return d.groupBy("site_id", "param").agg(F.count("*").alias("n_draws"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def _truth(spark, sf):
    truth = b.dvv_daily(spark, sf).groupBy("site_id").agg(F.avg("dvv").alias("a0"), F.lit(-1e-3).alias("p1_dGWL")).unpivot(
        ["site_id"], ["a0", "p1_dGWL"], "param", "truth")
    out = r.truth_recovery_check(_coef(spark, sf), truth, KEY)
    return out.select("site_id", "param", rnd("mean", 8).alias("mean"), rnd("truth", 8).alias("truth"), rnd("z", 4).alias("z"), "ok")


def _pressure_sensitivity(spark, sf):
    k = F.substring("site_id", 1, 1).cast("double")
    m = b.dvv_daily(spark, sf).select("site_id").distinct().select(
        "site_id", ((4.0 + k) * 1e9).alias("kappa_pa"), ((2.0 + k) * 1e9).alias("mu_pa"))
    out = r.pressure_sensitivity(_coef(spark, sf), m, KEY)
    return out.select(
        "site_id", *[rnd(F.col(c) * 1e9, 4).alias(c) for c in ("d_dvv_dp", "d_dvv_dp_std")],
        *[rnd(F.col(c) / 1e3, 6).alias(c) for c in ("beta_eff", "beta_eff_std", "mu_prime", "mu_prime_std")], "note")


def _shift(spark, sf):
    _, curve = r.shift_scan(b.aligned(spark, sf), KEY, shifts_days=SHIFTS)
    return curve.select("site_id", F.col("shift_days").cast("long").alias("shift_days"), "n_obs", rnd("chi2_red", 6).alias("chi2_red"))


def _best_shift(spark, sf):
    li = b.table(spark, sf, "lineitem")
    curve = li.groupBy(F.col("l_returnflag").alias("site_id"), (F.col("l_partkey") % 50).alias("shift_days")).agg(
        F.when(F.max("l_suppkey") % 7 > 0, F.round(F.avg("l_discount"), 4)).alias("chi2_red"))
    return r.best_shift(curve, KEY).select("site_id", "shift_days", "chi2_red")


def _patterns(spark, sf):
    _, _, resid = _resid(spark, sf)
    out = r.residual_patterns(resid, KEY)
    return out.select("site_id", *[rnd(c, 6).alias(c) for c in ("storm_pearson", "storm_var_ratio", "seasonal_norm", "drift_norm")],
                      "storm_band", "seasonal", "low_freq_drift")


def _pearson(spark, sf):
    return r.pearson(b.aligned(spark, sf), KEY, F.col("dvv"), F.col("temperature"), "r").select("site_id", rnd("r", 9).alias("r"))


def _wet_dry(spark, sf):
    out = r.wet_dry_variance(b.aligned(spark, sf), KEY, "dvv")
    return out.select("site_id", "n_rows", "n_wet", rnd("threshold", 9).alias("threshold"), rnd("var_ratio", 8).alias("var_ratio"))


def _harmonic(spark, sf):
    return r.harmonic_fit(b.dvv_daily(spark, sf), KEY, "dvv").select("site_id", "n_rows", rnd("amplitude", 9).alias("amplitude"))


def _drift(spark, sf):
    return r.low_freq_drift(b.dvv_daily(spark, sf), KEY, "dvv").select("site_id", rnd("drift_std", 10).alias("drift_std"))


def _staged(spark, sf):
    a = b.aligned(spark, sf).drop("temperature")
    k = F.substring("site_id", 1, 1).cast("int")
    state = b.dvv_daily(spark, sf).select("site_id").distinct().select(
        "site_id", F.when(k % 4 == 0, "warn").otherwise("safe").alias("tier1_status"), (k % 3 > 0).alias("loading_enabled"))
    out = r.staged_fit(a, KEY, state)
    return out.select(
        "site_id", rnd("aic_a", 4).alias("aic_a"), rnd("aic_b", 4).alias("aic_b"), rnd("chi2_a", 5).alias("chi2_a"),
        rnd("chi2_b", 5).alias("chi2_b"), "storm_band", "recommended", "accepted", rnd("delta_aic", 4).alias("delta_aic"), "stage", "reason")


QUERIES = {
    "groundwater_sensitivity": _sensitivity,
    "reservoir": _col(lambda d: f.reservoir(d, KEY), "reservoir"),
    "snowpack": _col(lambda d: f.snowpack(d, KEY, load="precipitation"), "swe", 9),
    "cdm": _col(lambda d: f.cdm(d, KEY, window_rows=365), "cdm"),
    "cdm_warmup": _cdm_warm,
    "antecedent_index": _col(lambda d: f.antecedent_index(d, KEY), "api"),
    "seasonal_lowpass": _col(lambda d: f.seasonal_lowpass(d, KEY, value="temperature"), "lowpass"),
    "centre_column": _col(lambda d: f.centre_column(d, KEY, "temperature", "t_c"), "t_c"),
    "thermo_shift": _col(lambda d: f.thermo_shift(d, KEY), "thermo"),
    "thermo_diffuse": _diffuse,
    "skin_depth": _skin,
    "fourier_decompose": _fourier,
    "pressure_step": _pressure_step,
    "pressure_convolve": _convolve,
    "healing": _healing,
    "healing_total": _healing_total,
    "surface_load": _load,
    "water_retention": _retention,
    "build_design": _build_design,
    "build_design_full": _design_full,
    "build_design_pressure": _pressure_design,
    "normal_equations": _normal,
    "wls_fit": _wls(None),
    "wls_fit_unweighted": _unweighted,
    "wls_fit_bounded": _wls(r.PHYSICAL_BOUNDS),
    "fit_stats": _fit_stats,
    "coef_summary": _coef_summary,
    "posterior_draws": _draws,
    "bootstrap_draws": _bootstrap,
    "truth_recovery_check": _truth,
    "pressure_sensitivity": _pressure_sensitivity,
    "shift_scan": _shift,
    "best_shift": _best_shift,
    "pearson": _pearson,
    "wet_dry_variance": _wet_dry,
    "harmonic_fit": _harmonic,
    "low_freq_drift": _drift,
    "residual_patterns": _patterns,
    "staged_fit": _staged,
}

_AL = "dvv forcing aligned"
_W = "1.0::double/(dvv_err*dvv_err)"
_FIT = solve3_sql("ft", "ds", "site_id", "dvv", ("1.0::double", "p1", "p2"), _W)
_RES = _FIT + """, rs as materialized (select ds.*, dvv-(y0+y1*p1+y2*p2) as residual, case when x1>0 then 2 else 3 end as rank from ds join ft using(site_id))"""
_ROLL30 = "over (partition by site_id order by ts rows between 15 preceding and 14 following)"
_ANG = "(2*pi()*epoch(ts)/(365.25::double*86400))"


def _drift_sql(rows: str, v: str) -> str:
    w = "over (partition by site_id order by ts rows between 182 preceding and 182 following)"
    return f"""select site_id, case when count(*)>365 then stddev_samp(m) else stddev_samp({v}) end as drift_std from (
      select site_id, {v}, case when count({v}) {w}>=91 then avg({v}) {w} end as m from {rows}) group by 1"""


def _cdm_sql(rows: str, keep: str) -> str:
    return f"""select site_id, ts as day, round(cdm,8) as cdm from (select *, sum(precipitation-m) over (partition by site_id order by ts
        rows between unbounded preceding and current row) as cdm from (select *, avg(precipitation) over
        (partition by site_id order by ts rows between 364 preceding and current row) as m from {rows})) where {keep}"""


def _harm_sql(name: str, rows: str, v: str) -> str:
    return solve3_sql(name, f"(select *, sin({_ANG}) as sn, cos({_ANG}) as cs from {rows})", "site_id", v, ("sn", "cs", "1.0::double"), "1.0::double")


_COEFS = """cf as (select site_id, unnest(['a0','p1_dGWL','p2_T']) as param, unnest([y0,y1,y2]) as mean,
    unnest([sqrt(v0), case when x1>0 then 0.0::double else sqrt(v1) end, sqrt(v2)]) as std,
    unnest(['fraction','fraction / m water head','fraction / degC']) as units from ft)"""

ORACLE = {
    "pressure_step": """with x as (select *, l_quantity*10.0::double/sqrt(4*0.1::double*l_linenumber*86400.0::double) as a from lineitem),
        e as (select *, 2/sqrt(pi())*list_sum(list_transform(range(0,70), lambda k: (case when k%2=0 then 1 else -1 end)*pow(a,2*k+1)/(gamma(k+1.0::double)*(2*k+1)))) as erf from x)
        select l_returnflag, l_linestatus, round(avg(l_extendedprice*(0.6::double*1.3::double/(3*0.7::double)*erf+1-erf)),4)+0.0 as pressure, count(*) as n_rows from e group by 1,2""",
    "groundwater_sensitivity": with_ctes(_AL + " gw", """select site_id, n as n_obs, round(case when x1>0 then b0/s00 else x0 end,10) as a0,
        round(case when x1>0 then 0.0::double else x1 end,10) as p1, round(case when x1>0 then 0.0::double else sqrt(s00/det) end,10) as p1_std,
        round(chi,6) as chi2_red from fx join (select d.site_id, sum(pow((dvv-(case when x1>0 then b0/s00 else x0+x1*p1 end))/dvv_err,2))
          /(count(*)-(case when any_value(x1)>0 then 1 else 2 end)) as chi from d2 d join fx using(site_id) group by 1) using(site_id)""",
        f"""d2 as (select al.*, r-avg(r) over (partition by site_id) as p1 from al join gw using(site_id,ts)),
        s2 as (select site_id, count(*) as n, sum({_W}) as s00, sum({_W}*p1) as s01, sum({_W}*p1*p1) as s11, sum({_W}*dvv) as b0, sum({_W}*p1*dvv) as b1 from d2 group by 1),
        fx as (select *, s00*s11-s01*s01 as det, (s11*b0-s01*b1)/(s00*s11-s01*s01) as x0, (s00*b1-s01*b0)/(s00*s11-s01*s01) as x1 from s2)"""),
    "reservoir": with_ctes(_AL + " gw", "select site_id, ts as day, round(r,8) as reservoir from gw"),
    "snowpack": with_ctes(_AL, """select a.site_id, a.ts as day, round(sum(b.precipitation*exp(-(a.ts-b.ts)/30.0::double)),9) as swe
        from al a join al b on a.site_id=b.site_id and b.ts<=a.ts group by 1,2"""),
    "cdm": with_ctes(_AL, _cdm_sql("al", "true")),
    "cdm_warmup": with_ctes(_AL, _cdm_sql("al", "ts>=date '1996-01-01'")),
    "antecedent_index": with_ctes(_AL, """select site_id, ts as day, round(sum(precipitation) over
        (partition by site_id order by ts rows between 89 preceding and current row),8) as api from al"""),
    "seasonal_lowpass": with_ctes(_AL, f"select site_id, ts as day, round(avg(temperature) {_ROLL30},8) as lowpass from al"),
    "centre_column": with_ctes(_AL, "select site_id, ts as day, round(temperature-avg(temperature) over (partition by site_id),8)+0.0 as t_c from al"),
    "thermo_shift": with_ctes(_AL + " tlag", "select site_id, ts as day, round(t_lag,8)+0.0 as thermo from tl"),
    "skin_depth": with_ctes("sites", "select site_id, round(sqrt(pow(10.0::double,log10_diffusivity)*365.25*86400/pi()),6) as skin_depth_m from sites"),
    "surface_load": with_ctes("forcing", "select site_id, ts as day, round(250.0*(1000.0*9.81::double*precipitation/(3*5e9)),12) as dvv_load from fw"),
    "water_retention": """select l_returnflag, round(avg(s),9) as saturation, round(min(s),9) as driest from (
        select l_returnflag, 0.05::double+0.95::double*pow(1+pow(1e-4*l_extendedprice,2),-0.5) as s from lineitem) group by 1""",
    "build_design": with_ctes(DESIGN, "select site_id, ts as day, round(dvv,12) as dvv, round(p1,8)+0.0 as \"p1_dGWL\", round(p2,9)+0.0 as \"p2_T\" from ds"),
    "normal_equations": with_ctes(DESIGN, "select site_id, n as n_obs, " + ", ".join(f"round({c}/1e6,6)+0.0 as {c}" for c in "s00 s01 s02 s11 s12 s22 b0 b1 b2".split()) + " from ft", _FIT),
    "wls_fit": with_ctes(DESIGN, """select site_id, n as n_obs, 3::bigint as rank, round(x0,9) as a0, round(x1,9) as p1, round(x2,9) as p2,
        round(sqrt(v0),9) as a0_std, round(sqrt(v1),9) as p1_std, round(sqrt(v2),9) as p2_std from ft""", _FIT),
    "wls_fit_unweighted": with_ctes(DESIGN, """select site_id, n as n_obs, 3::bigint as rank, round(x0,9) as a0, round(x1,9) as p1, round(x2,9) as p2,
        round(sqrt(v1*rss/(n-3)),9) as p1_std from fu join (select ds.site_id, sum(pow(dvv-(x0+x1*p1+x2*p2),2)) as rss from ds join fu using(site_id) group by 1) using(site_id)""",
        solve3_sql("fu", "ds", "site_id", "dvv", ("1.0::double", "p1", "p2"), "1.0::double")),
    "wls_fit_bounded": with_ctes(DESIGN, """select site_id, n as n_obs, (case when x1>0 then 2 else 3 end)::bigint as rank, round(y0,9) as a0, round(y1,9)+0.0 as p1, round(y2,9) as p2,
        round(sqrt(v0),9) as a0_std, round(case when x1>0 then 0.0::double else sqrt(v1) end,9) as p1_std, round(sqrt(v2),9) as p2_std from ft""", _FIT),
    "fit_stats": with_ctes(DESIGN, """select site_id, count(*) as n_obs, max(rank)::bigint as rank, round(sum(pow(residual/dvv_err,2))/(count(*)-max(rank)),6) as chi2_red,
        round(sum(residual*residual),8) as rss, round(count(*)*ln(sum(residual*residual)/count(*))+6,4) as aic from rs group by 1""", _RES),
    "coef_summary": with_ctes(DESIGN, """select site_id, param, round(mean,8)+0.0 as mean, round(std,8) as std, round(mean-1.96*std,8)+0.0 as ci95_low,
        round(mean+1.96*std,8)+0.0 as ci95_high, units from cf""", _FIT + "," + _COEFS),
    "truth_recovery_check": with_ctes(DESIGN, """select site_id, param, round(mean,8)+0.0 as mean, round(truth,8) as truth,
        round((mean-truth)/nullif(std,0),4) as z, abs((mean-truth)/nullif(std,0))<4 as ok from cf join (
        select site_id, unnest(['a0','p1_dGWL']) as param, unnest([avg(dvv),-1e-3]) as truth from dvv group by site_id) using(site_id,param)""", _FIT + "," + _COEFS),
    "pressure_sensitivity": with_ctes(DESIGN, """select site_id, round(s*1e9,4)+0.0 as d_dvv_dp, round(ss*1e9,4) as d_dvv_dp_std, round(s*(4+k)*1e9/1e3,6)+0.0 as beta_eff,
        round(ss*(4+k)*1e9/1e3,6) as beta_eff_std, round(-2*(2+k)*1e9*s/1e3,6)+0.0 as mu_prime, round(2*(2+k)*1e9*ss/1e3,6) as mu_prime_std,
        cast(null as varchar) as note from (select site_id, mean/9810.0::double as s, std/9810.0::double as ss, substr(site_id,1,1)::double as k from cf where param='p1_dGWL')""", _FIT + "," + _COEFS),
    "shift_scan": with_ctes(DESIGN.replace("tlag design", ""), """select site_id, sh as shift_days, n as n_obs,
        round((dd-2*(y0*b0+y1*b1+y2*b2)+y0*y0*s00+y1*y1*s11+y2*y2*s22+2*(y0*y1*s01+y0*y2*s02+y1*y2*s12))/(n-(case when x1>0 then 2 else 3 end)),6) as chi2_red from fs""",
        """tg as (select al.*, r-avg(r) over (partition by site_id) as p1, temperature-avg(temperature) over (partition by site_id) as tc from al join gw using(site_id,ts)),
        sh as (select unnest(generate_series(0,200))::bigint as sh),
        xx as (select t.site_id, t.ts, t.dvv, t.dvv_err, t.p1, sh.sh, t.ts-cast(sh.sh as integer) as x from tg t, sh),
        pp as (select xx.*, t.ts as p, t.tc as pv from xx asof left join tg t on xx.site_id=t.site_id and xx.x>=t.ts),
        qq as (select pp.*, t.ts as n, t.tc as nv from pp asof left join tg t on pp.site_id=t.site_id and pp.x<=t.ts),
        dl as (select *, case when p is null or n is null then 0.0::double when p=n then pv else pv+(nv-pv)*((x-p)::double/(n-p)::double) end as p2 from qq),
        """ + solve3_sql("fs", "dl", "site_id, sh", "dvv", ("1.0::double", "p1", "p2"), _W)),
    "best_shift": """with c as (select l_returnflag as site_id, l_partkey%50 as s, case when max(l_suppkey)%7>0 then round(avg(l_discount),4) end as c from lineitem group by 1,2)
        select site_id, arg_min(s, c*1000000+s) as shift_days, min(c) as chi2_red from c where c is not null group by 1""",
    "pearson": with_ctes(_AL, "select site_id, round(corr(dvv,temperature),9) as r from al group by 1"),
    "wet_dry_variance": with_ctes(_AL, """select site_id, count(*) as n_rows, sum(case when precipitation>thr then 1 else 0 end)::bigint as n_wet, round(any_value(thr),9) as threshold,
        round(case when count(*)>30 and count_if(precipitation>thr)>5 and count_if(precipitation<=thr)>5 then var_samp(case when precipitation>thr then dvv end)/var_samp(case when precipitation<=thr then dvv end) else 1.0::double end,8) as var_ratio
        from al join (select site_id, quantile_cont(precipitation,0.9) as thr from al group by 1) using(site_id) group by 1"""),
    "harmonic_fit": with_ctes("dvv", "select site_id, n as n_rows, round(sqrt(x0*x0+x1*x1),9) as amplitude from hf", _harm_sql("hf", "dvv", "dvv")),
    "low_freq_drift": with_ctes("dvv", f"select site_id, round(drift_std,10) as drift_std from ({_drift_sql('dvv', 'dvv')})"),
    "residual_patterns": with_ctes(DESIGN, f"""select site_id, round(pr,6) as storm_pearson, round(vr,6) as storm_var_ratio, round(se,6) as seasonal_norm, round(dr,6) as drift_norm,
        pr>=0.2 or vr>=1.5 as storm_band, se>=1 as seasonal, dr>=1 as low_freq_drift from (
        select site_id, abs(pr) as pr, vr, sqrt(h.x0*h.x0+h.x1*h.x1)/sg as se, drift_std/sg as dr from
        (select site_id, corr(abs(residual),precipitation) as pr, quantile_cont(dvv_err,0.5) as sg from rs group by 1)
        join (select site_id, case when count(*)>30 and count_if(precipitation>thr)>5 and count_if(precipitation<=thr)>5 then var_samp(case when precipitation>thr then residual end)/var_samp(case when precipitation<=thr then residual end) else 1.0::double end as vr
          from rs join (select site_id, quantile_cont(precipitation,0.9) as thr from rs group by 1) using(site_id) group by 1) using(site_id)
        join hr h using(site_id) join ({_drift_sql('rs', 'residual')}) using(site_id))""", _RES + "," + _harm_sql("hr", "rs", "residual")),
    "staged_fit": with_ctes(_AL + " gw", """, st as (select site_id, pr>=0.2 or vr>=1.5 as storm_band, aic_a, chi2_a from pa join ra using(site_id)),
        jj as (select *, substr(site_id,1,1)::integer%4<>0 as safe, substr(site_id,1,1)::integer%3>0 as en from st join rb using(site_id))
        select site_id, round(aic_a,4) as aic_a, round(aic_b,4) as aic_b, round(chi2_a,5) as chi2_a, round(chi2_b,5) as chi2_b, storm_band,
        storm_band and safe as recommended, storm_band and safe and en and aic_b-aic_a<=-4 as accepted,
        case when storm_band and safe and en then round(aic_b-aic_a,4) end as delta_aic,
        case when storm_band and safe and en and aic_b-aic_a<=-4 then 'stage_b' else 'stage_a' end as stage,
        case when not storm_band then 'no storm-band residual structure' when not safe then 'storm-band structure but tier 1 not safe'
          when not en then 'loading disabled for this site' when aic_b-aic_a<=-4 then 'loading accepted' else 'loading rejected: AIC gain below 4' end as reason from jj""",
        f"""l3 as materialized (select *, ld-avg(ld) over (partition by site_id) as p3, r-avg(r) over (partition by site_id) as p1 from
          (select al.*, r, 1000.0*9.81::double*precipitation/3e9 as ld from al join gw using(site_id,ts))),
        {solve3_sql("fb", "l3", "site_id", "dvv", ("1.0::double", "p1", "p3"), _W)},
        fa as (select *, (s11*b0-s01*b1)/c22 as a_0, (s00*b1-s01*b0)/c22 as a_1 from fb),
        xa as materialized (select l3.*, dvv-(case when a_1>0 then b0/s00 else a_0+a_1*p1 end) as residual, dvv-(y0+y1*p1+y2*p3) as resb,
          case when a_1>0 then 1 else 2 end as ka, case when x1>0 then 2 else 3 end as kb from l3 join fa using(site_id)),
        ra as (select site_id, sum(pow(residual/dvv_err,2))/(count(*)-max(ka)) as chi2_a, count(*)*ln(sum(residual*residual)/count(*))+4 as aic_a from xa group by 1),
        rb as (select site_id, sum(pow(resb/dvv_err,2))/(count(*)-max(kb)) as chi2_b, count(*)*ln(sum(resb*resb)/count(*))+6 as aic_b from xa group by 1),
        pa as (select * from (select site_id, abs(corr(abs(residual),precipitation)) as pr from xa group by 1) join (select site_id,
          case when count(*)>30 and count_if(precipitation>thr)>5 and count_if(precipitation<=thr)>5 then var_samp(case when precipitation>thr then residual end)/var_samp(case when precipitation<=thr then residual end) else 1.0::double end as vr
          from xa join (select site_id, quantile_cont(precipitation,0.9) as thr from xa group by 1) using(site_id) group by 1) using(site_id))"""),
}
