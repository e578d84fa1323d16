"""Queries: measurement uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions.exprs import day, rnd
from tremorlake.operators import align as al
from tremorlake.operators import gibbs as g
from tremorlake.operators import uncertainty as u
from tremorlake.plans import bindings as b
from tremorlake.plans.bindings import with_ctes
from tremorlake.session import cut

KEY = ["site_id"]


def _members(spark, sf):
    return b.component_dvv(spark, sf)


def _ensemble(spark, sf):
    out = u.ensemble_variance(_members(spark, sf), ["pair_id", "ts"])
    return out.select("pair_id", day(), "n_members", *[rnd(c, 9).alias(c) for c in ("method_std", "within_std", "total_std")], rnd("mean", 13).alias("mean"))


def _choices(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.select((F.col("l_linenumber") / 2.0).alias("frequency_hz"), (2 + F.col("l_quantity") / 10).alias("t1"),
                     (12 + F.col("l_quantity") / 3).alias("t2"), (0.5 + F.col("l_discount") * 4).alias("cc"))


def _floor(spark, sf):
    return u.choice_floor(_choices(spark, sf)).groupBy("frequency_hz").agg(F.count("floor").alias("n"), rnd(F.avg("floor") * 1e4, 8).alias("floor"))


def _band_error(spark, sf):
    out = u.band_marginal_error(u.choice_floor(_choices(spark, sf)), ["frequency_hz"])
    return out.select("frequency_hz", "n", *[rnd(F.col(c) * 1e4, 8).alias(c) for c in ("within", "processing", "total")])


def _model_average(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_linestatus", "l_linenumber", (F.col("l_discount") * 10).alias("score"), F.col("l_tax").alias("mean"), (F.col("l_quantity") / 1e3).alias("sigma"))
    out = u.window_model_average(li, ["l_linestatus", "l_linenumber"], min_score=0.1)
    return out.select("l_linestatus", "l_linenumber", "n_windows", *[rnd(c, 9).alias(c) for c in ("mean", "aleatoric", "epistemic", "total")])


def _cov(spark, sf):
    out = u.error_covariance(b.dvv_daily(spark, sf), KEY, sigma="dvv_err", corr_length_days=3.0, common_mode=5e-4, tolerance=1e-4)
    return out.select("site_id", "i", "j", rnd(F.col("cov") * 1e6, 8).alias("cov"), rnd(F.col("beyond") * 1e6, 8).alias("beyond"))


def _cov_hourly(spark, sf):
    """Sub-daily, irregular epochs: the reach is a time, not a number of epochs."""
    ev = b.table(spark, sf, "events")
    h = ev.groupBy(F.col("event_type").alias("site_id"), F.date_trunc("hour", "ts").alias("ts")).agg((F.avg("value") / 100).alias("s"))
    out = u.error_covariance(h, KEY, sigma="s", corr_length_days=0.5, common_mode=1e-3, tolerance=1e-3)
    return out.groupBy("site_id").agg(F.count("*").alias("n_pairs"), F.max(F.col("j") - F.col("i")).cast("long").alias("widest"), rnd(F.sum("cov"), 4).alias("total"))


def _factor(spark, sf):
    out = u.methodological_factor(_members(spark, sf), ["pair_id"], member="component")
    return out.select("pair_id", "component", F.col("ts").cast("date").alias("ts"), "n_members", rnd(F.col("factor") * 1e3, 8).alias("factor"))


def _method_cov(spark, sf):
    out = u.methodological_cov(_members(spark, sf), ["pair_id"], member="component", reach=3)
    return out.select("pair_id", "i", "j", "n_members", rnd(F.col("cov") * 1e3 * F.pi(), 9).alias("cov"))


def _neff(spark, sf):
    out = u.effective_n(b.dvv_daily(spark, sf), KEY, sigma="dvv_err", corr_length_days=10.0, common_mode=1e-4)
    return out.select("site_id", "n", rnd("n_eff", 6).alias("n_eff"))


def _single(spark, sf):
    out = u.single_reference_cov(b.dvv_daily(spark, sf), KEY, sigma="dvv_err")
    return out.select("site_id", "i", rnd(F.col("var") * 1e6, 6).alias("var"), rnd(F.col("ref_var") * 1e6, 6).alias("ref_var"))


def _corr_length(spark, sf):
    d = _members(spark, sf).withColumn("residual", F.col("dvv") + F.sin(F.dayofyear("ts") / 58.0) * 0.3)
    out = u.corr_length(d, ["pair_id"], member="component")
    return out.select("pair_id", "dt", rnd("corr_length_days", 6).alias("corr_length_days"))


def _all_to_all(spark, sf):
    e = al.epoch_pair_join(b.dvv_daily(spark, sf), KEY, max_lag=5)
    return u.all_to_all_reference(e, KEY, reach=5)


def _all_to_all_equations(spark, sf):
    """The equations that define the solution and its covariance: L x = G'Wd, sum 0, and rows of L C = 1 - 1/n."""
    e = cut(al.epoch_pair_join(b.dvv_daily(spark, sf), KEY, max_lag=5))
    x = u.all_to_all_reference(e, KEY, reach=5).select(*KEY, "i", "dvv", "sigma", "n_pairs")
    c = u.all_to_all_covariance(e, KEY, reach=5)
    both = c.unionByName(c.where("i < j").select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    w = 1 / (F.col("sigma") * F.col("sigma"))
    sides = e.select(*KEY, "i", "j", w.alias("w"), (w * F.col("rel")).alias("wd"))
    sides = sides.unionByName(sides.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), "w", (-F.col("wd")).alias("wd")))
    rows = sides.join(x.select(*KEY, F.col("i").alias("j"), F.col("dvv").alias("xj")), [*KEY, "j"]).join(both, [*KEY, "i", "j"])
    rows = rows.groupBy(*KEY, "i").agg(
        F.sum("w").alias("w"), F.sum("wd").alias("wd"), F.sum(F.col("w") * F.col("xj")).alias("wx"), F.sum(F.col("w") * F.col("cov")).alias("wc"))
    rows = rows.join(x, [*KEY, "i"])
    defect = F.abs(F.col("w") * F.col("dvv") - F.col("wx") - F.col("wd")) / F.col("w")
    unit = F.col("w") * F.col("sigma") ** 2 - F.col("wc")
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("n_epochs"), F.max("n_pairs").alias("n_pairs"), rnd(F.max(defect), 8).alias("defect"), rnd(F.abs(F.sum("dvv")), 8).alias("sum"),
        rnd(F.min(unit), 8).alias("least_unit"), rnd(F.max(unit), 8).alias("most_unit"))


def _all_to_all_chain(spark, sf):
    """Neighbours only: the solution is a running sum, its covariance that of a random walk."""
    e = al.epoch_pair_join(b.dvv_daily(spark, sf), KEY, max_lag=1)
    return u.all_to_all_reference(e, KEY).select(*KEY, "i", rnd(F.col("dvv") * F.pi(), 6).alias("dvv"), rnd(F.col("sigma") * F.pi(), 6).alias("sigma"), "component", "n_pairs")


def _posterior(spark, sf):
    m = _members(spark, sf).groupBy("pair_id", "component", F.datediff("ts", F.lit("1995-01-01")).cast("long").alias("t")).agg(
        F.avg("dvv").alias("dvv"), F.avg("sigma").alias("sigma"))
    return g.hierarchical_dvv(m, ["pair_id"], member="component")


def _gibbs(spark, sf):
    return _posterior(spark, sf)


def _gibbs_cov(spark, sf):
    """Measurement covariance of the posterior, with the epochs' own rows as a check of its diagonal."""
    p = cut(_posterior(spark, sf))
    c = g.measurement_covariance(p, ["pair_id"], tolerance=1e-3)
    return c.groupBy("pair_id").agg(F.count("*").alias("n_pairs"), F.sum(F.when(F.col("i") == F.col("j"), F.col("cov"))).alias("trace"), F.max("beyond").alias("beyond"))


def _sample(spark, sf):
    bands = b.table(spark, sf, "lineitem").select((F.col("l_linenumber") / 2.0).alias("frequency_hz")).distinct()
    out = u.choice_floor(u.sample_choices(spark, bands, n_samples=2000))
    return out.groupBy("frequency_hz", "rule").agg(F.count("*").alias("n"), F.avg("t2").alias("t2"), F.avg("floor").alias("floor"))


def _flatten(spark, sf):
    li = b.table(spark, sf, "lineitem")
    t2 = u.flatten_lapse(F.col("l_quantity") / 10, F.col("l_linenumber") / 2.0, F.lit(120.0), F.col("l_extendedprice") / 5e3)
    return li.groupBy("l_linenumber").agg(F.count(t2).alias("n_valid"), rnd(F.avg(t2), 7).alias("t2"))


def _bands(spark, sf):
    p = b.table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("site_id"), (F.col("p_size") / 20.0).alias("fmin")).distinct().withColumn("fmax", F.col("fmin") * 2)


def _candidates(spark, sf):
    out = u.candidate_windows(_bands(spark, sf), [2, 5, 10], [5, 20], [None, 7])
    return out.select("site_id", "fmin", "fmax", "start_s", "end_s", "substack_days")


def _rolling(spark, sf):
    return u.rolling_lapse_windows(_bands(spark, sf), start_s=2, stop_s=35, duration_s=5, step_s=1).select("site_id", "fmin", "fmax", "start_s", "end_s")


def _scored(spark, sf):
    w = u.candidate_windows(_bands(spark, sf), [2, 5, 10], [5, 20], [None, 7, 45])
    obs = b.table(spark, sf, "part").groupBy(F.col("p_brand").alias("site_id"), (F.col("p_size") / 20.0).alias("fmin")).agg(
        F.when(F.min("p_partkey") % 5 > 0, F.avg("p_retailprice") / 2000).alias("coherence"), (F.avg("p_retailprice") / 200).alias("snr"),
        (F.count("*") / 4e4).alias("dvv_sigma"), F.when(F.min("p_partkey") % 3 > 0, F.avg("p_partkey") / 1e4).alias("lapse_slope"))
    j = w.join(obs, ["site_id", "fmin"])
    return u.window_scores(j.withColumns({
        "distance_m": F.lit(8000.0), "group_velocity": F.lit(800.0), "vs_mps": F.lit(900.0), "depth_lo_m": F.lit(150.0), "depth_hi_m": F.lit(400.0), "forcing_period_days": F.lit(60.0)}))


def _window_scores(spark, sf):
    return _scored(spark, sf).select("site_id", "fmin", "start_s", "end_s", "substack_days", *[rnd(f"m_{m}", 8).alias(m) for m in (
        "coherence", "snr", "cycles", "wave_type", "depth", "uncertainty", "stability", "substack")], rnd("score", 8).alias("score"), F.concat_ws(",", "flags").alias("flags"))


def _rank(spark, sf):
    return u.rank_windows(_scored(spark, sf), KEY).select("site_id", "fmin", "start_s", "end_s", "substack_days", "rank")


def _profile(spark, sf):
    return u.lapse_profile(_scored(spark, sf), KEY).select("site_id", "fmin", "start_s", "end_s", "substack_days", "position", "eligible")


def _kernel(spark, sf):
    p = b.table(spark, sf, "part")
    return p.groupBy(F.col("p_type").alias("profile"), F.col("p_brand").alias("band"), (F.col("p_size") / 100.0).alias("depth_km")).agg(
        (F.avg("p_retailprice") / 1e3).alias("dcdvs"), (0.5 + F.count("*") / 50.0).alias("vs")).withColumn("c", F.lit(0.9))


def _overlap(spark, sf):
    k = _kernel(spark, sf).select("profile", "band", (F.col("depth_km") * 1e3).alias("depth"), (F.col("dcdvs") - 1.4).alias("g"))
    return u.kernel_overlap(k, ["profile", "band"], lo=99.9, hi=300.1).select("profile", "band", rnd("overlap", 8).alias("overlap"))


def _matrix(spark, sf):
    return u.kernel_matrix(_kernel(spark, sf), ["profile", "band"], max_depth_km=0.4).select("profile", "band", rnd("depth_km", 6).alias("depth_km"), rnd("g", 9).alias("g"))


def _gain(spark, sf):
    g = u.kernel_matrix(_kernel(spark, sf), ["profile", "band"])
    bands = g.select("band").distinct()
    return u.gain_matrix(g, bands.select(F.col("band").alias("band_i"), F.col("band").alias("band_j"), F.lit(1e-8).alias("cov")))


def _depth(spark, sf):
    d = b.table(spark, sf, "part").groupBy(F.col("p_type").alias("profile"), F.col("p_brand").alias("band"), F.col("p_size").alias("epoch")).agg((F.avg("p_retailprice") / 1e6).alias("dvv"))
    return u.depth_profile(_gain(spark, sf), d, ["epoch"])


def _depth_cov(spark, sf):
    """Every (profile, band) on its own, so that the matrix to invert is a number."""
    k = u.kernel_matrix(_kernel(spark, sf), ["profile", "band"])
    k = k.select(F.concat_ws("|", "profile", "band").alias("profile"), "band", "depth_km", "g")
    bands = k.select("band").distinct()
    cov = bands.select(F.col("band").alias("band_i"), F.col("band").alias("band_j"), F.lit(1e-8).alias("cov"))
    out = u.depth_covariance(u.gain_matrix(k, cov))
    return out.select("profile", rnd("depth_i", 6).alias("depth_i"), rnd("depth_j", 6).alias("depth_j"), rnd(F.col("cov") * 1e6, 6).alias("cov"))


def _depth_cov_all(spark, sf):
    gain = cut(_gain(spark, sf))
    out = u.depth_covariance(gain)
    own = out.where("depth_i = depth_j").join(gain.select("profile", F.col("depth_km").alias("depth_i"), "std").distinct(), ["profile", "depth_i"])
    return own.select("profile", "depth_i", F.col("cov").alias("variance"), "std")


QUERIES = {
    "ensemble_variance": _ensemble, "choice_floor": _floor, "band_marginal_error": _band_error, "window_model_average": _model_average,
    "error_covariance": _cov, "error_covariance_hourly": _cov_hourly, "methodological_factor": _factor, "methodological_cov": _method_cov, "effective_n": _neff, "single_reference_cov": _single,
    "corr_length": _corr_length, "all_to_all_reference": _all_to_all, "all_to_all_equations": _all_to_all_equations, "all_to_all_chain": _all_to_all_chain, "hierarchical_dvv": _gibbs, "hierarchical_covariance": _gibbs_cov, "sample_choices": _sample,
    "flatten_lapse": _flatten, "candidate_windows": _candidates, "rolling_lapse_windows": _rolling, "window_scores": _window_scores,
    "rank_windows": _rank, "lapse_profile": _profile, "kernel_overlap": _overlap, "kernel_matrix": _matrix, "depth_profile": _depth, "depth_covariance": _depth_cov, "depth_variance": _depth_cov_all,
}

_CH = """(select f, case when cc>0 and cc<=1 then sqrt((1-cc*cc)/(2*cc*cc)*6*sqrt(pi()/2)/(pow(2*pi()*f,2)*(pow(t2,3)-pow(t1,3)))) end as fl from
  (select l_linenumber/2.0::double as f, 2+l_quantity/10 as t1, 12+l_quantity/3 as t2, 0.5::double+l_discount*4 as cc from lineitem))"""
_BD = "bd as (select distinct p_brand as site_id, p_size/20.0::double as fmin, p_size/20.0::double*2 as fmax from part)"
_CW = "cw as (select *, st+du as end_s from (select site_id, fmin, fmax, unnest([2.0,2.0,5.0,5.0,10.0,10.0]::double[]) as st, unnest([5.0,20.0,5.0,20.0,5.0,20.0]::double[]) as du from bd), (select unnest([{}]::double[]) as substack_days))"
_SC = _CW.format("null,7,45") + """, ob as (select p_brand as site_id, p_size/20.0::double as fmin, case when min(p_partkey)%5>0 then avg(p_retailprice)/2000 end as coherence, avg(p_retailprice)/200 as snr, count(*)/4e4 as sg,
    case when min(p_partkey)%3>0 then avg(p_partkey)/1e4 end as sl from part group by 1,2),
  mm as (select c.*, case when coherence>1 then 1.0::double else coherence end as coherence, 1-exp(-snr/5) as snr, least((end_s-st)*c.fmin/10,1.0::double) as cycles,
    exp(-0.5*pow(ln(8000/((st+end_s)/2)/800.0::double)/ln(1.5::double),2)) as wave_type,
    case when z between 150 and 400 then 1.0::double else exp(-0.5*pow(ln(z/(case when z<150 then 150.0::double else 400.0::double end))/ln(2.0::double),2)) end as depth,
    exp(-sg/1e-4) as uncertainty, 1/(1+abs(sl)/0.2::double) as stability, case when substack_days<=15 then 1.0::double when substack_days is not null then exp(-(substack_days/15-1)) end as substack
    from (select *, 900/(3*sqrt(fmin*fmax)) as z from cw) c join ob on ob.site_id=c.site_id and ob.fmin=c.fmin),
  sc as materialized (select *, (coalesce(0.22::double*coherence,0)+0.18::double*snr+0.14::double*cycles+0.16::double*wave_type+0.18::double*depth+0.08::double*uncertainty+coalesce(0.04::double*stability,0))
    /((case when coherence is null then 0 else 0.22::double end)+0.18::double+0.14::double+0.16::double+0.18::double+0.08::double+(case when stability is null then 0 else 0.04::double end)) as score from mm)"""
_MET = ("coherence", "snr", "cycles", "wave_type", "depth", "uncertainty", "stability", "substack")
_KN = "kn as (select p_type as profile, p_brand as band, p_size/100.0::double as z, avg(p_retailprice)/1e3 as k, 0.5::double+count(*)/50.0::double as vs from part group by 1,2,3)"

ORACLE = {
    "ensemble_variance": with_ctes("component", """select pair_id, ts as day, count(*) as n_members, round(coalesce(stddev_samp(dvv),0),9) as method_std, round(sqrt(avg(sigma*sigma)),9) as within_std,
        round(sqrt(avg(sigma*sigma)+pow(coalesce(stddev_samp(dvv),0),2)),9) as total_std, round(avg(dvv),13) as mean from component group by 1,2"""),
    "choice_floor": f"select f as frequency_hz, count(fl) as n, round(avg(fl)*1e4,8) as floor from {_CH} group by 1",
    "band_marginal_error": f"select f as frequency_hz, count(*) as n, round(sqrt(avg(fl*fl))*1e4,8) as within, round(stddev_samp(fl)*1e4,8) as processing, round(sqrt(avg(fl*fl)+var_samp(fl))*1e4,8) as total from {_CH} group by 1",
    "window_model_average": """with w as (select *, exp(4*(l_discount*10-max(l_discount*10) over (partition by l_linestatus, l_linenumber))) as w, l_quantity/1e3 as sg from lineitem where l_discount*10>=0.1),
        m as (select l_linestatus, l_linenumber, count(*) as n, sum(w*l_tax)/sum(w) as mu, sum(w*sg*sg)/sum(w) as al from w group by 1,2),
        e as (select l_linestatus, l_linenumber, sum(w*pow(l_tax-mu,2))/sum(w) as ep from w join m using(l_linestatus,l_linenumber) group by 1,2)
        select l_linestatus, l_linenumber, n as n_windows, round(mu,9) as mean, round(sqrt(al),9) as aleatoric, round(sqrt(ep),9) as epistemic, round(sqrt(al+ep),9) as total from m join e using(l_linestatus,l_linenumber)""",
    "error_covariance": with_ctes("dvv", """, d as (select *, row_number() over (partition by site_id order by ts)-1 as i from dvv) select a.site_id, a.i, b.i as j,
        round((a.dvv_err*b.dvv_err*exp(-(b.ts-a.ts)/3.0::double)+25e-8)*1e6,8) as cov, 0.25::double as beyond from d a join d b on a.site_id=b.site_id and b.i>=a.i and b.ts-a.ts<=3*ln(1e4)"""),
    "error_covariance_hourly": """with h as (select event_type as site_id, epoch(date_trunc('hour', ts))/86400.0::double as t, avg(value)/100 as s from events group by 1,2),
        d as (select *, row_number() over (partition by site_id order by t)-1 as i from h)
        select a.site_id, count(*) as n_pairs, max(b.i-a.i) as widest, round(sum(a.s*b.s*exp(-(b.t-a.t)/0.5::double)+1e-6),4)+0.0 as total
        from d a join d b on a.site_id=b.site_id and b.i>=a.i and b.t-a.t<=0.5*ln(1e3) group by 1""",
    "methodological_factor": with_ctes("component", """, m as (select pair_id, ts, avg(dvv) as mean, count(*) as n from component group by 1,2 having count(*)>1)
        select c.pair_id, c.component, cast(c.ts as date) as ts, n as n_members, round((c.dvv-mean)/sqrt(n-1)*1e3,8)+0.0 as factor from component c join m using(pair_id, ts)"""),
    "methodological_cov": with_ctes("component", """, ep as (select pair_id, ts, row_number() over (partition by pair_id order by ts)-1 as i from (select distinct pair_id, ts from component)), m as (select * from component join ep using(pair_id,ts))
        select a.pair_id, a.i, b.i as j, count(*) as n_members, round(covar_samp(a.dvv,b.dvv)*1e3*pi(),9)+0.0 as cov from m a join m b on a.pair_id=b.pair_id and a.component=b.component and b.i between a.i and a.i+3 group by 1,2,3 having count(*)>1"""),
    "effective_n": with_ctes("dvv", """select site_id, n, round(n*(q/(1+1e-8*q))/d,6) as n_eff from (select site_id, count(*) as n, sum(case when pt is null then 1/(dvv_err*dvv_err) else pow(1/dvv_err-exp(-(ts-pt)/10.0::double)/ps,2)/(1-exp(-2*(ts-pt)/10.0::double)) end) as q,
        sum(1/(dvv_err*dvv_err)) as d from (select *, lag(ts) over w as pt, lag(dvv_err) over w as ps from dvv window w as (partition by site_id order by ts)) group by 1)"""),
    "single_reference_cov": with_ctes("dvv", """select site_id, i, round((case when i=0 then rv else dvv_err*dvv_err+rv end)*1e6,6) as var, round(rv*1e6,6) as ref_var from (select *, row_number() over (partition by site_id order by ts)-1 as i,
        pow(first_value(dvv_err) over (partition by site_id order by ts),2) as rv from dvv)"""),
    "corr_length": with_ctes("component", """, m as (select pair_id, component, ts, dvv+sin(dayofyear(ts)/58.0::double)*0.3::double as x from component),
        c as (select *, x-avg(x) over (partition by pair_id, component) as r, row_number() over (partition by pair_id, component order by ts) as i, count(*) over (partition by pair_id, component) as n from m),
        v as (select pair_id, component, sum(r*r) as v from c group by 1,2),
        p as (select a.pair_id, a.component, b.i-a.i as lag, sum(a.r*b.r)/any_value(v.v)*any_value(a.n)/(any_value(a.n)-(b.i-a.i)) as rho from c a join c b on a.pair_id=b.pair_id and a.component=b.component and b.i-a.i between 1 and 40 join v on v.pair_id=a.pair_id and v.component=a.component group by 1,2,3),
        q as (select pair_id, lag, greatest(least(avg(rho),1.0::double),1e-3) as r from p group by 1,2 union all select distinct pair_id, 0, 1.0::double from p),
        f as (select pair_id, max(lag) as top, (sum(r*r)*sum(r*r*lag*ln(r))-sum(r*r*lag)*sum(r*r*ln(r)))/(sum(r*r)*sum(r*r*lag*lag)-pow(sum(r*r*lag),2)) as s from q group by 1),
        t as (select pair_id, quantile_cont(g,0.5) as dt from (select pair_id, (ts-lag(ts) over (partition by pair_id order by ts))::double as g from (select distinct pair_id, ts from m)) group by 1)
        select pair_id, dt, round(greatest(least(case when s<0 then -dt/s else dt*top end, dt*top),dt),6) as corr_length_days from f join t using(pair_id)"""),
    "all_to_all_equations": with_ctes("dvv", """, n as (select site_id, count(*) as n from dvv group by 1)
        select site_id, n as n_epochs, 5*n-15 as n_pairs, 0.0::double as defect, 0.0::double as "sum", round(1-1.0::double/n,8) as least_unit, round(1-1.0::double/n,8) as most_unit from n"""),
    "all_to_all_chain": with_ctes("dvv", """, d as (select *, row_number() over w - 1 as i, count(*) over (partition by site_id) as n, pow(dvv_err,2)+pow(lag(dvv_err) over w,2) as s2 from dvv window w as (partition by site_id order by ts)),
        s as (select *, coalesce(sum(s2) over w,0) as sv from d window w as (partition by site_id order by i)),
        u as (select *, (sum(sv) over w + (n-1-i)*sv)/n as u from s window w as (partition by site_id order by i))
        select site_id, i, round((dvv-avg(dvv) over (partition by site_id))*pi(),6)+0.0 as dvv, round(sqrt(greatest(sv-2*u+avg(u) over (partition by site_id),0))*pi(),6) as sigma, 0 as component, n-1 as n_pairs from u"""),
    "flatten_lapse": """select l_linenumber, count(t2) as n_valid, round(avg(t2),7) as t2 from (select l_linenumber, case when l_extendedprice/5e3>1 then l_quantity/10+120.0::double/(pi()*(l_linenumber/2.0::double))*ln(l_extendedprice/5e3) end as t2 from lineitem) group by 1""",
    "candidate_windows": "with " + _BD + "," + _CW.format("null,7") + " select site_id, fmin, fmax, st as start_s, end_s, substack_days from cw",
    "rolling_lapse_windows": "with " + _BD + " select site_id, fmin, fmax, 2.0::double+k as start_s, 7.0::double+k as end_s from bd, (select unnest(range(29)) as k)",
    "window_scores": "with " + _BD + "," + _SC + " select site_id, fmin, st as start_s, end_s, substack_days, " + ", ".join(f"round({m},8) as {m}" for m in _MET) + ", round(score,8) as score, concat_ws(',', " + ", ".join(f"case when {m}<0.35 then 'low_{m}' end" for m in _MET) + ", case when cycles<1 then 'fewer_than_10_cycles' end) as flags from sc",
    "rank_windows": "with " + _BD + "," + _SC + " select site_id, fmin, st as start_s, end_s, substack_days, row_number() over (partition by site_id order by score desc nulls last, st, fmin, end_s, substack_days nulls first) as rank from sc",
    "lapse_profile": "with " + _BD + "," + _SC + " select site_id, fmin, st as start_s, end_s, substack_days, row_number() over (partition by site_id order by (st+end_s)/2, fmin, st, substack_days nulls first) as position, score>=0.7 as eligible from sc",
    "kernel_overlap": "with " + _KN + """ select profile, band, round(case when t>0 then least(coalesce(i,0)/t,1.0::double) else 0.0::double end,8)+0.0 as overlap from (select profile, band, sum(ar) as t, sum(case when d>=99.9 and d1<=300.1 then ar end) as i from (select *, (a+a1)/2*(d1-d) as ar from
        (select *, lead(a) over w as a1, lead(d) over w as d1 from (select profile, band, z*1e3 as d, abs(k-1.4::double) as a from kn) window w as (partition by profile, band order by d))) group by 1,2)""",
    "depth_covariance": "with " + _KN + """, km as (select profile||'|'||band as profile, z, coalesce(kr/nullif(sum(abs(kr)*dz) over (partition by profile, band),0),kr)*dz as g from (select *, vs/0.9::double*k as kr,
        case when up is not null and dn is not null then (dn-up)/2 else coalesce(dn-z, z-up, 0.0::double) end as dz from (select *, lag(z) over w as up, lead(z) over w as dn from kn window w as (partition by profile, band order by z)))),
        pr as (select a.profile, a.z as zi, b.z as zj, b.g as gj, 25e-6::double*exp(-0.5::double*pow((a.z-b.z)/0.1::double,2)) as cm from km a join km b using(profile)),
        gc as (select profile, zi as z, sum(gj*cm) as gc from pr group by 1,2), sd as (select profile, sum(g*gc)+1e-8 as s from gc join km using(profile, z) group by 1)
        select pr.profile, round(zi,6) as depth_i, round(zj,6) as depth_j, round((cm-x.gc*y.gc/s)*1e6,6)+0.0 as cov from pr join gc x on x.profile=pr.profile and x.z=zi join gc y on y.profile=pr.profile and y.z=zj join sd on sd.profile=pr.profile where zi<=zj""",
    "kernel_matrix": "with " + _KN + """ select profile, band, round(z,6) as depth_km, round(coalesce(kr/nullif(sum(abs(kr)*dz) over (partition by profile, band),0),kr)*dz,9) as g from (select *, vs/0.9::double*k as kr,
        case when up is not null and dn is not null then (dn-up)/2 else coalesce(dn-z, z-up, 0.0::double) end as dz from (select *, lag(z) over w as up, lead(z) over w as dn from kn where z<=0.4 window w as (partition by profile, band order by z)))""",
}
