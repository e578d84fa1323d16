"""Queries: residual tests, transients, coupling tiers, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions.exprs import day, rnd
from tremorlake.operators import align as al
from tremorlake.operators import diagnose as d
from tremorlake.operators import forcing as f
from tremorlake.operators.scan import with_row_index
from tremorlake.plans import bindings as b
from tremorlake.plans.bindings import solve3_sql, with_ctes
from tremorlake.session import cut

KEY = ["site_id"]
Z, RUN = 1.0, 2


def _zscore(spark, sf):
    out = d.rolling_zscore(b.dvv_daily(spark, sf), KEY, "dvv")
    return out.select("site_id", day(), "idx", rnd("z", 7).alias("z"))


def _segments(spark, sf):
    return d.transient_segments(b.dvv_daily(spark, sf), KEY, "dvv", z_threshold=Z, min_length=RUN)


def _transients(spark, sf):
    return _segments(spark, sf).select(
        "site_id", "onset_idx", "end_idx", day("onset_ts", "onset"), day("end_ts", "end_day"), "duration_samples",
        rnd("peak_amplitude", 12).alias("peak_amplitude"), rnd("peak_zscore", 7).alias("peak_zscore"), "sign")


def _autocorr(spark, sf):
    return d.autocorr_lags(b.dvv_daily(spark, sf), KEY, "dvv").select("site_id", "n_obs", "lag", rnd("rho", 9).alias("rho"))


def _ljung(spark, sf):
    return d.ljung_box(b.dvv_daily(spark, sf), KEY, "dvv").select(
        "site_id", "n_obs", rnd("q", 6).alias("q"), rnd("p_value", 8).alias("p_value"), "white")


def _detect(spark, sf):
    return d.detect_anomalies(b.dvv_daily(spark, sf), KEY, "dvv", z_threshold=Z, min_length=RUN).select(
        "site_id", "n_obs", rnd("q", 6).alias("q"), rnd("p_value", 8).alias("p_value"), "white",
        "n_transients", rnd("residual_std", 10).alias("residual_std"))


def _base(spark, sf):
    a = cut(with_row_index(b.aligned(spark, sf), KEY, ["ts"]))
    seg = d.transient_segments(a.drop("idx"), KEY, "dvv", z_threshold=Z, min_length=RUN)
    return a, seg


def _xcorr(spark, sf):
    a, seg = _base(spark, sf)
    out = d.lagged_xcorr(seg, a, KEY, value="dvv", channels=["precipitation", "temperature"])
    return out.select("site_id", "onset_idx", "channel", "lag", rnd("r", 7).alias("r"))


def _attribute(spark, sf):
    a, seg = _base(spark, sf)
    big = b.quakes(spark, sf).where(F.col("magnitude") >= 6.7).select("site_id", "ts")
    ev = big.join(a.select("site_id", "ts", "idx"), ["site_id", "ts"])
    warn = b.dvv_daily(spark, sf).select("site_id").distinct().withColumn(
        "coupling_warning", F.substring("site_id", 1, 1).cast("int") % 2 == 0)
    out = d.attribute_anomaly(seg, a, ev, warn, KEY, value="dvv", channels=["precipitation", "temperature"])
    return out.select("site_id", "onset_idx", "rank", "category", rnd("score", 6).alias("score"))


def _rank(spark, sf):
    li = b.table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    scored = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[
        e.alias(c) for c, e in zip(d.CATEGORIES, (
            F.col("l_discount") * 10, F.when(q > 40, 0.7).otherwise(0.4), F.when(F.col("l_tax") > 0.06, 1.0).otherwise(0.0),
            F.when(q < 5, 0.7).otherwise(0.0), F.lit(0.0)))])
    out = d.rank_attribution(scored, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.groupBy("rank", "category").agg(F.count("*").alias("n_rows"), rnd(F.sum("score"), 4).alias("score"))


def _tier1_sites(spark, sf):
    k = F.substring("site_id", 1, 1).cast("double")
    return b.dvv_daily(spark, sf).select("site_id").distinct().select(
        "site_id", F.lit(f.YEAR_S).alias("period_s"), (200.0 + 900.0 * k).alias("length_m"),
        F.lit(0.1).alias("diffusivity"), (150.0 + 50.0 * k).alias("beta_drained"), (0.3 + 0.08 * k).alias("alpha_b"))


def _supplier_tier1(spark, sf):
    s = b.sites(spark, sf)
    return s.select(
        "site_id", F.lit(f.YEAR_S).alias("period_s"), (50.0 + F.col("site_id") % 40 * 25.0).alias("length_m"),
        F.pow(F.lit(10.0), F.col("log10_diffusivity")).alias("diffusivity"),
        F.col("beta_mean").alias("beta_drained"), (F.col("biot_mean") * F.col("skempton_mean") / 2).alias("alpha_b"))


def _tier1(spark, sf):
    return d.tier1_poroelastic(_supplier_tier1(spark, sf), KEY).select(
        "site_id", rnd("peclet", 8).alias("peclet"), rnd("beta_eff", 6).alias("beta_eff"), rnd("ratio", 8).alias("ratio"),
        "tier1_status", rnd("tier1_score", 8).alias("tier1_score"))


def _peclet(spark, sf):
    s = _supplier_tier1(spark, sf)
    return s.select("site_id", rnd(d.drainage_peclet(F.col("period_s"), F.col("length_m"), F.col("diffusivity")), 8).alias("peclet"))


def _beta_eff(spark, sf):
    s = _supplier_tier1(spark, sf)
    om = F.col("diffusivity") / (F.col("length_m") * F.col("length_m"))
    e = d.beta_eff(F.lit(1e-6), om, F.col("beta_drained"), F.col("alpha_b"))
    return s.select("site_id", rnd(e, 6).alias("beta_eff"))


def _escalation(spark, sf):
    s = b.table(spark, sf, "lineitem")
    return s.groupBy(d.escalation_level(F.col("l_quantity") * F.col("l_tax") + 0.005).alias("level")).agg(F.count("*").alias("n_rows"))


def _likelihood(spark, sf):
    s = b.table(spark, sf, "part")
    score = d.coupling_likelihood(F.col("p_retailprice") / 400.0, 1 + F.col("p_size") / 250.0)
    return s.select("p_partkey", rnd(score, 8).alias("score"), d.likelihood_label(score).alias("label"))


def _max_tier(spark, sf):
    li = b.table(spark, sf, "lineitem")
    top, label = d.max_tier_score([F.col("l_discount") * 4, F.nullif(F.col("l_tax"), F.lit(0.03)) * 9, F.col("l_quantity") / 120.0])
    return li.select(label.alias("label"), top.alias("score")).groupBy("label").agg(
        F.count("*").alias("n_rows"), rnd(F.sum("score"), 6).alias("score"))


def _tidal(spark, sf):
    return d.tidal_windows(b.dvv_hourly(spark, sf), b.strain_hourly(spark, sf), KEY, n_cycles=10)


def _tidal_windows(spark, sf):
    return _tidal(spark, sf).select("site_id", "window", "n_rows", rnd("ratio", 6).alias("ratio"))


def _tidal_summary(spark, sf):
    out = d.tidal_ratio_summary(_tidal(spark, sf), KEY)
    return out.select("site_id", rnd("beta_tidal", 6).alias("beta_tidal"), rnd("sigma", 6).alias("sigma"))


def _tier2_rows(spark, sf):
    return d.tier2_split_window(cut(b.aligned(spark, sf)), KEY)


def _tier2(spark, sf):
    return _tier2_rows(spark, sf).select(
        "site_id", "n_pre", "n_post", *[rnd(c, 8).alias(c) for c in ("p1_pre", "p1_post")],
        rnd("delta_relative", 5).alias("delta_relative"), "non_overlap_2sigma")


def _tier2_events(spark, sf):
    """Splits at every event of the site's own catalog, whatever its magnitude."""
    ev = b.quakes(spark, sf).select("site_id", F.col("ts").alias("split_ts")).distinct()
    rows = d.tier2_split_window(cut(b.aligned(spark, sf)), KEY, splits=ev)
    return d.tier2_status(rows, KEY)


def _slopes(spark, sf):
    api = f.antecedent_index(b.aligned(spark, sf), KEY)
    return d.rolling_slope(api, KEY, "dvv", "api").select(
        "site_id", "window", day("centre_ts", "centre"), rnd("slope", 8).alias("slope"), rnd("x_mean", 8).alias("x_mean"))


def _tier3(spark, sf):
    return d.tier3_saturation(b.aligned(spark, sf), KEY).select(
        "site_id", "n_windows", rnd("cv_slope", 6).alias("cv_slope"), rnd("corr_slope_api", 6).alias("corr_slope_api"),
        "tier3_status", rnd("tier3_score", 6).alias("tier3_score"))


def _tier4(spark, sf):
    return d.tier4_thermo_capillary(b.aligned(spark, sf), KEY).select(
        "site_id", "n_obs", rnd("rho", 7).alias("rho"), "tier4_status", rnd("tier4_score", 7).alias("tier4_score"))


def _diagnose(spark, sf):
    rows = cut(b.aligned(spark, sf))
    out = d.diagnose_all(
        d.tier1_poroelastic(_tier1_sites(spark, sf), KEY), d.tier2_status(d.tier2_split_window(rows, KEY), KEY),
        d.tier3_saturation(rows, KEY), d.tier4_thermo_capillary(rows, KEY), KEY)
    return out.select(
        "site_id", rnd("peclet", 6).alias("peclet"), *[f"tier{i}_status" for i in (1, 2, 3, 4)],
        F.concat_ws(",", "warnings").alias("warnings"), F.concat_ws(",", "escalations").alias("escalations"),
        F.concat_ws(",", "deferred").alias("deferred"), rnd("score", 5).alias("score"), "label", "escalate")


QUERIES = {
    "rolling_zscore": _zscore,
    "transient_segments": _transients,
    "autocorr_lags": _autocorr,
    "ljung_box": _ljung,
    "detect_anomalies": _detect,
    "lagged_xcorr": _xcorr,
    "attribute_anomaly": _attribute,
    "rank_attribution": _rank,
    "tier1_poroelastic": _tier1,
    "drainage_peclet": _peclet,
    "beta_eff": _beta_eff,
    "escalation_level": _escalation,
    "coupling_likelihood": _likelihood,
    "max_tier_score": _max_tier,
    "tidal_windows": _tidal_windows,
    "tidal_ratio_summary": _tidal_summary,
    "tier2_split_window": _tier2,
    "tier2_events": _tier2_events,
    "rolling_slope": _slopes,
    "tier3_saturation": _tier3,
    "tier4_thermo_capillary": _tier4,
    "diagnose_all": _diagnose,
}

_R30 = "over (partition by site_id order by ts rows between 15 preceding and 14 following)"


def _z_ctes(rows: str) -> str:
    return f"""zz as materialized (select site_id, ts, dvv, i, (dvv-coalesce(mu,gm))/(case when sd>0 then sd else gs end) as z from (
      select site_id, ts, dvv, row_number() over (partition by site_id order by ts)-1 as i,
      case when count(*) {_R30}>=15 then avg(dvv) {_R30} end as mu, case when count(*) {_R30}>=15 then stddev_samp(dvv) {_R30} end as sd,
      avg(dvv) over (partition by site_id) as gm, stddev_samp(dvv) over (partition by site_id) as gs from {rows})),
    ab as (select *, i-row_number() over (partition by site_id order by ts) as g from zz where abs(z)>={Z}),
    sg as materialized (select site_id, min(i) as onset_idx, max(i) as end_idx, min(ts) as onset, max(ts) as end_day, count(*) as duration_samples,
      arg_max(dvv,abs(z)) as amp, arg_max(z,abs(z)) as pz from ab group by site_id, g having count(*)>={RUN})"""


_ACF = """cc as (select site_id, ts, dvv-avg(dvv) over (partition by site_id) as r from dvv),
  ca as (select site_id, count(*) as n_obs, sum(r*r) as v, """ + ", ".join(f"sum(r*l{k}) as p{k}" for k in range(1, 21)) + """ from (
    select site_id, r, """ + ", ".join(f"lag(r,{k}) over w as l{k}" for k in range(1, 21)) + """ from cc window w as (partition by site_id order by ts)) group by 1),
  ac as (select site_id, n_obs, unnest(generate_series(1,20))::bigint as lag, unnest([""" + ", ".join(f"p{k}/v" for k in range(1, 21)) + """]) as rho from ca),
  lb as (select site_id, max(n_obs) as n_obs, max(n_obs)*(max(n_obs)+2)*sum(rho*rho/(n_obs-lag)) as q from ac group by 1),
  lp as (select *, exp(-q/2)*(""" + "+".join(f"pow(q/2,{k})/{float(__import__('math').factorial(k))}::double" for k in range(10)) + """) as p from lb)"""

_T1 = """(select s_suppkey as site_id, 365.25*86400.0::double as per, 50.0::double+s_suppkey%40*25.0::double as l, pow(10.0::double,log10_diffusivity) as c,
  beta_mean as bd, biot_mean*skempton_mean/2 as ab from (select *, site_id as s_suppkey from sites))"""
_BETA = "bd*sqrt((1+pow(({om}*l*l/c)/(1-ab),2))/(1+pow({om}*l*l/c,2)))"

_XC = """xr as (select a.site_id, s.onset_idx, a.idx, a.dvv, a.precipitation, a.temperature from al a join sg s on a.site_id=s.site_id
    and a.idx between s.onset_idx-15 and s.end_idx+15),
  xp as (select a.site_id, a.onset_idx, ch, lag, a.dvv as x, case ch when 'precipitation' then b.precipitation else b.temperature end as y
    from xr a, (select unnest(generate_series(-10,10)) as lag) l, (select unnest(['precipitation','temperature']) as ch) c, xr b
    where b.site_id=a.site_id and b.onset_idx=a.onset_idx and b.idx=a.idx+lag),
  xq as (select site_id, onset_idx, ch, lag, count(*) as m, covar_samp(x,y)*(count(*)-1)/(count(*)*(case when stddev_samp(x)>0 then stddev_samp(x) else 1 end)
    *(case when stddev_samp(y)>0 then stddev_samp(y) else 1 end)) as r from xp group by 1,2,3,4),
  xb as (select * from (select *, row_number() over (partition by site_id, onset_idx, ch order by abs(r) desc, lag) as rn from xq where m>=5) where rn=1)"""

_TIDE = """td as (select h.site_id, h.ts, h.dvv, coalesce(n.value,p.value) as strain from hourly h
    left join strain n on n.site_id=h.site_id and n.ts=h.ts+interval 30 minute
    left join strain p on p.site_id=h.site_id and p.ts=h.ts-interval 30 minute),
  te as materialized (select *, cast(floor(t/(10*12.4206::double*3600)) as bigint) as win, sin(2*pi()*t/(12.4206::double*3600)) as sn, cos(2*pi()*t/(12.4206::double*3600)) as cs
    from (select *, (epoch(ts)-min(epoch(ts)) over (partition by site_id))::double as t from td where strain is not null)),
  """ + solve3_sql("ha", "te", "site_id, win", "dvv", ("sn", "cs", "1.0::double"), "1.0::double") + ",\n" + \
    solve3_sql("hb", "te", "site_id, win", "strain", ("sn", "cs", "1.0::double"), "1.0::double") + """,
  tw as (select a.site_id, a.win as "window", a.n as n_rows, sqrt(a.x0*a.x0+a.x1*a.x1)/sqrt(b.x0*b.x0+b.x1*b.x1) as ratio from ha a join hb b on a.site_id=b.site_id and a.win=b.win where a.n>=8)"""

_SPLIT = """sp as (select site_id, k, make_timestamp(cast(epoch_us(t0)+k/5.0::double*(epoch_us(t1)-epoch_us(t0)) as bigint)) as st from
    (select site_id, min(ts)::timestamp as t0, max(ts)::timestamp as t1 from al group by 1), (select unnest([1,2,3,4]) as k)),
  sd as materialized (select a.*, k, a.ts<st as pre from al a join sp using(site_id)),
  sr as materialized (select a.site_id, a.k, a.pre, a.ts, any_value(a.dvv) as dvv, any_value(a.dvv_err) as dvv_err,
    sum(b.precipitation/0.05::double*exp(-(a.ts-b.ts)/180.0::double)) as r from sd a join sd b on a.site_id=b.site_id and a.k=b.k and a.pre=b.pre and b.ts<=a.ts group by 1,2,3,4),
  sc as (select *, 1/(dvv_err*dvv_err) as w, r-avg(r) over (partition by site_id,k,pre) as x from sr),
  sf as (select site_id, k, pre, count(*) as n, (sum(w)*sum(w*x*dvv)-sum(w*x)*sum(w*dvv))/(sum(w)*sum(w*x*x)-sum(w*x)*sum(w*x)) as p,
    sqrt(sum(w)/(sum(w)*sum(w*x*x)-sum(w*x)*sum(w*x))) as s from sc group by 1,2,3 having count(*)>=90),
  po as (select site_id, (sum(w)*sum(w*x*dvv)-sum(w*x)*sum(w*dvv))/(sum(w)*sum(w*x*x)-sum(w*x)*sum(w*x)) as pp from
    (select al.site_id, al.dvv, 1/(al.dvv_err*al.dvv_err) as w, r-avg(r) over (partition by al.site_id) as x from al join gw using(site_id,ts)) group by 1),
  t2 as materialized (select a.site_id, a.n as n_pre, b.n as n_post, a.p as p1_pre, b.p as p1_post, abs(b.p-a.p)/abs(pp) as dr,
    a.p+2*a.s<b.p-2*b.s or b.p+2*b.s<a.p-2*a.s as apart from sf a join sf b on a.site_id=b.site_id and a.k=b.k and a.pre and not b.pre join po on po.site_id=a.site_id)"""

_T3 = """ap as materialized (select *, sum(precipitation) over (partition by site_id order by ts rows between 89 preceding and current row) as api from al),
  sl as materialized (select site_id, win as "window", max(case when idx=win*30+182 then ts end) as centre, regr_slope(dvv,api) as slope, avg(api) as x_mean
    from ap join (select unnest(generate_series(0,500))::bigint as win) on idx between win*30 and win*30+364
    join (select site_id, max(idx) as last from al group by 1) using(site_id) where win*30+364<=last group by 1,2),
  t3 as (select site_id, count(*) as n_windows, stddev_pop(slope)/avg(abs(slope)) as cv, covar_pop(abs(slope),x_mean)/(stddev_pop(slope)*stddev_pop(x_mean)) as cr from sl group by 1)"""
_T4 = f"""t4 as (select site_id, count(*) as n_obs, corr(tl,sl) as rho from (select site_id, avg(temperature) {_R30} as tl, avg(api) {_R30} as sl from ap) group by 1)"""
_S3 = "case when cv>=1 and abs(cr)>=0.4 then 'escalate' when cv>=0.5 then 'warn' else 'ok' end"
_S4 = "case when abs(rho)>=0.7 then 'escalate' when abs(rho)>=0.5 then 'warn' else 'ok' end"
_LABEL = "case when {s}>=0.75 then 'high' when {s}>=0.35 then 'moderate' when {s}>=0.1 then 'low' else 'very low' end"
_PE = "case when {p} between 0.3 and 3 then 'warn' when {p} between 0.1 and 10 then 'escalate' else 'safe' end"

ORACLE = {
    "rolling_zscore": with_ctes("dvv", "select site_id, ts as day, i as idx, round(z,7)+0.0 as z from zz", _z_ctes("dvv")),
    "transient_segments": with_ctes("dvv", """select site_id, onset_idx, end_idx, onset, end_day, duration_samples, round(amp,12) as peak_amplitude,
        round(pz,7) as peak_zscore, sign(pz)::bigint as sign from sg""", _z_ctes("dvv")),
    "autocorr_lags": with_ctes("dvv", "select site_id, n_obs, lag, round(rho,9)+0.0 as rho from ac", _ACF),
    "ljung_box": with_ctes("dvv", "select site_id, n_obs, round(q,6) as q, round(p,8) as p_value, p>=0.01 as white from lp", _ACF),
    "detect_anomalies": with_ctes("dvv", """select lp.site_id, n_obs, round(q,6) as q, round(p,8) as p_value, p>=0.01 as white, coalesce(nt,0) as n_transients,
        round(sd,10) as residual_std from lp join (select site_id, stddev_samp(dvv) as sd from dvv group by 1) using(site_id)
        left join (select site_id, count(*) as nt from sg group by 1) using(site_id)""", _z_ctes("dvv") + "," + _ACF),
    "lagged_xcorr": with_ctes("dvv forcing aligned", "select site_id, onset_idx, ch as channel, lag::bigint as lag, round(r,7)+0.0 as r from xb", _z_ctes("al") + "," + _XC),
    "attribute_anomaly": with_ctes("dvv forcing quakes aligned", """, ev as (select a.site_id, a.idx from quakes q join al a on a.site_id=q.site_id and a.ts=q.ts where magnitude>=6.7),
        br as (select site_id, onset_idx, max(abs(r)) as r from xb group by 1,2),
        bs as (select s.site_id, s.onset_idx, s.duration_samples as du, coalesce(r,0.0::double) as r, substr(s.site_id,1,1)::integer%2=0 as cw,
          exists(select 1 from ev where ev.site_id=s.site_id and abs(ev.idx-s.onset_idx)<=5) as qk from sg s left join br using(site_id,onset_idx)),
        b1 as (select *, case when r>=0.5 then least(r,1.0::double) else 0.0::double end as c1, case when cw then case when du>=60 then 0.7::double else 0.4::double end else 0.0::double end as c2,
          case when qk then 1.0::double else 0.0::double end as c3, case when du>=90 and r<0.5 and not qk then 0.7::double else 0.0::double end as c4 from bs),
        b2 as (select site_id, onset_idx, unnest([1,2,3,4,5]) as pos, unnest(['missing_forcing','coupling_residual','earthquake_response','slow_event','unmodeled']) as category,
          unnest([c1,c2,c3,c4,case when greatest(c1,c2,c3,c4)<0.3 then 0.5::double else 0.0::double end]) as score from b1)
        select site_id, onset_idx, row_number() over (partition by site_id, onset_idx order by score desc, pos) as rank, category, round(score,6) as score from b2""", _z_ctes("al") + "," + _XC),
    "rank_attribution": """with s as (select row_number() over () as id, unnest([1,2,3,4,5]) as pos, unnest(['missing_forcing','coupling_residual','earthquake_response','slow_event','unmodeled']) as category,
        unnest([l_discount*10, case when l_quantity>40 then 0.7::double else 0.4::double end, case when l_tax>0.06 then 1.0::double else 0.0::double end, case when l_quantity<5 then 0.7::double else 0.0::double end, 0.0::double]) as score, rid
        from (select *, row_number() over () as rid from lineitem)),
        r as (select *, row_number() over (partition by rid order by score desc, pos) as rank from s)
        select rank, category, count(*) as n_rows, round(sum(score),4)+0.0 as score from r group by 1,2""",
    "tier1_poroelastic": with_ctes("sites", f"""select site_id, round(pe,8) as peclet, round(be,6) as beta_eff, round(be/bd,8) as ratio, {_PE.format(p='pe')} as tier1_status,
        round(greatest(exp(-pow(log10(pe),2)), least(abs(be/bd-1)/0.5,1.0::double)),8) as tier1_score from (select *, per*c/(l*l) as pe, {_BETA.format(om='(2*pi()/per)')} as be from {_T1})"""),
    "drainage_peclet": with_ctes("sites", f"select site_id, round(per*c/(l*l),8) as peclet from {_T1}"),
    "beta_eff": with_ctes("sites", f"select site_id, round({_BETA.format(om='1e-6')},6) as beta_eff from {_T1}"),
    "escalation_level": f"select {_PE.format(p='(l_quantity*l_tax+0.005::double)')} as level, count(*) as n_rows from lineitem group by 1",
    "coupling_likelihood": f"""select p_partkey, round(s,8) as score, {_LABEL.format(s='s')} as label from (select p_partkey,
        greatest(exp(-pow(log10(p_retailprice/400.0::double),2)), least(abs(1+p_size/250.0::double-1)/0.5,1.0::double)) as s from part)""",
    "max_tier_score": f"""select {_LABEL.format(s='s')} as label, count(*) as n_rows, round(sum(s),6) as score from (select
        greatest(l_discount*4, coalesce(nullif(l_tax,0.03::double)*9,0.0::double), l_quantity/120.0::double, 0.0::double) as s from lineitem) group by 1""",
    "tidal_windows": with_ctes("hourly strain", 'select site_id, "window", n_rows, round(ratio,6) as ratio from tw', _TIDE),
    "tidal_ratio_summary": with_ctes("hourly strain", """select site_id, round(m,6) as beta_tidal, round(1.4826*median(abs(ratio-m)),6) as sigma from tw
        join (select site_id, median(ratio) as m from tw group by 1) using(site_id) group by site_id, m""", _TIDE),
    "tier2_split_window": with_ctes("dvv forcing aligned gw", """select site_id, n_pre, n_post, round(p1_pre,8)+0.0 as p1_pre, round(p1_post,8)+0.0 as p1_post,
        round(dr,5) as delta_relative, apart as non_overlap_2sigma from t2""", _SPLIT),
    "rolling_slope": with_ctes("dvv forcing aligned", 'select site_id, "window", centre, round(slope,8)+0.0 as slope, round(x_mean,8) as x_mean from sl', _T3),
    "tier3_saturation": with_ctes("dvv forcing aligned", f"""select site_id, n_windows, round(cv,6) as cv_slope, round(cr,6)+0.0 as corr_slope_api, {_S3} as tier3_status,
        round(least(cv,1.0::double),6) as tier3_score from t3 where n_windows>=4""", _T3),
    "tier4_thermo_capillary": with_ctes("dvv forcing aligned", f"""select site_id, n_obs, round(rho,7)+0.0 as rho, {_S4} as tier4_status, round(least(abs(rho)/0.7,1.0::double),7) as tier4_score
        from t4 where n_obs>=60""", _T3 + "," + _T4),
    "diagnose_all": with_ctes("dvv forcing aligned gw", f""", m2 as (select site_id, max(dr) as dr from t2 group by 1),
        jn as (select s.*, {_PE.format(p='pe')} as s1, greatest(exp(-pow(log10(pe),2)), least(abs(be/bd-1)/0.5,1.0::double)) as q1,
          case when dr>=1 then 'escalate' when dr>=0.3 then 'warn' when dr is not null then 'ok' end as s2, least(dr,1.0::double) as q2,
          case when t3.site_id is not null then {_S3} end as s3, least(cv,1.0::double) as q3,
          case when t4.site_id is not null then {_S4} end as s4, least(abs(rho)/0.7,1.0::double) as q4
          from (select *, per*c/(l*l) as pe, {_BETA.format(om='(2*pi()/per)')} as be from (select site_id, 365.25*86400.0::double as per, 200.0::double+900.0::double*k as l, 0.1::double as c,
            150.0::double+50.0::double*k as bd, 0.3::double+0.08::double*k as ab from (select distinct site_id, substr(site_id,1,1)::double as k from dvv))) s
          left join m2 using(site_id) left join t3 on t3.site_id=s.site_id and t3.n_windows>=4 left join t4 on t4.site_id=s.site_id and t4.n_obs>=60),
        js as (select *, greatest(coalesce(q1,0.0::double),coalesce(q2,0.0::double),coalesce(q3,0.0::double),coalesce(q4,0.0::double)) as sc from jn)
        select site_id, round(pe,6) as peclet, s1 as tier1_status, s2 as tier2_status, s3 as tier3_status, s4 as tier4_status,
          {"concat_ws(',', " + ", ".join(f"case when s{i}='warn' then 'tier{i}' end" for i in (1, 2, 3, 4)) + ")"} as warnings,
          {"concat_ws(',', " + ", ".join(f"case when s{i}='escalate' then 'tier{i}' end" for i in (1, 2, 3, 4)) + ")"} as escalations,
          {"concat_ws(',', " + ", ".join(f"case when s{i} is null then 'tier{i}' end" for i in (1, 2, 3, 4)) + ")"} as deferred,
          round(sc,5) as score, {_LABEL.format(s='sc')} as label, (s1='escalate' or coalesce(s2='escalate',false) or coalesce(s3='escalate',false) or coalesce(s4='escalate',false)) as escalate from js""",
        _SPLIT + "," + _T3 + "," + _T4),
}
