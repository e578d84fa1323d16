"""Queries: site configuration, layered models, interpretation, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions.exprs import day, eps_to_dvv, rnd, weaver_error
from tremorlake.operators import readiness as rd
from tremorlake.operators import sites as s
from tremorlake.plans import bindings as b
from tremorlake.plans.bindings import with_ctes

KEY = ["site_id"]


def _requests(spark, sf):
    return b.sites(spark, sf).select("site_id", F.lit("hydrological").alias("channel"), F.col("hydro_model").alias("model"))


def _select_models(spark, sf):
    return s.select_models(_requests(spark, sf)).select("site_id", "channel", "model", "canonical")


def _rejected(spark, sf):
    return s.rejected_models(_requests(spark, sf)).select("site_id", "channel", "model", "choices")


def _validate(spark, sf):
    return s.validate_sites(b.sites(spark, sf), b.site_layers(spark, sf)).select("site_id", "severity", "message")


def _prior(spark, sf):
    x = b.sites(spark, sf)
    return x.select("site_id", rnd(s.prior_log_density(F.col("balance") / 10, F.col("beta_mean"), F.col("beta_std")), 6).alias("log_density"))


def _moduli(spark, sf):
    m = s.moduli(b.site_layers(spark, sf))
    return m.select("site_id", "layer_idx", *[rnd(c, 8).alias(c) for c in ("top_km", "mid_km", "mu_gpa", "kappa_gpa")])


def _refine(spark, sf):
    out = s.refine_layers(b.site_layers(spark, sf), dz_km=0.03, max_depth_km=0.6)
    return out.select("site_id", "layer_idx", "sub_idx", *[rnd(c, 9).alias(c) for c in ("thickness_km", "vs")])


def _bands(spark, sf):
    return b.sites(spark, sf).select("site_id", F.explode(F.array("fmin", "fmax")).alias("frequency_hz"))


def _thumb(spark, sf):
    out = s.depth_rule_of_thumb(_bands(spark, sf), b.site_layers(spark, sf))
    return out.select("site_id", *[rnd(c, 8).alias(c) for c in ("frequency_hz", "peak_depth_km", "half_max_top_km", "half_max_bottom_km", "vs_at_peak", "rho_at_peak", "mu_gpa")])


def _kernel(spark, sf):
    p = b.table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("profile"), (F.col("p_size") / 10.0).alias("depth_km")).agg(F.avg("p_retailprice").alias("g"))


def _from_kernel(spark, sf):
    return s.depth_from_kernel(_kernel(spark, sf), ["profile"])


def _characterise(spark, sf):
    out = s.site_characterise(b.sites(spark, sf), b.site_layers(spark, sf))
    return out.select("site_id", rnd("frequency_hz", 8).alias("frequency_hz"), rnd("peak_depth_km", 8).alias("peak_depth_km"),
                      rnd(F.col("mu_pa") / 1e9, 8).alias("mu"), rnd(F.col("kappa_pa") / 1e9, 8).alias("kappa"))


def _peak_moduli(spark, sf):
    out = s.site_characterise(b.sites(spark, sf), b.site_layers(spark, sf)).select("site_id", "mu_pa", "kappa_pa")
    return out.join(b.sites(spark, sf), "site_id")


def _bridge(spark, sf):
    m = _peak_moduli(spark, sf).select("site_id", "mu_pa", "kappa_pa", (F.col("beta_mean") / 10).alias("mp"),
                                       F.col("balance").alias("p"), (F.abs("balance") / 50).alias("ps"))
    out = s.bridge(m, mu_prime="mp", kappa="kappa_pa", mu="mu_pa", pressure="p", pressure_std="ps")
    return out.select("site_id", rnd("beta", 6).alias("beta"), rnd(F.col("d_dvv_dp") * 1e9, 6).alias("d_dvv_dp"),
                      rnd("mu_prime_back", 8).alias("mu_prime_back"), rnd("stress_mean_pa", 4).alias("stress_mean_pa"), rnd("stress_std_pa", 6).alias("stress_std_pa"))


def _coef(spark, sf):
    units = F.element_at(F.array(*[F.lit(u) for u in ("fraction / Pa", "fraction / m water head", "fraction / m cumulative departure", "other")]), (F.col("site_id") % 4 + 1).cast("int"))
    return b.sites(spark, sf).select("site_id", F.lit("p1_dGWL").alias("param"), (-F.col("balance") / 7e6).alias("mean"),
                                     (F.sqrt(F.abs("balance") + 1.3) / 1e5).alias("std"), units.alias("units"))


def _fold(spark, sf):
    m = _peak_moduli(spark, sf).select("site_id", "mu_pa", "kappa_pa", "beta_mean", "beta_std")
    out = s.fold_priors(_coef(spark, sf).join(m, "site_id"))
    return out.select("site_id", rnd("beta_eff", 6).alias("beta_eff"), rnd("beta_eff_std", 6).alias("beta_eff_std"), rnd("mu_prime", 6).alias("mu_prime"),
                      rnd("mu_prime_std", 6).alias("mu_prime_std"), rnd(F.col("d_dvv_dp") * 1e12, 4).alias("d_dvv_dp"), rnd(F.col("d_dvv_dp_std") * 1e12, 4).alias("d_dvv_dp_std"))


def _closure(spark, sf):
    m = _peak_moduli(spark, sf).select("site_id", "mu_pa", "kappa_pa", (F.col("beta_mean") / 10).alias("mu_prime_mean"), (F.col("beta_std") / 10).alias("mu_prime_std"))
    out = s.bridge_closure(_coef(spark, sf), m, KEY)
    return out.select("site_id", *[rnd(F.col(c) / 1e3, 6).alias(c) for c in ("beta_data", "beta_data_std", "beta_prior", "beta_prior_std", "mu_prime_data", "mu_prime_data_std")], rnd("z_score", 6).alias("z_score"))


def _head(spark, sf):
    d = b.dvv_daily(spark, sf)
    k = F.substring("site_id", 1, 1).cast("double")
    coef = d.select("site_id").distinct().select("site_id", F.lit("p1_dGWL").alias("param"), ((k - 3) / 100).alias("mean"), (k / 1000).alias("std"))
    out = s.head_change(d, coef, KEY, value="dvv")
    return out.select("site_id", day(), rnd("head_change_m", 11).alias("head_change_m"), rnd("head_change_std_m", 11).alias("head_change_std_m"),
                      rnd(s.head_from_pressure(F.col("dvv") * 1e6), 8).alias("head_from_pressure_m"))


def _defaults(spark, sf):
    x = b.sites(spark, sf).select(
        "site_id", F.element_at(F.array(*[F.lit(p) for p in ("california_rock", "volcanic", "california_alluvium", "marsh")]), (F.col("site_id") % 4 + 1).cast("int")).alias("profile"),
        F.when(F.col("site_id") % 5 == 0, F.col("balance") / 10).alias("vs30_m_s"))
    return s.default_properties(x).select("site_id", "layer_idx", *[rnd(c, 8).alias(c) for c in ("thickness_km", "vp", "vs", "rho")], "confidence")


def _samples(spark, sf):
    p = b.table(spark, sf, "part").groupBy(F.col("p_brand").alias("site_id"), (F.col("p_size") * 25.0).alias("depth_m")).agg(
        (F.avg("p_retailprice") * 2).alias("vp"), F.avg("p_retailprice").alias("vs"), (F.count("*") / 10.0 + 1.5).alias("rho"))
    return s.layers_from_depth_samples(p).select("site_id", "layer_idx", *[rnd(c, 8).alias(c) for c in ("thickness_km", "vp", "vs", "rho")])


def _text_keys(spark, sf):
    d = b.table(spark, sf, "documents").select(
        F.concat(F.lit(" "), F.initcap("lang"), F.lit("-Soil "), F.col("source"), F.lit(" ")).alias("raw"))
    out = s.normalise_text_keys(d, "raw", "name", {"en_soil_web": "groundwater"})
    return out.groupBy("name").agg(F.count("*").alias("n_rows"))


def _weaver(spark, sf):
    li = b.table(spark, sf, "lineitem")
    e = weaver_error(F.col("l_discount") * 10, F.col("l_quantity") / 20.0, F.lit(2.0), F.lit(2.0) + F.col("l_linenumber"))
    return li.groupBy("l_linenumber").agg(rnd(F.avg(e) * 1e3, 8).alias("sigma"), F.count(e).alias("n_valid"))


def _eps(spark, sf):
    li = b.table(spark, sf, "lineitem")
    e = eps_to_dvv(F.col("l_tax") - F.col("l_discount") * 11)
    return li.groupBy("l_linenumber").agg(rnd(F.avg(e), 9).alias("dvv"), F.count(e).alias("n_valid"))


def _readiness(spark, sf):
    out = rd.readiness_report(b.inventory(spark, sf))
    return out.select("site_id", "goal", "status", F.concat_ws("; ", "missing_required").alias("missing"), F.concat_ws("; ", "next_data").alias("next_data"))


def _antijoin(spark, sf):
    return rd.missing_requirements(b.inventory(spark, sf)).select("site_id", "goal", "requirement")


QUERIES = {
    "select_models": _select_models,
    "rejected_models": _rejected,
    "validate_sites": _validate,
    "prior_log_density": _prior,
    "moduli": _moduli,
    "refine_layers": _refine,
    "depth_rule_of_thumb": _thumb,
    "depth_from_kernel": _from_kernel,
    "site_characterise": _characterise,
    "bridge": _bridge,
    "fold_priors": _fold,
    "bridge_closure": _closure,
    "head_change": _head,
    "default_properties": _defaults,
    "layers_from_depth_samples": _samples,
    "normalise_text_keys": _text_keys,
    "weaver_error": _weaver,
    "eps_to_dvv": _eps,
    "readiness_report": _readiness,
    "readiness_antijoin": _antijoin,
}

_MOD = """ml as materialized (select *, b-thickness_km as top_km, b-thickness_km/2 as mid_km, rho*vs*vs as mu, rho*(vp*vp-4.0*vs*vs/3.0) as kappa from
    (select *, sum(thickness_km) over (partition by site_id order by layer_idx) as b from layers))"""


def _iter(src: str) -> str:
    """Three rule-of-thumb iterations as nested nearest-layer lookups."""
    out = f"z0 as (select *, 0.5::double as z from {src})"
    for i in range(1, 5):
        out += f""",
    n{i} as (select q.*, m.vs as nvs, m.rho as nrho, m.mu as nmu, m.kappa as nkappa, row_number() over (partition by q.site_id, q.f order by abs(m.mid_km-q.z), m.layer_idx) as rn
      from z{i - 1} q join ml m using(site_id)),
    z{i} as materialized (select site_id, f, {'z' if i == 4 else 'nvs/(3.0*f)'} as z, nvs, nrho, nmu, nkappa from n{i} where rn=1)"""
        out = out.replace(f"select q.*, m.vs as nvs", "select q.site_id, q.f, q.z, m.vs as nvs")
    return out


_PK = _MOD + ", " + _iter("(select site_id, sqrt(fmin*fmax) as f from sites)") + ", pk as (select z4.site_id, f, z, nmu*1e9 as mu_pa, nkappa*1e9 as kappa_pa, sites.* exclude(site_id) from z4 join sites on sites.site_id=z4.site_id)"
_CF = """cf as (select site_id as sid, -balance/7e6 as mean, sqrt(abs(balance)+1.3)/1e5 as std, ['fraction / Pa','fraction / m water head','fraction / m cumulative departure','other'][site_id%4+1] as units from sites)"""
_PROF = """pf as (select * from (values """ + ", ".join(
    f"('{p}',{i}::bigint,{t}::double,{vp}::double,{vs}::double,{rho}::double)"
    for p, ls in s.DEFAULT_LAYERS.items() for i, (t, vp, vs, rho) in enumerate(ls)
) + ") t(profile,layer_idx,thickness_km,vp,vs,rho))"


def _tight(n, hi):
    return f"{n}_mean-3*{n}_std<0 or {n}_mean+3*{n}_std>{hi}"


ORACLE = {
    "select_models": with_ctes("sites", """select site_id, 'hydrological' as channel, hydro_model as model, case when hydro_model in ('baseflow','okubo2024','okubo_gwl') then 'baseflow'
        when hydro_model='roeloffs1988' then 'drained' when hydro_model='unknown_model' then null else hydro_model end as canonical from sites"""),
    "rejected_models": with_ctes("sites", """select site_id, 'hydrological' as channel, hydro_model as model, 'baseflow, cdm, drained, precomputed, talwani' as choices from sites where hydro_model='unknown_model'"""),
    "validate_sites": with_ctes("sites layers", "select distinct site_id, severity, message from (" + " union all ".join(
        f"select site_id, '{sev}' as severity, '{msg}' as message from {src} where {cond}" for src, sev, msg, cond in [
            ("sites", "error", "frequency band not ordered", "fmin>=fmax"), ("sites", "error", "no forcing channel enabled", "not hydro_enabled and not thermo_enabled"),
            ("sites", "error", "unknown hydrological model", "hydro_model='unknown_model'"), ("sites", "warning", "start date not before end date", "start_date>=end_date"),
            ("sites", "warning", "mcmc not available, wls is used", "uncertainty_method='mcmc'"), ("sites", "warning", "unknown uncertainty method", "uncertainty_method='abc'"),
            ("sites", "error", "prior std not positive", "least(porosity_std, skempton_std, biot_std)<=0"),
            ("sites", "error", "porosity prior outside (0, 0.6]", _tight("porosity", 0.6)), ("sites", "error", "skempton prior outside [0, 1.05]", _tight("skempton", 1.05)),
            ("sites", "error", "biot prior outside [0, 1.05]", _tight("biot", 1.05)), ("layers", "error", "vp/vs below sqrt(2)", "vp<=vs*sqrt(2.0::double)")]) + ")"),
    "prior_log_density": with_ctes("sites", "select site_id, round(-0.5*pow((balance/10-beta_mean)/beta_std,2),6)+0.0 as log_density from sites"),
    "moduli": with_ctes("layers", "select site_id, layer_idx, round(top_km,8)+0.0 as top_km, round(mid_km,8) as mid_km, round(mu,8) as mu_gpa, round(kappa,8)+0.0 as kappa_gpa from ml", _MOD),
    "refine_layers": with_ctes("layers", """select site_id, layer_idx, unnest(generate_series(1,n))::bigint as sub_idx, round(case when layer_idx=2 then thickness_km else h/n end,9) as thickness_km, round(vs,9) as vs
        from (select *, case when layer_idx=2 then 1 else greatest(ceil(h/0.03::double),1)::integer end as n from (select *, least(b,0.6::double)-top_km as h from ml where layer_idx=2 or top_km<0.6))""", _MOD),
    "depth_rule_of_thumb": with_ctes("sites layers", """select site_id, round(f,8) as frequency_hz, round(z,8) as peak_depth_km, round(z/2,8) as half_max_top_km, round(1.5*z,8) as half_max_bottom_km,
        round(nvs,8) as vs_at_peak, round(nrho,8) as rho_at_peak, round(nmu,8) as mu_gpa from z4""", _MOD + ", " + _iter("(select site_id, unnest([fmin,fmax]) as f from sites)")),
    "depth_from_kernel": """with k as (select p_brand as profile, p_size/10.0::double as z, avg(p_retailprice) as g from part group by 1,2),
        m as (select profile, max(g) as kk, max(z) as deep from k group by 1), p as (select m.*, (select min(z) from k where k.profile=m.profile and g=kk) as zp from m)
        select p.profile, zp as peak_depth_km, coalesce(max(case when g<kk/2 and z<zp then z end),0.0::double) as half_max_top_km,
        coalesce(min(case when g<kk/2 and z>zp then z end), max(deep)) as half_max_bottom_km from k join p on k.profile=p.profile group by 1,2""",
    "site_characterise": with_ctes("sites layers", "select site_id, round(f,8) as frequency_hz, round(z,8) as peak_depth_km, round(mu_pa/1e9,8) as mu, round(kappa_pa/1e9,8)+0.0 as kappa from pk", _PK),
    "bridge": with_ctes("sites layers", """select site_id, round(be,6)+0.0 as beta, round(be/kappa_pa*1e9,6)+0.0 as d_dvv_dp, round(-2*mu_pa*be/kappa_pa,8)+0.0 as mu_prime_back,
        round(balance,4)+0.0 as stress_mean_pa, round(abs(balance)/50,6)+0.0 as stress_std_pa from (select *, -(beta_mean/10)*kappa_pa/(2*mu_pa) as be from pk)""", _PK),
    "fold_priors": with_ctes("sites layers", """select site_id, round(beta_mean,6) as beta_eff, round(beta_std,6) as beta_eff_std, round(-(2*mu_pa/kappa_pa)*beta_mean,6)+0.0 as mu_prime,
        round(2*mu_pa/kappa_pa*beta_std,6)+0.0 as mu_prime_std, round(mean/kappa_pa*1e12,4)+0.0 as d_dvv_dp, round(std/kappa_pa*1e12,4)+0.0 as d_dvv_dp_std from pk join cf on sid=site_id""", _PK + ", " + _CF),
    "bridge_closure": with_ctes("sites layers", """select site_id, round(bd/1e3,6)+0.0 as beta_data, round(bs/1e3,6)+0.0 as beta_data_std, round(bp/1e3,6)+0.0 as beta_prior, round(ps/1e3,6)+0.0 as beta_prior_std,
        round(-2*mu_pa*(bd/3)/kappa_pa/1e3,6)+0.0 as mu_prime_data, round(2*mu_pa/kappa_pa*bs/3/1e3,6)+0.0 as mu_prime_data_std, round(case when bs*bs+ps*ps>0 then (bd-bp)/sqrt(bs*bs+ps*ps) end,6)+0.0 as z_score
        from (select *, mean/su as bd, abs(std/su) as bs, -3*(beta_mean/10)*kappa_pa/(2*mu_pa) as bp, abs(3*(beta_std/10)*kappa_pa/(2*mu_pa)) as ps from (select *,
        case units when 'fraction / Pa' then 1.0::double/(3*kappa_pa) when 'other' then null else 9810.0::double/(3*kappa_pa) end as su from pk join cf on sid=site_id))""", _PK + ", " + _CF),
    "head_change": with_ctes("dvv", """select site_id, ts as day, round(dvv/p1,11)+0.0 as head_change_m, round(abs(dvv/p1)*s1/abs(p1),11) as head_change_std_m, round(dvv*1e6/9810.0::double,8) as head_from_pressure_m
        from (select *, nullif((substr(site_id,1,1)::double-3)/100,0) as p1, substr(site_id,1,1)::double/1000 as s1 from dvv)"""),
    "default_properties": with_ctes("sites", """, q as (select *, coalesce(v30>0,false) as hv from (select site_id, ['california_rock','volcanic','california_alluvium','marsh'][site_id%4+1] as pr, case when site_id%5=0 then balance/10 end as v30 from sites)),
        r as (select q.*, case when hv or pr='marsh' then 'california_alluvium' else pr end as profile from q),
        t as (select *, hv and layer_idx=0 as top, greatest(1.85::double*v30/1000,1.05*sqrt(2.0::double)*v30/1000) as tvp from r join pf using(profile))
        select site_id, layer_idx, round(thickness_km,8) as thickness_km, round(case when top then tvp else vp end,8) as vp, round(case when top then v30/1000 else vs end,8) as vs,
        round(case when top then greatest(least(1.74::double*pow(tvp,0.25),3.1::double),1.6::double) else rho end,8) as rho, case when hv then 'medium' else 'low' end as confidence from t""", _PROF),
    "layers_from_depth_samples": """with p as (select p_brand as site_id, p_size*25.0::double as z, avg(p_retailprice)*2 as vp, avg(p_retailprice) as vs, count(*)/10.0::double+1.5::double as rho from part group by 1,2)
        select site_id, row_number() over w-1 as layer_idx, round(coalesce((lead(z) over w-z)/1000,50.0::double),8) as thickness_km, round(case when vp>20 then vp/1000 else vp end,8) as vp,
        round(case when vs>20 then vs/1000 else vs end,8) as vs, round(case when rho>20 then rho/1000 else rho end,8) as rho from p window w as (partition by site_id order by z)""",
    "normalise_text_keys": """select case when n='en_soil_web' then 'groundwater' else n end as name, count(*) as n_rows from (select replace(replace(lower(trim(' '||lang||'-Soil '||source||' ')),'-','_'),' ','_') as n from documents) group by 1""",
    "weaver_error": """select l_linenumber, round(avg(e)*1e3,8) as sigma, count(e) as n_valid from (select l_linenumber, case when cc>0 and cc<=1 then
        sqrt((1-cc*cc)/(2*cc*cc)*6*sqrt(pi()/2)/(pow(2*pi()*fr,2)*(pow(t2,3)-8))) end as e from (select l_linenumber, l_discount*10 as cc, l_quantity/20.0::double as fr, 2.0::double+l_linenumber as t2 from lineitem)) group by 1""",
    "eps_to_dvv": """select l_linenumber, round(avg(case when e>-1 then -e/(1+e) end),9)+0.0 as dvv, count(case when e>-1 then 1 end) as n_valid from (select l_linenumber, l_tax-l_discount*11 as e from lineitem) group by 1""",
}


def _rules(items) -> str:
    return ", ".join(
        f"('{g}','{text}',{i},'{name}')" for g, rules in items for i, (text, group) in enumerate(rules) for name in (group or ("*",))
    )


_INV = "iv as materialized (select distinct site_id, replace(replace(lower(trim(input_name)),'-','_'),' ','_') as name from inventory)"
_RULES = f"""rq as (select * from (values {_rules(rd.REQUIRED.items())}) t(goal,txt,pos,name)),
  nx as (select * from (values {_rules(rd.NEXT.items())}) t(goal,txt,pos,name)),
  st as (select distinct site_id from iv),
  ms as materialized (select st.site_id, r.goal, r.txt, r.pos from st, (select distinct goal, txt, pos from rq) r where not exists
    (select 1 from rq join iv on iv.name=rq.name where rq.goal=r.goal and rq.txt=r.txt and iv.site_id=st.site_id))"""
_FAM = "(" + "+".join(
    "(case when exists(select 1 from iv where iv.site_id=st.site_id and name in (" + ",".join(f"'{n}'" for n in g) + ")) then 1 else 0 end)" for g in rd.FAMILIES
) + ")"
ORACLE["readiness_antijoin"] = with_ctes("inventory", "select site_id, goal, txt as requirement from ms", _INV + "," + _RULES)
ORACLE["readiness_report"] = with_ctes("inventory", f""", m2 as (select * from ms union all select site_id, 'coupling', '{rd.TWO_FAMILIES}', 99 from st where {_FAM}<2),
  n2 as (select st.site_id, r.goal, r.txt, r.pos from st, (select distinct goal, txt, pos from nx) r where not exists
    (select 1 from nx join iv on iv.name=nx.name where nx.goal=r.goal and nx.txt=r.txt and iv.site_id=st.site_id)),
  gl as (select site_id, goal from st, (select unnest(['groundwater','stress','coupling']) as goal))
  select gl.site_id, gl.goal, case when exists(select 1 from m2 where m2.site_id=gl.site_id and m2.goal=gl.goal) then 'missing data' else 'ready' end as status,
  coalesce((select string_agg(txt,'; ' order by pos) from m2 where m2.site_id=gl.site_id and m2.goal=gl.goal),'') as missing,
  coalesce((select string_agg(txt,'; ' order by pos) from n2 where n2.site_id=gl.site_id and n2.goal=gl.goal),'') as next_data from gl""", _INV + "," + _RULES)
