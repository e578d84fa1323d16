"""Views of the shared test tables in the shapes the operators expect.

``orders`` gives one dv/v series per order priority, ``lineitem`` the forcings,
``events`` sub-daily series, ``supplier`` the sites, ``embeddings`` waveforms.
Each view has a matching SQL common table expression in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorlake.operators.scan import micros
from tremorlake.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str):
    return F.to_date(c).cast("timestamp")


def dvv_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, ts, dvv, dvv_err, cc: one row per site and day with data."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("site_id"), _day("o_orderdate").alias("ts")
    ).agg(
        (F.avg("o_totalprice") / F.lit(1e6)).alias("dvv"),
        (F.lit(1e-3) * (1 + F.count("*") % 3)).alias("dvv_err"),
        (F.avg(F.col("o_custkey") % 100) / 100.0).alias("cc"),
    )


def forcing_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, channel, ts, value: daily precipitation and temperature."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_quantity", "l_discount"
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    daily = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("o_orderpriority").alias("site_id"), _day("l_shipdate").alias("ts"))
        .agg(
            (F.sum("l_quantity") / 1e4).alias("precipitation"),
            (15.0 + 100.0 * F.avg("l_discount")).alias("temperature"),
        )
    )
    return daily.unpivot(
        ["site_id", "ts"], ["precipitation", "temperature"], "channel", "value"
    )


def dvv_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, ts, dvv: hourly means per event type, gaps kept."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.col("event_type").alias("site_id"),
        F.date_trunc("hour", "ts").cast("timestamp").alias("ts"),
    ).agg(F.avg("value").alias("dvv"))


def strain_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, ts, value: hourly strain proxy on its own half-past-the-hour clock."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.col("event_type").alias("site_id"),
        (F.date_trunc("hour", "ts").cast("timestamp") + F.expr("interval 30 minutes")).alias("ts"),
    ).agg((F.sum(F.col("user_id") % 17) / F.count("*")).alias("value"))


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, latitude, longitude, depth_km, magnitude."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        _day("o_orderdate").alias("ts"),
        (30 + F.col("o_custkey") % 1000 / 100.0).alias("latitude"),
        (-120 + F.col("o_custkey") % 700 / 100.0).alias("longitude"),
        F.lit(None).cast("double").alias("depth_km"),
        (3 + F.col("o_orderkey") % 40 / 10.0).alias("magnitude"),
        F.col("o_orderpriority").alias("site_id"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier with location, band, priors and settings."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("site_id"),
        (30 + k * 37 % 1000 / 100.0).alias("latitude"),
        (-120 + k * 53 % 700 / 100.0).alias("longitude"),
        (0.3 + k % 7 / 10.0).alias("fmin"),
        (0.9 + k % 7 / 5.0).alias("fmax"),
        (0.02 + k % 10 / 50.0).alias("porosity_mean"),
        (0.01 + k % 5 / 100.0).alias("porosity_std"),
        (0.5 + k % 6 / 10.0).alias("skempton_mean"),
        (0.02 + k % 4 / 50.0).alias("skempton_std"),
        (0.6 + k % 5 / 10.0).alias("biot_mean"),
        (0.02 + k % 3 / 50.0).alias("biot_std"),
        (-3.0 + k % 9 / 4.0).alias("log10_diffusivity"),
        (100.0 + k % 13 * 250.0).alias("beta_mean"),
        (20.0 + k % 3 * 30.0).alias("beta_std"),
        F.element_at(
            F.array(*[F.lit(m) for m in ("baseflow", "okubo2024", "talwani", "roeloffs1988", "cdm", "unknown_model")]),
            (k % 6 + 1).cast("int"),
        ).alias("hydro_model"),
        F.element_at(
            F.array(*[F.lit(m) for m in ("wls", "mcmc", "abc")]), (k % 3 + 1).cast("int")
        ).alias("uncertainty_method"),
        (k % 4 > 0).alias("hydro_enabled"),
        (k % 5 > 2).alias("thermo_enabled"),
        F.date_add(F.lit("2000-01-01").cast("date"), (k % 50).cast("int")).alias("start_date"),
        F.date_add(F.lit("2000-01-20").cast("date"), (k % 41).cast("int")).alias("end_date"),
        F.col("s_acctbal").alias("balance"),
        F.col("s_nationkey").alias("nation"),
    )


def site_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, layer_idx, thickness_km, vp, vs, rho: three layers per site."""
    s = table(spark, sf_dir, "supplier")
    k, i = F.col("s_suppkey"), F.col("layer_idx")
    vs = 0.4 + i * 0.7 + k % 11 / 20.0
    return s.select(k, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("layer_idx")).select(
        k.alias("site_id"),
        F.col("layer_idx").cast("long").alias("layer_idx"),
        F.when(i == 2, 30.0).otherwise(0.1 + i * 0.3 + k % 6 / 50.0).alias("thickness_km"),
        (vs * (1.3 + k % 5 / 10.0)).alias("vp"),
        vs.alias("vs"),
        (1.9 + i * 0.25 + k % 4 / 40.0).alias("rho"),
    )


def ccf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, component, day (0-based position), ccf array of 64 lags."""
    from tremorlake.operators.scan import with_row_index

    e = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("pair"), F.col("label").cast("string")).alias("pair_id"),
        F.lit("ZZ").alias("component"),
        "vec_id",
        F.col("embedding").alias("ccf"),
    )
    return (
        with_row_index(
            e, ["pair_id", "component"], ["vec_id"], "day",
            chunk=F.floor(F.col("vec_id") / 4096).cast("long"), hot=True,
        )
        .drop("vec_id")
    )


def component_dvv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, component, ts, dvv, cc, sigma: several components per pair."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("pair_id"),
        F.col("o_orderstatus").alias("component"),
        _day("o_orderdate").alias("ts"),
    ).agg(
        (F.avg("o_totalprice") / 1e6).alias("dvv"),
        (F.avg(F.col("o_orderkey") % 100) / 100.0 - 0.1).alias("cc"),
        (F.lit(5e-3) * (1 + F.max("o_custkey") % 5)).alias("sigma"),
    )


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, estimator, band_idx, stack, rms, drop_err, ok."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("case_id"),
        F.col("l_linestatus").alias("estimator"),
        F.col("l_linenumber").cast("long").alias("band_idx"),
        (F.col("l_suppkey") % 3).alias("stack"),
    ).agg(
        F.avg(F.col("l_discount") * F.col("l_tax")).alias("rms"),
        F.avg(F.col("l_quantity") * F.col("l_discount")).alias("drop_err"),
        (F.max("l_partkey") % 5 > 0).alias("ok"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, input_name: which inputs a site has (from user event types)."""
    e = table(spark, sf_dir, "events")
    names = [
        "dvv", "datetime_index", "dvv_err", "site_config", "measurement_frequency_band",
        "velocity_model", "material_property_priors", "precipitation", "gwl",
        "temperature", "swe", "earthquake_catalog", "GNSS ", "correlation-coefficient",
    ]
    return e.select(
        F.col("user_id").alias("site_id"),
        F.element_at(
            F.array(*[F.lit(n) for n in names]),
            (F.when(F.col("value") > 12, F.col("event_id") % len(names))
             .otherwise(F.col("event_id") % 7) + 1).cast("int"),
        ).alias("input_name"),
    ).distinct()


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dv/v with both forcings on its epochs; complete rows only."""
    from tremorlake.operators.align import align_forcings

    return align_forcings(
        dvv_daily(spark, sf_dir), forcing_long(spark, sf_dir), ["precipitation", "temperature"]
    ).na.drop(subset=["precipitation", "temperature"])


def dvv_by_day_number(df: DataFrame) -> DataFrame:
    """Adds ``d`` = whole days since 1970."""
    return df.withColumn("d", F.floor(micros("ts") / 86_400_000_000).cast("long"))


# SQL twins of the views above, used by the correctness check.
CTE = {
    "dvv": """dvv as (select o_orderpriority as site_id, cast(o_orderdate as date) as ts,
      avg(o_totalprice)/1e6 as dvv, 1e-3*(1+count(*)%3) as dvv_err, avg(o_custkey%100)/100 as cc
      from orders group by 1,2)""",
    "forcing": """fw as (select o_orderpriority as site_id, cast(l_shipdate as date) as ts,
      sum(l_quantity)/1e4 as precipitation, 15.0::double+100.0::double*avg(l_discount) as temperature
      from lineitem join orders on l_orderkey=o_orderkey group by 1,2)""",
    "hourly": """hourly as (select event_type as site_id, date_trunc('hour', ts) as ts, avg(value) as dvv
      from events group by 1,2)""",
    "strain": """strain as (select event_type as site_id, date_trunc('hour', ts)+interval 30 minute as ts,
      sum(user_id%17)::double/count(*) as value from events group by 1,2)""",
    "quakes": """quakes as (select o_orderkey as event_id, cast(o_orderdate as date) as ts,
      30+o_custkey%1000/100.0::double as latitude, -120+o_custkey%700/100.0::double as longitude,
      3+o_orderkey%40/10.0::double as magnitude, o_orderpriority as site_id from orders)""",
    "sites": """sites as (select s_suppkey as site_id, 30+s_suppkey*37%1000/100.0::double as latitude,
      -120+s_suppkey*53%700/100.0::double as longitude, 0.3::double+s_suppkey%7/10.0::double as fmin,
      0.9::double+s_suppkey%7/5.0::double as fmax,
      0.02::double+s_suppkey%10/50.0::double as porosity_mean, 0.01::double+s_suppkey%5/100.0::double as porosity_std,
      0.5::double+s_suppkey%6/10.0::double as skempton_mean, 0.02::double+s_suppkey%4/50.0::double as skempton_std,
      0.6::double+s_suppkey%5/10.0::double as biot_mean, 0.02::double+s_suppkey%3/50.0::double as biot_std,
      -3.0::double+s_suppkey%9/4.0::double as log10_diffusivity, 100.0::double+s_suppkey%13*250.0::double as beta_mean,
      20.0::double+s_suppkey%3*30.0::double as beta_std,
      ['baseflow','okubo2024','talwani','roeloffs1988','cdm','unknown_model'][s_suppkey%6+1] as hydro_model,
      ['wls','mcmc','abc'][s_suppkey%3+1] as uncertainty_method,
      s_suppkey%4>0 as hydro_enabled, s_suppkey%5>2 as thermo_enabled,
      date '2000-01-01'+cast(s_suppkey%50 as integer) as start_date, date '2000-01-20'+cast(s_suppkey%41 as integer) as end_date,
      s_acctbal as balance, s_nationkey as nation from supplier)""",
    "layers": """layers as (select s_suppkey as site_id, i::bigint as layer_idx,
      case when i=2 then 30.0::double else 0.1::double+i*0.3::double+s_suppkey%6/50.0::double end as thickness_km,
      (0.4::double+i*0.7::double+s_suppkey%11/20.0::double)*(1.3::double+s_suppkey%5/10.0::double) as vp,
      0.4::double+i*0.7::double+s_suppkey%11/20.0::double as vs,
      1.9::double+i*0.25::double+s_suppkey%4/40.0::double as rho
      from supplier, (select unnest([0,1,2]) as i))""",
    "ccf": """ccf as (select 'pair'||label::varchar as pair_id, 'ZZ' as component,
      row_number() over (partition by label order by vec_id)-1 as day, embedding as ccf from embeddings)""",
    "component": """component as (select o_orderpriority as pair_id, o_orderstatus as component,
      cast(o_orderdate as date) as ts, avg(o_totalprice)/1e6 as dvv,
      avg(o_orderkey%100)/100-0.1::double as cc, 5e-3*(1+max(o_custkey)%5) as sigma
      from orders group by 1,2,3)""",
    "sweep": """sweep as (select l_returnflag as case_id, l_linestatus as estimator,
      l_linenumber::bigint as band_idx, l_suppkey%3 as stack, avg(l_discount*l_tax) as rms,
      avg(l_quantity*l_discount) as drop_err, max(l_partkey)%5>0 as ok from lineitem group by 1,2,3,4)""",
    "inventory": """inventory as (select distinct user_id as site_id,
      ['dvv','datetime_index','dvv_err','site_config','measurement_frequency_band','velocity_model',
       'material_property_priors','precipitation','gwl','temperature','swe','earthquake_catalog','GNSS ',
       'correlation-coefficient'][(case when value>12 then event_id%14 else event_id%7 end)+1] as input_name
      from events)""",
}

# forcing bins as wide as the median dv/v spacing, anchored at the first epoch
BINNED = """gr as (select site_id, min(ts) as t0, floor(quantile_cont(gap,0.5)*86400) as st from (select site_id, ts,
    (ts-lag(ts) over (partition by site_id order by ts))::double as gap from dvv) group by 1),
  bb as (select f.site_id, floor((f.ts-t0)*86400/st)::bigint as k, sum(precipitation) as ps, avg(temperature) as tm from fw f join gr using(site_id) group by 1,2),
  be as (select site_id, min(k) as k0, max(k) as k1 from bb group by 1),
  dk as (select d.site_id, d.ts, case when ((d.ts-t0)*86400)::double%st=0 then floor((d.ts-t0)*86400/st)::bigint end as k from dvv d join gr using(site_id)),
  binned as materialized (select dk.site_id, dk.ts, coalesce(ps, case when dk.k between k0 and k1 then 0.0::double end) as ps, tm
    from dk left join be using(site_id) left join bb on bb.site_id=dk.site_id and bb.k=dk.k)"""
CTE["aligned"] = BINNED + """,
  nb as (select d.site_id, d.ts,
    (select max(ts) from fw f where f.site_id=d.site_id and f.ts<=d.ts) as p,
    (select min(ts) from fw f where f.site_id=d.site_id and f.ts>=d.ts) as n from dvv d),
  bp as materialized (select * from binned),
  al0 as (select nb.site_id, nb.ts, d.dvv, d.dvv_err, d.cc,
    f.ps as precipitation,
    case when p is null then null when n is null then a.temperature when p=n then a.temperature
      else a.temperature+(c.temperature-a.temperature)*((nb.ts-p)::double/(n-p)::double) end as temperature
    from nb join dvv d on d.site_id=nb.site_id and d.ts=nb.ts join bp f on f.site_id=nb.site_id and f.ts=nb.ts
    left join fw a on a.site_id=nb.site_id and a.ts=nb.p left join fw c on c.site_id=nb.site_id and c.ts=nb.n),
  al as materialized (select *, row_number() over (partition by site_id order by ts)-1 as idx from al0
    where precipitation is not null and temperature is not null)"""
CTE["gw"] = """gw as materialized (select a.site_id, a.ts,
    sum(b.precipitation/0.05::double*exp(-(a.ts-b.ts)/180.0::double)) as r
    from al a join al b on a.site_id=b.site_id and b.ts<=a.ts group by 1,2)"""
CTE["tlag"] = """tl as materialized (select x.site_id, x.ts,
    case when p is null or n is null then 0.0::double when p=n then pv-mu
      else pv+(nv-pv)*((x.s-p)::double/(n-p)::double)-mu end as t_lag
    from (select t.*, a.temperature as pv, c.temperature as nv from (
      select d.site_id, d.ts, d.ts-50 as s,
      (select max(ts) from al f where f.site_id=d.site_id and f.ts<=d.ts-50) as p,
      (select min(ts) from al f where f.site_id=d.site_id and f.ts>=d.ts-50) as n from al d) t
      left join al a on a.site_id=t.site_id and a.ts=t.p left join al c on c.site_id=t.site_id and c.ts=t.n) x
    join (select site_id, avg(temperature) as mu from al group by 1) m using(site_id))"""
CTE["design"] = """ds as materialized (select al.*, gw.r-avg(gw.r) over (partition by al.site_id) as p1, tl.t_lag as p2
    from al join gw using(site_id,ts) join tl using(site_id,ts))"""
DESIGN = "dvv forcing aligned gw tlag design"


def solve3_sql(name: str, rows: str, keys: str, d: str, x: tuple[str, str, str], w: str) -> str:
    """CTE ``name``: 3-parameter weighted fit by cofactors, with the p1 <= 0 rule.

    Columns: keys, n, x0..x2 (unbounded), v0..v2 (variances), y0..y2 (bounded), dd.
    """
    a, b, c = x
    return f"""{name}_s as (select {keys}, count(*) as n, sum({w}*({a})*({a})) as s00, sum({w}*({a})*({b})) as s01,
      sum({w}*({a})*({c})) as s02, sum({w}*({b})*({b})) as s11, sum({w}*({b})*({c})) as s12, sum({w}*({c})*({c})) as s22,
      sum({w}*({a})*{d}) as b0, sum({w}*({b})*{d}) as b1, sum({w}*({c})*{d}) as b2, sum({w}*{d}*{d}) as dd from {rows} group by {keys}),
    {name}_c as (select *, s11*s22-s12*s12 as c00, s02*s12-s01*s22 as c01, s01*s12-s02*s11 as c02,
      s00*s22-s02*s02 as c11, s01*s02-s00*s12 as c12, s00*s11-s01*s01 as c22 from {name}_s),
    {name}_x as (select *, s00*c00+s01*c01+s02*c02 as det from {name}_c),
    {name}_u as (select *, (c00*b0+c01*b1+c02*b2)/det as x0, (c01*b0+c11*b1+c12*b2)/det as x1,
      (c02*b0+c12*b1+c22*b2)/det as x2, c00/det as v0, c11/det as v1, c22/det as v2 from {name}_x),
    {name} as (select *, case when x1>0 then (b0*s22-b2*s02)/c11 else x0 end as y0,
      case when x1>0 then 0.0::double else x1 end as y1,
      case when x1>0 then (b2*s00-b0*s02)/c11 else x2 end as y2 from {name}_u)"""


def with_ctes(names: str, body: str, extra: str = "") -> str:
    """``with <ctes> [, extra] <body>`` for a space-separated list of view names."""
    parts = [CTE[n] for n in names.split()]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return "with " + ",\n".join(parts) + "\n" + body.strip()
