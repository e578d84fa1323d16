"""Queries: joins and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions.exprs import day, rnd
from tremorlake.operators import align as a
from tremorlake.operators.scan import with_row_index
from tremorlake.plans import bindings as b
from tremorlake.plans.bindings import BINNED, with_ctes

KEY = ["site_id"]


def _near(spark, sf):
    quakes = b.quakes(spark, sf).withColumns({"day": day(), "rounded": rnd("magnitude", 6)})  # once an event, not once a pair
    out = a.events_near_sites(quakes, b.sites(spark, sf), radius_km=60.0, min_magnitude=5.0, digits=6)
    return out.select("site_id", "event_id", "day", F.col("rounded").alias("magnitude"), (F.col("distance_km") + F.lit(0.0)).alias("distance_km"))


def _source(spark, sf, channel):
    return b.forcing_long(spark, sf).where(F.col("channel") == channel).drop("channel")


def _interp(fn, channel="temperature", **kw):
    def run(spark, sf):
        out = fn(b.dvv_daily(spark, sf).select("site_id", "ts"), _source(spark, sf, channel), KEY, **kw)
        return out.select("site_id", day(), rnd("value", 9).alias("value"))

    return run


def _tolerance(spark, sf):
    out = a.asof_nearest_tolerance(
        b.dvv_hourly(spark, sf).select("site_id", "ts"), b.strain_hourly(spark, sf), KEY
    )
    return out.select("site_id", F.unix_seconds("ts").alias("t"), rnd("value", 9).alias("value"))


def _align(spark, sf):
    out = a.align_forcings(
        b.dvv_daily(spark, sf), b.forcing_long(spark, sf), ["precipitation", "temperature"]
    )
    return out.select(
        "site_id", day(), rnd("dvv", 12).alias("dvv"),
        rnd("precipitation", 9).alias("precipitation"), rnd("temperature", 9).alias("temperature"),
    )


def _lag(spark, sf):
    t = b.dvv_daily(spark, sf).select("site_id", "ts")
    out = a.lag_join(t, _source(spark, sf, "temperature"), KEY, shift_days=F.lit(50), value="value", out="t_lag")
    return out.select("site_id", day(), rnd("t_lag", 9).alias("t_lag"))


def _nearest_layer(spark, sf):
    p = b.sites(spark, sf).select("site_id", (F.col("site_id") % 10 / 10.0).alias("depth_km"))
    return a.nearest_layer(p, b.site_layers(spark, sf), depth="depth_km").select(
        "site_id", "layer_idx", rnd("mid_km", 9).alias("mid_km"), rnd("vs", 9).alias("vs")
    )


def _grid_cell(spark, sf):
    st = b.sites(spark, sf).select("site_id", "latitude", "longitude")
    cells = b.table(spark, sf, "customer").select(
        (29.5 + F.col("c_custkey") % 30 * 0.37).alias("latitude"),
        (-120.3 + F.col("c_custkey") % 23 * 0.31).alias("longitude"),
    )
    return a.nearest_grid_cell(st, cells).select(
        "site_id", rnd("cell_latitude", 6).alias("cell_latitude"), rnd("cell_longitude", 6).alias("cell_longitude")
    )


def _cross(spark, sf):
    cases = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("case_id"), F.col("p_type").alias("use_case")
    )
    configs = (
        b.table(spark, sf, "part").groupBy(F.col("p_type").alias("use_case"), "p_size")
        .agg(F.min("p_retailprice").alias("stack"))
        .select("use_case", F.col("p_size").cast("long").alias("config_index"), "stack")
    )
    out = a.case_config_cross(cases, configs)
    return out.groupBy("use_case", "case_id").agg(
        F.count("*").alias("n_cells"), rnd(F.sum("stack"), 2).alias("stack_sum")
    )


def _onset(spark, sf):
    d = with_row_index(b.dvv_daily(spark, sf), KEY, ["ts"])
    seg = d.where(F.col("dvv") > 0.42).select("site_id", F.col("idx").alias("onset_idx"))
    big = b.quakes(spark, sf).where(F.col("magnitude") >= 6.5).select("site_id", "ts")
    ev = big.join(d.select("site_id", "ts", "idx"), ["site_id", "ts"])
    return a.event_onset_match(seg, ev, KEY)


def _provider(spark, sf):
    o = b.table(spark, sf, "orders")
    k = F.col("site_id")
    c = o.select(
        F.col("o_custkey").alias("site_id"),
        F.element_at(F.array(F.lit("ucvm"), F.lit("usgs_vs30"), F.lit("default")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("provider"),
    ).distinct()
    c = c.select(
        "*",
        F.when(F.col("provider") == "ucvm", k % 4 == 0).when(F.col("provider") == "usgs_vs30", k % 3 == 0).otherwise(F.lit(True)).alias("resolved"),
        F.concat(F.lit("no data for "), k.cast("string")).alias("reason"),
    )
    out = a.provider_fallback(c, ["ucvm", "usgs_vs30", "default"])
    return out.select("site_id", "source", F.concat_ws(" | ", "warnings").alias("warnings"))


def _pairs(spark, sf):
    out = a.epoch_pair_join(b.dvv_daily(spark, sf), KEY, max_lag=5)
    return out.select("site_id", "i", "j", rnd("rel", 12).alias("rel"), rnd("sigma", 12).alias("sigma"))


def _union_index(spark, sf):
    t = b.dvv_daily(spark, sf).select("site_id", "ts")
    s = _source(spark, sf, "temperature").select("site_id", "ts")
    return t.unionByName(s).distinct().select("site_id", day())


QUERIES = {
    "events_near_sites": _near,
    "interp_linear": _interp(a.interp_linear),
    "interp_nearest": _interp(a.interp_nearest),
    "asof_ffill": _interp(a.asof_ffill),
    "asof_nearest_tolerance": _tolerance,
    "bin_aggregate": _interp(a.bin_aggregate, "precipitation"),
    "bin_aggregate_mean": _interp(a.bin_aggregate, "temperature", aggregation="mean"),
    "align_forcings": _align,
    "lag_join": _lag,
    "nearest_layer": _nearest_layer,
    "nearest_grid_cell": _grid_cell,
    "case_config_cross": _cross,
    "event_onset_match": _onset,
    "provider_fallback": _provider,
    "epoch_pair_join": _pairs,
    "union_index": _union_index,
}

_BOTH = """nb as (select d.site_id, d.ts,
    (select max(ts) from fw f where f.site_id=d.site_id and f.ts<=d.ts) as p,
    (select min(ts) from fw f where f.site_id=d.site_id and f.ts>=d.ts) as n from dvv d),
  nv as (select nb.*, a.temperature as pv, c.temperature as nv from nb
    left join fw a on a.site_id=nb.site_id and a.ts=nb.p left join fw c on c.site_id=nb.site_id and c.ts=nb.n)"""
_LIN = "case when p is null then null when n is null then pv when p=n then pv else pv+(nv-pv)*((ts-p)::double/(n-p)::double) end"
ORACLE = {
    "events_near_sites": with_ctes("quakes sites", """select * from (select s.site_id, q.event_id, q.ts as day, round(q.magnitude,6) as magnitude,
        round(2*6371.0::double*asin(sqrt(pow(sin(radians(q.latitude-s.latitude)/2),2)+cos(radians(s.latitude))*cos(radians(q.latitude))
        *pow(sin(radians(q.longitude-s.longitude)/2),2))),6) as distance_km
        from quakes q, sites s where q.magnitude>=5.0) where distance_km<=60"""),
    "interp_linear": with_ctes("dvv forcing", f"select site_id, ts as day, round({_LIN},9) as value from nv", _BOTH),
    "interp_nearest": with_ctes("dvv forcing", """select site_id, ts as day, round(case when p is null or n is null then null
        when ts-p<=n-ts then pv else nv end,9) as value from nv""", _BOTH),
    "asof_ffill": with_ctes("dvv forcing", """select d.site_id, d.ts as day, round(f.temperature,9) as value
        from dvv d asof left join fw f on d.site_id=f.site_id and d.ts>=f.ts"""),
    "asof_nearest_tolerance": with_ctes("hourly strain", """select h.site_id, epoch(h.ts)::bigint as t,
        round(coalesce(n.value,p.value),9) as value from hourly h
        left join strain n on n.site_id=h.site_id and n.ts=h.ts+interval 30 minute
        left join strain p on p.site_id=h.site_id and p.ts=h.ts-interval 30 minute"""),
    "bin_aggregate": with_ctes("dvv forcing", "select site_id, ts as day, round(ps,9) as value from binned", BINNED),
    "bin_aggregate_mean": with_ctes("dvv forcing", "select site_id, ts as day, round(tm,9) as value from binned", BINNED),
    "align_forcings": with_ctes("dvv forcing", f"""select nv.site_id, nv.ts as day, round(d.dvv,12) as dvv,
        round(b.ps,9) as precipitation, round({_LIN.replace('(ts-p)', '(nv.ts-p)')},9) as temperature
        from nv join dvv d on d.site_id=nv.site_id and d.ts=nv.ts join binned b on b.site_id=nv.site_id and b.ts=nv.ts""", _BOTH + "," + BINNED),
    "lag_join": with_ctes("dvv forcing", """select x.site_id, x.ts as day,
        round(case when p is null or n is null then 0.0::double when p=n then pv-mu else pv+(nv-pv)*((x.s-p)::double/(n-p)::double)-mu end,9) as t_lag
        from (select t.*, a.temperature as pv, c.temperature as nv from (
          select d.site_id, d.ts, d.ts-50 as s,
          (select max(ts) from fw f where f.site_id=d.site_id and f.ts<=d.ts-50) as p,
          (select min(ts) from fw f where f.site_id=d.site_id and f.ts>=d.ts-50) as n from dvv d) t
          left join fw a on a.site_id=t.site_id and a.ts=t.p left join fw c on c.site_id=t.site_id and c.ts=t.n) x
        join (select site_id, avg(temperature) as mu from fw group by 1) m using(site_id)"""),
    "nearest_layer": with_ctes("sites layers", """, m as (select *, sum(thickness_km) over (partition by site_id order by layer_idx)-thickness_km/2 as mid from layers)
        select site_id, layer_idx, round(mid,9) as mid_km, round(vs,9) as vs from (select m.*, row_number() over
        (partition by m.site_id order by abs(mid-m.site_id%10/10.0::double), layer_idx) as rn from m) where rn=1"""),
    "nearest_grid_cell": with_ctes("sites", """select s.site_id,
        (select round(y,6) from la order by abs(y-s.latitude), y limit 1) as cell_latitude,
        (select round(x,6) from lo order by abs(x-s.longitude), x limit 1) as cell_longitude from sites s""",
        """la as (select distinct 29.5::double+c_custkey%30*0.37::double as y from customer),
        lo as (select distinct -120.3::double+c_custkey%23*0.31::double as x from customer)"""),
    "case_config_cross": """with c as (select p_type, p_size, min(p_retailprice) as stack from part group by 1,2)
        select p.p_type as use_case, p.p_partkey as case_id, count(*) as n_cells, round(sum(stack),2) as stack_sum
        from part p join c on c.p_type=p.p_type group by 1,2""",
    "event_onset_match": with_ctes("dvv quakes", """, d as (select *, row_number() over (partition by site_id order by ts)-1 as idx from dvv),
        ev as (select q.site_id, d.idx from quakes q join d on d.site_id=q.site_id and d.ts=q.ts where q.magnitude>=6.5)
        select d.site_id, d.idx as onset_idx, (select count(*) from ev where ev.site_id=d.site_id and abs(ev.idx-d.idx)<=5) as n_near_events
        from d where dvv>0.42"""),
    "provider_fallback": """with c as (select distinct o_custkey as site_id, o_orderkey%3 as r from orders),
        c2 as (select *, ['ucvm','usgs_vs30','default'][r+1] as provider,
          case r when 0 then site_id%4=0 when 1 then site_id%3=0 else true end as resolved from c),
        w as (select site_id, min(case when resolved then r end) as win from c2 group by 1)
        select site_id, coalesce(['ucvm','usgs_vs30','default'][w.win+1],'unresolved') as source,
          coalesce((select string_agg(provider||': no data for '||c2.site_id, ' | ' order by r) from c2 where c2.site_id=w.site_id and not resolved
            and (w.win is null or r<w.win)),'') as warnings from w""",
    "epoch_pair_join": with_ctes("dvv", """, d as (select *, row_number() over (partition by site_id order by ts)-1 as i from dvv)
        select a.site_id, a.i, b.i as j, round(a.dvv-b.dvv,12) as rel, round(sqrt(a.dvv_err*a.dvv_err+b.dvv_err*b.dvv_err),12) as sigma
        from d a join d b on a.site_id=b.site_id and b.i between a.i+1 and a.i+5"""),
    "union_index": with_ctes("dvv forcing", "select site_id, ts as day from dvv union select site_id, ts from fw"),
}
