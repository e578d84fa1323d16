"""Queries: sources, filters and quality control."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tremorlake.functions.exprs import day, rnd
from tremorlake.operators import quality as q
from tremorlake.plans import bindings as b
from tremorlake.plans.bindings import with_ctes
from tremorlake.session import shared_folder
from tremorlake.sources import io

KEY = ["site_id"]



def _read_table(spark, sf):
    b.prepare(spark)
    return io.read_table(spark, f"{sf}/orders.parquet").groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), rnd(F.sum("o_totalprice"), 2).alias("total")
    )


def _normalize_time(spark, sf):
    e = b.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 7 == 0, F.lit("n/a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
        "event_type",
    )
    return (
        io.normalize_time(e)
        .groupBy(F.to_date("ts").alias("day"), "event_type")
        .agg(F.count("*").alias("n_rows"))
    )


def _load_dvv(spark, sf):
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("site_id"),
        F.col("o_orderdate").alias("Date"),
        (F.col("o_totalprice") / 1e4).alias("dvv"),
        (F.col("o_custkey") % 100 / 100.0).alias("cc"),
        "o_orderkey",
    )
    out = io.load_dvv(o, keys=["site_id", "o_orderkey"], units="percent")
    return out.select(
        "site_id", "o_orderkey", day(), rnd("dvv", 12).alias("dvv"),
        rnd("dvv_err", 9).alias("dvv_err"), rnd("cc", 6).alias("cc"), "err_defaulted",
    )


def _load_forcing(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("site_id"), F.col("l_shipdate").alias("date"), "l_quantity"
    )
    out = io.load_forcing(li, "precipitation")
    return out.groupBy("site_id", "channel", day()).agg(
        rnd(F.sum("value"), 4).alias("value"), F.count("*").alias("n_rows")
    )


def _load_catalog(spark, sf):
    e = b.quakes(spark, sf).select(
        "event_id", F.col("ts").alias(" Time "), F.col("latitude").alias("LAT"),
        F.col("longitude").alias("Lon"), F.col("magnitude").alias("mag"),
    )
    out = io.load_catalog(
        e, site_lat=35.0, site_lon=-117.0, search_radius_km=250.0, min_magnitude=4.0
    )
    return out.select(
        "event_id", day(), rnd("latitude", 6).alias("latitude"), rnd("longitude", 6).alias("longitude"),
        F.col("depth_km"), rnd("magnitude", 6).alias("magnitude"),
        rnd("distance_km", 6).alias("distance_km"),
    )


def _station_archive(spark, sf):
    o = b.table(spark, sf, "orders").select(
        "o_orderpriority", "o_orderkey", F.col("o_orderdate").alias("DATE"),
        (F.col("o_totalprice") / 1e4).alias("DVV"), (F.col("o_custkey") % 100 / 100.0).alias("Q"),
    )
    out = io.station_archive(o, F.col("o_orderpriority"), F.col("o_orderkey"))
    return out.select(
        "site_id", day(), rnd("dvv", 12).alias("dvv"), rnd("dvv_err", 9).alias("dvv_err"),
        rnd("cc", 6).alias("cc"), "err_defaulted",
    )


def _station_folder(spark, sf):
    """The same archive from a folder with one set of files per station, read back in one scan."""
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("station"), F.col("o_orderdate").alias("DATE"), (F.col("o_totalprice") / 1e4).alias("DVV"),
        (F.col("o_custkey") % 100 / 100.0).alias("CC"), "o_orderkey")
    path = f"{shared_folder(spark).rstrip('/')}/stations-{uuid.uuid4().hex}"
    o.groupBy("station", "DATE").agg(F.min_by(F.struct("DVV", "CC"), "o_orderkey").alias("r")).select("station", "DATE", "r.*").write.partitionBy("station").parquet(path)
    out = io.load_station_archive(spark, path, name=r"station=([^/]+)/")
    return out.select("site_id", day(), rnd("dvv", 12).alias("dvv"), rnd("dvv_err", 9).alias("dvv_err"), rnd("cc", 6).alias("cc"), "err_defaulted")


def _export_run(spark, sf):
    """Tables of a run written and read back."""
    daily = b.dvv_daily(spark, sf).select("site_id", F.col("ts").cast("string").alias("ts"), "dvv")
    parts = daily.groupBy("site_id").agg(F.count("*").alias("n_obs"), F.round(F.avg("dvv"), 9).alias("mean"))
    path = f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    io.export_run({"residuals": daily, "parameters": parts, "results": parts.select("site_id", (F.col("n_obs") > 30).alias("enough"))}, path)
    residuals = spark.read.parquet(f"{path}/residuals").groupBy("site_id").agg(F.count("*").alias("n_rows"), rnd(F.sum("dvv"), 6).alias("total"))
    params = spark.read.option("header", True).schema("site_id string, n_obs long, mean double").csv(f"{path}/parameters")
    results = spark.read.schema("site_id string, enough boolean").json(f"{path}/results")
    return residuals.join(params.select("site_id", "n_obs", "mean"), "site_id").join(results.select("site_id", "enough"), "site_id")


def _read_layers(spark, sf):
    nested = b.site_layers(spark, sf).groupBy("site_id").agg(
        F.sort_array(
            F.collect_list(F.struct("layer_idx", "thickness_km", "vp", "vs", "rho"))
        ).alias("layers")
    )
    nested = nested.withColumn(
        "layers", F.transform("layers", lambda x: x.dropFields("layer_idx"))
    )
    return io.read_layers(nested).select(
        "site_id", "layer_idx", *[rnd(c, 9).alias(c) for c in ("thickness_km", "vp", "vs", "rho")]
    )


def _benchmark_rows(spark, sf):
    rows = b.table(spark, sf, "documents").select(
        "doc_id", "lang", "n_chars",
        F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 3 == 1, "test").otherwise("train")).alias("split"),
        F.when(F.col("source") == "wiki", F.lit("secret")).alias("visibility"),
    )
    kept = io.benchmark_rows(rows, splits=["validation", "test"], visibility=["public"])
    m = io.benchmark_manifest(kept, by="lang", payload=["doc_id", "n_chars", "split"])
    stats = kept.groupBy("lang").agg(
        F.sum("n_chars").alias("n_chars"), F.count_if(F.col("split") == "test").alias("n_test")
    )
    return m.join(stats, "lang").select("lang", "n_rows", "n_chars", "n_test", "digest")


def _finite_rows(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_tax") == 0, float("inf")).when(F.col("l_discount") == 0, float("nan"))
        .otherwise(F.try_divide("l_discount", "l_tax")).alias("x"),
        "l_quantity",
    )
    return q.finite_rows(li, ["x", "l_quantity"]).groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), rnd(F.avg("x"), 8).alias("mean_x")
    )


def _cc_gate(spark, sf):
    ref = F.when(F.col("site_id").startswith("1"), "moving").otherwise("fixed")
    return q.cc_gate(b.dvv_daily(spark, sf), ref).select(
        "site_id", day(), rnd("dvv", 12).alias("dvv"), rnd("cc", 8).alias("cc")
    )


def _subsample(spark, sf):
    return q.subsample_cadence(b.dvv_daily(spark, sf), KEY, 3).select(
        "site_id", day(), rnd("dvv", 12).alias("dvv")
    )


def _spacing(spark, sf):
    return q.spacing(b.dvv_daily(spark, sf), KEY).select(
        "site_id", day(), F.to_date("prev_ts").alias("prev_day"), "gap_days"
    )


def _gap_detect(spark, sf):
    return q.gap_detect(b.dvv_daily(spark, sf), KEY).select(
        "site_id", day("gap_start", "gap_start"), day("gap_end", "gap_end"), "gap_days"
    )


def _flags(fn, **kw):
    def run(spark, sf):
        out = fn(b.dvv_daily(spark, sf), KEY, "dvv", **kw)
        return out.select("site_id", day(), rnd("dvv", 12).alias("dvv"), "is_outlier")

    return run


def _quality_summary(spark, sf):
    out = q.quality_summary(b.dvv_daily(spark, sf), KEY, "dvv", n_sigma=2.0)
    return out.select(
        "site_id", "n_samples", "n_outliers", "n_gaps", "largest_gap_days",
        "median_spacing_days", rnd("fraction_present", 9).alias("fraction_present"),
    )


QUERIES = {
    "read_table": _read_table,
    "normalize_time": _normalize_time,
    "load_dvv": _load_dvv,
    "load_forcing": _load_forcing,
    "load_catalog": _load_catalog,
    "load_station_archive": _station_archive,
    "load_station_folder": _station_folder,
    "export_run": _export_run,
    "read_layers": _read_layers,
    "export_benchmark_rows": _benchmark_rows,
    "finite_rows": _finite_rows,
    "cc_gate": _cc_gate,
    "subsample_cadence": _subsample,
    "spacing": _spacing,
    "gap_detect": _gap_detect,
    "outliers_mad_global": _flags(q.outliers_mad_global, n_sigma=2.0),
    "outliers_sigma_global": _flags(q.outliers_sigma_global, n_sigma=2.0),
    "rolling_outlier_mad": _flags(q.rolling_outlier_mad, n_sigma=3.0),
    "rolling_outlier_sigma": _flags(q.rolling_outlier_sigma, n_sigma=2.0),
    "quality_summary": _quality_summary,
}

_ROLL = "over (partition by site_id order by date_diff('day', date '1970-01-01', ts) range between 14 preceding and 15 following)"

ORACLE = {
    "read_table": """select o_orderstatus, count(*) as n_rows, round(sum(o_totalprice),2) as total
        from orders group by 1""",
    "normalize_time": """select cast(ts as date) as day, event_type, count(*) as n_rows from events
        where event_id%7<>0 group by 1,2""",
    "load_dvv": """select o_orderpriority as site_id, o_orderkey, cast(o_orderdate as date) as day,
        round(o_totalprice/1e4/100,12) as dvv, round(1e-3/100,9) as dvv_err,
        round(o_custkey%100/100.0::double,6) as cc, true as err_defaulted from orders""",
    "load_forcing": """select l_linestatus as site_id, 'precipitation' as channel,
        cast(l_shipdate as date) as day, round(sum(l_quantity),4) as value, count(*) as n_rows
        from lineitem group by 1,2,3""",
    "load_catalog": with_ctes("quakes", """select event_id, ts as day, round(latitude,6) as latitude,
        round(longitude,6) as longitude, cast(null as double) as depth_km, round(magnitude,6) as magnitude,
        round(dist,6) as distance_km from (select *, 2*6371.0::double*asin(sqrt(
          pow(sin(radians(latitude-35.0)/2),2)+cos(radians(35.0::double))*cos(radians(latitude))
          *pow(sin(radians(longitude+117.0)/2),2))) as dist from quakes)
        where dist<=250 and magnitude>=4.0"""),
    "load_station_archive": """select site_id, day, round(dvv/100,12) as dvv, 1e-3 as dvv_err,
        round(q,6) as cc, true as err_defaulted from (
        select o_orderpriority as site_id, cast(o_orderdate as date) as day, o_totalprice/1e4 as dvv,
        o_custkey%100/100.0::double as q,
        row_number() over (partition by o_orderpriority, o_orderdate order by o_orderkey) as rn
        from orders) where rn=1""",
    "load_station_folder": """select site_id, day, round(dvv/100,12) as dvv, 1e-3 as dvv_err,
        round(q,6) as cc, true as err_defaulted from (
        select o_orderpriority as site_id, cast(o_orderdate as date) as day, o_totalprice/1e4 as dvv,
        o_custkey%100/100.0::double as q,
        row_number() over (partition by o_orderpriority, o_orderdate order by o_orderkey) as rn
        from orders) where rn=1""",
    "export_run": with_ctes("dvv", """select site_id, count(*) as n_rows, round(sum(dvv),6) as total, count(*) as n_obs, round(avg(dvv),9) as mean, count(*)>30 as enough from dvv group by 1"""),
    "read_layers": with_ctes("layers", """select site_id, layer_idx, round(thickness_km,9) as thickness_km,
        round(vp,9) as vp, round(vs,9) as vs, round(rho,9) as rho from layers"""),
    "export_benchmark_rows": """with r as (select lang, doc_id, n_chars,
        case doc_id%3 when 0 then 'validation' when 1 then 'test' else 'train' end as split
        from documents where source is null or source<>'wiki'),
        h as (select lang, n_chars, split, sha256(doc_id||chr(31)||n_chars||chr(31)||split) as h from r where split<>'train'),
        s as (select lang, count(*) as n_rows, sum(n_chars)::bigint as n_chars,
          sum(case when split='test' then 1 else 0 end)::bigint as n_test,
          """ + ", ".join(
        f"sum(cast('0x'||substr(h,{1 + 12 * i},12) as bigint)%1000003)::bigint as w{i}" for i in range(5)
    ) + """ from h group by lang)
        select lang, n_rows, n_chars, n_test, sha256(concat_ws(',',w0,w1,w2,w3,w4)) as digest from s""",
    "finite_rows": """select l_returnflag, count(*) as n_rows, round(avg(l_discount/l_tax),8) as mean_x
        from lineitem where l_tax<>0 and l_discount<>0 and l_quantity is not null group by 1""",
    "cc_gate": with_ctes("dvv", """select site_id, ts as day, round(dvv,12) as dvv, round(cc,8) as cc
        from dvv where site_id like '1%' or cc>0.6"""),
    "subsample_cadence": with_ctes("dvv", """select site_id, ts as day, round(dvv,12) as dvv from (
        select *, row_number() over (partition by site_id order by ts)-1 as i from dvv) where i%3=0"""),
    "spacing": with_ctes("dvv", """select site_id, ts as day, lag(ts) over w as prev_day,
        cast(ts - lag(ts) over w as double) as gap_days from dvv window w as (partition by site_id order by ts)"""),
    "gap_detect": with_ctes("dvv", """select site_id, p as gap_start, ts as gap_end, cast(ts-p as double) as gap_days
        from (select site_id, ts, lag(ts) over (partition by site_id order by ts) as p from dvv) where ts-p>3"""),
    "outliers_mad_global": with_ctes("dvv", """, m as (select site_id, median(dvv) as med, stddev_samp(dvv) as sd from dvv group by 1),
        a as (select site_id, median(abs(dvv-med)) as mad from dvv join m using(site_id) group by 1)
        select site_id, ts as day, round(dvv,12) as dvv,
        abs(dvv-med)>2.0*(case when mad>0 then 1.4826*mad else sd end) as is_outlier
        from dvv join m using(site_id) join a using(site_id)"""),
    "outliers_sigma_global": with_ctes("dvv", """select site_id, ts as day, round(dvv,12) as dvv,
        abs(dvv-avg(dvv) over p)>2.0*stddev_samp(dvv) over p as is_outlier from dvv window p as (partition by site_id)"""),
    "rolling_outlier_mad": with_ctes("dvv", f""", m as (select *, case when count(*) {_ROLL}>=3 then
          quantile_cont(dvv,0.5) {_ROLL} end as med from dvv),
        d as (select *, abs(dvv-med) as dev from m),
        a as (select *, case when count(dev) {_ROLL}>=3 then quantile_cont(dev,0.5) {_ROLL} end as mad from d)
        select site_id, ts as day, round(dvv,12) as dvv, coalesce(dev>3.0*1.4826*mad,false) as is_outlier from a"""),
    "rolling_outlier_sigma": with_ctes("dvv", f"""select site_id, ts as day, round(dvv,12) as dvv,
        coalesce(case when count(*) {_ROLL}>=3 then abs(dvv-avg(dvv) {_ROLL})>2.0*stddev_samp(dvv) {_ROLL} end,false)
        as is_outlier from dvv"""),
    "quality_summary": with_ctes("dvv", """, m as (select site_id, median(dvv) as med, stddev_samp(dvv) as sd from dvv group by 1),
        a as (select site_id, median(abs(dvv-med)) as mad from dvv join m using(site_id) group by 1),
        f as (select site_id, count(*) as n_samples,
          sum(case when abs(dvv-med)>2.0*(case when mad>0 then 1.4826*mad else sd end) then 1 else 0 end)::bigint as n_outliers,
          (max(ts)-min(ts))::double as span from dvv join m using(site_id) join a using(site_id) group by 1),
        g as (select site_id, cast(ts-lag(ts) over (partition by site_id order by ts) as double) as gap from dvv),
        h as (select site_id, sum(case when gap>3 then 1 else 0 end)::bigint as n_gaps,
          coalesce(max(case when gap>3 then gap end),0.0::double) as largest_gap_days,
          quantile_cont(gap,0.5) as median_spacing_days from g group by 1)
        select site_id, n_samples, n_outliers, n_gaps, largest_gap_days, median_spacing_days,
          round(least(1.0::double,1.0::double/(span/(n_samples-1))),9) as fraction_present from f join h using(site_id)"""),
}
