"""Queries: waveform stacks, references, estimators and sweeps on them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tremorlake.functions.exprs import rnd
from tremorlake.operators import campaign as ca
from tremorlake.operators import combine as cb
from tremorlake.operators import sweep as sw
from tremorlake.operators import waveform as w
from tremorlake.plans import bindings as b
from tremorlake.plans.bindings import with_ctes
from tremorlake.session import cut, shared_folder

K = ["pair_id", "component"]
FS, T0 = 1.0, -32.0
WIN, BAND = (4.0, 28.0), (0.05, 0.4)


def _energy(df, *extra):
    e = F.sqrt(F.aggregate("ccf", F.lit(0.0), lambda s, v: s + v * v))
    return df.select("pair_id", *extra, rnd(e, 8).alias("norm"), rnd(F.get("ccf", F.lit(0)), 9).alias("first"), rnd(F.get("ccf", F.lit(63)), 9).alias("last"))


def _stack(spark, sf):
    return _energy(w.trailing_stack(b.ccf(spark, sf), K, k=10), "day")


def _moving(spark, sf):
    return _energy(w.moving_reference(b.ccf(spark, sf), K, ref_days=20), "day")


def _fixed(spark, sf):
    return _energy(w.fixed_reference(b.ccf(spark, sf), K))


def _block(spark, sf):
    return _energy(w.block_stack(b.ccf(spark, sf), K), "block")


def _bandpass(spark, sf):
    return _energy(w.bandpass_ccf(b.ccf(spark, sf), K, band=BAND, fs=FS), "day")


def _image(spark, sf):
    c = cut(b.ccf(spark, sf))
    return w.cc_image(c, w.fixed_reference(c, K), K, fs=FS, t0=T0, window=WIN)


def _cc_image(spark, sf):
    return _image(spark, sf).select("pair_id", "day", F.posexplode("cc").alias("eps_idx", "c")).select(
        "pair_id", "day", F.col("eps_idx").cast("long").alias("eps_idx"), rnd("c", 8).alias("cc"))


def _peak(spark, sf):
    return w.peak_eps(_image(spark, sf), K).select("pair_id", "day", *[rnd(c, 8).alias(c) for c in ("eps", "dvv", "cc")])


def _image_average(spark, sf):
    long = _image(spark, sf).select("pair_id", F.col("day").alias("_d"), F.posexplode("cc").alias("eps_idx", "cc"))
    long = long.select("pair_id", F.floor(F.col("_d") / 6).alias("ts"), F.col("eps_idx").cast("long").alias("eps_idx"), (F.col("eps_idx") * 0.00075 - 0.06).alias("eps"), "cc")
    return cb.image_average(long, ["pair_id", "ts"]).select("pair_id", "ts", "eps_idx", rnd("cc", 8).alias("cc"))


def _cfg(name, i=0, ref="fixed", stack=3, **kw):
    return {"config_index": i, "estimator": name, "band": BAND, "window": WIN, "stack": stack, "reference": ref, "gate": True, "eps_max": 0.06, **kw}


def _estimator(name, **kw):
    def run(spark, sf):
        return w.measure_dvv(cut(b.ccf(spark, sf)), [_cfg(name, **kw)], K, fs=FS, t0=T0).select("pair_id", "day", rnd("dvv", 7).alias("dvv"), rnd("cc", 7).alias("cc"), "valid", "error")

    return run


def _measure(spark, sf):
    cfgs = [_cfg("stretching (TS)", 0), _cfg("stretching (TS)", 1, "moving"), _cfg("MWCS", 2, stack=1), _cfg("stretching (TS)", 3, "inversion"), _cfg("nonsense", 4)]
    return w.measure_dvv(cut(b.ccf(spark, sf)), cfgs, K, fs=FS, t0=T0, ref_days=15)


def _joint(spark, sf):
    return w.joint_inversion(cut(b.ccf(spark, sf)), K, fs=FS, t0=T0, band=BAND, window=WIN)


def _coda(spark, sf):
    return w.coda_window(w.fixed_reference(b.ccf(spark, sf), K), K, fs=FS, t0=T0, bands=[(0.05, 0.2), (0.2, 0.4)], floor_window=(24.0, 31.0))


def _ensemble(spark, sf):
    # the twelve configs of the prior, in bands and windows of the test waveforms
    cfgs = [{**m, "band": BAND if m["band"][0] < 0.5 else (0.1, 0.45), "window": {8: (4.0, 28.0), 12: (6.0, 30.0)}[m["window"][0]]} for m in w.ensemble_configs()]
    return w.processing_ensemble(cut(b.ccf(spark, sf)), cfgs, K, fs=FS, t0=T0, cadence=2)


def _truth(c):
    return c.select("pair_id", "day").distinct().withColumn("truth", 0.02 * F.sin(F.col("day") / 9.0))


def _scored(spark, sf):
    c = cut(b.ccf(spark, sf))
    cfgs = [_cfg(e, i * 2 + j, r) for i, e in enumerate(("stretching (TS)", "MWCS", "WCS")) for j, r in enumerate(("fixed", "moving"))] + [_cfg("broken", 6)]
    return w.score_cells(w.measure_dvv(c, cfgs, K, fs=FS, t0=T0, ref_days=15), _truth(c))


def _scaled(band, window):
    """A case's own band and window on the axis of the test waveforms (one sample a second, 31 s each side)."""
    top_f, top_t = max(v[0][1] for v in sw.USE_CASES.values()) * 1.5, max(v[1][1] for v in sw.USE_CASES.values()) * 1.8
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    return pair(F.sqrt(band["lo"] / top_f) * 0.4, F.sqrt(band["hi"] / top_f) * 0.4 + 0.05), pair(F.sqrt(window["lo"] / top_t) * 10.0, 10.0 + F.sqrt(window["hi"] / top_t) * 20.0)


def _sweep(spark, sf):
    """Every case with the grid of its own application, interrupted after the first wave and resumed."""
    c = cut(b.ccf(spark, sf))
    keys = F.array(*[F.lit(k) for k in sw.USE_CASES])
    cases = c.select("pair_id").distinct().select(
        F.col("pair_id").alias("case_id"), F.element_at(keys, (F.pmod(F.xxhash64("pair_id"), F.lit(6)) + 1).cast("int")).alias("use_case"), F.lit(False).alias("two_layer"))
    grid = sw.build_grid(cases, "compact").withColumnRenamed("case_id", "pair_id")
    band, window = _scaled(F.col("band"), F.col("window"))
    grid = grid.withColumns({"band": band, "window": window})
    inverse = grid.where(F.col("reference") == "moving").withColumns({"reference": F.lit("inversion"), "config_index": F.col("config_index") + 100})
    grid = cut(grid.unionByName(inverse))
    path = f"{shared_folder(spark).rstrip('/')}/sweep-{uuid.uuid4().hex}"
    run = lambda **kw: ca.run_sweep(c, grid, _truth(c), path, K, fs=FS, t0=T0, ref_days=15, max_stack=10, waves=2, **kw)
    run(most_waves=1)
    return run()


def _multiverse(spark, sf):
    c = cut(b.ccf(spark, sf))
    cells = [{**m, "band": BAND if m["band"][0] < 0.5 else (0.1, 0.45), "window": {10: WIN, 4: (3.0, 20.0), 25: (8.0, 30.0)}[m["window"][0]]} for m in w.multiverse_configs()]
    scored = w.score_cells(w.measure_dvv(c, cells, K, fs=FS, t0=T0, ref_days=15), _truth(c), aligned=False, event_day=F.lit(25))
    scored = cut(scored)
    axes = spark.createDataFrame([(m["config_index"], m["estimator"], str(m["band"]), str(m["window"]), m["stack"], m["reference"]) for m in cells],
                                 "config_index long, estimator string, band string, window string, stack long, reference string")
    rows = scored.where("ok").join(F.broadcast(axes), "config_index")
    names = ["estimator", "band", "window", "stack", "reference"]
    share = lambda v: sw.sobol_first_order(rows, ["pair_id"], names, value=v).withColumn("of", F.lit(v))
    return share("rms").unionByName(share("drop"))


def _config_scores(spark, sf):
    """One submission per brand and pair; invalid ones score 0, valid ones are run and scored by their case's thresholds."""
    c = cut(b.ccf(spark, sf))
    size, n = F.col("size"), F.col("n")
    pair = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    brands = b.table(spark, sf, "part").groupBy(F.col("p_brand").alias("submission_id"), (F.col("p_size") % 10).alias("n")).agg(F.count("*").alias("b"), F.sum("p_size").alias("a"))
    sub = brands.withColumn("size", F.pmod(F.col("a") * 7 + F.col("b") * 3 + n, F.lit(50))).select(
        "submission_id", F.concat(F.lit("pair"), n.cast("string")).alias("pair_id"), F.element_at(F.array(*[F.lit(k) for k in sw.USE_CASES]), (size % 6 + 1).cast("int")).alias("use_case"),
        F.element_at(F.array(F.lit("stretching (TS)"), F.lit("MWCS"), F.lit("magic")), (size % 3 + 1).cast("int")).alias("estimator"),
        F.when(size % 7 > 0, pair(0.03 + size / 1000.0, 0.3 + size / 400.0)).alias("band"), pair(2 + size / 10.0, 4 + size / 2.0).alias("window"),
        F.when(size % 4 > 0, (size % 5 + 1).cast("int")).alias("stack"), F.when(size % 2 > 0, F.lit("moving")).alias("reference"), F.lit(True).alias("gate"))
    pairs = c.select("pair_id").distinct().withColumn("n", F.substring("pair_id", 5, 9).cast("int"))
    cases = pairs.select("pair_id", (0.005 + n / 1000.0).alias("rms_target"), F.lit(0.35).alias("rel_tol"), F.when(n % 3 > 0, 0.02 + n / 500.0).alias("rms_wrong_layer"))
    out = ca.score_config_submissions(sub, c, _truth(c), cases, K, fs=FS, t0=T0, ref_days=15, max_stack=10)
    return out.select("submission_id", "pair_id", "valid", rnd("rms", 9).alias("rms"), rnd("score", 7).alias("score"))


QUERIES = {
    "trailing_stack": _stack, "moving_reference": _moving, "fixed_reference": _fixed, "block_stack": _block, "bandpass_ccf": _bandpass,
    "cc_image": _cc_image, "peak_eps": _peak, "image_average": _image_average, "stretching": _estimator("stretching (TS)"),
    "stretching_causal": _estimator("stretching (TS)", branch="causal"), "mwcs": _estimator("MWCS"), "wcc": _estimator("WCC"),
    "dtw": _estimator("DTW"), "wavelet_xspec": _estimator("WCS"), "wavelet_stretch": _estimator("WTS"), "wavelet_dtw": _estimator("WTDTW"),
    "measure_dvv": _measure, "joint_inversion": _joint, "coda_window": _coda, "processing_ensemble_run": _ensemble, "score_cells": _scored,
    "sweep": _sweep, "multiverse": _multiverse, "score_config_submissions": _config_scores,
}

_LONG = "lg as materialized (select pair_id, day, unnest(ccf)::double as v, unnest(range(64)) as k from ccf)"
_OUT = "round(sqrt(sum(v*v)),8) as norm, round(max(case when k=0 then v end),9)+0.0 as \"first\", round(max(case when k=63 then v end),9)+0.0 as \"last\""
_FX = "fx as materialized (select pair_id, k, avg(v) as v from lg join (select pair_id, count(*) as n from ccf group by 1) using(pair_id) where day<floor(0.6*n) group by 1,2)"
_IM = _LONG + "," + _FX + """, ep as (select e, -0.06::double+0.12::double*e/160 as eps from (select unnest(range(161)) as e)),
  ps as (select k, e, least(greatest((k-32.0::double)/(1+eps)+32,0.0::double),63.0::double) as pos from (select unnest(range(64)) as k), ep where abs(k-32) between 4 and 28),
  tr as materialized (select a.pair_id, ps.e, ps.k, a.v*(1-(pos-least(floor(pos),62)))+c.v*(pos-least(floor(pos),62)) as r from ps join fx a on a.k=least(floor(pos),62) join fx c on c.k=least(floor(pos),62)+1 and c.pair_id=a.pair_id),
  im as materialized (select lg.pair_id, lg.day, e, sum(v*r)/((sqrt(sum(v*v))+1e-12)*(sqrt(sum(r*r))+1e-12)) as cc from lg join tr on tr.pair_id=lg.pair_id and tr.k=lg.k group by 1,2,3)"""

# band-pass as a sum over lags: the inverse DFT of the pass band's shoulders
_G = """g as materialized (select d, sum((case when f in (0,32) then 1.0::double else 2.0::double end)*m*cos(2*pi()*f*d/64))/64 as w from (select unnest(range(-63,64)) as d),
    (select f, 0.25::double*(1-cos(pi()*least(greatest((f/64.0::double-(0.05::double-0.0875::double))/0.0875::double,0),1)))*(1-cos(pi()*least(greatest((0.4::double+0.0875::double-f/64.0::double)/0.0875::double,0),1))) as m
     from (select unnest(range(33)) as f)) group by d)"""


def _passed(name: str, src: str, by: str) -> str:
    return f"{name} as materialized (select {by}, n as k, sum(v*w) as v from {src}, (select unnest(range(64)) as n), g where g.d=n-k group by {by}, n)"


def _stretching_sql(inside: str) -> str:
    st = "st as (select pair_id, day, k, avg(v) over (partition by pair_id, k order by day rows between 2 preceding and current row) as v from lg)"
    return with_ctes("ccf", """, ep as (select e, -0.06::double+0.12::double*e/160 as eps from (select unnest(range(161)) as e)),
      ps as (select k, e, least(greatest((k-32.0::double)/(1+eps)+32,0.0::double),63.0::double) as pos from (select unnest(range(64)) as k), ep where """ + inside + """),
      tr as materialized (select a.pair_id, ps.e, ps.k, a.v*(1-(pos-least(floor(pos),62)))+c.v*(pos-least(floor(pos),62)) as r from ps join bf a on a.k=least(floor(pos),62) join bf c on c.k=least(floor(pos),62)+1 and c.pair_id=a.pair_id),
      im as materialized (select bs.pair_id, bs.day, e, sum(v*r)/((sqrt(sum(v*v))+1e-12)*(sqrt(sum(r*r))+1e-12)) as cc from bs join tr on tr.pair_id=bs.pair_id and tr.k=bs.k group by 1,2,3),
      bb as (select pair_id, day, arg_max(e,cc) as i, max(cc) as b from im group by 1,2),
      ac as (select bb.*, x.cc as a, y.cc as c from bb left join im x on x.pair_id=bb.pair_id and x.day=bb.day and x.e=i-1 left join im y on y.pair_id=bb.pair_id and y.day=bb.day and y.e=i+1),
      pe as (select *, -0.06::double+0.12::double/160*(i+case when a is null or c is null or a-2*b+c=0 then 0 else 0.5::double*(a-c)/(a-2*b+c) end) as eps from ac)
      select pair_id, day, round(-eps/(1+eps),7)+0.0 as dvv, round(b,7)+0.0 as cc, b>0.6 as valid, null::varchar as error from pe""",
      ",".join([_LONG, _FX, st, _G, _passed("bs", "st", "pair_id, day"), _passed("bf", "fx", "pair_id")]))


_ST = "st as (select pair_id, day, k, avg(v) over (partition by pair_id, k order by day rows between 2 preceding and current row) as v from lg)"
_MWCS = with_ctes("ccf", """, sg as (select c, 32+c-3+j as k, 0.5::double-0.5::double*cos(2*pi()*j/5) as h, j from (select unnest([7,10,13,16,19,22]) as c), (select unnest(range(6)) as j)),
      fq as (select unnest([1,2]) as m),
      fa as materialized (select pair_id, day, c, m, sum(v*h*cos(2*pi()*m*j/6)) as re, -sum(v*h*sin(2*pi()*m*j/6)) as im from bs join sg using(k), fq group by 1,2,3,4),
      fb as materialized (select pair_id, c, m, sum(v*h*cos(2*pi()*m*j/6)) as re, -sum(v*h*sin(2*pi()*m*j/6)) as im from bf join sg using(k), fq group by 1,2,3),
      ce as (select pair_id, c, sum(m/6.0::double*(re*re+im*im))/(sum(re*re+im*im)+1e-12) as f from fb group by 1,2),
      dl as (select fa.pair_id, day, fa.c, atan2(sum(fa.im*fb.re-fa.re*fb.im), sum(fa.re*fb.re+fa.im*fb.im))/(2*pi()*any_value(ce.f)) as delay
        from fa join fb on fa.pair_id=fb.pair_id and fa.c=fb.c and fa.m=fb.m join ce on ce.pair_id=fa.pair_id and ce.c=fa.c group by 1,2,3)
      select pair_id, day, round(sum(delay*(c-14.5::double))/sum((c-14.5::double)*(c-14.5::double)),7)+0.0 as dvv, null::double as cc, true as valid, null::varchar as error from dl group by 1,2""",
      ",".join([_LONG, _FX, _ST, _G, _passed("bs", "st", "pair_id, day"), _passed("bf", "fx", "pair_id")]))

ORACLE = {
    "mwcs": _MWCS,
    "bandpass_ccf": with_ctes("ccf", f"select pair_id, day, {_OUT} from bp group by 1,2", ",".join([_LONG, _G, _passed("bp", "lg", "pair_id, day")])),
    "stretching": _stretching_sql("abs(k-32) between 4 and 28"),
    "stretching_causal": _stretching_sql("k-32 between 4 and 28"),
    "trailing_stack": with_ctes("ccf", f"select pair_id, day, {_OUT} from (select pair_id, day, k, avg(v) over (partition by pair_id, k order by day rows between 9 preceding and current row) as v from lg) group by 1,2", _LONG),
    "moving_reference": with_ctes("ccf", f"select pair_id, day, {_OUT} from (select pair_id, day, k, avg(v) over (partition by pair_id, k order by day rows between 20 preceding and 1 preceding) as v from lg) where day>=20 group by 1,2", _LONG),
    "fixed_reference": with_ctes("ccf", f"select pair_id, {_OUT} from fx group by 1", _LONG + "," + _FX),
    "block_stack": with_ctes("ccf", f"select pair_id, block, {_OUT} from (select pair_id, day//7 as block, k, avg(v) as v from lg group by 1,2,3 having count(*)=7) group by 1,2", _LONG),
    "cc_image": with_ctes("ccf", "select pair_id, day, e as eps_idx, round(cc,8)+0.0 as cc from im", _IM),
    "peak_eps": with_ctes("ccf", """, bb as (select pair_id, day, arg_max(e,cc) as i, max(cc) as b from im group by 1,2), ac as (select bb.*, x.cc as a, y.cc as c from bb left join im x on x.pair_id=bb.pair_id and x.day=bb.day and x.e=i-1
        left join im y on y.pair_id=bb.pair_id and y.day=bb.day and y.e=i+1), pe as (select *, -0.06::double+0.12::double/160*(i+case when a is null or c is null or a-2*b+c=0 then 0 else 0.5::double*(a-c)/(a-2*b+c) end) as eps from ac)
        select pair_id, day, round(eps,8)+0.0 as eps, round(-eps/(1+eps),8)+0.0 as dvv, round(b,8)+0.0 as cc from pe""", _IM),
    "image_average": with_ctes("ccf", "select pair_id, day//6 as ts, e as eps_idx, round(avg(cc),8)+0.0 as cc from im group by 1,2,3", _IM),
}
