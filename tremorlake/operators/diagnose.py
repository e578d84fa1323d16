"""Residual tests, transient detection, coupling tiers and attribution."""

from __future__ import annotations

from collections.abc import Sequence
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tremorlake.functions.exprs import clip, finite
from tremorlake.operators import align, forcing
from tremorlake.operators.regress import INTERCEPT, harmonic_fit, solve_normal
from tremorlake.operators.scan import (
    CHUNK_DAYS,
    exact_quantiles,
    halo,
    key_stats,
    micros,
    running,
    with_row_index,
)

# Attribution categories in tie order, Peclet bands, label cut-offs.
CATEGORIES = ("missing_forcing", "coupling_residual", "earthquake_response", "slow_event", "unmodeled")
PE_SOFT = (0.3, 3.0)
PE_HARD = (0.1, 10.0)
LIKELIHOOD_LABELS = ((0.75, "high"), (0.35, "moderate"), (0.10, "low"))


def rolling_zscore(
    df: DataFrame, keys: Sequence[str], value: str, *, window: int = 30, min_periods: int | None = None, out: str = "z"
) -> DataFrame:
    """Centred row-window z score; thin or flat windows use the series statistics.

    Keeps the row position as ``idx``.
    """
    need = max(window // 2, 1) if min_periods is None else min_periods
    idx = with_row_index(df, keys, ["ts"])
    lo, hi = window - 1 - (window - 1) // 2, (window - 1) // 2

    def guarded(fn):
        return lambda w: F.when(F.count(value).over(w) >= need, fn(value).over(w))

    rolled = halo(
        idx, keys, F.col("idx"), lo, hi, {"_mu": guarded(F.avg), "_sd": guarded(F.stddev_samp)}
    )
    stats = {"_gm": F.avg(value), "_gs": F.stddev_samp(value)}
    gs = F.when(F.col("_gs") == 0, 1.0).otherwise(F.col("_gs"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(gs)
    z = (F.col(value) - F.coalesce("_mu", "_gm")) / sd
    return key_stats(rolled, keys, stats).withColumn(out, z).drop("_mu", "_sd", "_gm", "_gs")


def transient_segments(
    df: DataFrame, keys: Sequence[str], value: str, *, z_threshold: float = 3.0, min_length: int = 7, window: int = 30
) -> DataFrame:
    """Runs of |z| above the threshold, at least ``min_length`` samples long.

    Only the rows above the threshold are scanned again: inside a run the row
    position minus the rank among those rows is constant.
    """
    z = rolling_zscore(df, keys, value, window=window)
    above = z.where(F.abs("z") >= z_threshold)
    runs = running(above, keys, ["ts"], {"_rank": ("count", F.lit(1))}).withColumn(
        "_run", F.col("idx") - F.col("_rank")
    )
    peak = F.max_by(F.struct(F.col(value).alias("amp"), "z"), F.struct(F.abs("z"), -F.col("idx")))
    seg = (
        runs.groupBy(*keys, "_run")
        .agg(
            F.min("idx").alias("onset_idx"),
            F.max("idx").alias("end_idx"),
            F.min("ts").alias("onset_ts"),
            F.max("ts").alias("end_ts"),
            F.count("*").alias("duration_samples"),
            peak.alias("_p"),
        )
        .where(F.col("duration_samples") >= min_length)
    )
    return seg.select(
        *keys, "onset_idx", "end_idx", "onset_ts", "end_ts", "duration_samples",
        F.col("_p.amp").alias("peak_amplitude"), F.col("_p.z").alias("peak_zscore"),
        F.signum("_p.z").cast("long").alias("sign"),
    )


def autocorr_lags(df: DataFrame, keys: Sequence[str], value: str, *, n_lags: int = 20) -> DataFrame:
    """Per key and lag: rho = sum(r_i r_(i-k)) / sum(r^2) after mean removal.

    One pass: each row meets the array of its ``n_lags`` predecessors.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, "ts", value)
    r = key_stats(rows, keys, {"_mu": F.avg(value)}).select(*keys, "ts", (F.col(value) - F.col("_mu")).alias("r"))
    idx = with_row_index(r, keys, ["ts"])
    prev = halo(
        idx, keys, F.col("idx"), n_lags, 0,
        {"_prev": lambda w: F.collect_list("r").over(w.rowsBetween(-n_lags, -1))},
    )
    products = [
        F.sum(F.col("r") * F.try_element_at("_prev", F.lit(-k))).alias(f"_p{k}")
        for k in range(1, n_lags + 1)
    ]
    sums = prev.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.sum(F.col("r") * F.col("r")).alias("_var"), *products
    )
    lags = F.array(
        *[
            F.struct(F.lit(k).cast("long").alias("lag"), F.coalesce(f"_p{k}", F.lit(0.0)).alias("s"))
            for k in range(1, n_lags + 1)
        ]
    )
    return sums.select(*keys, "n_obs", "_var", F.explode(lags).alias("l")).select(
        *keys, "n_obs", "l.lag",
        F.when(F.col("_var") > 0, F.col("l.s") / F.col("_var")).alias("rho"),
    )


def chi2_sf_even(q: Column, dof: int) -> Column:
    """Chi-square survival function for an even number of degrees of freedom."""
    half, term, total = q / 2, F.lit(1.0), F.lit(1.0)
    for k in range(1, dof // 2):
        term = term * half / k
        total = total + term
    return F.exp(-half) * total


def ljung_box(
    df: DataFrame, keys: Sequence[str], value: str, *, n_lags: int = 20, p_min: float = 0.01
) -> DataFrame:
    """Whiteness test per key; NULL statistics for fewer than 2 * n_lags rows."""
    if n_lags % 2:
        raise ValueError("n_lags must be even")
    rho = autocorr_lags(df, keys, value, n_lags=n_lags)
    q = rho.groupBy(*keys).agg(
        F.max("n_obs").alias("n_obs"),
        F.coalesce(F.sum(F.col("rho") ** 2 / (F.col("n_obs") - F.col("lag"))), F.lit(0.0)).alias("_s"),
    )
    n = F.col("n_obs")
    stat = F.when(n >= 2 * n_lags, n * (n + 2) * F.col("_s"))
    p = chi2_sf_even(F.col("q"), n_lags)
    return q.withColumn("q", stat).select(
        *keys, "n_obs", "q", p.alias("p_value"), (p >= p_min).alias("white")
    )


def detect_anomalies(df: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    """Whiteness, number of transients and residual std per key."""
    lb = ljung_box(df, keys, value)
    seg = transient_segments(df, keys, value, **kw).groupBy(*keys).agg(F.count("*").alias("n_transients"))
    std = df.groupBy(*keys).agg(F.stddev_samp(value).alias("residual_std"))
    return (
        lb.join(std, list(keys))
        .join(seg, list(keys), "left")
        .withColumn("n_transients", F.coalesce("n_transients", F.lit(0)))
    )


def _segment_windows(segments: DataFrame, rows: DataFrame, keys: Sequence[str], pad: int) -> DataFrame:
    """Rows of each padded segment window through a bucketed range join."""
    width = 256
    seg = segments.select(*keys, "onset_idx", "end_idx").withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("onset_idx") - pad, F.lit(0)) / width).cast("long"),
                F.floor((F.col("end_idx") + pad) / width).cast("long"),
            )
        ),
    )
    r = rows.withColumn("_bucket", F.floor(F.col("idx") / width).cast("long"))
    inside = F.col("idx").between(F.col("onset_idx") - pad, F.col("end_idx") + pad)
    return r.join(seg, [*keys, "_bucket"]).where(inside).drop("_bucket")


def lagged_xcorr(
    segments: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    channels: Sequence[str],
    max_lag: int = 10,
) -> DataFrame:
    """Best lagged correlation per segment and channel.

    ``rows``: keys, idx, value and one column per channel.  The sum is divided
    by m times the sample deviations, so a perfect match gives (m - 1) / m.
    """
    win = _segment_windows(segments, rows.select(*keys, "idx", value, *channels), keys, max_lag + 5)
    seg = [*keys, "onset_idx"]
    a = win.where(F.col(value).isNotNull()).select(
        *seg, F.col(value).alias("_a"), "idx",
        F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"),
    ).withColumn("_j", F.col("idx") + F.col("lag"))
    b = win.select(*seg, F.col("idx").alias("_j"), *channels).unpivot(
        [*seg, "_j"], list(channels), "channel", "_b"
    )
    pairs = a.join(b.where(F.col("_b").isNotNull()), [*seg, "_j"])
    m = F.count("*")
    sx, sy = F.stddev_samp("_a"), F.stddev_samp("_b")
    cov = F.covar_samp("_a", "_b") * (m - 1)
    one = lambda s: F.when(s > 0, s).otherwise(1.0)
    r = pairs.groupBy(*seg, "channel", "lag").agg(m.alias("m"), (cov / (m * one(sx) * one(sy))).alias("r"))
    return r.where(F.col("m") >= 5).groupBy(*seg, "channel").agg(
        F.max_by(F.struct("r", "lag"), F.struct(F.abs("r"), -F.col("lag"))).alias("_b")
    ).select(*seg, "channel", F.col("_b.r").alias("r"), F.col("_b.lag").cast("long").alias("lag"))


def attribution_scores(
    has_quake: Column, best_r: Column, coupling: Column, duration: Column, *, threshold: float = 0.5
) -> dict[str, Column]:
    """Score per category from the per-segment evidence columns."""
    r = F.abs(F.coalesce(best_r, F.lit(0.0)))
    scores = {
        "missing_forcing": F.when(r >= threshold, F.least(r, F.lit(1.0))).otherwise(0.0),
        "coupling_residual": F.when(coupling, F.when(duration >= 60, 0.7).otherwise(0.4)).otherwise(0.0),
        "earthquake_response": F.when(has_quake, 1.0).otherwise(0.0),
        "slow_event": F.when((duration >= 90) & (r < threshold) & ~has_quake, 0.7).otherwise(0.0),
    }
    top = F.greatest(*scores.values())
    scores["unmodeled"] = F.when(top < 0.3, 0.5).otherwise(0.0)
    return scores


def rank_attribution(scored: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Five ranked categories per segment from one column per category."""
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("pos"), F.lit(c).alias("category"))
                for i, c in enumerate(CATEGORIES)
            ]
        )
    )
    return scored.select(*ids, F.posexplode(ranked).alias("_p", "_c")).select(
        *ids, (F.col("_p") + 1).cast("long").alias("rank"), F.col("_c.category").alias("category"),
        (-F.col("_c.neg") + F.lit(0.0)).alias("score"),
    )


def attribute_anomaly(
    segments: DataFrame,
    rows: DataFrame,
    events: DataFrame,
    coupling: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    channels: Sequence[str],
) -> DataFrame:
    """Ranked attribution of every transient segment.

    ``events``: keys, idx of event samples; ``coupling``: keys, coupling_warning.
    """
    ids = [*keys, "onset_idx"]
    xc = lagged_xcorr(segments, rows, keys, value=value, channels=channels)
    order = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel"))
    best = xc.groupBy(*ids).agg(F.max_by("r", F.struct(F.abs("r"), -order)).alias("best_r"))
    seg = align.event_onset_match(segments, events, keys).join(best, ids, "left").join(
        coupling, list(keys), "left"
    )
    scores = attribution_scores(
        F.col("n_near_events") > 0, F.col("best_r"),
        F.coalesce("coupling_warning", F.lit(False)), F.col("duration_samples"),
    )
    return rank_attribution(seg.withColumns(scores), ids)


# --- coupling tiers -------------------------------------------------------------


def drainage_peclet(period_s: Column, length_m: Column, diffusivity: Column) -> Column:
    return period_s * diffusivity / (length_m * length_m)


def beta_eff(omega: Column, omega_drain: Column, beta_drained: Column, alpha_b: Column) -> Column:
    """Magnitude of the frequency-dependent coefficient."""
    x = omega / omega_drain
    ratio = (1 + F.pow(x / (1 - alpha_b), 2)) / (1 + x * x)
    return F.abs(beta_drained) * F.sqrt(ratio)


def escalation_level(pe: Column) -> Column:
    """Inner band warns, the rest of the outer band escalates."""
    return (
        F.when(pe.between(*PE_SOFT), "warn").when(pe.between(*PE_HARD), "escalate").otherwise("safe")
    )


def likelihood_label(score: Column) -> Column:
    out = F.lit("very low")
    for cut_off, name in reversed(LIKELIHOOD_LABELS):
        out = F.when(score >= cut_off, name).otherwise(out)
    return out


def coupling_likelihood(pe: Column, ratio: Column | None = None) -> Column:
    """Score in [0, 1]: closeness of Pe to 1 or deviation of the beta ratio."""
    pe_score = F.exp(-F.pow(F.log10(pe), 2))
    if ratio is None:
        return pe_score
    dev = clip(F.abs(ratio - 1) / 0.5, 0.0, 1.0)
    return F.greatest(pe_score, F.coalesce(dev, F.lit(0.0)))


def tier1_poroelastic(
    sites: DataFrame, keys: Sequence[str], *, tidal: DataFrame | None = None
) -> DataFrame:
    """Drainage regime per site.

    ``sites``: keys, period_s, length_m, diffusivity, beta_drained, alpha_b.
    ``tidal`` (keys, beta_tidal) adds the undrained-response warning.
    """
    pe = drainage_peclet(F.col("period_s"), F.col("length_m"), F.col("diffusivity"))
    omega_drain = F.col("diffusivity") / (F.col("length_m") * F.col("length_m"))
    beta = beta_eff(2 * math.pi / F.col("period_s"), omega_drain, F.col("beta_drained"), F.col("alpha_b"))
    out = sites.select(*keys, "beta_drained", pe.alias("peclet"), beta.alias("beta_eff")).withColumn(
        "ratio", F.col("beta_eff") / F.nullif("beta_drained", F.lit(0.0))
    )
    out = out.withColumn("tier1_status", escalation_level(F.col("peclet"))).withColumn(
        "tier1_score", coupling_likelihood(F.col("peclet"), F.col("ratio"))
    )
    warn = F.lit(False)
    if tidal is not None:
        out = out.join(tidal, list(keys), "left")
        warn = F.coalesce(F.col("beta_tidal") / F.nullif("beta_drained", F.lit(0.0)) > 1.5, F.lit(False))
    return out.withColumn("tidal_warning", warn)


def tidal_windows(
    dvv: DataFrame, strain: DataFrame, keys: Sequence[str], *, period_h: float = 12.4206, n_cycles: int = 60
) -> DataFrame:
    """Amplitude ratio dv/v : strain at the tidal period per tumbling window."""
    near = align.asof_nearest_tolerance(dvv.where(F.col("dvv").isNotNull()), strain, keys, out="strain")
    rows = near.where(F.col("strain").isNotNull())
    secs = (micros("ts") - F.col("_t0")) / 1e6
    period_s = period_h * 3600.0
    win = key_stats(rows, keys, {"_t0": F.min(micros("ts"))}).withColumn("t_s", secs).withColumn(
        "window", F.floor(F.col("t_s") / (n_cycles * period_s)).cast("long")
    )
    ids = [*keys, "window"]
    a = harmonic_fit(win, ids, "dvv", period_s=period_s, t_s=F.col("t_s"), out="amp_dvv")
    b = harmonic_fit(win, ids, "strain", period_s=period_s, t_s=F.col("t_s"), out="amp_strain").drop("n_rows")
    return a.join(b, ids).where((F.col("n_rows") >= 8) & (F.col("amp_strain") > 0)).withColumn(
        "ratio", F.col("amp_dvv") / F.col("amp_strain")
    )


def tidal_ratio_summary(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median ratio and 1.4826 x MAD over the windows of a key."""
    med = exact_quantiles(windows, keys, F.col("ratio"), {"beta_tidal": 0.5})
    dev = windows.join(med, list(keys)).withColumn("_d", F.abs(F.col("ratio") - F.col("beta_tidal")))
    mad = exact_quantiles(dev, keys, F.col("_d"), {"_mad": 0.5})
    return med.join(mad, list(keys)).select(*keys, "beta_tidal", (1.4826 * F.col("_mad")).alias("sigma"))


#: running sums of one side of a split; h is the reservoir, w the weight of a complete row
_SIDE = ("rows", "h", "n", "bad", "w", "wh", "whh", "wd", "whd", "wdd")
#: decayed sums over the rows from a split on: power of the decay, term
_FADED = {"a1": (1, "rows"), "w1": (1, "w"), "h1": (1, "wh"), "d1": (1, "wd"), "w2": (2, "w")}


def _split_sums(base: DataFrame, keys: list[str], d: str, sigma: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the sums before them, of their key and, decayed, from them to the end of their chunk; and the decayed
    sums of all later chunks, one row a chunk."""
    rate = forcing.BASEFLOW_RATE
    span = min(CHUNK_DAYS * 86400.0, 30.0 / (2 * rate))
    reach = math.ceil(745.0 / (rate * span)) + 1
    rows = forcing.reservoir(base, keys, out="_h")
    rows = rows.withColumns({"_d": finite(d), "_s": finite(sigma)})
    full = F.col("_d").isNotNull() & F.col("_s").isNotNull()
    w = F.when(full & (F.col("_s") > 0), 1.0 / (F.col("_s") * F.col("_s"))).otherwise(0.0)
    h, dd = F.col("_h"), F.coalesce("_d", F.lit(0.0))
    terms = {
        "rows": F.lit(1.0), "h": h, "n": full.cast("double"), "bad": (full & (F.col("_s") <= 0)).cast("double"),
        "w": w, "wh": w * h, "whh": w * h * h, "wd": w * dd, "whd": w * h * dd, "wdd": w * dd * dd,
    }
    t = micros("ts") / 1e6
    rows = rows.select(*keys, "ts", "_h", t.alias("_t"), *[e.alias(f"_{n}_") for n, e in terms.items()])
    rows = rows.withColumn("_chunk", F.floor(F.col("_t") / span).cast("long")).withColumn("_age", F.col("_t") - F.col("_chunk") * span)
    faded = {x: F.col(f"_{c}_") * F.exp(F.lit(-k * rate) * F.col("_age")) for x, (k, c) in _FADED.items()}
    totals = rows.groupBy(*keys, "_chunk").agg(*[F.sum(e).alias(x) for x, e in faded.items()])
    later = W.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rangeBetween(-reach, -1)
    totals = totals.withColumn("_after", F.collect_list(F.struct("_chunk", *_FADED)).over(later))

    def of_later(x: str, k: int) -> Column:
        fade = lambda p: F.exp(F.lit(-k * rate * span) * (p["_chunk"] - F.col("_chunk")))
        return F.aggregate("_after", F.lit(0.0), lambda acc, p: acc + p[x] * fade(p))

    carried = [of_later(x, k).alias(f"_later_{x}") for x, (k, _) in _FADED.items()]
    carried = totals.select(*keys, "_chunk", *carried)
    rows = key_stats(rows, keys, {f"_all_{c}": F.sum(f"_{c}_") for c in _SIDE})
    rows = running(rows, keys, ["ts"], {**{f"_to_{c}": ("sum", F.col(f"_{c}_")) for c in _SIDE}, "_last": ("lag", F.struct("_t", "_h"))})
    rest = W.partitionBy(*keys, "_chunk").orderBy(F.col("ts").desc()).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({f"_rest_{x}": F.sum(e).over(rest) for x, e in faded.items()}), carried


def _line(s: dict) -> list[Column]:
    """Normal equations of [1, h less its mean] from the sums of one side."""
    m = s["h"] / s["rows"]
    wx = s["wh"] - m * s["w"]
    return [
        s["n"].cast("long").alias("n_obs"), F.array(s["w"], wx, s["whh"] - 2 * m * s["wh"] + m * m * s["w"]).alias("xtwx"),
        F.array(s["wd"], s["whd"] - m * s["wd"]).alias("xtwd"), s["wdd"].alias("dtwd"), F.when(s["bad"] > 0, 0.0).otherwise(1.0).alias("min_sigma"),
    ]


def tier2_split_window(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    splits: DataFrame | None = None,
    n_splits: int = 4,
    min_samples: int = 90,
    d: str = "dvv",
    sigma: str = "dvv_err",
) -> DataFrame:
    """Step changes of the hydrological coefficient, one row per usable split.

    ``splits`` (keys, split_ts) are event times, any number of them; without it
    the record is split evenly.  The reservoir restarts on each side.

    The rows are scanned once, whatever the number of splits: the side before a split has the running sums of the normal
    equations, the side after it the rest. What the reservoir held at the split fades from there on at the known rate, so the restart is
    the running reservoir less a multiple of that fade, whose sums are decayed sums from the end.
    """
    keys = list(keys)
    rate = forcing.BASEFLOW_RATE
    base = rows.na.drop(subset=["precipitation", d])
    if splits is None:
        ends = base.groupBy(*keys).agg(F.min(micros("ts")).alias("_a"), F.max(micros("ts")).alias("_b"))
        steps = F.array(*[F.lit(k / (n_splits + 1.0)) for k in range(1, n_splits + 1)])
        splits = ends.select(*keys, F.explode(steps).alias("_f"), "_a", "_b").select(
            *keys, F.timestamp_micros((F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).cast("long")).alias("split_ts")
        )
    summed, carried = _split_sums(base, keys, d, sigma)
    state = [c for c in summed.columns if c not in (*keys, "ts")]
    at = align.neighbours(
        splits.select(*keys, "split_ts"), summed.select(*keys, F.col("ts").alias("split_ts"), F.struct("ts", *state).alias("value")), keys, x="split_ts"
    )
    first = F.when(F.col("prev.x") == F.col("split_ts"), F.col("prev.v")).otherwise(F.col("next.v"))  # first row of the side after
    at = at.select(*keys, "split_ts", first.alias("_r")).where(F.col("_r").isNotNull() & F.col("_r._last").isNotNull())
    at = at.select(*keys, "split_ts", "_r.*").join(carried, [*keys, "_chunk"])
    whole = {c: F.col(f"_all_{c}") for c in _SIDE}
    pre = {c: F.col(f"_to_{c}") - F.col(f"_{c}_") for c in _SIDE}
    post = {c: whole[c] - pre[c] for c in _SIDE}
    gap = F.col("_t") - F.col("_last._t")
    fade = {
        x: (F.col(f"_rest_{x}") + F.col(f"_later_{x}")) * F.exp(F.lit(k * rate) * (F.col("_age") - gap)) for x, (k, _) in _FADED.items()
    }
    held = F.col("_last._h")  # in the reservoir at the last row before the split
    post |= {
        "h": post["h"] - held * fade["a1"], "wh": post["wh"] - held * fade["w1"],
        "whh": post["whh"] - 2 * held * fade["h1"] + held * held * fade["w2"], "whd": post["whd"] - held * fade["d1"],
    }
    sides = {"all": whole, "pre": pre, "post": post}
    lines = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), *_line(s)) for n, s in sides.items()])).alias("_l")
    fits = solve_normal(at.select(*keys, "split_ts", lines).select(*keys, "split_ts", "_l.*"), [INTERCEPT, "p1_dGWL"])
    fits = fits.select(*keys, "split_ts", "side", "n_obs", F.col("coef")[1].alias("p1"), F.sqrt(F.col("cov")[3]).alias("p1_std"))
    pick = lambda side, c: F.max(F.when((F.col("side") == side) & (F.col("n_obs") >= min_samples), F.col(c)))
    per = fits.groupBy(*keys, "split_ts").agg(
        F.max(F.when(F.col("side") == "all", F.col("p1"))).alias("_pooled"),
        *[pick(s, c).alias(f"{c}_{s}") for s in ("pre", "post") for c in ("p1", "p1_std", "n_obs")],
    ).where(F.col("p1_pre").isNotNull() & F.col("p1_post").isNotNull())
    denom = F.when(F.abs("_pooled") > 0, F.abs("_pooled")).otherwise(1.0)
    apart = (
        (F.col("p1_pre") + 2 * F.col("p1_std_pre") < F.col("p1_post") - 2 * F.col("p1_std_post"))
        | (F.col("p1_post") + 2 * F.col("p1_std_post") < F.col("p1_pre") - 2 * F.col("p1_std_pre"))
    )
    return per.select(
        *keys, "split_ts", F.col("n_obs_pre").alias("n_pre"), F.col("n_obs_post").alias("n_post"),
        "p1_pre", "p1_post",
        (F.abs(F.col("p1_post") - F.col("p1_pre")) / denom).alias("delta_relative"),
        apart.alias("non_overlap_2sigma"),
    )


def tier2_status(split_rows: DataFrame, keys: Sequence[str], *, soft: float = 0.3, hard: float = 1.0) -> DataFrame:
    m = F.col("max_delta_relative")
    return split_rows.groupBy(*keys).agg(
        F.count("*").alias("n_splits"), F.max("delta_relative").alias("max_delta_relative")
    ).select(
        *keys, "n_splits", "max_delta_relative",
        F.when(m >= hard, "escalate").when(m >= soft, "warn").otherwise("ok").alias("tier2_status"),
        F.least(m / hard, F.lit(1.0)).alias("tier2_score"),
    )


def rolling_slope(
    df: DataFrame, keys: Sequence[str], y: str, x: str, *, window: int = 365, step: int = 30, min_rows: int = 30
) -> DataFrame:
    """Slope of y on x in row windows of ``window`` every ``step`` rows.

    Each row is sent to the few windows that contain it; the regression is a
    plain aggregate per (key, window).
    """
    keys = list(keys)
    idx = with_row_index(df.select(*keys, "ts", y, x), keys, ["ts"])
    i = F.col("idx")
    first = F.greatest(F.ceil((i - (window - 1)) / step), F.lit(0)).cast("long")
    members = (
        key_stats(idx, keys, {"_last": F.max("idx")})
        .withColumn("_lo", first)
        .withColumn("_hi", F.floor(i / step).cast("long"))
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("window", F.explode(F.sequence("_lo", "_hi")))
        .where(F.col("window") * step + window - 1 <= F.col("_last"))
    )
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    xo, yo = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    centre = F.col("window") * step + window // 2
    agg = members.groupBy(*keys, "window").agg(
        F.count_if(ok).alias("_m"),
        F.var_pop(xo).alias("_vx"),
        F.regr_slope(yo, xo).alias("slope"),
        F.avg(x).alias("x_mean"),
        F.max(F.when(i == centre, F.col("ts"))).alias("centre_ts"),
    )
    return agg.where((F.col("_m") >= min_rows) & (F.col("_vx") > 0)).select(
        *keys, "window", "centre_ts", "slope", "x_mean"
    )


def tier3_saturation(
    rows: DataFrame, keys: Sequence[str], *, d: str = "dvv", window: int = 365, step: int = 30,
    soft: float = 0.5, hard: float = 1.0, corr_min: float = 0.4,
) -> DataFrame:
    """Variability of the rolling slope of dv/v on the antecedent index."""
    api = forcing.antecedent_index(rows, keys)
    slopes = rolling_slope(api, keys, d, "api", window=window, step=step)
    agg = slopes.groupBy(*keys).agg(
        F.count("*").alias("n_windows"),
        (F.stddev_pop("slope") / F.nullif(F.avg(F.abs("slope")), F.lit(0.0))).alias("_cv"),
        # magnitude centred, but scaled by the spread of the signed slope
        (
            F.covar_pop(F.abs("slope"), F.col("x_mean"))
            / (
                F.coalesce(F.nullif(F.stddev_pop("slope"), F.lit(0.0)), F.lit(1.0))
                * F.coalesce(F.nullif(F.stddev_pop("x_mean"), F.lit(0.0)), F.lit(1.0))
            )
        ).alias("corr_slope_api"),
    ).where(F.col("n_windows") >= 4)
    cv = F.coalesce("_cv", F.lit(0.0))
    status = F.when((cv >= hard) & (F.abs("corr_slope_api") >= corr_min), "escalate").when(cv >= soft, "warn").otherwise("ok")
    return agg.select(
        *keys, "n_windows", cv.alias("cv_slope"), "corr_slope_api",
        status.alias("tier3_status"), F.least(cv / hard, F.lit(1.0)).alias("tier3_score"),
    )


def tier4_thermo_capillary(
    rows: DataFrame, keys: Sequence[str], *, api_window: int = 90, smooth: int = 30, soft: float = 0.5, hard: float = 0.7
) -> DataFrame:
    """Seasonal correlation of temperature and the saturation proxy."""
    api = forcing.antecedent_index(rows, keys, window=api_window)
    lo, hi = smooth - 1 - (smooth - 1) // 2, (smooth - 1) // 2
    low = forcing.trailing_rows(
        api, keys,
        {"_t": (F.col("temperature"), lo, hi, "mean"), "_s": (F.col("api"), lo, hi, "mean")},
    )
    agg = low.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.corr("_t", "_s").alias("rho"))
    agg = agg.where((F.col("n_obs") >= 60) & F.col("rho").isNotNull())
    r = F.abs("rho")
    return agg.select(
        *keys, "n_obs", "rho",
        F.when(r >= hard, "escalate").when(r >= soft, "warn").otherwise("ok").alias("tier4_status"),
        F.least(r / hard, F.lit(1.0)).alias("tier4_score"),
    )


def max_tier_score(scores: Sequence[Column]) -> tuple[Column, Column]:
    """Largest tier score and its label."""
    top = F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in scores], F.lit(0.0))
    return top, likelihood_label(top)


def diagnose_all(
    tier1: DataFrame, tier2: DataFrame, tier3: DataFrame, tier4: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Combined report per site: warnings, escalations, deferred tiers, label."""
    keys = list(keys)
    out = tier1
    for t in (tier2, tier3, tier4):
        out = out.join(t.select(*keys, *[c for c in t.columns if c.startswith("tier")]), keys, "left")
    tiers = ("tier1", "tier2", "tier3", "tier4")
    score, label = max_tier_score([F.col(f"{t}_score") for t in tiers])

    def having(state: str):
        return [F.when(F.col(f"{t}_status") == state, F.lit(t)) for t in tiers]

    warnings = F.array_compact(
        F.array(*having("warn"), F.when(F.col("tidal_warning"), F.lit("tier1_tidal")))
    )
    escalations = F.array_compact(F.array(*having("escalate")))
    deferred = F.array_compact(
        F.array(*[F.when(F.col(f"{t}_status").isNull(), F.lit(t)) for t in tiers])
    )
    return out.select(
        *keys, "peclet", *[F.col(f"{t}_status") for t in tiers], warnings.alias("warnings"),
        escalations.alias("escalations"), deferred.alias("deferred"), score.alias("score"),
        label.alias("label"), (F.size(escalations) > 0).alias("escalate"),
    )
