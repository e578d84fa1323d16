"""Measurement uncertainty: ensembles, covariances, windows, depth inversion."""

from __future__ import annotations

from collections.abc import Sequence
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorlake.functions.exprs import clip, weaver_error
from tremorlake.operators.chain import chain_nodes
from tremorlake.operators.gibbs import hierarchical_dvv, measurement_covariance  # noqa: F401  (part of this family)
from tremorlake.operators.scan import (
    exact_quantiles,
    key_stats,
    micros,
    running,
    with_row_index,
)

# Weights of the window objective.
WINDOW_WEIGHTS = {
    "coherence": 0.22,
    "snr": 0.18,
    "cycles": 0.14,
    "wave_type": 0.16,
    "depth": 0.18,
    "uncertainty": 0.08,
    "stability": 0.04,
}
# Processing prior.
RULES = ("fixed", "envelope_pick_flatten", "moving")


def ensemble_variance(members: DataFrame, keys: Sequence[str], *, sigma: str = "sigma") -> DataFrame:
    """Mean, methodological, within and total standard deviation per epoch."""
    agg = members.groupBy(*keys).agg(
        F.count("*").alias("n_members"),
        F.avg("dvv").alias("mean"),
        F.coalesce(F.stddev_samp("dvv"), F.lit(0.0)).alias("method_std"),
        F.sqrt(F.avg(F.coalesce(F.col(sigma), F.lit(0.0)) ** 2)).alias("within_std"),
    )
    return agg.withColumn("total_std", F.sqrt(F.col("within_std") ** 2 + F.col("method_std") ** 2))


def band_marginal_error(choices: DataFrame, keys: Sequence[str], *, floor: str = "floor", bias: str | None = None) -> DataFrame:
    """Law of total variance over processing choices, per band."""
    b2 = F.lit(0.0) if bias is None else F.coalesce(F.max(bias), F.lit(0.0)) ** 2
    agg = choices.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col(floor) ** 2).alias("_w"),
        (F.coalesce(F.var_samp(floor), F.lit(0.0)) + b2).alias("_p"),
    )
    return agg.select(
        *keys, "n", F.sqrt("_w").alias("within"), F.sqrt("_p").alias("processing"), F.sqrt(F.col("_w") + F.col("_p")).alias("total")
    )


def window_model_average(
    df: DataFrame, keys: Sequence[str], *, score: str = "score", mean: str = "mean", sigma: str = "sigma",
    scale: float = 4.0, min_score: float | None = None,
) -> DataFrame:
    """Softmax(score) weighted average over coda windows with its variance parts."""
    rows = df.where(F.col(mean).isNotNull() & F.col(score).isNotNull())
    if min_score is not None:
        rows = rows.where(F.col(score) >= min_score)
    rows = key_stats(rows, keys, {"_top": F.max(score)}, salt_on=[mean])
    w, m = F.exp(scale * (F.col(score) - F.col("_top"))), F.col(mean)
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), F.sum(w).alias("_w"), F.sum(w * m).alias("_wm"),
        F.sum(w * m * m).alias("_wmm"), F.sum(w * F.col(sigma) ** 2).alias("_ws"),
    )
    avg = F.col("_wm") / F.col("_w")
    alea, epi = F.col("_ws") / F.col("_w"), F.greatest(F.col("_wmm") / F.col("_w") - avg * avg, F.lit(0.0))
    return agg.select(
        *keys, "n_windows", avg.alias("mean"), F.sqrt(alea).alias("aleatoric"), F.sqrt(epi).alias("epistemic"),
        F.sqrt(alea + epi).alias("total"),
    )


def _epoch_pairs(df: DataFrame, keys: Sequence[str], columns: Sequence[str], reach: int | None) -> DataFrame:
    """Ordered epoch pairs i <= j <= i + reach as an equi-join on the epoch number; all of a key without a reach."""
    if reach is None:
        left = df.select(*keys, "i", *[F.col(c).alias(f"{c}_i") for c in columns])
        right = df.select(*keys, F.col("i").alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
        return left.join(right, list(keys)).where(F.col("i") <= F.col("j"))
    left = df.select(*keys, "i", *[F.col(c).alias(f"{c}_i") for c in columns], F.explode(F.sequence(F.col("i"), F.col("i") + reach)).alias("j"))
    right = df.select(*keys, F.col("i").alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return left.join(right, [*keys, "j"])


def error_covariance(
    df: DataFrame, keys: Sequence[str], *, sigma: str, corr_length_days: float, common_mode: float = 0.0,
    kind: str = "exp", tolerance: float = 1e-12,
) -> DataFrame:
    """Temporal error covariance as a banded long table (i <= j).

    Entries whose correlation is below ``tolerance`` are exactly the constant
    ``common_mode`` squared to that tolerance; they are not stored, and ``beyond`` holds that constant.
    Pairs meet by time, whatever the spacing: an epoch joins its own and the next span of the
    reach, so the table grows with the epochs in reach, not with their square.
    """
    if corr_length_days <= 0 or kind not in ("exp", "gauss"):
        raise ValueError("need a positive correlation length and kind 'exp' or 'gauss'")
    reach_days = corr_length_days * (
        -math.log(tolerance) if kind == "exp" else math.sqrt(-2 * math.log(tolerance))
    )
    idx = with_row_index(df.select(*keys, "ts", sigma), keys, ["ts"], "i").withColumn("t", micros("ts") / 86_400e6)
    span = F.floor(F.col("t") / reach_days).cast("long")
    early = idx.select(*keys, "i", F.col("t").alias("t_i"), F.col(sigma).alias(f"{sigma}_i"), F.explode(F.array(span, span + 1)).alias("_span"))
    late = idx.select(*keys, F.col("i").alias("j"), F.col("t").alias("t_j"), F.col(sigma).alias(f"{sigma}_j"), span.alias("_span"))
    pairs = early.join(late, [*keys, "_span"]).where(F.col("i") <= F.col("j"))
    dt = F.col("t_j") - F.col("t_i")
    rho = F.exp(-dt / corr_length_days) if kind == "exp" else F.exp(-0.5 * F.pow(dt / corr_length_days, 2))
    return pairs.where(dt <= reach_days).select(
        *keys, "i", "j", (F.col(f"{sigma}_i") * F.col(f"{sigma}_j") * rho + common_mode**2).alias("cov"),
        F.lit(float(common_mode) ** 2).alias("beyond"),
    )


def methodological_cov(members: DataFrame, keys: Sequence[str], *, member: str, reach: int | None = None) -> DataFrame:
    """Across-member covariance of all epoch pairs, or of those up to ``reach`` epochs apart.

    The full table has a row for each pair of epochs; ``methodological_factor`` has the same matrix as a factor.
    """
    epochs = with_row_index(members.select(*keys, "ts").distinct(), keys, ["ts"], "i")
    rows = members.join(epochs, [*keys, "ts"]).select(*keys, member, "i", "dvv")
    pairs = _epoch_pairs(rows, [*keys, member], ["dvv"], reach)
    return pairs.groupBy(*keys, "i", "j").agg(
        F.count("*").alias("n_members"), F.covar_samp("dvv_i", "dvv_j").alias("cov")
    ).where(F.col("n_members") > 1)


def methodological_factor(members: DataFrame, keys: Sequence[str], *, member: str) -> DataFrame:
    """Factor form of the full across-member covariance: cov(i, j) = sum over members of f_i * f_j.

    Exact where every epoch has all members (the rank is members - 1); linear in the rows.
    """
    mean = members.groupBy(*keys, "ts").agg(F.avg("dvv").alias("_mean"), F.count("dvv").alias("n_members"))
    rows = members.join(mean, [*keys, "ts"]).where(F.col("n_members") > 1)
    factor = (F.col("dvv") - F.col("_mean")) / F.sqrt(F.col("n_members") - 1)
    return rows.select(*keys, member, "ts", "n_members", factor.alias("factor"))


def effective_n(df: DataFrame, keys: Sequence[str], *, sigma: str, corr_length_days: float, common_mode: float = 0.0) -> DataFrame:
    """Effective number of epochs under exponential correlation, without a matrix.

    The exponential kernel is Markov, so 1' C^-1 1 is a sum over neighbours.
    """
    prev = running(
        df.select(*keys, "ts", sigma), keys, ["ts"],
        {"_t": ("lag", micros("ts")), "_s": ("lag", F.col(sigma))},
    )
    y, y0 = 1.0 / F.col(sigma), 1.0 / F.col("_s")
    rho = F.exp(-(micros("ts") - F.col("_t")) / 86_400e6 / corr_length_days)
    step = F.when(F.col("_t").isNull(), y * y).otherwise(F.pow(y - rho * y0, 2) / (1 - rho * rho))
    agg = prev.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(step).alias("_q"), F.sum(y * y).alias("_d"))
    full = F.col("_q") / (1 + common_mode**2 * F.col("_q"))
    return agg.select(*keys, "n", (F.col("n") * full / F.col("_d")).alias("n_eff"))


def single_reference_cov(df: DataFrame, keys: Sequence[str], *, sigma: str, ref_index: int = 0) -> DataFrame:
    """Covariance of a single-reference series in factored form.

    Per epoch the diagonal ``var``; every off-diagonal entry equals ``ref_var``.
    """
    idx = with_row_index(df.select(*keys, "ts", sigma), keys, ["ts"], "i")
    rows = key_stats(idx, keys, {"_r": F.max(F.when(F.col("i") == ref_index, F.col(sigma)))})
    ref_var = F.col("_r") ** 2
    var = F.when(F.col("i") == ref_index, ref_var).otherwise(F.col(sigma) ** 2 + ref_var)
    return rows.select(*keys, "i", "ts", var.alias("var"), ref_var.alias("ref_var"))


def corr_length(resid: DataFrame, keys: Sequence[str], *, member: str, value: str = "residual", max_lag: int = 40) -> DataFrame:
    """Correlation length from the mean lag autocorrelation of ensemble residuals.

    exp(-lag / L) is fitted to log rho with weights rho^2; L is clipped to
    [dt, dt * max_lag].
    """
    from tremorlake.operators.diagnose import autocorr_lags

    mk = [*keys, member]
    acf = autocorr_lags(resid, mk, value, n_lags=max_lag)
    # mean products use n - lag terms, the variance uses n
    rho = acf.withColumn("r", F.col("rho") * F.col("n_obs") / (F.col("n_obs") - F.col("lag"))).where(F.col("lag") < F.col("n_obs"))
    mean = rho.groupBy(*keys, "lag").agg(F.avg("r").alias("r"))
    zero = mean.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("lag"), F.lit(1.0).alias("r"))
    pts = mean.unionByName(zero).withColumn("r", clip(F.col("r"), 1e-3, 1.0))
    gaps = running(resid.select(*keys, "ts").distinct(), keys, ["ts"], {"_p": ("lag", micros("ts"))})
    dt = exact_quantiles(gaps, keys, (micros("ts") - F.col("_p")) / 86_400e6, {"dt": 0.5})
    w, x, y = F.col("r") ** 2, F.col("lag").cast("double"), F.log("r")
    sums = pts.groupBy(*keys).agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"),
        F.sum(w * y).alias("wy"), F.sum(w * x * y).alias("wxy"), F.max("lag").alias("top"),
    )
    slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / (F.col("w") * F.col("wxx") - F.col("wx") ** 2)
    length = F.when(slope < 0, -F.col("dt") / slope).otherwise(F.col("dt") * F.col("top"))
    return sums.join(dt, list(keys)).select(
        *keys, "dt", F.greatest(F.least(length, F.col("dt") * F.col("top")), F.col("dt")).alias("corr_length_days")
    )


def _chain_of(edges: DataFrame, keys: Sequence[str], reach: int | None) -> DataFrame:
    """Epoch rows of the chain with the totals of their component (_n, _x, _u) and key (_ss, n_pairs), in one pass."""
    from pyspark.sql import Window as W

    w = 1.0 / (F.col("sigma") * F.col("sigma"))
    merged = edges.where((F.col("sigma") > 0) & (F.col("i") != F.col("j")) & F.col("rel").isNotNull()).groupBy(*keys, "i", "j").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("rel")).alias("wd"), F.sum(w * F.col("rel") * F.col("rel")).alias("wdd"),
        F.count("*").alias("m"),
    )
    if reach is None:
        reach = edges.agg(F.max(F.abs(F.col("i") - F.col("j")))).first()[0] or 1
    nodes = chain_nodes(merged, keys, reach=int(reach), pairs=True)
    key, comp = W.partitionBy(*keys), W.partitionBy(*keys, "comp")
    nodes = nodes.withColumns({"_ss": F.sum("ss").over(key), "n_pairs": F.sum("m").over(key)})
    return nodes.withColumns({"_n": F.count("*").over(comp), "_x": F.sum("x").over(comp), "_u": F.sum("u").over(comp)})


def _centred(g: Column, ui: Column, uj: Column) -> Column:
    """Entry of the pseudo-inverse from the held inverse, its row sums and their total."""
    n = F.col("_n")
    return g - (ui + uj) / n + F.col("_u") / (n * n)


def all_to_all_reference(edges: DataFrame, keys: Sequence[str], *, reach: int | None = None) -> DataFrame:
    """Reference-free series from pairwise differences (i, j, rel, sigma), with its standard errors.

    keys, i, dvv (minimum norm: the mean of every connected component is zero), sigma (root of the diagonal of the
    pseudo-inverse), component (its smallest epoch), n_pairs and residual_rms of the key. Pairs without a positive sigma or a value,
    and pairs of an epoch with itself, take no part. ``reach`` is the largest distance of a pair in epochs; it is measured if
    not given. Memory follows a block of epochs, as wide as the reach asks for (``chain``).
    """
    keys = list(keys)
    own = F.element_at("gs", F.array_position("js", F.col("i")).cast("int"))
    return _chain_of(edges, keys, reach).select(
        *keys, "i", (F.col("x") - F.col("_x") / F.col("_n")).alias("dvv"),
        F.sqrt(F.greatest(_centred(own, F.col("u"), F.col("u")), F.lit(0.0))).alias("sigma"),
        F.col("comp").alias("component"), "n_pairs", F.sqrt(F.greatest(F.col("_ss"), F.lit(0.0)) / F.col("n_pairs")).alias("residual_rms"),
    )


def all_to_all_covariance(edges: DataFrame, keys: Sequence[str], *, reach: int | None = None) -> DataFrame:
    """Covariance (keys, i, j, cov; i <= j) of the reference-free series for epochs at most ``reach`` apart.

    Entries of the pseudo-inverse of the weighted Laplacian, component by component; epochs of different components have none.
    """
    keys = list(keys)
    pairs = _chain_of(edges, keys, reach).select(*keys, "i", "u", "_n", "_u", F.explode(F.arrays_zip("js", "gs", "us")).alias("_p"))
    j = F.col("_p.js")
    return pairs.select(
        *keys, F.least("i", j).alias("i"), F.greatest("i", j).alias("j"), _centred(F.col("_p.gs"), F.col("u"), F.col("_p.us")).alias("cov")
    )


def flatten_lapse(t1: Column, freq: Column, qc: Column, snr: Column) -> Column:
    """Lapse at which the coda decays into the noise; NULL for snr <= 1."""
    return F.when((qc > 0) & (snr > 1) & (freq > 0), t1 + qc / (math.pi * freq) * F.log(snr))


def sample_choices(
    spark: SparkSession, bands: DataFrame, *, n_samples: int, weights: Sequence[float] = (0.5, 0.3, 0.2), seed: int = 0,
    start: tuple[float, float] = (3.0, 12.0), length: tuple[float, float] = (10.0, 40.0), moving_length: float = 5.0,
    moving_span: float = 40.0, qc: float = 40.0, snr0: float = 80.0, cc0: float = 0.98, cc_decay: float = 80.0,
) -> DataFrame:
    """Draws of (rule, band, window, cc) from a processing prior.

    Every draw is a hash of its number, so partitioning does not matter.
    ``bands``: frequency_hz; n_samples draws per band.
    """
    def u(tag: int) -> Column:
        return (F.pmod(F.xxhash64("frequency_hz", "draw", F.lit(seed), F.lit(tag)), F.lit(2**52)) + 0.5) / float(2**52)

    total = sum(weights)
    c1, c2 = weights[0] / total, (weights[0] + weights[1]) / total
    rows = bands.select("frequency_hz", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_samples).cast("long"))).alias("draw"))
    rule = F.when(u(1) < c1, RULES[0]).when(u(1) < c2, RULES[1]).otherwise(RULES[2])
    a = u(2)
    t1 = (
        F.when(F.col("rule") == RULES[0], start[0] + a * (start[1] - start[0]))
        .when(F.col("rule") == RULES[1], start[0] + 2.0 * a)
        .otherwise(start[0] + a * moving_span)
    )
    t2 = (
        F.when(F.col("rule") == RULES[0], F.col("t1") + length[0] + u(3) * (length[1] - length[0]))
        .when(F.col("rule") == RULES[1], flatten_lapse(F.col("t1"), F.col("frequency_hz"), F.lit(qc), F.lit(snr0)))
        .otherwise(F.col("t1") + moving_length)
    )
    out = rows.withColumn("rule", rule).withColumn("t1", t1).withColumn("t2", t2)
    return out.withColumn("cc", clip(cc0 * F.exp(-0.5 * (F.col("t1") + F.col("t2")) / cc_decay), 0.6, 0.999))


def choice_floor(choices: DataFrame) -> DataFrame:
    """Adds the within-choice standard error."""
    return choices.withColumn("floor", weaver_error(F.col("cc"), F.col("frequency_hz"), F.col("t1"), F.col("t2")))


# --- coda windows ---------------------------------------------------------------------


def candidate_windows(bands: DataFrame, starts: Sequence[float], durations: Sequence[float], substacks: Sequence[float | None] = (None,)) -> DataFrame:
    """Product of starts, durations, bands (fmin, fmax) and substacks."""
    arr = lambda vals: F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in vals])
    out = bands.withColumn("start_s", F.explode(arr(starts))).withColumn("_d", F.explode(arr(durations)))
    return out.withColumn("substack_days", F.explode(arr(substacks))).withColumn("end_s", F.col("start_s") + F.col("_d")).drop("_d")


def rolling_lapse_windows(bands: DataFrame, *, start_s: float, stop_s: float, duration_s: float, step_s: float) -> DataFrame:
    """Overlapping windows from early to late lapse; the last ends by stop_s."""
    if not (stop_s > start_s and duration_s > 0 and step_s > 0 and start_s + duration_s <= stop_s):
        raise ValueError("the first window must fit between start_s and stop_s")
    start_s, stop_s, duration_s, step_s = (float(v) for v in (start_s, stop_s, duration_s, step_s))
    last = int(math.floor((stop_s - duration_s - start_s) / step_s + 1e-9))
    k = F.explode(F.sequence(F.lit(0), F.lit(last)))
    out = bands.withColumn("_k", k).withColumn("start_s", start_s + F.col("_k") * step_s)
    return out.withColumn("end_s", F.col("start_s") + duration_s).drop("_k")


def window_scores(df: DataFrame) -> DataFrame:
    """Eight metrics, the weighted objective and flags per candidate window.

    Uses start_s, end_s, fmin, fmax and, when not NULL: coherence, snr, dvv_sigma,
    lapse_slope, distance_m, group_velocity, vs_mps, depth_lo_m, depth_hi_m,
    substack_days, forcing_period_days.
    """
    c = F.col
    centre, fc = (c("start_s") + c("end_s")) / 2, F.sqrt(c("fmin") * c("fmax"))
    v_app = c("distance_m") / F.greatest(centre, F.lit(1e-12))
    depth = c("vs_mps") / (3.0 * fc)
    edge = F.when(depth < c("depth_lo_m"), c("depth_lo_m")).otherwise(c("depth_hi_m"))
    limit = c("forcing_period_days") * 0.25
    bell = lambda ratio, width: F.exp(-0.5 * F.pow(F.log(ratio) / width, 2))
    metrics = {
        "coherence": c("coherence"),
        "snr": 1 - F.exp(-F.greatest(c("snr"), c("snr") * 0) / 5.0),
        "cycles": (c("end_s") - c("start_s")) * c("fmin") / 10.0,
        "wave_type": bell(v_app / c("group_velocity"), math.log(1.5)),
        "depth": F.when(depth.between(c("depth_lo_m"), c("depth_hi_m")), 1.0).otherwise(bell(depth / edge, math.log(2.0))),
        "uncertainty": F.exp(-c("dvv_sigma") / 1e-4),
        "stability": 1 / (1 + F.abs(c("lapse_slope")) / 0.20),
        "substack": F.when(c("substack_days") <= limit, 1.0).otherwise(F.exp(-(c("substack_days") / limit - 1))),
    }
    out = df.withColumns({f"m_{n}": clip(e, 0.0, 1.0) for n, e in metrics.items()})
    num = sum((w * F.coalesce(c(f"m_{n}"), F.lit(0.0)) for n, w in WINDOW_WEIGHTS.items()), start=F.lit(0.0))
    den = sum((F.when(c(f"m_{n}").isNotNull(), w).otherwise(0.0) for n, w in WINDOW_WEIGHTS.items()), start=F.lit(0.0))
    flags = [F.when(c(f"m_{n}") < 0.35, F.lit(f"low_{n}")) for n in metrics]
    flags.append(F.when(c("m_cycles") < 1.0, F.lit("fewer_than_10_cycles")))
    return out.withColumn("score", num / F.nullif(den, F.lit(0.0))).withColumn("flags", F.array_compact(F.array(*flags)))


def rank_windows(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank by score (NULL last), then start, band, end and substack; a key has a bounded window menu."""
    from pyspark.sql import Window as W

    ties = ["start_s", "fmin", "end_s", *(c for c in ("substack_days",) if c in scored.columns)]
    w = W.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), *ties)
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def lapse_profile(scored: DataFrame, keys: Sequence[str], *, min_score: float = 0.70) -> DataFrame:
    """Early-to-late position and eligibility of the windows of a key."""
    from pyspark.sql import Window as W

    ties = ["fmin", "start_s", *(c for c in ("substack_days",) if c in scored.columns)]
    w = W.partitionBy(*keys).orderBy((F.col("start_s") + F.col("end_s")) / 2, *ties)
    return scored.withColumn("position", F.row_number().over(w).cast("long")).withColumn(
        "eligible", F.coalesce(F.col("score") >= min_score, F.lit(False))
    )


def kernel_overlap(kernel: DataFrame, keys: Sequence[str], *, lo: float, hi: float) -> DataFrame:
    """Trapezoid share of |kernel| inside a depth range (keys, depth, g)."""
    nxt = running(
        kernel.withColumn("_a", F.abs("g")), keys, ["depth"],
        {"_d1": ("lag", F.col("depth")), "_a1": ("lag", F.col("_a"))},
        reverse=True, chunk=F.floor(F.col("depth") / 10_000).cast("long"),
    )
    area = (F.col("_a") + F.col("_a1")) / 2 * (F.col("_d1") - F.col("depth"))
    inside = (F.col("depth") >= lo) & (F.col("_d1") <= hi)
    agg = nxt.groupBy(*keys).agg(F.sum(area).alias("_t"), F.coalesce(F.sum(F.when(inside, area)), F.lit(0.0)).alias("_i"))
    return agg.select(*keys, F.when(F.col("_t") > 0, clip(F.col("_i") / F.col("_t"), 0.0, 1.0)).otherwise(0.0).alias("overlap"))


# --- depth -------------------------------------------------------------------------------


def kernel_matrix(kernel: DataFrame, keys: Sequence[str], *, max_depth_km: float | None = None) -> DataFrame:
    """Unit-area relative kernel times the depth step, from supplied tables.

    ``kernel``: keys (profile, band), depth_km, vs, c, dcdvs.  The step is the
    gradient of the depth grid (one-sided at the ends).
    """
    rows = kernel if max_depth_km is None else kernel.where(F.col("depth_km") <= max_depth_km)
    chunk = F.floor(F.col("depth_km") / 100).cast("long")
    z = F.col("depth_km")
    rows = running(rows, keys, ["depth_km"], {"_up": ("lag", z)}, chunk=chunk)
    rows = running(rows, keys, ["depth_km"], {"_dn": ("lag", z)}, chunk=chunk, reverse=True)
    both = F.col("_up").isNotNull() & F.col("_dn").isNotNull()
    # second-order gradient of the identity on an uneven grid is the mean step
    dz = F.when(both, (F.col("_dn") - F.col("_up")) / 2).otherwise(F.coalesce(F.col("_dn") - z, z - F.col("_up"), F.lit(0.0)))
    rows = rows.withColumn("_dz", dz).withColumn("_k", F.col("vs") / F.col("c") * F.col("dcdvs"))
    rows = key_stats(rows, keys, {"_area": F.sum(F.abs("_k") * F.col("_dz"))}, salt_on=["depth_km"])
    unit = F.when(F.col("_area") > 0, F.col("_k") / F.col("_area")).otherwise(F.col("_k"))
    return rows.select(*keys, "depth_km", (unit * F.col("_dz")).alias("g"))


def gain_matrix(kernel: DataFrame, band_cov: DataFrame, *, profile: str = "profile", prior_std: float = 5e-3, corr_length_km: float = 0.1) -> DataFrame:
    """Per profile the epoch-independent gain, posterior std and resolution.

    Works in data space: only an n_band x n_band system per profile is solved.
    ``factor`` holds the posterior covariance: prior less the product of the factors, summed over the bands
    (``depth_covariance``).
    ``kernel``: profile, band, depth_km, g; ``band_cov``: band_i, band_j, cov.
    """
    cov = band_cov.groupBy(F.col("band_i").alias("band")).agg(F.collect_list(F.struct("band_j", "cov")).alias("_cov"))
    src = kernel.select(profile, "band", "depth_km", "g").join(cov, "band")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.pivot_table(index="band", columns="depth_km", values="g").fillna(0.0)
        bands, z = list(g.index), g.columns.to_numpy(dtype=float)
        pos = {b: i for i, b in enumerate(bands)}
        cd = np.zeros((len(bands), len(bands)))
        for b, entries in pdf.groupby("band")["_cov"].first().items():
            for e in entries:
                if e["band_j"] in pos:
                    cd[pos[b], pos[e["band_j"]]] = e["cov"]
        gm = g.to_numpy()
        cm = prior_std**2 * np.exp(-0.5 * ((z[:, None] - z[None, :]) / corr_length_km) ** 2)
        gc = gm @ cm
        data = gc @ gm.T + cd
        gain = np.linalg.solve(data, gc).T
        std = np.sqrt(np.clip(np.diag(cm) - (gain * gc.T).sum(1), 0, None))
        factor = np.linalg.solve(np.linalg.cholesky((data + data.T) / 2), gc).T
        res = (gain * gm.T).sum(1)
        n, k = len(z), len(bands)
        return pd.DataFrame({
            profile: pdf[profile].iloc[0], "band": np.tile(bands, n), "depth_km": np.repeat(z, k), "gain": gain.ravel(),
            "std": np.repeat(std, k), "resolution": np.repeat(res, k), "factor": factor.ravel(),
        })

    kinds = {f.name: f.dataType.simpleString() for f in kernel.schema}
    return src.groupBy(profile).applyInPandas(
        solve, f"{profile} {kinds[profile]}, band {kinds['band']}, depth_km double, gain double, std double, resolution double, factor double"
    )


def depth_profile(gain: DataFrame, dvv_bands: DataFrame, keys: Sequence[str], *, profile: str = "profile") -> DataFrame:
    """Depth profile of every epoch: gain joined to the band vector and summed.

    The gain holds for all its bands together, so ``mean`` is NULL at an epoch that lacks one; ``n_bands`` counts
    those it has.
    """
    need = gain.groupBy(profile).agg(F.count_distinct("band").alias("_need"))
    joined = dvv_bands.where(F.col("dvv").isNotNull()).join(gain, [profile, "band"])
    sums = joined.groupBy(*keys, profile, "depth_km").agg(F.sum(F.col("gain") * F.col("dvv")).alias("_sum"), F.count_distinct("band").alias("n_bands"))
    whole = F.when(F.col("n_bands") == F.col("_need"), F.col("_sum"))
    return sums.join(need, profile).select(*keys, profile, "depth_km", "n_bands", whole.alias("mean"))


def depth_covariance(gain: DataFrame, *, profile: str = "profile", prior_std: float = 5e-3, corr_length_km: float = 0.1) -> DataFrame:
    """Posterior covariance of every pair of depths (profile, depth_i <= depth_j, cov), from the factors of ``gain_matrix``.

    It does not depend on the data, so it holds for every epoch that has all bands. Prior settings must be those of the gain.
    """
    rows = gain.groupBy(profile, "depth_km").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "factor"))), lambda x: x["factor"]).alias("_f"))
    left = rows.select(profile, F.col("depth_km").alias("depth_i"), F.col("_f").alias("_fi"))
    right = rows.select(profile, F.col("depth_km").alias("depth_j"), F.col("_f").alias("_fj"))
    both = left.join(right, profile).where(F.col("depth_i") <= F.col("depth_j"))
    gap = (F.col("depth_j") - F.col("depth_i")) / corr_length_km
    known = F.aggregate(F.zip_with("_fi", "_fj", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return both.select(profile, "depth_i", "depth_j", (prior_std**2 * F.exp(-0.5 * gap * gap) - known).alias("cov"))
