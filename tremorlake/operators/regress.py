"""Weighted least squares for every series at once.

Sums of the normal equations are ordinary aggregates (map-side partial sums, one
small row per key); only the p x p solve runs in Python, on Arrow batches of keys.
"""

from __future__ import annotations

from collections.abc import Sequence
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tremorlake.functions.exprs import GRAVITY, WATER_RHO, finite
from tremorlake.operators import align, forcing
from tremorlake.operators.scan import (
    attach,
    exact_quantiles,
    halo,
    is_hot,
    key_stats,
    micros,
    running,
    with_row_index,
)
from tremorlake.session import cut

INTERCEPT = "a0"
PHYSICAL_BOUNDS = {"p1_dGWL": (None, 0.0)}
AIC_GAIN = -4.0
LAG_BLOCK_DAYS = 400.0


def _x(c: str) -> Column:
    return F.lit(1.0) if c == INTERCEPT else F.col(c)


def complete(df: DataFrame, d: str, columns: Sequence[str], sigma: str | None) -> DataFrame:
    """Rows with finite data, predictors and (positive) sigma."""
    used = [c for c in (d, *columns) if c != INTERCEPT] + ([sigma] if sigma else [])
    return df.withColumns({c: finite(c) for c in used}).na.drop(subset=used)


def normal_equations(
    df: DataFrame, keys: Sequence[str], d: str, columns: Sequence[str], sigma: str | None = None
) -> DataFrame:
    """Per key: n_obs, xtwx (row-major upper triangle), xtwd, dtwd, min_sigma."""
    rows = complete(df, d, columns, sigma)
    w = F.lit(1.0) if sigma is None else F.when(F.col(sigma) > 0, 1.0 / (F.col(sigma) * F.col(sigma)))
    upper = [
        F.sum(w * _x(columns[i]) * _x(columns[j]))
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        F.array(*upper).alias("xtwx"),
        F.array(*[F.sum(w * _x(c) * F.col(d)) for c in columns]).alias("xtwd"),
        F.sum(w * F.col(d) * F.col(d)).alias("dtwd"),
        (F.lit(1.0) if sigma is None else F.min(sigma)).alias("min_sigma"),
    )


def _box_solution(n: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Exact box-constrained quadratic minimum of a small system.

    Tries every free / at-lower / at-upper choice of the bounded parameters and
    keeps the feasible one with the smallest objective.
    """
    p = len(b)
    options = [
        [None] + [v for v in (lo[i], hi[i]) if np.isfinite(v)] for i in range(p)
    ]
    best, best_f, best_free = None, np.inf, None
    for choice in itertools.product(*options):
        free = np.array([c is None for c in choice])
        x = np.array([0.0 if c is None else c for c in choice])
        if free.any():
            rhs = b[free] - n[np.ix_(free, ~free)] @ x[~free]
            x[free] = np.linalg.lstsq(n[np.ix_(free, free)], rhs, rcond=None)[0]
        if np.any(x < lo - 1e-12) or np.any(x > hi + 1e-12):
            continue
        f = 0.5 * x @ n @ x - b @ x
        if f < best_f - 1e-15 * abs(best_f if np.isfinite(best_f) else 0.0):
            best, best_f, best_free = x, f, free
    return best, best_free


def _solver(columns: Sequence[str], bounds: dict | None, weighted: bool):
    p = len(columns)
    iu = np.triu_indices(p)
    lo = np.array([-np.inf if (bounds or {}).get(c, (None, None))[0] is None else bounds[c][0] for c in columns])
    hi = np.array([np.inf if (bounds or {}).get(c, (None, None))[1] is None else bounds[c][1] for c in columns])
    constrained = bool(np.isfinite(lo).any() or np.isfinite(hi).any())

    def solve(xtwx, xtwd, dtwd, n_obs, min_sigma):
        coef, cov, rank = [], [], []
        for a, b, dd, m, s in zip(xtwx, xtwd, dtwd, n_obs, min_sigma):
            if not s > 0:  # a key with a sigma that is not positive has no fit; the others go on
                coef.append(None)
                cov.append(None)
                rank.append(None)
                continue
            full = np.zeros((p, p))
            full[iu] = a
            full = full + full.T - np.diag(np.diag(full))
            scale = np.sqrt(np.where(np.diag(full) > 0, np.diag(full), 1.0))
            n, rhs = full / np.outer(scale, scale), np.asarray(b) / scale
            if constrained:
                x, free = _box_solution(n, rhs, lo * scale, hi * scale)
                r = int(free.sum())
            else:
                x, _, r, _ = np.linalg.lstsq(n, rhs, rcond=1e-13)
                free = np.ones(p, bool)
            c = np.linalg.inv(n) if np.linalg.matrix_rank(n, 1e-13) == p else np.linalg.pinv(n, rcond=1e-13)
            if not weighted:
                rss = max(dd - 2 * x @ rhs + x @ n @ x, 0.0)
                c = c * rss / max(m - r, 1)
            c = c / np.outer(scale, scale)
            c[~free, :] = 0.0
            c[:, ~free] = 0.0
            coef.append((x / scale).tolist())
            cov.append(c.ravel().tolist())
            rank.append(int(r))
        return pd.DataFrame({"coef": coef, "cov": cov, "rank": pd.array(rank, "Int32")})

    return solve


def solve_normal(
    ne: DataFrame, columns: Sequence[str], *, bounds: dict | None = None, weighted: bool = True,
    keep_sums: bool = False,
) -> DataFrame:
    """Adds coef, cov (row-major) and rank to the normal-equation rows."""
    solve = _solver(columns, bounds, weighted)

    @F.pandas_udf("coef array<double>, cov array<double>, rank int")
    def run(a: pd.Series, b: pd.Series, dd: pd.Series, n: pd.Series, s: pd.Series) -> pd.DataFrame:
        return solve(a, b, dd, n, s)

    out = ne.withColumn("_s", run("xtwx", "xtwd", "dtwd", "n_obs", "min_sigma"))
    return out.select(
        *[c for c in ne.columns if keep_sums or c not in ("xtwx", "xtwd", "dtwd", "min_sigma")],
        "_s.coef", "_s.cov", F.col("_s.rank").cast("long").alias("rank"),
    )


def wls_fit(
    df: DataFrame,
    keys: Sequence[str],
    d: str,
    columns: Sequence[str],
    *,
    sigma: str | None = None,
    bounds: dict | None = None,
) -> DataFrame:
    """Per key: n_obs, rank, coef, cov.  Without sigma the covariance is scaled by RSS/dof.

    A key with a sigma that is not positive gets NULL rank, coef and cov.

    With an active bound the bounded parameter gets a zero row and column, the
    others keep their variance from the full inverse.
    """
    ne = normal_equations(df, keys, d, columns, sigma)
    return solve_normal(ne, columns, bounds=bounds, weighted=sigma is not None)


def with_residuals(
    df: DataFrame, fit: DataFrame, keys: Sequence[str], d: str, columns: Sequence[str], sigma: str | None = None
) -> DataFrame:
    """Adds fitted and residual to every complete row, keyed, so ts stays with it."""
    rows = complete(df, d, columns, sigma)
    joined = attach(rows, fit.select(*keys, "coef", "rank"), keys, ["ts"])
    fitted = sum((F.col("coef")[i] * _x(c) for i, c in enumerate(columns)), start=F.lit(0.0))
    return joined.withColumn("fitted", fitted).withColumn("residual", F.col(d) - F.col("fitted"))


def fit_stats(resid: DataFrame, keys: Sequence[str], n_par: int, sigma: str | None = None) -> DataFrame:
    """chi2_red (weighted), rss and AIC (unweighted) per key from residual rows."""
    s = F.lit(1.0) if sigma is None else F.col(sigma)
    sums = resid.groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        F.max("rank").alias("rank"),
        F.sum((F.col("residual") / s) ** 2).alias("_chi2"),
        F.sum(F.col("residual") ** 2).alias("rss"),
    )
    dof = F.greatest(F.col("n_obs") - F.col("rank"), F.lit(1))
    aic = F.when(
        F.col("rss") > 0, F.col("n_obs") * F.log(F.col("rss") / F.col("n_obs")) + 2 * n_par
    )
    return sums.withColumn("chi2_red", F.col("_chi2") / dof).withColumn("aic", aic).drop("_chi2")


def coef_summary(fit: DataFrame, keys: Sequence[str], columns: Sequence[str], units: dict[str, str] | None = None) -> DataFrame:
    """Long table: param, mean, std, ci95_low, ci95_high, units."""
    p = len(columns)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("param"),
                F.col("coef")[i].alias("mean"),
                F.sqrt(F.greatest(F.col("cov")[i * p + i], F.lit(0.0))).alias("std"),
                F.lit((units or {}).get(c, "fraction")).alias("units"),
            )
            for i, c in enumerate(columns)
        ]
    )
    flat = fit.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return flat.select(
        "*",
        (F.col("mean") - 1.96 * F.col("std")).alias("ci95_low"),
        (F.col("mean") + 1.96 * F.col("std")).alias("ci95_high"),
    )


def build_design(
    aligned: DataFrame,
    keys: Sequence[str],
    *,
    hydro_model: str = "baseflow",
    time_shift_days: float = 50.0,
    loading: str | None = None,
    loading_model: str = "instantaneous",
    bulk_modulus_gpa: float = 1.0,
    events: DataFrame | None = None,
    event_names: Sequence[str] = (),
    porosity: float = 0.05,
    rate_per_s: float = forcing.BASEFLOW_RATE,
    window_rows: int = forcing.CDM_WINDOW,
    warmup: DataFrame | None = None,
) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Design columns in fixed order: a0, p1_dGWL, p2_T, s_eq_*, p3_load.

    Rows without every forcing are left out first.  Returns the table, the
    parameter order and the units.
    """
    names, units = [INTERCEPT], {INTERCEPT: "fraction"}
    have = [c for c in ("precipitation", "temperature", loading) if c and c in aligned.columns]
    rows = aligned.na.drop(subset=have)
    if "precipitation" in have:
        hydro_units = {
            "baseflow": "fraction / m water head",
            "cdm": "fraction / m cumulative departure",
            "precomputed": "fraction / precomputed unit",
            "talwani": "fraction / Pa",
            "drained": "fraction / Pa",
        }[hydro_model]
        if hydro_model == "baseflow":
            rows = forcing.reservoir(rows, keys, porosity=porosity, rate_per_s=rate_per_s, out="_h")
        elif hydro_model == "cdm":
            rows = forcing.cdm(rows, keys, window_rows=window_rows, warmup=warmup, out="_h")
        elif hydro_model in ("talwani", "drained"):
            grid = forcing.daily_grid(rows, keys, "precipitation")
            press = forcing.pressure_convolve(grid, keys, drained_only=hydro_model == "drained")
            press = press.withColumn("ts", F.timestamp_micros(F.col("day_no") * 86_400_000_000))
            src = press.select(*keys, "ts", F.col("pressure").alias("value"))
            rows = align.interp_linear(rows, src, keys, out="_h")
        else:
            rows = rows.withColumn("_h", F.col("precipitation"))
        rows = forcing.centre_column(rows, keys, "_h", "p1_dGWL").drop("_h")
        names.append("p1_dGWL")
        units["p1_dGWL"] = hydro_units
    if "temperature" in have:
        rows = forcing.thermo_shift(rows, keys, shift_days=time_shift_days, out="p2_T")
        names.append("p2_T")
        units["p2_T"] = "fraction / degC"
    if events is not None and event_names:
        heal = forcing.healing(rows, events, keys)
        wide = heal.groupBy(*keys, "ts").agg(
            *[
                F.coalesce(F.sum(F.when(F.col("event_id").cast("string") == e, F.col("healing"))), F.lit(0.0)).alias(f"s_eq_{e}")
                for e in event_names
            ]
        )
        rows = rows.join(wide, [*keys, "ts"], "left").na.fill(0.0, [f"s_eq_{e}" for e in event_names])
        names += [f"s_eq_{e}" for e in event_names]
        units.update({f"s_eq_{e}": "fraction" for e in event_names})
    if loading and loading in have:
        if loading_model == "snowpack":
            rows = forcing.snowpack(rows, keys, load=loading, out="_l")
        else:
            rows = rows.withColumn("_l", F.col(loading))
        rows = rows.withColumn("_l", forcing.surface_load(F.col("_l"), bulk_modulus_gpa=bulk_modulus_gpa))
        rows = forcing.centre_column(rows, keys, "_l", "p3_load").drop("_l")
        names.append("p3_load")
        units["p3_load"] = "fraction / strain"
    if len(names) == 1:
        raise ValueError("the design needs at least one forcing")
    return rows, names, units


def _lag_sums(pdf: pd.DataFrame, names: Sequence[str], d: str, sigma: str, lags_us: np.ndarray, span_us: int) -> dict | None:
    """Normal sums of one block for every lag; rows of earlier blocks only serve the interpolation."""
    pdf = pdf.sort_values("_t", kind="stable")
    t, block = pdf["_t"].to_numpy(), int(pdf["_block"].iloc[0])
    own = (t // span_us == block) & pdf["_full"].to_numpy(bool)
    if not own.any():
        return None
    first, zero = pdf.iloc[0], block * span_us  # the first row brings the sample before it
    knots, value = t - zero, pdf["_v"].to_numpy()
    if pd.notna(first["_t0"]):
        knots, value = np.append(int(first["_t0"]) - zero, knots), np.append(first["_v0"], value)
    rows = pdf[own]
    x = np.stack([np.ones(len(rows)) if c == INTERCEPT else np.zeros(len(rows)) if c == "p2_T" else rows[c].to_numpy(float) for c in names], 1)
    y, s = rows[d].to_numpy(float), rows[sigma].to_numpy(float)
    w = np.where(s > 0, 1.0 / np.where(s > 0, s, 1.0) ** 2, 0.0)
    at = t[own][None, :] - zero - lags_us[:, None]
    lagged = np.interp(at, knots, value)
    lagged[at < int(first["_start"]) - zero] = 0.0  # before the record
    k, wx = list(names).index("p2_T"), x * w[:, None]
    m = np.repeat((x.T @ wx)[None], len(lags_us), 0)
    b = np.repeat((wx.T @ y)[None], len(lags_us), 0)
    m[:, k, :] = m[:, :, k] = lagged @ wx
    m[:, k, k], b[:, k] = (lagged * lagged) @ w, lagged @ (w * y)
    upper = np.triu_indices(len(names))
    return {"n_obs": len(rows), "xtwx": m[:, upper[0], upper[1]].ravel(), "xtwd": b.ravel(), "dtwd": float(w @ (y * y)), "min_sigma": float(s.min())}


def shift_scan(
    aligned: DataFrame,
    keys: Sequence[str],
    *,
    shifts_days: Sequence[float],
    d: str = "dvv",
    sigma: str = "dvv_err",
    bounds: dict | None = PHYSICAL_BOUNDS,
    **design,
) -> tuple[DataFrame, DataFrame]:
    """Profile the thermal lag for every key and shift in one pass.

    Epochs are grouped into time blocks, each with the epochs that its lags reach back to; a block gives the sums of the normal
    equations of all lags, the blocks' sums are added up per key, and each lag is one small solve. No row is made per
    epoch and lag, so what is shuffled does not depend on their number.  Returns (best per key, chi2 curve).
    """
    if any(s < 0 or not math.isfinite(s) for s in shifts_days):
        raise ValueError("shifts must be finite and non-negative")
    keys = list(keys)
    base, names, _ = build_design(aligned, keys, time_shift_days=0.0, **design)
    grid = sorted({float(s) for s in shifts_days})
    lags_us = np.array([int(s * align.DAY_US) for s in grid], np.int64)
    reach_us = int(lags_us[-1])
    span_us = max(2 * reach_us, int(LAG_BLOCK_DAYS * align.DAY_US))
    others = [n for n in names if n not in (INTERCEPT, "p2_T")]
    used = [d, sigma, *others]
    rows = base.withColumns({c: finite(c) for c in used})
    full = F.lit(True)
    for c in used:
        full = full & F.col(c).isNotNull()
    rows = rows.select(*keys, *used, micros("ts").alias("_t"), "temperature", full.alias("_full"))
    rows = key_stats(rows, keys, {"_mu": F.avg("temperature"), "_start": F.min("_t")}, salt_on=["_t"])
    rows = rows.withColumn("_v", F.col("temperature") - F.col("_mu")).drop("temperature", "_mu")
    before = running(rows, keys, ["_t"], {"_p": ("lag", F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))}, chunk=F.floor(F.col("_t") / span_us))
    home = lambda c: F.floor(c / span_us).cast("long")
    spread = before.select("*", F.col("_p.t").alias("_t0"), F.col("_p.v").alias("_v0"), F.explode(F.sequence(home(F.col("_t")), home(F.col("_t") + reach_us))).alias("_block")).drop("_p")
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    head = "".join(f"{k} {kinds[k]}, " for k in keys)
    sums = "n_obs long, xtwx array<double>, xtwd array<double>, dtwd double, min_sigma double"

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        part = _lag_sums(pdf, names, d, sigma, lags_us, span_us)
        cols = [*keys, "n_obs", "xtwx", "xtwd", "dtwd", "min_sigma"]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **part}] if part else [], columns=cols)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = {c: pdf[c].sum() for c in ("n_obs", "dtwd")} | {c: np.sum(np.stack(pdf[c].to_numpy()), axis=0) for c in ("xtwx", "xtwd")}
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **total, "min_sigma": pdf["min_sigma"].min()}])

    parts = spread.groupBy(*keys, "_block").applyInPandas(block, head + sums)
    merged = parts.groupBy(*keys).applyInPandas(merge, head + sums)
    p = len(names)
    tri = p * (p + 1) // 2
    lags = F.posexplode(F.array(*[F.lit(s) for s in grid])).alias("_k", "shift_days")
    piece = lambda c, width: F.slice(c, F.col("_k") * width + 1, F.lit(width)).alias(c)
    ne = merged.select("*", lags).select(*keys, "shift_days", "n_obs", piece("xtwx", tri), piece("xtwd", p), "dtwd", "min_sigma")
    # the weighted chi2 follows from the sums: no second pass over the epochs
    fit = solve_normal(ne, names, bounds=bounds, keep_sums=True)
    pos = 0
    quad = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            quad = quad + (1.0 if i == j else 2.0) * F.col("coef")[i] * F.col("coef")[j] * F.col("xtwx")[pos]
            pos += 1
    lin = sum((F.col("coef")[i] * F.col("xtwd")[i] for i in range(p)), start=F.lit(0.0))
    chi2 = (F.col("dtwd") - 2 * lin + quad) / F.greatest(F.col("n_obs") - F.col("rank"), F.lit(1))
    curve = fit.withColumn("chi2_red", chi2).drop("xtwx", "xtwd", "dtwd", "min_sigma")
    best = curve.groupBy(*keys).agg(
        F.min_by(
            F.struct("shift_days", "chi2_red", "coef", "cov", "n_obs"),
            F.struct("chi2_red", "shift_days"),
        ).alias("b")
    ).select(*keys, "b.*")
    return best, curve


def best_shift(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First shift with the smallest chi2, ignoring NULL."""
    return curve.where(F.col("chi2_red").isNotNull()).groupBy(*keys).agg(
        F.min_by("shift_days", F.struct("chi2_red", "shift_days")).alias("shift_days"),
        F.min("chi2_red").alias("chi2_red"),
    )


def pearson(df: DataFrame, keys: Sequence[str], a: Column, b: Column, out: str) -> DataFrame:
    """Population Pearson correlation, 0 for degenerate input."""
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    agg = df.groupBy(*keys).agg(
        F.corr(x, y).alias("_r"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy")
    )
    return agg.select(
        *keys, F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_r")).otherwise(0.0).alias(out)
    )


def solve3(s: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Solution of a symmetric 3 x 3 system; s = s00 s01 s02 s11 s12 s22."""
    s00, s01, s02, s11, s12, s22 = s
    c00, c01, c02 = s11 * s22 - s12 * s12, s02 * s12 - s01 * s22, s01 * s12 - s02 * s11
    c11, c12, c22 = s00 * s22 - s02 * s02, s01 * s02 - s00 * s12, s00 * s11 - s01 * s01
    det = s00 * c00 + s01 * c01 + s02 * c02
    ok = F.abs(det) > 0
    rows = [(c00, c01, c02), (c01, c11, c12), (c02, c12, c22)]
    return [F.when(ok, (r[0] * b[0] + r[1] * b[1] + r[2] * b[2]) / det) for r in rows]


def harmonic_fit(
    df: DataFrame, keys: Sequence[str], value: str, *, period_s: float = forcing.YEAR_S,
    t_s: Column | None = None, out: str = "amplitude",
) -> DataFrame:
    """Amplitude of the sin/cos pair of one period (with constant), per key."""
    t = micros("ts") / 1e6 if t_s is None else t_s
    ang = 2 * math.pi * t / period_s
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.sin(ang).alias("s"), F.cos(ang).alias("c"), F.col(value).alias("y")
    )
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        *[F.sum(e).alias(n) for n, e in {
            "ss": F.col("s") * F.col("s"), "sc": F.col("s") * F.col("c"), "s1": F.col("s"),
            "cc": F.col("c") * F.col("c"), "c1": F.col("c"),
            "ys": F.col("y") * F.col("s"), "yc": F.col("y") * F.col("c"), "y1": F.col("y"),
        }.items()],
    )
    x = solve3(
        [F.col(c) for c in ("ss", "sc", "s1", "cc", "c1")] + [F.col("n_rows").cast("double")],
        [F.col(c) for c in ("ys", "yc", "y1")],
    )
    return sums.select(*keys, "n_rows", F.hypot(x[0], x[1]).alias(out))


def fourier_decompose(df: DataFrame, keys: Sequence[str], value: str, *, harmonics: int = 5) -> DataFrame:
    """Least squares on the first harmonics of the record span.

    Long output: k (0 = mean), a (cosine), b (sine), period_s.
    """
    rows = key_stats(df, keys, {"_t0": F.min(micros("ts")), "_t1": F.max(micros("ts"))}).withColumn(
        "_span", F.col("_t1") - F.col("_t0")
    )
    names = [INTERCEPT]
    for k in range(1, harmonics + 1):
        ang = 2 * math.pi * k * (micros("ts") - F.col("_t0")) / F.col("_span")
        rows = rows.withColumn(f"_c{k}", F.cos(ang)).withColumn(f"_s{k}", F.sin(ang))
        names += [f"_c{k}", f"_s{k}"]
    fit = wls_fit(rows, [*keys, "_span"], value, names)
    terms = F.array(
        F.struct(F.lit(0).alias("k"), F.col("coef")[0].alias("a"), F.lit(0.0).alias("b")),
        *[
            F.struct(F.lit(k).alias("k"), F.col("coef")[2 * k - 1].alias("a"), F.col("coef")[2 * k].alias("b"))
            for k in range(1, harmonics + 1)
        ],
    )
    out = fit.select(*keys, "_span", F.explode(terms).alias("t"))
    return out.select(
        *keys, F.col("t.k").cast("long").alias("k"), "t.a", "t.b",
        F.when(F.col("t.k") > 0, F.col("_span") / 1e6 / F.col("t.k")).alias("period_s"),
    )


def wet_dry_variance(
    df: DataFrame, keys: Sequence[str], value: str, *, precipitation: str = "precipitation", quantile: float = 0.9
) -> DataFrame:
    """Variance ratio of wet to dry rows; 1 when either side is too small."""
    rows = df.where(F.col(value).isNotNull() & F.col(precipitation).isNotNull()).select(
        *keys, "ts", value, precipitation
    )
    if is_hot(df, None):
        thr = exact_quantiles(rows, keys, F.col(precipitation), {"threshold": quantile})
        rows = attach(rows, thr, keys, ["ts"])
    else:
        rows = key_stats(rows, keys, {"threshold": F.percentile(precipitation, F.lit(quantile))})
    wet = F.col(precipitation) > F.col("threshold")
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if(wet).alias("n_wet"),
        F.max("threshold").alias("threshold"),
        F.var_samp(F.when(wet, F.col(value))).alias("_vw"),
        F.var_samp(F.when(~wet, F.col(value))).alias("_vd"),
    )
    ok = (
        (F.col("n_rows") > 30) & (F.col("n_wet") > 5)
        & (F.col("n_rows") - F.col("n_wet") > 5) & (F.col("_vd") > 0)
    )
    return agg.select(
        *keys, "n_rows", "n_wet", "threshold",
        F.when(ok, F.col("_vw") / F.col("_vd")).otherwise(1.0).alias("var_ratio"),
    )


def low_freq_drift(df: DataFrame, keys: Sequence[str], value: str, *, window: int = 365) -> DataFrame:
    """Sample std of the centred rolling mean (at least a quarter of the window);
    the std of the series itself when it is not longer than the window."""
    idx = with_row_index(df.select(*keys, "ts", value), keys, ["ts"], "_i")
    lo, hi = window - 1 - (window - 1) // 2, (window - 1) // 2
    need = max(window // 4, 1)
    rolled = halo(
        idx, keys, F.col("_i"), lo, hi,
        {"_roll": lambda w: F.when(F.count(value).over(w) >= need, F.avg(value).over(w))},
    )
    return rolled.groupBy(*keys).agg(
        F.when(F.count("*") > window, F.stddev_samp("_roll"))
        .otherwise(F.stddev_samp(value)).alias("drift_std")
    )


def residual_patterns(
    resid: DataFrame, keys: Sequence[str], *, value: str = "residual", sigma: str = "dvv_err",
    precipitation: str = "precipitation", drift_window: int = 365,
) -> DataFrame:
    """Storm-band, seasonal and drift diagnostics with their flags."""
    keys = list(keys)
    both = resid.where(F.col(precipitation).isNotNull() & F.col(value).isNotNull())
    r = pearson(both, keys, F.abs(F.col(value)), F.col(precipitation), "_r")
    ratio = wet_dry_variance(resid, keys, value, precipitation=precipitation)
    amp = harmonic_fit(resid, keys, value, out="_amp").withColumnRenamed("n_rows", "_n")
    drift = low_freq_drift(resid, keys, value, window=drift_window)
    sig = exact_quantiles(resid, keys, F.col(sigma), {"_sig": 0.5})
    s = F.when(F.col("_sig") > 0, F.col("_sig")).otherwise(1.0)
    out = r.join(ratio, keys).join(amp, keys).join(drift, keys).join(sig, keys)
    out = out.select(
        *keys,
        F.when(F.col("n_rows") > 30, F.abs("_r")).otherwise(0.0).alias("storm_pearson"),
        F.col("var_ratio").alias("storm_var_ratio"),
        (F.when(F.col("_n") > 30, F.col("_amp")).otherwise(0.0) / s).alias("seasonal_norm"),
        (F.col("drift_std") / s).alias("drift_norm"),
    )
    return out.select(
        "*",
        ((F.col("storm_pearson") >= 0.2) | (F.col("storm_var_ratio") >= 1.5)).alias("storm_band"),
        (F.col("seasonal_norm") >= 1.0).alias("seasonal"),
        (F.col("drift_norm") >= 1.0).alias("low_freq_drift"),
    )


def staged_fit(
    aligned: DataFrame,
    keys: Sequence[str],
    site_state: DataFrame,
    *,
    loading: str = "precipitation",
    d: str = "dvv",
    sigma: str = "dvv_err",
    drift_window: int = 365,
    **design,
) -> DataFrame:
    """Stage A without loading, stage B with it, for every key in one job.

    ``site_state``: keys, tier1_status, loading_enabled.  Loading is recommended
    when the storm flag fires and tier 1 is safe, and accepted when it lowers the
    AIC by at least 4.
    """
    keys = list(keys)
    rows, names_b, _ = build_design(
        aligned.withColumn("_load", F.col(loading)), keys, loading="_load", **design
    )
    rows = cut(rows)  # feeds both stages and the residual diagnostics
    names_a = [n for n in names_b if n != "p3_load"]
    fits, stats = {}, {}
    for stage, names in (("a", names_a), ("b", names_b)):
        fit = wls_fit(rows, keys, d, names, sigma=sigma, bounds=PHYSICAL_BOUNDS)
        resid = with_residuals(rows, fit, keys, d, names, sigma)
        fits[stage] = resid
        stats[stage] = fit_stats(resid, keys, len(names), sigma).select(
            *keys, F.col("aic").alias(f"aic_{stage}"), F.col("chi2_red").alias(f"chi2_{stage}")
        )
    patterns = residual_patterns(
        fits["a"], keys, sigma=sigma, drift_window=drift_window
    ).select(*keys, "storm_band", "seasonal", "low_freq_drift")
    out = stats["a"].join(stats["b"], keys).join(patterns, keys).join(site_state, keys)
    recommend = F.col("storm_band") & (F.col("tier1_status") == "safe")
    delta = F.col("aic_b") - F.col("aic_a")
    tried = recommend & F.col("loading_enabled")
    accept = tried & (delta <= AIC_GAIN)
    reason = (
        F.when(~F.col("storm_band"), "no storm-band residual structure")
        .when(~recommend, "storm-band structure but tier 1 not safe")
        .when(~F.col("loading_enabled"), "loading disabled for this site")
        .when(accept, "loading accepted")
        .otherwise("loading rejected: AIC gain below 4")
    )
    trail = F.array_compact(
        F.array(
            F.concat(F.lit("stage A chi2_red="), F.format_number("chi2_a", 2)),
            F.concat(
                F.lit("patterns storm="), F.col("storm_band").cast("string"),
                F.lit(" seasonal="), F.col("seasonal").cast("string"),
                F.lit(" drift="), F.col("low_freq_drift").cast("string"),
            ),
            F.when(tried, F.concat(F.lit("stage B delta_aic="), F.format_number(delta, 1))),
            reason,
        )
    )
    return out.select(
        *keys, "aic_a", "aic_b", "chi2_a", "chi2_b",
        "storm_band", "seasonal", "low_freq_drift",
        recommend.alias("recommended"), accept.alias("accepted"),
        F.when(tried, delta).alias("delta_aic"),
        F.when(accept, "stage_b").otherwise("stage_a").alias("stage"),
        reason.alias("reason"), trail.alias("trail"),
    )


def pressure_sensitivity(coef: DataFrame, moduli: DataFrame, keys: Sequence[str]) -> DataFrame:
    """d(dv/v)/dp, effective beta and mu' from the hydrological coefficient.

    Only head and Pa predictors convert; other units give a note.
    """
    unit = F.col("units")
    scale = F.when(unit == "fraction / m water head", 1.0 / (WATER_RHO * GRAVITY)).when(
        unit == "fraction / Pa", 1.0
    )
    rows = coef.where(F.col("param") == "p1_dGWL").join(moduli, list(keys))
    kappa, mu = F.col("kappa_pa"), F.col("mu_pa")
    s, s_std = F.col("mean") * scale, F.col("std") * scale
    return rows.select(
        *keys,
        s.alias("d_dvv_dp"),
        s_std.alias("d_dvv_dp_std"),
        (s * kappa).alias("beta_eff"),
        (s_std * kappa).alias("beta_eff_std"),
        (-2.0 * mu * s).alias("mu_prime"),
        (2.0 * mu * s_std).alias("mu_prime_std"),
        F.when(scale.isNull(), F.concat(F.lit("not converted to pressure: "), unit)).alias("note"),
    )


def posterior_draws(
    fit: DataFrame, keys: Sequence[str], columns: Sequence[str], *, n_draws: int = 1000, seed: int = 7
) -> DataFrame:
    """Joint Gaussian draws of the parameters of each fit row (coef, cov): keys, param, draw, value.

    One factor of each key's small covariance (also a singular one, of bounded parameters) is taken;
    the normals are hashes of (key, draw, number), so the result does not depend on partitioning.
    """
    p = len(columns)

    @F.pandas_udf("array<double>")
    def factor(cov: pd.Series) -> pd.Series:
        def one(c):
            w, v = np.linalg.eigh(np.asarray(c, float).reshape(p, p))
            return (v * np.sqrt(np.clip(w, 0, None))).ravel()

        return cov.map(lambda c: None if c is None else one(c))

    def normal(i: Column) -> Column:
        u = [(F.pmod(F.xxhash64(*keys, "draw", i, F.lit(seed), F.lit(t)), F.lit(2**52)) + 0.5) / float(2**52) for t in (1, 2)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])

    ready = fit.where(F.col("coef").isNotNull()).select(*keys, "coef", factor("cov").alias("_f"))
    draws = ready.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_draws)).cast("array<long>")).alias("draw"))
    draws = draws.withColumn("_z", F.array(*[normal(F.lit(k)) for k in range(p)]))
    value = lambda i: sum((F.col("_f")[i * p + k] * F.col("_z")[k] for k in range(p)), start=F.col("coef")[i])
    rows = F.array(*[F.struct(F.lit(c).alias("param"), value(i).alias("value")) for i, c in enumerate(columns)])
    return draws.select(*keys, "draw", F.explode(rows).alias("r")).select(*keys, "r.param", "draw", "r.value")


def bootstrap_draws(samples: DataFrame, keys: Sequence[str], *, n_draws: int = 1000, seed: int = 7, order: str = "sample") -> DataFrame:
    """Draws from a posterior that is given as samples: rows of ``samples`` per key, with replacement, numbered by ``draw``.

    The number of a drawn row is a hash of key and draw, so reruns agree; rows are numbered by ``order``, and a draw meets its row in
    an equi-join. A key without samples has no draws.
    """
    keys = list(keys)
    rows = with_row_index(samples, keys, [order], "_i", chunk=F.floor(F.col(order) / 4096))
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    draws = size.select(*keys, "_n", F.explode(F.sequence(F.lit(1), F.lit(n_draws)).cast("array<long>")).alias("draw"))
    draws = draws.select(*keys, "draw", F.pmod(F.xxhash64(*keys, "draw", F.lit(seed)), F.col("_n")).alias("_i"))
    return draws.join(rows, [*keys, "_i"]).drop("_i")


def propagate(draws: DataFrame, keys: Sequence[str], **functions: Column) -> DataFrame:
    """Mean and standard deviation over the draws of each key, for every named function of the drawn columns."""
    aggs = [a for n, f in functions.items() for a in (F.avg(f).alias(f"{n}_mean"), F.stddev_samp(f).alias(f"{n}_std"))]
    return draws.groupBy(*keys).agg(F.count("*").alias("n_draws"), *aggs)


def truth_recovery_check(coef: DataFrame, truth: DataFrame, keys: Sequence[str], *, z_max: float = 4.0) -> DataFrame:
    """z score of each fitted parameter against a truth table."""
    z = (F.col("mean") - F.col("truth")) / F.nullif(F.col("std"), F.lit(0.0))
    return coef.join(truth, [*keys, "param"]).select(
        *keys, "param", "mean", "std", "truth", z.alias("z"), (F.abs(z) < z_max).alias("ok")
    )
