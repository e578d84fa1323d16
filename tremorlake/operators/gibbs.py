"""Hierarchical posterior of a common series, many series at a time.

A smoothing prior on second differences makes the precision of the series pentadiagonal. A draw is one solve: the right-hand
side gets noise whose covariance is the precision itself. The system is seen as 2 x 2 blocks along time and solved by
cyclic reduction, which halves the blocks each step with array operations over all blocks, chains and keys, so a sweep has no loop
over epochs, keys or chains.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

FIELDS = ("mu_mean", "mu_lo", "mu_hi", "tau", "s", "within_std", "method_std", "total_std", "corr_length_days", "n_eff")
MAX_LAG = 40
#: numbers held for the kept draws of the series worked on together
DRAWS = 8_000_000


def _times(a, b):
    """Product of 2 x 2 blocks, each given as its four entries by row."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3])


def _apply(a, x):
    return a[0] * x[0] + a[1] * x[1], a[2] * x[0] + a[3] * x[1]


def _turned(a):
    return a[0], a[2], a[1], a[3]


def _inverse(d):
    """Inverse of symmetric blocks (entries 00, 01, 11)."""
    det = d[0] * d[2] - d[1] * d[1]
    off = -d[1] / det
    return d[2] / det, off, off, d[0] / det


def _even(x, fill):
    """Two halves of an array along its last axis, even and odd places; an odd length is filled up."""
    if x.shape[-1] % 2:
        x = np.concatenate([x, np.full((*x.shape[:-1], 1), fill)], -1)
    return x[..., 0::2], x[..., 1::2]


def penta_solve(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve symmetric positive pentadiagonal systems along the last axis; d1 and d2 are the first and second upper diagonals
    (entry t couples t with t + 1 or t + 2; what reaches beyond the end is ignored)."""
    n = d0.shape[-1]
    d1, d2 = d1.copy(), d2.copy()
    d1[..., n - 1 :], d2[..., max(n - 2, 0) :] = 0.0, 0.0
    (d00, d11), (low, up), (e00, e11), f = _even(d0, 1.0), _even(d1, 0.0), _even(d2, 0.0), _even(rhs, 0.0)
    d, e = (d00, low, d11), (e00, np.zeros_like(e00), up, e11)
    steps = []
    while d[0].shape[-1] > 1:
        (da, odd_a), (db, odd_b), (dc, odd_c) = (_even(x, fill) for x, fill in zip(d, (1.0, 0.0, 1.0)))
        to, on = zip(*(_even(x, 0.0) for x in e))  # coupling of an odd block with the even ones before and after
        (f0, g0), (f1, g1) = (_even(x, 0.0) for x in f)
        inv = _inverse((odd_a, odd_b, odd_c))
        a, c = _times(to, inv), _times(_turned(on), inv)
        steps.append((inv, to, on, (g0, g1)))
        left, right = _times(a, _turned(to)), _times(c, on)
        d, e, f = [da - left[0], db - left[1], dc - left[3]], [-x for x in _times(a, on)], [f0, f1]
        for x, r in zip(d, (right[0], right[1], right[3])):
            x[..., 1:] -= r[..., :-1]
        from_left, from_right = _apply(a, (g0, g1)), _apply(c, (g0, g1))
        for k in range(2):
            f[k] = f[k] - from_left[k]
            f[k][..., 1:] -= from_right[k][..., :-1]
    x = _apply(_inverse(d), f)
    for inv, to, on, g in reversed(steps):
        size = inv[0].shape[-1]
        after = [np.concatenate([v[..., 1 : size + 1], np.zeros((*v.shape[:-1], max(0, size + 1 - v.shape[-1])))], -1) for v in x]
        before, later = _apply(_turned(to), [v[..., :size] for v in x]), _apply(on, after)
        odd = _apply(inv, [g[k] - before[k] - later[k] for k in range(2)])
        both = []
        for k in range(2):
            v = np.empty((*x[k].shape[:-1], 2 * size))
            v[..., 0::2], v[..., 1::2] = x[k][..., :size], odd[k]
            both.append(v)
        x = both
    half = x[0].shape[-1]
    out = np.empty((*x[0].shape[:-1], 2 * half))
    out[..., 0::2], out[..., 1::2] = x[0], x[1]
    return out[..., :n]


def _second(x: np.ndarray) -> np.ndarray:
    return x[..., 2:] - 2 * x[..., 1:-1] + x[..., :-2]


def _spread(e: np.ndarray) -> np.ndarray:
    """Transpose of the second difference."""
    out = np.zeros((*e.shape[:-1], e.shape[-1] + 2))
    out[..., :-2] += e
    out[..., 1:-1] -= 2 * e
    out[..., 2:] += e
    return out


def sample(m: np.ndarray, v: np.ndarray, lengths: np.ndarray, members: np.ndarray, rngs: list, *, chains: int, n_iter: int, burn: int, thin: int,
           a0: float = 2.0, b0: float = 1e-8, lam_a: float = 2.0, lam_b: float = 1e-10):
    """Draws of (mu, tau2, s2): arrays (kept, keys, chains, ...) for ``m`` and variances ``v`` of shape (keys, members, epochs).

    A missing value has infinite variance. Keys shorter than the longest, or with fewer members, are padded.
    """
    keys, most, n = m.shape
    w = 1.0 / v
    m = np.where(w > 0, m, 0.0)
    live = np.arange(n) < lengths[:, None]
    bend = (np.arange(n - 2) < lengths[:, None] - 2).astype(float)[:, None]  # second differences inside the series
    ones = np.ones_like(bend)
    q0, q1, q2 = np.zeros((keys, 1, n)), np.zeros((keys, 1, n)), np.zeros((keys, 1, n))
    for step, c in enumerate((1.0, -2.0, 1.0)):
        q0[..., step : n - 2 + step] += c * c * bend
    q1[..., : n - 2] += -2.0 * bend
    q1[..., 1 : n - 1] += -2.0 * bend
    q2[..., : n - 2] += bend * ones
    idle = np.where(live, 0.0, 1.0)[:, None]
    p, pm = w.sum(1)[:, None], (w * m).sum(1)[:, None]
    wk, wm = w.sum(2)[:, None], (w * m).sum(2)[:, None]  # (keys, 1, members)
    seen, is_member = (w > 0).sum((1, 2))[:, None], np.arange(most) < members[:, None]
    is_member = is_member[:, None]
    counts = np.maximum((w > 0).sum(1), 1)
    mu = np.repeat(((m * (w > 0)).sum(1) / counts)[:, None], chains, 1)
    level = [(m[k][: members[k]] * (w[k][: members[k]] > 0)).sum(1) / np.maximum((w[k][: members[k]] > 0).sum(1), 1) for k in range(keys)]
    tau2 = np.repeat(np.array([x.var() for x in level])[:, None] + 1e-12, chains, 1)
    s2 = np.ones((keys, chains))
    lam = np.stack([np.repeat(1.0 / (np.diff(mu[k, 0, : lengths[k]], 2).var() + 1e-12), chains) for k in range(keys)])
    beta = np.zeros((keys, chains, most))

    def normal(sizes, width: int) -> np.ndarray:
        """Normal numbers of each key's own size, so that padding does not move its stream."""
        out = np.zeros((keys, chains, width))
        for k, (r, size) in enumerate(zip(rngs, sizes)):
            out[k, :, :size] = r.standard_normal((chains, size))
        return out

    gamma = lambda a, b: np.stack([r.gamma(x, 1.0, chains) for r, x in zip(rngs, a)]) / b
    kept = []
    for it in range(n_iter):
        s, ll = s2[..., None], lam[..., None]
        noise = np.sqrt(p / s) * normal(lengths, n) + _spread(np.sqrt(ll) * bend * normal(lengths - 2, n - 2))
        rhs = (pm - np.einsum("kcm,kmt->kct", beta, w)) / s + noise
        mu = penta_solve(p / s + ll * q0 + idle, ll * q1, ll * q2, rhs)
        prec = 1.0 / tau2[..., None] + wk / s
        beta = (wm - np.einsum("kmt,kct->kcm", w, mu)) / s / prec + normal(members, most) / np.sqrt(prec)
        beta = np.where(is_member, beta, 0.0)
        tau2 = 1.0 / gamma(a0 + members / 2, b0 + 0.5 * (beta**2).sum(-1))
        fit = mu[:, :, None] + beta[..., None]
        ss = np.einsum("kmt,kcmt->kc", w, (m[:, None] - fit) ** 2)
        s2 = 1.0 / gamma(a0 + seen[:, 0] / 2, b0 + 0.5 * ss)
        lam = gamma(lam_a + (lengths - 2) / 2, lam_b + 0.5 * (bend * _second(mu) ** 2).sum(-1))
        if it >= burn and (it - burn) % thin == 0:
            kept.append((mu, tau2, s2))
    return tuple(np.stack([k[i] for k in kept]) for i in range(3))


def corr_length(resid: np.ndarray, days: np.ndarray) -> float:
    """Correlation length from the mean lag autocorrelation of members (rows; NaN where missing)."""
    r = resid - np.nanmean(resid, axis=1, keepdims=True)
    n, var = r.shape[1], np.nanmean(r**2, axis=1)
    top = min(n - 1, MAX_LAG)
    products = lambda g: np.nanmean(r[:, : n - g] * r[:, g:], axis=1) if g else var
    with np.errstate(invalid="ignore"):
        rho = np.array([np.nanmean(products(g) / (var + 1e-30)) for g in range(top + 1)])
    rho = np.clip(np.nan_to_num(rho, nan=1e-3), 1e-3, 1.0)
    dt = float(np.median(np.diff(days))) if n > 1 else 1.0
    lags, y, w = np.arange(top + 1) * dt, np.log(rho), rho**2
    slope = (w.sum() * (w * lags * y).sum() - (w * lags).sum() * (w * y).sum()) / (w.sum() * (w * lags**2).sum() - (w * lags).sum() ** 2)
    length = -1.0 / slope if slope < 0 else dt * top
    return float(np.clip(length, dt, dt * top))


def n_effective(sigma: np.ndarray, days: np.ndarray, length: float, common: float) -> float:
    """Effective number of epochs under exponential correlation and a common mode; the kernel is Markov, so sums do."""
    y, rho = 1.0 / sigma, np.exp(-np.diff(days) / length)
    q = y[0] ** 2 + ((y[1:] - rho * y[:-1]) ** 2 / (1 - rho**2)).sum()
    return float(len(y) * (q / (1 + common**2 * q)) / (y**2).sum())


def _wide(pdf: pd.DataFrame, member: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(epochs, values and variances by member and epoch)."""
    values = pdf.pivot_table(index=member, columns="t", values="dvv", dropna=False)
    sigma = pdf.pivot_table(index=member, columns="t", values="sigma", dropna=False).to_numpy()
    m = values.to_numpy()
    return values.columns.to_numpy(), m, np.where(np.isfinite(m), np.clip(sigma, 1e-9, None) ** 2, np.inf)


def _summary(t, m, v, mu, tau2, s2, epoch_days) -> pd.DataFrame:
    has = np.isfinite(m)
    tau, s = float(np.sqrt(tau2.mean())), float(np.sqrt(s2.mean()))
    draws = mu.reshape(-1, mu.shape[-1])
    lo, hi = np.percentile(draws, [2.5, 97.5], axis=0)
    mean, days = draws.mean(0), t * epoch_days
    filled = np.where(has, m, np.nan)
    n = has.sum(0)
    centred = np.where(has, filled - np.nansum(filled, 0) / n, 0.0)
    method = np.sqrt((centred**2).sum(0) / np.maximum(n - 1, 1))
    within = s * np.sqrt(np.where(has, v, 0.0).sum(0) / n)
    total = np.sqrt(within**2 + method**2)
    length = corr_length(filled - mean, days)
    return pd.DataFrame({
        "t": t, "mu_mean": mean, "mu_lo": lo, "mu_hi": hi, "tau": tau, "s": s, "within_std": within, "method_std": method,
        "total_std": total, "corr_length_days": length, "n_eff": n_effective(total, days, length, tau),
    })


def hierarchical_dvv(
    members: DataFrame, keys: Sequence[str], *, member: str, n_iter: int = 1500, burn: int = 500, thin: int = 2, seed: int = 0,
    chains: int = 1, epoch_days: float = 1.0, buckets: int | None = None,
) -> DataFrame:
    """Gibbs posterior of the common series mu(t) of each key, with the measurement covariance as a factor.

    Rows: keys, member, t (epoch number, ``epoch_days`` long), dvv, sigma. A member may lack epochs; every epoch of any member is
    kept. A key of fewer than four epochs gives no rows. Chains and keys are axes of one array; each key draws from its own
    stream, seeded by a hash of the key, so batching does not change a result. Per epoch: mean and 95 % band of mu, the three
    standard deviations; per key: tau, s, the correlation length of the residuals and the effective number of epochs.
    ``measurement_covariance`` expands the factor (total_std, corr_length_days, tau).
    """
    keys = list(keys)
    buckets = buckets or int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.to_json(F.struct(*keys))
    src = members.select(*keys, member, "t", "dvv", "sigma", F.xxhash64(*keys, F.lit(seed)).alias("_seed"), name.alias("_key")).where(
        F.col("dvv").isNotNull() & F.col("sigma").isNotNull()
    ).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    names = [*keys, "t", *FIELDS]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        series = [(g, *_wide(g, member)) for _, g in pdf.groupby("_key", sort=True)]
        series = sorted((s for s in series if len(s[1]) >= 4), key=lambda s: len(s[1]))
        out, at = [], 0
        while at < len(series):
            # neighbours in length share a batch, as far as the kept draws allow
            stop = at + 1
            while stop < len(series) and (stop + 1 - at) * chains * (n_iter // thin) * len(series[stop][1]) <= DRAWS:
                stop += 1
            part, at = series[at:stop], stop
            n, most = max(len(t) for _, t, _, _ in part), max(len(m) for _, _, m, _ in part)
            m, v = np.zeros((len(part), most, n)), np.full((len(part), most, n), np.inf)
            for k, (_, t, mk, vk) in enumerate(part):
                m[k, : len(mk), : len(t)], v[k, : len(mk), : len(t)] = mk, vk
            rngs = [np.random.default_rng(int(g["_seed"].iloc[0]) & 0x7FFFFFFFFFFFFFFF) for g, *_ in part]
            size, count = np.array([len(t) for _, t, _, _ in part]), np.array([len(mk) for _, _, mk, _ in part])
            mu, tau2, s2 = sample(m, v, size, count, rngs, chains=chains, n_iter=n_iter, burn=burn, thin=thin)
            for k, (g, t, mk, vk) in enumerate(part):
                rows = _summary(t, mk, vk, mu[:, k, :, : len(t)], tau2[:, k], s2[:, k], epoch_days)
                for key in keys:
                    rows[key] = g[key].iloc[0]
                out.append(rows[names])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "t long", *[f"{c} double" for c in FIELDS]])
    return src.groupBy("_bucket").applyInPandas(run, schema)


def measurement_covariance(posterior: DataFrame, keys: Sequence[str], *, epoch_days: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """Covariance (keys, i, j, cov; i <= j epoch numbers) of the series: total errors with exponential correlation, tau squared in common.

    Entries correlated less than ``tolerance`` equal ``beyond``, the common mode, and are not listed. The reach follows each key's length.
    """
    keys = list(keys)
    reach = F.ceil(-F.log(F.lit(tolerance)) * F.col("corr_length_days") / epoch_days)
    src = posterior.select(*keys, F.col("t").alias("i"), "total_std", "tau", "corr_length_days", reach.alias("_reach"))
    span = F.floor(F.col("i") / F.col("_reach")).cast("long")
    early = src.withColumn("_span", F.explode(F.array(span, span + 1)))
    late = src.select(*keys, F.col("i").alias("j"), F.col("total_std").alias("_other"), span.alias("_span"))
    pairs = early.join(late, [*keys, "_span"]).where((F.col("i") <= F.col("j")) & (F.col("j") - F.col("i") <= F.col("_reach")))
    rho: Column = F.exp(-(F.col("j") - F.col("i")) * epoch_days / F.col("corr_length_days"))
    common = F.col("tau") * F.col("tau")
    return pairs.select(*keys, "i", "j", (F.col("total_std") * F.col("_other") * rho + common).alias("cov"), common.alias("beyond"))
