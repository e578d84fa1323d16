"""Forcing responses and design columns."""

from __future__ import annotations

from collections.abc import Sequence
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from tremorlake.functions.exprs import GRAVITY, WATER_RHO
from tremorlake.functions.special import erf_array, erf_udf, exp1_array, exp1_udf
from tremorlake.operators.align import self_lag
from tremorlake.operators.scan import CHUNK_DAYS, DAY_US, halo, is_hot, key_stats, micros, running, with_row_index
from tremorlake.session import cut

BASEFLOW_RATE = 1.0 / (180.0 * 86400.0)
SNOW_RATE = 1.0 / (30.0 * 86400.0)
CDM_WINDOW = 365 * 8
YEAR_S = 365.25 * 86400.0


def decay_sum(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    rate_per_s: float,
    out: str,
    *,
    ts: str = "ts",
    hot: bool | None = None,
) -> DataFrame:
    """sum over n <= i of value_n * exp(-rate * (t_i - t_n)).

    Chunk by chunk, with the exponentials anchored at each chunk's start so that none leaves the
    range of a double whatever the rate and the span; earlier chunks enter through one decayed total
    each, looking back as far as a double can represent the decay.  Both forms compute the same: a bounded series
    in windows over one partitioning by key, a hot one with one summary row per chunk.
    """
    keys = list(keys)
    days = min(CHUNK_DAYS, 30.0 / (rate_per_s * 86400.0))
    span_s = days * 86400.0
    reach = math.ceil(745.0 / (rate_per_s * span_s)) + 1
    t = micros(ts) / 1e6
    src = (
        df.withColumn("_chunk", F.floor(t / span_s).cast("long"))
        .withColumn("_age", t - F.col("_chunk") * span_s)
        .withColumn("_in", value)
    )
    bounded = not is_hot(df, hot)
    src = src if bounded else cut(src)
    grow = F.col("_in") * F.exp(F.lit(rate_per_s) * F.col("_age"))
    local = (
        W.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    )
    fade = F.exp(F.lit(-rate_per_s) * F.col("_age"))
    inside = F.coalesce(F.sum(grow).over(local), F.lit(0.0)) * fade
    end = F.sum(F.col("_in") * F.exp(F.lit(-rate_per_s) * (span_s - F.col("_age"))))
    if bounded:
        last = F.lead("_chunk").over(W.partitionBy(*keys, "_chunk").orderBy(ts)).isNull()
        ends = src.withColumn("_inside", inside).withColumn("_last", last)
        ends = ends.withColumn("_end", F.when(F.col("_last"), end.over(W.partitionBy(*keys, "_chunk"))))
    else:
        ends = src.groupBy(*keys, "_chunk").agg(end.alias("_end")).withColumn("_last", F.lit(True))
    entry = F.struct("_chunk", F.coalesce("_end", F.lit(0.0)).alias("e"))
    past = F.collect_list(F.when(F.col("_last"), entry)).over(
        W.partitionBy(*keys).orderBy("_chunk").rangeBetween(-reach, -1)
    )
    carried = F.aggregate(
        past,
        F.lit(0.0),
        lambda acc, p: acc
        + p["e"] * F.exp(F.lit(-rate_per_s * span_s) * (F.col("_chunk") - p["_chunk"] - 1)),
    )
    if bounded:
        return ends.withColumn(out, F.col("_inside") + carried * fade).select(*df.columns, out)
    carry = ends.withColumn("_past", carried).select(*keys, "_chunk", "_past")
    return (
        src.join(carry, [*keys, "_chunk"])
        .withColumn(out, inside + F.col("_past") * fade)
        .select(*df.columns, out)
    )


def reservoir(
    df: DataFrame,
    keys: Sequence[str],
    *,
    precipitation: str = "precipitation",
    porosity: float = 0.05,
    rate_per_s: float = BASEFLOW_RATE,
    out: str = "reservoir",
) -> DataFrame:
    """Baseflow reservoir: exponentially draining recharge."""
    return decay_sum(df, keys, F.col(precipitation) / porosity, rate_per_s, out)


def snowpack(
    df: DataFrame, keys: Sequence[str], *, load: str, rate_per_s: float = SNOW_RATE, out: str = "swe"
) -> DataFrame:
    """Exponentially melting load accumulator."""
    return decay_sum(df, keys, F.col(load), rate_per_s, out)


def cdm(
    df: DataFrame,
    keys: Sequence[str],
    *,
    precipitation: str = "precipitation",
    window_rows: int = CDM_WINDOW,
    warmup: DataFrame | None = None,
    out: str = "cdm",
) -> DataFrame:
    """Cumulative departure from the backward rolling mean.

    ``warmup`` rows (same keys, ts, precipitation) initialise the mean and are
    left out of the result.  The long sliding mean is a difference of two
    running sums, so its cost does not depend on the window length.
    """
    keys = list(keys)
    rows = df.withColumn("_keep", F.lit(True))
    if warmup is not None:
        rows = rows.unionByName(
            warmup.select(*keys, "ts", precipitation, F.lit(False).alias("_keep")),
            allowMissingColumns=True,
        )
    scan = running(
        rows, keys, ["ts"],
        {"_cum": ("sum", F.col(precipitation)), "_n": ("count", F.lit(1))},
    )
    if is_hot(df, None):
        # the running sum window_rows earlier, by an equi-join on position
        scan = cut(scan)
        past = scan.select(*keys, (F.col("_n") + window_rows).alias("_n"), F.col("_cum").alias("_old"))
        scan = scan.join(past, [*keys, "_n"], "left")
    else:
        back = F.lag("_cum", window_rows).over(W.partitionBy(*keys).orderBy("ts"))
        scan = scan.withColumn("_old", back)
    mean = (F.col("_cum") - F.coalesce("_old", F.lit(0.0))) / F.least(
        F.col("_n"), F.lit(window_rows)
    )
    departures = scan.withColumn("_dep", F.col(precipitation) - mean)
    total = running(departures, keys, ["ts"], {out: ("sum", F.col("_dep"))})
    return total.where("_keep").select(*df.columns, out)


def trailing_rows(
    df: DataFrame, keys: Sequence[str], outputs: dict[str, tuple[Column, int, int, str]]
) -> DataFrame:
    """Row-frame sums / means: name -> (value, before, after, 'sum' | 'mean')."""
    idx = with_row_index(df, keys, ["ts"], "_i")
    before = max(b for _, b, _, _ in outputs.values())
    after = max(a for _, _, a, _ in outputs.values())

    def make(value, b, a, kind):
        fn = F.sum if kind == "sum" else F.avg
        return lambda w: fn(value).over(w.rowsBetween(-b, a))

    return halo(
        idx, keys, F.col("_i"), before, after, {n: make(*spec) for n, spec in outputs.items()}
    ).drop("_i")


def antecedent_index(
    df: DataFrame, keys: Sequence[str], *, precipitation: str = "precipitation", window: int = 90, out: str = "api"
) -> DataFrame:
    """Trailing precipitation sum over ``window`` rows."""
    return trailing_rows(df, keys, {out: (F.col(precipitation), window - 1, 0, "sum")})


def seasonal_lowpass(
    df: DataFrame, keys: Sequence[str], *, value: str, window: int = 30, out: str = "lowpass"
) -> DataFrame:
    """Centred row mean, at least one value."""
    lo = window - 1 - (window - 1) // 2
    return trailing_rows(df, keys, {out: (F.col(value), lo, (window - 1) // 2, "mean")})


def centre_column(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """x minus its mean per series."""
    return (
        key_stats(df, keys, {"_mu": F.avg(column)})
        .withColumn(out, F.col(column) - F.col("_mu"))
        .drop("_mu")
    )


def thermo_shift(
    df: DataFrame, keys: Sequence[str], *, temperature: str = "temperature", shift_days: float = 50.0, out: str = "thermo"
) -> DataFrame:
    """Lagged temperature: mean removed, zero before the record."""
    if shift_days < 0:
        raise ValueError("shift_days must be non-negative")
    if shift_days == 0:
        return centre_column(df, keys, temperature, out)
    return self_lag(df, keys, value=temperature, shifts_days=[shift_days], out=out)


def skin_depth(diffusivity: Column, period_s: Column) -> Column:
    """Thermal skin depth in metres."""
    return F.sqrt(diffusivity * period_s / math.pi)


def daily_grid(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gap-free daily series per key: keys, day_no, value (linear between days).

    The result has one row per calendar day, which bounds any per-key kernel
    that follows by the length of the record in days.
    """
    from tremorlake.operators.align import interp_linear

    daily = df.groupBy(*keys, F.floor(micros("ts") / DAY_US).cast("long").alias("day_no")).agg(
        F.avg(value).alias("value")
    )
    span = daily.groupBy(*keys).agg(F.min("day_no").alias("_a"), F.max("day_no").alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day_no"))
    ts = F.timestamp_micros((F.col("day_no") * DAY_US).cast("long"))
    out = interp_linear(days.withColumn("ts", ts), daily.withColumn("ts", ts).drop("day_no"), keys)
    return out.select(*keys, "day_no", "value")


def thermo_diffuse(
    grid: DataFrame, keys: Sequence[str], *, depth_m: float, diffusivity_m2_s: float
) -> DataFrame:
    """Temperature diffused to depth, on a daily grid (keys, day_no, value); NULL for a site of under four days.

    Linear in the record, so it is an FFT per key over at most one value per day.
    """
    keys = list(keys)
    schema = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in grid.schema if f.name in keys
    ) + ", day_no bigint, t_depth double"

    def diffuse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_no")
        x = pdf["value"].to_numpy()
        if len(x) < 4:  # too short for this site; the others go on
            return pdf[[*keys, "day_no"]].assign(t_depth=np.nan)
        omega = 2 * np.pi * np.fft.rfftfreq(len(x), 86400.0)
        ratio = depth_m * np.sqrt(omega / (2 * diffusivity_m2_s))
        spectrum = np.fft.rfft(x - x.mean()) * np.exp(-(1 + 1j) * ratio)
        return pdf[[*keys, "day_no"]].assign(t_depth=np.fft.irfft(spectrum, n=len(x)))

    return grid.select(*keys, "day_no", "value").groupBy(*keys).applyInPandas(diffuse, schema)


def pressure_step(
    p0: Column, depth_m: Column, time_s: Column, *, diffusivity: Column,
    skempton_b: float = 0.6, poisson_undrained: float = 0.3, drained_only: bool = False,
) -> Column:
    """Pore pressure under a step load: undrained part plus diffusion front."""
    erf = erf_udf()(depth_m / F.sqrt(4.0 * diffusivity * time_s))
    undrained = 0.0 if drained_only else skempton_b * (1 + poisson_undrained) / (3 * (1 - poisson_undrained))
    return F.when(time_s > 0, p0 * (undrained * erf + (1.0 - erf)))


def pressure_convolve(
    grid: DataFrame,
    keys: Sequence[str],
    *,
    depth_m: float = 100.0,
    diffusivity_m2_s: float = 0.01,
    skempton_b: float = 0.6,
    poisson_undrained: float = 0.3,
    drained_only: bool = False,
) -> DataFrame:
    """Pressure at depth from a daily precipitation grid (keys, day_no, value).

    The load is the departure from the record mean; today's load and yesterday's
    share one kernel value, and the first day is 0.
    """
    keys = list(keys)
    schema = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in grid.schema if f.name in keys
    ) + ", day_no bigint, pressure double"
    undrained = 0.0 if drained_only else skempton_b * (1 + poisson_undrained) / (3 * (1 - poisson_undrained))

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_no")
        load = WATER_RHO * GRAVITY * (pdf["value"].to_numpy() - pdf["value"].mean())
        n = len(load)
        lag_s = 86400.0 * np.maximum(np.arange(n), 1)
        e = erf_array(depth_m / np.sqrt(4.0 * diffusivity_m2_s * lag_s))
        kernel = undrained * e + (1.0 - e)
        size = 1 << (2 * n - 1).bit_length()
        full = np.fft.irfft(np.fft.rfft(load, size) * np.fft.rfft(kernel, size), size)[:n]
        full[0] = 0.0
        return pdf[[*keys, "day_no"]].assign(pressure=full)

    return grid.select(*keys, "day_no", "value").groupBy(*keys).applyInPandas(convolve, schema)


def healing(
    epochs: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    *,
    tau_min_s: float = 86400.0,
    tau_max_s: float = 30.0 * YEAR_S,
    amplitude: float = 1.0,
) -> DataFrame:
    """Normalised healing column per (epoch, event): 0 before, 1 at the event.

    The kernel is positive after the event while its value at zero is negative,
    so the normalised column turns negative for t > 0.
    """
    if not 0 < tau_min_s < tau_max_s:
        raise ValueError("need 0 < tau_min_s < tau_max_s")
    e1 = exp1_udf()
    at_zero = -math.log(tau_max_s / tau_min_s)
    ev = events.select(*keys, "event_id", F.col("ts").alias("_t0"))
    pairs = epochs.select(*keys, "ts").join(ev, list(keys))
    t = (micros("ts") - micros("_t0")) / 1e6
    raw = e1(F.greatest(t, F.lit(1.0)) / tau_max_s) - e1(F.greatest(t, F.lit(1.0)) / tau_min_s)
    column = F.when(t < 0, 0.0).when(t == 0, 1.0).otherwise(raw / at_zero)
    return pairs.select(*keys, "ts", "event_id", (amplitude * column).alias("healing"))


def healing_nodes(tau_min_s: float, tau_max_s: float, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(relaxation times, weights): exponentials whose sum is E1(t / tau_max) - E1(t / tau_min), within ``tolerance``.

    The kernel is the integral of exp(-t / tau) over log tau, so Gauss-Legendre nodes in log tau do; their
    number grows until the error, over times from a hundredth of tau_min to a thousand tau_max, is small enough.
    """
    lo, hi = math.log(tau_min_s), math.log(tau_max_s)
    t = np.concatenate([[0.0], np.geomspace(tau_min_s / 100, tau_max_s * 1000, 4000)])
    exact = np.append(hi - lo, exp1_array(t[1:] / tau_max_s) - exp1_array(t[1:] / tau_min_s))
    n = 8
    while True:
        x, w = np.polynomial.legendre.leggauss(n)
        tau, weight = np.exp(lo + (x + 1) * (hi - lo) / 2), w * (hi - lo) / 2
        with np.errstate(under="ignore"):
            error = np.abs(np.exp(-t[:, None] / tau) @ weight - exact).max()
        if error <= tolerance * (hi - lo):
            return tau, weight
        if n > 512:
            raise ValueError("tolerance too small")
        n += 4


def healing_total(
    epochs: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    *,
    tau_min_s: float = 86400.0,
    tau_max_s: float = 30.0 * YEAR_S,
    amplitude: str | None = None,
    tolerance: float = 1e-10,
    chunk_days: float = 30.0,
) -> DataFrame:
    """Healing of all events together: ``epochs`` with n_events (so far) and healing, for any number of events.

    Events of earlier time chunks enter through one decayed sum for each of the kernel's exponentials, events of an epoch's own
    chunk exactly. So work follows epochs plus events (times the chunk), not their product. ``amplitude``
    names a column of ``events`` that weighs them (null: 1). Rows without time take no part; an epoch before all events has 0.
    An event less than a second before an epoch counts as one second old only inside a chunk.
    """
    if not 0 < tau_min_s < tau_max_s:
        raise ValueError("need 0 < tau_min_s < tau_max_s")
    keys = list(keys)
    tau, weight = healing_nodes(tau_min_s, tau_max_s, tolerance)
    scale, span_us = -1.0 / math.log(tau_max_s / tau_min_s), int(chunk_days * DAY_US)
    gain = F.lit(1.0) if amplitude is None else F.coalesce(F.col(amplitude).cast("double"), F.lit(1.0))
    ev = events.where(F.col("ts").isNotNull()).select(*keys, micros("ts").alias("_t"), gain.alias("_a"))
    ev = ev.withColumn("_chunk", F.floor(F.col("_t") / span_us).cast("long"))
    left = ((F.col("_chunk") + 1) * span_us - F.col("_t")) / 1e6  # seconds to the chunk's end
    held = ev.groupBy(*keys, "_chunk").agg(
        F.count("*").alias("_n"), F.array(*[F.sum(F.col("_a") * F.exp(-left / float(x))) for x in tau]).alias("_s")
    )
    rows = epochs.withColumn("_t", micros("ts")).withColumn("_chunk", F.floor(F.col("_t") / span_us).cast("long"))
    asked = rows.select(*keys, "_chunk").where(F.col("_chunk").isNotNull()).distinct()
    marks = held.unionByName(asked.select(*keys, "_chunk", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("array<double>").alias("_s")))
    kinds = {f.name: f.dataType.simpleString() for f in epochs.schema}
    head = "".join(f"{k} {kinds[k]}, " for k in keys)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """What earlier chunks hold at each chunk's start; a key has one row per chunk of events."""
        state, last, seen, at, out = np.zeros(len(tau)), np.zeros(len(tau)), 0, None, []
        for chunk, part in pdf.groupby("_chunk", sort=True):
            if at is not None:  # what the chunk before held at its start, and its own events from its end
                with np.errstate(under="ignore"):
                    state = state * np.exp(-(chunk - at) * span_us / 1e6 / tau) + last * np.exp(-(chunk - at - 1) * span_us / 1e6 / tau)
            out.append((chunk, seen, state))
            own = [np.asarray(s) for s in part["_s"] if s is not None]
            last, at = np.sum(own, axis=0) if own else np.zeros(len(tau)), chunk
            seen += int(part["_n"].sum())
        res = pd.DataFrame(out, columns=["_chunk", "_seen", "_state"])
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, "_chunk", "_seen", "_state"]]

    carried = marks.groupBy(*keys).applyInPandas(carry, f"{head}_chunk long, _seen long, _state array<double>")
    same = F.col("r._chunk") == F.col("c._chunk")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    rows = rows.alias("r").join(carried.alias("c"), same, "left").select("r.*", "_seen", "_state")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in epochs.schema) + ", n_events long, healing double"
    names = [*epochs.columns, "n_events", "healing"]

    def near(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        t, total, count = pdf["_t"].to_numpy(), np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
        if len(pdf) and pdf["_state"].iloc[0] is not None and pdf["_t"].notna().all():
            age = (t - int(pdf["_chunk"].iloc[0]) * span_us) / 1e6
            with np.errstate(under="ignore"):
                total += np.exp(-age[:, None] / tau) @ (weight * np.asarray(pdf["_state"].iloc[0]))
            count += int(pdf["_seen"].iloc[0])
            total *= scale
            for i in range(0, len(own), 4096):
                e = own.iloc[i : i + 4096]
                dt = (t[:, None] - e["_t"].to_numpy()[None, :]) / 1e6
                late = np.maximum(dt, 1.0)
                kernel = np.where(dt < 0, 0.0, np.where(dt == 0, 1.0, scale * (exp1_array(late / tau_max_s) - exp1_array(late / tau_min_s))))
                total += kernel @ e["_a"].to_numpy()
                count += (dt >= 0).sum(1)
        return pdf.assign(n_events=count, healing=total)[names]

    return rows.groupBy(*keys, "_chunk").cogroup(ev.groupBy(*keys, "_chunk")).applyInPandas(near, schema)


def surface_load(
    height_m: Column, *, beta: float = 1.0, bulk_modulus_gpa: Column | float = 5.0, rho: float = WATER_RHO
) -> Column:
    """dv/v of a surface load: beta times volumetric strain."""
    bulk = bulk_modulus_gpa if isinstance(bulk_modulus_gpa, Column) else F.lit(float(bulk_modulus_gpa))
    return beta * (rho * GRAVITY * height_m / (3.0 * bulk * 1e9))


def water_retention(
    suction_pa: Column, *, alpha_per_pa: float = 1e-4, n: float = 2.0, residual: float = 0.05, maximum: float = 1.0
) -> Column:
    """Effective saturation from suction (van Genuchten)."""
    se = F.pow(1.0 + F.pow(alpha_per_pa * F.abs(suction_pa), n), -(1.0 - 1.0 / n))
    return residual + (maximum - residual) * se
