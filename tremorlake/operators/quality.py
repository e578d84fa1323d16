"""Row filters and quality control of dv/v series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tremorlake.functions.exprs import finite
from tremorlake.operators.scan import (
    DAY_US,
    attach,
    exact_quantiles,
    halo,
    key_stats,
    micros,
    running,
    with_row_index,
)

MAD_TO_SIGMA = 1.4826


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinite values become NULL, then incomplete rows are dropped."""
    clean = {c: finite(c) for c in columns}
    return df.withColumns(clean).na.drop(subset=list(columns))


def cc_gate(df: DataFrame, reference: Column, *, threshold: float = 0.6) -> DataFrame:
    """Coherence gate; applies to fixed references with a known cc only."""
    gated = (reference == "fixed") & F.col("cc").isNotNull()
    return df.where(F.when(gated, F.col("cc") > threshold).otherwise(F.lit(True)))


def subsample_cadence(df: DataFrame, keys: Sequence[str], n: int, *, ts: str = "ts") -> DataFrame:
    """Every n-th epoch of each key, starting with the first."""
    return (
        with_row_index(df, keys, [ts], "_pos").where(F.col("_pos") % n == 0).drop("_pos")
    )


def spacing(df: DataFrame, keys: Sequence[str], *, ts: str = "ts") -> DataFrame:
    """Adds prev_ts and gap_days (NULL on the first row)."""
    return running(df, keys, [ts], {"prev_ts": ("lag", F.col(ts))}).withColumn(
        "gap_days", (micros(ts) - micros("prev_ts")) / float(DAY_US)
    )


def gap_detect(
    df: DataFrame,
    keys: Sequence[str],
    *,
    expected_days: float = 1.0,
    factor: float = 3.0,
    ts: str = "ts",
) -> DataFrame:
    """Gaps longer than ``factor`` times the expected spacing."""
    return (
        spacing(df.select(*keys, ts), keys, ts=ts)
        .where(F.col("gap_days") > expected_days * factor)
        .select(*keys, F.col("prev_ts").alias("gap_start"), F.col(ts).alias("gap_end"), "gap_days")
    )


def outliers_mad_global(
    df: DataFrame, keys: Sequence[str], value: str, *, n_sigma: float = 5.0
) -> DataFrame:
    """Adds is_outlier: beyond n_sigma robust deviations from the key's median."""
    med = exact_quantiles(df, keys, F.col(value), {"_med": 0.5})
    dev = attach(df, med, keys, [value]).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = exact_quantiles(dev, keys, F.col("_dev"), {"_mad": 0.5})
    both = key_stats(attach(dev, mad, keys, [value]), keys, {"_std": F.stddev_samp(value)}, salt_on=[value])
    scale = F.when(F.col("_mad") > 0, MAD_TO_SIGMA * F.col("_mad")).otherwise(F.col("_std"))
    flag = F.coalesce(F.col("_dev") > n_sigma * scale, F.lit(False))
    return both.withColumn("is_outlier", flag).drop("_med", "_dev", "_mad", "_std")


def outliers_sigma_global(
    df: DataFrame, keys: Sequence[str], value: str, *, n_sigma: float = 5.0
) -> DataFrame:
    """Adds is_outlier: beyond n_sigma sample deviations from the key's mean."""
    return (
        key_stats(df, keys, {"_mu": F.avg(value), "_std": F.stddev_samp(value)}, salt_on=[value])
        .withColumn(
            "is_outlier",
            F.coalesce(F.abs(F.col(value) - F.col("_mu")) > n_sigma * F.col("_std"), F.lit(False)),
        )
        .drop("_mu", "_std")
    )


def _centred_days(days: float) -> tuple[int, int]:
    """Centred time window (t - w/2, t + w/2] in microseconds."""
    half = int(days * DAY_US / 2)
    return half - 1, half


def rolling_outlier_mad(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    window_days: float = 30.0,
    n_sigma: float = 5.0,
    min_periods: int = 3,
    ts: str = "ts",
) -> DataFrame:
    """MAD rule inside a centred time window; a zero MAD flags any deviation."""
    lo, hi = _centred_days(window_days)

    def median_of(c: str):
        return lambda w: F.when(
            F.count(c).over(w) >= min_periods, F.percentile(c, 0.5).over(w)
        )

    first = halo(df, keys, micros(ts), lo, hi, {"_med": median_of(value)}, rows=False)
    first = first.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    out = halo(first, keys, micros(ts), lo, hi, {"_mad": median_of("_dev")}, rows=False)
    return out.withColumn(
        "is_outlier",
        F.coalesce(F.col("_dev") > n_sigma * MAD_TO_SIGMA * F.col("_mad"), F.lit(False)),
    ).drop("_med", "_dev", "_mad")


def rolling_outlier_sigma(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    window_days: float = 30.0,
    n_sigma: float = 5.0,
    min_periods: int = 3,
    ts: str = "ts",
) -> DataFrame:
    """Mean / standard deviation rule inside a centred time window."""
    lo, hi = _centred_days(window_days)

    def guarded(fn):
        return lambda w: F.when(F.count(value).over(w) >= min_periods, fn(value).over(w))

    out = halo(
        df, keys, micros(ts), lo, hi,
        {"_mu": guarded(F.avg), "_sd": guarded(F.stddev_samp)}, rows=False,
    )
    return out.withColumn(
        "is_outlier",
        F.coalesce(F.abs(F.col(value) - F.col("_mu")) > n_sigma * F.col("_sd"), F.lit(False)),
    ).drop("_mu", "_sd")


def quality_summary(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    expected_days: float = 1.0,
    gap_factor: float = 3.0,
    n_sigma: float = 5.0,
    ts: str = "ts",
) -> DataFrame:
    """One quality row per key; keys whose values are all NULL keep a zero row."""
    rows = df.where(F.col(value).isNotNull())
    flagged = outliers_mad_global(rows.select(*keys, value), keys, value, n_sigma=n_sigma)
    outliers = flagged.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.count_if("is_outlier").alias("n_outliers")
    )
    gaps = spacing(rows.select(*keys, ts), keys, ts=ts)
    is_gap = F.col("gap_days") > expected_days * gap_factor
    gap_stats = gaps.groupBy(*keys).agg(
        F.count_if(is_gap).alias("n_gaps"),
        F.coalesce(F.max(F.when(is_gap, F.col("gap_days"))), F.lit(0.0)).alias("largest_gap_days"),
        ((F.max(micros(ts)) - F.min(micros(ts))) / float(DAY_US)).alias("_span"),
    )
    median = exact_quantiles(gaps, keys, F.col("gap_days"), {"median_spacing_days": 0.5})
    n = F.col("n_samples")
    ratio = F.col("_span") / F.greatest(expected_days * (n - 1), F.lit(1.0 / 86400))
    present = F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(
        F.when(ratio > 0, F.least(F.lit(1.0), 1.0 / ratio)).otherwise(1.0)
    )
    everyone = df.select(*keys).distinct()
    joined = (
        everyone.join(outliers, list(keys), "left")
        .join(gap_stats, list(keys), "left")
        .join(median, list(keys), "left")
        .withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    )
    return joined.select(
        *keys,
        "n_samples",
        F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"),
        F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        "largest_gap_days",
        "median_spacing_days",
        present.alias("fraction_present"),
    )
