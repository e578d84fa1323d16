"""Combination of components, pairs, channels and ensemble members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tremorlake.operators.scan import exact_quantiles


def component_combine(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted mean and coherence-weighted mean over components (cc clipped at 0)."""
    w = F.greatest(F.col("cc"), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_components"),
        F.avg("dvv").alias("dvv_mean"),
        (F.sum(w * F.col("dvv")) / (F.sum(w) + 1e-12)).alias("dvv_weighted"),
        F.avg(w).alias("cc_mean"),
    )


def image_average(image: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean coherence image over components, before any peak is picked.

    ``image``: keys, component, eps_idx, eps, cc.
    """
    return image.groupBy(*keys, "eps_idx", "eps").agg(F.avg("cc").alias("cc"))


def network_combine(df: DataFrame, keys: Sequence[str], *, value: str = "dvv", weight: str = "weight") -> DataFrame:
    """Weighted mean with its standard error, and the plain mean with SE and SD.

    One pass of sums; n_eff = (sum w)^2 / sum w^2.
    """
    w, x = F.col(weight), F.col(value)
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"),
        F.sum(w).alias("_w"),
        F.sum(w * w).alias("_w2"),
        F.sum(w * x).alias("_wx"),
        F.sum(w * x * x).alias("_wxx"),
        F.avg(x).alias("unweighted_mean"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("unweighted_sd"),
    )
    total = F.nullif("_w", F.lit(0.0))
    mean = F.col("_wx") / total
    n_eff = F.col("_w") * total / F.col("_w2")
    scatter = F.greatest(F.col("_wxx") / total - mean * mean, F.lit(0.0))
    return sums.select(
        *keys, "n_pairs", mean.alias("weighted_mean"), n_eff.alias("n_eff"),
        F.sqrt(scatter / n_eff).alias("weighted_se"), "unweighted_mean", "unweighted_sd",
        (F.col("unweighted_sd") / F.sqrt("n_pairs")).alias("unweighted_se"),
    )


def network_dvv(df: DataFrame, *, pair: str = "pair_id", ts: str = "ts") -> DataFrame:
    """pair x component -> pair (coherence weighted) -> network, per epoch."""
    pairs = component_combine(df, [pair, ts])
    return network_combine(
        pairs.select(ts, F.col("dvv_weighted").alias("dvv"), F.col("cc_mean").alias("weight")), [ts]
    )


def nanmean_channels(df: DataFrame, keys: Sequence[str], valid: Column, *, value: str = "dvv") -> DataFrame:
    """Mean over the valid channels; the epoch is valid when any channel is."""
    return df.groupBy(*keys).agg(
        F.avg(F.when(valid, F.col(value))).alias(value),
        F.coalesce(F.bool_or(valid), F.lit(False)).alias("valid"),
    )


def percentile_band(df: DataFrame, keys: Sequence[str], *, value: str = "dvv") -> DataFrame:
    """10 - 90 % band and median over pipelines."""
    return exact_quantiles(df, keys, F.col(value), {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def branch_combine(causal: Column, acausal: Column) -> dict[str, Column]:
    """Mean, more negative and larger magnitude of the two branches."""
    return {
        "branch_mean": (causal + acausal) / 2,
        "branch_min": F.least(causal, acausal),
        "branch_absmax": F.when(F.abs(causal) >= F.abs(acausal), causal).otherwise(acausal),
    }
