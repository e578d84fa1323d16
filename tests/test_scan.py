"""The hot form must equal the bounded form, also for a key with most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import align, diagnose, forcing, quality, regress, scan

KEY = ["site_id"]


def same(a: pd.DataFrame, b: pd.DataFrame, by):
    a, b = (x.sort_values(by).reset_index(drop=True)[sorted(a.columns)] for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-11)


CASES = {
    "index": lambda d: scan.with_row_index(d, KEY, ["ts"]),
    "lead": lambda d: scan.running(d, KEY, ["ts"], {"x": ("lag", F.col("dvv"))}, reverse=True),
    "last": lambda d: scan.running(d, KEY, ["ts"], {"x": ("last", F.when(F.col("dvv") > 1, F.col("dvv")))}),
    "sum": lambda d: scan.running(d, KEY, ["ts"], {"x": ("sum", F.col("dvv"))}),
    "decay": lambda d: forcing.reservoir(d, KEY),
    "snow": lambda d: forcing.snowpack(d, KEY, load="precipitation"),
    "cdm": lambda d: forcing.cdm(d, KEY, window_rows=200),
    "api": lambda d: forcing.antecedent_index(d, KEY),
    "spacing": lambda d: quality.spacing(d, KEY),
    "mad": lambda d: quality.outliers_mad_global(d, KEY, "dvv", n_sigma=2.0),
    "roll_mad": lambda d: quality.rolling_outlier_mad(d, KEY, "dvv", n_sigma=2.0),
    "zscore": lambda d: diagnose.rolling_zscore(d, KEY, "dvv"),
    "centre": lambda d: forcing.centre_column(d, KEY, "dvv", "x"),
    "lag": lambda d: forcing.thermo_shift(d, KEY, shift_days=37.0),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_equals_bounded(series, both_forms, name):
    same(*both_forms(lambda: CASES[name](series)), ["site_id", "ts"])


def test_hot_equals_bounded_summaries(series, both_forms):
    for fn in (
        lambda: quality.quality_summary(series, KEY, "dvv"),
        lambda: diagnose.ljung_box(series, KEY, "dvv"),
        lambda: regress.wet_dry_variance(series, KEY, "dvv"),
        lambda: regress.low_freq_drift(series, KEY, "dvv", window=101),
    ):
        same(*both_forms(fn), KEY)
    runs = both_forms(lambda: diagnose.transient_segments(series, KEY, "dvv", z_threshold=1.0, min_length=2))
    same(*runs, ["site_id", "onset_idx"])


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"k": k, "v": v}) for k, v in {
        "normal": rng.normal(size=5001), "ties": np.round(rng.exponential(size=4000), 1), "constant": np.full(1000, 3.25), "one": np.array([7.0]),
    }.items()]
    pdf = pd.concat(frames)
    out = scan.exact_quantiles(spark.createDataFrame(pdf), ["k"], F.col("v"), {"a": 0.2, "b": 0.5, "c": 0.9}, hot=True).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(out.loc[k, ["a", "b", "c"]].to_numpy(float), np.quantile(g["v"], [0.2, 0.5, 0.9]), rtol=1e-12)


def test_interpolation_against_pandas(spark, series, both_forms):
    pdf = series.toPandas()
    targets = series.select("site_id", (F.col("ts") + F.expr("interval 13 hours")).alias("ts")).unionByName(
        series.select("site_id").distinct().withColumn("ts", F.lit("2000-06-01").cast("timestamp")))
    src = series.select("site_id", "ts", F.col("dvv").alias("value"))
    for out in both_forms(lambda: align.interp_linear(targets, src, KEY)):
        for site, g in out.groupby("site_id"):
            s = pdf[pdf.site_id == site].set_index("ts")["dvv"]
            want = s.reindex(s.index.union(pd.DatetimeIndex(g["ts"]))).sort_index().interpolate(method="time").reindex(g["ts"]).to_numpy()
            np.testing.assert_allclose(g["value"].to_numpy(float), want, atol=1e-9)


def test_partition_and_key_independence(spark, series):
    full = forcing.reservoir(series, KEY).where("site_id = 'b'").toPandas()
    alone = forcing.reservoir(series.where("site_id = 'b'").repartition(3), KEY).toPandas()
    same(full, alone, ["site_id", "ts"])
