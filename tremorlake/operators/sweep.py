"""Configurations, grids and scoring of config sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorlake.operators.scan import attach, exact_quantiles, is_hot, key_stats

# Recommended configuration per application (band Hz, window s, stack days,
# stretch search half-width) and the content band of its waveforms.
USE_CASES = {
    "volcano": ((0.4, 1.0), (10.0, 30.0), 10, 0.06, (0.05, 10.0)),
    "earthquake_fault": ((0.5, 1.5), (8.0, 25.0), 10, 0.05, (0.05, 10.0)),
    "landslide": ((4.0, 12.0), (0.2, 1.5), 5, 0.09, (1.0, 20.0)),
    "groundwater": ((2.0, 4.0), (2.0, 8.0), 10, 0.03, (0.5, 8.0)),
    "cryosphere": ((4.0, 14.0), (0.3, 0.8), 5, 0.11, (2.0, 25.0)),
    "geothermal": ((0.5, 2.0), (10.0, 25.0), 10, 0.03, (0.1, 8.0)),
}
USE_CASE_ALIASES = {
    "fault": "earthquake_fault",
    "earthquake": "earthquake_fault",
    "tectonic": "earthquake_fault",
    "hydrology": "groundwater",
    "aquifer": "groundwater",
    "permafrost": "cryosphere",
    "glacier": "cryosphere",
    "glacial": "cryosphere",
    "reservoir": "geothermal",
    "co2": "geothermal",
    "mining": "geothermal",
}
DEFAULT_ESTIMATOR, DEFAULT_REFERENCE, DEFAULT_GATE = "stretching (TS)", "fixed", True
AXES = ("estimator", "band", "window", "stack", "reference", "gate")
# Sweep grids (None = the recommended stack; "rec" / "variants" per axis).
GRIDS = {
    "compact": {
        "estimator": ["stretching (TS)", "MWCS"], "band": "rec", "window": "rec", "stack": [None],
        "reference": ["fixed", "moving"], "gate": [True],
    },
    "multiverse": {
        "estimator": ["stretching (TS)", "MWCS", "WCS", "DTW"], "band": "variants", "window": "variants",
        "stack": [None, 1, 45], "reference": ["fixed", "moving", "inversion"], "gate": [True, False],
    },
    "wide": {
        "estimator": ["stretching (TS)", "MWCS", "WCS", "DTW"], "band": "variants", "window": "variants",
        "stack": [None, 1, 5, 20, 60], "reference": ["fixed", "moving", "inversion"], "gate": [True, False],
    },
}
PAIR = "struct<lo:double,hi:double>"


def use_case_table(spark: SparkSession) -> DataFrame:
    rows = [
        (k, DEFAULT_ESTIMATOR, band, window, stack, DEFAULT_REFERENCE, DEFAULT_GATE, eps, gen)
        for k, (band, window, stack, eps, gen) in USE_CASES.items()
    ]
    return spark.createDataFrame(
        rows,
        f"use_case string, estimator string, band {PAIR}, window {PAIR}, stack int, "
        f"reference string, gate boolean, eps_max double, gen_band {PAIR}",
    )


def resolve_use_case(text: Column) -> Column:
    """Exact key, alias, keyword scan in table order, first-token scan; else NULL."""
    key = F.regexp_replace(F.lower(F.trim(text)), "[ /]", "_")
    low = F.lower(text)
    out = F.when(key.isin(*USE_CASES), key)
    for alias, target in USE_CASE_ALIASES.items():
        out = out.when(key == alias, target)
    for alias, target in USE_CASE_ALIASES.items():
        out = out.when(low.contains(alias), target)
    for name in USE_CASES:
        out = out.when(low.contains(name.split("_")[0]), name)
    return out


def recommend_config(
    requests: DataFrame, *, use_case: str = "use_case", overrides: Sequence[str] = ()
) -> DataFrame:
    """Config per request; override columns (named like the axes) win when not NULL.

    A request with an unknown use case is kept, with a NULL use case and without a recommendation.
    """
    bad = set(overrides) - set(AXES)
    if bad:
        raise KeyError(f"unknown config axes {sorted(bad)}; valid: {AXES}")
    table = use_case_table(requests.sparkSession).withColumnsRenamed({a: f"_{a}" for a in AXES})
    keep = [c for c in requests.columns if c not in overrides and c != use_case]
    r = requests.withColumn("_key", resolve_use_case(F.col(use_case)))
    joined = r.join(F.broadcast(table.withColumnRenamed("use_case", "_key")), "_key", "left")
    axis = [
        (F.coalesce(F.col(a).cast(PAIR) if a in ("band", "window") else F.col(a), F.col(f"_{a}")) if a in overrides else F.col(f"_{a}")).alias(a)
        for a in AXES
    ]
    return joined.select(*keep, F.col("_key").alias("use_case"), *axis, "eps_max", "gen_band")


def representative_case(requests: DataFrame, cases: DataFrame, *, order: str = "case_id", default_grade: str = "easy") -> DataFrame:
    """First listed case of the application and grade, else of any grade.

    ``requests`` (use_case as free text, grade) keep their rows and columns; one whose text names no application, or an
    application without a case, gets a NULL case_id, and a NULL grade asks for ``default_grade``. ``order`` is the column of
    ``cases`` that says which is listed first (equal places: the smaller case_id).
    One aggregate over the cases; requests join its small result.
    """
    place = F.struct(order, "case_id")
    first = cases.groupBy(F.col("use_case").alias("_key"), F.col("grade").alias("_grade")).agg(F.min(place).alias("_first"))
    first = first.groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_grade").isNotNull(), F.struct("_grade", "_first")))).alias("_by"), F.min("_first").alias("_any")
    )
    asked = requests.withColumn("_key", resolve_use_case(F.col("use_case")))
    exact = F.try_element_at("_by", F.coalesce("grade", F.lit(default_grade)))
    return asked.join(first, "_key", "left").select(*requests.columns, F.coalesce(exact["case_id"], F.col("_any.case_id")).alias("case_id"))


def _pair(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def depth_bands(gen: Column) -> Column:
    """Shallow (high) and deep (low) sub-bands of an application's content band."""
    mid = F.sqrt(gen["lo"] * gen["hi"])
    return F.array(
        _pair(F.round(mid * 1.6, 3), F.round(gen["hi"] * 0.9, 3)),
        _pair(F.round(gen["lo"] * 1.1, 3), F.round(mid * 0.6, 3)),
    )


def build_grid(cases: DataFrame, grid: str = "multiverse") -> DataFrame:
    """Every config of a grid per case, with config_index in product order.

    ``cases``: case_id, use_case, two_layer.  A recommended value equal to a
    listed one gives duplicate cells, as the sweep expects.  A case with an unknown use case
    keeps one row without a config.
    """
    if grid not in GRIDS:
        raise ValueError(f"unknown grid {grid!r}; known: {sorted(GRIDS)}")
    spec = GRIDS[grid]
    rec = recommend_config(cases.select("case_id", "use_case", "two_layer"))
    known = F.col("use_case").isNotNull()
    b, w = F.col("band"), F.col("window")

    def floor_lo(k: float) -> Column:
        return _pair(F.greatest(b["lo"] * k, F.lit(1e-3)), b["hi"] * k)

    bands = F.array(b) if spec["band"] == "rec" else F.filter(
        F.array(*[floor_lo(k) for k in (1.0, 0.5, 1.5)]), lambda x: x["hi"] > x["lo"]
    )
    bands = F.when(F.col("two_layer"), depth_bands(F.col("gen_band"))).otherwise(bands)
    span = w["hi"] - w["lo"]
    windows = F.array(w) if spec["window"] == "rec" else F.array(
        w, _pair(w["lo"], w["lo"] + 0.5 * span), _pair(w["lo"], w["lo"] + 1.8 * span)
    )
    stacks = F.array(*[F.col("stack") if s is None else F.lit(s) for s in spec["stack"]])
    options = {
        "estimator": F.array(*[F.lit(v) for v in spec["estimator"]]),
        "band": bands,
        "window": windows,
        "stack": stacks,
        "reference": F.array(*[F.lit(v) for v in spec["reference"]]),
        "gate": F.array(*[F.lit(v) for v in spec["gate"]]),
    }
    # an unknown use case has one choice on every axis, NULL, so it goes through the same pass
    options = {a: F.when(known, v).otherwise(F.array(F.col(a))) for a, v in options.items()}
    out = rec.select(
        "case_id", "use_case", "eps_max", F.when(known, F.lit(0)).alias("config_index"),
        *[v.alias(f"_{a}") for a, v in options.items()],
    )
    for axis in AXES:
        out = out.select("*", F.posexplode(f"_{axis}").alias("_p", axis)).withColumn(
            "config_index", F.col("config_index") * F.size(f"_{axis}") + F.col("_p")
        ).drop("_p", f"_{axis}")
    return out


# --- scoring ---------------------------------------------------------------------------


def rms_error(df: DataFrame, keys: Sequence[str], *, valid: Column | None = None) -> DataFrame:
    """Plain RMS against the truth; NULL below 10 valid epochs."""
    ok = F.col("dvv").isNotNull() & (F.lit(True) if valid is None else valid)
    err = F.when(ok, F.pow(F.col("dvv") - F.col("truth"), 2))
    return df.groupBy(*keys).agg(F.count(err).alias("n_valid"), F.avg(err).alias("_m")).select(
        *keys, "n_valid", F.when(F.col("n_valid") >= 10, F.sqrt("_m")).alias("rms")
    )


def rms_baseline_aligned(
    df: DataFrame, keys: Sequence[str], *, day: str = "day", valid: Column | None = None, fraction: float = 0.2
) -> DataFrame:
    """RMS after removing each series' mean over its earliest valid epochs."""
    keys = list(keys)
    ok = F.col("dvv").isNotNull() & (F.lit(True) if valid is None else valid)
    rows = df.where(ok)
    if is_hot(df, None):
        q = exact_quantiles(rows, keys, F.col(day), {"_cut": fraction})
        rows = attach(rows, q, keys, [day])
    else:
        rows = key_stats(rows, keys, {"_cut": F.percentile(day, F.lit(fraction))})
    base = F.col(day) <= F.col("_cut")
    e = F.col("dvv") - F.col("truth")
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n_valid"), F.count_if(base).alias("_nb"), F.avg(F.when(base, e)).alias("_mb"),
        F.avg(e).alias("_m1"), F.var_pop(e).alias("_var"),
    )
    # removing the two baselines shifts the error by their difference only
    offset = F.when(F.col("_nb") < 2, F.col("_m1")).otherwise(F.col("_mb"))
    ms = F.col("_var") + F.pow(F.col("_m1") - offset, 2)
    return agg.select(*keys, "n_valid", F.when(F.col("n_valid") >= 10, F.sqrt(ms)).alias("rms"))


def drop_amplitude(
    df: DataFrame, keys: Sequence[str], *, value: str, event_day: Column, day: str = "day", span: int = 120, out: str = "drop"
) -> DataFrame:
    """Minimum after the event minus median before it; needs three epochs each side."""
    t = F.col(day)
    pre = (t < event_day) & (t > event_day - 120)
    post = (t >= event_day) & (t < event_day + span)
    rows = df.where(F.col(value).isNotNull() & (pre | post)).select(*keys, pre.alias("_pre"), value)
    low = rows.groupBy(*keys).agg(
        F.count_if("_pre").alias("_a"), F.count_if(~F.col("_pre")).alias("_b"), F.min(F.when(~F.col("_pre"), F.col(value))).alias("_low")
    )
    med = exact_quantiles(rows.where("_pre"), keys, F.col(value), {"_med": 0.5})
    return low.join(med, list(keys), "left").select(
        *keys, F.when((F.col("_a") >= 3) & (F.col("_b") >= 3), F.col("_low") - F.col("_med")).alias(out)
    )


def best_config(sweep: DataFrame, *, tie: Sequence[str] = ("config_index",)) -> DataFrame:
    """Per case the successful row with the smallest RMS."""
    ok = sweep.where(F.col("ok") & F.col("rms").isNotNull())
    cols = [c for c in sweep.columns if c != "case_id"]
    return ok.groupBy("case_id").agg(
        F.min_by(F.struct(*cols), F.struct("rms", *tie)).alias("_b")
    ).select("case_id", "_b.*")


def sweep_summary(sweep: DataFrame, *, tie: Sequence[str] = ("config_index",)) -> DataFrame:
    """Cells, failures and best RMS per case."""
    counts = sweep.groupBy("case_id").agg(
        F.count("*").alias("n_cells"), F.count_if(~F.col("ok")).alias("n_failed")
    )
    best = best_config(sweep, tie=tie).select("case_id", F.col("rms").alias("best_rms"), *tie)
    return counts.join(best, "case_id", "left")


def sobol_first_order(sweep: DataFrame, keys: Sequence[str], axes: Sequence[str], *, value: str = "rms") -> DataFrame:
    """Variance of the level means over the total variance, per axis."""
    ok = sweep.where(F.col(value).isNotNull())
    total = ok.groupBy(*keys).agg(F.var_pop(value).alias("_total"))
    long = ok.select(*keys, value, *[F.col(a).cast("string").alias(a) for a in axes]).unpivot(
        [*keys, value], list(axes), "axis", "level"
    )
    levels = long.groupBy(*keys, "axis", "level").agg(F.avg(value).alias("_m"))
    per = levels.groupBy(*keys, "axis").agg(F.var_pop("_m").alias("_v"), F.count("*").alias("n_levels"))
    return per.join(total, list(keys)).select(
        *keys, "axis", "n_levels",
        F.when((F.col("n_levels") > 1) & (F.col("_total") > 0), F.col("_v") / F.col("_total")).alias("s1"),
    )


def oat_menu(baseline: DataFrame, menu: dict[str, Sequence]) -> DataFrame:
    """One-at-a-time configs: the baseline plus each option of each axis."""
    changes = [("baseline", None)] + [(axis, v) for axis, vals in menu.items() for v in vals]
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(None if v is None else str(v)).alias("option")) for a, v in changes])
    out = baseline.select("*", F.posexplode(rows).alias("config_index", "_c")).select(
        *baseline.columns, "config_index", "_c.axis", "_c.option"
    )
    for axis, vals in menu.items():
        kind = baseline.schema[axis].dataType.simpleString()
        out = out.withColumn(
            axis, F.when(F.col("axis") == axis, F.col("option").cast(kind)).otherwise(F.col(axis))
        )
    return out


def oat_ranking(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Damage of each single change against the key's baseline, ranked worst first.

    ``scores``: keys, axis, option, rms.  A menu is a handful of rows per key.
    """
    from pyspark.sql import Window as W

    base = scores.where(F.col("axis") == "baseline").select(*keys, F.col("rms").alias("_base"))
    rows = scores.where(F.col("axis") != "baseline").join(base, list(keys))
    damage = F.col("rms") - F.col("_base")
    w = W.partitionBy(*keys).orderBy(F.col("damage").desc_nulls_last(), "axis", "option")
    return rows.select(*keys, "axis", "option", "rms", damage.alias("damage")).withColumn(
        "rank", F.row_number().over(w).cast("long")
    )


def expected_metrics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Frozen against fresh metrics: missing / unexpected ids and tolerance check.

    ``expected``: case_id, rms, rel_tol; ``actual``: case_id, rms.
    """
    e = expected.withColumnRenamed("rms", "expected_rms")
    a = actual.withColumnRenamed("rms", "actual_rms")
    within = F.abs(F.col("actual_rms") - F.col("expected_rms")) <= F.col("rel_tol") * F.col("expected_rms")
    status = (
        F.when(F.col("actual_rms").isNull(), "missing")
        .when(F.col("expected_rms").isNull(), "unexpected")
        .when(within, "ok")
        .otherwise("out of tolerance")
    )
    return e.join(a, "case_id", "full_outer").select(
        "case_id", "expected_rms", "actual_rms", status.alias("status")
    )


def score_from_rms(rms: Column, good: Column, bad: Column) -> Column:
    return (
        F.when(rms.isNull(), 0.0).when(rms <= good, 1.0).when(rms >= bad, 0.0)
        .otherwise((bad - rms) / (bad - good))
    )


def score_thresholds(target: Column, rel_tol: Column, wrong_layer: Column) -> tuple[Column, Column]:
    """RMS that still scores 1 and RMS that scores 0 for a case."""
    good = F.greatest(target * (1.0 + rel_tol), target + 5e-5)
    bad = F.greatest(target * 6.0, F.lit(3.0e-3))
    return good, F.when(wrong_layer > good, F.greatest(good * 1.5, wrong_layer)).otherwise(bad)


def score_submissions(submitted: DataFrame, truth: DataFrame, cases: DataFrame, *, by: Sequence[str] = ("submission_id",)) -> DataFrame:
    """Score submitted (case, day, dvv) series; a wrong length scores 0.

    ``cases``: case_id, rms_target, rel_tol, rms_wrong_layer, n_days.  Where a series of zeros is
    worse than what still scores 1, its error is what scores 0.
    """
    keys = [*by, "case_id"]
    counts = submitted.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    rms = rms_baseline_aligned(submitted.join(truth, ["case_id", "day"]), keys)
    good, bad = score_thresholds(F.col("rms_target"), F.col("rel_tol"), F.col("rms_wrong_layer"))
    zeros = rms_baseline_aligned(truth.select("case_id", "day", "truth", F.lit(0.0).alias("dvv")), ["case_id"])
    zeros = zeros.select("case_id", F.col("rms").alias("_null"))
    bad = F.when(F.col("_null") > good, F.col("_null")).otherwise(bad)
    out = counts.join(cases, "case_id").join(zeros, "case_id", "left").join(rms.select(*keys, "rms"), keys, "left")
    score = F.when(F.col("n_rows") != F.col("n_days"), 0.0).otherwise(score_from_rms(F.col("rms"), good, bad))
    return out.select(*keys, "n_rows", "rms", score.alias("score"))


def config_submissions(submitted: DataFrame, *, estimators: Sequence[str]) -> DataFrame:
    """Submitted configs checked and completed from the use-case defaults.

    Needs estimator, band and window to be present and valid; ``valid`` is false
    otherwise (such rows score 0 without a run).
    """
    def ordered(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(f"{c}.hi") > F.col(f"{c}.lo"))

    valid = F.coalesce(F.col("estimator").isin(*estimators) & ordered("band") & ordered("window"), F.lit(False))
    out = recommend_config(submitted.withColumn("valid", valid), overrides=AXES)
    return out.withColumn("valid", F.col("valid") & F.col("use_case").isNotNull())
